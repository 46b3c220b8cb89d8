"""Token kinds of source texts. Each lexer gives (kind, place, begins a line); the kind "?" is no token of the language."""

from __future__ import annotations

import re

Token = tuple[str, int, bool]
BAD = "?"

# --- JSON -------------------------------------------------------------------------------------------------------------

_JSON = re.compile(r'[ \t\r\n]+|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null)\b|([\[\]{},:])')


def json_tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _JSON.match(text, at)
        if not m:
            out.append((BAD, at, False))
            break
        if m.lastindex:
            out.append(("string" if m[1] else "number" if m[2] else "word" if m[3] else m[4], at, False))
        at = m.end()
    return out


# --- Python -----------------------------------------------------------------------------------------------------------

_PY_WORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type".split())
_PY_STRING = re.compile(
    r"(?:[rR][bBfFtT]?|[bBfFtT][rR]?|[uU])?(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?!\"\")(?:[^\"\\\n]|\\.)*\"|'(?!'')(?:[^'\\\n]|\\.)*')", re.S
)
_PY_NUMBER = re.compile(
    r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*[jJ]?|(?:0(?:_?0)*|[1-9](?:_?\d)*)[jJ]?|\d(?:_?\d)*[jJ])(?![0-9A-Za-z_])"
    r"|(?:0(?:_?0)*|[1-9](?:_?\d)*)(?=(?:if|in|is|or|and|else|for|not)\b)"
)
_PY_NAME = re.compile(r"[^\W\d]\w*")
_PY_OP = re.compile(r"\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|\*\*|//|<<|>>|<=|>=|==|!=|[-+*/%@&|^~<>()\[\]{},:.;=]")
_AUG = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())


def python_tokens(text: str) -> list[Token]:
    text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    out: list[Token] = []
    indents, depth, at, n = [0], [], 0, len(text)
    pairs = {")": "(", "]": "[", "}": "{"}
    fresh = True
    while at < n:
        if fresh and not depth:
            start = at
            width = 0
            while at < n and text[at] in " \t\f":
                width = width + 1 if text[at] == " " else (width // 8 + 1) * 8 if text[at] == "\t" else 0
                at += 1
            if at >= n:
                break
            if text[at] == "\n":
                at += 1
                continue
            if text[at] == "#":
                at = (text.find("\n", at) + 1) or n
                continue
            if text.startswith("\\\n", at):
                at += 2
                fresh = False
                continue
            if width > indents[-1]:
                indents.append(width)
                out.append(("INDENT", start, True))
            while width < indents[-1]:
                indents.pop()
                out.append(("DEDENT", at, True))
            if width != indents[-1]:
                out.append((BAD, at, True))
                return out
            fresh = False
        c = text[at]
        if c == "\n":
            if not depth:
                out.append(("NEWLINE", at, False))
                fresh = True
            at += 1
        elif c in " \t\f":
            at += 1
        elif c == "#":
            at = text.find("\n", at) if "\n" in text[at:] else n
        elif c == "\\" and text.startswith("\n", at + 1):
            at += 2
        elif m := _PY_STRING.match(text, at):
            out.append(("STRING", at, False))
            at = m.end()
        elif m := _PY_NUMBER.match(text, at):
            out.append(("NUMBER", at, False))
            at = m.end()
        elif m := _PY_NAME.match(text, at):
            if text[m.end() : m.end() + 1] in ("'", '"') and re.fullmatch(r"[rRbBfFuUtT]{1,2}", m[0]):
                out.append((BAD, at, False))
                return out
            out.append((m[0] if m[0] in _PY_WORDS else "NAME", at, False))
            at = m.end()
        elif m := _PY_OP.match(text, at):
            op = m[0]
            if op in "([{":
                depth.append(op)
            elif op in pairs:
                if not depth or depth.pop() != pairs[op]:
                    out.append((BAD, at, False))
                    return out
            out.append(("aug" if op in _AUG else op, at, False))
            at = m.end()
        else:
            out.append((BAD, at, False))
            return out
    if depth:
        return out  # open brackets: the stream ends within an expression
    if out and out[-1][0] not in ("NEWLINE", "DEDENT"):
        out.append(("NEWLINE", n, False))
    out += [("DEDENT", n, False)] * (len(indents) - 1)
    return out


# --- JavaScript and TypeScript ----------------------------------------------------------------------------------------

_JS_OWN = frozenset(
    "of async get set from as target await static const new import export default this super null function class extends return if else for in while do switch case break continue throw try catch finally var let "
    "typeof yield instanceof debugger with enum".split()
)
_TS_OWN = frozenset("type interface declare namespace module abstract readonly keyof infer is asserts satisfies unique implements public protected override accessor out global void".split())
_JS_RESERVED_STRICT = frozenset("implements interface package private protected public let static yield".split())
_JS_SKIP = re.compile(r"(?:[ \t\v\f\xa0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000]+|//[^\n\r\u2028\u2029]*|/\*(?:[^*]|\*(?!/))*\*/)")
_JS_NAME = re.compile(r"[#]?(?:[^\W\d]|[$]|\\u[0-9a-fA-F]{4})(?:\w|[$\u200c\u200d]|\\u[0-9a-fA-F]{4})*")
_JS_NUMBER = re.compile(
    r"(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:0|[1-9](?:_?\d)*)n|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)(?![\w$])"
)
_JS_STRING = re.compile(r"\"(?:[^\"\\\n\r]|\\(?:\r\n|.))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|.))*'", re.S)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*(?![\w$])")
_JS_OP = re.compile(r">>>=|\.\.\.|\*\*=|===|!==|>>=|<<=|&&=|\|\|=|\?\?=|=>|\?\.(?!\d)|\+\+|--|\*\*|&&|\|\||\?\?|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%&|^!~<>()\[\]{},:.;=?@]")
_JS_KIND = {op: "op" for op in "** && || ?? == != === !== <= >= << % ^".split()} | {op: "asg" for op in "+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split()} | {"!": "pre", "~": "pre", "--": "++"}
_JS_AFTER_VALUE = frozenset(["ident", "number", "string", "regex", "tpl", "tpl)", "this", "super", "null", "bool", ")", "]", "}", "private", "++", *("of async get set from as target static type module is out global").split()])


def _ecma_tokens(text: str, typed: bool) -> list[Token]:
    own = _JS_OWN | _TS_OWN if typed else _JS_OWN
    out: list[Token] = []
    at, n, line = 0, len(text), True
    braces: list[bool] = []  # whether each open brace belongs to a template
    last = ""
    if text.startswith("#!"):
        at = text.find("\n") if "\n" in text else n

    def template(i: int) -> tuple[int, str]:
        while i < n:
            c = text[i]
            if c == "\\":
                i += 2
            elif c == "`":
                return i + 1, "end"
            elif c == "$" and text.startswith("{", i + 1):
                return i + 2, "expr"
            else:
                i += 1
        return n, "open"

    while at < n:
        c = text[at]
        if c in "\n\r\u2028\u2029":
            line = True
            at += 1
            continue
        if m := _JS_SKIP.match(text, at):
            if m[0].startswith("/*") and "\n" in m[0]:
                line = True
            at = m.end()
            continue
        start = at
        if c == "`" or c == "}" and braces and braces[-1]:
            if c == "}":
                braces.pop()
            at, how = template(at + 1)
            if how == "open":
                out.append(("unclosed", start, line))
                return out
            last = ("tpl" if how == "end" else "tpl(") if c == "`" else ("tpl)" if how == "end" else "tpl-")
            if how == "expr":
                braces.append(True)
        elif m := _JS_STRING.match(text, at):
            last, at = "string", m.end()
        elif c.isdigit() or c == "." and text[at + 1 : at + 2].isdigit():
            m = _JS_NUMBER.match(text, at)
            if not m:
                out.append((BAD, at, line))
                return out
            last, at = "number", m.end()
        elif m := _JS_NAME.match(text, at):
            w = m[0]
            if w[0] == "#":
                last = "private"
            elif w in ("true", "false"):
                last = "bool"
            elif w in own:
                last = w
            elif w in ("void", "delete"):
                last = "typeof"
            elif w == "private" and typed:
                last = "private_"
            elif w in _JS_RESERVED_STRICT:
                last = "kw"
            else:
                last = "ident"
            at = m.end()
        elif c == "/" and last not in _JS_AFTER_VALUE and (m := _JS_REGEX.match(text, at)):
            last, at = "regex", m.end()
        elif m := _JS_OP.match(text, at):
            op = m[0]
            if op == "{":
                braces.append(False)
            elif op == "}" and braces:
                braces.pop()
            last, at = _JS_KIND.get(op, op), m.end()
        else:
            out.append((BAD, at, line))
            return out
        out.append((last, start, line))
        line = False
    return out


def javascript_tokens(text: str) -> list[Token]:
    return _ecma_tokens(text, False)


def typescript_tokens(text: str) -> list[Token]:
    return _ecma_tokens(text, True)


# --- PHP --------------------------------------------------------------------------------------------------------------

_PHP_OWN = {w: w for w in (
    "enum readonly from self namespace use function const fn class abstract final interface trait extends implements public private protected static var new clone if else elseif endif while endwhile do for endfor foreach endforeach "
    "switch endswitch case default match break continue return try catch finally throw global echo print unset isset empty list array callable as instanceof declare goto insteadof null yield"
).split()} | {"and": "wordop", "or": "wordop", "xor": "wordop", "include": "include", "include_once": "include", "require": "include", "require_once": "include", "exit": "exit", "die": "exit", "__halt_compiler": "__halt", "enddeclare": "kw"}
_PHP_SKIP = re.compile(r"\s+|/\*(?:[^*]|\*(?!/))*\*/|(?://|#(?!\[))(?:(?!\?>)[^\n\r])*")
_PHP_NAME = re.compile(r"\\?[A-Za-z_\x80-\U0010ffff][A-Za-z0-9_\x80-\U0010ffff]*(?:\\[A-Za-z_\x80-\U0010ffff][A-Za-z0-9_\x80-\U0010ffff]*)*\\?")
_PHP_VAR = re.compile(r"\$[A-Za-z_\x80-\U0010ffff][A-Za-z0-9_\x80-\U0010ffff]*")
_PHP_NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*|0[bB][01](?:_?[01])*|0[oO]?[0-7](?:_?[0-7])*(?![.\d])|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d+)?|\d(?:_?\d)*\.?(?:[eE][+-]?\d+)?)(?![A-Za-z_])")
_PHP_SINGLE = re.compile(r"[bB]?'(?:[^'\\]|\\.)*'", re.S)
_PHP_CAST = re.compile(r"\(\s*(?:int|integer|bool|boolean|float|double|real|string|binary|array|object|unset)\s*\)", re.I)
_PHP_HEREDOC = re.compile(r"[bB]?<<<[ \t]*(?:\"(\w+)\"|'(\w+)'|([A-Za-z_]\w*))[^\S\n]*\r?\n")
_PHP_OP = re.compile(r"<<=|>>=|\*\*=|\.\.\.|<=>|===|!==|\?\?=|\?->|->|=>|::|\+\+|--|\*\*|&&|\|\||\?\?|==|!=|<>|<=|>=|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|<<|>>|#\[|\|>|[-+*/%&|^!~<>()\[\]{},:.;=?@$]")
_PHP_KIND = {op: "op" for op in "** && || ?? == != <> === !== <= >= <=> << >> % ^ / < > |>".split()} | {op: "asg" for op in "+= -= *= /= .= %= **= <<= >>= &= |= ^= ??=".split()} | {"!": "pre", "~": "pre", "@": "pre", "--": "++", "&": "amp"}
_PHP_OPEN = re.compile(r"<\?php(?=\s|$)|<\?=", re.I)


def php_tokens(text: str) -> list[Token]:
    """Text outside the tags is one token of its own; a text without a tag is such a token alone."""
    out: list[Token] = []
    n = len(text)

    def quoted(i: int, end: str) -> int:
        """Tokens of an interpolated string from i to its end mark; the place after it, or -1."""
        start, parts, j = i, False, i
        while j < n:
            if end and text.startswith(end, j):
                break
            c = text[j]
            if c == "\\":
                j += 2
            elif c == "{" and text.startswith("$", j + 1) or c == "$" and text.startswith("{", j + 1):
                if not parts:
                    out.append(("is(", start, False))
                    parts = True
                if c == "$":
                    k = text.find("}", j)
                    if k < 0:
                        return -1
                    out.append(("var$", j, False))
                    j = k + 1
                else:
                    j = code(j + 1, True)
                    if j < 0:
                        return -1
                out.append(("is-", j, False))
            else:
                j += 1
        else:
            return -1
        out.append(("is)" if parts else "string", j, False))
        return j + len(end)

    def code(at: int, inner: bool) -> int:
        """Tokens of code up to ?> (or, inside a string, up to the closing brace)."""
        depth = 0
        while at < n:
            if m := _PHP_SKIP.match(text, at):
                at = m.end()
                continue
            c = text[at]
            if text.startswith("?>", at):
                return at
            if c == '"' or c in "bB" and text.startswith('"', at + 1) or c == "`":
                at = quoted(at + (2 if c in "bB" else 1), c if c == "`" else '"')
                if at < 0:
                    return -1
                continue
            if text.startswith("/*", at):
                return -1
            if m := _PHP_SINGLE.match(text, at):
                out.append(("string", at, False))
            elif c == "'":
                return -1
            elif m := _PHP_HEREDOC.match(text, at):
                mark = m[1] or m[2] or m[3]
                e = re.compile(rf"^[ \t]*{mark}(?![A-Za-z0-9_])", re.M).search(text, m.end())
                if not e:
                    return -1
                out.append(("string", at, False))
                at = e.end()
                continue
            elif m := _PHP_VAR.match(text, at):
                out.append(("var$", at, False))
            elif c.isdigit() or c == "." and text[at + 1 : at + 2].isdigit():
                m = _PHP_NUMBER.match(text, at)
                if not m:
                    out.append((BAD, at, False))
                    return n
                out.append(("number", at, False))
            elif m := _PHP_NAME.match(text, at):
                w = m[0].lower()
                prev = out[-1][0] if out else ""
                if w.endswith("\\"):
                    kind = "qname_b"
                elif "\\" in w:
                    kind = "qname" if not w.startswith("namespace\\") else "qname"
                elif prev in ("->", "?->"):
                    kind = "ident"
                elif w == "yield" and (f := re.compile(r"\s+from\b", re.I).match(text, m.end())):
                    out.append(("yield_from", at, False))
                    at = f.end()
                    continue
                elif w in ("enum", "readonly", "from", "self", "match") and re.compile(r"\s*\(").match(text, m.end()) and w != "match":
                    kind = "ident"
                else:
                    kind = _PHP_OWN.get(w, "ident")
                out.append((kind, at, False))
            elif m := _PHP_CAST.match(text, at):
                out.append(("cast", at, False))
            elif m := _PHP_OP.match(text, at):
                op = m[0]
                if inner:
                    if op == "{":
                        depth += 1
                    elif op == "}":
                        if not depth:
                            return at + 1
                        depth -= 1
                out.append((_PHP_KIND.get(op, op), at, False))
            else:
                out.append((BAD, at, False))
                return n
            at = m.end()
        return -1 if inner else n

    at = 0
    while at < n:
        m = _PHP_OPEN.search(text, at)
        if not m:
            out.append(("html", at, False))
            break
        if m.start() > at:
            out.append(("html", at, False))
        if m[0] == "<?=":
            out.append(("echo=", m.start(), False))
        at = code(m.end(), False)
        if at < 0:
            out.append(("unclosed", n, False))
            break
        if text.startswith("?>", at):
            out.append((";", at, False))
            at += 2
            at += 1 if text.startswith("\n", at) else 2 if text.startswith("\r\n", at) else 0
    return out
