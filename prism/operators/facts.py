"""Facts of source texts: symbols, calls, imports and exports of Python by its own syntax tree, calls of scripts and PHP by a scan.

There is no grammar of scripts and PHP here that builds trees: their calls are found in the text with comments and strings
blanked, declarations told by the symbols that are known to begin there. What a scan cannot see (a callee that is an
expression) is reported as such.
"""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Receivers that stand for the enclosing type; names that look like calls and are none.
SELF = frozenset(["this", "self", "cls", "super", "parent", "static", "$this"])
NOT_REFERENCES = frozenset(["super", "import", "require"])
# Words before a bracket that are no callee.
_WORDS = frozenset(
    "if for while switch catch return typeof instanceof void delete await yield throw case do else in of new function fn with elseif foreach echo print isset unset empty list array exit die include "
    "include_once require_once use and or xor not lambda assert del from as try finally match constructor async get set".split()
)
_SEPARATOR = re.compile(r"\?\.|->|::|\.|\\")
_IDENTIFIER = re.compile(r"[^\W\d][\w$]*|\$[\w$]*", re.U)
_OPEN = {"(": ")", "[": "]", "{": "}", "<": ">"}


def parse_callee(text: str) -> tuple[str | None, str | None, str | None]:
    """(name, kind of receiver, receiver) of a callee as written: parts joined by ``.``, ``?.``, ``->``, ``::`` or a backslash
    outside brackets. No name: it is an expression. Kinds: None, self, name, complex."""
    parts, depth, at, i = [], [], 0, 0
    text = text.strip()
    while i < len(text):
        c = text[i]
        if depth and c == depth[-1]:
            depth.pop()
        elif c in _OPEN:
            depth.append(_OPEN[c])
        elif not depth and (m := _SEPARATOR.match(text, i)):
            parts.append(text[at:i])
            at = i = m.end()
            continue
        i += 1
    parts.append(text[at:])
    names = []
    for p in parts:
        p = re.sub(r"[?!]+$", "", re.sub(r"(?<=.)<.*>$", "", p.strip()))
        names.append(p if _IDENTIFIER.fullmatch(p) else None)
    if names[-1] is None:
        return None, None, None
    if len(names) == 1:
        return names[0], None, None
    if None in names[:-1]:
        return names[-1], "complex", None
    if len(names) == 2 and names[0] in SELF:
        return names[-1], "self", None
    return names[-1], "name", ".".join(names[:-1])


# ---- Python


def _python(path: str, text: str) -> tuple[list, list, list] | None:
    """(symbols, calls, imports) of a Python text; None where it does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text.removeprefix("﻿"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    symbols, calls, imports, seen = [], [], [], {}

    def ident(name: str) -> str:
        seen[name] = seen.get(name, 0) + 1
        return f"{path}#{name}" + (f"~{seen[name]}" if seen[name] > 1 else "")

    def declare(node, kind: str, base: str, up: tuple, params=None, alias=None, doc=None) -> tuple:
        name = f"{up[1]}.{base}" if up[1] else base
        key = ident(name)
        first = min([node.lineno, *[d.lineno for d in getattr(node, "decorator_list", [])]])
        symbols.append((path, len(symbols), key, name, base, kind, up[0], first, node.end_lineno, params, doc, alias))
        return key, name, kind

    def visit(node, up: tuple) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            a = node.args
            names = [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs)] + [x.arg for x in (a.vararg, a.kwarg) if x]
            own = declare(node, "method" if up[2] == "class" else "function", node.name, up, ", ".join(names), None, ast.get_docstring(node))
            for x in (*node.decorator_list, a, *([node.returns] if node.returns else [])):
                visit(x, up)
            for x in node.body:
                visit(x, own)
            return
        if isinstance(node, ast.ClassDef):
            own = declare(node, "class", node.name, up, None, None, ast.get_docstring(node))
            for x in (*node.decorator_list, *node.bases, *node.keywords):
                visit(x, up)
            for x in node.body:
                visit(x, own)
            return
        if isinstance(node, (ast.Assign, ast.AnnAssign)) and (up[0] is None or up[2] == "class"):
            target = node.targets[0] if isinstance(node, ast.Assign) else node.target
            if isinstance(target, ast.Name) and node.value is not None:
                alias = node.value.id if isinstance(node.value, ast.Name) else None
                fn = isinstance(node.value, ast.Lambda)
                if fn or alias or target.id.isupper():
                    declare(node, "function" if fn else "constant" if target.id.isupper() else "variable", target.id, up, None, alias)
        if isinstance(node, ast.Import):
            for x in node.names:
                imports.append((path, len(imports), node.lineno, x.name, [("*", x.asname or x.name.split(".")[0])]))
        elif isinstance(node, ast.ImportFrom):
            imports.append((path, len(imports), node.lineno, "." * node.level + (node.module or ""), [(x.name, x.asname or x.name) for x in node.names]))
        elif isinstance(node, ast.Call):
            name, kind, receiver = _callee(node.func)
            if name is None or kind is not None or name not in NOT_REFERENCES:
                calls.append((path, len(calls), up[0], name, kind, receiver, "call", node.lineno))
        for x in ast.iter_child_nodes(node):
            visit(x, up)

    for x in tree.body:
        visit(x, (None, "", None))
    return symbols, calls, imports


def _callee(f: ast.expr) -> tuple[str | None, str | None, str | None]:
    names: list[str] = []
    while isinstance(f, ast.Attribute):
        names.append(f.attr)
        f = f.value
    if isinstance(f, ast.Name):
        names.append(f.id)
    elif isinstance(f, ast.Call) and names and isinstance(f.func, ast.Name) and f.func.id == "super":
        names.append("super")
    elif not names:
        return None, None, None
    else:
        return names[0], "complex", None
    names.reverse()
    if len(names) == 1:
        return names[0], None, None
    return (names[-1], "self", None) if len(names) == 2 and names[0] in SELF else (names[-1], "name", ".".join(names[:-1]))


SYMBOLS = "path string, seq int, id string, name string, base_name string, kind string, parent_id string, start_line int, end_line int, params string, doc string, alias_of string"
CALLS = "path string, seq int, caller string, name string, receiver_kind string, receiver string, kind string, line int"
IMPORTS = "path string, seq int, line int, specifier string, names array<struct<imported:string,local:string>>"


def _own(texts: DataFrame, which: int, schema: str) -> DataFrame:
    columns = [c.strip().split()[0] for c in re.sub(r"<[^>]*>+", "", schema).split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, text in zip(f["path"], f["content"], strict=True):
                found = _python(path, text)
                if found:
                    rows += found[which]
            out = pd.DataFrame(rows, columns=columns)
            if "names" in columns:
                out["names"] = [[{"imported": a, "local": b} for a, b in n] for n in out["names"]]
            yield out

    t = texts.where("path like '%.py' and content is not null").select("path", "content").distinct()
    return t.mapInPandas(run, schema)


def python_symbols(texts: DataFrame) -> DataFrame:
    """The declarations of Python texts: ids are path#qualified.name, with ~n for the nth of a name; parameters as names."""
    return _own(texts, 0, SYMBOLS)


def python_imports(texts: DataFrame) -> DataFrame:
    return _own(texts, 2, IMPORTS)


# ---- scripts and PHP

_BLANK = re.compile(r"/\*.*?\*/|//[^\n]*|(?m:(?<![\w$\])])#(?!\[)[^\n]*)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
_SCRIPT_BLANK = re.compile(r"/\*.*?\*/|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|(?<=[=(,:;!&|?{}\n])\s*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*", re.S)
_CALL = re.compile(r"(\bnew\s+)?((?:[$\\]?[A-Za-z_$][\w$]*)(?:\s*(?:\?\.|->|::|\.|\\)\s*[$A-Za-z_][\w$]*)*)\s*(?:<[\w\s,<>\[\]|.]*>)?\(")
_DECLARED = re.compile(r"\b(?:function\*?|fn)\s+&?$")


def scan_calls(text: str, php: bool = False) -> list[tuple]:
    """(name, receiver kind, receiver, kind, line) of the calls in a script or PHP text."""
    code = (_BLANK if php else _SCRIPT_BLANK).sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    out, line, at = [], 1, 0
    for m in _CALL.finditer(code):
        line += code.count("\n", at, m.start())
        at = m.start()
        name, kind, receiver = parse_callee(re.sub(r"\s+", "", m[2]))
        before = code[max(0, m.start() - 40) : m.start()]
        if name in _WORDS and kind is None or _DECLARED.search(before):
            continue
        if re.search(r"(?:\?\.|->|::|\.)\s*$", before):
            kind, receiver = "complex", None
        if name is None or kind is None and name in NOT_REFERENCES:
            continue
        out.append((name, kind, receiver, "new" if m[1] else "call", line + code.count("\n", m.start(), m.start(2))))
    return out


def call_sites(texts: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, seq, caller, name, receiver_kind, receiver, kind, line) of every call. caller: the innermost symbol that spans the
    line, null outside of all. The head of a method is no call. Repeated rows and texts
    that do not parse (Python) give none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, text in zip(f["path"], f["content"], strict=True):
                if path.endswith(".py"):
                    found = _python(path, text)
                    rows += [(path, i, n, k, r, how, line) for i, _, n, k, r, how, line in (c[1:] for c in found[1])] if found else []
                else:
                    rows += [(path, i, *c) for i, c in enumerate(scan_calls(text.replace("\r\n", "\n").replace("\r", "\n"), path.endswith(".php")))]
            yield pd.DataFrame(rows, columns=["path", "seq", "name", "receiver_kind", "receiver", "kind", "line"])

    t = texts.where(F.col("path").rlike(r"\.(py|php|[mc]?[jt]sx?)$") & F.col("content").isNotNull()).select("path", "content").distinct()
    sites = t.mapInPandas(run, "path string, seq int, name string, receiver_kind string, receiver string, kind string, line int")
    # a method of a script is written as its call is: the first on the line where it begins
    begun = symbols.where("kind in ('method', 'constructor') and path not like '%.py' and path not like '%.php'").select("path", F.col("base_name").alias("name"), F.col("start_line").alias("line")).distinct()
    heads = sites.join(begun, ["path", "name", "line"], "left_semi").groupBy("path", "name", "line").agg(F.min("seq").alias("seq"))
    sites = sites.join(heads, ["path", "name", "line", "seq"], "left_anti")
    spans = symbols.select("path", "id", "start_line", "end_line", F.col("seq").alias("s_seq")).distinct()
    j = sites.join(spans, "path").where("line between start_line and end_line")
    inner = j.groupBy("path", "line").agg(F.max(F.struct("start_line", (-F.col("end_line")).alias("e"), "s_seq", "id"))["id"].alias("caller"))
    return sites.join(inner, ["path", "line"], "left").select("path", "seq", "caller", "name", "receiver_kind", "receiver", "kind", "line")


def exports_of(texts: DataFrame) -> DataFrame:
    """(path, name, local): names that a script exports by a list or as its default."""
    t = texts.where(F.col("path").rlike(r"\.[mc]?[jt]sx?$") & F.col("content").isNotNull()).select("path", "content").distinct()
    lists = t.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]*export\s*\{([^}]*)\}(?!\s*from)"), F.lit(1))).alias("l"))
    one = lists.select("path", F.explode(F.split("l", ",")).alias("p")).select("path", F.trim(F.regexp_replace("p", r"\s+", " ")).alias("p")).where("p <> ''")
    named = one.select("path", F.regexp_extract("p", r"([\w$]+)$", 1).alias("name"), F.regexp_extract("p", r"^(?:type )?([\w$]+)", 1).alias("local"))
    default = t.select("path", F.lit("default").alias("name"), F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]*export\s+default\s+([A-Za-z_$][\w$]*)\s*;?[ \t]*$"), F.lit(1))).alias("local"))
    return named.unionByName(default).distinct()


# ---- outlines of Python: callables, bodies, shapes


def _body_kind(body: list[ast.stmt]) -> tuple[str, int]:
    """(kind, statements) of a body: empty, comment-only, throw-only, return-literal or real; a docstring is no statement."""
    own = [b for b in body if not (isinstance(b, ast.Expr) and isinstance(b.value, ast.Constant) and isinstance(b.value.value, str))]
    n = len(own)
    if not own:
        return "comment-only" if body else "empty", 0
    if all(isinstance(b, ast.Pass) or isinstance(b, ast.Expr) and isinstance(b.value, ast.Constant) and b.value.value is ... for b in own):
        return "empty", n
    if n == 1 and isinstance(own[0], ast.Raise):
        return "throw-only", 1
    if n == 1 and isinstance(own[0], ast.Return) and (own[0].value is None or isinstance(own[0].value, ast.Constant)):
        return "return-literal", 1
    return "real", n


def _shape(node: ast.AST) -> tuple[str, int]:
    """(digest, nodes) of a tree in which names and literals count alike, while operators and the build of it do not; bottom-up."""
    parts, n = [type(node).__name__], 1
    if isinstance(node, ast.Constant):
        return hashlib.sha256(b"LIT").hexdigest()[:16], 1
    if isinstance(node, (ast.Name, ast.arg, ast.alias)):
        parts = ["ID"]
    for child in ast.iter_child_nodes(node):
        if isinstance(child, (ast.expr_context,)):
            continue
        digest, k = _shape(child)
        parts.append(digest)
        n += k
    return hashlib.sha256(" ".join(parts).encode()).hexdigest()[:16], n


def _outline(path: str, text: str) -> list[tuple] | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text.removeprefix("﻿"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    rows: list[list] = []

    def add(node: ast.AST, tag: str, name: str, up: int | None, attrs: dict[str, str]) -> int:
        rows.append([path, len(rows) + 1, 0, up, tag, name, {"name": name, "line": str(node.lineno), "endLine": str(node.end_lineno), **attrs}])
        return len(rows)

    def walk(node: ast.AST, up: int | None, names: list[str], in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
                a = child.args
                params = ast.unparse(a)
                base = getattr(child, "name", "")
                returns = ast.unparse(child.returns) if getattr(child, "returns", None) else ""
                full = ".".join([*names, base]) if base else ""
                kind, n = _body_kind(child.body) if base else ("real", 1)
                shape, size = _shape(child)
                body = hashlib.sha256(" ".join(_shape(b)[0] for b in (child.body if base else [child.body])).encode()).hexdigest()[:16]
                attrs = {"params": params, "signature": f"{base}({params})" + (f":{returns}" if returns else ""), "signatureHash": hashlib.sha256(f"({params}):{returns}".encode()).hexdigest()[:16], "bodyKind": kind, "statements": str(n), "shape": shape, "shapeNodes": str(size), "bodyShape": body, "callable": "true"}
                attrs |= {"returns": returns} if returns else {}
                attrs |= {"doc": d} if base and (d := ast.get_docstring(child)) else {}
                own = add(child, "method" if base and in_class else "function" if base else "lambda", full, up, attrs)
                walk(child, own, [*names, base] if base else names, False)
                rows[own - 1][2] = len(rows)
            elif isinstance(child, ast.ClassDef):
                own = add(child, "class", ".".join([*names, child.name]), up, {"shape": _shape(child)[0]} | ({"doc": d} if (d := ast.get_docstring(child)) else {}))
                walk(child, own, [*names, child.name], True)
                rows[own - 1][2] = len(rows)
            else:
                walk(child, up, names, in_class and isinstance(child, (ast.If, ast.Try, ast.With)))

    walk(tree, None, [], False)
    return [tuple(r) for r in rows]


def python_outlines(texts: DataFrame) -> DataFrame:
    """(path, pre, end_pre, parent_pre, tag, name, attrs) of the classes and callables of Python texts: parameters, returns, signature and
    its digest, the kind of the body with its statements, and digests of shape in which names and literals count alike. Texts
    that do not parse have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for path, text in zip(f["path"], f["content"], strict=True) for r in _outline(path, text) or []]
            yield pd.DataFrame(rows, columns=["path", "pre", "end_pre", "parent_pre", "tag", "name", "attrs"]).astype({"parent_pre": "Int64"})

    t = texts.where("path like '%.py' and content is not null").select("path", "content").distinct()
    return t.mapInPandas(run, "path string, pre int, end_pre int, parent_pre int, tag string, name string, attrs map<string,string>")


def component_of(path: str) -> str:
    """The name of the symbol that a single-file component stands for: that of its file, in capitals."""
    base = re.sub(r"\.[^.]*$", "", path.rpartition("/")[2])
    return "".join(w[:1].upper() + w[1:] for w in re.split(r"[^A-Za-z0-9]+", base) if w)


def python_types(texts: DataFrame) -> DataFrame:
    """(path, scope, name, type, origin) of what annotations say: parameters and variables of a function, fields of a class, returns. One
    plain class or nothing; an optional counts as what it holds."""

    def one(a: ast.expr | None) -> str | None:
        if isinstance(a, ast.Constant) and isinstance(a.value, str):
            try:
                a = ast.parse(a.value, mode="eval").body
            except SyntaxError:
                return None
        if isinstance(a, ast.BinOp) and isinstance(a.op, ast.BitOr):
            sides = [x for x in (a.left, a.right) if not (isinstance(x, ast.Constant) and x.value is None)]
            return one(sides[0]) if len(sides) == 1 else None
        if isinstance(a, ast.Subscript) and ast.unparse(a.value).split(".")[-1] == "Optional":
            return one(a.slice)
        return ast.unparse(a) if isinstance(a, (ast.Name, ast.Attribute)) else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, text in zip(f["path"], f["content"], strict=True):
                try:
                    tree = ast.parse(text.removeprefix("﻿"))
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                stack = [(tree, "")]
                while stack:
                    node, scope = stack.pop()
                    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        scope = f"{scope}.{node.name}" if scope else node.name
                    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        rows += [(path, scope, x.arg, t, "parameter") for x in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs) if (t := one(x.annotation))]
                        rows += [(path, scope, "", t, "return")] if (t := one(node.returns)) else []
                    elif isinstance(node, ast.AnnAssign) and (t := one(node.annotation)):
                        field = isinstance(node.target, ast.Attribute) and isinstance(node.target.value, ast.Name) and node.target.value.id == "self"
                        name = node.target.attr if field else node.target.id if isinstance(node.target, ast.Name) else None
                        rows += [(path, scope.rpartition(".")[0] if field else scope, name, t, "property" if field else "variable")] if name else []
                    stack += [(x, scope) for x in ast.iter_child_nodes(node)]
            yield pd.DataFrame(rows, columns=["path", "scope", "name", "type", "origin"])

    t = texts.where("path like '%.py' and content is not null").select("path", "content").distinct()
    return t.mapInPandas(run, "path string, scope string, name string, type string, origin string")
