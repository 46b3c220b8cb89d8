"""Functions paired with their documentation.

A symbol table over all files joins documented declarations with definitions of the same qualified name in the
same package and language that stand elsewhere without documentation; overloads are told apart by a normalised
signature. What the join gives is filtered: a description must say something in words of its own.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prism.session import cut

# Words that add nothing to the name of a callable.
_FILLERS = frozenset(
    "a an the this that these those it its to of for from in on with and or by as is are be at into "
    "function method constructor procedure routine helper callable member step thing stuff code class object instance value values "
    "does do build builds make makes performs perform executes execute implements implementation wrapper new create creates construct constructs initialise initialize "
    "initialises initializes init self given provided specified current used use uses simply just some any here main default "
    "der die das ein eine und le la les un une et el los las y".split()
)
# Orders to tools, as they begin a line.
_TOOL = re.compile(
    r"^@?(?:eslint(?:-\w+)*|tslint\S*|jshint|jslint|jscs|prettier-ignore\S*|noqa|type:\s*ignore|pylint|flake8|ruff|mypy|pyright|isort|fmt:|yapf|black|pragma\b|nosec|"
    r"istanbul|c8 ignore|v8 ignore|nyc|biome-ignore|biome|deno-lint\S*|oxlint\S*|stylelint\S*|ts-(?:ignore|expect-error|nocheck|check)|phpcs\S*|phpstan\S*|psalm\S*|"
    r"codecoverageignore\S*|codeCoverageIgnore\S*|nolint\S*|noinspection|sonar\S*|nosonar|cspell\S*|spell-?checker|webpack\S*|vite-ignore|region|endregion|coding[:=]|-\*-|vim:|"
    r"no-?cover|clang-format|lint\b|suppress\w*|formatter:|checkstyle\S*)",
    re.I,
)
_LICENCE = re.compile(
    r"SPDX-License-Identifier|^\W*(?:copyright\b|\(c\)\s|©)|all rights reserved|\blicen[sc]ed under\b|\blicen[sc]e\b.*\b(?:terms|file|apache|mit|gpl|bsd)\b|^\W*(?:this file is part of|permission is hereby granted)|"
    r"(?:apache|mit|gpl|bsd)[- ]licen[sc]e|redistribution and use|without warranty",
    re.I,
)
_NOTE = re.compile(r"^\W*(?:todo|fixme|xxx|hack|tbd|wip|bug|nocommit|optimi[sz]e|refactor|review|note to self|to ?do)\b(?!\s+(?:list|item)s?\b)\s*(?:\([^)]*\))?\s*[:\-–—]*\s*", re.I)
_POINTER = re.compile(
    r"^\W*(?:see(?: also)?\b(?!\w).{0,120}|(?:same|similar) as\b.{0,80}|as above|ditto|idem|refer to\b.{0,100}|cf\.? .{0,80}|inherit(?:ed|s|doc)?\b.{0,60}|overrid(?:es|den|e)\b.{0,60}|"
    r"(?:documented|described|defined|explained) (?:in|at|elsewhere|above|below)\b.{0,80}|(?:read )?more (?:at|in)\b.{0,80}|docs?: .{0,80}|documentation(?: is)? (?:at|in)\b.{0,80})$",
    re.I,
)
_TEMPLATE = re.compile(
    r"^\W*(?:auto[- ]?generated\b.*|(?:automatically )?(?:generated|created) (?:by|with|from|on|using)\b.*|short description|long description|(?:method|function|class|add|your|insert|enter)?\s*(?:a )?(?:description|documentation|summary|docstring|doc|comment)s?"
    r"(?: of (?:the |what )?\w+(?: \w+)*)?(?: goes)?(?: here)?|description of (?:the )?\w+(?: here)?|(?:missing|no|none|needs?|lacks?|undocumented|not yet)\b ?(?:doc(?:s|umented|umentation|string)?|description|comments?)?|"
    r"n/?a|none|null|nil|undefined|unknown|tbd|lorem ipsum\b.*|placeholder|empty|fill (?:me )?in\b.*|write (?:me|docs?|this)\b.*|describe\b(?: (?:me|this|here|what|it)\b.*)?|(?:do not|don't) edit\b.*|non-?javadoc|@?generated)\W*$",
    re.I,
)
_BRACKETED = re.compile(r"^\W*(?:\[[^\]\[]*\]|<[^<>]*>|\{\{?[^{}]*\}\}?|_{2,}|\.{3,})\W*$")
_URL = re.compile(r"(?:https?|ftp)://\S+|www\.\S+")
_INLINE_TAG = re.compile(r"\{@\w+[^{}]*\}")
_TAG = re.compile(r"^(?:@\w[\w-]*|\\(?:param|return|brief)\b|:(?:param|type|returns?|rtype|raises?|see)\b[^:]*:)")
#: Tags whose text describes the callable itself.
_TELLING = re.compile(r"^(?:@(?:description|desc|summary|brief|remarks?|abstract|fileoverview|overview|notice|dev)|\\brief)\b\s*", re.I)
_SECTION = re.compile(r"^(?:args?|arguments|params?|parameters|returns?|raises|yields|throws|examples?|usage|see also|since|deprecated|attributes|notes?)\s*:\s*$", re.I)
_CODE = re.compile(
    r"[;{}]\s*$|^\s*(?:return|const|let|var|if|for|foreach|while|switch|try|catch|throw|import|from|export|def|class|function|public|private|protected|static|echo|print|await|use|namespace|raise|elif|else|yield|async)\b.*[(){};=:]|"
    r"^\s*[\w.$\->\[\]'\"]+\s*(?:[+\-*/|&]?=)[^=].*|^\s*[\w.$]+(?:->|\.|::)?\w*\([^()\s]*(?:,\s*[^()\s]*)*\)\s*;?\s*$|=>|^\s*\$\w+|^\s*(?:curl|npm|pip|git|export|docker|php|python|node)\s+[-\w\"'./]"
)
_SECRETISH = re.compile(r"^\W*[\w.-]*(?:key|token|secret|passw(?:or)?d|pwd|dsn|auth\w*|login|credential\w*)\w*\"?\s*[:=]\s*\S+|^-----(?:BEGIN|END)|^authorization:|^[A-Za-z0-9+/=_-]{40,}$|^data:\w+/", re.I)
_HUMP = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W\d_]+)?")


def bare_text(doc: str) -> str:
    """The comment without its marks: delimiters, the stars or slashes before each line, common indents."""
    s = doc.replace("\r\n", "\n").replace("\r", "\n").strip("﻿ \t\n")
    s = re.sub(r'^(?:[rRbBuU]?"""|[rRbBuU]?\'\'\'|/\*+!?|<!--)', "", s)
    s = re.sub(r'(?:"""|\'\'\'|\*+/|-->)$', "", s)
    lines = [re.sub(r"^\s*(?:/{2,}!?|#+(?!\w)|\*(?!\*)|--(?!-)|;+)[ \t]?", "", ln) if re.match(r"^\s*(?://|#|\*|--|;)", ln) else ln for ln in s.split("\n")]
    body = [ln for ln in lines[1:] if ln.strip()]
    indent = min((len(ln) - len(ln.lstrip()) for ln in body), default=0)
    return "\n".join([lines[0].strip(), *[ln[indent:].rstrip() for ln in lines[1:]]]).strip("\n")


def _stem(w: str) -> str:
    w = w.lower()
    for end in ("isations", "izations", "ations"):
        if w.endswith(end) and len(w) > len(end) + 2:
            return w[: -len(end)]
    for end in ("ings", "ing", "ies", "ied", "ers", "ed", "es", "er", "s", "e", "y"):
        if w.endswith(end) and len(w) > len(end) + 2:
            w = w[: -len(end)]
            break
    if len(w) > 3 and w[-1] == w[-2]:
        w = w[:-1]
    return w[:-1] if w and w[-1] in "ey" and len(w) > 3 else w


def _drop_note(block: str) -> str:
    """A paragraph without its notes to self; a note goes to the end of its sentence, or of its line where it holds no more."""
    lines = block.split("\n")
    out: list[str] = []
    i = 0
    while i < len(lines):
        m = _NOTE.match(lines[i])
        if not m:
            out.append(lines[i])
            i += 1
            continue
        rest = lines[i][m.end() :]
        while not (end := re.search(r"[.!?](?=\s|$)", rest)) and rest.strip() and i + 1 < len(lines) and (lines[i + 1][:1].islower() or lines[i + 1][:1] in "(\"'`"):
            i += 1
            rest += " " + lines[i]
        if end:
            tail = rest[end.end() :].strip()
            if tail and not _NOTE.match(tail):
                out.append(tail)
        i += 1
    return "\n".join(out)


@lru_cache(maxsize=1 << 14)
def description(doc: str | None, names: str = "") -> str | None:
    """What a documentation comment says in words of its own, or None.

    Left out: tags and their continued lines, sections of arguments, ornaments, notes to self, licences, orders
    to tools, pointers elsewhere, disabled code, lines that only hold values, templates. names: the words of the
    symbol's own names, which alone say nothing.
    """
    if not doc or not doc.strip():
        return None
    text = _INLINE_TAG.sub(" ", bare_text(doc))
    kept: list[str] = []
    fence = False
    for block in re.split(r"\n[ \t]*\n", text):
        lines: list[str] = []
        tag = False
        for line in _drop_note(block).split("\n"):
            s = line.strip()
            if s.startswith(("```", "~~~")):
                fence = not fence
                continue
            if fence or not s:
                continue
            if m := _TELLING.match(s):
                tag = False
                s = s[m.end() :]
            elif _TAG.match(s) or _SECTION.match(s):
                tag = True
                continue
            elif tag and (line[:1].isspace() or s[:1].islower()):
                continue
            else:
                tag = False
            if line.startswith(("    ", "\t")) and not lines:
                continue
            if _TOOL.match(s) or _LICENCE.search(s) or _SECRETISH.search(s) or _CODE.search(s) or _BRACKETED.match(s):
                continue
            lines.append(s)
        if not lines:
            continue
        said = " ".join(lines)
        if _TEMPLATE.match(said) or _LICENCE.search(said) or _POINTER.match(said):
            continue
        parts = [p for p in re.split(r"(?<=[.!?])\s+", said) if not (_TEMPLATE.match(p) or _POINTER.match(p) or _BRACKETED.match(p) or _NOTE.match(p))]
        said = _URL.sub(" ", " ".join(parts)).strip()
        if said:
            kept.append(said)
    whole = " ".join(kept)
    humps = [w.lower() for w in _HUMP.findall(names)]
    own = {_stem(w) for w in humps} | {_stem(a + b) for a, b in zip(humps, humps[1:])} | {_stem("".join(_HUMP.findall(n))) for n in re.split(r"[\s.#:]+", names)}
    new = [w for w in _WORD.findall(whole) if not (_stem(w) in own or w.lower() in _FILLERS)]
    new = [w for w in new if any(ch.isalpha() for ch in w)]
    content = [w for w in _WORD.findall(whole) if w.lower() not in _FILLERS]
    # one new word beside a word of the name ("Run dense.") is a name restated
    if not new or len(content) < 2 or len(new) == 1 and len(content) < 3:
        return None
    return whole


@F.pandas_udf(T.StringType())
def _description(doc: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([description(d, n or "") for d, n in zip(doc, names, strict=True)], dtype=object)


def normal_kind(c: Column | str) -> Column:
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


#: The kinds that can be called.
CALLABLE = ("function", "method", "constructor", "func", "fn", "ctor", "procedure", "subroutine", "accessor", "getter", "setter")


def normal_signature(c: Column | str) -> Column:
    """A signature without blanks, parameter names, defaults and qualifiers: what tells overloads apart."""
    s = F.regexp_replace(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), r"^[\w.$\\:]*(?=\()", "")
    s = F.regexp_replace(s, r"""=\s*(?:"[^"]*"|'[^']*'|[^,()]+)""", "")
    s = F.regexp_replace(s, r"(?:[\w$]+\s*\??\s*:\s*)(?=[^,()]+[,)])", "")
    return F.regexp_replace(s, r"\s+|\$\w+", "")


def symbol_table(symbols: DataFrame) -> DataFrame:
    """Callables with the key of their overload: package root and directory aside, language, qualified name, signature.

    Rows without id or kind are left out; repeated rows count once.
    """
    k = normal_kind("kind")
    rows = symbols.where(k.isin(*CALLABLE) & F.col("id").isNotNull()).select("id", "path", "name", "base_name", k.alias("kind"), "parent_id", "signature", "doc").distinct()
    repo = F.substring_index("path", "/", 2)
    ext = F.regexp_extract("path", r"\.(\w+)$", 1)
    qualified = F.regexp_replace(F.coalesce(F.regexp_extract("id", r"#(.*)$", 1), "name"), r"~\d+$", "")
    names = F.concat_ws(" ", "name", "base_name", qualified)
    return rows.select("*", names.alias("names"), F.xxhash64(repo, ext, qualified, normal_signature("signature")).alias("overload"))


def doc_pairs(symbols: DataFrame) -> DataFrame:
    """(id, kind, signature, description, doc_id): each callable with its description.

    doc_id is the symbol whose doc it is: the symbol's own, or else, for a definition without any doc, a documented
    declaration of the same overload in its repository (the longest, of equals the last by id). Joined first, filtered after; each
    comment is read once, however many definitions it goes to. Callables without a telling doc are left out. Null and blank
    docs, repeated rows and empty tables give no pair of their own. A hot overload key costs nothing extra: declarations are
    reduced to one a key before the join, and only definitions without a doc look for one.
    """
    t = symbol_table(symbols)
    silent = F.col("doc").isNull() | (F.trim("doc") == "")
    read = cut(t.where(~silent).select("id", "kind", "signature", "overload", F.length("doc").alias("length"), _description("doc", "names").alias("description")))
    declared = read.groupBy("overload").agg(F.max_by(F.struct("id", "description"), F.struct("length", "id")).alias("d"))
    lent = t.where(silent).select("id", "kind", "signature", "overload").join(declared, "overload").select("id", "kind", "signature", "d.description", F.col("d.id").alias("doc_id"))
    mine = read.select("id", "kind", "signature", "description", F.col("id").alias("doc_id"))
    return mine.unionByName(lent).where("description is not null")
