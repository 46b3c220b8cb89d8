"""Forms that the index reads and writes: outlines as text, a compiler's index, and untrusted text behind a fence."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Escapes of outline text.
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_BACK = {v[1]: k for k, v in _ESCAPES.items()}
_TOKEN = re.compile(r'\s*(?:(\()|(\))|@([A-Za-z_][\w-]*)="((?:[^"\\]|\\.)*)"|([A-Za-z_][\w-]*))')


class OutlineTextError(ValueError):
    pass


def read_outline(text: str) -> list[tuple[int, int, int | None, str, dict[str, str]]]:
    """(pre, end_pre, parent_pre, tag, attributes) of the nodes of outline text such as ``(class @name="A" (method @name="A.f"))``. An
    attribute that stands twice, an unknown escape and brackets that do not close are errors."""
    out: list[list] = []
    open_: list[int] = []
    at, fresh = 0, False
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise OutlineTextError(f"unexpected {text[at]!r} at {at}")
        if fresh and not m[5]:
            raise OutlineTextError(f"a tag expected at {at}")
        if m[1]:
            fresh = True
        elif m[5]:
            if not fresh:
                raise OutlineTextError(f"( expected before {m[5]} at {at}")
            out.append([len(out) + 1, 0, open_[-1] + 1 if open_ else None, m[5], {}])
            open_.append(len(out) - 1)
            fresh = False
        elif m[2]:
            if not open_:
                raise OutlineTextError(f") without ( at {at}")
            out[open_.pop()][1] = len(out)
        else:
            if not open_ or out[open_[-1]][1] or open_[-1] != len(out) - 1:
                raise OutlineTextError(f"an attribute must follow its tag at {at}")
            attrs = out[-1][4]
            if m[3] in attrs:
                raise OutlineTextError(f"@{m[3]} stands twice at {at}")
            if bad := re.search(r'\\(?![\\"nrt])', re.sub(r"\\\\", "", m[4])):
                raise OutlineTextError(f"unknown escape at {at + bad.start()}")
            attrs[m[3]] = re.sub(r"\\(.)", lambda e: _BACK[e[1]], m[4])
        at = m.end()
    if open_ or fresh:
        raise OutlineTextError("a bracket does not close")
    return [tuple(n) for n in out]


def write_outline(nodes: list[tuple[int, int, int | None, str, dict[str, str]]], pretty: bool = False) -> str:
    """The text of nodes in preorder; read again it gives the same."""
    parts, ends, depth = [], [], 0
    for pre, end, _, tag, attrs in nodes:
        while ends and ends[-1] < pre:
            ends.pop()
            parts.append(")")
        depth = len(ends)
        lead = ("\n" + "  " * depth if pretty else " ") if parts else ""
        parts.append(lead + "(" + " ".join([tag, *(f'@{k}="{"".join(_ESCAPES.get(c, c) for c in v)}"' for k, v in attrs.items())]))
        ends.append(end)
    return "".join(parts) + ")" * len(ends)


def read_outlines(texts: DataFrame) -> DataFrame:
    """(path, pre, end_pre, parent_pre, tag, attrs) of the nodes of outline texts (path, outline); one that cannot be read is an error of its
    task that names the path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, text in zip(f["path"], f["outline"], strict=True):
                try:
                    rows += [(path, *n) for n in read_outline(text)]
                except OutlineTextError as e:
                    raise OutlineTextError(f"{path}: {e}") from e
            yield pd.DataFrame(rows, columns=["path", "pre", "end_pre", "parent_pre", "tag", "attrs"]).astype({"parent_pre": "Int64"})

    t = texts.where("path is not null and outline is not null").select("path", "outline").distinct()
    return t.mapInPandas(run, "path string, pre int, end_pre int, parent_pre int, tag string, attrs map<string,string>")


# ---- a compiler's index (protocol buffers: documents, their occurrences and symbols)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message: integers and bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            if at >= len(data):
                raise ValueError("the message is cut off")
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        wire, number = key & 7, key >> 3
        if wire == 0:
            yield number, varint()
        elif wire in (1, 5, 2):
            n = varint() if wire == 2 else 8 if wire == 1 else 4
            if at + n > len(data):
                raise ValueError("the message is cut off")
            yield number, data[at : at + n]
            at += n
        else:
            raise ValueError(f"unknown wire type {wire}")


def _numbers(data: int | bytes) -> list[int]:
    if isinstance(data, int):
        return [data]
    out, value, shift = [], 0, 0
    for b in data:
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(value)
            value = shift = 0
    return out


# Numbers of the fields of the format, and the bits of roles.
_DOCUMENT, _PATH, _OCCURRENCE, _RANGE, _SYMBOL, _ROLES = 2, 1, 2, 1, 2, 3
DEFINITION, IMPORT = 1, 2


def scip_occurrences(data: bytes) -> Iterator[tuple[str, str, int, int, int]]:
    """(path, symbol, line from 1, end line, roles) of every occurrence of an index."""
    for number, doc in _fields(data):
        if number != _DOCUMENT:
            continue
        path, found = "", []
        for n, v in _fields(doc):
            if n == _PATH:
                path = v.decode()
            elif n == _OCCURRENCE:
                span, symbol, roles = [], "", 0
                for k, x in _fields(v):
                    if k == _RANGE:
                        span += _numbers(x)
                    elif k == _SYMBOL:
                        symbol = x.decode()
                    elif k == _ROLES:
                        roles = x
                if span and symbol:
                    found.append((symbol, span[0] + 1, (span[2] if len(span) == 4 else span[0]) + 1, roles))
        yield from ((path, *f) for f in found)


def descriptor_name(symbol: str) -> str | None:
    """The plain name at the end of a symbol: the last descriptor without its suffix."""
    m = re.search(r"(?:`((?:[^`]|``)+)`|([\w$+-]+))(?:\([^)]*\))?[./#:!]?$|\[[^\]]*\]$", symbol)
    return (m[1] or m[2]) if m else None


def read_scip(files: DataFrame) -> DataFrame:
    """(path, symbol, name, line, definition, import) of the indexes in binary files (content); one that is cut off is an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, s, descriptor_name(s), line, bool(r & DEFINITION), bool(r & IMPORT)) for data in f["content"] if data is not None for p, s, line, _, r in scip_occurrences(bytes(data))]
            yield pd.DataFrame(rows, columns=["path", "symbol", "name", "line", "definition", "import"])

    return files.select("content").mapInPandas(run, "path string, symbol string, name string, line int, definition boolean, import boolean")


def fenced(text: Column, label: str = "untrusted") -> Column:
    """A text between marks that it does not hold, so that nothing in it can end the fence: the mark grows until it is not in the text."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(={3,})"), F.lit(1)), F.length)), F.lit(2))
    mark = F.repeat(F.lit("="), F.greatest(F.lit(3), longest + 1))
    return F.concat(mark, F.lit(f" {label}\n"), text, F.lit("\n"), mark)
