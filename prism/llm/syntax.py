"""Source files that do not parse, by derivatives of the grammar of their language."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prism.llm import grammars, lexers
from prism.llm.derivatives import Grammar

# Language names and extensions, and the grammar each goes by.
LANGUAGES = {
    "json": "json", "python": "python", "py": "python", "python3": "python", "php": "php",
    "javascript": "javascript", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ecmascript": "javascript",
    "typescript": "typescript", "ts": "typescript", "mts": "typescript", "cts": "typescript",
}
_TEXTS: dict[str, tuple[str, Callable]] = {
    "json": (grammars.JSON, lexers.json_tokens),
    "python": (grammars.PYTHON, lexers.python_tokens),
    "javascript": (grammars.JAVASCRIPT, lexers.javascript_tokens),
    "typescript": (grammars.TYPESCRIPT, lexers.typescript_tokens),
    "php": (grammars.PHP, lexers.php_tokens),
}
_made: dict[str, Grammar] = {}


def grammar(language: str) -> Grammar:
    if language not in _made:
        _made[language] = Grammar(_TEXTS[language][0], "file")
    return _made[language]


#: After these a line break ends the statement.
_RESTRICTED = frozenset(["return", "break", "continue", "throw", "yield"])


def check(text: str, language: str) -> tuple[str, int] | None:
    """None for a valid text, else ("token", place) of the failing token or ("truncated", length).

    In ECMAScript a semicolon is put before a token that has no derivative where the rules of the language put one:
    at a line break, before a closing brace and at the end.
    """
    g, ecma = grammar(language), language in ("javascript", "typescript")
    g.trim()
    state, empty, steps = g.start, g.empty, g._steps
    before = ""
    for kind, at, line in _TEXTS[language][1](text):
        if ecma and line and (before in _RESTRICTED or kind == "++"):
            closed = g.step(state, "ASI")
            if closed != empty:
                state = closed
        after = steps.get((state, kind))
        if after is None:
            after = g.step(state, kind)
        if after == empty and ecma and (line or kind == "}"):
            closed = g.step(state, "ASI")
            if closed != empty:
                after = g.step(closed, kind)
        if after == empty:
            return ("truncated" if kind == "unclosed" else "token"), at
        state, before = after, kind
    if g.nullable(state):
        return None
    if ecma and g.nullable(g.step(state, "ASI")):
        return None
    return "truncated", len(text)


@lru_cache(maxsize=1 << 12)
def _checked(text: str, language: str) -> tuple[str, int] | None:
    """As check, with what an empty text is: valid except as JSON. Copies of a text are read once a task for the most part."""
    if not text.strip("\ufeff \t\r\n"):
        return ("truncated", 0) if language == "json" else None
    return check(text, language)


def language_of(name: str | None, path: str | None) -> str | None:
    key = re.sub(r"[^a-z0-9]", "", (name or "").lower())
    return LANGUAGES.get(key) or LANGUAGES.get((path or "").rpartition(".")[2].lower())


def check_files(texts: DataFrame, files: DataFrame) -> DataFrame:
    """(path, language, repo, valid, error, place) of each path with a text.

    The language is that of files, of the row seen last, however spelled; of a path unknown to files, its extension's.
    A null text counts as not read and gives no row, an empty one is valid except as JSON. Paths of other languages
    have a null ``valid``. Of several texts of a path, one that fails counts. Repeated rows count once.
    """
    last = files.where("path is not null").groupBy("path").agg(F.max_by(F.struct("language", "repo"), F.coalesce("seen_at", F.lit(0).cast("timestamp"))).alias("f"))
    # one exchange of the texts, by path; repeated rows are judged like any and fall together in the end
    t = texts.where("path is not null and content is not null").select("path", "content")
    rows = t.join(last, "path", "left").select("path", "content", "f.language", "f.repo")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, text, name, repo in f.itertuples(index=False):
                lang = language_of(name, path)
                if lang is None:
                    out.append((path, (name or "").strip().lower() or None, repo, None, None, None))
                    continue
                found = _checked(text, lang)
                out.append((path, lang, repo, found is None, *(found or (None, None))))
            yield pd.DataFrame(out, columns=["path", "language", "repo", "valid", "error", "place"]).astype({"valid": "boolean", "place": "Int64"})

    checked = rows.mapInPandas(run, "path string, language string, repo string, valid boolean, error string, place long")
    one = F.struct(F.coalesce(F.col("valid"), F.lit(True)).alias("v"), "place", "error", "language", "repo", "valid")
    return checked.groupBy("path").agg(F.min(one).alias("m")).select("path", "m.language", "m.repo", "m.valid", "m.error", "m.place")


def rates(checked: DataFrame) -> DataFrame:
    """(repo, language, files, invalid, truncated, rate) of what could be checked."""
    own = checked.where("valid is not null").groupBy("repo", "language").agg(
        F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if(F.col("error") == "truncated").alias("truncated")
    )
    return own.withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
