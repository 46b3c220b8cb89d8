"""Scalar text functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a query.
STOP = "a an the to of in on for and or is are be it its this that with by from as at how do does what i my when which why where can get set".split()

# Upper ends of the buckets of telemetry, with their names.
DURATION_BUCKETS = ((10, "<10"), (50, "10-50"), (200, "50-200"), (1000, "200-1000"), (5000, "1000-5000"), (30000, "5000-30000"), (120000, "30000-120000"), (None, "120000+"))
COUNT_BUCKETS = ((1, "0"), (6, "1-5"), (21, "6-20"), (101, "21-100"), (1001, "101-1000"), (10001, "1001-10000"), (100001, "10001-100000"), (None, "100000+"))
RATIO_BUCKETS = ((0.25, "<0.25"), (0.5, "0.25-0.5"), (0.75, "0.5-0.75"), (None, "0.75-1.0"))
MEMORY_BUCKETS = ((4, "<4"), (8, "4-8"), (16, "8-16"), (32, "16-32"), (None, "32+"))


def bucket(c: Column, ends: tuple) -> Column:
    """The name of the first bucket whose end lies above the value; null for null."""
    out = None
    for end, name in ends[:-1]:
        out = F.when(c < end, name) if out is None else out.when(c < end, name)
    return F.when(c.isNotNull(), out.otherwise(ends[-1][1]))


# Where a name parts into words, and what a word of a query is.
_HUMP, _QUERY_WORD = r"([a-z0-9])([A-Z])", r"([a-z0-9]+)"
_SEPARATORS, _SIGILS, _ACRONYM, _CAMEL, _EXTENSION = r"(::|->|[_\-.\\#/]+)", r"[$@%&?!]+", r"([A-Z]+)([A-Z][a-z])", r"([a-z\d])([A-Z])", r"(?i)\.[a-z0-9]+$"


def words(c: Column) -> Column:
    """What BM25 counts: runs of ASCII letters and digits in lower case, parted before a capital, less the stop words."""
    spaced = F.lower(F.regexp_replace(c, _HUMP, "$1 $2"))
    return F.filter(F.regexp_extract_all(spaced, F.lit(_QUERY_WORD), F.lit(1)), lambda w: ~w.isin(*STOP))


def identifier_words(c: Column) -> Column:
    """The words of an identifier: humps, acronyms, separators and namespaces."""
    s = c
    for pattern, put in ((_SEPARATORS, " "), (_SIGILS, " "), (_ACRONYM, "$1 $2"), (_CAMEL, "$1 $2")):
        s = F.regexp_replace(s, pattern, put)
    return F.filter(F.transform(F.split(s, r"\s+"), lambda w: F.lower(w)), lambda w: w != "")


def path_words(c: Column) -> Column:
    """The words of a path without its extension."""
    bare = F.regexp_replace(c, _EXTENSION, "")
    return F.flatten(F.transform(F.filter(F.split(bare, r"[/\\]+"), lambda s: ~s.isin("", ".", "..")), identifier_words))


def suffixes(c: Column) -> Column:
    """A dotted name and each of its dotted suffixes."""
    parts = F.split(c, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def sentences(c: Column) -> Column:
    """Sentences, cut after . ! ? where a capital, a digit, a quote, a backtick or a bracket follows; without blanks around, empty ones left out."""
    parts = F.transform(F.split(c, r"(?<=[.!?])\s+(?=[A-Z0-9\"'(`])"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def directory(c: Column) -> Column:
    return F.when(F.instr(c, "/") > 0, F.regexp_replace(c, r"/[^/]*$", "")).otherwise("")


def in_scope(path: Column, scope: str) -> Column:
    """The path is the scope or lies under it; "." is everything. Absolute scopes and those with .. are refused."""
    scope = scope.rstrip("/")
    if scope in ("", "."):
        return F.lit(True)
    if scope.startswith("/") or ".." in scope.split("/") or "\0" in scope:
        raise ValueError(f"scope {scope!r} leaves the project")
    return (path == scope) | path.startswith(scope + "/")
