"""Outline trees as rows, and the path language over them.

A tree is a table ``nodes(path, pre, end_pre, parent_pre, tag, name, attrs, callable, is_method, start_line, end_line)``:
a child has its parent's ``pre`` as parent_pre, a descendant's ``pre`` lies in (pre, end_pre]. A path query becomes a
chain of left semi joins that all carry ``path``, so every file is matched where its rows lie after one exchange.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prism.functions.text import suffixes

# Tags and attributes the language knows.
TAGS = frozenset("function method class interface enum type variable constant field module constructor property component namespace trait struct import call arrow lambda closure".split())
ATTRIBUTES = frozenset("name path kind signature exported doc params line endLine callable isMethod alias hasDoc parent declaration".split())
CALLABLE_TAGS = ("function", "method", "arrow", "lambda", "closure", "constructor")


class PathQueryError(ValueError):
    def __init__(self, message: str, offset: int):
        super().__init__(f"{message} at {offset}")
        self.offset = offset


@dataclass
class Test:
    op: str  # = ^= $= ~= contains exists and or not
    name: str = ""
    value: str = ""
    parts: list["Test"] = field(default_factory=list)


@dataclass
class Step:
    relation: str  # child or descendant
    tag: str
    tests: list[Test]


_TOKEN = re.compile(r"\s*(?:(//|/|>)|(\[)|(\])|(\()|(\))|((?:and|or|not)(?=[\s(!@\[\])]|$)|!)|(contains\b)|@([A-Za-z_][\w-]*)|(\^=|\$=|~=|=~|=)|(,)|([A-Za-z_*][\w-]*))")
_KINDS = ("step", "[", "]", "(", ")", "word", "contains", "attr", "op", ",", "tag")
#: A value: quoted either way, or bare. In quotes a backslash is an escape only before a backslash or a quote.
_VALUE = re.compile(r"""\s*(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|([^\s\])"',=^$~][^\s\])"',]*))""", re.S)
_ESCAPED = re.compile(r"""\\([\\"'])""")


def _tokens(query: str) -> list[tuple[str, str, int]]:
    items, at, stop = [], 0, len(query.rstrip())
    while at < stop:
        valued = bool(items) and items[-1][0] in ("op", ",")
        m = (_VALUE if valued else _TOKEN).match(query, at)
        if not m:
            raise PathQueryError(f"{'value expected' if valued else f'unexpected {query[at]!r}'}", at)
        i = m.lastindex
        items.append(("text", _ESCAPED.sub(r"\1", m[i]) if i < 3 else m[i], m.start(i)) if valued else (_KINDS[i - 1], m[i], m.start(i)))
        at = m.end()
    return [*items, ("end", "", len(query))]


def parse(query: str) -> list[Step]:
    """The steps of a path query; errors tell the place."""
    items = _tokens(query)
    pos = 0

    def take(kind: str) -> str:
        nonlocal pos
        k, v, o = items[pos]
        if k != kind:
            raise PathQueryError(f"{kind} expected, {v or k} found", o)
        pos += 1
        return v

    def either() -> Test:
        nonlocal pos
        parts = [both()]
        while items[pos][:2] == ("word", "or"):
            pos += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else Test("or", parts=parts)

    def both() -> Test:
        nonlocal pos
        parts = [one()]
        while items[pos][:2] == ("word", "and"):
            pos += 1
            parts.append(one())
        return parts[0] if len(parts) == 1 else Test("and", parts=parts)

    def one() -> Test:
        nonlocal pos
        k, v, o = items[pos]
        pos += 1
        if k == "word" and v in ("not", "!"):
            return Test("not", parts=[one()])
        if k == "(":
            t = either()
            take(")")
            return t
        if k == "contains":
            take("(")
            name = take("attr")
            take(",")
            t = Test("contains", name, take("text"))
            take(")")
        elif k == "attr":
            t = Test("exists", v)
            if items[pos][0] == "op":
                t = Test(take("op").replace("=~", "~="), v, take("text"))
                if t.op == "~=":
                    _check_regex(t.value, items[pos - 1][2])
        else:
            raise PathQueryError(f"test expected, {v or k} found", o)
        if t.name not in ATTRIBUTES:
            raise PathQueryError(f"unknown attribute @{t.name}", o)
        return t

    steps: list[Step] = []
    while items[pos][0] != "end":
        relation = "descendant"
        if items[pos][0] == "step":
            if not steps and items[pos][1] != "//":
                raise PathQueryError("// or a tag expected", items[pos][2])
            relation = "descendant" if items[pos][1] == "//" else "child"
            pos += 1
        elif steps:
            raise PathQueryError("/ or // expected", items[pos][2])
        tag = "*"
        if items[pos][0] == "tag":
            tag = take("tag")
            if tag != "*" and tag not in TAGS and tag not in ("callable", "fn"):
                raise PathQueryError(f"unknown tag {tag}", items[pos - 1][2])
        elif items[pos][0] != "[":
            raise PathQueryError("tag expected", items[pos][2])
        tests = []
        while items[pos][0] == "[":
            pos += 1
            tests.append(either())
            take("]")
        steps.append(Step(relation, tag, tests))
    if not steps:
        raise PathQueryError("empty query", 0)
    return steps


def _check_regex(pattern: str, at: int) -> None:
    try:
        re.compile(pattern)
    except re.error as e:
        raise PathQueryError(f"not a regular expression: {e}", at) from e


def _value(name: str) -> Column:
    own = F.try_element_at("attrs", F.lit(name))
    return F.coalesce(own, F.col("path")) if name == "path" else F.coalesce(own, F.col("name")) if name == "name" else own


def condition(t: Test) -> Column:
    """A test as a two-valued column: a missing attribute fails every test, so its negation holds."""
    if t.op in ("and", "or"):
        out = condition(t.parts[0])
        for p in t.parts[1:]:
            out = out & condition(p) if t.op == "and" else out | condition(p)
        return out
    if t.op == "not":
        return ~condition(t.parts[0])
    tests = {"=": lambda v: v == t.value, "^=": lambda v: v.startswith(t.value), "$=": lambda v: v.endswith(t.value), "contains": lambda v: v.contains(t.value), "~=": lambda v: v.rlike(t.value)}
    v = _value(t.name)
    if t.op == "exists":
        return v.isNotNull()
    if t.name == "name":
        return F.coalesce(F.exists(suffixes(v), tests[t.op]), F.lit(False))
    return F.coalesce(tests[t.op](v), F.lit(False))


def _matches(step: Step) -> Column:
    if step.tag in ("callable", "fn"):
        c = F.col("tag").isin(*CALLABLE_TAGS) | F.coalesce(F.col("callable"), F.lit(False))
    elif step.tag == "method":
        c = (F.col("tag") == "method") | F.coalesce(F.col("is_method"), F.lit(False))
    else:
        c = F.lit(True) if step.tag == "*" else F.col("tag") == step.tag
    for t in step.tests:
        c = c & condition(t)
    return c


def declares(tag: Column, name: Column) -> Column:
    """The node declares a name, where an import or a call only mentions it."""
    return name.isNotNull() & (name != "") & ~tag.isin("import", "call")


def select(nodes: DataFrame, query: str) -> DataFrame:
    """The nodes a path query finds, each once."""
    found = None
    for step in parse(query):
        now = nodes.where(_matches(step))
        if found is None:
            found = now
            continue
        up = found.select(F.col("path").alias("_p"), F.col("pre").alias("_pre"), F.col("end_pre").alias("_end"))
        on = now["path"] == up["_p"]
        on = on & (now["parent_pre"] == up["_pre"]) if step.relation == "child" else on & (now["pre"] > up["_pre"]) & (now["pre"] <= up["_end"])
        found = now.join(up, on, "left_semi")
    return found


def nodes(symbols: DataFrame) -> DataFrame:
    """The outline rows of symbols: preorder by line, outer first. Repeated rows count once."""
    kind = F.lower(F.trim("kind"))
    s = symbols.where("path is not null and id is not null").select("path", "id", "parent_id", "seq", "name", kind.alias("tag"), "start_line", "end_line", "signature", "params", "doc", "exported", "alias_of").distinct()
    w = Window.partitionBy("path").orderBy("start_line", F.desc("end_line"), "seq", "id")
    s = s.withColumn("pre", F.row_number().over(w)).withColumn("declares", F.when(declares(F.col("tag"), F.col("name")), "true"))
    names = {"name": "name", "kind": "tag", "signature": "signature", "params": "params", "doc": "doc", "exported": "exported", "alias": "alias_of", "line": "start_line", "endLine": "end_line", "parent": "parent_id", "declaration": "declares"}
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(v).cast("string").alias("value")) for k, v in names.items()]), lambda p: p["value"].isNotNull())
    s = s.withColumn("attrs", F.map_from_entries(pairs))
    ups = s.select(F.col("path").alias("_p"), F.col("id").alias("_i"), F.col("pre").alias("parent_pre"))
    s = s.join(ups, (s["path"] == ups["_p"]) & (s["parent_id"] == ups["_i"]), "left").drop("_p", "_i")
    # within a file, lines begin in preorder: the last descendant is the last row that begins at or before the end line,
    # a running maximum over beginnings and ends in one sort of the file
    row = F.struct("pre", "parent_pre", "tag", "name", "attrs", "start_line", "end_line", "id").alias("r")
    begins = s.select("path", F.col("start_line").alias("line"), F.lit(0).alias("o"), F.col("pre").alias("p"), F.lit(None).cast(s.select(row).schema["r"].dataType).alias("r"))
    ends = s.select("path", F.col("end_line").alias("line"), F.lit(1).alias("o"), F.lit(None).cast("int").alias("p"), row)
    last = F.max("p").over(Window.partitionBy("path").orderBy("line", "o").rowsBetween(Window.unboundedPreceding, 0))
    e = begins.unionByName(ends).withColumn("last", last).where("o = 1").select("path", F.greatest("r.pre", "last").alias("end_pre"), "r.*")
    return e.select("path", "pre", "end_pre", "parent_pre", "tag", "name", "attrs", F.col("tag").isin(*CALLABLE_TAGS).alias("callable"), (F.col("tag") == "method").alias("is_method"), "start_line", "end_line", "id")
