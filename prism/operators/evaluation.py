"""Comparison with truth: multisets, places, answers, and queries that an index can ask of itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Which kinds are compared as one; others have no counterpart.
GROUPS = {"function": "callable", "method": "callable", "class": "class", "interface": "interface", "type": "type", "enum": "enum", "namespace": "namespace", "module": "namespace"}
# Which paths are tests; how few words a query by intent may have.
TEST_PATH, INTENT_WORDS = r"(^|/)(__tests__|tests?|spec)/|\.(test|spec)\.[a-z]+$", 5


def group_of(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, g in GROUPS.items() for x in (F.lit(k), F.lit(g))]), kind)


def multiset_diff(truth: DataFrame, ours: DataFrame, key: list[str]) -> DataFrame:
    """(key, truth, ours, matched) of every key of either side: how often it stands in each and in both."""
    a, b = truth.groupBy(*key).agg(F.count("*").alias("truth")), ours.groupBy(*key).agg(F.count("*").alias("ours"))
    j = a.join(b, key, "full_outer").select(*key, F.coalesce("truth", F.lit(0)).alias("truth"), F.coalesce("ours", F.lit(0)).alias("ours"))
    return j.withColumn("matched", F.least("truth", "ours"))


def precision_recall(diff: DataFrame, group: str) -> DataFrame:
    """(group, matched, truth, ours, precision, recall) of each group, and of all under a null group. Null where there is nothing
    to divide by."""
    r = diff.where(F.col(group).isNotNull()).rollup(group).agg(*[F.sum(c).alias(c) for c in ("matched", "truth", "ours")])
    ratio = lambda n: F.when(F.col(n) > 0, F.col("matched") / F.col(n))
    return r.select(group, "matched", "truth", "ours", ratio("ours").alias("precision"), ratio("truth").alias("recall"))


def paired(truth: DataFrame, ours: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """(key, n, truth, ours, extracted): the nth site of a key with the nth of the other side; sites that only ours has are
    not compared."""
    num = lambda df, name: df.select(*key, F.row_number().over(Window.partitionBy(*key).orderBy(*order)).alias("n"), F.col(value).alias(name), F.lit(True).alias(f"_{name}"))
    j = num(truth, "truth").join(num(ours, "ours"), [*key, "n"], "left")
    return j.select(*key, "n", "truth", "ours", F.col("_ours").isNotNull().alias("extracted"))


def confusion(pairs: DataFrame) -> DataFrame:
    """(outcome, n): truth>ours of the sites that were extracted, by count."""
    return pairs.where("extracted").groupBy(F.concat_ws(">", "truth", "ours").alias("outcome")).agg(F.count("*").alias("n"))


def answers(expected: DataFrame, got: DataFrame, query: str = "query_id", item: str = "item") -> DataFrame:
    """(query, passed, missing, unexpected) of each expected query: distinct items on one side only, in order.

    With a column ``confidence`` or ``lines`` on both sides, items whose value differs from an expected one fail too (wrong)."""
    extra = [c for c in ("confidence", "lines") if c in expected.columns and c in got.columns]
    a = expected.select(query, item, *[F.col(c).alias(f"_e{c}") for c in extra]).dropDuplicates([query, item]).withColumn("_a", F.lit(True))
    b = got.select(query, item, *[F.col(c).alias(f"_g{c}") for c in extra]).dropDuplicates([query, item]).withColumn("_b", F.lit(True))
    j = a.join(b, [query, item], "full_outer")
    differs = F.lit(False)
    for c in extra:
        differs = differs | (F.col(f"_e{c}").isNotNull() & F.col("_b").isNotNull() & ~F.col(f"_e{c}").eqNullSafe(F.col(f"_g{c}")))
    some = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col(item))))
    g = j.groupBy(query).agg(some(F.col("_b").isNull()).alias("missing"), some(F.col("_a").isNull()).alias("unexpected"), some(differs).alias("wrong"))
    g = g.join(expected.select(query).distinct(), query, "left_semi")
    return g.select(query, ((F.size("missing") == 0) & (F.size("unexpected") == 0) & (F.size("wrong") == 0)).alias("passed"), "missing", "unexpected", "wrong")


def spread(rows: DataFrame, count: int | None, order: list[str], by: list[str] | None = None) -> DataFrame:
    """``count`` rows spread evenly over the ordered rows (of each group): those at floor(i * n / count). All where there are not more."""
    if count is None:
        return rows
    w = Window.partitionBy(*(by or [F.lit(0)]))
    n = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    # row i is picked where some j has floor(j n / count) = i: the least j with j n >= i count is below count, and its place is i
    j = F.floor((F.col("_i") * count + F.col("_n") - 1) / F.col("_n"))
    return n.where((F.col("_n") <= count) | ((j < count) & (F.floor(j * F.col("_n") / count) == F.col("_i")))).drop("_i", "_n")


def query_words(c: Column) -> Column:
    """Words of an identifier as a query asks for them: humps and acronyms split, lower case."""
    s = F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.transform(F.filter(F.split(s, r"[^A-Za-z0-9]+"), lambda w: w != ""), F.lower)


def first_sentence(doc: Column) -> Column:
    """The first sentence of a comment without its marks and tag lines, and without its full stop."""
    line = lambda s: F.trim(F.regexp_replace(s, r"^\s*(/\*\*?|\*/|\*|///?|#)\s?", ""))
    lines = F.filter(F.transform(F.split(doc, r"\r?\n"), line), lambda s: (s != "") & ~s.startswith("@"))
    return F.trim(F.regexp_replace(F.array_join(lines, " "), r"(?s)[.!?](\s.*|$)", ""))


def own_queries(symbols: DataFrame, per_population: int | None = None, least: int = INTENT_WORDS) -> DataFrame:
    """(population, text, symbol, base_name): queries that the index can answer itself, with the symbol each is made of.

    identifier and exact-name: of each name of two words or more, its first exported symbol; intent: the first sentence of a
    doc less the words of the name. Tests are left out. symbols: (path, seq, id, base_name, kind, exported, doc)."""
    s = symbols.where(~F.col("path").rlike(TEST_PATH) & F.col("base_name").isNotNull())
    named = s.where((F.col("exported") == 1) & (F.size(query_words(F.col("base_name"))) >= 2)).groupBy("base_name").agg(F.min(F.struct("path", "seq", "id", "kind")).alias("m"))
    named = spread(named, per_population, ["m.path", "m.seq"])
    ident = named.select(F.lit("identifier").alias("population"), F.array_join(query_words(F.col("base_name")), " ").alias("text"), F.col("m.id").alias("symbol"), "base_name")
    exact = named.select(F.lit("exact-name").alias("population"), F.concat(F.lit("//"), "m.kind", F.lit('[@name="'), "base_name", F.lit('"][@declaration]')).alias("text"), F.col("m.id").alias("symbol"), "base_name")
    told = F.filter(query_words(first_sentence(F.col("doc"))), lambda w: ~F.array_contains(query_words(F.col("base_name")), w))
    intent = s.where(F.col("doc").isNotNull()).withColumn("t", told).where(F.size("t") >= least)
    intent = spread(intent, per_population, ["path", "seq"]).select(F.lit("intent").alias("population"), F.array_join("t", " ").alias("text"), F.col("id").alias("symbol"), "base_name")
    return ident.unionByName(exact).unionByName(intent)


def relevant_files(queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """(text, population, path): the files that answer a query: those that define the name, or of an intent the symbol's own."""
    by_name = queries.where("population <> 'intent'").join(symbols.where(~F.col("path").rlike(TEST_PATH)).select("base_name", "path").distinct(), "base_name").select("population", "text", "path")
    own = queries.where("population = 'intent'").join(symbols.select(F.col("id").alias("symbol"), "path").distinct(), "symbol").select("population", "text", "path")
    return by_name.unionByName(own).distinct()


def link_summary(edges: DataFrame) -> DataFrame:
    """(family, outcome, n): edges by what became of them: imports resolved, asset, external, dangling; calls resolved, by name,
    external, unresolved."""
    kind = F.col("kind")
    outcome = (
        F.when(kind.isin("imports", "imports:type", "imports:reexport", "calls"), "resolved").when(kind == "calls:name", "by name")
        .otherwise(F.substring_index(kind, ":", -1))
    )
    return edges.groupBy(F.substring_index(kind, ":", 1).alias("family"), outcome.alias("outcome")).agg(F.count("*").alias("n"))


def complexity(files: Column) -> Column:
    """The grade of a repository by its number of source files."""
    # Ends of the grades.
    return F.when(files < 300, "small").when(files < 3000, "medium").when(files < 20000, "large").otherwise("huge")


def structure(packages: Column, marked: Column, major_languages: Column) -> Column:
    """How a repository is built: by marks of a workspace and packages, else by languages of a tenth of the bytes or more."""
    # Packages of a monorepo, languages of a polyglot one.
    return F.when(marked | (packages >= 3), "monorepo").when(major_languages >= 3, "polyglot").when(packages > 0, "nested").otherwise("single")
