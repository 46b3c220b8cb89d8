"""Searches: channels by vector, symbols in two stages, lanes fused by rank, and meaning together with structure."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prism.functions import text as tx
from prism.functions.vectors import dot
from prism.operators import ranking, screen

# The kinds that have a feature each; the features in the order of the model.
KINDS = ("function", "method", "type", "class", "interface", "variable", "constant", "field", "module", "enum")
FEATURES = ("rank", "fused", "fused_gap", "card_cos", "hub_pen", "bm25_card", "name_hit", "name_cover", "path_hit", "card_hit", "names_symbol", "has_doc", "card_len", "depth", "same_file", "q_len", *[f"kind_{k}" for k in KINDS])
# How many cards a conjunction reads for each row of a page, and at least.
CONJUNCTION_FACTOR, CONJUNCTION_LEAST = 10, 500


# ---- what is asked


def is_path(query: str) -> bool:
    return query.lstrip().startswith("//")


def split_conjunction(query: str, path: str | None = None, meaning: str | None = None) -> tuple[str | None, str | None]:
    """(meaning, path query) of a text: either side of &&, WHERE before a path, AND beside one. Stated parts win."""
    text = query.strip()
    if path or meaning:
        return meaning or (None if is_path(text) else text or None), path or (text if is_path(text) else None)
    tries = [text.split("&&")] if "&&" in text else []
    if m := re.match(r"(.*?)\s+where\s+(//.*)$", text, re.I):
        tries.append(list(m.groups()))
    if m := re.match(r"(.*?)\s+AND\s+(.*)$", text):
        tries.append(list(m.groups()))
    for parts in tries:
        a, b = (p.strip() for p in parts) if len(parts) == 2 else ("", "")
        if len(parts) == 2 and is_path(a) != is_path(b):
            return (b, a) if is_path(a) else (a, b)
    return (None, text) if is_path(text) else (text, None)


# ---- cards


_CARD = "id string, channel string, categoryLabel string, text string, attrs map<string,string>, source struct<path:string,span:struct<startLine:int,endLine:int>>"


def read_cards(cards: DataFrame) -> DataFrame:
    """(channel, id, model, group_key, path, text, symbol, kind, has_doc, start_line, end_line) of the cards whose JSON can be
    read, each once. A card that is cut off has no row; one without a span has null lines."""
    c = cards.where("id is not null and card is not null").select("channel", "id", "model", "group_key", F.from_json("card", _CARD, {"mode": "PERMISSIVE"}).alias("c"))
    c = c.where("c.text is not null and c.source.path is not null")
    return c.select("channel", "id", "model", "group_key", F.col("c.source.path").alias("path"), F.col("c.text").alias("text"), F.col("c.attrs")["symbol"].alias("symbol"), F.col("c.attrs")["kind"].alias("kind"),
                    F.coalesce(F.col("c.attrs")["hasDoc"] == "true", F.lit(False)).alias("has_doc"), F.col("c.source.span.startLine").alias("start_line"), F.col("c.source.span.endLine").alias("end_line")).distinct()


def without_path(text: Column) -> Column:
    """A card's text less its path line: what is embedded and what BM25 counts."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda s: ~s.startswith("/")), "\n")


def card_key(path: Column, symbol: Column, channel: Column, id_: Column) -> Column:
    """What a result is the same as in every lane: file and symbol, or else channel and card."""
    return F.when(symbol.isNotNull() & (symbol != ""), F.concat_ws("#", path, symbol)).otherwise(F.concat_ws(":", channel, id_))


def node_key(path: Column, name: Column, tag: Column, line: Column) -> Column:
    return F.when(name.isNotNull() & (name != ""), F.concat_ws("#", path, name)).otherwise(F.concat_ws(":", path, tag, F.coalesce(line.cast("string"), F.lit(""))))


# ---- one channel


def retrieve(vectors: DataFrame, query: list[float], limit: int, keep: Column | None = None, collapse: bool = True, least: float | None = None) -> DataFrame:
    """(id, group_key, score): the cards nearest to a unit query, the best of each group only, ties by id.

    keep filters before the cut, least drops what is less similar after it. Winners are found on id, group and score alone;
    what else is known of them is joined to the page."""
    rows = vectors.where(F.size("vector") == len(query))
    if keep is not None:
        rows = rows.where(keep)
    rows = rows.select("id", "group_key", dot(F.col("vector"), F.array(*[F.lit(float(x)) for x in query])).alias("score"))
    if collapse:
        best = rows.groupBy("group_key").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("m"))
        rows = best.select(F.col("m.id").alias("id"), "group_key", (-F.col("m.s")).alias("score"))
    top = rows.orderBy(F.desc("score"), "id").limit(limit)
    return top if least is None else top.where(F.col("score") >= least)


def rescreen(hits: DataFrame, text: str = "text", profile: str = "standard") -> DataFrame:
    """``hits`` less those that are withheld, with clean text and whether it was changed. Withheld ones are not replaced, so a
    page may be short."""
    s = screen.screen(hits, text, profile).where("verdict <> 'quarantine'")
    return s.withColumn(text, F.coalesce("clean", F.col(text))).withColumn("sanitised", F.col("verdict") == "sanitize").drop("findings", "clean", "verdict")


# ---- symbols in two stages


def symbol_scores(vectors: DataFrame, query: list[float], hub: float = ranking.HUB_WEIGHT) -> DataFrame:
    """(symbol, score, best_id, best_cos, first_id, first_cos, first_pen) of every symbol, each step in float32.

    vectors: (id, group_key, vector of unit length, mean). A symbol is a group less its #n. The best card is that of the
    highest score, ties by id; the first is that of the least group, then of the least part (~n of its id)."""
    f = lambda c: c.cast("float")
    w = f(F.lit(hub))
    rows = vectors.select("id", "group_key", f(dot(F.col("vector"), F.array(*[F.lit(float(x)) for x in query]))).alias("cos"), f(w * f(F.coalesce("mean", F.lit(0.0)))).alias("pen"))
    rows = rows.withColumn("score", f(F.col("cos") - F.col("pen"))).withColumn("symbol", F.regexp_replace("group_key", r"#\d+$", ""))
    part = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("id", r"~(\d+)$", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))
    g = rows.groupBy("symbol").agg(F.min(F.struct((-F.col("score")).alias("s"), "id", "cos")).alias("b"), F.min(F.struct("group_key", part.alias("p"), "id", "cos", "pen")).alias("f"))
    return g.select("symbol", (-F.col("b.s")).alias("score"), F.col("b.id").alias("best_id"), F.col("b.cos").alias("best_cos"), F.col("f.id").alias("first_id"), F.col("f.cos").alias("first_cos"), F.col("f.pen").alias("first_pen"))


def symbol_order() -> list[Column]:
    return [F.desc("score"), F.asc("symbol")]


def ranker_features(query: str, top: DataFrame, cards: DataFrame, stats: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``top`` (symbol_scores, cut at the depth of the second stage) with all FEATURES. cards: read_cards; stats: bm25_stats.

    The candidates of one query are few by the depth, so the windows over them hold one page."""
    asked = tx.words(F.lit(query))
    distinct = F.array_distinct(asked)
    j = top.join(cards.select(F.col("id").alias("first_id"), "path", "text", F.coalesce("symbol", F.lit("")).alias("name"), F.coalesce("kind", F.lit("")).alias("kind"), "has_doc"), "first_id")
    every = Window.partitionBy(F.lit(0))
    ranked = every.orderBy(*symbol_order())
    hit = lambda other: F.size(F.array_intersect(distinct, other))
    at_least_one = lambda n: F.greatest(F.lit(1), n)
    names, paths, words = (F.array_distinct(tx.words(F.col(c))) for c in ("name", "path", "text"))
    file = F.substring_index("symbol", "#", 1)
    q = at_least_one(F.size(distinct))
    out = j.withColumn("rank", F.row_number().over(ranked) - 1).withColumn("fused", F.col("score")).withColumn("fused_gap", (F.first("score").over(ranked) - F.col("score")).cast("float"))
    out = out.withColumn("same_file", F.count("*").over(Window.partitionBy(file)) - 1)
    out = out.withColumns({
        "card_cos": F.col("first_cos"), "hub_pen": F.col("first_pen"), "name_hit": hit(names) / q, "name_cover": hit(names) / at_least_one(F.size(names)), "path_hit": hit(paths) / q, "card_hit": hit(words) / q,
        "names_symbol": ((F.size(names) > 0) & F.contains(F.lit(query.lower()), F.lower("name"))).cast("int"), "has_doc": F.col("has_doc").cast("int"), "card_len": F.length("text"),
        "depth": F.size(F.split("path", "/")) - 1, "q_len": F.size(asked), **{f"kind_{k}": (F.col("kind") == k).cast("int") for k in KINDS},
    })
    scored = _bm25(query, out.select("symbol", tx.words(without_path(F.col("text"))).alias("w")), stats)
    return out.join(scored, "symbol", "left").fillna(0.0, ["bm25_card"]).select(*top.columns, *FEATURES)


def _bm25(query: str, docs: DataFrame, stats: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(symbol, bm25_card) by statistics of the whole collection; a word that no document of it has counts as in none."""
    df, whole = stats
    asked = docs.sparkSession.range(1).select(F.explode(tx.words(F.lit(query))).alias("word")).groupBy("word").agg(F.count("*").alias("times"))
    known = F.broadcast(asked.join(df, "word", "left").select("word", "times", F.coalesce("df", F.lit(0)).alias("df")))
    tf = docs.select("symbol", F.size("w").alias("len"), F.explode("w").alias("word")).join(known, "word").groupBy("symbol", "len", "word", "times", "df").agg(F.count("*").alias("f")).crossJoin(F.broadcast(whole))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    s = F.col("times") * idf * F.col("f") * (ranking.K1 + 1) / (F.col("f") + ranking.K1 * (1 - ranking.B + ranking.B * F.col("len") / F.col("avg_length")))
    return tf.groupBy("symbol").agg(F.sum(s).alias("bm25_card"))


def symbol_search(query: str, vector: list[float], vectors: DataFrame, cards: DataFrame, stats: tuple[DataFrame, DataFrame], features: list[str], trees: list[dict], base: float = 0.0, depth: int = ranking.DEPTH, limit: int = 20) -> DataFrame:
    """(symbol, best_id, best_cos, first_rank, shown_rank): the first stage's order with its head put in the order of the
    trees, ties by the first stage. Beyond the depth the first stage's order stands."""
    order = symbol_scores(vectors, vector)
    head = order.orderBy(*symbol_order()).limit(max(depth, limit))
    head = head.withColumn("first_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*symbol_order())))
    read = ranker_features(query, head.where(F.col("first_rank") <= depth).drop("first_rank"), cards, stats)
    scored = ranking.score_trees(read, features, trees, base).select("symbol", "tree_score")
    shown = ranking.rerank_head(head.join(scored, "symbol", "left").withColumn("rank", F.col("first_rank")), depth)
    return shown.where(F.col("new_rank") <= limit).select("symbol", "best_id", "best_cos", "first_rank", F.col("new_rank").alias("shown_rank"))


def stages_summary(shown: DataFrame) -> DataFrame:
    """One row: candidates, whether the top changed, where the shown top stood first (from 0), and which share of the first
    ten is still among the ten shown. shown: (first_rank, shown_rank)."""
    head = F.least(F.lit(10), F.count("*"))
    kept = F.count_if((F.col("first_rank") <= 10) & (F.col("shown_rank") <= 10))
    top = F.min(F.when(F.col("shown_rank") == 1, F.col("first_rank")))
    return shown.agg(F.count("*").alias("candidates"), (top != 1).alias("top_changed"), (top - 1).alias("shown_top_first_rank"), F.when(head > 0, kept / head).otherwise(1.0).alias("overlap_at_10"))


# ---- lanes


@dataclass
class Lane:
    """Hits of one way to search: (pos, key, score), score null where the lane has none."""

    name: str
    hits: DataFrame
    weight: float = 1.0


@dataclass
class Fused:
    rows: DataFrame
    lanes: list[str]
    degraded: list[tuple[str, str]] = field(default_factory=list)


def fused_search(lanes: list[tuple[str, float, object]], known: list[str], exclude: tuple[str, ...] = (), weights: dict[str, float] | None = None, k: int = ranking.RRF_K) -> Fused:
    """Lanes fused by weighted rank. lanes: (name, weight, a function that gives the hits). A lane whose function fails is
    reported and left out; a name that is no lane, a negative weight, or nothing left to run is an error."""
    weights = weights or {}
    for name in (*exclude, *weights):
        if name not in known:
            raise ValueError(f"{name} is no lane; lanes are {', '.join(known)}")
    for name, w in weights.items():
        if not w >= 0 or w == float("inf"):
            raise ValueError(f"the weight of {name} must be a number of at least 0")
    kept = [(n, weights.get(n, w), run) for n, w, run in lanes if n not in exclude and weights.get(n, w) > 0]
    if not kept:
        raise ValueError("a search must keep at least one lane")
    rows, names, degraded = None, [], []
    for at, (name, weight, run) in enumerate(kept):
        try:
            hits = run().select("pos", "key", F.col("score").cast("double").alias("score"))
            hits.schema
        except Exception as e:  # noqa: BLE001 - whatever a lane fails with is reported with it
            degraded.append((name, str(e).splitlines()[0]))
            continue
        one = hits.select(F.lit(name).alias("lane"), F.lit(at).alias("lane_pos"), F.lit(float(weight)).alias("weight"), "pos", "key", "score")
        rows = one if rows is None else rows.unionByName(one)
        names.append(name)
    if rows is None:
        raise RuntimeError("every lane failed: " + "; ".join(f"{n}: {e}" for n, e in degraded))
    return Fused(ranking.fuse(rows, k), names, degraded)


def lane_of(hits: DataFrame, order: list[Column]) -> DataFrame:
    """(pos, key, score) of the hits of a lane, which its depth has bounded."""
    return hits.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("pos"), "key", "score")


def federated(pages: DataFrame, weights: dict[str, float] | None = None, k: int = ranking.RRF_K) -> DataFrame:
    """(key, score, best_score, found_by): the fused lists of several repositories fused again, keys told apart by repository.
    pages: (repo, pos, key, score); weights by repository, 1 where none is named, 0 leaves one out."""
    w = F.coalesce(F.try_element_at(F.create_map(*[x for r, v in weights.items() for x in (F.lit(r), F.lit(float(v)))]), F.col("repo")), F.lit(1.0)) if weights else F.lit(1.0)
    order = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("repo"))
    names = pages.select("repo").distinct().select("repo", order.alias("lane_pos"))
    rows = pages.join(F.broadcast(names), "repo")  # one row a repository that answers
    return ranking.fuse(rows.select(F.col("repo").alias("lane"), "lane_pos", w.alias("weight"), "pos", F.concat_ws(":", "repo", "key").alias("key"), "score"), k)


def hub_sync(vectors: DataFrame, root: str, neighbours: int = ranking.HUB_NEIGHBOURS) -> tuple[DataFrame, bool]:
    """((id, mean), whether it was worked out now): hub means of (id, vector), kept under ``root`` by a fingerprint of the vectors; only
    other vectors than those of the kept means are measured again. A folder is complete or not there (its _SUCCESS is last)."""
    from prism.operators.store import fingerprint

    spark = vectors.sparkSession
    mark = fingerprint(vectors.select("id", "vector"), ["id", "vector"]).first()[0]
    path = f"{root.rstrip('/')}/hub-{neighbours}-{mark}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        return spark.read.parquet(path), False
    ranking.hub_means(vectors, neighbours).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), True


# ---- meaning and structure


def _same_name(a: Column, b: Column) -> Column:
    dotted = lambda x, y: x.endswith(F.concat(F.lit("."), y))
    return F.coalesce((a != "") & (b != "") & ((a == b) | dotted(a, b) | dotted(b, a)), F.lit(False))


def _meets() -> Column:
    inside = F.coalesce((F.col("c.start_line") >= F.col("h.start_line")) & (F.col("c.end_line") <= F.col("h.end_line")), F.lit(False))
    return (F.col("c.path") == F.col("h.path")) & (_same_name(F.col("c.symbol"), F.col("h.name")) | inside)


def matching_cards(cards: DataFrame, nodes: DataFrame) -> DataFrame:
    """The cards (path, symbol, start_line, end_line, ..) that some node (path, name, start_line, end_line) of the same file
    matches: by name, either a dotted suffix of the other, or else by span. Every node of the set counts, not a page of them."""
    return cards.alias("c").join(nodes.select("path", "name", "start_line", "end_line").alias("h"), _meets(), "left_semi")


def best_cards(nodes: DataFrame, cards: DataFrame) -> DataFrame:
    """``nodes`` (path, pre, ..) that a card matches, with the score of the best; those without a card are left out."""
    own = [F.col(f"h.{c}") for c in nodes.columns]
    j = nodes.alias("h").join(cards.alias("c"), _meets()).select(*own, F.col("c.score").alias("score"))
    return j.groupBy("path", "pre").agg(F.max("score").alias("score")).join(nodes, ["path", "pre"])
