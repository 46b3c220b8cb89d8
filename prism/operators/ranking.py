"""Retrieval and ranking: exact cosine search, collapse, hub means, BM25, fusion, trees, evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prism.functions.text import words
from prism.functions.vectors import dot
from prism.session import cut

RRF_K, HUB_WEIGHT, HUB_NEIGHBOURS, DEPTH = 60, 0.3, 10, 30
K1, B = 1.2, 0.75


def cosine_search(vectors: DataFrame, query: list[float], k: int, keep: Column | None = None, group: str | None = None) -> DataFrame:
    """(id, score): the k rows of unit vectors most similar to a unit query, ties by id. keep filters and group collapses
    (best row of each group) before the cut. Vectors of other lengths are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.where(F.size("vector") == len(query))
    if keep is not None:
        rows = rows.where(keep)
    rows = rows.withColumn("score", dot(F.col("vector"), q))
    if group:
        rows = rows.groupBy(group).agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("m")).select(F.col("m.id").alias("id"), (-F.col("m.s")).alias("score"))
    return rows.select("id", "score").orderBy(F.desc("score"), "id").limit(k)


#: Vectors of a packed block.
BLOCK = 4096


def packed(vectors: DataFrame, id_type: str) -> DataFrame:
    """(ids, data): vectors in blocks of at most BLOCK, one matrix of doubles a row. Vectors stay in their partitions."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), BLOCK):
                part = f.iloc[at : at + BLOCK]
                yield pd.DataFrame({"ids": [part["id"].to_numpy()], "data": [np.stack(part["vector"]).astype(np.float64).tobytes()]})

    return vectors.select("id", "vector").mapInPandas(run, f"ids array<{id_type}>, data binary")


def search_many(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) of the k most similar vectors for each of a stated set of queries, ties by id.

    Both sides are packed into blocks, each block of queries meets each block of vectors, and of a meeting only the k best a
    query go on (with what ties with the last). Nothing is collected: what is exchanged is queries x blocks x k rows. Vectors
    must be of one length.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    q = packed(queries, kind).withColumnRenamed("ids", "qids").withColumnRenamed("data", "qdata")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for ids, data, qids, qdata in f[["ids", "data", "qids", "qdata"]].itertuples(index=False):
                own, asked = np.asarray(ids), np.asarray(qids)
                s = np.frombuffer(qdata).reshape(len(asked), -1) @ np.frombuffer(data).reshape(len(own), -1).T
                top = min(k, len(own))
                edge = np.partition(s, len(own) - top, axis=1)[:, len(own) - top]
                r, c = np.nonzero(s >= edge[:, None])
                yield pd.DataFrame({"query_id": asked[r], "id": own[c], "score": s[r, c]})

    met = packed(vectors, kind).crossJoin(q).mapInPandas(run, f"query_id {kind}, id {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Rows and columns of a product that stays in the caches; bytes of vectors that a task holds of the other side.
TILE, HELD = (1024, 2048), 1 << 26


def _raised(top: np.ndarray, q: np.ndarray, data: np.ndarray, times: np.ndarray) -> np.ndarray:
    """``top``, the best scores of each row of q in falling order (-inf where there is none yet), after it has met the rows of data,
    each of which counts ``times``. Products in float32 find what may be among the best, by the largest error of such a sum; the
    scores themselves are sums of doubles."""
    k = top.shape[1]
    q32, d32 = q.astype(np.float32), data.astype(np.float32)
    length = lambda m: np.sqrt(np.einsum("ij,ij->i", m, m).max(initial=0.0))
    slack = (q.shape[1] + 4) * 2.0**-23 * length(q) * length(data)
    found = []
    room, over = np.empty(TILE, np.float32), np.empty(TILE, bool)  # used again by each tile
    for i in range(0, len(q), TILE[0]):
        least = top[i : i + TILE[0], -1] - slack
        for j in range(0, len(data), TILE[1]):
            a, b = q32[i : i + TILE[0]], d32[j : j + TILE[1]]
            s = np.matmul(a, b.T, out=room.ravel()[: len(a) * len(b)].reshape(len(a), len(b)))
            if s.shape[1] >= k and np.isneginf(least).any():
                least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k] - 2 * slack)
            hit = np.flatnonzero(np.greater_equal(s, np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None], out=over.ravel()[: s.size].reshape(s.shape)))
            found.append((hit // s.shape[1] + i, hit % s.shape[1] + j))
    r, c = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(r):
        return top
    score = np.concatenate([np.einsum("ij,ij->i", q[r[a : a + 32768]], data[c[a : a + 32768]]) for a in range(0, len(r), 32768)])
    more = np.minimum(times[c], k)
    changed = np.unique(r)
    row = np.concatenate([np.repeat(changed, k), np.repeat(r, more)])
    score = np.concatenate([top[changed].ravel(), np.repeat(score, more)])
    order = np.lexsort((-score, row))
    row, score = row[order], score[order]
    top = top.copy()
    top[changed] = score[(np.searchsorted(row, changed)[:, None] + np.arange(k)).ravel()].reshape(-1, k)
    return top


def nearest_scores(vectors: DataFrame, k: int) -> DataFrame:
    """(vector, top): the k highest similarities of each distinct vector to all rows, itself among them, in falling order.

    Equal vectors have equal scores, so they are compared once and counted. Each block of vectors meets all others in the
    order they come, and only what beats the k best so far is looked at again; of a block and the blocks that a task holds k scores a
    vector are exchanged."""
    spark = vectors.sparkSession
    each = cut(vectors.groupBy("vector").agg(F.count("*").alias("n")).withColumn("key", F.monotonically_increasing_id()))
    rows, width = each.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    parts = max(1, -(-rows // (BLOCK - 96)), min(spark.sparkContext.defaultParallelism, rows // 512))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = [f for f in frames if len(f)]
        f = pd.concat(whole) if whole else pd.DataFrame()
        for at in range(0, len(f), BLOCK):
            part = f.iloc[at : at + BLOCK]
            yield pd.DataFrame({"block": [int(part["key"].iloc[0])], "keys": [part["key"].to_numpy().tobytes()], "times": [part["n"].to_numpy().tobytes()], "data": [np.stack(part["vector"]).astype(np.float64).tobytes()]})

    blocks = cut(each.repartition(parts).mapInPandas(pack, "block long, keys binary, times binary, data binary"))
    others = blocks.coalesce(max(1, -(-rows * width * 8 // HELD))).select("times", "data")
    asked = blocks.select("block", "keys", F.col("data").alias("asked"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, keys, q, top = None, None, None, None
        for f in frames:
            for block, own, raw, times, data in f[["block", "keys", "asked", "times", "data"]].itertuples(index=False):
                if block != at:
                    if at is not None:
                        yield pd.DataFrame({"block": [at], "keys": [keys], "top": [top.tobytes()]})
                    at, keys, q = block, own, np.frombuffer(raw).reshape(len(own) // 8, -1)
                    top = np.full((len(q), k), -np.inf)
                top = _raised(top, q, np.frombuffer(data).reshape(-1, q.shape[1]), np.frombuffer(times, np.int64))
        if at is not None:
            yield pd.DataFrame({"block": [at], "keys": [keys], "top": [top.tobytes()]})

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        key = np.frombuffer(f["keys"].iloc[0], np.int64)
        top = -np.sort(-np.concatenate([np.frombuffer(t).reshape(len(key), -1) for t in f["top"]], axis=1), axis=1)[:, :k]
        return pd.DataFrame({"key": key, "top": list(top)})

    met = asked.crossJoin(others).mapInPandas(run, "block long, keys binary, top binary").groupBy("block").applyInPandas(merge, "key long, top array<double>")
    return each.join(met, "key").select("vector", F.filter("top", lambda s: s > float("-inf")).alias("top"))


def hub_means(vectors: DataFrame, neighbours: int = HUB_NEIGHBOURS) -> DataFrame:
    """(id, mean): the mean similarity of each unit vector to its nearest, the largest (itself) dropped; 0 for a lone one."""
    near = cut(nearest_scores(vectors, neighbours + 1))
    mark = F.xxhash64("vector").alias("mark")  # told apart by a number first, as arrays are slow to sort
    scores = vectors.select("id", "vector", mark).join(near.select("*", mark), ["mark", "vector"]).select("id", F.explode("top").alias("score"))
    top = scores.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score")))).where(F.col("rank") <= neighbours + 1)
    own = top.where("rank > 1").groupBy("id").agg(F.avg("score").alias("mean"))
    return vectors.select("id").join(own, "id", "left").select("id", F.coalesce("mean", F.lit(0.0)).alias("mean"))


def bm25_stats(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((word, df), (docs, avg_length)) over the words of a text column."""
    w = docs.select(words(F.col(text)).alias("w"))
    df = w.select(F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    whole = w.agg(F.count("*").alias("docs"), F.coalesce(F.avg(F.size("w")), F.lit(1.0)).alias("avg_length"))
    return df, whole


def bm25(docs: DataFrame, query: str, text: str = "text", id_col: str = "id") -> DataFrame:
    """(id, score) of the rows that hold a word of the query; a word repeated in the query counts each time."""
    spark = docs.sparkSession
    asked = spark.range(1).select(F.explode(words(F.lit(query))).alias("word")).groupBy("word").agg(F.count("*").alias("times"))
    df, whole = bm25_stats(docs, text)
    rows = docs.select(F.col(id_col).alias("id"), words(F.col(text)).alias("w"))
    tf = rows.select("id", F.size("w").alias("len"), F.explode("w").alias("word")).join(F.broadcast(asked), "word").groupBy("id", "len", "word", "times").agg(F.count("*").alias("f"))
    j = tf.join(df.join(F.broadcast(asked.select("word")), "word", "left_semi"), "word").crossJoin(F.broadcast(whole))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    s = F.col("times") * idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avg_length")))
    return j.groupBy("id").agg(F.sum(s).alias("score"))


def fuse(lanes: DataFrame, k: int = RRF_K, by: tuple[str, ...] = ()) -> DataFrame:
    """Weighted reciprocal rank fusion of (lane, lane_pos, weight, pos, key, score): (key, score, best_score, found_by). by: the
    columns that name a query, where lanes of several are fused at once.

    Only the first place of a key in a lane counts and later copies do not advance the rank; weights of 0 or less are
    skipped; terms are added in lane order.
    """
    first = lanes.where("weight > 0 and key is not null").groupBy(*by, "lane", "lane_pos", "weight", "key").agg(F.min(F.struct("pos", "score")).alias("m"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "lane").orderBy("m.pos")))
    one = F.struct("lane_pos", "lane", "rank", "weight", F.col("m.score").alias("score"))
    g = ranked.groupBy(*by, "key").agg(F.array_sort(F.collect_list(one)).alias("found_by"))
    total = F.aggregate("found_by", F.lit(0.0), lambda s, x: s + x["weight"] / (k + x["rank"]))
    return g.select(*by, "key", total.alias("score"), F.array_max(F.transform("found_by", lambda x: x["score"])).alias("best_score"), F.transform("found_by", lambda x: x["lane"]).alias("found_by"))


def fused_order() -> list[Column]:
    """The order of a fused list: score, best score with those that have none last, key."""
    return [F.desc("score"), F.desc_nulls_last("best_score"), F.asc("key")]


def score_trees(rows: DataFrame, features: list[str], trees: list[dict], base: float = 0.0) -> DataFrame:
    """``rows`` with ``tree_score``: the sum, in float32, of the leaves reached. A tree has left, right, feature, value and
    default_left arrays; a value below the threshold goes left, NaN or null the default way; left < 0 marks a leaf."""

    @F.pandas_udf(T.FloatType())
    def run(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(dtype=np.float32, na_value=np.nan) for c in columns], axis=1)
        total = np.full(len(x), np.float32(base), dtype=np.float32)
        each = np.arange(len(x))
        for t in trees:
            left, right, feature, value, default = (np.asarray(t[n]) for n in ("left", "right", "feature", "value", "default_left"))
            node = np.zeros(len(x), dtype=np.int64)
            while (inner := left[node] >= 0).any():
                v = x[each, feature[node]]
                go = np.where(np.isnan(v), default[node].astype(bool), v < value[node].astype(np.float32))
                node = np.where(inner, np.where(go, left[node], right[node]), node)
            total += value[node].astype(np.float32)
        return pd.Series(total)

    return rows.withColumn("tree_score", run(*[F.col(f).cast("float") for f in features]))


def rerank_head(rows: DataFrame, depth: int = DEPTH, by: list[str] | None = None) -> DataFrame:
    """``rows`` (rank, tree_score) with ``new_rank``: the first ``depth`` by tree score, ties by rank; the tail untouched.
    by: the columns that name a query; without them all rows are one query's page."""
    head = F.when(F.col("rank") <= depth, 0).otherwise(1)
    best = F.when(F.col("rank") <= depth, -F.col("tree_score").cast("double")).otherwise(0.0)
    return rows.withColumn("new_rank", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(head, best, "rank")))


def first_relevant(results: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, rank): the rank, among distinct files in order of appearance, of the first relevant file; null if none.
    results: (query_id, pos, file); relevant: (query_id, file)."""
    files = results.groupBy("query_id", "file").agg(F.min("pos").alias("pos"))
    ranked = files.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("pos", "file")))
    hit = ranked.join(relevant.distinct(), ["query_id", "file"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return relevant.select("query_id").distinct().join(hit, "query_id", "left")


def recall_and_mrr(ranks: DataFrame, k: int = 5) -> DataFrame:
    hit = F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))
    return ranks.agg(F.count("*").alias("queries"), F.avg(hit).alias("recall"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.count_if(F.col("rank").isNull()).alias("misses"))


def nearest_rank(p: float, c: str) -> Column:
    """An aggregate: the value at ceil(p n) of the sorted values of column ``c``, at least the first. Never interpolates; what
    is kept of a group is one count a distinct value."""
    return F.expr(f"percentile_disc({float(p)}) within group (order by `{c}`)")
