"""Most similar vectors for every vector: score-aware quantisation, four-bit table scans, exact reranking.

Per model and dims a partition and a codebook are fitted on a bounded sample. Every vector is then encoded in four
bits for each two dimensions, with codes that penalise the error along the vector more than the error across it, and
its code (not the vector) goes to the few cells nearest to it; the vector itself goes as a query to its own cell. A
cell scores all its queries against all its codes from the 16-entry tables, and what comes near the threshold is
scored exactly. Cells hold a bounded number of rows: larger ones are scanned as blocks of queries by blocks of codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prism.session import cut

#: Rows of each model and dims that the partition, and of them those that the codebook, is fitted on, at most.
SAMPLE, CODED = 20_000, 8_000
#: Rows of a cell aimed at; cells a code goes to; rows of a block of a hot cell.
CELL, PROBES, BLOCK = 400, 6, 4096
#: Up to so many cells one list of centres is used, beyond it the product of two lists, with more probes.
FLAT, PRODUCT_PROBES = 1024, 16
#: How far below the threshold a table score may lie to be scored exactly.
MARGIN = 0.08
CENTRES, SUB = 16, 2


def valid(model: Column, dims: Column, vector: Column) -> Column:
    """The vector takes part: it is as long as dims says, finite and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(model.isNotNull() & dims.isNotNull() & (F.size(vector) == dims) & (dims > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: list | pd.Series) -> np.ndarray:
    m = np.array(list(vectors), dtype=np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        order = np.argsort(near, kind="stable")
        counts = np.bincount(near, minlength=k)
        sums = np.add.reduceat(x[order], np.minimum(np.cumsum(counts) - counts, len(x) - 1), axis=0)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.choice(len(x), k)])
    return c


class Quantiser:
    """Partition and codebook of one model and dims, fitted on unit vectors."""

    def __init__(self, sample: np.ndarray, total: int, threshold: float, seed: int = 0):
        rng = np.random.default_rng(seed)
        sample = sample.astype(np.float32)
        self.dims = sample.shape[1]
        cells = max(1, -(-total // CELL))
        half = self.dims // 2
        if cells <= FLAT or half == 0:
            self.lists, self.probes = [_kmeans(sample, cells, rng)], PROBES
        else:
            k = int(np.ceil(np.sqrt(cells)))
            self.lists, self.probes = [_kmeans(sample[:, :half], k, rng), _kmeans(sample[:, half:], k, rng)], PRODUCT_PROBES
        # weight of the parallel error for scores at the threshold
        self.eta = max(1.0, (self.dims - 1) * threshold**2 / max(1e-6, 1 - threshold**2))
        x = self._split(sample[:CODED])
        self.books = np.stack([_kmeans(x[:, m], CENTRES, rng) if len(x) >= CENTRES else np.resize(x[:, m], (CENTRES, SUB)) for m in range(x.shape[1])])
        for _ in range(2):
            self._refit(x)
        self.spread = self._error(sample[:CODED], threshold, rng)

    def _error(self, x: np.ndarray, threshold: float, rng: np.random.Generator) -> float:
        """How far a table score may lie from the cosine: twice the largest error over a bounded number of near pairs, so that
        the difference of two scores is covered. Margin where there are none."""
        some = x[rng.choice(len(x), min(len(x), 512), replace=False)]
        exact = some @ x.T
        off = np.abs(some @ self.decode(self.encode(x)).T.astype(np.float32) - exact)[exact >= threshold - MARGIN]
        return max(2 * MARGIN, 2 * float(off.max())) if len(off) else 2 * MARGIN

    def _split(self, x: np.ndarray) -> np.ndarray:
        if self.dims % SUB:
            x = np.concatenate([x, np.zeros((len(x), SUB - self.dims % SUB), x.dtype)], axis=1)
        return x.reshape(len(x), -1, SUB)

    def _assign(self, x: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """Codes by coordinate descent on |r|^2 + (eta - 1) (r.x)^2, and r.x of each part."""
        n, parts = x.shape[:2]
        codes = np.empty((n, parts), dtype=np.uint8)
        along = np.empty((n, parts), dtype=np.float32)
        each = np.arange(n)
        for m in range(parts):
            b = self.books[m]
            codes[:, m] = (x[:, m] @ b.T - 0.5 * (b * b).sum(1)).argmax(1)
            along[:, m] = ((x[:, m] - b[codes[:, m]]) * x[:, m]).sum(1)
        whole = along.sum(1)
        for _ in range(rounds):
            for m in range(parts):
                b = self.books[m]
                dot = x[:, m] @ b.T
                par = (x[:, m] ** 2).sum(1)[:, None] - dot
                rest = whole - along[:, m]
                cost = (b * b).sum(1) - 2 * dot + (self.eta - 1) * (rest[:, None] + par) ** 2
                codes[:, m] = cost.argmin(1)
                along[:, m] = par[each, codes[:, m]]
                whole = rest + along[:, m]
        return codes, along

    def _refit(self, x: np.ndarray) -> None:
        codes, along = self._assign(x)
        whole = along.sum(1)
        for m in range(x.shape[1]):
            xm = x[:, m].astype(np.float64)
            rest = (whole - along[:, m]).astype(np.float64)
            for c in range(CENTRES):
                own = codes[:, m] == c
                if own.sum() > 4 * SUB:
                    v = xm[own]
                    a = own.sum() * np.eye(SUB) + (self.eta - 1) * v.T @ v
                    self.books[m, c] = np.linalg.solve(a, v.sum(0) + (self.eta - 1) * (v * (rest[own] + (v * v).sum(1))[:, None]).sum(0))

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes, two in a byte."""
        codes, _ = self._assign(self._split(x.astype(np.float32)))
        if codes.shape[1] % 2:
            codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], axis=1)
        return codes[:, ::2] | codes[:, 1::2] << 4

    def decode(self, packed: np.ndarray) -> np.ndarray:
        codes = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(packed), -1)[:, : len(self.books)]
        return self.books[np.arange(len(self.books)), codes].reshape(len(packed), -1)[:, : self.dims]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cells of each vector, nearest first."""
        x = x.astype(np.float32)
        if len(self.lists) == 1:
            c = self.lists[0]
            s = x @ c.T - 0.5 * (c * c).sum(1)
        else:
            half = self.dims // 2
            a, b = self.lists
            top = min(len(a), 2 * self.probes)
            sa, sb = x[:, :half] @ a.T - 0.5 * (a * a).sum(1), x[:, half:] @ b.T - 0.5 * (b * b).sum(1)
            ia, ib = np.argpartition(-sa, top - 1, 1)[:, :top], np.argpartition(-sb, top - 1, 1)[:, :top]
            s = (np.take_along_axis(sa, ia, 1)[:, :, None] + np.take_along_axis(sb, ib, 1)[:, None, :]).reshape(len(x), -1)
            name = (ia[:, :, None] * len(b) + ib[:, None, :]).reshape(len(x), -1)
            best = np.argsort(-s, 1, kind="stable")[:, : self.probes]
            return np.take_along_axis(name, best, 1)
        p = min(self.probes, s.shape[1])
        best = np.argpartition(-s, p - 1, 1)[:, :p]
        return np.take_along_axis(best, np.argsort(-np.take_along_axis(s, best, 1), 1, kind="stable"), 1)


#: Rows of a table of keys that may be sent to every task (at 16 bytes each); larger ones are joined by exchange.
SMALL = 1_000_000


def small(keys: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(keys) if rows <= SMALL else keys


_ROWS = T.StructType([T.StructField("g", T.IntegerType()), T.StructField("cell", T.LongType()), T.StructField("q", T.IntegerType()), T.StructField("vid", T.LongType()), T.StructField("data", T.BinaryType())])


def similar_pairs(vectors: DataFrame, k: int = 5, threshold: float = 0.85, seed: int = 0) -> DataFrame:
    """(id_a, id_b, similarity): the pairs of vectors of one model and dims with a cosine of the threshold or more, one
    being among the k most similar of the other (ties by id); id_a < id_b.

    Vectors that are null, zero, not finite or not dims long take no part. Repeated rows count once. Of more than
    k + 1 copies of one vector, the first k + 1 by id are indexed; the rest are linked to the first k by id of those
    and of all rows that tie with them at a rounded cosine of 1 (vectors of another length or nearly the same), which
    is what a tie by id gives. An empty table gives no row.
    """
    spark = vectors.sparkSession
    v = vectors.where(valid(F.col("model"), F.col("dims"), F.col("vector")) & F.col("id").isNotNull()).select(
        "id", "model", F.col("dims").cast("int").alias("dims"), "vector", F.xxhash64("model", "dims", "id").alias("vid"), F.xxhash64("model", "dims", "vector").alias("copy")
    )
    groups = v.groupBy("model", "dims").agg(F.count("*").alias("n")).orderBy("model", "dims").collect()
    if not groups:
        return spark.createDataFrame([], "id_a string, id_b string, similarity double")
    # repeated rows count once: only those whose id repeats are exchanged, by one small key
    again = cut(v.groupBy("vid", "copy").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("vid", "copy"))
    if repeated := again.count():
        again = small(again, repeated)
        v = v.join(again, ["vid", "copy"], "left_anti").unionByName(cut(v.join(again, ["vid", "copy"], "left_semi").dropDuplicates(["vid", "copy"])))
    first = rest = None
    hot = v.groupBy("copy").agg(F.approx_count_distinct("vid").alias("c")).where(F.col("c") > k + 1).select("copy")
    if hot.limit(1).count():
        rows = v.join(hot, "copy", "left_semi").select("copy", "vid", "id").distinct()
        first = cut(rows.withColumn("r", F.row_number().over(Window.partitionBy("copy").orderBy("id"))).where(F.col("r") <= k + 1))
        stays = first.select("copy", "vid")
        rest = cut(rows.join(stays, ["copy", "vid"], "left_anti"))
        v = v.join(small(rest.select("vid"), rest.count()), "vid", "left_anti")

    quantisers, number = [], {}
    for g in groups:
        own = v.where((F.col("model") == g["model"]) & (F.col("dims") == g["dims"]))
        share = min(1.0, 1.2 * SAMPLE / g["n"])
        sample = (own if share == 1.0 else own.sample(share, seed)).select("vector").limit(SAMPLE).toPandas()["vector"]
        number[g["model"], g["dims"]] = len(quantisers)
        quantisers.append(Quantiser(unit(sample), g["n"], threshold, seed) if len(sample) else None)
    shared = spark.sparkContext.broadcast((quantisers, number))

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qs, names = shared.value
        for f in frames:
            for key, part in f.groupby(["model", "dims"], sort=False):
                g = names[key[0], int(key[1])]
                x, vid, qz = unit(part["vector"]), part["vid"].to_numpy(), qs[g]
                cells, codes = qz.cells(x), qz.encode(x)
                p = cells.shape[1]
                data = [r.tobytes() for r in x.astype(np.float32)]
                small = [r.tobytes() for r in codes]
                yield pd.DataFrame(
                    {
                        "g": np.int32(g),
                        "cell": np.concatenate([cells[:, 0], cells.ravel()]).astype(np.int64),
                        "q": np.concatenate([np.ones(len(x), np.int32), np.zeros(len(x) * p, np.int32)]),
                        "vid": np.concatenate([vid, np.repeat(vid, p)]),
                        "data": data + [c for c in small for _ in range(p)],
                    }
                )

    rows = v.select("model", "dims", "vid", "vector").mapInPandas(spread, _ROWS)

    def scan(f: pd.DataFrame) -> pd.DataFrame:
        f = f.drop_duplicates(["q", "vid"])
        qz = shared.value[0][f["g"].iat[0]]
        a, b = f[f["q"] == 1], f[f["q"] == 0]
        out = []
        if len(a) and len(b):
            codes = np.frombuffer(b"".join(b["data"]), dtype=np.uint8).reshape(len(b), -1)
            tables = qz.decode(codes).T.astype(np.float32)
            left, right = a["vid"].to_numpy(), b["vid"].to_numpy()
            queries = np.frombuffer(b"".join(a["data"]), dtype=np.float32).reshape(len(a), -1)
            for s in range(0, len(a), 1024):
                # the product with the decoded codes is the sum of the entries of each query's tables
                scores = queries[s : s + 1024] @ tables
                # a query keeps what may be among its k best here by the error of the tables; itself is one of the k + 1
                kept = min(k + 1, scores.shape[1])
                edge = np.partition(scores, scores.shape[1] - kept, axis=1)[:, scores.shape[1] - kept]
                r, c = np.nonzero(scores >= np.maximum(threshold - MARGIN, edge - qz.spread)[:, None])
                x, y = left[r + s], right[c]
                ok = x != y
                out.append(np.unique(np.stack([np.minimum(x, y)[ok], np.maximum(x, y)[ok]], axis=1), axis=0))
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    # hot cells, counted from the ids alone: blocks of queries meet blocks of codes
    sizes = cut(_hot_cells(v, shared, BLOCK))
    if cells := sizes.count():
        rows = rows.join(small(sizes.select("g", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("m")), cells), ["g", "cell"], "left")
        m = F.coalesce("m", F.lit(1))
        mine = F.pmod(F.xxhash64("vid"), m).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), m - 1), lambda o: F.when(F.col("q") == 1, F.struct(mine.alias("i"), o.alias("j"))).otherwise(F.struct(o.alias("i"), mine.alias("j"))))
        near = rows.withColumn("x", F.explode(blocks)).select("g", "cell", "x.i", "x.j", "q", "vid", "data").groupBy("g", "cell", "i", "j").applyInPandas(scan, "a long, b long")
    else:
        near = rows.groupBy("g", "cell").applyInPandas(scan, "a long, b long")
    near = near.distinct()

    @F.pandas_udf(T.DoubleType())
    def cosine(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.empty(len(x))
        size = x.map(len).to_numpy()
        for d in np.unique(size):
            at = size == d
            out[at] = (unit(x[at]) * unit(y[at])).sum(1)
        return pd.Series(out)

    full = v.select("vid", "id", "vector")
    exact = near.join(full.select(F.col("vid").alias("a"), F.col("id").alias("x"), F.col("vector").alias("xv")), "a").join(full.select(F.col("vid").alias("b"), F.col("id").alias("y"), F.col("vector").alias("yv")), "b")
    scored = exact.select("a", "b", "x", "y", cosine("xv", "yv").alias("similarity")).where(F.col("similarity") >= threshold - 1e-9)
    if rest is not None:
        scored = cut(scored)
    pairs = scored.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity").dropDuplicates(["id_a", "id_b"])
    sides = F.array(F.struct(F.col("id_a").alias("me"), F.col("id_b").alias("other")), F.struct(F.col("id_b").alias("me"), F.col("id_a").alias("other")))
    ranked = pairs.select("id_a", "id_b", "similarity", F.explode(sides).alias("s")).select("id_a", "id_b", "similarity", "s.me", "s.other")
    if rest is not None:
        # what ties with the first copy ties with all of them; those that stay are among it
        head = first.where("r = 1").select("copy", F.col("vid").alias("head"))
        ends = scored.where(F.round("similarity", 9) >= 1).select(F.explode(F.array(F.struct(F.col("a").alias("head"), F.col("y").alias("other")), F.struct(F.col("b").alias("head"), F.col("x").alias("other")))).alias("e")).select("e.*")
        ties = ends.join(head, "head").select("copy", "other").union(first.select("copy", "id")).distinct()
        least = ties.withColumn("n", F.row_number().over(Window.partitionBy("copy").orderBy("other"))).where(F.col("n") <= k).select("copy", "other")
        links = rest.join(least, "copy")
        ranked = ranked.unionByName(links.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"), F.lit(1.0).alias("similarity"), F.col("id").alias("me"), "other"))
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("me").orderBy(F.desc(F.round("similarity", 9)), "other")))
    return ranked.where(F.col("r") <= k).groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity"))


def _hot_cells(v: DataFrame, shared, block: int) -> DataFrame:
    """(g, cell, n) of the cells whose queries outnumber a block; their number is bounded by the rows over the block."""

    def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qs, names = shared.value
        for f in frames:
            for key, part in f.groupby(["model", "dims"], sort=False):
                g = names[key[0], int(key[1])]
                cell, n = np.unique(qs[g].cells(unit(part["vector"])), return_counts=True)
                yield pd.DataFrame({"g": np.int32(g), "cell": cell.astype(np.int64), "n": n.astype(np.int64)})

    return v.select("model", "dims", "vector").mapInPandas(own, "g int, cell long, n long").groupBy("g", "cell").agg(F.sum("n").alias("n")).where(F.col("n") > 4 * block)
