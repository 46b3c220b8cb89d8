"""Filling fixed-capacity containers with texts (lexical retrieval packing).

Texts are measured in tokens, cut only where longer than a container, and spread over shards of a bounded
number of tokens by content: pieces are ordered by weighted MinHashes of their terms, rarer terms weighing more, and
the order is cut into shards, so that pieces of like words meet however large the corpus is. Each shard builds a BM25 inverted index of its pieces. The longest unused piece seeds a
container; its best-scoring unused neighbours fill the window greedily, and what room is left takes the
longest unused piece that fits, so a container closes only when no unused piece of its shard fits.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prism.session import cut

#: A token of the built-in tokenizer: a run of letters, digits and underscores, or another non-blank character.
WORD = re.compile(r"\w+|[^\w\s]")
#: Bounds of the work of one task.
SHARD_TOKENS = 600_000
#: Bits of the table of how many pieces hold a term (terms that fall together are counted together); MinHashes that order
#: the pieces; bits of each part of that order.
TABLE, HASHES, BITS = 20, 2, 16
K1, B = 1.2, 0.75

_PIECES = "doc_id long, piece int, pieces int, start int, stop int, n_tokens int, terms array<int>, tfs array<int>"
_loaded: dict[str, object] = {}


def spans(text: str, tokenizer: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the tokens of a text, in characters. tokenizer: None (WORD) or a tokenizers .json file."""
    if tokenizer is None:
        found = [m.span() for m in WORD.finditer(text)]
    else:
        if tokenizer not in _loaded:
            from tokenizers import Tokenizer

            _loaded[tokenizer] = t = Tokenizer.from_file(tokenizer)
            t.encode_special_tokens = True
        found = _loaded[tokenizer].encode(text, add_special_tokens=False).offsets
    a = np.array(found, dtype=np.int64).reshape(-1, 2)
    return a[:, 0], a[:, 1]


def cuts(text: str, tokenizer: str | None, capacity: int) -> list[tuple[int, int, int]]:
    """(start, stop, tokens) of the pieces of a text; together they are the whole text. One piece, unless too long."""
    if tokenizer is None and (n := len(WORD.findall(text))) <= capacity:
        return [(0, len(text), n)]  # places are not needed
    starts, _ = spans(text, tokenizer)
    n = len(starts)
    if n <= capacity:
        return [(0, len(text), n)]
    out, at, i = [], 0, 0
    while i < n:
        j = min(i + capacity, n)
        # several tokens may belong to one character: cut where the character begins
        while j < n and j > i + 1 and starts[j] == starts[j - 1]:
            j -= 1
        stop = len(text) if j == n else int(starts[j])
        out.append((at, stop, j - i))
        at, i = stop, j
    return out


def pieces(docs: DataFrame, capacity: int, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each text with their terms (32-bit hashes) and frequencies. A null text has no tokens."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc, text in zip(f["doc_id"], f["text"], strict=True):
                text = text or ""
                found = WORD.findall(text.lower()) if tokenizer is None and text.isascii() else None
                # letter case changes no token of an ASCII text
                parts = [(0, len(text), len(found))] if found is not None and len(found) <= capacity else cuts(text, tokenizer, capacity)
                for k, (a, b, n) in enumerate(parts):
                    tf = Counter(found if found is not None and len(parts) == 1 else WORD.findall(text[a:b].lower()))
                    hashed: dict[int, int] = {}
                    for w, c in tf.items():
                        if w[0].isalpha():
                            h = _hash(w)
                            hashed[h] = hashed.get(h, 0) + c
                    rows.append((doc, k, len(parts), a, b, n, list(hashed), list(hashed.values())))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "pieces", "start", "stop", "n_tokens", "terms", "tfs"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, _PIECES)


@lru_cache(maxsize=1 << 18)
def _hash(w: str) -> int:
    return xxhash.xxh32_intdigest(w) - (1 << 31)


def fill(n_tokens: np.ndarray, terms: list, tfs: list, capacity: int) -> np.ndarray:
    """The container of each piece of one shard, numbered from 0."""
    n = len(n_tokens)
    lengths = np.array([max(1, int(np.sum(t))) if t is not None else 1 for t in tfs], dtype=np.float64)
    norm = K1 * (1 - B + B * lengths / lengths.mean())
    flat = np.concatenate([np.asarray(t, dtype=np.int64) for t in terms]) if n else np.array([], dtype=np.int64)
    owner = np.repeat(np.arange(n), [len(t) for t in terms])
    tf = np.concatenate([np.asarray(t, dtype=np.float64) for t in tfs]) if n else np.array([])
    order = np.argsort(flat, kind="stable")
    flat, owner, tf = flat[order], owner[order], tf[order]
    vocabulary, first, df = np.unique(flat, return_index=True, return_counts=True)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    impact = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[owner])

    container = np.full(n, -1, dtype=np.int64)
    # unused pieces, ascending by length and number, each one integer
    keys = sorted((int(n_tokens[i]) << 32) + i for i in range(n))
    number = (1 << 32) - 1

    def take(i: int, c: int) -> None:
        container[i] = c
        del keys[bisect_left(keys, (int(n_tokens[i]) << 32) + i)]

    c = 0
    while keys:
        seed = keys[-1] & number
        room = capacity - int(n_tokens[seed])
        take(seed, c)
        if room > 0 and keys and keys[0] >> 32 <= room:
            own = np.searchsorted(vocabulary, np.asarray(terms[seed], dtype=np.int64))
            own = own[df[own] > 1]  # a term of df 1 scores nothing but the seed
            score = np.zeros(n)
            for v in own:
                s = slice(first[v], first[v] + df[v])
                score[owner[s]] += impact[s]
            score[container >= 0] = 0
            near = np.flatnonzero(score)
            for i in near[np.argsort(-score[near], kind="stable")]:
                if n_tokens[i] <= room:
                    take(int(i), c)
                    room -= int(n_tokens[i])
                    if room <= 0 or not keys or keys[0] >> 32 > room:
                        break
            while room > 0 and (at := bisect_left(keys, (room + 1) << 32)):
                i = keys[at - 1] & number
                if n_tokens[i] == 0 and n_tokens[seed] > 0:
                    break
                take(i, c)
                room -= int(n_tokens[i])
        c += 1
    return container


def signature(terms: np.ndarray, table: np.ndarray, total: int) -> list[int]:
    """MinHashes of a set of terms, weighted by idf: pieces that share their rare terms are likely to share them.

    table: how many of the total pieces hold a term, by the low bits of the term."""
    if not len(terms):
        return [0] * HASHES
    t = terms.astype(np.int64)
    df = table[t & ((1 << TABLE) - 1)].astype(np.float64)
    weight = np.log1p(total / (df + 1.0))
    out = []
    for k in range(HASHES):
        h = (t + (1 << 31)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((k + 1) * 0xBF58476D1CE4E5B9 % (1 << 64))
        h = (h ^ h >> np.uint64(30)) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        # a term that no other piece has cannot bring two together
        cost = -np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)) / weight + np.where(df > 1, 0.0, 1e9)
        out.append(int(h[cost.argmin()] * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)))
    return out


def by_content(parts: DataFrame, shards: int) -> DataFrame:
    """parts with the shard of each: ranges of about equal tokens of the order by signature.

    Places of the order are 2^16 values of the first MinHash; one that holds more than an eighth of a shard is ordered
    within by the second MinHash and by a hash of the piece, so that no group of like texts makes a large shard."""
    if shards == 1:
        return parts.withColumn("shard", F.lit(0))
    # over all pieces; the table is of one size at any number of terms
    seen = parts.select(F.explode("terms").alias("t")).groupBy(F.col("t").bitwiseAND(F.lit((1 << TABLE) - 1)).alias("t")).count().toPandas()
    table = np.zeros(1 << TABLE, dtype=np.int64)
    table[seen["t"].to_numpy(np.int64)] = seen["count"].to_numpy(np.int64)
    shared = parts.sparkSession.sparkContext.broadcast((table, max(1, parts.count())))

    @F.pandas_udf("array<long>")
    def sign(terms: pd.Series) -> pd.Series:
        table, total = shared.value
        return terms.map(lambda t: signature(np.asarray(t), table, total))

    signed = cut(parts.withColumn("sign", sign("terms")).withColumn("even", F.xxhash64("doc_id", "piece", "start")))
    signed = signed.select(*parts.columns, F.col("sign")[0].alias("b"), F.shiftright(F.col("sign")[1], 10).cast("int").alias("c"), F.pmod("even", F.lit(1024)).cast("int").alias("e"))
    tokens = F.sum(F.greatest("n_tokens", F.lit(16))).alias("n")
    first = signed.groupBy("b").agg(tokens).toPandas()
    each = first["n"].sum() / shards
    hot = np.zeros(1 << BITS, dtype=bool)
    hot[first["b"][first["n"] > each / 8].to_numpy(np.int64)] = True
    flags = parts.sparkSession.sparkContext.broadcast(hot)

    @F.pandas_udf("long")
    def order(b: pd.Series, c: pd.Series, e: pd.Series) -> pd.Series:
        return (b * (1 << BITS) + (c * 1024 + e).where(flags.value[b.to_numpy()], 0)).astype("int64")

    signed = signed.withColumn("place", order("b", "c", "e"))
    sums = signed.groupBy("place").agg(tokens).toPandas().sort_values("place")
    to = np.minimum(shards - 1, ((sums["n"].cumsum() - sums["n"] / 2) / each).astype(int)).to_numpy(np.int32)
    ends = parts.sparkSession.sparkContext.broadcast((sums["place"].to_numpy(np.int64), to))

    @F.pandas_udf("int")
    def shard(p: pd.Series) -> pd.Series:
        return pd.Series(ends.value[1][np.searchsorted(ends.value[0], p.to_numpy())])

    return signed.select(*parts.columns, shard("place").alias("shard"))


def pack(docs: DataFrame, capacity: int, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, pieces, start, stop, n_tokens, container): every piece of every text in one container.

    Null and empty texts are pieces of no token and share containers of their own kind. Repeated ids are packed
    as often as they stand. An empty table gives no row. Extra columns are ignored.
    """
    parts = cut(pieces(docs, capacity, tokenizer, id_col, text_col))
    total = parts.agg(F.sum(F.greatest("n_tokens", F.lit(16))).alias("n")).first()["n"] or 0
    shards = max(1, -(-int(total) // max(SHARD_TOKENS, 64 * capacity)))

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        c = fill(f["n_tokens"].to_numpy(), list(f["terms"]), list(f["tfs"]), capacity)
        out = f[["doc_id", "piece", "pieces", "start", "stop", "n_tokens"]].copy()
        out["container"] = [f"{key[0]}-{x}" for x in c]
        return out

    return by_content(parts, shards).groupBy("shard").applyInPandas(run, "doc_id long, piece int, pieces int, start int, stop int, n_tokens int, container string")


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """Containers, tokens, the share of room that is used and the number of texts that were cut."""
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n"))
    whole = per.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.sum("n").alias("pieces"), F.max("used").alias("fullest"))
    return whole.select("containers", "pieces", "tokens", "fullest", F.round(F.col("tokens") / (F.col("containers") * capacity), 4).alias("used_share"))
