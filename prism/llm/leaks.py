"""Evaluation texts inside a training corpus, by exact seeds and alignment.

The seed is the longest run of words that the error rule leaves whole: with at most one word in eight altered, a passage
of 25 words has at most three alterations, which leave four runs with 22 words between them, so one of at least six is
whole. Every such run of the items is hashed. A bitmap of those hashes, of one size however many items there are, goes
to the tasks that read the documents; what passes it is joined with the runs themselves, which tells item, document and
diagonal; and what lies about the diagonals is decided by an exact alignment of item and document.

Fingerprints of item-sized windows (SimHash with a multi-index of blocks) cannot find these passages: see the README for
how far apart they lie.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prism.session import cut

PASSAGE, ERRORS = 25, 8
#: Bits of a place in the bitmap of seeds: 2^27 places are 16 MB.
BITMAP = 27
#: Cells of one batch of alignments.
CELLS = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)

_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_LINK = re.compile(r"\]\([^()\s]*(?:\s\"[^\"]*\")?\)")
_WORD = re.compile(r"[^\W_]+")


def seed_size(passage: int = PASSAGE, errors: int = ERRORS) -> int:
    e = passage // errors
    return max(2, -(-(passage - e) // (e + 1)))


def words_of(text: str) -> list[str]:
    """The words of a text without case, punctuation, markup and line breaks."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "](" in text:
        text = _LINK.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return _WORD.findall(text.lower().replace("­", ""))


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, one after the other, and how many words each text has."""
    words = [words_of(t) if t else [] for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    codes, known = pd.factorize(np.array([x for w in words for x in w], dtype=object))
    own = np.array([xxhash.xxh64_intdigest(x) for x in known], dtype=np.uint64)
    return own[codes] if len(codes) else np.empty(0, np.uint64), sizes


def seeds(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of the run of ``width`` words that begins at each place; the last width - 1 places have none."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        out = (out ^ hashes[j : j + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


_ITEMS = "item_id long, words binary, at array<int>, seed array<long>"
_DOCS = "doc_id long, words binary, at array<int>, seed array<long>"


def _seeded(df: DataFrame, key: str, schema: str, passage: int, width: int, bitmap=None) -> DataFrame:
    """(key, words, at, seed) of each text of at least a passage; with a bitmap only seeds that it has, and texts with any."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            flat, sizes = hashed(list(f["text"]))
            starts = np.cumsum(sizes) - sizes
            every = seeds(flat, width)
            owner = np.repeat(np.arange(len(f)), sizes)[: len(every)]
            place = np.arange(len(every)) - starts[owner] if len(every) else np.empty(0, np.int64)
            ok = place <= sizes[owner] - width
            if bitmap is not None:
                spot = every >> np.uint64(64 - BITMAP)
                ok &= (bitmap.value[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)
            ok = np.flatnonzero(ok & (sizes[owner] >= passage))
            owner, place, kept = owner[ok], place[ok], every[ok].view(np.int64)
            ids, first = np.unique(owner, return_index=True)
            ends = np.append(first, len(owner))[1:]
            rows = [(f[key].iat[i], flat[starts[i] : starts[i] + sizes[i]].tobytes(), place[a:b].astype(np.int32), kept[a:b]) for i, a, b in zip(ids, first, ends, strict=True)]
            yield pd.DataFrame(rows, columns=[key, "words", "at", "seed"])

    return df.select(F.col(key).cast("long").alias(key), "text").mapInPandas(run, schema)


def holds_many(pairs: list[tuple[np.ndarray, np.ndarray]], passage: int = PASSAGE, errors: int = ERRORS) -> np.ndarray:
    """Whether each document holds at least ``passage`` consecutive words of its item in order with at most one in ``errors``
    of them replaced, dropped or added; words missing at the ends count as dropped. best[e, k, j]: the most item words of pair
    k that end before word j of the document with e errors."""
    out = np.zeros(len(pairs), dtype=bool)
    order = sorted(range(len(pairs)), key=lambda k: len(pairs[k][1]))
    none, at = -(10**6), 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * len(pairs[order[to]][1]) <= CELLS:
            to += 1
        own = [pairs[k] for k in order[at:to]]
        longest, width = max(len(i) for i, _ in own), max(len(d) for _, d in own)
        item, doc, size = np.zeros((len(own), longest), np.uint64), np.zeros((len(own), width), np.uint64), np.array([len(i) for i, _ in own])
        inside = np.zeros((len(own), width), bool)
        for k, (i, d) in enumerate(own):
            item[k, : len(i)], doc[k, : len(d)], inside[k, : len(d)] = i, d, True
        top = longest // errors
        best, found = np.full((top + 1, len(own), width + 1), none, np.int32), np.zeros(len(own), bool)
        need = np.maximum(passage, np.arange(top + 1) * errors)
        for w in range(longest):
            now = np.full_like(best, none)
            np.maximum(best[0], 0, out=best[0])  # a passage may begin at any word of either
            same = (doc == item[:, w : w + 1]) & inside
            now[:, :, 1:] = np.where(same[None], best[:, :, :-1] + 1, none)
            for e in range(1, top + 1):
                np.maximum(now[e, :, 1:], best[e - 1, :, :-1] + 1, out=now[e, :, 1:])  # replaced
                np.maximum(now[e], best[e - 1] + 1, out=now[e])  # dropped from the item
                np.maximum(now[e, :, 1:], now[e - 1, :, :-1], out=now[e, :, 1:])  # added to the document
            live = w < size
            now[:, ~live] = none
            found |= (now.max(axis=2) >= need[:, None]).any(axis=0)
            if (found | ~live).all():
                break
            best = now
        out[order[at:to]] = found
        at = to
    return out


def holds(item: np.ndarray, doc: np.ndarray, passage: int = PASSAGE, errors: int = ERRORS) -> bool:
    return bool(holds_many([(item, doc)], passage, errors)[0])


def parts_of(item: np.ndarray, doc: np.ndarray, shifts: np.ndarray, errors: int) -> list[np.ndarray]:
    """The parts of a document about the diagonals of its seeds; near ones are one part."""
    slack = len(item) // errors
    low, high = int(shifts.min()), int(shifts.max())
    if high - low <= len(item) + 2 * slack:
        return [doc[max(0, low - slack) : high + len(item) + slack]]
    shifts = np.unique(shifts)
    breaks = np.flatnonzero(np.diff(shifts) > len(item) + 2 * slack) + 1
    return [doc[max(0, g[0] - slack) : g[-1] + len(item) + slack] for g in np.split(shifts, breaks)]


def dense(item: np.ndarray, parts: list[np.ndarray], passage: int, errors: int) -> np.ndarray:
    """Whether each part has enough of the item for a passage: needed, not enough.

    Of some ``passage`` words of the item in a row a passage leaves all but two more than its errors whole, and of their
    triples all but three for each error and one more error (errors that stand close break fewer triples than three each)."""
    e = passage // errors
    ok = np.ones(len(parts), dtype=bool)
    for width, need in ((3, passage - 2 - 3 * (e + 1)), (1, passage - e - 2)):
        at = np.flatnonzero(ok)
        if need <= 0 or not len(at):
            continue
        grams, back = np.unique(seeds(item, width), return_inverse=True)
        sizes = np.array([len(parts[k]) for k in at])
        flat = seeds(np.concatenate([parts[k] for k in at]), width)
        owner = np.repeat(np.arange(len(at)), sizes)[: len(flat)]
        place = np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[owner]
        spot = np.minimum(np.searchsorted(grams, flat), len(grams) - 1)
        hit = np.zeros((len(at), len(grams)), dtype=bool)
        there = (grams[spot] == flat) & (place <= sizes[owner] - width)
        hit[owner[there], spot[there]] = True
        total = np.zeros((len(at), len(back) + 1), dtype=np.int32)
        np.cumsum(hit[:, back], axis=1, out=total[:, 1:])
        run = passage - width + 1
        ok[at] = (total[:, run:] - total[:, :-run]).max(axis=1, initial=0) >= need
    return ok


def find_leaks(items: DataFrame, docs: DataFrame, passage: int = PASSAGE, errors: int = ERRORS) -> DataFrame:
    """(item_id, doc_id) of every document that holds a passage of an item.

    Documents are read once where they lie; only those that hold a seed, as hashes of their words, are exchanged. Items of
    any number stay in tables; the driver sees the bitmap of their seeds alone (2^27 bits). Null ids, null and short texts
    hold and leak nothing; repeated rows give one row; a seed that many items and documents share is a key of a join, which
    is split where it is skewed.
    """
    width = seed_size(passage, errors)
    spark = docs.sparkSession
    own = cut(_seeded(items.where("item_id is not null and text is not null").select("item_id", "text").distinct(), "item_id", _ITEMS, passage, width).withColumn("item_mark", F.xxhash64("words")))
    runs = own.select("item_id", "item_mark", F.posexplode("seed").alias("place", "seed"))
    spot = F.shiftrightunsigned("seed", 64 - BITMAP)
    bits = runs.groupBy(F.shiftrightunsigned(spot, 6).alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - BITMAP}) & 63 as int))")).alias("b")).toPandas()
    bitmap = np.zeros(1 << (BITMAP - 6), dtype=np.uint64)
    bitmap[bits["i"].to_numpy(np.int64)] = bits["b"].to_numpy(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(bitmap)

    seen = cut(_seeded(docs.where("doc_id is not null and text is not null"), "doc_id", _DOCS, passage, width, shared).withColumn("mark", F.xxhash64("words")))
    hits = seen.select("doc_id", "mark", F.explode(F.arrays_zip("at", "seed")).alias("x")).select("doc_id", "mark", "x.at", "x.seed")
    # an error breaks at most ``width`` runs of a passage: so many are left
    least = max(1, passage - width + 1 - width * (passage // errors))
    met = hits.join(runs, "seed").groupBy("item_id", "item_mark", "doc_id", "mark").agg(F.collect_set(F.col("at") - F.col("place")).alias("shifts"), F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    full = met.join(own.select("item_id", "item_mark", F.col("words").alias("item")), ["item_id", "item_mark"]).join(seen.select("doc_id", "mark", F.col("words").alias("doc")), ["doc_id", "mark"])

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            pairs, owner = [], []
            items, docs, shifts = (f[c].to_numpy() for c in ("item", "doc", "shifts"))
            for _, rows in f.groupby(["item_id", "item_mark"], sort=False).indices.items():
                item = np.frombuffer(items[rows[0]], np.uint64)
                parts = [(k, p) for k in rows for p in parts_of(item, np.frombuffer(docs[k], np.uint64), np.asarray(shifts[k]), errors)]
                for (k, part), good in zip(parts, dense(item, [p for _, p in parts], passage, errors), strict=True):
                    if good:
                        pairs.append((item, part))
                        owner.append(k)
            ok = sorted({k for k, good in zip(owner, holds_many(pairs, passage, errors), strict=True) if good})
            yield f.iloc[ok][["item_id", "doc_id"]]

    return full.select("item_id", "item_mark", "doc_id", "item", "doc", "shifts").mapInPandas(decide, "item_id long, doc_id long").distinct()
