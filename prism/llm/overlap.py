"""Same or near-same records across splits: an exact prefix-filter bipartite join on rare shingles.

Records with the same set of words are one class. The words of a class are put in one global order, rarest first by
order of magnitude and by hash within one, so that words that always occur together do not stand together; its
shingles are the runs of q words in that order, so shingles are ordered too. If two classes of n and m words have a
Jaccard similarity of t or more, they differ in at most (n + m) / 9 words (at t = 0.8). A word of n's own breaks at
most q of its shingles, one of the other's at most q - 1; the rest are common, and the first common shingle lies within
that many places plus one on either side. Long classes use q = 4, shorter ones q = 3, the shortest single words,
whose prefix is n - ceil(t n) + 1. Prefixes of evaluation classes are indexed, those of training classes probe them
with length and position filters. A match of keys also compares two 64-bit parities of the words of either class, in which
each word of one side alone can turn one bit at most: where more bits differ than words may, the match is dropped at once.
What is left is verified on the word sets. Nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prism.llm.splits import split_name
from prism.session import cut

#: (q, least and most words of a class that uses shingles of q words, most shingles broken by the word). A pair of
#: classes uses the longest shingles that both have; lengths of such a pair differ by a quarter at most.
SHINGLES = ((4, 20, None, 0.8), (3, 6, 24, 0.6), (1, 1, 7, None))


def _classes(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    text = F.lower(F.concat_ws(" ", "query", "positive"))
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))))
    r = pairs.where("pair_id is not null").select("pair_id", "source", split_name("split").alias("split"), words.alias("words")).where("split is not null and size(words) > 0")
    members = cut(r.withColumn("cid", F.unhex(F.md5(F.concat_ws(" ", "words")))).distinct())
    classes = members.groupBy("cid").agg(
        F.first("words").alias("words"), F.max(F.col("split") == "train").alias("train"), F.max(F.col("split") != "train").alias("held")
    )
    return members.drop("words"), classes


def overlapping_classes(classes: DataFrame, t: float = 0.8) -> DataFrame:
    """(train_cid, held_cid, similarity) of the pairs of different classes, one in train, one held out."""
    if t < 0.8:
        raise ValueError("the shingle bound is made for similarities of 0.8 or more")
    exploded = classes.select("cid", F.explode("words").alias("w"))
    df = exploded.groupBy("w").agg(F.count("*").alias("df"))
    order = F.struct(F.floor(F.log2("df") / 3).alias("m"), F.xxhash64("w").alias("h"), "w")
    ranked = exploded.join(df, "w").groupBy("cid").agg(F.array_sort(F.collect_list(order)).alias("r"))
    sides = cut(ranked.join(classes.select("cid", "train", "held"), "cid").select("cid", "train", "held", F.col("r.w").alias("ws"), F.size("r").alias("n"), *_parities("r.w")))
    n = F.col("n")
    keys = []
    for q, least, most, broken in SHINGLES:
        prefix = F.floor(broken * n + 1e-9) + 1 if broken else n - F.ceil(t * n - 1e-9) + 1
        places = F.sequence(F.lit(1), F.least(n - q + 1, prefix).cast("int"))
        key = lambda i, q=q: F.struct(F.xxhash64(*[F.element_at("ws", i + j) for j in range(q)]).alias("k"), i.alias("pos"), F.lit(q).alias("q"))
        mine = (n >= least) & (n <= most) if most else n >= least
        keys.append(F.when(mine, F.transform(places, _one(key))).otherwise(F.array()))
    keyed = lambda side: sides.where(side).select(F.col("cid").alias(f"{side}_cid"), n.alias(f"{side}_n"), F.col("b0").alias(f"{side}_b0"), F.col("b1").alias(f"{side}_b1"), F.explode(F.concat(*keys)).alias("x")).select(f"{side}_cid", f"{side}_n", f"{side}_b0", f"{side}_b1", F.col("x.k").alias("k"), F.col("x.q").alias("q"), F.col("x.pos").alias(f"{side}_pos"))
    x, y, q = F.col("train_n"), F.col("held_n"), F.col("q")
    lengths = (x >= t * y - 1e-9) & (y >= t * x - 1e-9)
    differ = F.floor((x + y) * (1 - t) / (1 + t) + 1e-9)
    own_x, own_y = F.floor((differ + x - y) / 2), F.floor((differ + y - x) / 2)  # words of one side only, at most
    broken_x, broken_y = q * own_x + (q - 1) * own_y, q * own_y + (q - 1) * own_x
    need = F.greatest(x - q + 1 - broken_x, y - q + 1 - broken_y)
    places = (F.col("train_pos") <= broken_x + 1) & (F.col("held_pos") <= broken_y + 1) & (1 + F.least(x - q + 1 - F.col("train_pos"), y - q + 1 - F.col("held_pos")) >= need)
    bits = [F.bit_count(F.col(f"train_{b}").bitwiseXOR(F.col(f"held_{b}"))) for b in ("b0", "b1")]
    turned = bits[0] + bits[1] <= differ
    # the bounds hold for the first common shingle; other common ones may be dropped
    near = keyed("train").join(keyed("held"), ["k", "q"]).where(lengths & places & turned & (F.col("train_cid") != F.col("held_cid"))).select("train_cid", "held_cid").distinct()
    ws = sides.select("cid", "ws")
    full = near.join(ws.select(F.col("cid").alias("train_cid"), F.col("ws").alias("x")), "train_cid").join(ws.select(F.col("cid").alias("held_cid"), F.col("ws").alias("y")), "held_cid")
    common = F.size(F.array_intersect("x", "y"))
    return full.select("train_cid", "held_cid", (common / (F.size("x") + F.size("y") - common)).alias("similarity")).where(F.col("similarity") >= t - 1e-12)


def _parities(words: str) -> list:
    """Two 64-bit words: of each bit, whether an odd number of the words fall on it."""
    h = f"transform({words}, w -> xxhash64(w))"
    half = "aggregate({0}, 0L, (a, h) -> if((h & 64) = {1}, a ^ shiftleft(1L, cast(h & 63 as int)), a))"
    return [F.expr(half.format(h, bit)).alias(name) for name, bit in (("b0", 0), ("b1", 64))]


def _one(f):
    """A function of one argument only, as the higher-order functions ask for."""
    return lambda i: f(i)


def overlap_classes(pairs: DataFrame, t: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (train_cid, held_cid, similarity) between classes of records with the same words, a class that
    stands on both sides with itself among them, and members (cid, pair_id, split, source), one row a record."""
    members, classes = _classes(pairs)
    classes = cut(classes)
    both = classes.where("train and held").select(F.col("cid").alias("train_cid"), F.col("cid").alias("held_cid"), F.lit(1.0).alias("similarity"))
    return overlapping_classes(classes, t).unionByName(both), members


def cross_split_overlaps(pairs: DataFrame, t: float = 0.8) -> DataFrame:
    """(train_id, held_id, held_split, source, similarity) of every overlap of a held-out record with a training record.

    Records are queries with their positives; null texts count as empty, records without a word or a readable
    split have no overlap. Repeated rows count once; a record standing in train and in a held-out split overlaps
    itself nowhere. Copies join through their class; the rows of a class are spread over tasks by the join's keys.
    """
    links, members = overlap_classes(pairs, t)
    tr = members.where("split = 'train'").select(F.col("cid").alias("train_cid"), F.col("pair_id").alias("train_id"))
    he = members.where("split <> 'train'").select(F.col("cid").alias("held_cid"), F.col("pair_id").alias("held_id"), F.col("split").alias("held_split"), "source")
    return links.join(he, "held_cid").join(tr, "train_cid").where("train_id <> held_id").select("train_id", "held_id", "held_split", "source", "similarity").distinct()


def overlap_report(pairs: DataFrame, t: float = 0.8) -> DataFrame:
    """(held_split, source, overlaps, held_records, train_records): the counts of cross_split_overlaps, from the sizes of
    classes; copies are never paired out. A record is a pair_id with its words, split and source."""
    links, members = overlap_classes(pairs, t)
    links = cut(links.select("train_cid", "held_cid"))
    by = ["held_split", "source"]
    he = members.where("split <> 'train'").select(F.col("cid").alias("held_cid"), F.col("pair_id").alias("held_id"), F.col("split").alias("held_split"), "source").distinct()
    tr = members.where("split = 'train'").select(F.col("cid").alias("train_cid"), F.col("pair_id").alias("train_id")).distinct()
    h, n = he.groupBy("held_cid", *by).agg(F.count("*").alias("h")), tr.groupBy("train_cid").agg(F.count("*").alias("n"))
    met = cut(links.join(h, "held_cid").join(n, "train_cid"))
    # records that stand in train and held out overlap themselves in links of their classes: taken off
    self_ = he.join(tr, F.col("held_id") == F.col("train_id")).join(links, ["train_cid", "held_cid"], "left_semi")
    alone = self_.join(links.groupBy("held_cid").agg(F.count("*").alias("l")), "held_cid").join(n, "train_cid")
    lone_held = alone.where("l = 1 and n = 1").groupBy(*by).agg(F.countDistinct("held_id").alias("_h"))
    selves = self_.groupBy(*by).agg(F.count("*").alias("_s"))
    sums = met.groupBy(*by).agg(F.sum(F.col("h") * F.col("n")).alias("overlaps"))
    held = met.select("held_cid", *by).distinct().join(he, ["held_cid", *by]).groupBy(*by).agg(F.countDistinct("held_id").alias("held_records"))
    # a training record counts unless the only held record of that split and source that its class meets is itself
    rooms = met.groupBy("train_cid", *by).agg(F.sum("h").alias("room"))
    trained = rooms.join(tr, "train_cid").join(self_.select("train_cid", "train_id", *by, F.lit(1).alias("me")).distinct(), ["train_cid", "train_id", *by], "left").where(F.col("room") > F.coalesce("me", F.lit(0)))
    train = trained.groupBy(*by).agg(F.countDistinct("train_id").alias("train_records"))
    out = sums.join(held, by).join(train, by, "left").join(selves, by, "left").join(lone_held, by, "left").fillna(0, ["_s", "_h", "train_records"])
    return out.select(*by, (F.col("overlaps") - F.col("_s")).alias("overlaps"), (F.col("held_records") - F.col("_h")).alias("held_records"), "train_records").where("overlaps > 0")
