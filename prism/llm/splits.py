"""Splits that keep related records together: hash-to-min components, then weighted rendezvous hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prism.session import cut

#: A repository with its host (url, scp form, or host/owner/name), and by owner/name alone. Groups: host, owner, name.
_HOSTED = r"^(?:(?:git\+)?[a-z]+://(?:[^/@]*@)?|[^/@:]+@|(?=[^/:]+\.[^/:]+/[^/]+/[^/]))(?:www\.)?([^/:]+?)\.?(?::\d+(?=/))?[/:]+([^/]+)/+([^/]+?)(?:\.git)?(?:/.*)?$"
_BARE = r"^(){1}/*([^/:@]+)/+([^/]+?)(?:\.git)?(?:/.*)?$"

PROPORTIONS = {"train": 0.8, "val": 0.1, "test": 0.1}
#: Sets with at least this share of all pairs are placed largest first; there are at most 1 / BIG of them.
BIG = 1 / 4000


def repo_place(c: Column | str) -> Column:
    """struct(host, owner, name), lower case, of a repository however written; host is null for owner/name alone.

    Null where no owner and name can be read.
    """
    c = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(F.lower(F.regexp_replace(c, "[\\s\ufeff]+", "")), "[?#].*$", "")
    hosted = s.rlike(_HOSTED)
    part = lambda i: F.nullif(F.when(hosted, F.regexp_extract(s, _HOSTED, i)).otherwise(F.regexp_extract(s, _BARE, i)), F.lit(""))
    return F.when(part(2).isNotNull() & part(3).isNotNull(), F.struct(part(1).alias("host"), part(2).alias("owner"), part(3).alias("name")))


def hash_to_min(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each node is connected to. edges: (a, b) of one type, loops allowed.

    max_rounds is no limit on what is found: not to be stable by then is an error. The rounds of a set of n nodes are about
    log2 of its diameter, so 60 serve any table there is. Each round every node tells the members of its cluster to its least member, and its least member to all of
    them; rounds are logarithmic in the diameter. Clusters are rows, never lists: the least of a large cluster
    is found by partial aggregation and joined back, so no group is gathered in one task. Null ends and repeated
    edges do not matter; an empty table gives no row.
    """
    e = edges.where("a is not null and b is not null")
    both = e.select(F.col("a").alias("u"), F.col("b").alias("w")).union(e.select(F.col("b"), F.col("a")))
    loops = both.select("u", F.col("u").alias("w"))
    now = cut(both.union(loops).distinct())
    seen = None
    for _ in range(max_rounds):
        least = now.groupBy("u").agg(F.min("w").alias("m"))
        told = now.join(least, "u")
        after = cut(told.select(F.col("m").alias("u"), "w").union(told.select(F.col("w").alias("u"), F.col("m").alias("w"))).distinct())
        size, total = after.agg(F.count("*"), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)"))).first()
        now = after
        if (size, total) == seen:
            return now.groupBy("u").agg(F.min("w").alias("component")).withColumnRenamed("u", "node")
        seen = (size, total)
    raise RuntimeError(f"components are not stable after {max_rounds} rounds")


def rendezvous(key: Column, proportions: dict[str, float] | None = None, seed: int = 0) -> Column:
    """The split of a key by weighted rendezvous hashing: the split of the least -ln(hash) / weight.

    A change of one weight moves only keys into or out of that split.
    """
    proportions = {k: v for k, v in (proportions or PROPORTIONS).items() if v > 0}
    costs = [F.struct((_cost(key, k, seed) / v).alias("c"), F.lit(k).alias("s")) for k, v in proportions.items()]
    return (F.least(*costs) if len(costs) > 1 else costs[0])["s"]


def _cost(key: Column, name: str, seed: int) -> Column:
    """-ln of a hash in (0, 1) of the key and the split."""
    return -F.log((F.shiftrightunsigned(F.xxhash64(key, F.lit(name), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53))


def split_name(c: Column | str) -> Column:
    """train, val or test however spelled, else null."""
    s = F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"[^A-Za-z]", ""))
    return (
        F.when(s.isin("train", "training", "trn", "trainset", "trainsplit"), "train")
        .when(s.isin("val", "valid", "validation", "dev", "devel", "development", "eval", "validate"), "val")
        .when(s.isin("test", "testing", "tst", "testset", "heldout", "holdout"), "test")
    )


def repo_sets(repos: DataFrame) -> DataFrame:
    """(repo_id, place, first_repo_id): each row of repos with the least repo_id of its related set.

    Rows are joined through nodes for the place a url leads to, its owner on its host and the place it mirrors,
    so a shared owner costs one edge a row. Rows without a readable url are a set of their own.
    """
    rows = repos.where("repo_id is not null").select("repo_id", repo_place("url").alias("p"), repo_place("mirror_of").alias("m")).distinct()
    rows = cut(rows)
    text = lambda kind, *cs: F.concat_ws("/", F.lit(kind), *[F.coalesce(c, F.lit("")) for c in cs])
    me = text("0", F.lpad(F.col("repo_id").cast("string"), 20, "0"))
    places = [(F.col("p").isNotNull(), text("1", F.col("p.host"), F.col("p.owner"), F.col("p.name"))), (F.col("p").isNotNull(), text("2", F.col("p.host"), F.col("p.owner"))), (F.col("m").isNotNull(), text("1", F.col("m.host"), F.col("m.owner"), F.col("m.name"))), (F.lit(True), me)]
    edges = rows.select(F.explode(F.filter(F.array(*[F.when(ok, F.struct(me.alias("a"), b.alias("b"))) for ok, b in places]), lambda x: x.isNotNull())).alias("e")).select("e.*")
    parts = hash_to_min(edges)
    mine = parts.where(F.col("node").startswith("0/")).select(F.expr("cast(substring(node, 3) as bigint)").alias("repo_id"), F.expr("cast(substring(component, 3) as bigint)").alias("first_repo_id"))
    return rows.select("repo_id", F.col("p").alias("place")).join(mine, "repo_id")


def pair_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(pair_id, split, first_repo_id) of each pair that names a known repository, each once.

    A repository named without host is the one of that owner and name; where several hosts have it, the set
    of the least repo_id.
    """
    full = sets.where("place is not null").select(F.concat_ws("/", "place.host", "place.owner", "place.name").alias("k"), "first_repo_id")
    bare = sets.where("place is not null").select(F.concat_ws("/", "place.owner", "place.name").alias("k"), "first_repo_id")
    known = full.union(bare).groupBy("k").agg(F.min("first_repo_id").alias("first_repo_id"))
    p = pairs.select("pair_id", split_name("split").alias("split"), repo_place("repo").alias("p")).where("p is not null and pair_id is not null").distinct()
    return p.select("pair_id", "split", F.concat_ws("/", "p.host", "p.owner", "p.name").alias("k")).join(known, "k").select("pair_id", "split", "first_repo_id")


def torn_sets(repos: DataFrame, pairs: DataFrame) -> DataFrame:
    """(first_repo_id, pair_id): every pair of each related set whose pairs stand in more than one split today."""
    p = cut(pair_sets(pairs, repo_sets(repos)))
    torn = p.groupBy("first_repo_id").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select("first_repo_id")
    return p.join(torn, "first_repo_id").select("first_repo_id", "pair_id").distinct()


def all_sets(repos: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, first_repo_id, set_id) of every pair. Repositories that only pairs name are related by place and owner to
    each other and to those of ``repos``, as repos are; one named without host is that of a host where one has it. first_repo_id is null
    where no listed repository is in the set; a pair without a readable repository is a set of its own."""
    sets = cut(repo_sets(repos))
    mine = pairs.where("pair_id is not null").select("pair_id", repo_place("repo").alias("p")).distinct()
    places = sets.where("place is not null").select(F.col("place.host").alias("host"), F.col("place.owner").alias("owner"), F.col("place.name").alias("name"), "first_repo_id")
    named = mine.where("p is not null").select("p.host", "p.owner", "p.name").distinct()
    hosted = places.where("host is not null").select("owner", "name", "host", F.col("first_repo_id").alias("f")).unionByName(named.where("host is not null").select("owner", "name", "host", F.lit(None).cast("long").alias("f")))
    # listed before unlisted, then the least set, then the least host
    home = hosted.groupBy("owner", "name").agg(F.min(F.struct(F.col("f").isNull().alias("u"), "f", "host")).alias("m")).select("owner", "name", F.col("m.host").alias("home"))
    at = named.join(home, ["owner", "name"], "left").withColumn("at", F.coalesce("host", "home", F.lit("")))
    node = F.concat_ws("/", "at", "owner", "name")
    owner = F.concat_ws("/", F.lit("@"), "at", "owner")
    listed = places.where("host is not null").select(F.concat(F.lit("#"), F.lpad(F.col("first_repo_id").cast("string"), 20, "0")).alias("a"), F.explode(F.array(F.concat_ws("/", "host", "owner", "name"), F.concat_ws("/", F.lit("@"), "host", "owner"))).alias("b"))
    edges = listed.union(at.select(node.alias("a"), owner.alias("b"))).distinct()
    parts = hash_to_min(edges)
    of = at.select("host", "owner", "name", node.alias("node")).join(parts, "node").select("host", "owner", "name", "component")
    k = F.concat_ws("/", F.coalesce("host", F.lit("")), "owner", "name")
    known = of.select(k.alias("k"), "component")
    rows = mine.select("pair_id", F.when(F.col("p").isNotNull(), F.concat_ws("/", F.coalesce("p.host", F.lit("")), "p.owner", "p.name")).alias("k")).join(known, "k", "left")
    # a pair that names several repositories goes with the least of their sets
    one = rows.groupBy("pair_id").agg(F.min("component").alias("component"))
    first = F.when(F.col("component").startswith("#"), F.expr("cast(substring(component, 2) as bigint)"))
    return one.select("pair_id", first.alias("first_repo_id"), F.coalesce("component", F.concat(F.lit("p"), F.col("pair_id"))).alias("set_id"))


def assign_splits(repos: DataFrame, pairs: DataFrame, proportions: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """(pair_id, first_repo_id, new_split): all pairs of a related set in one split, shares of pairs as asked for.

    Sets weigh as many pairs as they have. Those of at least BIG of all pairs (so at most 1 / BIG, one row each on the driver)
    are placed largest first, each by rendezvous hashing with the room that the splits have left as weights, among the splits
    that it fits into, or where it fits none into the one with most room. All others go by rendezvous hashing over the room
    that is left, which they fill evenly by their number. A table may be empty; null proportions mean the usual ones.
    """
    shares = {k: v for k, v in (proportions or PROPORTIONS).items() if v > 0}
    sets = cut(all_sets(repos, pairs))
    size = sets.groupBy("set_id").agg(F.count("*").alias("n"))
    total = sets.count()
    big = size.where(F.col("n") >= max(2.0, BIG * total)).select("set_id", "n", *[_cost(F.col("set_id"), k, seed).alias(k) for k in shares]).orderBy(F.desc("n"), "set_id").collect()
    room = {k: v / sum(shares.values()) * total for k, v in shares.items()}
    placed = []
    for r in big:
        fits = [k for k in room if room[k] >= r["n"]]
        best = min(fits, key=lambda k: r[k] / room[k]) if fits else max(room, key=lambda k: room[k])
        room[best] -= r["n"]
        placed.append((r["set_id"], best))
    rest = rendezvous(F.col("set_id"), {k: max(v, 0.0) for k, v in room.items()} if any(v > 0 for v in room.values()) else shares, seed)
    fixed = pairs.sparkSession.createDataFrame(placed, "set_id string, placed string")
    return sets.join(fixed, "set_id", "left").select("pair_id", "first_repo_id", F.coalesce("placed", rest).alias("new_split"))
