"""Graphs of imports and calls: neighbours, reach, ranks and communities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prism.session import cut

DAMPING, ROUNDS = 0.85, 20
# Kinds of edges that lead from a file to one it imports; those of run time; those from a caller to a symbol.
IMPORT_KINDS = ("imports", "imports:type", "imports:reexport", "imports:asset")
RUNTIME_KINDS = ("imports", "imports:reexport", "imports:asset")
CALL_KINDS = ("calls", "calls:name")


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("to_ref").alias("ref")).agg(F.countDistinct("source_path").alias("importers"))


def dependents(edges: DataFrame, seeds: DataFrame, depth: int | None = 1, type_only: bool = False) -> DataFrame:
    """(seed, path, depth, more): who imports each seed, by hops; the seed itself is never among them. depth None: all.
    type_only: imports of types count too. more: something lies beyond the depth for that seed.

    Each hop joins only the frontier and drops what was seen; rounds end when the frontier is empty.
    """
    links = cut(edges.where(F.col("kind").isin(*(IMPORT_KINDS if type_only else RUNTIME_KINDS))).select("source_path", "to_ref").distinct())
    frontier = seeds.select(F.col("path").alias("seed"), "path").distinct()
    seen = cut(frontier.withColumn("depth", F.lit(0)))
    hop, beyond = 0, None
    while True:
        hop += 1
        now = seen.where(F.col("depth") == hop - 1).select("seed", F.col("path").alias("to_ref"))
        after = now.join(links, "to_ref").select("seed", F.col("source_path").alias("path")).distinct().join(seen, ["seed", "path"], "left_anti")
        if depth is not None and hop > depth:
            beyond = after.select("seed").distinct().withColumn("more", F.lit(True))
            break
        after = cut(after.withColumn("depth", F.lit(hop)))
        if not after.limit(1).count():
            break
        seen = seen.unionByName(after)
        if hop % 5 == 0:
            seen = cut(seen)
    found = seen.where("depth > 0")
    if beyond is None:
        return found.withColumn("more", F.lit(False))
    return found.join(beyond, "seed", "left").select("seed", "path", "depth", F.coalesce("more", F.lit(False)).alias("more"))


def dependencies(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(source_path, to_ref, kind) of the imports of the given files that stay in the workspace."""
    return edges.where(F.col("kind").isin(*IMPORT_KINDS)).join(paths.select(F.col("path").alias("source_path")).distinct(), "source_path", "left_semi").select("source_path", "to_ref", "kind")


def dangling(edges: DataFrame) -> DataFrame:
    """(source_path, to_ref, lines) of imports that ought to lead into the workspace and do not."""
    return edges.where("kind = 'imports:dangling'").select("source_path", "to_ref", "lines")


def hubs(edges: DataFrame, kinds: tuple[str, ...], n: int) -> DataFrame:
    """(ref, users): the n targets with the most distinct sources, ties by ref. Guesses count only if asked for by kind."""
    per = edges.where(F.col("kind").isin(*kinds)).groupBy(F.col("to_ref").alias("ref")).agg(F.countDistinct("source_path").alias("users"))
    return per.orderBy(F.desc("users"), "ref").limit(n)


def relink_set(edges: DataFrame, changed: DataFrame, membership_changed: bool = False) -> DataFrame:
    """Files to link again: importers of the changed files, on through re-exports only, without the changed ones; with
    membership_changed (a file appeared or went) also the importers of what dangles."""
    links = cut(edges.where(F.col("kind").isin(*IMPORT_KINDS)).select("source_path", "to_ref", (F.col("kind") == "imports:reexport").alias("on")).distinct())
    start = cut(changed.select("path").distinct())
    found, visited, frontier = start, start, start
    while True:
        hit = cut(links.join(frontier.select(F.col("path").alias("to_ref")), "to_ref", "left_semi").groupBy(F.col("source_path").alias("path")).agg(F.max("on").alias("on")))
        found = cut(found.unionByName(hit.select("path")).distinct())
        # a file that was found by a plain import still goes on where it is reached by a re-export
        frontier = cut(hit.where("on").select("path").join(visited, "path", "left_anti"))
        if not frontier.limit(1).count():
            break
        visited = cut(visited.unionByName(frontier))
    if membership_changed:
        found = found.unionByName(edges.where("kind = 'imports:dangling'").select(F.col("source_path").alias("path"))).distinct()
    return found.join(start, "path", "left_anti")


def pagerank(edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, refs: DataFrame | None = None) -> DataFrame:
    """(ref, score), the largest score 1. refs: (ref), nodes besides those of the edges. Uniform start; the mass of sinks leaks; parallel edges count each."""
    e = cut(edges.select(F.col("source_path").alias("a"), F.col("to_ref").alias("b")))
    nodes = e.select(F.col("a").alias("ref")).union(e.select("b"))
    nodes = cut((nodes if refs is None else nodes.union(refs.select("ref").where("ref is not null"))).distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("score", F.lit(0.0))
    out = e.groupBy("a").agg(F.count("*").alias("d"))
    links = cut(e.join(out, "a").select("a", "b", (1.0 / F.col("d")).alias("w")).groupBy("a", "b").agg(F.sum("w").alias("w")))
    rank = cut(nodes.withColumn("score", F.lit(1.0 / n)))
    for i in range(rounds):
        got = rank.join(links, rank["ref"] == links["a"]).groupBy(F.col("b").alias("ref")).agg(F.sum(F.col("score") * F.col("w")).alias("s"))
        rank = rank.select("ref").join(got, "ref", "left").select("ref", ((1 - damping) / n + damping * F.coalesce("s", F.lit(0.0))).alias("score"))
        if i % 5 == 4:
            rank = cut(rank)
    top = rank.agg(F.max("score")).first()[0]
    return rank.select("ref", (F.col("score") / top).alias("score"))


def repo_map(edges: DataFrame, scores: DataFrame, budget: int, cost: Column | None = None) -> DataFrame:
    """(path, score, importers, used): the highest files until the budget would be exceeded; the first always, and
    nothing after the first that does not fit. cost: a column over path and what else ``scores`` (ref, score, ..) holds, in tokens."""
    cost = F.ceil((F.length("path") + 16) / 4) if cost is None else cost
    f = scores.withColumnRenamed("ref", "path").join(in_degree(edges).withColumnRenamed("ref", "path"), "path", "left").fillna(0, ["importers"])
    f = f.withColumn("cost", cost.cast("long"))
    # a file costs at least four tokens, so no more than budget / 4 of the highest can fit
    top = f.orderBy(F.desc("score"), F.desc("importers"), "path").limit(max(1, budget // 4 + 1))
    w = Window.orderBy(F.desc("score"), F.desc("importers"), "path").rowsBetween(Window.unboundedPreceding, 0)
    run = top.withColumn("used", F.sum("cost").over(w)).withColumn("n", F.count("*").over(w))
    return run.where((F.col("used") <= budget) | (F.col("n") == 1)).select("path", "score", "importers", "used")


# Symbols that a file of the map shows; what a caller and an importer are worth where there is no rank.
SHOWN, CALLER_WORTH, IMPORTER_WORTH = 5, 0.1, 0.2


def map_symbols(symbols: DataFrame, call_edges: DataFrame, ranks: DataFrame, shown: int = SHOWN) -> DataFrame:
    """(path, id, name, kind, line, signature, callers, score, place): the symbols that each file of the map shows, best first.

    Callers and rank are those of the id, or else of the name; without a rank, a tenth for each caller."""
    calls = call_edges.where(F.col("kind").isin(*CALL_KINDS)).groupBy(F.col("to_ref").alias("ref")).agg(F.count("*").alias("n"))
    known = calls.join(ranks.select("ref", "score"), "ref", "full_outer")
    one = lambda key, tag: known.select(F.col("ref").alias(key), F.col("n").alias(f"n_{tag}"), F.col("score").alias(f"s_{tag}"))
    s = symbols.select("path", "id", "name", "kind", F.col("start_line").alias("line"), "signature").distinct().join(one("id", "i"), "id", "left").join(one("name", "n"), "name", "left")
    callers = F.coalesce("n_i", "n_n", F.lit(0))
    s = s.withColumn("callers", callers).withColumn("score", F.coalesce("s_i", "s_n", callers * CALLER_WORTH))
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), F.desc("callers"), "line", "id"))
    return s.withColumn("place", place).where(F.col("place") <= shown).select("path", "id", "name", "kind", "line", "signature", "callers", "score", "place")


def map_cost(shown: DataFrame) -> DataFrame:
    """(path, symbols_chars): what the lines of a file's symbols take in the map."""
    indent = 4 * F.size(F.split("path", "/"))
    chars = indent + 8 + F.length("kind") + F.length("name") + F.coalesce(F.length("signature"), F.lit(0)) + 14
    return shown.groupBy("path").agg(F.sum(chars).alias("symbols_chars"))


def map_tree(files: DataFrame, depth: int | None = None) -> DataFrame:
    """(path, is_dir, score): the folders and files of the map; a folder's score is the greatest of what it holds. depth: folders
    below so many parts, and what they hold, are left out. files: (path, score)."""
    parts = F.split("path", "/")
    ups = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("path"), (n < F.size(parts)).alias("is_dir"), n.alias("n"), F.size(parts).alias("of")))).alias("x"), "score")
    if depth is not None:
        # the walk stops at the first folder beyond the depth, so files below one do not appear
        ups = ups.where(F.when(F.col("x.is_dir"), F.col("x.n") <= depth).otherwise(F.col("x.of") - 1 <= depth))
    return ups.groupBy(F.col("x.path").alias("path"), F.col("x.is_dir").alias("is_dir")).agg(F.max("score").alias("score"))


def propagated(vectors: DataFrame, edges: DataFrame, parents: DataFrame, alpha: float) -> DataFrame:
    """(id, vector): each raw vector with alpha times the mean of its neighbours' added, at length one. From the raw vectors, so
    again gives the same. vectors: (id, grp, vector); a group's vector is the sum of its cards' at length one.

    Neighbours are groups that share an edge (a, b) either way or are parent (id, parent_id) and member. Groups without any
    keep their raw vectors. Means are built by place, never as lists of vectors."""
    from prism.functions.vectors import unit

    at = vectors.select("grp", F.posexplode("vector").alias("i", "x"))
    gather = lambda df: df.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("v"))
    group = cut(gather(at.groupBy("grp", "i").agg(F.sum(F.col("x").cast("double")).alias("x"))).select("grp", unit(F.col("v")).alias("v")).where("v is not null"))
    links = edges.select("a", "b").union(parents.where("parent_id is not null").select(F.col("id").alias("a"), F.col("parent_id").alias("b"))).where("a <> b")
    both = links.union(links.select("b", "a")).distinct().join(group.select(F.col("grp").alias("a")), "a", "left_semi")
    near = both.join(group.select(F.col("grp").alias("b"), "v"), "b").select(F.col("a").alias("grp"), F.posexplode("v").alias("i", "x")).groupBy("grp", "i").agg(F.avg("x").alias("x"))
    mean = gather(near).withColumnRenamed("v", "mean")
    j = vectors.join(mean, "grp", "left")
    mixed = unit(F.zip_with("vector", "mean", lambda x, y: x.cast("double") + alpha * y))
    return j.select("id", F.when(F.col("mean").isNotNull(), mixed).otherwise(F.col("vector").cast("array<double>")).alias("vector"))


def smallest_span(points: DataFrame, symbols: DataFrame, by_name: bool = False) -> DataFrame:
    """``points`` (point, path, line, and name where by_name) with the id of the smallest symbol that spans each, the earliest by
    seq of equals; null where there is none."""
    s = symbols.select("path", F.col("id").alias("_id"), "start_line", "end_line", "seq", "base_name").distinct()
    j = points.join(s, "path").where("line between start_line and end_line")
    if by_name:
        j = j.where(F.col("name").isNull() | (F.col("base_name") == F.col("name")))
    best = j.groupBy("point").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("n"), "seq", "_id"))["_id"].alias("id"))
    return points.join(best, "point", "left")


def overlay(edges: DataFrame, definitions: DataFrame, references: DataFrame, symbols: DataFrame, import_lines: DataFrame) -> DataFrame:
    """``edges`` with the calls of the files of ``references`` replaced by what a compiler's index says. definitions and references:
    (symbol, path, line, name); import_lines: (path, line), which are no uses. A symbol is that of its first definition that some
    declaration of the name spans; uses within itself are left out; the kind of an edge is that of what it leads to."""
    point = lambda df: df.withColumn("point", F.xxhash64("symbol", "path", "line"))
    to = smallest_span(point(definitions.where(~F.col("symbol").startswith("local "))), symbols, by_name=True).where("id is not null").groupBy("symbol").agg(F.min_by("id", F.struct("path", "line")).alias("to_ref"))
    uses = references.join(import_lines, ["path", "line"], "left_anti").join(to, "symbol")
    uses = smallest_span(point(uses), symbols).withColumn("source_path", F.coalesce("id", "path")).where("source_path <> to_ref")
    kinds = symbols.select(F.col("id").alias("to_ref"), F.lower(F.trim("kind")).alias("k")).distinct()
    kind = F.when(F.col("k").isin("function", "method", "constructor"), "calls").when(F.col("k").isin("class", "interface", "type", "enum", "trait"), "references:type").otherwise("references")
    new = uses.join(kinds, "to_ref").groupBy("source_path", "to_ref", kind.alias("kind")).agg(F.array_sort(F.collect_set("line")).alias("lines"))
    files = references.select("path").distinct()
    owned = symbols.select(F.col("id").alias("source_path"), "path").union(files.select("path", "path")).join(files, "path", "left_semi").select("source_path").distinct()
    gone = F.col("kind").isin("calls", "calls:name", "calls:external", "calls:unresolved", "references:type", "references")
    kept = edges.where(~gone).unionByName(edges.where(gone).join(owned, "source_path", "left_anti"))
    return kept.select("source_path", "to_ref", "kind", "lines").unionByName(new)


def federated_dependents(imports: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host, repo, path): the files of other repositories with an import that names a host's file: by its last part less the
    extension, or, of an index file, by its folder. imports: (repo, path, specifier); hosts: (host: a path)."""
    parts = F.filter(F.split(F.regexp_replace("specifier", r"^['\"`]|['\"`]$", ""), "/"), lambda s: ~s.isin("", "."))
    bare = lambda c: F.regexp_replace(c, r"\.[^.]+$", "")
    i = imports.select("repo", "path", bare(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))).alias("last"), F.try_element_at(parts, F.lit(-2)).alias("parent")).distinct()
    base, folder = bare(F.substring_index("host", "/", -1)), F.substring_index(F.regexp_replace("host", r"/?[^/]*$", ""), "/", -1)
    h = hosts.select("host", base.alias("stem"), folder.alias("folder")).distinct()
    plain = i.join(h.where("stem <> 'index'"), F.col("last") == F.col("stem"))
    index = h.where("stem = 'index'")
    by_folder, by_index = i.join(index, F.col("last") == F.col("folder")), i.where("last = 'index'").join(index, F.col("parent") == F.col("folder"))
    rows = [x.select("host", "repo", "path") for x in (plain, by_folder, by_index)]
    return rows[0].union(rows[1]).union(rows[2]).distinct()


def diagnose(paths: DataFrame, states: DataFrame, cards: DataFrame, ranks: DataFrame) -> DataFrame:
    """(path, lost_at, rank): which stage lost each path: INDEX where it is not indexed or in quarantine, RED_TEAM where all its
    cards are in quarantine, CARDS where it has none, RANK where no lane shows it; null with its best rank where it is found.
    states: (path, status); cards: (path, quarantined); ranks: (path, rank)."""
    c = cards.groupBy("path").agg(F.count_if(~F.col("quarantined")).alias("cards"), F.count_if("quarantined").alias("held"))
    j = paths.select("path").distinct().join(states.select("path", "status"), "path", "left").join(c, "path", "left").join(ranks.groupBy("path").agg(F.min("rank").alias("rank")), "path", "left")
    none = F.coalesce("cards", F.lit(0)) == 0
    lost = F.when(F.coalesce("status", F.lit("missing")) != "indexed", "INDEX").when(none & (F.coalesce("held", F.lit(0)) > 0), "RED_TEAM").when(none, "CARDS").when(F.col("rank").isNull(), "RANK")
    return j.select("path", lost.alias("lost_at"), F.when(lost.isNull(), F.col("rank")).alias("rank"))


# The least gain in modularity that counts as one; ends of links that one task takes (above that, rounds are joins);
# choices that are weighed at once there.
GAIN, IN_ONE, AT_ONCE = 1e-12, 4_000_000, 4_000_000


def communities(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(node, community): communities of high modularity, named by their least node. edges: (a, b, weight), either way round.

    Modularity is raised level by level in rounds. In a round nodes go to the neighbouring community where
    modularity gains most, the least name on ties, in one round only to names below their own and in the next only to names
    above, so that two nodes never swap; every other pair of rounds moves but half of the nodes (by a hash of node and round).
    A round that does not raise the modularity of the whole is taken back, and four such rounds in a row end the level; then
    communities become the nodes of the next. The order of the edges does not matter. A graph of up to IN_ONE ends goes through its
    rounds as numbers in one task, a larger one by joins, with the same result. Null ends are left out; loops count to their node; an empty table gives no row.
    """
    e = edges.where("a is not null and b is not null and weight > 0").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("w"))
    e = cut(e)
    if 2 * e.count() > IN_ONE:
        return _by_joins(e, resolution)
    e = e.withColumn("link", F.monotonically_increasing_id())
    ends = e.select(F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("node"), "link", F.col("w").cast("double").alias("w"))
    return _in_one_task(ends, resolution)


def shared_communities(members: DataFrame, resolution: float = 1.0) -> DataFrame:
    """``communities`` of the graph where two nodes are linked as often as they are in a group together, each pair of them.
    members: (node, grp), each pair once; a node that shares no group has no row.

    Pairs are not written out where memberships fit IN_ONE: what links a node to a community is counted by group."""
    m = members.where("node is not null and grp is not null").distinct()
    m = cut(m.join(m.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp"), "grp"))
    if m.count() > IN_ONE:
        pairs = m.select(F.col("node").alias("a"), "grp").join(m.select(F.col("node").alias("b"), "grp"), "grp").where("a < b")
        return _by_joins(cut(pairs.groupBy("a", "b").agg(F.count("*").cast("double").alias("w"))), resolution)
    number = cut(m.select("grp").distinct()).withColumn("link", F.monotonically_increasing_id())
    return _in_one_task(m.join(number, "grp").select("node", "link", F.lit(1.0).alias("w")), resolution)


def _in_one_task(ends: DataFrame, resolution: float) -> DataFrame:
    """(node, community) of links (node, link, w): all nodes of a link are linked to each other by its weight; of one node, a loop."""
    nodes = cut(ends.select("node").distinct().withColumn("i", F.row_number().over(Window.orderBy("node")) - 1))
    rows = ends.join(nodes, "node").select("i", "link", "w").union(nodes.select("i", F.xxhash64("node"), F.lit(None).cast("double")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = list(frames)
        if not whole:
            return
        f = pd.concat(whole, ignore_index=True)
        mark, f = f[f["w"].isna()].sort_values("i"), f[f["w"].notna()]
        _, first, link = np.unique(f["link"].to_numpy(), return_index=True, return_inverse=True)
        weights, v = f["w"].to_numpy()[first], f["i"].to_numpy().astype(np.int64)
        yield pd.DataFrame({"i": np.arange(len(mark)), "c": _communities(v, link, weights, mark["link"].to_numpy().view(np.uint64), resolution)})

    found = cut(rows.repartition(1).mapInPandas(run, "i int, c int"))
    names = nodes.select(F.col("i").alias("c"), F.col("node").alias("community"))
    return nodes.join(found, "i").join(names, "c").select("node", "community")


def _half(mark: np.ndarray, turn: int) -> np.ndarray:
    """Whether xxhash64 of node and turn, as Spark has it, is even. mark: xxhash64 of the nodes."""
    p1, p2, p3, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    with np.errstate(over="ignore"):
        h = mark + p5 + np.uint64(4)
        h = h ^ (np.uint64(turn) * p1)
        h = (h << np.uint64(23) | h >> np.uint64(41)) * p2 + p3
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
    return (h ^ h >> np.uint64(32)) & np.uint64(1) == 0


def _summed(major: np.ndarray, minor: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(major, minor, sum of x) of each pair that is there, in order. minor lies below n."""
    key = major * n + minor
    span = (int(major.max(initial=-1)) + 1) * n
    if span <= 4 * len(key) + 1024:
        total, there = np.bincount(key, x, span), np.bincount(key, minlength=span)
        at = np.flatnonzero(there)
        return at // n, at % n, total[at]
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[start] // n, key[start] % n, np.add.reduceat(x[order], start)


def _communities(v: np.ndarray, link: np.ndarray, weight: np.ndarray, mark: np.ndarray, resolution: float) -> np.ndarray:
    """The least node of the community of each node 0.. in the order of their names, by the rounds of ``communities``.
    (v, link): ends; weight by link; mark: the hashes of the nodes."""
    size = np.bincount(link, minlength=len(weight))
    k = np.bincount(v, weight[link] * np.maximum(size[link] - 1, 2 * (size[link] == 1)), len(mark))
    total = k.sum() / 2
    # the weight within communities is this and half the squares of how many ends of a link each has
    base = weight[size == 1].sum() - (weight * size)[size > 1].sum() / 2
    v, link = v[size[link] > 1], link[size[link] > 1]
    ends, name, member = np.ones(len(v)), np.arange(len(mark)), np.arange(len(mark))
    while True:
        n = len(name)
        v, link, ends = _summed(v, link, ends, len(weight))
        alone = np.bincount(link, minlength=len(weight))[link] == 1
        base += (weight[link] * ends * ends)[alone].sum() / 2
        v, link, ends = v[~alone], link[~alone], ends[~alone]

        def state(c: np.ndarray) -> tuple[float, tuple]:
            held = _summed(link, c[v], ends, n)  # noqa: B023
            inside = base + (weight[held[0]] * held[2] * held[2]).sum() / 2  # noqa: B023
            return inside / total - resolution * np.square(np.bincount(c, k) / (2 * total)).sum(), held  # noqa: B023

        c = np.arange(n)
        (best, held), idle, turn, moved = state(c), 0, 0, False
        while idle < 4:
            mine = np.ones(n, bool) if turn % 4 < 2 else _half(mark[name], turn // 4)
            after = _round(v, link, ends, weight, k, c, held, mine, total, resolution, turn)
            now, then = state(after) if (after != c).any() else (best, held)
            turn += 1
            if now > best + GAIN:
                c, best, held, idle, moved = after, now, then, 0, True
            else:
                idle += 1
        if not moved:
            return name[member]
        _, first, at = np.unique(c, return_index=True, return_inverse=True)
        order = np.argsort(first)  # communities by their least node
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        at = place[at]
        name, member, k, v = name[first[order]], at[member], np.bincount(at, k), at[v]


def _round(v: np.ndarray, link: np.ndarray, ends: np.ndarray, weight: np.ndarray, k: np.ndarray, c: np.ndarray, held: tuple, mine: np.ndarray, total: float, resolution: float, turn: int) -> np.ndarray:
    """The communities after the nodes whose turn it is have gone to the best one of the turn's direction; ``_moved`` over ends in order of v."""
    after, mass, n = c.copy(), np.bincount(c, k, len(c)), len(c)
    begin = np.searchsorted(held[0], np.arange(len(weight) + 1))
    keep = mine[v]
    v, link, ends = v[keep], link[keep], ends[keep]
    many = begin[link + 1] - begin[link]
    upto = np.cumsum(many)
    at = 0
    while at < len(v):
        # whole nodes of about AT_ONCE choices
        to = np.searchsorted(v, v[min(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE), len(v) - 1)], "right")
        here, m = slice(at, to), many[at:to]
        which = np.arange(m.sum()) + np.repeat(begin[link[here]] - np.cumsum(m) + m, m)
        one, nodes = np.repeat(ends[here], m), np.repeat(v[here], m)
        to_c = held[1][which]
        w = np.repeat(weight[link[here]], m) * one * (held[2][which] - np.where(to_c == c[nodes], one, 0.0))
        low = v[at]
        x, y, w = _summed(nodes - low, to_c, w, n)
        x = x + low
        stays = y == c[x]
        worth = w - resolution * (mass[y] - np.where(stays, k[x], 0.0)) * k[x] / (2 * total)
        own = -(resolution * (mass[c] - k) * k / (2 * total))
        own[x[stays]] = worth[stays]
        onward = y < c[x] if turn % 2 == 0 else y > c[x]
        x, y, worth = x[onward], y[onward], worth[onward]
        if len(x):
            start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            top = np.repeat(np.maximum.reduceat(worth, start), np.diff(np.append(start, len(x))))
            x, y, worth = x[worth == top], y[worth == top], worth[worth == top]
            x, first = np.unique(x, return_index=True)
            go = worth[first] > own[x] + GAIN
            after[x[go]] = y[first][go]
        at = to
    return after


def _by_joins(e: DataFrame, resolution: float) -> DataFrame:
    """``communities`` of (a, b, w), each pair once, by rounds of joins; no component is gathered in a task."""
    level = e
    total = level.agg(F.sum("w")).first()[0]
    member = cut(level.select(F.col("a").alias("node")).union(level.select("b")).distinct().withColumn("community", F.col("node")))
    while total:
        both = cut(level.where("a <> b").select("a", "b", "w").union(level.where("a <> b").select("b", "a", "w")))
        degree = level.select(F.col("a").alias("v"), "w").union(level.select("b", "w")).groupBy("v").agg(F.sum("w").alias("k"))
        of = cut(degree.withColumn("c", F.col("v")))
        best, idle, turn, moved = _modularity(level, of, total, resolution), 0, 0, False
        while idle < 4:
            after = cut(_moved(both, of, total, resolution, turn))
            now = _modularity(level, after, total, resolution)
            turn += 1
            if now > best + GAIN:
                of, best, idle, moved = after, now, 0, True
            else:
                idle += 1
        if not moved:
            break
        names = of.groupBy("c").agg(F.min("v").alias("name"))
        to = cut(of.join(names, "c").select(F.col("v").alias("community"), "name"))
        member = cut(member.join(to, "community").select("node", F.col("name").alias("community")))
        x, y = to.select(F.col("community").alias("a"), F.col("name").alias("x")), to.select(F.col("community").alias("b"), F.col("name").alias("y"))
        level = cut(level.join(x, "a").join(y, "b").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w")))
    least = member.groupBy("community").agg(F.min("node").alias("name"))
    return member.join(least, "community").select("node", F.col("name").alias("community"))


def _modularity(level: DataFrame, of: DataFrame, total: float, resolution: float) -> float:
    x, y = of.select(F.col("v").alias("a"), F.col("c").alias("x")), of.select(F.col("v").alias("b"), F.col("c").alias("y"))
    inside = level.join(x, "a").join(y, "b").where("x = y").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    spread = of.groupBy("c").agg(F.sum("k").alias("k")).agg(F.sum(F.pow(F.col("k") / (2 * total), F.lit(2.0)))).first()[0]
    return inside / total - resolution * spread


def _moved(both: DataFrame, of: DataFrame, total: float, resolution: float, turn: int) -> DataFrame:
    """(v, k, c) after the nodes whose turn it is have gone to their best neighbouring community of the turn's direction."""
    mine = of if turn % 4 < 2 else of.where(F.pmod(F.xxhash64("v", F.lit(turn // 4)), F.lit(2)) == 0)
    near = both.join(mine.select(F.col("v").alias("a")), "a", "left_semi").join(of.select(F.col("v").alias("b"), "c"), "b").groupBy(F.col("a").alias("v"), "c").agg(F.sum("w").alias("w"))
    # the own community is always a choice, be there a link into it or not
    choices = near.union(mine.select("v", "c", F.lit(0.0))).groupBy("v", "c").agg(F.sum("w").alias("w"))
    mass = of.groupBy("c").agg(F.sum("k").alias("mass"))
    j = choices.join(mass, "c").join(mine.select("v", "k", F.col("c").alias("own")), "v")
    stays = F.col("c") == F.col("own")
    worth = F.col("w") - resolution * (F.col("mass") - F.when(stays, F.col("k")).otherwise(0.0)) * F.col("k") / (2 * total)
    onward = F.col("c") < F.col("own") if turn % 2 == 0 else F.col("c") > F.col("own")
    pick = j.groupBy("v").agg(F.min(F.when(onward, F.struct((-worth).alias("u"), "c"))).alias("m"), F.max(F.when(stays, worth)).alias("own_worth"))
    go = pick.where(-F.col("m.u") > F.col("own_worth") + GAIN).select("v", F.col("m.c").alias("to"))
    return of.join(go, "v", "left").select("v", "k", F.coalesce("to", "c").alias("c"))
