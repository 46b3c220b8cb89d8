import itertools
import os
import random
import re

import numpy as np
import pytest
from parity import check
from pyspark.sql import functions as F

from prism.llm import neighbours, overlap, splits
from prism.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLE:
        check(spark, QUERIES[name], ORACLE[name], SF)
    else:
        QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("git@h.example:a/b.git", ("h.example", "a", "b")), ("https://www.H.example/A/B/tree/main#x", ("h.example", "a", "b")), ("ssh://git@h.example:22/a/b.git", ("h.example", "a", "b")),
        ("HTTPS://h.example/a/b?tab=x", ("h.example", "a", "b")), ("A/B", (None, "a", "b")), ("a/b.git", (None, "a", "b")), (" h.example/a/b/ ", ("h.example", "a", "b")), ("a", None), ("", None), (None, None), ("http://u:p@h.e:80/o/n", ("h.e", "o", "n")),
    ],
)
def test_places(spark, text, want):
    got = spark.createDataFrame([(text,)], "u string").select(splits.repo_place("u").alias("p")).first()["p"]
    assert (tuple(got) if got else None) == want


def union_find(edges):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "empty"])
def test_components(spark, kind):
    rng = random.Random(1)
    edges = {"random": [(rng.randrange(200), rng.randrange(200)) for _ in range(120)], "chain": [(i, i + 1) for i in range(40)], "star": [(500, i) for i in range(100)], "empty": []}[kind]
    df = spark.createDataFrame([*edges, *edges[:3], (None, 1)], "a long, b long")
    assert {r["node"]: r["component"] for r in splits.hash_to_min(df).collect()} == union_find(edges)


def test_torn_sets_and_new_splits(spark):
    repos = spark.createDataFrame(
        [(5, "https://h.example/o/a", "train", None), (3, "git@h.example:o/b.git", "test", None), (3, "git@h.example:o/b.git", "test", None), (7, "https://g.example/p/c", "val", "http://h.example/O/A"), (8, "https://g.example/q/d", None, "http://z.example/m/m"), (9, "https://k.example/r/e", None, "git@z.example:m/m.git"), (10, None, None, None), (11, "https://x.example/s/f", None, None)],
        "repo_id long, url string, split string, mirror_of string",
    )
    pairs = spark.createDataFrame([(1, "o/a", "TRAIN"), (1, "o/a", "TRAIN"), (2, "O/B.git", "test "), (3, "p/c", None), (4, "q/d", "train"), (5, "r/e", "training"), (6, None, "val"), (7, "s/f", "train"), (8, "https://x.example/s/f/", "dev"), (9, "no/where", "test")], "pair_id long, repo string, split string")
    assert sorted(map(tuple, splits.torn_sets(repos, pairs).collect())) == [(3, 1), (3, 2), (3, 3), (11, 7), (11, 8)]
    new = {r["pair_id"]: r["new_split"] for r in splits.assign_splits(repos, pairs).collect()}
    assert set(new) == set(range(1, 10)) and new[1] == new[2] == new[3] and new[4] == new[5] and new[7] == new[8]
    assert splits.torn_sets(repos.limit(0), pairs).count() == 0 and splits.torn_sets(repos, pairs.limit(0)).count() == 0


def test_rendezvous_keeps_proportions(spark):
    got = {r["s"]: r["count"] for r in spark.range(20_000).select(splits.rendezvous(F.col("id"), {"train": 0.7, "val": 0.2, "test": 0.1}).alias("s")).groupBy("s").count().collect()}
    assert abs(got["train"] - 14_000) < 400 and abs(got["val"] - 4_000) < 300


def test_overlaps_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)]
    rows = []
    for i in range(260):
        n = rng.choice([1, 2, 3, 5, 6, 7, 8, 12, 19, 20, 21, 24, 25, 26, 40])
        w = rng.sample(vocabulary, n) if not rows or rng.random() < 0.4 else re.findall(r"\w+", rows[rng.randrange(len(rows))][3])
        for _ in range(rng.randrange(5)):
            if w and rng.random() < 0.5:
                w.pop(rng.randrange(len(w)))
            elif w:
                w.append(rng.choice(vocabulary))
        rows.append((i, rng.choice(["train", "Train ", "val", "dev", "TEST", None]), "doc", " ".join(w), "", "c"))
    rows += [(900, "train", "doc", None, None, "c"), (901, "test", "doc", None, "", "c"), rows[0], (902, "other", "doc", rows[1][3], "", "c")]
    df = spark.createDataFrame(rows, "pair_id long, split string, source string, query string, positive string, words string")
    sets = {i: ((s or "").strip().lower(), set(re.findall(r"[a-z0-9]+", f"{q or ''} {p or ''}".lower()))) for i, s, _, q, p, _ in rows}
    want = set()
    for (i, (s, x)), (j, (t, y)) in itertools.permutations(sets.items(), 2):
        if s == "train" and t in ("val", "dev", "test") and x and y and len(x & y) * 5 >= 4 * len(x | y):
            want.add((i, j))
    got = [(r["train_id"], r["held_id"]) for r in overlap.cross_split_overlaps(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30
    assert overlap.cross_split_overlaps(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        overlap.cross_split_overlaps(df, 0.5)


def _vectors(n=700, d=24, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, d))
    x = np.concatenate([base[rng.integers(len(base), size=n)] + 0.25 * rng.normal(size=(n, d))]) * rng.uniform(0.1, 9, size=(n, 1))
    return x.astype(np.float32)


def test_neighbours_against_brute_force(spark):
    x = _vectors()
    rows = [(f"id{i:04d}", "m", 24, v.tolist(), "c") for i, v in enumerate(x)]
    bad = [("z1", "m", 24, None, "c"), ("z2", "m", 24, [0.0] * 24, "c"), ("z3", "m", 24, [float("nan")] * 24, "c"), ("z4", "m", 25, [1.0] * 24, "c"), ("z5", None, 24, [1.0] * 24, "c"), ("y1", "other", 24, x[0].tolist(), "c"), ("x1", "odd", 3, [1.0, 2.0, 3.0], "c"), ("x2", "odd", 3, [2.0, 4.0, 6.0], "c")]
    df = spark.createDataFrame(rows + bad + rows[:5], "id string, model string, dims int, vector array<float>, copy string")
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    want = set()
    for i in range(len(u)):
        for j in np.argsort(-s[i])[:5]:
            if s[i, j] >= 0.85:
                want.add((min(i, j), max(i, j)))
    want = {(f"id{a:04d}", f"id{b:04d}") for a, b in want} | {("x1", "x2")}
    got = {(r["id_a"], r["id_b"]) for r in neighbours.similar_pairs(df).collect()}
    assert len(want) > 200 and len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    assert neighbours.similar_pairs(df.limit(0)).count() == 0


def test_many_copies_of_a_vector(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 20)  # hot cells in blocks
    x = _vectors(200)
    rows = [(f"id{i:04d}", "m", 24, (x[0] if i % 3 == 0 else x[i]).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, model string, dims int, vector array<float>")
    got = [(r["id_a"], r["id_b"]) for r in neighbours.similar_pairs(df).collect()]
    copies = [f"id{i:04d}" for i in range(0, 200, 3)]
    want = {tuple(sorted((a, b))) for a in copies for b in [c for c in copies if c != a][:5]}
    assert len(got) == len(set(got)) and want <= set(got)


@pytest.mark.parametrize("other", ["rescaled", "last digit"])
def test_copies_tie_with_vectors_of_the_same_direction(spark, other):
    v = _vectors(60)
    one = (2 * v[0]) if other == "rescaled" else np.nextafter(v[0], np.float32(9))
    rows = [("a00", "m", 24, one.tolist()), *[(f"b{i:02d}", "m", 24, v[0].tolist()) for i in range(1, 11)], *[(f"c{i:02d}", "m", 24, x.tolist()) for i, x in enumerate(v[1:])]]
    df = spark.createDataFrame(rows, "id string, model string, dims int, vector array<float>")
    got = {(r["id_a"], r["id_b"]) for r in neighbours.similar_pairs(df).collect()}
    ids = ["a00", *[f"b{i:02d}" for i in range(1, 11)]]
    want = {tuple(sorted((a, b))) for a in ids for b in [c for c in ids if c != a][:5]}
    assert {p for p in got if p[0] in ids and p[1] in ids} == want


def test_a_product_of_lists_indexes_every_row(monkeypatch):
    monkeypatch.setattr(neighbours, "FLAT", 1)
    x = neighbours.unit(list(_vectors(2000)))
    q = neighbours.Quantiser(x, 2000, 0.85)
    assert len(q.lists) == 2 and q.cells(x).shape[0] == 2000
    back = q.decode(q.encode(x))
    assert back.shape == x.shape and (np.abs((x * (x - back)).sum(1)) < 0.1).mean() > 0.95


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
@pytest.mark.parametrize("flat", [1024, 1])
def test_recall_where_most_cells_are_skipped(spark, monkeypatch, flat):
    monkeypatch.setattr(neighbours, "CELL", 20)
    monkeypatch.setattr(neighbours, "FLAT", flat)
    table = spark.read.parquet("/root/testdata/sf0.1/card_vectors.parquet")
    model = table.groupBy("model").count().orderBy(F.desc("count")).first()["model"]
    table = table.where(F.col("model") == model)
    got = {(r["id_a"], r["id_b"]) for r in neighbours.similar_pairs(table).collect()}
    ok = table.where(neighbours.valid(F.col("model"), F.col("dims"), F.col("vector"))).select("id", "dims", "vector").distinct().toPandas()
    want = set()
    for _, part in ok.groupby("dims"):
        x, ids = neighbours.unit(part["vector"]), part["id"].to_numpy()
        for a in range(0, len(x), 512):
            s = np.round(x[a : a + 512] @ x.T, 9)
            for i, row in enumerate(s, a):
                near = [j for j in np.flatnonzero(row >= 0.85) if ids[j] != ids[i]]
                near.sort(key=lambda j: (-row[j], ids[j]))
                want |= {tuple(sorted((ids[i], ids[j]))) for j in near[:5]}
    recall = len(got & want) / len(want)
    print(f"FLAT {flat}: {len(ok)} rows, recall {recall:.4f}, precision {len(got & want) / len(got):.4f}")
    assert len(ok) / 20 > 6 * 20 and recall >= 0.9


def test_repeated_rows_of_one_vector_count_once(spark):
    rows = [("a", "m", 2, [1.0, 0.0])] * 300 + [("b", "m", 2, [1.0, 0.1]), ("c", "m", 2, [0.9, 0.1])]
    df = spark.createDataFrame(rows, "id string, model string, dims int, vector array<float>")
    assert sorted((r["id_a"], r["id_b"]) for r in neighbours.similar_pairs(df).collect()) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_shares_of_pairs_are_those_asked_for(spark):
    repos = spark.createDataFrame([(i, f"https://h.example/o{i}/r", None) for i in range(400)], "repo_id long, url string, mirror_of string")
    rng = random.Random(3)
    sizes = [1 + int(400 / (i + 1)) for i in range(400)]
    pairs, at = [], 0
    for i, n in enumerate(sizes):
        for _ in range(n):
            pairs.append((at, rng.choice([f"O{i}/R", f"git@h.example:o{i}/r.git"]), "train"))
            at += 1
    # repositories that only pairs name, once with and once without host, and one of a listed owner
    pairs += [(at, "new/x", None), (at + 1, "https://g.example/new/x", None), (at + 2, "g.example/new/y", None), (at + 3, "h.example/o7/other", None), (at + 4, None, None)]
    got = splits.assign_splits(repos, spark.createDataFrame(pairs, "pair_id long, repo string, split string")).collect()
    split = {r["pair_id"]: r["new_split"] for r in got}
    assert len(got) == len(pairs)
    assert len({split[at], split[at + 1], split[at + 2]}) == 1 and next(r for r in got if r["pair_id"] == at + 3)["first_repo_id"] == 7
    share = {k: sum(v == k for v in split.values()) / len(split) for k in ("train", "val", "test")}
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["val"] - 0.1) < 0.02 and abs(share["test"] - 0.1) < 0.02


def test_the_report_counts_what_the_pairs_are(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    base = [rng.sample(words, 25) for _ in range(6)]
    rows = []
    for i in range(120):
        w = list(rng.choice(base))
        if rng.random() < 0.5:
            w[rng.randrange(25)] = rng.choice(words)
        rows.append((i if rng.random() < 0.9 else max(0, i - 1), rng.choice(["train", "dev", "Test"]), rng.choice("ab"), " ".join(w), None))
    df = spark.createDataFrame(rows, "pair_id long, split string, source string, query string, positive string").dropDuplicates(["pair_id", "split"])
    o = overlap.cross_split_overlaps(df).groupBy("held_split", "source").agg(F.count("*").alias("overlaps"), F.countDistinct("held_id").alias("held_records"), F.countDistinct("train_id").alias("train_records"))
    assert sorted(map(tuple, overlap.overlap_report(df).select(*o.columns).collect())) == sorted(map(tuple, o.collect()))
