from datetime import datetime, timedelta
from threading import Barrier, Thread

import pytest
from pyspark.sql import functions as F

from prism.operators.incremental import IncrementalTarget, Overtaken, land, normal_digest

T0 = datetime(2025, 1, 1)
H = lambda n: T0 + timedelta(hours=n)
SCHEMA = "path string, content_hash string, seen_at timestamp, loaded_at timestamp, key string, version string"


def source(spark, rows):
    return spark.createDataFrame([(p, d, s, l, "clash", "clash") for p, d, s, l in rows], SCHEMA)


def run(target, src, run_id, at):
    return target.process(src, run_id, at, "path", normal_digest("content_hash"), "seen_at", "loaded_at")


def changes(target):
    return sorted((r.run_id, r.key) for r in target.changes().collect())


def test_late_repeated_and_reverted_rows(spark, tmp_path):
    src = source(
        spark,
        [
            ("a", "sha256:AA", H(0), H(1)), ("a", "sha256:AA", H(0), H(1)), ("b", "bb", H(0), H(1)), ("n", None, H(0), H(1)), ("e", "  ", H(0), H(1)), (None, "cc", H(0), H(1)),
            ("a", "aa", H(5), H(6)),  # the same digest, seen again
            ("b", "b2", H(5), H(6)),
            ("a", "late", H(4), H(9)),  # arrives later, but was seen earlier
            ("b", "bb", H(9), H(9)),
        ],
    )
    t = IncrementalTarget(spark, str(tmp_path / "t"), compact_every=2)
    assert run(t, src, 1, H(2)) and run(t, src, 2, H(7)) and run(t, src, 3, H(10))
    assert changes(t) == [(1, "a"), (1, "b"), (2, "b"), (3, "b")]
    assert not run(t, src, 2, H(7))  # published before: nothing is repeated
    with pytest.raises(ValueError):
        run(t, src, 4, H(3))


def test_a_run_that_dies_leaves_no_trace(spark, tmp_path, monkeypatch):
    src = source(spark, [("a", "x", H(0), H(0))])
    t = IncrementalTarget(spark, str(tmp_path / "t"))
    real = t._path
    monkeypatch.setattr(t, "_path", lambda p: real(p) if "meta.json" not in p else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run(t, src, 1, H(1))
    again = IncrementalTarget(spark, str(tmp_path / "t"))
    assert again.versions() == []
    assert run(again, src, 1, H(1))
    assert changes(again) == [(1, "a")]


def test_empty_source_and_ties(spark, tmp_path):
    t = IncrementalTarget(spark, str(tmp_path / "t"))
    assert t.changes() is None
    run(t, source(spark, []), 1, H(1))
    assert t.changes().count() == 0
    # of rows seen at the same time the later loaded counts, then the greater digest
    run(t, source(spark, [("a", "x", H(1), H(2)), ("a", "y", H(1), H(2)), ("a", "a", H(1), H(1.5))]), 2, H(3))
    assert [r.version for r in t.state().collect()] == ["y"]


def test_digests(spark):
    rows = spark.createDataFrame([("SHA256:Ab",), ("ab",), (" ab ",), ("md5=ab",), ("",), (None,)], "d string")
    assert [r[0] for r in rows.select(normal_digest(F.col("d"))).collect()] == ["ab"] * 4 + [None, None]


def test_of_two_runs_that_race_one_begins_again(spark, tmp_path):
    src = source(spark, [("a", "x", H(0), H(0)), ("b", "y", H(0), H(0))])
    ends, both = [], Barrier(2)

    def racing(run_id):
        t = IncrementalTarget(spark, str(tmp_path / "t"))
        publish = t._publish
        t._publish = lambda *a: (both.wait(60), publish(*a))  # both have read the same log
        try:
            ends.append((run_id, run(t, src, run_id, H(1))))
        except Overtaken:
            t._publish = publish
            ends.append((run_id, None))
            run(t, src, run_id, H(1))

    threads = [Thread(target=racing, args=(i,)) for i in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(x for _, x in ends if x) == [True] and [x for _, x in ends].count(None) == 1
    t = IncrementalTarget(spark, str(tmp_path / "t"))
    assert [m["run_no"] for m in t.versions()] == [1, 2]
    winner = next(i for i, x in ends if x)
    assert changes(t) == [(winner, "a"), (winner, "b")]  # the other published an empty version; nothing is lost or repeated
    assert t.clean(0.0) == 1


def test_landed_sources_are_read_by_day(spark, tmp_path):
    src = source(spark, [("a", "1", H(0), H(0)), ("a", "2", H(30), H(30)), ("b", "1", H(50), H(50)), ("c", "1", H(50), None), (None, "1", H(0), H(0))])
    landed = land(src, str(tmp_path), "path", normal_digest("content_hash"), "seen_at", "loaded_at")
    t = IncrementalTarget(spark, str(tmp_path / "t"))
    assert t.process(landed, 1, H(1)) and t.process(landed, 2, H(31)) and t.process(landed, 3, H(60))
    assert changes(t) == [(1, "a"), (2, "a"), (3, "b")]
    plan = landed.where(F.col("day") >= F.to_date(F.lit(H(31))))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
