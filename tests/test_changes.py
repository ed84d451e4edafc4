"""Snapshot changes and incremental runs on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siltstone.operators.incremental import VERSION, IncrementalRun, last_success, listing, unseen_versions
from siltstone.operators.snapshot_diff import baseline_changes

SCHEMA = "baseline_id long, skill_name string, scan_time timestamp, total_files int, file_hashes map<string, struct<path string, sha256 string, size long>>, extra string"


def day(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def snap(i, skill, n, files, total=None):
    m = None if files is None else {k: (k, v, 1) for k, v in files.items()}
    return i, skill, day(n), len(files or {}) if total is None else total, m, "x"


def changes(spark, rows, **kw):
    d = baseline_changes(spark.createDataFrame(rows, SCHEMA), **kw)
    return {(r.baseline_id, r.file_path, r.change_type) for r in d.collect()}


def test_changes_and_dirt(spark):
    rows = [
        snap(1, "a", 0, {"x": "AA", "./y": "bb", "d\\z": "cc"}),
        snap(2, "a", 0, {"x": "AA", "./y": "bb", "d\\z": "cc"}),  # delivered again
        snap(3, "a", 1, None, 5),  # failed
        snap(4, "a", 2, {"x": "aa"}, 3),  # too few
        snap(5, "a", 3, {"x": "aa", "y": "dd", "w": "ee"}),
        snap(6, "a", 4, {}),  # truly empty
        snap(7, "a", 5, {"x": "aa"}),
        snap(8, None, 5, {"x": "aa"}),
    ]
    assert changes(spark, rows) == {
        (5, "y", "MODIFIED"), (5, "w", "ADDED"), (5, "d/z", "DELETED"),
        (6, "x", "DELETED"), (6, "y", "DELETED"), (6, "w", "DELETED"), (7, "x", "ADDED"),
    }


def test_empty_table(spark):
    assert changes(spark, []) == set()


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_blocks_change_nothing(spark, block):
    """A long series against a plain comparison of neighbours."""
    import random

    rnd = random.Random(5)
    snaps, rows = [], []
    for n in range(40):
        f = {k: rnd.choice("abc") * 4 for k in "pqrs" if rnd.random() < 0.6}
        snaps.append(f)
        rows.append(snap(n + 1, "hot", n, f))
    want = set()
    for n in range(1, 40):
        a, b = snaps[n - 1], snaps[n]
        want |= {(n + 1, k, "ADDED") for k in b.keys() - a.keys()} | {(n + 1, k, "DELETED") for k in a.keys() - b.keys()}
        want |= {(n + 1, k, "MODIFIED") for k in a.keys() & b.keys() if a[k] != b[k]}
    assert changes(spark, rows, block=block) == want


HASH = "record_id long, skill_path string, path string, sha256 string, size long, delivered_at timestamp"
CACHE = "skill_path string, result string, scan_time double, entry_timestamp double"


def test_unseen_versions(spark):
    t0 = day(10).replace(tzinfo=dt.timezone.utc).timestamp()
    fh = spark.createDataFrame(
        [
            (1, "/s/a", "x", "AA", 1, day(1)), (2, "/s/a", "./x", "aa", 1, day(20)), (3, "/s/a", "x", "bb", 1, day(20)), (4, "/s/a", "x", "BB", 1, day(21)),
            (5, "/s/b", "x", "aa", None, day(1)), (6, "/s/c/", "x", "aa", 1, day(1)), (7, "/s/a", None, None, 1, None),
        ], HASH,
    )
    ce = spark.createDataFrame(
        [("/s/a/", '{"status": "ok"}', 5.0, t0), ("/s/b", '{"status": "ok"', 5.0, t0), ("/s/b", '{"status": "failed"}', 1.0, t0), ("/s/c", None, 1.0, t0)], CACHE
    )
    assert sorted(r.record_id for r in unseen_versions(fh, ce).collect()) == [3, 5, 6, 7]
    none = spark.createDataFrame([], CACHE)
    assert unseen_versions(fh, none).count() == 5
    assert unseen_versions(spark.createDataFrame([], HASH), ce).count() == 0
    assert last_success(ce).count() == 1


def test_incremental_survives_failure(spark, tmp_path):
    base = spark.createDataFrame([(i, "/s", f"f{i}", "a", 1, day(1)) for i in range(10)], HASH)
    inc = IncrementalRun(spark, str(tmp_path / "state"), VERSION)
    inc.run(listing(base.where("record_id < 4")), lambda d: d)

    def broken(d):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        inc.run(listing(base), broken)
    assert inc.results().count() == 4
    inc.run(listing(base), lambda d: d.withColumn("y", F.lit(1)))
    inc.run(listing(base), lambda d: d)
    assert inc.committed() == [1, 2, 3]
    assert sorted(r.path for r in inc.manifest().collect()) == sorted(f"f{i}" for i in range(10))


def test_of_two_runs_for_a_batch_one_wins(spark, tmp_path):
    base = spark.createDataFrame([(i, "/s", f"f{i}", "a", 1, day(1)) for i in range(6)], HASH)
    root = str(tmp_path / "state")
    inc = IncrementalRun(spark, root, VERSION)

    def slow(d):
        # while it works, another run takes the same batch
        IncrementalRun(spark, root, VERSION).run(listing(base), lambda x: x.withColumn("by", F.lit("other")))
        return d.withColumn("by", F.lit("slow"))

    with pytest.raises(RuntimeError):
        inc.run(listing(base), slow)
    assert inc.committed() == [1]
    assert {r["by"] for r in inc.results().collect()} == {"other"} and inc.results().count() == 6
    # a run that died while it committed leaves an empty file
    (tmp_path / "state" / "commits" / "2.json").write_text("")
    inc.GRACE = 0
    more = spark.createDataFrame([(i, "/s", f"f{i}", "a", 1, day(1)) for i in range(9)], HASH)
    assert inc.run(listing(more), lambda d: d.withColumn("by", F.lit("next"))) == 2 and inc.results().count() == 9


def test_compacted_manifest(spark, tmp_path):
    inc = IncrementalRun(spark, str(tmp_path / "state"), VERSION)
    for n in (2, 4, 6):
        inc.run(listing(spark.createDataFrame([(i, "/s", f"f{i}", "a", 1, day(1)) for i in range(n)], HASH)), lambda d: d)
    assert inc.compact() == 3 and inc.compact() == 3
    assert inc.manifest().count() == 6 and len(inc.manifest().inputFiles()) <= 8
    inc.run(listing(spark.createDataFrame([(i, "/s", f"f{i}", "a", 1, day(1)) for i in range(7)], HASH)), lambda d: d)
    assert inc.manifest().count() == 7 and inc.results().count() == 7
