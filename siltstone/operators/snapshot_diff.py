"""Changes between consecutive full snapshots.

Each key is windowed by the index of its snapshot. Only neighbours matter: a
record without the same key one index earlier was added, one without the key
one index later was deleted, one whose hash differs from the lagged hash was
modified. Since only neighbours matter, a long run of snapshots is cut into
blocks of ``BLOCK`` indices that overlap by one on both sides, so no window
holds more than ``BLOCK + 2`` rows, however hot the key.

Snapshot indices come from a two-level rank (per day, plus the running count of
earlier days), so that one hot series is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators.paths import clean_path

BLOCK = 64


def number_snapshots(snaps: DataFrame, series: str, at: str, ident: str) -> DataFrame:
    """Add ``idx`` (1, 2, ... in order of ``at``) and ``next_id`` per series.

    ``snaps`` has one row per snapshot; columns other than the three named are
    kept. Ties in ``at`` are ordered by ``ident``. A null series or time gives
    no row.
    """
    s = snaps.where(F.col(series).isNotNull() & F.col(at).isNotNull()).withColumn("_day", F.date_trunc("DAY", F.col(at)))
    by_day = s.groupBy(series, "_day").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(F.col(ident), F.struct(at, ident)).alias("_first")
    )
    days = W.partitionBy(series).orderBy("_day")
    by_day = by_day.select(
        series,
        "_day",
        F.coalesce(F.sum("_n").over(days.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.lead("_first").over(days).alias("_next_first"),
    )
    in_day = W.partitionBy(series, "_day").orderBy(at, ident)
    s = s.withColumns({"_rn": F.row_number().over(in_day), "_lead": F.lead(ident).over(in_day)})
    return (
        s.join(by_day, [series, "_day"])
        .withColumn("idx", F.col("_before") + F.col("_rn"))
        .withColumn("next_id", F.coalesce("_lead", "_next_first"))
        .drop("_day", "_rn", "_lead", "_before", "_next_first")
    )


def diff_snapshots(records: DataFrame, series: str, key: str, digest: str, block: int = BLOCK) -> DataFrame:
    """Rows ``snapshot_id, key, change_type, old, new`` from numbered records.

    ``records`` has ``series, idx, snapshot_id, next_id, key, digest``, one row
    per key in a snapshot. A null digest is a value of its own.
    """
    b = F.floor((F.col("idx") - 1) / block)
    spread = F.array_distinct(F.array(F.floor((F.col("idx") - 2) / block), b, F.floor(F.col("idx") / block)))
    r = records.withColumn("_home", b).withColumn("_block", F.explode(spread))
    w = W.partitionBy(series, key, "_block").orderBy("idx")
    lag_idx, lag_dig, lead_idx = (F.lag("idx").over(w), F.lag(digest).over(w), F.lead("idx").over(w))
    r = r.withColumns({"_lag": lag_idx, "_old": lag_dig, "_lead": lead_idx}).where(F.col("_block") == F.col("_home"))
    follows = F.col("_lag").eqNullSafe(F.col("idx") - 1)
    changed = (
        F.when((F.col("idx") > 1) & ~follows, F.lit("ADDED"))
        .when(follows & ~F.col("_old").eqNullSafe(F.col(digest)), F.lit("MODIFIED"))
    )
    gone = F.when(~F.col("_lead").eqNullSafe(F.col("idx") + 1) & F.col("next_id").isNotNull(), F.lit("DELETED"))

    def row(kind: Column, at: str, old: Column, new: Column) -> Column:
        none = F.lit(None).cast(records.schema[digest].dataType)
        return F.when(
            kind.isNotNull(),
            F.struct(
                F.col(at).alias("snapshot_id"),
                kind.alias("change_type"),
                F.coalesce(old, none).alias("old_hash"),
                F.coalesce(new, none).alias("new_hash"),
            ),
        )

    null = F.lit(None)
    old = F.when(follows, F.col("_old"))
    out = F.array_compact(F.array(row(changed, "snapshot_id", old, F.col(digest)), row(gone, "next_id", F.col(digest), null)))
    return r.select(series, key, F.explode(out).alias("c")).select(series, key, "c.*")


def baseline_changes(skill_baseline: DataFrame, block: int = BLOCK) -> DataFrame:
    """Changes of delivered ``skill_baseline`` snapshots.

    Columns out: ``baseline_id, skill_name, file_path, change_type, old_hash,
    new_hash``. A delivery whose map is null or holds fewer entries than
    ``total_files`` failed and is left out; an empty map with ``total_files`` 0
    is a true empty snapshot. A null ``total_files`` counts as 0. Deliveries of
    one skill and scan_time are one snapshot, that of the smallest baseline_id.
    Keys that are equal after normalisation count once (the smallest digest).
    Columns beside those read are ignored; a row without skill_name or
    scan_time can't be placed and gives nothing. An empty table gives no rows.
    """
    src = skill_baseline.select("baseline_id", "skill_name", "scan_time", "total_files", "file_hashes")
    ok = src.where(
        F.col("file_hashes").isNotNull() & (F.size("file_hashes") >= F.coalesce(F.col("total_files"), F.lit(0)))
    )
    snaps = ok.groupBy("skill_name", "scan_time").agg(F.min("baseline_id").alias("baseline_id"))
    nums = number_snapshots(snaps, "skill_name", "scan_time", "baseline_id").select(
        F.col("baseline_id").alias("snapshot_id"), "idx", "next_id"
    )
    files = ok.select("baseline_id", "skill_name", F.explode("file_hashes").alias("k", "v")).select(
        F.col("baseline_id").alias("snapshot_id"),
        "skill_name",
        clean_path(F.col("k"), backslashes=True).alias("file_path"),
        # 32 raw bytes shuffle at half the size of the hex text
        F.coalesce(F.unhex(F.col("v.sha256")), F.encode(F.lower(F.col("v.sha256")), "UTF-8")).alias("sha"),
    )
    recs = files.join(nums, "snapshot_id")
    # a path that occurs in two spellings in one snapshot counts once
    w = W.partitionBy("skill_name", "file_path", "_b", "idx").orderBy(F.col("sha").asc_nulls_last())
    recs = (
        recs.withColumn("_b", F.floor((F.col("idx") - 1) / block))
        .withColumn("_rn", F.row_number().over(w))
        .where("_rn = 1")
        .drop("_rn", "_b")
    )
    d = diff_snapshots(recs, "skill_name", "file_path", "sha", block)
    text = lambda c: F.lower(F.hex(c))
    return d.select(
        F.col("snapshot_id").alias("baseline_id"),
        "skill_name",
        "file_path",
        "change_type",
        text("old_hash").alias("old_hash"),
        text("new_hash").alias("new_hash"),
    )
