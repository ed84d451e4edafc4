"""Queries p3_ and p5_ with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.incremental import VERSION, IncrementalRun, last_success, listing, unseen_versions
from siltstone.operators.snapshot_diff import baseline_changes
from siltstone.session import scratch
from siltstone.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return baseline_changes(table(spark, d, "skill_baseline")).select("baseline_id", "file_path", "change_type")


def p3_change_counts(spark: SparkSession, d: str) -> DataFrame:
    c = baseline_changes(table(spark, d, "skill_baseline"))
    return c.groupBy("skill_name", "change_type").agg(F.count(F.lit(1)).alias("n_changes"))


def p3_report_check(spark: SparkSession, d: str) -> DataFrame:
    """How the older tool's change_record agrees: per type, true changes and those it reported."""
    c = baseline_changes(table(spark, d, "skill_baseline")).select(
        "skill_name", "file_path", "change_type", F.coalesce("old_hash", F.lit("")).alias("o"), F.coalesce("new_hash", F.lit("")).alias("n")
    )
    r = (
        table(spark, d, "change_record")
        .select(
            "skill_name",
            "file_path",
            "change_type",
            F.lower(F.coalesce("old_hash", F.lit(""))).alias("o"),
            F.lower(F.coalesce("new_hash", F.lit(""))).alias("n"),
        )
        .distinct()
        .withColumn("hit", F.lit(1))
    )
    return (
        c.join(r, ["skill_name", "file_path", "change_type", "o", "n"], "left")
        .groupBy("change_type")
        .agg(F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_reported"))
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return unseen_versions(table(spark, d, "file_hash"), table(spark, d, "cache_entry")).select("record_id")


def p5_pending_by_skill(spark: SparkSession, d: str) -> DataFrame:
    u = unseen_versions(table(spark, d, "file_hash"), table(spark, d, "cache_entry"))
    return u.groupBy("skill_path").agg(F.count(F.lit(1)).alias("n_pending"), F.sum("size").alias("bytes_pending"))


def p5_incremental_run(spark: SparkSession, d: str) -> DataFrame:
    """Two committed batches through the manifest: what runs have seen, then the rest."""
    fh, ce = table(spark, d, "file_hash"), table(spark, d, "cache_entry")
    runs = last_success(ce)
    versions = listing(fh)
    first = versions.join(runs, "skill_path").where(F.col("arrived") < F.col("started")).select(versions.columns)
    inc = IncrementalRun(spark, scratch(spark, "incremental"), VERSION)
    inc.run(first, lambda x: x)
    inc.run(versions, lambda x: x)
    return inc.results().groupBy("batch").agg(
        F.count(F.lit(1)).alias("n_versions"), F.countDistinct("skill_path").alias("n_skills")
    ).select(F.col("batch").cast("int").alias("batch"), "n_versions", "n_skills")


QUERIES = {f.__name__: f for f in (p3_found, p3_change_counts, p3_report_check, p5_found, p5_pending_by_skill, p5_incremental_run)}

_P3 = r"""
WITH ok AS (
  SELECT baseline_id, skill_name, scan_time, file_hashes FROM skill_baseline
  WHERE file_hashes IS NOT NULL AND cardinality(file_hashes) >= coalesce(total_files, 0)
    AND skill_name IS NOT NULL AND scan_time IS NOT NULL),
snaps AS (
  SELECT skill_name, scan_time, min(baseline_id) AS baseline_id FROM ok GROUP BY 1, 2),
num AS (
  SELECT *, row_number() OVER (PARTITION BY skill_name ORDER BY scan_time) AS idx,
    lead(baseline_id) OVER (PARTITION BY skill_name ORDER BY scan_time) AS next_id FROM snaps),
raw AS (
  SELECT n.baseline_id, n.skill_name, n.idx, n.next_id, unnest(map_entries(o.file_hashes)) AS e
  FROM ok o JOIN num n USING (baseline_id)),
files AS (
  SELECT baseline_id, skill_name, idx, next_id,
    regexp_replace(regexp_replace(replace(e.key, '\', '/'), '^(\./+)+', ''), '/(\./+)+', '/', 'g') AS file_path,
    min(lower(e.value.sha256)) AS sha
  FROM raw GROUP BY ALL),
changes AS (
  SELECT b.baseline_id, b.skill_name, b.file_path,
    CASE WHEN a.idx IS NULL THEN 'ADDED' ELSE 'MODIFIED' END AS change_type, a.sha AS old_hash, b.sha AS new_hash
  FROM files b LEFT JOIN files a ON a.skill_name = b.skill_name AND a.file_path = b.file_path AND a.idx = b.idx - 1
  WHERE b.idx > 1 AND (a.idx IS NULL OR a.sha IS DISTINCT FROM b.sha)
  UNION ALL
  SELECT a.next_id, a.skill_name, a.file_path, 'DELETED', a.sha, NULL
  FROM files a LEFT JOIN files b ON a.skill_name = b.skill_name AND a.file_path = b.file_path AND b.idx = a.idx + 1
  WHERE a.next_id IS NOT NULL AND b.idx IS NULL)
"""

_P5 = r"""
WITH runs AS (
  SELECT regexp_replace(skill_path, '/+$', '') AS skill_path,
    max(round((entry_timestamp - coalesce(scan_time, 0)) * 1e6)::BIGINT) AS started
  FROM cache_entry WHERE CASE WHEN json_valid(result) THEN json_extract_string(result, '$.status') END = 'ok' GROUP BY 1),
versions AS (
  SELECT regexp_replace(skill_path, '/+$', '') AS skill_path,
    regexp_replace(regexp_replace(path, '^(\./+)+', ''), '/(\./+)+', '/', 'g') AS path, lower(sha256) AS sha256,
    min(record_id) AS record_id, min(epoch_us(delivered_at)) AS arrived, max(size) AS size
  FROM file_hash GROUP BY 1, 2, 3),
unseen AS (
  SELECT v.* FROM versions v LEFT JOIN runs r USING (skill_path)
  WHERE NOT coalesce(v.arrived < r.started, false))
"""

SQL = {
    "p3_found": _P3 + "SELECT baseline_id, file_path, change_type FROM changes",
    "p3_change_counts": _P3 + "SELECT skill_name, change_type, count(*) AS n_changes FROM changes GROUP BY 1, 2",
    "p3_report_check": _P3
    + """, r AS (SELECT DISTINCT skill_name, file_path, change_type, lower(coalesce(old_hash, '')) AS o, lower(coalesce(new_hash, '')) AS n FROM change_record)
SELECT c.change_type, count(*) AS n_true, count(r.o) AS n_reported FROM changes c
LEFT JOIN r ON r.skill_name = c.skill_name AND r.file_path = c.file_path AND r.change_type = c.change_type
 AND r.o = coalesce(c.old_hash, '') AND r.n = coalesce(c.new_hash, '') GROUP BY 1""",
    "p5_found": _P5 + "SELECT record_id FROM unseen",
    "p5_pending_by_skill": _P5
    + "SELECT skill_path, count(*) AS n_pending, sum(size)::BIGINT AS bytes_pending FROM unseen GROUP BY 1",
    "p5_incremental_run": _P5
    + """SELECT CASE WHEN u.record_id IS NULL THEN 1 ELSE 2 END AS batch, count(*) AS n_versions, count(DISTINCT v.skill_path) AS n_skills
FROM versions v LEFT JOIN unseen u USING (record_id) GROUP BY 1""",
}
