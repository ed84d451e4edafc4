"""Problem 2 over tables: locate and redact credentials in files and finding snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.arrow import map_rows, ship_file
from siltstone.llm.secrets import VOCABULARY


def _texts(skill_file: DataFrame, finding: DataFrame) -> DataFrame:
    a = skill_file.select(F.lit("skill_file").alias("origin"), F.col("file_id").alias("row_id"), F.col("content").alias("text"))
    b = finding.select(F.lit("finding").alias("origin"), F.col("finding_id").alias("row_id"), F.col("snippet").alias("text"))
    return a.unionByName(b).where("text IS NOT NULL")


def _finder():
    from siltstone.llm.secrets import find

    def one(origin, row_id, text):
        seen = set()
        for line, spans, kind in find(text):
            if line not in seen:
                seen.add(line)
                yield origin, row_id, line, kind, len(spans)

    return one


def _redactor():
    from siltstone.llm.secrets import redact

    def one(origin, row_id, text):
        out, n = redact(text)
        if n:
            yield origin, row_id, n, out

    return one


def credentials(skill_file: DataFrame, finding: DataFrame) -> DataFrame:
    """``origin, row_id, line_no, kind, n_pieces``: one row per line on which a credential begins.

    Every row is judged on its own in the task that read it: no shuffle. Null
    and empty texts hold nothing; repeated rows count each; the tables' other
    columns don't matter.
    """
    ship_file(skill_file.sparkSession, VOCABULARY)
    return map_rows(_texts(skill_file, finding), _finder, "origin string, row_id long, line_no int, kind string, n_pieces int")


def redacted(skill_file: DataFrame, finding: DataFrame) -> DataFrame:
    """``origin, row_id, n_credentials, redacted`` of the texts that hold any."""
    ship_file(skill_file.sparkSession, VOCABULARY)
    return map_rows(_texts(skill_file, finding), _redactor, "origin string, row_id long, n_credentials int, redacted string")


def by_rule(finding: DataFrame, found: DataFrame) -> DataFrame:
    """What the old scanner's rule ids were worth: findings and those with a credential, per rule."""
    hits = found.where("origin = 'finding'").select(F.col("row_id").alias("finding_id")).distinct().withColumn("hit", F.lit(1))
    return (
        finding.select("finding_id", "rule_id")
        .join(hits, "finding_id", "left")
        .groupBy("rule_id")
        .agg(F.count(F.lit(1)).alias("n_findings"), F.count("hit").alias("n_with_credential"))
    )
