"""Queries of the llm problems, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import containers, credentials, handwritten, invalid_source, language, leakage
from siltstone.sources.tables import spread
from siltstone.sources.tables import table as _table


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    t = _table(spark, d, name)
    return spread(t) if name in ("skill_file", "finding", "documents") else t


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return invalid_source.syntax_errors(table(spark, d, "skill_file")).select("file_id")


def p1_errors(spark: SparkSession, d: str) -> DataFrame:
    return invalid_source.syntax_errors(table(spark, d, "skill_file"))


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return invalid_source.error_rates(table(spark, d, "skill_file"))


def p1_analysed_before(spark: SparkSession, d: str) -> DataFrame:
    return invalid_source.analysed_before(table(spark, d, "skill_file"), table(spark, d, "ast_finding"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    c = credentials.credentials(table(spark, d, "skill_file"), table(spark, d, "finding"))
    return c.select("origin", "row_id", "line_no")


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redacted(table(spark, d, "skill_file"), table(spark, d, "finding"))


def p2_by_rule(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "finding")
    return credentials.by_rule(f, credentials.credentials(table(spark, d, "skill_file"), f))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.machine_made(table(spark, d, "skill_file")).select("file_id")


def p4_kinds(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "skill_file")
    return handwritten.kinds_by_language(f, handwritten.machine_made(f))


def p4_evidence(spark: SparkSession, d: str) -> DataFrame:
    m = handwritten.machine_made(table(spark, d, "skill_file"))
    return m.groupBy("kind", "evidence").agg(F.count(F.lit(1)).alias("n_files"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return containers.fill(table(spark, d, "documents"), table(spark, d, "container_profile"))


def p6_usage(spark: SparkSession, d: str) -> DataFrame:
    profiles = table(spark, d, "container_profile")
    return containers.usage(containers.fill(table(spark, d, "documents"), profiles), profiles)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "bench_item")).select("doc_id", "item_id")


def p7_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(leakage.leaks(table(spark, d, "documents"), table(spark, d, "bench_item")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return language.languages(table(spark, d, "documents"), table(spark, d, "lang_code")).where("NOT as_labelled").select("doc_id", "lang_code")


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    return language.languages(table(spark, d, "documents"), table(spark, d, "lang_code"))


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.language_segments(table(spark, d, "documents"), table(spark, d, "lang_code"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_errors, p1_rates, p1_analysed_before,
        p2_found, p2_redacted, p2_by_rule,
        p4_found, p4_kinds, p4_evidence,
        p6_containers, p6_usage,
        p7_found, p7_leaked_items,
        p8_found, p8_languages, p8_segments,
    )
}
SQL: dict[str, str] = {}
