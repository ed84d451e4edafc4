"""Problem 1: source files that do not parse, and their rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.arrow import map_rows
from siltstone.operators.paths import clean_path

EXTENSIONS = {"py": "python", "js": "javascript", "mjs": "javascript", "sh": "bash", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml"}


def language_of(path: Column, content: Column) -> Column:
    """The language that the path names; without an extension, that of the ``#!`` line; null for all others.

    A null or empty path has no extension.
    """
    base = F.element_at(F.split(F.coalesce(path, F.lit("")), r"[/\\]"), -1)
    ext = F.lower(F.regexp_extract(base, r"\.([^.]*)$", 1))
    by_ext = F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), ext)
    line = F.regexp_extract(content, r"^﻿?#!\s*([^\r\n]*)", 1)
    run = F.regexp_extract(line, r"^(?:\S*/env\s+(?:-\S+\s+|\w+=\S*\s+)*)?(?:\S*/)?(\w+)", 1)
    by_line = (
        F.when(run.rlike(r"^python(3|$)"), "python")
        .when(run.isin("node", "nodejs"), "javascript")
        .when(run.isin("bash", "sh"), "bash")
    )
    return F.when(base.contains("."), by_ext).otherwise(by_line)


def _parser():
    from siltstone.llm.syntax import first_error

    def one(file_id, language, content):
        e = first_error(language, content)
        if e:
            yield file_id, language, e[0], e[1]

    return one


def syntax_errors(skill_file: DataFrame) -> DataFrame:
    """``file_id, parsed_as, line_no, reason``: one row per file that is not valid in its language.

    Each file's whole token stream goes through the bundled grammar of its
    language, in the task that read it: no shuffle. Files of other kinds count as
    valid; null content counts as empty (only JSON must not be empty); a null
    path has no extension. Repeated rows are judged on their own.
    """
    src = skill_file.select("file_id", language_of(F.col("path"), F.col("content")).alias("language"), "content")
    return map_rows(src.where("language IS NOT NULL"), _parser, "file_id long, parsed_as string, line_no int, reason string")


def error_rates(skill_file: DataFrame) -> DataFrame:
    """``skill_name, language, n_files, n_invalid, rate`` over the files that have a language."""
    bad = syntax_errors(skill_file).select("file_id").withColumn("bad", F.lit(1))
    files = skill_file.select("file_id", "skill_name", language_of(F.col("path"), F.col("content")).alias("language")).where("language IS NOT NULL")
    return (
        files.join(bad, "file_id", "left")
        .groupBy("skill_name", "language")
        .agg(F.count(F.lit(1)).alias("n_files"), F.count("bad").alias("n_invalid"))
        .withColumn("rate", F.col("n_invalid") / F.col("n_files"))
    )


def analysed_before(skill_file: DataFrame, ast_finding: DataFrame) -> DataFrame:
    """Files that do not parse now though an earlier syntax-tree pass had findings in them."""
    bad = syntax_errors(skill_file)
    files = skill_file.select("file_id", "skill_name", clean_path(F.col("path"), True).alias("file_path"))
    old = ast_finding.groupBy("skill_name", clean_path(F.col("file_path"), True).alias("file_path")).agg(F.count(F.lit(1)).alias("n_findings"))
    return bad.join(files, "file_id").join(old, ["skill_name", "file_path"]).select("file_id", "skill_name", "file_path", "line_no", "n_findings")
