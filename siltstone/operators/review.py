"""Review operators: JSON and findings out of prose, negative examples, batches, merged verdicts, look-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import lines
from siltstone.operators.line_rules import severity_rank
from siltstone.operators.paths import clean_path
from siltstone.operators.scoring import NEGATIVE, severity

# Category -> words that name it in prose.
CATEGORY_WORDS = {
    "malicious_code": ["malicious", "eval", "exec", "backdoor"],
    "data_exfiltration": ["exfil", "upload", "leak"],
    "credential_theft": ["credential", "password", "token", "secret"],
    "prompt_injection": ["prompt injection", "ignore previous", "jailbreak"],
    "network_risk": ["network", "http", "socket"],
}
RECOMMENDATIONS = {
    "en": {"CRITICAL": "Do not install.", "HIGH": "Review before use.", "MEDIUM": "Use with care.", "LOW": "No action needed."},
    "zh": {"CRITICAL": "请勿安装。", "HIGH": "使用前请审核。", "MEDIUM": "谨慎使用。"},
}
LANGUAGE_ALIASES = {"zh": "zh", "cn": "zh", "chinese": "zh", "en": "en", "english": "en"}


def json_in(text: Column) -> Column:
    """JSON of a text as a variant: the text itself, else its first fenced block, else its widest braces or brackets; null if none parses."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    brackets = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    return F.coalesce(*[F.try_parse_json(F.nullif(F.trim(x), F.lit(""))) for x in (text, fenced, braces, brackets)])


def commented_json(text: Column, schema: str) -> Column:
    """JSON with comments."""
    return F.from_json(text, schema, {"allowComments": "true"})


def answer_findings(v: Column) -> Column:
    """Findings of an answer in any of its three shapes, as an array of variants."""
    get = lambda k: F.try_variant_get(v, f"$.{k}", "array<variant>")
    return F.coalesce(get("findings"), get("risks"), get("vulnerabilities"), F.try_variant_get(v, "$", "array<variant>"))


def prose_findings(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, category, severity``: the highest severity that a paragraph names for a category; paragraphs without a severity are INFO."""
    p = df.select(key, F.explode(F.split(text, r"\n{2,}")).alias("p")).withColumn("l", F.lower("p"))
    sev = F.upper(F.regexp_extract("l", r"\b(critical|high|medium|low)\b", 1))
    cats = F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [F.contains("l", F.lit(w)) for w in ws]), F.lit(c)) for c, ws in CATEGORY_WORDS.items()]))
    x = p.select(key, F.explode(cats).alias("category"), severity(F.when(sev != "", sev)).alias("severity"))
    return x.groupBy(key, "category").agg(F.max_by("severity", severity_rank(F.col("severity"))).alias("severity"))


def reasoning_leak(title: Column, text: Column, evidence: Column) -> Column:
    """Long text that thinks aloud and shows no evidence, or a title that only names a step."""
    return ((F.length(text) > 500) & text.rlike(r"(?i)let me|i need to|step by step|first, i") & (F.coalesce(evidence, F.lit("")) == "")) | title.rlike(r"(?i)^(?:step|phase|stage)\s*\d")


def negative_examples(finding: DataFrame, skill_file: DataFrame, around: int = 10) -> DataFrame:
    """``finding_id, is_negative``: whether the lines around a finding warn against what they show. Of repeated files the first counts."""
    f = finding.where("line_number IS NOT NULL AND file_path IS NOT NULL").select("finding_id", "skill_name", clean_path(F.col("file_path"), True).alias("path"), "line_number")
    # only the numbers of the lines that warn leave the scan, never a text
    warns = F.filter(F.transform(lines(F.col("content")), lambda x, i: F.when(x.rlike(NEGATIVE), i + 1)), lambda n: n.isNotNull())
    s = skill_file.select("skill_name", "path", "file_id", warns.alias("warns")).groupBy("skill_name", "path").agg(F.min_by("warns", "file_id").alias("warns"))
    n = F.col("line_number")
    return f.join(s, ["skill_name", "path"]).select("finding_id", F.exists("warns", lambda w: w.between(n - around, n + around)).alias("is_negative"))


RANGE = 100_000  # ids that are ordered together


def batches(f: DataFrame, threshold: str = "MEDIUM", size: int = 20) -> DataFrame:
    """``finding_id, batch_no``: findings of at least a severity, numbered per file and cut into batches of ``size``."""
    g = f.where(severity_rank(F.col("severity")) >= severity_rank(F.lit(threshold))).select("finding_id", "pkg_id", "file_path", F.floor(F.col("finding_id") / RANGE).alias("_b"))
    # findings without a path may be a third of all: they are ordered within ranges of ids, and the ranges' counts are added up
    key = ["pkg_id", "file_path"]
    ranges = g.groupBy(*key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    ranges = ranges.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("_b").alias("_r"), F.coalesce(F.sum("_n").over(W.partitionBy(*key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    on = (F.col("_b") == F.col("_r")) & reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
    n = F.row_number().over(W.partitionBy(*key, "_b").orderBy("finding_id")) + F.col("_before")
    return g.join(ranges, on).select("finding_id", *key, F.floor((n - 1) / size).cast("int").alias("batch_no"))


def merge(f: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings without those judged false positives above 0.8; a judged severity replaces the old one."""
    v = verdicts.select("finding_id", "verdict", "verdict_confidence", "true_severity")
    j = f.join(v, "finding_id", "left")
    j = j.where(~F.coalesce((F.col("verdict") == "FP") & (F.col("verdict_confidence") > 0.8), F.lit(False)))
    return j.withColumn("severity", F.coalesce(F.when(F.col("verdict") == "TP", F.col("true_severity")), "severity")).drop("true_severity")


def normal_language(c: Column) -> Column:
    base = F.lower(F.element_at(F.split(F.trim(c), r"[-_.]"), 1))
    return F.coalesce(*[F.when(base == k, v) for k, v in LANGUAGE_ALIASES.items()], F.lit("en"))


def recommendation(lang: Column, sev: Column) -> Column:
    """Text by language and severity; English where the language has none, else the severity itself."""
    table = {k: F.create_map(*[F.lit(x) for kv in v.items() for x in kv]) for k, v in RECOMMENDATIONS.items()}
    return F.coalesce(*[F.when(lang == k, F.try_element_at(m, sev)) for k, m in table.items()], F.try_element_at(table["en"], sev), sev)


def answers(responses: DataFrame, batches_: DataFrame) -> DataFrame:
    """``finding_id, verdict, verdict_confidence, true_severity, reasoning``: a reviewer's array of answers paired with its batch by position.

    ``responses`` has the batch's key (``pkg_id, file_path, batch_no``) and ``text``:
    a JSON array, bare or in a fenced block. ``batches_`` is what ``batches`` gives.
    Findings without an answer are UNCERTAIN at 0.5; answers beyond the batch and
    texts that hold no array count for nothing.
    """
    key = ["pkg_id", "file_path", "batch_no"]
    n = F.row_number().over(W.partitionBy(*key).orderBy("finding_id")) - 1
    ordered = batches_.withColumn("at", n)
    items = F.try_variant_get(json_in(F.col("text")), "$", "array<variant>")
    r = responses.select(*key, F.posexplode(items).alias("at", "v"))
    get = lambda k, t="string": F.try_variant_get("v", f"$.{k}", t)
    r = r.select(*key, "at", F.coalesce(get("verdict"), F.lit("HUMAN_REVIEW")).alias("verdict"), F.coalesce(get("confidence", "double"), F.lit(0.5)).alias("verdict_confidence"), get("true_severity").alias("true_severity"), get("reasoning").alias("reasoning"))
    on = reduce(lambda a, b: a & b, [F.col(f"o.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*key, "at"]])
    j = ordered.alias("o").join(r.alias("r"), on, "left")
    return j.select("finding_id", F.coalesce("r.verdict", F.lit("UNCERTAIN")).alias("verdict"), F.coalesce("r.verdict_confidence", F.lit(0.5)).alias("verdict_confidence"), "r.true_severity", "r.reasoning")


def paired(results: DataFrame, f: DataFrame) -> DataFrame:
    """``result_id, finding_id``: the first finding of the package whose rule starts with a result's ``answer_id`` or whose title holds it; null if none does.

    Results and findings meet within a package; a package's rules and titles are
    made distinct first, so equal ones are compared once.
    """
    d = f.groupBy("pkg_id", "rule_id", "title").agg(F.min("finding_id").alias("finding_id"))
    r = results.select("result_id", F.col("pkg_id").alias("_p"), "answer_id")
    hit = (F.col("_p") == F.col("pkg_id")) & (F.col("rule_id").startswith(F.col("answer_id")) | F.contains("title", F.col("answer_id")))
    return r.join(d, hit, "left").groupBy("result_id").agg(F.min("finding_id").alias("finding_id"))


def review_statistics(reviews: DataFrame) -> DataFrame:
    """``n, n_tp, n_fp, n_human, sure_fp, sure_tp, fp_rate`` (sure ones above 0.8; the rate in per cent to one place): one row."""
    sure = lambda v: F.count_if((F.col("verdict") == v) & (F.col("verdict_confidence") > 0.8))
    n = F.count(F.lit(1))
    c = lambda v: F.count_if(F.col("verdict") == v)
    return reviews.agg(n.alias("n"), c("TP").alias("n_tp"), c("FP").alias("n_fp"), c("HUMAN_REVIEW").alias("n_human"), sure("FP").alias("sure_fp"), sure("TP").alias("sure_tp"), F.round(100.0 * sure("FP") / F.greatest(n, F.lit(1)), 1).alias("fp_rate"))


def code_context(text: Column, line_number: Column, around: int = 15) -> Column:
    """Numbered lines around a finding, its own marked with ``>>>``."""
    ls = lines(text)
    first = F.greatest(F.lit(1), line_number - around)
    part = F.slice(ls, first, F.greatest(F.lit(0), F.least(F.size(ls), line_number + around) - first + 1))
    return F.array_join(F.transform(part, lambda x, i: F.concat(F.when(first + i == line_number, ">>> ").otherwise("    "), (first + i).cast("string"), F.lit(": "), x)), "\n")
