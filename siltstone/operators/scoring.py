"""Correlation, scores, roll-ups, review and reports over findings tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.line_rules import severity_rank
from siltstone.operators.paths import clean_path
from siltstone.rules import packs
from siltstone.rules.fold import JAVA, any_of


def severity(c: Column) -> Column:
    """One of the six severities; other spellings are trimmed and upper-cased, unknown ones are INFO."""
    up = F.upper(F.trim(c))
    up = F.when(up.isin("CRIT"), "CRITICAL").when(up.isin("MED", "MODERATE", "WARNING"), "MEDIUM").when(up.isin("INFORMATIONAL", "NOTE"), "INFO").otherwise(up)
    return F.when(up.isin(*packs.SEVERITY), up).otherwise("INFO")


def findings(finding: DataFrame) -> DataFrame:
    """A finding table with clean severity, category and path, each repeated row once (the smallest id)."""
    f = finding.select(
        "finding_id",
        "rule_id",
        severity(F.col("severity")).alias("severity"),
        F.coalesce(F.lower(F.trim("category")), F.lit("other")).alias("category"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.col("skill_name").alias("pkg_id"),
        clean_path(F.col("file_path"), True).alias("file_path"),
        "line_number",
        F.coalesce("analyzer", F.lit("")).alias("source"),
    )
    key = ["rule_id", "severity", "category", "title", "description", "pkg_id", "file_path", "line_number", "source"]
    return f.groupBy(*key).agg(F.min("finding_id").alias("finding_id"))


def features(f: DataFrame) -> DataFrame:
    """``pkg_id, features``: what categories and texts of a package's findings speak of (a bounded set)."""
    text = F.lower(F.concat("description", "title"))
    parts = [F.when(F.contains("category", F.lit(k)), F.lit(v)) for k, v in packs.FEATURE_OF_CATEGORY]
    parts += [F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in ws]), F.lit(v)) for v, ws in packs.FEATURE_OF_TEXT]
    return f.select("pkg_id", F.explode(F.array_compact(F.array(*parts))).alias("x")).groupBy("pkg_id").agg(F.array_sort(F.collect_set("x")).alias("features"))


def feature_flags(ok: Column) -> dict[str, Column]:
    """``f_<feature>`` for the features that chains require: whether any finding that is ``ok`` speaks of it; aggregates for one pass over findings."""
    text = F.lower(F.concat("description", "title"))
    by: dict[str, list[Column]] = {}
    for k, v in packs.FEATURE_OF_CATEGORY:
        by.setdefault(v, []).append(F.contains("category", F.lit(k)))
    for v, ws in packs.FEATURE_OF_TEXT:
        by.setdefault(v, []).extend(F.contains(text, F.lit(w)) for w in ws)
    needed = dict.fromkeys(x for _, _, need, _ in packs.CHAINS for x in need)
    return {f"f_{x}": F.bool_or(ok & reduce(lambda a, b: a | b, by.get(x, [F.lit(False)]))) for x in needed}


def chains(f: DataFrame) -> DataFrame:
    """``pkg_id, chain, severity, n_optional``: attack chains whose required features a package has (relational division)."""
    c = F.array(*[F.struct(F.lit(n).alias("chain"), F.lit(s).alias("severity"), F.array(*[F.lit(x) for x in r]).alias("required"), F.array(*[F.lit(x) for x in o]).alias("optional")) for n, s, r, o in packs.CHAINS])
    j = features(f).select("pkg_id", "features", F.explode(c).alias("c"))
    return j.where(F.size(F.array_except("c.required", "features")) == 0).select("pkg_id", "c.chain", "c.severity", F.size(F.array_intersect("c.optional", "features")).alias("n_optional"))


def multi_engine(f: DataFrame) -> DataFrame:
    """Files with two findings or more from at least three sources: their highest severity."""
    g = f.where("file_path IS NOT NULL").groupBy("pkg_id", "file_path").agg(
        F.count(F.lit(1)).alias("n_findings"), F.countDistinct("source").alias("n_sources"), F.max_by("severity", severity_rank(F.col("severity"))).alias("severity")
    )
    return g.where("n_findings >= 2 AND n_sources >= 3")


def correlation_score(f: DataFrame) -> DataFrame:
    """25, 15 or 10 a chain by its severity and 5 a correlated file, at most 100."""
    w = F.when(F.col("severity") == "CRITICAL", 25).when(F.col("severity") == "HIGH", 15).otherwise(10)
    a = chains(f).select("pkg_id", w.alias("s")).unionByName(multi_engine(f).select("pkg_id", F.lit(5).alias("s")))
    return a.groupBy("pkg_id").agg(F.least(F.lit(100), F.sum("s")).cast("int").alias("score"))


def weight(sev: Column, table: dict[str, int], other: int) -> Column:
    return F.coalesce(*[F.when(sev == k, v) for k, v in table.items()], F.lit(other))


PROFILES = {"main": (packs.WEIGHT_MAIN, 5), "light": (packs.WEIGHT_LIGHT, 1)}


def level(score: Column) -> Column:
    out = F.lit("LOW")
    for least, name in reversed(packs.LEVELS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def scores(f: DataFrame, profile: str = "main") -> DataFrame:
    """One row a package: score (at most 100), level, counts; ranked by score, criticals and highs."""
    table, other = PROFILES[profile]
    n = lambda s: F.count_if(F.col("severity") == s)
    g = f.groupBy("pkg_id").agg(
        F.least(F.lit(100), F.sum(weight(F.col("severity"), table, other))).cast("int").alias("score"),
        F.count(F.lit(1)).alias("n_findings"),
        n("CRITICAL").alias("n_critical"),
        n("HIGH").alias("n_high"),
    )
    return g.withColumn("level", level(F.col("score")))


def weighted_scores(f: DataFrame) -> DataFrame:
    """(severity weights + 5 a finding) times the context's factors, truncated, at most 100; below 5 SAFE."""
    has = lambda k: F.bool_or(F.contains("category", F.lit(k)))
    g = f.groupBy("pkg_id").agg(F.sum(weight(F.col("severity"), packs.WEIGHT_MAIN, 5) + 5).alias("base"), has("hook").alias("h"), has("network").alias("n"), has("credential").alias("c"))
    factor = F.when(F.col("h"), 1.5).otherwise(1.0) * F.when(F.col("n"), 1.2).otherwise(1.0) * F.when(F.col("c"), 1.3).otherwise(1.0)
    g = g.withColumn("score", F.least(F.lit(100), F.floor(F.col("base") * factor + 1e-9)).cast("int"))
    return g.select("pkg_id", "score", F.when(F.col("score") < 5, "SAFE").otherwise(level(F.col("score"))).alias("level"))


def rollups(f: DataFrame) -> DataFrame:
    """Counts by severity, by category and by source in one pass (grouping sets)."""
    x = F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).alias("value")) for k in ("severity", "category", "source")])
    return f.select("pkg_id", F.explode(x).alias("x")).groupBy("pkg_id", "x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"))


def report_groups(f: DataFrame) -> DataFrame:
    """Findings merged by rule and severity: how many, the description without line numbers, the first five places."""
    loc = F.concat_ws(":", F.coalesce("file_path", F.lit("?")), F.coalesce(F.col("line_number").cast("string"), F.lit("?")))
    d = f.select("rule_id", "severity", F.regexp_replace("description", r":\d+", "").alias("description"), loc.alias("loc"), "finding_id")
    head = d.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.min_by("description", "finding_id").alias("description"))
    by_loc = d.groupBy("rule_id", "severity", "loc").agg(F.min("finding_id").alias("k"))
    from pyspark.sql import Window as W

    top = by_loc.withColumn("rn", F.row_number().over(W.partitionBy("rule_id", "severity").orderBy("k"))).where("rn <= 5")
    top = top.groupBy("rule_id", "severity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "loc"))), lambda x: x["loc"]), "|").alias("places"))
    return head.join(top, ["rule_id", "severity"])


# Technique, least number of keywords, keywords.
TECHNIQUES = [
    ("remote_code_execution", 2, ["exec", "eval", "shell", "command", "subprocess"]),
    ("credential_access", 2, ["credential", "password", "token", "secret", "key"]),
    ("social_engineering", 3, ["urgent", "disable", "paste", "verify", "install"]),
    ("exfiltration", 2, ["upload", "exfil", "send", "http", "webhook"]),
    ("persistence", 1, ["cron", "startup", "persist", "bashrc"]),
    ("threat_intel", 1, ["ioc", "c2", "malware"]),
]


def techniques(f: DataFrame) -> DataFrame:
    """``pkg_id, technique, n_keywords``: techniques enough of whose keywords stand in a package's findings."""
    text = F.lower(F.concat_ws(" ", "title", "description"))
    words = sorted({w for _, _, ws in TECHNIQUES for w in ws})
    g = f.groupBy("pkg_id").agg(*[F.bool_or(F.contains(text, F.lit(w))).alias(f"w_{w}") for w in words])
    n = [(t, k, reduce(lambda a, b: a + b, [F.col(f"w_{w}").cast("int") for w in ws])) for t, k, ws in TECHNIQUES]
    x = F.array_compact(F.array(*[F.when(c >= k, F.struct(F.lit(t).alias("technique"), c.alias("n_keywords"))) for t, k, c in n]))
    return g.select("pkg_id", F.explode(x).alias("x")).select("pkg_id", "x.technique", "x.n_keywords")


def maximal(strings: DataFrame, key: str = "file_id", col: str = "decoded", least: int = 30) -> DataFrame:
    """Decoded strings of at least ``least`` characters that no longer one of the same file contains.

    A string can only stand in those that have its first ``least`` characters
    somewhere, so the longer ones are looked up by all their parts of that size.
    """
    s = strings.where(F.length(col) >= least).select(key, col).distinct()
    parts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(col) - least + 1), lambda i: F.substring(F.col(col), i, F.lit(least))))
    o = s.where(F.length(col) > least).select(F.col(key).alias("_k"), F.col(col).alias("_o"), F.explode(parts).alias("_p"))
    starts = F.substring(F.col(col), 1, least)
    return s.join(o, (F.col(key) == F.col("_k")) & (starts == F.col("_p")) & (F.length("_o") > F.length(col)) & F.contains("_o", F.col(col)), "left_anti")


def verdicts(f: DataFrame, self_root: str | None = None) -> DataFrame:
    """``verdict, confidence, reason`` for each finding: self reference (below ``self_root``), true-positive marks, a security tool's own tree, the other false-positive groups in order, source defaults."""
    text = F.concat_ws("\n", "title", "description", F.coalesce("evidence", F.lit("")))
    path = F.coalesce("file_path", F.lit(""))
    v = lambda verdict, conf, why: F.struct(F.lit(verdict).alias("verdict"), F.lit(float(conf)).alias("confidence"), F.lit(why).alias("reason"))
    steps = []
    if self_root:
        steps.append(F.when(path.startswith(self_root), v("FP", 0.98, "self_reference")))
    steps.append(F.when(text.rlike(JAVA + any_of(packs.TRUE_POSITIVE)), v("TP", 0.90, "true_positive")))
    name, file_p, content_p, conf = packs.SELF_REFERENCE
    steps.append(F.when(path.rlike(JAVA + file_p), F.when(text.rlike(JAVA + content_p), v("FP", conf, name)).otherwise(v("FP", conf * 0.85, name))))
    for name, file_p, content_p, conf in packs.FALSE_POSITIVE:
        steps.append(F.when(path.rlike(JAVA + file_p) & text.rlike(JAVA + content_p), v("FP", conf, name)))
    steps.append(F.when(F.col("source") == "entropy", v("UNCERTAIN", 0.3, "entropy")))
    return f.withColumn("_v", F.coalesce(*steps, v("UNCERTAIN", 0.5, "default"))).select("*", "_v.verdict", "_v.confidence", "_v.reason").drop("_v")


def kept(v: DataFrame) -> DataFrame:
    """What remains after dropping false positives of a confidence above 0.85."""
    return v.where(~((F.col("verdict") == "FP") & (F.col("confidence") > 0.85)))


def heuristic_review(f: DataFrame) -> DataFrame:
    return f.withColumn("review", F.lit("HUMAN_REVIEW")).withColumn("review_confidence", F.when(F.col("severity").isin("CRITICAL", "HIGH"), 0.95).otherwise(0.5))


def review_gate(f: DataFrame, strategy: str) -> DataFrame:
    """``pkg_id, threshold``: quick NEVER (MEDIUM with any critical or high finding), standard MEDIUM, else ALL."""
    g = f.groupBy("pkg_id").agg(F.bool_or(F.col("severity").isin("CRITICAL", "HIGH")).alias("b"))
    t = {"quick": F.when(F.col("b"), "MEDIUM").otherwise("NEVER"), "standard": F.lit("MEDIUM")}.get(strategy, F.lit("ALL"))
    return g.select("pkg_id", t.alias("threshold"))


NEGATIVE = r"(?i)\b(?:never|do not|don't|avoid|should not|must not|insecure|bad example)\b|不要|禁止|避免|切勿"


def sarif(f: DataFrame, most: int) -> str:
    """SARIF text of the first ``most`` findings in severity order (a report's limit)."""
    import json

    rows = f.orderBy(-severity_rank(F.col("severity")), "finding_id").limit(most).collect()
    lv = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning"}
    rules: dict[str, dict] = {}
    for r in rows:
        rules.setdefault(r.rule_id, {"id": r.rule_id, "shortDescription": {"text": r.title}})
    results = [
        {"ruleId": r.rule_id, "level": lv.get(r.severity, "note"), "message": {"text": r.description}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": r.file_path or ""}, "region": {"startLine": r.line_number or 1}}}]}
        for r in rows
    ]
    return json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "siltstone", "rules": list(rules.values())}}, "results": results}]}, ensure_ascii=False)


def render(s: DataFrame, fmt: str, most: int = 50) -> str:
    """The packages of the highest scores as text, md or json (a report's limit)."""
    import json

    rows = [r.asDict() for r in s.orderBy(F.desc("score"), F.desc("n_critical"), F.desc("n_high"), "pkg_id").limit(most).collect()]
    if fmt == "json":
        return json.dumps(rows)
    if fmt == "md":
        return "| package | score | level | findings |\n|-|-|-|-|\n" + "\n".join(f"| {r['pkg_id']} | {r['score']} | {r['level']} | {r['n_findings']} |" for r in rows)
    return "\n".join(f"{r['level']:8} {r['score']:3} {r['pkg_id']} ({r['n_findings']} findings)" for r in rows)


def exit_code(s: DataFrame) -> int:
    """1 with any EXTREME or HIGH package, 2 with a MEDIUM one, else 0."""
    rank = s.agg(F.max(F.when(F.col("level").isin("EXTREME", "HIGH"), 2).when(F.col("level") == "MEDIUM", 1).otherwise(0)).alias("r")).head().r or 0
    return {2: 1, 1: 2}.get(rank, 0)


def language_of_output(text: Column) -> Column:
    return F.when(text.rlike("[㐀-鿿]"), "zh").when(text.rlike("[A-Za-z]{3,}"), "en").otherwise("zh")


def from_static(static: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Static findings in the shape that scores and correlation take."""
    return static.select(
        F.xxhash64("file_id", "line_no", "pattern_ix").alias("finding_id"), "rule_id", "severity", "category", F.col("rule_id").alias("title"), F.col("matched_text").alias("description"),
        "pkg_id", F.col("rel_path").alias("file_path"), F.col("line_no").alias("line_number"), F.lit("static_analysis").alias("source"),
    )
