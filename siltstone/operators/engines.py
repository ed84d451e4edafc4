"""All engines over the files of packages, by strategy, down to one scored row a package."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import ast_rules, behaviour, decode, intel, line_rules, packages, scoring
from siltstone.rules import packs

FINDING = "rule_id, severity, category, title, description, pkg_id, file_path, line_number, source"


def _finding(df: DataFrame, engine: str, rule: Column, severity: Column, category: Column | str, title: Column, description: Column | None = None, line: Column | None = None) -> DataFrame:
    """Rows of one engine in the common form; ``df`` has file_id."""
    return df.select(
        "file_id", rule.alias("rule_id"), severity.alias("severity"), (F.lit(category) if isinstance(category, str) else category).alias("category"), title.alias("title"),
        (title if description is None else description).cast("string").alias("description"), (F.lit(None) if line is None else line).cast("int").alias("line_number"), F.lit(engine).alias("source"),
    )


def _threat_intel(f: DataFrame) -> DataFrame:
    c = F.col
    a = _finding(intel.attack_patterns(f), "threat_intel", F.concat(F.lit("TI_"), F.upper("pattern_id")), c("severity"), "threat_intel", c("pattern_id"), c("indicator"), c("line_no"))
    return a.unionByName(_finding(intel.ioc_hits(f), "threat_intel", F.lit("TI_IOC"), F.lit("CRITICAL"), "threat_intel", F.concat(F.lit("ioc "), c("kind")), c("ioc")))


def _static(f: DataFrame) -> DataFrame:
    c = F.col
    return _finding(line_rules.static_findings(f), "static_analysis", c("rule_id"), c("severity"), c("category"), c("rule_id"), c("matched_text"), c("line_no"))


def _credential_theft(f: DataFrame) -> DataFrame:
    c = F.col
    return _finding(behaviour.credential_theft(f), "credential_theft", F.concat(F.lit("CREDTHEFT_"), F.upper("target")), c("severity"), "credential_theft", c("target"), line=c("line_no"))


def _deobfuscation(f: DataFrame) -> DataFrame:
    c = F.col
    h = decode.hidden_characters(f)
    hidden = _finding(h.where("n_bidi + n_zero_width > 0"), "deobfuscation", F.lit("DEOBF_HIDDEN"), F.when(c("n_bidi") > 0, "HIGH").otherwise("MEDIUM"), "deobfuscation", F.lit("hidden characters"))
    used = _finding(decode.technique_usage(f), "deobfuscation", F.concat(F.lit("DEOBF_"), F.upper("technique")), F.lit("LOW"), "deobfuscation", c("technique"))
    d = decode.decoded_lines(f)
    danger = F.lower("decoded").rlike(decode.DANGER_WORDS)
    read = _finding(d.where(danger), "deobfuscation", F.lit("DEOBF_PAYLOAD"), F.lit("HIGH"), "deobfuscation", c("technique"), F.substring("decoded", 1, 300), c("line_no"))
    return hidden.unionByName(used).unionByName(read)


def _ast(f: DataFrame) -> DataFrame:
    c = F.col
    return _finding(ast_rules.ast_findings(f), "ast", c("rule_id"), c("severity"), "ast", c("name"), line=c("line_no"))


def _dependency(f: DataFrame) -> DataFrame:
    c = F.col
    v = behaviour.vulnerable(behaviour.dependencies(f), f.sparkSession)
    return _finding(v, "dependency", c("cve"), F.lit("HIGH"), "dependency", c("package"), F.concat_ws(" ", "package", "spec", F.lit("below"), "safe"))


def _prompt(f: DataFrame) -> DataFrame:
    c = F.col
    p = _finding(line_rules.probe_hits(f, skip_rule_lines=True), "prompt_injection", c("rule_id"), c("severity"), "prompt_injection", c("category"), c("matched"))
    return p.dropDuplicates(["file_id", "rule_id"])


def _semantic(f: DataFrame) -> DataFrame:
    q = line_rules.quick_assessment(f).where("needs_review")
    return _finding(q, "semantic", F.lit("SEM_QUICK"), F.when(F.col("level") == "CRITICAL", "HIGH").otherwise(F.col("level")), "semantic", F.lit("quick assessment"), F.col("score"))


def _entropy(f: DataFrame) -> DataFrame:
    sev = F.when(F.col("rule_id") == "ENTROPY_001", "HIGH").when(F.col("rule_id") == "ENTROPY_004", "LOW").otherwise("MEDIUM")
    return _finding(decode.entropy_findings(f), "entropy", F.col("rule_id"), sev, "entropy_analysis", F.lit("entropy"), F.col("value"))


def _hooks(f: DataFrame) -> DataFrame:
    c = F.col
    a = _finding(behaviour.hook_findings(f), "install_hook", c("rule_id"), c("severity"), "install_hook", c("label"), line=c("line_no"))
    b = _finding(behaviour.manifest_hooks(f), "install_hook", c("rule_id"), c("severity"), "install_hook", c("rule_id"), line=c("line_no"))
    n = _finding(behaviour.package_json_hooks(f), "install_hook", F.lit("HOOK_010"), c("severity"), "install_hook", c("hook"), c("command"))
    return a.unionByName(b).unionByName(n)


def _network(f: DataFrame) -> DataFrame:
    c = F.col
    a = _finding(behaviour.network_lines(f), "network", F.concat(F.lit("NET_"), F.upper("family")), c("severity"), "network_behavior", c("label"), line=c("line_no"))
    return a.unionByName(_finding(behaviour.endpoint_risks(behaviour.endpoints(f)), "network", F.concat(F.lit("NET_"), F.upper("risk")), c("severity"), "network_behavior", c("risk"), c("url")))


def _documents(f: DataFrame) -> DataFrame:
    c = F.col
    return _finding(line_rules.document_findings(f), "social_engineering", F.concat(F.lit("SE_"), F.upper("category")), c("severity"), c("category"), c("category"), line=c("line_no"))


#: engine -> its findings over files; the baseline engine is given its changes by the caller of ``scan``
ENGINES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "threat_intel": _threat_intel, "static_analysis": _static, "credential_theft": _credential_theft, "deobfuscation": _deobfuscation, "ast": _ast, "dependency": _dependency,
    "prompt_injection": _prompt, "semantic": _semantic, "entropy": _entropy, "install_hook": _hooks, "network": _network, "social_engineering": _documents,
}


#: strategy -> engines; documents are scanned by all but the quick one
STRATEGIES = {k: [*v, *(["social_engineering"] if k != "quick" else [])] for k, v in packages.ENGINES.items()}


def runs_engine(strategy: Column, engine: str) -> Column:
    return strategy.isin(*[s for s, es in STRATEGIES.items() if engine in es])


def engine_findings(f: DataFrame, strategy: str | DataFrame = "standard", only: list[str] | None = None) -> DataFrame:
    """The findings of all engines that a strategy runs, with ``finding_id`` (a hash of what is found).

    ``strategy`` is one for all packages or a table ``pkg_id, strategy``; then an
    engine reads the files of those packages only whose strategy has it.
    ``only`` narrows the engines further. Nothing is found in no files.
    """
    if isinstance(strategy, DataFrame):
        f = f.join(strategy.select("pkg_id", F.col("strategy").alias("_strategy")), "pkg_id")
    else:
        f = f.withColumn("_strategy", F.lit(strategy))
    names = [n for n in ENGINES if (only is None or n in only) and (isinstance(strategy, DataFrame) or n in STRATEGIES.get(strategy, []))]
    parts = [ENGINES[n](f.where(runs_engine(F.col("_strategy"), n)).drop("_strategy")) for n in names]
    where = f.select("file_id", "pkg_id", F.col("rel_path").alias("file_path"))
    found = reduce(DataFrame.unionByName, parts).join(where, "file_id")
    return found.select(F.xxhash64("file_id", "rule_id", "title", "description", "line_number", "source").alias("finding_id"), *FINDING.split(", "))


def gate_findings(f: DataFrame) -> DataFrame:
    """The package gate's checks as findings."""
    c = F.col
    return packages.preflight(f).select(
        F.xxhash64("pkg_id", "check_id").alias("finding_id"), c("check_id").alias("rule_id"), "severity", F.lit("preflight").alias("category"), c("check_id").alias("title"), c("check_id").alias("description"),
        "pkg_id", F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("line_number"), F.lit("preflight").alias("source"),
    )


def baseline_findings(changes: DataFrame) -> DataFrame:
    """Changes against a baseline (``pkg_id, file_path, change_type``) as findings."""
    sev = packages.change_severity(F.col("file_path"))
    return changes.select(
        F.xxhash64("pkg_id", "file_path", "change_type").alias("finding_id"), F.lit("BASELINE_CHANGE").alias("rule_id"), sev.alias("severity"), F.lit("baseline_change").alias("category"),
        F.col("change_type").alias("title"), F.concat_ws(" ", "change_type", "file_path").alias("description"), "pkg_id", "file_path", F.lit(None).cast("int").alias("line_number"), F.lit("baseline").alias("source"),
    )


def scan(f: DataFrame, strategy: str | DataFrame = "standard", changes: DataFrame | None = None, whitelist: DataFrame | None = None, only: list[str] | None = None) -> DataFrame:
    """``pkg_id, n_findings, n_dropped, n_critical, n_high, n_chains, score, level``: one row for every package.

    Gate, engines, false-positive filter, correlation and score. Packages of
    ``whitelist`` (``pkg_id``) are passed with no findings. The score is that of
    the findings left plus the correlation's, 100 at most; quick scans take the
    weighted scorer's context factors instead. Packages without findings have
    score 0; a package without files doesn't exist.
    """
    packages_ = f.select("pkg_id").distinct()
    src = f.join(whitelist.select("pkg_id").distinct(), "pkg_id", "left_anti") if whitelist is not None else f
    found = engine_findings(src, strategy, only).unionByName(gate_findings(src))
    if changes is not None:
        found = found.unionByName(baseline_findings(changes))
    v = scoring.verdicts(found.withColumn("evidence", F.lit(None).cast("string")))
    dropped = (F.col("verdict") == "FP") & (F.col("confidence") > 0.85)
    n = lambda c: F.count_if(c & ~dropped)
    weight = scoring.weight(F.col("severity"), packs.WEIGHT_MAIN, 5)
    has = lambda k: F.bool_or(F.contains("category", F.lit(k)) & ~dropped)
    g = v.groupBy("pkg_id").agg(
        n(F.lit(True)).alias("n_findings"), F.count_if(dropped).alias("n_dropped"), n(F.col("severity") == "CRITICAL").alias("n_critical"), n(F.col("severity") == "HIGH").alias("n_high"),
        F.sum(F.when(dropped, 0).otherwise(weight)).alias("base"), has("hook").alias("h"), has("network").alias("w"), has("credential").alias("c"), *[x.alias(k) for k, x in scoring.feature_flags(~dropped).items()],
    )
    chains = [F.when(reduce(lambda a, b: a & b, [F.col(f"f_{x}") for x in need]), {"CRITICAL": 25, "HIGH": 15}.get(sev, 10)).otherwise(0) for _, sev, need, _ in packs.CHAINS]
    g = g.withColumn("n_chains", reduce(lambda a, b: a + b, [(c > 0).cast("int") for c in chains])).withColumn("extra", reduce(lambda a, b: a + b, chains))
    factor = F.when(F.col("h"), 1.5).otherwise(1.0) * F.when(F.col("w"), 1.2).otherwise(1.0) * F.when(F.col("c"), 1.3).otherwise(1.0)
    total = F.floor((F.col("base") + 5 * F.col("n_findings")) * factor + 1e-9) if strategy == "quick" else F.col("base") + F.col("extra")
    g = g.select("pkg_id", "n_findings", "n_dropped", "n_critical", "n_high", "n_chains", F.least(F.lit(100), total).cast("int").alias("score"))
    zero = {c: 0 for c in ("n_findings", "n_dropped", "n_critical", "n_high", "n_chains", "score")}
    return packages_.join(g, "pkg_id", "left").na.fill(zero).withColumn("level", scoring.level(F.col("score")))


# --- summaries


def engine_summaries(found: DataFrame) -> DataFrame:
    """``source, severity, category, n, n_packages``: what each engine found."""
    return found.groupBy("source", "severity", "category").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("pkg_id").alias("n_packages"))


def drop_summary(v: DataFrame) -> DataFrame:
    """``n, n_dropped, n_true, n_uncertain, fp_rate`` of judged findings: one row, the rate in per cent to one place (0 of none)."""
    dropped = (F.col("verdict") == "FP") & (F.col("confidence") > 0.85)
    n = F.count(F.lit(1))
    return v.agg(
        n.alias("n"), F.count_if(dropped).alias("n_dropped"), F.count_if(F.col("verdict") == "TP").alias("n_true"), F.count_if(F.col("verdict") == "UNCERTAIN").alias("n_uncertain"),
        F.when(n == 0, 0.0).otherwise(F.round(100.0 * F.count_if(F.col("verdict") == "FP") / n, 1)).alias("fp_rate"),
    )
