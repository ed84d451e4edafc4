"""Operators on whole packages: metadata, trust, gate, whitelist, fingerprints, caches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import lines
from siltstone.sources.packages import glob_regex

MANIFEST = "SKILL.md"
BINARIES = ["exe", "dll", "so", "dylib", "bin", "msi", "app"]
DANGEROUS_NAMES = r"(?i)^(?:keylogger|stealer|backdoor|rootkit|miner|exploit|payload)\."
AUTOSTART = r"(?m)crontab\s+-|launchctl\s+load|systemctl\s+enable|/etc/rc\.local|\\CurrentVersion\\Run"
LANGUAGES = {"py": "python", "js": "javascript", "mjs": "javascript", "ts": "typescript", "sh": "shell", "bash": "shell", "rb": "ruby", "go": "go", "rs": "rust", "java": "java"}


def header(text: Column, field: str) -> Column:
    """``field:`` in the first 20 lines, the first one's value; empty if there is none."""
    hit = F.filter(F.slice(lines(text), 1, 20), lambda x: x.rlike(rf"^{field}:"))
    return F.trim(F.regexp_replace(F.coalesce(F.get(hit, F.lit(0)), F.lit("")), rf"^{field}:|\r$", ""))


def metadata(f: DataFrame) -> DataFrame:
    """``pkg_id, name, version, author, description``: of each package's manifest at the shortest path."""
    m = f.where(F.lower("name") == MANIFEST.lower())
    order = F.struct(F.length("rel_path"), "rel_path", "file_id")
    t = m.groupBy("pkg_id").agg(F.min_by("text", order).alias("text"))
    return t.select("pkg_id", *[header(F.col("text"), k).alias(k) for k in ("name", "version", "author", "description")])


def statistics(f: DataFrame) -> DataFrame:
    """Files, bytes, manifests, install scripts, languages and a fingerprint of the sorted paths per package."""
    lang = F.coalesce(*[F.when(F.col("ext") == k, v) for k, v in LANGUAGES.items()])
    g = f.groupBy("pkg_id").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"),
        F.bool_or(F.lower("name") == MANIFEST.lower()).alias("has_manifest"),
        F.bool_or(F.lower("name").isin("requirements.txt", "package.json", "pyproject.toml")).alias("has_dependencies"),
        F.bool_or(F.lower("name").isin("install.sh", "setup.sh", "postinstall.sh")).alias("has_install_script"),
        F.array_join(F.array_sort(F.collect_set(lang)), ",").alias("languages"),
    )
    return g


def fingerprint(f: DataFrame) -> DataFrame:
    """Order-free digest of a package's (path, content) pairs: count and two sums of hashes, so that no package is gathered in one place."""
    h = F.col("h")
    u = f.select("pkg_id", F.xxhash64("rel_path", "text").alias("h")).distinct()
    return u.groupBy("pkg_id").agg(F.md5(F.concat_ws(":", F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)")))).alias("fingerprint"))


def preflight(f: DataFrame) -> DataFrame:
    """``pkg_id, check_id, severity``: missing manifest, binaries, dangerous names, autostart code, binaries without source."""
    small_code = F.col("ext").isin(*LANGUAGES) & (F.col("size") <= 100 * 1024)
    g = f.groupBy("pkg_id").agg(
        F.count_if(F.lower("name") == MANIFEST.lower()).alias("m"),
        F.count_if(F.col("ext").isin(*BINARIES)).alias("b"),
        F.count_if(F.col("name").rlike(DANGEROUS_NAMES)).alias("d"),
        F.count_if(small_code & F.col("text").rlike(AUTOSTART)).alias("a"),
        F.count_if(F.col("ext").isin(*LANGUAGES)).alias("c"),
    )
    checks = [("PFC-001", "HIGH", F.col("m") == 0), ("PFC-002", "HIGH", F.col("b") > 0), ("PFC-003", "CRITICAL", F.col("d") > 0), ("PFC-004", "HIGH", F.col("a") > 0), ("PFC-005", "CRITICAL", (F.col("b") > 0) & (F.col("c") == 0))]
    x = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("check_id"), F.lit(s).alias("severity"))) for i, s, c in checks]))
    return g.select("pkg_id", F.explode(x).alias("x")).select("pkg_id", "x.check_id", "x.severity")


def red_flags(f: DataFrame) -> DataFrame:
    """``pkg_id, n_flags``: suspicious file names, instruction phrases in the manifest, pipe-to-shell install scripts, files over 50 MB."""
    flags = F.array_compact(F.array(
        F.when(F.col("name").rlike(DANGEROUS_NAMES), F.lit("name")),
        F.when((F.lower("name") == MANIFEST.lower()) & F.lower("text").rlike("disable security|run as root|ignore warnings|paste your"), F.lit("phrase")),
        F.when(F.lower("name").isin("install.sh", "setup.sh") & F.col("text").rlike(r"curl[^\n]*\|\s*(?:ba)?sh|rm\s+-rf\s+[/~]"), F.lit("install")),
        F.when(F.col("size") > 50 * 1024 * 1024, F.lit("size")),
    ))
    return f.select("pkg_id", F.explode(flags).alias("x")).groupBy("pkg_id").agg(F.countDistinct("x").alias("n_flags"))


def trust(f: DataFrame) -> DataFrame:
    """``pkg_id, trust, strategy``: 50, plus and minus for what a package shows, from 0 to 100; and the scan it deserves."""
    p = statistics(f).join(metadata(f), "pkg_id", "left").join(red_flags(f), "pkg_id", "left")
    n = F.coalesce("n_flags", F.lit(0))
    s = (
        F.lit(50) + F.when(F.col("has_manifest"), 10).otherwise(0) + F.when(F.coalesce("author", F.lit("")) != "", 15).otherwise(0) + F.when(F.col("has_dependencies"), 5).otherwise(0)
        - 15 * n - F.when(F.col("n_bytes") > 10 * 1024 * 1024, 10).when(F.col("n_bytes") < 100, 5).otherwise(0)
    )
    t = p.select("pkg_id", F.greatest(F.lit(0), F.least(F.lit(100), s)).cast("int").alias("trust"), n.alias("n"))
    return t.select("pkg_id", "trust", F.when((F.col("trust") >= 70) & (F.col("n") == 0), "quick").when(F.col("trust") >= 40, "standard").otherwise("full").alias("strategy"))


# The engines of each strategy.
ENGINES = {
    "quick": ["threat_intel", "static_analysis", "credential_theft"],
    "standard": ["threat_intel", "static_analysis", "credential_theft", "deobfuscation", "ast", "dependency", "prompt_injection", "baseline", "semantic", "entropy", "install_hook", "network"],
}
ENGINES["full"] = ENGINES["standard"]


def whitelisted(packages: DataFrame, names: list[str], globs: list[str], prefixes: list[str]) -> DataFrame:
    """Packages on the list: exact name, glob, or path prefix; an empty list trusts nobody."""
    c = F.lit(False)
    if names:
        c = c | F.col("pkg_id").isin(*names)
    for g in globs:
        c = c | F.col("pkg_id").rlike(glob_regex(g))
    for p in prefixes:
        c = c | F.col("path").startswith(p)
    return packages.where(c)


def change_severity(path: Column) -> Column:
    """Manifest, hooks and config changes CRITICAL, code HIGH, the rest MEDIUM."""
    return (
        F.when(path.rlike(r"(?i)(?:^|/)skill\.md$|(?:^|/)(?:hooks|config)/"), "CRITICAL")
        .when(path.rlike(r"\.(?:py|js|mjs|ts|sh|bash|rb|go)$"), "HIGH")
        .otherwise("MEDIUM")
    )


def cache_valid(entries: DataFrame, current: DataFrame, version: str, now: float, days: int = 7) -> DataFrame:
    """Entries whose version and tree hash are the current ones and whose age is within the limit."""
    return entries.where((F.col("version") == version) & (F.lit(now) - F.col("entry_timestamp") <= days * 86400)).join(current, ["skill_path", "skill_hash"], "left_semi")


def cache_evict(entries: DataFrame, most_bytes: int, share: float = 0.8) -> DataFrame:
    """Entries to drop, oldest first, until the newest fit in ``share`` of the limit; none while the limit holds.

    Sizes are summed up per day first, so only a day's entries are ever ordered together.
    """
    e = entries.withColumn("_day", F.floor(F.col("entry_timestamp") / 86400)).withColumn("_n", F.coalesce(F.length("result"), F.lit(0)))
    days = e.groupBy("_day").agg(F.sum("_n").alias("_d"))
    newer = days.withColumn("_before", F.coalesce(F.sum("_d").over(W.orderBy(F.desc("_day")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    total = days.agg(F.sum("_d").alias("_total"))
    w = W.partitionBy("_day").orderBy(F.desc("entry_timestamp"), F.desc("entry_id")).rowsBetween(W.unboundedPreceding, 0)
    run = e.join(newer.select("_day", "_before"), "_day").withColumn("_run", F.col("_before") + F.sum("_n").over(w))
    return run.join(F.broadcast(total)).where((F.col("_total") > most_bytes) & (F.col("_run") > most_bytes * share)).drop("_day", "_n", "_before", "_run", "_total")
