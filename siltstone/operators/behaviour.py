"""Install hooks, network behaviour, credential theft, manifests and known vulnerabilities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import explode_lines, lines, pinned, tagged
from siltstone.rules import packs
from siltstone.rules.fold import JAVA, any_of, first_hit, folded, gate, pick
from siltstone.sources.packages import for_engine

HOOK_FILES = ["setup.py", "package.json", "pyproject.toml", "makefile", "dockerfile", "install.sh", "setup.sh", "postinstall.sh", "preinstall.sh", "install.py"]
SAFE_INSTALLER = r"(?i)^\s*(?:npm (?:ci|install)|husky install|node-gyp rebuild|tsc|npm run build)\s*$"


def either(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cs)


def first_per_line(f: DataFrame, rules: list[tuple[str, str]], skip: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """``file_id, pkg_id, keep, line_no, label``: the first of the ordered patterns on each line."""
    pats, keep = [p for _, p in rules], keep or []
    src = pinned(f, "_low", folded(F.col("text"))).where(F.size(gate("_low", pats)) > 0)
    rows = explode_lines(src.select("file_id", "pkg_id", *keep, "text"))
    if skip is not None:
        rows = rows.where(~skip)
    rows = pinned(rows, "ix", first_hit("line", pats)).where("ix IS NOT NULL")
    return rows.select("file_id", "pkg_id", *keep, "line_no", pick([n for n, _ in rules], "ix").alias("label"))


def hook_findings(f: DataFrame) -> DataFrame:
    """Install-hook patterns, first per line that isn't a comment: HOOK_020 in hook files, HOOK_040 elsewhere."""
    src = for_engine(f, "hooks").withColumn("is_hook_file", F.lower("name").isin(*HOOK_FILES))
    h = first_per_line(src, packs.HOOKS, F.trim(F.col("line")).startswith("#"), ["is_hook_file"])
    return h.select("file_id", "pkg_id", "line_no", "label", F.when(F.col("is_hook_file"), "HOOK_020").otherwise("HOOK_040").alias("rule_id"), F.when(F.col("is_hook_file"), "HIGH").otherwise("MEDIUM").alias("severity"))


def manifest_hooks(f: DataFrame) -> DataFrame:
    """``file_id, pkg_id, line_no, rule_id, severity``: what setup.py (by line) and pyproject.toml (line 0) run at build or install.

    HOOK_001 replaced commands, HOOK_002 an install class of its own, HOOK_003
    console scripts; HOOK_030 a build backend, HOOK_031 a table of commands.
    """
    n = F.lower("name")
    s = F.trim("line")
    hit = lambda *cs: F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("rule_id"), F.lit(v).alias("severity"))) for i, v, c in cs]))
    setup = explode_lines(f.where(n == "setup.py").select("file_id", "pkg_id", "text"))
    setup = setup.select("file_id", "pkg_id", "line_no", F.explode(hit(
        ("HOOK_001", "HIGH", s.contains("cmdclass") & (s.contains("install") | s.contains("build"))),
        ("HOOK_002", "HIGH", s.rlike(JAVA + r"class\s+\w+\(.*install\)")),
        ("HOOK_003", "MEDIUM", s.contains("entry_points") & s.contains("console_scripts")),
    )).alias("h"))
    t = F.col("text")
    project = f.where(n == "pyproject.toml").select("file_id", "pkg_id", F.lit(0).alias("line_no"), F.explode(hit(
        ("HOOK_030", "MEDIUM", t.rlike(r"build-backend\s*=")), ("HOOK_031", "HIGH", t.contains("[tool.setuptools.cmdclass]")),
    )).alias("h"))
    return setup.unionByName(project).select("file_id", "pkg_id", "line_no", "h.rule_id", "h.severity")


def package_json_hooks(f: DataFrame) -> DataFrame:
    """Scripts of package.json run at install: an additive danger score and its severity; safe installers don't count."""
    scripts = F.from_json("text", "scripts map<string,string>")["scripts"]
    s = f.where(F.lower("name") == "package.json").select("file_id", "pkg_id", F.explode(scripts).alias("hook", "command"))
    s = s.where(F.col("hook").isin("preinstall", "install", "postinstall", "prepare", "prepublish") & ~F.col("command").rlike(SAFE_INSTALLER))
    parts = [(r"(?i)curl|wget|http", 2), (r"(?i)\bsh\b|bash|powershell", 2), (r"(?i)eval|exec|base64", 3), (r"(?i)token|secret|password|\.ssh|\.aws", 2)]
    s = s.withColumn("score", reduce(lambda a, b: a + b, [F.when(F.col("command").rlike(p), w).otherwise(0) for p, w in parts]))
    return s.where("score > 0").withColumn("severity", F.when(F.col("score") >= 5, "CRITICAL").when(F.col("score") >= 3, "HIGH").otherwise("MEDIUM"))


def endpoints(f: DataFrame) -> DataFrame:
    """``file_id, label, url, host, scheme, port, is_ip``: addresses that code calls, over whole texts."""
    src = for_engine(f, "network").where(F.lower("text").rlike(r"http|curl|wget|socket|client\.|fetch|axios"))
    parts = [
        tagged(F.regexp_extract_all("text", F.lit("(?iud)" + p), F.lit(g)), "label", n, "url")
        for n, g, p in packs.ENDPOINTS
    ]
    e = src.select("file_id", F.explode(F.concat(*parts)).alias("e")).select("file_id", "e.label", "e.url").where("url <> ''")
    return e.select("*", *url_parts(F.col("url")))


def url_parts(url: Column) -> list[Column]:
    """Host, scheme, port (443, 80 or 0 where none is given) and whether the host is an IPv4 literal; a bare address counts as http."""
    full = F.when(url.rlike(r"^\d{1,3}(\.\d{1,3}){3}"), F.concat(F.lit("http://"), url)).otherwise(url)
    scheme = F.lower(F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    auth = F.regexp_replace(F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\s]*)", 1), r"^[^@]*@", "")
    host = F.lower(F.regexp_replace(auth, r":\d*$", ""))
    port = F.regexp_extract(auth, r":(\d{1,5})$", 1)
    return [
        host.alias("host"), scheme.alias("scheme"),
        F.when(port != "", port.cast("int")).when(scheme == "https", 443).when(scheme == "http", 80).otherwise(0).alias("port"),
        host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$").alias("is_ip"),
    ]


SUSPICIOUS_TLD = ["tk", "ml", "ga", "cf", "gq", "xyz", "top", "pw", "cc"]


def endpoint_risks(e: DataFrame) -> DataFrame:
    """IP literals and suspicious top-level domains MEDIUM, unusual ports LOW."""
    tld = F.element_at(F.split("host", r"\."), -1)
    risks = F.array_compact(F.array(
        F.when(F.col("is_ip"), F.struct(F.lit("ip_literal").alias("risk"), F.lit("MEDIUM").alias("severity"))),
        F.when(tld.isin(*SUSPICIOUS_TLD), F.struct(F.lit("suspicious_tld").alias("risk"), F.lit("MEDIUM").alias("severity"))),
        F.when(~F.col("port").isin(80, 443, 0) & F.col("scheme").isin("http", "https"), F.struct(F.lit("unusual_port").alias("risk"), F.lit("LOW").alias("severity"))),
    ))
    return e.select("file_id", "url", F.explode(risks).alias("r")).select("file_id", "url", "r.risk", "r.severity")


TRUSTED = any_of([t.replace(".", r"\.") for t in packs.TRUSTED])


def network_lines(f: DataFrame) -> DataFrame:
    """``file_id, pkg_id, line_no, family, label, severity``: exfiltration (trusted domains aside), covert channels and
    command-and-control lines, each family's first pattern per line; whole-text patterns only for files without a line of the last.

    All families are looked for in one pass over the lines.
    """
    src = for_engine(f, "network")
    families = [("exfil", packs.EXFIL, "HIGH", ~F.lower("line").rlike(TRUSTED)), ("covert", packs.COVERT, "HIGH", None), ("c2", packs.C2, "CRITICAL", None)]
    every = [p for _, rules, _, _ in families for _, p in rules]
    low = pinned(src, "_low", folded(F.col("text"))).where(F.size(gate("_low", every)) > 0)
    rows = explode_lines(low.select("file_id", "pkg_id", "text"))
    for name, rules, _, ok in families:
        ix = first_hit("line", [p for _, p in rules])
        rows = pinned(rows, name, ix if ok is None else F.when(ok, ix))
    found = F.array_compact(F.array(*[
        F.when(F.col(name).isNotNull(), F.struct(F.lit(name).alias("family"), pick([n for n, _ in rules], name).alias("label"), F.lit(sev).alias("severity")))
        for name, rules, sev, _ in families
    ]))
    rows = rows.select("file_id", "pkg_id", "line_no", F.explode(found).alias("h")).select("file_id", "pkg_id", "line_no", "h.*")
    multi = src.withColumn("ix", first_hit("text", [p for _, p in packs.C2_MULTI], "(?iu)")).where("ix IS NOT NULL")
    multi = multi.where(~F.exists(lines(F.col("text")), lambda x: x.rlike(JAVA + any_of([p for _, p in packs.C2]))))
    multi = multi.select("file_id", "pkg_id", F.lit(0).alias("line_no"), F.lit("c2_multi").alias("family"), pick([n for n, _ in packs.C2_MULTI], "ix").alias("label"), F.lit("CRITICAL").alias("severity"))
    return rows.unionByName(multi)


# Places where credentials lie, and ways to send them.
THEFT_READ = [
    ("ssh_key", r"\.ssh/(?:id_[a-z0-9]+|authorized_keys|config)"), ("cloud_credentials", r"\.aws/credentials|\.config/gcloud|\.azure/|\.kube/config"),
    ("browser_store", r"Login Data|logins\.json|key4\.db|Cookies\b.*(?:Chrome|Firefox)|localStorage\.getItem"),
    ("keychain", r"find-generic-password|secret-tool lookup|cmdkey /list|keychain-db"), ("password_dialog", r"osascript.*display dialog|with hidden answer"),
]
THEFT_SEND = r"requests\.(?:post|put)|curl\s+.*(?:-d|--data|-F|-T)\b|fetch\(.*POST|urlopen\(|socket\.send|webhook"


def credential_theft(f: DataFrame) -> DataFrame:
    """Lines that read stored credentials: HIGH, CRITICAL where the same file also sends data."""
    src = f.where(F.col("ext").isin("py", "js", "mjs", "ts", "sh", "bash", "zsh", "")).withColumn("sends", F.col("text").rlike(JAVA + THEFT_SEND))
    h = first_per_line(src, THEFT_READ, keep=["sends"])
    return h.select("file_id", "pkg_id", "line_no", F.col("label").alias("target"), F.when(F.col("sends"), "CRITICAL").otherwise("HIGH").alias("severity"))


# --- dependencies


def version(v: Column) -> Column:
    """Leading digits of each part, as an array; a shorter one that is a prefix is smaller."""
    parts = F.split(F.regexp_replace(F.trim(v), r"^[^\d]+", ""), r"\.")
    nums = F.transform(parts, lambda p: F.regexp_extract(p, r"^(\d+)", 1))
    return F.transform(F.filter(nums, lambda p: p != ""), lambda p: p.cast("int"))


def dependencies(f: DataFrame) -> DataFrame:
    """``file_id, pkg_id, package, spec``: requirements lines, install_requires, project dependencies and package.json sections, at most one folder deep."""
    near = f.where(F.size(F.split("rel_path", "/")) <= 2)
    req = explode_lines(near.where(F.lower("name").rlike(r"^requirements.*\.txt$")).select("file_id", "pkg_id", "text"))
    pat = r"^\s*([A-Za-z0-9_.\-]+)\s*(?:\[[^\]]*\])?\s*((?:==|>=|<=|~=|>|<)\s*[0-9][\w.]*)"
    req = req.select("file_id", "pkg_id", F.regexp_extract("line", pat, 1).alias("package"), F.regexp_extract("line", pat, 2).alias("spec")).where("package <> ''")
    quoted = F.regexp_extract_all(F.regexp_extract("text", r"(?s)(?:install_requires|dependencies)\s*=\s*\[(.*?)\]", 1), F.lit(r"[\"']([^\"']+)[\"']"), F.lit(1))
    lst = near.where(F.col("name").isin("setup.py", "pyproject.toml")).select("file_id", "pkg_id", F.explode(quoted).alias("q"))
    lst = lst.select("file_id", "pkg_id", F.regexp_extract("q", pat, 1).alias("package"), F.regexp_extract("q", pat, 2).alias("spec")).where("package <> ''")
    j = F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>")
    none = F.create_map().cast("map<string,string>")
    npm = near.where(F.col("name") == "package.json").select("file_id", "pkg_id", j.alias("j"))
    npm = npm.select("file_id", "pkg_id", F.explode(F.concat(*[F.map_entries(F.coalesce(F.col(f"j.{k}"), none)) for k in ("dependencies", "devDependencies", "peerDependencies")])).alias("e"))
    npm = npm.select("file_id", "pkg_id", F.col("e.key").alias("package"), F.col("e.value").alias("spec"))
    return req.unionByName(lst).unionByName(npm)


def vulnerable(deps: DataFrame, spark: SparkSession, extra: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Dependencies below the first safe version of a known advisory; entries of ``extra`` replace a package's own. The table is a constant of some twenty rows."""
    own = {p for p, _, _ in extra or []}
    rows = [r for r in packs.CVE if r[0] not in own] + list(extra or [])
    db = spark.createDataFrame(rows, "package string, cve string, safe string").withColumn("bound", version(F.col("safe"))).withColumnRenamed("package", "p")
    d = deps.withColumn("v", version(F.col("spec"))).where(F.size("v") > 0)
    return d.join(F.broadcast(db), (F.lower("package") == F.col("p")) & (F.col("v") < F.col("bound"))).select("file_id", "pkg_id", F.lower("package").alias("package"), "spec", "cve", "safe")
