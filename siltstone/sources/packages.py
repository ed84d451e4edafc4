"""Files of packages: from folders, or from a skill_file table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.tables import spread, table

# Extensions that each engine reads.
ENGINE_EXT = {
    "static": ["py", "js", "ts", "sh", "md", "yaml", "yml", "json", "txt"],
    "entropy": ["py", "js", "ts", "sh", "md", "yaml", "yml", "json", "txt"],
    "deobfuscation": ["py", "js", "ts", "sh", "md", "yaml", "yml", "json"],
    "network": ["py", "js", "ts", "sh", "bash", "zsh"],
    "ast": ["py"],
    "probes": ["py", "js", "ts", "md", "yaml", "yml", "json", "txt"],
    "hooks": ["py", "js", "sh", "json", "toml", "yaml", "yml"],
    "documents": ["md", "txt", "rst", "text", "adoc"],
}
IGNORED_DIRS = ["node_modules", "__pycache__", ".git", ".venv", "venv", ".tmp_scan"]
LOCKFILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml"]
BINARY_EXT = ["png", "jpg", "jpeg", "gif", "ico", "pdf", "zip", "tar", "gz", "bz2", "7z", "exe", "dll", "so", "dylib", "pyc", "class", "jar", "woff", "woff2"]
MOST_DOCUMENT_BYTES, MOST_PARALLEL_BYTES = 500 * 1024, 10 * 1024 * 1024


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def ext_of(name: Column) -> Column:
    """Lower-case suffix without the dot; a leading dot alone makes none."""
    return F.lower(F.regexp_extract(name, r".\.([^.]+)$", 1))


def from_table(skill_file: DataFrame) -> DataFrame:
    """``file_id, pkg_id, rel_path, name, ext, size, text`` of a skill_file table."""
    n = name_of(F.col("path"))
    return skill_file.select(
        "file_id",
        F.col("skill_name").alias("pkg_id"),
        F.col("path").alias("rel_path"),
        n.alias("name"),
        ext_of(n).alias("ext"),
        F.octet_length("content").cast("long").alias("size"),
        F.col("content").alias("text"),
    )


def files(spark: SparkSession, d: str) -> DataFrame:
    return from_table(spread(table(spark, d, "skill_file")))


def read_packages(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """Files below ``root/<package>/``, read as bytes; text is null where it isn't UTF-8.

    ``pattern`` goes to the source as a path filter, so other files are never opened.
    """
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    base = root.rstrip("/")
    rel = F.regexp_extract("path", rf"\Q{base.split(':')[-1].lstrip('/')}\E/(.+)$", 1)
    raw = F.col("content").cast("string")
    df = r.load(base).withColumn("_rel", rel)
    pkg = F.element_at(F.split("_rel", "/"), 1)
    path = F.regexp_replace("_rel", r"^[^/]+/", "")
    n = name_of(path)
    return df.select(
        F.xxhash64("_rel").alias("file_id"),
        pkg.alias("pkg_id"),
        path.alias("rel_path"),
        n.alias("name"),
        ext_of(n).alias("ext"),
        F.col("length").alias("size"),
        F.when(F.is_valid_utf8(raw), raw).alias("text"),
    )


def for_engine(f: DataFrame, engine: str) -> DataFrame:
    return f.where(F.col("ext").isin(*ENGINE_EXT[engine]))


def glob_regex(glob: str) -> str:
    """A shell glob as a regular expression; ``*`` crosses slashes."""
    out = ""
    for c in glob:
        out += {"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() and c not in "[]-_/" else c)
    return f"^{out}$"


def ignored(path: Column, rules: list[str] | None = None) -> Column:
    """Whether an ignore list drops a path: default folders, dot files, then negations, folder names and globs in this order."""
    parts = F.split(path, "/")
    name = name_of(path)
    base = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in IGNORED_DIRS])) | F.exists(parts, lambda p: p.startswith("."))
    if not rules:
        return base
    keep = [glob_regex(r[1:]) for r in rules if r.startswith("!")]
    dirs = [r.rstrip("/") for r in rules if r.endswith("/") and not r.startswith("!")]
    globs = [glob_regex(r) for r in rules if not r.startswith("!") and not r.endswith("/")]
    either = lambda cs: reduce(lambda a, b: a | b, cs, F.lit(False))
    kept = either([name.rlike(g) | path.rlike(g) for g in keep])
    hit = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in dirs])) if dirs else F.lit(False)
    return F.when(base, True).when(kept, False).otherwise(hit | either([name.rlike(g) | path.rlike(g) for g in globs]))


def reference_json(name: Column) -> Column:
    """JSON files that hold reference data by their name."""
    return F.lower(name).rlike(r"(?:threat|ioc|blocklist|malicious|indicator|high-risk).*\.json$")


def pruning(f: DataFrame) -> DataFrame:
    """Per file: which engines read it, and why others skip it."""
    reads = F.array_compact(F.array(*[F.when(F.col("ext").isin(*v), F.lit(k)) for k, v in sorted(ENGINE_EXT.items())]))
    return f.select(
        "file_id",
        F.array_join(reads, ",").alias("engines"),
        F.coalesce(ignored(F.col("rel_path")), F.lit(False)).alias("is_ignored"),
        reference_json(F.col("name")).alias("is_reference"),
        (F.col("size") > MOST_DOCUMENT_BYTES).alias("too_long_document"),
        F.col("name").isin(*LOCKFILES).alias("is_lockfile"),
        F.col("ext").isin(*BINARY_EXT).alias("is_binary"),
    )


def discover(spark: SparkSession, bases: dict[str, list[str]]) -> DataFrame:
    """``platform, path, kind``: package folders (those that hold a manifest, in any casing) below each platform's base folders.

    ``kind`` is marketplace or system after a folder of that name in the path,
    else local. Base folders that don't exist hold nothing; a folder is listed
    once a platform. No file is read.
    """
    out = None
    for platform, dirs in bases.items():
        for d in dirs:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(d)
            if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
                continue
            r = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "[Ss][Kk][Ii][Ll][Ll].[Mm][Dd]").load(d)
            r = r.select(F.lit(platform).alias("platform"), F.regexp_replace("path", "/[^/]+$", "").alias("path"))
            out = r if out is None else out.unionByName(r)
    if out is None:
        return spark.createDataFrame([], "platform string, path string, kind string")
    parts = F.split(F.lower("path"), "/")
    kind = F.when(F.array_contains(parts, "marketplace"), "marketplace").when(F.array_contains(parts, "system"), "system").otherwise("local")
    return out.distinct().withColumn("kind", kind)


def detect_platform(env: dict[str, str], marks: list[tuple[str, str]], default: str = "local") -> str:
    """The platform of the first environment variable of ``marks`` (variable, platform) that is set."""
    return next((p for v, p in marks if env.get(v)), default)
