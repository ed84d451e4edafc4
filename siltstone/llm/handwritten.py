"""Problem 4 over tables: generated, minified, third-party and data files, so that hand-written ones remain."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.arrow import map_batches
from siltstone.llm.repair import TOKEN
from siltstone.session import checkpoint

BATCH = 500  # files whose tokens are in memory at once
REUSE = 0.34  # a grammar smaller than this by its text: generated
REUSE_DATA = 0.5  # the same in a file of code that is half literals: a table
REUSE_CONFIG = 0.43  # the same in configuration
SHARED = 0.5  # share of a file's tokens in rules that other repositories have too
BLOB_CODE, BLOB_CONFIG = 0.62, 0.5  # share of a file that stays when its long literals are packed and all else is left out
BLOB_LOCK = 0.35  # the same with a grammar below REUSE_DATA
DENSE, LEAST_CHARS = 0.09, 200  # white space in minified scripts stays below this share; a line of script is none

SCRIPT = ("js", "mjs", "cjs")
CODE = (*SCRIPT, *"py pyw pyi ts tsx jsx sh bash zsh ksh ps1 java kt scala groovy go rs rb php pl pm lua r jl swift c h cc cpp cxx hpp hh cs fs vb m mm dart ex exs erl hs clj sql vue svelte".split())
CONFIG = ("json", "yaml", "yml", "toml", "lock", "map", "gen")
MARKUP = ("css", "html", "htm", "svg", "xml")
NOTICE = re.compile(
    r"(?i)@generated\b|\bauto[- ]?generated\b|\bautomatically[ ](?:generated|produced)\b|\b(?:code|file)[ ](?:is[ ]|was[ ])?generated[ ](?:by|with|from)\b"
    r"|^[\s#/*\"']*generated[ ](?:by|with|from)\b|\bchanges[ ]will[ ]be[ ]lost\b",
    re.M,
)
PINS = re.compile(r"sha(?:1|256|384|512)[-:]")
WEB_PAGE = re.compile(r"(?i)\A\s*<(?:!doctype|html)")
LITERAL = re.compile(r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|[A-Za-z0-9+/=]{40,}")
LONG_LITERAL = 26


def incompressible(text: str) -> float:
    """Share of a text that is left when its long literals without blanks are packed, and all else is left out."""
    whole = "".join(x for x in LITERAL.findall(text) if len(x) >= LONG_LITERAL and " " not in x)
    return len(zlib.compress(whole.encode("utf-8", "surrogatepass"), 9)) / len(text) if whole else 0.0


def notice(text: str, docstring: bool) -> bool:
    """Whether a comment anywhere, or a string before the first code, says that the text is a generator's."""
    low = text.lower()
    if "generated" not in low and "produced" not in low and "will be lost" not in low:
        return False
    head = docstring
    for t in TOKEN.findall(text):
        if t[0] == "#" or t[0] == "/" and t[1:2] in ("/", "*"):
            if NOTICE.search(t):
                return True
        elif head and t[0] in "\"'":
            if NOTICE.search(t):
                return True
        else:
            head = False
    return False


def extension(path: Column, content: Column) -> Column:
    """Lower-case extension; of a file without one, ``sh``, ``py`` or ``js`` after its ``#!`` line."""
    base = F.element_at(F.split(F.coalesce(path, F.lit("")), r"[/\\]"), -1)
    ext = F.lower(F.regexp_extract(base, r"\.([^.]*)$", 1))
    line = F.regexp_extract(content, r"^#!([^\r\n]*)", 1)
    return F.when(base.contains("."), ext).otherwise(
        F.when(line.contains("python"), "py").when(line.contains("node"), "js").when(line.rlike(r"sh\b"), "sh")
    )


def _judge():
    import numpy as np

    from siltstone.llm.repair import Batch, common_rules, own_grammar

    def one(ext, text, tokens, chars, literal, ratio):
        """``(kind, evidence)``: what the file's grammar or literals show; only where they don't, what it says of itself."""
        if not tokens or WEB_PAGE.match(text):
            return None, None
        share = literal / max(1, chars)
        if ext in CODE:
            if ext in SCRIPT and len(text) >= LEAST_CHARS and sum(map(text.count, " \n\t\r")) / len(text) < DENSE:
                return "minified", "density"
            if ratio <= REUSE and not text.startswith("---"):
                return "generated", "reuse"
            if share >= 0.45 and ratio <= REUSE_DATA:
                return "data", "reuse"
            if share >= 0.45 and incompressible(text) >= BLOB_CODE:
                return "data", "literals"
            if ext in SCRIPT and '"__esModule"' in text:
                return "generated", "notice"
        elif ext in CONFIG:
            blob = incompressible(text) if share >= 0.3 else 0.0
            if ratio <= REUSE_CONFIG:
                return "generated", "reuse"
            if ext in ("json", "map") and blob >= BLOB_CONFIG or ratio <= REUSE_DATA and blob >= BLOB_LOCK:
                return "generated", "literals"
            if ratio <= 0.85 and ext != "map" and (len(PINS.findall(text)) >= 2 or '"lockfileVersion"' in text) or '"mappings"' in text and '"sources"' in text:
                return "generated", "notice"
        if notice(text, ext == "py"):
            return "generated", "notice"
        return None, None

    def batch(cols):
        for at in range(0, len(cols["file_id"]), BATCH):
            ids, skills, exts, texts = (cols[k][at : at + BATCH] for k in ("file_id", "skill_key", "ext", "content"))
            b = Batch(texts)
            ratio = own_grammar(b.shape, b.file, b.n_files)
            rules: list[list[dict]] = [[] for _ in ids]
            for f, name, w in zip(*(c.tolist() for c in common_rules(b.raw, b.file))):
                rules[f].append({"name": name - (1 << 63), "tokens": w})
            tokens, chars, literal = (x.tolist() for x in (b.tokens, b.chars, b.literal))
            for k, i in enumerate(ids):
                kind, evidence = one(exts[k], texts[k], tokens[k], chars[k], literal[k], ratio[k])
                # only files of code that nothing else gives away need to be compared across repositories; all take part in the count
                yield i, skills[k], kind, evidence, tokens[k], float(np.round(ratio[k], 4)), rules[k] if exts[k] in CODE else []

    return batch


FEATURES = "file_id long, skill_key long, kind string, evidence string, n_tokens long, reuse double, rules array<struct<name: long, tokens: long>>"


def features(skill_file: DataFrame) -> DataFrame:
    """One row per file of code or configuration: its own grammar's verdict and its rules of the common grammar."""
    ext = extension(F.col("path"), F.col("content"))
    src = skill_file.select(
        "file_id", F.xxhash64("skill_name").alias("skill_key"), ext.alias("ext"), F.coalesce("content", F.lit("")).alias("content")
    ).where(F.col("ext").isin(*CODE, *CONFIG, *MARKUP))
    return map_batches(src, _judge, FEATURES)


def machine_made(skill_file: DataFrame) -> DataFrame:
    """``file_id, kind, evidence, reuse, shared``: the files that their skill's authors did not type.

    ``kind`` is generated, minified, data or third-party; ``evidence`` is what
    shows it: reuse of rules, incompressible literals, density, rules shared
    across skills, or (notice) what the file says of itself where its grammar
    shows nothing. Where a file lies doesn't matter. ``shared`` is the share
    of a file's tokens in rules that another skill has too (null where a file is
    given away without it). A rule's skills are counted by their smallest and
    largest key, so a rule that stands in a third of all files costs no more
    than any other. Null paths and contents count as empty; empty files are
    hand-written; repeated rows count on their own.
    """
    f = checkpoint(features(skill_file))
    rules = f.select("file_id", "skill_key", "n_tokens", "kind", F.explode("rules").alias("r")).select(
        "file_id", "skill_key", "n_tokens", "kind", "r.name", "r.tokens"
    )
    common = rules.groupBy("name").agg(F.min("skill_key").alias("a"), F.max("skill_key").alias("b")).where("a <> b").select("name")
    shared = (
        rules.where("kind IS NULL")
        .join(common, "name", "left_semi")
        .groupBy("file_id")
        .agg((F.sum("tokens") / F.greatest(F.lit(1), F.max("n_tokens"))).alias("shared"))
        .where(F.col("shared") >= SHARED)
    )
    own = f.where("kind IS NOT NULL").select("file_id", "kind", "evidence", "reuse", F.lit(None).cast("double").alias("shared"))
    return own.unionByName(
        shared.select("file_id", F.lit("third-party").alias("kind"), F.lit("shared rules").alias("evidence"), F.lit(None).cast("double").alias("reuse"), "shared")
    )


def kinds_by_language(skill_file: DataFrame, found: DataFrame) -> DataFrame:
    """Files and bytes of each kind per extension; ``hand-written`` for what remains."""
    ext = F.coalesce(extension(F.col("path"), F.col("content")), F.lit(""))
    files = skill_file.select("file_id", ext.alias("ext"), F.octet_length("content").alias("n"))
    return (
        files.join(found.select("file_id", "kind"), "file_id", "left")
        .groupBy("ext", F.coalesce("kind", F.lit("hand-written")).alias("kind"))
        .agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_bytes"))
    )
