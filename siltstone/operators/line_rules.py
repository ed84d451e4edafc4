"""Line-rule operators: static rules with context, signatures, documents, probes, quick assessment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import fence_ranges, front_matter_end, lines, pinned, tagged
from siltstone.rules import packs
from siltstone.rules.fold import JAVA, any_of, folded, gate, literal, looks_around, pick
from siltstone.sources.packages import for_engine, reference_json

_STATIC = [(r[0], r[1], r[2], r[3], p) for r in packs.STATIC for p in r[4]]
#: Those that SQL can hold; in STATIC_ALL the rest stand behind them, so that both number alike.
STATIC_PATTERNS = [p for p in _STATIC if not looks_around(p[4])]
STATIC_ALL = STATIC_PATTERNS + [p for p in _STATIC if looks_around(p[4])]
SIG_PATTERNS = [(r[0], r[1], r[2], p) for r in packs.SIGNATURES for p in r[4]]
DOC_TEXT = ["md", "txt", "rst"]
SHELL = ["sh", "bash", "zsh"]


def severity_rank(c: Column) -> Column:
    """0 (SAFE) to 5 (CRITICAL); unknown spellings count as INFO."""
    up = F.upper(F.trim(c))
    return F.coalesce(F.when(up.isin(*packs.SEVERITY), F.array_position(F.array(*[F.lit(s) for s in packs.SEVERITY]), up).cast("int") - 1), F.lit(1))


def candidates(f: DataFrame, patterns: list[str]) -> DataFrame:
    """Files that may match, with ``cand``: the numbers of the patterns in question."""
    low = pinned(f, "_low", folded(F.col("text")))
    return pinned(low, "cand", gate("_low", patterns)).drop("_low").where(F.size("cand") > 0)


def line_hits(src: DataFrame, patterns: list[str], keep: list[str], context: int = 0, flags: str = JAVA) -> DataFrame:
    """``keep, ix, line_no, line`` of every hit, with ``ctx`` (lines around) where ``context`` asks for it.

    A file's lines are searched only with its candidate patterns, and lines
    without a hit never become rows; a hit carries its own context, never the file.
    """
    x = pinned(src, "_ls", lines(F.col("text")))
    x = pinned(x, "_nl", F.transform("_ls", lambda v, i: F.struct((i + 1).alias("line_no"), v.alias("line"))))

    ctx = f", 'ctx', slice(_ls, greatest(1, r.line_no - {context}), least(r.line_no + {context}, size(_ls)) - greatest(1, r.line_no - {context}) + 1)" if context else ""
    found = [
        f"CASE WHEN array_contains(cand, {k}) THEN transform(filter(_nl, r -> rlike(r.line, {literal(flags + p)})), r -> named_struct('ix', {k}, 'line_no', r.line_no, 'line', r.line{ctx})) END"
        for k, p in enumerate(patterns)
    ]
    per = F.flatten(F.expr(f"array_compact(array({', '.join(found)}))"))
    return x.select(*keep, F.explode(per).alias("_h")).select(*keep, "_h.*")


def static_hits(f: DataFrame, context: bool = False) -> DataFrame:
    """Every hit of every pattern on every line: ``file_id, pkg_id, rel_path, line_no, rule_id, category, severity, cwe_id, pattern_ix``."""
    pats = [p[4] for p in STATIC_ALL]
    keep = ["file_id", "pkg_id", "rel_path", "name", "ext"]
    src = candidates(for_engine(f, "static"), pats)
    if context:
        src = pinned(pinned(src, "fences", fence_ranges(lines(F.col("text")))), "front", front_matter_end(lines(F.col("text"))))
        keep += ["fences", "front"]
    rows = line_hits(src, pats, keep, 4 if context else 0)
    return rows.select(
        "*",
        *[pick([p[k] for p in STATIC_ALL], "ix").alias(n) for k, n in ((0, "rule_id"), (1, "category"), (2, "severity"), (3, "cwe_id"))],
        F.col("ix").alias("pattern_ix"),
    ).drop("ix")


def in_fence() -> Column:
    n = F.col("line_no")
    return F.col("ext").isin(*DOC_TEXT) & F.exists("fences", lambda r: (n > r["a"]) & (n < r["b"]))


def in_front_matter() -> Column:
    return F.col("ext").isin(*DOC_TEXT) & (F.col("line_no") <= F.col("front"))


def rule_definition() -> Column:
    """The line speaks about rules rather than acts: reference data, comments, headings, teaching examples, rule fields."""
    s = F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))
    shell = F.col("ext").isin(*SHELL) & (s.startswith("#") | s.startswith('echo "') | s.startswith("echo '"))
    ctx = F.col("ctx")
    text = F.array_join(ctx, "\n")
    open_fences = F.size(F.filter(ctx, lambda x: F.trim(x).rlike(r"^(`{3,}|~{3,})")))
    bare_fence = F.exists(ctx, lambda x: x.rlike(r"^(`{3,}|~{3,})\w*\s*$"))
    before = F.array_join(F.slice(ctx, 1, F.greatest(F.lit(1), F.floor(F.size(ctx) / 2).cast("int"))), "\n")
    doc = F.col("ext").isin(*DOC_TEXT) & (
        s.rlike(r"^(?:[-*+] |>|#|\||```|~~~)") | (bare_fence & (open_fences % 2 == 1)) | before.rlike(JAVA + any_of(packs.TEACHING))
    )
    markers = s.rlike(JAVA + any_of(packs.RULE_MARKERS))
    structure = reduce(lambda a, b: a + b, [text.rlike(JAVA + p).cast("int") for p in packs.STRUCTURE_MARKERS]) >= 2
    return reference_json(F.col("name")) | shell | doc | markers | structure


def exempt() -> Column:
    """Hardening commands, comments, and files that name themselves scanners."""
    s = F.trim("line")
    shell = F.col("ext").isin(*SHELL) & (s.rlike(r"^chmod\s+[017][0-7]{2}\s+") | s.startswith("chown ") | s.startswith("sudo chown "))
    return shell | s.startswith("#") | s.startswith("//") | security_tool(F.col("name"))


def static_findings(f: DataFrame) -> DataFrame:
    """Hits that context doesn't explain away, with evidence."""
    h = static_hits(f, context=True).where(~in_fence() & ~in_front_matter() & ~rule_definition() & ~exempt())
    return h.select(
        "file_id", "pkg_id", "rel_path", "line_no", "rule_id", "category", "severity", "cwe_id", "pattern_ix",
        F.substring(F.trim("line"), 1, 300).alias("matched_text"),
        evidence().alias("evidence"),
    )


def evidence(most: int = 600) -> Column:
    """Numbered context lines, cut to ``most`` characters."""
    first = F.greatest(F.lit(1), F.col("line_no") - 4)
    return F.substring(F.array_join(F.transform("ctx", lambda x, i: F.concat_ws(": ", (first + i).cast("string"), x)), "\n"), 1, most)


def signature_findings(f: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Case-sensitive signatures by file type; an exclude pattern on the line silences its rule; first per rule, file and line."""
    rules = packs.SIGNATURES
    pats = [p[3] for p in SIG_PATTERNS]
    kind = F.when(F.col("ext").isin("sh", "bash", "zsh"), "sh").when(F.col("ext").isin("js", "mjs"), "js").otherwise(F.col("ext"))
    src = f.withColumn("kind", kind).where(F.col("kind").isin("py", "js", "ts", "sh"))
    src = candidates(src, pats)
    keep = keep or []
    rows = line_hits(src, pats, ["file_id", "pkg_id", "rel_path", "kind", *keep], flags="(?d)")
    rule_of = [n for n, r in enumerate(rules) for _ in r[4]]
    rows = rows.withColumn("rule", pick(rule_of, "ix"))
    ok = reduce(
        lambda a, b: a | b,
        [(F.col("rule") == n) & F.col("kind").isin(*r[3]) & ~F.col("line").rlike("(?d)" + any_of(r[5])) for n, r in enumerate(rules)],
    )
    rows = rows.where(ok).groupBy("file_id", "pkg_id", "rel_path", "line_no", "rule", *keep).agg(F.count(F.lit(1)).alias("n_patterns"))
    return rows.select(
        "file_id", "pkg_id", "rel_path", "line_no", *keep,
        *[pick([r[k] for r in rules], "rule").alias(n) for k, n in ((0, "rule_id"), (1, "category"), (2, "severity"))],
    )


TRUSTED_LINE = any_of([t.replace(".", r"\.") for t in packs.TRUSTED])


def trusted_suppression(f: DataFrame) -> DataFrame:
    """Signature findings without the EXFIL ones of files that name a trusted domain and an authorization word."""
    t = f.withColumn("trusted", F.lower("text").rlike(TRUSTED_LINE) & F.lower("text").rlike("authorization|api_key|bearer"))
    return signature_findings(t, ["trusted"]).where(~(F.col("trusted") & F.col("rule_id").startswith("EXFIL"))).drop("trusted")


#: Category, severity, pattern and place in scan order; the number here is the pattern_ix.
DOC_PATTERNS = [(*p, 2 * k + 1) for k, p in enumerate(packs.DOCUMENT)] + [(*p, 2 * k) for k, *p in packs.DOCUMENT_AHEAD]


def document_hits(f: DataFrame) -> DataFrame:
    """Social-engineering patterns per line of documents; ``place`` is the pattern's in scan order."""
    pats = [p[2] for p in DOC_PATTERNS]
    rows = line_hits(candidates(for_engine(f, "documents"), pats), pats, ["file_id", "pkg_id", "rel_path"])
    return rows.select("file_id", "pkg_id", "rel_path", "line_no", "line", F.col("ix").alias("pattern_ix"), *[pick([p[k] for p in DOC_PATTERNS], "ix").alias(n) for k, n in ((0, "category"), (1, "severity"), (3, "place"))])


CATEGORIES = list(dict.fromkeys(p[0] for p in packs.DOCUMENT))


def document_findings(f: DataFrame) -> DataFrame:
    """One finding per file and category.

    The first hit in scan order (pattern, line) makes it; the severest one gives
    severity and line (the earliest among equals). ``ordinal`` numbers a file's
    findings in the order of their first hits.
    """
    h = document_hits(f).withColumn("rank", severity_rank(F.col("severity")))
    best = F.struct(-F.col("rank"), "place", "line_no")
    g = h.groupBy("file_id", "pkg_id", "rel_path", "category").agg(
        F.min(F.struct("place", "line_no")).alias("first"), F.min_by(F.struct("severity", "line_no"), best).alias("best")
    )
    return g.select(
        "file_id", "pkg_id", "rel_path", "category", F.col("best.severity").alias("severity"), F.col("best.line_no").alias("line_no"),
        F.row_number().over(W.partitionBy("file_id").orderBy("first")).alias("ordinal"),
    )


def security_tool(name: Column) -> Column:
    """Whether a file's name is that of a security tool."""
    return F.lower(name).rlike("scanner|analyzer|detector|audit|security")


def probe_hits(f: DataFrame, skip_rule_lines: bool = False) -> DataFrame:
    """Prompt probes over whole texts: ``file_id, pkg_id, rule_id, category, severity, matched`` for each occurrence.

    ``skip_rule_lines`` blanks the lines of security tools' files that define rules.
    """
    if skip_rule_lines:
        code = F.array_join(F.transform(lines(F.col("text")), lambda x: F.when(F.trim(x).rlike(JAVA + any_of(packs.RULE_LINE)), "").otherwise(x)), "\n")
        f = f.withColumn("text", F.when(security_tool(F.col("name")), code).otherwise(F.col("text")))
    pats = [p[3] for p in packs.PROBES]
    src = candidates(for_engine(f, "probes"), pats)
    per = [
        F.when(F.array_contains("cand", k), F.regexp_extract_all("text", F.lit(JAVA + p), F.lit(0))).otherwise(F.array().cast("array<string>"))
        for k, p in enumerate(pats)
    ]
    all_ = F.concat(*[tagged(x, "ix", k, "matched") for k, x in enumerate(per)])
    return src.select("file_id", "pkg_id", F.explode(all_).alias("h")).select(
        "file_id", "pkg_id", *[pick([p[k] for p in packs.PROBES], "h.ix").alias(n) for k, n in ((0, "rule_id"), (1, "category"), (2, "severity"))], "h.matched"
    )


def quick_score(text: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.when(text.rlike(JAVA + p), F.lit(w)).otherwise(0) for _, w, p in packs.QUICK])


def quick_assessment(f: DataFrame) -> DataFrame:
    """Weights of the patterns in a text of more than 100 characters, each once, and the level they make."""
    s = f.where(F.length("text") > 100).select("file_id", quick_score(F.col("text")).alias("score"))
    level = F.when(F.col("score") < 25, "LOW").when(F.col("score") < 50, "MEDIUM").when(F.col("score") < 75, "HIGH").otherwise("CRITICAL")
    return s.withColumn("level", level).withColumn("needs_review", F.col("score") >= 25)
