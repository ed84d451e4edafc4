"""Texts for readers: summaries, look-ups by category and level, rankings and renderings of bounded size."""

from __future__ import annotations

import html
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.line_rules import severity_rank

# Level -> order in a batch.
LEVEL_ORDER = ["EXTREME", "HIGH", "MEDIUM", "LOW", "SAFE", "ERROR"]
# Words that must all occur -> what a finding means in plain language; in order.
PLAIN = [
    (("base64", "decode", "execute"), "Execute hidden malicious commands (like letting someone secretly control your computer)"),
    (("persistence", "launchctl", "startup"), "Establish persistent control (survives system reboot)"),
    (("credential", "password", "theft"), "Steal your passwords and authentication tokens"),
    (("reverse_shell", "backdoor"), "Allow attackers to remotely control your computer"),
    (("threat intel", "known malicious"), "This skill has been confirmed as malware by security researchers"),
    (("exfiltration", "exfil", "send"), "Secretly send data to attackers"),
    (("downloader", "dropper"), "Download malicious programs from the internet and execute them"),
    (("backdoor", "后门"), "Leave a hidden entry point for attackers to access anytime"),
    (("trojan", "特洛伊"), "Disguise as normal software while doing malicious things"),
    (("hook", "hooking", "hijack"), "Hijack the execution flow of other programs"),
]
ADVICE = {
    "encoded_command": "Don't run commands that are decoded first.",
    "suspicious_download": "Check where the download comes from; avoid bare addresses and short links.",
    "executable_delivery": "Don't download or run executables of unknown origin.",
    "credential_harvesting": "Don't paste credentials because a document says so.",
    "urgency": "Be wary of instructions that press for time.",
    "fake_output": "Logs of success in a document may be made up.",
    "prompt_injection": "The document tries to override the system's instructions.",
    "supply_chain": "The prerequisites download or run something unofficial.",
    "credential_theft": "Stop the installation and change the credentials concerned.",
}
OTHER_ADVICE = "Have a person look at this finding."
#: kind of finding -> title, risk, what to do
REMEDIES = {
    "base64_decode_execute": ("Decoded and run", "May hide malicious code and do unknown harm", "Look at what it decodes to before running it"),
    "credential_theft": ("Theft of credentials", "May take keys, cloud credentials or a browser's passwords", "Remove the code that reads them; authenticate by environment or a key service"),
    "reverse_shell": ("Reverse shell", "Lets an attacker control the machine", "Remove it; use a proper tool for remote work"),
    "prompt_injection": ("Prompt injection", "May get round the system's limits", "Check and clean what users put in"),
    "exfiltration": ("Exfiltration", "May send sensitive data to other servers", "Remove the transfer or check its target against a list"),
}
LEVELS = {
    "EXTREME": ("Severe risk: credentials may leak, the system may be taken over", "red", "Stop using it and check all configuration"),
    "HIGH": ("High risk: weaknesses that can be exploited", "yellow", "Mend what is high before using it"),
    "MEDIUM": ("Medium risk: better mended", "orange", "Weigh the risk before using it"),
    "LOW": ("Low risk: slight matters", "blue", "Can be used"),
    "SAFE": ("No visible risk", "green", "Safe to use"),
}


def _lookup(table: dict[str, str], key: Column, other: Column | None = None) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, key), F.lit(None) if other is None else other)


def advice(category: Column) -> Column:
    """What to do about a finding of a category."""
    return _lookup(ADVICE, category, F.lit(OTHER_ADVICE))


def remedy(kind: Column) -> list[Column]:
    """Title, risk and remedy of a kind of finding; null for others."""
    return [_lookup({k: v[i] for k, v in REMEDIES.items()}, kind).alias(n) for i, n in enumerate(("title", "risk", "fix"))]


def risk_details(scores: DataFrame) -> DataFrame:
    """``pkg_id, score, level, description, colour, recommendation``; below 5 SAFE."""
    lv = F.when(F.col("score") >= 80, "EXTREME").when(F.col("score") >= 50, "HIGH").when(F.col("score") >= 20, "MEDIUM").when(F.col("score") >= 5, "LOW").otherwise("SAFE")
    s = scores.select("pkg_id", "score", lv.alias("level"))
    return s.select("*", *[_lookup({k: v[i] for k, v in LEVELS.items()}, F.col("level")).alias(n) for i, n in enumerate(("description", "colour", "recommendation"))])


def plain_language(title: Column, description: Column) -> Column:
    """The first entry all of whose words occur in title and description, else the description."""
    t = F.lower(F.concat_ws(" ", title, description))
    return F.coalesce(*[F.when(reduce(lambda a, b: a & b, [F.contains(t, F.lit(w)) for w in words]), F.lit(text)) for words, text in PLAIN], description)


def summary_sentence(scores: DataFrame) -> DataFrame:
    """``pkg_id, summary``: what was found, in a sentence."""
    n = lambda c, word: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {word}")))
    end = F.when(F.col("level").isin("EXTREME", "HIGH"), " Don't install.").when(F.col("level") == "MEDIUM", " Review before installing.").otherwise("")
    some = F.concat(F.col("n_findings").cast("string"), F.lit(" findings"), F.when((F.col("n_critical") > 0) | (F.col("n_high") > 0), F.concat(F.lit(": "), F.concat_ws(", ", n("n_critical", "critical"), n("n_high", "high")))).otherwise(""), F.lit("."), end)
    return scores.select("pkg_id", F.when(F.col("n_findings") == 0, "Nothing found.").otherwise(some).alias("summary"))


def max_severity(found: DataFrame, least: str = "SAFE") -> DataFrame:
    """``pkg_id, severity, n``: the highest severity of a package's findings of at least ``least``, and how many those are."""
    f = found.where(severity_rank(F.col("severity")) >= severity_rank(F.lit(least)))
    return f.groupBy("pkg_id").agg(F.max_by("severity", severity_rank(F.col("severity"))).alias("severity"), F.count(F.lit(1)).alias("n"))


def batch_order(level: Column) -> Column:
    """Place of a level in a batch's listing; unknown ones come last."""
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in LEVEL_ORDER]), level), F.lit(0)).cast("int") % (len(LEVEL_ORDER) + 1) + F.when(level.isin(*LEVEL_ORDER), 0).otherwise(len(LEVEL_ORDER) + 1)


def listing(scores: DataFrame, most: int = 1000) -> list[dict]:
    """The batch's packages, worst level first, then by name: a report's limit."""
    return [r.asDict() for r in scores.orderBy(batch_order(F.col("level")), "pkg_id").limit(most).collect()]


def to_html(scores: DataFrame, most: int = 200) -> str:
    """A table of the worst packages as a page."""
    head = ["pkg_id", "level", "score", "n_findings"]
    rows = "".join("<tr>" + "".join(f"<td>{html.escape(str(r[k]))}</td>" for k in head) + "</tr>" for r in listing(scores, most))
    return f"<!doctype html><meta charset=utf-8><title>Scan</title><table><tr>{''.join(f'<th>{k}</th>' for k in head)}</tr>{rows}</table>"


def write_report(scores: DataFrame, path: str, form: str = "parquet") -> None:
    """All scores as a table (parquet, csv or json lines), one file a partition."""
    scores.write.mode("overwrite").format(form).save(path)


def histogram(found: DataFrame) -> str:
    """Findings per severity as text bars; at most six rows come to the driver."""
    rows = sorted(found.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r.severity)
    most = max((r.n for r in rows), default=1)
    return "\n".join(f"{r.severity:9}{'#' * max(1, 40 * r.n // most)} {r.n}" for r in rows)


def deep_review_task(found: DataFrame, f: DataFrame, most: int = 10, around: int = 20) -> str:
    """The ``most`` highest findings with the lines around them, as JSON for a reviewer: a report's limit."""
    top = found.where("file_path IS NOT NULL").orderBy(-severity_rank(F.col("severity")), "finding_id").limit(most)
    n = F.coalesce("line_number", F.lit(1))
    first = F.greatest(F.lit(1), n - around)
    code = F.array_join(F.slice(F.split("text", "\n", -1), first, n + around - first + 1), "\n")
    texts = f.groupBy("pkg_id", F.col("rel_path").alias("file_path")).agg(F.min("file_id").alias("file_id"))
    rows = top.join(texts, ["pkg_id", "file_path"]).join(f.select("file_id", "text"), "file_id").select("finding_id", "rule_id", "severity", "pkg_id", "file_path", "line_number", code.alias("code")).collect()
    return json.dumps([r.asDict() for r in sorted(rows, key=lambda r: r.finding_id)], ensure_ascii=False)
