"""Rule and intelligence files in place of the bundled packs: read on the driver, as they are small by nature."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from siltstone.rules import packs


def _scalar(t: str) -> str:
    t = t.strip()
    if t[:1] == "'" and t[-1:] == "'" and len(t) > 1:
        return t[1:-1].replace("''", "'")
    if t[:1] == '"' and t[-1:] == '"' and len(t) > 1:
        return json.loads(t) if "\\" not in t or re.fullmatch(r'"(?:[^"\\]|\\["\\/bfnrtu])*"', t) else t[1:-1]
    return t


def _plain(text: str) -> list[dict]:
    """Rules of a YAML file in block style: a list of mappings with scalars and lists of scalars, for hosts without a YAML library."""
    rules: list[dict] = []
    category, rule, key, dash = "", None, "", 0
    for line in text.splitlines():
        body = line.strip()
        if not body or body[0] == "#":
            continue
        col = len(line) - len(line.lstrip())
        m = re.match(r"(- )?\s*([A-Za-z_]\w*):(?:\s+(.*))?$", body)
        if col == 0 and m and not m.group(1):
            category, rule = m.group(2), None
        elif m and m.group(1) and (rule is None or col <= dash):
            rule, dash, key = {"category": category, m.group(2): _scalar(m.group(3) or "")}, col, m.group(2)
            rules.append(rule)
        elif rule is not None and body.startswith("- ") and isinstance(rule.get(key), list):
            rule[key].append(_scalar(body[2:]))
        elif rule is not None and m and col > dash:
            key = m.group(2)
            rule[key] = _scalar(m.group(3)) if m.group(3) else []
    return [r for r in rules if r.get("id") and r.get("patterns")]


def read_rules(path: str) -> list[tuple[str, str, str, str, list[str]]]:
    """``(id, category, severity, cwe, patterns)`` of a rule file (YAML or JSON: category -> rules); the bundled pack where there is none or it can't be read.

    A rule whose patterns don't compile is left out.
    """
    try:
        text = Path(path).read_text("utf-8")
        if path.endswith(".json"):
            data = json.loads(text)
            rows = [{"category": c, **r} for c, x in data.items() for r in (x["rules"] if isinstance(x, dict) else x)]
        else:
            rows = _plain(text)
    except (OSError, ValueError, KeyError, TypeError):
        return packs.STATIC
    out = []
    for r in rows:
        good = []
        for p in r.get("patterns", []):
            try:
                re.compile(p)
                good.append(p)
            except re.error:
                continue
        if good:
            out.append((r["id"], r["category"], r.get("severity", "MEDIUM"), r.get("cwe", ""), good))
    return out or packs.STATIC


def read_intel(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables ``names, typos, authors, iocs`` of an intelligence file (JSON of lists); empty ones where it has none or can't be read."""
    try:
        data = json.loads(Path(path).read_text("utf-8"))
    except (OSError, ValueError):
        data = {}
    get = lambda *ks: next(([str(x) for x in data[k]] for k in ks if isinstance(data.get(k), list)), [])
    return {
        "names": spark.createDataFrame([(x,) for x in get("known_malicious_names", "names")], "name string"),
        "typos": spark.createDataFrame(list(enumerate(get("typosquat_patterns", "typos"))), "ord int, pattern string"),
        "authors": spark.createDataFrame([(x,) for x in get("malicious_authors", "authors")], "author string"),
        "iocs": spark.createDataFrame([(x,) for x in get("ioc_domains", "iocs")], "ioc string"),
    }


def intel_statistics(tables: dict[str, DataFrame]) -> dict[str, int]:
    """Sizes of the intelligence tables."""
    return {k: t.count() for k, t in tables.items()}
