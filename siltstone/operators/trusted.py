"""Lists of what is trusted, from a file and as predicates; and files whose content an earlier audit has seen."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.sources.packages import glob_regex

# The sets of a list's file.
SETS = ["trusted_skills", "trusted_domains", "trusted_ips", "safe_functions", "safe_paths", "exempt_rules", "trusted_authors"]


def read_lists(path: str) -> dict[str, list[str]]:
    """The seven sets of a JSON file, sorted; empty ones where it lacks them or can't be read. They are small by nature: people keep them."""
    try:
        data = json.loads(Path(path).read_text("utf-8"))
    except (OSError, ValueError):
        data = {}
    data = data if isinstance(data, dict) else {}
    return {k: sorted({str(x) for x in data.get(k) or []}) for k in SETS}


def write_lists(lists: dict[str, list[str]], path: str) -> None:
    Path(path).write_text(json.dumps({k: sorted(set(lists.get(k, []))) for k in SETS}, ensure_ascii=False, indent=1), "utf-8")


def _among(c: Column, xs: list[str]) -> Column:
    return c.isin(*xs) if xs else F.lit(False)


def domain_trusted(domain: Column, trusted: list[str]) -> Column:
    """The domain itself or one above it is trusted, case aside; a null one isn't."""
    d = F.lower(domain)
    return F.coalesce(reduce(lambda a, b: a | b, [d.endswith(f".{t}") for t in trusted], _among(d, trusted)), F.lit(False))


def function_safe(name: Column, safe: list[str]) -> Column:
    """The function is safe with its module or by its last name."""
    return F.coalesce(_among(name, safe) | _among(F.element_at(F.split(name, r"\."), -1), safe), F.lit(False))


def path_safe(path: Column, globs: list[str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [path.rlike(glob_regex(g)) for g in globs], F.lit(False)), F.lit(False))


def without_exempt(found: DataFrame, rules: list[str]) -> DataFrame:
    """Findings without those of exempt rules."""
    return found.where(~_among(F.col("rule_id"), rules)) if rules else found


def audit_key(path: Column, text: Column) -> Column:
    """``path:`` and the first 16 digits of the content's SHA-256."""
    return F.concat(F.coalesce(path, F.lit("")), F.lit(":"), F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16))


def to_audit(f: DataFrame, cache: DataFrame, now: float, hours: float = 24) -> DataFrame:
    """The files that no cache entry (``key, cached_at`` in seconds) younger than ``hours`` answers for."""
    young = cache.where(F.lit(now) - F.col("cached_at") < hours * 3600).select("key").distinct()
    return f.withColumn("key", audit_key(F.col("rel_path"), F.col("text"))).join(young, "key", "left_anti").drop("key")
