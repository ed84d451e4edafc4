"""What is kept between scans: baselines and the scan cache, as tables that are rewritten whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86400.0


def latest(baselines: DataFrame) -> DataFrame:
    """The newest baseline of each package: by scan time, then delivery, then id. Packages without a name have none."""
    order = F.struct("scan_time", "delivered_at", "baseline_id")
    cols = [F.max_by(c, order).alias(c) for c in baselines.columns if c != "skill_name"]
    return baselines.where("skill_name IS NOT NULL AND scan_time IS NOT NULL").groupBy("skill_name").agg(*cols)


def baseline_upsert(current: DataFrame, new: DataFrame, levels: tuple[str, ...] = ("LOW", "MEDIUM")) -> DataFrame:
    """``current`` (a row a package) with the packages of ``new`` put in their place, where their risk level allows it.

    A new row of any other level, or of none, leaves the old one as it is.
    """
    ok = new.where(F.col("risk_level").isin(*levels)).select(current.columns)
    return current.join(ok.select("skill_name"), "skill_name", "left_anti").select(current.columns).unionByName(ok)


def baseline_list(baselines: DataFrame) -> DataFrame:
    """``skill_name, n_baselines, last_scan, last_level``."""
    order = F.struct("scan_time", "delivered_at", "baseline_id")
    return baselines.where("skill_name IS NOT NULL").groupBy("skill_name").agg(
        F.count(F.lit(1)).alias("n_baselines"), F.max("scan_time").alias("last_scan"), F.max_by("risk_level", order).alias("last_level")
    )


def baseline_remove(baselines: DataFrame, names: DataFrame) -> DataFrame:
    """Baselines without those of the named packages (``skill_name``)."""
    return baselines.join(names.select("skill_name").distinct(), "skill_name", "left_anti")


def readable(result: Column) -> Column:
    return F.try_parse_json(result).isNotNull()


def cache_get(entries: DataFrame) -> DataFrame:
    """The newest entry of each package folder whose result can be read: ``skill_path, entry_id, entry_timestamp``."""
    ok = entries.where(F.col("skill_path").isNotNull() & F.col("entry_timestamp").isNotNull() & readable(F.col("result")))
    path = F.regexp_replace("skill_path", "/+$", "")
    order = F.struct("entry_timestamp", "entry_id")
    return ok.groupBy(path.alias("skill_path")).agg(F.max_by("entry_id", order).alias("entry_id"), F.max("entry_timestamp").alias("entry_timestamp"))


def cache_expire(entries: DataFrame, now: float, days: float = 7) -> DataFrame:
    """Entries not older than ``days``; those without a time are as old as can be."""
    return entries.where(F.lit(now) - F.col("entry_timestamp") <= days * DAY)


def cache_invalidate(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """Entries without those of the given package folders (``skill_path``, a closing slash aside)."""
    p = paths.select(F.regexp_replace("skill_path", "/+$", "").alias("_p")).distinct()
    return entries.join(p, F.regexp_replace("skill_path", "/+$", "") == F.col("_p"), "left_anti")


def cache_statistics(entries: DataFrame) -> DataFrame:
    """``n_entries, n_packages, n_bytes, n_unreadable, oldest, newest``: one row."""
    return entries.agg(
        F.count(F.lit(1)).alias("n_entries"), F.count_distinct(F.regexp_replace("skill_path", "/+$", "")).alias("n_packages"), F.coalesce(F.sum(F.octet_length("result")), F.lit(0)).alias("n_bytes"),
        F.count_if(~readable(F.col("result")) | F.col("result").isNull()).alias("n_unreadable"), F.min("entry_timestamp").alias("oldest"), F.max("entry_timestamp").alias("newest"),
    )
