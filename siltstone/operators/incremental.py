"""Process only what no successful run has seen.

Two surfaces. ``unseen_versions`` derives the manifest of processed versions
from the noted runs and anti-joins the feed against it. ``IncrementalRun`` keeps
a manifest table of its own and runs a job exactly once per version: fix the batch,
write under an id of its own, then commit that under the batch id, if absent.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.paths import clean_dir, clean_path

VERSION = ["skill_path", "path", "sha256"]


def last_success(cache_entry: DataFrame) -> DataFrame:
    """``skill_path, started`` (microseconds): the latest start of a successful run.

    A run succeeded if ``result`` is readable JSON whose ``status`` is ``ok``.
    Runs without a time or path can't have seen anything and are ignored.
    """
    start = F.round((F.col("entry_timestamp") - F.coalesce(F.col("scan_time"), F.lit(0.0))) * 1e6).cast("long")
    status = F.try_variant_get(F.try_parse_json("result"), "$.status", "string")
    return (
        cache_entry.where(status == "ok")
        .select(clean_dir(F.col("skill_path")).alias("skill_path"), start.alias("started"))
        .where(F.col("started").isNotNull() & F.col("skill_path").isNotNull())
        .groupBy("skill_path")
        .agg(F.max("started").alias("started"))
    )


def listing(file_hash: DataFrame) -> DataFrame:
    """One row per version: key, smallest record_id, first arrival, size."""
    return (
        file_hash.select(
            clean_dir(F.col("skill_path")).alias("skill_path"),
            clean_path(F.col("path")).alias("path"),
            F.lower("sha256").alias("sha256"),
            "record_id",
            F.unix_micros("delivered_at").alias("arrived"),
            "size",
        )
        .groupBy(*VERSION)
        .agg(F.min("record_id").alias("record_id"), F.min("arrived").alias("arrived"), F.max("size").alias("size"))
    )


def manifest_of_runs(versions: DataFrame, runs: DataFrame) -> DataFrame:
    """Versions that some successful run has seen, with checksum and size: the manifest of processed inputs."""
    return (
        versions.join(runs, "skill_path")
        .where(F.col("arrived") < F.col("started"))
        .select(*VERSION, "size")
    )


def unseen_versions(file_hash: DataFrame, cache_entry: DataFrame) -> DataFrame:
    """``record_id, skill_path, path, sha256, size`` of each version that no successful run has seen.

    Nulls in a key column are values of their own; a version without any
    arrival time can't have been seen. Repeated rows count once, under the
    smallest record_id. Empty tables give an empty result or, without runs,
    every version.
    """
    versions = listing(file_hash)
    done = manifest_of_runs(versions, last_success(cache_entry))
    v, m = versions.alias("v"), done.alias("m")
    same = [F.col(f"v.{c}").eqNullSafe(F.col(f"m.{c}")) for c in VERSION]
    # a manifest row never has a null skill_path, so plain equality on it lets Spark hash on the key
    left = v.join(m, (F.col("v.skill_path") == F.col("m.skill_path")) & same[1] & same[2], "left_anti")
    return left.select("record_id", *VERSION, "size")


class IncrementalRun:
    """Exactly-once batches over a growing table, for a manifest in a shared folder.

    Layout under ``root``: ``data/run=<id>/`` results and ``manifest/run=<id>/``
    keys done, each written by one run only; ``commits/<batch>.json`` names the
    run that made a batch. A commit is created if absent, so of two runs for
    the same batch one wins and the other's files count for nothing, whenever
    it dies or ends. ``snapshots/<batch>.json`` names a manifest that holds all
    up to a batch (``compact``), so that a long history is read as one table.
    """

    GRACE = 30  # seconds after which a commit without content counts as that of a dead run

    def __init__(self, spark: SparkSession, root: str, key: list[str]):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        jvm = spark.sparkContext._jvm
        self._path, self._io = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> dict[int, str]:
        """Batch -> run of all commits (or snapshots)."""
        p = self._path(f"{self.root}/{kind}")
        if not self._fs.exists(p):
            return {}
        out = {}
        for s in self._fs.listStatus(p):
            at = s.getPath()
            if not at.getName().endswith(".json") or at.getName().startswith("."):
                continue
            end = time.time() + self.GRACE
            while not (text := self._content(at)) and time.time() < end:
                time.sleep(0.2)
            if text:
                out[int(at.getName()[:-5])] = json.loads(text)["run"]
            else:
                self._fs.delete(at, False)
        return out

    def _content(self, at) -> str:
        i = self._fs.open(at)
        try:
            return self._io.toString(i, "UTF-8")
        finally:
            i.close()

    def _create(self, kind: str, batch: int, run: str) -> None:
        from py4j.protocol import Py4JJavaError

        try:
            out = self._fs.create(self._path(f"{self.root}/{kind}/{batch}.json"), False)
        except Py4JJavaError as e:
            raise RuntimeError(f"batch {batch} was committed by another run") from e
        out.write(bytearray(json.dumps({"batch": batch, "run": run}).encode()))
        out.close()

    def committed(self) -> list[int]:
        return sorted(self._names("commits"))

    def manifest(self) -> DataFrame | None:
        done, short = self._names("commits"), self._names("snapshots")
        upto = max(short, default=0)
        runs = [short[upto]] if short else []
        runs += [r for b, r in sorted(done.items()) if b > upto]
        return self.spark.read.parquet(*[f"{self.root}/manifest/run={r}" for r in runs]) if runs else None

    def results(self) -> DataFrame | None:
        """What all committed batches wrote, with ``batch``."""
        done = self._names("commits")
        if not done:
            return None
        d = self.spark.read.option("basePath", f"{self.root}/data").parquet(*[f"{self.root}/data/run={r}" for r in done.values()])
        return d.join(self.spark.createDataFrame(list(done.items()), "batch int, run string"), "run").drop("run")

    def pending(self, listing: DataFrame) -> DataFrame:
        """Rows of ``listing`` (unique by key) that no committed batch holds."""
        m = self.manifest()
        if m is None:
            return listing
        a, b = listing.alias("a"), m.select(*self.key).alias("b")
        on = None
        for c in self.key:
            e = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
            on = e if on is None else on & e
        return a.join(b, on, "left_anti")

    def run(self, listing: DataFrame, job: Callable[[DataFrame], DataFrame]) -> int:
        """One batch over what is pending; returns its id."""
        batch, run = max(self.committed(), default=0) + 1, "r" + uuid.uuid4().hex
        todo_at = f"{self.root}/manifest/run={run}"
        self.pending(listing).write.parquet(todo_at)  # fixes what this batch holds
        job(self.spark.read.schema(listing.schema).parquet(todo_at)).write.parquet(f"{self.root}/data/run={run}")
        self._create("commits", batch, run)
        return batch

    def compact(self) -> int:
        """Put the keys of all committed batches into one manifest; returns the last batch in it."""
        upto, run = max(self.committed(), default=0), "r" + uuid.uuid4().hex
        if upto > max(self._names("snapshots"), default=0):
            self.manifest().select(*self.key).write.parquet(f"{self.root}/manifest/run={run}")
            self._create("snapshots", upto, run)
        return upto
