"""Session set-up and the shared folder for lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


_own: list[str] = []  # this process's folder for local sessions without a setting


def get_spark(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("siltstone")
    for k, v in (DEFAULTS | conf).items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.driver.memory", memory)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    A local session's own folder goes with the process.

    Only a local session without that setting gets a folder of its own; a
    cluster without it is an error, as a machine-local folder would not survive
    the loss of an executor.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d and (set_by_hand := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        d = set_by_hand.get()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="siltstone-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        d = _own[0]
    return d


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/siltstone/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
