"""Arrow-batched Python over rows, for what no built-in function can express."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_shipped: set[str] = set()

#: bytes of Arrow data that are turned into Python objects at once
MOST_BYTES = 8 << 20


def pieces(batch, most: int = MOST_BYTES) -> Iterator:
    """A record batch in slices of about ``most`` bytes, one row at least."""
    n, size = batch.num_rows, batch.nbytes
    if size <= most or n < 2:
        if n:
            yield batch
        return
    half = n // 2
    yield from pieces(batch.slice(0, half), most)
    yield from pieces(batch.slice(half), most)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session (once per application)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and p.suffix in (".py", ".ebnf", ".json", ".txt"):
                z.write(p, p.relative_to(root.parent))
    folder = tempfile.mkdtemp(prefix="siltstone-code-")  # read by the driver's file server only
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    at = os.path.join(folder, "siltstone_code.zip")
    Path(at).write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(at)
    _shipped.add(app)


def ship_file(spark: SparkSession, path: str) -> None:
    """Send a file of the driver's machine to all executors; ``shipped(path)`` finds it there."""
    key = f"{spark.sparkContext.applicationId} {path}"
    if key not in _shipped:
        spark.sparkContext.addFile(path)
        _shipped.add(key)


def shipped(path: str) -> str:
    """Where a shipped file lies in this process: among the job's files in a worker, else at its own path."""
    from pyspark import SparkFiles

    if SparkFiles._root_directory or SparkFiles._is_running_on_worker:
        at = os.path.join(SparkFiles.getRootDirectory(), os.path.basename(path))
        if os.path.exists(at):
            return at
    return path


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: StructType | str) -> DataFrame:
    """Flat-map rows through Python, batch by batch.

    ``make`` runs once per task and returns the function that gets one row's
    columns as arguments and yields output tuples. Only the columns of ``df``
    are sent to Python, so select first.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        fn = make()
        for b in (x for whole in batches for x in pieces(whole)):
            rows = [t for r in zip(*(c.to_pylist() for c in b.columns)) for t in fn(*r)]
            if rows:
                cols = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], Iterable[tuple]]], schema: StructType | str) -> DataFrame:
    """As ``map_rows``, but the function gets the rows of a batch (``MOST_BYTES`` at most) as a dict of lists."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        fn = make()
        for b in (x for whole in batches for x in pieces(whole)):
            rows = list(fn(dict(zip(b.schema.names, (c.to_pylist() for c in b.columns)))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
