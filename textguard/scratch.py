"""Where intermediate tables live, and when a small table may be broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

_DIR_KEY = "spark.checkpoint.dir"
_local_root: str | None = None


class _HandedOut:
    """Paths handed out in the innermost ``temporary_tables`` block of this thread. Modules may go to workers by value, which a context
    variable cannot; there it is a new one."""

    def __init__(self) -> None:
        self.paths: ContextVar[list[str] | None] = ContextVar("handed_out", default=None)

    def __reduce__(self) -> tuple[type[_HandedOut], tuple[()]]:
        return _HandedOut, ()


_handed_out = _HandedOut()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the shared folder the session names in ``spark.checkpoint.dir``.

    The path does not exist yet. A temporary folder stands in only where the setting is absent
    (single-machine tests).
    """
    global _local_root
    root = spark.conf.get(_DIR_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_DIR_KEY} to a folder every executor can reach")
        if _local_root is None:
            _local_root = tempfile.mkdtemp(prefix="textguard-")
        root = _local_root
    path = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    if (paths := _handed_out.paths.get()) is not None:
        paths.append(path)
    return path


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete at the end of the block what was staged in it, also after an error.

    Results that read staged tables must be written to a place of their own within the block. Tables staged before, outside or
    by other threads (a stream's micro-batches) stay; a block inside another one deletes only its own.
    """
    paths: list[str] = []
    token = _handed_out.paths.set(paths)
    try:
        yield
    finally:
        _handed_out.paths.reset(token)
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            table = spark._jvm.org.apache.hadoop.fs.Path(path)
            table.getFileSystem(hadoop).delete(table, True)


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The stage boundary between preparation, splitting and evaluation: everything after it reads a
    columnar table instead of repeating the upstream plan, and a lost executor loses nothing.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(df: DataFrame, max_rows: int) -> tuple[DataFrame, list[Row] | None]:
    """Broadcast ``df`` if it has at most ``max_rows`` rows; otherwise hand it back for a shuffle join.

    Returns the table and, if it is small, its rows. At most ``max_rows + 1`` rows ever reach the
    driver.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df, None
    local = df.sparkSession.createDataFrame(rows, df.schema)
    return F.broadcast(local), rows


def spread(scan: DataFrame, key: str, per_core: int = 3) -> DataFrame:
    """Give a file scan some partitions per core, by ``key``, before CPU-heavy work.

    Only for a plain scan. Large inputs already have many splits and pass through unshuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(per_core * cores, key)
