"""Raw dataset files: one parquet table per logical name."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def raw_path(name: str, raw_dir: str) -> str:
    """``owner/name`` → ``<raw_dir>/owner__name.parquet``."""
    return f"{raw_dir.rstrip('/')}/{name.replace('/', '__')}.parquet"


def read_raw(
    spark: SparkSession, name: str, raw_dir: str, schema: T.StructType | None = None
) -> DataFrame:
    """One raw dataset, lazily. Without a schema the one in the parquet footers is used."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(raw_path(name, raw_dir))


def write_raw(df: DataFrame, name: str, raw_dir: str) -> str:
    """Store a dataset as it is, replacing an earlier copy of the same name."""
    path = raw_path(name, raw_dir)
    df.write.mode("overwrite").parquet(path)
    return path


def read_sources(
    spark: SparkSession,
    names: Iterable[str],
    raw_dir: str,
    schemas: Mapping[str, T.StructType] | None = None,
) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Read a list of datasets; a failing one is reported instead of ending the run.

    Returns (frames, skipped), where skipped maps a name to the reason.
    """
    frames: dict[str, DataFrame] = {}
    skipped: dict[str, str] = {}
    for name in names:
        try:
            frames[name] = read_raw(spark, name, raw_dir, (schemas or {}).get(name))
        except PySparkException as error:
            skipped[name] = error.getCondition() or str(error)
    return frames, skipped
