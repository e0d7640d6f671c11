"""Logs of per-row judge results, keyed by ``row_id``: numbered commits of JSON Lines, merged from time to time.

A log is a folder. Every append is a folder ``commit=<n>`` of its own, so a repeated append under one number replaces itself and a
failed one leaves nothing that is read. ``_compact/upto=<n>`` holds one record per row of all commits up to n, as Parquet in row
order, and ``_mark/commit=<n>`` up to which row the sample is settled. Files that lie in the folder itself are read as well.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textguard.schemas import JUDGE_RESULT

#: Commits since the last merge from which a run merges the log.
COMPACT_COMMITS = 64
_MARK = "row_id bigint, n_rows bigint"


def _numbered(files: list[str], name: str) -> dict[int, list[str]]:
    found: dict[int, list[str]] = {}
    for file in files:
        number = re.search(rf"/{name}=(\d+)/", file)
        if number:
            found.setdefault(int(number[1]), []).append(file)
    return found


def resolve_results(results: DataFrame, on: str = "row_id") -> DataFrame:
    """One record per row id, of a log of any kind: an answer or a refusal wins over an error record, an answer over none
    where the log has no reasons, and of several the least one stays."""
    columns = results.columns
    if "block_reason" in columns:
        late = F.coalesce(F.col("block_reason").startswith("error"), F.lit(False))
    else:
        late = F.col("predicted_label").isNull() if "predicted_label" in columns else F.lit(False)
    order = F.struct(late.cast("int").alias("late"), F.struct(*columns).alias("record"))
    return results.groupBy(on).agg(F.min(order).alias("r")).select("r.record.*")


@dataclass
class ResultLog:
    """A log at ``path``. One writer at a time; any number of readers."""

    spark: SparkSession
    path: str
    schema: T.StructType = field(default_factory=lambda: JUDGE_RESULT)

    def _files(self, folder: str = "") -> list[str]:
        try:
            found = self.spark.read.option("recursiveFileLookup", "true").text(f"{self.path}{folder}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return found.inputFiles()

    def merged_upto(self) -> int:
        """The last commit that is merged, 0 if none is."""
        return max(_numbered(self._files("/_compact"), "upto"), default=0)

    def last_commit(self) -> int:
        return max([*_numbered(self._files(), "commit"), self.merged_upto()])

    def _json(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).json(files)

    def read(self, above: int | None = None) -> DataFrame:
        """The records of the log, one per row of those that are merged; with ``above``, at least those of larger row ids."""
        files, merged = self._files(), self.merged_upto()
        commits = _numbered(files, "commit")
        loose = [f for f in files if not re.search(r"/commit=\d+/", f)]
        rows = self._json(loose + [f for n in sorted(commits) if n > merged for f in commits[n]])
        if merged:
            old = self.spark.read.schema(self.schema).parquet(f"{self.path}/_compact/upto={merged}")
            rows = (old if above is None else old.where(F.col("row_id") > above)).unionByName(rows)
        return rows

    def append(self, df: DataFrame, commit: int | None = None) -> int:
        """Add records as one commit and return its number. Spark commits a write as a whole, so a failed job adds nothing;
        a number given by the caller may be written again and then replaces what it held."""
        number = self.last_commit() + 1 if commit is None else commit
        # The folder of a failed append may be there, without files.
        mode = "append" if commit is None else "overwrite"
        df.write.mode(mode).option("ignoreNullFields", "false").json(f"{self.path}/commit={number:010d}")
        return number

    def compact(self) -> int:
        """Merge all commits to one record per row. Readers go on with the old ones until the new folder is complete."""
        number = self.last_commit()
        if number > self.merged_upto():
            merged = resolve_results(self.read()).repartitionByRange("row_id").sortWithinPartitions("row_id")
            merged.write.mode("overwrite").parquet(f"{self.path}/_compact/upto={number}")
        return number

    def compact_if_long(self) -> None:
        if self.last_commit() - self.merged_upto() >= COMPACT_COMMITS:
            self.compact()

    def set_mark(self, row_id: int, n_rows: int) -> None:
        """Note that the sample's first ``n_rows`` rows, all up to ``row_id``, have records."""
        mark = self.spark.createDataFrame([(row_id, n_rows)], _MARK).coalesce(1)
        mark.write.mode("overwrite").json(f"{self.path}/_mark/commit={self.last_commit():010d}")

    def mark(self) -> tuple[int, int] | None:
        marks = _numbered(self._files("/_mark"), "commit")
        if not marks:
            return None
        row = self.spark.read.schema(_MARK).json(marks[max(marks)]).first()
        return (row.row_id, row.n_rows) if row else None


def append_predictions(df: DataFrame, path: str) -> None:
    """Add records to the log at ``path``."""
    ResultLog(df.sparkSession, path, df.schema).append(df)


def read_predictions(
    spark: SparkSession, path: str, schema: T.StructType = JUDGE_RESULT
) -> DataFrame:
    """All records of a log; an absent log has none."""
    return ResultLog(spark, path, schema).read()
