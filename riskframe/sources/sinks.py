"""Report and import sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.operators.ingest import clean_table, snapshot_changed


def write_report(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite",
                 row_group_bytes: int | None = None) -> None:
    """One Parquet table per report (snappy); optional partition columns for pruning."""
    w = df.write.mode(mode).option("compression", "snappy")
    if row_group_bytes:
        w = w.option("parquet.block.size", row_group_bytes)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_periods(df: DataFrame, path: str, periods: Sequence[str], sort_by: Sequence[str] = ()) -> None:
    """Write the periods that ``df`` holds into a partitioned report; all others keep their files.

    Rows are clustered by period before the write (the planner merges small periods into one task and
    splits one that is large), so a period gets few files and a task writes few periods. Within a
    file rows are sorted, so the row groups of a period can be skipped by ``sort_by`` too.
    """
    keys = [F.col(f"`{c}`") for c in periods]
    clustered = df.hint("rebalance", *keys).sortWithinPartitions(*keys, *[F.col(f"`{c}`") for c in sort_by])
    clustered.write.mode("overwrite").option("compression", "snappy").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(*periods).parquet(path)


def ingest_clean(df: DataFrame, path: str) -> DataFrame:
    """Clean (B10) then write; returns the cleaned frame."""
    out = clean_table(df)
    write_report(out, path)
    return out


def write_if_changed(new: DataFrame, previous_path: str | None, path: str) -> bool:
    """A9 by comparing rows: write the new snapshot only when it differs from the previous one. ``snapshots``
    publishes without reading the old rows."""
    if previous_path is not None:
        old = new.sparkSession.read.parquet(previous_path)
        if not snapshot_changed(new, old):
            return False
    write_report(new, path)
    return True


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a write that is not needed any more (any file system that Spark writes to)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
