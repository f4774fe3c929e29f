"""Sinks. Tables are overwritten as a whole unless a partition of them is named."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, *columns: str) -> None:
    """Parquet partitioned by provider (or the given columns)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(
        *(columns or ("cloud_provider",))
    ).parquet(path)


def write_log_text(lines: DataFrame, path: str, files: int | None = None) -> None:
    """One string column to text files.

    A file count, where wanted, is reached by a shuffle of the finished lines: merging partitions instead would pull the
    work before it into as few tasks.
    """
    rows = lines if files is None else lines.repartition(files)
    rows.write.mode("overwrite").text(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_window_feed(rows: DataFrame, path: str, files_per_window: int = 1) -> None:
    """One folder per window, in one job.

    Rows are spread over `files_per_window` tasks per window, so a cluster too large for one file per window only
    needs a higher number.
    """
    keyed = rows
    if files_per_window > 1:
        keyed = rows.withColumn("_part", F.pmod(F.xxhash64("node_id"), F.lit(files_per_window)))
        keyed = keyed.repartition("window_ts", "_part").drop("_part")
    else:
        keyed = rows.repartition("window_ts")
    # The window is also kept inside the files: the stream reads them without partition discovery.
    keyed.withColumn("w", F.col("window_ts")).write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).partitionBy("w").parquet(path)


def replace_partitions(df: DataFrame, path: str, *columns: str) -> None:
    """Write exactly the partitions present in `df`; running it again changes nothing.

    Rows are gathered by partition first, and Spark splits a partition too large for one task and joins small ones.
    """
    df.hint("rebalance", *columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *columns
    ).parquet(path)


def json_document(df: DataFrame, **parts) -> DataFrame:
    """Small aggregated columns as one JSON text row."""
    return df.select(F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()])).alias("value"))


def write_json_document(doc: DataFrame, path: str) -> None:
    doc.coalesce(1).write.mode("overwrite").text(path)
