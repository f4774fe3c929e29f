"""Helpers of the text operators: batches, written stages, row keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodetide.session import scratch_path, ship_package

#: Text handed to a Python worker at a time. A single longer text still comes whole.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Small batches of text for the Python workers, and this package on them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ship_package(spark)


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back: later steps read one copy, whatever executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the written tables that these DataFrames read; only for tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        folders = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
        for folder in folders:
            place = spark._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def map_rows(df: DataFrame, fn: Callable[[list], dict[str, list]], column: str, schema: str, keep: list[str]) -> DataFrame:
    """One output row for each row: the columns `keep` and what `fn` makes of the values of `column`.

    `fn` gets a list of values (None for null) and returns a list for each further column of `schema`.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    full = f"{fields}, {schema}" if keep else schema
    target = df.sparkSession.createDataFrame([], full).schema
    arrow = _arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(batch.column(batch.schema.get_field_index(column)).to_pylist())
            arrays = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            arrays = [a.cast(arrow.field(i).type) for i, a in enumerate(arrays)]
            arrays += [pa.array(made[f.name], f.type) for f in arrow if f.name not in keep]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.select(*dict.fromkeys([*keep, column])).mapInArrow(run, target)


def _arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def spare_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that clash with none of `df`."""
    taken = {c.lower() for c in df.columns}
    return [w if w.lower() not in taken else f"{w}_{uuid.uuid4().hex[:8]}" for w in wanted]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, keys: list, number: str) -> DataFrame:
    """`df` with its rows' places (from 0) in ascending order of `keys` in the column `number`, by one shuffle.

    Rows go to ranges of the keys, equal keys to several of them where they are frequent; each range is sorted and counted,
    and one row a range gives the ranges' starts. The sorted rows are written, so places and starts belong to one run.
    Rows equal in all keys stand in no order of their own.
    """
    tie, part, at, before = spare_name(df, "tie", "part", "at", "before")
    ranges = partitions(df.sparkSession)
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(ranges, *keys, F.col(tie)).sortWithinPartitions(*keys, F.col(tie))
    placed = dealt.drop(tie).withColumn(at, F.monotonically_increasing_id())
    placed = staged(placed.withColumn(part, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1))), "ranges")
    counts = placed.groupBy(part).agg(F.count("*").alias(before))  # at most `ranges` rows
    starts = counts.withColumn(before, F.sum(before).over(Window.orderBy(part)) - F.col(before))
    return placed.join(F.broadcast(starts), part).withColumn(number, F.col(before) + F.col(at)).drop(part, at, before)


def text_column(name: str = "text"):
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))
