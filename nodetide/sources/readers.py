"""Batch scans of the raw traces and of the pipeline's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodetide.config import PERCENT_COLUMNS

STRING = T.StringType()
PERCENT_SCHEMA = T.StructType([T.StructField(c, STRING) for c in PERCENT_COLUMNS])
PREAGG_SCHEMA = T.StructType([
    T.StructField(c, STRING) for c in ("machine_id", "window_ts", "cpu_sum", "mem_sum", "n_records")
])
CAPACITY_SCHEMA = T.StructType([T.StructField(c, STRING) for c in ("machine_id", "cap_cpu", "cap_mem")])


def _pair(name: str) -> T.StructField:
    return T.StructField(name, T.StructType([
        T.StructField("cpus", T.DoubleType()), T.StructField("memory", T.DoubleType()),
    ]))


INSTANCE_SCHEMA = T.StructType([
    T.StructField("machine_id", STRING), T.StructField("start_time", T.LongType()), _pair("average_usage"),
])
MACHINE_EVENT_SCHEMA = T.StructType([T.StructField("machine_id", STRING), _pair("capacity")])
FEED_SCHEMA = T.StructType([
    T.StructField("node_id", STRING),
    T.StructField("window_ts", T.LongType()),
    T.StructField("cpu_usage_norm", T.DoubleType()),
    T.StructField("mem_usage_norm", T.DoubleType()),
    T.StructField("n_records", T.LongType()),
    T.StructField("sev", T.IntegerType()),
])


def read_percent_usage(spark: SparkSession, path: str) -> DataFrame:
    """CSV with or without a header row; without one the columns are taken by position.

    The probe reads the first line only. With a header the columns may come in any order.
    """
    probe = spark.read.option("header", "true").csv(path)
    if "machine_id" in probe.columns:
        return probe
    return spark.read.schema(PERCENT_SCHEMA).csv(path)


def read_headed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header, plain or gzipped, globs allowed; all fields as text, no inference pass."""
    return spark.read.option("header", "true").schema(schema).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines, plain or gzipped; the schema is given, so the data is read once."""
    return spark.read.schema(schema).json(path)


def read_log_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_table(spark: SparkSession, path: str, provider: str | None = None) -> DataFrame:
    """Parquet table; a provider reads only that provider's folders."""
    df = spark.read.parquet(path)
    return df if provider is None else df.filter(F.col("cloud_provider") == provider)
