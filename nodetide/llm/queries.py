"""The text operators as registered queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodetide.llm.oracle import ORACLE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nodetide.llm import langid

    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    return langid.predict(docs, model)


@_query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nodetide.llm import urls

    rules = (urls.Rule("org/", "allow"), urls.Rule("example.org/es/", "block"), urls.Rule("example.org/en/1", "block"), urls.Rule("com/fr/", "allow"),
             urls.Rule("com/de/", "block"))
    return urls.judge(_table(spark, sf_dir, "pages"), urls.UrlConfig(rules))


@_query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nodetide.llm import packing

    return packing.pack(_table(spark, sf_dir, "documents"))


@_query
def op4_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nodetide.llm import idfiles
    from nodetide.session import scratch_path

    docs, folder = _table(spark, sf_dir, "documents"), scratch_path(spark, "ids")
    idfiles.write(docs, folder)
    return idfiles.look_up(spark, folder, docs, "doc_id").withColumnRenamed("key", "doc_id")


@_query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nodetide.llm import secrets

    return secrets.digest(secrets.find_secrets(_table(spark, sf_dir, "documents")))


@_query
def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nodetide.llm import pii

    return pii.pseudonymise(_table(spark, sf_dir, "documents"))


@_query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nodetide.llm import decontaminate

    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nodetide.llm import licences

    return licences.digest(licences.find_licences(_table(spark, sf_dir, "documents")))


@_query
def op9_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nodetide.llm import crosspolytope

    return crosspolytope.near_duplicates(_table(spark, sf_dir, "embeddings"))


@_query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nodetide.llm import simhash

    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nodetide.llm import resample

    return resample.draw(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


@_query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nodetide.llm import repair

    return repair.audit(repair.damaged(_table(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")


@_query
def op13_shuffled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nodetide.llm import sharding

    placed = sharding.assign(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def registered() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries of this subpackage and the SQL that checks them."""
    return dict(QUERIES), dict(ORACLE)
