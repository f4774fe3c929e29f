"""Token ids in binary files, with keyed access through a minimal perfect hash index.

A data set is a folder:

* `*.ids`   the ids of a shard's documents one after the other, in ascending key order, unsigned little-endian: 16 bits where
            the vocabulary has no more ids, else 32 (`width` bytes);
* `*.len`   the number of ids of each of them, 32 bits;
* `*.mph`   an index of the keys that hash to one bucket: a perfect hash, 32-bit fingerprints by number, the first segment
            by number, and segments (shard, first document, documents, ids, ids before it in the shard). A key has one
            segment, or one for each shard where rows repeat it;
* `shards/`, `indexes/`  Parquet tables that name the files which count, with the ids before each shard. Files are written
            under names of their own and only these tables make them part of the data set, so a task that is run again
            or twice leaves nothing behind that is read.

A look-up costs one hash, one record and one read, however large the data set is.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodetide.llm import tokens
from nodetide.llm.common import _arrow_schema, prepare, staged
from nodetide.llm.mph import PerfectHash, hashes

END = 2
SEGMENT = np.dtype([("shard", "<u4"), ("first", "<u4"), ("docs", "<u4"), ("ids", "<u8"), ("before", "<u8")])
#: Bytes of text for a shard, keys for an index file.
SHARD_BYTES, INDEX_KEYS = 64 << 20, 200_000
NO_KEY = b"\x00no key"


def filesystem(path: str):
    """File system and path in it of a folder that all executors reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def key_bytes(key) -> bytes:
    """A key as text, or the mark of no key; missing values of pandas are none."""
    return NO_KEY if key is None or key != key else str(key).encode()


def bucket_of(key_col: str, buckets: int):
    return F.pmod(F.xxhash64(F.coalesce(F.col(key_col).cast("string"), F.lit("\x00no key"))), F.lit(buckets)).cast("int")


def _shard_writer(folder: str, path: str, end: int, width: int, arrow: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, name = TaskContext.get().partitionId(), f"shard-{uuid.uuid4().hex}"
        store, base = filesystem(folder)
        encode, tail = tokens.encoder(path).ids, np.array([end], f"<u{width}").tobytes()
        docs = before = 0
        lengths: list[int] = []
        out = None
        try:
            for batch in batches:
                n = []
                for text in batch.column(1).to_pylist():
                    data = np.frombuffer(encode(text or ""), "<u4").astype(f"<u{width}").tobytes() + tail
                    out = out or store.open_output_stream(f"{base}/{name}.ids")
                    out.write(data)
                    n.append(len(data) // width)
                lengths += n
                ends = np.cumsum(n) + before
                made = {"shard": [shard] * len(n), "file": [name] * len(n), "place": range(docs, docs + len(n)), "n": n, "before": ends - n}
                docs, before = docs + len(n), int(ends[-1]) if len(n) else before
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), *[pa.array(made[f.name], f.type) for f in list(arrow)[1:]]], schema=arrow)
        finally:
            if out:
                out.close()
        if docs:
            with store.open_output_stream(f"{base}/{name}.len") as f:
                f.write(np.array(lengths, "<u4").tobytes())

    return run


def _index_writer(folder: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "shard"], na_position="first", kind="stable", ignore_index=True)
        keys = [key_bytes(k) for k in rows["key"]]
        first = np.flatnonzero([i == 0 or keys[i] != keys[i - 1] for i in range(len(keys))])
        own = [keys[i] for i in first]
        perfect = PerfectHash.build(own)
        number = perfect.numbers(own)
        order = np.argsort(number)
        size = np.diff(np.append(first, len(keys)))[order]
        starts = np.concatenate([[0], np.cumsum(size)])
        take = np.concatenate([np.arange(first[i], first[i] + n) for i, n in zip(order, size)])
        segments = np.zeros(len(rows), SEGMENT)
        for name in SEGMENT.names:
            segments[name] = rows[name].to_numpy()[take]
        name = f"index-{uuid.uuid4().hex}.mph"
        store, base = filesystem(folder)
        with store.open_output_stream(f"{base}/{name}") as f:
            f.write(perfect.to_bytes() + hashes(own)[2][order].astype("<u4").tobytes() + starts.astype("<u4").tobytes() + segments.tobytes())
        return pd.DataFrame({"bucket": [int(rows["bucket"].iloc[0])], "file": [name], "keys": [len(own)]})

    return run


class Index:
    """One index file."""

    def __init__(self, data: bytes):
        self.perfect, at = PerfectHash.from_bytes(data)
        n = self.perfect.n
        self.marks = np.frombuffer(data, "<u4", n, at)
        self.starts = np.frombuffer(data, "<u4", n + 1, at + 4 * n)
        self.segments = np.frombuffer(data, SEGMENT, offset=at + 8 * n + 4)

    def find(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(place of the key, segment) for all segments of all keys that are there."""
        number = self.perfect.numbers(keys)
        there = np.flatnonzero(number >= 0)
        there = there[self.marks[number[there]] == hashes([keys[i] for i in there])[2]]
        first, last = self.starts[number[there]].astype(np.int64), self.starts[number[there] + 1].astype(np.int64)
        n = last - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        return np.repeat(there, n), self.segments[at]


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = END, id_col: str = "doc_id", text_col: str = "text",
          shard_bytes: int = SHARD_BYTES, index_keys: int = INDEX_KEYS) -> None:
    """Encode all texts into the data set `folder` (new, reached by all executors), in ascending order of their ids.

    Null texts count as empty: the end id alone. Rows without id come first, under a key of their own; rows with equal ids
    stand next to each other, in no order of their own, also over several shards; further columns are ignored; an empty
    table gives a data set without files.
    """
    spark = docs.sparkSession
    prepare(spark)
    path = path or tokens.public_path()
    width = 2 if max(tokens.encoder(path).tokenizer.get_vocab_size() - 1, end) < 1 << 16 else 4
    filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    size, count = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    shards = max(1, -(-(size or 0) // shard_bytes))
    schema = spark.createDataFrame([], f"key {rows.schema[0].dataType.simpleString()}, shard int, file string, place long, n long, before long").schema
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(shards, "key", "tie").sortWithinPartitions("key", "tie").drop("tie")
    placed = staged(dealt.mapInArrow(_shard_writer(folder, path, end, width, _arrow_schema(schema)), schema), "placed")
    totals = placed.groupBy("shard", "file").agg(F.count("*").alias("docs"), F.sum("n").alias("ids")).orderBy("shard").collect()  # a row a file
    base, listed = 0, []
    for r in totals:
        listed.append((r["shard"], r["file"], width, r["docs"], r["ids"], base))
        base += r["ids"]
    spark.createDataFrame(listed, "shard int, file string, width int, docs long, ids long, base long").coalesce(1).write.parquet(f"{folder}/shards")
    buckets = max(1, -(-count // index_keys))
    segments = placed.groupBy(F.col("key").cast("string").alias("key"), "shard").agg(F.min("place").alias("first"), F.count("*").alias("docs"), F.sum("n").alias("ids"), F.min("before").alias("before"))
    segments.withColumn("bucket", bucket_of("key", buckets)).groupBy("bucket").applyInPandas(
        _index_writer(folder), "bucket int, file string, keys long").withColumn("buckets", F.lit(buckets)).write.parquet(f"{folder}/indexes")


def _look_up(folder: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        store, base = filesystem(folder)
        with store.open_input_file(f"{base}/{rows['index_file'].iloc[0]}") as f:
            index = Index(f.read())
        place, found = index.find([key_bytes(k) for k in rows["key"]])
        return pd.DataFrame({"key": rows["key"].to_numpy()[place]} | {k: found[k].astype(np.int64) for k in SEGMENT.names})

    return run


def _reader(folder: str, keep_ids: bool, arrow: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        name = ids = lengths = None
        for batch in batches:
            column = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            row, out = [], {k: [] for k in ("start", "n_tokens", "ids_crc32", "ids")}
            for i in range(batch.num_rows):
                if column["file"][i] != name:
                    name = column["file"][i]
                    if ids:
                        ids.close()
                    ids = store.open_input_file(f"{base}/{name}.ids")
                    with store.open_input_file(f"{base}/{name}.len") as f:
                        lengths = np.frombuffer(f.read(), "<u4")
                before, first, width = column["before"][i], column["first"][i], column["width"][i]
                for n in lengths[first:first + column["docs"][i]].tolist():
                    data = np.frombuffer(ids.read_at(width * n, width * before), f"<u{width}").astype("<u4").tobytes()
                    row.append(i)
                    for k, v in zip(out, (column["base"][i] + before, n, zlib.crc32(data), data if keep_ids else None)):
                        out[k].append(v)
                    before += n
            keys = batch.column(batch.schema.get_field_index("key")).take(pa.array(row, pa.int64())).cast(arrow.field(0).type)
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(out[f.name], f.type) for f in list(arrow)[1:]]], schema=arrow)
        if ids:
            ids.close()

    return run


def look_up(spark: SparkSession, folder: str, keys: DataFrame, key_col: str, keep_ids: bool = False) -> DataFrame:
    """For every document of the data set under one of the keys: key, start (ids of all documents before it), n_tokens,
    ids_crc32, and ids (bytes) with `keep_ids`. Keys that are not there give no row; repeated keys count once."""
    prepare(spark)
    kind = keys.select(key_col).schema[0].dataType.simpleString()
    wanted = keys.select(F.col(key_col).cast("string").alias("key")).distinct()
    indexes = spark.read.parquet(f"{folder}/indexes")
    some = indexes.select("buckets").first()
    named = indexes.select("bucket", F.col("file").alias("index_file"))
    found = wanted.withColumn("bucket", bucket_of("key", some[0] if some else 1)).join(named, "bucket").groupBy("bucket").applyInPandas(
        _look_up(folder), "key string, shard long, first long, docs long, ids long, before long")
    shards = spark.read.parquet(f"{folder}/shards").select("shard", "file", "width", "base")
    schema = spark.createDataFrame([], f"key {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids).schema
    segments = found.join(shards, "shard").select(F.col("key").cast(kind).alias("key"), "file", "width", "base", "first", "docs", "before")
    n = max(1, shards.count())
    return segments.repartition(n, "file").sortWithinPartitions("file", "first").mapInArrow(_reader(folder, keep_ids, _arrow_schema(schema)), schema)


class Reader:
    """Keyed access from one process: `ids(key)` gives the ids of all documents under a key."""

    def __init__(self, spark: SparkSession, folder: str):
        self.store, self.base = filesystem(folder)
        self.shards = {r["shard"]: (r["file"], r["width"]) for r in spark.read.parquet(f"{folder}/shards").collect()}
        rows = spark.read.parquet(f"{folder}/indexes").collect()
        self.files, self.buckets = {r["bucket"]: r["file"] for r in rows}, rows[0]["buckets"] if rows else 1
        self.loaded: dict[int, Index] = {}

    def ids(self, key) -> list[np.ndarray]:
        import xxhash

        h = xxhash.xxh64_intdigest(key_bytes(key), 42)  # as Spark hashes the key's text
        bucket = (h - (1 << 64) if h >> 63 else h) % self.buckets
        if bucket not in self.files:
            return []
        if bucket not in self.loaded:
            with self.store.open_input_file(f"{self.base}/{self.files[bucket]}") as f:
                self.loaded[bucket] = Index(f.read())
        out = []
        for s in self.loaded[bucket].find([key_bytes(key)])[1]:
            name, width = self.shards[int(s["shard"])]
            file = f"{self.base}/{name}"
            with self.store.open_input_file(f"{file}.len") as f:
                lengths = np.frombuffer(f.read_at(4 * int(s["docs"]), 4 * int(s["first"])), "<u4")
            with self.store.open_input_file(f"{file}.ids") as f:
                data = np.frombuffer(f.read_at(width * int(s["ids"]), width * int(s["before"])), f"<u{width}")
            out += np.split(data, np.cumsum(lengths)[:-1])
        return out
