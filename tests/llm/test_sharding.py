import collections
import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from nodetide.llm import sharding


def plain_place(row, n, seed):
    m = math.isqrt(n - 1) + 1
    x = row
    while True:
        left, right = divmod(x, m)
        for k in range(1, sharding.ROUNDS + 1):
            left, right = right, (left + int(hashlib.md5(f"{seed}:{k}:{right}".encode()).hexdigest()[:15], 16)) % m
        x = left * m + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 3, 17, 1025])
def test_permutation_and_its_inverse(spark, n):
    order = sharding.Permutation(spark, n, 7)
    rows = spark.range(n).select("id", order.place(F.col("id")).alias("place")).select("*", order.row(F.col("place")).alias("back")).collect()
    assert [r.place for r in sorted(rows)] == [plain_place(i, n, 7) for i in range(n)]
    assert sorted(r.place for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)


def test_large_numbers_stay_exact(spark):
    n = 10**16 + 12345
    order = sharding.Permutation.__new__(sharding.Permutation)
    order.rows, order.seed, order.side, order.walks = n, 3, math.isqrt(n - 1) + 1, (8, 8)
    rows = spark.range(n - 50, n).select("id", order.place(F.col("id")).alias("place")).select("*", order.row(F.col("place")).alias("back")).collect()
    assert all(r.place == plain_place(r.id, n, 3) and r.back == r.id for r in rows)


def documents():
    texts = ["same"] * 40 + [f"text {i}" * (i % 9) for i in range(150)] + [None, "", "é" * 50_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, None), (5, "same"), (5, "other"), (5, "same")]
    return [(i, t, "x", 1, 2) for i, t in rows]


def test_assignment(spark):
    docs = documents()
    df = spark.createDataFrame(docs, "doc_id long, text string, slot string, shard int, size int")
    got = sharding.assign(df).collect()
    counts = collections.Counter(r.shard for r in got)
    assert len(got) == len(docs) and max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(16))
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in docs)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    order = sorted(got, key=lambda r: r.slot * 16 + r.shard)
    row_of = {id(r): i for i, r in enumerate(sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32)))}
    places = [plain_place(i, len(docs), sharding.SEED) for i in range(len(docs))]
    for place, r in enumerate(order):
        if r.doc_id not in (None, 5):
            assert places[row_of[id(r)]] == place
    again = sharding.assign(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert sharding.row_at(spark, len(docs), got[0].shard, got[0].slot) == places.index(got[0].slot * 16 + got[0].shard)


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame(documents(), "doc_id long, text string, slot string, shard int, size int")
    sharding.write(df, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == df.count() and set(df.columns) <= set(back.columns) and len(back.columns) == len(df.columns) + 2
    assert back.select(*df.columns).exceptAll(df).count() == 0


def test_empty_table_and_no_python(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.assign(df).count() == 0
    df = spark.createDataFrame(documents(), "doc_id long, text string, a string, b int, c int")
    assert "Python" not in sharding.assign(df)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        sharding.assign(df, shards=0)


def test_numbers_outside_the_table_make_few_tasks(spark, monkeypatch):
    """They are about twice the root of the rows: each further task and file costs memory and is worth nothing."""
    tasks, real = [], sharding.staged

    def counted(df, name):
        tasks.append(df.rdd.getNumPartitions())
        return real(df, name)

    monkeypatch.setattr(sharding, "staged", counted)
    order = sharding.Permutation(spark, 1_000_002, 42)
    assert order.walks[0] > 0 and set(tasks) == {1}
