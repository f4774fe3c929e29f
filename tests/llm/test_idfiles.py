import random
import zlib

import numpy as np
import pytest

from nodetide.llm import idfiles, tokens
from nodetide.llm.mph import PerfectHash, hashes


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 1000, 30_000])
def test_perfect_hash(n):
    keys = [str(i * 7).encode() for i in range(n)]
    built = PerfectHash.build(keys)
    again, size = PerfectHash.from_bytes(built.to_bytes() + b"more")
    assert size == len(built.to_bytes()) and sorted(again.numbers(keys)) == list(range(n))
    assert np.array_equal(again.numbers(keys), built.numbers(keys))
    if n >= 1000:
        assert len(built.to_bytes()) * 8 < 6 * n
        marks = np.zeros(n, np.uint32)
        marks[built.numbers(keys)] = hashes(keys)[2]
        other = [f"x{i}".encode() for i in range(2000)]
        number = built.numbers(other)
        assert not (marks[number[number >= 0]] == hashes(other)[2][number >= 0]).any()


def test_equal_keys_are_refused():
    with pytest.raises(ValueError):
        PerfectHash.build([b"a", b"b", b"a"])


def plain(rows):
    """All documents in order, encoded at once: id -> [(start, n, crc, ids)]."""
    from tokenizers import Tokenizer

    t, at, out = Tokenizer.from_file(tokens.public_path()), 0, {}
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.setdefault(key, []).append((at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        at += len(ids)
    return out


@pytest.mark.parametrize("shard_bytes,index_keys", [(idfiles.SHARD_BYTES, idfiles.INDEX_KEYS), (2000, 7)])
def test_round_trip(spark, tmp_path, shard_bytes, index_keys):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("the of Zebra # straße\n 12".split(" ")) for _ in range(rng.choice([0, 1, 30, 200])))) for i in rng.sample(range(-500, 9000), 60)]
    rows += [(77777, "twice"), (77777, "twice"), (None, "nobody's"), (5_000_000_000, None), (42_000, "long " * 50_000)]
    df = spark.createDataFrame([(k, t, 1, "f") for k, t in rows], "doc_id long, text string, shard int, file string").repartition(5)
    folder = f"file://{tmp_path}/set"
    idfiles.write(df, folder, shard_bytes=shard_bytes, index_keys=index_keys)
    got = idfiles.look_up(spark, folder, df, "doc_id", keep_ids=True).collect()
    want = plain(rows)
    assert sorted((str(r.key), r.start, r.n_tokens, r.ids_crc32, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted((str(k), *v) for k, vs in want.items() for v in vs)
    reader = idfiles.Reader(spark, folder)
    for key, docs in want.items():
        assert [a.tolist() for a in reader.ids(key)] == [ids for *_, ids in docs]
    assert reader.ids(123_456_789) == []
    missing = spark.createDataFrame([(123_456_789,), (77777,), (77777,)], "doc_id long")
    assert [r.key for r in idfiles.look_up(spark, folder, missing, "doc_id").collect()] == [77777, 77777]


def test_one_key_over_many_shards(spark, tmp_path):
    df = spark.createDataFrame([(3, "same words here " * 20)] * 50 + [(i, "x y z") for i in range(10)], "doc_id long, text string")
    folder = f"file://{tmp_path}/set"
    idfiles.write(df, folder, shard_bytes=2000)
    got = idfiles.look_up(spark, folder, df, "doc_id").collect()
    assert len(got) == 60 and len({r.start for r in got}) == 60 and len(spark.read.parquet(f"{folder}/shards").collect()) > 3
    assert sum(r.n_tokens for r in got) == sum(r.ids for r in spark.read.parquet(f"{folder}/shards").collect())


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    idfiles.write(df, f"file://{tmp_path}/set")
    assert idfiles.look_up(spark, f"file://{tmp_path}/set", df, "doc_id").count() == 0
    assert idfiles.Reader(spark, f"file://{tmp_path}/set").ids(1) == []
