import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from nodetide.llm import resample
from nodetide.llm.resample import ResampleConfig

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def grams(text, longest):
    words = WORDS.findall(lower(text))
    return [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def plain(docs, target, config):
    def bucket(g):
        return zlib.crc32(g.encode("utf-8", "surrogatepass")) % config.buckets

    b = config.buckets
    corpus = Counter(bucket(g) for _, t in docs for g in grams(t, config.longest)[0])
    aims = Counter(bucket(g) for t in target for g in grams(t, config.longest)[0])
    s_all, t_all = sum(corpus.values()), sum(aims.values())
    gain = {k: math.floor(1000 * math.log((aims[k] + 1) * (s_all + b) / ((corpus[k] + 1) * (t_all + b)))) for k in range(b)}
    rows = []
    for i, t in docs:
        found, words = grams(t, config.longest)
        weight = sum(gain[bucket(g)] for g in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{config.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= config.least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for rank, r in enumerate(fit[:len(fit) * config.percent // 100], 1):
        r.append(rank)
    return [tuple(r if len(r) == 6 else [*r, None]) for r in rows]


def texts():
    rng = random.Random(2)
    vocabulary = "The a of Ärger naïve 7 x9 data-base don't MODEL model city".split()
    docs = [(i * 2, " ".join(rng.choice(vocabulary) + rng.choice(["", ".", ",", "\n", "--"]) for _ in range(rng.randrange(0, 60)))) for i in range(120)]
    docs += [(1, None), (3, ""), (5, " .,; \n"), (7, "İstanbul ſ K ١٢ 日本 語"), (9, docs[30][1]), (None, docs[31][1]), (60, docs[40][1])]
    return docs, ["The model of a city", "naïve data base; 日本", None, ""]


@pytest.mark.parametrize("config", [ResampleConfig(), ResampleConfig(longest=3, buckets=97, percent=35), ResampleConfig(longest=2, buckets=70_000, least_words=1, percent=100)])
def test_against_plain_version(spark, config):
    docs, target = texts()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, rank string")
    aims = spark.createDataFrame([(t, 0) for t in target], "text string, item_id int")
    got = [tuple(r) for r in resample.draw(df, aims, config).collect()]
    key = str
    assert sorted(got, key=key) == sorted(plain(docs, target, config), key=key)


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_slices_of_long_texts(monkeypatch, longest):
    monkeypatch.setattr(resample, "SLICE", 50)
    rng = random.Random(3)
    text = "  ".join(rng.choice(["alpha", "Beta", "g7", "Ünï", "-", "z" * 120]) for _ in range(900))
    found = [(f.decode(), n) for f, n in resample.Features(longest, 10).spans(text)]
    want = grams(text, longest)[0]
    assert Counter(f for f, _ in found) == Counter(want) and all(f.count(" ") == n - 1 for f, n in found)
    assert resample.Features(longest, 10).of(text)[0] == grams(text, 1)[1]


def test_empty_tables_and_rows_drawn(spark):
    docs, target = texts()
    none = spark.createDataFrame([], "doc_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    assert resample.draw(none, aims).count() == 0
    assert sorted(map(str, (tuple(r) for r in resample.draw(df, none).collect()))) == sorted(map(str, plain(docs, [], ResampleConfig())))
    wanted = {r[0] for r in plain(docs, target, ResampleConfig()) if r[5]}
    assert {r.doc_id for r in resample.drawn(df, aims).collect()} == wanted
