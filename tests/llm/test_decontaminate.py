import math
import random
from collections import Counter

import pytest

from nodetide.llm import decontaminate as D

RNG = random.Random(11)
COMMON, RARE = "the of and to in is it that".split(), [f"w{i}" for i in range(900)]


def sentence(n):
    return " ".join(RNG.choice(COMMON) if RNG.random() < 0.45 else RNG.choice(RARE) for _ in range(n)).capitalize() + "."


ITEMS = [(i, " ".join(sentence(RNG.randrange(5, 30)) for _ in range(RNG.randrange(1, 4)))) for i in range(40)]


def part_of(items):
    segs = [s for _, t in items for s in D.segments(D.words_of(t))]
    return D.Part(items, len(segs), sum(map(len, segs)) / len(segs), dict(Counter(w for s in segs for w in set(s))))


def slow_scores(part, text):
    """BM25 of every passage with every segment, one by one; the best share of an item."""
    words, best = D.words_of(text), {}
    strides = -(-len(words) // D.STRIDE)
    passages = [words[i * D.STRIDE:(i + 2) * D.STRIDE] for i in range(max(1, strides - 1))]
    for place, (_, item) in enumerate(part.items):
        for seg in D.segments(D.words_of(item)):
            w = {}
            for t, k in Counter(seg).items():
                f = part.frequency[t]
                idf = math.log(1 + (part.n - f + 0.5) / (f + 0.5))
                w[t] = idf * k * (D.K1 + 1) / (k + D.K1 * (1 - D.B + D.B * len(seg) / part.mean))
            for p in passages:
                share = sum(x for t, x in w.items() if t in set(p)) / sum(w.values())
                best[place] = max(best.get(place, 0), share)
    return best


def text_with(*items, words=150):
    out = [sentence(RNG.randrange(4, 14)) for _ in range(words // 9)]
    for item in items:
        out.insert(RNG.randrange(len(out)), item)
    return " ".join(out)


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8])
def test_retrieval_equals_exhaustive_scores(least):
    part = part_of(ITEMS)
    index = D.Index(part)
    texts = [text_with(*(t for _, t in RNG.sample(ITEMS, RNG.randrange(3))), words=RNG.choice([9, 40, 300])) for _ in range(40)] + ["", "the", ITEMS[0][1]]
    for text in texts:
        want = {k: v for k, v in slow_scores(part, text).items() if v >= least}
        got = index.retrieve(text, least)
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_bounded_slices_change_nothing(monkeypatch):
    index = D.Index(part_of(ITEMS))
    text = text_with(*(t for _, t in ITEMS[:5]), words=900)
    want = index.retrieve(text, 0.4)
    index.maxima = __import__("numpy").pad(index.maxima, ((0, 0), (0, 40_000)))
    assert index.retrieve(text, 0.4) == want and len(want) >= 5


def test_leaks_need_question_and_answer():
    index, config = D.Index(part_of(ITEMS)), D.LeakConfig()
    for item_id, text in ITEMS:
        assert item_id in {r["item_id"] for r in index.leaks(text_with(text), config)}
        noisy = text_with(" ".join(w + "&&&" for w in text.upper().split()))
        assert item_id in {r["item_id"] for r in index.leaks(noisy, config)}
    two = next((i, t) for i, t in ITEMS if len(D.SENTENCE.split(t)) > 1)
    only_question = two[1][: two[1].rindex(D.SENTENCE.split(two[1])[-1])]
    assert not index.leaks(only_question, config)
    assert not any(index.leaks(text_with(), config) for _ in range(30))


@pytest.mark.parametrize("part_bytes", [D.PART_BYTES, 600])
def test_frames(spark, part_bytes):
    config = D.LeakConfig(part_bytes=part_bytes)
    items = [*ITEMS, (99, None), (98, ""), (97, "?!"), (5, ITEMS[5][1]), (None, ITEMS[6][1])]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id int, text string, part string")
    long = "filler words here " * 100_000 + ITEMS[3][1]
    rows = [(1, text_with(ITEMS[1][1], ITEMS[2][1])), (2, text_with()), (3, long), (4, None), (5, ""), (None, ITEMS[4][1]), (6, ITEMS[0][1]), (6, ITEMS[0][1]), (7, ITEMS[6][1])]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    got = sorted((r.doc_id or -1, r.item_id if r.item_id is not None else -1) for r in D.find_leaks(docs, bench, config).collect())
    assert got == [(-1, 4), (1, 1), (1, 2), (3, 3), (6, 0), (6, 0), (7, -1), (7, 6)]
    kept = D.without_leaks(docs, bench, config)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4, 5]
    assert D.find_leaks(docs, bench.limit(0), config).count() == 0 and D.find_leaks(docs.limit(0), bench, config).count() == 0
    assert D.without_leaks(docs, bench.limit(0), config).count() == len(rows)
