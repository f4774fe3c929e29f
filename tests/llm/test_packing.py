import functools
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nodetide.llm import packing, tokens


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.public_path())


def library_ids(text):
    return library().encode(text, add_special_tokens=False).ids


PIECES = st.sampled_from(["a", "Word", " ", "  ", "\n", "\n\n", "\t", "é", "ñ", "12", "3.5", "'s", "'ll", "!!", " ", "\x1c", "\x85", "　", "日本", " the", "x" * 60, "\r\n", "🙂", ",", ".", "&&&", "_", "-", "<|endoftext|>", "<|endoftext", "|>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=40))
def test_ids_equal_those_of_the_library(pieces):
    text = "".join(pieces)
    assert np.frombuffer(tokens.encoder(tokens.public_path()).ids(text), "<u4").tolist() == library_ids(text)


def test_slices_and_a_full_cache_change_nothing(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice(["the ", "of\n", "x  y", "Zebra", "\n \n", "7", " ", "\t", "wörd"]) for _ in range(3000))
    mark = "<|endoftext|>"
    text = mark + text[:400] + mark + " " + mark + mark + text[400:] + " " + mark
    want = library_ids(text)
    assert want.count(50256) == 5
    monkeypatch.setattr(tokens, "SLICE", 50)
    monkeypatch.setattr(tokens, "CACHED", 7)
    e = tokens.Encoder(tokens.public_path())
    for _ in range(2):
        assert np.frombuffer(e.ids(text), "<u4").tolist() == want


def test_vocabularies_of_another_build_go_to_the_library():
    from tokenizers import Tokenizer

    path = tokens.public_path("word_bpe_49k.json")
    texts = ["Words  and\nmore WORDS", "a <|endoftext|> b", "", "  x " * 50]
    assert not tokens.Encoder(path).cuttable and tokens.Encoder(tokens.public_path()).cuttable
    for text in texts:
        assert np.frombuffer(tokens.Encoder(path).ids(text), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def unpack(runs, counts):
    """Every piece at its place: sequence -> [(offset, length)]; ranks of a length are used once each."""
    seqs, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, first, offset in runs:
        ranks[length] += range(rank, rank + n)
        for k in range(n):
            seqs[first + k].append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in enumerate(counts) if n}
    return seqs


def best_possible(pieces, size):
    """Fewest sequences, by search."""
    pieces = sorted(pieces, reverse=True)
    best = len(pieces)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= pieces[i]:
                rest = list(rooms)
                rest.remove(r)
                go(i + 1, [*rest, r - pieces[i]])
        go(i + 1, [*rooms, size - pieces[i]])

    go(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_the_reduction_loses_nothing(pieces):
    size = 20
    counts = [pieces.count(i) for i in range(size + 1)]
    left = list(counts)
    fixed = packing.reduce_by_dominance(left, size)
    rest = list(itertools.chain.from_iterable([i] * n for i, n in enumerate(left)))
    used = sum(n for _, n in fixed)
    assert all(sum(lengths) <= size for lengths, _ in fixed)
    assert used + (best_possible(rest, size) if rest else 0) == best_possible(pieces, size)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=300))
def test_the_plan_is_a_packing_and_best_fit(pieces):
    size = 64
    counts = [pieces.count(i) for i in range(size + 1)]
    runs, n = packing.plan(counts, size)
    seqs = unpack(runs, counts)
    assert sorted(seqs) == list(range(n))
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    left = list(counts)
    fixed = sum(k for _, k in packing.reduce_by_dominance(left, size))
    rooms = []
    for length in range(size, 0, -1):  # best fit, piece by piece
        for _ in range(left[length]):
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - length)
            else:
                rooms.append(size - length)
    assert n == fixed + len(rooms)


def test_plan_does_not_grow_with_the_documents():
    rng = np.random.default_rng(4)
    small = np.bincount(rng.integers(1, 2049, 20_000), minlength=2049)
    a, b = (packing.plan((small * k).tolist()) for k in (1, 10_000))
    assert len(b[0]) < 3 * len(a[0]) and b[1] >= -(-int((small * 10_000 * np.arange(2049)).sum()) // 2048)


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 5000, 6144])
def test_cut(n):
    pieces = packing.cut(n)
    assert sum(length for _, length in pieces) == n and all(length == 2048 for _, length in pieces[1:])
    assert [s for s, _ in pieces] == [sum(length for _, length in pieces[:i]) for i in range(len(pieces))]


def test_frame(spark):
    rng = random.Random(8)
    words = "the of and with Zebra straße ñ 12".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 9, 200, 3000]))) for _ in range(60)] + [None, "", "same", "same", "long word " * 30_000]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "same", 2, "y"), (3, texts[3], 3, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank int, part string").repartition(7)
    got = packing.pack(df, keep_ids=True).collect()
    want = {(i, piece): np.array((library_ids(t or "") + [0])[start:start + n], "<u4").tobytes()
            for i, t, _, _ in rows for piece, (start, n) in enumerate(packing.cut(len(library_ids(t or "")) + 1))}
    assert len(got) == len(want) + len(packing.cut(len(library_ids(texts[3])) + 1))
    places = defaultdict(list)
    for r in got:
        assert want[r.doc_id, r.piece] == r.ids and zlib.crc32(r.ids) == r.ids_crc32 and r.length == len(r.ids) // 4
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:i]) for i in range(len(p))] and sum(n for _, n in p) <= 2048
    assert packing.pack(df.limit(0)).count() == 0
