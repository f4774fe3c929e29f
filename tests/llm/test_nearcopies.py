import random

import pytest

from nodetide.llm import nearcopies, simhash


def slow_set(text):
    words = (text or "").split()
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_kept(rows):
    """The least id of every component of the pairs with a similarity of 0.8 or more."""
    sets, root = [slow_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(rows[i][0] for i in range(len(rows)) if find(i) == i)


def edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def corpus():
    rng = random.Random(3)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(60, 260))] for _ in range(40)]
    near = [edited(w, rng, rng.randrange(1, 9)) for w in base for _ in range(3)]
    common = base[0]
    crowd = [edited(common, rng, 1) for _ in range(60)]
    half = [common[:60] + [f"q{rng.randrange(10**6)}" for _ in range(60)] for _ in range(30)]
    texts = [" ".join(w) for w in base + near + crowd + half]
    return list(enumerate(texts + texts[:5] + ["", "one two", "one two"]))


def test_edited_copies_that_differ_in_many_bits_are_linked(spark):
    words = [f"w{i}" for i in range(100)]
    copy = words[:60] + ["x", "y"] + words[60:]
    far = words[:50] + [f"z{i}" for i in range(50)]
    rows = [(1, " ".join(words)), (2, " ".join(copy)), (3, " ".join(far))]
    assert bin(simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[1][1])).count("1") > 2
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


@pytest.mark.parametrize("small, block", [(8, 512), (2, 3)])
def test_components_match_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(nearcopies, "SMALL", small)
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    rows = corpus()
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == slow_kept(rows)


def test_recall_of_candidates():
    """Pairs of similarity 0.8 to 0.85 that share a tile and pass the fingerprints."""
    rng = random.Random(8)
    found = total = 0
    while total < 400:
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(80, 400))]
        a, b = (nearcopies.shingles(" ".join(w)) for w in (words, edited(words, rng, max(1, len(words) // 50))))
        common = len(set(a.tolist()) & set(b.tolist()))
        if not 0.8 <= common / (len(a) + len(b) - common) < 0.85:
            continue
        total += 1
        bits = bin((nearcopies.fingerprint(a) ^ nearcopies.fingerprint(b)) & (2**64 - 1)).count("1")
        found += bits <= nearcopies.RADIUS and any(x == y for x, y in zip(nearcopies.bands(a), nearcopies.bands(b)))
    assert found >= 0.98 * total


def test_nulls_ties_and_scratch(spark):
    long = "word%d " * 20_000 % tuple(range(20_000))
    rows = [(1, None, "a"), (2, "", "b"), (None, "no id here at all", "c"), (None, "no id here at all", "d"), (5, long, "e"), (4, long + "end", "f"), (5, long, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, set string")
    kept = simhash.one_of_each(df).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept) == [(False, 0), (True, 1), (True, 4)]
    assert simhash.one_of_each(df.limit(0)).count() == 0


def crowd_of(n):
    """Copies of one text with edits of their own: most share tiles, and few are similar enough to be linked."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(100)]
    return [(i, " ".join(edited(words, rng, rng.choice([1, 2, 2, 2, 3])))) for i in range(n)]


@pytest.mark.parametrize("block", [512, 16])
def test_large_tiles_move_rows_in_proportion_to_their_members(spark, monkeypatch, block):
    written, real = {}, nearcopies.staged

    def counted(df, name):
        table = real(df, name)
        written[name] = max(written.get(name, 0), table.count())
        return table

    monkeypatch.setattr(nearcopies, "staged", counted)
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    rows = crowd_of(150)
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = [(nearcopies.fingerprint(s), set(s.tolist())) for s in (nearcopies.shingles(t) for _, t in rows)]
    root = list(range(len(rows)))
    for i, (fp, a) in enumerate(sets):
        for j, (other, b) in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) or bin((fp ^ other) & (2**64 - 1)).count("1") <= 2:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))
    assert written["pairs"] <= 8 * len(rows) and written["links"] <= written["members"]


def test_common_shingles_are_counted_exactly(monkeypatch):
    monkeypatch.setattr(nearcopies, "COLUMNS", 7)
    sets = [nearcopies.shingles(t) for _, t in crowd_of(30)] + [nearcopies.shingles("one two")]
    common = nearcopies.common_shingles(sets)
    assert all(common[i][j] == len(set(a.tolist()) & set(b.tolist())) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)
