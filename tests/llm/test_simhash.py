import random

import numpy as np
import pytest
import xxhash

from nodetide.llm import nearcopies, simhash
from nodetide.llm.components import components


def slow_fingerprint(text):
    words = [w for w in __import__("re").findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, radius=2):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def texts():
    rng = random.Random(5)
    base = [" ".join(rng.choice("alpha beta gamma delta EPSILON zeta ÉTA theta iota".split()) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 90)))
            for _ in range(60)]
    near = []
    for t in base[:30]:
        words = t.split()
        words[rng.randrange(len(words))] = "other"
        near.append(" ".join(words))
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [*base, *near, *base[:10], None, "", "  \n\t", "one", "one two", "a b c\x0bd", long, long + " end"]


def test_fingerprint_matches_definition():
    for t in texts():
        assert simhash.fingerprint(t) == slow_fingerprint(t)


@pytest.mark.parametrize("tile", [4096, 8])
def test_components_match_brute_force(spark, tile):
    rows = [(i * 3, t, "x") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in simhash.near_duplicates(df, tile=tile).collect()}
    prints = [slow_fingerprint(t) for _, t, _ in rows]
    roots = slow_components(prints)
    assert len(got) == len(rows)
    for (doc_id, _, _), p, r in zip(rows, prints, roots):
        assert got[doc_id].fp & (2**64 - 1) == p and got[doc_id].component_id == rows[r][0]


@pytest.mark.parametrize("tile", [4096, 64])
def test_dense_fingerprints(spark, tile):
    """Hot tiles: many fingerprints that differ in few bits of one range."""
    rng = np.random.default_rng(1)
    prints = {int(x) for x in rng.integers(0, 2**63, 300)}
    prints |= {0xABCDEF0123456789 ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 20, (700, 3))}
    prints = sorted(prints)
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    edges = simhash.close_edges(spark.createDataFrame(signed, "fp long"), tile=tile)
    from nodetide.llm.components import components

    label = {r.node: r.root for r in components(edges).collect()}
    roots = slow_components(prints)
    groups = {}
    for (s,), r in zip(signed, roots):
        groups.setdefault(r, set()).add(label.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_one_of_each_and_edges_of_the_input(spark):
    schema = "doc_id long, text string, source string, text_digest int"
    rows = [(5, "a b c d", "s", 1), (2, "a b c d", "s", 2), (2, "a b c d", "s", 2), (2, "other words here now", "t", 3), (None, "lone text of nobody", None, 4),
            (None, None, None, 5), (9, "", "u", 6)]
    df = spark.createDataFrame(rows, schema)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [(-1, "lone text of nobody"), (2, "a b c d"), (2, "other words here now"), (9, "")]
    empty = spark.createDataFrame([], schema)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_the_stage_links_fingerprints_within_two_bits(spark):
    """Texts of two shingles, one of them in common: a similarity of a third, but fingerprints that differ in two bits or fewer."""
    head = min((f"a b c d e{i}" for i in range(200)), key=lambda t: nearcopies.fingerprint(nearcopies.shingles(t)) & (2**64 - 1) and
               bin(nearcopies.fingerprint(nearcopies.shingles(t)) & (2**64 - 1)).count("1"))
    texts = [f"{head} x{i}" for i in range(1500)]
    prints = np.array([nearcopies.fingerprint(nearcopies.shingles(t)) for t in texts]).view(np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2, 1))
    i, j = (int(x) for x in near[0])
    far = next(k for k in range(1500) if k not in (i, j) and min(np.bitwise_count(prints[k] ^ prints[[i, j]])) > 2)
    rows = [(1, texts[i]), (2, texts[j]), (3, texts[far]), (4, "")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_components_of_stars_paths_and_rings(spark):
    edges = [(0, 1), (0, 2), (10, 11), (11, 12), (12, 13), (13, 10), (20, 22), (21, 22), (30, 30), (None, 31)]
    edges += [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: n // 10 * 10 for n in (0, 1, 2, 10, 11, 12, 13, 20, 21, 22)} | {100 + i: 100 for i in range(41)}
