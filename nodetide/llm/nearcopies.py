"""Near copies of texts: fingerprints of word shingles compared in tiles, every link checked on the whole shingle sets.

A text's set holds the hashes of its shingles of `WIDTH` words; texts with equal sets are one before anything is compared.
The set's fingerprint (SimHash, 64 bits) differs from that of a set of similarity 0.8 in about ten bits, too many for tiles of
equal bits, so tiles are formed by MinHash: two sets share a tile if they agree in one of `BANDS` bands of `ROWS` minima. A
pair of similarity 0.8 shares none with a probability of 1 %, one of 0.85 with 4e-5; one of 0.5 shares one with 6 %. Inside a
tile, pairs whose sizes or fingerprints are too far apart are skipped by exclusive-or and bit counts, and a link is a pair
whose similarity, counted exactly, is 4/5 or more.

Only the components of the links are wanted. All pairs of a small tile are compared at once. A larger tile whose sets are not
all connected by then is compared whole, inside a task and in cells of two blocks: a block holds each of its sets once, common
shingles of all its pairs are counted slice by slice of the shingles, and what leaves the task is a forest, never pairs. So
rows grow with a tile's members and not with their square. In a tile of more than `CELLS` blocks every set is first compared
with two chosen members, by one pair a set over all its tiles, and again with others, `STARS` times; what that has connected
is not compared again. No pair is left out but those connected already.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodetide.llm.common import discard, map_rows, staged
from nodetide.llm.components import components, spanning

WIDTH = 5
BANDS, ROWS = 32, 9
SEED = 42
#: Bits in which fingerprints of a similarity of 0.8 may differ: 9.7 are expected, 20 are passed by one pair in 5,000.
RADIUS = 20
#: Shingles whose minima are taken at a time, members of a small tile, members of a block, parts of a set's partners.
AT_ONCE, SMALL, BLOCK, PARTS = 2048, 8, 512, 64
#: Shingles a block is meant to hold at most, and shingles that are flagged at a time.
HELD, COLUMNS = 1 << 20, 4096
#: Blocks of a tile that need no chosen members first, and rounds of these.
CELLS, STARS = 8, 6

_rng = np.random.default_rng(SEED)
_FLIP = _rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_ODD = _rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles; one shingle of all words for a shorter text, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.array([digest(join(words[i:i + width]), SEED) for i in range(max(1, len(words) - width + 1))], np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """One key for each band; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), AT_ONCE):
        least = np.minimum(least, ((hashes[None, at:at + AT_ONCE] ^ _FLIP) * _ODD).min(axis=1))
    keys = [xxhash.xxh64_intdigest(row.tobytes(), b) for b, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the set's hashes, as a signed number."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at:at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def sketches(texts: list) -> dict[str, list]:
    """Columns set (hash of the whole set), n, fp and bands."""
    sets = [shingles(t) for t in texts]
    keys = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
    return {"set": keys, "n": np.array([len(s) for s in sets], np.int32), "fp": [fingerprint(s) for s in sets], "bands": [bands(s) for s in sets]}


SKETCH = "set long, n int, fp long, bands array<long>"
_CLOSE = f"5 * least(n, other_n) >= 4 * greatest(n, other_n) and bit_count(fp ^ other_fp) <= {RADIUS}"


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose sets (columns set, hashes) have a similarity of 4/5 or more.

    Every set b moves once a pair; a moves once to each of the parts, up to `PARTS`, that its partners are dealt into.
    """
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(PARTS)).alias("part"))
    left = dealt.select("a", "part").distinct().join(sets.select(F.col("set").alias("a"), F.col("hashes").alias("left")), "a")
    right = dealt.join(sets.select(F.col("set").alias("b"), F.col("hashes").alias("right")), "b")
    met = right.join(left, ["a", "part"])
    common = F.size(F.array_intersect("left", "right"))
    return met.where(common * 9 >= (F.size("left") + F.size("right")) * 4).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _other(*more: str) -> list:
    return [F.col("set").alias("other"), F.col("n").alias("other_n"), F.col("fp").alias("other_fp"), *more]


def _small_tiles(members: DataFrame) -> DataFrame:
    """All close pairs of the small tiles."""
    small = members.where(F.col("size") <= SMALL)
    met = small.join(small.select("key", *_other()), "key").where("set < other").where(_CLOSE)
    return met.select(F.col("set").alias("a"), F.col("other").alias("b")).distinct()


def _stars(now: DataFrame, mixed: DataFrame) -> DataFrame:
    """For every set not connected with a chosen member of one of its tiles, the pair with the closest of these."""
    chosen = mixed.select("key", F.explode(F.array("low", "high")).alias("c")).select(
        "key", F.col("c.set").alias("other"), F.col("c.n").alias("other_n"), F.col("c.fp").alias("other_fp"), F.col("c.comp").alias("other_comp"))
    met = now.join(chosen, "key").where("comp <> other_comp").where(_CLOSE)
    best = met.groupBy("set").agg(F.min(F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("other_fp"))).alias("bits"), "other")).alias("best"))
    return best.select(F.col("best.other").alias("a"), F.col("set").alias("b"))


def common_shingles(hashes: list[np.ndarray]) -> np.ndarray:
    """How many shingles every two of the sets share; `COLUMNS` shingles at a time, as rows of flags for the sets that hold them."""
    codes, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)[1:]
    owner, met = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]), counts > 1
    owner, place = owner[met[codes]], (np.cumsum(met) - 1)[codes][met[codes]]
    order = np.lexsort((owner, place // COLUMNS))
    owner, place = owner[order], place[order]
    common = np.zeros((len(hashes), len(hashes)), np.int32)
    slices = np.searchsorted(place // COLUMNS, np.arange(-(-int(met.sum()) // COLUMNS) + 1))
    for lo, hi in zip(slices[:-1], slices[1:]):
        at, own = place[lo:hi] % COLUMNS, owner[lo:hi]
        held = np.zeros((COLUMNS, len(hashes)), np.uint8)
        held[at, own] = 1
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        for i, part in zip(own[starts], np.split(at, starts[1:])):
            common[i] += held[part].sum(axis=0, dtype=np.int32)
    return common


def _cell_edges(rows: pd.DataFrame) -> pd.DataFrame:
    """Edges u, v that connect the sets of a cell as all links do that are not connected yet."""
    sets, comp = rows["set"].to_numpy(np.int64), rows["comp"].to_numpy(np.int64)
    fp, n = rows["fp"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    close = (comp[:, None] != comp[None, :]) & (np.bitwise_count(fp[:, None] ^ fp[None, :]) <= RADIUS)
    close &= 5 * np.minimum(n[:, None], n[None, :]) >= 4 * np.maximum(n[:, None], n[None, :])
    used = np.flatnonzero(close.any(axis=1))
    if not len(used):
        return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
    sets, n, close = sets[used], n[used], close[np.ix_(used, used)]
    close &= common_shingles([np.asarray(rows["hashes"].iat[i], np.int64) for i in used]) * 9 >= (n[:, None] + n[None, :]) * 4
    root = spanning(len(sets), [np.nonzero(np.triu(close))])
    moved = root != np.arange(len(sets))
    return pd.DataFrame({"u": sets[root[moved]], "v": sets[moved]})


def _tiles_compared(now: DataFrame, mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges u, v that connect the sets of the mixed tiles as all their links would, a large tile in cells of two blocks."""
    blocks = F.ceil(F.greatest(F.col("rows") / BLOCK, F.col("held") / HELD)).cast("int")
    dealt = now.join(mixed.select("key", blocks.alias("k")), "key").withColumn("own", F.pmod(F.xxhash64("set"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cells = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "set", "n", "fp", "comp")
    return cells.join(sets, "set").groupBy("key", "i", "j").applyInPandas(_cell_edges, "u long, v long")


def linked(distinct: DataFrame, texts_of, known: DataFrame) -> DataFrame | None:
    """Columns node, root of the sets that are linked, None without links or candidates.

    `distinct` has one row a set with the columns of `SKETCH`. `texts_of` gets the sets that are candidates (column set) and
    gives a text of each (columns set, text). `known` are links (columns u, v, a written table) that hold already. Tables written on the way are deleted as soon as others replace them.
    """
    keys = distinct.select("set", "n", "fp", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = staged(keys.join(shared, "key"), "members")
    wanted = members.select("set").distinct()
    if not members.limit(1).count():
        roots = components(known) if known.limit(1).count() else None
        discard(members, known)
        return roots
    sets = staged(map_rows(texts_of(wanted), lambda texts: {"hashes": [shingles(t).view(np.int64) for t in texts]}, "text",
                           "hashes array<long>", ["set"]).dropDuplicates(["set"]), "sets")

    def grown(links: DataFrame, further: DataFrame) -> DataFrame:
        """The roots of what is linked by `links` or by further links."""
        found = staged(further, "links")
        roots = components(links.unionByName(found))
        discard(links, found)
        return roots

    def grown_by(links: DataFrame, pairs: DataFrame) -> DataFrame:
        """The same, by the links among pairs."""
        pairs = staged(pairs, "pairs")
        roots = grown(links, _similar(pairs, sets))
        discard(pairs)
        return roots

    def as_links(roots: DataFrame) -> DataFrame:
        return roots.select(F.col("root").alias("u"), F.col("node").alias("v"))

    roots = grown_by(known, _small_tiles(members))
    large = members.where(F.col("size") > SMALL)
    for number in range(STARS + 1):
        now = staged(large.join(roots.withColumnRenamed("node", "set"), "set", "left").select(
            "key", "set", "n", "fp", F.coalesce("root", "set").alias("comp")), "labelled")
        own = F.struct(F.xxhash64("set", F.lit(number)).alias("h"), "set", "n", "fp", "comp")
        mixed = staged(now.groupBy("key").agg(
            F.count("*").alias("rows"), F.sum("n").alias("held"), F.min("comp").alias("c0"), F.max("comp").alias("c1"),
            F.min(own).alias("low"), F.max(own).alias("high")).where("c0 <> c1").drop("c0", "c1"), "mixed")
        huge = mixed.where(F.col("rows") > CELLS * BLOCK)
        again = number < STARS and huge.limit(1).count()
        if again:
            roots = grown_by(as_links(roots), _stars(now, huge))
        elif mixed.limit(1).count():
            roots = grown(as_links(roots), _tiles_compared(now, mixed, sets))
        discard(now, mixed)
        if not again:
            break
    discard(members, sets)
    return roots
