"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has 64 bits: a bit is set if it is set in over half of the hashes of the text's word shingles.
Texts whose fingerprints differ in at most `radius` bits are linked; linked texts form components.

Equal fingerprints are first reduced to one. The distinct ones are dealt into tiles. Two fingerprints within the radius
agree wholly in one of radius + 1 ranges of bits, so each is put into one tile for each range, chosen by its leading bits
there; the number of leading bits grows with the table, so a tile keeps its size. A tile larger than `TILE` is cut by
population count, and a count that is still too frequent into blocks: only cuts whose counts differ by the radius or less
are brought together. Inside a task numpy takes exclusive-or and bit counts of whole blocks, sorted by population count,
and skips block pairs whose counts lie further apart than the radius. Nothing is approximate.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodetide.llm import nearcopies
from nodetide.llm.common import discard, map_rows, prepare, spare_name, staged
from nodetide.llm.components import components, spanning

SEED = 42
BITS = 64
#: Fingerprints a tile is meant to hold, and rows numpy compares at a time.
TILE, BLOCK = 4096, 1024
#: Hashes whose bits are counted at a time.
COUNT_AT_ONCE = 1 << 14


def _bit_totals(hashes: np.ndarray) -> np.ndarray:
    octets = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """Fingerprint of a whole text; 0 for a null text or one without words. The shingles are hashed slice by slice."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    totals = np.zeros(BITS, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, COUNT_AT_ONCE):
        part = words[at:min(n, at + COUNT_AT_ONCE) + width - 1]
        found = [digest(join(part[i:i + width]), SEED) for i in range(min(COUNT_AT_ONCE, n - at))]
        totals += _bit_totals(np.array(found, np.uint64))
    return int((np.uint64(1) << np.flatnonzero(totals * 2 > n).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns `id_col` and fp (the 64 bits as a long) for every row."""
    prepare(docs.sparkSession)

    def of(texts):
        return {"fp": np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)}

    return map_rows(docs, of, text_col, "fp long", [id_col])


def _close_pairs(left: np.ndarray, right: np.ndarray, radius: int, same: bool):
    """Index pairs within the radius; both sides sorted by population count; for `same` only pairs i < j."""
    cl, cr = np.bitwise_count(left).astype(np.int16), np.bitwise_count(right).astype(np.int16)
    for i in range(0, len(left), BLOCK):
        a, ca = left[i:i + BLOCK], cl[i:i + BLOCK]
        lo = np.searchsorted(cr, ca[0] - radius, "left")
        hi = np.searchsorted(cr, ca[-1] + radius, "right")
        for j in range(max(lo, i) if same else lo, hi, BLOCK):
            b = right[j:min(hi, j + BLOCK)]
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
            x, y = x + i, y + j
            if same:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield x, y


def _tile_edges(radius: int):
    def edges(rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
        side = rows["side"].to_numpy()
        order = np.argsort(np.bitwise_count(fp), kind="stable")
        fp, side = fp[order], side[order]
        if (side == 0).all():
            nodes, pairs = fp, _close_pairs(fp, fp, radius, True)
        else:
            left, right = fp[side == 1], fp[side == 2]
            nodes = np.concatenate([left, right])
            pairs = ((x, y + len(left)) for x, y in _close_pairs(left, right, radius, False))
        root = spanning(len(nodes), pairs)
        moved = (root != np.arange(len(nodes))) & (nodes[root] != nodes)
        return pd.DataFrame({"u": nodes[root][moved].view(np.int64), "v": nodes[moved].view(np.int64)})

    return edges


def close_edges(distinct: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """Edges u, v that connect the distinct fingerprints (column fp) as all pairs within the radius would."""
    spark = distinct.sparkSession
    n = distinct.count()
    ranges = radius + 1
    cuts = [BITS * b // ranges for b in range(ranges + 1)]
    lead = max(0, min(BITS // ranges, math.ceil(math.log2(max(1, n) / tile))))
    bands = F.array(*[
        F.struct(F.lit(b).alias("band"), F.shiftrightunsigned(F.shiftleft("fp", BITS - cuts[b + 1]), BITS - lead).alias("head"))
        if lead else F.struct(F.lit(b).alias("band"), F.lit(0).cast("long").alias("head"))
        for b in (range(ranges) if lead else range(1))])
    dealt = distinct.select("fp", F.explode(bands).alias("t")).select("t.*", "fp")
    sizes = dealt.groupBy("band", "head").count().where(F.col("count") > 2 * tile).select("band", "head", F.lit(True).alias("hot"))
    marked = staged(dealt.join(sizes, ["band", "head"], "left").select(
        "band", "head", "fp", F.coalesce("hot", F.lit(False)).alias("hot"), F.bit_count("fp").alias("ones")), "tiles")
    plain = marked.where("not hot").select("band", "head", F.lit(-1).alias("ones"), F.lit(0).alias("i"), F.lit(0).alias("j"),
                                           F.lit(0).alias("side"), "fp")
    hot = marked.where("hot").drop("hot")
    blocks = hot.groupBy("band", "head", "ones").agg(F.ceil(F.count("*") / tile).cast("int").alias("k"))
    block = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("k")).cast("int")
    left = hot.join(blocks, ["band", "head", "ones"])
    # A left block meets every right block of its own count and of the next ones, up to the radius.
    near = blocks.select("band", "head", F.explode(F.sequence(F.col("ones") - radius, F.col("ones"))).alias("ones"), F.col("ones").alias("right_ones"),
                         F.col("k").alias("right_k"))
    met = near.join(blocks, ["band", "head", "ones"])
    as_left = left.withColumn("i", block).join(met.select("band", "head", "ones", "right_ones", "right_k"), ["band", "head", "ones"]).select(
        "band", "head", (F.col("ones") * 100 + F.col("right_ones")).alias("ones"), "i", F.explode(F.sequence(F.lit(0), F.col("right_k") - 1)).alias("j"),
        F.lit(1).alias("side"), "fp")
    other = met.select("band", "head", F.col("ones").alias("left_ones"), F.col("right_ones").alias("ones"), F.col("k").alias("left_k"))
    as_right = left.withColumn("j", block).join(other, ["band", "head", "ones"]).select(
        "band", "head", (F.col("left_ones") * 100 + F.col("ones")).alias("ones"), F.explode(F.sequence(F.lit(0), F.col("left_k") - 1)).alias("i"),
        "j", F.lit(2).alias("side"), "fp").select("band", "head", "ones", "i", "j", "side", "fp")
    cells = plain.unionByName(as_left).unionByName(as_right)
    return cells.groupBy("band", "head", "ones", "i", "j").applyInPandas(_tile_edges(radius), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, tile: int = TILE) -> DataFrame:
    """For every row its id, fp, component_id (the smallest id linked with it, itself included).

    Null texts count as empty; texts without words have fingerprint 0 and are linked like any other. Rows with equal ids
    are rows of their own. A component without any id has component_id null. An empty table gives an empty result; further
    columns are ignored.
    """
    prints = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.min(id_col).alias("least_id")), "distinct")
    roots = components(close_edges(distinct.select("fp"), radius, tile))
    labelled = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = labelled.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(id_col, "fp", "component_id")


def fingerprint_links(sets: DataFrame, radius: int = 2) -> DataFrame:
    """Links u, v between sets (columns set, fp) that connect them as all pairs of fingerprints within the radius would; a written table."""
    least = staged(sets.groupBy("fp").agg(F.min("set").alias("least")), "fingerprints")
    equal = sets.join(least, "fp").where("set <> least").select(F.col("least").alias("u"), F.col("set").alias("v"))
    left, right = (least.select(F.col("fp").alias(f"{end}_fp"), F.col("least").alias(end)) for end in "uv")
    close = close_edges(least.select("fp"), radius).select(F.col("u").alias("u_fp"), F.col("v").alias("v_fp"))
    links = staged(close.join(left, "u_fp").join(right, "v_fp").select("u", "v").unionByName(equal), "links")
    discard(least)
    return links


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of one document of every component, all columns as they are: the one with the smallest id.

    Texts are linked as in `near_duplicates`, by fingerprints that differ in at most two bits, here of the set of five-word
    shingles; further, if these sets have a Jaccard similarity of 0.8 or more. Fingerprints of such texts differ in more bits
    than tiles of equal bits reach, so the tiles of this second step are formed by MinHash (`nearcopies`). Null texts count as empty; texts without words are one component. Very long texts are hashed slice by
    slice and are compared whole. Of several rows with the least id and text one is kept; of a component without ids the
    row whose text has the least hash.
    """
    prepare(docs.sparkSession)
    digest = spare_name(docs, "text_digest")[0]
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    prints = staged(map_rows(rows, nearcopies.sketches, "text", nearcopies.SKETCH, ["id", "digest"]), "sketches")
    first = F.struct(F.col("id").isNull().alias("no"), F.col("id"), F.col("digest"))
    distinct = staged(prints.groupBy("set").agg(F.min(first).alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "distinct")

    def texts_of(wanted: DataFrame) -> DataFrame:
        at = distinct.join(wanted, "set", "left_semi").select("set", F.col("first.id").alias("at_id"), F.col("first.digest").alias("at_digest"))
        return rows.join(at, rows["id"].eqNullSafe(at["at_id"]) & (rows["digest"] == at["at_digest"])).select("set", "text")

    roots, classes = nearcopies.linked(distinct, texts_of, fingerprint_links(distinct)), distinct.select("set", "first")
    if roots is None:
        kept = classes
    else:
        kept = classes.join(roots.withColumnRenamed("node", "set"), "set", "left").groupBy(F.coalesce("root", "set").alias("root")).agg(
            F.min("first").alias("first"))
    kept = staged(kept.select("first.id", "first.digest"), "kept")
    repeated = prints.groupBy("id", "digest").count().where("count > 1").limit(1).count()
    discard(prints, distinct, *([] if roots is None else [roots]))
    known = docs.withColumn(digest, F.xxhash64(text_col))
    found = known.join(kept, known[id_col].eqNullSafe(kept["id"]) & (known[digest] == kept["digest"]), "left_semi")
    if repeated:
        found = found.dropDuplicates([id_col, digest])
    return found.drop(digest)
