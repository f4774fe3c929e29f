"""Shuffled shards without a shuffle key: a keyed Feistel permutation of the global row numbers.

Rows are numbered in the order of their ids. The permutation works on m * m numbers, m the least whole number whose square
holds all rows; a number that leaves the table is permuted again until it is back (cycle walking). A row's place after the
permutation gives its shard (place mod shards) and slot (place div shards), and `row_at` gives the row of a shard's slot,
so either can be computed from the other with nothing looked up. Shards differ by one row at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodetide.llm.common import discard, numbered, spare_name, staged

ROUNDS = 4
SHARDS, SEED = 16, 42
#: Numbers outside the table that a task permutes; there are fewer than twice the root of the rows.
AT_ONCE = 1 << 18


def _div(a: Column, b: Column) -> Column:
    """Whole-number division, exact for all longs."""
    return F.call_function("div", a, b)


class Permutation:
    """A permutation of 0 .. rows - 1 that `seed` chooses, as column expressions."""

    def __init__(self, spark: SparkSession, rows: int, seed: int):
        self.rows, self.seed = rows, seed
        self.side = math.isqrt(max(rows, 1) - 1) + 1
        self.walks = self._longest(spark, self._rounds), self._longest(spark, self._rounds_back)

    def _mixed(self, number: Column, value: Column) -> Column:
        """The round function: 60 bits of a digest of seed, round and value."""
        digest = F.md5(F.concat_ws(":", F.lit(self.seed).cast("string"), number.cast("string"), value.cast("string")).cast("binary"))
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    def _halves(self, x: Column) -> Column:
        m = F.lit(self.side).cast("long")
        return F.struct(_div(x, m).alias("l"), (x % m).alias("r"))

    def _rounds(self, x: Column) -> Column:
        m = F.lit(self.side).cast("long")
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), self._halves(x), lambda s, k: F.struct(
            s["r"].alias("l"), ((s["l"] + self._mixed(k, s["r"])) % m).alias("r")), lambda s: s["l"] * m + s["r"])

    def _rounds_back(self, x: Column) -> Column:
        m = F.lit(self.side).cast("long")
        return F.aggregate(F.sequence(F.lit(ROUNDS), F.lit(1)), self._halves(x), lambda s, k: F.struct(
            F.pmod(s["r"] - self._mixed(k, s["l"]), m).alias("l"), s["l"].alias("r")), lambda s: s["l"] * m + s["r"])

    def _longest(self, spark: SparkSession, step) -> int:
        """How often a number that left the table has to be permuted again at most.

        The numbers outside, below 2 * side of them and so few tasks, are permuted until no more of them come back; those left then are on
        cycles wholly outside, which no row enters.
        """
        end, walks = self.side * self.side, 0
        left = max(end - self.rows, 0)
        outside = spark.range(self.rows, self.rows + left, numPartitions=-(-left // AT_ONCE) or 1)
        while left:
            tables, before = [outside] if walks else [], left
            outside = staged(outside.select(step(F.col("id")).alias("id")).where(F.col("id") >= self.rows), "walks")
            discard(*tables)
            left = outside.count()
            if left == before:
                break
            walks += 1
        return walks

    def _walk(self, x: Column, step, walks: int) -> Column:
        first = step(x.cast("long"))
        if not walks:
            return first
        return F.aggregate(F.sequence(F.lit(1), F.lit(walks)), first, lambda y, _: F.when(y >= self.rows, step(y)).otherwise(y))

    def place(self, row: Column) -> Column:
        """Where a row number goes."""
        return self._walk(row, self._rounds, self.walks[0])

    def row(self, place: Column) -> Column:
        """The row number that goes to a place."""
        return self._walk(place, self._rounds_back, self.walks[1])


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """For every row its id, size (UTF-8 bytes of the text and 1), text_crc32 (unsigned), shard, slot, and the columns `keep`.

    Rows are numbered by id, null ids first, then by size, checksum and hash of the text; rows equal in all of these stand in
    no order of their own, so only they can change places between runs. Null texts count as empty. Equal texts are not kept
    together: counts that differ by one at most leave no room for groups. The counts alone follow from the rows and not from
    texts or ids, so no key can make a shard hot. An empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    if shards < 1:
        raise ValueError("at least one shard")
    size, crc, tie, row, place = spare_name(docs, "size", "text_crc32", "tie", "row", "place")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    narrow = docs.select(id_col, (F.octet_length(text) + 1).cast("long").alias(size), F.crc32(text).alias(crc), F.xxhash64(text).alias(tie), *keep)
    narrow = staged(narrow, "sized")
    order = Permutation(spark, narrow.count(), seed)
    placed = numbered(narrow, [F.col(id_col), F.col(size), F.col(crc), F.col(tie)], row).withColumn(place, order.place(F.col(row)))
    number = F.lit(shards).cast("long")
    return placed.select(id_col, F.col(size).alias("size"), F.col(crc).alias("text_crc32"), (F.col(place) % number).cast("int").alias("shard"),
                         _div(F.col(place), number).alias("slot"), *keep)


def row_at(spark: SparkSession, rows: int, shard: int, slot: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The number of the row that a shard holds at a slot, of a table of `rows` rows."""
    place = slot * shards + shard
    if not 0 <= place < rows or not 0 <= shard < shards:
        raise ValueError(f"shard {shard} has no slot {slot}")
    return spark.range(1).select(Permutation(spark, rows, seed).row(F.lit(place).cast("long"))).first()[0]


def write(docs: DataFrame, folder: str, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all columns of all rows to `folder`, a subfolder a shard, each file a run of slots in ascending order.

    The columns shard and slot come to the rows' own, under other names where those are taken.
    """
    own = spare_name(docs, "shard", "slot")
    rest = {c: f"kept_{i}" for i, c in enumerate(docs.columns) if c != id_col}
    kept = docs.select(id_col, F.col(text_col).alias("read_text"), *[F.col(f"`{c}`").alias(n) for c, n in rest.items()])
    dealt = assign(kept, shards, seed, id_col, "read_text", tuple(rest.values()))
    dealt = dealt.select(id_col, *[F.col(n).alias(c) for c, n in rest.items()], F.col("shard").alias(own[0]), F.col("slot").alias(own[1]))
    dealt.repartitionByRange(*own).sortWithinPartitions(*own).write.partitionBy(own[0]).parquet(folder)
