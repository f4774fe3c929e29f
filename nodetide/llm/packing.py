"""Packing of documents into sequences: Martello-Toth dominance reduction, then best fit.

Pieces of equal length are interchangeable, so the packing is found from the number of pieces of each length: at most
`size` numbers, however many documents there are. The reduction goes through the lengths from the longest and fixes
sequences that dominate every alternative: a piece that nothing fits beside, a pair that fills a sequence, a pair where at
most one more piece fits, and a pair whose second piece is at least as long as any two that fit. What is left is packed by
best fit, longest first, whole groups of equal sequences at a time. The plan is a list of runs (so many pieces of a length
go to consecutive sequences at one offset) and does not grow with the documents.

Pieces find their places by rank among those of their length: their rank within the task that encoded them plus the counts
of the tasks before. No piece is moved for that but by the join with these counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodetide.llm import tokens
from nodetide.llm.common import prepare, staged

SIZE = 2048
END = 0

Run = tuple[int, int, int, int, int]  # length, first rank, pieces, first sequence, offset


def _largest(counts: list[int], most: int) -> int:
    """The largest length up to `most` that is there, or 0."""
    return next((s for s in range(min(most, len(counts) - 1), 0, -1) if counts[s]), 0)


def _best_pair(counts: list[int], most: int) -> int:
    """The largest sum up to `most` of two pieces that are there, or 0."""
    sizes = [s for s in range(1, min(most, len(counts) - 1) + 1) if counts[s]]
    best, i, j = 0, 0, len(sizes) - 1
    while i <= j:
        total = sizes[i] + sizes[j]
        if total > most:
            j -= 1
        else:
            if i < j or counts[sizes[i]] > 1:
                best = max(best, total)
            i += 1
    return best


def reduce_by_dominance(counts: list[int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences fixed for good: (lengths, how many such sequences). `counts` (by length) keeps what is left."""
    fixed = []
    for length in range(size, 0, -1):
        while counts[length]:
            counts[length] -= 1  # the piece in hand
            room = size - length
            least, n = [], 1
            while len(least) < 3 and n <= room:  # the three shortest others, as far as one fits
                least += [n] * min(3 - len(least), counts[n])
                n += 1
            partner = _largest(counts, room)
            counts[length] += 1
            if not partner:
                fixed.append(((length,), counts[length]))
                counts[length] = 0
                continue
            fits = sum(sum(least[:k + 1]) <= room for k in range(len(least)))
            if not (partner == room or fits <= 1 or fits == 2 and partner >= _best_pair_without(counts, length, room)):
                break
            times = counts[length] // 2 if partner == length else min(counts[length], counts[partner])
            fixed.append(((length, partner), times))
            counts[length] -= times
            counts[partner] -= times
    return fixed


def _best_pair_without(counts: list[int], length: int, room: int) -> int:
    counts[length] -= 1
    best = _best_pair(counts, room)
    counts[length] += 1
    return best


def plan(counts: list[int], size: int = SIZE) -> tuple[list[Run], int]:
    """Runs that place all pieces (`counts` by length, index 0 unused), and the number of sequences."""
    left = list(counts) + [0] * (size + 1 - len(counts))
    rank, runs, sequences = [0] * (size + 1), [], 0

    def place(length: int, pieces: int, first: int, offset: int) -> None:
        if pieces:
            runs.append((length, rank[length], pieces, first, offset))
            rank[length] += pieces

    for lengths, times in reduce_by_dominance(left, size):
        offset = 0
        for length in lengths:
            place(length, times, sequences, offset)
            offset += length
        sequences += times
    open_: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by room left: (first sequence, how many)

    def fill(length: int, first: int, many: int, room: int, pieces: int) -> int:
        """Put pieces into `many` equal sequences one after the other, each as full as it gets; how many pieces that took."""
        each = room // length
        full = min(many, pieces // each)
        for k in range(each):
            place(length, full, first, size - room + k * length)
        if full:
            open_[room - each * length].append((first, full))
        rest = min(pieces - full * each, each) if full < many else 0
        for k in range(rest):
            place(length, 1, first + full, size - room + k * length)
        if rest:
            open_[room - rest * length].append((first + full, 1))
        if many > full + (rest > 0):
            open_[room].append((first + full + (rest > 0), many - full - (rest > 0)))
        return full * each + rest

    for length in range(size, 0, -1):
        pieces = left[length]
        for room in range(length, size):
            while pieces and open_[room]:
                pieces -= fill(length, *open_[room].pop(), room, pieces)
            if not pieces:
                break
        if pieces:
            many = -(-pieces // (size // length))
            fill(length, sequences, many, size, pieces)
            sequences += many
    return runs, sequences


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: only the first may be shorter than a sequence, if there are more."""
    first = n % size or size
    return [(0, first)] + [(at, size) for at in range(first, n, size)] if n else []


def _encoded(path: str, size: int, end: int, keep_ids: bool, arrow: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, ranks, encode = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64), tokens.encoder(path).ids
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            row, out = [], {k: [] for k in ("piece", "start", "length", "ids_crc32", "rank", "ids")}
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = encode(text or "") + tail
                for piece, (start, length) in enumerate(cut(len(data) // 4, size)):
                    ids = data[start * 4:(start + length) * 4]
                    row.append(i)
                    for k, v in zip(out, (piece, start, length, zlib.crc32(ids), int(ranks[length]), ids if keep_ids else None)):
                        out[k].append(v)
                    ranks[length] += 1
            made = {"part": [part] * len(row), **out}
            id_column = batch.column(0).take(pa.array(row, pa.int64())).cast(arrow.field(0).type)
            yield pa.RecordBatch.from_arrays([id_column, *[pa.array(made[f.name], f.type) for f in list(arrow)[1:]]], schema=arrow)

    return run


def _placed(runs: list[Run], arrow: pa.Schema):
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    keys = table[:, 0] << 48 | table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length, rank = (column[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "rank"))
            at = np.searchsorted(keys, length << 48 | rank, "right") - 1
            made = {"sequence_id": table[at, 3] + rank - table[at, 1], "offset": table[at, 4]}
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else column[f.name].cast(f.type) for f in arrow], schema=arrow)

    return run


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END, keep_ids: bool = False,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every piece: id, piece, start, length, ids_crc32, sequence_id, offset, and ids (bytes) with `keep_ids`.

    Null texts count as empty: one piece that is the end id. Repeated rows are packed each for itself; further columns are
    ignored; an empty table gives an empty result. Which of several pieces of one length goes where depends on the dealing
    of the rows to tasks; the number of sequences does not.
    """
    from nodetide.llm.common import _arrow_schema

    spark = docs.sparkSession
    prepare(spark)
    path = path or tokens.public_path()
    rows = docs.select(F.col(id_col), F.col(text_col))
    kind = rows.schema[0].dataType.simpleString()
    schema = spark.createDataFrame([], f"`{id_col}` {kind}, part int, piece int, start long, length long, ids_crc32 long, rank long, ids binary").schema
    made = staged(rows.mapInArrow(_encoded(path, size, end, keep_ids, _arrow_schema(schema)), schema), "pieces")
    counted = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = staged(counted.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "bases")
    counts = [0] * (size + 1)
    for length, n in bases.groupBy("length").agg(F.sum("n")).collect():  # at most `size` rows
        counts[length] = n
    runs, _ = plan(counts, size)
    ranked = made.join(bases.drop("n"), ["part", "length"]).select(
        id_col, "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"), *["ids"] * keep_ids)
    schema = spark.createDataFrame([], f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
                                   + ", ids binary" * keep_ids).schema
    return ranked.mapInArrow(_placed(runs, _arrow_schema(schema)), schema)
