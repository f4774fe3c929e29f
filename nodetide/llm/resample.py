"""Importance resampling towards a target: hashed n-gram counts of the corpus and of target texts, Gumbel draw by keyed scores.

Words are runs of letters and digits (and all characters beyond ASCII); a feature is a run of 1 to `longest` consecutive words.
Separators are collapsed to single blanks, then one pattern for each length finds all runs, overlapping ones too: boundary
lookarounds let a match begin and end only where a word does. Features are counted in buckets by their CRC. The logarithm of
a bucket's share in the target over its share in the corpus is its gain, a document's weight the mean gain of its features.
Weight plus keyed Gumbel noise is the score, and the highest scores are a draw without replacement by weight.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodetide.llm.common import map_rows, numbered, prepare, spare_name, staged

#: Separators become blanks: ASCII but digits and letters. Bytes beyond ASCII belong to words.
BLANKS = bytes(b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Bytes of text whose features are found at a time, and features whose buckets a worker remembers.
SLICE, REMEMBERED = 1 << 20, 500_000


@dataclass(frozen=True)
class ResampleConfig:
    longest: int = 1        # words of the longest feature
    buckets: int = 10_000
    least_words: int = 20   # documents with fewer are not drawn
    percent: int = 10       # of the others are
    seed: int = 2024


def _patterns(longest: int) -> list:
    word = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]++"
    return [regex.compile(rb"(?<![^ ])" + word + rb"(?: " + word + rb"){%d}(?![^ ])" % (n - 1)) for n in range(1, longest + 1)]


def _collapsed(data: bytes) -> Iterator[bytes]:
    """The text with single blanks between its words, in slices that end with a word."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        if part := b" ".join(data[at:end].split()):
            yield part
        at = end


class Features:
    """Finds the features of texts and their buckets."""

    def __init__(self, longest: int, buckets: int):
        self.longest, self.buckets, self.patterns = longest, buckets, _patterns(longest)
        self.known: dict[bytes, int] = {}

    def spans(self, text: str | None) -> Iterator[tuple[bytes, int]]:
        """(feature, its words) for every feature, repeated ones each time."""
        lead = b""  # the last words of the slice before: features may begin there
        for part in _collapsed((text or "").encode("utf-8", "surrogatepass").lower().translate(BLANKS)):
            whole = lead + b" " + part if lead else part
            for n, pattern in enumerate(self.patterns, 1):
                for match in pattern.finditer(whole, overlapped=True):
                    if match.end() > len(lead):
                        yield match.group(), n
            if self.longest > 1:
                lead = b" ".join(whole.rsplit(b" ", self.longest - 1)[1 - self.longest:])

    def of(self, text: str | None) -> tuple[int, np.ndarray]:
        """Number of words, and the bucket of every feature."""
        words, out, known = 0, [], self.known
        for feature, n in self.spans(text):
            words += n == 1
            bucket = known.get(feature)
            if bucket is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                bucket = known[feature] = zlib.crc32(feature) % self.buckets
            out.append(bucket)
        return words, np.array(out, np.int64)


def hashed(rows: DataFrame, config: ResampleConfig, text_col: str, keep: list[str]) -> DataFrame:
    """The columns `keep`, n_words, n_features and found (the buckets of all features) for every row."""
    kind = _width(config)

    def of(texts: list) -> dict[str, list]:
        finder = Features(config.longest, config.buckets)
        made = [finder.of(t) for t in texts]
        return {"n_words": [w for w, _ in made], "n_features": [len(b) for _, b in made], "found": [b.astype(kind).tobytes() for _, b in made]}

    return map_rows(rows, of, text_col, "n_words long, n_features long, found binary", keep)


def _width(config: ResampleConfig) -> str:
    return "<u2" if config.buckets <= 1 << 16 else "<u4"


def bucket_counts(found: DataFrame, config: ResampleConfig) -> np.ndarray:
    """Features in each bucket. A task sums its rows first; `config.buckets` sums reach the driver."""
    kind, buckets = _width(config), config.buckets

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column(0):
                total += np.bincount(np.frombuffer(data.as_buffer(), kind), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in found.select("found").mapInArrow(sums, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket the floored thousandfold logarithm of its smoothed share in the target over that in the corpus."""
    buckets, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _noise(id_col: str, seed: int):
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("string")).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def draw(docs: DataFrame, target: DataFrame, config: ResampleConfig = ResampleConfig(), id_col: str = "doc_id", text_col: str = "text",
         target_text: str = "text") -> DataFrame:
    """For every row its id, n_words, n_features, weight, score and rank; rank counts from 1 for the rows drawn, null for others.

    Of the rows with `least_words` words, percent / 100 of them (rounded down) are drawn by descending score; equal scores by
    ascending id, null ids last, then by number of features; rows equal in these are alike in the result but for the rank.
    Null texts have no features and weight 0. A null id draws its noise from an empty one; rows of one id share their noise.
    An empty target or corpus is smoothed like any other; an empty table of documents gives an empty result. Further columns
    are ignored. Very long texts are taken in slices, features across their borders included.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    corpus = staged(hashed(rows, config, "text", ["id"]), "features")
    aims = hashed(target.select(F.col(target_text).alias("text")), config, "text", [])
    gain, kind = gains(bucket_counts(corpus, config), bucket_counts(aims, config)), _width(config)

    def weigh(found: list) -> dict[str, list]:
        at = [np.frombuffer(b, kind) for b in found]
        return {"weight": [int(gain[b].sum()) // len(b) if len(b) else 0 for b in at]}

    scored = map_rows(corpus, weigh, "found", "weight long", ["id", "n_words", "n_features"])
    scored = staged(scored.withColumn("score", F.col("weight") + _noise("id", config.seed)), "scored")
    fit = F.col("n_words") >= config.least_words
    chosen = scored.where(fit).count() * config.percent // 100
    order = [fit.desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features")]
    placed = numbered(scored, order, "place")
    rank = F.when(fit & (F.col("place") < chosen), F.col("place") + 1)
    return placed.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", rank.alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, config: ResampleConfig = ResampleConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that carry a drawn id, all columns as they are."""
    own = spare_name(docs, "drawn_id")[0]
    picked = draw(docs, target, config, id_col, text_col).where("rank is not null").select(F.col(id_col).alias(own)).distinct()
    return docs.join(picked, docs[id_col].eqNullSafe(picked[own]), "left_semi")
