"""Benchmark decontamination: every passage of every text queries a BM25 index of the test items, by block-max WAND.

Test items are cut into segments of at most `STRIDE` words. The inverted index stores, for every word, the share of a
segment's own best score that the word brings (so a passage that holds all words of a segment scores 1), and the largest
such share in each block of `BLOCK` segments. A text is read in passages of two strides that overlap by one, so any
segment lies wholly within one passage. Block maxima are summed for all passages of a text at once; a block whose sum
stays below the threshold cannot hold a hit and is skipped, the others are scored in full. All items above the threshold
are retrieved and then verified: question and answer must both stand in the text, by their five-word shingles.

The index is built from the whole test set, in parts of `part_bytes` of text where that is larger: word statistics are
those of the whole set, each part is one pass over the texts. The texts are never shuffled.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodetide.llm.common import map_rows, prepare, staged

STRIDE, BLOCK, SHINGLE = 32, 4, 5
K1, B = 1.2, 0.75
WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
LEAKS = "array<struct<item_id: long, score: double, question: double, answer: double>>"
PART_BYTES = 4 << 20


@dataclass(frozen=True)
class LeakConfig:
    """Least BM25 share for retrieval; least shares of the question's and the answer's shingles for a leak."""

    score: float = 0.5
    question: float = 0.5
    answer: float = 0.5
    part_bytes: int = PART_BYTES


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def segments(words: list[str]) -> list[list[str]]:
    """The words in nearly equal runs of at most STRIDE."""
    n = -(-len(words) // STRIDE)
    return [words[len(words) * i // n:len(words) * (i + 1) // n] for i in range(n)]


def shingles(words: list[str]) -> list[tuple[str, ...]]:
    return [tuple(words[i:i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)] or ([tuple(words)] if words else [])


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of all sentences but the last, and of the last; of a single sentence the first two thirds and the rest."""
    parts = [w for w in map(words_of, SENTENCE.split(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = -(-2 * len(words) // 3)
    return words[:cut], words[cut:] or words[:cut]


@dataclass
class Part:
    """Test items of one index, with statistics of the whole test set: segments, their mean length, segments by word."""

    items: list[tuple[int, str]]
    n: int
    mean: float
    frequency: dict[str, int]
    uid: str = field(default_factory=lambda: uuid.uuid4().hex)


class Index:
    """The inverted index of a part."""

    def __init__(self, part: Part):
        rows = [(item, seg) for item, (_, text) in enumerate(part.items) for seg in segments(words_of(text))]
        idf = {w: math.log(1 + (part.n - f + 0.5) / (f + 0.5)) for w, f in part.frequency.items()}
        weighed = []
        for item, seg in rows:
            norm = K1 * (1 - B + B * len(seg) / part.mean)
            w = {t: idf[t] * k * (K1 + 1) / (k + norm) for t, k in Counter(seg).items()}
            own = sum(w.values())
            weighed.append((own, item, {t: x / own for t, x in w.items()}))
        weighed.sort(key=lambda s: s[0])  # segments with like scores share blocks: tight maxima
        self.items = part.items
        self.item_of = np.array([item for _, item, _ in weighed], np.int64)
        self.words = {w: i for i, w in enumerate(sorted(part.frequency))}
        blocks = -(-len(weighed) // BLOCK)
        self.maxima = np.zeros((len(self.words), max(1, blocks)), np.float32)
        found: list[list[tuple[int, float]]] = [[] for _ in self.words]
        for s, (_, _, w) in enumerate(weighed):
            for t, x in w.items():
                i = self.words[t]
                found[i].append((s, x))
                self.maxima[i, s // BLOCK] = max(self.maxima[i, s // BLOCK], np.nextafter(np.float32(x), np.float32(2)))
        self.postings = [dict(_by_block(p)) for p in found]

    def _known(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Passage and word of every known word, each word once in a passage, by passage."""
        get, ids, n = self.words.get, [], 0
        for n, w in enumerate(WORD.findall(text.lower()), 1):
            i = get(w)
            if i is not None:
                ids.append((n - 1) // STRIDE * len(self.words) + i)
        keys, v, strides = np.array(ids, np.int64), max(1, len(self.words)), -(-n // STRIDE)
        # A stride belongs to its own passage and to the one before; the last one only to that, if there is one.
        keys = np.concatenate([keys[keys < (strides - 1) * v] if strides > 1 else keys, keys[keys >= v] - v])
        keys = np.unique(keys)
        return keys // v, keys % v

    def retrieve(self, text: str, least: float) -> dict[int, float]:
        """Best score of every item (by place in `items`) that a passage of the text finds with at least `least`."""
        passage, word = self._known(text)
        best: dict[int, float] = {}
        _, first = np.unique(passage, return_index=True)
        ends = np.append(first[1:], len(word))
        step, at = max(1, (4 << 20) // self.maxima.shape[1]), 0
        while at < len(first):  # whole passages, a bounded number of words at a time
            to = max(at + 1, int(np.searchsorted(ends, first[at] + step, "right")))
            bounds = np.add.reduceat(self.maxima[word[first[at]:ends[to - 1]]], first[at:to] - first[at], axis=0)
            previous, terms = -1, []
            for w, b in np.argwhere(bounds >= least - 1e-4).tolist():
                if w != previous:
                    previous, terms = w, word[first[at + w]:ends[at + w]].tolist()
                scores: dict[int, float] = {}
                for t in terms:
                    for s, x in self.postings[t].get(b, ()):
                        scores[s] = scores.get(s, 0.0) + x
                for s, x in scores.items():
                    if x >= least - 1e-9:
                        item = int(self.item_of[s])
                        best[item] = max(best.get(item, 0.0), min(1.0, x))
            at = to
        return best

    def leaks(self, text: str | None, config: LeakConfig) -> list[dict]:
        """Verified items of a text: item_id, score, shares of the question and the answer; by item_id."""
        found = self.retrieve(text or "", config.score)
        if not found:
            return []
        parts = {item: tuple(set(shingles(p)) for p in question_and_answer(self.items[item][1])) for item in found}
        sizes = {len(s) for q, a in parts.values() for s in (*q, *a)}
        wanted = {s for q, a in parts.values() for s in (*q, *a)}
        words, seen = words_of(text), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                s = tuple(words[i:i + size])
                if s in wanted:
                    seen.add(s)
        out: dict = {}
        for item, (q, a) in parts.items():
            item_id, shares = self.items[item][0], (len(q & seen) / len(q), len(a & seen) / len(a))
            if shares[0] >= config.question and shares[1] >= config.answer:
                row = {"item_id": item_id, "score": found[item], "question": shares[0], "answer": shares[1]}
                if item_id not in out or row["score"] > out[item_id]["score"]:
                    out[item_id] = row
        return [out[k] for k in sorted(out, key=lambda k: (k is None, k or 0))]


def _by_block(postings):
    groups: dict[int, list] = defaultdict(list)
    for s, x in postings:
        groups[s // BLOCK].append((s, x))
    return groups.items()


_BUILT: dict[str, Index] = {}


def index_of(part: Part) -> Index:
    """The part's index; a worker builds it once."""
    if part.uid not in _BUILT:
        if len(_BUILT) >= 2:
            _BUILT.clear()
        _BUILT[part.uid] = Index(part)
    return _BUILT[part.uid]


def parts(benchmark: DataFrame, config: LeakConfig = LeakConfig(), item_col: str = "item_id", text_col: str = "text") -> Iterator[Part]:
    """The test set in parts of about `part_bytes`, each with the statistics of all. Items without words are left out."""
    spark = benchmark.sparkSession
    prepare(spark)

    def cut(texts):
        made = [segments(words_of(t)) for t in texts]
        return {"n": [len(s) for s in made], "length": [sum(map(len, s)) for s in made], "terms": [[w for g in s for w in set(g)] for s in made]}

    items = staged(map_rows(benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("body")), cut, "body",
                            "n long, length long, terms array<string>", ["item", "body"]).where("n > 0"), "test-items")
    n, length, size = items.agg(F.sum("n"), F.sum("length"), F.sum(F.octet_length("body"))).first()
    if not n:
        return
    count = -(-size // config.part_bytes)
    frequency = staged(items.select(F.explode("terms").alias("word")).groupBy("word").agg(F.count("*").alias("n")), "test-words")
    numbered = items.withColumn("part", F.pmod(F.xxhash64("item", "body"), F.lit(count)))
    for k in range(count):
        own = numbered.where(F.col("part") == k)
        rows = [(r["item"], r["body"]) for r in own.select("item", "body").collect()]  # part_bytes of text
        if rows:
            words = own.select(F.explode("terms").alias("word")).distinct()
            known = {r["word"]: r["n"] for r in frequency.join(words, "word", "left_semi").collect()}
            yield Part(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])), n, length / n, known)


def leaked(part: Part, config: LeakConfig, text_col: str = "text") -> Column:
    """Array of the verified items of a text, of this part of the test set."""

    @F.pandas_udf(LEAKS)
    def find(texts: pd.Series) -> pd.Series:
        index = index_of(part)
        return pd.Series([index.leaks(t, config) for t in texts], dtype=object)

    return find(F.col(text_col))


def find_leaks(docs: DataFrame, benchmark: DataFrame, config: LeakConfig = LeakConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every text and test item that it holds: id, item_id, score, question and answer (shares found).

    Null and empty texts hold nothing, nor do texts or items without words; items with equal ids count once, with their
    best score; repeated rows give repeated results; further columns are ignored; an empty test set or table gives an
    empty result.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col))
    found = docs.sparkSession.createDataFrame([], f"`{id_col}` {dict(rows.dtypes)[id_col]}, item_id long, score double, question double, answer double")
    for part in parts(benchmark, config):
        found = found.union(rows.select(id_col, F.inline(leaked(part, config, text_col))))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, config: LeakConfig = LeakConfig(), text_col: str = "text") -> DataFrame:
    """The rows, unchanged, whose text holds no test item."""
    prepare(docs.sparkSession)
    for part in parts(benchmark, config):
        docs = docs.where(F.size(leaked(part, config, text_col)) == 0)
    return docs
