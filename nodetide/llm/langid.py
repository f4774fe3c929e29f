"""Language identification: sparse multinomial logistic regression on TF-IDF weights of character n-grams.

Letters are lower-cased, everything else counts as one space; the 1- to 3-grams of a whole text are hashed to `DIM`
columns. A text's weights are relative frequencies times inverse document frequencies. The frequencies come from all
documents that may be learned from; the classifier itself is fitted on a bounded sample of them (`sample_docs`, dealt
evenly to the languages) by follow-the-regularised-leader with elastic-net penalties, and a temperature fitted on a fifth
of that sample turns its outputs into probabilities.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodetide.llm.common import prepare, staged

DIM = 1 << 16
UNKNOWN = "und"
SPACE = 32
#: Characters hashed at a time.
SLICE = 1 << 18
#: Multipliers of the characters in grams of one, two and three.
MIX = ((2654435761,), (2246822519, 3266489917), (668265263, 374761393, 3339683297))
#: Makes typical weights about one.
SCALE = 16.0


@dataclass(frozen=True)
class TrainConfig:
    """`sample_docs` bounds the documents fitted on, over all languages."""

    sample_docs: int = 6000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-3


@dataclass(frozen=True)
class Model:
    """Languages; weights of a gram for each (inverse document frequency included), the last row the intercept; temperature."""

    langs: tuple[str, ...]
    weights: np.ndarray
    temperature: float


@functools.cache
def _fold() -> np.ndarray:
    """For every code point its lower-case letter, or a space."""
    table = np.full(0x110000, SPACE, np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def grams(text: str) -> Iterator[np.ndarray]:
    """Columns of all grams of a text, slice by slice; nothing for a text without a letter."""
    if not any(map(str.isalpha, text)):
        return
    tail = np.array([SPACE], np.uint32)
    for at in range(0, len(text), SLICE):
        part = text[at:at + SLICE]
        folded = _fold()[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)]
        if at + SLICE >= len(text):
            folded = np.append(folded, np.uint32(SPACE))
        run = np.concatenate([tail, folded])
        keep = np.ones(len(run), bool)
        keep[1:] = (run[1:] != SPACE) | (run[:-1] != SPACE)
        run, old = run[keep], len(tail)
        for n, mix in enumerate(MIX, 1):
            first = max(0, old - n + 1)  # grams that lie wholly in the last slice were given there
            m = len(run) - first - n + 1
            if m > 0:
                h = np.zeros(m, np.uint32)
                for k, factor in enumerate(mix):
                    h += run[first + k:first + k + m] * np.uint32(factor)
                h ^= h >> np.uint32(15)
                h *= np.uint32(2246822519)
                yield (h >> np.uint32(16)).astype(np.int64)
        tail = run[-2:]


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n, seen = np.zeros(DIM, np.int64), 0, np.zeros(DIM, bool)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen[:] = False
            for h in grams(text or ""):
                seen[h] = True
            total += seen
            n += 1
    cols = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(cols, DIM), pa.int32()), pa.array(np.append(total[cols], n), pa.int64())], names=["gram", "docs"])


def document_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Documents that hold each gram; at the end the number of documents. Summed over all documents, DIM + 1 numbers."""
    counted = docs.select(text_col).mapInArrow(_document_frequencies, "gram int, docs long").groupBy("gram").agg(F.sum("docs").alias("docs"))
    out = np.zeros(DIM + 1, np.int64)
    for gram, n in counted.collect():  # at most DIM + 1 rows
        out[gram] = n
    return out


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, cols, counts = [], [], []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            count = np.zeros(DIM, np.int64)
            for h in grams(text or ""):
                count += np.bincount(h, minlength=DIM)
            found = np.flatnonzero(count)
            if len(found):
                langs.append(lang), cols.append(found.astype("<i4").tobytes()), counts.append(count[found].astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(cols, pa.binary()), pa.array(counts, pa.binary())], names=["lang", "cols", "counts"])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, config: TrainConfig) -> np.ndarray:
    """Weights (DIM + 1, classes) from rows (class, columns, weights), in the order given, epoch by epoch."""
    z, n, w = (np.zeros((DIM + 1, classes)) for _ in range(3))
    for _ in range(config.epochs):
        for y, cols, x in rows:
            zc, nc = z[cols], n[cols]
            wc = np.where(np.abs(zc) <= config.l1, 0.0, (np.sign(zc) * config.l1 - zc) / ((config.beta + np.sqrt(nc)) / config.alpha + config.l2))
            error = _softmax(x @ wc)
            error[y] -= 1
            g = x[:, None] * error[None, :]
            more = nc + g * g
            z[cols] = zc + g - (np.sqrt(more) - np.sqrt(nc)) / config.alpha * wc
            n[cols] = more
    active = np.abs(z) > config.l1
    w[active] = ((np.sign(z) * config.l1 - z) / ((config.beta + np.sqrt(n)) / config.alpha + config.l2))[active]
    return w


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by a grid that is refined three times."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()

    best, width = 1.0, 100.0
    for _ in range(4):
        grid = best * np.logspace(-np.log10(width), np.log10(width), 25)
        best, width = float(grid[np.argmin([loss(t) for t in grid])]), width ** 0.15
    return best


def train(docs: DataFrame, config: TrainConfig = TrainConfig(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Model of the languages of `docs`: rows with a language and a letter in their text. None if there are none."""
    prepare(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("draw"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row for each language
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, config.sample_docs / len(sizes) / n))])
    drawn = known.where(F.pmod("draw", F.lit(1 << 40)) < share[F.col("lang")] * float(1 << 40)).select("lang", "text")
    sample = staged(drawn.mapInArrow(_bags, "lang string, cols binary, counts binary"), "language-sample").limit(2 * config.sample_docs)
    df = document_frequencies(known.select("text"))
    idf = np.append(np.log((1 + df[DIM]) / (1 + df[:DIM])) + 1, 1.0)
    langs = tuple(sorted(sizes))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        index = {lang: i for i, lang in enumerate(langs)}
        made = []
        for lang, cols, counts in zip(rows["lang"], rows["cols"], rows["counts"]):
            c, k = np.frombuffer(cols, "<i4"), np.frombuffer(counts, "<i8")
            made.append((index[lang], np.append(c, DIM), np.append(k / k.sum() * idf[c] * SCALE, 1.0), hash_of(cols)))
        made.sort(key=lambda r: r[3])
        fitted, held = [r[:3] for i, r in enumerate(made) if i % 5], [r for i, r in enumerate(made) if not i % 5]
        w = fit(fitted or [r[:3] for r in made], len(langs), config)
        logits = np.array([x @ w[c] for _, c, x, _ in held]).reshape(-1, len(langs))
        t = calibrate(logits, np.array([r[0] for r in held], np.int64)) if fitted else 1.0
        return pd.DataFrame({"weights": [w.astype("<f4").tobytes()], "temperature": [t]})

    fitted = sample.groupBy().applyInPandas(run, "weights binary, temperature double").collect()  # one row
    if not fitted:
        return None
    w = np.frombuffer(fitted[0][0], "<f4").reshape(DIM + 1, len(langs)).copy()
    w[:DIM] *= (idf[:DIM, None] * SCALE).astype("f4")
    return Model(langs, w, float(fitted[0][1]))


def hash_of(data: bytes) -> int:
    import zlib

    return zlib.crc32(data)


def identify(text: str | None, model: Model | None) -> tuple[str, float]:
    """Language and probability of a whole text."""
    total, n = 0.0, 0
    if model is not None:
        for h in grams(text or ""):
            total = total + model.weights[h].sum(axis=0, dtype=np.float64)
            n += len(h)
    if not n:
        return UNKNOWN, 0.0
    p = _softmax((total / n + model.weights[DIM]) / model.temperature)
    best = int(p.argmax())
    return model.langs[best], float(p[best])


def language(text_col: str, model: Model | None) -> Column:
    """Struct lang_pred, score of a text column."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([identify(t, model) for t in texts], columns=["lang_pred", "score"])

    return predict(F.col(text_col))


def held_out(id_col: str = "doc_id") -> Column:
    """Documents never learned from: crc32 of the id's text is a multiple of five, or there is no id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row its id, held_out, lang_pred and score.

    Null texts and texts without a letter get `und` and score 0; so does every text if nothing could be learned. Repeated
    rows are judged alike; further columns are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    return docs.select(F.col(id_col), held_out(id_col).alias("held_out"), language(text_col, model).alias("found")).select(
        id_col, "held_out", "found.lang_pred", "found.score")


def accepted(docs: DataFrame, model: Model | None, min_score: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, unchanged, whose text is in one of the model's languages with at least `min_score`."""
    prepare(docs.sparkSession)
    found = language(text_col, model)
    return docs.where((found["lang_pred"] != UNKNOWN) & (found["score"] >= min_score))
