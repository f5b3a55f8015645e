"""Operator 7, quality classifier: ordinal cumulative-link regression on graded ratings.

A rated document's grade is 0 if it is toxic, else 1 + quality (0 or 1). With shared weights w over hashed text features
and ordered thresholds t_1 < t_2, P(grade >= k) = 1 / (1 + exp(t_k - w.x)). Scoring gives every document its expected
grade, the tail probability P(grade >= 2), P(grade >= 1), and selected: both tails are at least SELECT.

Features are the distinct lower-cased words and a few marks of form (letters' share, capitals, repeated words, length),
hashed into 2^18 places. The model is fitted on at most MAX_TRAIN labelled documents, those of the lowest id hash whose
crc32(doc_id as text) mod 5 is not 0 (the rest is for held-out tests); corpus scoring covers every row. Label rows with a
null doc_id, quality or toxic, and repeated ones, are left out (of several grades the lowest holds; of documents that share
a labelled id one is learned from). A null text has no words. Without labels of two grades every document has expected
grade null and selected true. Repeated rows are judged alike; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower_words, kept, slices

PLACES, MAX_TRAIN, MIN_DOCS, STEPS, DECAY, RATE, SELECT = 1 << 18, 6000, 4, 250, 2e-4, 0.05, 0.5
_TRIM = re.compile(rb"^[^0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff]+$")
#: Words whose places a worker keeps.
KEPT_WORDS = 300_000


class _Places(dict):
    """Word -> its place."""

    def __missing__(self, word: bytes) -> int:
        at = zlib.crc32(_TRIM.sub(b"", word) or word) % PLACES
        if len(self) < KEPT_WORDS and len(word) <= 64:
            self[word] = at
        return at


def features(text: str | None) -> np.ndarray:
    """Sorted distinct places of a text's features."""
    words, place = ascii_lower_words(text), kept("places", _Places).__getitem__
    if not words:
        return np.array([place(b"\0empty")])
    letters, capitals = sum(map(str.isalpha, text)), sum(map(str.isupper, text))
    kinds = set(words)
    marks = (f"\0letters{10 * letters // len(text)}", f"\0capitals{10 * capitals // max(letters, 1)}", f"\0kinds{10 * len(kinds) // len(words)}", f"\0size{len(words).bit_length()}")
    return np.unique(np.fromiter(map(place, [*kinds, *map(str.encode, marks)]), dtype=np.int64))


def likelihood(w: np.ndarray, t: np.ndarray, doc: np.ndarray, at: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean log likelihood less the decay of the weights, and its gradient by w and t; feature at[i] is in row doc[i]."""
    n, top = len(grades), len(t)
    score = np.bincount(doc, w[at], n)
    tail = 1 / (1 + np.exp(np.clip(t[None, :] - score[:, None], -30, 30)))  # P(grade >= k)
    above = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], 1)
    p = np.maximum(above[np.arange(n), grades] - above[np.arange(n), grades + 1], 1e-9)
    k = np.arange(1, top + 1)
    to_tail = ((grades[:, None] == k) * 1.0 - (grades[:, None] == k - 1)) * tail * (1 - tail) / p[:, None]  # d log p / d (score - t_k)
    gradient = np.concatenate([np.bincount(at, to_tail.sum(1)[doc], len(w)) / n - DECAY * w, -to_tail.sum(0) / n])
    return float(np.log(p).mean() - DECAY / 2 * (w @ w)), gradient


def fit(rows: list[np.ndarray], grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights over all places and the thresholds, one for each grade but the lowest; by Adam on the mean log likelihood."""
    top = int(grades.max())
    flat, ends = np.concatenate(rows), np.cumsum([len(r) for r in rows])
    used, at = np.unique(flat, return_inverse=True)
    often = np.bincount(at) >= MIN_DOCS
    kept = often[at]
    doc = np.repeat(np.arange(len(rows)), np.diff(ends, prepend=0))[kept]
    at = (np.cumsum(often) - 1)[at[kept]]
    m = int(often.sum())
    w, t = np.zeros(m), np.arange(top) - (top - 1) / 2.0
    first, second = np.zeros(m + top), np.zeros(m + top)
    for step in range(1, STEPS + 1):
        _, gradient = likelihood(w, t, doc, at, grades)
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, t = w + move[:m], np.maximum.accumulate(t + move[m:])
    weights = np.zeros(PLACES, dtype=np.float32)
    weights[used[often]] = w
    return weights, t


def training_rows(documents: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, text, grade) of at most limit labelled documents. The broadcast side has at most limit rows."""
    graded = labels.where("doc_id is not null and quality is not null and toxic is not null").selectExpr("cast(doc_id as long) doc_id", "case when toxic = 1 then 0 else 1 + cast(quality = 1 as int) end grade")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    chosen = graded.where(fold).groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return documents.selectExpr("cast(doc_id as long) doc_id", "text").join(F.broadcast(chosen), "doc_id")


def learn(documents: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray] | None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            found = [features(t).astype("<i4").tobytes() for t in some.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(found, pa.binary())], names=["doc_id", "grade", "places"])

    # One row for each id, however often it occurs: at most limit rows come to the driver.
    found = training_rows(documents, labels, limit).mapInArrow(run, "doc_id long, grade int, places binary")
    got = sorted(found.groupBy("doc_id").agg(F.min(F.struct("grade", "places")).alias("x")).select("doc_id", "x.*").collect())
    grades = np.array([r.grade for r in got], dtype=np.int64)
    if len(np.unique(grades)) < 2:
        return None
    return fit([np.frombuffer(r.places, "<i4").astype(np.int64) for r in got], grades)


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """(doc_id, expected_grade, p_tail, p_not_lowest, selected) of every document."""
    schema = "doc_id long, expected_grade double, p_tail double, p_not_lowest double, selected boolean"
    documents = documents.selectExpr("cast(doc_id as long) doc_id", "text")
    if model is None:
        return documents.selectExpr("doc_id", "cast(null as double) expected_grade", "cast(null as double) p_tail", "cast(null as double) p_not_lowest", "true selected")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, t = shared.value
        for some in slices(batches):
            scores = np.array([float(weights[features(x)].sum(dtype=np.float64)) for x in some.column(1).to_pylist()])
            tails = 1 / (1 + np.exp(np.clip(t[None, :] - scores[:, None], -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [some.column(0), pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, 0]), pa.array(tails[:, -1] >= SELECT)],
                names=["doc_id", "expected_grade", "p_tail", "p_not_lowest", "selected"],
            )

    return documents.mapInArrow(run, schema)


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents, learn(documents, labels))
