"""Operator 6, language ID: hyperdimensional profiles of letter trigrams.

Every letter, of any script, has its own random vector of +1 and -1, drawn from a hash of its code point; what is no letter
counts as a blank, which has one too. A trigram's vector binds its letters: the first one's vector rotated by
two places, times the second one's rotated by one, times the third one's. A text's vector is the sum over its trigrams,
and a language's prototype the sum over its training texts; a text gets the language of the prototype with the largest
cosine, after the mean of all prototypes' directions was taken from both. score is that cosine, 0 if it is negative.

Training takes rows whose crc32(doc_id as text) mod 5 is not 0, with a text and a lang; a null doc_id counts as an empty
text there, hence as held out. Trigram counts for each language are summed over the whole corpus, so what is gathered is
bounded by alphabet and languages. A text that is null or has no letter, and every text if nothing could be learned, is
`und` with score 0. Equal cosines go to the alphabetically first language. Repeated rows are judged alike; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, kept, named, slices

DIMENSIONS, SEED, FOLDS = 1024, 20, 5
UNKNOWN = "und"
#: Letters and trigrams whose vectors a worker keeps ready.
READY_LETTERS, READY_VECTORS = 8192, 24_000
#: Trigrams whose vectors are added at a time, and trigrams of the training texts that a task counts before it passes them on.
BUNDLED, COUNTED = 192, 1 << 20
_BITS = 21  # of a code point; a trigram's code has three


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


class Letters(dict):
    """Code point (0: blank) -> the letter's vector; begins anew when full, as each follows from the code point alone."""

    def __missing__(self, code: int) -> np.ndarray:
        if len(self) >= READY_LETTERS:
            self.clear()
        bits = np.frombuffer(hashlib.shake_256(f"{SEED} {code}".encode()).digest(DIMENSIONS // 8), np.uint8)
        self[code] = got = (2 * np.unpackbits(bits).astype(np.int8) - 1).astype(np.int8)
        return got


@cache
def _letters() -> Letters:
    return Letters()


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    out = np.ones((len(codes), DIMENSIONS), dtype=np.int8)
    for place in range(3):  # the first letter is rotated by two, the second by one
        own, at = np.unique(codes >> _BITS * (2 - place) & (1 << _BITS) - 1, return_inverse=True)
        for start in range(0, len(own), 1024):  # blocks of letters, should there be very many
            some = (at >= start) & (at < start + 1024)
            vectors = np.array([_letters()[c] for c in own[start : start + 1024].tolist()])
            out[some] *= np.roll(vectors, 2 - place, 1)[at[some] - start]
    return out


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the text's trigrams, runs of other characters counting as one blank, and how often each occurs."""
    s = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64) if text else np.zeros(0, np.int64)
    s = s * _is_letter()[s]
    if not s.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = s[np.concatenate([[True], (s[1:] > 0) | (s[:-1] > 0)])]
    return np.unique(s[:-2] << 2 * _BITS | s[1:-1] << _BITS | s[2:], return_counts=True)


class _Bundler:
    """Text -> its vector; keeps the vectors of the trigrams that come first."""

    def __init__(self):
        self.codes, self.at = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)  # in order, and their vectors' places
        self.ready = np.zeros((READY_VECTORS, DIMENSIONS), dtype=np.int8)

    def _known(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(self.codes, codes), max(len(self.codes) - 1, 0))
        return place, self.codes[place] == codes if len(self.codes) else np.zeros(len(codes), bool)

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        place, known = self._known(codes)
        size = len(self.codes)
        if size < READY_VECTORS and not known.all():
            new = codes[~known][: READY_VECTORS - size]
            for start in range(0, len(new), 4096):
                self.ready[size + start : size + min(start + 4096, len(new))] = trigram_vectors(new[start : start + 4096])
            into = np.searchsorted(self.codes, new)
            self.codes, self.at = np.insert(self.codes, into, new), np.insert(self.at, into, np.arange(size, size + len(new)))
            place, known = self._known(codes)
        out = np.zeros(DIMENSIONS, dtype=np.float32)
        rows, weights = self.at[place[known]], counts[known].astype(np.float32)
        for start in range(0, len(rows), BUNDLED):
            out += weights[start : start + BUNDLED] @ self.ready[rows[start : start + BUNDLED]].astype(np.float32)
        rest, weights = codes[~known], counts[~known].astype(np.float32)
        for start in range(0, len(rest), BUNDLED):
            out += weights[start : start + BUNDLED] @ trigram_vectors(rest[start : start + BUNDLED]).astype(np.float32)
        return out


def _bundler() -> _Bundler:
    return kept("bundler", _Bundler)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS == 0


def _counted(held: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    for lang, [(codes, counts)] in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "code", "n"])


def learn(documents: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order, and their prototypes as unit vectors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def summed(parts):
            codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return codes, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

        for some in slices(batches):
            for lang, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                codes, counts = trigrams(text)
                if len(codes):
                    held.setdefault(lang, []).append((codes, counts))
                    size += len(codes)
            if size > COUNTED:
                held = {lang: [summed(parts)] for lang, parts in held.items()}
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > COUNTED // 2:
                    yield from _counted(held)
                    held, size = {}, 0
        yield from _counted({lang: [summed(parts)] for lang, parts in held.items()})

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors: dict[str, np.ndarray] = {}
        for some in slices(batches, 2048):
            langs, code, n = np.array(some.column(0).to_pylist(), dtype=object), some.column(1).to_numpy(), some.column(2).to_numpy()
            for lang in set(langs.tolist()):
                own = langs == lang
                vectors[lang] = vectors.get(lang, 0) + n[own] @ trigram_vectors(code[own]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(vectors), pa.string()), pa.array([v.tolist() for v in vectors.values()], pa.list_(pa.int64()))], names=["lang", "vector"])

    train = documents.where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    sums = train.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    parts = sums.mapInArrow(bundled, "lang string, vector array<long>").select("lang", F.posexplode("vector").alias("at", "n")).groupBy("lang", "at").agg(F.sum("n").alias("n"))
    rows = sorted(parts.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("vector")).collect())
    vectors = np.array([r.vector for r in rows], dtype=np.float64).reshape(len(rows), DIMENSIONS)
    return [r.lang for r in rows], vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def predict(documents: DataFrame, languages: list[str], prototypes: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """The columns named in keep, then held_out, lang_pred and score."""
    keep = keep or ["doc_id"]
    common = prototypes.mean(0) if len(languages) > 1 else np.zeros(DIMENSIONS)
    common = common / max(np.linalg.norm(common), 1e-12)
    own = prototypes - np.outer(prototypes @ common, common) if len(languages) > 1 else prototypes
    own = (own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    axis = common.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler = _bundler()
        for some in slices(batches):
            names, scores = [], []
            for text in some.column(0).to_pylist():
                codes, counts = trigrams(text) if languages else ((), ())
                if not len(codes):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                v = bundler.bundle(codes, counts)
                v = v - (v @ axis) * axis
                cosines = own @ v / max(float(np.linalg.norm(v)), 1e-9)
                best = int(np.argmax(cosines))
                names.append(languages[best])
                scores.append(min(1.0, max(0.0, float(cosines[best]))))
            yield pa.RecordBatch.from_arrays([*some.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*some.schema.names[1:], "lang_pred", "score"])

    inner = documents.select("text", *[named(c).alias(f"kept_{i}") for i, c in enumerate(keep)], held_out().alias("held_out"))
    schema = T.StructType([*inner.schema.fields[1:], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return inner.mapInArrow(run, schema).withColumnsRenamed({f"kept_{i}": c for i, c in enumerate(keep)})


def identify(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    bound_batches(documents.sparkSession)
    return predict(documents, *learn(documents), keep)
