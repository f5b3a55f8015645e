"""Operator 13, periodic run detection: harmonic grid probing.

A run is a stretch of consecutive words whose smallest period is p (words p apart are identical), of length at least
max(min_length, min_exponent * p), which no neighbouring word extends at that period. For every period p the words at the
grid places 0, p, 2p, ... are compared with the next grid place. A run holds min_exponent grid places at least, so that
min_exponent - 1 grid pairs in a row are equal; places where they are, and whose following words agree too, are extended
both ways by comparing chunks of the word array with itself p further. Periods rise, and a grid place whose probe lies
within a found run is skipped: there the same stretch would be found again at a multiple of its period. All grids of n
words have n * (1 + 1/2 + 1/3 + ...) places. Periods up to the square root of n are probed one by one over their whole
grid, longer ones all at once for each grid place, so that about twice the square root of n array operations are made.

The work is a map over documents: nothing is shuffled, and no document meets another. A null text has no words; empty and
one-word texts have no runs. Rows are judged one by one, so that repeated rows and ids give as many equal results; rows
without doc_id are judged like others (and get no planted period, see planted()). An empty table gives an empty result, and
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Shortest run in words, and fewest repeats of its period.
MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Words of a comparison when a stretch is extended; each further one is twice as long, up to the last.
FIRST_CHUNK, LAST_CHUNK = 32, 1 << 16
#: Places after a grid place that are compared for many survivors at once, while more than FEW are left, before any is extended.
SCREENS, FEW = 64, 8

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def words_of(text: bytes | None) -> list[bytes]:
    """UTF-8 words between space and the bytes 9 to 13."""
    return text.split() if text else []


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal where the words are."""
    return pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy()


def agreeing(a: np.ndarray, i: int, p: int, forward: bool) -> int:
    """How many words in a row from place i on (or before it) equal those p further on."""
    done, chunk = 0, FIRST_CHUNK
    while True:
        if forward:
            low, high = i + done, min(i + done + chunk, len(a) - p)
        else:
            low, high = max(i - done - chunk, 0), i - done
        if low >= high:
            return done
        differs = np.flatnonzero(a[low:high] != a[low + p : high + p])
        if len(differs):
            return done + int(differs[0] if forward else high - low - 1 - differs[-1])
        done, chunk = done + high - low, min(2 * chunk, LAST_CHUNK)


def screened(a: np.ndarray, at: np.ndarray, p, exponent: int) -> np.ndarray:
    """Which of the places at may be a run's first on the grid of period p (one for all, or one for each): from there on the
    words of exponent - 2 periods equal those p further."""
    left, width = np.arange(len(at)), np.broadcast_to((exponent - 2) * p, at.shape)
    for t in range(min(SCREENS, int(width.max(initial=0)))):
        if len(left) <= FEW:
            break
        i = at[left] + np.minimum(1 + t * np.maximum(width[left] // SCREENS, 1), width[left])
        left = left[a[i] == a[i + (p if np.isscalar(p) else p[left])]]
    return left


def probes(a: np.ndarray, exponent: int, reach: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(p, places on its grid that may be a run's first), for periods that have any, rising: exponent - 1 grid pairs in a row
    are equal from there on, and not all within a found run, whose furthest end over word i is reach[i]."""
    n, root = len(a), math.isqrt(len(a))
    longest = n // exponent
    for p in range(1, min(root, longest) + 1):
        grid = a[::p]
        equal = grid[1:] == grid[:-1]
        row = equal[: len(equal) - exponent + 2]
        for k in range(1, exponent - 1):
            row = row & equal[k : len(equal) - exponent + 2 + k]
        at = np.flatnonzero(row) * p
        at = at[reach[at] <= at + (exponent - 1) * p]
        if len(at):
            yield p, at[screened(a, at, p, exponent)]
    found_p, found_at = [], []
    for j in range((n - 1) // (root + 1) - exponent + 2):
        periods = np.arange(root + 1, min(longest, (n - 1) // (j + exponent - 1)) + 1)
        for k in range(exponent - 1):
            periods = periods[a[(j + k) * periods] == a[(j + k + 1) * periods]]
        periods = periods[reach[j * periods] <= (j + exponent - 1) * periods]
        if len(periods):
            found_p.append(periods)
            found_at.append(periods * j)
    if found_p:
        periods, at = np.concatenate(found_p), np.concatenate(found_at)
        order = screened(a, at, periods, exponent)
        order = order[np.lexsort((at[order], periods[order]))]
        periods, at = periods[order], at[order]
        if not len(periods):
            return
        first = np.flatnonzero(np.concatenate([[True], periods[1:] != periods[:-1]]))
        for b, e in zip(first, [*first[1:], len(periods)], strict=True):
            yield int(periods[b]), at[b:e]


def find_runs(a: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the words numbered in a, by start and period.

    min_exponent is 3 at least. Two stretches of periods q < p that share 2p + 1 words or more, q being the first one's
    smallest period, are one (their common part has the period gcd(p, q), hence q divides p): so probes within a run of a
    smaller period need no look, and a stretch found outside of all has no period below its own.
    """
    if min_exponent < 3:
        raise ValueError("min_exponent must be 3 at least")
    if len(a) < min_exponent:
        return []
    reach, runs = np.zeros(len(a), dtype=np.int64), []
    for p, at in probes(a, min_exponent, reach):
        span = (min_exponent - 1) * p
        for i in at.tolist():
            if reach[i] > i + span:
                continue
            start = i - agreeing(a, i, p, False)
            stop = i + agreeing(a, i, p, True) + p
            # A run's first grid place has all of its grid places within the run; those at its end are passed over.
            if stop > i + span and stop - start >= max(min_length, min_exponent * p):
                runs.append((start, stop - start, p))
                np.maximum(reach[start:stop], stop, out=reach[start:stop])
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but those that lie in a run after its first period."""
    keep = np.ones(len(words), dtype=bool)
    for start, length, p in runs:
        keep[start + p : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that the query judges: with h = crc32 of the decimal doc_id, where h mod 10 is 0 the words from a place on
    repeat a stretch of them, so that every text collection holds runs. Without doc_id they stay as they are."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * -(-(n - a) // len(cycle)))[: n - a]


def detect(documents: DataFrame, rewrite=None, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(doc_id, runs, collapsed) of every row: runs as an array of (start, length, period), collapsed as text.

    rewrite(doc_id, words), where given, changes a row's words first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for doc_id, words, runs in _judged(batches, rewrite, min_length, min_exponent):
            spans = [{"start": s, "length": n, "period": p} for s, n, p in runs]
            text = b" ".join(collapsed(words, runs)).decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([spans], kind), pa.array([text])], names=["doc_id", "runs", "collapsed"])

    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def _judged(batches: Iterator[pa.RecordBatch], rewrite, min_length: int, min_exponent: int) -> Iterator[tuple]:
    for some in slices(batches):
        for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).cast(pa.binary()), strict=True):
            words = words_of(text.as_py())
            words = rewrite(doc_id, words) if rewrite else words
            yield doc_id, words, find_runs(numbered(words), min_length, min_exponent) if len(words) >= min_length else []


def digests(documents: DataFrame, rewrite=planted, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """A row for each document: its number of runs, the one of greatest exponent, and digests of all runs and of the
    collapsed text. Neither list nor text leaves the task."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    def row(doc_id, words, runs):
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        said = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        return doc_id, len(runs), *said, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = []
        for judged in _judged(batches, rewrite, min_length, min_exponent):
            some.append(row(*judged))
            if len(some) == 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=names)
                some = []
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=names)

    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
