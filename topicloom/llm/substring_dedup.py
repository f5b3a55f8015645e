"""Operator 3, substring dedup: passages that repeat in other documents, by collinear chaining of k-mer seeds.

1. Seeds. A document's words (ASCII white space between them, A-Z lower-cased) give hashes of SEED = 8 words; winnowing
   keeps the smallest of each WINDOW = 16 in a row, so any shared passage of 39 words or more has two seeds at least.
   Documents of equal words are one class; it takes part once, for its smallest doc_id. Seeds travel packed by hash.
2. Matches. Of the classes in which a seed occurs the one with the smallest key owns it; elsewhere its nth occurrence
   in a document matches the owner's nth, or last. So there are at most as many matches as seeds, however common a
   passage is.
3. Chains. A class's matches with one owner are chained: the best chain that ends in a match adds SEED, plus the best
   before it on both sides, less GAP for each word between. With that cost taken apart into both ends' places, a Fenwick
   tree of prefix maxima over the owner's places finds the best predecessor. Chains of two seeds or more go on.
4. Alignment. Words between seeds are aligned by longest common subsequence; where more than APART of them, and more than
   a share of 1 - MIN_IDENTITY, agree with nothing, the chain is cut, so that no passage holds a longer stretch of a document's
   own words. Gaps of more than GAP_CELLS pairs of words aren't aligned but cut at once. Both ends of each part are
   extended word by word until the score falls X_DROP below its best. A passage of MIN_WORDS words of which MIN_IDENTITY
   agree counts; a part that agrees less is cut at its gaps, and each piece that agrees enough is judged alone. For this
   the owner's words travel in blocks of 64, only those that chains touch.
5. Open windows. Seeds of one passage may have different owners, none of which holds MIN_WORDS words of it. So windows of
   MIN_WORDS words, with all their seeds matched, that no passage found so far holds are looked up in all texts: the
   smallest class that holds the whole window owns it, and it is a passage of the others. So each MIN_WORDS words that
   documents share exactly are reported for all of their classes but one.

Passages of the owner stay; the others repeat. A copy of a whole document of at least MIN_WORDS words repeats its class's
smallest doc_id from end to end. Rows without words take no part, nor do rows with a null doc_id in repeats(); in
without_repeats() they come last among their class. Repeated rows are judged alike; rows of one doc_id with other texts
each by their own text; a document that repeats only itself is clean; an empty table gives an empty result; other columns
are ignored and kept, whatever their names. Seeds, windows and classes are told apart by 64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import FREQUENT, ascii_lower_words, bitmap, bitmap_bits, by_group, frequent, likely, materialize, named, row_key, slices

SEED, WINDOW, GAP, X_DROP, MIN_WORDS, MIN_IDENTITY, BLOCK_WORDS = 8, 16, 0.1, 6, 40, 0.8, 64
#: Words of a gap that may agree with nothing, and pairs of words that a gap may have to be aligned.
APART, GAP_CELLS = 20, 160_000
#: Hash buckets: at least this many, and one for each so many documents; seeds that a task packs at a time.
BUCKETS, BUCKET_DOCS, PACKED = 512, 60_000, 750_000
_P, _FAR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def class_key(words: list[bytes]) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(words)))))


def _grams(words: list[bytes]) -> np.ndarray:
    """Sums over the hashes of each SEED words in a row."""
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64)
    n = len(h) - SEED + 1
    total = np.zeros(n, np.uint64)
    for k in range(SEED):
        total = total * _P + h[k : k + n]
    return total


def _mixed(total: np.ndarray) -> np.ndarray:
    total = total ^ (total >> np.uint64(31))
    total *= np.uint64(0x94D049BB133111EB)
    total ^= total >> np.uint64(29)
    return total


def _winnowed(total: np.ndarray) -> np.ndarray:
    """The place of the smallest of each WINDOW in a row."""
    runs = np.lib.stride_tricks.sliding_window_view(total, min(WINDOW, len(total)))
    return np.arange(len(runs)) + runs.argmin(1)


def seeds(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of a document's winnowed seeds."""
    if len(words) < SEED:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = _mixed(_grams(words))
    at = np.unique(_winnowed(total))
    return total[at], at


def windows(grams: np.ndarray) -> np.ndarray:
    """Hashes of each MIN_WORDS words in a row; grams: their sums of SEED words."""
    n = len(grams) - (MIN_WORDS - SEED)
    total = np.zeros(n, np.uint64)
    for k in (*range(0, MIN_WORDS - SEED, SEED), MIN_WORDS - SEED):
        total = total * _FAR + grams[k : k + n]
    return _mixed(total)


def _covered(spans: list[tuple[int, int]], n: int) -> np.ndarray:
    """For n windows of MIN_WORDS words: do the spans together hold it?"""
    edges = np.zeros(n + MIN_WORDS, np.int64)
    for a, b in spans:
        edges[a] += 1
        edges[b] -= 1
    held = np.concatenate([[0], np.cumsum(np.cumsum(edges[:-1]) > 0)])
    return held[MIN_WORDS:] - held[:-MIN_WORDS] == MIN_WORDS


def open_windows(words: list[bytes], matched: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Hashes of the windows of MIN_WORDS words that may repeat elsewhere, with all their seeds matched, and that spans don't hold.

    A window that a class of smaller key shares has no seed that its own class owns. Only those seeds count that are the
    smallest of WINDOW in a row within the window: they are seeds wherever it occurs.
    """
    if len(words) < MIN_WORDS:
        return np.zeros(0, np.uint64)
    grams = _grams(words)
    mine = np.zeros(len(grams), bool)
    mine[matched] = True
    hits = np.concatenate([[0], np.cumsum(mine[_winnowed(_mixed(grams))])])
    runs = MIN_WORDS - SEED - WINDOW + 2  # of WINDOW seeds, in a window
    wanted = hits[runs:] - hits[:-runs] == runs
    wanted &= ~_covered(spans, len(wanted))
    return windows(grams)[wanted] if wanted.any() else np.zeros(0, np.uint64)


def keyed_rows(documents: DataFrame) -> DataFrame:
    return documents.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")


def classes(rows: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, cls) of every row that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            found = [ascii_lower_words(t) for t in some.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*some.columns[:2], pa.array([len(w) for w in found], pa.int64()), pa.array([class_key(w) for w in found], pa.int64())], names=["row", "doc_id", "n_words", "cls"])

    return rows.mapInArrow(run, "row long, doc_id long, n_words long, cls long").where("n_words > 0")


def _ordered(h: np.ndarray, cls: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows in order of hash, class and place, without repeated ones."""
    order = np.lexsort((at, cls, h))
    h, cls, at = h[order], cls[order], at[order]
    new = np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (cls[1:] != cls[:-1]) | (at[1:] != at[:-1])])
    return h[new], cls[new], at[new]


def _pack(h: np.ndarray, cls: np.ndarray, at: np.ndarray) -> bytes:
    own, counts = np.unique(h, return_counts=True)
    return len(own).to_bytes(8, "little") + own.tobytes() + counts.astype("<u4").tobytes() + cls.tobytes() + at.astype("<u4").tobytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(raw[:8], "little")
    counts = np.frombuffer(raw, "<u4", n, 8 + 8 * n)
    total = int(counts.sum())
    return np.repeat(np.frombuffer(raw, "<u8", n, 8), counts), np.frombuffer(raw, "<i8", total, 8 + 12 * n), np.frombuffer(raw, "<u4", total, 8 + 12 * n + 8 * total)


def _owned(h: np.ndarray, cls: np.ndarray, at: np.ndarray):
    """(cls, at, owner, owner_at) of rows in order, where the class isn't the hash's owner."""
    begins = np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]])
    runs = begins | np.concatenate([np.ones(min(1, len(h)), bool), cls[1:] != cls[:-1]])  # of one class's occurrences of a seed
    rows, run, first = np.arange(len(h)), np.cumsum(runs) - 1, np.flatnonzero(runs)
    length = np.diff([*first, len(h)])
    owner_first = np.flatnonzero(begins)[np.cumsum(begins) - 1]
    owner = owner_first + np.minimum(rows - first[run], length[run[owner_first]] - 1)
    other = cls != cls[owner]
    return cls[other], at[other].astype(np.int64), cls[owner][other], at[owner][other].astype(np.int64)


def matches(texts: DataFrame, buckets: int, hashes=seeds, least: int = FREQUENT) -> DataFrame:
    """(cls, at, owner, owner_at): each seed's occurrences outside the class that owns it; hashes gives a text's seeds.

    Seeds are dealt into buckets. Entries of one that has `least` in a pack go to groups by class instead, with a note to
    its bucket, which leaves the seed's other entries unresolved too. Spark finds the owners of unresolved ones by partial
    minima, so that no task holds a seed of very many classes.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def flush():
            h, cls, at = _ordered(*(np.concatenate(p) for p in zip(*parts, strict=True)))
            much = frequent(h, least)
            place = (h % np.uint64(buckets)).astype(np.int64)
            rows = {k: [_pack(*r), b""] for k, r in by_group(place[~much], h[~much], cls[~much], at[~much]).items()}
            for k, (own,) in by_group(place[much], h[much]).items():
                rows.setdefault(k, [_pack(own[:0], cls[:0], at[:0]), b""])[1] = np.unique(own).tobytes()
            rows |= {-1 - k: [_pack(*r), b""] for k, r in by_group((cls[much].view(np.uint64) % np.uint64(buckets)).astype(np.int64), h[much], cls[much], at[much]).items()}
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), *(pa.array([r[i] for r in rows.values()], pa.binary()) for i in (0, 1))], names=["bucket", "packed", "frequent"])

        for some in slices(batches):
            for text in some.column(0).to_pylist():
                words = ascii_lower_words(text)
                h, at = hashes(words)
                if len(h):
                    parts.append((h, np.full(len(h), class_key(words), np.int64), at))
                    held += len(h)
            if held >= PACKED:
                yield from flush()
                parts, held = [], 0
        if held:
            yield from flush()

    def join(key, rows):
        import pandas as pd

        h, cls, at = _ordered(*(np.concatenate(p) for p in zip(*(_unpack(bytes(x)) for x in rows["packed"]), strict=True)))
        unresolved = np.isin(h, np.frombuffer(b"".join(map(bytes, rows["frequent"])), "<u8")) | (key[0] < 0)
        known = _owned(h[~unresolved], cls[~unresolved], at[~unresolved])
        left = [x[unresolved] for x in (h.view(np.int64), cls, at.astype(np.int64))]
        none = np.zeros(len(left[0]), np.int64)
        columns = {"hash": (np.zeros(len(known[0]), np.int64), left[0]), "cls": (known[0], left[1]), "at": (known[1], left[2]), "owner": (known[2], none), "owner_at": (known[3], none)}
        return pd.DataFrame({n: np.concatenate(c) for n, c in columns.items()} | {"resolved": np.arange(len(known[0]) + len(none)) < len(known[0])})

    packed = texts.select("text").mapInArrow(emit, "bucket long, packed binary, frequent binary")
    found = materialize(packed.groupBy("bucket").applyInPandas(join, "hash long, cls long, at long, owner long, owner_at long, resolved boolean"), "matches")
    in_class = Window.partitionBy("hash", "cls").orderBy("at")  # a class's places of one seed: bounded by its text
    left = materialize(found.where("not resolved").select("hash", "cls", "at").distinct().withColumn("nth", F.row_number().over(in_class)), "frequent-seeds")
    owned = left.join(left.groupBy("hash").agg(F.min("cls").alias("owner")), "hash").where("cls = owner").select("hash", "owner", "nth", F.col("at").alias("owner_at"))
    last = owned.groupBy("hash", "owner").agg(F.max("nth").alias("last"))
    others = left.join(last, "hash").where("cls <> owner").withColumn("nth", F.least("nth", "last")).join(owned.drop("owner"), ["hash", "nth"])
    columns = ["cls", "at", "owner", "owner_at"]
    return found.where("resolved").select(columns).unionByName(others.select(columns))


class FenwickMax:
    """Prefix maxima with the place that has each."""

    def __init__(self, size: int):
        self.best = [(float("-inf"), -1)] * (size + 1)

    def put(self, at: int, value: float, name: int) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at][0]:
                self.best[at] = (value, name)
            at += at & -at

    def before(self, at: int) -> tuple[float, int]:
        """The largest of places smaller than at."""
        out = (float("-inf"), -1)
        while at > 0:
            out = max(out, self.best[at], key=lambda x: x[0])
            at -= at & -at
        return out


def chains(pairs: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Chains of matches (place, owner's place), rising on both sides, best first; each match is in one chain."""
    pairs = sorted(set(pairs))
    rank = {b: r for r, b in enumerate(sorted({b for _, b in pairs}))}
    tree, score, back = FenwickMax(len(rank)), [0.0] * len(pairs), [-1] * len(pairs)
    known = 0
    for i, (a, b) in enumerate(pairs):
        while pairs[known][0] < a:  # only matches that begin earlier may come before
            tree.put(rank[pairs[known][1]], score[known] + GAP * sum(pairs[known]), known)
            known += 1
        best, j = tree.before(rank[b])
        gain = best - GAP * (a + b)
        score[i], back[i] = (SEED + gain, j) if j >= 0 and gain > 0 else (float(SEED), -1)
    used, out = [False] * len(pairs), []
    for i in sorted(range(len(pairs)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(pairs[i])
            i = back[i]
        if len(chain) > 1:
            out.append(chain[::-1])
    return out


def all_chains(found: DataFrame) -> DataFrame:
    """(cls, chain, owner, seeds, low, high): low and high are the owner's blocks that the chain's alignment may need.

    Where seeds lie so close that a window of MIN_WORDS words may hold two, a row with chain -1 has all places of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            out = []
            for cls, rows in zip(some.column(0).to_pylist(), some.column(1), strict=True):
                by_owner: dict[int, list[tuple[int, int]]] = {}
                flat = rows.values
                for owner, a, b in zip(flat.field("owner").to_pylist(), flat.field("at").to_pylist(), flat.field("owner_at").to_pylist(), strict=True):
                    by_owner.setdefault(owner, []).append((a, b))
                number, places = 0, np.unique(flat.field("at").to_numpy())
                if len(places) > 1 and np.diff(places).min() <= MIN_WORDS - SEED:
                    out.append({"cls": cls, "chain": -1, "owner": cls, "seeds": places.astype("<u4").tobytes(), "low": 0, "high": -1})
                for owner in sorted(by_owner):
                    for chain in chains(by_owner[owner]):
                        low, high = max(0, chain[0][1] - BLOCK_WORDS) // BLOCK_WORDS, (chain[-1][1] + SEED + BLOCK_WORDS) // BLOCK_WORDS
                        out.append({"cls": cls, "chain": number, "owner": owner, "seeds": np.array(chain, "<i8").tobytes(), "low": low, "high": high})
                        number += 1
            yield pa.RecordBatch.from_pylist(out, schema=CHAINS)

    # A class has no more matches than seeds, so its list is bounded by its own text.
    lists = found.groupBy("cls").agg(F.collect_list(F.struct("owner", "at", "owner_at")).alias("rows"))
    return lists.mapInArrow(run, "cls long, chain long, owner long, seeds binary, low long, high long")


CHAINS = pa.schema([("cls", pa.int64()), ("chain", pa.int64()), ("owner", pa.int64()), ("seeds", pa.binary()), ("low", pa.int64()), ("high", pa.int64())])
PASSAGES = pa.schema([("cls", pa.int64()), ("owner", pa.int64()), *[(n, pa.int64()) for n in ("start", "end", "owner_start", "owner_end")], ("identity", pa.float64()), ("open", pa.binary())])


def common_words(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence."""
    if a == b:
        return len(a)
    if not a or not b:
        return 0
    row = [0] * (len(b) + 1)
    for x in a:
        left = diagonal = 0
        for j, y in enumerate(b, 1):
            up = row[j]
            left = diagonal + 1 if x == y else max(left, up)
            row[j], diagonal = left, up
    return row[-1]


def _extend(a: list[bytes], b: dict[int, bytes], i: int, j: int, step: int) -> tuple[int, int]:
    """Words taken and words equal when going from a[i], b[j] by step until the score falls too far."""
    score = best = taken = equal = steps = same = 0
    while 0 <= i < len(a) and j in b:
        steps += 1
        if a[i] == b[j]:
            score, same = score + 1, same + 1
            if score > best:
                best, taken, equal = score, steps, same
        else:
            score -= 2
            if score < best - X_DROP:
                break
        i, j = i + step, j + step
    return taken, equal


def align(a: list[bytes], b: dict[int, bytes], chain: np.ndarray, agreed: list[tuple[int, int, int]] | None = None) -> tuple[int, int, int, int, float]:
    """start, end, the owner's start and end, and the share of words that agree. b: the owner's words by place.

    agreed, where given, is filled with the words equal up to each seed's end and with its places in a and b.
    """
    (a0, b0), equal = chain[0], SEED
    end_a, end_b = int(a0) + SEED, int(b0) + SEED
    if agreed is not None:
        agreed.append((equal, end_a, end_b))
    for x, y in chain[1:].tolist():
        skip = max(0, end_a - x, end_b - y)  # seeds may overlap, by unequal lengths even
        if skip < SEED:
            if (x + skip - end_a) * (y + skip - end_b) <= GAP_CELLS:  # wider ones are few words against very many: as none
                equal += common_words(a[end_a : x + skip], [b.get(k, b"") for k in range(end_b, y + skip)])
            equal += SEED - skip
            end_a, end_b = x + SEED, y + SEED
        if agreed is not None:
            agreed.append((equal, end_a, end_b))
    more, same = _extend(a, b, end_a, end_b, 1)
    less, before = _extend(a, b, int(a0) - 1, int(b0) - 1, -1)
    start, end = int(a0) - less, end_a + more
    return start, end, int(b0) - less, end_b + more, (equal + same + before) / (end - start)


def _counts(found: tuple[int, int, int, int, float]) -> bool:
    return found[1] - found[0] >= MIN_WORDS and found[4] >= MIN_IDENTITY


def holds(a: list[bytes], b: dict[int, bytes], before: np.ndarray, after: np.ndarray) -> bool:
    """Whether the gap between two seeds of a chain belongs to one passage: few of the document's words there stand alone."""
    end_a, end_b, (x, y) = int(before[0]) + SEED, int(before[1]) + SEED, after.tolist()
    skip = max(0, end_a - x, end_b - y)
    size, other = x + skip - end_a, y + skip - end_b
    most = max(APART, round((1 - MIN_IDENTITY) * size))
    if size <= APART:
        return True
    if size - other > most or size * other > GAP_CELLS:
        return False
    return size - common_words(a[end_a : x + skip], [b.get(k, b"") for k in range(end_b, y + skip)]) <= most


def judged(a: list[bytes], b: dict[int, bytes], chain: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """The passages of a chain: those of its parts between the gaps that don't hold."""
    cuts = [i for i in range(1, len(chain)) if not holds(a, b, chain[i - 1], chain[i])]
    return [found for part in np.split(chain, cuts) for found in judged_part(a, b, part)]


def judged_part(a: list[bytes], b: dict[int, bytes], chain: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """The passages of a chain whose gaps hold: the whole of it, or where that agrees too little, parts of it that agree enough.

    From each seed the part goes to the last seed up to which MIN_IDENTITY of the words agree. Of these parts, which
    may overlap, as few are judged as hold all seeds.
    """
    agreed: list[tuple[int, int, int]] = []
    whole = align(a, b, chain, agreed)
    if _counts(whole):
        return [whole]
    if whole[1] - whole[0] < MIN_WORDS:
        return []
    equal, ends, _ = np.array(agreed, dtype=np.int64).T
    # Equal words less MIN_IDENTITY of all up to a seed's end, and up to its begin; in hundredths, to be exact.
    share = round(100 * MIN_IDENTITY)
    up = 100 * equal - share * ends
    down = 100 * (equal - SEED) - share * (ends - SEED)
    best = np.maximum.accumulate(up[::-1])[::-1]  # the highest from each seed on; falls or stays
    last = np.searchsorted(-best, -down, side="right") - 1
    out, begin, reach = [], 0, -1
    while reach < len(chain) - 1:
        held = np.arange(begin, reach + 2)  # parts that begin up to the seed after the last one held
        pick = int(held[last[held].argmax()])
        begin, reach = pick + 1, int(last[pick])
        part, agreed = chain[pick : reach + 1], []
        found = align(a, b, part, agreed)
        if not _counts(found):  # words that agree less may have come at the ends
            same, end, owner_end = agreed[-1]
            found = int(part[0][0]), end, int(part[0][1]), owner_end, same / (end - int(part[0][0]))
        if _counts(found):
            out.append(found)
    return out


def passages(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cls, owner, start, end, owner_start, owner_end, identity), and rows' classes with the row and doc_id that stand for each.

    rows: row, doc_id, text.
    """
    found = materialize(classes(rows), "word-classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    reps = materialize(found.groupBy("cls").agg(first.alias("m")).select("cls", F.col("m.row").alias("rep"), F.col("m.doc_id").alias("rep_id")), "class-reps")
    ours = found.join(reps, "cls")
    buckets = max(BUCKETS, rows.count() // BUCKET_DOCS)
    found = materialize(all_chains(matches(rows, buckets)), "chains")
    links, places = found.where("chain >= 0"), found.where("chain < 0").select("cls", F.col("seeds").alias("places"))
    wanted = materialize(found.select("cls").union(found.select("owner")).distinct().join(reps, "cls"), "chained-classes")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([class_key(ascii_lower_words(t)) for t in some.column(1).to_pylist()], pa.int64()), some.column(1)], names=["cls", "text"])

    texts = rows.select(F.col("row").alias("rep"), "text")
    texts = likely(texts, "rep", wanted.select("rep"), keyed, "cls long, text string")
    texts = materialize(texts.join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]).select("cls", "text"), "chained-texts")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 64):
            out = []
            for cls, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                words = ascii_lower_words(text)
                out += [{"owner": cls, "block": k // BLOCK_WORDS, "words": b" ".join(words[k : k + BLOCK_WORDS])} for k in range(0, len(words), BLOCK_WORDS)]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("owner", pa.int64()), ("block", pa.int64()), ("words", pa.binary())]))

    owned = texts.join(links.select(F.col("owner").alias("cls")).distinct(), "cls", "left_semi").mapInArrow(blocks, "owner long, block long, words binary")
    asked = links.select("cls", "chain", "owner", F.explode(F.sequence("low", "high")).alias("block"))
    sent = asked.join(owned, ["owner", "block"]).groupBy("cls", "chain").agg(F.collect_list(F.struct("block", "words")).alias("blocks"))
    whole = sent.join(links.select("cls", "chain", "owner", "seeds"), ["cls", "chain"]).groupBy("cls").agg(F.collect_list(F.struct("owner", "seeds", "blocks")).alias("chains"))
    whole = whole.join(places, "cls", "full")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 16):
            out = []
            for row in some.to_pylist():
                words, spans = ascii_lower_words(row["text"]), []
                for c in row["chains"] or []:
                    theirs = {x["block"] * BLOCK_WORDS + k: w for x in c["blocks"] for k, w in enumerate(x["words"].split(b" "))}
                    for start, end, b0, b1, identity in judged(words, theirs, np.frombuffer(c["seeds"], "<i8").reshape(-1, 2)):
                        out.append({"cls": row["cls"], "owner": c["owner"], "start": start, "end": end, "owner_start": b0, "owner_end": b1, "identity": identity})
                        spans.append((start, end))
                if row["places"]:
                    left = open_windows(words, np.frombuffer(row["places"], "<u4"), spans)
                    if len(left):
                        out.append({"cls": row["cls"], "open": left.tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=PASSAGES)

    got = materialize(texts.join(whole, "cls").select("cls", "text", "chains", "places").mapInArrow(aligned, "cls long, owner long, start long, end long, owner_start long, owner_end long, identity double, open binary"), "passages")
    first = got.where("owner is not null").drop("open")
    return first.unionByName(open_passages(rows, got.where("open is not null").select("open"), first, buckets)), ours


def open_passages(texts: DataFrame, left: DataFrame, first: DataFrame, buckets: int) -> DataFrame:
    """Passages, as in first, of the windows in left: those that the smallest class which holds the whole window owns."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            for raw in some.column(0).to_pylist():
                h = np.frombuffer(raw, "<u8")
                for k in range(0, len(h), PACKED):
                    yield pa.RecordBatch.from_arrays([pa.array((h[k : k + PACKED] >> np.uint64(1)).astype(np.int64))], names=["h"])

    hashes = left.mapInArrow(spread, "h long")
    n = hashes.count()
    if not n:
        return first.limit(0)
    bits = bitmap_bits(n)
    shared = texts.sparkSession.sparkContext.broadcast(bitmap(hashes.select((F.col("h") % bits + 1).alias("p")), bits))

    def asked(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(words) < MIN_WORDS:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = windows(_grams(words))
        p = ((h >> np.uint64(1)) % np.uint64(bits)).astype(np.int64)
        at = np.flatnonzero((shared.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1)
        return h[at], at

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 64):
            out = []
            for cls, rows, spans in zip(some.column(0).to_pylist(), some.column(1), some.column(2).to_pylist(), strict=True):
                at, owner, owner_at = (rows.values.field(name).to_numpy() for name in ("at", "owner", "owner_at"))
                order = np.argsort(at)
                at, owner, owner_at = at[order], owner[order], owner_at[order]
                spans = [(s["start"], s["end"]) for s in spans or []]
                stays = ~_covered(spans, max(int(at[-1]) + 1, *(b - MIN_WORDS + 1 for _, b in spans), 1))[at]
                at, owner, owner_at = at[stays], owner[stays], owner_at[stays]
                if len(at):
                    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(owner_at) != 1) | (owner[1:] != owner[:-1])]))
                    for a, b in zip(new.tolist(), [*(new[1:] - 1).tolist(), len(at) - 1], strict=True):
                        out.append({"cls": cls, "owner": int(owner[a]), "start": int(at[a]), "end": int(at[b]) + MIN_WORDS, "owner_start": int(owner_at[a]), "owner_end": int(owner_at[b]) + MIN_WORDS, "identity": 1.0})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([f for f in PASSAGES if f.name != "open"]))

    lists = matches(texts, buckets, asked).groupBy("cls").agg(F.collect_list(F.struct("owner", "at", "owner_at")).alias("rows"))
    known = first.groupBy("cls").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return lists.join(known, "cls", "left").select("cls", "rows", "spans").mapInArrow(runs, first.schema)


def repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, match_doc_id, start_word, end_word, match_start, match_end, identity): passages that repeat elsewhere.

    Words start_word to end_word, not included, of doc_id repeat those of match_doc_id.
    """
    got, rows = passages(keyed_rows(documents).where("doc_id is not null"))
    reps = rows.select("cls", "rep_id").distinct()
    known = got.join(reps, "cls").join(reps.select(F.col("cls").alias("owner"), F.col("rep_id").alias("owner_id")), "owner")
    parts = known.selectExpr("rep_id doc_id", "owner_id match_doc_id", "start start_word", "end end_word", "owner_start match_start", "owner_end match_end", "identity")
    copies = rows.where(f"doc_id <> rep_id and n_words >= {MIN_WORDS}").selectExpr("doc_id", "rep_id match_doc_id", "0L start_word", "n_words end_word", "0L match_start", "n_words match_end", "1d identity")
    return parts.unionByName(copies)


def without_repeats(documents: DataFrame) -> DataFrame:
    """documents with repeated passages cut out of their texts and n_chars brought up to date; those left without words go."""
    got, rows = passages(keyed_rows(documents))
    parts = got.join(rows.select("cls", F.col("rep").alias("row")).distinct(), "cls").select("row", "start", "end")
    copies = rows.where(f"row <> rep and n_words >= {MIN_WORDS}").select("row", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")).distinct()
    spans = materialize(parts.unionByName(copies).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "repeats")
    held = documents.select(row_key().alias("row"), F.struct(*map(named, documents.columns)).alias("document"), "text").join(spans, "row", "left").select("document", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            spans = some.column(2).to_pylist()
            texts = [cut(t, [(s["start"], s["end"]) for s in own]) if own else t for t, own in zip(some.column(1).to_pylist(), spans, strict=True)]
            stays = [own is None or bool(_WORD.search(t.encode("utf-8", "surrogatepass"))) for t, own in zip(texts, spans, strict=True)]
            out = pa.RecordBatch.from_arrays([some.column(0), pa.array(texts, pa.string()), pa.array([own is not None for own in spans])], names=["document", "text", "changed"])
            yield out.filter(pa.array(stays, pa.bool_()))

    schema = T.StructType([held.schema["document"], T.StructField("text", T.StringType()), T.StructField("changed", T.BooleanType())])
    new = {"text": F.col("text"), "n_chars": F.length("text")}
    types = documents.schema
    columns = [F.when(F.col("changed"), new[c].cast(types[c].dataType)).otherwise(F.col("document")[c]).alias(c) if c in new else F.col("document")[c].alias(c) for c in documents.columns]
    return held.mapInArrow(run, schema).select(columns)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; what stood between other words stays."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw)]
    out, done = [], 0
    for a, b in sorted(spans):
        if a < b and at[b - 1][1] > done:
            out.append(raw[done : max(done, at[a][0])])
            done = at[b - 1][1]
    return b"".join([*out, raw[done:]]).decode("utf-8")
