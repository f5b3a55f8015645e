"""Operator 8, packing: token ids of all documents in sequences of at most 4096, by Karmarkar-Karp differencing.

Documents are encoded where they are read. Whole windows are cut off long documents at once. A task gathers the other
pieces until they would fill GROUP_WINDOWS windows, and deals those of the first PACKED share of them into windows by
multiway differencing: each piece begins as a partition of its own, and the two partitions of the largest spread are
merged again and again, the fullest windows of one with the emptiest of the other, until one partition with near-equal
windows is left. Whenever a window exceeds the capacity, the window count rises and the differencing runs again; no piece
of a group is cut to make it fit. What room the windows leave is filled with the pieces that wait behind the group, cut as
needed; if those don't suffice, the emptiest windows are taken apart for it. A task's last ids become sequences whose
lengths are powers of two, which need no padding. So no sequence is padded.

A null text is empty: its document is the end id alone. Null ids and repeated rows are packed like any others (pieces of
rows with one doc_id can't be told apart); an empty table gives no pieces; other columns are ignored. sequence_id is the
task's number times 2^33 plus a count. Nothing is shuffled; memory is bounded by a group and one document.
"""

from __future__ import annotations

import heapq
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import count as counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .chunked_encoding import encoder
from .common import slices

END_ID, CAPACITY, GROUP_WINDOWS, PACKED = 2, 4096, 96, 0.99
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """k windows of indexes into sizes, with near-equal sums: Karmarkar-Karp's largest differencing method for k ways.

    A partial partition lists only its non-empty windows, fullest first; the others are empty.
    """
    if not sizes:
        return [[] for _ in range(k)]
    tie = counter()
    heap = [(-s, next(tie), [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = max(0, len(a) + len(b) - k)  # so many windows of a meet one of b; the fullest meet the emptiest
        merged = a[: len(a) - over] + b[: len(b) - over]
        merged += [(x + y, u + v) for (x, u), (y, v) in zip(a[len(a) - over :], reversed(b[len(b) - over :]), strict=True)] if over else []
        merged.sort(key=lambda w: -w[0])
        least = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (least - merged[0][0], next(tie), merged))
    windows = [w for _, w in heap[0][2]]
    return windows + [[] for _ in range(k - len(windows))]


def fit(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of indexes into sizes, of at most capacity ids each; sizes are of at most capacity."""
    k = -(-sum(sizes) // capacity)
    while True:
        windows = differencing(sizes, k)
        over = sum(max(0, sum(sizes[i] for i in w) - capacity) for w in windows)
        if not over:
            return [w for w in windows if w]
        k += -(-over // capacity)


def _size(piece: tuple) -> int:
    return len(piece[2]) // 4


class _Packer:
    """Pieces are (doc_id, ids before it in its document, bytes, ids of the document)."""

    def __init__(self, task: int, capacity: int):
        self.next, self.capacity = counter(task << 33), capacity
        self.waiting: deque[tuple] = deque()
        self.size = 0

    def add(self, doc_id: int | None, array: bytes) -> Iterator[tuple]:
        n = len(array) // 4
        whole = n - n % self.capacity
        for start in range(0, whole, self.capacity):
            yield from self.sequence([(doc_id, start, array[4 * start : 4 * (start + self.capacity)], n)])
        if n > whole:
            self.wait((doc_id, whole, array[4 * whole :], n))
        if self.size >= GROUP_WINDOWS * self.capacity:
            yield from self.group(GROUP_WINDOWS)

    def wait(self, piece: tuple) -> None:
        self.waiting.append(piece)
        self.size += _size(piece)

    def take(self, room: int) -> list[tuple]:
        """So many waiting ids; the last piece is cut."""
        out = []
        while room:
            doc_id, start, array, n = self.waiting.popleft()
            cut = min(room, len(array) // 4)
            out.append((doc_id, start, array[: 4 * cut], n))
            if 4 * cut < len(array):
                self.waiting.appendleft((doc_id, start + cut, array[4 * cut :], n))
            room -= cut
            self.size -= cut
        return out

    def group(self, windows: int) -> Iterator[tuple]:
        """Full windows of the pieces that wait; some of them wait on."""
        pieces, limit = [], int(PACKED * windows * self.capacity)
        while self.waiting and _size(self.waiting[0]) <= limit:
            piece = self.waiting.popleft()
            pieces.append(piece)
            limit -= _size(piece)
            self.size -= _size(piece)
        packed = [[pieces[i] for i in w] for w in fit([_size(p) for p in pieces], self.capacity)]
        order = sorted(((sum(map(_size, w)), k) for k, w in enumerate(packed)), reverse=True)  # fullest first
        room = sum(self.capacity - n for n, _ in order)
        while room > self.size:
            n, k = order.pop()
            room -= self.capacity - n
            for piece in packed[k]:
                self.wait(piece)
        for n, k in order:
            yield from self.sequence(packed[k] + self.take(self.capacity - n))

    def finish(self) -> Iterator[tuple]:
        if self.size >= self.capacity:
            yield from self.group(self.size // self.capacity)
        while self.size:
            yield from self.sequence(self.take(self.capacity if self.size >= self.capacity else 1 << (self.size.bit_length() - 1)))

    def sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        number, offset = next(self.next), 0
        for doc_id, start, array, n in pieces:
            yield doc_id, start, len(array) // 4, zlib.crc32(array), n, number, offset
            offset += len(array) // 4


def pack(documents: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(path, False), _Packer(TaskContext.get().partitionId(), capacity)

        def rows(got: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], names=_NAMES)

        for some in slices(batches):
            got = []
            for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                got += packer.add(doc_id, enc.encode(text) + end)
            if got:
                yield rows(got)
        if got := list(packer.finish()):
            yield rows(got)

    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, ", ".join(f"{n} long" for n in _NAMES))
