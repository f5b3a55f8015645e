"""Operator 1, token counts: how many pieces a unigram tokenizer makes of each whole text.

Pre-tokens are the words between ASCII white space, each with the word mark U+2581 before it. The distinct ones that a
worker hasn't met yet go into a trie, which is scored level by level: every node gets the best forward score of its
prefix from its parent's, once for all words that share it, and the node where a word ends gives the word's count, which
is stored. Pieces come from a public vocabulary file; a piece's log probability follows from its rank there (Zipf's law).
A character that is no piece falls back to its UTF-8 bytes, one token each, at a score UNKNOWN_BELOW below the lowest
piece. Of equal scores the one with the longest last piece counts.

Nulls and empty texts have 0 words and 0 tokens; null ids and repeated rows are kept as they are; an empty table gives
an empty result; further columns are ignored. Only a worker's terminal counts, of bounded number, and the trie of some
words are held in memory: no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept, slices

WORD_MARK = "▁"
#: Terminal counts that a worker keeps before it begins anew, words that make one trie, and characters beyond which a
#: word is scored alone and not kept.
KEPT_WORDS, TRIE_WORDS, STORED_CHARS = 1_000_000, 32_768, 64
UNKNOWN_BELOW = 10.0


def load_pieces(path: str) -> dict[str, float]:
    """Piece -> log probability by its rank among the file's ordinary pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    plain = [i for i in range(len(model)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (r + 2) for r in range(len(plain))))
    return {model.id_to_piece(i): -math.log(r + 2) - total for r, i in enumerate(sorted(plain))}


class PieceTrie:
    """The vocabulary as a trie: from node and code point to the next node; gain is a node's piece score, or -inf."""

    def __init__(self, pieces: dict[str, float]):
        numbers, step = {"": 0}, {}
        for piece in pieces:
            for end in range(1, len(piece) + 1):
                if piece[:end] not in numbers:
                    numbers[piece[:end]] = len(numbers)
                    step[numbers[piece[: end - 1]] << 21 | ord(piece[end - 1])] = numbers[piece[:end]]
        self.keys = np.array(sorted(step), dtype=np.int64)
        self.next = np.array([step[k] for k in self.keys.tolist()], dtype=np.int64)
        self.gain = np.full(len(numbers), -np.inf)
        for piece, score in pieces.items():
            self.gain[numbers[piece]] = score

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The next nodes, -1 where no piece goes on."""
        if not len(self.keys):
            return np.full(len(nodes), -1)
        keys = nodes << 21 | codes
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.next[at], -1)


class TerminalCounts(dict):
    """Pre-token (bytes, without its mark) -> its number of tokens, for the pre-tokens inserted so far."""

    def __init__(self, pieces: dict[str, float]):
        super().__init__()
        self.pieces, self.trie = pieces, PieceTrie(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_BELOW

    def __missing__(self, plain: bytes) -> int:
        """Very long words aren't kept."""
        return self.alone(WORD_MARK + plain.decode("utf-8", "surrogatepass"))

    def alone(self, word: str) -> int:
        """Tokens of one word, without a trie."""
        scores, tokens, gain_of = [0.0], [0], self.pieces.get
        for end in range(1, len(word) + 1):
            best, count = -math.inf, 0
            for start in range(max(0, end - self.longest), end):
                gain = gain_of(word[start:end])
                if gain is not None and scores[start] + gain > best:
                    best, count = scores[start] + gain, tokens[start] + 1
            if word[end - 1] not in self.pieces and scores[end - 1] + self.unknown > best:
                best, count = scores[end - 1] + self.unknown, tokens[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))
            scores.append(best)
            tokens.append(count)
        return tokens[-1]

    def insert(self, words: set[bytes]) -> None:
        """Insert those of the words that are new and not very long."""
        new = words.difference(self)
        if len(self) + len(new) > KEPT_WORDS:
            self.clear()
            new = words
        texts = sorted((t, w) for w in new if len(t := WORD_MARK + w.decode("utf-8", "surrogatepass")) <= STORED_CHARS)
        for start in range(0, len(texts), TRIE_WORDS):
            some = texts[start : start + TRIE_WORDS]
            self.update(zip((w for _, w in some), self.score([t for t, _ in some]).tolist(), strict=True))

    def score(self, words: list[str]) -> np.ndarray:
        """Tokens of each of the words, which come in order: a trie's levels are runs of equal prefixes.

        Of a level's nodes, score and tokens are those of their prefixes. Pieces that may run on from a node are in the
        arrays owner (the node, rising), piece (the place in the piece trie), and before and taken (score and tokens of
        the prefix behind which the piece began).
        """
        lengths = np.array(list(map(len, words)), dtype=np.int64)
        codes = np.array(words, dtype=f"U{lengths.max()}").view(np.uint32).reshape(len(words), -1).astype(np.int64)
        node, out = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        score, tokens = np.zeros(1), np.zeros(1, np.int64)
        owner, piece, before, taken = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        on = np.arange(len(words))
        for depth in range(codes.shape[1]):
            on = on[lengths[on] > depth]
            above, c = node[on], codes[on, depth]
            new = np.concatenate([[True], (above[1:] != above[:-1]) | (c[1:] != c[:-1])])
            node[on] = np.cumsum(new) - 1
            parent, c = above[new], c[new]
            n = len(parent)
            # Each new node goes on with its parent's running pieces, and with one that begins behind the parent.
            first, last = np.searchsorted(owner, parent), np.searchsorted(owner, parent, side="right")
            sizes = last - first
            flat = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            mine = np.concatenate([np.repeat(np.arange(n), sizes), np.arange(n)])
            order = np.argsort(mine, kind="stable")
            mine = mine[order]
            went = self.trie.step(np.concatenate([piece[flat], np.zeros(n, np.int64)])[order], c[mine])
            before, taken = np.concatenate([before[flat], score[parent]])[order], np.concatenate([taken[flat], tokens[parent]])[order]
            runs = went >= 0
            owner, piece, before, taken = mine[runs], went[runs], before[runs], taken[runs]
            gain = before + self.trie.gain[piece]
            best, count = np.full(n, -np.inf), np.zeros(n, np.int64)
            np.maximum.at(best, owner, gain)
            hit = np.flatnonzero((gain == best[owner]) & (gain > -np.inf))[::-1]
            count[owner[hit]] = taken[hit] + 1  # the first, hence longest, of equal ones is written last
            single = self.trie.step(np.zeros(n, np.int64), c)
            plain = score[parent] + self.unknown
            fall = ((single < 0) | (self.trie.gain[single] == -np.inf)) & (plain > best)
            width = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
            score, tokens = np.where(fall, plain, best), np.where(fall, tokens[parent] + width, count)
            ends = on[lengths[on] == depth + 1]
            out[ends] = tokens[node[ends]]
        return out


def worker_counts(path: str) -> TerminalCounts:
    return kept(("trie", path), lambda: TerminalCounts(load_pieces(path)))


def count_tokens(documents: DataFrame, pieces_path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every document."""
    path = pieces_path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terminal = worker_counts(path)
        for some in slices(batches):
            found = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in some.column(1).to_pylist()]
            terminal.insert(set(chain.from_iterable(found)))
            words, tokens = list(map(len, found)), [sum(map(terminal.__getitem__, w)) for w in found]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
