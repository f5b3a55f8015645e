"""Encodes texts with the tokenizers library, each distinct chunk between blanks once.

A text is cut at single blanks and line ends where the tokenizer's own pre-tokenizer also cuts, so that the ids of the
chunks, put together, are the ids of the whole text. Texts with other white space, or with runs of it, are encoded whole.
"""

from __future__ import annotations

import os
import re
from struct import pack

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives each task one core

from tokenizers import Tokenizer  # noqa: E402

from .common import kept  # noqa: E402

#: Chunks that a worker keeps, with blanks or without; it encodes others again when they come back.
CACHED_CHUNKS = {True: 900_000, False: 350_000}
_WHITE_RUN = re.compile(r" (?:\s|$)|\n(?:\s|$)|[^\S \n]|\0")
#: A run of Latin letters, perhaps after a blank, then perhaps ASCII punctuation without an apostrophe: one or two pre-tokens.
_WORD = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]+)?")


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, others come after."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class ChunkedEncoder(dict):
    """Chunk -> its ids as little-endian unsigned 32-bit integers.

    keep_blank: the blank belongs to the word after it (byte-level vocabularies), or is dropped and letters are lower-cased.
    """

    def __init__(self, path: str, keep_blank: bool):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.room = self.tokenizer.model, CACHED_CHUNKS[keep_blank]
        self.keep_blank, self.letters = keep_blank, _byte_letters()

    def chunks(self, text: str) -> list[str]:
        if _WHITE_RUN.search(text):
            return [text]
        if not self.keep_blank:
            return text.replace("\n", " ").split(" ")
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def __missing__(self, chunk: str) -> bytes:
        word = _WORD.fullmatch(chunk) if len(chunk) <= 64 else None
        if word is None:
            ids = self.tokenizer.encode_batch_fast([chunk], add_special_tokens=False)[0].ids
        elif word[2]:
            ids = None
            got = self[word[1]] + self[word[2]]
        else:
            raw = chunk if self.keep_blank else chunk.lower()
            raw = raw.replace(" ", self.letters[32]) if raw.isascii() else "".join(map(self.letters.__getitem__, raw.encode()))
            ids = [t.id for t in self.model.tokenize(raw)]
        if ids is not None:
            got = pack(f"<{len(ids)}I", *ids)
        if len(self) < self.room and len(chunk) <= 64:
            self[chunk] = got
        return got

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text; a null text is empty."""
        return b"".join(map(self.__getitem__, self.chunks(text))) if text else b""


def encoder(path: str, keep_blank: bool) -> ChunkedEncoder:
    """One for each Python worker, so that its chunks serve later tasks too."""
    return kept(("encoder", path, keep_blank), lambda: ChunkedEncoder(path, keep_blank))
