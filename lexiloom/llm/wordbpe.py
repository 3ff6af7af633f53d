"""Whole-text encoding with the ``tokenizers`` library, word by word with a bounded memory.

The tokenizer's rules never join text across white space, nor between letters, digits and other
characters, but for apostrophes.  So a text is cut there, and what the library returns for a piece
is remembered.  All ids come from the library; the cut only decides which strings it sees.

A text of Latin-1 characters is put in lower case first, which the tokenizer would do character by
character, and cut by character kind in one vector operation; nothing is cut beside an apostrophe.
Other texts are cut at white space, and at the ends of runs of Latin letters and of punctuation.
A run of Latin-1 letters goes, in lower case and with bytes for characters, straight to the library's
model, as that is all that the steps before the model do to such a word.  ``tests/llm`` compares whole texts with the library's result.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

WORD_BPE = "word_bpe_49k.json"
#: ASCII white space, and ASCII punctuation without the apostrophe.
WS, PUNCT = r" \t\n\r\f\v", r"!-&(-/:-@\[-`{-~"
PIECES = re.compile(rf"[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[{WS}{PUNCT}]|\Z)|[{PUNCT}]+(?=[{WS}]|\Z)|[^{WS}]+")
CHUNKS = re.compile(rf"[^{WS}]+")
#: How special tokens start; what ``str.split`` takes for white space and the tokenizer does not.
#: Latin-1 characters by kind: 1 letters, 2 numbers, 4 others, 8 white space and the apostrophe.
KINDS = np.array([8 if chr(i).isspace() or chr(i) == "'" else 1 if unicodedata.category(chr(i))[0] == "L" else 2 if unicodedata.category(chr(i))[0] == "N" else 4 for i in range(256)], np.uint8)
#: By the kinds of two neighbours put together: whether a cut lies between.
CUT = np.isin(np.arange(16), (1 | 2, 1 | 4, 2 | 4))
#: The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on.
BYTES = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}
SPECIAL, SEPARATORS = "<|", "\x1c\x1d\x1e\x1f"
REMEMBERED, LONGEST = 500_000, 48


class Memory(dict):
    """A bounded memory of ``make(key)``: two generations, of which the older goes when the newer is full."""

    def __init__(self, make, limit: int = REMEMBERED, longest: int = LONGEST):
        super().__init__()
        self.make, self.limit, self.longest, self.older = make, limit, longest, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class WordEncoder:
    """``encode(text)`` gives the ids as an array of ``dtype``, the narrowest unsigned type that holds the vocabulary."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        narrow = self.tokenizer.get_vocab_size() <= 1 << 16
        self.dtype, self.code = np.dtype("<u2" if narrow else "<u4"), "H" if narrow else "I"
        self.model = self.tokenizer.model
        self.words, self.chunks = Memory(self._word), Memory(self._chunk, REMEMBERED // 5)

    def _word(self, piece: str) -> bytes:
        if piece.isalpha() and piece.isascii():
            lower = piece.lower()
            ids = [t.id for t in self.model.tokenize(lower)]
        elif piece.isalpha() and max(piece) <= "ÿ":
            ids = [t.id for t in self.model.tokenize(piece.lower().encode().decode("latin-1").translate(BYTES))]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        return array(self.code, ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha() and chunk.isascii():
            return self._word(chunk)
        return b"".join(map(self.words.__getitem__, PIECES.findall(chunk)))

    def encode(self, text: str) -> np.ndarray:
        parts = None if SPECIAL in text or any(c in text for c in SEPARATORS) else self._cut(text)
        if parts is None:
            parts = map(self.chunks.__getitem__, CHUNKS.findall(text))
        else:
            parts = map(self.words.__getitem__, parts)
        return np.frombuffer(b"".join(parts), self.dtype)

    @staticmethod
    def _cut(text: str) -> list[str] | None:
        try:
            text.encode("latin-1")  # as it is: some other letters have lower case in Latin-1
            raw = np.frombuffer(text.lower().encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            return None
        kinds = KINDS[raw]
        at = np.flatnonzero(CUT[kinds[1:] | kinds[:-1]]) + 1
        return str(np.insert(raw, at, 32).tobytes(), "latin-1").split()


@lru_cache(1)
def encoder(name: str = WORD_BPE) -> WordEncoder:
    """One a Python worker; the vocabulary file is found by name on each machine."""
    return WordEncoder(public_tokenizers.path(name))
