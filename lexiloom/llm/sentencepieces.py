"""Exact encoding with a SentencePiece model of merge type, by backtracking, and decoding.

Instead of merging step by step, a chunk's pieces are found left to right.  An Aho-Corasick pass over
the chunk gives the longest piece that starts at each place.  A piece is taken if it is compatible
with the one before it: re-merging the two side by side must merge nothing across their border.  Else the
next shorter piece that starts there is tried; if none is left, the place is marked in a bitfield of
failed positions, the piece before is given up, and its shorter ones are tried.  Each place fails at
most once, so the work is linear in the chunk for a bounded piece length.

Texts are cut into chunks where no piece of the vocabulary has the two neighbouring characters side by
side, as nothing merges there; which characters these are is worked out from the vocabulary.  Chunks
are remembered in a bounded memory.  Characters that the vocabulary lacks become their UTF-8 bytes.

Defined cases: null and empty texts have no ids and decode to an empty text; repeated rows and null
ids are encoded as they are; very long chunks without a cut are encoded in one pass, as any other.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from .common import documents, table
from .wordbpe import Memory

PIECE_BPE = "piece_bpe_32k.model"
SPACE = "▁"
MARKS = ".,;:!?#%|)"


class PieceEncoder:
    """Encoder and decoder over the vocabulary of one model file."""

    def __init__(self, path: str, remembered: int = 400_000):
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.numbers = every = list(range(model.vocab_size()))  # one object an id, however often it is remembered
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in every if model.is_byte(i)}
        self.pieces = {model.id_to_piece(i): i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        self.rank = {p: -model.get_score(i) for p, i in self.pieces.items()}  # the lower, the sooner merged
        self.automaton = ahocorasick.Automaton()
        for piece in self.pieces:
            self.automaton.add_word(piece, (len(piece) - 1, piece))
        self.automaton.make_automaton()
        # The next shorter piece that starts like a given one.
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.pieces), None) for p in self.pieces}
        self.characters = {p for p in self.pieces if len(p) == 1}
        if any(not self.characters.issuperset(p) for p in self.pieces):
            raise ValueError("a piece has a character that is no piece: texts can't be cut at unknown characters")
        self.fits: dict[tuple[str, str], bool] = {}
        self.edges: dict[str, tuple[list, list] | None] = {}
        self.chunk_pattern = re.compile(self._cuts())
        self.memory = Memory(self._encode_chunk, remembered)

    def _cuts(self) -> str:
        """The pattern of chunks; ``kinds`` and ``cut`` say the same of bytes and their neighbours.

        Before spaces that follow another character; around line ends; and after a Latin-1 letter
        before a mark that no piece has there."""
        pairs = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        if any(b == SPACE != a for a, b in pairs):
            raise ValueError("a piece has a space after another character: texts can't be cut at spaces")
        closing = set(MARKS) - {b for a, b in pairs if a.isalpha() and a <= "ÿ"}
        line = "" if any("\n" in p for p in pairs) else "\n"
        word = rf" *[^ {line}]+| +" + (f"|{line}" if line else "")
        marks = "".join(map(re.escape, sorted(closing)))
        pattern = rf" *[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[{marks}])|{word}" if closing else word
        kinds = np.array([1 if c == " " else 2 if c == line else 4 if c in closing else 8 if c.isascii() and c.isalpha() else 0 for c in map(chr, range(256))], np.uint8)
        cut = np.zeros((16, 16), bool)
        for a in (0, 1, 2, 4, 8):
            for b in (0, 1, 2, 4, 8):
                cut[a, b] = b == 1 != a or 2 in (a, b) or (a, b) == (8, 4)
        self.kinds, self.cut = kinds, cut.ravel()
        return pattern

    def merges(self, text: str) -> tuple[list[str], list[tuple[float, str, int, int]]]:
        """The pieces of a short text by merging, the best-ranked neighbours first and the leftmost of
        equals; and each merge: its rank, what it made, and from where to where."""
        parts, history = list(text), []
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, math.inf) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == math.inf:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            start = sum(map(len, parts[:i]))
            history.append((best, parts[i], start, start + len(parts[i])))
        return parts, history

    def _edges(self, piece: str) -> tuple[list, list] | None:
        """What stands at a piece's left and right edge as it is merged: pieces with the rank that ends
        each.  None if the piece isn't its own encoding, or its merges don't come in the order of rank."""
        if piece not in self.edges:
            parts, history = self.merges(piece)
            ranks = [h[0] for h in history]
            left, right = [(piece[0], 0)], [(piece[-1], 0)]
            for rank, made, start, end in history:
                if start == 0:
                    left.append((made, rank))
                if end == len(piece):
                    right.append((made, rank))
            ends = lambda chain: [(p[0], nxt[1]) for p, nxt in zip(chain, [*chain[1:], ("", math.inf)])]
            self.edges[piece] = (ends(left), ends(right)) if parts == [piece] and ranks == sorted(ranks) else None
        return self.edges[piece]

    def _remerged(self, left: str, right: str) -> bool:
        """Merge both again side by side: they are compatible if nothing merges across their border.

        While ``a`` and ``b`` stand at the border, a merge of the two comes first if its rank is below
        the rank that ends ``a``, and not above the one that ends ``b``: of equals the leftmost merges."""
        one, two = self._edges(left), self._edges(right)
        if one is None or two is None:
            return self.merges(left + right)[0] == [left, right]
        one, two, i, j = one[1], two[0], 0, 0
        while True:
            (a, a_ends), (b, b_ends) = one[i], two[j]
            rank = self.rank.get(a + b, math.inf)
            if rank < a_ends and rank <= b_ends and rank < math.inf:
                return False
            if a_ends == b_ends == math.inf:
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1

    def compatible(self, left: str, right: str) -> bool:
        """Whether the two stand side by side in the encoding of their joined text; ``left`` may be empty."""
        found = self.fits.get((left, right))
        if found is None:
            if len(self.fits) >= 400_000:
                self.fits.clear()
            found = self.fits[left, right] = self._remerged(left, right) if left else self.merges(right)[0] == [right]
        return found

    def split(self, text: str) -> list[str]:
        """The pieces of a text all of whose characters are pieces."""
        longest: list[str | None] = [None] * len(text)
        for end, (back, piece) in self.automaton.iter(text):
            longest[end - back] = piece  # of those from one place, the longest ends last
        taken: list[str] = []
        failed = bytearray((len(text) >> 3) + 1)
        at, piece = 0, longest[0] if text else None
        while at < len(text):
            left = taken[-1] if taken else ""
            while piece is not None:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and self.compatible(left, piece):
                    break
                piece = self.shorter[piece]
            if piece is not None:
                taken.append(piece)
                at += len(piece)
                piece = longest[at] if at < len(text) else None
            elif not taken:
                raise ValueError(f"no encoding of {text[:40]!r}")
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = taken.pop()
                at -= len(piece)
                piece = self.shorter[piece]
        return taken

    def _encode_chunk(self, chunk: str) -> tuple[tuple[int, ...], str]:
        chunk = chunk.replace(" ", SPACE)
        ids: list[int] = []
        if self.characters.issuperset(chunk):
            ids = [self.pieces[p] for p in self.split(chunk)]
        else:  # a character that is no piece merges with nothing
            for known, run in itertools.groupby(chunk, self.characters.__contains__):
                ids += [self.pieces[p] for p in self.split("".join(run))] if known else [self.bytes[b] for b in "".join(run).encode()]
        return tuple(map(self.numbers.__getitem__, ids)), ",".join(map(str, ids))

    def chunks(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        if not text:
            return []
        text = " " + text.replace(SPACE, " ")  # the model takes both for one character
        if "\0" in text:
            return [*map(self.memory.__getitem__, self.chunk_pattern.findall(text))]
        raw = np.frombuffer(text.encode(), np.uint8)
        kinds = self.kinds[raw]
        cut = self.cut[(kinds[:-1] << 4) | kinds[1:]]
        if len(raw) != len(text):  # letters of two bytes: 0xC3, then any but those of two signs
            cut[1:] |= (raw[:-2] == 0xC3) & (raw[1:-1] != 0x97) & (raw[1:-1] != 0xB7) & (kinds[2:] == 4)
        at = np.flatnonzero(cut) + 1
        return [*map(self.memory.__getitem__, str(np.insert(raw, at, 0), "utf-8").split("\0"))]

    def encode(self, text: str) -> list[int]:
        return [i for ids, _ in self.chunks(text) for i in ids]

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


@lru_cache(1)
def encoder(name: str = PIECE_BPE) -> PieceEncoder:
    return PieceEncoder(public_tokenizers.path(name))


ENCODED = "doc_id long, ids array<int>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, model: str = PIECE_BPE) -> DataFrame:
    """``doc_id`` and the ids of its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for b in batches:
            ids = [enc.encode(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return documents(docs).mapInArrow(run, ENCODED)


def digests(docs: DataFrame, model: str = PIECE_BPE) -> DataFrame:
    """Per document: number and digest of its ids, and digest of what they decode to."""
    names = [x.split()[0] for x in DIGESTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for b in batches:
            n, coded, decoded = [], [], []
            for t in b.column("text"):
                chunks = enc.chunks(t.as_py())
                ids = [i for own, _ in chunks for i in own]
                n.append(len(ids))
                coded.append(hashlib.sha256(",".join([s for _, s in chunks]).encode()).hexdigest())
                decoded.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded), pa.array(decoded)], names)

    return documents(docs).mapInArrow(run, DIGESTS)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
