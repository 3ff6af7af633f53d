"""Best-fit packing of documents into sequences, improved by swap-based local search.

What fits where depends on lengths alone, and there are at most ``capacity`` of them.  So the
table is reduced to a histogram of piece lengths, whose size is bounded by the capacity and not by
the rows.  The driver packs the histogram: bins with the same content are one *group* with a count.

* Best fit, longest first, whole runs of equal pieces at a time.
* Local search over groups that are not full: move a piece, or exchange one for one or two for
  one, from an emptier to a fuller bin, whichever raises the sum of squared fills most, for as many
  bins at once as both groups have, until the bins are no more than the sum of lengths takes or
  nothing improves.  Bins that become empty go.  All groups are searched; one that was tried in vain
  is tried again only against groups that came or grew since.

Then each piece takes a slot of its length by its rank among pieces of that length, which comes from
counts per input partition and prefix sums over partitions; no partition needs another's rows.

Defined cases: a null or empty text is one piece that holds the end id; a document longer than the
capacity is cut into whole-capacity pieces and a rest; repeated rows and null ids are packed as they
are; ties among equal lengths are settled by partition and row order; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, table
from .wordbpe import WORD_BPE, encoder

CAPACITY, END_ID = 2048, 0
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, local_rank long"


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Histogram of lengths to bins: content, a sorted tuple of lengths, to the number of bins with it."""
    by_room: dict[int, list[list]] = defaultdict(list)  # room to [number, content as linked pairs]
    rooms: set[int] = set()

    def put(number: int, room: int, content) -> None:
        if number:
            by_room[room].append([number, content])
            rooms.add(room)

    for size in sorted(counts, reverse=True):
        left = counts[size]
        for room in sorted(r for r in rooms if r >= size):
            if not left:
                break
            groups, by_room[room] = by_room[room], []
            rooms.discard(room)
            each = room // size
            for number, content in groups:
                full = min(number, left // each)
                put(full, room - each * size, (size, each, content))
                number, left = number - full, left - full * each
                if number and left:  # fewer than each are left: they share one bin
                    put(1, room - left * size, (size, left, content))
                    number, left = number - 1, 0
                put(number, room, content)
        each = capacity // size
        put(left // each, capacity - each * size, (size, each, None))
        if left % each:
            put(1, capacity - left % each * size, (size, left % each, None))
    bins: Counter = Counter()
    for groups in by_room.values():
        for number, content in groups:
            sizes: list[int] = []
            while content:
                sizes += [content[0]] * content[1]
                content = content[2]
            bins[tuple(sorted(sizes, reverse=True))] += number
    return bins


def _ups(low: tuple) -> tuple[list[int], list[int], dict[int, tuple]]:
    """The sizes that can move up alone, and the sums of two of them with what they consist of."""
    often = Counter(low)
    ones = sorted(often)
    twos = {a + b: (a, b) for i, a in enumerate(ones) for b in ones[i:] if a != b or often[a] > 1}
    return ones, sorted(twos), twos


def _exchange(ups: tuple, high: tuple, room: int) -> tuple[int, tuple, tuple] | None:
    """The most that ``high`` can gain from an emptier bin: gain, what moves up, what moves down."""
    ones, sums, twos = ups
    best = None
    for down in (0, *sorted(set(high))):
        for sizes in (ones, sums) if down else (ones,):
            k = bisect.bisect_right(sizes, room + down) - 1
            if k >= 0 and (gain := sizes[k] - down) > 0 and (best is None or gain > best[0]):
                best = gain, (sizes[k],) if sizes is ones else twos[sizes[k]], (down,) if down else ()
    return best


def local_search(bins: Counter, capacity: int) -> Counter:
    """Raise the sum of squared fills by moves and exchanges until the bins are as few as they can be or nothing improves."""
    bins = Counter(bins)
    under = sorted((sum(b), b) for b in bins if sum(b) < capacity)
    n, least = sum(bins.values()), -(-sum(sum(b) * k for b, k in bins.items()) // capacity)
    risen: list[tuple] = []  # groups that came or grew, in that order
    tried: dict[tuple, int] = {}  # groups tried in vain against all, and against so many of ``risen``

    def change(content: tuple, by: int) -> None:
        entry = sum(content), content
        if by > 0 and entry[0] < capacity:
            risen.append(entry)
            if content not in bins:
                bisect.insort(under, entry)
        bins[content] += by
        if not bins[content]:
            del bins[content]
            if entry[0] < capacity:
                del under[bisect.bisect_left(under, entry)]

    while n > least:
        for i, (fill, low) in enumerate(under):
            found, ups = None, None
            if low not in tried:
                highs = reversed(under[i:])
            elif tried[low] == len(risen):
                continue
            else:
                highs = sorted({x for x in risen[tried[low] :] if x >= (fill, low) and x[1] in bins}, reverse=True)
            for total, high in highs:
                if low == high and bins[low] < 2:
                    continue
                ups = ups or _ups(low)
                if (x := _exchange(ups, high, capacity - total)) and (found is None or x[0] + total > found[0][0] + sum(found[1])):
                    found = x, high
                    if x[0] + total == capacity:
                        break
            if found:
                break
            tried[low] = len(risen)
        else:
            break
        (gain, up, down), high = found
        number = bins[low] // 2 if low == high else min(bins[low], bins[high])
        a, b = Counter(low) - Counter(up) + Counter(down), Counter(high) + Counter(up) - Counter(down)
        for content in (low, high):
            change(content, -number)
        for content in (a, b):
            if flat := tuple(sorted(content.elements(), reverse=True)):
                change(flat, number)
            else:
                n -= number
    return bins


class Plan:
    """Slots by length: the ``k``-th piece of a length to its sequence and offset."""

    def __init__(self, bins: Counter):
        starts, keys, firsts, offsets = Counter(), [], [], []
        sequence = 0
        for content, number in sorted(bins.items(), reverse=True):
            at = 0
            for size in content:
                keys.append((size, starts[size]))
                firsts.append(sequence)
                offsets.append(at)
                starts[size] += number
                at += size
            sequence += number
        order = sorted(range(len(keys)), key=keys.__getitem__)
        self.n_sequences = sequence
        self.sizes = np.array([keys[i][0] for i in order], np.int64)
        self.ranks = np.array([keys[i][1] for i in order], np.int64)
        self.firsts = np.array([firsts[i] for i in order], np.int64)
        self.offsets = np.array([offsets[i] for i in order], np.int64)
        self.key = (self.sizes << 48) | self.ranks

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.key, (length.astype(np.int64) << 48) | rank, side="right") - 1
        return self.firsts[k] + rank - self.ranks[k], self.offsets[k]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = WORD_BPE) -> DataFrame:
    """Each document's pieces with their ids' digest, and each one's rank among its partition's pieces of that length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], enc.dtype)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.concatenate([enc.encode(text.as_py()), end]).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    for column, x in zip(out, (doc, k, start, len(own), zlib.crc32(own.tobytes()), part, int(seen[len(own)])), strict=True):
                        column.append(x)
                    seen[len(own)] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return documents(docs).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = WORD_BPE) -> DataFrame:
    """One row a piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    cut = materialize(pieces(docs, capacity, end_id, tokenizer), "pieces")
    by_part = materialize(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    plan = Plan(local_search(best_fit(histogram, capacity), capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    shared = docs.sparkSession.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy()
            sequence, offset = shared.value.place(length, b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], out.split(","))

    out = "doc_id,piece,start,length,ids_crc32,sequence_id,offset"
    ranked = cut.join(bases, ["length", "part"]).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank")
    )
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
