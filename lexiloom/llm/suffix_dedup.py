"""Removal of long repeats by sharded suffix sorting.

Removed is each byte covered by a string of ``least`` bytes that also starts earlier: in a document of
smaller id, or earlier in the same one.  Strings are judged on the input, and never cross documents.

1. The documents are written once to the shared folder; later passes read those files where they are
   needed, so texts are not shuffled.
2. *Anchors*: of the 32-byte grams in a window of ``least`` bytes the one with the lowest hash is its
   anchor, so equal windows have equal anchors at equal places.  The windows of one anchor, with the
   bytes they span, are its *context*.  An anchor whose gram occurs nowhere else spans no repeat.
   Anchors go to buckets by gram hash as packed arrays, equal contexts within a segment as one.
3. A context that occurred earlier as a whole is a repeat throughout.  The first of each context whose
   gram has other contexts too needs its bytes compared: it is fetched and sent to a shard.
4. Each shard sorts all suffixes of its contexts by external induced sorting (see ``induced``), in bounded
   memory whatever its size.  A run of suffixes with ``least`` bytes in common is one string; all its
   windows but the first are repeats.
5. Repeats go back to their files, where spans are joined and cut out.

All strings of ``least`` bytes are compared; steps 2 and 3 only set aside those that cannot have, or
are already known to have, an earlier equal.

A passage that very many documents share would make its grams the anchors of as many contexts, where the
passage meets other text.  So grams that are in ``HOT_SHARE`` of ``HOT_SAMPLE`` sampled documents are anchors
only of windows without others; the sample decides where strings are compared, not whether.

Defined cases: null and empty texts have nothing to remove; documents shorter than ``least`` are kept whole; a null
id comes before all others; of repeated ids the order is that of the written files and rows; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.session import work_folder

from .common import new_path, partitions, table
from .induced import CAP, CHUNK, Scratch, Tape, descending, padded
from .textstats import BLOCK, hash_spans, mix

LEAST, GRAM = 100, 32
#: Anchors in a bucket and bytes of contexts in a shard, about; bytes of text in a segment of a file.
BUCKET_ANCHORS, SHARD_BYTES, SEGMENT = 250_000, 2_500_000, 16 << 20
HOT_SAMPLE, HOT_SHARE, HOT_BITS, HOT_LENGTH = 400, 0.02, 20, 1 << 16
NO_ID = -(1 << 63)
#: Arrays of an anchor: gram and context hashes; document id, file, row in it; first window, further windows, the gram's place.
ANCHOR = {"gram": "<u8", "context": "<u8", "doc": "<i8", "file": "<i4", "row": "<i4", "lo": "<i8", "more": "u1", "off": "u1"}
SPAN = {"row": "<i4", "lo": "<i8", "more": "u1"}
ROW = "kind int, target long, n long, payload binary"


def pack(arrays: dict[str, np.ndarray], kinds: dict[str, str], tail: bytes = b"") -> bytes:
    """Arrays of one length as compressed bytes; signed ones as differences, which compress well."""
    parts = [np.array([len(next(iter(arrays.values())))], "<i8").tobytes()]
    for name, kind in kinds.items():
        x = arrays[name].astype(kind)
        parts.append((np.diff(x, prepend=x.dtype.type(0)) if kind[1] == "i" else x).tobytes())
    return zstandard.ZstdCompressor(1).compress(b"".join([*parts, tail]))


def unpack(payload: bytes, kinds: dict[str, str]) -> tuple[dict[str, np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n, at, out = int(np.frombuffer(raw, "<i8", 1)[0]), 8, {}
    for name, kind in kinds.items():
        x = np.frombuffer(raw, kind, n, at)
        out[name] = np.cumsum(x, dtype=kind) if kind[1] == "i" else x
        at += x.nbytes
    return out, raw[at:]


def joined(payloads, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    parts = [unpack(p.as_py(), kinds)[0] for p in payloads]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.empty(0, kinds[k]) for k in kinds}


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of the grams at each place."""
    words = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw), strides=(1,))
    n = len(raw) - GRAM + 1
    out = np.zeros(n, np.uint64)
    for at in range(0, GRAM, 8):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[at : at + n])
    return out


def hot_grams(texts: DataFrame) -> np.ndarray:
    """For each beginning of a hash, whether it is that of a gram in very many documents; from a bounded sample."""
    share = min(1.0, HOT_SAMPLE / max(1, texts.count()))
    sampled = texts.filter((F.rand(7) < share) & (F.length("text") <= HOT_LENGTH)).select("text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column("text"):
                raw = np.frombuffer(text.as_py().encode(), np.uint8)
                if len(raw) >= LEAST:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(gram_hashes(raw) >> np.uint64(64 - HOT_BITS)).astype(np.int64))], ["gram"])

    often = sampled.mapInArrow(grams, "gram long").groupBy("gram").count().filter(F.col("count") >= max(3, HOT_SHARE * HOT_SAMPLE))
    out = np.zeros(1 << HOT_BITS, np.bool_)
    out[[r.gram for r in often.collect()]] = True  # at most 2**HOT_BITS rows
    return out


def anchors(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hot: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Anchors of the windows within ``raw[start:end]``; ``part`` is the place of the span, ``lo`` counts in ``raw``."""
    n, width = len(raw), LEAST - GRAM + 1
    valid = np.zeros(n + 1, np.int32)
    long = ends - starts >= LEAST
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - LEAST + 1, -1)
    valid = np.cumsum(valid)[: max(0, n - LEAST + 1)] > 0
    if not valid.any():
        return {k: np.empty(0, np.int64) for k in ("gram", "context", "part", "lo", "more", "off")}
    gram = gram_hashes(raw)
    places = np.uint64(BLOCK - 1)
    key = gram >> np.uint64(1)
    if hot is not None:
        key |= hot[gram >> np.uint64(64 - HOT_BITS)].astype(np.uint64) << np.uint64(63)  # after all others
    key = (key & ~places) | np.arange(len(gram), dtype=np.uint64)
    padded = np.append(key, np.full(-len(key) % width, ~np.uint64(0))).reshape(-1, width)
    to_end = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    from_start = np.minimum.accumulate(padded, 1).ravel()
    at = (np.minimum(to_end[: len(valid)], from_start[width - 1 : width - 1 + len(valid)]) & places).astype(np.int64)
    change = np.append(True, (at[1:] != at[:-1]) | (valid[1:] != valid[:-1]))
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(valid)) - 1
    lo, hi = first[valid[first]], last[valid[first]]
    off = at[lo] - lo
    context = mix(hash_spans(raw, lo, hi + LEAST) + off.astype(np.uint64))
    return {"gram": gram[at[lo]], "context": context, "part": np.searchsorted(starts, lo, "right") - 1, "lo": lo, "more": hi - lo, "off": off}


def _open(path: str) -> pq.ParquetFile:
    where, name = fs.FileSystem.from_uri(path)
    return pq.ParquetFile(where.open_input_file(name))


def _texts(path: str) -> Iterator[tuple[int, list, list[bytes]]]:
    """Batches of a written file: the first row's number, ids, texts as bytes."""
    row = 0
    for batch in _open(path).iter_batches(512, columns=["doc_id", "text"]):
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        yield row, batch.column("doc_id").to_pylist(), texts
        row += len(texts)


def file_anchors(path: str, file: int, hot: np.ndarray | None = None) -> Iterator[dict[str, np.ndarray]]:
    """All anchors of one file in the order of its rows, a segment at a time."""
    parts: list[dict[str, np.ndarray]] = []
    seen = 0

    def add(raw: bytes, starts: list[int], rows: list[int], ids: list[int], shift: int) -> None:
        x = np.frombuffer(raw, np.uint8)
        s = np.array(starts)
        found = anchors(x, s, np.append(s[1:], len(x)), hot)
        part = found.pop("part").astype(np.int64)
        found["lo"] = found["lo"] - s[part] + shift
        parts.append(found | {"row": np.array(rows)[part], "doc": np.array(ids)[part], "file": np.full(len(part), file)})

    def segment() -> dict[str, np.ndarray]:
        out = {k: np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in ANCHOR}
        parts.clear()
        return out

    for first, ids, texts in _texts(path):
        held, starts, rows, docs, size = [], [], [], [], 0
        for i, (doc, text) in enumerate(zip(ids, texts, strict=True)):
            doc = NO_ID if doc is None else doc
            if len(text) < LEAST:
                continue
            if len(text) > BLOCK:
                for at in range(0, len(text) - LEAST + 1, BLOCK - LEAST + 1):
                    add(text[at : at + BLOCK], [0], [first + i], [doc], at)
                    if (seen := seen + BLOCK) > SEGMENT:
                        yield segment()
                        seen = 0
                continue
            if size + len(text) > BLOCK:
                add(b"".join(held), starts, rows, docs, 0)
                held, starts, rows, docs, size = [], [], [], [], 0
            held.append(text)
            starts.append(size)
            rows.append(first + i)
            docs.append(doc)
            size += len(text)
        if held:
            add(b"".join(held), starts, rows, docs, 0)
        if (seen := seen + sum(map(len, texts))) > SEGMENT:
            yield segment()
            seen = 0
    yield segment()


def _first_of_each(a: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Anchors by gram, context and place in the corpus; and whether each is the first of its context."""
    order = np.lexsort([a[k] for k in ("lo", "row", "file", "doc", "context", "gram")])
    a = {k: v[order] for k, v in a.items()}
    first = np.ones(len(order), bool)
    first[1:] = (a["gram"][1:] != a["gram"][:-1]) | (a["context"][1:] != a["context"][:-1])
    return a, first


def _rows(kind: int, by: np.ndarray, arrays: dict[str, np.ndarray], kinds: dict[str, str], weight: np.ndarray | None = None, tails: list[bytes] | None = None) -> list[dict]:
    """A packed row for each value of ``by``; ``n`` sums the weights."""
    out = []
    order = np.argsort(by, kind="stable")
    if not len(order):
        return out
    cuts = np.flatnonzero(np.diff(by[order])) + 1
    for own in np.split(order, cuts):
        tail = b"".join(tails[i] for i in own) if tails is not None else b""
        n = int(weight[own].sum()) if weight is not None else len(own)
        out.append({"kind": kind, "target": int(by[own[0]]), "n": n, "payload": pack({k: v[own] for k, v in arrays.items()}, kinds, tail)})
    return out


_SCHEMA = pa.schema([("kind", pa.int32()), ("target", pa.int64()), ("n", pa.int64()), ("payload", pa.binary())])
SPANS, ANCHORS, WANTED = 0, 1, 2
CONTEXT = {k: v for k, v in ANCHOR.items() if k not in ("gram", "context", "off")}


class _Firsts:
    """Marks all but the first of each run of equal windows, as the suffixes come in order."""

    def __init__(self, start: np.ndarray, contexts: dict[str, np.ndarray], repeat: np.ndarray):
        self.start, self.contexts, self.repeat, self.best = start, contexts, repeat, None

    def add(self, suffixes: np.ndarray, common: np.ndarray) -> None:
        new = common < LEAST
        member = np.flatnonzero(~new | np.append(~new[1:], True))  # the last one's run may go on
        at, run = suffixes[member].astype(np.int64), np.cumsum(new)[member]
        own = np.searchsorted(self.start, at, "right") - 1
        inside = at - self.start[own]
        window = inside <= self.contexts["more"][own]
        at, run, own, inside = at[window], run[window], own[window], inside[window]
        place = [self.contexts[k][own] for k in ("doc", "file", "row")] + [self.contexts["lo"][own] + inside]
        order = np.lexsort([*place[::-1], run])
        first = np.append(True, run[order][1:] != run[order][:-1])[: len(order)]
        self.repeat[at[order[~first]]] = True
        best = order[first]
        last = int(new.sum())
        if len(best) and run[best[0]] == 0 and self.best is not None:
            here = [int(p[best[0]]) for p in place], int(at[best[0]])
            here, later = (here, self.best) if here[0] < self.best[0] else (self.best, here)
            self.repeat[later[1]] = True
            if last == 0:
                self.best = here
                return
        goes_on = len(best) and run[best[-1]] == last
        self.best = ([int(p[best[-1]]) for p in place], int(at[best[-1]])) if goes_on else None


def repeated_windows(parts: Iterator[tuple[dict[str, np.ndarray], bytes]], scratch: Scratch) -> Iterator[list[dict]]:
    """A shard, given as contexts and their bytes: spans of windows that occurred earlier, as packed rows by file."""
    tapes = {k: Tape(scratch, kind) for k, kind in CONTEXT.items()}
    tape = Tape(scratch, np.uint8)
    for own, tail in parts:
        for k in CONTEXT:
            tapes[k].add(own[k])
        tape.add(np.frombuffer(tail, np.uint8))
    contexts, raw = {k: x.whole() for k, x in tapes.items()}, tape.whole()
    n = len(contexts["more"])
    if not n:
        return
    start = scratch.array(n + 1, np.int64)  # of each context in the text
    start[1:] = np.cumsum(contexts["more"].astype(np.int64) + LEAST + 1)
    t = padded(int(start[-1]), scratch)
    step = CHUNK // LEAST
    for i in range(0, n, step):
        j = min(n, i + step)
        size = np.diff(start[i : j + 1]) - 1
        text = raw[start[i] - i : start[j] - j].astype(np.uint16) + 1
        t[start[i] : start[j]] = np.insert(text, np.cumsum(size), 0)  # 0 ends a context
    repeat = scratch.array(len(t), np.bool_)
    firsts = _Firsts(start, contexts, repeat)
    for suffixes, common in descending(t, scratch):
        firsts.add(suffixes, common)
    for i in range(0, n, 16 * step):
        j = min(n, i + 16 * step)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], repeat[start[i] : start[j]].view(np.int8), [0]])))
        lo, hi = edge[::2] + start[i], edge[1::2] - 1 + start[i]
        own = np.searchsorted(start, lo, "right") - 1
        spans = {"row": contexts["row"][own], "lo": contexts["lo"][own] + lo - start[own], "more": hi - lo}
        yield _rows(SPANS, contexts["file"][own], spans, SPAN)


def _batches(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    yield from pa.Table.from_pylist(rows, _SCHEMA).to_batches()


def find_spans(spark: SparkSession, folder: str, paths: list[str]) -> DataFrame:
    """Rows ``target`` (a file's number), ``payload`` (packed spans of repeated windows in it)."""
    assert LEAST <= CAP
    shared = spark.sparkContext.broadcast(paths)
    where, name = fs.FileSystem.from_uri(folder)
    compressed = sum(f.size or 0 for f in where.get_file_info(fs.FileSelector(name)))
    tasks = partitions(spark)
    buckets = max(tasks, int(compressed * 2.5 / 35 / BUCKET_ANCHORS))
    where, name = fs.FileSystem.from_uri(work_folder(spark))
    scratch = name if isinstance(where, fs.LocalFileSystem) else None  # elsewhere files cannot be mapped
    hot = spark.sparkContext.broadcast(hot_grams(spark.read.parquet(folder)))  # 2**HOT_BITS bytes

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column("id").to_pylist():
                for found in file_anchors(shared.value[file], file, hot.value):
                    a, first = _first_of_each(found)
                    known = {k: a[k][~first] for k in SPAN}
                    rows = _rows(SPANS, np.full(len(known["lo"]), -1 - file), known, SPAN)
                    kept = {k: v[first] for k, v in a.items()}
                    order = np.lexsort([kept["lo"], kept["row"]])
                    kept = {k: v[order] for k, v in kept.items()}
                    rows += _rows(ANCHORS, (kept["gram"] % np.uint64(buckets)).astype(np.int64), kept, ANCHOR)
                    yield from _batches(rows)

    def compare(group: pa.Table) -> pa.Table:
        if group["kind"][0].as_py() == SPANS:  # on their way to their file
            return pa.Table.from_pylist([r | {"target": -1 - r["target"]} for r in group.to_pylist()], _SCHEMA)
        a, first = _first_of_each(joined(group["payload"], ANCHOR))
        rows = _rows(SPANS, a["file"][~first], {k: a[k][~first] for k in SPAN}, SPAN)
        a = {k: v[first] for k, v in a.items()}
        same = a["gram"][1:] == a["gram"][:-1]
        several = np.append(same, False) | np.append(False, same)
        a = {k: v[several] for k, v in a.items()}
        rows += _rows(WANTED, a["file"].astype(np.int64), a, ANCHOR, a["more"].astype(np.int64) + LEAST)
        return pa.Table.from_pylist(rows, _SCHEMA)

    # As many tasks as there is work for, not as few as these packed bytes ask for.
    found = spark.range(0, len(paths), 1, len(paths)).mapInArrow(collect, ROW).repartition(max(tasks, min(buckets, 4 * tasks)), "kind", "target")
    found = found.groupBy("kind", "target").applyInArrow(compare, ROW)
    path = new_path(spark, "repeats")
    found.write.parquet(path)
    found = spark.read.schema(ROW).parquet(path)
    wanted = found.filter(F.col("kind") == WANTED)
    shards = max(1, -(-int(wanted.agg(F.sum("n")).first()[0] or 0) // SHARD_BYTES))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches)
        a = joined(group["payload"], ANCHOR)
        order = np.lexsort([a["lo"], a["row"]])
        a = {k: v[order] for k, v in a.items()}
        shard = (mix(a["gram"]) % np.uint64(shards)).astype(np.int64)
        tails: list[bytes] = []
        done, size = 0, 0

        def rows() -> list[dict]:
            own = slice(done, done + len(tails))
            return _rows(ANCHORS, shard[own], {k: a[k][own] for k in CONTEXT}, CONTEXT, tails=tails)

        for first, _, texts in _texts(shared.value[group["target"][0].as_py()]):
            lo, hi = np.searchsorted(a["row"], [first, first + len(texts)])
            for row, at, more in zip(a["row"][lo:hi].tolist(), a["lo"][lo:hi].tolist(), a["more"][lo:hi].tolist(), strict=True):
                tails.append(texts[row - first][at : at + more + LEAST])
                size += more + LEAST
                if size > SEGMENT:
                    yield from _batches(rows())
                    done, tails, size = done + len(tails), [], 0
        yield from _batches(rows())

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scratch(scratch)
        for rows in repeated_windows((unpack(p.as_py(), CONTEXT) for b in batches for p in b.column("payload")), own):
            yield from _batches(rows)
        own.close()

    # The payloads are small beside the files that a task reads for them: as many tasks as files.
    fetched = wanted.repartition(len(paths), "target").groupBy("target").applyInArrow(fetch, ROW)
    sorted_out = fetched.repartition(max(tasks, min(shards, 4 * tasks)), "target").groupBy("target").applyInArrow(sort, ROW)
    return found.filter(F.col("kind") == SPANS).unionByName(sorted_out).select("target", "payload")


def removal(length: int, lo: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes under windows ``lo`` to ``lo + more``."""
    cover = np.zeros(length + 1, np.int32)
    np.add.at(cover, lo, 1)
    np.add.at(cover, lo + more.astype(np.int64) + LEAST, -1)
    inside = np.cumsum(cover[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _cut(docs: DataFrame, schema: str, make) -> DataFrame:
    """``make(batch of a file, removed spans of each of its rows)`` over all files, as rows of ``schema``."""
    spark = docs.sparkSession
    path = new_path(spark, "texts")
    docs.write.option("compression", "zstd").parquet(path)
    paths = sorted(spark.read.schema(docs.schema).parquet(path).inputFiles())
    if not paths:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(paths)
    files = spark.range(len(paths)).select(F.col("id").alias("target"), F.lit(None).cast("binary").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches)
        a = joined((p for p in group["payload"] if p.is_valid), SPAN)
        order = np.lexsort([a["lo"], a["row"]])
        a = {k: v[order] for k, v in a.items()}
        file = _open(shared.value[group["target"][0].as_py()])
        row = 0
        for batch in file.iter_batches(512):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            cut = np.searchsorted(a["row"], np.arange(row, row + len(texts) + 1))
            spans = [removal(len(t), a["lo"][i:j], a["more"][i:j]) for t, i, j in zip(texts, cut[:-1], cut[1:], strict=True)]
            yield from make(batch, texts, spans).to_batches()
            row += len(texts)

    return files.unionByName(find_spans(spark, path, paths)).repartition(len(paths), "target").groupBy("target").applyInArrow(run, schema)


def _kept(text: bytes, spans: tuple[np.ndarray, np.ndarray]) -> bytes:
    starts, ends = spans
    return b"".join(text[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(text)], strict=True)) if len(starts) else text


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each document."""

    def make(batch: pa.RecordBatch, texts: list[bytes], spans: list) -> pa.Table:
        return pa.table(
            {
                "doc_id": batch.column("doc_id"),
                "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "n_removed": pa.array([int((e - s).sum()) for s, e in spans], pa.int64()),
                "n_spans": pa.array([len(s) for s, _ in spans], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(_kept(t, s)).hexdigest() for t, s in zip(texts, spans, strict=True)], pa.string()),
            }
        )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _cut(docs, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", make)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeats cut out of ``text``; ``n_chars``, if it is there, follows.  Of a character cut
    in part the rest goes too."""
    schema = docs.schema

    def make(batch: pa.RecordBatch, texts: list[bytes], spans: list) -> pa.Table:
        table = pa.Table.from_batches([batch])
        if any(len(s) for s, _ in spans):
            old = batch.column("text").to_pylist()
            new = [_kept(t, s).decode(errors="ignore") if len(s[0]) else o for t, s, o in zip(texts, spans, old, strict=True)]
            table = table.set_column(table.schema.get_field_index("text"), "text", pa.array(new, pa.string()))
            at = table.schema.get_field_index("n_chars")
            if at >= 0:
                counts = batch.column("n_chars").to_pylist()
                counts = [len(n) if len(s[0]) else c for n, s, c in zip(new, spans, counts, strict=True)]
                table = table.set_column(at, "n_chars", pa.array(counts, table.schema.field(at).type))
        return table

    return _cut(docs, schema, make)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
