"""Data sources for SQLite tables and for the binary index, and the index's writer."""

from __future__ import annotations

import os
import shutil
import sqlite3
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexiloom.functions.codec import Reader, varint

#: Fixed values of the file format: its mark, its version, its sections in order.
MAGIC, VERSION = b"MYENGINE", 2
SECTIONS = ("stats", "postings", "positions", "doc_lengths", "dictionary", "urls", "pageranks")


class _RowRange(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SQLiteSource(DataSource):
    """``spark.read.format("sqlite_table").schema(...).option("path", ...).option("table", ...)``.

    The file is opened read-only; ranges of rowid are the partitions; only the schema's columns are read."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        raise ValueError("give a schema")

    def reader(self, schema):
        options, columns = dict(self.options), schema.names

        class Rows(DataSourceReader):
            def connect(self):
                return sqlite3.connect(f"file:{options['path']}?mode=ro", uri=True)

            def partitions(self):
                with self.connect() as c:
                    low, high = c.execute(f'SELECT coalesce(min(rowid), 1), coalesce(max(rowid), 0) FROM "{options["table"]}"').fetchone()
                n = int(options.get("partitions", 8))
                step = max(1, -(-(high - low + 1) // n))
                return [_RowRange(i, min(i + step, high + 1)) for i in range(low, high + 1, step)] or [_RowRange(0, 0)]

            def read(self, partition) -> Iterator[tuple]:
                names = ", ".join(f'"{c}"' for c in columns)
                with self.connect() as c:
                    yield from c.execute(f'SELECT {names} FROM "{options["table"]}" WHERE rowid >= ? AND rowid < ?', (partition.low, partition.high))

        return Rows()


def read_index(data: bytes) -> dict:
    """All sections of a binary index: ``n_docs, avgdl, postings, doc_lengths, urls, pageranks``.

    Positions are stored as gaps, in the order of the dictionary and within a term of its postings."""
    r = Reader(data)
    if r.take(8) != MAGIC:
        raise ValueError("not an index file")
    if (version := r.fixed("I")) != VERSION:
        raise ValueError(f"index version {version} is not supported")
    at = dict(zip(SECTIONS, [r.fixed("Q") for _ in SECTIONS], strict=True))

    def section(name: str) -> tuple[Reader, int]:
        s = Reader(data, at[name])
        return s, s.fixed("Q")

    s = Reader(data, at["stats"])
    out = {"avgdl": s.fixed("d"), "n_docs": s.fixed("Q")}
    s, n = section("postings")
    pool = [(s.varint(), s.varint(), s.varint()) for _ in range(n)]
    s, n = section("doc_lengths")
    out["doc_lengths"] = {s.fixed("i"): s.fixed("I") for _ in range(n)}
    s, n = section("urls")
    out["urls"] = {s.fixed("i"): s.string() for _ in range(n)}
    s, n = section("pageranks")
    out["pageranks"] = {s.fixed("i"): s.fixed("f") for _ in range(n)}
    words, n = section("dictionary")
    gaps, _ = section("positions")
    out["postings"] = []
    for _ in range(n):
        term, start, count = words.string(), words.fixed("I"), words.fixed("I")
        for doc, tf, _ in pool[start : start + count]:
            positions, last = [], 0
            for _ in range(tf):
                last += gaps.varint()
                positions.append(last)
            out["postings"].append((term, doc, tf, positions))
    return out


class BinaryIndexSource(DataSource):
    """``spark.read.format("binary_index").option("path", ...).option("section", "postings")``."""

    SCHEMAS = {
        "postings": "term string, doc_id int, tf int, positions array<int>",
        "doc_lengths": "doc_id int, dl int",
        "urls": "doc_id int, url string",
        "pageranks": "doc_id int, pagerank float",
        "stats": "n_docs long, avgdl double",
    }

    @classmethod
    def name(cls) -> str:
        return "binary_index"

    def schema(self) -> str:
        return self.SCHEMAS[self.options.get("section", "postings")]

    def reader(self, schema):
        options = dict(self.options)

        class Section(DataSourceReader):
            def read(self, partition) -> Iterator[tuple]:
                with open(options["path"], "rb") as f:
                    index = read_index(f.read())
                name = options.get("section", "postings")
                if name == "stats":
                    yield index["n_docs"], index["avgdl"]
                elif name == "postings":
                    yield from index["postings"]
                else:
                    yield from index[name].items()

        return Section()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SQLiteSource)
    spark.dataSource.register(BinaryIndexSource)


class _Section:
    """A section of the file while it is written, in a file of its own beside it: a count, then entries."""

    def __init__(self, path: str, counted: bool = True):
        self.path, self.n, self.counted = path, 0, counted
        self.file = open(path, "wb")  # noqa: SIM115

    def add(self, entry: bytes) -> None:
        self.file.write(entry)
        self.n += 1

    def close(self) -> int:
        """Its size in the index file."""
        self.file.close()
        return os.path.getsize(self.path) + 8 * self.counted

    def copy_to(self, out) -> None:
        if self.counted:
            out.write(struct.pack("<Q", self.n))
        with open(self.path, "rb") as f:
            shutil.copyfileobj(f, out)
        os.unlink(self.path)


def write_index(path: str, posted: DataFrame, docs: DataFrame) -> None:
    """Write the binary index of ``term, doc_id, positions`` and ``doc_id, dl, url, pagerank``.

    One file in byte order of terms needs one writer: rows come to the driver in that order, a partition
    at a time, and go to their sections' files at once, which are then put together; the index file appears
    when it is whole.  Only this interchange format is made so; the engine's own index is Parquet."""
    parts = {name: _Section(f"{path}.{name}", name != "stats") for name in SECTIONS}
    text = lambda s: struct.pack("<Q", len(s.encode())) + s.encode()
    start, last, at = 0, None, 0

    def close() -> None:
        if last is not None:
            parts["dictionary"].add(text(last) + struct.pack("<II", start, parts["postings"].n - start))

    for row in posted.select("term", "doc_id", "positions").orderBy("term", "doc_id").toLocalIterator():
        if row.term != last:
            close()
            last, start = row.term, parts["postings"].n
        parts["postings"].add(varint(row.doc_id) + varint(len(row.positions)) + varint(at))
        for p, q in zip(row.positions, [0, *row.positions]):
            parts["positions"].add(varint(p - q))
        at += len(row.positions)
    close()
    total = 0
    for r in docs.select("doc_id", "dl", "url", "pagerank").orderBy("doc_id").toLocalIterator():
        total += r.dl
        parts["doc_lengths"].add(struct.pack("<iI", r.doc_id, r.dl))
        parts["urls"].add(struct.pack("<i", r.doc_id) + text(r.url))
        parts["pageranks"].add(struct.pack("<if", r.doc_id, r.pagerank))
    n = parts["doc_lengths"].n
    parts["stats"].add(struct.pack("<dQ", total / n if n else 0.0, n))
    offset, offsets = 8 + 4 + 8 * len(SECTIONS), []
    for name in SECTIONS:
        offsets.append(offset)
        offset += parts[name].close()
    with open(f"{path}.whole", "wb") as f:
        f.write(MAGIC + struct.pack("<I", VERSION) + struct.pack(f"<{len(offsets)}Q", *offsets))
        for name in SECTIONS:
            parts[name].copy_to(f)
    os.replace(f"{path}.whole", path)
