"""Token ids as flat binary files with 64-bit document offsets.

Documents are dealt to shards by ranges of ``doc_id``, and of a hash of the text so that a much repeated id is
spread too, and sorted within them.  A shard is
``<name>.bin`` (ids one after another, unsigned, 16 bits wide where the vocabulary fits and else
32), ``<name>.idx`` (signed 64-bit starts within the shard, one more than documents) and
``<name>.ids`` (64-bit document ids, each with a further 64-bit word that is 1 where the id is null).  A shard's base, the ids in all shards before it, is a prefix
sum over shards kept in the manifest; ``base + idx`` is a document's place in the whole sequence.

A task writes under names of its own and returns them; only names in the manifest count, so tasks
that are run again or twice do no harm.  Files go to the shared folder, by ``pyarrow.fs`` where that
is not a mounted one; mounted files are memory-mapped when read.

Defined cases: a null or empty text is the end id alone; a null ``doc_id`` sorts first and is read back as
null; repeated rows are written each, ties of ``doc_id`` in the order of their texts' hashes, then texts; a long text is
encoded whole; an empty table gives no shards and no rows; other columns are not looked at.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, new_path, partitions, table
from .wordbpe import WORD_BPE, encoder

END_ID = 2
SHARDS = "shard int, name string, dtype string, n_docs long, n_ids long"


def _create(folder: str, name: str):
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    return where.open_output_stream(f"{path}/{name}")


def write(docs: DataFrame, folder: str, end_id: int = END_ID, tokenizer: str = WORD_BPE, shards: int | None = None) -> DataFrame:
    """Write the shards; the manifest: a row a shard, with its base, in the order of doc_id."""
    spark = docs.sparkSession
    tie = documents(docs).withColumn("tie", F.xxhash64("text"))
    dealt = tie.repartitionByRange(shards or partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        name, sizes, ids, end = "", [], [], None
        out = None
        for batch in batches:
            if out is None:
                name = f"{shard:06d}-{uuid.uuid4().hex}"
                out, end = _create(folder, f"{name}.bin"), np.array([end_id], enc.dtype).tobytes()
            own = batch.column("doc_id")
            ids.append(np.stack([own.fill_null(0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False)], 1).astype("<i8"))
            for text in batch.column("text"):
                tokens = enc.encode(text.as_py())
                out.write(tokens.tobytes() + end)
                sizes.append(len(tokens) + 1)
        if out is None:
            return
        out.close()
        at = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
        for kind, data in (("idx", at), ("ids", np.concatenate(ids))):
            with _create(folder, f"{name}.{kind}") as f:
                f.write(data.tobytes())
        yield pa.RecordBatch.from_pylist(
            [{"shard": shard, "name": name, "dtype": enc.dtype.str, "n_docs": len(sizes), "n_ids": int(at[-1])}],
            pa.schema([("shard", pa.int32()), ("name", pa.string()), ("dtype", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
        )

    manifest = materialize(dealt.mapInArrow(put, SHARDS), "manifest")  # written once: a second pass would write other files
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _map(folder: str, name: str, dtype: str) -> np.ndarray:
    where, path = fs.FileSystem.from_uri(folder)
    path = f"{path}/{name}"
    if isinstance(where, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if where.get_file_info(path).size else np.empty(0, dtype)
    with where.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = _map(folder, f"{row['name']}.bin", row["dtype"])
                at, docs = _map(folder, f"{row['name']}.idx", "<i8"), _map(folder, f"{row['name']}.ids", "<i8").reshape(-1, 2)
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[:, 0], mask=docs[:, 1] == 1), pa.array(at[:-1] + row["base"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return manifest.repartition(partitions(manifest.sparkSession)).mapInArrow(get, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    return read(write(table(spark, sf_dir, "documents"), folder), folder)
