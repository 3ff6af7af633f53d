"""Document embeddings: made in batches by any embedder, stored with the state of their source, loaded while that holds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import versions

MAGIC, VERSION, BATCH = "lexiloom-embeddings", 1, 64


def embed(docs: DataFrame, model: Callable[[list[str]], np.ndarray], text: str = "text", batch: int = BATCH) -> DataFrame:
    """``doc_id, embedding`` of unit length; ``model`` takes a list of texts, ``batch`` at most, and returns a row each.

    A zero vector stays zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("_text").to_pylist()]
            for at in range(0, len(texts), batch):
                x = np.asarray(model(texts[at : at + batch]), np.float32)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.finfo(np.float32).tiny)
                ids = b.column("doc_id").slice(at, len(x))
                yield pa.RecordBatch.from_arrays([ids, pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "embedding"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("_text")).mapInArrow(run, f"doc_id {kind}, embedding array<float>")


def save(embeddings: DataFrame, path: str, source: str = "", model: str = "") -> None:
    """A new version, published when it is whole."""
    folder = uuid.uuid4().hex
    embeddings.select("doc_id", "embedding").write.parquet(f"{path}/{folder}")
    spark = embeddings.sparkSession
    versions.publish(spark, path, MAGIC, VERSION, folder, model, spark.read.parquet(f"{path}/{folder}").count(), source)


def load(spark: SparkSession, path: str, source: str | None = None, model: str | None = None) -> DataFrame | None:
    """The newest version, or None where there is none or it is of another source or model."""
    try:
        found = versions.newest(spark, path, MAGIC, VERSION, source)
    except versions.Stale:
        return None
    return spark.read.parquet(f"{path}/{found['folder']}") if model in (None, found["details"]) else None
