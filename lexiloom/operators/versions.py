"""Versions of stored tables: a folder for each, which counts from when its line is in the manifest."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

MANIFEST = "magic string, version int, folder string, details string, n_rows long, source string, saved_at long"


class Stale(ValueError):
    """Nothing stored, something of another kind or version, or of another state of its source."""


def publish(spark: SparkSession, path: str, magic: str, version: int, folder: str, details: str = "", n_rows: int = 0, source: str = "") -> None:
    """Add a line to the manifest, after everything in the folder is written."""
    row = (magic, version, folder, details, n_rows, source, time.time_ns())
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """All lines of the manifest; None where there is none."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifest")
    except Exception as e:  # only a path that isn't there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def newest(spark: SparkSession, path: str, magic: str, version: int, source: str | None = None) -> Row:
    """The newest line; with ``source`` it must be of that state of the source."""
    lines = published(spark, path)
    found = lines.orderBy(F.desc("saved_at")).limit(1).collect() if lines is not None else []
    if not found or (found[0]["magic"], found[0]["version"]) != (magic, version):
        raise Stale(f"no {magic} of version {version} at {path}")
    if source is not None and found[0]["source"] != source:
        raise Stale(f"the {magic} at {path} is of {found[0]['source']!r}, not of {source!r}")
    return found[0]


def source_state(table: DataFrame) -> str:
    """What changes when a table of files does: the newest time, the number and the size of its files."""
    files = table.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    got = files.agg(F.max("file_modification_time").alias("t"), F.count("*").alias("n"), F.sum("file_size").alias("s")).first()
    return f"{got['t']} {got['n']} {got['s']}"
