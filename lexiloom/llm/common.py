"""What the training-data operators share: reading, cutting lineage, document text.

Intermediate results that are used more than once are written as Parquet under the shared
folder named in ``spark.checkpoint.dir``.  All executors see that folder, so a lost executor
costs a reread and not a rerun of the lineage.  They go when nothing reads them any more, at the latest with the application.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.session import delete, work_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.lexiloom_path = path
    return out


def release(*written: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more."""
    for df in written:
        delete(df.sparkSession, df.lexiloom_path)


def documents(df: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, null texts as empty; other columns cannot clash."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(column: str, buckets: int):
    """``crc32`` of the id as text, modulo ``buckets``: the contract's train and held-out folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(buckets)
