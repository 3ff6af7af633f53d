"""What the vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(column: str = "embedding"):
    """Whether a vector takes part: not null, not zero, all its components finite numbers."""
    e = F.col(column)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(e, lambda x: x != 0), F.lit(False))


def usual_length(vectors: DataFrame) -> int:
    """The most frequent length, the longest of equals; 0 without rows.  Vectors of another length have no measure with these."""
    top = vectors.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return top[0]["n"] if top else 0


def matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    """Rows of an array column of equal lengths, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)


SALTS = 16


def with_hash(vectors: DataFrame) -> DataFrame:
    """``h`` and ``g``: 128 bits that stand for a vector where equal ones are grouped or joined, so that vectors are not sorted."""
    return vectors.withColumn("h", F.xxhash64("embedding")).withColumn("g", F.xxhash64(F.lit(1), "embedding"))


def salt(column: str):
    return F.pmod(F.xxhash64(F.col(column), F.lit(7)), F.lit(SALTS)).cast("int")


def salts(often, one: str):
    """The salts that a class needs: all if it has several rows, and else that of its one row, so a frequent vector is no hot key."""
    return F.explode(F.when(often > 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(salt(one))))


def sample(vectors: DataFrame, size: int, total: int) -> np.ndarray:
    """About ``size`` vectors, chosen by a hash of the id, in the order of ids."""
    chance = (F.xxhash64("vec_id") % F.lit(1 << 30) + F.lit(1 << 30)) / F.lit(float(1 << 31))
    rows = vectors.filter(chance < min(1.0, size / max(1, total))).select("vec_id", "embedding").toArrow().sort_by("vec_id")
    if not rows.num_rows:  # a table of few rows may miss them all
        rows = vectors.select("vec_id", "embedding").limit(size).toArrow().sort_by("vec_id")
    n = len(rows["embedding"][0])
    return matrix(rows["embedding"], n)
