"""Connected components by random contraction, distributed throughout.

Each round every vertex points at the lowest vertex, in an order drawn anew, among itself and its
neighbours; pointers are followed once more; edges are put on what they lead to, and loops and
repeats go.  The number of vertices with edges falls by a constant factor a round whatever the
graph's diameter or degrees, and minima are taken before the shuffle, so a hub is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` for each id of ``edges`` (``a, b``), the component being its smallest id."""
    edges = materialize(
        edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    labels, turn = None, 0
    while not edges.isEmpty():
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        ways = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = ways.groupBy("a").agg(F.min(rank("b")).alias("low"))
        first = materialize(low.select("a", F.least(rank("a"), "low")["v"].alias("to")), "points")
        far = first.select(F.col("a").alias("to"), F.col("to").alias("far"))
        points = materialize(first.join(far, "to").select("a", F.col("far").alias("to")), "points")
        old, before = labels, edges
        if labels is None:
            labels = points.select(F.col("a").alias("id"), F.col("to").alias("root"))
        else:
            labels = labels.join(points.withColumnRenamed("a", "root"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
        labels = materialize(labels, "labels")
        ends = points.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(points, "a").join(ends, "b").filter("`to` <> tb")
        edges = materialize(moved.select(F.least("to", "tb").alias("a"), F.greatest("to", "tb").alias("b")).distinct(), "edges")
        release(first, points, before, *([old] if old is not None else []))
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    least = labels.groupBy("root").agg(F.min("id").alias("component"))
    return labels.join(least, "root").select("id", "component")
