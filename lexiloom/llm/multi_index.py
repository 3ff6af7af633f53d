"""Embedding near-duplicates by an inverted multi-index.

Vectors are brought to unit length and cut in halves.  Two codebooks, one for each half, are fitted by
k-means on a bounded sample; their product is a grid of cells, and each vector lies in the cell of its
nearest centroids.  A vector visits cells by the multi-sequence traversal, in the order of the summed
squared *excess*, the distance to a cell's centroid beyond that to the nearest one, until the excess
passes a reach.  Codebooks grow with the table: they are doubled as long as that saves more comparisons than it
takes copies to further cells, both counted on the sample.  The reach is set for ``TARGET`` recall at the limit: on pairs drawn from the sample
whose cosine is exactly the threshold, the partner's cell is within it.  Closer pairs have less excess.

In each cell, residents meet residents and visitors, of one label, in blocks of bounded size; cosines
are confirmed in double precision.  A pair that two cells could see is counted in one only.  Tasks return
link counts and links that join components, so output is linear in the rows.  Equal vectors of a label
are one class with a count, as their links are the same; classes are joined by a salted hash, so that a
frequent vector is no hot key.

Defined cases: null, zero and not finite vectors, other lengths than the most frequent, null labels: no
links, a component of its own; rows without an id are not returned; repeated rows are vectors of their
own; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .components import components
from .minhash import _Joined
from .vectors import matrix, salt, salts, sample, usable, usual_length, with_hash

COSINE, CENTROIDS, MOST_CENTROIDS, SAMPLE, ROUNDS, TARGET, BLOCK, SEED = 0.98, 24, 1536, 20_000, 12, 0.9995, 8192, 5
#: What a copy of a vector to one more cell costs, in comparisons of two vectors.
COPY = 200


def codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids by Lloyd's iterations; empty ones stay where they are."""
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = ((centre**2).sum(1) - 2 * x @ centre.T).argmin(1)
        for i in np.unique(near):
            centre[i] = x[near == i].mean(0)
    return centre


@dataclass
class MultiIndex:
    halves: tuple[np.ndarray, np.ndarray]
    reach: float = 0.0

    def excess(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared excess of each vector to each centroid of either half."""
        cut, out = self.halves[0].shape[1], []
        for part, centre in zip((x[:, :cut], x[:, cut:]), self.halves, strict=True):
            d = np.sqrt(np.maximum(0, (part**2).sum(1)[:, None] - 2 * part @ centre.T + (centre**2).sum(1)))
            out.append((d - d.min(1, keepdims=True)) ** 2)
        return out[0], out[1]

    def cells(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return one.argmin(1) * len(self.halves[1]) + two.argmin(1)

    def visit(self, one: np.ndarray, two: np.ndarray) -> list[int]:
        """Cells of one vector in ascending excess, by the multi-sequence traversal, within the reach."""
        a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
        queue, seen, found = [(0.0, 0, 0)], {(0, 0)}, []
        while queue and queue[0][0] <= self.reach:
            _, i, j = heapq.heappop(queue)
            found.append(int(a[i]) * len(two) + int(b[j]))
            for i, j in ((i + 1, j), (i, j + 1)):
                if i < len(a) and j < len(b) and (i, j) not in seen:
                    seen.add((i, j))
                    heapq.heappush(queue, (float(one[a[i]] + two[b[j]]), i, j))
        return found


def fit(x: np.ndarray, cosine: float = COSINE, k: int = CENTROIDS, target: float = TARGET) -> MultiIndex:
    """Codebooks of a sample of unit vectors, and the reach for pairs just at the threshold."""
    rng = np.random.default_rng(SEED)
    cut = max(1, x.shape[1] // 2)
    index = MultiIndex((codebook(x[:, :cut], k, rng), codebook(x[:, cut:], k, rng)))
    a = x[rng.integers(0, len(x), 20_000)]
    side = rng.standard_normal(a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
    b = cosine * a + np.sqrt(1 - cosine**2) * side
    one, two = index.excess(a)
    other = index.cells(*index.excess(b))
    rows, n = np.arange(len(a)), len(index.halves[1])
    index.reach = float(np.quantile(one[rows, other // n] + two[rows, other % n], target)) + 1e-12
    return index


def fit_for(x: np.ndarray, total: int, cosine: float = COSINE) -> MultiIndex:
    """The index of the least estimated cost for ``total`` rows; codebooks stay within the sample's means."""
    k, best = CENTROIDS, fit(x, cosine)
    few = x[:300]

    def cost(index: MultiIndex) -> tuple[float, float]:
        visits = float(np.mean([len(index.visit(a, b)) for a, b in zip(*index.excess(few), strict=True)]))
        return visits * COPY, visits * total / (len(index.halves[0]) * len(index.halves[1]))

    least = cost(best)
    while 2 * k <= min(MOST_CENTROIDS, len(x) // 8) and least[1] > least[0]:  # more cells never take fewer copies
        k *= 2
        finer = fit(x, cosine, k)
        if sum(own := cost(finer)) >= sum(least):
            break
        best, least = finer, own
    return best


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each vector with an id."""
    spark = vectors.sparkSession
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    every = every.filter("vec_id IS NOT NULL")
    part = every.filter(usable() & F.col("label").isNotNull())
    n = usual_length(part)
    part = with_hash(part.filter(F.size("embedding") == max(n, 1)))
    classes = part.groupBy("label", "h", "g").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.min_by("embedding", "vec_id").alias("embedding"))
    classes = materialize(classes, "vector-classes")
    total = classes.count()
    if not total:
        alone = every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
        return alone
    x = sample(classes, SAMPLE, total)
    index = spark.sparkContext.broadcast(fit_for(x / np.linalg.norm(x, axis=1, keepdims=True), total, cosine))  # bounded by MOST_CENTROIDS

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column("embedding"), n)
            one, two = index.value.excess(v / np.linalg.norm(v, axis=1, keepdims=True))
            home = index.value.cells(one, two).tolist()
            rows, cells = [], []
            for r in range(len(v)):
                seen = index.value.visit(one[r], two[r])
                cells += seen
                rows += [r] * len(seen)
            took = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [took.column(c) for c in ("label", "vec_id", "copies", "embedding")] + [pa.array([home[r] for r in rows], pa.int32()), pa.array(cells, pa.int32())],
                ["label", "vec_id", "copies", "embedding", "home", "cell"],
            )

    label = classes.schema["label"].dataType.simpleString()
    spread = classes.mapInArrow(deal, f"label {label}, vec_id long, copies long, embedding array<double>, home int, cell int")
    spread = materialize(spread, "cells")
    sizes = spread.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))
    placed = spread.join(sizes, ["label", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), "n_blocks").cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def meet(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        ids, home, cell = rows["vec_id"].to_numpy(), rows["home"].to_numpy(), rows["cell"][0].as_py()
        block, copies, v = rows["block"].to_numpy(), rows["copies"].to_numpy(), matrix(rows["embedding"], n)
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        one, two = index.value.excess(unit)
        width = two.shape[1]
        links = np.zeros(len(ids), np.int64)
        joined, joins = _Joined(len(ids)), []
        residents = np.flatnonzero(home == cell)
        two_blocks = rows["low"][0] != rows["high"][0]
        for at in range(0, len(residents), 512):
            own = residents[at : at + 512]
            i, j = np.nonzero(unit[own] @ unit.T >= cosine - 1e-9)
            i = own[i]
            keep = i != j
            keep &= (home[j] != cell) | (i < j)  # two residents meet once
            if two_blocks:
                keep &= block[i] != block[j]
            i, j = i[keep], j[keep]
            # A visitor from a lower cell is counted there if the resident visits it.
            seen_there = one[i, home[j] // width] + two[i, home[j] % width] <= index.value.reach
            keep = ~((home[j] < cell) & seen_there)
            i, j = i[keep], j[keep]
            keep = (v[i] * v[j]).sum(1) >= cosine * (np.linalg.norm(v[i], axis=1) * np.linalg.norm(v[j], axis=1))
            i, j = i[keep], j[keep]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                if joined.join(p, q):
                    joins.append((p, q))
        some = np.flatnonzero(links)
        a = np.concatenate([ids[some], ids[[p for p, _ in joins]]]) if len(some) else np.empty(0, np.int64)
        return pa.table(
            {
                "a": pa.array(a, pa.int64()),
                "b": pa.array([None] * len(some) + [int(ids[q]) for _, q in joins], pa.int64()),
                "n_links": pa.array(links[some].tolist() + [0] * len(joins), pa.int64()),
            }
        )

    met = dealt.select("label", "cell", "low", "high", "block", "vec_id", "copies", "embedding", "home")
    met = materialize(met.groupBy("label", "cell", "low", "high").applyInArrow(meet, "a long, b long, n_links long"), "vector-links")
    counts = met.groupBy(F.col("a").alias("class_id")).agg(F.sum("n_links").alias("linked"))
    joined = components(met.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("id", "class_id")
    found = classes.withColumnRenamed("vec_id", "class_id").join(counts, "class_id", "left").join(joined, "class_id", "left")
    found = found.select(
        "label", "h", "g", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "class_id").alias("component"), salts(F.col("copies"), "class_id").alias("salt")
    )
    keyed = with_hash(every).select("vec_id", F.when(usable() & F.col("label").isNotNull() & (F.size("embedding") == max(n, 1)), salt("vec_id")).alias("salt"), "label", "h", "g")
    out = keyed.join(found, ["label", "h", "g", "salt"], "left").withColumn("component_id", F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
