"""Approximate nearest neighbours: a forest of random-projection trees under one priority queue.

Each tree splits a bounded sample at the median of a projection on the difference of two of its
vectors, down to leaves.  A query descends all trees through one queue, the branches in the order of
the largest margin by which they were missed, and visits leaves until these hold a set share of all
rows; then all candidates in them are ranked by the exact inner product in double precision.  The
share is set on the sample: the least at which the sample's own nearest are found to ``TARGET``.
In a table larger than the sample neighbours lie closer, so the same share finds no fewer of them.

All rows are indexed.  Of equal vectors the ``k + 1`` smallest ids are kept, as ties go to smaller
ids: no others can be among a query's nearest; equal queries are searched once.  A tree has ``LEAVES``
leaves at most, so a query goes to a bounded number of them; leaves of more than ``BLOCK_BYTES`` are cut.
A task holds the vectors of one leaf, or part of one, while its queries stream past; of each query it
returns the best, with all that tie with the last.

The queries' work grows with rows times queries at a set share; where vectors have structure, the share is small.

Defined cases: null, zero and not finite vectors, and those of another length than the most frequent,
take no part; nor do rows without an id; repeated ids are candidates of their own, but a query never finds
its own id, and a repeated query has the nearest of all its vectors; ties of score go to the smaller id,
whether the vectors are equal or not; an empty table, or one without usable queries, gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, table
from .vectors import matrix, salt, salts, sample, usable, usual_length, with_hash

K, TREES, LEAF, LEAVES, BLOCK_BYTES, SAMPLE, TARGET, SEED = 20, 4, 1024, 256, 32 << 20, 20_000, 0.96, 11
SCORES = 1 << 22  # in a block of queries times rows
SHARES = (0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0)
LEAST_IN_LEAF = 16


@dataclass
class Tree:
    """Inner nodes as arrays; a negative child ``-1 - i`` is leaf ``i``."""

    normal: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    above: np.ndarray
    weight: np.ndarray  # of leaves: their share of the sample

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.cut) else np.full(len(x), -1)
        while (inner := at >= 0).any():
            node = at[inner]
            margin = np.einsum("ij,ij->i", x[inner], self.normal[node]) - self.cut[node]
            at[inner] = np.where(margin < 0, self.below[node], self.above[node])
        return -1 - at


def grow(x: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    normal, cut, below, above, weight = [], [], [], [], []

    def split(rows: np.ndarray) -> int:
        if len(rows) > leaf:
            for _ in range(4):
                a, b = x[rng.choice(rows, 2, replace=False)]
                if not (size := np.linalg.norm(a - b)):
                    continue
                p = x[rows] @ ((a - b) / size)
                if 0 < (low := p < np.median(p)).sum() < len(rows):
                    node = len(cut)
                    normal.append((a - b) / size)
                    cut.append(float(np.median(p)))
                    below.append(0)
                    above.append(0)
                    below[node], above[node] = split(rows[low]), split(rows[~low])
                    return node
        weight.append(len(rows) / len(x))
        return -len(weight)

    split(np.arange(len(x)))
    return Tree(np.array(normal).reshape(-1, x.shape[1]), np.array(cut), np.array(below, np.int64), np.array(above, np.int64), np.array(weight))


@dataclass
class Forest:
    trees: list[Tree]
    share: float = 1.0

    def visit(self, q: np.ndarray, share: float | None = None) -> list[tuple[int, int]]:
        """Leaves ``(tree, leaf)`` in the order of the shared queue, until they hold the share of the sample."""
        share = self.share if share is None else share
        margins = [t.normal @ q - t.cut for t in self.trees]
        queue: list[tuple[float, int, int]] = [(0.0, i, 0 if len(t.cut) else -1) for i, t in enumerate(self.trees)]
        found, held = [], 0.0
        while queue and held < share:
            missed, i, node = heapq.heappop(queue)
            tree, margin = self.trees[i], margins[i]
            while node >= 0:
                m = float(margin[node])
                near, far = (tree.below[node], tree.above[node]) if m < 0 else (tree.above[node], tree.below[node])
                heapq.heappush(queue, (max(missed, abs(m)), i, int(far)))
                node = int(near)
            found.append((i, -1 - node))
            held += tree.weight[-1 - node]
        return found


def fit(x: np.ndarray, total: int, k: int = K, trees: int = TREES, target: float = TARGET) -> Forest:
    """The forest of a sample for ``total`` rows, with the share that finds the sample's own nearest."""
    rng = np.random.default_rng(SEED)
    leaf = max(LEAST_IN_LEAF, int(LEAF * len(x) / max(total, 1)), len(x) // LEAVES)
    forest = Forest([grow(x, leaf, rng) for _ in range(trees)], float(trees))
    own = rng.choice(len(x), min(150, len(x)), replace=False)
    if len(x) <= k + 1:
        return forest
    scores = x[own] @ x.T
    scores[np.arange(len(own)), own] = -np.inf
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    where = [t.leaves(x) for t in forest.trees]
    for share in [s for s in SHARES if s < trees]:
        right = 0
        for row, q in zip(best, own, strict=True):
            seen = np.zeros(k, bool)
            for i, at in forest.visit(x[q], share):
                seen |= where[i][row] == at
            right += seen.sum()
        if right >= target * best.size:
            forest.share = share
            break
    return forest


def best_of(q: np.ndarray, x: np.ndarray, ids: pa.ListArray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the ``most`` best pairs with rows of ``x``, each of which has one or more ids: places in ``q``, scores, ids."""
    flat, ends = ids.flatten().to_numpy(), np.append(0, np.cumsum(ids.value_lengths().to_numpy()))
    owners, scores, found = [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0, np.int64)]
    rounding = 1e-12 * np.linalg.norm(x, axis=1).max() * x.shape[1]
    kth = len(x) - min(most, len(x))
    step = max(1, SCORES // len(x))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        near = part @ x.T
        least = np.partition(near, kth, axis=1)[:, kth] - rounding * np.linalg.norm(part, axis=1)
        r, c = np.nonzero(near >= least[:, None])  # all that may tie with the last one
        exact = np.concatenate([(x[c[i : i + 100_000]] * part[r[i : i + 100_000]]).sum(1) for i in range(0, len(r), 100_000)])  # the same sum for a pair wherever it meets
        often = ends[c + 1] - ends[c]
        place = np.repeat(ends[c] - np.append(0, np.cumsum(often)[:-1]), often) + np.arange(often.sum())
        r, exact, own = np.repeat(r, often), np.repeat(exact, often), flat[place]
        order = np.lexsort((own, -exact, r))
        r = r[order]
        first = np.searchsorted(r, r)  # of each query's pairs
        kept = np.arange(len(r)) - first < most
        owners.append(r[kept] + at)
        scores.append(exact[order][kept])
        found.append(own[order][kept])
    return np.concatenate(owners), np.concatenate(scores), np.concatenate(found)


def nearest(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows of ``vec_id, embedding`` for which ``is_query`` holds."""
    out = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    part = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    part = part.filter(F.col("vec_id").isNotNull() & usable())
    n = usual_length(part)
    if not n:
        return spark.createDataFrame([], out)
    part = with_hash(part.filter(F.size("embedding") == n))
    asked = part.filter(is_query).select(F.col("vec_id").alias("query_id"), "h", "g")
    # Of equal vectors, the k + 1 smallest ids; the limit is applied before the shuffle too.
    order = Window.partitionBy("h", "g").orderBy("vec_id")
    first = part.withColumn("nth", F.dense_rank().over(order)).filter(F.col("nth") <= k + 1)
    rows = first.groupBy("h", "g").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.min_by("embedding", "vec_id").alias("embedding"))
    rows = materialize(rows.withColumn("vec_id", F.col("ids")[0]), "distinct-vectors")
    total = rows.count()
    forest = fit(sample(rows, SAMPLE, total), total, k)
    parts = [np.maximum(1, np.ceil(t.weight * total * n * 8 / BLOCK_BYTES)).astype(np.int64) for t in forest.trees]
    shared = spark.sparkContext.broadcast(forest)  # bounded by SAMPLE, whatever the table's size
    cell = lambda tree, leaf, part: (tree << 56) | (leaf << 32) | part
    columns = ["cell", "query", "h", "g", "ids", "embedding"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ids = matrix(b.column("embedding"), n), b.column("vec_id").to_numpy()
            for i, tree in enumerate(shared.value.trees):
                leaf = tree.leaves(x)
                own = pa.array(cell(i, leaf, ids % parts[i][leaf]))
                yield pa.RecordBatch.from_arrays([own, pa.array(np.zeros(len(ids), bool)), *(b.column(c) for c in columns[2:])], columns)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, cells, taken = matrix(b.column("embedding"), n), [], []
            for r in range(len(x)):
                for i, leaf in shared.value.visit(x[r]):
                    cells += [cell(i, leaf, p) for p in range(parts[i][leaf])]
                taken += [r] * (len(cells) - len(taken))
            took = b.take(pa.array(taken, pa.int64()))
            none = pa.nulls(len(taken), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(np.ones(len(taken), bool)), took.column("h"), took.column("g"), none, took.column("embedding")], columns)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a cell, then its queries: a cell's rows are held while its queries pass."""
        now, x, held = None, [], []
        for b in batches:
            cells, query = b.column("cell").to_numpy(), b.column("query").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(cells) != 0) | (query[1:] != query[:-1])) + 1
            for i, j in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                own = b.slice(i, j - i)
                if not len(own):
                    continue
                if cells[i] != now:
                    now, x, held = cells[i], [], []
                if not query[i]:
                    x.append(matrix(own.column("embedding"), n))
                    held.append(own.column("ids"))
                elif x:
                    if len(x) > 1:
                        x, held = [np.concatenate(x)], [pa.concat_arrays(held)]
                    r, scores, ids = best_of(matrix(own.column("embedding"), n), x[0], held[0], k + 1)
                    pairs = pa.StructArray.from_arrays([pa.array(-scores), pa.array(ids)], ["s", "v"])
                    ends = pa.array(np.searchsorted(r, np.arange(len(own) + 1)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([own.column("h"), own.column("g"), pa.ListArray.from_arrays(ends, pairs)], ["h", "g", "best"])

    schema = "cell long, query boolean, h long, g long, ids array<long>, embedding array<double>"
    searched = asked.groupBy("h", "g").agg(F.count("*").alias("often"), F.min("query_id").alias("query_id"))
    together = rows.mapInArrow(index, schema).unionByName(rows.join(searched, ["h", "g"], "left_semi").select(rows.columns).mapInArrow(probes, schema))
    dealt = together.repartition(partitions(spark), "cell").sortWithinPartitions("cell", "query")
    # A query has as many lists of hits as it visited cells.  A pair that several trees found has the same score in each.
    hits = dealt.mapInArrow(rank, "h long, g long, best array<struct<s:double,v:long>>").groupBy("h", "g").agg(F.sort_array(F.flatten(F.collect_list("best"))).alias("found"))
    unique = lambda found: F.filter(found, lambda x, i: (i == 0) | (x != F.get(found, i - 1)))
    hits = hits.select("h", "g", F.slice(unique(F.col("found")), 1, k + 1).alias("found")).join(searched, ["h", "g"])
    hits = hits.select("h", "g", "found", salts(F.col("often"), "query_id").alias("salt"))
    each = asked.withColumn("salt", salt("query_id")).join(hits, ["h", "g", "salt"]).groupBy("query_id").agg(F.sort_array(F.flatten(F.collect_set("found"))).alias("found"))
    others = F.filter(unique(F.col("found")), lambda x: x["v"] != F.col("query_id"))
    each = each.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("rank", "hit"))
    return each.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.v").alias("vec_id"), (-F.col("hit.s")).alias("score"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
