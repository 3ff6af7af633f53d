"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

1. A document's set holds its distinct word shingles as 64-bit hashes.  Equal sets, by a 128-bit
   digest, are one class, represented by its smallest ``doc_id``; copies are not looked at again.
2. Circulant MinHash: a first permutation spreads the hashes over a circle of 2**32 places; the
   second, shifted by one place for each coordinate, gives all coordinates as minima.  ``ROWS``
   coordinates make a band; a pair at similarity 0.85 shares none of 24 bands once in a million, at 0.8
   once in ten thousand.
3. Each bucket's members are confirmed against its first, ``100 * intersection >= percent * union`` on the full
   sets, which are made from the whole texts once more and kept.  A first with very many members is dealt out
   with them by a salt; members stream past it.  The confirmed links' components are *groups*.
4. What may still be linked shares a bucket of several groups.  Such buckets are joined into *clusters*, which
   are cut into blocks of bounded size; a task has two blocks, takes the pairs that share a band and are of
   different groups and components so far, and confirms them.  It returns only links that join components, at
   most one a document, so output is linear however many pairs there are.  No bucket is capped.
5. Components of the confirmed links, expanded from representatives to all copies.

Texts and words of any length are read whole: a text by blocks, and a word that goes over a block's end is carried on.

Defined cases: a null or empty text, or one without words, has no shingles and is a component of its
own; fewer words than a shingle are one shingle; a null ``doc_id`` takes no part and is not returned;
repeated ids with differing texts count as one document with the links of each and the largest set;
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, partitions, table
from .components import components
from .textstats import SPACES, mix, word_hashes
from .vectors import salt, salts

WORDS, PERCENT, BANDS, ROWS = 5, 80, 24, 5
#: Shingles in a block of a cluster, about, a document counting as ``LEAST_SHINGLES`` at least; a task holds two blocks.
BLOCK_SHINGLES, LEAST_SHINGLES = 1_000_000, 200
#: Members of a bucket that meet its first in one task, about.
STAR = 4096
#: Bytes of a bit matrix of shared shingles; above it, pairs are compared one by one.
MATRIX_BYTES = 64 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEPARATOR = SPACES.copy()  # 0x20 and 0x09 to 0x0D


def shingles(text: str, words: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in ascending order."""
    h = word_hashes(LOWER[np.frombuffer(text.encode(), np.uint8)], ~SEPARATOR)
    if not len(h):
        return h
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation of the circle of 2**32 places, in place."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(16)
    return x


def signature(found: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of a set that is not empty."""
    place = (mix(found ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)  # the first permutation
    out = np.empty(size, np.uint32)
    step = max(1, 65536 // len(place))
    for k in range(0, size, step):
        shifts = np.arange(k, min(size, k + step), dtype=np.uint32)
        out[k : k + step] = _second(place[None, :] + shifts[:, None]).min(1)
    return out


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    parts = sig.reshape(-1, rows).astype(np.uint64)
    key = np.arange(len(parts), dtype=np.uint64)
    for j in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, j])
    return key.view(np.int64)


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """Per document: size and digest of its set, and its band keys; null where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, digests, keys = [], [], []
            for t in b.column("text"):
                s = shingles(t.as_py(), words)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(band_keys(signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "digest", "bands"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


class _Joined:
    """Union-find over places."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def similar_links(sets: list[np.ndarray], keys: np.ndarray, side: np.ndarray | None, percent: int, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Confirmed links that join components, among pairs of places that share a band and are of different groups.

    With sides given, pairs of one side are left out: another task has them."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    _, place, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = often > 1
    column = np.cumsum(shared) - 1
    keep = shared[place]
    width = (int(shared.sum()) + 63) // 64
    matrix = None
    if n * width * 8 <= MATRIX_BYTES:
        matrix = np.zeros((n, width * 8), np.uint8)
        c = column[place[keep]]
        np.bitwise_or.at(matrix, (owner[keep], c >> 3), (1 << (c & 7)).astype(np.uint8))
        matrix = matrix.view(np.uint64)
    joined, links = _Joined(n), []
    if group is not None:
        first = {}
        for i, g in enumerate(group.tolist()):
            joined.join(first.setdefault(g, i), i)
    for i in range(n - 1):
        later = (keys[i + 1 :] == keys[i]).any(1)
        # |A & B| <= min and |A | B| >= max
        later &= 100 * np.minimum(size[i], size[i + 1 :]) >= percent * np.maximum(size[i], size[i + 1 :])
        if side is not None:
            later &= side[i + 1 :] != side[i]
        if group is not None:
            later &= group[i + 1 :] != group[i]
        others = np.flatnonzero(later) + i + 1
        if not len(others):
            continue
        if matrix is not None:
            both = np.bitwise_count(matrix[others] & matrix[i]).sum(1).astype(np.int64)
            others = others[100 * both >= percent * (size[i] + size[others] - both)]
        for j in others.tolist():
            if joined.find(i) == joined.find(j):
                continue
            if matrix is None:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both < percent * (size[i] + size[j] - both):
                    continue
            joined.join(i, j)
            links.append((i, j))
    return links


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each document with an id."""
    texts = documents(docs).filter("doc_id IS NOT NULL")
    sketched = materialize(sketch(texts, words), "sketch")
    classes = sketched.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.min_by("bands", "doc_id").alias("bands"), F.min("n_shingles").alias("n_shingles"), F.count("*").alias("copies"))
    classes = materialize(classes, "classes")
    banded = classes.select("class_id", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("class_id").alias("first"), F.max("class_id").alias("last")).filter("first < last")
    near = materialize(banded.join(buckets, "band").filter("class_id <> first").select(F.col("first").alias("a"), F.col("class_id").alias("b")).distinct(), "near")
    ids = near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct()
    # One plan at every size, which sorts no texts: the ids are hashed, each partition having a few.
    sets = materialize(_sets(texts.join(ids.hint("shuffle_hash"), "doc_id", "left_semi"), words), "sets")
    star = materialize(_star(near, sets, percent), "star")
    groups = components(star).select(F.col("id").alias("class_id"), F.col("component").alias("group"))
    owned = banded.join(groups, "class_id", "left").select("class_id", "band", F.coalesce("group", "class_id").alias("group"))
    several = owned.groupBy("band").agg(F.min("class_id").alias("first"), F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high")
    open_pairs = owned.join(several, "band").select(F.col("first").alias("a"), F.col("class_id").alias("b"))
    in_cluster = components(open_pairs).select(F.col("id").alias("class_id"), F.col("component").alias("cluster")).join(groups, "class_id", "left")
    in_cluster = materialize(in_cluster.join(classes.select("class_id", "n_shingles"), "class_id"), "clusters")
    blocks = in_cluster.groupBy("cluster").agg(F.ceil(F.sum(F.greatest("n_shingles", F.lit(LEAST_SHINGLES))) / BLOCK_SHINGLES).cast("int").alias("n_blocks"))
    placed = in_cluster.join(blocks, "cluster").select(
        F.col("class_id").alias("doc_id"), F.coalesce("group", "class_id").alias("group"), "cluster", "n_blocks", F.pmod(F.xxhash64("class_id"), F.col("n_blocks")).cast("int").alias("block")
    )
    links = materialize(star.union(_verified(sets.join(placed, "doc_id"), percent)), "links")
    # Copies of one id with differing texts, and classes through their links.
    owners = classes.select("digest", "class_id", salts(F.col("copies"), "class_id").alias("salt"))  # a digest of very many copies is no hot key
    members = sketched.withColumn("salt", salt("doc_id")).join(owners, ["digest", "salt"], "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"))
    joined = components(links.union(members.filter("doc_id <> class_id").select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"))))
    sizes = members.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    out = sizes.join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """``doc_id, shingles, keys``: the set and the band keys of each text, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t.as_py(), words) for t in b.column("text")]
            keys = [band_keys(signature(s)) if len(s) else np.empty(0, np.int64) for s in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([s.tobytes() for s in found], pa.binary()), pa.array([k.tobytes() for k in keys], pa.binary())], ["doc_id", "shingles", "keys"]
            )

    return texts.mapInArrow(run, "doc_id long, shingles binary, keys binary").filter(F.length("shingles") > 0)


def _star(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of ``near`` (``a, b``) whose sets are similar: members stream past the set of their first."""
    spark = near.sparkSession
    firsts = near.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("n_salts"))
    members = near.join(firsts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("n_salts")).cast("int").alias("salt"))
    own = sets.select(F.col("doc_id").alias("id"), "shingles")
    held = firsts.join(own, F.col("a") == F.col("id")).select("a", F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1)).alias("salt"), F.lit(0).alias("member"), "id", "shingles")
    passing = members.join(own, F.col("b") == F.col("id")).select("a", "salt", F.lit(1).alias("member"), "id", "shingles")
    dealt = held.unionByName(passing).repartition(partitions(spark), "a", "salt").sortWithinPartitions("a", "salt", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first = None, []
        for b in batches:
            a, salt, member, ids = (b.column(c).to_pylist() for c in ("a", "salt", "member", "id"))
            out: list[tuple[int, int]] = []
            for i, shingle in enumerate(b.column("shingles")):
                own = np.frombuffer(shingle.as_py(), np.uint64)
                if (a[i], salt[i]) != now:
                    now, first = (a[i], salt[i]), []
                if not member[i]:
                    first.append(own)  # a repeated id may have several sets
                    continue
                for f in first:
                    if 100 * min(len(f), len(own)) >= percent * max(len(f), len(own)):
                        both = int((f[np.minimum(np.searchsorted(f, own), len(f) - 1)] == own).sum())
                        if 100 * both >= percent * (len(f) + len(own) - both):
                            out.append((a[i], ids[i]))
                            break
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _verified(ready: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` between documents of a cluster and of different groups, block by block."""
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    dealt = ready.select("*", other).select(
        "doc_id", "group", "cluster", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "shingles", "keys"
    )

    def confirm(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id")
        ids = rows["doc_id"].to_numpy()
        links: list[tuple[int, int]] = []
        if len(ids) > 1:
            found = [np.frombuffer(x.as_py(), np.uint64) for x in rows["shingles"]]
            keys = np.stack([np.frombuffer(x.as_py(), np.int64) for x in rows["keys"]])
            side = rows["block"].to_numpy() if key[1] != key[2] else None
            links = similar_links(found, keys, side, percent, rows["group"].to_numpy())
        return pa.table({"a": pa.array([ids[i] for i, _ in links], pa.int64()), "b": pa.array([ids[j] for _, j in links], pa.int64())})

    return dealt.groupBy("cluster", "low", "high").applyInArrow(confirm, "a long, b long")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
