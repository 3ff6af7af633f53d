"""Vector similarity and the hybrid re-rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.config import Semantic

from .scoring import minmax


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def hashed_embedding(tokens: Column, dimensions: int = 64) -> Column:
    """A stand-in embedder where no model is at hand: signed feature hashing to unit length."""
    signed = F.transform(tokens, lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(dimensions)).cast("int").alias("i"), F.when(F.pmod(F.hash(t), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("v")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.aggregate(F.filter(signed, lambda s: s["i"] == d), F.lit(0.0), lambda acc, s: acc + s["v"]))
    size = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(raw, lambda x: F.when(size > 0, x / size).otherwise(0.0))


def similarities(embeddings: DataFrame, query: DataFrame) -> DataFrame:
    """``doc_id, sim`` of every embedding with the one row of ``query`` (``q``)."""
    return embeddings.join(F.broadcast(query)).select("doc_id", dot(F.col("embedding"), F.col("q")).alias("sim"))


def augment(sims: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar documents that the whole ranked list lacks."""
    new = sims.join(ranked.select("doc_id"), "doc_id", "left_anti")
    return new.orderBy(F.desc(F.round("sim", 9)), "doc_id").limit(k)


def rerank(ranked: DataFrame, sims: DataFrame, params: Semantic = Semantic(), allow_augmentation: bool = True) -> DataFrame:
    """Ranked results (``doc_id, score, rank``) re-ranked: ``doc_id, position, score, semantic_score, is_augmented``.

    The pool is the first ``top_k`` and, where allowed, the augmented.  Similarity is normalised over the
    pool, the base score over the head alone; an augmented document has no base score, and its blended
    score is its similarity.  The tail follows unchanged, with no semantic score."""
    head = ranked.filter(F.col("rank") <= params.top_k).join(sims, "doc_id", "left").select("doc_id", "score", F.coalesce("sim", F.lit(0.0)).alias("sim"))
    pool = head
    if allow_augmentation:
        pool = head.unionByName(augment(sims, ranked, params.augment_k).select("doc_id", F.lit(None).cast("double").alias("score"), "sim"))
    w = Window.partitionBy()  # the pool has top_k + augment_k rows at most
    sem = minmax(F.col("sim"), F.min("sim").over(w), F.max("sim").over(w))
    base = minmax(F.col("score"), F.min("score").over(w), F.max("score").over(w))
    pool = pool.withColumn("semantic_score", sem).withColumn("base", base)
    blended = F.when(F.col("score").isNull(), F.col("semantic_score")).otherwise((1 - params.weight) * F.col("base") + params.weight * F.col("semantic_score"))
    pool = pool.withColumn("blended", blended).withColumn("position", F.row_number().over(Window.orderBy(F.desc(F.round("blended", 9)), "doc_id")))
    size = pool.agg(F.count("*").alias("n_pool"))
    tail = ranked.filter(F.col("rank") > params.top_k).join(F.broadcast(size)).select(
        "doc_id", (F.col("rank") - params.top_k + F.col("n_pool")).cast("int").alias("position"), "score", F.lit(None).cast("double").alias("semantic_score"), F.lit(False).alias("is_augmented")
    )
    return pool.select("doc_id", "position", F.col("blended").alias("score"), "semantic_score", F.col("score").isNull().alias("is_augmented")).unionByName(tail)
