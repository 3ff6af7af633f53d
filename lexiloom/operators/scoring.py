"""BM25, normalisation over the right set of rows, and fusion with PageRank and phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.config import BM25, SERVER_FUSION, Fusion


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)


def term_score(tf: Column, dl: Column, avgdl: Column, k1: Column | float, b: Column | float) -> Column:
    score = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
    return F.when((tf > 0) & (avgdl > 0), score).otherwise(0.0)


def idf_table(posted: DataFrame, stats: DataFrame) -> DataFrame:
    """``term, df, idf``; the statistics are one row."""
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(stats)).select("term", "df", idf(F.col("n_docs"), F.col("df")).alias("idf"))


def bm25(candidates: DataFrame | None, posted: DataFrame, lengths: DataFrame, stats: DataFrame, terms: list[str], params: BM25 = BM25()) -> DataFrame:
    """``doc_id, bm25`` for each candidate, over distinct terms; 0 where none occurs.

    Without candidates, for each document that has a term: those are the candidates of an OR query, and
    need no retrieval of their own.  ``posted`` may have other terms too; idf is over all of its documents."""
    own = posted.filter(F.col("term").isin(sorted(set(terms))))
    weights = F.broadcast(idf_table(own, stats))  # a row a query term
    hits = own.select("term", "doc_id", "tf").join(weights, "term").join(lengths, "doc_id").join(F.broadcast(stats.select("avgdl")))
    one = F.col("idf") * term_score(F.col("tf"), F.col("dl"), F.col("avgdl"), params.k1, params.b)
    summed = hits.groupBy("doc_id").agg(F.sum(one).alias("bm25"))
    if candidates is None:
        return summed
    return candidates.join(summed, "doc_id", "left").select("doc_id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"))


def minmax(value: Column, low: Column, high: Column, flat: float = 1.0) -> Column:
    return F.when(high - low == 0, F.lit(flat)).otherwise((value - low) / (high - low))


def minmax_over(df: DataFrame, column: str, out: str, by: list[str] | None = None, flat: float = 1.0) -> DataFrame:
    """Min-max within the rows, or within groups of ``by``: bounds by one aggregation, joined back."""
    if by:
        w = Window.partitionBy(*by)
        return df.withColumn(out, minmax(F.col(column), F.min(column).over(w), F.max(column).over(w), flat))
    bounds = df.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    return df.join(F.broadcast(bounds)).withColumn(out, minmax(F.col(column), F.col("_low"), F.col("_high"), flat)).drop("_low", "_high")


def normalized_pagerank(ranks: DataFrame, flat: float = 1.0) -> DataFrame:
    """Min-max over the whole corpus, not over candidates."""
    return minmax_over(ranks, "pagerank", "pagerank_norm", flat=flat)


def fuse(scored: DataFrame, ranks: DataFrame, phrase_hits: DataFrame | None = None, weights: Fusion = SERVER_FUSION) -> DataFrame:
    """``doc_id, bm25_norm, pagerank_norm, phrase_bonus, score`` of candidates with ``bm25``.

    A candidate without PageRank counts 0; the bonus is given once if any phrase matches.  ``ranks`` may
    have ``pagerank_norm`` already, as an engine works it out once."""
    out = minmax_over(scored, "bm25", "bm25_norm")
    norm = ranks if "pagerank_norm" in ranks.columns else normalized_pagerank(ranks, weights.flat_pagerank)
    out = out.join(norm.select("doc_id", "pagerank_norm"), "doc_id", "left")
    out = out.withColumn("pagerank_norm", F.coalesce("pagerank_norm", F.lit(0.0)))
    if phrase_hits is None:
        out = out.withColumn("phrase_bonus", F.lit(0.0))
    else:
        marked = phrase_hits.select("doc_id").distinct().withColumn("phrase_bonus", F.lit(weights.phrase_bonus))
        out = out.join(marked, "doc_id", "left").withColumn("phrase_bonus", F.coalesce("phrase_bonus", F.lit(0.0)))
    total = weights.bm25 * F.col("bm25_norm") + weights.pagerank * F.col("pagerank_norm") + F.col("phrase_bonus")
    return out.select("doc_id", "bm25_norm", "pagerank_norm", "phrase_bonus", total.alias("score"))
