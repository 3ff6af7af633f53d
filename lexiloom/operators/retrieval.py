"""Boolean and phrase retrieval over postings, as filters, groupings, semi and anti joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parsing import StructuredQuery


def docs_for(posted: DataFrame, term: str) -> DataFrame:
    return posted.filter(F.col("term") == term).select("doc_id")


def any_of(posted: DataFrame, terms: list[str]) -> DataFrame:
    return posted.filter(F.col("term").isin(terms)).select("doc_id").distinct()


def all_of(posted: DataFrame, terms: list[str]) -> DataFrame:
    """One scan: documents that have as many of the terms as there are; none for no terms."""
    terms = sorted(set(terms))
    hits = posted.filter(F.col("term").isin(terms)).groupBy("doc_id").agg(F.count_distinct("term").alias("n"))
    return hits.filter(F.col("n") == max(1, len(terms))).select("doc_id")


def without(docs: DataFrame, posted: DataFrame, terms: list[str]) -> DataFrame:
    return docs.join(any_of(posted, terms), "doc_id", "left_anti")


def phrase(posted: DataFrame, terms: list[str]) -> DataFrame:
    """Documents where the terms stand side by side: a start at which every offset is hit."""
    if not terms:
        return posted.filter(F.lit(False)).select("doc_id")
    offsets = [F.struct(F.lit(t).alias("term"), F.lit(i).alias("offset")) for i, t in enumerate(terms)]
    own = posted.filter(F.col("term").isin(terms)).select("term", "doc_id", F.explode("positions").alias("pos"))
    hits = own.withColumn("o", F.explode(F.array(*offsets))).filter(F.col("o.term") == F.col("term"))
    starts = hits.groupBy("doc_id", (F.col("pos") - F.col("o.offset")).alias("start")).agg(F.count_distinct("o.offset").alias("n"))
    return starts.filter(F.col("n") == len(terms)).select("doc_id").distinct()


def retrieve(posted: DataFrame, docs: DataFrame, query: StructuredQuery) -> DataFrame:
    """(all required, or any optional), or every document where there are neither; less what is excluded; with all phrases."""
    parts = [all_of(posted, query.required)] if query.required else []
    parts += [any_of(posted, query.optional)] if query.optional else []
    found = reduce(DataFrame.union, parts).distinct() if parts else docs.select("doc_id")
    if query.excluded:
        found = without(found, posted, query.excluded)
    for terms in query.excluded_phrases:
        found = found.join(phrase(posted, terms), "doc_id", "left_anti")
    for terms in query.phrases:
        found = found.join(phrase(posted, terms), "doc_id", "left_semi")
    return found


def terms_of(query: StructuredQuery) -> list[str]:
    """All terms whose postings a query needs."""
    lists = [query.required, query.optional, query.excluded, *query.phrases, *query.excluded_phrases]
    return sorted({t for ts in lists for t in ts})
