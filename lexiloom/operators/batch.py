"""Whole tables of queries through the engine's pipeline at once: validate, correct, parse, retrieve, score, sort.

Everything is keyed by ``query_id``, so a thousand queries are one plan, and each stage reads the postings of
all their terms once.  ``queries``: ``query_id, query``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.config import BM25, SERVER_FUSION, Fusion, Semantic
from lexiloom.functions import analyzers

from . import parsing, scoring, spell
from .index import Index


def corrected(queries: DataFrame, vocab: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``query_id, query`` with misspelt words replaced; queries that are invalid or have unknown words go."""
    valid = queries.filter(analyzers.query_error(F.col("query")).isNull())

    @F.pandas_udf("array<string>")
    def words(q: pd.Series) -> pd.Series:
        return q.map(spell.words_of)

    @F.pandas_udf("string")
    def rewritten(q: pd.Series, fixed: pd.Series) -> pd.Series:
        def one(text, pairs):
            got = spell.rewrite(text, {p["word"]: p["correction"] for p in pairs} if pairs is not None else {})
            return None if got["unknown_words"] else got["corrected_query"]

        return pd.Series([one(a, b) for a, b in zip(q, fixed)])

    each = valid.withColumn("word", F.explode_outer(words("query")))
    found = spell.best(each.filter("word IS NOT NULL").select("word").distinct(), vocab, known=known)
    pairs = each.join(found, "word", "left").groupBy("query_id", "query").agg(F.collect_list(F.struct("word", "correction")).alias("fixed"))
    return pairs.select("query_id", rewritten("query", "fixed").alias("query")).filter("query IS NOT NULL")


def parsed_terms(queries: DataFrame, analyze) -> tuple[DataFrame, DataFrame]:
    """``query_id, mode, term`` of required, optional and excluded terms; ``query_id, negated, phrase, offset, term`` of phrases."""
    parsed = parsing.searchable(parsing.parse_table(queries, analyze)).select("query_id", "parsed.*")
    modes = [parsed.select("query_id", F.lit(m).alias("mode"), F.explode(F.array_distinct(m)).alias("term")) for m in ("required", "optional", "excluded")]
    phrases = [
        parsed.select("query_id", F.lit(negated).alias("negated"), F.posexplode(c).alias("phrase", "words")).select("query_id", "negated", "phrase", F.posexplode("words").alias("offset", "term"))
        for c, negated in (("phrases", False), ("excluded_phrases", True))
    ]
    return modes[0].unionByName(modes[1]).unionByName(modes[2]), phrases[0].unionByName(phrases[1])


def lexical(queries: DataFrame, index: Index, ranks: DataFrame, analyze=parsing.stemmed, weights: Fusion = SERVER_FUSION, params: BM25 = BM25(), correct: bool = True) -> DataFrame:
    """``query_id, doc_id, bm25_norm, pagerank_norm, phrase_bonus, score, rank`` of every hit of every query."""
    if correct:
        queries = corrected(queries, index.vocab, index.deletions)
    terms, phrases = parsed_terms(queries, analyze)
    # Which terms of a query a document has: one join of the queries' terms with their postings.
    hits = index.postings.select("term", "doc_id", "tf").join(terms, "term")
    seen = lambda m: F.count_if(F.col("mode") == m)
    by_doc = hits.groupBy("query_id", "doc_id").agg(seen("required").alias("r"), seen("optional").alias("o"), seen("excluded").alias("x"))
    needed = terms.groupBy("query_id").agg(seen("required").alias("needed"), seen("optional").alias("wanted"))
    # Phrases: a start at which every offset is hit.
    at = index.postings.join(phrases, "term").select("query_id", "negated", "phrase", "offset", "doc_id", F.explode("positions").alias("pos"))
    starts = at.groupBy("query_id", "negated", "phrase", "doc_id", (F.col("pos") - F.col("offset")).alias("start")).agg(F.count("*").alias("n"))
    lengths = phrases.groupBy("query_id", "negated", "phrase").agg(F.count("*").alias("length"))
    whole = starts.join(lengths, ["query_id", "negated", "phrase"]).filter("n = length").select("query_id", "negated", "phrase", "doc_id").distinct()
    with_phrases = whole.groupBy("query_id", "doc_id").agg(F.count_if(~F.col("negated")).alias("p"), F.count_if("negated").alias("np"))
    n_phrases = lengths.groupBy("query_id").agg(F.count_if(~F.col("negated")).alias("n_phrases"))
    # A searchable query without words of its own has phrases, and their documents are all it can find.
    every = needed.join(n_phrases, "query_id", "full").select("query_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("needed", "wanted", "n_phrases")))
    counts = by_doc.join(with_phrases, ["query_id", "doc_id"], "full").join(every, "query_id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    own = ((F.col("needed") > 0) & (zero("r") == F.col("needed"))) | (zero("o") > 0) | ((F.col("needed") == 0) & (F.col("wanted") == 0))
    candidates = counts.filter(own & (zero("x") == 0) & (zero("np") == 0) & (zero("p") == F.col("n_phrases"))).select("query_id", "doc_id", "n_phrases")
    # Scores over distinct terms, required or optional.
    scored_terms = terms.filter("mode <> 'excluded'").select("query_id", "term").distinct()
    own_terms = index.postings.select("term", "doc_id", "tf").join(scored_terms.select("term").distinct(), "term", "left_semi")
    idf = scoring.idf_table(own_terms, index.stats).select("term", "idf")
    one = F.col("idf") * scoring.term_score(F.col("tf"), F.col("dl"), F.col("avgdl"), params.k1, params.b)
    summed = own_terms.join(scored_terms, "term").join(idf, "term").join(index.lengths, "doc_id").join(F.broadcast(index.stats.select("avgdl"))).groupBy("query_id", "doc_id").agg(F.sum(one).alias("bm25"))
    scored = candidates.join(summed, ["query_id", "doc_id"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    out = scoring.minmax_over(scored, "bm25", "bm25_norm", ["query_id"])
    norm = scoring.normalized_pagerank(ranks, weights.flat_pagerank).select("doc_id", "pagerank_norm")
    out = out.join(norm, "doc_id", "left").withColumn("pagerank_norm", F.coalesce("pagerank_norm", F.lit(0.0)))
    out = out.withColumn("phrase_bonus", F.when(F.col("n_phrases") > 0, weights.phrase_bonus).otherwise(0.0))
    out = out.withColumn("score", weights.bm25 * F.col("bm25_norm") + weights.pagerank * F.col("pagerank_norm") + F.col("phrase_bonus"))
    return ranked(out).select("query_id", "doc_id", "bm25_norm", "pagerank_norm", "phrase_bonus", "score", "rank")


def ranked(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return rows.withColumn("rank", F.row_number().over(w))


def semantic(hits: DataFrame, sims: DataFrame, params: Semantic = Semantic()) -> DataFrame:
    """The hits of :func:`lexical` re-ranked: ``query_id, doc_id, score, rank``, for each query of ``sims`` (``query_id, doc_id, sim``).

    A query's pool is its first ``top_k`` and the ``augment_k`` most similar documents that it lacks; a query without
    hits, as one with nothing to search for, takes its documents from the whole corpus."""
    head = hits.filter(F.col("rank") <= params.top_k).select("query_id", "doc_id", F.col("score").alias("base"))
    head = head.join(sims, ["query_id", "doc_id"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
    others = sims.join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    searched = hits.select("query_id").distinct().withColumn("found", F.lit(True))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("sim", 9)), "doc_id"))
    limit = F.when(F.col("found"), params.augment_k).otherwise(params.top_k)
    # The larger of both limits goes before the shuffle; a query's own is applied after.
    nearest = others.withColumn("nth", nth).filter(F.col("nth") <= max(params.augment_k, params.top_k)).join(searched, "query_id", "left").filter(F.col("nth") <= limit)
    pool = head.unionByName(nearest.select("query_id", "doc_id", F.lit(None).cast("double").alias("base"), "sim"))
    w = Window.partitionBy("query_id")
    pool = pool.withColumn("s", scoring.minmax(F.col("sim"), F.min("sim").over(w), F.max("sim").over(w)))
    pool = pool.withColumn("b", scoring.minmax(F.col("base"), F.min("base").over(w), F.max("base").over(w)))
    blended = F.when(F.col("base").isNull(), F.col("s")).otherwise((1 - params.weight) * F.col("b") + params.weight * F.col("s"))
    return ranked(pool.select("query_id", "doc_id", blended.alias("score")))
