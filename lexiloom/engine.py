"""The search engine: build or load an index, then search, suggest, stats and clicks."""

from __future__ import annotations

import time
from collections import OrderedDict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.config import CACHE_SIZE, MAX_PAGE_SIZE, MAX_QUERY_LENGTH, PAGE_SIZE, QUERY_ERRORS, SERVER_FUSION, Semantic
from lexiloom.functions import analyzers
from lexiloom.functions.stemmer import stem
from lexiloom.operators import results, retrieval, scoring, semantic, spell, versions
from lexiloom.operators.index import Index, vocabulary
from lexiloom.operators.parsing import parse


@dataclass
class Outcome:
    """``status``: ok, invalid or no_results; the results are ranked, and empty unless it is ok."""

    status: str
    results: DataFrame | None = None
    message: str | None = None
    did_you_mean: str | None = None
    unknown_words: tuple[str, ...] = ()
    total: int = 0
    total_pages: int = 0
    #: The stems that snippets mark: those searched for, not those excluded.
    terms: frozenset[str] = frozenset()


class SearchEngine:
    """``docs``: ``doc_id, title, content, url``; ``ranks``: ``doc_id, pagerank``; ``embeddings``: ``doc_id, embedding``."""

    def __init__(self, docs: DataFrame, ranks: DataFrame, embeddings: DataFrame | None = None, embed=None, index: Index | None = None):
        self.docs = docs.withColumn("text", analyzers.whole_text(F.col("title"), F.col("content")))
        self.ranks = scoring.normalized_pagerank(ranks, SERVER_FUSION.flat_pagerank).select("doc_id", "pagerank_norm").cache()
        self.embeddings, self.embed = embeddings, embed
        self.index = index or Index.build(self.docs, "query")
        self.vocab = self.index.vocab if self.index.vocab is not None else vocabulary(self.docs)
        self.started = time.monotonic()
        self.cache: OrderedDict[str, Outcome] = OrderedDict()

    @classmethod
    def open(cls, docs: DataFrame, ranks: DataFrame, path: str, embeddings: DataFrame | None = None, embed=None, source: str | None = None) -> SearchEngine:
        """An engine on the index saved at ``path``, which is made and saved first where it is missing or stale."""
        try:
            index = Index.load(docs.sparkSession, path, source)
        except versions.Stale:
            text = docs.withColumn("text", analyzers.whole_text(F.col("title"), F.col("content")))
            Index.build(text, "query").save(path, source=source or "")
            index = Index.load(docs.sparkSession, path, source)
        index.stats, index.lengths = index.stats.cache(), index.lengths.cache()
        return cls(docs, ranks, embeddings, embed, index)

    def search(self, q: str | None, page: int = 1, page_size: int = PAGE_SIZE, rerank: bool = False) -> Outcome:
        error = self._error(q)
        if error:
            return Outcome("invalid", message=error)
        key = q.strip().lower() + ("\x1frerank" if rerank else "")
        if key not in self.cache:
            found = self._ranked(q, rerank)
            if found.status != "ok":
                return found
            self.cache[key] = found
            while len(self.cache) > CACHE_SIZE:
                self.cache.popitem(last=False)[1].results.unpersist()
        self.cache.move_to_end(key)
        found = self.cache[key]
        first = (page - 1) * page_size
        if page < 1 or not 1 <= page_size <= MAX_PAGE_SIZE:
            return Outcome("invalid", message="page starts at 1 and page_size is from 1 to 50")
        if "position" in found.results.columns:
            shown = found.results.withColumn("rank", F.col("position")).drop("position").filter(F.col("rank").between(first + 1, first + page_size))
        else:
            shown = results.top(found.results, first + page_size).filter(F.col("rank") > first)
        # Texts are read, and snippets made, for the page alone: at most 50 documents.
        rows = shown.collect()
        shown = self.docs.sparkSession.createDataFrame(rows, shown.schema)
        texts = self.docs.filter(F.col("doc_id").isin([r["doc_id"] for r in rows])).select("doc_id", "title", "content", "url", "text").cache()
        words = texts.select(F.explode(analyzers.basic_tokens(F.col("text"))).alias("w")).distinct()
        targets = [r["w"] for r in words.collect() if stem(r["w"]) in found.terms]
        mark = lambda w: F.arrays_overlap(F.regexp_extract_all(F.lower(w), F.lit("([a-z0-9]+)"), 1), F.array(*map(F.lit, targets)).cast("array<string>"))
        snippet = results.snippet(analyzers.display_text(F.col("title"), F.col("content")), mark)
        out = F.broadcast(shown).join(texts, "doc_id").select(*shown.columns, "title", "url", snippet.alias("snippet"))
        return Outcome("ok", out.orderBy("rank"), did_you_mean=found.did_you_mean, total=found.total, total_pages=-(-found.total // page_size), terms=found.terms)

    @staticmethod
    def _error(q: str | None) -> str | None:
        if q is None:
            return QUERY_ERRORS["missing"]
        if any(ord(c) < 32 for c in q):
            return QUERY_ERRORS["control"]
        if not q.strip():
            return QUERY_ERRORS["empty"]
        if len(q) > MAX_QUERY_LENGTH:
            return QUERY_ERRORS["long"]
        return None if any(c.isalnum() for c in q) else QUERY_ERRORS["no_word"]

    def _ranked(self, q: str, rerank: bool) -> Outcome:
        fixed = spell.correct(q, self.vocab, self.index.deletions)
        if fixed["unknown_words"] and not rerank:
            return Outcome("no_results", message="No results found.", unknown_words=tuple(fixed["unknown_words"]))
        corrected = fixed["corrected_query"] if fixed["suggestions"] and not rerank else q
        query = parse(corrected)
        if not query.searchable:
            return Outcome("no_results", message="No searchable terms.")
        posted = self.index.postings.filter(F.col("term").isin(retrieval.terms_of(query)))
        candidates = None if query.any_of_terms else retrieval.retrieve(posted, self.index.lengths, query)
        scored = scoring.bm25(candidates, posted, self.index.lengths, self.index.stats, query.scored_terms)
        hits = None
        for terms in query.phrases:
            found = retrieval.phrase(posted, terms)
            hits = found if hits is None else hits.union(found)
        fused = scoring.fuse(scored, self.ranks, hits, SERVER_FUSION).withColumn("semantic_score", F.lit(None).cast("double"))
        prints = lambda rows: rows.join(self.docs.select("doc_id", "title", "content"), "doc_id", "left").withColumn(
            "fingerprint", F.sha2(analyzers.fingerprint(F.col("title"), F.col("content")), 256)
        ).drop("title", "content")
        if rerank and self.embeddings is not None:
            hybrid = semantic.rerank(results.ranked(fused), semantic.similarities(self.embeddings, self.embed(q)), Semantic(), query.may_augment)
            joined = prints(hybrid.join(fused.select("doc_id", "bm25_norm", "pagerank_norm", "phrase_bonus"), "doc_id", "left"))
            kept = joined.groupBy("fingerprint").agg(F.min_by(F.struct(*joined.columns), "position").alias("_best")).select("_best.*").drop("fingerprint")
            final = results.ranked(kept.withColumn("_place", -F.col("position").cast("double")), "_place").drop("position", "_place").withColumnRenamed("rank", "position")
        else:
            final = results.collapse(prints(fused)).drop("fingerprint")
        final = final.cache()
        total = final.count()
        terms = frozenset([*query.required, *query.optional, *(t for p in query.phrases for t in p)])
        return Outcome("ok" if total else "no_results", final, None if total else "No results found.", corrected if corrected != q else None, total=total, terms=terms)

    def suggest(self, prefix: str, limit: int = 10) -> DataFrame:
        return results.suggest(self.vocab, prefix, limit)

    def stats(self) -> DataFrame:
        """Size of the corpus, the time, and for how many seconds this engine has been up."""
        up = F.lit(time.monotonic() - self.started).alias("uptime_s")
        return self.index.stats.select(F.col("n_docs").alias("corpus_size")).select("corpus_size", F.current_timestamp().alias("checked_at"), up)

    def clicks(self, rows: DataFrame) -> DataFrame:
        from lexiloom.streaming.streams import valid_clicks

        return valid_clicks(rows, self.docs)
