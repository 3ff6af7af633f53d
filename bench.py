"""Times of the headline queries, as one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8).  ``value`` is the sum over queries.
Index queries run on an index that was built and written once, as a search service would; each is
run twice and the second, warm time counts, except for the build itself.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexiloom import catalog
from lexiloom.config import PageRank, Semantic
from lexiloom.engine import SearchEngine
from lexiloom.operators import graph, index, results, retrieval, scoring, semantic
from lexiloom.operators.parsing import StructuredQuery
from lexiloom.plans import crawl, search
from lexiloom.sources import corpus


def main() -> None:
    folder = tempfile.mkdtemp(prefix="bench-")
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", f"file://{folder}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, run, warm: bool = True) -> None:
        if warm:
            run()
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)

    done = lambda df: df.write.format("noop").mode("overwrite").save()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    timed("index_build_and_write", lambda: index.Index.build(docs, spelling=False).save(f"{folder}/index"), warm=False)
    own = index.Index.load(spark, f"{folder}/index")
    own.lengths, own.stats = own.lengths.cache(), own.stats.cache()
    done(own.lengths.join(own.stats))
    ranks = scoring.normalized_pagerank(search.ranks(spark, sf_dir)).select("doc_id", "pagerank_norm").cache()
    done(ranks)

    def lexical(query: StructuredQuery):
        posted = own.postings.filter(F.col("term").isin(retrieval.terms_of(query)))
        found = None if query.any_of_terms else retrieval.retrieve(posted, own.lengths, query)
        scored = scoring.bm25(found, posted, own.lengths, own.stats, query.scored_terms)
        return scoring.fuse(scored, ranks)

    def hybrid():
        fused = lexical(StructuredQuery(optional=["ther", "erin", "thon"]))
        ranked = results.head_and_rest(fused, Semantic().top_k)  # the first page needs the head's order alone
        return semantic.rerank(ranked, search.sims(spark, sf_dir), Semantic())

    timed("lexical_one_word", lambda: results.top(lexical(StructuredQuery(optional=["ther"])), 10).collect())
    timed("lexical_or_3", lambda: results.top(lexical(StructuredQuery(optional=["ther", "erin", "thon"])), 10).collect())
    timed("phrase", lambda: retrieval.phrase(own.postings, ["anea", "eriner"]).count())
    timed("hybrid", lambda: hybrid().orderBy("position").limit(10).collect())
    timed("suggest", lambda: results.suggest(own.vocab, "th", 10).collect())
    corpus.documents(spark, sf_dir).write.parquet(f"{folder}/docs")
    saved = spark.read.parquet(f"{folder}/docs")
    engine = SearchEngine.open(saved, search.ranks(spark, sf_dir), f"{folder}/engine")

    def page(query: str, keep: bool = False):
        if not keep:
            engine.cache.clear()
        return engine.search(query).results.collect()

    # Spelling, parsing, retrieval, scores, copies, the page and its snippets.
    timed("engine_search_one_word", lambda: page("ther"))
    timed("engine_search_or_3", lambda: page("ther OR erin OR thon"))
    timed("engine_search_corrected", lambda: page("tehr"))
    timed("engine_search_cached", lambda: page("ther", keep=True))
    edges = crawl.supply_edges(spark, sf_dir).cache()
    done(edges)
    timed("pagerank_5_iterations", lambda: done(graph.pagerank(edges, PageRank(iterations=5), stop_early=False)))
    for name in ("grid_k1_b", "dedup_documents", "snippet_window", "eval_summary", "rollup_summary", "rate_limit_window"):
        timed(name, lambda name=name: done(catalog.queries()[name](spark, sf_dir)))
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    shutil.rmtree(folder, ignore_errors=True)
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
