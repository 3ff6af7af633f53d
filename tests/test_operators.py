import json
import math

import pytest
from pyspark.sql import functions as F

from lexiloom.config import BM25, PageRank, Semantic
from lexiloom.operators import batch, evaluation, graph, index, parsing, results, retrieval, scoring, semantic, tables, versions
from lexiloom.operators.parsing import StructuredQuery


def postings(spark, rows):
    return spark.createDataFrame([(t, d, len(p), p) for t, d, p in rows], "term string, doc_id long, tf long, positions array<int>")


@pytest.fixture(scope="module")
def f1(spark):
    posted = postings(spark, [("python", 1, [0]), ("python", 2, [0, 5]), ("python", 3, [2]), ("rare", 1, [1])])
    lengths = spark.createDataFrame([(1, 4), (2, 6), (3, 3)], "doc_id long, dl long")
    return posted, lengths, index.corpus_stats(lengths)


def test_bm25(spark, f1):
    posted, lengths, stats = f1
    idf = {r.term: r.idf for r in scoring.idf_table(posted, stats).collect()}
    assert math.isclose(idf["python"], math.log(0.5 / 3.5 + 1)) and math.isclose(idf["rare"], math.log(2.5 / 1.5 + 1))
    every = lengths.select("doc_id")
    got = {r.doc_id: r.bm25 for r in scoring.bm25(every, posted, lengths, stats, ["rare", "rare", "unseen"]).collect()}
    expected = idf["rare"] * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 4 / (13 / 3)))
    assert math.isclose(got[1], expected) and got[2] == got[3] == 0.0
    one = spark.createDataFrame([(0, 3, 5.0), (2, 3, 0.0)], "tf int, dl int, a double")
    assert [r[0] for r in one.select(scoring.term_score(F.col("tf"), F.col("dl"), F.col("a"), 1.2, 0.75)).collect()] == [0.0, 0.0]
    assert (BM25().k1, BM25().b) == (1.2, 0.75)


def test_minmax_and_fusion(spark):
    rows = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "doc_id long, bm25 double")
    assert sorted(r.n for r in scoring.minmax_over(rows, "bm25", "n").collect()) == [0.0, 0.5, 1.0]
    flat = spark.createDataFrame([(1, 5.0), (2, 5.0)], "doc_id long, bm25 double")
    assert {r.n for r in scoring.minmax_over(flat, "bm25", "n").collect()} == {1.0}
    ranks = spark.createDataFrame([(1, 0.8), (2, 0.2)], "doc_id long, pagerank double")
    hit = spark.createDataFrame([(1,), (1,)], "doc_id long")
    got = {r.doc_id: r for r in scoring.fuse(rows, ranks, hit).collect()}
    assert math.isclose(got[1].score, 0.15 + 2.0) and got[3].pagerank_norm == 0.0 and got[3].phrase_bonus == 0.0 and math.isclose(got[3].score, 0.85)
    assert scoring.fuse(rows.filter("false"), ranks).count() == 0


def test_retrieval(spark):
    texts = [(1, "alpha beta gamma"), (2, "beta alpha"), (3, "alpha x1 beta"), (4, ""), (5, "alpha beta alpha beta")]
    rows = index.tokens(spark.createDataFrame(texts, "doc_id long, text string"))
    posted, docs = index.postings(rows), rows.select("doc_id")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(retrieval.any_of(posted, ["gamma", "x1"])) == [1, 3] and ids(retrieval.all_of(posted, ["alpha", "gamma"])) == [1] and ids(retrieval.all_of(posted, [])) == []
    assert ids(retrieval.phrase(posted, ["alpha", "beta"])) == [1, 5] and ids(retrieval.phrase(posted, ["alpha", "beta", "alpha"])) == [5] and ids(retrieval.phrase(posted, [])) == []
    assert ids(retrieval.retrieve(posted, docs, StructuredQuery(excluded=["gamma"]))) == [2, 3, 4, 5]
    assert ids(retrieval.retrieve(posted, docs, StructuredQuery(required=["alpha", "gamma"], optional=["x1"]))) == [1, 3]
    assert ids(retrieval.retrieve(posted, docs, StructuredQuery(phrases=[["alpha", "beta"]], excluded_phrases=[["beta", "gamma"]]))) == [5]
    anded, ored = set(ids(retrieval.all_of(posted, ["alpha", "beta"]))), set(ids(retrieval.any_of(posted, ["alpha", "beta"])))
    assert anded <= ored


def test_index_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta alpha"), (2, None), (3, "the")], "doc_id long, text string")
    own = index.Index.build(docs)
    assert {(r.term, r.doc_id): list(r.positions) for r in own.postings.collect()} == {("alpha", 1): [0, 2], ("beta", 1): [1]}
    assert {r.doc_id: r.dl for r in own.lengths.collect()} == {1: 3, 2: 0, 3: 0}
    assert own.stats.first().asDict() == {"n_docs": 3, "avgdl": 1.0}
    own.save(str(tmp_path / "index"))
    again = index.Index.load(spark, str(tmp_path / "index"))
    assert again.postings.count() == 2 and "PushedFilters: [In(term" in again.postings.filter(F.col("term").isin("alpha", "zeta"))._jdf.queryExecution().toString().replace("IsNotNull(term), ", "")
    words = {(r.key, r.word) for r in again.deletions.collect()}
    assert ("bta", "beta") in words and ("alpha", "alpha") in words and {r.word: r.freq for r in again.vocab.collect()} == {"alpha": 2, "beta": 1, "the": 1}
    assert again.stats.first().asDict() == {"n_docs": 3, "avgdl": 1.0}
    own.save(str(tmp_path / "index"), source="two")  # a new version is read from then on
    assert index.Index.load(spark, str(tmp_path / "index"), "two").postings.count() == 2
    for path, source in ((tmp_path / "index", "one"), (tmp_path / "none", None)):
        with pytest.raises(versions.Stale):
            index.Index.load(spark, str(path), source)
    assert index.corpus_stats(own.lengths.filter("false")).first().avgdl == 0.0
    assert index.dump(own.postings).filter("term = 'alpha'").first().line == "alpha -> [Doc 1, TF=2, Pos=(0,2)]"
    ranks = spark.createDataFrame([("u1", 0.5)], "url string, score double")
    pages = spark.createDataFrame([(1, "u1"), (2, "u2")], "doc_id long, url string")
    assert {r.doc_id: r.pagerank for r in index.with_pagerank(pages, ranks).collect()} == {1: 0.5, 2: 0.0}


def test_results(spark):
    rows = spark.createDataFrame([(i, 1.0 if i < 3 else 1.0 / i, f"f{i % 4}") for i in range(1, 26)], "doc_id long, score double, fingerprint string")
    assert [r.doc_id for r in results.top(rows, 4).orderBy("rank").collect()] == [1, 2, 3, 4]
    assert sorted(r.doc_id for r in results.collapse(rows).collect()) == [1, 2, 3, 4]
    pages = [[r.doc_id for r in results.page(rows, n, 10).orderBy("rank").collect()] for n in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [10, 10, 5, 0] and sum(pages, []) == [r.doc_id for r in results.top(rows, 99).orderBy("rank").collect()]
    assert results.total_pages(rows).first().total_pages == 3 and results.total_pages(rows.filter("false")).first().total_pages == 0
    for bad in ((0, 10), (1, 51), (1, 0)):
        with pytest.raises(ValueError):
            results.page(rows, *bad)
    vocab = spark.createDataFrame([("alpha", 3), ("album", 3), ("alp", 9), ("beta", 1)], "word string, freq long")
    assert [r.word for r in results.suggest(vocab, " AL ", 2).collect()] == ["alp", "album"] and results.suggest(vocab, " ").count() == 0


def test_snippet(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(words,), ("a b",), (None,)], "t string")
    got = [r[0] for r in rows.select(results.snippet(F.col("t"), lambda w: w == "w20", 2)).collect()]
    assert got == ["...w18 w19 <mark>w20</mark> w21 w22...", "a b", ""]
    assert rows.select(results.snippet(F.col("t"), lambda w: w == "none", 2)).first()[0] == "w0 w1 w2 w3..."


def test_semantic(spark):
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "doc_id long, embedding array<float>")
    sims = semantic.similarities(emb, spark.createDataFrame([([1.0, 0.0],)], "q array<float>"))
    ranked = spark.createDataFrame([(2, 0.9, 1), (3, 0.5, 2)], "doc_id long, score double, rank int")
    got = {r.doc_id: r for r in semantic.rerank(ranked, sims).collect()}
    assert got[1].position == 1 and got[1].is_augmented and got[1].score == 1.0 and got[1].semantic_score == 1.0
    assert set(r.doc_id for r in semantic.rerank(ranked, sims, allow_augmentation=False).collect()) == {2, 3}
    tail = {r.doc_id: r for r in semantic.rerank(ranked, sims, Semantic(top_k=1, augment_k=0)).collect()}
    assert tail[3].semantic_score is None and tail[3].score == 0.5 and tail[3].position == 2
    assert semantic.rerank(ranked.filter("false"), sims.filter("false")).count() == 0


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")], "src string, dst string")
    ranks = {r.node: r.score for r in graph.pagerank(edges).collect()}
    assert math.isclose(sum(ranks.values()), 1, abs_tol=1e-6) and ranks["b"] < ranks["c"] < ranks["a"] + 1
    nodes, score = sorted(ranks), {n: 0.25 for n in ranks}
    out = {n: [d for s, d in [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")] if s == n] for n in nodes}
    for _ in range(30):
        lost = sum(score[n] for n in nodes if not out[n])
        score = {n: 0.0375 + 0.85 * (sum(score[m] / len(out[m]) for m in nodes if n in out[m]) + lost / 4) for n in nodes}
    assert all(math.isclose(ranks[n], score[n], abs_tol=1e-5) for n in nodes)
    assert {r.node: r.depth for r in graph.bfs(edges, spark.createDataFrame([("a",)], "node string"), 2).collect()} == {"a": 0, "b": 1, "d": 1, "c": 2}
    assert graph.pagerank(edges.filter("false"), PageRank(iterations=2)).count() == 0


def test_evaluation(spark):
    ranked = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("q", 3, 3), ("q", 4, 4)], "query_id string, doc_id long, rank int")
    judged = spark.createDataFrame([("q", 2), ("q", 9)], "query_id string, doc_id long")
    got = {r.query_id: r for r in evaluation.metrics(ranked, judged, spark.createDataFrame([("q",), ("none",)], "query_id string")).collect()}
    ndcg = (1 / math.log2(3)) / (1 + 1 / math.log2(3))
    assert got["q"].p_at_k == 0.25 and got["q"].mrr == 0.5 and math.isclose(got["q"].ndcg_at_k, ndcg) and got["none"].ndcg_at_k == 0.0
    ex = spark.createDataFrame([(1.0, 0.0, 1), (0.9, 0.1, 1), (0.1, 0.2, 0), (0.0, 0.9, 0)], "bm25_norm double, pagerank_norm double, label int")
    a, b = evaluation.nonnegative_ridge(evaluation.ridge_moments(evaluation.sample_weights(ex)).first().asDict())
    assert a == 1.0 and b == 0.0
    zero = dict.fromkeys(("sx", "sz", "sy", "sxx", "szz", "sxz", "sxy", "szy"), 0.0) | {"sw": 1.0}
    assert evaluation.nonnegative_ridge(zero) == (0.85, 0.15)


def test_tables(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2), ("c", 2)], "k string, v int")
    assert sorted(tables.upsert(old, new.distinct(), "k").collect()) == [("a", 1), ("b", 2), ("c", 2)]
    assert sorted(tables.insert_ignore(old, new, "k").collect()) == [("a", 1), ("b", 1), ("c", 2)]
    asked = spark.createDataFrame([("h", 0.0, 0), ("h", 0.1, 1), ("h", 5.0, 2), ("g", 0.0, 3)], "host string, at double, seq int")
    assert {r.seq: r.slot for r in tables.politeness_slots(asked, "host", "at", ["seq"]).collect()} == {0: 0.0, 1: 1.0, 2: 5.0, 3: 0.0}
    sized = spark.createDataFrame([(i, 10) for i in range(100)], "k long, n long")
    assert tables.within_budget(sized, "k", "n", 1000, 95).count() == 10 and tables.within_budget(sized, "k", "n", 7, 10**9).count() == 7


def test_ranks_without_one_task(spark):
    rows = [(i, [0.25, 1.0, 1.0 - 1e-12, None, -3.0][i % 5]) for i in range(60)]
    got = {r.doc_id: r["rank"] for r in results.ranked(spark.createDataFrame(rows, "doc_id long, score double")).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -round(r[1] or 0.0, 9), r[0]))
    assert got == {i: n + 1 for n, (i, _) in enumerate(order)}
    same = spark.createDataFrame([(i, 1.0) for i in range(5)], "doc_id long, score double")
    assert [r["rank"] for r in results.ranked(same).orderBy("doc_id").collect()] == [1, 2, 3, 4, 5] and results.ranked(same.filter("false")).count() == 0


def test_breadth_first_ends_by_itself(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "src long, dst long")
    got = graph.bfs(edges, spark.createDataFrame([(1,)], "node long")).collect()
    assert {r.node: r.depth for r in got} == {1: 0, 2: 1, 3: 2}


def test_pagerank_of_documents(spark):
    """By power iteration over a matrix; two documents are linked with nothing, one link leads to no document."""
    docs = spark.createDataFrame([(i,) for i in range(7)], "doc_id long")
    edges = [(0, 1), (0, 2), (1, 2), (2, 0), (3, 2), (3, 2), (4, 99)]
    got = {r.doc_id: r.pagerank for r in graph.document_pagerank(spark.createDataFrame(edges, "src long, dst long"), docs).collect()}
    to = {i: sorted({b for a, b in edges if a == i and b < 7}) for i in range(7)}
    ranks = [1 / 7] * 7
    for _ in range(300):
        loose = sum(r for i, r in enumerate(ranks) if not to[i]) / 7
        new = [0.15 / 7 + 0.85 * loose] * 7
        for i, targets in to.items():
            for j in targets:
                new[j] += 0.85 * ranks[i] / len(targets)
        ranks = new
    assert set(got) == set(range(7)) and sum(abs(got[i] - ranks[i]) for i in range(7)) < 1e-4


def test_report_and_judgments(spark, tmp_path):
    per = spark.createDataFrame([("b", "x", 0.5, 1.0, 0.25), ("a", "y", 0.0, 0.0, 0.0)], "query_id string, qtype string, p_at_k double, mrr double, ndcg_at_k double")
    evaluation.write_report(evaluation.report(per), str(tmp_path / "report"))
    got = json.loads(spark.read.text(str(tmp_path / "report")).first().value)
    assert [q["query_id"] for q in got["queries"]] == ["a", "b"] and {r["qtype"]: r["n"] for r in got["summary"]} == {"overall": 2, "x": 1, "y": 1}
    assert next(r for r in got["summary"] if r["qtype"] == "overall")["p_at_k"] == 0.25
    docs = spark.createDataFrame([(1, "Salt guide", "a"), (2, "PEPPER", "b"), (3, None, None)], "doc_id long, title string, kind string")
    rules = spark.createDataFrame([("q", "salt"), ("q", "guide"), ("r", "pepper")], "query_id string, part string")
    assert {tuple(r) for r in evaluation.judged_by_title(docs, rules).collect()} == {("q", 1), ("r", 2)}
    kinds = spark.createDataFrame([("q", "b")], "query_id string, category string")
    assert [tuple(r) for r in evaluation.judged_by_category(docs, kinds, "kind").collect()] == [("q", 2)]
    bars = results.signals(spark.createDataFrame([(1.7,), (-0.2,), (0.456,), (None,)], "s double"), ["s"]).collect()
    assert [r.s_percent for r in bars] == [100, 0, 46, None]


def test_query_tables_agree_with_single_queries(spark):
    texts = [(1, "alpha beta gamma"), (2, "beta alpha"), (3, "alpha x1 beta"), (4, "delta"), (5, "alpha beta alpha beta")]
    own = index.Index.build(spark.createDataFrame(texts, "doc_id long, text string"))
    ranks = spark.createDataFrame([(1, 0.5), (2, 0.1), (5, 0.9)], "doc_id long, pagerank double")
    queries = ["alpha", "alpha AND gamma", "alpha OR delta NOT beta", '"alpha beta"', '"alpha beta" NOT "beta gamma"', "alpha AND gamma OR delta", "gamma AND missing OR delta", "NOT alpha"]
    rows = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    got = {}
    for r in batch.lexical(rows, own, ranks, parsing.plain, correct=False).collect():
        got.setdefault(r.query_id, {})[r.doc_id] = round(r.score, 9)
    for i, text in enumerate(queries):
        q = parsing.parse(text, parsing.plain)
        want = {}
        if q.searchable:
            found = retrieval.retrieve(own.postings, own.lengths, q)
            hits = None
            for p in q.phrases:
                hits = retrieval.phrase(own.postings, p)
            scored = scoring.bm25(found, own.postings, own.lengths, own.stats, q.scored_terms)
            want = {r.doc_id: round(r.score, 9) for r in scoring.fuse(scored, ranks, hits).collect()}
        assert got.get(i, {}) == want, text
