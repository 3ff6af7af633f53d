import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.engine import SearchEngine
from lexiloom.operators import embeddings, tables
from lexiloom.sources import corpus, fetch, formats
from lexiloom.streaming import crawl, streams


@pytest.fixture
def two_docs(spark, tmp_path):
    path = str(tmp_path / "index.bin")
    posted = spark.createDataFrame([("foo", 1, [2, 5, 6]), ("foo", 2, [0]), ("bar", 1, [1])], "term string, doc_id int, positions array<int>")
    docs = spark.createDataFrame([(1, 2, "http://a", 0.6), (2, 1, "http://b", 0.4)], "doc_id int, dl int, url string, pagerank float")
    formats.write_index(path, posted, docs)
    return path


def test_binary_index(spark, two_docs):
    formats.register(spark)
    read = lambda s: spark.read.format("binary_index").option("path", two_docs).option("section", s).load()
    assert [(r.term, r.doc_id, r.tf, list(r.positions)) for r in read("postings").collect()] == [("bar", 1, 1, [1]), ("foo", 1, 3, [2, 5, 6]), ("foo", 2, 1, [0])]
    assert {r.doc_id: r.dl for r in read("doc_lengths").collect()} == {1: 2, 2: 1} and read("stats").first().avgdl == 1.5
    assert {r.doc_id: r.url for r in read("urls").collect()} == {1: "http://a", 2: "http://b"} and abs(read("pageranks").collect()[0].pagerank - 0.6) < 1e-6
    data = open(two_docs, "rb").read()
    for bad in (b"NOTINDEX" + data[8:], data[:8] + b"\1" + data[9:], data[:30]):
        with pytest.raises(ValueError):
            formats.read_index(bad)


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "crawl.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE pages (id INTEGER PRIMARY KEY, url TEXT, title TEXT, content TEXT)")
        c.executemany("INSERT INTO pages (url, title, content) VALUES (?, ?, ?)", [(f"u{i}", None, f"text {i}") for i in range(25)])
    formats.register(spark)
    got = spark.read.format("sqlite_table").schema("url string, content string").option("path", path).option("table", "pages").option("partitions", "4").load()
    assert got.count() == 25 and got.filter("url = 'u7'").first().content == "text 7"


def test_corpora(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": 1, "title": "a"}, {"id": 2, "title": "b"}, {"id": 1, "title": "c"}]))
    assert {r.id: r.title for r in corpus.json_corpus(spark, str(tmp_path / "c.json")).collect()} == {1: "c", 2: "b"}
    (tmp_path / "stop.txt").write_text("the a\nan  the\n")
    assert {r.word for r in corpus.stop_words(spark, str(tmp_path / "stop.txt")).collect()} == {"the", "a", "an"}
    assert corpus.pagerank_table(spark, str(tmp_path / "none")).count() == 0
    assert [r.url for r in corpus.seeds(spark, ["http://A.com", "nope", "http://a.com/"]).collect()] == ["http://a.com/"]
    made = corpus.generated(spark, 30).collect()
    assert len(made) == 30 and made[8].content == made[9].content and made[7].content != made[8].content
    assert corpus.generated(spark, 30).collect() == made
    frontier = spark.createDataFrame([("u1", "pending", 0), ("u2", "visited", 0), ("u3", "failed", 1)], "url string, status string, depth int")
    pending, seen = corpus.resume_frontier(frontier, spark.createDataFrame([("u2", "pending", 0), ("u4", "pending", 0)], "url string, status string, depth int"))
    assert {r.url for r in pending.collect()} == {"u1", "u4"} and {r.url for r in seen.collect()} == {"u2", "u3"}


def test_fetch_and_robots(spark):
    def get(url):
        return (200, "text/html; charset=utf-8", b"<p>x</p>", url) if "good" in url else (404, "text/html", b"", url) if "bad" in url else (200, "image/png", b"x", url)

    urls = spark.createDataFrame([("http://a/good",), ("http://a/bad",), ("http://a/img",)], "url string")
    assert [r.url for r in fetch.fetch(urls, get).collect()] == ["http://a/good"]
    assert fetch.read_body([b"a" * 3, b"b" * 3], 5) is None and fetch.read_body([b"a", b"b"], 5) == b"ab" and fetch.read_body(iter([b"x" * 6, 1 / 1]), 5) is None
    flaky = lambda url: (503, "text/html", b"", url)
    slept = []
    assert fetch.fetch(urls.limit(1), flaky, slept.append).count() == 0 and (fetch.RETRIES, fetch.BACKOFF_S) == (3, 0.5)
    robots = spark.createDataFrame([("a", "User-agent: *\nCrawl-delay: 2\nDisallow: /private/")], "host string, body string")
    asked = spark.createDataFrame([("http://a/x",), ("http://a/private/x",), ("http://b/private/x",), ("nohost",)], "url string")
    got = {r.url: (r.allowed, r.delay) for r in fetch.robots_verdicts(asked, robots).collect()}
    assert got == {"http://a/x": (True, 2.0), "http://a/private/x": (False, 2.0), "http://b/private/x": (True, 1.0), "nohost": (False, 1.0)}


def test_streams_equal_batch(spark, tmp_path):
    rows = spark.createDataFrame([("h", i, float(i) / 4) for i in range(8)] + [("g", 9, 0.0)], "host string, seq long, at double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    streams.append_sink(streams.politeness(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {(r.host, r.seq): r.slot for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.host, r.seq): r.slot for r in tables.politeness_slots(rows, "host", "at", ["seq"]).collect()}


def test_windowed_streams(spark, tmp_path):
    rows = spark.sql("SELECT id AS event_id, id % 2 AS user_id, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id * 20) AS ts, 'click' AS event_type FROM range(60)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = streams.with_event_time(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    for kind, make in (("rate", streams.requests_per_minute(stream, "user_id", limit=1)), ("session", streams.session_stats(stream))):
        make.writeStream.format("memory").queryName(kind).outputMode("complete" if kind == "rate" else "append").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("rate").agg(F.sum("n")).first()[0] == 60 and spark.table("rate").agg(F.max("n_allowed")).first()[0] == 1


def test_clicks_and_log(spark):
    clicks = spark.createDataFrame([("q", 1, 1), ("q", 99, 1), (None, 1, 1)], "query string, doc_id long, position int")
    assert streams.valid_clicks(clicks, spark.createDataFrame([(1,)], "doc_id long")).count() == 1
    assert json.loads(streams.log_lines(clicks.limit(1), "click").first().value)["data"]["doc_id"] == 1


def test_engine(spark):
    docs = [(1, "Python guide", "Python developers run python services"), (2, "Kubernetes", "kubernetes runs containers for python"), (3, "Cooking", "salt and pepper"), (4, "Cooking", "salt and pepper")]
    frame = spark.createDataFrame([(i, t, c, f"https://x.org/{i}") for i, t, c in docs], "doc_id long, title string, content string, url string")
    ranks = spark.createDataFrame([(1, 0.2), (2, 0.8)], "doc_id long, pagerank double")
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0])], "doc_id long, embedding array<double>")
    e = SearchEngine(frame, ranks, emb, lambda q: spark.createDataFrame([([0.0, 1.0],)], "q array<double>"))
    found = e.search("python")
    rows = found.results.collect()
    assert found.status == "ok" and {r.doc_id for r in rows} == {1, 2} and [r.rank for r in rows] == [1, 2] and "<mark>" in rows[0].snippet and rows[0].semantic_score is None
    assert [r.doc_id for r in e.search("python AND kubernetes").results.collect()] == [2]
    assert e.search("salt").total == 1  # copies collapse
    assert e.search("pyhton").did_you_mean == "python" and e.search("qqqqqqqq").unknown_words == ("qqqqqqqq",)
    assert e.search("NOT python").status == "no_results" and e.search("").status == "invalid" and e.search(None).status == "invalid"
    hybrid = {r.doc_id: r for r in e.search("python", rerank=True).results.collect()}
    assert hybrid[3].bm25_norm is None and hybrid[3].semantic_score == 1.0
    assert e.search("python", page=9).results.count() == 0 and e.search("python", page_size=99).status == "invalid"
    assert [r.word for r in e.suggest("py").collect()] == ["python"] and e.stats().first().corpus_size == 4
    assert "<mark>salt" not in e.search("pepper NOT kubernetes").results.first().snippet and "<mark>pepper</mark>" in e.search("pepper NOT kubernetes").results.first().snippet


def test_engine_on_a_saved_index(spark, tmp_path):
    frame = spark.createDataFrame([(i, "Salt", f"salt and pepper number{i}", f"https://x.org/{i}") for i in range(30)], "doc_id long, title string, content string, url string")
    ranks = spark.createDataFrame([(1, 0.2)], "doc_id long, pagerank double")
    path = str(tmp_path / "index")
    first = SearchEngine.open(frame, ranks, path, source="a")
    again = SearchEngine.open(frame.filter("false").unionByName(frame), ranks, path, source="a")
    assert first.index.postings.inputFiles() == again.index.postings.inputFiles() and first.index.deletions is not None
    for page in (1, 2, 3):
        rows = [(r["rank"], r.doc_id) for r in again.search("salt pepper", page).results.collect()]
        assert len(rows) == 10 and [r for r, _ in rows] == list(range(10 * page - 9, 10 * page + 1))
    assert again.search("slat").did_you_mean == "salt" and again.search("salt", 2).total_pages == 3
    assert SearchEngine.open(frame, ranks, path, source="b").index.postings.inputFiles() != first.index.postings.inputFiles()


def test_crawl_until_nothing_is_pending(spark, tmp_path):
    web = {"http://a/1": '<a href="/2">x</a> one', "http://a/2": '<a href="/3">x</a><a href="/1">y</a> two', "http://a/3": "  ", "http://a/4": "never linked"}

    def get(url):
        return (200, "text/html", web[url].encode(), url) if url in web else (404, "text/html", b"", url)

    store = crawl.CrawlStore(spark, str(tmp_path / "crawl"))
    seeds = spark.createDataFrame([("http://a/1", "pending", 0), ("http://a/9", "pending", 0)], crawl.FRONTIER)
    crawl.crawl(store, seeds, get)
    assert {r.url for r in store.pages().collect()} == {"http://a/1", "http://a/2"}
    assert {(r.src[-1], r.dst[-1]) for r in store.links().collect()} == {("1", "2"), ("2", "3"), ("2", "1")}
    assert {(r.url[-1], r.status, r.depth) for r in store.frontier().collect()} == {("1", "visited", 0), ("9", "failed", 0), ("2", "visited", 1), ("3", "failed", 2)}
    # A batch that was not published does not count; a seed already seen is not fetched again.
    spark.createDataFrame([("http://a/7", "t", "c", 0)], crawl.PAGES).write.parquet(f"{tmp_path}/crawl/{'0' * 32}/pages")
    crawl.crawl(crawl.CrawlStore(spark, str(tmp_path / "crawl")), seeds, lambda url: 1 / 0)
    assert store.pages().count() == 2


def test_embedding_store(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * i) for i in range(5)] + [(9, None)], "doc_id long, text string")
    seen = lambda texts: np.array([[len(t), 2.0 * len(t)] for t in texts])
    made = embeddings.embed(docs, seen, batch=2)
    got = {r.doc_id: r.embedding for r in made.collect()}
    assert got[9] == [0.0, 0.0] and abs(sum(v * v for v in got[3]) - 1) < 1e-6 and len(got) == 6
    path = str(tmp_path / "store")
    assert embeddings.load(spark, path) is None
    embeddings.save(made, path, "monday", "lengths")
    assert embeddings.load(spark, path, "monday", "lengths").count() == 6
    assert embeddings.load(spark, path, "tuesday") is None and embeddings.load(spark, path, model="others") is None


def test_page_texts(spark, tmp_path):
    assert corpus.page_texts(spark, str(tmp_path / "none")).count() == 0
    spark.createDataFrame([(1, None, "c")], "doc_id int, title string, content string").write.parquet(str(tmp_path / "pages"))
    assert [tuple(r) for r in corpus.page_texts(spark, str(tmp_path / "pages")).collect()] == [(1, "", "c")]
