import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.functions import codec, web
from lexiloom.functions.analyzers import ENGINE_STOP_WORDS, STOP_WORDS, basic_tokens, query_error, stem_terms, title_from_url
from lexiloom.functions.engine_tokens import surface_tokens
from lexiloom.functions.stemmer import stem
from lexiloom.operators.spell import osa, rewrite


@pytest.mark.parametrize(
    "word,stemmed",
    [
        ("running", "run"), ("runs", "run"), ("developers", "develop"), ("kubernetes", "kubernet"), ("engineer", "engin"), ("google", "googl"), ("machine", "machin"),
        ("learning", "learn"), ("consistency", "consist"), ("consigned", "consign"), ("knocked", "knock"), ("hopping", "hop"), ("hoping", "hope"), ("skies", "sky"),
        ("dying", "die"), ("generously", "generous"), ("relational", "relat"), ("national", "nation"), ("happy", "happi"), ("say", "say"), ("cries", "cri"), ("ties", "tie"),
        ("gas", "gas"), ("kiwis", "kiwi"), ("bed", "bed"), ("controlling", "control"), ("rolled", "roll"), ("news", "news"), ("proceed", "proceed"), ("sensational", "sensat"),
    ],
)
def test_stem(word, stemmed):
    assert stem(word) == stemmed


def test_stop_word_lists():
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) == 153 and len(ENGINE_STOP_WORDS) == 109


@pytest.mark.parametrize(
    "text,words",
    [
        ("C++ is", ["C++", "is"]), ("C# is", ["C", "is"]), ("C#", ["C#"]), ("the end. ", ["the", "end"]), ("end.", ["end."]), ("word. x", ["word", "x"]), ("tar.gz", ["tar.gz"]),
        ("café", ["caf"]), ("-5 .bin", ["-5", ".bin"]), ("foo-- x", ["foo-", "x"]), ("", []), ("... --", []),
    ],
)
def test_engine_tokens(text, words):
    assert surface_tokens(text) == words


@given(st.lists(st.integers(0, 2**40)))
def test_varint_round_trip(numbers):
    r = codec.Reader(b"".join(map(codec.varint, numbers)))
    assert [r.varint() for _ in numbers] == numbers


def test_gaps_round_trip(spark):
    rows = spark.createDataFrame([([2, 5, 6],), ([],), ([0],)], "p array<int>")
    got = rows.select(codec.gaps(F.col("p")).alias("g"), codec.from_gaps(codec.gaps(F.col("p"))).alias("q"), "p").collect()
    assert got[0].g == [2, 3, 1] and all(r.q == r.p for r in got)


URLS = {
    "HTTPS://Example.COM/Path": "https://example.com/Path",
    "http://a.com:80/x": "http://a.com/x",
    "https://a.com:443/x": "https://a.com/x",
    "http://a.com:8080/x": "http://a.com:8080/x",
    "http://a.com": "http://a.com/",
    "http://a.com/x#top": "http://a.com/x",
    "http://a.com/x?utm_source=f&b=2&a=1&fbclid=9": "http://a.com/x?a=1&b=2",
    "mailto:x@y.z": None,
    "javascript:void(0)": None,
    "ftp://a.com/x": None,
    "free text": None,
    "": None,
}


def test_normalize_url(spark):
    assert {u: web.normalized(u) for u in URLS} == URLS
    rows = spark.createDataFrame([(u,) for u in URLS], "url string")
    got = {r.url: (r.a, r.b) for r in rows.select("url", web.normalize_url(F.col("url")).alias("a"), web.normalize_url_udf("url").alias("b")).collect()}
    assert got == {u: (n, n) for u, n in URLS.items()}


def test_is_crawlable(spark):
    cases = {"https://a.com/x": True, "https://a.com/x.JPG": False, "https://a.com/x.pdf": False, "https://a.com/d.zip/y": True, "https://a.com/s.css": False, "https://a.com/" + "x" * 3000: False}
    rows = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r.url: r.ok for r in rows.select("url", web.is_crawlable(F.col("url")).alias("ok")).collect()} == cases == {u: web.crawlable(u) for u in cases}
    for url, ok in {"https://sub.a.com/": True, "https://a.com/": True, "https://nota.com/": False}.items():
        assert web.crawlable(url, ("a.com",)) is ok
        assert rows.limit(1).select(web.is_crawlable(F.lit(url), ("a.com",))).first()[0] is ok


PAGE = """<html><head><title>Test Page</title><style>p{}</style></head><body><nav><a href="/nav">n</a></nav><!-- no --><p>Hello <b>world</b></p><script>var x="</p>";</script>
<a href="/rel">r</a><a href="https://other.org/p?utm_source=x">o</a><a href="mailto:a@b.c">m</a><a href="/i.png">i</a><a href="#top">t</a><a href="/self">s</a><footer>foot</footer></body></html>"""


def test_html_extract():
    got = web.extract(PAGE, "https://a.com/self")
    assert got["title"] == "Test Page" and got["links"] == ["https://a.com/rel", "https://other.org/p"]
    assert "Hello" in got["text"] and "foot" not in got["text"] and "var x" not in got["text"] and "Test Page" in got["text"]
    assert "https://a.com/nav" in web.extract(PAGE, "https://a.com/self", "all")["links"]
    assert web.extract("<h1>Head</h1>", "https://a.com/x")["title"] == "Head"
    assert web.extract('<meta property="og:title" content="Og">', "https://a.com/x")["title"] == "Og"
    assert web.extract("<p>x</p>", "https://a.com/some-page_x/")["title"] == "some page x"
    assert web.extract("", "https://a.com/")["title"] == "a.com"


def test_title_from_url(spark):
    got = spark.range(1).select(title_from_url(F.lit("https://a.com/my-page_1/")).alias("a"), title_from_url(F.lit("https://a.com/")).alias("b")).first()
    assert (got.a, got.b) == ("my page 1", "a.com")


def test_query_error(spark):
    cases = [(None, True), ("", True), ("   ", True), ("a\tb", True), ("?!", True), ("x" * 201, True), ("x" * 200, False), ("é", False)]
    got = spark.createDataFrame(cases, "q string, bad boolean").withColumn("e", query_error(F.col("q"))).collect()
    assert all((r.e is not None) == r.bad for r in got)


def test_basic_tokens_and_stem_by_vocabulary(spark):
    rows = spark.createDataFrame([(1, "Runs RUNNING café"), (2, None)], "doc_id int, text string").select("doc_id", F.explode_outer(basic_tokens(F.col("text"))).alias("term"))
    assert sorted(r.term for r in stem_terms(rows.filter("term IS NOT NULL")).collect()) == ["caf", "run", "run"]


def test_osa():
    assert osa("pyhton", "python", 2) == 1 and osa("ca", "abc", 3) == 3 and osa("abc", "abc", 2) == 0 and osa("a", "abcd", 2) == 3


def test_rewrite():
    got = rewrite('tehr AND "big wrd" NOT zzz', {"tehr": "ther", "big": "big", "wrd": "word", "zzz": None})
    assert got["corrected_query"] == 'ther AND "big word" NOT zzz' and got["unknown_words"] == ["zzz"] and got["suggestions"] == {"tehr": "ther", "wrd": "word"}
