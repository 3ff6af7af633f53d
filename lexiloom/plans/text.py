"""Queries on analysis and the index."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.config import QUERY_ERRORS
from lexiloom.functions import analyzers, codec
from lexiloom.operators import index
from lexiloom.session import ship_package

from .registry import BASIC, ENGINE_STOP, INDEX, LENS, POST, TOK, query, table

PROBES = ["ther", "erin", "thon"]


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def plain(spark, d):
    return index.tokens(docs(spark, d))


@query(f"SELECT doc_id, len({BASIC}) AS n_basic, len(list_filter({BASIC}, lambda x: x NOT IN ({ENGINE_STOP}))) AS n_not_engine_stop FROM documents")
def tokenize_counts(spark, d):
    basic = analyzers.basic_tokens(F.col("text"))
    kept = F.filter(basic, lambda t: ~analyzers.is_stop_word(t, analyzers.ENGINE_STOP_WORDS))
    return docs(spark, d).select("doc_id", F.size(basic).cast("long").alias("n_basic"), F.size(kept).cast("long").alias("n_not_engine_stop"))


@query(f"WITH {TOK} SELECT doc_id, len(toks) AS n, array_to_string(toks, ' ') AS tokens FROM tok")
def stopword_filter(spark, d):
    """All kept tokens of each document."""
    return plain(spark, d).select("doc_id", F.size("tokens").cast("long").alias("n"), F.array_join("tokens", " ").alias("tokens"))


@query(f"WITH {TOK} SELECT doc_id, len(toks) AS dl FROM tok")
def doc_lengths(spark, d):
    return index.doc_lengths(plain(spark, d))


@query(f"WITH {TOK}, {LENS} SELECT n_docs, round(avgdl, 6) AS avgdl FROM st")
def corpus_stats(spark, d):
    return index.corpus_stats(index.doc_lengths(plain(spark, d))).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query(f"SELECT word, count(*) AS freq FROM (SELECT unnest({BASIC}) AS word FROM documents) GROUP BY word")
def vocab_frequency(spark, d):
    return index.vocabulary(docs(spark, d))


@query(f"WITH {POST} SELECT term, count(*) AS df FROM post GROUP BY term")
def term_df(spark, d):
    return index.document_frequency(index.postings(plain(spark, d)))


@query(f"WITH {POST} SELECT term, doc_id, tf, array_to_string(positions, ',') AS positions FROM post")
def postings_tf_positions(spark, d):
    return index.postings(plain(spark, d)).select("term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(
    f"""WITH {POST}, g AS (SELECT term, doc_id, unnest(positions) AS p, unnest(range(len(positions))) AS i FROM post)
SELECT term, doc_id, string_agg(p - before, ',' ORDER BY i) AS gaps FROM (SELECT *, coalesce(lag(p) OVER (PARTITION BY term, doc_id ORDER BY i), 0) AS before FROM g) GROUP BY ALL"""
)
def gap_encode(spark, d):
    """Gaps of every posting."""
    own = index.postings(plain(spark, d))
    return own.select("term", "doc_id", F.array_join(codec.gaps(F.col("positions")).cast("array<string>"), ",").alias("gaps"))


@query(f"WITH {POST} SELECT term, doc_id, array_to_string(positions, ',') AS positions FROM post")
def gap_decode(spark, d):
    """Every posting, encoded and decoded again."""
    decoded = codec.from_gaps(codec.gaps(F.col("positions")))
    return index.postings(plain(spark, d)).select("term", "doc_id", F.array_join(decoded.cast("array<string>"), ",").alias("positions"))


@query(
    r"""SELECT doc_id, sha256(trim(regexp_replace(lower(' ' || coalesce(text, '')), '[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) AS fingerprint,
sha256(coalesce(text, '')) AS content_hash, length(coalesce(text, '')) AS n FROM documents"""
)
def fingerprint_sha(spark, d):
    text = F.coalesce("text", F.lit(""))
    flat = analyzers.fingerprint(F.lit(None).cast("string"), F.col("text"))
    return docs(spark, d).select("doc_id", F.sha2(flat, 256).alias("fingerprint"), F.sha2(text, 256).alias("content_hash"), F.length(text).alias("n"))


@query(
    f"""WITH {INDEX} SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT count(DISTINCT term) FROM post) AS n_terms, (SELECT count(*) FROM post) AS n_postings,
(SELECT sum(tf) FROM post)::BIGINT AS n_positions, (SELECT min(dl) FROM lens) AS min_dl, (SELECT max(dl) FROM lens) AS max_dl"""
)
def index_scale(spark, d):
    per_doc = plain(spark, d).select("doc_id", F.size("tokens").cast("long").alias("dl"), F.array_distinct("tokens").alias("terms"))
    sizes = per_doc.agg(
        F.count("*").alias("n_docs"), F.sum(F.size("terms").cast("long")).alias("n_postings"), F.sum("dl").alias("n_positions"), F.min("dl").alias("min_dl"), F.max("dl").alias("max_dl")
    )
    words = per_doc.select(F.explode("terms").alias("t")).distinct().agg(F.count("*").alias("n_terms"))
    return sizes.join(F.broadcast(words))


@query(
    f"""WITH {POST} SELECT term, term || ' -> [' || string_agg(format('Doc {{}}, TF={{}}, Pos=({{}})', doc_id, tf, array_to_string(positions, ',')), '; ' ORDER BY doc_id) || ']' AS line
FROM post GROUP BY term"""
)
def index_dump(spark, d):
    """The line of every term."""
    return index.dump(index.postings(plain(spark, d)))


@query(
    f"""SELECT doc_id, CASE WHEN q IS NULL THEN '{QUERY_ERRORS["missing"]}' WHEN regexp_matches(q, '[\\x00-\\x1f]') THEN '{QUERY_ERRORS["control"]}' WHEN trim(q) = '' THEN '{QUERY_ERRORS["empty"]}'
WHEN length(q) > 200 THEN '{QUERY_ERRORS["long"]}' WHEN NOT regexp_matches(q, '[\\p{{L}}\\p{{N}}]') THEN '{QUERY_ERRORS["no_word"]}' END AS problem
FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN '?!' WHEN 3 THEN 'doc ' || doc_id ELSE text END AS q FROM documents)"""
)
def query_validation(spark, d):
    """Every text as a query, some in the place of others that are null, blank, without words or right."""
    m = F.col("doc_id") % 6
    good = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    q = F.when(m == 0, F.lit(None)).when(m == 1, "  ").when(m == 2, "?!").when(m == 3, good).otherwise(F.col("text"))
    return docs(spark, d).select("doc_id", analyzers.query_error(q).alias("problem"))


@query("SELECT item_id, lower(trim(text)) AS cache_key, lower(trim(text)) || chr(31) || 'rerank' AS rerank_key FROM benchmark")
def cache_keys(spark, d):
    rows = table(spark, d, "benchmark")
    return rows.select("item_id", analyzers.cache_key(F.col("text")).alias("cache_key"), analyzers.cache_key(F.col("text"), True).alias("rerank_key"))


@query()
def engine_tokens(spark, d):
    ship_package(spark)
    return index.tokens(docs(spark, d), "engine").select("doc_id", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("tokens"))


@query()
def stemmed_vocabulary(spark, d):
    ship_package(spark)
    words = index.vocabulary(docs(spark, d)).filter(~F.col("word").isin(*analyzers.STOP_WORDS))
    return words.withColumn("stem", analyzers.stem_udf("word"))


#: Words with their stems, fixed values of the published algorithm's sample.
STEMS = (
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sized", "size"), ("hopping", "hop"),
    ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"), ("operator", "oper"), ("formality", "formal"), ("hopefulness", "hope"),
    ("triplicate", "triplic"), ("electrical", "electr"), ("revival", "reviv"), ("allowance", "allow"), ("adjustment", "adjust"), ("effective", "effect"), ("rate", "rate"),
    ("controll", "control"), ("roll", "roll"), ("running", "run"), ("sky", "sky"),
)


@query(f"SELECT * FROM (VALUES {', '.join(f"('{w}', '{t}')" for w, t in STEMS)}) v(word, stem)")
def stem_sample(spark, d):
    ship_package(spark)
    return spark.createDataFrame([(w,) for w, _ in STEMS], "word string").withColumn("stem", analyzers.stem_udf("word"))
