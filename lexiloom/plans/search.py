"""Queries on retrieval, scoring, results, vectors, spelling and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiloom.config import B_GRID, BM25, ENGINE_FUSION, K1_GRID, WEIGHT_GRID, Semantic
from lexiloom.functions import analyzers
from lexiloom.operators import batch, embeddings, evaluation, index, parsing, results, retrieval, scoring, semantic, spell, versions
from lexiloom.operators.parsing import StructuredQuery
from lexiloom.session import ship_package, work_folder
from lexiloom.sources.corpus import titled

from .registry import BASIC, INDEX, LENS, POS, POST, TOK, bm25_sql, phrase_sql, query, quoted, table
from .text import PROBES, docs, plain

PHRASE = ["anea", "eriner"]


def posted(spark, d, terms=PROBES):
    return index.postings(plain(spark, d), terms)


# Retrieval


@query(f"WITH {POST} SELECT doc_id FROM post WHERE term = 'ther'")
def term_docs(spark, d):
    return retrieval.docs_for(posted(spark, d), "ther")


@query(f"WITH {POST} SELECT DISTINCT doc_id FROM post WHERE term IN ({quoted(PROBES)})")
def or_union(spark, d):
    return retrieval.any_of(posted(spark, d), PROBES)


@query(f"WITH {POST} " + " INTERSECT ".join(f"SELECT doc_id FROM post WHERE term = '{t}'" for t in PROBES))
def and_intersect(spark, d):
    return retrieval.all_of(posted(spark, d), PROBES)


@query(f"WITH {POST} SELECT doc_id FROM post WHERE term = 'ther' EXCEPT SELECT doc_id FROM post WHERE term = 'erin'")
def not_except(spark, d):
    p = posted(spark, d)
    return retrieval.without(retrieval.docs_for(p, "ther"), p, ["erin"])


@query(f"WITH {POS} {phrase_sql(PHRASE)}")
def phrase_match(spark, d):
    return retrieval.phrase(posted(spark, d, PHRASE), PHRASE)


@query(f"WITH {POS} SELECT DISTINCT doc_id FROM pos WHERE term = 'anea' EXCEPT ({phrase_sql(PHRASE)})")
def phrase_excluded(spark, d):
    p = posted(spark, d, PHRASE)
    return retrieval.docs_for(p, "anea").join(retrieval.phrase(p, PHRASE), "doc_id", "left_anti")


@query(
    f"""WITH {POS}, need AS (SELECT doc_id FROM pos WHERE term = 'ther' INTERSECT SELECT doc_id FROM pos WHERE term = 'anea'), opt AS (SELECT doc_id FROM pos WHERE term = 'thon')
(SELECT doc_id FROM need UNION SELECT doc_id FROM opt) EXCEPT SELECT doc_id FROM pos WHERE term = 'erin' INTERSECT ({phrase_sql(PHRASE)})"""
    .replace("(SELECT doc_id FROM need UNION", "SELECT doc_id FROM ((SELECT doc_id FROM need UNION").replace("'erin' INTERSECT (", "'erin') INTERSECT (")
)
def retrieve_composite(spark, d):
    q = StructuredQuery(required=["ther", "anea"], optional=["thon"], excluded=["erin"], phrases=[PHRASE])
    rows = plain(spark, d)
    return retrieval.retrieve(index.postings(rows, retrieval.terms_of(q)), rows.select("doc_id"), q)


# Scoring


def built(spark, d, terms=PROBES):
    rows = plain(spark, d)
    lengths = index.doc_lengths(rows)
    return index.postings(rows, terms), lengths, index.corpus_stats(lengths)


def scored(spark, d, terms=PROBES, params=BM25()):
    p, lengths, stats = built(spark, d, terms)
    return scoring.bm25(retrieval.any_of(p, terms), p, lengths, stats, terms, params)


CANDIDATES = f"cand AS (SELECT DISTINCT doc_id FROM post WHERE term IN ({quoted(PROBES)}))"
SCORED = f"WITH {INDEX}, {CANDIDATES}, {bm25_sql('cand', PROBES)}"
NORM = f"{SCORED}, norm AS (SELECT doc_id, bm25, CASE WHEN max(bm25) OVER () = min(bm25) OVER () THEN 1.0 ELSE (bm25 - min(bm25) OVER ()) / (max(bm25) OVER () - min(bm25) OVER ()) END AS bn FROM scored)"


@query(f"WITH {INDEX} SELECT term, count(*) AS df, round(ln((any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf FROM post CROSS JOIN st GROUP BY term")
def idf_table(spark, d):
    rows = plain(spark, d)
    df = rows.select(F.explode(F.array_distinct("tokens")).alias("term"))
    stats = index.corpus_stats(index.doc_lengths(rows))
    return scoring.idf_table(df, stats).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {INDEX}, cand AS (SELECT DISTINCT doc_id FROM post WHERE term = 'ther'), {bm25_sql('cand', ['ther'])} SELECT doc_id, round(bm25, 6) AS bm25 FROM scored")
def bm25_single(spark, d):
    return scored(spark, d, ["ther"]).select("doc_id", F.round("bm25", 6).alias("bm25"))


@query(f"{SCORED} SELECT doc_id, round(bm25, 6) AS bm25 FROM scored")
def bm25_multi(spark, d):
    return scored(spark, d).select("doc_id", F.round("bm25", 6).alias("bm25"))


@query(f"{NORM} SELECT doc_id, round(bn, 6) AS bm25_norm FROM norm")
def bm25_minmax(spark, d):
    return scoring.minmax_over(scored(spark, d), "bm25", "bm25_norm").select("doc_id", F.round("bm25_norm", 6).alias("bm25_norm"))


#: Document authority for the fusion queries: one in-link step over a rule-made link graph.
RANKS = """n AS (SELECT max(doc_id) + 1 AS n FROM documents),
edge AS (SELECT doc_id AS src, (doc_id * 7 + 3) % n AS dst FROM documents, n UNION ALL SELECT doc_id, doc_id // 3 FROM documents),
outd AS (SELECT src, count(*) AS k FROM edge GROUP BY src),
ranks AS (SELECT dst AS doc_id, 0.15 + 0.85 * sum(1.0::DOUBLE / k) AS pagerank FROM edge JOIN outd USING (src) GROUP BY dst)"""


def pr_norm(flat: str) -> str:
    return f"prn AS (SELECT doc_id, CASE WHEN max(pagerank) OVER () = min(pagerank) OVER () THEN {flat} ELSE (pagerank - min(pagerank) OVER ()) / (max(pagerank) OVER () - min(pagerank) OVER ()) END AS pn FROM ranks)"


def ranks(spark, d):
    from lexiloom.operators.graph import one_iteration

    own = table(spark, d, "documents").select("doc_id")
    n = F.broadcast(own.agg((F.max("doc_id") + 1).alias("n")))
    a = own.join(n).select(F.col("doc_id").alias("src"), ((F.col("doc_id") * 7 + 3) % F.col("n")).alias("dst"))
    b = own.select(F.col("doc_id").alias("src"), F.floor(F.col("doc_id") / 3).alias("dst"))
    return one_iteration(a.unionByName(b)).select(F.col("dst").alias("doc_id"), F.col("score").alias("pagerank"))


@query(f"WITH {RANKS}, {pr_norm('1.0')} SELECT doc_id, round(pn, 6) AS pagerank_norm FROM prn")
def pagerank_minmax(spark, d):
    return scoring.normalized_pagerank(ranks(spark, d)).select("doc_id", F.round("pagerank_norm", 6).alias("pagerank_norm"))


def fused_sql(bm25: float, pagerank: float, flat: str) -> str:
    return f"""{NORM}, {RANKS}, {pr_norm(flat)}, fused AS (SELECT doc_id, bn, coalesce(pn, 0.0) AS pn, {bm25} * bn + {pagerank} * coalesce(pn, 0.0) AS score FROM norm LEFT JOIN prn USING (doc_id))"""


@query(f"{fused_sql(0.85, 0.15, '1.0')} SELECT doc_id, round(bn, 6) AS bm25_norm, round(pn, 6) AS pagerank_norm, 0.0 AS phrase_bonus, round(score, 6) AS score FROM fused")
def fused_server(spark, d):
    out = scoring.fuse(scored(spark, d), ranks(spark, d))
    return out.select("doc_id", *(F.round(c, 6).alias(c) for c in ("bm25_norm", "pagerank_norm", "phrase_bonus", "score")))


@query(f"{fused_sql(0.7, 0.3, '0.0')} SELECT doc_id, round(score, 6) AS score FROM fused")
def fused_engine(spark, d):
    return scoring.fuse(scored(spark, d), ranks(spark, d), weights=ENGINE_FUSION).select("doc_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {POS}, hit AS ({phrase_sql(PHRASE)}), {RANKS}, {pr_norm('1.0')}
SELECT row_number() OVER (ORDER BY round(s, 9) DESC, doc_id) AS rank, doc_id, round(s, 6) AS score FROM (SELECT doc_id, 0.85 + 0.15 * coalesce(pn, 0.0) + 2.0 AS s FROM hit LEFT JOIN prn USING (doc_id))
QUALIFY rank <= 20"""
)
def phrase_only_rank(spark, d):
    p = posted(spark, d, PHRASE)
    found = retrieval.phrase(p, PHRASE)
    fused = scoring.fuse(found.withColumn("bm25", F.lit(0.0)), ranks(spark, d), found)
    return results.top(fused, 20).select("rank", "doc_id", F.round("score", 6).alias("score"))


# Results


@query(f"{SCORED} SELECT row_number() OVER (ORDER BY round(bm25, 9) DESC, doc_id) AS rank, doc_id, round(bm25, 6) AS score FROM scored QUALIFY rank <= 20")
def search_topk(spark, d):
    return results.top(scored(spark, d), 20, "bm25").select("rank", "doc_id", F.round("bm25", 6).alias("score"))


@query(f"{SCORED} SELECT row_number() OVER (ORDER BY round(bm25, 9) DESC, doc_id) AS rank, doc_id, round(bm25, 6) AS score FROM scored QUALIFY rank <= 20")
def saved_index_topk(spark, d):
    """The same search on an index that was saved: only the row groups of its terms are read."""
    path = f"{work_folder(spark)}/index-{uuid.uuid4().hex}"
    index.Index.build(docs(spark, d)).save(path)
    own = index.Index.load(spark, path)
    p = own.postings.filter(F.col("term").isin(PROBES))
    found = scoring.bm25(retrieval.any_of(p, PROBES), p, own.lengths, own.stats, PROBES)
    return results.top(found, 20, "bm25").select("rank", "doc_id", F.round("bm25", 6).alias("score"))


@query(f"{SCORED} SELECT doc_id, row_number() OVER (ORDER BY round(bm25, 9) DESC, doc_id) AS rank FROM scored")
def search_all_ranks(spark, d):
    """The rank of every hit."""
    return results.ranked(scored(spark, d), "bm25").select("doc_id", "rank")


FINGER = r"sha256(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')))"


@query(
    f"""{SCORED} SELECT doc_id, round(bm25, 6) AS score FROM scored JOIN (SELECT doc_id, {FINGER} AS f FROM documents) USING (doc_id)
QUALIFY row_number() OVER (PARTITION BY f ORDER BY round(bm25, 9) DESC, doc_id) = 1"""
)
def dedup_documents(spark, d):
    flat = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " "))
    own = scored(spark, d).withColumnRenamed("bm25", "score").join(docs(spark, d), "doc_id")  # hits first, then their fingerprints
    own = own.withColumn("fingerprint", F.sha2(flat, 256)).drop("text")
    return results.collapse(own).select("doc_id", F.round("score", 6).alias("score"))


@query(
    f"""{SCORED} SELECT row_number() OVER (ORDER BY round(bm25, 9) DESC, doc_id) AS rank, doc_id, (SELECT count(*) FROM scored) AS total_results,
(SELECT ceil(count(*) / 10)::BIGINT FROM scored) AS total_pages FROM scored QUALIFY rank BETWEEN 11 AND 20"""
)
def paginate_page2(spark, d):
    own = scored(spark, d).withColumnRenamed("bm25", "score")
    return results.page(own, 2, 10).join(F.broadcast(results.total_pages(own))).select("rank", "doc_id", "total_results", "total_pages")


@query(f"SELECT word, count(*) AS freq FROM (SELECT unnest({BASIC}) AS word FROM documents) WHERE starts_with(word, 'th') GROUP BY word ORDER BY freq DESC, word LIMIT 10")
def suggest_prefix(spark, d):
    return results.suggest(index.vocabulary(docs(spark, d)), " TH ", 10)


MATCH = f"len(list_intersect(regexp_extract_all(lower(w), '[a-z0-9]+'), [{quoted(PROBES)}])) > 0"


@query(
    f"""{SCORED}, best AS (SELECT doc_id FROM scored ORDER BY round(bm25, 9) DESC, doc_id LIMIT 10),
ws AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+') AS ws FROM best JOIN documents USING (doc_id)),
f AS (SELECT doc_id, ws, list_position(list_transform(ws, lambda w: {MATCH}), true) - 1 AS hit FROM ws),
b AS (SELECT doc_id, ws, CASE WHEN hit >= 0 THEN greatest(hit - 12, 0) ELSE 0 END AS s, least(CASE WHEN hit >= 0 THEN hit + 13 ELSE 24 END, len(ws)) AS e FROM f)
SELECT doc_id, CASE WHEN s > 0 THEN '...' ELSE '' END || array_to_string(list_transform(ws[s + 1:e], lambda w: CASE WHEN {MATCH} THEN '<mark>' || w || '</mark>' ELSE w END), ' ')
|| CASE WHEN e < len(ws) THEN '...' ELSE '' END AS snippet FROM b"""
)
def snippet_window(spark, d):
    best = results.top(scored(spark, d), 10, "bm25").select("doc_id")
    mark = lambda w: F.arrays_overlap(F.regexp_extract_all(F.lower(w), F.lit("([a-z0-9]+)"), 1), F.array(*map(F.lit, PROBES)))
    return docs(spark, d).join(F.broadcast(best), "doc_id").select("doc_id", results.snippet(F.col("text"), mark).alias("snippet"))


@query("SELECT doc_id, split_part(text, chr(10), 1)[1:500] AS title, 'doc ' || doc_id AS fallback FROM documents")
def title_fallback(spark, d):
    return titled(table(spark, d, "documents")).select("doc_id", "title", analyzers.title_from_url(F.col("url")).alias("fallback"))


# Vectors


SIM = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
SIMS = f"sims AS (SELECT e.vec_id AS doc_id, {SIM} AS sim FROM embeddings e CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


def sims(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return semantic.similarities(e, e.filter("doc_id = 0").select(F.col("embedding").alias("q")))


@query(f"WITH {SIMS} SELECT row_number() OVER (ORDER BY round(sim, 9) DESC, doc_id) AS rank, doc_id, round(sim, 6) AS sim FROM sims QUALIFY rank <= 20")
def cosine_topk(spark, d):
    return results.top(sims(spark, d), 20, "sim").select("rank", "doc_id", F.round("sim", 6).alias("sim"))


@query(f"{SCORED}, {SIMS} SELECT doc_id, round(sim, 6) AS sim FROM sims ANTI JOIN scored USING (doc_id) ORDER BY round(sim, 9) DESC, doc_id LIMIT 15")
def augment_antijoin(spark, d):
    return semantic.augment(sims(spark, d), scored(spark, d), 15).select("doc_id", F.round("sim", 6).alias("sim"))


HYBRID = f"""{SCORED}, {SIMS}, ranked AS (SELECT doc_id, bm25, row_number() OVER (ORDER BY round(bm25, 9) DESC, doc_id) AS rank FROM scored),
aug AS (SELECT doc_id, sim FROM sims WHERE doc_id NOT IN (SELECT doc_id FROM ranked) ORDER BY round(sim, 9) DESC, doc_id LIMIT 15),
pool AS (SELECT doc_id, bm25 AS base, coalesce(sim, 0.0) AS sim FROM ranked LEFT JOIN sims USING (doc_id) WHERE rank <= 30 UNION ALL SELECT doc_id, NULL, sim FROM aug),
b AS (SELECT min(base) AS bl, max(base) AS bh, min(sim) AS sl, max(sim) AS sh, count(*) AS np FROM pool),
n AS (SELECT doc_id, base, CASE WHEN sh = sl THEN 1.0 ELSE (sim - sl) / (sh - sl) END AS sn, CASE WHEN bh = bl THEN 1.0 ELSE (base - bl) / (bh - bl) END AS bn FROM pool CROSS JOIN b)"""


def blend_sql(weight: str) -> str:
    return f"CASE WHEN base IS NULL THEN sn ELSE (1 - {weight}) * bn + {weight} * sn END"


@query(
    f"""{HYBRID}, x AS (SELECT doc_id, sn, base IS NULL AS is_augmented, {blend_sql('0.7')} AS score FROM n)
SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS position, round(score, 6) AS score, round(sn, 6) AS semantic_score, is_augmented FROM x
UNION ALL SELECT doc_id, rank - 30 + np, round(bm25, 6), NULL, false FROM ranked CROSS JOIN b WHERE rank > 30"""
)
def hybrid_rerank(spark, d):
    ranked = results.ranked(scored(spark, d).withColumnRenamed("bm25", "score"))
    out = semantic.rerank(ranked, sims(spark, d), Semantic())
    return out.select("doc_id", "position", F.round("score", 6).alias("score"), F.round("semantic_score", 6).alias("semantic_score"), "is_augmented")


# Spelling

MISSPELT = ["thre", "tehr", "erni", "thonn", "zzzzqqq", "ther"]
VOCAB = f"vocab AS (SELECT word, count(*) AS freq FROM (SELECT unnest({BASIC}) AS word FROM documents) GROUP BY word)"
SPELL = f"WITH {VOCAB}, w AS (SELECT unnest([{quoted(MISSPELT)}]) AS word), c AS (SELECT w.word, v.word AS term, freq, damerau_levenshtein(w.word, v.word) AS dist FROM w JOIN vocab v ON damerau_levenshtein(w.word, v.word) <= 2)"


def misspelt(spark):
    return spark.createDataFrame([(w,) for w in MISSPELT], "word string")


#: Optimal string alignment, a row of the table at a time; unrestricted edit distance is never larger, and so has found the pairs.
OSA = f"""{SPELL.replace("WITH", "WITH RECURSIVE", 1)},
rows AS (
  SELECT word, term, freq, 0 AS i, NULL::INT[] AS before, range(len(term) + 1)::INT[] AS last FROM c
  UNION ALL
  SELECT word, term, freq, i + 1, last, list_reduce(
    list_transform(range(1, len(term) + 1), lambda j: [j::INT]),
    lambda acc, x: list_append(acc, least(
      acc[x[1]] + 1, last[x[1] + 1] + 1, last[x[1]] + CASE WHEN word[i + 1] = term[x[1]] THEN 0 ELSE 1 END,
      CASE WHEN i > 0 AND x[1] > 1 AND word[i + 1] = term[x[1] - 1] AND word[i] = term[x[1]] THEN before[x[1] - 1] + 1 ELSE 1000 END)),
    [i::INT + 1])
  FROM rows WHERE i < len(word)),
osa AS (SELECT word, term, freq, last[-1] AS dist FROM rows WHERE i = len(word) AND last[-1] <= 2)"""


@query(f"{OSA} SELECT word, term, freq, dist FROM osa")
def osa_candidates(spark, d):
    """All candidates up to ``EDIT_DISTANCE``."""
    ship_package(spark)
    return spell.candidates(misspelt(spark), index.vocabulary(docs(spark, d)))


@query(f"{OSA}, b AS (SELECT word, term FROM osa QUALIFY row_number() OVER (PARTITION BY word ORDER BY dist, freq DESC, term) = 1) SELECT w.word, b.term AS correction FROM w LEFT JOIN b USING (word)")
def spell_best(spark, d):
    ship_package(spark)
    return spell.best(misspelt(spark), index.vocabulary(docs(spark, d)))


@query()
def spell_rewrite(spark, d):
    ship_package(spark)
    texts = ['tehr AND "erni thonn" NOT zzzzqqq', "thre OR ther", "state-of-art ther"]
    words = sorted({w for t in texts for w in spell.words_of(t)})
    fixed = spell.best(spark.createDataFrame([(w,) for w in words], "word string"), index.vocabulary(docs(spark, d)))
    known = {r["word"]: r["correction"] for r in fixed.collect()}  # the words of three queries
    rows = [spell.rewrite(t, known) for t in texts]
    return spark.createDataFrame([(t, r["corrected_query"], r["unknown_words"]) for t, r in zip(texts, rows, strict=True)], "query string, corrected_query string, unknown_words array<string>")


@query()
def parse_query_batch(spark, d):
    """Every benchmark text as a query: by turns all words required, the text as a phrase, its last word excluded."""
    ship_package(spark)
    text, kind = F.trim("text"), F.pmod("item_id", F.lit(3))
    query = (
        F.when(kind == 0, F.regexp_replace(text, r"\s+", " AND "))
        .when(kind == 1, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit(" ")), F.lit('"')))
        .otherwise(F.regexp_replace(text, r"\s+(\S+)$", " NOT $1"))
    )
    rows = table(spark, d, "benchmark").select("item_id", query.alias("query"))
    return parsing.searchable(parsing.parse_table(rows)).select("item_id", "query", "parsed.*")


#: Queries with what they are parsed to; the words have no other stem.
PARSED = (
    ("sky AND rat", "sky rat", "", "", "", ""),
    ("sky rat", "", "sky rat", "", "", ""),
    ("sky OR rat NOT dog", "", "sky rat", "dog", "", ""),
    ("sky AND rat fox NOT dog bird OR hen", "sky rat fox", "hen", "dog bird", "", ""),
    ('"red fox" sky NOT "blue bird"', "", "sky", "", "red fox", "blue bird"),
    ('sky AND "red fox"', "sky", "", "", "red fox", ""),
    ("NOT dog", "", "", "dog", "", ""),
    ("the AND", "", "", "", "", ""),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"({', '.join(repr(x) for x in row)})" for row in PARSED) + ") v(query, required, optional, excluded, phrases, excluded_phrases)")
def parse_sample(spark, d):
    ship_package(spark)
    rows = spark.createDataFrame([(q,) for q, *_ in PARSED], "query string")
    joined = [F.array_join(f"parsed.{c}", " ").alias(c) for c in ("required", "optional", "excluded")]
    phrases = [F.array_join(F.flatten(f"parsed.{c}"), " ").alias(c) for c in ("phrases", "excluded_phrases")]
    return parsing.parse_table(rows).select("query", *joined, *phrases)


@query()
def stemmed_search(spark, d):
    ship_package(spark)
    own = index.Index.build(docs(spark, d), "query")
    terms = parsing.parse("thing OR reading OR ther").scored_terms
    p = own.postings.filter(F.col("term").isin(terms))
    out = scoring.bm25(retrieval.any_of(p, terms), p, own.lengths, own.stats, terms)
    return results.top(out, 20, "bm25").select("rank", "doc_id", F.round("bm25", 6).alias("score"))


# Evaluation: two query kinds over the probes, relevant where the label says good

EVAL = [("q1", "lexical", ["ther", "erin"]), ("q2", "lexical", ["thon"]), ("q3", "semantic", ["anea", "eriner"]), ("q4", "semantic", ["zzzz"])]
EVAL_TERMS = sorted({t for _, _, ts in EVAL for t in ts})
QTERMS = "qt AS (SELECT * FROM (VALUES " + ", ".join(f"('{q}', '{k}', '{t}')" for q, k, ts in EVAL for t in ts) + ") v(query_id, qtype, term))"


def eval_scored_sql(k1: str = "1.2", b: str = "0.75", extra: str = "", by: str = "") -> str:
    return f"""es AS (SELECT query_id, any_value(qtype) AS qtype, p.doc_id{by}, sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))) AS score
FROM qt JOIN post p USING (term) JOIN (SELECT term, count(*) AS df FROM post GROUP BY term) x USING (term) JOIN lens l ON l.doc_id = p.doc_id CROSS JOIN st {extra} GROUP BY query_id, p.doc_id{by})"""


def metric_sql(by: str = "") -> str:
    return f"""er AS (SELECT *, row_number() OVER (PARTITION BY query_id{by} ORDER BY round(score, 9) DESC, doc_id) AS rank FROM es),
rel AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), nrel AS (SELECT count(*) AS m FROM rel),
em AS (SELECT query_id{by}, sum(CASE WHEN rank <= 10 AND r.doc_id IS NOT NULL THEN 1 ELSE 0 END) / sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS p_at_k,
  coalesce(1.0 / min(CASE WHEN r.doc_id IS NOT NULL THEN rank END), 0.0)::DOUBLE AS mrr,
  sum(CASE WHEN rank <= 10 AND r.doc_id IS NOT NULL THEN 1 / log2(rank + 1) ELSE 0.0 END) / (SELECT sum(1 / log2(i + 1)) FROM range(1, (SELECT least(m, 10) + 1 FROM nrel)) t(i)) AS ndcg_at_k
  FROM er LEFT JOIN rel r ON r.doc_id = er.doc_id GROUP BY query_id{by})"""


QS = "qs AS (SELECT DISTINCT query_id, qtype FROM qt)"
PER_QUERY = f"WITH {INDEX}, {QTERMS}, {QS}, {eval_scored_sql()}, {metric_sql()}, pq AS (SELECT query_id, qtype, coalesce(p_at_k, 0.0) AS p_at_k, coalesce(mrr, 0.0) AS mrr, coalesce(ndcg_at_k, 0.0) AS ndcg_at_k FROM qs LEFT JOIN em USING (query_id))"


def query_terms(spark):
    return spark.createDataFrame([(q, k, t) for q, k, ts in EVAL for t in ts], "query_id string, qtype string, term string")


def eval_hits(spark, d):
    """``query_id, qtype, doc_id, tf, dl, idf, avgdl``: all queries in one plan; the query terms are a handful."""
    p, lengths, stats = built(spark, d, EVAL_TERMS)
    weights = F.broadcast(scoring.idf_table(p, stats))
    return (
        p.select("term", "doc_id", "tf").join(weights, "term").join(F.broadcast(query_terms(spark)), "term").join(lengths, "doc_id").join(F.broadcast(stats.select("avgdl")))
    )


def eval_ranked(spark, d):
    one = F.col("idf") * scoring.term_score(F.col("tf"), F.col("dl"), F.col("avgdl"), 1.2, 0.75)
    return evaluation.first_rank(eval_hits(spark, d).groupBy("query_id", "doc_id").agg(F.sum(one).alias("score")))


def judged(spark, d):
    good = table(spark, d, "labels").filter("quality = 1").select("doc_id").distinct()
    return good.join(F.broadcast(query_terms(spark).select("query_id").distinct()))


def eval_metrics(spark, d):
    kinds = query_terms(spark).select("query_id", "qtype").distinct()
    return evaluation.metrics(eval_ranked(spark, d), judged(spark, d), kinds).join(F.broadcast(kinds), "query_id")


@query(f"{PER_QUERY} SELECT query_id, round(p_at_k, 6) AS p_at_k FROM pq")
def precision_at_10(spark, d):
    return eval_metrics(spark, d).select("query_id", F.round("p_at_k", 6).alias("p_at_k"))


@query(f"{PER_QUERY} SELECT query_id, round(mrr, 6) AS mrr FROM pq")
def mrr(spark, d):
    return eval_metrics(spark, d).select("query_id", F.round("mrr", 6).alias("mrr"))


@query(f"{PER_QUERY} SELECT query_id, round(ndcg_at_k, 6) AS ndcg FROM pq")
def ndcg_at_10(spark, d):
    return eval_metrics(spark, d).select("query_id", F.round("ndcg_at_k", 6).alias("ndcg"))


@query(f"{PER_QUERY} SELECT coalesce(qtype, 'overall') AS qtype, count(*) AS n, round(avg(p_at_k), 6) AS p_at_k, round(avg(mrr), 6) AS mrr, round(avg(ndcg_at_k), 6) AS ndcg_at_k FROM pq GROUP BY ROLLUP (qtype)")
def eval_summary(spark, d):
    out = evaluation.summary(eval_metrics(spark, d))
    return out.select("qtype", "n", *(F.round(c, 6).alias(c) for c in ("p_at_k", "mrr", "ndcg_at_k")))


#: Judgments as rules written by hand: parts of titles, and categories.
TITLE_RULES, SOURCE_RULES = [("q1", "ther"), ("q2", "THON"), ("q3", "anea")], [("q1", "src1"), ("q2", "src2")]


@query("SELECT DISTINCT query_id, doc_id FROM documents JOIN (VALUES " + ", ".join(f"('{q}', '{p}')" for q, p in TITLE_RULES) + ") r(query_id, part) ON contains(lower(split_part(text, chr(10), 1)[1:500]), lower(part))")
def judgments_by_title(spark, d):
    return evaluation.judged_by_title(titled(table(spark, d, "documents")), spark.createDataFrame(TITLE_RULES, "query_id string, part string"))


@query("SELECT DISTINCT query_id, doc_id FROM documents JOIN (VALUES " + ", ".join(f"('{q}', '{p}')" for q, p in SOURCE_RULES) + ") r(query_id, source) USING (source)")
def judgments_by_category(spark, d):
    return evaluation.judged_by_category(table(spark, d, "documents"), spark.createDataFrame(SOURCE_RULES, "query_id string, category string"), "source")


#: Queries as they are typed, one of them misspelt, through the whole pipeline.
TYPED = [("q1", "ther erin"), ("q2", "ther AND anea NOT erin"), ("q3", '"anea eriner"'), ("q4", "tehr"), ("q5", "?!")]
PIPELINE = f"""{OSA}, {INDEX}, {RANKS}, {pr_norm('1.0')},
fix AS (SELECT arg_min(term, (dist, -freq, term)) AS word FROM osa WHERE word = 'tehr'),
has AS (SELECT DISTINCT doc_id, term FROM post),
cand AS (
  SELECT DISTINCT 'q1' AS query_id, doc_id FROM has WHERE term IN ('ther', 'erin')
  UNION ALL (SELECT 'q2', doc_id FROM (SELECT doc_id FROM has WHERE term = 'ther' INTERSECT SELECT doc_id FROM has WHERE term = 'anea' EXCEPT SELECT doc_id FROM has WHERE term = 'erin'))
  UNION ALL (SELECT 'q3', doc_id FROM ({phrase_sql(PHRASE)}))
  UNION ALL (SELECT 'q4', doc_id FROM has JOIN fix ON term = word)),
qterm AS (SELECT * FROM (VALUES ('q1', 'ther'), ('q1', 'erin'), ('q2', 'ther'), ('q2', 'anea')) v(query_id, term) UNION ALL SELECT 'q4', word FROM fix),
hit AS (SELECT query_id, p.doc_id, sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s
  FROM qterm JOIN post p USING (term) JOIN (SELECT term, count(*) AS df FROM post GROUP BY term) x USING (term) JOIN lens l ON l.doc_id = p.doc_id CROSS JOIN st GROUP BY query_id, p.doc_id),
sc AS (SELECT c.query_id, c.doc_id, coalesce(s, 0.0) AS bm25 FROM cand c LEFT JOIN hit h ON h.query_id = c.query_id AND h.doc_id = c.doc_id),
nm AS (SELECT query_id, doc_id, CASE WHEN max(bm25) OVER w = min(bm25) OVER w THEN 1.0 ELSE (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) END AS bn FROM sc WINDOW w AS (PARTITION BY query_id)),
lex AS (SELECT query_id, doc_id, 0.85 * bn + 0.15 * coalesce(pn, 0.0) + CASE WHEN query_id = 'q3' THEN 2.0 ELSE 0.0 END AS score FROM nm LEFT JOIN prn USING (doc_id)),
lexr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM lex)"""


def typed_hits(spark, d):
    ship_package(spark)
    queries = spark.createDataFrame(TYPED, "query_id string, query string")
    return batch.lexical(queries, index.Index.build(docs(spark, d)), ranks(spark, d), parsing.plain)


@query(f"{PIPELINE} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM lexr")
def eval_pipeline(spark, d):
    return typed_hits(spark, d).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    f"""{PIPELINE}, sims AS (SELECT q.query_id, e.vec_id AS doc_id, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sim FROM embeddings e
CROSS JOIN (SELECT 'q' || (vec_id + 1) AS query_id, embedding FROM embeddings WHERE vec_id < 5) q),
others AS (SELECT s.query_id, s.doc_id, sim, row_number() OVER (PARTITION BY s.query_id ORDER BY round(sim, 9) DESC, s.doc_id) AS nth FROM sims s ANTI JOIN lex l ON l.query_id = s.query_id AND l.doc_id = s.doc_id),
pool AS (SELECT l.query_id, l.doc_id, score AS base, coalesce(sim, 0.0) AS sim FROM lexr l LEFT JOIN sims s ON s.query_id = l.query_id AND s.doc_id = l.doc_id WHERE rank <= 30
  UNION ALL SELECT query_id, doc_id, NULL, sim FROM others WHERE nth <= CASE WHEN query_id IN (SELECT query_id FROM lex) THEN 15 ELSE 30 END),
normed AS (SELECT *, CASE WHEN max(sim) OVER w = min(sim) OVER w THEN 1.0 ELSE (sim - min(sim) OVER w) / (max(sim) OVER w - min(sim) OVER w) END AS sn,
  CASE WHEN max(base) OVER w = min(base) OVER w THEN 1.0 ELSE (base - min(base) OVER w) / (max(base) OVER w - min(base) OVER w) END AS bn FROM pool WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, doc_id, CASE WHEN base IS NULL THEN sn ELSE 0.3::DOUBLE * bn + 0.7::DOUBLE * sn END AS score FROM normed)
SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f"""
)
def semantic_pipeline(spark, d):
    """The typed queries re-ranked by meaning; the fifth has nothing to search for, and finds by meaning alone."""
    e = table(spark, d, "embeddings")
    asked = e.filter("vec_id < 5").select(F.concat(F.lit("q"), (F.col("vec_id") + 1).cast("string")).alias("query_id"), F.col("embedding").alias("q"))
    sims = e.join(F.broadcast(asked)).select("query_id", F.col("vec_id").alias("doc_id"), semantic.dot(F.col("embedding"), F.col("q")).alias("sim"))
    return batch.semantic(typed_hits(spark, d), sims).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {SIMS} SELECT row_number() OVER (ORDER BY round(sim, 9) DESC, doc_id) AS rank, doc_id, round(sim, 6) AS sim FROM sims QUALIFY rank <= 20")
def embedding_store_topk(spark, d):
    """The embeddings saved with the state of their source, loaded while it holds, and searched."""
    e, path = table(spark, d, "embeddings"), f"{work_folder(spark)}/embeddings-{uuid.uuid4().hex}"
    state = versions.source_state(e)
    embeddings.save(e.select(F.col("vec_id").alias("doc_id"), "embedding"), path, state)
    stored = embeddings.load(spark, path, state)
    found = semantic.similarities(stored, stored.filter("doc_id = 0").select(F.col("embedding").alias("q")))
    return results.top(found, 20, "sim").select("rank", "doc_id", F.round("sim", 6).alias("sim"))


@query()
def eval_report(spark, d):
    return evaluation.report(eval_metrics(spark, d))


GRID = f"(SELECT * FROM (VALUES {', '.join(f'({k}::DOUBLE)' for k in K1_GRID)}) a(k1) CROSS JOIN (VALUES {', '.join(f'({b}::DOUBLE)' for b in B_GRID)}) c(b)) g"


@query(
    f"WITH {INDEX}, {QTERMS}, {QS}, {eval_scored_sql('k1', 'b', f'CROSS JOIN {GRID}', ', k1, b')}, {metric_sql(', k1, b')} "
    f"SELECT k1, b, round(sum(coalesce(ndcg_at_k, 0.0)) / {len(EVAL)}, 6) AS mean_ndcg FROM em GROUP BY k1, b"
)
def grid_k1_b(spark, d):
    """The parameter grid is a fixed set of 35 rows beside the hits; all settings are ranked in one plan."""
    grid = spark.createDataFrame([(k, b) for k in K1_GRID for b in B_GRID], "k1 double, b double")
    one = F.col("idf") * scoring.term_score(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("k1"), F.col("b"))
    own = eval_hits(spark, d).join(F.broadcast(grid)).groupBy("query_id", "doc_id", "k1", "b").agg(F.sum(one).alias("score"))
    w = Window.partitionBy("query_id", "k1", "b").orderBy(F.desc(F.round("score", 9)), "doc_id")
    own = own.withColumn("rank", F.row_number().over(w)).filter("rank <= 10")
    good = table(spark, d, "labels").filter("quality = 1").select("doc_id").distinct()
    ideal = good.agg(F.least(F.count("*"), F.lit(10)).cast("int").alias("m"))
    gain = own.join(good.withColumn("rel", F.lit(1)), "doc_id", "left").groupBy("k1", "b").agg(F.sum(F.when(F.col("rel") == 1, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    best = F.aggregate(F.sequence(F.lit(1), F.col("m")), F.lit(0.0), lambda acc, i: acc + 1.0 / F.log2(i + 1.0))
    return gain.join(F.broadcast(ideal)).select("k1", "b", F.round(F.col("dcg") / best / len(EVAL), 6).alias("mean_ndcg"))


@query(
    f"WITH {INDEX}, {QTERMS}, {QS}, {eval_scored_sql('k1', 'b', f'CROSS JOIN {GRID}', ', k1, b')}, {metric_sql(', k1, b')}, "
    f"g AS (SELECT k1, b, sum(coalesce(ndcg_at_k, 0.0)) / {len(EVAL)} AS m FROM em GROUP BY k1, b) SELECT k1, b, round(m, 6) AS mean_ndcg FROM g ORDER BY round(m, 6) DESC, k1, b LIMIT 1"
)
def grid_best(spark, d):
    """The best setting of the grid; of equals the first in its order."""
    return evaluation.grid_best(grid_k1_b(spark, d), ["k1", "b"], "mean_ndcg").select("k1", "b", F.col("mean").alias("mean_ndcg"))


WEIGHTED = (
    f"{HYBRID}, g AS (SELECT unnest([{', '.join(map(str, WEIGHT_GRID))}])::DOUBLE AS weight), "
    f"y AS (SELECT weight, doc_id, row_number() OVER (PARTITION BY weight ORDER BY round({blend_sql('weight')}, 9) DESC, doc_id) AS rank FROM n CROSS JOIN g), "
    "rel AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), ideal AS (SELECT sum(1 / log2(i + 1)) AS best FROM range(1, (SELECT least(count(*), 10) + 1 FROM rel)) t(i)), "
    "w AS (SELECT weight, count(rel.doc_id) AS relevant_in_10, round(sum(CASE WHEN rel.doc_id IS NOT NULL THEN 1 / log2(rank + 1) ELSE 0.0 END) / (SELECT best FROM ideal), 6) AS ndcg "
    "FROM y LEFT JOIN rel USING (doc_id) WHERE rank <= 10 GROUP BY weight)"
)


@query(f"{WEIGHTED} SELECT * FROM w")
def grid_semantic_weight(spark, d):
    """nDCG in the first ten for each weight of the similarity."""
    first = semantic.rerank(results.head_and_rest(scored(spark, d).withColumnRenamed("bm25", "score"), Semantic().top_k), sims(spark, d), Semantic(weight=0.0))  # the base score alone; the similarity is beside it
    pool = first.filter("semantic_score IS NOT NULL").join(F.broadcast(spark.createDataFrame([(w,) for w in WEIGHT_GRID], "weight double")))
    blended = F.when(F.col("is_augmented"), F.col("semantic_score")).otherwise((1 - F.col("weight")) * F.col("score") + F.col("weight") * F.col("semantic_score"))
    w = Window.partitionBy("weight").orderBy(F.desc(F.round(blended, 9)), "doc_id")
    top = pool.withColumn("rank", F.row_number().over(w)).filter("rank <= 10")
    good = table(spark, d, "labels").filter("quality = 1").select("doc_id").distinct()
    ideal = F.broadcast(good.agg(F.least(F.count("*"), F.lit(10)).cast("int").alias("m")))
    best = F.aggregate(F.sequence(F.lit(1), F.col("m")), F.lit(0.0), lambda acc, i: acc + 1.0 / F.log2(i + 1.0))
    gain = F.sum(F.when(F.col("rel") == 1, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    found = top.join(good.withColumn("rel", F.lit(1)), "doc_id", "left").groupBy("weight").agg(F.count("rel").alias("relevant_in_10"), gain.alias("dcg"))
    return found.join(ideal).select("weight", "relevant_in_10", F.round(F.col("dcg") / best, 6).alias("ndcg"))


@query(f"{WEIGHTED} SELECT weight, ndcg FROM w ORDER BY ndcg DESC, weight LIMIT 1")
def semantic_weight_best(spark, d):
    return evaluation.grid_best(grid_semantic_weight(spark, d), ["weight"], "ndcg").select("weight", F.col("mean").alias("ndcg"))


EXAMPLES = f"""WITH {INDEX}, {QTERMS}, {eval_scored_sql()}, {RANKS}, {pr_norm('1.0')},
ex AS (SELECT query_id, es.doc_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS bm25_norm,
  coalesce(pn, 0.0) AS pagerank_norm, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS label
  FROM es LEFT JOIN prn ON prn.doc_id = es.doc_id LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = es.doc_id WINDOW w AS (PARTITION BY query_id)),
wt AS (SELECT *, (SELECT count(*) FROM ex) / (2.0 * count(*) OVER (PARTITION BY label)) AS weight FROM ex)"""


def examples(spark, d):
    own = scoring.minmax_over(eval_ranked(spark, d), "score", "bm25_norm", ["query_id"])
    norm = scoring.normalized_pagerank(ranks(spark, d)).select("doc_id", "pagerank_norm")
    good = table(spark, d, "labels").filter("quality = 1").select("doc_id").distinct().withColumn("label", F.lit(1))
    out = own.join(norm, "doc_id", "left").join(good, "doc_id", "left")
    return out.select("query_id", "doc_id", "bm25_norm", F.coalesce("pagerank_norm", F.lit(0.0)).alias("pagerank_norm"), F.coalesce("label", F.lit(0)).alias("label"))


@query(f"{EXAMPLES} SELECT query_id, doc_id, round(bm25_norm, 6) AS bm25_norm, round(pagerank_norm, 6) AS pagerank_norm, label FROM ex")
def train_examples(spark, d):
    return examples(spark, d).select("query_id", "doc_id", F.round("bm25_norm", 6).alias("bm25_norm"), F.round("pagerank_norm", 6).alias("pagerank_norm"), "label")


@query(f"{EXAMPLES} SELECT label, count(*) AS n, round(any_value(weight), 6) AS weight FROM wt GROUP BY label")
def sample_weights(spark, d):
    return evaluation.sample_weights(examples(spark, d)).groupBy("label").agg(F.count("*").alias("n"), F.round(F.first("weight"), 6).alias("weight"))


MOMENTS = {"sw": "weight", "sx": "weight*bm25_norm", "sz": "weight*pagerank_norm", "sy": "weight*label", "sxx": "weight*bm25_norm*bm25_norm", "szz": "weight*pagerank_norm*pagerank_norm",
           "sxz": "weight*bm25_norm*pagerank_norm", "sxy": "weight*bm25_norm*label", "szy": "weight*pagerank_norm*label"}


@query(f"{EXAMPLES} SELECT {', '.join(f'round(sum({v}), 5) AS {k}' for k, v in MOMENTS.items())} FROM wt")
def ridge_moments(spark, d):
    m = evaluation.ridge_moments(evaluation.sample_weights(examples(spark, d)))
    return m.select(*(F.round(c, 5).alias(c) for c in m.columns))


@query()
def fusion_fit(spark, d):
    m = evaluation.ridge_moments(evaluation.sample_weights(examples(spark, d))).first().asDict()  # nine sums
    a, b = evaluation.nonnegative_ridge(m)
    return spark.createDataFrame([(a, b)], "bm25_weight double, pagerank_weight double")


@query(
    f"""WITH {RANKS}, {pr_norm('1.0')}, j AS (SELECT pn, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good FROM prn)
SELECT round(avg(pn) FILTER (good), 6) AS judged_mean, round(avg(pn), 6) AS corpus_mean, round(median(pn) FILTER (good), 6) AS judged_median, round(median(pn), 6) AS corpus_median,
round(avg(pn) FILTER (good) / avg(pn), 6) AS ratio, coalesce(avg(pn) FILTER (good) / avg(pn) > 5, false) AS biased FROM j"""
)
def bias_check(spark, d):
    good = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    out = evaluation.bias_check(scoring.normalized_pagerank(ranks(spark, d)), good)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns if c != "biased"), "biased")
