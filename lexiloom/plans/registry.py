"""Queries with their SQL, registered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiloom.functions.analyzers import ENGINE_STOP_WORDS, STOP_WORDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a session and a directory; ``sql`` is what it must equal."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


#: Common table expressions of the SQL side.
STOP, ENGINE_STOP = quoted(STOP_WORDS), quoted(ENGINE_STOP_WORDS)
BASIC = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
TOK = f"tok AS (SELECT doc_id, list_filter({BASIC}, lambda x: x NOT IN ({STOP})) AS toks FROM documents)"
POS = f"{TOK}, pos AS (SELECT doc_id, unnest(toks) AS term, unnest(range(len(toks))) AS pos FROM tok)"
POST = f"{POS}, post AS (SELECT term, doc_id, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM pos GROUP BY ALL)"
LENS = "lens AS (SELECT doc_id, len(toks) AS dl FROM tok), st AS (SELECT count(*) AS n_docs, sum(dl) / count(*) AS avgdl FROM lens)"
INDEX = f"{POST}, {LENS}"


def phrase_sql(terms: list[str]) -> str:
    """Documents with the terms side by side, by joins of positions."""
    joins = " ".join(f"JOIN pos p{i} ON p{i}.doc_id = p0.doc_id AND p{i}.pos = p0.pos + {i} AND p{i}.term = '{t}'" for i, t in enumerate(terms) if i)
    return f"SELECT DISTINCT p0.doc_id FROM pos p0 {joins} WHERE p0.term = '{terms[0]}'"


def bm25_sql(candidates: str, terms: list[str], k1: str = "1.2", b: str = "0.75") -> str:
    """CTE ``scored(doc_id, bm25)`` over a CTE of candidates, after INDEX."""
    return f"""df AS (SELECT term, count(*) AS df FROM post WHERE term IN ({quoted(terms)}) GROUP BY term),
hits AS (SELECT p.doc_id, sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))) AS s
  FROM post p JOIN df USING (term) JOIN lens l ON l.doc_id = p.doc_id CROSS JOIN st GROUP BY p.doc_id),
scored AS (SELECT c.doc_id, coalesce(s, 0.0) AS bm25 FROM {candidates} c LEFT JOIN hits h ON h.doc_id = c.doc_id)"""
