"""The search engine's queries and their SQL, gathered from ``lexiloom.plans``."""

from __future__ import annotations

from lexiloom.plans import crawl, search, text  # noqa: F401  they register their queries
from lexiloom.plans.registry import QUERIES, SQL


def flagship(spark, sf_dir):
    """The best 20 documents for an OR query by BM25."""
    return search.search_topk(spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
