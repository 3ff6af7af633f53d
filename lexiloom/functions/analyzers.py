"""Text analysis as Column expressions, and stemming over a vocabulary."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.config import MAX_QUERY_LENGTH, QUERY_ERRORS

from .stemmer import stem

#: English stop words of the query analyzer.
STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this",
    "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing",
    "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between",
    "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again",
    "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some",
    "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now", "d",
    "ll", "m", "o", "re", "ve", "y", "ain", "aren", "couldn", "didn", "doesn", "hadn", "hasn", "haven", "isn", "ma", "mightn", "mustn", "needn",
    "shan", "shouldn", "wasn", "weren", "won", "wouldn",
)
#: Stop words of the engine analyzer.
ENGINE_STOP_WORDS = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before",
    "being", "below", "between", "both", "but", "by", "can", "did", "do", "does", "doing", "down", "during", "each", "few", "for", "from", "further",
    "had", "has", "have", "having", "he", "her", "here", "hers", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "me", "more",
    "most", "my", "no", "nor", "not", "of", "off", "on", "once", "only", "or", "other", "our", "out", "over", "own", "same", "she", "so", "some",
    "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "through", "to", "too", "under", "until",
    "up", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "why", "will", "with", "you", "your",
)


def whole_text(title: Column, content: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit("")))


def basic_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def is_stop_word(token: Column, words=STOP_WORDS) -> Column:
    return F.lower(token).isin(list(words))


def plain_tokens(text: Column) -> Column:
    """Basic tokens without stop words."""
    return F.filter(basic_tokens(text), lambda t: ~t.isin(*STOP_WORDS))


@F.pandas_udf(T.StringType())
def stem_udf(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


def stem_terms(terms: DataFrame, column: str = "term") -> DataFrame:
    """Stem a column by way of its distinct words: the Python function sees each word once."""
    stems = terms.select(column).distinct().withColumn("stem", stem_udf(column))
    return terms.join(stems, column).drop(column).withColumnRenamed("stem", column)


def fingerprint(title: Column, content: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(whole_text(title, content)), r"(?U)\s+", " "))


def display_text(title: Column, content: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(content, F.lit("")))


def cache_key(query: Column, rerank: bool = False) -> Column:
    key = F.lower(F.trim(query))
    return F.concat(key, F.lit("\x1frerank")) if rerank else key


def query_error(query: Column) -> Column:
    """The first thing wrong with a raw query, or null: in a fixed order of checks."""
    return (
        F.when(query.isNull(), QUERY_ERRORS["missing"])
        .when(query.rlike(r"[\x00-\x1f]"), QUERY_ERRORS["control"])
        .when(F.trim(query) == "", QUERY_ERRORS["empty"])
        .when(F.length(query) > MAX_QUERY_LENGTH, QUERY_ERRORS["long"])
        .when(~query.rlike(r"[\p{L}\p{N}]"), QUERY_ERRORS["no_word"])
    )


def title_from_url(url: Column) -> Column:
    """The last path segment with ``-`` and ``_`` as spaces, else the host."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    last = F.trim(F.translate(F.element_at(F.split(path, "/"), -1), "-_", "  "))
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return F.when(last != "", last).otherwise(host)
