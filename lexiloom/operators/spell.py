"""Spelling: candidates by shared deletions, optimal string alignment, and the query rewrite."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.config import EDIT_DISTANCE

from .parsing import basic

SEGMENT = re.compile(r'"|[^\s"]+')
OPERATORS = ("AND", "OR", "NOT")


def osa(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance, or ``most + 1`` if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def osa_udf(most: int = EDIT_DISTANCE):
    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([osa(x, y, most) for x, y in zip(a, b)])

    return run


def deletions(word: Column, most: int = EDIT_DISTANCE) -> Column:
    """The word and what is left of it without up to ``most`` characters."""
    out = F.array(word)
    for _ in range(most):
        once = F.flatten(
            F.transform(
                out,
                lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(
                    F.array().cast("array<string>")
                ),
            )
        )
        out = F.array_distinct(F.concat(out, once))
    return out


def left_over(word: str, most: int = EDIT_DISTANCE) -> set[str]:
    """:func:`deletions` of one word."""
    out = {word}
    for _ in range(most):
        out |= {w[:i] + w[i + 1 :] for w in out for i in range(len(w))}
    return out


def candidates(words: DataFrame, vocab: DataFrame, most: int = EDIT_DISTANCE, known: DataFrame | None = None) -> DataFrame:
    """``word, term, freq, dist`` of vocabulary terms within the distance: an equi-join on shared deletions, then the distance.

    ``known``: the vocabulary's deletions ``key, word, freq``, if they are kept."""
    left = words.select("word", F.explode(deletions(F.col("word"), most)).alias("key"))
    if known is None:
        known = vocab.select(F.explode(deletions(F.col("word"), most)).alias("key"), "word", "freq")
    right = known.select("key", F.col("word").alias("term"), "freq")
    pairs = left.join(right, "key").select("word", "term", "freq").distinct()
    return pairs.withColumn("dist", osa_udf(most)("word", "term")).filter(F.col("dist") <= most)


def best(words: DataFrame, vocab: DataFrame, most: int = EDIT_DISTANCE, known: DataFrame | None = None) -> DataFrame:
    """``word, correction``: the word itself if known, else the closest, then most frequent term; null if none."""
    w = Window.partitionBy("word").orderBy("dist", F.desc("freq"), "term")
    first = candidates(words, vocab, most, known).withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return words.join(first.select("word", F.col("term").alias("correction")), "word", "left")


def segments(query: str) -> list[str]:
    return SEGMENT.findall(query)


def words_of(query: str) -> list[str]:
    """The words of a query that are looked up: the first basic token of a segment, or the segment in lower case."""
    return [(basic(s) or [s.lower()])[0] for s in segments(query) if s != '"' and s not in OPERATORS]


def rewrite(query: str, corrections: dict[str, str | None]) -> dict:
    """The query with its words corrected: quotes and operators stay; and what was changed or is unknown."""
    out, changed, unknown = [], {}, []
    for s in segments(query):
        if s == '"' or s in OPERATORS:
            out.append(s)
            continue
        word = (basic(s) or [s.lower()])[0]
        found = corrections.get(word)
        if found is None:
            unknown.append(word)
            out.append(word)
        else:
            if found != word:
                changed[word] = found
            out.append(found)
    text, quoted = "", False
    for s in out:
        closes = s == '"' and quoted
        opened = text.endswith('"') and quoted
        text += s if not text or closes or opened else f" {s}"
        quoted ^= s == '"'
    return {"corrected_query": text, "suggestions": changed, "unknown_words": unknown}


def correct(query: str, vocab: DataFrame, known: DataFrame | None = None) -> dict:
    """Rewrite one query: its few words are looked up, and only those that are not found are compared with others."""
    words = sorted(set(words_of(query)))
    if not words:
        return rewrite(query, {})
    found = {r["word"]: r["word"] for r in vocab.filter(F.col("word").isin(words)).select("word").collect()}
    missing = [w for w in words if w not in found]
    if missing:
        if known is not None:  # sorted by key: only the row groups with theirs are read
            known = known.filter(F.col("key").isin(sorted(set().union(*map(left_over, missing)))))
        rows = best(vocab.sparkSession.createDataFrame([(w,) for w in missing], "word string"), vocab, known=known).collect()
        found |= {r["word"]: r["correction"] for r in rows}
    return rewrite(query, found)
