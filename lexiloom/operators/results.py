"""Ranking, duplicate collapse, pages, suggestions and snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.config import MAX_PAGE_SIZE, PAGE_SIZE, SNIPPET_WINDOW, SUGGEST_LIMIT
from lexiloom.session import cut_lineage


def order(score: str = "score", key: str = "doc_id") -> list[Column]:
    """Best first; scores equal to nine places are ties and go by id, so that sums in another order change nothing."""
    return [F.desc(F.round(score, 9)), F.asc(key)]


def top(scored: DataFrame, k: int, score: str = "score", key: str = "doc_id") -> DataFrame:
    """The first ``k`` with their rank: a top-k first, so that only ``k`` rows meet in one task."""
    first = scored.orderBy(*order(score, key)).limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order(score, key))))


def ranked(scored: DataFrame, score: str = "score", key: str = "doc_id", ranges: int = 64) -> DataFrame:
    """All rows with their rank, without one task for all: scores fall into ranges of equal width, and a rank is
    the place in its range after the rows of better ranges, whose counts are few."""
    scored = cut_lineage(scored)  # it is read three times
    bounds = scored.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    own = F.floor((F.col("_hi") - F.round(score, 9)) * ranges / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0))
    dealt = scored.join(F.broadcast(bounds)).withColumn("_r", F.coalesce(own, F.lit(ranges))).drop("_lo", "_hi")
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges' counts
    better = dealt.groupBy("_r").agg(F.count("*").alias("_n")).select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_better"))
    place = F.row_number().over(Window.partitionBy("_r").orderBy(*order(score, key)))
    return dealt.join(F.broadcast(better), "_r").withColumn("rank", (place + F.col("_better")).cast("int")).drop("_r", "_better")


def head_and_rest(scored: DataFrame, k: int, score: str = "score", key: str = "doc_id") -> DataFrame:
    """The first ``k`` with their rank, and the rest with a rank beyond: enough where only the head is ordered."""
    scored = cut_lineage(scored)
    head = top(scored, k, score, key)
    rest = scored.join(F.broadcast(head.select(key)), key, "left_anti").withColumn("rank", F.lit(k + 1))
    return head.unionByName(rest)


def collapse(results: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """Of rows with one fingerprint the best ranked: an aggregate, which is combined before the shuffle."""
    whole = F.struct(*results.columns)
    best = F.max_by(whole, F.struct(F.round("score", 9).alias("s"), (-F.col("doc_id")).alias("d")))
    return results.groupBy(F.col(fingerprint).alias("_f")).agg(best.alias("_best")).select("_best.*")


def page(results: DataFrame, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page of ranked results with ``rank``; beyond the end it is empty."""
    if number < 1 or not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError("page starts at 1 and page_size is from 1 to 50")
    return top(results, number * size).filter(F.col("rank") > (number - 1) * size)


def signals(ranked: DataFrame, columns: list[str]) -> DataFrame:
    """Beside each score its bar, a whole percentage between 0 and 100; no bar where the score is null."""
    bar = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) * 100).cast("int")
    return ranked.select("*", *(F.when(F.col(c).isNotNull(), bar(c)).alias(f"{c}_percent") for c in columns))


def total_pages(results: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    return results.agg(F.count("*").alias("total_results")).withColumn("total_pages", F.ceil(F.col("total_results") / size).cast("long"))


def suggest(vocab: DataFrame, prefix: str, limit: int = SUGGEST_LIMIT) -> DataFrame:
    """Words with a prefix, the most frequent first; the filter reaches the scan of a written vocabulary."""
    prefix = prefix.strip().lower()
    if not prefix:
        return vocab.filter(F.lit(False))
    return vocab.filter(F.col("word").startswith(prefix)).orderBy(F.desc("freq"), "word").limit(limit)


def snippet(text: Column, is_target, window: int = SNIPPET_WINDOW) -> Column:
    """``window`` words to each side of the first target word, or the first twice as many words; targets are marked.

    ``is_target``: from a word to whether it is one."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\S+)"), 1)
    hit = F.array_position(F.transform(words, is_target), True) - 1
    found = hit >= 0
    start = F.when(found, F.greatest(hit - window, F.lit(0))).otherwise(0)
    end = F.least(F.when(found, hit + window + 1).otherwise(2 * window), F.size(words))
    shown = F.transform(F.slice(words, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int")), lambda w: F.when(is_target(w), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w))
    return F.concat(F.when(start > 0, "...").otherwise(""), F.array_join(shown, " "), F.when(end < F.size(words), "...").otherwise(""))
