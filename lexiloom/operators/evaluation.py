"""Relevance metrics, parameter grids and the fusion fit, over tables of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.config import BIAS_RATIO


def metrics(ranked: DataFrame, judged: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, p_at_k, mrr, ndcg_at_k`` of ``ranked`` (``query_id, doc_id, rank``) for each query.

    Precision divides by the number of results within ``k``; without results, or relevant documents, all are 0."""
    marked = judged.select("query_id", "doc_id").distinct().withColumn("rel", F.lit(1))
    hits = ranked.join(marked, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    top = F.col("rank") <= k
    per = hits.groupBy("query_id").agg(
        (F.sum(F.when(top, F.col("rel"))) / F.sum(F.when(top, 1))).alias("p_at_k"),
        (1.0 / F.min(F.when(F.col("rel") == 1, F.col("rank")))).alias("mrr"),
        F.sum(F.when(top, F.col("rel") / F.log2(F.col("rank") + 1.0))).alias("dcg"),
    )
    ideal = judged.groupBy("query_id").agg(F.least(F.count_distinct("doc_id"), F.lit(k)).alias("m"))
    best = F.aggregate(F.sequence(F.lit(1), F.col("m").cast("int")), F.lit(0.0), lambda acc, i: acc + 1.0 / F.log2(i + 1.0))
    out = queries.select("query_id").join(per, "query_id", "left").join(ideal.withColumn("idcg", F.when(F.col("m") > 0, best)), "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("query_id", zero(F.col("p_at_k")).alias("p_at_k"), zero(F.col("mrr")).alias("mrr"), zero(F.col("dcg") / F.col("idcg")).alias("ndcg_at_k"))


def summary(per_query: DataFrame, kind: str = "qtype") -> DataFrame:
    """Means overall and by kind of query, as one rollup."""
    rolled = per_query.rollup(kind).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("p_at_k", "mrr", "ndcg_at_k")))
    return rolled.withColumn(kind, F.coalesce(F.col(kind), F.lit("overall")))


def sample_weights(examples: DataFrame) -> DataFrame:
    """Balanced weights ``n / (2 * n of the label)``; the counts are two rows."""
    counts = examples.groupBy("label").agg(F.count("*").alias("n_label"))
    total = examples.agg(F.count("*").alias("n_all"))
    return examples.join(F.broadcast(counts), "label").join(F.broadcast(total)).withColumn("weight", F.col("n_all") / (2.0 * F.col("n_label"))).drop("n_label", "n_all")


def ridge_moments(weighted: DataFrame) -> DataFrame:
    """All that the weighted two-feature fit needs, in one pass: weighted sums and products."""
    w, x, z, y = (F.col(c) for c in ("weight", "bm25_norm", "pagerank_norm", "label"))
    parts = {"sw": w, "sx": w * x, "sz": w * z, "sy": w * y, "sxx": w * x * x, "szz": w * z * z, "sxz": w * x * z, "sxy": w * x * y, "szy": w * z * y}
    return weighted.agg(*(F.sum(v.cast("double")).alias(k) for k, v in parts.items()))


def nonnegative_ridge(m: dict, alpha: float = 1.0) -> tuple[float, float]:
    """Coefficients of both features, not negative, of the ridge with a free intercept, brought to sum 1.

    Two variables leave four active sets; the best feasible one is taken.  Both 0: the served weights."""
    centred = lambda ab, a, b: m[ab] - m[a] * m[b] / m["sw"]
    xx, zz, xz = centred("sxx", "sx", "sx") + alpha, centred("szz", "sz", "sz") + alpha, centred("sxz", "sx", "sz")
    xy, zy = centred("sxy", "sx", "sy"), centred("szy", "sz", "sy")
    loss = lambda a, b: a * a * xx + b * b * zz + 2 * a * b * xz - 2 * a * xy - 2 * b * zy
    det = xx * zz - xz * xz
    found = [(0.0, 0.0), (max(0.0, xy / xx), 0.0), (0.0, max(0.0, zy / zz))]
    if det > 0:
        both = ((xy * zz - zy * xz) / det, (zy * xx - xy * xz) / det)
        found += [both] if min(both) >= 0 else []
    a, b = min(found, key=lambda p: loss(*p))
    return (a / (a + b), b / (a + b)) if a + b > 0 else (0.85, 0.15)


def grid_best(per_setting: DataFrame, settings: list[str], metric: str = "ndcg_at_k") -> DataFrame:
    """The setting with the best mean; of equals the first in grid order."""
    mean = per_setting.groupBy(*settings).agg(F.avg(metric).alias("mean"))
    return mean.orderBy(F.desc(F.round("mean", 9)), *settings).limit(1)


def bias_check(ranks: DataFrame, judged: DataFrame, limit: float = BIAS_RATIO) -> DataFrame:
    """Mean and median PageRank of judged documents against all, and whether the ratio of means is suspicious."""
    flag = judged.select("doc_id").distinct().withColumn("judged", F.lit(True))
    marked = ranks.join(flag, "doc_id", "left")
    means = marked.agg(
        F.avg(F.when(F.col("judged"), F.col("pagerank_norm"))).alias("judged_mean"),
        F.avg("pagerank_norm").alias("corpus_mean"),
        F.median(F.when(F.col("judged"), F.col("pagerank_norm"))).alias("judged_median"),
        F.median("pagerank_norm").alias("corpus_median"),
    )
    ratio = F.try_divide(F.col("judged_mean"), F.col("corpus_mean"))
    return means.withColumn("ratio", ratio).withColumn("biased", F.coalesce(ratio > limit, F.lit(False)))


def first_rank(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")))


def judged_by_title(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """``query_id, doc_id`` where the title holds a rule's words, whatever the case; ``rules`` (``query_id, part``) are written by hand."""
    holds = F.contains(F.lower(F.col("title")), F.lower(F.col("part")))
    return docs.select("doc_id", "title").join(F.broadcast(rules), holds).select("query_id", "doc_id").distinct()


def judged_by_category(docs: DataFrame, rules: DataFrame, category: str) -> DataFrame:
    """``query_id, doc_id`` where the category is a rule's; ``rules``: ``query_id, category``."""
    own = docs.select("doc_id", F.col(category).alias("category"))
    return own.join(F.broadcast(rules), "category").select("query_id", "doc_id").distinct()


def report(per_query: DataFrame, kind: str = "qtype") -> DataFrame:
    """One row ``value``: the evaluation as a JSON object, its summary by kind and the queries, in a fixed order."""
    means = summary(per_query, kind).select(F.struct(kind, "n", "p_at_k", "mrr", "ndcg_at_k").alias("s")).agg(F.sort_array(F.collect_list("s")).alias("summary"))
    each = per_query.select(F.struct("query_id", kind, "p_at_k", "mrr", "ndcg_at_k").alias("q")).agg(F.sort_array(F.collect_list("q")).alias("queries"))
    return means.join(F.broadcast(each)).select(F.to_json(F.struct("summary", "queries")).alias("value"))


def write_report(reported: DataFrame, path: str) -> None:
    """The report as a text file of one line, in a folder of Spark's."""
    reported.select("value").coalesce(1).write.mode("overwrite").text(path)
