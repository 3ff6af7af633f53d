"""Link graph: degrees, PageRank by joins until it converges, breadth-first depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.config import PageRank
from lexiloom.session import cut_lineage, delete


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def weights(edges: DataFrame) -> DataFrame:
    """Repeated edges add up: ``src, dst, weight``, each source's weights being 1 together."""
    counted = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    out = counted.groupBy("src").agg(F.sum("n").alias("total"))
    return counted.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("weight"))


def outdegree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("outdegree"))


def inbound(edges: DataFrame, k: int = 20) -> DataFrame:
    return edges.groupBy("dst").agg(F.count("*").alias("inbound")).orderBy(F.desc("inbound"), "dst").limit(k)


def one_iteration(edges: DataFrame) -> DataFrame:
    """``0.15 + 0.85 * sum(1 / outdegree)`` of nodes with links to them."""
    out = edges.groupBy("src").agg(F.count("*").alias("n"))
    return edges.join(out, "src").groupBy("dst").agg((F.lit(0.15) + F.lit(0.85) * F.sum(F.lit(1.0) / F.col("n"))).alias("score"))


def pagerank(edges: DataFrame, params: PageRank = PageRank(), stop_early: bool = True, all_nodes: DataFrame | None = None) -> DataFrame:
    """``node, score``: uniform teleport, and the rank of nodes without links spread over all.

    Edge weights stay partitioned by source.  A round is one join of them with the ranks and one of what they carry
    with the ranks, written beside the old ones; how far they moved, and what the next round spreads, is one sum over it."""
    spark = edges.sparkSession
    every = cut_lineage((all_nodes or nodes(edges)).select("node").distinct())
    n = every.count()
    if not n:
        return every.withColumn("score", F.lit(0.0))
    w = weights(edges).repartition("src").cache()
    sources = w.select(F.col("src").alias("node")).distinct().withColumn("links", F.lit(True))
    ranks = cut_lineage(every.join(sources, "node", "left").select("node", F.coalesce("links", F.lit(False)).alias("links"), F.lit(1.0 / n).alias("score")))
    unlinked = F.coalesce(F.sum(F.when(~F.col("links"), F.col("score"))), F.lit(0.0)).alias("unlinked")
    spread = ranks.agg(unlinked).first()["unlinked"]
    for _ in range(params.iterations):
        carried = w.join(ranks.select(F.col("node").alias("src"), "score"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("weight")).alias("carried"))
        score = (1 - params.damping) / n + params.damping * (F.coalesce("carried", F.lit(0.0)) + F.lit(spread) / n)
        new = cut_lineage(ranks.join(carried, "node", "left").select("node", "links", F.col("score").alias("old"), score.alias("score")))
        delete(spark, ranks.lexiloom_path)
        got = new.agg(F.sum(F.abs(F.col("score") - F.col("old"))).alias("moved"), unlinked).first()
        path = new.lexiloom_path
        ranks, spread = new.select("node", "links", "score"), got["unlinked"]
        ranks.lexiloom_path = path
        if stop_early and got["moved"] < params.tolerance:
            break
    w.unpersist()
    return ranks.select("node", "score")


def document_pagerank(links: DataFrame, docs: DataFrame, iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """``doc_id, pagerank`` over links between documents, those without any included; the tolerance is for each node."""
    known = docs.select(F.col("doc_id").alias("node")).distinct()
    own = links.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst").distinct()
    params = PageRank(iterations=iterations, tolerance=tolerance * max(1, known.count()))
    return pagerank(own, params, all_nodes=known).select(F.col("node").alias("doc_id"), F.col("score").alias("pagerank"))


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``node, depth``: the least number of links from a seed, up to ``max_depth`` or until no node is new."""
    seen = seeds.select("node", F.lit(0).alias("depth")).distinct()
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = cut_lineage(reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
