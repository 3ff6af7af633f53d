"""Keyed tables: upsert, insert-ignore, rejects, shards; and windows over crawl and request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.config import CRAWL_DELAY_S, RATE_PER_MINUTE


def latest(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The last write of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def newest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key that is greatest by ``order``: an aggregate, which is combined before the shuffle."""
    best = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(F.col(key).alias("_k")).agg(best.alias("_best")).select("_best.*")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"))


def accepted_pages(pages: DataFrame) -> DataFrame:
    """Pages with content; blank ones are rejected."""
    return pages.filter(F.trim(F.coalesce("content", F.lit(""))) != "")


def html_shards(pages: DataFrame) -> DataFrame:
    """Where a page's raw HTML goes: a folder by the first two digits of its URL's digest."""
    return pages.withColumn("url_sha256", F.sha2("url", 256)).withColumn("shard", F.substring("url_sha256", 1, 2))


def write_html_archive(pages: DataFrame, path: str) -> None:
    html_shards(pages).select("url", "url_sha256", "html", "shard").write.mode("append").partitionBy("shard").parquet(path)


def politeness_slots(requests: DataFrame, host: str, at: str, order: list[str], delay: float = CRAWL_DELAY_S) -> DataFrame:
    """When each request may go: no sooner than ``delay`` after the host's last slot.

    The recursion ``slot = max(arrival, last slot + delay)`` is the running maximum of ``arrival - i * delay`` plus ``i * delay``."""
    w = Window.partitionBy(host).orderBy(at, *order)
    numbered = requests.withColumn("_i", F.row_number().over(w) - 1)
    waited = F.col("_i").cast("long") * delay
    running = F.max(F.col(at) - waited).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("slot", running + waited).drop("_i")


def rate_limited(requests: DataFrame, client: str, ts: str, order: list[str], limit: int = RATE_PER_MINUTE) -> DataFrame:
    """Each request's number within its client's minute, and whether it is let through."""
    minute = F.date_trunc("minute", F.col(ts))
    w = Window.partitionBy(client, "minute").orderBy(ts, *order)
    out = requests.withColumn("minute", minute).withColumn("nth", F.row_number().over(w))
    return out.withColumn("allowed", F.col("nth") <= limit)


def within_budget(pages: DataFrame, order: str, size: str, max_pages: int, max_bytes: int, buckets: int = 64) -> DataFrame:
    """The pages, in order, before either budget is used up.

    Running sums go by ranges of the order: within each range, plus the ranges before it, whose sums are few rows."""
    span = pages.agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    ranged = pages.join(F.broadcast(span)).withColumn("_r", F.floor((F.col(order) - F.col("_lo")) * buckets / (F.col("_hi") - F.col("_lo") + 1)))
    sums = ranged.groupBy("_r").agg(F.sum(size).alias("_s"), F.count("*").alias("_c"))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_r", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_bs"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_bc"))
    within = Window.partitionBy("_r").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(bases), "_r").withColumn("bytes_so_far", F.sum(size).over(within) + F.col("_bs")).withColumn("pages_so_far", F.count("*").over(within) + F.col("_bc"))
    kept = out.filter((F.col("pages_so_far") <= max_pages) & (F.col("bytes_so_far") - F.col(size) < max_bytes))
    return kept.drop("_lo", "_hi", "_r", "_bs", "_bc")
