"""The crawl as a loop of micro-batches over a store whose batches count all at once or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.web import html_extract_udf
from lexiloom.operators import tables, versions
from lexiloom.session import ship_package
from lexiloom.sources.fetch import fetch

MAGIC, VERSION = "lexiloom-crawl", 1
PAGES, LINKS, FRONTIER = "url string, title string, content string, depth int", "src string, dst string", "url string, status string, depth int"


class CrawlStore:
    """Pages, links and frontier at ``path``, as batches; a batch's three tables count from its line in the manifest on.

    Of a page the newest counts, of a link one, of a URL in the frontier what was last said of it, though
    ``pending`` never replaces anything."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, pages: DataFrame, links: DataFrame, frontier: DataFrame) -> int:
        """One batch; pages without content are rejected.  The number of pages accepted."""
        folder = uuid.uuid4().hex
        tables.accepted_pages(pages).select("url", "title", "content", "depth").write.parquet(f"{self.path}/{folder}/pages")
        links.select("src", "dst").distinct().write.parquet(f"{self.path}/{folder}/links")
        frontier.select("url", "status", "depth").write.parquet(f"{self.path}/{folder}/frontier")
        n = self.spark.read.schema(PAGES).parquet(f"{self.path}/{folder}/pages").count()
        versions.publish(self.spark, self.path, MAGIC, VERSION, folder, n_rows=n)
        return n

    def _all(self, name: str, schema: str) -> DataFrame:
        lines = versions.published(self.spark, self.path)
        folders = [] if lines is None else [r["folder"] for r in lines.orderBy("saved_at").collect()]  # a line a batch
        if not folders:
            return self.spark.createDataFrame([], f"{schema}, batch int")
        number = F.element_at(F.create_map(*(F.lit(x) for i, f in enumerate(folders) for x in (f, i))), F.regexp_extract(F.col("_metadata.file_path"), rf"([0-9a-f]{{32}})/{name}/", 1))
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}/{name}" for f in folders)).select("*", number.alias("batch"))

    def pages(self) -> DataFrame:
        return tables.newest(self._all("pages", PAGES), "url", ["batch", "title", "content"]).drop("batch")

    def links(self) -> DataFrame:
        return self._all("links", LINKS).select("src", "dst").distinct()

    def frontier(self) -> DataFrame:
        own = self._all("frontier", FRONTIER).withColumn("_final", F.col("status") != "pending")
        return tables.newest(own, "url", ["_final", "batch", "status"]).drop("batch", "_final")


def step(store: CrawlStore, get: Callable, max_depth: int | None = None) -> int:
    """Fetch all that is pending and save what comes of it; how many URLs were pending."""
    spark = store.spark
    ship_package(spark)
    known = store.frontier()
    pending = known.filter("status = 'pending'").select("url", "depth")
    folder = f"{store.path}/fetched-{uuid.uuid4().hex}"  # fetched once, read by the three tables
    got = fetch(pending, get).withColumn("x", html_extract_udf()("html", "final_url"))
    pending.join(got, "url", "left").select("url", "depth", F.col("x.title").alias("title"), F.coalesce("x.text", F.lit("")).alias("content"), F.col("x.links").alias("links")).write.parquet(folder)
    batch = spark.read.parquet(folder)
    n = batch.count()
    if n:
        accepted = tables.accepted_pages(batch)
        links = accepted.select(F.col("url").alias("src"), F.explode("links").alias("dst"), "depth")
        done = batch.select("url", F.when(F.trim("content") != "", "visited").otherwise("failed").alias("status"), "depth")
        found = links.groupBy(F.col("dst").alias("url")).agg((F.min("depth") + 1).alias("depth")).join(known.select("url"), "url", "left_anti")
        if max_depth is not None:
            found = found.filter(F.col("depth") <= max_depth)
        store.save(accepted, links, done.unionByName(found.select("url", F.lit("pending").alias("status"), "depth")))
    return n


def crawl(store: CrawlStore, seeds: DataFrame, get: Callable, max_depth: int | None = None) -> CrawlStore:
    """Rounds until nothing is pending.  A crawl that was broken off goes on where its last whole batch ended."""
    new = seeds.join(store.frontier().select("url"), "url", "left_anti")
    empty = lambda schema: store.spark.createDataFrame([], schema)
    store.save(empty(PAGES), empty(LINKS), new)
    while step(store, get, max_depth):
        pass
    return store
