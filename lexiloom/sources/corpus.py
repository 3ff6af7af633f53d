"""Corpora as DataFrames: Parquet documents and pages, JSON arrays, stop-word files, seeds, generated texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.functions.web import normalize_url_udf
from lexiloom.schemas import CORPUS_JSON, PAGERANK


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table as titled pages: the first line (500 characters at most) is the title."""
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return titled(raw)


def titled(raw: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    title = F.substring(F.split_part(text, F.lit("\n"), F.lit(1)), 1, 500)
    return raw.select(
        "doc_id",
        title.alias("title"),
        F.substring(text, F.length(title) + 1, F.length(text)).alias("content"),
        F.concat(F.lit("https://"), F.coalesce("source", F.lit("none")), F.lit(".example/doc-"), F.col("doc_id").cast("string")).alias("url"),
        text.alias("text"),
    )


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, title, content`` of stored pages, nulls as empty; a missing table is an empty one."""
    try:
        rows = spark.read.parquet(path)
    except Exception as e:  # only a path that isn't there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "doc_id int, title string, content string")
    return rows.select("doc_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("title", "content")))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def json_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of documents; of one id the last counts."""
    rows = spark.read.option("multiLine", True).schema(CORPUS_JSON).json(path).withColumn("_n", F.monotonically_increasing_id())
    w = Window.partitionBy("id").orderBy(F.desc("_n"))
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_n", "_k")


def pagerank_table(spark: SparkSession, path: str) -> DataFrame:
    """``url, score``; a missing table is an empty one."""
    try:
        return spark.read.schema(PAGERANK).parquet(path)
    except Exception as e:  # only a path that isn't there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], PAGERANK)


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("word")).filter("word <> ''").distinct()


def seeds(spark: SparkSession, urls: list[str]) -> DataFrame:
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    return rows.select(normalize_url_udf("url").alias("url")).filter("url IS NOT NULL").distinct().select("url", F.lit("pending").alias("status"), F.lit(0).alias("depth"))


def resume_frontier(frontier: DataFrame, seed_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pending URLs and those already seen; what was saved wins over seeds."""
    pending = frontier.filter("status = 'pending'")
    seen = frontier.filter("status IN ('visited', 'failed')").select("url")
    return pending.unionByName(seed_rows.join(frontier.select("url"), "url", "left_anti"), allowMissingColumns=True), seen


#: A small phrase stock of our own; texts are chosen from it by hashes of the id.
SUBJECTS = "the index,a crawler,our ranking,the query,a posting list,the cache,one shard,a token,the graph,every page".split(",")
VERBS = "stores,joins,merges,filters,counts,sorts,reads,links,scores,samples".split(",")
OBJECTS = "long documents,short titles,rare words,common terms,old snapshots,new links,warm partitions,cold files,small tables,large groups".split(",")


def generated(spark: SparkSession, n: int, sentences: int = 40, salt: int = 0) -> DataFrame:
    """``n`` repeatable documents, each tenth a copy of the one before it, with links to three others."""
    pick = lambda words, *k: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64(*k), F.lit(len(words))) + 1).cast("int"))
    source = F.when(F.col("id") % 10 == 9, F.col("id") - 1).otherwise(F.col("id"))
    sentence = lambda i: F.concat_ws(" ", pick(SUBJECTS, source, i, F.lit(salt)), pick(VERBS, source, i, F.lit(salt + 1)), pick(OBJECTS, source, i, F.lit(salt + 2)))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(sentences)), sentence), ". ")
    links = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.pmod(F.xxhash64("id", i, F.lit(salt)), F.lit(n))))
    return spark.range(n).select(F.col("id").alias("doc_id"), pick(OBJECTS, source, F.lit("t")).alias("title"), text.alias("content"), links.alias("links"))
