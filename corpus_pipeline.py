"""The training-data pipeline: five stages from ``documents`` to packed sequences.

Each stage takes what its predecessor returned and works on all of it.  The near-duplicate stage
works on rows, whatever their ids: of rows with one id, or with null ids, one of each group stays too.

Defined cases, of all stages: an empty table gives an empty one, with the columns of documents (the last stage: of
packing); texts are read whole, however long; columns with names that an operator uses pass unchanged.  Each stage's
docstring says what becomes of null and empty texts, null ids, repeated rows and ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import language_id, minhash, packing, quality, suffix_dedup
from lexiloom.llm.common import materialize, table
from lexiloom.session import ship_package


def _apart(docs: DataFrame) -> tuple[DataFrame, list]:
    """``docs`` with all columns but the text under names that nothing else has, and what restores them."""
    names = {c: f"_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    apart = docs.select("text", *(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    return apart, [F.col(names[c]).alias(c) if c in names else F.col(c) for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of none of the learned languages as the decoder has it, go; those between two languages stay.

    Null and empty texts go; a null id or language is no reason to go; repeated rows go or stay alike; codewords of equal
    cost do not matter, as either language keeps the document.  Without a learned language all documents go."""
    ship_package(spark)
    model = language_id.train(docs.select("doc_id", "text", "lang").filter(~language_id.held_out()))
    apart, restored = _apart(docs)
    return language_id.identify(apart, model, strict=True).filter(F.col("lang_pred") != language_id.UNDETERMINED).select(*restored)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below one half go; a score of exactly one half stays.

    A null text is scored as an empty one; null ids are scored, and never learned from; repeated rows go or stay alike.
    Without labels every score is one half, and all stay."""
    ship_package(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~quality.held_out())
    apart, restored = _apart(docs)
    return quality.score(apart, quality.train(docs, labels)).filter("predicted = 1").select(*restored)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id stays; null ids come last, and one of equal ids stays.

    Of repeated rows, and of ties, that with the smaller internal key stays.  Null and empty texts have no shingles, are
    near nothing and stay."""
    ship_package(spark)
    apart, restored = _apart(docs)
    keyed = materialize(apart.withColumn("_key", F.monotonically_increasing_id()), "keyed")  # a key must not change when it is read again
    found = minhash.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), "component_id")
    doc_id = F.col(f"_{docs.columns.index('doc_id')}")
    ranked = found.join(keyed.select("_key", F.struct(doc_id.isNull().alias("unknown"), doc_id.alias("id"), "_key").alias("order")), "_key")
    kept = ranked.groupBy("component_id").agg(F.min("order").alias("first")).select("first._key")
    return keyed.join(kept.hint("shuffle_hash"), "_key", "left_semi").select(*restored)  # one plan at every size


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occurred earlier in the corpus go from the texts; every document stays.

    Null texts stay null, empty ones empty; a null id comes before all others; of repeated ids the order is that of the
    rows as they were written, so a repeated row's text becomes empty."""
    ship_package(spark)
    return suffix_dedup.remove_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a document, with its sequence and place.

    A null or empty text is one piece that holds the end id; null ids and repeated rows are packed as they are; pieces of
    equal length take slots in the order of partitions and rows."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", classify_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", remove_repeated_passages),
    ("best-fit packing", pack_sequences),
]

#: Trained classifiers and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{i + 1}")
    return docs
