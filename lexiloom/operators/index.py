"""The positional inverted index as tables: postings, document lengths, corpus statistics, vocabulary."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import analyzers
from lexiloom.functions.stemmer import stem
from lexiloom.session import ship_package

from . import versions

#: What a saved index says it is; another magic or version is not read.
MAGIC, VERSION = "lexiloom-index", 2


def tokens(docs: DataFrame, analyzer: str = "plain", text: str = "text") -> DataFrame:
    """``doc_id, tokens`` under a named analyzer: basic, plain, query (plain and stemmed) or engine."""
    if analyzer == "engine":
        from lexiloom.functions.engine_tokens import engine_tokens_udf

        return docs.select("doc_id", engine_tokens_udf(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    make = analyzers.basic_tokens if analyzer == "basic" else analyzers.plain_tokens
    return docs.select("doc_id", make(F.col(text)).alias("tokens"))


def positions(token_rows: DataFrame) -> DataFrame:
    return token_rows.select("doc_id", F.posexplode("tokens").alias("pos", "term"))


def postings(token_rows: DataFrame, terms: list[str] | None = None, stemmed: bool = False) -> DataFrame:
    """``term, doc_id, tf, positions``; with ``terms`` only theirs.

    A posting lies whole within its document's row, so a row a posting is made there, and nothing is shuffled;
    rows that repeat an id have postings of their own."""
    ship_package(token_rows.sparkSession)

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems: dict[str, str] = {}
        for b in batches:
            lists = b.column("tokens")
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            doc = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            encoded = lists.flatten().dictionary_encode()
            code, words = encoded.indices.to_numpy(), encoded.dictionary
            if stemmed and len(words):
                own = words.to_pylist()
                for w in own:
                    if w not in stems:
                        if len(stems) > 1 << 16:
                            stems.clear()
                        stems[w] = stem(w)
                again = pa.array([stems.get(w) or stem(w) for w in own], pa.string()).dictionary_encode()
                code, words = again.indices.to_numpy()[code], again.dictionary
            if terms is not None:
                kept = np.flatnonzero(pa.compute.is_in(words, pa.array(list(terms), pa.string())).to_numpy(zero_copy_only=False)[code]) if len(words) else np.empty(0, np.int64)
                doc, pos, code = doc[kept], pos[kept], code[kept]
            key = doc * max(1, len(words)) + code
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)[: len(order)])
            ends = np.append(first, len(order))
            yield pa.RecordBatch.from_arrays(
                [
                    words.take(pa.array(code[order[first]])),
                    b.column("doc_id").take(pa.array(doc[order[first]])),
                    pa.array(np.diff(ends).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(pos[order].astype(np.int32))),
                ],
                ["term", "doc_id", "tf", "positions"],
            )

    kind = token_rows.schema["doc_id"].dataType.simpleString()
    return token_rows.select("doc_id", "tokens").mapInArrow(invert, f"term string, doc_id {kind}, tf long, positions array<int>")


def doc_lengths(token_rows: DataFrame) -> DataFrame:
    """``doc_id, dl``; documents without tokens stay, with 0."""
    return token_rows.select("doc_id", F.size("tokens").cast("long").alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row ``n_docs, avgdl``; 0.0 for an empty corpus."""
    return lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.try_divide(F.sum("dl"), F.count("*")), F.lit(0.0)).alias("avgdl"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, freq`` of unstemmed words, stop words included."""
    return docs.select(F.explode(analyzers.basic_tokens(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))


def with_pagerank(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """PageRank by URL as a 32-bit float, 0 where there is none."""
    return docs.join(ranks.select("url", F.col("score").cast("float").alias("pagerank")), "url", "left").fillna(0.0, ["pagerank"])


def deletions(vocab: DataFrame) -> DataFrame:
    """``key, word, freq``: what is left of each word without up to two characters, for the spelling lookup."""
    from .spell import deletions as keys

    return vocab.select(F.explode(keys(F.col("word"))).alias("key"), "word", "freq")


@dataclass
class Index:
    """The index's tables.

    ``save`` keeps them as Parquet sorted by what they are looked up by, so that row groups are skipped: postings by
    term, the vocabulary by word, its deletions by key.  Each save has a folder of its own, and counts from when its
    line is in the manifest, which is written last; so readers never see half an index."""

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    vocab: DataFrame | None = None
    deletions: DataFrame | None = None
    analyzer: str = "plain"

    @staticmethod
    def build(docs: DataFrame, analyzer: str = "plain", text: str = "text", spelling: bool = True) -> Index:
        rows = tokens(docs, "plain" if analyzer == "query" else analyzer, text)
        lengths, vocab = doc_lengths(rows), vocabulary(docs, text)
        return Index(postings(rows, stemmed=analyzer == "query"), lengths, corpus_stats(lengths), vocab, deletions(vocab) if spelling else None, analyzer)

    def save(self, path: str, parts: int | None = None, source: str = "") -> None:
        """Write a new version; ``source`` says which state of the documents it is of."""
        spark, folder = self.postings.sparkSession, uuid.uuid4().hex
        at = f"{path}/{folder}"
        posted = self.postings.repartitionByRange(parts, "term") if parts else self.postings.repartitionByRange("term")
        posted.sortWithinPartitions("term", "doc_id").write.parquet(f"{at}/postings")
        self.lengths.write.parquet(f"{at}/lengths")
        lengths = spark.read.parquet(f"{at}/lengths")
        corpus_stats(lengths).write.parquet(f"{at}/stats")
        if self.vocab is not None:
            self.vocab.repartitionByRange("word").sortWithinPartitions("word").write.parquet(f"{at}/vocab")
        if self.deletions is not None:
            words = deletions(spark.read.parquet(f"{at}/vocab"))
            words.repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{at}/deletions")
        versions.publish(spark, path, MAGIC, VERSION, folder, self.analyzer, lengths.count(), source)

    @staticmethod
    def load(spark: SparkSession, path: str, source: str | None = None) -> Index:
        """The newest version; with ``source`` it must be of that state."""
        own = versions.newest(spark, path, MAGIC, VERSION, source)
        read = lambda name: spark.read.parquet(f"{path}/{own['folder']}/{name}")

        def perhaps(name: str) -> DataFrame | None:
            try:
                return read(name)
            except Exception as e:  # an index saved without it
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                return None

        return Index(read("postings"), read("lengths"), read("stats"), perhaps("vocab"), perhaps("deletions"), own["details"])


def dump(posted: DataFrame) -> DataFrame:
    """``term, line``: each term's postings as text, in the order of documents."""
    one = F.format_string("Doc %d, TF=%d, Pos=(%s)", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ","))
    lined = posted.select("term", "doc_id", one.alias("s")).groupBy("term").agg(F.sort_array(F.collect_list(F.struct("doc_id", "s"))).alias("l"))
    return lined.select("term", F.concat("term", F.lit(" -> ["), F.array_join(F.transform("l", lambda x: x["s"]), "; "), F.lit("]")).alias("line"))
