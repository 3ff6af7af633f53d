"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text is a sparse vector: its words, hashed, with damped counts at unit length in total; and one
place for the range in which each structure statistic lies, and the metadata ``n_chars`` where the table has it.  The score is the
logistic of ``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``, the pairwise part in linear time as
half of ``sum_f (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2``.

It is fitted on about ``SAMPLE`` labelled rows, half of each class, chosen by a hash of the id; the
intercept is then put right for the classes' shares.  Scoring reads every text whole, by blocks, however long.  Language,
source and id are not inputs.

Defined cases: a null text is scored as an empty one; a null ``n_chars``, or a table without it, has a range of its own;
a score of exactly 0.5 is predicted 1; without labelled rows every score is 0.5, with
one class that class's smoothed share; of repeated labels for an id the lowest counts; repeated rows
and null ids are scored as they are (a null id is not held out and never learned from); an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, table
from .textstats import SPACES, blocks, hash_spans, spans, word_hashes

WORD_BITS, FACTORS, SAMPLE = 16, 8, 6000
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 64, 0.05, 1e-5, 7
#: Upper ends of the ranges of a share, and of a size.
SHARES = np.array([0, 0.001, 0.003, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.999])
SIZES = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 48, 64, 100, 200, 400, 800, 1600, 3200, 6400, 12800, 25600, 102400])
SYMBOLS = "|#!%*<>{}[]()/\\=+@&$.,;:?'\"-_"
N_STATS, RANGES = 13 + len(SYMBOLS), 32


def statistics(raw: np.ndarray, words: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Range numbers of the structure statistics, in a fixed order."""
    n = max(1, len(raw))
    seen = np.bincount(raw, minlength=256)
    n_words = max(1, len(words))
    _, often = np.unique(words, return_counts=True)
    lines = np.concatenate([np.empty(0, np.uint64), *(hash_spans(b, *spans(b != 10)) for b in blocks(lower) if len(b))])
    _, per_line = np.unique(lines, return_counts=True)
    tokens = int(spans(~SPACES[raw])[0].size) if len(raw) else 0
    shares = [
        seen[65:91].sum() / n,
        seen[48:58].sum() / n,
        seen[128:].sum() / n,
        SPACES.astype(np.int64) @ seen / n,
        1 - len(often) / n_words,
        (words[1:] == words[:-1]).sum() / n_words,
        (often.max() if len(often) else 0) / n_words,
        1 - len(per_line) / max(1, len(lines)),
        *(seen[ord(c)] / n for c in SYMBOLS),
    ]
    sizes = [n if len(raw) else 0, tokens, len(raw) / max(1, tokens), len(lines), len(words) / max(1, len(lines))]
    return np.concatenate([np.searchsorted(SHARES, shares), np.searchsorted(SIZES, sizes)])


def features(text: str | None, n_chars: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the sparse vector of a text and its metadata."""
    text = text or ""
    raw, lower = np.frombuffer(text.encode(), np.uint8), np.frombuffer(text.lower().encode(), np.uint8)
    words = word_hashes(lower)
    places, counts = np.unique(words >> np.uint64(64 - WORD_BITS), return_counts=True)
    values = np.log1p(counts)
    values = values / max(1.0, np.sqrt((values**2).sum()))
    ranges = np.append(statistics(raw, words, lower), 0 if n_chars is None else 1 + np.searchsorted(SIZES, n_chars))
    stats = (1 << WORD_BITS) + np.arange(len(ranges)) * RANGES + ranges
    return np.concatenate([places.astype(np.int64), stats]), np.concatenate([values, np.full(len(stats), 0.3)]).astype(np.float32)


DIMENSION = (1 << WORD_BITS) + (N_STATS + 1) * RANGES


@dataclass
class FactorisationMachine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, places: np.ndarray, values: np.ndarray) -> float:
        vx = self.v[places] * values[:, None]
        return float(self.w0 + self.w[places] @ values + 0.5 * ((vx.sum(0) ** 2).sum() - (vx**2).sum()))

    def score(self, text: str | None, n_chars: int | None = None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(*features(text, n_chars)), -30, 30))))


def n_chars(docs: DataFrame):
    """The metadata column as a long, null where the table has none."""
    return F.col("n_chars").try_cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float = 0.5) -> FactorisationMachine:
    """Logistic loss by AdaGrad over shuffled batches; ``prior``: the share of label 1 to be expected."""
    rng = np.random.default_rng(SEED)
    w = np.zeros(DIMENSION, np.float32)
    v = (rng.standard_normal((DIMENSION, FACTORS)) * 0.05).astype(np.float32)
    if len(set(labels.tolist())) < 2:
        p = (labels.sum() + 1) / (len(labels) + 2) if len(labels) else 0.5
        return FactorisationMachine(float(np.log(p / (1 - p))), w, np.zeros_like(v))
    w0, g0, gw, gv = 0.0, 1e-6, np.full(DIMENSION, 1e-6, np.float32), np.full(v.shape, 1e-6, np.float32)
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            places, values = np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own])
            first = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in own])[:-1]])
            sizes = [len(rows[i][0]) for i in own]
            vx = v[places] * values[:, None]
            summed = np.add.reduceat(vx, first)
            z = w0 + np.add.reduceat(w[places] * values, first) + 0.5 * ((summed**2).sum(1) - np.add.reduceat(vx**2, first).sum(1))
            pull = weight[own] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[own]) / len(own)
            each = np.repeat(pull, sizes).astype(np.float32) * values
            used, inverse = np.unique(places, return_inverse=True)
            dw = np.bincount(inverse, each, len(used)).astype(np.float32) + DECAY * w[used]
            dv = np.zeros((len(used), FACTORS), np.float32)
            np.add.at(dv, inverse, each[:, None] * (np.repeat(summed, sizes, 0) - vx))
            dv += DECAY * v[used]
            g0 += pull.sum() ** 2
            gw[used] += dw**2
            gv[used] += dv**2
            w0 -= RATE * pull.sum() / np.sqrt(g0)
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= RATE * dv / np.sqrt(gv[used])
    return FactorisationMachine(float(w0 + np.log(prior / (1 - prior))), w, v)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorisationMachine:
    """Fit on about ``sample`` rows of ``labels`` (``doc_id, quality``), half of each class, with the texts of ``docs``."""
    marked = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marked = marked.filter(F.col("quality").isin(0, 1))
    counts = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    if not counts:
        return fit([], np.empty(0))
    chance = (F.xxhash64(F.col("doc_id")) % F.lit(1 << 30) + F.lit(1 << 30)) / F.lit(float(1 << 31))
    share = F.when(F.col("quality") == 1, min(1.0, sample / 2 / counts.get(1, 1))).otherwise(min(1.0, sample / 2 / counts.get(0, 1)))
    chosen = marked.filter(chance < share)  # about ``sample`` rows of two numbers: small enough to broadcast at any size
    picked = docs.select("doc_id", "text", n_chars(docs).alias("size")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "size", F.col("quality").cast("int").alias("quality"))

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t.as_py(), n) for t, n in zip(b.column("text"), b.column("size").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("quality"), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))],
                ["doc_id", "quality", "places", "values"],
            )

    got = picked.mapInArrow(featurize, "doc_id long, quality int, places array<long>, values array<float>").toArrow().sort_by("doc_id")
    rows = [(p.values.to_numpy(zero_copy_only=False), x.values.to_numpy(zero_copy_only=False)) for p, x in zip(got["places"], got["values"], strict=True)]
    total = sum(counts.values())
    return fit(rows, got["quality"].to_numpy().astype(np.float64), (counts.get(1, 0) + 1) / (total + 2))


def score(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """The rows of ``docs`` with ``score, predicted``; a column of such a name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [shared.value.score(t.as_py(), n) for t, n in zip(b.column("text"), b.column(b.num_columns - 1).to_pylist(), strict=True)]
            more = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], [*b.schema.names[:-1], "score", "predicted"])

    more = T.StructType().add("score", "double").add("predicted", "integer")
    return kept.withColumn("_size", n_chars(docs)).mapInArrow(run, T.StructType(kept.schema.fields + more.fields))


def held_out(column: str = "doc_id"):
    return F.coalesce(fold(column, 3) == 1, F.lit(False))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~held_out()))
    return score(docs.withColumn("held_out", held_out()), model).select("doc_id", "held_out", "score", "predicted")
