"""Language identification with error-correcting output codes.

Each language has a codeword, a row of a Hadamard matrix, so that any two differ in half of the bits.
For each bit a logistic classifier over hashed byte n-grams of the lower-cased text predicts it.  A
text gets the language whose codeword costs least: the sum over bits of the logistic loss of the
classifier's margin against the bit, weighted by how well that classifier did on its training rows.
The score is the softmax of the negative costs; a text whose two cheapest codewords lie closer than
``AMBIGUOUS`` in score is flagged.

The decoder can also reject: a text whose cheapest codeword costs more than ``limit``, and of whose
passages of ``PASSAGE`` characters at least half cost more too (a mixture of languages has no codeword, its
passages have), is of none of the languages, and ``strict`` identification says ``und``.  The limit lies above the cost of every training
row, at the share ``REJECT`` of the way to the cost of a text that the classifiers know nothing of.

The classifiers are fitted on about ``SAMPLE`` rows of each language, chosen by a hash of the id, or fewer where there are
many languages: ``TOTAL`` rows in all, but ``FEWEST`` of each at least.  Every language is learned.  The
prediction reads every text whole, by blocks.

Defined cases: codewords of equal cost: the language that comes first by name; a null text, or one without a letter, is ``und`` with score 0 and not ambiguous; with
no labelled row at all every text is ``und``; with one language, that one with score 1.  Repeated rows and null ids are predicted
as they are (a null id is not held out and never learned from); an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, table
from .textstats import ngram_counts

ORDERS, BITS, SAMPLE, TOTAL, FEWEST, ROWS = (2, 3, 4), 13, 1000, 8000, 20, 1000
STEPS, RATE, DECAY = 80, 12.0, 1e-4
AMBIGUOUS = 0.2
REJECT, PASSAGE = 0.75, 200
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")


def codewords(n: int) -> np.ndarray:
    """``n`` codewords of -1 and 1: rows of Sylvester's Hadamard matrix without its constant columns."""
    h = np.ones((1, 1))
    while len(h) < max(8, n + 1):
        h = np.block([[h, h], [h, -h]])
    code = h[1 : n + 1]
    return code[:, (code != code[0]).any(0)] if n > 1 else code


def features(text: str) -> np.ndarray:
    counts = np.sqrt(ngram_counts(np.frombuffer(text.lower().encode(), np.uint8), ORDERS, BITS)).astype(np.float32)
    return counts / max(1.0, float(np.linalg.norm(counts)))


def costs(margin: np.ndarray, code: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """What each codeword costs a text with these margins."""
    return (np.logaddexp(0, -code * margin) * trust).sum(1)


@dataclass
class LanguageModel:
    languages: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None  # feature by bit
    bias: np.ndarray | None = None
    trust: np.ndarray | None = None  # of each bit, adding up to the number of bits
    limit: float = float("inf")  # of the cheapest codeword's cost

    def costs(self, text: str) -> np.ndarray:
        return costs(features(text) @ self.weights + self.bias, codewords(len(self.languages)), self.trust)

    def rejects(self, text: str) -> bool:
        """Whether half of the passages, those without a letter included, are of no language."""
        passages = [text[i : i + PASSAGE] for i in range(0, len(text), PASSAGE)]
        return 2 * sum(not LETTER.search(p) or self.costs(p).min() > self.limit for p in passages) >= len(passages)

    def predict(self, text: str | None, strict: bool = False) -> tuple[str, float, bool]:
        if not self.languages or text is None or not LETTER.search(text):
            return UNDETERMINED, 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        cost = self.costs(text)
        if strict and cost.min() > self.limit and self.rejects(text):
            return UNDETERMINED, 0.0, False
        p = np.exp(cost.min() - cost)
        p /= p.sum()
        first, second = np.argsort(-p, kind="stable")[:2]
        return self.languages[first], float(p[first]), bool(p[first] - p[second] < AMBIGUOUS)


Sparse = tuple[np.ndarray, np.ndarray]  # places and values of a row


def dense(rows: list[Sparse]) -> np.ndarray:
    x = np.zeros((len(rows), 1 << BITS), np.float32)
    for i, (places, values) in enumerate(rows):
        x[i, places] = values
    return x


def fit(rows: list[Sparse], langs: list[str]) -> LanguageModel:
    """One logistic classifier a bit, all at once, by gradient steps with momentum; ``ROWS`` rows are made dense at a time."""
    names = sorted(set(langs))
    if len(names) < 2:
        return LanguageModel(names)
    number = {v: i for i, v in enumerate(names)}
    which = np.array([number[v] for v in langs])
    code = codewords(len(names))
    target = code[which].astype(np.float32)
    share = (1 / np.bincount(which)[which] / len(names)).astype(np.float32)[:, None]  # languages count alike
    blocks = [slice(i, i + ROWS) for i in range(0, len(rows), ROWS)]
    held = [dense(rows[own]) for own in blocks[:8]]  # what is dense at once is bounded
    part = lambda i: held[i] if i < len(held) else dense(rows[blocks[i]])
    w, b = np.zeros((1 << BITS, target.shape[1]), np.float32), np.zeros(target.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(STEPS):
        vw, vb = 0.9 * vw - DECAY * w, 0.9 * vb
        for i, own in enumerate(blocks):
            x = part(i)
            pull = share[own] * target[own] / (1 + np.exp(target[own] * (x @ w + b)))
            vw += x.T @ pull
            vb += pull.sum(0)
        w, b = w + RATE * vw, b + RATE * vb
    margin = np.concatenate([part(i) @ w + b for i in range(len(blocks))])
    trust = np.maximum(((target * margin > 0) * share).sum(0) - 0.5, 1e-3)
    trust = trust / trust.sum() * len(trust)
    most = max(float(costs(m, code, trust).min()) for m in margin)
    unknown = float(costs(np.zeros(len(trust)), code, trust)[0])
    return LanguageModel(names, w, b, trust, most + REJECT * max(0.0, unknown - most))


def train(labelled: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Fit on about ``sample`` rows of each language of ``doc_id, text, lang``, fewer if languages are many."""
    known = labelled.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").count()  # a row a language, far less than the model has for it
    languages = counts.count()
    each = max(FEWEST, min(sample, TOTAL // max(1, languages)))
    chance = (F.xxhash64(F.col("doc_id")) % F.lit(1 << 30) + F.lit(1 << 30)) / F.lit(float(1 << 31))
    chosen = known.join(F.broadcast(counts), "lang").filter(chance < F.lit(float(each)) / F.col("count")).select("lang", "text")

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()) for t in b.column("text")]
            places = [np.flatnonzero(v).astype(np.int32) for v in x]
            yield pa.RecordBatch.from_arrays(
                [b.column("lang"), pa.array(places, pa.list_(pa.int32())), pa.array([v[p] for v, p in zip(x, places)], pa.list_(pa.float32()))],
                ["lang", "places", "values"],
            )

    rows = chosen.mapInArrow(featurize, "lang string, places array<int>, values array<float>").toArrow()
    sparse = [(p.values.to_numpy(zero_copy_only=False), v.values.to_numpy(zero_copy_only=False)) for p, v in zip(rows["places"], rows["values"], strict=True)]
    return fit(sparse, rows["lang"].to_pylist())


def identify(docs: DataFrame, model: LanguageModel, strict: bool = False) -> DataFrame:
    """The rows of ``docs`` with ``lang_pred, score, ambiguous``; a column of such a name is replaced.

    If ``strict``, texts that the decoder rejects are ``und``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score", "ambiguous")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [shared.value.predict(t.as_py(), strict) for t in b.column("text")]
            more = [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "lang_pred", "score", "ambiguous"])

    more = T.StructType().add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return kept.mapInArrow(run, T.StructType(kept.schema.fields + more.fields))


def held_out(column: str = "doc_id"):
    return F.coalesce(fold(column, 4) == 2, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out()))
    found = identify(docs.select("doc_id", "text").withColumn("held_out", held_out()), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
