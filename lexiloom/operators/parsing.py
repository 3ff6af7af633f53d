"""The query language: phrases, AND / OR / NOT with a sticky mode, and its batch form."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.analyzers import STOP_WORDS
from lexiloom.functions.stemmer import stem
from lexiloom.schemas import STRUCTURED_QUERY

PHRASE = re.compile(r'(not\s+)?"([^"]*)"', re.IGNORECASE)
_WORDS, _STOP = re.compile("[a-z0-9]+"), frozenset(STOP_WORDS)


def basic(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def plain(text: str) -> list[str]:
    return [w for w in basic(text) if w not in _STOP]


def stemmed(text: str) -> list[str]:
    return [stem(w) for w in plain(text)]


@dataclass
class StructuredQuery:
    required: list[str] = field(default_factory=list)
    optional: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    phrases: list[list[str]] = field(default_factory=list)
    excluded_phrases: list[list[str]] = field(default_factory=list)

    @property
    def searchable(self) -> bool:
        return bool(self.required or self.optional or self.phrases)

    @property
    def any_of_terms(self) -> bool:
        """Nothing but optional terms: the candidates are the documents that score."""
        return bool(self.optional) and not (self.required or self.excluded or self.phrases or self.excluded_phrases)

    @property
    def scored_terms(self) -> list[str]:
        return list(dict.fromkeys(self.required + self.optional))

    @property
    def may_augment(self) -> bool:
        return not (self.required or self.excluded or self.phrases or self.excluded_phrases)


def parse(query: str, analyze=stemmed) -> StructuredQuery:
    """Phrases first, wherever they stand; then words by the mode that the latest operator set.

    If the first operator is AND, the words before it are required too."""
    out = StructuredQuery()
    for negated, words in PHRASE.findall(query):
        if terms := analyze(words):
            (out.excluded_phrases if negated else out.phrases).append(terms)
    by_mode = {"AND": out.required, "OR": out.optional, "NOT": out.excluded}
    mode, first = "OR", True
    for word in PHRASE.sub(" ", query).split():
        if word not in by_mode:
            by_mode[mode] += analyze(word)
            continue
        if first and word == "AND":
            out.required[:] = out.optional + out.required
            out.optional.clear()
        mode, first = word, False
    return out


def parse_udf(analyze=stemmed):
    """The parser over a table of queries."""

    @F.pandas_udf(STRUCTURED_QUERY)
    def run(queries: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([asdict(parse(q or "", analyze)) for q in queries], columns=STRUCTURED_QUERY.names)

    return run


def parse_table(queries: DataFrame, analyze=stemmed) -> DataFrame:
    return queries.withColumn("parsed", parse_udf(analyze)("query"))


def searchable(parsed: DataFrame) -> DataFrame:
    """The queries with something to search for; one of exclusions alone has not."""
    return parsed.filter(F.size("parsed.required") + F.size("parsed.optional") + F.size("parsed.phrases") > 0)
