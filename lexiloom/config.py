"""Parameters with the values that results depend on (fixed values)."""

from dataclasses import dataclass


@dataclass(frozen=True)
class BM25:
    k1: float = 1.2
    b: float = 0.75


@dataclass(frozen=True)
class Fusion:
    bm25: float = 0.85
    pagerank: float = 0.15
    phrase_bonus: float = 2.0
    #: Normalised PageRank when all scores are equal.
    flat_pagerank: float = 1.0


SERVER_FUSION = Fusion()
ENGINE_FUSION = Fusion(bm25=0.7, pagerank=0.3, phrase_bonus=0.0, flat_pagerank=0.0)


@dataclass(frozen=True)
class Semantic:
    top_k: int = 30
    weight: float = 0.7
    augment_k: int = 15


@dataclass(frozen=True)
class PageRank:
    damping: float = 0.85
    iterations: int = 30
    tolerance: float = 1e-6


SNIPPET_WINDOW, MAX_QUERY_LENGTH, MAX_PAGE_SIZE, PAGE_SIZE, SUGGEST_LIMIT, EDIT_DISTANCE = 12, 200, 50, 10, 10, 2
CACHE_SIZE, RATE_PER_MINUTE, CRAWL_DELAY_S, MAX_URL, MAX_DEPTH = 256, 30, 1.0, 2000, None
K1_GRID, B_GRID = (0.8, 1.0, 1.2, 1.4, 1.6, 1.8, 2.0), (0.0, 0.25, 0.5, 0.75, 1.0)
WEIGHT_GRID = tuple(i / 10 for i in range(11))
BIAS_RATIO = 5.0

#: What is said of a query that cannot be searched.
QUERY_ERRORS = {
    "missing": "Query parameter is required.",
    "control": "Query contains invalid control characters.",
    "empty": "Query cannot be empty.",
    "long": "Query is too long (max 200 characters).",
    "no_word": "Query must contain at least one letter or number.",
}
