"""That registered queries work on all of their input."""

from functools import lru_cache

import pytest

from lexiloom import catalog
from lexiloom.config import EDIT_DISTANCE
from lexiloom.plans import search


@pytest.fixture
def folder(spark, tmp_path):
    def make(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


DOCS = "doc_id long, text string"


def test_stopword_filter_returns_every_token(spark, folder):
    words = [f"w{i}" for i in range(50)]
    d = folder(documents=([(1, " the ".join(words) + " and"), (2, None)], DOCS))
    got = {r.doc_id: (r.n, r.tokens) for r in catalog.queries()["stopword_filter"](spark, d).collect()}
    assert got == {1: (50, " ".join(words)), 2: (0, "")}


def test_parse_query_batch_parses_every_word(spark, folder):
    words = [f"w{i}" for i in range(12)]
    d = folder(benchmark=([(i, " ".join(words)) for i in (3, 4, 5)], "item_id long, text string"))
    got = {r.item_id: r for r in catalog.queries()["parse_query_batch"](spark, d).collect()}
    assert got[3].query == " AND ".join(words) and sorted(got[3].required) == sorted(words)
    assert got[4].phrases == [words] and not got[4].optional
    assert sorted(got[5].optional) == sorted(words[:-1]) and got[5].excluded == words[-1:]


def test_codec_and_dump_take_every_term(spark, folder):
    d = folder(documents=([(1, "zebra apple zebra the zebra"), (2, "apple 42"), (3, None)], DOCS))
    run = lambda name: {tuple(r) for r in catalog.queries()[name](spark, d).collect()}
    assert run("gap_encode") == {("zebra", 1, "0,2,1"), ("apple", 1, "1"), ("apple", 2, "0"), ("42", 2, "1")}
    assert run("gap_decode") == {("zebra", 1, "0,2,3"), ("apple", 1, "1"), ("apple", 2, "0"), ("42", 2, "1")}
    assert run("index_dump") == {
        ("zebra", "zebra -> [Doc 1, TF=3, Pos=(0,2,3)]"),
        ("apple", "apple -> [Doc 1, TF=1, Pos=(1); Doc 2, TF=1, Pos=(0)]"),
        ("42", "42 -> [Doc 2, TF=1, Pos=(1)]"),
    }


def brute_osa(a, b):
    @lru_cache(None)
    def d(i, j):
        if not i or not j:
            return i + j
        best = min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            best = min(best, d(i - 2, j - 2) + 1)
        return best

    return d(len(a), len(b))


def test_osa_candidates_up_to_distance_two(spark, folder):
    vocab = "there three tree the ther other erin ernie thorn thon python zzzqqq tehrs threat hter tr t ethr h42".split()
    d = folder(documents=([(1, " ".join(vocab)), (2, "there ther")], DOCS))
    freq = {w: 1 + (w in ("there", "ther")) for w in vocab}
    want = {(w, v, freq[v], n) for w in search.MISSPELT for v in vocab if (n := brute_osa(w, v)) <= EDIT_DISTANCE}
    got = [tuple(r) for r in catalog.queries()["osa_candidates"](spark, d).collect()]
    assert set(got) == want and len(got) == len(want) and {n for *_, n in want} == {0, 1, 2}


def test_pagerank_converges(spark, folder):
    pairs = [(s, p) for s in range(1, 6) for p in range(1, 13) if (s * p + s) % 4 < 2]
    d = folder(lineitem=(pairs, "l_suppkey long, l_partkey long"))
    edges = [(f"s{s}", f"p{p}") for s, p in pairs] + [(f"p{p}", f"s{s}") for s, p in pairs if p % 3]
    nodes = sorted({x for e in edges for x in e})
    to = {n: [b for a, b in edges if a == n] for n in nodes}
    ranks = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(500):
        spread = sum(ranks[n] for n in nodes if not to[n]) / len(nodes)
        new = {n: 0.15 / len(nodes) + 0.85 * spread for n in nodes}
        for n in nodes:
            for m in to[n]:
                new[m] += 0.85 * ranks[n] / len(to[n])
        ranks = new
    q = catalog.queries()
    got = {r.node: r.score for r in q["pagerank_converged"](spark, d).collect()}
    assert set(got) == set(nodes) and sum(abs(got[n] - ranks[n]) for n in nodes) < 1e-3
    fixed = {r.node: r.score for r in q["pagerank_fixed"](spark, d).collect()}
    assert sum(abs(fixed[n] - ranks[n]) for n in nodes) < 1e-3
    assert [r.node for r in q["pagerank_top10"](spark, d).collect()] == sorted(nodes, key=lambda n: (-got[n], n))[:10]
    assert [tuple(r) for r in q["pagerank_sum"](spark, d).collect()] == [(True, len(nodes))]
