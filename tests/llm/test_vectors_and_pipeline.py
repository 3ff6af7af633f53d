import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from lexiloom.llm import entries, minhash, multi_index, neighbours, suffix_dedup

VECTORS = T.StructType().add("vec_id", "long").add("embedding", T.ArrayType(T.FloatType())).add("label", "integer").add("cell", "string").add("ids", "string")
ODD = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]


def vectors(spark, x, labels, ids=None):
    rows = [(int(i), v.tolist(), l, "x", "y") for i, v, l in zip(ids if ids is not None else range(len(x)), x, labels)]
    rows += [(10_000 + i * 20, v, 1, "x", "y") for i, v in enumerate(ODD)] + [(None, [1.0] * 16, 1, "x", "y")]
    return spark.createDataFrame(rows, VECTORS)


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    x[100:160] = x[3]  # copies tie
    for name, value in (("BLOCK_BYTES", 100 * 16 * 8), ("LEAF", 60), ("SCORES", 500)):
        monkeypatch.setattr(neighbours, name, value)
    df = vectors(spark, x, [0] * 900)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    d, found, total = x.astype(np.float64), 0, 0
    assert set(got) == set(range(0, 900, 20))
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21)) and q not in [r[1] for r in rows]
        scores = (d * d[q]).sum(1)
        assert all(s == scores[v] for _, v, s in rows) and [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        best = [v for v in np.lexsort((np.arange(900), -scores)) if v != q][:20]
        found += len(set(best) & {v for _, v, _ in rows})
        total += 20
        if q in range(100, 160):
            assert [v for _, v, _ in rows] == best  # of equal vectors the smallest ids
    assert found >= 0.9 * total
    few = vectors(spark, x[:4], [0] * 4)
    assert sorted((r.query_id, r["rank"]) for r in neighbours.nearest(few, F.col("vec_id") % 20 == 0).collect()) == [(0, 1), (0, 2), (0, 3)]
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


def test_neighbours_of_equal_score_go_by_id(spark):
    """Integer vectors, whose scores tie without the vectors being equal; a vector that a third of all rows are, queries too."""
    rng = np.random.default_rng(3)
    x = rng.integers(-1, 2, (600, 16)).astype(np.float32)
    x[~x.any(1)] = 1
    x[rng.permutation(600)[:200]] = x[7]
    ids = rng.permutation(4000)[:600]
    got = {}
    for r in neighbours.nearest(vectors(spark, x, [0] * 600, ids), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    d, right = x.astype(np.float64), 0
    for i in np.flatnonzero(ids % 20 == 0):
        scores = d @ d[i]
        best = [j for j in np.lexsort((ids, -scores)) if j != i][:20]
        right += [(n + 1, int(ids[j]), scores[j]) for n, j in enumerate(best)] == sorted(got[ids[i]])
    assert right >= 0.9 * len(got) and len(got) == (ids % 20 == 0).sum()
    twice = spark.createDataFrame([(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (2, [0.0, 3.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in neighbours.nearest(twice, F.col("vec_id") % 20 == 0).orderBy("rank").collect()][:2] == [(20, 1, 2, 3.0), (20, 2, 1, 2.0)]


def test_best_of_keeps_the_smallest_ids_of_ties():
    rng = np.random.default_rng(4)
    x, q = rng.integers(-2, 3, (306, 8)).astype(float), rng.integers(-2, 3, (40, 8)).astype(float)
    ids = rng.permutation(306)
    r, scores, found = neighbours.best_of(q, x, __import__("pyarrow").array([[int(i)] for i in ids]), 21)
    for i in range(40):
        exact = x @ q[i]
        best = np.lexsort((ids, -exact))[:21]
        assert found[r == i].tolist() == ids[best].tolist() and scores[r == i].tolist() == exact[best].tolist()


def test_embedding_near_duplicates(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 16))
    x = np.concatenate([base[i % 12][None] + rng.standard_normal((1, 16)) * rng.choice([0, 0.05, 0.15]) for i in range(500)]).astype(np.float32) * 3
    labels = [None if i % 50 == 0 else i % 3 for i in range(500)]
    monkeypatch.setattr(multi_index, "BLOCK", 40)
    df = vectors(spark, x, labels)
    got = {r.vec_id: r for r in multi_index.near_duplicates(df).collect()}
    d = x.astype(np.float64)
    cos = d @ d.T / np.outer(np.linalg.norm(d, axis=1), np.linalg.norm(d, axis=1))
    same = np.array([[a is not None and a == b for b in labels] for a in labels])
    link = (cos >= 0.98) & same & ~np.eye(500, dtype=bool)
    up = list(range(500))
    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, j in zip(*np.nonzero(link)):
        i, j = find(i), find(j)
        up[max(i, j)] = min(i, j)
    n = link.sum(1)
    assert sum(got[i].n_links for i in range(500)) >= 0.99 * n.sum() and all(got[i].n_links <= n[i] for i in range(500))
    assert np.mean([got[i].component_id == find(i) for i in range(500)]) >= 0.98
    assert all(got[i].n_links == 0 and got[i].kept for i in range(0, 500, 50)) and all(got[10_000 + 20 * i].kept for i in range(len(ODD)))
    assert len(got) == 500 + len(ODD)
    assert multi_index.near_duplicates(df.limit(0)).count() == 0


def test_every_query_is_registered():
    names = entries.queries()
    assert [sum(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)] == [1] * 10 and set(entries.oracle_sql()) <= set(names)


def test_pipeline_stages(spark, tmp_path):
    rng = np.random.default_rng(3)
    vocab = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(800)]
    prose = lambda n: " ".join(rng.choice(vocab, n))
    passage = prose(70)
    texts = [prose(80) for _ in range(60)] + ["buy! | " * 60 for _ in range(20)]
    texts[10], texts[20], texts[30] = texts[5], prose(30) + " " + passage + " " + prose(30), prose(40) + " " + passage
    rows = [(i, t, "en", "s", len(t), "kept") for i, t in enumerate(texts)] + [(90, None, None, None, None, "kept"), (91, "123", "en", "s", 3, "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out, now = [], docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns == docs.columns
        out.append({r.doc_id: r for r in now.collect()})
    assert set(out[0]) == set(range(80)) and set(out[1]) == set(range(60))
    assert set(out[2]) == set(range(60)) - {10} and set(out[3]) == set(out[2])
    assert passage in out[3][20].text and passage not in out[3][30].text and out[3][30].n_chars == len(out[3][30].text)
    assert all(out[3][i].text == texts[i] and out[3][i].score == "kept" for i in out[3] if i != 30)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(out[3])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "MinHash near-dedup", "suffix-array dedup", "best-fit packing"]
    assert minhash.WORDS == 5 and minhash.PERCENT == 80 and suffix_dedup.LEAST == 100


def test_pipeline_edges(spark, tmp_path):
    """Repeated rows, ties, null ids and texts, a very long text, clashing columns; and an empty table."""
    rng = np.random.default_rng(31)
    vocab = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocab, n))
    texts = [prose(60) for _ in range(40)]
    long = prose(200_000)
    rows = [(i, t, "en", "s", len(t), "kept") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (3, prose(70), "en", "s", 1, "kept"), (45, texts[5], "en", "s", 1, "kept"), (None, texts[7], None, None, None, "kept"), (None, prose(50), None, None, None, "kept")]
    rows += [(50, None, "en", "s", None, "kept"), (51, "", "en", "s", 0, "kept"), (52, long, "en", "s", len(long), "kept"), (53, long + " end", None, "s", None, "kept")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, length string"
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out, now = [], docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns == docs.columns
        out.append(now.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out[0]) == sorted((r[0] is None, r[0] or 0) for r in rows if r[0] not in (50, 51))
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in out[2])
    assert ids == sorted([(False, i) for i in [*range(40), 3, 52]] + [(True, 0)])  # one of each group: copies, a repeated id, a null id
    assert sorted(r.text for r in out[3]) == sorted(r.text for r in out[2]) and {r.length for r in out[3]} == {"kept"}
    packed = corpus_pipeline.STAGES[4][1](spark, now, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in out[3]} and max(r.piece for r in packed) > 50
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0
