"""That training-data operators do the whole of their job."""

import random
from collections import Counter

import numpy as np

import corpus_pipeline
from lexiloom.llm import language_id, minhash, packing, textstats


def test_language_stage_drops_noise_with_letters(spark):
    rng = random.Random(11)
    letters = {"aa": "abcdei ", "bb": "mnopqu ", "cc": "rstvwxé "}
    text = lambda chars: "".join(rng.choice(chars) for _ in range(rng.randint(30, 120)))
    rows = [(i, text(letters[lang]), lang) for i in range(300) for lang in [rng.choice(list(letters))]]
    noise = [(1000 + i, text("0123456789#%$|;:@!? z"), None) for i in range(30)] + [(1100 + i, text("бгджзклп "), None) for i in range(30)]
    noise = [r for r in noise if language_id.LETTER.search(r[1])]
    assert len(noise) > 40
    rows += [(400 + i, " ".join("".join(rng.choice(letters[lang]) for _ in range(600)) for lang in letters), None) for i in range(5)]  # mixtures stay
    docs = spark.createDataFrame(rows + noise, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert kept == {r[0] for r in rows}


def test_words_longer_than_a_block(monkeypatch):
    rng = random.Random(12)
    texts = ["word " * 400 + "x" * 700 + " tail words here", "x" * 256, "x" * 512 + " y", "", " ", "é" * 300, "ab " + "q" * 254 + "\n" + "z" * 1024 + "!" + "z" * 255]
    texts += ["".join(rng.choice("ab") * rng.randint(1, 400) + rng.choice(" !\n") * rng.randint(0, 2) for _ in range(30)) for _ in range(40)]
    for inside in (textstats.IN_WORD, ~minhash.SEPARATOR):
        raws = [np.frombuffer(t.encode(), np.uint8) for t in texts]
        monkeypatch.setattr(textstats, "BLOCK", 1 << 20)
        whole = [textstats.word_hashes(r, inside) for r in raws]
        monkeypatch.setattr(textstats, "BLOCK", 256)
        assert all((w.shape == s.shape and (w == s).all()) for w, s in zip(whole, (textstats.word_hashes(r, inside) for r in raws), strict=True))
    assert len(whole[0]) == 404


def test_shingles_of_a_word_of_three_mib(spark):
    long = "W" * (3 << 20)
    docs = spark.createDataFrame([(1, "a b c d " + long), (2, long), (3, long[:-1] + "V")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.kept) for r in minhash.near_duplicates(docs, words=3, percent=85).collect()}
    assert got == {1: (3, True), 2: (1, True), 3: (1, True)}


def test_near_duplicates_of_rows_with_one_id_or_none(spark):
    rng = random.Random(13)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    a, b, c, e, f = (prose() for _ in range(5))
    rows = [(7, a, "x"), (7, a, "x"), (7, b, "x"), (3, b + " end", "x"), (None, c, "x"), (None, c, "x"), (None, e, "x"), (9, e, "x"), (5, f, "x"), (None, None, "x"), (11, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string").repartition(3)
    now = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert now.columns == docs.columns
    want = [(7, a, "x"), (3, b + " end", "x"), (None, c, "x"), (9, e, "x"), (5, f, "x"), (None, None, "x"), (11, "", "x")]
    assert sorted(map(repr, map(tuple, now.collect()))) == sorted(map(repr, want))


def left_over(bins, capacity):
    """Whether some piece can move, or be exchanged one for one or two for one, into a fuller bin."""
    groups = sorted((sum(b), b) for b in bins if sum(b) < capacity)
    for i, (_, low) in enumerate(groups):
        ones = set(low)
        twos = {a + b for k, a in enumerate(low) for b in low[k + 1 :]}
        for total, high in groups[i:]:
            if low == high and bins[low] < 2:
                continue
            room, downs = capacity - total, set(high)
            if any(0 < u <= room for u in ones) or any(0 < u - d <= room for u in ones | twos for d in downs):
                return True
    return False


def test_local_search_leaves_no_exchange():
    rng = random.Random(14)
    for capacity, counts in [(2048, Counter(rng.randint(600, 760) for _ in range(3000)))] + [(30, Counter(rng.randint(1, 30) for _ in range(50))) for _ in range(20)]:
        better = packing.local_search(packing.best_fit(counts, capacity), capacity)
        held = Counter()
        for content, n in better.items():
            assert sum(content) <= capacity and n > 0
            for size in content:
                held[size] += n
        assert held == counts
        least = -(-sum(k * n for k, n in counts.items()) // capacity)
        assert sum(better.values()) == least or not left_over(better, capacity)
