import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import chat, components, induced, language_id, minhash, quality, suffix_dedup, textstats


def frame(spark, rows, more=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("band", "cluster", "component_id", "score", "digest", "target") if more else ():
        df = df.withColumn(c, F.lit("clash"))
    return df


# Chat


def brute_windows(turns, budget, history):
    cost = [-(-len(t) // 4) + chat.TURN_TOKENS for _, t in turns]
    system = bool(turns) and turns[0][0] == "system"
    room, out, first = max(1, budget - history - (cost[0] if system else 0)), [], 0
    while first < len(turns):
        after = first + 1
        while after < len(turns) and sum(cost[first : after + 1]) <= room:
            after += 1
        back = first
        while back > 0 and sum(cost[back - 1 : first]) <= history and back - 1 >= system:
            back -= 1
        shown = ([0] if system and first > 0 else []) + list(range(back, after))
        out.append([(i, i < first) for i in shown])
        first = after
    return out


def test_chat_windows(spark):
    rng = random.Random(1)
    rows = []
    for conv in range(12):
        for turn in range(rng.randint(1, 14)):
            role = "system" if turn == 0 and conv % 2 else rng.choice(["user", "assistant", None])
            rows.append((conv, turn, role, rng.choice(["", None, "<|end|>&amp;[x]&lt;", "é" * rng.randint(0, 90), "</s>" * 20])))
    rows += [(None, None, "user", "x"), (3, 5, "user", "tie"), (3, 5, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.windows(df, 40, 12)
    by_conv = {}
    for r in made.collect():
        by_conv.setdefault(r.conv_id, {})[r.window] = r
    key = lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        want = brute_windows(turns, 40, 12)
        got = [by_conv[conv][w] for w in sorted(by_conv[conv])]
        assert [[(s.turn_index, s.repeated) for s in w.spans] for w in got] == want
        assert all(s.loss == (not s.repeated and turns[s.turn_index][0] == "assistant") for w in got for s in w.spans)
        assert back[conv].n_turns == len(turns)
        assert back[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (back[conv].loss_chars, back[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert all("</s>" not in w.formatted and "[" not in w.formatted for w in got)
    assert chat.read_back(chat.windows(df.limit(0))).count() == 0


def test_a_very_long_conversation(spark, monkeypatch):
    """Twenty thousand turns, in shuffled rows with clashing columns, in time that grows with the turns."""
    rng = random.Random(21)
    roles = ["system"] + ["user", "assistant"] * 10_000
    texts = ["".join(rng.choice("ab <&[") for _ in range(rng.randint(0, 160))) for _ in roles]
    rows = [(1, i, r, t, "x", "y") for i, (r, t) in enumerate(zip(roles, texts))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, upto string, parts string")
    monkeypatch.setattr(chat, "STARTS", 64)
    got = chat.read_back(chat.windows(df)).collect()[0]
    assert got.n_turns == len(rows) and got.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in zip(roles, texts)).encode()).hexdigest()
    loss = "".join(b for a, b in zip(roles, texts) if a == "assistant")
    assert (got.loss_chars, got.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


# MinHash and components


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)] + [(5, 5), (7, 1), (1, 7)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    up = {}
    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(up)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def word_sets(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def near(spark, rows, words, percent):
    got = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, rows), words, percent).collect()}
    sets = {i: word_sets(t, words) for i, t in rows}
    up = {i: i for i in sets}
    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, monkeypatch, words, percent):
    rng, rows = random.Random(3), []
    vocab = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocab) for _ in range(160)]
    for i in range(70):  # a group of graded similarity, so that links chain
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            own[rng.randrange(len(own))] = rng.choice(vocab)
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(rng.choice(vocab) for _ in range(40))) for i in range(20)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "ONE"), (205, "one two"), (206, "É é"), (207, "é é"), (208, rows[0][1]), (209, "x y"), (210, "tok " * 5000)]
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 1500)  # several blocks a cluster
    monkeypatch.setattr(minhash, "STAR", 7)  # and several tasks a bucket
    near(spark, rows, words, percent)
    monkeypatch.setattr(minhash, "MATRIX_BYTES", 0)
    near(spark, rows[:40], words, percent)


def test_near_duplicates_edges(spark):
    got = minhash.near_duplicates(frame(spark, [(None, "a b c d e"), (1, "a b c d e"), (1, "p q r s t u"), (2, "p q r s t u")])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1)} and len(got) == 2
    assert minhash.near_duplicates(frame(spark, []).limit(0)).count() == 0


def test_signature_is_circulant():
    x = minhash.shingles("a b c d e f g h i j", 3)
    sig = minhash.signature(x, 30)
    place = (textstats.mix(x ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint64)
    for k in range(30):
        assert sig[k] == minhash._second(((place + np.uint64(k)) % np.uint64(1 << 32)).astype(np.uint32)).min()
    assert len(np.unique(minhash._second(np.arange(1 << 16, dtype=np.uint32)))) == 1 << 16


# Suffix arrays


def suffixes_by_brute_force(t):
    rows = sorted(range(len(t)), key=lambda i: tuple(t[i:]))
    common = [0] * min(1, len(t))
    for x, y in zip(rows, rows[1:]):
        a, b = t[x:], t[y:]
        n = min(len(a), len(b))
        common.append(n if (a[:n] == b[:n]).all() else int((a[:n] != b[:n]).argmax()))
    return rows, common


@pytest.mark.parametrize("memory", [0, 10**8])
@pytest.mark.parametrize("base", [0, 5, 1 << 20])
def test_induced_sort(monkeypatch, tmp_path, memory, base):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(induced, "BASE", base)
    for i in range(120):
        monkeypatch.setattr(induced, "CHUNK", int(rng.integers(1, 9)))
        t = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(1, 60)))
        t = np.tile(t[:7], 8) if i % 7 == 0 else t
        sa, common = induced.induced_sort(t, str(tmp_path), memory)
        assert (sa.tolist(), common.tolist()) == suffixes_by_brute_force(t)
    assert not list(tmp_path.iterdir())


def test_induced_sort_with_ranges_of_several_symbols(monkeypatch, tmp_path):
    rng = np.random.default_rng(5)
    for name, value in (("OWN_RANGES", 2), ("BASE", 0), ("CHUNK", 9), ("RANGE", 12), ("BATCH", 4)):
        monkeypatch.setattr(induced, name, value)
    for _ in range(150):
        t = rng.integers(0, int(rng.integers(3, 50)), int(rng.integers(1, 120)))
        scratch = induced.Scratch(str(tmp_path), int(rng.integers(0, 300)))
        text = induced.padded(len(t), scratch)
        text[: len(t)] = t
        order = np.concatenate([a for a, _ in induced._descending(text, len(t), int(t.max()) + 1, scratch, False)])[::-1]
        assert order.tolist() == suffixes_by_brute_force(t)[0]


def test_a_text_larger_than_memory_is_sorted_on_disk(tmp_path):
    """At the production setting: the recursion's names exceed what is sorted in memory, arrays and queues go to files."""
    rng = np.random.default_rng(6)
    words = [rng.integers(2, 28, int(rng.integers(2, 9))) for _ in range(3000)]
    t = np.concatenate([np.append(words[i], 1) for i in rng.integers(0, len(words), 1_200_000)])
    scratch = induced.Scratch(str(tmp_path))
    text = induced.padded(len(t), scratch)
    text[: len(t)] = t
    rank, held = np.zeros(len(t) + 1, np.int32), 0
    rank[len(t)], n = -1, len(t)
    order, common = [], []
    for suffixes, prefixes in induced.descending(text, scratch):
        order.append(suffixes.copy())
        common.append(prefixes.copy())
        held = max(held, scratch.held)
    order, common = np.concatenate(order).astype(np.int64), np.concatenate(common)
    rank[order] = np.arange(n, 0, -1)
    assert (np.sort(order) == np.arange(n)).all()
    # A suffix is less than another if its symbol is, or that is equal and what follows is less.
    a, b = order[1:], order[:-1]
    assert ((t[a] < t[b]) | ((t[a] == t[b]) & (rank[a + 1] < rank[b + 1]))).all()
    some = rng.integers(1, n, 3000)
    for i in some.tolist():
        x, y = t[order[i] : order[i] + 100], t[order[i - 1] : order[i - 1] + 100]
        m = min(len(x), len(y))
        assert common[i] == (m if (x[:m] == y[:m]).all() else (x[:m] != y[:m]).argmax())
    assert len(t) > 6 * (1 << 20) and scratch.spilled > 2 * scratch.memory and held < 2 * scratch.memory


def brute_repeats(rows, least=suffix_dedup.LEAST):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for p in range(len(b) - least + 1):
            w = b[p : p + least]
            if w in seen:
                cover[p] += 1
                cover[p + least] -= 1
            seen.add(w)
        gone = np.cumsum(cover[:-1]) > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_remove_repeats(spark, monkeypatch):
    rng = random.Random(5)
    make = lambda n, a="abcdefgh é": "".join(rng.choice(a) for _ in range(n))
    shared = [make(150), make(99), make(101), make(100), make(400, "ab")]
    rows = [(i, make(rng.randint(0, 300)) + rng.choice(shared) + make(rng.randint(0, 200)) + rng.choice(shared)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "z" * 3000), (103, "z" * 90), (104, rows[3][1]), (105, shared[0][:99]), (106, "xy" * 400), (107, make(9000)), (None, rows[7][1])]
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 5000)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 12)  # several pieces a long document
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digests(frame(spark, rows).repartition(5)).collect()}
    assert got == brute_repeats(rows)
    texts = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, rows).withColumn("n_chars", F.length("text").cast("long"))).collect()}
    assert texts[104].text == "" and texts[104].n_chars == 0 and texts[104].band == "clash" and texts[100].text is None and texts[107].text == rows[-2][1]
    assert suffix_dedup.digests(frame(spark, rows).limit(0)).count() == 0


# Classifiers


def languages(rng, n):
    letters = {"aa": "abcdei ", "bb": "mnopqu ", "cc": "rstvwxé "}
    out = []
    for i in range(n):
        lang = rng.choice(list(letters))
        out.append((i, "".join(rng.choice(letters[lang]) for _ in range(rng.randint(30, 120))), lang if rng.random() < 0.9 else None, lang))
    return out


def test_language_id(spark):
    rows = languages(random.Random(6), 400)
    extra = [(900, None, "aa", "und"), (901, "", "aa", "und"), (902, "123 !?", "bb", "und"), (None, "abcdei abc", None, "aa")]
    df = spark.createDataFrame([r[:3] for r in rows + extra], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = language_id.train(df.filter(~language_id.held_out()))
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert all(got[r[0]].lang_pred == r[3] for r in rows + extra) and all(0 <= r.score <= 1 for r in got.values()) and got[900].score == 0
    nobody = language_id.train(df.filter("false"))
    assert {r.lang_pred for r in language_id.identify(df, nobody).collect()} == {"und"}
    one = language_id.train(df.filter("lang = 'aa'"))
    assert {(r.lang_pred, r.score) for r in language_id.identify(df, one).filter("doc_id < 400").collect()} == {("aa", 1.0)}
    assert language_id.identify(df.limit(0), model).count() == 0


def test_decoding_by_brute_force():
    """The loss-weighted nearest codeword, found by going through all codewords and bits one by one."""
    import math

    rng = np.random.default_rng(11)
    for n in (2, 3, 5, 9):
        names, code = [f"l{i}" for i in range(n)], language_id.codewords(n)
        model = language_id.LanguageModel(names, rng.standard_normal((1 << language_id.BITS, code.shape[1])), rng.standard_normal(code.shape[1]), rng.random(code.shape[1]) + 0.1)
        for _ in range(30):
            text = "".join(rng.choice(list("abcdeé xyz"), int(rng.integers(1, 40)))) + "a"
            x = language_id.features(text)
            cost = [sum(model.trust[j] * math.log1p(math.exp(-code[i, j] * (sum(float(x[k]) * model.weights[k, j] for k in np.flatnonzero(x)) + model.bias[j]))) for j in range(code.shape[1])) for i in range(n)]
            p = [math.exp(-c) / sum(math.exp(-d) for d in cost) for c in cost]
            best = min(range(n), key=lambda i: (cost[i], i))
            lang, score, ambiguous = model.predict(text)
            assert lang == names[best] and math.isclose(score, p[best], rel_tol=1e-6)
            assert ambiguous == (sorted(p)[-1] - sorted(p)[-2] < language_id.AMBIGUOUS)
    tied = language_id.LanguageModel(["x", "y", "z"], np.zeros((1 << language_id.BITS, language_id.codewords(3).shape[1])), np.zeros(language_id.codewords(3).shape[1]), np.ones(language_id.codewords(3).shape[1]))
    assert tied.predict("words") == ("x", pytest.approx(1 / 3), True)


def test_every_language_is_learned(spark, monkeypatch):
    """Many languages, and a text of several blocks."""
    rng = random.Random(12)
    letters = [chr(0x4E00 + 40 * i + j) for i in range(230) for j in range(12)]
    text = lambda i: "".join(rng.choice(letters[12 * i : 12 * i + 12]) for _ in range(40))
    rows = [(8 * i + j, text(i), f"l{i:03d}") for i in range(230) for j in range(8)]
    monkeypatch.setattr(language_id, "STEPS", 12)
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 230
    assert sum(model.predict(text(i))[0] == f"l{i:03d}" for i in range(230)) >= 220
    monkeypatch.setattr(textstats, "BLOCK", 64)
    assert model.predict("".join(text(7) for _ in range(300)))[0] == "l007"


@pytest.mark.parametrize("n", [2, 3, 5, 8, 20])
def test_codewords_differ_in_half_of_the_bits(n):
    code = language_id.codewords(n)
    assert len({(a != b).sum() for a, b in combinations(code, 2)}) == 1 and all((a != b).sum() >= 2 for a, b in combinations(code, 2))


def test_quality(spark):
    rng = random.Random(7)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 90)))
    bad = lambda: " | ".join([rng.choice(["buy", "click", "now"]) + "!!"] * rng.randint(20, 60))
    rows = [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(450)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, ""), (None, "x")], "doc_id long, text string").withColumn("predicted", F.lit("clash"))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(5, None), (None, 1), (900, 7)], "doc_id long, quality int").filter(~quality.held_out())
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    held = [r for r in rows if (__import__("zlib").crc32(str(r[0]).encode()) % 3) == 1]
    assert sum(got[r[0]].predicted == r[2] for r in held) >= 0.97 * len(held) and got[900].score == got[901].score and all(0 <= r.score <= 1 for r in got.values())
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.filter("false"))).collect()} == {0.5}
    assert quality.train(docs, labels.filter("quality = 1")).score("x") > 0.9
    assert quality.score(docs.limit(0), model).count() == 0
    long = spark.createDataFrame([(1, "word " * 300_000 + good(), 7), (1, None, None)], "doc_id long, text string, n_chars long")
    assert [r.n_chars for r in quality.score(long, model).orderBy("n_chars").collect()] == [None, 7]
    half = quality.FactorisationMachine(0.0, np.zeros(quality.DIMENSION), np.zeros((quality.DIMENSION, 2)))
    assert {(r.score, r.predicted) for r in quality.score(long, half).collect()} == {(0.5, 1)}


def test_quality_from_end_to_end_by_brute_force():
    """Scores of a fitted machine, by all pairs of features one by one."""
    import math

    rng = np.random.default_rng(13)
    texts = ["good words here " * int(rng.integers(1, 4)) if i % 2 else "BUY!! | 12 " * int(rng.integers(1, 4)) for i in range(80)]
    model = quality.fit([quality.features(t, len(t)) for t in texts], np.arange(80) % 2)
    for t in texts[:6]:
        x = list(zip(*quality.features(t, len(t))))
        z = model.w0 + sum(model.w[i] * a for i, a in x) + sum(float(model.v[i] @ model.v[j]) * a * b for (i, a), (j, b) in combinations(x, 2))
        assert math.isclose(model.score(t, len(t)), 1 / (1 + math.exp(-z)), rel_tol=1e-3)
        assert (model.score(t, len(t)) >= 0.5) == t.startswith("good")


def test_pairwise_part_is_linear_identity():
    places, values = quality.features("some words and some more words")
    rng = np.random.default_rng(8)
    m = quality.FactorisationMachine(0.5, rng.standard_normal(quality.DIMENSION), rng.standard_normal((quality.DIMENSION, 4)))
    pairs = sum(m.v[places[i]] @ m.v[places[j]] * values[i] * values[j] for i, j in combinations(range(len(places)), 2))
    assert np.isclose(m.margin(places, values), 0.5 + m.w[places] @ values + pairs)


def test_long_texts_in_blocks(monkeypatch):
    text = np.frombuffer(("word " * 400 + "x" * 700 + " tail words here").encode(), np.uint8)
    whole = textstats.ngram_counts(text, (2, 3), 10)
    monkeypatch.setattr(textstats, "BLOCK", 256)
    assert (textstats.ngram_counts(text, (2, 3), 10) == whole).all()
    assert len(textstats.word_hashes(text)) >= 403
