import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from lexiloom.llm import binary_output, packing, sentencepieces, wordbpe

DOCS = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long").add("length", "string").add("part", "string")
TEXTS = ["The quick fox. It's 12 o'clock!", None, "", "Über <|endoftext|> naïve\x1cx y ﬁ İ ΣΑΣ", "word " * 3000, "word " * 3000, "a" * 5000, "日本語 éclair don't"]


def frame(spark, texts=TEXTS):
    rows = [(i, t, None, None, None, "x", "y") for i, t in enumerate(texts)] + [(None, "no id", None, None, None, "x", "y")]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("alphabet", ["aBc'strEmlvd.,!? \t\n\x1c  éÉßøÞ1²_<|-&µªº½ \u0085\xad\0", "aBc'st.,! \n\x1c　 ́éİſΣσ1²٣_|<-日한"])
def test_word_encoder_equals_the_library(alphabet):
    enc, rng = wordbpe.encoder(), random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice([*alphabet, "<|endoftext|>", "'s", "don't"]) for _ in range(rng.randint(0, 14)))
        assert enc.encode(text).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_memory_is_bounded():
    m = wordbpe.Memory(str.upper, limit=3, longest=4)
    assert [m[k] for k in ("a", "b", "c", "d", "a", "longer")] == ["A", "B", "C", "D", "A", "LONGER"] and len(m) <= 3 and len(m.older) <= 3


def test_piece_encoder_equals_the_library():
    enc, rng = sentencepieces.encoder(), random.Random(4)
    pieces = list(enc.pieces)
    for k in range(6000):
        if k % 2:
            text = "".join(rng.choice("abcdefghi stuvxyz.'’▁\n<0x41></s>é日本́ßtheing  \0") for _ in range(rng.randint(0, 24)))
        else:
            text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 4))).replace("▁", " ")
        ids = enc.encode(text)
        assert ids == enc.model.encode(text), repr(text)
        assert enc.decode(ids) == enc.model.decode(enc.model.encode(text))


def test_piece_compatibility_is_that_of_whole_merges():
    enc, rng = sentencepieces.PieceEncoder(sentencepieces.public_tokenizers.path(sentencepieces.PIECE_BPE)), random.Random(5)
    pieces = [p for p in enc.pieces if enc.merges(p)[0] == [p]]
    for _ in range(3000):
        a, b = rng.choice(pieces), rng.choice(pieces)
        assert enc.compatible(a, b) == (enc.merges(a + b)[0] == [a, b])


def test_piece_digests(spark):
    import hashlib

    got = {r.doc_id: r for r in sentencepieces.digests(frame(spark)).collect()}
    model = sentencepieces.encoder().model
    for i, t in enumerate(TEXTS):
        ids = model.encode(t or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()
    assert got[1].n_tokens == 0 and None in got
    assert sentencepieces.digests(frame(spark).limit(0)).count() == 0


def library_ids(text, end):
    return [*wordbpe.encoder().tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def test_files_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    manifest = binary_output.write(frame(spark), folder, shards=3)
    rows = sorted(binary_output.read(manifest, folder).collect(), key=lambda r: r.start)
    at = 0
    for r, (i, t) in zip(rows, [(None, "no id"), *enumerate(TEXTS)], strict=True):
        ids = library_ids(t, 2)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert binary_output.read(binary_output.write(frame(spark).limit(0), folder + "0"), folder + "0").count() == 0


def test_packing(spark):
    rows = packing.pack(frame(spark), capacity=64).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in [(None, "no id"), *enumerate(TEXTS)]:
        ids = library_ids(t, 0)
        cut = [ids[k : k + 64] for k in range(0, len(ids), 64)]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == [(k, 64 * k, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cut)]
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) <= 64
    assert packing.pack(frame(spark).limit(0)).count() == 0


def test_local_search_keeps_pieces_and_empties_bins():
    from collections import Counter

    rng = random.Random(6)
    for _ in range(40):
        counts = Counter(rng.randint(1, 30) for _ in range(rng.randint(1, 60)))
        first = packing.best_fit(counts, 30)
        better = packing.local_search(first, 30)
        for bins in (first, better):
            held = Counter()
            for content, n in bins.items():
                assert sum(content) <= 30 and n > 0
                for size in content:
                    held[size] += n
            assert held == counts
        squares = lambda bins: sum(sum(c) ** 2 * n for c, n in bins.items())
        assert squares(better) >= squares(first) and sum(better.values()) <= sum(first.values())
    poor = Counter({(6, 1): 1, (5, 2): 1, (4, 3): 1, (7,): 1})  # 28 of 4 x 10: three bins do
    assert sum(packing.local_search(poor, 10).values()) == 3
