import random
import time
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairwright.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference(special=False):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = not special
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_those_of_tokenizers(text):
    assert packing.encoder(PATH)(text).tolist() == reference()(text)


def test_ids_of_latin_characters():
    r, encode, ref = random.Random(1), packing.encoder(PATH), reference()
    chars = [chr(i) for i in range(0x250)]
    for _ in range(400):
        text = "".join(r.choice(chars + ["a", " ", "e"] * 60) for _ in range(60))
        assert encode(text).tolist() == ref(text), text
    assert encode("x<|endoftext|>y").tolist() == ref("x<|endoftext|>y")


def test_special_tokens_as_in_a_plain_call(spark):
    plain = Tokenizer.from_file(PATH)
    texts = ["x<|endoftext|>y", "<|endoftext|>", " a <|endoftext|> <|endoftext|>\n", "<|endoftext", "日本<|endoftext|>", "a|endoftext|"]
    for text in texts:
        want = plain.encode(text, add_special_tokens=False).ids
        assert packing.encoder(PATH, True)(text).tolist() == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for special in (True, False):
        ref = reference(special)
        rows = packing.pack(docs, tokenizer=PATH, with_ids=True, special=special).collect()
        assert {r.doc_id: r.ids for r in rows} == {i: [*ref(t), 0] for i, t in enumerate(texts)}
    assert {r.doc_id: r.length for r in packing.pack(docs, tokenizer=PATH).collect()}[0] == 4


def test_round_trip(spark):
    r = random.Random(2)
    word = lambda: r.choice(["the", "thing", "ound", "é", "10.5", "\n"])
    texts = [" ".join(word() for _ in range(r.choice([1, 30, 300, 900]))) for _ in range(300)] + [None, "", "a" * 9000, texts0 := "same", texts0]
    docs = spark.createDataFrame([(i if i < 303 else 303, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, sequence_id string, length int")
    rows = packing.pack(docs, tokenizer=PATH, size=256, with_ids=True).collect()
    ref, by_doc, by_seq = reference(True), {}, {}
    for x in rows:
        assert x.length == len(x.ids) <= 256 and x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes())
        by_doc.setdefault(x.doc_id, []).append(x)
        by_seq.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for i, t in enumerate(texts[:303]):
        parts = sorted(by_doc[i], key=lambda x: x.piece)
        assert [p.piece for p in parts] == list(range(len(parts)))
        assert sum((p.ids for p in parts), []) == [*ref(t or ""), 0]
        assert all(p.length == 256 for p in parts[1:])
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(x.length for x in rows)
    assert len(by_seq) <= 1.03 * total / 256 + 1
    assert packing.pack(docs.limit(0), tokenizer=PATH).count() == 0


def test_local_search_empties_bins():
    # Best fit by falling length leaves three bins; exchanging pieces makes it two.
    lengths = np.array([44, 24, 24, 22, 21, 17, 8, 8, 6, 6])
    bins = packing._best_fit(lengths, 90)
    better = packing._improve([list(b) for b in bins], lengths, 90)
    assert sorted(sum(better, [])) == list(range(10)) and len(better) == 2 and all(sum(lengths[b]) <= 90 for b in better)
    for seed in range(30):
        lengths = np.random.default_rng(seed).integers(1, 60, 80)
        bins = packing._best_fit(lengths, 100)
        better = packing._improve([list(b) for b in bins], lengths, 100)
        assert sorted(sum(better, [])) == list(range(80)) and len(better) <= len(bins) and all(sum(lengths[b]) <= 100 for b in better)


def test_null_and_repeated_ids_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 50)
    docs = spark.createDataFrame([(None, "the same words")] * 400 + [(7, "others")] * 200, "doc_id long, text string").repartition(3)
    dealt, n = packing._dealt(packing.written(packing.pieces(docs, PATH, 64), "pieces"), 0)
    sizes = [r["count"] for r in dealt.groupBy("chunk").count().collect()]
    assert n == 12 and len(sizes) == 12 and max(sizes) < 120
    assert packing.pack(docs, tokenizer=PATH, size=64).count() == 600


def test_packed_result_against_brute_force(spark):
    """A chunk's sequences: as few as exhaustive search finds, over small sets of lengths."""
    def fewest(lengths, size):
        best = [len(lengths)]

        def place(at, rooms):
            if len(rooms) >= best[0]:
                return
            if at == len(lengths):
                best[0] = len(rooms)
                return
            for r in sorted(set(rooms)):
                if r >= lengths[at]:
                    left = list(rooms)
                    left.remove(r)
                    place(at + 1, [*left, r - lengths[at]])
            place(at + 1, [*rooms, size - lengths[at]])

        place(0, [])
        return best[0]

    for seed in range(40):
        lengths = np.sort(np.random.default_rng(seed).integers(5, 60, 10))[::-1]
        bins = packing._improve(packing._best_fit(lengths, 100), lengths, 100)
        assert len(bins) <= fewest(lengths.tolist(), 100), seed


def test_short_pieces_end_soon():
    """Lengths are tried, not pieces: chunks of short or equal pieces take no longer than others."""
    draw = np.random.default_rng(0)
    cases = [draw.integers(1, 2049, 4096), draw.integers(10, 31, 4096), np.full(4096, 100), np.full(4096, 30), draw.integers(1, 60, 4096), np.concatenate([draw.integers(1, 40, 2000), draw.integers(1, 2049, 2096)])]
    for lengths in cases:
        began = time.perf_counter()
        before = packing._best_fit(lengths, 2048)
        after = packing._improve(before, lengths, 2048)
        assert time.perf_counter() - began < 2
        assert sorted(sum(after, [])) == list(range(4096)) and len(after) <= len(before) and all(lengths[b].sum() <= 2048 for b in after)
