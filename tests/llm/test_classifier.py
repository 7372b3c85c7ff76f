import random

import numpy as np
import pytest

from pairwright.llm import classifier as C
from pairwright.llm.queries import QUERIES
from pairwright.llm.scratch import table


def index_by_definition(word):
    """Forms by form, in whole numbers of 64 bits."""
    mask = (1 << 64) - 1

    def mixed(x):
        x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 32)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    codes = [2, 2, *map(ord, word), 3]
    grams = [(codes[i] + codes[i + 1] * 0x1F123BB5 + codes[i + 2] * 0x27D4EB2F165667C5) & mask for i in range(len(codes) - 2)]
    forms = [mixed(g) for g in grams] + [mixed(sum(mixed((g * (2 * i + 1)) & mask) for i, g in enumerate(grams)) & mask)]
    out = [0] * C.DIM
    for f in forms:
        for k in range(C.PLACES):
            out[(f >> (7 * k)) % C.DIM] += -1 if (f >> (63 - k)) & 1 else 1
    return out


def test_index_vectors_by_definition():
    words = ["a", "the", "x!!", "Übermut", "𝄞𝄞", "$$$", "y" * 256]
    assert C.index_vectors(words).tolist() == [index_by_definition(w) for w in words]


def test_pooled_rows_by_definition(monkeypatch):
    monkeypatch.setattr(C, "STEP", 50)
    monkeypatch.setattr(C, "REMEMBERED", 3)
    r = random.Random(1)
    texts = [None, "", "  "] + [" ".join(r.choice(["the", "of", "ab$$$", "|", "x!!", "Ünder", "a" * 300]) for _ in range(r.choice([0, 1, 2, 10, 49, 50, 51, 400]))) for _ in range(60)] + [None]
    reader = C.Reader({"the": C._unit(np.ones((1, C.DIM)))[0]})
    for row, text in zip(reader.rows(texts), texts, strict=True):
        words = C._WORD.findall(text or "")
        v = np.stack([reader.vectors([w])[0] for w in words]).astype(float) if words else np.zeros((1, C.DIM))
        mean = v.mean(0)
        near = (v[1:] * v[:-1]).sum() / max(len(words) - 1, 1)
        assert np.allclose(row, [*mean, np.linalg.norm(mean), near, np.log1p(len(words))], atol=1e-5)


def test_words_that_come_again_are_remembered(monkeypatch):
    """Words that come once don't drive out those that come again, whose vectors are made once more at most."""
    monkeypatch.setattr(C, "STEP", 60)
    monkeypatch.setattr(C, "REMEMBERED", 100)
    made, plain = [], C.index_vectors
    monkeypatch.setattr(C, "index_vectors", lambda them: made.extend(them) or plain(them))
    common = [f"word{i}" for i in range(20)]
    texts = [" ".join([*common, *(f"once{k}x{i}" for i in range(30)), common[k % 20]]) for k in range(40)]
    reader = C.Reader({"word3": C._unit(np.ones((1, C.DIM)))[0]})
    got = np.concatenate([reader.rows([text]) for text in texts])
    assert all(made.count(w) <= 2 for w in common) and len(reader._row) <= C.REMEMBERED + C.STEP
    fresh = np.concatenate([C.Reader(reader.contexts).rows([text]) for text in texts])
    assert np.allclose(got, fresh, atol=1e-6)


def test_contexts_by_definition(spark):
    texts = ["a b c a b", "b a", "c", "", "lone"]
    learn = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    sums = {}
    for t in texts:
        w = t.split()
        for i, x in enumerate(w):
            for k in range(-C.WINDOW, C.WINDOW + 1):
                if k and 0 <= i + k < len(w):
                    sums[x] = sums.get(x, np.zeros(C.DIM)) + np.roll(index_by_definition(w[i + k]), k)
    got = C._contexts(learn, 10)
    assert sorted(got) == ["a", "b", "c"]  # a word that comes once has no context
    for word, v in got.items():
        assert np.allclose(v, sums[word] / np.linalg.norm(sums[word]), atol=1e-6)
    assert sorted(C._contexts(learn, 2)) == ["a", "b"]


def test_temperature_calibrates():
    draw = np.random.default_rng(4)
    z = draw.normal(0, 2, 20_000)
    y = (draw.random(len(z)) < C._odds(z)).astype(float)
    assert C._temperature(3 * z, y, np.ones(len(z))) == pytest.approx(3, rel=0.1)


def rows(n, seed=0):
    r = random.Random(seed)
    good = lambda: " ".join(r.choice(["lo", "mi", "ra", "te"]) + r.choice(["n", "s", "l"]) + r.choice(["", "o", "a"]) for _ in range(r.randrange(20, 80)))
    bad = lambda: " ".join([r.choice(["lon", "mis", "ral"]) + "###"] * r.randrange(20, 80))
    return [(i, bad() if i % 4 == 0 else good(), int(i % 4 != 0)) for i in range(n)]


def test_learns_and_scores_odd_rows(spark):
    data = rows(800)
    docs = spark.createDataFrame([(i, t, 5.0) for i, t, _ in data] + [(None, "lon mis", 1.0), (9000, None, 1.0), (9001, "", 1.0), (9002, "lon " * 200_000, 1.0), (9002, "lon " * 200_000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, q) for i, _, q in data if i < 600] + [(None, 1), (601, None), (5, 1)], "doc_id long, quality int")
    model = C.train(docs, labels)
    got = {}
    for r in C.score(docs, model).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    assert all(0 <= s <= 1 for some in got.values() for s in some) and len(got[9002]) == 2 and len(set(got[9002])) == 1
    assert got[9000] == got[9001]
    assert sum((got[i][0] >= 0.3) == bool(q) for i, _, q in data if i >= 600) >= 196
    again = {r.doc_id: r.score for r in C.score(docs, C.train(docs.repartition(5), labels.repartition(2))).collect()}
    assert all(abs(again[i] - got[i][0]) < 1e-6 for i, _, _ in data)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert C.train(docs, none) == 0.5
    assert C.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")) == pytest.approx(2 / 3)
    assert {r.score for r in C.score(docs, C.train(docs, none)).collect()} == {0.5}
    assert C.score(docs.limit(0), 0.5).collect() == []


def test_repeats_do_not_grow_what_comes_back(spark):
    data = rows(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(8, data[8][1])] * 3000, "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in data] * 2, "doc_id long, quality int")
    model = C.train(docs, labels, rows=400)
    assert isinstance(model, C.Model)
    # Rows that repeat count once: the others are learned from as if these weren't there.
    plain = C.train(docs.dropDuplicates(), labels, rows=400)
    score = lambda m: [r.score for r in C.score(docs.where("doc_id < 50").dropDuplicates().orderBy("doc_id").coalesce(1), m).collect()]
    assert np.allclose(score(model), score(plain), atol=1e-6)


def test_held_out_accuracy_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels").where("quality IS NOT NULL")
    out = QUERIES["op11_quality"](spark, sf)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == table(spark, sf, "documents").count()
    held = out.join(labels, "doc_id").where("held_out").toPandas()
    assert (held.predicted == held.quality).mean() > 0.97 and ((held.score >= 0.3) == (held.predicted == 1)).all()
    assert held[held.quality == 0].predicted.mean() < 0.1
