import random
import re
import zlib

import numpy as np

from pairwright.llm import toxicity
from pairwright.llm.scratch import table


def brute(a, b):
    """The gap-weighted kernel of three-letter subsequences within the span, from its definition."""
    from itertools import combinations

    def features(s):
        out = {}
        for i, j, k in combinations(range(len(s)), 3):
            if k - i < toxicity.SPAN:
                out[s[i], s[j], s[k]] = out.get((s[i], s[j], s[k]), 0) + toxicity.DECAY ** (k - i + 1)
        return out

    fa, fb = features(a), features(b)
    dot = lambda x, y: sum(v * y.get(g, 0) for g, v in x.items())
    return dot(fa, fb) / np.sqrt(dot(fa, fa) * dot(fb, fb))


def test_kernel_by_definition():
    marks = [b"idiot", b"pathetic", b"worthles"]
    words = ["idiot", "idxiot", "idit", "path", "worthles", "worhtless", "pathological", "stationarily", "tidiots", "i-d.i/o#t", "xxxxxxidiotxxxxxxx", "worthlessworthless"]
    got = toxicity.Kernel(marks).likeness([w.encode() for w in words])
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            k = [brute(p.decode(), "\x01" + m.decode()) for p in toxicity._parts([b"\x01" + w.encode()])[0]]
            assert abs(got[i, j] - sum(x**toxicity.POWER for x in k if x >= toxicity.LEAST)) < 1e-4, (w, m)


def obfuscated(r):
    word = list(r.choice(["idiot", "pathetic", "worthless", "scoundrel", "dumb", "plain", "windows"]))
    for _ in range(r.randrange(6)):
        word.insert(r.randrange(len(word) + 1), r.choice("./_-xyzq#(1@é"))
    around = lambda: "".join(r.choice("abcxyz./_-") for _ in range(r.choice([0, 0, 3, 9])))
    return (around() + "".join(word) + around()).encode()


def test_screen_changes_no_likeness():
    r = random.Random(6)
    words = [obfuscated(r) for _ in range(4000)] + [b"ndasfm.orxon_ucyf", b"xx--dumb--xxxxxxxx", b"w/o/r/t/h/l/e/s/s"]
    for marks in ([b"dumb"], [b"dumb", b"worthles", b"idiot", b"forxonu", b"scoundre"]):
        kernel = toxicity.Kernel(marks)
        out = np.zeros((len(words), len(marks)), np.float32)
        kernel._compare([b"\x01" + w.strip(toxicity._SIGNS) for w in words], np.arange(len(words)), out)
        kept = kernel.bound
        kernel.bound = lambda word, gram, weight, norm2: np.full(len(norm2), np.inf)
        every = np.zeros_like(out)
        kernel._compare([b"\x01" + w.strip(toxicity._SIGNS) for w in words], np.arange(len(words)), every)
        kernel.bound = kept
        assert np.allclose(kernel.likeness(words), every, atol=1e-5) and np.allclose(out, every, atol=1e-5)


def test_matrix_is_a_kernel():
    marks = [b"worthles", b"worthle", b"pathetic", b"pathe", b"scoundre", b"idiot", b"idio"]
    kernel = toxicity.Kernel(marks)
    k = kernel.matrix()
    assert np.array_equal(k, k.T) or np.abs(k - k.T).max() < 1e-12
    assert np.linalg.eigvalsh(k).min() > -1e-9 and np.allclose(np.diag(k), 1, atol=1e-5)
    rows = kernel.likeness(marks)
    assert np.allclose(np.where(k >= toxicity.LEAST**toxicity.POWER, k, 0), rows, atol=1e-4)


def test_inserted_characters_stay_close():
    kernel = toxicity.Kernel([b"idiot"])
    near = lambda w: kernel.likeness([w])[0, 0]
    assert near(b"i-d.i*o-t") > 0.99 and near(b"1d10t") > 0.99 and near(b"idxiot") > 0.05 and near(b"the") == 0
    assert near(b"zzzzzzzzzzzzzzzzzzzzidiotzzzzzzzzzzzzzzzz") > 0
    reader = toxicity.Reader(kernel)
    spelled = list(reader.sentences(["you i d i o t there", "a b", None, ""]))
    assert list(reader.sentences(["i d i o t there. fine words here."]))[0].max() > 0.99
    assert spelled[0].max() > 0.99 and [len(s) for s in spelled[1:]] == [0, 0, 0]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = {r.doc_id: r for r in toxicity.toxicity_query(docs, labels).collect()}
    truth = [(out[r.doc_id].predicted, r.toxic) for r in labels.collect() if out[r.doc_id].held_out]
    assert len(out) == 1000 and sum(p == t for p, t in truth) / len(truth) > 0.93
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in out.items())


def test_odd_rows(spark):
    rows = [(i, ("plain words stand here. you utter scoundrel go. " if i % 3 == 0 else "plain words stand here. and there they go. ") * 3, 1.0) for i in range(60)]
    rows += [(100, None, 0.0), (101, "", 0.0), (None, "a scoundrel", 0.0), (0, rows[0][1], 0.0), (102, "x " * 200_000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "s") for i in range(60)] + [(None, 1, ""), (7, None, "")], "doc_id long, toxic int, text string")
    out = toxicity.toxicity_query(docs, labels).collect()
    assert len(out) == len(rows)
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in out if r.doc_id is not None and r.doc_id < 60)
    assert [r.predicted for r in out if r.doc_id in (100, 101, 102)] == [0, 0, 0]
    assert toxicity.toxicity_query(docs, labels.limit(0)).where("score = 0").count() == len(rows)
    assert toxicity.toxicity_query(docs.limit(0), labels).count() == 0


def test_rare_insults_are_learned(spark, monkeypatch):
    """About 20,000 labelled rows are asked for, and among so many a rare insult is learned."""
    asked = []
    monkeypatch.setattr(toxicity, "sampled", lambda df, id_col, rows, salt: asked.append(rows) or df)
    docs = spark.range(20_000).selectExpr("id as doc_id", "if(id % 3000 = 0, 'you utter scoundrel', 'plain words stand here') as text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 3000 = 0 or doc_id % 9 = 0) as toxic")
    model = toxicity.train(docs, labels)
    assert asked == [20_000] and any(b"scoundrel".startswith(w) for w in model.kernel.landmarks)


def test_scores_by_definition():
    """Scores of whole texts from the kernel's definition, word by word and sentence by sentence."""
    r = random.Random(8)
    kernel = toxicity.Kernel([b"idiot", b"dumb", b"worthles"])
    model = toxicity.Model(kernel, toxicity._root(kernel), np.array([0.9, 0.5, -0.2]), -0.8, 3.0, 0.4)
    texts = [" ".join(r.choice(["the", "dumb", "idi0t", "worthles", "plain.", "go!", "i d i o t", "x-dumb-y", "é?", "worthlessworthless"]) for _ in range(r.randrange(12))) for _ in range(60)] + [None, ""]
    got = model.scores(texts, toxicity.Reader(kernel))
    for text, score in zip(texts, got, strict=True):
        sentences = [[]]
        for w in re.sub("i d i o t(?: i d i o t)*", lambda m: f"{m[0].replace(' ', '')} {m[0]}", text or "").split():
            sentences[-1].append(w)
            if w.endswith((".", "!", "?")):
                sentences.append([])
        margins = [model.bias]
        for words in sentences:
            row = np.zeros(3)
            for w in words:
                bare = b"\x01" + w.encode().strip(toxicity._SIGNS)
                for part in toxicity._parts([bare])[0]:
                    form = "".join(chr(toxicity._CODE[c]) for c in part)
                    for j, m in enumerate(kernel.landmarks):
                        if len(part) >= 3:
                            x = brute(form, "".join(chr(toxicity._CODE[c]) for c in b"\x01" + m))
                            row[j] += x**toxicity.POWER if x >= toxicity.LEAST else 0
            if row.any():
                margins.append(float(row @ model.root @ model.weight + model.bias))
        want = 1 / (1 + np.exp(-(model.slope * max(margins) + model.shift)))
        assert abs(score - want) < 1e-3, text


def test_repeats_bound_what_comes_back(spark):
    docs = spark.createDataFrame([(7, "you utter scoundrel go now" if i % 3 == 0 else "plain words stand here") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (7, 0)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels, rows=20))
    assert out.count() == 300
