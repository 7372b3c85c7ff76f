import random
import re

import numpy as np

from pairwright.llm import minhash
from pairwright.llm.scratch import table


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    by: dict = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs: dict = {}
    for ids in by.values():
        for a in ids:
            for b in ids:
                if a < b:
                    pairs[a, b] = pairs.get((a, b), 0) + 1
    least = {i: i for i in sets}
    links = [(a, b) for (a, b), n in pairs.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if (least[a], least[b]) != (m, m):
                least[a] = least[b] = m
                changed = True
    return {i: (len(s), least[i], least[i] == i) for i, s in sets.items()}


def test_sets_by_definition():
    r = random.Random(1)
    texts = ["".join(r.choice(["a", "B", "é", " ", "\n", "\x0b", " ", "c d", "x y z w v "]) for _ in range(r.randrange(40))) for _ in range(400)] + [None, "", " \t", "one"]
    sets = list(minhash.shingle_sets(texts))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    seen: dict = {}
    for t, s in zip(texts, sets, strict=True):
        assert seen.setdefault(frozenset(shingles(t)), s.tobytes()) == s.tobytes()
    assert len({v for v in seen.values()}) == len(seen)


def test_signatures_estimate():
    r = np.random.default_rng(2)
    a = r.integers(0, 1 << 63, 2000).astype(np.uint64)
    b = np.r_[a[:1800], r.integers(0, 1 << 63, 200).astype(np.uint64)]
    assert abs((minhash.signature(a) == minhash.signature(b)).mean() - 1800 / 2200) < 0.15


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows = []
    for group in range(30):
        base = [r.choice(vocabulary) for _ in range(r.choice([6, 40, 120]))]
        for _ in range(r.choice([1, 2, 25])):
            words = list(base)
            for _ in range(r.randrange(5)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            rows.append(" ".join(words).title() if r.random() < 0.1 else " ".join(words))
    rows += rows[:20] + [None, "", "one two", "one two", "ONE two", "two one", " "]
    rows = list(enumerate(rows, 5))
    r.shuffle(rows)
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, component string, bucket int")
    for percent, block in ((85, 256), (80, 6)):
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash.near_copies(df, percent=percent).collect()}
        assert got == brute(rows, percent)
    assert minhash.near_copies(df.limit(0)).count() == 0
    twice = df.where("doc_id < 15").union(df.where("doc_id < 15")).union(spark.createDataFrame([(None, "x y", None, None)], df.schema))
    assert minhash.near_copies(twice).count() == 21
    assert minhash.without_copies(df, percent=85).columns == df.columns


def test_ids_that_repeat_with_other_texts(spark):
    """Each row has its own links, whatever its id; of a group one document stays."""
    a, b = "one two three four five six seven eight nine ten", "red green blue black white grey pink brown lime teal"
    rows = [(1, a), (1, b), (2, a), (3, b), (4, a), (4, a), (5, f"{a} x"), (6, None), (6, "alone in the world of words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_copies(df, percent=80).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (4, 1, False), (5, 1, False), (6, 6, True), (6, 6, True)]
    left = sorted((r.doc_id, r.text or "") for r in minhash.without_copies(df).collect())
    assert left == sorted([(1, a), (1, b), (6, ""), (6, "alone in the world of words")])
    same = spark.createDataFrame([(1, a), (1, f"{a} x"), (2, b), (2, b)], df.schema)
    assert [r.doc_id for r in minhash.without_copies(same).orderBy("doc_id").collect()] == [1, 2, 2]


def test_long_sets_make_small_blocks(spark, monkeypatch):
    r = random.Random(9)
    base = [f"w{r.randrange(500)}" for _ in range(400)]
    rows = [(i, " ".join([*base[: 400 - i], f"x{i}"])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 900)
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash.near_copies(df, percent=85).collect()} == brute(rows, 85)


def test_documents_of_the_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 85)
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash.near_copies(docs, percent=85).collect()} == want


def test_ids_of_texts(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [("b-2", text), ("a-1", text), (None, text), ("c", None), ("d", "other words stand here in this text")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id string, text string, _gone int")
    got = sorted(map(tuple, minhash.near_copies(df).select("doc_id", "component_id", "kept").collect()), key=str)
    assert got == sorted([("b-2", "a-1", False), ("a-1", "a-1", True), (None, None, True), ("c", "c", True), ("d", "d", True)], key=str)
    left = minhash.without_copies(df)
    assert left.columns == df.columns and sorted(str(r.doc_id) for r in left.collect()) == ["None", "a-1", "c", "d"]
