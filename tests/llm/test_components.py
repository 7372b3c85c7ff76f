import random

import numpy as np

from pairwright.llm import embedding
from pairwright.llm.components import components
from pairwright.llm.scratch import table


def brute_components(nodes, links):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    want = brute_components(nodes, [(a, b) for a, b in links if a != b])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def brute_vectors(rows, threshold):
    ok = {}
    for i, (k, v, label) in enumerate(rows):
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = (np.array(v, np.float32).astype(float), label)
    links = []
    for i in ok:
        for j in ok:
            if i < j and ok[i][1] == ok[j][1] and len(ok[i][0]) == len(ok[j][0]):
                a, b = ok[i][0], ok[j][0]
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    links.append((i, j))
    n = [0] * len(rows)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    # Rows are nodes; a component's name is its rows' smallest id.
    least = brute_components(range(len(rows)), links)
    name: dict = {}
    for i, r in enumerate(rows):
        if i in ok:
            name[least[i]] = min(name.get(least[i], r[0]), r[0])
    ids = [name[least[i]] if i in ok else r[0] for i, r in enumerate(rows)]
    return sorted((r[0], n[i], ids[i], ids[i] == r[0]) for i, r in enumerate(rows))


def vector_rows(df):
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect())


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(20):
        base = rng.standard_normal(16)
        rows += [((base + 0.13 * rng.standard_normal(16)).tolist(), c % 2) for _ in range(14)]
    rows += [(rows[0][0], 0), (rows[0][0], 1), (rows[0][0], None), (None, 0), ([], 0), ([0.0] * 16, 0), ([float("nan")] * 16, 0), ([1.0] * 15 + [None], 0), ([1.0] * 8, 0), ([2.0] * 8, 0), ([float("inf")] * 16, 0)]
    rows = [(i, v, label) for i, (v, label) in enumerate(rows)]
    df = spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], "vec_id long, embedding array<float>, label int, component_id string")
    want = brute_vectors(rows, 0.98)
    for block in (512, 5):
        assert vector_rows(embedding.near_vectors(df, block=block)) == want
    assert embedding.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_the_table(spark):
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    want = brute_vectors([(r.vec_id, list(r.embedding), r.label) for r in df.collect()], 0.98)
    assert vector_rows(embedding.near_vectors(df)) == want


def test_ids_that_repeat_with_other_vectors(spark):
    """Each row has its own links, whatever its id."""
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    near = lambda v: [x + 0.05 for x in v]
    rows = [(1, a, 0), (1, b, 0), (2, near(a), 0), (3, near(b), 0), (4, a, 0), (4, a, 0), (5, [-0.0 if x == 0 else x for x in a], 0), (0, [0.0, 0.0, 1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = vector_rows(embedding.near_vectors(df))
    assert got == brute_vectors(rows, 0.98)
    assert [(i, n) for i, n, _, _ in got if i == 1] == [(1, 1), (1, 4)]
    null = spark.createDataFrame([(None, a, 0), (1, a, 0)], "vec_id long, embedding array<float>, label int")
    assert {(r.vec_id, r.n_links) for r in embedding.near_vectors(null).collect()} == {(None, 0), (1, 0)}


def test_words_rule_out_hardly_any_pair():
    assert 10 <= embedding.most_apart(0.98) <= 20
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal((4000, 32))
    y -= (x * y).sum(1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    z = 0.98 * x + np.sqrt(1 - 0.98**2) * y
    keys, word = embedding.signs(np.r_[x, z], *embedding.shape(4000, 0.98), 5)
    assert (np.bitwise_count(word[:4000] ^ word[4000:]) <= embedding.most_apart(0.98)).all()
    assert (keys[:4000] == keys[4000:]).any(1).all()


def test_components_whose_squares_leave_the_range(spark):
    big, small = [1e300, 1e300, 0.0, 0.0], [1e-300, 1e-300, 0.0, 0.0]
    rows = [(1, big, 0), (2, [x * 0.5 for x in big], 0), (3, small, 0), (4, [0.0, 0.0, 5e-324, 0.0], 0), (5, [0.0, 0.0, 1.0, 0.0], 0), (6, [1.0, 0.99, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert vector_rows(embedding.near_vectors(df)) == [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 1, 4, True), (5, 1, 4, False), (6, 3, 1, False)]


def test_ids_of_texts(spark):
    a = [1.0, 0.0, 0.0, 0.0]
    rows = [("b-2", a, 0), ("a-1", a, 0), (None, a, 0), ("c", [0.0, 1.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>, label int")
    got = sorted(map(tuple, embedding.near_vectors(df).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)
    assert got == sorted([("b-2", 1, "a-1", False), ("a-1", 1, "a-1", True), (None, 0, None, True), ("c", 0, "c", True)], key=str)
