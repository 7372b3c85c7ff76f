import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from pairwright.llm import search as S

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
found = lambda text: TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """All scores from their definition; docs and items are (id, text), ids may repeat."""
    counts = [(i, Counter(found(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    posting = defaultdict(list)
    for at, (_, c) in enumerate(counts):
        for t, f in c.items():
            posting[t].append((at, f))
    out = []
    for item, text in items:
        score = Counter()
        for t in set(found(text)):
            w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * len(posting[t]) + 1)))
            for at, f in posting[t]:
                m = 100 - 90 + 90 * sum(counts[at][1].values()) * n_docs // n_terms
                score[at] += w * (1_000_000_000 * f // (1000 * f + 8 * m))
        best = sorted((-s, counts[at][0] is None, counts[at][0] or 0) for at, s in score.items() if s > 0)[:k]
        out += [(item, rank, None if null else doc, -s) for rank, (s, null, doc) in enumerate(best, 1)]
    return out


def text(r, most):
    return " ".join(r.choice(["der", "Die", "rain", "ÄRGER", "ärger", "x1", "_", "c3-po", "naïve", "日本", "the"]) + r.choice(["", "", "", str(r.randrange(40))]) for _ in range(r.randrange(most)))


def test_results_by_definition(spark, monkeypatch):
    """Small shards, small ranges, several blocks; nulls, ties, empty and long texts, repeated rows."""
    monkeypatch.setattr(S, "BLOCK", 7)
    r = random.Random(12)
    docs = [(i, text(r, 60)) for i in range(1500)]
    docs += [(i, "same words here for all") for i in range(3000, 3040)]  # ties, more of them than places
    docs += [(7, "rain rain"), (7, "rain rain"), (None, "rain x1"), (None, None), (4000, None), (4001, ""), (4002, "?!"), (4003, "long der rain " * 120_000)]
    r.shuffle(docs)
    items = [(i, text(r, 25)) for i in range(20)] + [(50, "same words"), (51, None), (52, ""), (53, "nowhere at-all"), (50, "rain"), (None, "x1 naïve")]
    index = S.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    got = S.search(index, spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(docs, items), key=str)


def test_shards_and_ids_of_any_type(spark):
    """Many shards of one task: scores to beat go from one to the next.  Ids are texts; clashing columns are not read."""
    r = random.Random(5)
    docs = [(f"d{i:03d}", text(r, 30), 1) for i in range(600)]
    items = [(f"q{i}", text(r, 12)) for i in range(8)]
    frame = spark.createDataFrame(docs, "key string, body string, score int").coalesce(1)

    index = S.build(frame, id_col="key", text_col="body", shard_docs=64)
    assert index.count() == 10
    got = S.search(index, spark.createDataFrame(items, "name string, q string"), id_col="name", text_col="q", k=3)
    assert sorted(map(tuple, got.collect())) == sorted(brute([d[:2] for d in docs], items, 3))


def test_each_shard_by_definition():
    """MaxScore of a shard against sums over all its lists, whatever score is to beat."""
    r = random.Random(3)
    import pyarrow as pa

    for trial in range(30):
        docs = [(i, text(r, 40)) for i in range(r.choice([1, 40, 700, 2500]))]
        shard = S._Shard()
        for i, t in docs:
            shard.add(pa.array([i]), t.encode())
        row = shard.row()
        counts = [Counter(found(t)) for _, t in docs]
        n_docs, n_terms = sum(map(bool, counts)) + 10, sum(sum(c.values()) for c in counts) + 1000
        weight = {t.encode(): r.randrange(0, 9000) for t in {t for c in counts for t in c} | {"absent"}}
        lists = S.Lists({name: row.column(name)[0] for name in row.schema.names}, weight, n_docs, n_terms)
        for _ in range(5):
            asked = {t: weight[t] for t in r.sample(sorted(weight), min(len(weight), r.randrange(12)))}
            norm = [10 + 90 * sum(c.values()) * n_docs // n_terms for c in counts]
            scores = [sum(asked.get(t.encode(), 0) * (10**9 * f // (1000 * f + 8 * m)) for t, f in c.items()) for c, m in zip(counts, norm, strict=True)]
            beat = r.choice([[], [5] * 4, sorted(scores)[-4:] * 4])
            got = S.max_score(lists, asked, 4, np.array(beat, np.int64))
            least = sorted(beat)[-4] if len(beat) >= 4 else 1
            want = sorted((-s, i) for i, s in enumerate(scores) if s > 0)[:4]
            have = [(-s, i) for i, s in zip(got[0].tolist(), got[1].tolist(), strict=True)]
            assert [x for x in have if -x[0] >= least] == [x for x in want if -x[0] >= least], trial


def test_lengths_beyond_64_bits():
    n = np.array([3, 10**9], np.int64)
    assert S._norms(n, 10**12, 10**15).tolist() == [10 + 90 * x * 10**12 // 10**15 for x in n.tolist()]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert S.search_query(docs, items).collect() == []
    assert S.search_query(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).collect() == []
