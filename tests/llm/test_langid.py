import zlib

import numpy as np

from pairwright.llm import langid
from pairwright.llm.scratch import table


def test_filters_hold_what_they_were_given():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (5000, 50, 700, 10, 0, 3, 8, 90, 100, 20)]
    model = langid.Model.of([f"l{i}" for i in range(10)], sets)
    for i, s in enumerate(sets):
        found = np.uint8(255)
        for slot in langid._slots(s, model.tables.shape[1]):
            found = found & model.tables[i // 8][slot]
        assert ((found >> (i % 8)) & 1).all()
    other = rng.integers(0, 1 << 63, 50_000).astype(np.uint64)
    found = np.uint8(255)
    for slot in langid._slots(other, model.tables.shape[1]):
        found = found & model.tables[0][slot]
    assert abs((found & 1).mean() - model.false[0]) < 0.002


def test_grams_do_not_cross_texts():
    whole = {n: (set(g.tolist()), list(t)) for n, g, t in langid._grams(["ab", "cd"])}
    first = {n: set(g.tolist()) for n, g, _ in langid._grams(["ab"])}
    second = {n: set(g.tolist()) for n, g, _ in langid._grams(["cd"])}
    for n in first:
        assert whole[n][0] == first[n] | second[n]
    assert langid.Model.of(["x"], [np.zeros(0, np.uint64)]).predict([None, "", "12 3!", "é"])[0] == ["und", "und", "und", "x"]


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = {r.doc_id: r for r in langid.language_query(docs).collect()}
    right = [(out[r.doc_id].lang_pred == r.lang) for r in docs.select("doc_id", "lang").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(out) == 1000 and sum(right) / len(right) > 0.98
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in out.items())


def test_odd_rows(spark):
    rows = [(i, "der die und das " * 5 if i % 2 else "the and of that " * 5, "de" if i % 2 else "en", "x") for i in range(40)]
    rows += [(None, "the and", "en", "y"), (50, None, "en", None), (51, "", None, None), (52, "?!", "de", None), (53, "und die", None, None), (53, "und die", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    out = langid.language_query(docs).collect()
    assert len(out) == len(rows) and {r.lang_pred for r in out if r.doc_id in (50, 51, 52)} == {"und"} and [r.lang_pred for r in out if r.doc_id == 53] == ["de", "de"]
    assert langid.language_query(docs.limit(0)).count() == 0
    assert langid.with_language(docs, langid.train(docs)).where("doc_id = 53").first().lang_found.lang_pred == "de"


def test_nothing_to_learn_from(spark):
    """Null languages only, or none that isn't held out: every language is unknown."""
    docs = spark.createDataFrame([(i, "the and of that", None) for i in range(9)] + [(9, None, None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.language_query(docs).collect()} == {("und", 0.0)}
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = spark.createDataFrame([(i, "the and of that", "en") for i in held], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.held_out) for r in langid.language_query(docs).collect()} == {("und", True)}
    assert langid.with_language(docs, langid.train(docs.limit(0))).where("lang_found.lang_pred = 'und'").count() == len(held)


def test_scores_by_plain_counting(spark):
    """The query's result from sets of n-grams in place of filters: the languages that hold each n-gram, counted."""
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    rate: dict = {}
    for order in langid.ORDERS:
        counts: dict = {}
        for i, text, lang in rows:
            if text is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
                by = counts.setdefault(lang, {})
                for n, grams, _ in langid._grams([text.replace("\0", " ")]):
                    if n == order:
                        for g in grams.tolist():
                            by[g] = by.get(g, 0) + 1
        for lang, by in counts.items():
            total = sum(by.values())
            for g, c in by.items():
                if c / total >= langid.LEAST:
                    rate[order, g, lang] = c / total
    most: dict = {}
    for (order, g, _), x in rate.items():
        most[order, g] = max(most.get((order, g), 0), x)
    own = {k: x for k, x in rate.items() if x >= langid.OF_MOST * most[k[:2]]}
    langs = sorted({k[2] for k in own})
    sets = {x: {g for _, g, lang in own if lang == x} for x in langs}
    cover = {x: max(0.01, sum(v for k, v in own.items() if k[2] == x) / len(langid.ORDERS)) for x in langs}
    got = {r.doc_id: r for r in langid.language_query(docs).collect()}
    for i, text, _ in rows:
        grams = [g for _, gs, _ in langid._grams([(text or "").replace("\0", " ")]) for g in gs.tolist()]
        if not any(c.isalpha() for c in text or ""):
            assert got[i].lang_pred == "und"
            continue
        share = {x: sum(g in sets[x] for g in grams) / len(grams) / cover[x] for x in langs}
        best = max(share.values())
        # Filters take hardly anything for held that isn't, and what they do is corrected: scores agree closely.
        assert abs(got[i].score - best / sum(share.values())) < 0.02 and share[got[i].lang_pred] > best - 0.02, i


def test_long_texts_are_read_whole():
    model = langid.Model.of(["en"], [np.unique(np.concatenate([g for _, g, _ in langid._grams(["the"])]))])
    text = "xyz " * 300_000 + "the " * 100
    n, held = model.counts([text])
    assert n[0] > 4_000_000 and held[0, 0] >= 100
