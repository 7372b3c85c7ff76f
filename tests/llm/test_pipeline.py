"""The pipeline, stage by stage, against plain Python and SQL over the whole small table."""

import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import zlib
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from pairwright.llm import langid, oracles
from pairwright.llm.scratch import table, written

from test_minhash import brute as brute_copies
from test_spans import plain_pii

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def plainly_masked(text):
    spans = sorted(plain_pii(text), key=lambda s: (s[1], -s[2]))
    out, at = "", 0
    for kind, a, b in spans:
        if a >= at:
            out += text[at:a] + f"<{kind.upper()}>"
        at = max(at, b)
    return out + text[at:]


def test_stages(spark):
    docs = table(spark, SF, "documents")
    extra = [(10_000, None, "en", "src1", 0), (10_001, "1234 !?", "en", None, 7), (10_002, "the and of that with this from", "en", None, 30)]
    docs = written(docs.union(spark.createDataFrame(extra, docs.schema)), "docs")
    start = rows(docs)

    model = langid.train(docs)
    lang, _, covered = model.judged([r[1] for r in start])
    want = [r for r, x, c in zip(start, lang, covered, strict=True) if x != "und" and c >= pipeline.COVERED]
    one = written(pipeline.language(spark, docs, SF), "one")
    assert one.columns == docs.columns and sorted(rows(one)) == sorted(want)
    assert {10_000, 10_001}.isdisjoint(r[0] for r in want) and len(want) >= len(start) - 4

    kept = brute_copies([(r[0], r[1]) for r in want], 80)
    want = [r for r in want if kept[r[0]][2]]
    two = written(pipeline.near_copies(spark, one, SF), "two")
    assert two.columns == docs.columns and sorted(rows(two)) == sorted(want)

    want = [(r[0], t := plainly_masked(r[1]), r[2], r[3], len(t)) for r in want]
    three = written(pipeline.personal_data(spark, two, SF), "three")
    assert three.schema == docs.schema or three.columns == docs.columns
    assert sorted(rows(three)) == sorted(want)

    con = duckdb.connect()
    frame = three.toPandas()
    con.register("documents", frame)
    copies = dict(con.sql(f"select doc_id, copies from ({oracles.MIXING})").fetchall())
    four = written(pipeline.mixture(spark, three, SF), "four")
    assert Counter(r[0] for r in rows(four)) == Counter({k: v for k, v in copies.items() if v})
    assert four.columns == docs.columns and set(rows(four)) <= set(want)

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r[0]: r[1] for r in want}
    pieces = pipeline.packing(spark, four, SF).collect()
    left = Counter()
    for p in pieces:
        ids = [*t.encode(texts[p.doc_id], add_special_tokens=False).ids, 0][p.start : p.start + p.length]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == p.ids_crc32
        left[p.doc_id] += p.length
    assert all(left[d] == n * (len(t.encode(texts[d], add_special_tokens=False).ids) + 1) for d, n in copies.items())
    full = Counter()
    for p in pieces:
        full[p.sequence_id] += p.length
    assert max(full.values()) <= 2048 and len(full) <= 1.05 * sum(full.values()) / 2048 + 1


def test_clean_documents_stay_with_any_number_of_languages(spark):
    """One, two and twelve languages: what is told apart stays, letters of no language that was learned go."""
    import random

    for n in (1, 2, 12):
        r = random.Random(n)
        # Languages share half of their letters.
        alphabets = ["aeinorst" + "".join(r.sample("bcdfghjklmpquvwxyzäöüéèñßøåłż", 8)) for _ in range(n)]
        word = lambda k: "".join(r.choice(alphabets[k]) for _ in range(r.randrange(3, 8)))  # noqa: B023,E731
        vocabularies = [[word(k) for _ in range(200)] for k in range(n)]
        rows = [(i, " ".join(r.choice(vocabularies[i % n]) for _ in range(60)), f"l{i % n:02}", "s", 0) for i in range(240)]
        foreign = ["".join(r.choice("абвгдежзиклмнопрст ") for _ in range(400)), "".join(r.choice("αβγδεζηθικλμνξοπρ ") for _ in range(30)), "кот", "的一是不了人我在有"]
        rows += [(800 + i, t, None, "s", 0) for i, t in enumerate(foreign)]
        docs = spark.createDataFrame([*rows, (900, "12 !?", "l00", "s", 0), (901, None, None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
        docs = docs.withColumn("_found", F.lit("a column of the user's"))
        assert sorted(x.doc_id for x in pipeline.language(spark, docs, SF).collect()) == list(range(240)), n


def test_empty_and_unlabelled_tables(spark, tmp_path):
    docs = table(spark, SF, "documents")
    for name, frame in (("empty", docs.limit(0)), ("unlabelled", docs.limit(20).selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "n_chars"))):
        frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert pipeline.run(spark, f"{tmp_path}/{name}").count() == 0


def test_run_is_the_stages(spark):
    out = pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
    assert [n for n, _ in pipeline.STAGES] and re.fullmatch("language", pipeline.STAGES[0][0])
