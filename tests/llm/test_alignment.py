import hashlib
import json
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pairwright.llm import alignment as A
from pairwright.llm.queries import QUERIES
from pairwright.llm.scratch import table

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(docs):
    """Groups, links and counts from their definition, document by document."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
    with open(FIRST, encoding="utf-8") as file:
        bytes_a = {n: bytes(byte_of[c] for c in t) for t, n in json.load(file)["model"]["vocab"].items() if t != "<|endoftext|>"}
    first, second = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
    first.encode_special_tokens = True
    bytes_b = lambda i: bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for _, text in docs:
        a = first.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        ta, tb = [bytes_a[i] for i in a], [bytes_b(i) for i in b]
        if b"".join(ta) != f" {text}".encode() or b"".join(tb) != f" {text}".encode():
            found.append([])
            continue
        ends = lambda ts: [sum(map(len, ts[: i + 1])) for i in range(len(ts))]
        ea, eb = ends(ta), ends(tb)
        groups, start = [], 0
        for end in sorted(set(ea) & set(eb)):
            groups.append(([i for i, e in zip(a, ea, strict=True) if start < e <= end], [i for i, e in zip(b, eb, strict=True) if start < e <= end]))
            start = end
        found.append(groups)
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for groups in found]
    count = Counter(pair for c in links for pair in c)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    rows = []
    for (doc_id, _), groups, c in zip(docs, found, links, strict=True):
        plain_text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        rows.append((
            doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(c.values()), sum(n for p, n in c.items() if count[p] == best[p[0]]),
            sum(n * count[p] for p, n in c.items()), hashlib.sha256(plain_text.encode()).hexdigest() if groups else "",
        ))
    return rows, count


def texts():
    r = random.Random(13)
    parts = ["the ", "rain", "Ünder ", "  ", "\n", "naïve", "日本語", "🎼", "====", "x", "aaaa", " <|endoftext|>", "</s>", "\t", "1234", "é", "ning ", "🏳️‍🌈", "'s", " ", "ﬁ", "\r\n"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(1, 40))) for _ in range(150)]


def test_rows_by_definition(spark):
    docs = [(i, t) for i, t in enumerate(texts())]
    docs += [(900, None), (901, ""), (902, " "), (903, "▁ piece sign"), (904, "aa" * 700), (7, "the rain"), (7, "the rain"), (None, "the rain"), (905, "=" * 500 + "日本" * 100)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, key string, block int")
    want, count = brute(docs)
    assert any(not w[1] for w in want) and any(w[1] for w in want)
    for block_docs, parts in ((A.BLOCK_DOCS, 1), (5, 3)):
        got = A.align(frame.repartition(parts), first=FIRST, second=SECOND, block_docs=block_docs)
        assert got.columns == COLUMNS
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    pairs = A.links(A._aligned(frame, FIRST, SECOND, "doc_id", "text", 4))[0]
    assert {(p.a, p.b): p["count"] for p in pairs.collect()} == dict(count)
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    assert all(p.best == (p["count"] == best[p.a]) for p in pairs.collect())


def test_ids_of_any_type_and_empty_tables(spark):
    named = spark.createDataFrame([("a-1", "the rain"), ("b", None)], "name string, body string")
    got = A.align(named, first=FIRST, second=SECOND, id_col="name", text_col="body").collect()
    want, _ = brute([("a-1", "the rain"), ("b", None)])
    assert sorted(map(tuple, got)) == sorted(want)
    assert A.align(named.limit(0), first=FIRST, second=SECOND, id_col="name", text_col="body").collect() == []
    nothing = A.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), first=FIRST, second=SECOND).collect()
    assert sorted(map(tuple, nothing)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_a_large_group_is_written_in_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(A, "PAIRS", 20)
    a, b = [5, 5, *range(100, 130)], [7, 8, 8, 9]
    batch = pa.RecordBatch.from_arrays([pa.array([",".join(map(str, a)) + "|" + ",".join(map(str, b)), "1|2"]), pa.array([3, 4])], names=["key", "docs"])
    out = list(A._expanded([batch]))
    assert len(out) > 2 and all(o.num_rows <= 100 for o in out)
    rows = [r for o in out for r in zip(*(c.to_pylist() for c in o.columns[1:]), strict=True)]
    assert Counter({(x, y): t for _, x, y, t in rows}) == Counter((x, y) for x in a for y in b) + Counter([(1, 2)])


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_by_definition(spark, sf):
    path = f"/root/testdata/{sf}"
    docs = [(d.doc_id, d.text[:1500] if d.text else d.text) for d in table(spark, path, "documents").collect()]
    got = A.align(spark.createDataFrame(docs, "doc_id long, text string"), first=FIRST, second=SECOND)
    assert sorted(map(tuple, got.collect())) == sorted(brute(docs)[0])
    whole = QUERIES["op13_alignment"](spark, path)
    assert whole.columns == COLUMNS and whole.count() == len(docs)
