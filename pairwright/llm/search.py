"""Ranked lexical search: an index in shards, and MaxScore over each shard.

A shard is a bounded run of documents and holds their postings by term, whole, in one row, so
building an index shuffles nothing and a shard is never split between tasks.  With every term
go its largest count and the fewest terms of its documents: both bound what the term can give
to any document of the shard, whatever the corpus-wide figures are.  For an item, terms are put
in order of these bounds; the longest run of small ones that can't reach the score to beat
together is not essential: only documents of the other lists are looked at, and the lists that
aren't essential are probed, largest bound first, for those documents that can still qualify.
The score to beat is the last of the best documents so far, carried from shard to shard of a task.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairwright.llm.scratch import trimmed, written

#: A shard is closed at so many bytes of text, or so many documents (two bytes number a document).
SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 16
#: Items answered in one pass over the index.
BLOCK = 1024
#: Documents of a shard looked at first; each range after it is twice as long.
FIRST_RANGE = 512
#: Longer texts are read without a list of their terms.
LONG = 1 << 20
#: A term is a run of letters and digits of ASCII and of whatever lies beyond ASCII; A-Z in lower case.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def counted(text: bytes | None) -> Counter:
    """Occurrences of each term of a text in UTF-8; none for null."""
    lower = (text or b"").translate(_LOWER)
    return Counter(_TERM.findall(lower) if len(lower) <= LONG else (m.group() for m in _TERM.finditer(lower)))


class _Shard:
    """Gathers documents, and gives them as one row of the index."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids: list[pa.Array] = []
        self.n: list[int] = []
        self.term: list[np.ndarray] = []
        self.count: list[np.ndarray] = []
        self.bytes = 0

    def add(self, id_: pa.Array, text: bytes | None) -> None:
        found = counted(text)
        self.ids.append(id_)
        self.n.append(sum(found.values()))
        number = self.number
        self.term.append(np.fromiter((number.setdefault(t, len(number)) for t in found), np.int32, len(found)))
        self.count.append(np.fromiter(found.values(), np.int32, len(found)))
        self.bytes += len(text or b"")

    def row(self) -> pa.RecordBatch:
        ids, n = pa.concat_arrays(self.ids), np.array(self.n, np.int64)
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()  # equal scores go by id: the smaller number comes first
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc = np.repeat(place, [len(t) for t in self.term])
        term, count = np.concatenate(self.term), np.concatenate(self.count)
        by = np.lexsort([doc, term])
        doc, term, count, n = doc[by], term[by], count[by], n[order]
        sizes = np.bincount(term, minlength=len(self.number))
        first = np.cumsum(sizes) - sizes
        most = np.maximum.reduceat(count, first) if len(first) else count
        least = np.minimum.reduceat(n[doc], first) if len(first) else n[:0]
        ids = ids.take(pa.array(order))
        values = {
            "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "n": n, "terms": b"\n".join(self.number), "sizes": sizes.astype(np.int32), "docs": doc.astype(np.uint16),
            "counts": count.astype(np.int32), "most": most.astype(np.int32), "least": least.astype(np.int64),
        }
        columns = [v if isinstance(v, pa.Array) else pa.array([v if isinstance(v, bytes) else v.tobytes()], pa.binary()) for v in values.values()]
        return pa.RecordBatch.from_arrays(columns, names=list(values))


def build(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The index of all documents, a row per shard, written to the shared folder.

    Ids may be of any type that Arrow can sort; null ids come last.  Null texts have no terms,
    and rows that repeat are documents of their own.  Other columns are not read.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def shards(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in them:
            for i in range(batch.num_rows):
                if shard.bytes >= shard_bytes or len(shard.n) >= min(shard_docs, SHARD_DOCS):
                    yield shard.row()
                    shard = _Shard()
                shard.add(batch.column(0).slice(i, 1), batch.column(1)[i].as_py())
        if shard.n:
            yield shard.row()

    kind = narrow.schema["id"].dataType.simpleString()
    schema = f"ids array<{kind}>, n binary, terms binary, sizes binary, docs binary, counts binary, most binary, least binary"
    return written(narrow.mapInArrow(lambda it: trimmed(shards(it)), schema), "index")


def _numbers(value: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def statistics(index: DataFrame, wanted: set[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """Documents with a term, terms of all documents, and for each wanted term the documents that hold it."""
    shared = index.sparkSession.sparkContext.broadcast(wanted)

    def summed(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        n_docs = n_terms = 0
        for batch in them:
            for n, terms, sizes in zip(*(batch.column(i) for i in range(3)), strict=True):
                n = _numbers(n, np.int64)
                n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
                df.update({t: s for t, s in zip(terms.as_py().split(b"\n"), _numbers(sizes, np.int32).tolist(), strict=False) if t in shared.value})
        yield pa.RecordBatch.from_arrays([pa.array([*df, None, None], pa.binary()), pa.array([*df.values(), n_docs, 0]), pa.array([0] * (len(df) + 1) + [n_terms])], names=["term", "df", "terms"])

    got = index.select("n", "terms", "sizes").mapInArrow(summed, "term binary, df long, terms long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("terms").alias("terms")).collect()
    df = {None if r["term"] is None else bytes(r["term"]): (r["df"], r["terms"]) for r in got}
    n_docs, n_terms = df.pop(None, (0, 0))
    return n_docs, n_terms, {t: n for t, (n, _) in df.items()}


def weights(n_docs: int, df: dict[bytes, int]) -> dict[bytes, int]:
    return {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}


def _norms(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a document's length makes of it."""
    if 90 * int(n.max(initial=0)) * n_docs < 1 << 63:
        return 10 + 90 * n * n_docs // max(n_terms, 1)
    return np.array([10 + 90 * x * n_docs // max(n_terms, 1) for x in n.tolist()], np.int64)


def _part(count: np.ndarray, norm: np.ndarray) -> np.ndarray:
    count = count.astype(np.int64)
    return 1_000_000_000 * count // (1000 * count + 8 * norm)


class Lists:
    """The postings of a shard's wanted terms; what they give is worked out once and kept."""

    def __init__(self, row: dict, wanted: dict[bytes, int], n_docs: int, n_terms: int) -> None:
        self.norm = _norms(_numbers(row["n"], np.int64), n_docs, n_terms)
        sizes = _numbers(row["sizes"], np.int32)
        self.ends = np.cumsum(sizes, dtype=np.int64)
        self.docs, self.counts = _numbers(row["docs"], np.uint16), _numbers(row["counts"], np.int32)
        self.at = {t: i for i, t in enumerate(row["terms"].as_py().split(b"\n")) if t in wanted and i < len(sizes)}
        self.bound = _part(_numbers(row["most"], np.int32), _norms(_numbers(row["least"], np.int64), n_docs, n_terms))
        self.sizes, self.given = sizes, {}

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        some = slice(self.ends[term] - self.sizes[term], self.ends[term])
        return self.docs[some], self.counts[some]

    def parts(self, term: int) -> np.ndarray:
        if term not in self.given:
            docs, counts = self.of(term)
            self.given[term] = _part(counts, self.norm[docs])
        return self.given[term]


def max_score(lists: Lists, terms: dict[bytes, int], k: int, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard that can be among the ``k`` best, and their scores; ``terms`` have weights, ``best`` are scores of other shards.

    Whole scores come out, for at most ``k`` documents: among equal ones the smaller numbers.
    """
    found = sorted((w * int(lists.bound[i]), i, w) for t, w in terms.items() if w > 0 and (i := lists.at.get(t)) is not None)
    bound = np.cumsum([0, *(b for b, _, _ in found)])
    top_docs, top_scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, length, n = 0, FIRST_RANGE, len(lists.norm)
    while low < n:
        high = min(n, low + length)
        scores = np.concatenate([best, top_scores])
        beat = int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 1
        essential = int(np.searchsorted(bound[1:], beat))  # the lists before it give less than the score to beat, all together
        if essential == len(found):
            break
        total = np.zeros(high - low)
        for _, i, w in found[essential:]:
            docs = lists.of(i)[0]
            a, b = np.searchsorted(docs, np.uint16(low)), np.searchsorted(docs, np.uint16(high)) if high < n else len(docs)
            total[docs[a:b] - low] += w * lists.parts(i)[a:b]  # a document stands once in a list
        able = np.flatnonzero((total > 0) & (total + bound[essential] >= beat))
        total = total[able].astype(np.int64)
        for at in range(essential - 1, -1, -1):
            if not len(able):
                break
            _, i, w = found[at]
            docs, counts = lists.of(i)
            sought = (able + low).astype(np.uint16)
            place = np.minimum(np.searchsorted(docs, sought), len(docs) - 1)
            hit = docs[place] == sought
            total[hit] += w * _part(counts[place[hit]], lists.norm[docs[place[hit]]])
            still = total + bound[at] >= beat
            able, total = able[still], total[still]
        docs, scores = np.concatenate([top_docs, able + low]), np.concatenate([top_scores, total])
        order = np.lexsort([docs, -scores])[:k]
        top_docs, top_scores = docs[order], scores[order]
        low, length = high, length * 2
    keep = top_scores > 0
    return top_docs[keep], top_scores[keep]


def _answered(index: DataFrame, items: pa.Table, k: int) -> DataFrame:
    """The best documents of each task's shards for each of a block of items: number, item_id, doc_id and score."""
    terms = [counted(text) for text in items.column("text").to_pylist()]
    n_docs, n_terms, df = statistics(index, {t for some in terms for t in some})
    weight = weights(n_docs, df)
    asked = [{t: weight[t] for t in some if t in weight} for some in terms]
    numbers, ids = items.column("number").combine_chunks(), items.column("item_id").combine_chunks()
    shared = index.sparkSession.sparkContext.broadcast((asked, weight, numbers, ids))  # BLOCK items at most

    def searched(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight, numbers, ids = shared.value
        best: list[list[tuple]] = [[] for _ in asked]
        kind = pa.null()
        for batch in them:
            for at in range(batch.num_rows):
                lists = Lists({name: batch.column(name)[at] for name in batch.schema.names}, weight, n_docs, n_terms)
                doc_ids = batch.column("ids")[at].values
                kind = doc_ids.type
                for item, some in enumerate(asked):
                    docs, scores = max_score(lists, some, k, np.array([-b[0] for b in best[item]], np.int64))
                    if len(docs):
                        found = doc_ids.take(pa.array(docs)).to_pylist()
                        both = best[item] + [(-s, d is None, d) for s, d in zip(scores.tolist(), found, strict=True)]
                        best[item] = sorted(both, key=lambda b: (b[0], b[1]) if b[1] else b)[:k]
        rows = [(item, -s, d) for item, some in enumerate(best) for s, _, d in some]
        if rows:
            item = pa.array([r[0] for r in rows])
            yield pa.RecordBatch.from_arrays([numbers.take(item), ids.take(item), pa.array([r[2] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64())], names=["number", "item_id", "doc_id", "score"])

    of_doc = index.schema["ids"].dataType.elementType.simpleString()
    of_item = {"int64": "bigint", "int32": "int", "string": "string", "large_string": "string"}.get(str(ids.type), "string")
    return index.mapInArrow(lambda it: trimmed(searched(it)), f"number long, item_id {of_item}, doc_id {of_doc}, score long")


def search(index: DataFrame, items: DataFrame, *, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``k`` documents of highest score for each item: item_id, rank (from 1), doc_id and score.

    Equal scores go by ascending doc_id, null ids last.  Every row of ``items`` is an item, also
    where its id repeats or is null; one without terms, or whose terms stand in no document, gets
    no rows.  Only a block of BLOCK items is ever held at once, and each block reads the index
    twice: for the documents of its terms, and to answer.
    """
    kind = items.schema[id_col].dataType.simpleString()
    asked = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("binary").alias("text"))
    if kind not in ("bigint", "int", "string"):
        asked = asked.withColumn("item_id", F.col("item_id").cast("string"))
    asked = written(asked, "items").withColumn("number", F.monotonically_increasing_id())
    blocks = max(1, -(-asked.count() // BLOCK))
    found = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b).toArrow()
        part = _answered(index, block, k)
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")


def search_query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(build(docs), items)
