"""Links between the tokens that two tokenizers cut the same text into, and how common they are.

Where both cut at the same byte, a group of tokens ends; every pair of tokens of a group is a
link.  Groups repeat far more than texts do, so they are interned: each block of documents has a
dictionary of its own, whose entries meet in one of the whole corpus.  Links are expanded there
only, once per distinct group, and a pair's documents are the sum over its groups of the documents
that hold them, less what a document with several such groups counts too often, which each block
finds for itself.  What the pairs of a group are worth goes back by the group's key to the blocks
that hold it, and from there to documents; no document's groups travel one by one.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.packing import encoder, vocabulary
from pairwright.llm.scratch import trimmed, written

#: A block of documents is closed at so many characters of text, or so many documents.
BLOCK_CHARS, BLOCK_DOCS = 2 << 20, 8192
#: Pairs of a group written at once.
PAIRS = 1 << 18
#: Ids of the second tokenizer lie below this power of two.
_BITS = 20


@functools.lru_cache(maxsize=1)
def _first(path: str):
    """Ids of a text by the byte-level tokenizer, and the bytes of each id."""
    by_id = [b""] * (1 + max(vocabulary(path).values()))
    for token, n in vocabulary(path).items():
        by_id[n] = token
    return encoder(path), by_id


@functools.lru_cache(maxsize=1)
def _second(path: str):
    """Ids of a text by the piece tokenizer, which adds a space in front, and the bytes of each id."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    if model.get_piece_size() > 1 << _BITS:
        raise ValueError(f"more than {1 << _BITS} pieces: {path}")
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    by_id = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return lambda text: np.array(model.encode(text, num_threads=1), np.int64), by_id


class Aligner:
    """Both tokenizers: cuts documents, and finds the groups of a block of them."""

    def __init__(self, first: str, second: str) -> None:
        (self.encode_a, self.bytes_a), (self.encode_b, self.bytes_b) = _first(first), _second(second)
        self.length_a, self.length_b = (np.array([len(t) for t in by_id], np.int64) for by_id in (self.bytes_a, self.bytes_b))

    def cut(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of space and text, and B's ids of text; none for null, empty, or where either does not give the bytes back."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not text:
            return none
        whole = f" {text}".encode("utf-8", "replace")
        a, b = self.encode_a(f" {text}").astype(np.int64), self.encode_b(text)
        same = all(b"".join(map(of.__getitem__, ids.tolist())) == whole for of, ids in ((self.bytes_a, a), (self.bytes_b, b)))
        return (a, b) if same else none

    def block(self, texts: list[str | None]) -> Block:
        cut = [self.cut(t) for t in texts]
        n_a, n_b = (np.array([len(c[k]) for c in cut], np.int64) for k in (0, 1))
        a, b = (np.concatenate([c[k] for c in cut] or [np.zeros(0, np.int64)]) for k in (0, 1))
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])  # both cut at every document's end
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_a, last_b = np.searchsorted(ends_a, common), np.searchsorted(ends_b, common)
        doc = np.searchsorted(np.cumsum(n_a), last_a, side="right")
        return Block(n_a, n_b, a, b, np.r_[0, last_a + 1], np.r_[0, last_b + 1], doc)


class Block:
    """The groups of a block of documents: a dictionary, and each document's entries.

    ``code[g]`` is the entry of the g-th group and ``doc[g]`` its document; ``keys`` are the entries'
    texts, ``a1,a2|b1``.
    """

    def __init__(self, n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, doc: np.ndarray) -> None:
        self.n_a, self.n_b, self.doc = n_a, n_b, doc
        size_a, size_b = np.diff(at_a), np.diff(at_b)
        one = (size_a == 1) & (size_b == 1)
        self.code = np.zeros(len(doc), np.int64)
        single, self.code[one] = np.unique(a[at_a[:-1][one]] << _BITS | b[at_b[:-1][one]], return_inverse=True)
        number: dict[tuple[bytes, bytes], int] = {}
        more = np.flatnonzero(~one)
        bytes_a, bytes_b = a.tobytes(), b.tobytes()
        spans = zip((8 * at_a[more]).tolist(), (8 * at_a[more + 1]).tolist(), (8 * at_b[more]).tolist(), (8 * at_b[more + 1]).tolist(), strict=True)
        self.code[more] = [len(single) + number.setdefault((bytes_a[p:q], bytes_b[r:s]), len(number)) for p, q, r, s in spans]
        several = [(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)) for x, y in number]
        plain = lambda ids: ",".join(map(str, ids.tolist()))
        self.keys = [f"{p >> _BITS}|{p & (1 << _BITS) - 1}" for p in single.tolist()] + [f"{plain(x)}|{plain(y)}" for x, y in several]
        self.n_links = np.bincount(doc, size_a * size_b, len(n_a)).astype(np.int64)
        distinct = [np.unique(x[:, None] << _BITS | y) for x, y in several]
        self._pairs = np.concatenate([single, *distinct])
        self._sizes = np.array([1] * len(single) + [len(d) for d in distinct], np.int64)
        #: Each document's distinct entries, in order of documents, and how often it has them.
        width = max(len(self.keys), 1)
        both, self.times = np.unique(doc * width + self.code, return_counts=True)
        self.of_doc, self.entry = both // width, both % width
        self.docs = np.bincount(self.entry, minlength=len(self.keys))

    def counted_again(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs that a document holds in several distinct groups: A id, B id and by how much sums over groups exceed its documents."""
        pair, number = np.unique(self._pairs, return_inverse=True)
        first = np.cumsum(self._sizes) - self._sizes
        size = self._sizes[self.entry]
        at = np.repeat(first[self.entry], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        width = max(len(pair), 1)
        held, times = np.unique(np.repeat(self.of_doc, size) * width + number[at], return_counts=True)
        again = np.bincount(held % width, times - 1, len(pair)).astype(np.int64)
        some = np.flatnonzero(again)
        return pair[some] >> _BITS, pair[some] & ((1 << _BITS) - 1), again[some]

    def digests(self) -> list[str]:
        ends = np.cumsum(np.bincount(self.doc, minlength=len(self.n_a))).tolist()
        text = list(map(self.keys.__getitem__, self.code.tolist()))
        return [hashlib.sha256(";".join(text[p:q]).encode()).hexdigest() if q > p else "" for p, q in zip([0, *ends], ends, strict=False)]


_PARTS = "block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, entries binary, times binary, entry int, key string, docs long, a int, b int, again long"


def _rows(of: dict, schema: pa.Schema, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(of[f.name], f.type) if f.name in of else pa.nulls(n, f.type) for f in schema], schema=schema)


def _aligned(docs: DataFrame, first: str, second: str, id_col: str, text_col: str, block_docs: int) -> DataFrame:
    """Rows of three kinds: documents (with the entries they hold), entries of blocks' dictionaries, and pairs counted again."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def blocks(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, task, number = Aligner(first, second), TaskContext.get().partitionId(), 0
        numbers = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

        def made(ids: list[pa.Array], texts: list[str | None]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("doc_id", ids[0].type), *((n, numbers[t]) for n, t in (p.split() for p in _PARTS.split(", ")))])
            block, at = aligner.block(texts), task << 32 | number
            split = np.searchsorted(block.of_doc, np.arange(1, len(texts)))
            packed = lambda values: [v.astype(np.int32).tobytes() for v in np.split(values, split)]
            n_groups = np.bincount(block.doc, minlength=len(texts))
            of = {"doc_id": pa.concat_arrays(ids), "n_a": block.n_a, "n_b": block.n_b, "n_groups": n_groups, "n_links": block.n_links, "groups_sha256": block.digests(), "entries": packed(block.entry), "times": packed(block.times)}
            yield _rows(of | {"block": [at] * len(texts)}, schema, len(texts))
            n = len(block.keys)
            yield _rows({"block": [at] * n, "entry": np.arange(n), "key": block.keys, "docs": block.docs}, schema, n)
            a, b, again = block.counted_again()
            yield _rows({"a": a, "b": b, "again": again}, schema, len(a))

        ids, texts, held = [], [], 0
        for batch in them:
            for i in range(batch.num_rows):
                ids.append(batch.column(0).slice(i, 1))
                texts.append(batch.column(1)[i].as_py())
                held += len(texts[-1] or "")
                if held >= BLOCK_CHARS or len(texts) >= block_docs:
                    yield from made(ids, texts)
                    ids, texts, held, number = [], [], 0, number + 1
        if texts:
            yield from made(ids, texts)

    return written(narrow.mapInArrow(lambda it: trimmed(blocks(it)), f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, {_PARTS}"), "aligned")


def _expanded(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct pairs of each group, and how often the group has each."""
    held: list[list] = [[], [], [], [], []]
    for batch in them:
        for key, docs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            (a, n_a), (b, n_b) = (np.unique(np.array(side.split(","), np.int64), return_counts=True) for side in key.split("|"))
            step = max(1, PAIRS // len(b))
            for at in range(0, len(a), step):
                x = a[at : at + step]
                held[0] += [key] * (len(x) * len(b))
                held[1] += [docs] * (len(x) * len(b))
                held[2] += np.repeat(x, len(b)).tolist()
                held[3] += np.tile(b, len(x)).tolist()
                held[4] += np.outer(n_a[at : at + step], n_b).ravel().tolist()
                if len(held[0]) >= PAIRS:
                    yield _pairs(held)
                    held = [[], [], [], [], []]
    yield _pairs(held)


def _pairs(held: list[list]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(held, kinds, strict=True)], names=["key", "docs", "a", "b", "times"])


def links(aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Id pairs with their number of documents and whether it is the highest of the A id; and groups with what their links come to."""
    entries = aligned.where("key IS NOT NULL").groupBy("key").agg(F.sum("docs").alias("docs"))
    expanded = written(entries.mapInArrow(lambda it: trimmed(_expanded(it)), "key string, docs long, a int, b int, times long"), "links")
    again = aligned.where("again IS NOT NULL").select("a", "b", (-F.col("again")).alias("docs"))
    counts = written(expanded.select("a", "b", "docs").union(again).groupBy("a", "b").agg(F.sum("docs").alias("count")), "pairs")
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    pairs = counts.join(highest, "a").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))
    worth = expanded.join(pairs, ["a", "b"]).groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    return pairs, worth


def align(docs: DataFrame, *, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    ``first`` is the file of a byte-level tokenizer, given space and text, ``second`` that of a piece
    tokenizer that adds the space.  Null and empty texts, and those whose tokens don't give space and
    text back, have zeros and an empty digest.  Rows that repeat are documents of their own; an empty
    table gives no rows.  Other columns are not read.
    """
    aligned = _aligned(docs, first, second, id_col, text_col, block_docs)
    worth = links(aligned)[1]
    held = aligned.where("key IS NOT NULL").select("block", "entry", "key").join(worth, "key").select(F.col("block").alias("of_block"), "entry", "n_best", "count_sum")
    of_docs = aligned.where("groups_sha256 IS NOT NULL").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "entries", "times")

    def summed(docs: pa.Table, entries: pa.Table) -> pa.Table:
        order = entries.column("entry").to_numpy()
        sums = {}
        for name in ("n_best", "count_sum"):
            value = np.zeros(len(order), np.int64)
            value[order] = entries.column(name).to_numpy()
            sums[name] = [int(value[np.frombuffer(e, np.int32)] @ np.frombuffer(t, np.int32).astype(np.int64)) for e, t in zip(docs.column("entries").to_pylist(), docs.column("times").to_pylist(), strict=True)]
        out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        for name, values in sums.items():
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out.append_column("groups_sha256", docs.column("groups_sha256"))

    kind = of_docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return of_docs.groupBy("block").cogroup(held.groupBy("of_block")).applyInArrow(summed, schema)
