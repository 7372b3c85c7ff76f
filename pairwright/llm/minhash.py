"""Near-duplicate documents by MinHash: banding, signatures, exact sets, components.

Documents with the same set of shingles form a class.  Of each class the minima of many
universal hashes are taken; classes whose minima agree in a whole band meet in a bucket.
In a bucket every class first meets the smallest one, in parts of bounded size; whatever
the links found so far leave apart then meets the rest of its bucket block by block.
Signatures rule pairs out, full sets confirm them, and only as many links leave a task as
connect what it found connected.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.components import components
from pairwright.llm.ids import ordered, restored
from pairwright.llm.scratch import trimmed, written

SHINGLE = 5
#: Rows that a copy's removal is sent to all executors with, at most: an id and a hash each, some 50 MB.
SENT_ROWS = 2_000_000
#: Bands and hashes in each: of pairs at 0.85, less than one in a million meets in no band.
BANDS, ROWS = 20, 4
#: Pairs whose signatures agree this much less than the threshold, more than five standard errors, are ruled out.
SLACK = 0.22
#: Classes in a block, and shingles of their sets, on average at most.
BLOCK, BLOCK_SHINGLES = 256, 2_000_000
#: Bytes of text worked on at once.
STEP = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_TURNS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    up, down = np.full(n, _U(_BASE)), np.full(n, _U(pow(_BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@functools.lru_cache(maxsize=1)
def _hashes() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(85)
    n = BANDS * ROWS
    return r.integers(0, 1 << 63, n, np.uint64) * _U(2) + _U(1), r.integers(0, 1 << 63, n, np.uint64)


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (and the last ones end)."""
    data = b"\n".join([*texts, b""])
    buf = np.frombuffer(data, np.uint8)
    size = 1 << max(16, (len(buf) + 1).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + _U(1)) * up[: len(buf)], out=total[1:])
    word = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(start, begins)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text, the sorted hashes of its distinct shingles."""
    group: list[bytes] = []
    held = 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        if held + len(data) > STEP and group:
            yield from _sets(group)
            group, held = [], 0
        group.append(data)
        held += len(data)
    if group:
        yield from _sets(group)


def _sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    words, at = _word_hashes(texts)
    m = max(0, len(words) - SHINGLE + 1)
    run = np.zeros(m, np.uint64)
    for k in range(SHINGLE):
        run += words[k : k + m] * _TURNS[k]
    run = mix(run)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= SHINGLE:
            yield np.unique(run[a : b - SHINGLE + 1])
        elif b > a:
            yield mix((words[a:b] * _TURNS[: b - a]).sum(keepdims=True) + _U(b - a))
        else:
            yield np.zeros(0, np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minima of the universal hashes over a set, their upper 32 bits."""
    a, b = _hashes()
    least = np.full(len(a), _U(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), 256):
        np.minimum(least, (hashes[at : at + 256, None] * a + b).min(0), out=least)
    return (least >> _U(32)).astype(np.uint32).view(np.int32)


def _signed(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(at, 512) for whole in them for at in range(0, whole.num_rows, 512)):
        n, one, two, signs = [], [], [], []
        for s in shingle_sets(batch.column(1).to_pylist()):
            n.append(len(s))
            one.append(int(mix(s).sum()))
            two.append(int(mix(s ^ _U(0x5851F42D4C957F2D)).sum()))
            signs.append(signature(s) if len(s) else None)
        as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), as_long(one), as_long(two), pa.array(signs, pa.list_(pa.int32()))], names=["doc_id", "text_hash", "n_shingles", "print1", "print2", "signs"])


def _with_sets(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in them:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = list(shingle_sets(part.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([signature(s).tobytes() for s in sets], pa.binary())], names=["rep", "hashes", "signs"])


class _Linker:
    """Union of classes by links that full sets confirm."""

    def __init__(self, table: pa.Table, percent: int) -> None:
        self.ids = table.column("rep").to_numpy()
        self.sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        self.sizes = np.array([len(s) for s in self.sets])
        self.signs = np.stack([np.frombuffer(x, np.int32) for x in table.column("signs").to_pylist()])
        self.percent = percent
        self.parent = list(range(len(self.ids)))
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, groups: np.ndarray) -> None:
        """Rows of the same group are connected already."""
        first: dict[int, int] = {}
        for i, g in enumerate(groups.tolist()):
            self.parent[self.root(i)] = self.root(first.setdefault(g, i))

    def meet(self, i: int, others: np.ndarray) -> None:
        """Try row i with others that nothing connects to it yet."""
        small, large = np.minimum(self.sizes[others], self.sizes[i]), np.maximum(self.sizes[others], self.sizes[i])
        others = others[100 * small >= self.percent * large]
        if not len(others):
            return
        agree = (self.signs[others] == self.signs[i]).mean(1)
        for j in others[np.argsort(-agree, kind="stable")][: (agree >= self.percent / 100 - SLACK).sum()].tolist():
            a, b = self.root(i), self.root(j)
            if a == b:
                continue
            both = np.intersect1d(self.sets[i], self.sets[j], assume_unique=True).size
            if 100 * both >= self.percent * (self.sizes[i] + self.sizes[j] - both):
                self.parent[a] = b
                self.links.append((i, j))

    def result(self) -> pa.Table:
        i, j = (np.array([x[k] for x in self.links], np.int64) for k in (0, 1))
        return pa.table({"left": pa.array(self.ids[i].astype(np.int64)), "right": pa.array(self.ids[j].astype(np.int64))})


def _stars(table: pa.Table, percent: int) -> pa.Table:
    """A part of a star: its centre with each class, then classes that stay apart with each other."""
    table = table.sort_by("rep")
    link = _Linker(table, percent)
    n = len(link.ids)
    centre = int(np.flatnonzero(link.ids == table.column("centre")[0].as_py())[0])
    link.meet(centre, np.delete(np.arange(n), centre))
    for i in range(n):
        if link.root(i) != link.root(centre):
            link.meet(i, np.delete(np.arange(n), i))
    return link.result()


def _blocks(table: pa.Table, percent: int) -> pa.Table:
    """Classes outside their bucket's main component, with a block of the bucket."""
    link = _Linker(table, percent)
    link.join(table.column("component").to_numpy())
    side = table.column("side").to_numpy()
    rest = np.flatnonzero(side == 1)
    for i in np.flatnonzero(side == 0).tolist():
        link.meet(i, rest[link.ids[rest] != link.ids[i]])
    return link.result()


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept (it is its component's smallest id).

    Documents link if ``percent`` of the union of their sets of five-word shingles, A-Z in
    lower case, is in both.  Fewer words count as one shingle; without words, or with a null
    text or id, a document links with nothing.  Every row is a document of its own, whatever
    its id: rows that share an id have each their own links.
    """
    docs, names = ordered(docs.select(id_col, text_col), id_col)
    placed = restored(_placed(docs, id_col, text_col, percent), names, "doc_id", "component_id")
    return placed.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _parts(n: str, shingles: str) -> Column:
    """Blocks for so many classes and shingles."""
    return F.ceil(F.greatest(F.col(n) / BLOCK, F.col(shingles) / BLOCK_SHINGLES, F.lit(1))).cast("int")


def _placed(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Per row: doc_id, text_hash, n_shingles, component_id, and whether it is its component's first by id and text_hash.

    Classes are documents with one set, told apart by 128 bits of hash and the set's size, and
    numbered; a class's first row by id and hash of the text stands for it.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    prints = written(narrow.mapInArrow(lambda it: trimmed(_signed(it)), "doc_id long, text_hash long, n_shingles long, print1 long, print2 long, signs array<int>"), "prints")
    full = prints.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("print1", "print2", "n_shingles").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.any_value("signs").alias("signs"))
    # Numbers are fixed by writing them.
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    band = lambda t: F.xxhash64(F.slice("signs", t * ROWS + 1, ROWS), t)
    slots = classes.select("rep", "n_shingles", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("bucket"))
    full_buckets = slots.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).where("n > 1")
    meets = written(slots.join(full_buckets, "bucket"), "meets")

    needed = meets.select("rep").distinct().join(classes.select("rep", "first.*"), "rep")
    texts = narrow.join(needed, ["doc_id", "text_hash"]).select("rep", "text").dropDuplicates(["rep"])
    sets = written(texts.mapInArrow(lambda it: trimmed(_with_sets(it)), "rep long, hashes binary, signs binary"), "sets")

    # Stars: every class of a bucket with the bucket's smallest, once however many buckets they share.
    stars = meets.where("rep <> centre").select("centre", "rep", "n_shingles").distinct()
    parts = stars.groupBy("centre").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")).select("centre", _parts("n", "shingles").alias("parts"))
    leaves = stars.join(parts, "centre").select("centre", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), "rep")
    centres = parts.select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("centre").alias("rep"))
    links = leaves.union(centres).join(sets, "rep").groupBy("centre", "part").applyInArrow(lambda t: _stars(t, percent), "left long, right long")
    links = written(links, "stars")

    # Blocks: in buckets that the links leave in several components, what is outside the main one meets the rest.
    parts_of = written(components(links, "left", "right"), "components")
    placed = meets.join(parts_of, F.col("rep") == F.col("node"), "left").select("bucket", "rep", "n_shingles", F.coalesce("component", "rep").alias("component"))
    counted = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who"))
    split = counted.groupBy("bucket").agg(F.max(F.struct("n", "component", "s")).alias("main"), F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("who").alias("who")).where("k > 1")
    # Buckets with the same members are one; a star of two has met already.
    split = split.where("n > 2").groupBy("who", "n", "s").agg(F.min(F.struct("bucket", "main")).alias("b"))
    split = split.select("b.bucket", F.col("b.main.component").alias("main"), "n", "s", (F.col("n") - F.col("b.main.n")).alias("n_out"), (F.col("s") - F.col("b.main.s")).alias("s_out"))
    split = split.select("bucket", "main", _parts("n_out", "s_out").alias("outer"), _parts("n", "s").alias("inner"))
    inside = placed.join(split, "bucket")
    block = lambda k: F.pmod(F.xxhash64("rep"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    outer = inside.where(F.col("component") != F.col("main")).select("bucket", block("outer").alias("o"), every("inner").alias("i"), "rep", "component", F.lit(0).alias("side"))
    inner = inside.select("bucket", every("outer").alias("o"), block("inner").alias("i"), "rep", "component", F.lit(1).alias("side"))
    more = outer.union(inner).join(sets, "rep").groupBy("bucket", "o", "i").applyInArrow(lambda t: _blocks(t, percent), "left long, right long")
    links = written(links.union(more), "links")

    found = components(links, "left", "right")
    keys = ["print1", "print2", "n_shingles"]
    of = classes.select(*keys, "rep", "first").join(found, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    least = of.groupBy("component").agg(F.min("first").alias("least"))
    of = of.join(least, "component").select(*keys, "least")
    out = prints.select("doc_id", "text_hash", *keys).join(of, keys, "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return out.select(
        "doc_id", "text_hash", "n_shingles", F.when(linked, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(linked, F.struct("doc_id", "text_hash") == F.col("least")).otherwise(F.lit(True)).alias("first"),
    )


def without_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The documents, all columns: of each group of near copies the one with the smallest id.

    Of rows with that id the one whose text has the smallest hash stays; rows that share both
    id and text are one document and stay or go together.
    """
    known, names = ordered(docs.select(id_col, text_col), id_col)
    gone = restored(_placed(known, id_col, text_col, percent).where("not first").select("doc_id", "text_hash"), names, "doc_id")
    gone = written(gone, "gone")
    if names is None and gone.count() <= SENT_ROWS:  # else, or where ids are texts of any length, Spark joins by shuffling both sides
        gone = F.broadcast(gone)
    return docs.join(gone, (docs[id_col] == gone["doc_id"]) & (F.xxhash64(docs[text_col]) == gone["text_hash"]), "left_anti")
