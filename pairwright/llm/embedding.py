"""Near-duplicate embeddings: sign hashes of random hyperplanes, exact cosines, components.

Identical vectors form a class at once.  Classes are hashed in several tables by the sides
of random hyperplanes on which they lie.  What travels by table is a class's number and one
word of further signs; where classes of one label share a table's hash they meet block by
block, and the words rule out what can't be near.  Classes that may have a partner in a block
fetch their keys, which tell the table where a pair meets first, and where they are left their
vectors, and cosines decide in double precision.  A pair
that meets in several tables counts in the first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.components import components
from pairwright.llm.ids import ordered, restored
from pairwright.llm.scratch import written

#: Of pairs at the threshold, the share that may meet in no table, and the share that the words of signs may rule out.
MISSED, RULED_OUT = 1e-5, 1e-6
#: Vectors in a bucket, on average, that the number of hyperplanes aims at; and the fewest and most hyperplanes in a table.
BUCKET, FEWEST, MOST = 4096, 6, 26
#: Tables, at most: a bucket's number holds its table's in its lowest six bits.
TABLES = 63
#: Classes in a block; a larger bucket is worked off by pairs of blocks.
BLOCK = 4096
#: Rows of a block that are held against the other block at a time.
STRIP = 256
#: Signs in the word that rules pairs out.
SIGNS = 64


def shape(n: int, threshold: float) -> tuple[int, int]:
    """Hyperplanes in a table and tables for ``n`` vectors that may meet: more planes keep buckets small, more tables keep pairs."""
    alike = 1 - math.acos(min(max(threshold, -1.0), 1.0)) / math.pi
    n_planes = min(max(FEWEST, math.ceil(math.log2(max(n, 1) / BUCKET))), MOST)
    while True:
        n_tables = max(1, math.ceil(math.log(MISSED) / math.log(max(1 - alike**n_planes, 1e-12))))
        if n_tables <= TABLES or n_planes == 1:
            return n_planes, min(n_tables, TABLES)
        n_planes -= 1


def most_apart(threshold: float) -> int:
    """Of SIGNS signs, how many may differ: a pair at the threshold differs in more with probability RULED_OUT at most."""
    apart = math.acos(min(max(threshold, -1.0), 1.0)) / math.pi
    tail, k = 1.0, -1
    while tail > RULED_OUT and k < SIGNS:
        k += 1
        tail -= math.comb(SIGNS, k) * apart**k * (1 - apart) ** (SIGNS - k)
    return k


def planes(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def signs(vectors: np.ndarray, n_planes: int, n_tables: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each vector a key by table, and the word of signs of further hyperplanes."""
    n = n_planes * n_tables
    sides = vectors @ planes(vectors.shape[1], n + SIGNS, seed) > 0
    keys = (sides[:, :n].reshape(len(vectors), n_tables, n_planes) << np.arange(n_planes)).sum(2)
    word = np.packbits(sides[:, n:], axis=1).view(np.uint64)[:, 0]
    return keys.astype(np.int32), word


def _usable(column: pa.ChunkedArray | pa.Array) -> Iterator[np.ndarray | None]:
    """Vectors in double precision; None for null, empty or zero ones and those with null or non-finite parts."""
    for value in column:
        parts = value.as_py()
        if not parts or any(x is None for x in parts):
            yield None
            continue
        v = np.array(parts, float)
        yield _scaled(v) if np.isfinite(v).all() and v.any() else None


def _scaled(v: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, so that their largest components lie near 1 and squares stay in range; cosines stay the same."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(-1, keepdims=True))[1])


_HASHED = ("keys", "word")


def _hashed(them: Iterator[pa.RecordBatch], n_planes: int, n_tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Classes with their keys (four bytes a table) and words; unusable vectors get none."""
    for batch in them:
        vectors = list(_usable(batch.column("vector")))
        keys: list[bytes | None] = [None] * len(vectors)
        words: list[int | None] = [None] * len(vectors)
        for dim in sorted({len(v) for v in vectors if v is not None}):
            rows = [i for i, v in enumerate(vectors) if v is not None and len(v) == dim]
            of, word = signs(np.stack([vectors[i] for i in rows]), n_planes, n_tables, seed)
            for i, k, w in zip(rows, of, word.view(np.int64).tolist(), strict=True):
                keys[i], words[i] = k.tobytes(), w
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary()), pa.array(words, pa.int64())], names=[*batch.schema.names, *_HASHED])


def _first_here(left: np.ndarray, right: np.ndarray, tab: int) -> np.ndarray:
    """Which pairs of rows of keys share none of the tables before ``tab``."""
    return (left[:, :tab] != right[:, :tab]).all(1)


def _partners(table: pa.Table, apart: int) -> pa.Table:
    """Of one pair of blocks, the classes that may have a partner; with ``keys``, one which no earlier table has shown."""
    side, word = table.column("side").to_numpy(), table.column("word").to_numpy().view(np.uint64)
    keys = np.stack([np.frombuffer(k, np.int32) for k in table.column("keys").to_pylist()]) if "keys" in table.column_names else None
    tab = int(table.column("bucket")[0].as_py()) & 63
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(b) and table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
    if alone:
        b = a
    some = np.zeros(len(table), bool)
    for at in range(0, len(a), STRIP):
        i, j = np.nonzero(np.bitwise_count(word[a[at : at + STRIP], None] ^ word[None, b]) <= apart)
        i, j = a[at + i], b[j]
        if alone:
            i, j = i[i < j], j[i < j]
        # So many pairs at a time, however alike a block's classes are.
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            new = slice(None) if keys is None else _first_here(keys[p], keys[q], tab)
            some[p[new]] = some[q[new]] = True
    return table.select(["bucket", "lo", "hi", "side", "number"]).filter(pa.array(some))


def _compare(table: pa.Table, threshold: float) -> pa.Table:
    """Links of one pair of blocks: per class the vectors linked to it, and enough pairs to connect what is linked."""
    side, number, w = table.column("side").to_numpy(), table.column("number").to_numpy(), table.column("members").to_numpy()
    keys = np.stack([np.frombuffer(k, np.int32) for k in table.column("keys").to_pylist()])
    tab = int(table.column("bucket")[0].as_py()) & 63
    alone = table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
    vectors = table.column("vector").to_pylist()
    counts = np.zeros(len(number), np.int64)
    parent = list(range(len(number)))
    left, right = [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # A bucket is a hash of its label and length: should two ever share one, each is worked off by itself.
    kinds: dict[tuple, list[int]] = {}
    for i, (label, v) in enumerate(zip(table.column("label").to_pylist(), vectors, strict=True)):
        kinds.setdefault((label, len(v)), []).append(i)
    for rows in map(np.array, kinds.values()):
        x = _scaled(np.array([vectors[i] for i in rows], float))
        norm = np.sqrt((x * x).sum(1))
        a, b = np.flatnonzero(side[rows] == 0), np.flatnonzero(side[rows] == 1)
        if alone:
            b = a
        for at in range(0, len(a), STRIP):
            c = a[at : at + STRIP]
            i, j = np.nonzero((x[c] @ x[b].T) / norm[c][:, None] / norm[b][None, :] >= threshold)
            i, j = rows[c[i]], rows[b[j]]
            if alone:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 1 << 16):
                p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                new = _first_here(keys[p], keys[q], tab)
                p, q = p[new], q[new]
                np.add.at(counts, p, w[q])
                np.add.at(counts, q, w[p])
                # A forest over the linked pairs: the first link of each, joined as they come.
                for m, n in zip(p.tolist(), q.tolist(), strict=True):
                    u, v = root(m), root(n)
                    if u != v:
                        parent[u] = v
                        left.append(number[m])
                        right.append(number[n])
    kept = counts > 0
    n, m = int(kept.sum()), len(left)
    return pa.table({
        "number": pa.array(np.r_[number[kept], np.array(left, np.int64)]), "other": pa.array([None] * n + right, pa.int64()),
        "linked": pa.array(np.r_[counts[kept], np.zeros(m, np.int64)].astype(np.int64)),
    })


def near_vectors(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98,
    block: int = BLOCK, seed: int = 5,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept (it is its component's smallest id).

    Vectors link if their labels are equal and not null and their cosine is at least the
    threshold.  Null, empty and zero vectors, and those with null or non-finite parts, link
    with nothing, nor do vectors of different lengths or with a null id.  Every row is a
    vector of its own, whatever its id: rows that share an id and a vector link with each
    other, and rows that share an id alone have each their own links.
    """
    vectors, names = ordered(vectors.select(id_col, vector_col, label_col), id_col)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    # Two hashes of 64 bits name a class; zeros of either sign hash alike.
    one, two = (F.when(ok, F.xxhash64("label", F.size("vector"), "vector", F.lit(k))) for k in (1, 2))
    rows = rows.withColumn("p1", one).withColumn("p2", two)
    narrow = rows.where("p1 is not null").groupBy("p1", "p2", "label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("members"))
    n = vectors.where(F.col(label_col).isNotNull()).groupBy(label_col).count().agg(F.max("count")).first()[0] or 0
    n_planes, n_tables = shape(n, threshold)
    kinds = {c: narrow.schema[c].dataType.simpleString() for c in ("label", "vector")}
    schema = f"p1 long, p2 long, label {kinds['label']}, vector {kinds['vector']}, least long, members long, number long"
    # Numbers are fixed by writing them.
    narrow = narrow.withColumn("number", F.monotonically_increasing_id())
    classes = written(narrow.mapInArrow(lambda it: _hashed(it, n_planes, n_tables, seed), f"{schema}, keys binary, word long"), "classes")

    bucket = F.transform(F.sequence(F.lit(0), F.lit(n_tables - 1)), lambda t: F.xxhash64("label", F.size("vector"), t, F.substring(F.col("keys"), 4 * t + 1, F.lit(4))).bitwiseAND(~63).bitwiseOR(t.cast("long")))
    slots = classes.select("number", "word", F.explode(bucket).alias("bucket"))
    # Full buckets are worked off by pairs of blocks: block b meets each block after it as side 0, each before it as side 1, and itself.
    full = slots.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > block).select(F.col("bucket").alias("full"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    some = slots.join(full, F.col("bucket") == F.col("full"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    some = some.withColumn("mine", F.pmod(F.xxhash64("number"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = some.select("bucket", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "number", "word")
    apart = most_apart(threshold)
    at = ["bucket", "lo", "hi"]
    # Dealt by cell, not by bucket, so that a full bucket's pairs of blocks are many tasks' work.
    met = cells.repartition(*at).groupBy(*at).applyInArrow(lambda t: _partners(t, apart), "bucket long, lo int, hi int, side int, number long")
    met = written(met, "met")
    # The keys of all tables go only to those that have met: most classes have no partner, and those that have shall fetch their vectors once.
    kept = met.join(classes.select("number", "word", "keys"), "number")
    met = kept.repartition(*at).groupBy(*at).applyInArrow(lambda t: _partners(t, apart), "bucket long, lo int, hi int, side int, number long")
    met = written(met, "partners")
    found = met.join(classes.select("number", "label", "vector", "members", "keys"), "number")
    found = found.repartition(*at).groupBy(*at).applyInArrow(lambda t: _compare(t, threshold), "number long, other long, linked long")
    found = written(found, "cosines")
    linked = found.groupBy("number").agg(F.sum("linked").alias("linked"))
    parts = components(found.where(F.col("other").isNotNull()), "number", "other")
    of = classes.select("p1", "p2", "number", "least", "members").join(linked, "number", "left").join(parts.select(F.col("node").alias("number"), "component"), "number", "left").withColumn("component", F.coalesce("component", "number"))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = of.join(least, "component").select("p1", "p2", (F.col("members") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "p1", "p2").join(of, ["p1", "p2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return restored(out, names, "vec_id", "component_id").withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
