"""Quality scores from random-indexing word vectors, pooled by document, and a two-layer network.

A word's index vector needs no table: each of its forms (its runs of three characters and the
word itself) hashes to a few places with signs, and these are summed.  Its context vector is the
sum of its neighbours' index vectors, shifted by their distance, over the texts learned from.
Index vectors are whole numbers, so sums over any partitions come out the same.  A document is
the mean of its words' vectors with three numbers more; a network of two layers, fitted in NumPy,
gives the odds, and one temperature, fitted on rows that the network hasn't seen, calibrates them.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.langid import held_out, sampled
from pairwright.llm.scratch import trimmed, written

#: Places of a vector (a power of two), and those that a form's hash sets.
DIM, PLACES = 128, 6
#: Words with a context vector: the commonest of what is learned from.  All others have their index vector alone.
VOCABULARY = 16_384
#: Neighbours on either side that make a word's context.
WINDOW = 2
#: Labelled rows to learn from, about; a hash of the id chooses them.
TRAIN_ROWS = 20_000
#: Units of the first layer, passes over the rows, rows of a step, its length, and the pull of weights to 0.
HIDDEN, EPOCHS, STEP_ROWS, RATE, DECAY = 32, 40, 128, 2e-3, 1e-4
#: One row in so many is kept from the network, for the temperature.
KEPT = 5
#: Words worked on at once, and words whose vectors a task remembers.
STEP, REMEMBERED = 20_000, 65_536
#: Fixed value: a run of other characters than the six ASCII white-space characters; a longer one counts as several words.
_WORD = re.compile(r"[^\x20\x09-\x0D]{1,256}")
#: What a document's row holds besides the mean vector.
EXTRAS = 3


def words(text: str | None) -> Iterator[list[str]]:
    """The words of a text in order, at most STEP at a time."""
    if len(text or "") <= 2 * STEP:
        if found := _WORD.findall(text or ""):
            yield found
        return
    found = _WORD.finditer(text)
    while held := [m.group() for m in itertools.islice(found, STEP)]:
        yield held


def _slices(texts: Iterable[str | None]) -> Iterator[tuple[list[str], np.ndarray, bool]]:
    """Words of several texts, how many each has, and whether the first of them goes on from the slice before."""
    held: list[str] = []
    sizes: list[int] = []
    goes_on = False
    for text in texts:
        sizes.append(0)
        for some in words(text):
            if held and len(held) + len(some) > STEP:
                ends = sizes[-1] > 0
                yield held, np.array(sizes if ends else sizes[:-1]), goes_on
                held, sizes, goes_on = [], [0], ends
            held += some
            sizes[-1] += len(some)
    if sizes:
        yield held, np.array(sizes), goes_on


def index_vectors(them: list[str]) -> np.ndarray:
    """The index vector of each word, none of them empty: whole numbers, DIM to a row."""
    codes = np.frombuffer("".join(f"\2\2{w}\3" for w in them).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, them), np.int64, len(them))
    word = np.repeat(np.arange(len(them)), size + 1)
    ends = np.cumsum(size + 3)
    start = np.repeat(ends - size - 3, size + 1)
    at = start + np.arange(len(word)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    form = codes[at] + codes[at + 1] * np.uint64(0x1F123BB5) + codes[at + 2] * np.uint64(0x27D4EB2F165667C5)
    place = (at - start).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    whole = np.add.reduceat(_mixed(form * place), np.cumsum(size + 1) - size - 1)
    form, word = np.concatenate([_mixed(form), _mixed(whole)]), np.concatenate([word, np.arange(len(them))])
    to = np.empty((PLACES, len(form)), np.int64)
    sign = np.empty((PLACES, len(form)))
    base = word * DIM
    for k in range(PLACES):
        to[k] = base + ((form >> np.uint64(7 * k)) & np.uint64(DIM - 1)).view(np.int64)
        sign[k] = 1.0 - 2.0 * ((form >> np.uint64(63 - k)) & np.uint64(1))
    return np.bincount(to.ravel(), sign.ravel(), len(them) * DIM).reshape(-1, DIM).astype(np.int32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64 if rows.dtype == np.float64 else np.float32)
    rows /= np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows)), 1e-12)[:, None]
    return rows.astype(np.float32, copy=False)


@dataclass
class Reader:
    """Turns texts into rows; remembers the vectors of words it has met.

    When it remembers too many, those that have come again since they were first met stay, if they are
    few enough: most words of a large text come once.
    """

    contexts: dict[str, np.ndarray]
    _row: dict[str, int] = field(default_factory=dict)
    _vectors: np.ndarray = field(default_factory=lambda: np.zeros((REMEMBERED + STEP, DIM), np.float32))
    _again: np.ndarray = field(default_factory=lambda: np.zeros(REMEMBERED + STEP, bool))

    def places(self, them: list[str]) -> np.ndarray:
        """Where each word's vector is kept: the unit vector of its index vector, and of its context's where it has one."""
        if len(self._row) > REMEMBERED:
            self._forget()
        at = np.fromiter(map(self._row.get, them, itertools.repeat(-1)), np.int64, len(them))
        self._again[at[at >= 0]] = True
        unmet = np.flatnonzero(at < 0)
        if len(unmet):
            first = len(self._row)
            met = [them[i] for i in unmet.tolist()]
            new = list(dict.fromkeys(met))
            made = _unit(index_vectors(new))
            known = [(i, context) for i, context in enumerate(map(self.contexts.get, new)) if context is not None]
            if known:
                which, context = zip(*known, strict=True)
                made[list(which)] = _unit(made[list(which)] + np.stack(context))
            self._row.update(zip(new, range(first, first + len(new)), strict=True))
            self._vectors[first : first + len(new)] = made
            self._again[first : first + len(new)] = False
            at[unmet] = np.fromiter(map(self._row.__getitem__, met), np.int64, len(met))
        return at

    def _forget(self) -> None:
        stay = np.flatnonzero(self._again[: len(self._row)])  # words are in order of their places
        if len(stay) > REMEMBERED // 2:
            stay = stay[:0]
        self._row = dict(zip(map(list(self._row).__getitem__, stay.tolist()), range(len(stay)), strict=True))
        self._vectors[: len(stay)] = self._vectors[stay]
        self._again[: len(stay)] = False

    def vectors(self, them: list[str]) -> np.ndarray:
        """A word's unit vector, one row each."""
        return self._vectors[self.places(them)]

    def rows(self, texts: Iterable[str | None]) -> np.ndarray:
        """For each text the mean of its words' vectors, that mean's length, the mean likeness of neighbours, and the logarithm of the number of words."""
        total, near, n = [], [], []
        for some, sizes, goes_on in _slices(texts):
            v = self.vectors(some) if some else np.zeros((1, DIM), np.float32)
            ends = np.cumsum(sizes)
            upto = np.concatenate([[0.0], np.cumsum(np.einsum("ij,ij->i", v[1:], v[:-1]), dtype=np.float64), [0.0]])
            sums = np.zeros((len(sizes), DIM))
            for i in np.flatnonzero(sizes).tolist():
                sums[i] = np.add.reduce(v[ends[i] - sizes[i] : ends[i]], axis=0)
            alike = np.where(sizes > 1, upto[np.maximum(ends - 1, 0)] - upto[np.minimum(ends - sizes, len(v) - 1)], 0.0)
            if goes_on:
                total[-1] += sums[0]
                near[-1] += alike[0] + float(last @ v[0])
                n[-1] += sizes[0]
            total += list(sums[goes_on:])
            near += list(alike[goes_on:])
            n += list(sizes[goes_on:])
            last = v[-1]
        n = np.array(n, np.int64)
        mean = np.array(total).reshape(-1, DIM) / np.maximum(n, 1)[:, None]
        return np.c_[mean, np.linalg.norm(mean, axis=1), np.array(near) / np.maximum(n - 1, 1), np.log1p(n)].astype(np.float32)


@dataclass
class Model:
    """What scoring needs: at most VOCABULARY contexts, what rows are scaled by, two layers and the temperature."""

    contexts: dict[str, np.ndarray]
    centre: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.centre) / self.spread, -8, 8)
        return np.tanh(x @ self.layers[0] + self.layers[1]) @ self.layers[2] + self.layers[3]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return _odds(self.logits(rows) / self.temperature)


def _odds(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fitted(contexts: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, n: np.ndarray, seed: int = 11) -> Model:
    """Fit the layers by Adam steps over rows that come n times each, then the temperature on the rows kept apart."""
    apart = np.fromiter((zlib.crc32(row.tobytes()) % KEPT == 0 for row in x), bool, len(x))
    if len(set(y[apart].tolist())) < 2 or len(set(y[~apart].tolist())) < 2:
        apart[:] = False
    fit = np.flatnonzero(~apart)
    share = n[fit] / n[fit].sum()
    centre = share @ x[fit]
    spread = np.sqrt(share @ (x[fit] - centre) ** 2) + 1e-6
    draw = np.random.default_rng(seed)
    p = [draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    model = Model(contexts, centre, spread, p)
    z = np.clip((x - centre) / spread, -8, 8)
    first, second, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    mean_n = n[fit].mean()
    for _ in range(EPOCHS):
        order = draw.permutation(fit)
        for rows in (order[at : at + STEP_ROWS] for at in range(0, len(order), STEP_ROWS)):
            step += 1
            hidden = np.tanh(z[rows] @ p[0] + p[1])
            off = (_odds(hidden @ p[2] + p[3]) - y[rows]) * n[rows] / (mean_n * len(rows))
            back = off[:, None] * p[2] * (1 - hidden**2)
            grads = [z[rows].T @ back + DECAY * p[0], back.sum(0), hidden.T @ off + DECAY * p[2], off.sum(keepdims=True)]
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] -= RATE * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    if apart.any():
        model.temperature = _temperature(model.logits(x[apart]), y[apart], n[apart])
    return model


def _temperature(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """The divisor of logits, 1/8 to 8, that makes the labels likeliest; the loss has one valley, which golden sections close in on."""
    loss = lambda t: float(n @ (np.logaddexp(0, z * np.exp(-t)) - y * z * np.exp(-t)))
    low, high, part = -np.log(8), np.log(8), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _counted(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in them:
        n = Counter(w for text in batch.column("text").to_pylist() for some in words(text) for w in some)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])


def _contexts(learn: DataFrame, vocabulary: int) -> dict[str, np.ndarray]:
    """The context vectors, of unit length, of the commonest words of ``learn``; at most ``vocabulary`` rows come back."""
    common = learn.select("text").mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    known = [r["word"] for r in common.where("n > 1").orderBy(F.desc("n"), "word").limit(vocabulary).collect()]
    shared = learn.sparkSession.sparkContext.broadcast(known)

    def summed(rows: np.ndarray, at: np.ndarray, into: np.ndarray) -> None:
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
        into[at[order[first]]] += np.add.reduceat(rows[order], first, axis=0)

    def sums(into: np.ndarray) -> pa.RecordBatch:
        met = np.flatnonzero(into.any(1))
        return pa.RecordBatch.from_arrays([pa.array(met), pa.array(list(into[met]), pa.list_(pa.int64()))], names=["word", "sums"])

    def neighbours(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(shared.value)}
        into = np.zeros((len(number), DIM), np.int64)
        for batch in them:
            for text in batch.column("text").to_pylist():
                for some in words(text):
                    distinct = {w: i for i, w in enumerate(dict.fromkeys(some))}
                    index = index_vectors(list(distinct))[np.fromiter(map(distinct.__getitem__, some), np.int64, len(some))]
                    at = np.fromiter((number.get(w, -1) for w in some), np.int64, len(some))
                    around = np.zeros(index.shape, np.int32)
                    for k in range(1, min(WINDOW, len(some) - 1) + 1):
                        around[k:] += np.roll(index[:-k], -k, axis=1)
                        around[:-k] += np.roll(index[k:], k, axis=1)
                    if (at >= 0).any():
                        summed(around[at >= 0], at[at >= 0], into)
        if into.any():
            yield sums(into)

    def added(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = np.zeros((len(shared.value), DIM), np.int64)
        for batch in them:
            if batch.num_rows:
                summed(np.stack(batch.column("sums").to_numpy(zero_copy_only=False)), batch.column("word").to_numpy(), into)
        if into.any():
            yield sums(into)

    if not known:
        return {}
    kind = "word long, sums array<long>"
    got = learn.select("text").mapInArrow(neighbours, kind).repartition(8, "word").mapInArrow(added, kind).toArrow()
    if not got.num_rows:
        return {}
    unit = _unit(np.stack(got.column("sums").to_numpy()).astype(np.float64))
    return {known[i]: v for i, v in zip(got.column("word").to_pylist(), unit, strict=True)}


def train(
    docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, vocabulary: int = VOCABULARY
) -> Model | float:
    """Learn from about ``rows`` labelled rows at most, whole texts.

    Where a class is missing there is nothing to tell apart, and what comes back is the share of
    label 1 with one row of either class added.  Labels that are null, or stand at a null id, are
    no labels; of several for one id the smallest counts.  Rows are chosen by id, where ids repeat
    in the documents by text too.  Rows that repeat id and text count once, whatever their number,
    and equal rows of vectors are summed before they leave Spark.
    """
    named = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    named = written(sampled(named, "id", rows, 11), "labelled")
    learn = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(named), "id")  # about ``rows`` ids at most
    learn = learn.withColumn("hash", F.xxhash64("text"))
    n = learn.select("id", "hash").distinct().count()
    if n > 2 * rows:
        learn = learn.where(F.pmod(F.xxhash64("id", "hash"), F.lit(1 << 30)) < int((1 << 30) * rows / n))
    learn = learn.groupBy("id", "hash").agg(F.any_value("label").alias("label"), F.any_value("text").alias("text"))
    learn = written(learn.repartition(16, "hash"), "learn")  # some thousand texts each
    contexts = _contexts(learn, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(contexts)

    def pooled(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in them:
            made = reader.rows(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(made), pa.list_(pa.float32()))], names=["label", "row"])

    got = learn.select("label", "text").mapInArrow(pooled, "label int, row array<float>").groupBy("label", "row").agg(F.count("*").alias("n")).toArrow()
    y = np.array([float(v == 1) for v in got.column("label").to_pylist()])
    times = np.array(got.column("n").to_pylist(), float)
    if len(set(y.tolist())) < 2:
        return float((times @ y + 1) / (times.sum() + 2)) if len(y) else 0.5
    x = np.stack(got.column("row").to_numpy()).astype(float)
    order = np.lexsort([*x.T[:8], y])  # rows come in any order; steps shall not
    return fitted(contexts, x[order], y[order], times[order])


def score(docs: DataFrame, model: Model | float, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1), one row per document, from its whole text; null is as empty, and empty texts have a score like others.

    Rows that repeat come as often as they are there; other columns are not read.  Where a class
    was missing, all have the one score that ``train`` gave.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if isinstance(model, float):
        return narrow.select("doc_id", F.lit(model).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # VOCABULARY rows of DIM numbers at most, 8 MB

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value.contexts)
        for batch in them:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                found = shared.value.scores(reader.rows(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return narrow.mapInArrow(lambda it: trimmed(batches(it)), f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, score double")


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels of documents that aren't held out, and score all."""
    learn = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    out = score(docs, train(docs, learn))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
