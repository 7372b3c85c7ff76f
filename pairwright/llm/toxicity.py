"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

Two words are alike if they share three-letter subsequences, gaps allowed and paid for;
so ``idiot``, ``id-i0t`` and ``idxiot`` stay close.  Words are taken by their letters, and
long ones in parts; the kernel of two words is the sum over both sides' parts of a power of
that likeness, the kernel of a sentence with a landmark the sum over its words.  Landmarks
are words of one part that mark the labelled documents; the kernel among them, symmetric and
not negative, turns kernel rows into Nyström coordinates, on which a linear machine is
trained by sentences.  A document scores as its worst sentence.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.langid import held_out, sampled
from pairwright.llm.scratch import written

#: Labelled rows to learn from, about; a hash of the id chooses them.
TRAIN_ROWS = 20_000
#: Landmarks, at most.
LANDMARKS = 64
#: Of words more alike than this, one is a landmark.
ALIKE = 0.8
#: The decay of each letter that a subsequence spans, and how many it may span.
DECAY, SPAN = 0.6, 6
#: Likenesses count to this power; in a sentence's row those below the bound are rounded to zero.
POWER, LEAST = 4, 0.4
#: Landmarks are words, or beginnings of words, of at most so many letters.
LONGEST = 8
#: Words of at most so many letters, the start of the word counted, are a part as a whole;
#: those longer than a landmark are also cut into overlapping windows of so many letters, so many apart.
WHOLE, WINDOW, APART = 16, 8, 3
#: Words whose likenesses a worker remembers.
REMEMBERED = 300_000

#: Gap patterns: the second and third letter's places after the first.
_GAPS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]

#: A letter's number, from its byte: letters without case, digits and signs that stand for letters
#: as those letters, other bytes above 127 by themselves; 0 for bytes that are skipped.
_CODE = np.zeros(256, np.int32)
for _n, _c in enumerate("abcdefghijklmnopqrstuvwxyz", 1):
    _CODE[ord(_c)] = _CODE[ord(_c.upper())] = _n
for _c, _of in zip("013457@$!", "oieastasi", strict=True):
    _CODE[ord(_c)] = _CODE[ord(_of)]
_CODE[128:] = 27 + np.arange(128) % 36
#: Stands before each word, as a letter: where a word begins tells too.
_START = b"\x01"
_CODE[1] = 63
#: Signs at either end of a word are no letters.
_SIGNS = b"!$@.,;:?*&%#|-_'\"()[]{}<>+=/\\"

#: Bytes that are skipped; words that hold such are also cut without them.
_SKIPPED = bytes(np.flatnonzero(_CODE == 0).tolist())

_SPELLED = re.compile(rb"(?<![^\x20\x09-\x0D])[A-Za-z0-9@$!](?:[\x20._*-]{1,2}[A-Za-z0-9@$!]){2,}(?![^\x20\x09-\x0D])")
_ENDS = (b".", b"!", b"?")


def _features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subsequences of three letters: the word's number, the letters as one number, and the weight."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = _CODE[np.frombuffer(b"".join(words), np.uint8)]
    of = np.repeat(np.arange(len(words)), lengths)
    keep = codes > 0
    codes, of = codes[keep], of[keep]
    word, gram, weight = [], [], []
    for i, j in _GAPS:
        m = len(codes) - j
        if m <= 0:
            continue
        at = np.flatnonzero(of[:m] == of[j:])
        word.append(of[at])
        gram.append((codes[at] << 12) | (codes[at + i] << 6) | codes[at + j])
        weight.append(np.full(len(at), DECAY ** (j + 1), np.float32))
    if not word:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32)
    return np.concatenate(word), np.concatenate(gram), np.concatenate(weight)


def _parts(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The parts of words, by their letters alone (signs left out), and the word that each is of."""
    parts, of = [], []
    for n, w in enumerate(words):
        w = w.translate(None, _SKIPPED)
        if len(w) <= WHOLE:
            parts.append(w)
            of.append(n)
        if len(w) > LONGEST + 1:
            cut = [w[at : at + WINDOW] for at in range(0, len(w) - WINDOW + APART, APART)]
            parts += cut
            of += [n] * len(cut)
    return parts, np.array(of, np.int64)


#: The squared norm of the fewest letters that a window has, without repeats; the last of a word is the shortest.
_WINDOW_NORM2 = sum(DECAY ** (2 * (j + 1)) * max(WINDOW - APART + 1 - j, 0) for _, j in _GAPS)


def _unit(n: int, word: np.ndarray, gram: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features summed by word and subsequence, scaled so that a word's likeness to itself is 1."""
    key, at = np.unique((word.astype(np.int64) << 18) | gram, return_inverse=True)
    total = np.bincount(at, weight, len(key))
    word = key >> 18
    norm = np.sqrt(np.bincount(word, total * total, n))
    return word, (key & 0x3FFFF).astype(np.int64), total / norm[word]


def _landmark_table(landmarks: list[bytes]) -> np.ndarray:
    """Unit features of the landmarks: rows are subsequences, columns landmarks."""
    word, gram, value = _unit(len(landmarks), *_features([_START + w for w in landmarks]))
    table = np.zeros((1 << 18, len(landmarks)), np.float32)
    table[gram, word] = value
    return table


@dataclass
class Kernel:
    """Likenesses of words to landmarks."""

    landmarks: list[bytes]

    def __post_init__(self) -> None:
        table = _landmark_table(self.landmarks)
        self.most = table.max(1)
        # Few subsequences are in any landmark: rows for those alone, and each one's row.
        held = np.flatnonzero(self.most)
        self.row = np.zeros(len(table), np.int32)
        self.row[held] = np.arange(len(held))
        self.table = table[held]
        self.row_most = self.most[held]

    def bound(self, word: np.ndarray, gram: np.ndarray, weight: np.ndarray, norm2: np.ndarray) -> np.ndarray:
        """No likeness exceeds this: repeated subsequences only make a word's norm larger."""
        return np.bincount(word, weight * self.most[gram], len(norm2)) / np.sqrt(np.maximum(norm2, 1e-12))

    def matrix(self) -> np.ndarray:
        """The kernel among the landmarks, each of one part: products of unit vectors to a whole power."""
        return (self.table.T.astype(float) @ self.table) ** POWER

    def likeness(self, words: list[bytes]) -> np.ndarray:
        """A row per word: the sum over its parts of the normalised kernel with each landmark to the power."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        whole = [(_START + w.strip(_SIGNS)).translate(None, _SKIPPED) for w in words]
        for at in range(0, len(whole), 20_000):
            # No part has more in common with a landmark than its word, nor less of a norm than the word or the shortest window.
            some = whole[at : at + 20_000]
            word, gram, weight = _features(some)
            norm2 = np.bincount(word, weight * weight, len(some))
            cut = np.fromiter(map(len, some), np.int64, len(some)) > LONGEST + 1
            norm2[cut] = np.minimum(norm2[cut], _WINDOW_NORM2)
            may = np.flatnonzero(self.bound(word, gram, weight, norm2) >= LEAST * (1 - 1e-5)) + at
            if len(may):
                self._compare([whole[i] for i in may.tolist()], may, out)
        return out

    def _compare(self, words: list[bytes], of_word: np.ndarray, out: np.ndarray) -> None:
        parts, of = _parts(words)
        word, gram, weight = _features(parts)
        may = self.bound(word, gram, weight, np.bincount(word, weight * weight, len(parts))) >= LEAST * (1 - 1e-5)
        if not may.any():
            return
        inside = may[word]
        number = np.cumsum(may) - 1
        w, g, v = _unit(int(may.sum()), number[word[inside]], gram[inside], weight[inside])
        held = self.most[g] > 0
        w, g, v = w[held], self.row[g[held]], v[held].astype(np.float32)
        # The bound again, now that exact norms are known.
        tight = np.bincount(w, v * self.row_most[g], int(may.sum())) >= LEAST * (1 - 1e-5)
        w, g, v = (x[tight[w]] for x in (w, g, v))
        if not len(w):
            return
        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        near = np.add.reduceat(self.table[g] * v[:, None], first, axis=0)
        near = np.where(near >= LEAST, near, 0) ** POWER
        hit = near.any(1)
        np.add.at(out, of_word[of[may][w[first[hit]]]], near[hit])


class Reader:
    """Kernel sums of a text's sentences; remembers words that it has seen."""

    def __init__(self, kernel: Kernel) -> None:
        self.kernel = kernel
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.rows = [np.zeros(len(self.kernel.landmarks), np.float32)]

    def learn(self, words: set[bytes]) -> None:
        new = sorted(words.difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.forget()
            new = sorted(words)
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            near = self.kernel.likeness(some)
            for word, hit, row in zip(some, near.any(1).tolist(), near, strict=True):
                self.known[word] = 2 * len(self.rows) * hit + word.endswith(_ENDS)
                if hit:
                    self.rows.append(row.copy())

    def sentences(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """For each text, the kernel rows of its sentences that are near any landmark at all."""
        tokens = []
        for text in texts:
            data, at, words = (text or "").encode("utf-8", "surrogatepass"), 0, []
            for m in _SPELLED.finditer(data):  # a spelled word stands before its letters, in their sentence
                words += data[at : m.start()].split()
                words.append(re.sub(rb"[\x20._*-]", b"", m[0]))
                at = m.start()
            words += data[at:].split()
            tokens.append(words)
        self.learn(set().union(*tokens))
        for words in tokens:
            found = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            at = np.flatnonzero(found > 1)
            if not len(at):
                yield np.zeros((0, len(self.kernel.landmarks)), np.float32)
                continue
            sentence = np.cumsum(found & 1) - (found & 1)
            first = np.flatnonzero(np.r_[True, np.diff(sentence[at]) != 0])
            yield np.add.reduceat(np.stack([self.rows[k] for k in found[at] >> 1]), first, axis=0)


@dataclass
class Model:
    """Nyström coordinates of a kernel row are ``row @ root``; the score is a logistic of the worst sentence's margin."""

    kernel: Kernel
    root: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, rows: np.ndarray) -> np.ndarray:
        return rows @ self.root @ self.weight + self.bias

    def scores(self, texts: list[str | None], reader: Reader) -> list[float]:
        margins = np.array([max([self.bias, *self.margins(rows)]) for rows in reader.sentences(texts)])
        return (1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))).tolist()


def _root(kernel: Kernel) -> np.ndarray:
    """The inverse square root of the kernel among the landmarks, a ridge added."""
    values, vectors = np.linalg.eigh(kernel.matrix() + 1e-3 * np.eye(len(kernel.landmarks)))
    return (vectors / np.sqrt(values)) @ vectors.T


def machine(x: np.ndarray, y: np.ndarray, n: np.ndarray, cost: float = 1.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss by Newton steps; row i comes n[i] times."""
    z = np.c_[x, np.ones(len(x))]
    sign = np.where(y > 0, 1.0, -1.0)
    c = cost * n
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        inside = sign * (z @ w) < 1
        a, t = z[inside], c[inside]
        new = np.linalg.solve(ridge + (a * t[:, None]).T @ a, (a * (t * sign[inside])[:, None]).sum(0))
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def logistic(margin: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift that turn margins into probabilities; smoothed targets keep them finite."""
    n1, n0 = n[y > 0].sum(), n[y <= 0].sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = np.c_[margin, np.ones(len(margin))]
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (n * (p - t)) + 1e-3 * w
        step = np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), grad)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _landmarks(rows: DataFrame) -> list[bytes]:
    """Words and beginnings of words that tell toxic documents apart; a bounded number comes back.

    A word counts if its share among toxic documents can't be chance, all words considered;
    one much like a better one is left out.
    """
    bare = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{Nd}@$!\x20\x09-\x0D]|[@$!]+(?![\p{L}\p{Nd}])", "")
    words = F.array_distinct(F.filter(F.split(bare, r"[\x20\x09-\x0D]+"), lambda w: F.length(w) >= 4))
    begun = lambda w: F.transform(F.sequence(F.lit(4), F.least(F.length(w), F.lit(LONGEST))), lambda k: F.left(w, k))
    word = rows.select("toxic", F.explode(F.array_distinct(F.flatten(F.transform(words, begun)))).alias("word"))
    n = rows.agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")).first()
    if not n["t"] or not n["c"]:
        return []
    by = word.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")).where("t + c >= 3")
    by = written(by, "words")
    ratio_t = F.col("t") / (F.col("t") + F.col("c")) * ((n["t"] + n["c"]) / n["t"])
    ratio_c = F.col("c") / (F.col("t") + F.col("c")) * ((n["t"] + n["c"]) / n["c"])
    tells = F.col("t") * F.log(ratio_t) + F.when(F.col("c") > 0, F.col("c") * F.log(ratio_c)).otherwise(0.0)
    marks = by.where(ratio_t > 2).withColumn("tells", tells).where(F.col("tells") > math.log(by.count() + 1) + 1)
    marks = marks.orderBy(F.desc("tells"), F.desc(F.length("word")), "word").limit(16 * LANDMARKS).collect()
    found = [w for r in marks if len(w := r["word"].encode().translate(None, _SKIPPED)) <= LONGEST and len(_features([_START + w])[0])]
    if not found:
        return []
    table = _landmark_table(found)
    alike = table.T @ table
    chosen: list[int] = []
    for i in range(len(found)):
        if len(chosen) < LANDMARKS and all(alike[i, j] < ALIKE for j in chosen):
            chosen.append(i)
    return [found[i] for i in chosen]


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model | None:
    """Learn from about ``rows`` labelled rows at most, whole texts; None where a class is missing.

    Each document gives the sentence nearest to the landmarks, under its document's label.
    Rows are chosen by id and text, and equal kernel rows are summed up before they leave
    Spark, so neither repeated ids nor repeated rows let what comes back grow.
    """
    labelled = sampled(labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), "toxic"), "id", rows, 2)
    learn = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(labelled, "id")
    # Ids may repeat in the documents: then the rows are chosen once more, by their texts too.
    n = docs.select(F.col(id_col).alias("id")).join(labelled, "id").count()
    if n > 2 * rows:
        learn = learn.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < int((1 << 30) * rows / n))
    landmarks = _landmarks(learn)
    if not landmarks:
        return None
    kernel = Kernel(landmarks)

    def nearest(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(kernel)
        for batch in them:
            rows = [max(s, key=lambda r: r.sum(), default=reader.rows[0]) for s in reader.sentences(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tolist() for r in rows], pa.list_(pa.float32()))], names=["toxic", "row"])

    got = learn.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(nearest, "toxic int, row array<float>").groupBy("toxic", "row").agg(F.count("*").alias("n")).toArrow()
    y = got.column("toxic").to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    x = np.stack(got.column("row").to_numpy(zero_copy_only=False)).astype(float)
    order = np.lexsort([*x.T, y])  # rows come in any order; sums shall not
    x, y, times = x[order], y[order], got.column("n").to_numpy()[order].astype(float)
    root = _root(kernel)
    weight, bias = machine(x @ root, y, times)
    margin = np.maximum(x @ root @ weight + bias, bias)
    return Model(kernel, root, weight, bias, *logistic(margin, y, times))


def score(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1), one row per document, from its whole text; null is as empty.  Without a model all score 0."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return narrow.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((model.kernel.landmarks, model.root, model.weight, model.bias, model.slope, model.shift))

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        landmarks, *rest = shared.value
        mine = Model(Kernel(landmarks), *rest)
        reader = Reader(mine.kernel)
        for batch in them:
            out: list[float] = []
            for at in range(0, batch.num_rows, 256):
                out += mine.scores(batch.column(1).slice(at, 256).to_pylist(), reader)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return narrow.mapInArrow(batches, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels of documents that aren't held out, and score all."""
    learn = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    out = score(docs, train(docs, learn))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
