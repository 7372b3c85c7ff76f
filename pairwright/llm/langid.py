"""Language identification by bit-sliced Bloom filters of character n-grams.

Every slot of one table holds a mask with a bit per language, so that a single look-up
answers for all languages at once: the masks at an n-gram's slots are and-ed, and the bits
left name the languages whose filters hold it.  A text's n-grams are counted by language,
the filters' false positives are taken off, and the language that is best covered wins.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairwright.llm.scratch import trimmed

ORDERS = (1, 2, 3, 4)
#: Slots read for each n-gram, and slots for each n-gram that the fullest filter holds.
PROBES, ROOM = 3, 16
#: An n-gram is a language's if it makes up this share of its n-grams of that order (so a filter
#: holds at most 1 / LEAST of them), and this share of the rate it has where it is commonest.
LEAST, OF_MOST = 1e-5, 0.34
#: Labelled rows to learn from, about; a hash of the id chooses them.
TRAIN_ROWS = 20_000
#: Code points worked on at once.
STEP = 200_000
#: Rows whose texts are Python strings at a time.
ROWS = 500
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


def _grams(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order, the hashes of all n-grams and the number of the text each stands in.

    Letters in lower case, one space for whatever lies between words, and one at either end.
    """
    codes = np.frombuffer("\0".join(["", *texts, ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = codes[: len(codes)]
    gap = ~_letters()[codes]
    ends = codes == 0
    keep = ~gap | ends
    keep[1:] |= ~gap[:-1]  # the first of a run of gaps stays, as a space
    text = np.cumsum(ends)[keep] - 1
    codes = np.where(gap, np.uint32(32), codes)[keep].astype(np.uint64)
    run = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            return
        run = run[:m] * np.uint64(0x1F123BB5) + codes[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            inside = (text[:m] == text[n - 1 :]) if n > 1 else codes != 32
            yield n, _mix(run[inside]), text[:m][inside]


def _slices(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Whole texts in groups of about STEP code points; a longer one in parts."""
    rows: list[int] = []
    parts: list[str] = []
    held = 0
    for row, text in enumerate(texts):
        text = (text or "").replace("\0", " ")
        for at in range(0, len(text), STEP):
            part = text[at : at + STEP]
            if held + len(part) > STEP and rows:
                yield rows, parts
                rows, parts, held = [], [], 0
            rows.append(row)
            parts.append(part)
            held += len(part)
    if rows:
        yield rows, parts


@dataclass
class Model:
    """languages[i] has bit i % 8 of tables[i // 8]; rates of false positives; the mean share of its own n-grams that it covers."""

    languages: list[str]
    tables: np.ndarray
    false: np.ndarray
    cover: np.ndarray

    @classmethod
    def of(cls, languages: list[str], grams: list[np.ndarray]) -> Model:
        most = max((len(g) for g in grams), default=0)
        size = 1 << max(10, (ROOM * most).bit_length())
        tables = np.zeros((-(-len(languages) // 8), size), np.uint8)
        for i, g in enumerate(grams):
            for slot in _slots(g, size):
                np.bitwise_or.at(tables[i // 8], slot, np.uint8(1 << i % 8))
        false = np.array([np.mean((tables[i // 8] >> np.uint8(i % 8)) & 1) ** PROBES for i in range(len(languages))])
        return cls(languages, tables, false, np.ones(len(languages)))

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of each text, and how many of them each language's filter holds, false positives taken off."""
        n = np.zeros(len(texts), np.int64)
        held = np.zeros((len(texts), len(self.languages)))
        bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
        for rows, parts in _slices(texts):
            masks = np.zeros((len(self.tables), len(parts), 256), np.int64)
            for _, grams, of in _grams(parts):
                for byte, table in enumerate(self.tables):
                    found = np.uint8(255)
                    for slot in _slots(grams, len(table)):
                        found = found & table[slot]
                    masks[byte] += np.bincount(of * 256 + found, minlength=len(parts) * 256).reshape(-1, 256)
            total = masks[0].sum(1)
            by = np.concatenate([m @ bits for m in masks], 1)[:, : len(self.languages)]
            np.add.at(n, rows, total)
            np.add.at(held, rows, np.maximum(by - total[:, None] * self.false, 0) / (1 - self.false))
        return n, held

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        return self.judged(texts)[:2]

    def judged(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and how much of a text is covered: the best language's share of its n-grams, over the share that it has of its own texts."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        n, held = self.counts(texts)
        share = held / np.maximum(n, 1)[:, None] / self.cover
        best = share.argmax(1)
        score = share.max(1) / np.maximum(share.sum(1), 1e-12)
        letters = n > 0
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], np.where(letters, np.clip(score, 0, 1), 0.0), share.max(1)


def _slots(grams: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """PROBES slots for each hash, by double hashing."""
    step = (grams >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        yield ((grams + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64)


def sampled(rows: DataFrame, id_col: str, about: int, salt: int) -> DataFrame:
    """About ``about`` of the rows, chosen by a hash of their id: the bound of what is learned from.

    Rows of one id share a fate, so what is learned from them must not grow with their repeats:
    callers sum equal rows up before anything leaves Spark.
    """
    n = rows.count()
    if n <= about:
        return rows
    return rows.where(F.pmod(F.xxhash64(id_col, F.lit(salt)), F.lit(1 << 30)) < int((1 << 30) * about / n))


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> Model:
    """Learn from the rows with a text and a language: at most about ``rows`` of them, whole texts."""
    labelled = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    labelled = sampled(labelled, "id", rows, 10)

    def counted(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            langs, texts = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                for _, parts in _slices([t for t, x in zip(texts, langs, strict=True) if x == lang]):
                    for order, grams, _ in _grams(parts):
                        gram, n = np.unique(grams, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array([order] * len(gram), pa.int32()), pa.array(gram.view(np.int64)), pa.array(n)], names=["lang", "n", "gram", "count"])

    grams = labelled.mapInArrow(counted, "lang string, n int, gram long, count long").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))
    totals = grams.groupBy("lang", "n").agg(F.sum("count").alias("total"))
    grams = grams.join(totals, ["lang", "n"]).withColumn("rate", F.col("count") / F.col("total")).where(F.col("rate") >= LEAST)
    own = grams.withColumn("most", F.max("rate").over(Window.partitionBy("n", "gram"))).where(F.col("rate") >= OF_MOST * F.col("most"))
    found = own.select("lang", "gram", "rate").toArrow()
    lang, gram = found.column("lang").to_numpy(zero_copy_only=False), found.column("gram").to_numpy().view(np.uint64)
    rates = found.column("rate").to_numpy()
    languages = sorted(set(lang.tolist()))
    model = Model.of(languages, [np.unique(gram[lang == x]) for x in languages])
    model.cover = np.array([rates[lang == x].sum() / len(ORDERS) for x in languages]).clip(0.01)
    return model


def held_out(id_col: str, parts: int, rest: int) -> Column:
    """True where crc32 of the id as text leaves ``rest``; a null id is never held out, nor learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == rest, F.lit(False))


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score, one row per document, from its whole text.

    ``und`` with score 0 for a null text or one without letters, or where nothing was learned.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lang, score = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return narrow.mapInArrow(lambda it: trimmed(batches(it)), f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def with_language(docs: DataFrame, model: Model, *, text_col: str = "text", as_col: str = "lang_found") -> DataFrame:
    """The documents, all columns kept, with a struct of the language found, its score, and how much of the text it covers."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            lang, score, covered = [], [], []
            for at in range(0, len(batch), ROWS):
                some = shared.value.judged(batch.slice(at, ROWS).to_pylist())
                lang += some[0]
                score += some[1].tolist()
                covered += some[2].tolist()
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(covered, pa.float64())], names=["lang_pred", "score", "covered"])

    from pyspark.sql.functions import arrow_udf
    from pyspark.sql.pandas.functions import ArrowUDFType

    return docs.withColumn(as_col, arrow_udf(lambda it: trimmed(found(it)), "lang_pred string, score double, covered double", ArrowUDFType.SCALAR_ITER)(F.col(text_col)))


def language_query(docs: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Learn from the documents that aren't held out, and predict the language of all."""
    learn = docs.where(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2)
    out = identify(docs, train(learn, id_col=id_col), id_col=id_col)
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
