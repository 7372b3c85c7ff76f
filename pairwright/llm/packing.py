"""Best-fit packing of token sequences by swap-based local search.

Documents are tokenized where they lie; only their pieces' lengths travel.  Pieces are
dealt at random into chunks of bounded size, and each chunk is packed in one task: best
fit by falling length first, then single pieces and pairs are exchanged or moved between
bins that are not full, each step raising the sum of squared fills, until bins run empty.
What still lies in loose bins is dealt out and packed once more.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.scratch import trimmed, written

#: Pieces in a chunk, on average.
CHUNK = 4096
#: Bins filled less than this share are packed again.
LOOSE = 0.98
#: Two-for-one exchanges look for their pair in so many of the emptiest bins; these are the ones that can run empty.
PARTNERS = 32
#: Partitions at most; beyond it each holds several chunks.
PARTITIONS = 8192
#: Beyond this range the two libraries' regular expressions might differ; such texts take the slower one.
_PLAIN = re.compile("[^\x00-ɏ]")


@functools.lru_cache(maxsize=1)
def _described(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def vocabulary(path: str) -> dict[bytes, int]:
    """The bytes of each token that isn't special, with its id; the file writes each byte as a printable character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
    special = set(specials(path))
    return {bytes(map(byte_of.__getitem__, token)): n for token, n in _described(path)["model"]["vocab"].items() if token not in special}


def specials(path: str) -> list[str]:
    return [token["content"] for token in _described(path)["added_tokens"] if token["special"]]


@functools.lru_cache(maxsize=4)
def encoder(path: str, special: bool = False):
    """A function from text to ids, as ``tokenizers`` gives them with ``add_special_tokens=False``.

    With ``special`` the string of a special token in a text is that token, as in a plain call;
    without, it is ordinary text (``encode_special_tokens``).  tiktoken reads the same vocabulary
    four times as fast; its ids are the same, which the tests hold against ``tokenizers``.  Texts
    beyond Latin letters, or with a special token, take ``tokenizers`` itself.
    """
    import tiktoken

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=vocabulary(path), special_tokens={})
    slow = [_PLAIN.pattern, *(map(re.escape, specials(path)) if special else ())]
    unlike = re.compile("|".join(slow))

    def ids(text: str) -> np.ndarray:
        if unlike.search(text):
            return np.array(_tokenizer(path, special).encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=())

    return ids


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str, special: bool):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = not special
    return found


def pieces(docs: DataFrame, tokenizer: str, size: int, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", special: bool = True) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its ids and then 0; a null text has only the 0.  Longer documents are cut
    so that all pieces but the first are full.
    """

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, special)
        for batch in (whole.slice(at, 1000) for whole in them for at in range(0, whole.num_rows, 1000)):
            rows, starts, lengths, sums, parts = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), 0).astype("<u4")
                first = len(ids) % size or size
                for start in [0, *range(first, len(ids), size)]:
                    part = ids[start : start + (size if start else first)]
                    rows.append(row)
                    starts.append(start)
                    lengths.append(len(part))
                    sums.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        parts.append(part.astype(np.int32))
            place = np.array(rows, np.int64)
            piece = np.arange(len(place)) - np.searchsorted(place, place)
            columns = [batch.column(0).take(pa.array(place)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(parts, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(lambda it: trimmed(batches(it)), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def _best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of item numbers; an item goes where the least room is left.  A bit per amount of room finds that at once."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    there = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        fits = there >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                there &= ~(1 << room)
            bins[b].append(item)
        else:
            b, room = len(bins), size
            bins.append([item])
        if room > n:
            by_room[room - n].append(b)
            there |= 1 << (room - n)
    return bins


def _sums_of_two(them: dict[int, list[int]]) -> int:
    """A bit for each sum of two pieces' lengths."""
    every = sum(1 << x for x in them)
    found = 0
    for x, items in them.items():
        found |= (every if len(items) > 1 else every & ~(1 << x)) << x
    return found


def _highest(bits: int, least: int, most: int) -> int | None:
    found = (bits & ((1 << (most + 1)) - 1)) >> least if most >= least else 0
    return least + found.bit_length() - 1 if found else None


def _improve(bins: list[list[int]], lengths: np.ndarray, size: int) -> list[list[int]]:
    """Exchange pieces between bins that are not full, each time raising the sum of squared fills, until no step does.

    A bin gives up none, one or two of its pieces for one of another bin, or none or one for two.
    Pieces of one length are interchangeable, so lengths are tried, not pieces: a bin has few
    different ones (they sum to ``size`` at most), however many pieces it holds.
    """
    n = lengths.tolist()
    held: list[dict[int, list[int]]] = [{} for _ in bins]
    for b, items in enumerate(bins):
        for i in items:
            held[b].setdefault(n[i], []).append(i)
    fill = [sum(n[i] for i in b) for b in bins]
    open_ = {b for b, f in enumerate(fill) if f < size}
    where: dict[int, dict[int, None]] = {}  # the open bins that hold a length
    for b in sorted(open_):
        for x in held[b]:
            where.setdefault(x, {})[b] = None
    mask = sum(1 << x for x in where)
    sums: dict[int, int] = {}

    def withdraw(x: int, b: int) -> None:
        nonlocal mask
        del where[x][b]
        if not where[x]:
            del where[x]
            mask &= ~(1 << x)

    def move(x: int, b: int, to: int) -> None:
        nonlocal mask
        item = held[b][x].pop()
        if not held[b][x]:
            del held[b][x]
            withdraw(x, b)
        held[to].setdefault(x, []).append(item)
        where.setdefault(x, {})[to] = None
        mask |= 1 << x
        fill[b] -= x
        fill[to] += x
        sums.pop(b, None)
        sums.pop(to, None)

    def step(a: int) -> bool:
        room, best = size - fill[a], (0, (), (), a)
        own = sorted(held[a])
        gives = {0: (), **{x: (x,) for x in own}}
        single = list(gives.values())
        for k, x in enumerate(own):
            for y in own[k if len(held[a][x]) > 1 else k + 1 :]:
                gives.setdefault(x + y, (x, y))
        for out, give in gives.items():
            most = min(out + room, size)
            while (x := _highest(mask, out + best[0] + 1, most)) is not None:
                # The other bin must be less full than this one will be.
                other = next((b for b in where[x] if b != a and fill[b] < fill[a] + x - out), None)
                if other is not None:
                    best = (x - out, give, (x,), other)
                    break
                most = x - 1
            if best[0] == room:
                break
        if best[0] < room:
            for b in emptiest:
                if b == a or b not in open_ or fill[b] > fill[a]:
                    continue
                if b not in sums:
                    sums[b] = _sums_of_two(held[b])
                for give in single:
                    out = sum(give)
                    if (both := _highest(sums[b], out + best[0] + 1, out + room)) is not None:
                        x = next(x for x in sorted(held[b]) if (y := both - x) in held[b] and (x != y or len(held[b][x]) > 1))
                        best = (both - out, give, (x, both - x), b)
                if best[0] == room:
                    break
        gain, give, take, b = best
        if not gain:
            return False
        for x in give:
            move(x, a, b)
        for x in take:
            move(x, b, a)
        for c in (a, b):
            if fill[c] in (0, size):
                open_.discard(c)
                for x in held[c]:
                    withdraw(x, c)
        return True

    changed = True
    while changed:
        emptiest = sorted(open_, key=lambda b: (fill[b], b))[:PARTNERS]
        changed = False
        for a in sorted(open_, key=lambda b: (-fill[b], b)):
            while a in open_ and step(a):
                changed = True
    return [[i for items in b.values() for i in items] for b in held if b]


def _packed(df: DataFrame, size: int, first: int, n_chunks: int) -> DataFrame:
    """Pack each chunk; sequence numbers start at ``first`` chunks times 2^32."""
    names = [c for c in df.columns if c != "chunk"]

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = table.column("length").to_numpy()
        sequence, offset, loose = (np.zeros(len(table), np.int64) for _ in range(3))
        base = (first + table.column("chunk")[0].as_py()) << 32
        bins = _improve(_best_fit(lengths, size), lengths, size)
        for number, items in enumerate(bins):
            upto = np.cumsum(lengths[items])
            sequence[items] = base + number
            offset[items] = upto - lengths[items]
            loose[items] = upto[-1] < LOOSE * size
        out = table.select(names)
        for name, values in (("sequence_id", sequence), ("offset", offset), ("loose", loose)):
            out = out.append_column(name, pa.array(values))
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "chunk")
    return df.repartition(min(n_chunks, PARTITIONS), "chunk").groupBy("chunk").applyInArrow(pack, f"{schema}, sequence_id long, offset long, loose long")


def _dealt(df: DataFrame, salt: int) -> tuple[DataFrame, int]:
    """Rows of a written table dealt to chunks by their place in it, so that repeated or null ids spread like others."""
    n = max(1, -(-df.count() // CHUNK))
    return df.withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(salt)), F.lit(n))), n


def pack(docs: DataFrame, *, tokenizer: str, size: int = 2048, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", special: bool = True) -> DataFrame:
    """Place every piece of every document in a sequence of at most ``size`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset; with
    ``with_ids`` its ids too.  Null and empty texts are one token.  Repeated rows are packed
    as often as they come; no rows give no sequences.  Other columns are not read.  The string
    of a special token in a text is that token, as ``tokenizers`` has it in a plain call; with
    ``special`` false it is ordinary text, so that no document can end a sequence.
    """
    cut, n = _dealt(written(pieces(docs, tokenizer, size, with_ids, id_col, text_col, special), "pieces"), 0)
    once = written(_packed(cut, size, 0, n), "packed")
    again, m = _dealt(once.where("loose = 1").drop("sequence_id", "offset", "loose"), 1)
    return once.where("loose = 0").unionByName(_packed(again, size, n, m)).drop("loose")
