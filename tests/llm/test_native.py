"""The two native operators: by their SQL, by plain Python, and on odd rows."""

import hashlib
import random
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from pairwright.llm import mixing, oracles, quality
from pairwright.llm.queries import ORACLES, QUERIES
from pairwright.llm.scratch import table, written

SF = "/root/testdata/sf0.001"


def sql(text, **tables):
    con = duckdb.connect()
    for path in Path(SF).iterdir():
        if path.stem not in tables:
            con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    for name, frame in tables.items():
        con.register(name, frame)
    rel = con.sql(text)
    return rel.columns, rel.fetchall()


def same(df, columns, rows):
    names = sorted(columns)
    assert sorted(df.columns) == names
    key = lambda r: tuple(round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else x for x in r)
    got = [key(r) for r in df.select(*names).collect()]
    want = [key(r[columns.index(n)] for n in names) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_by_sql(spark, name):
    same(QUERIES[name](spark, SF), *sql(ORACLES[name]))


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_measures_by_definition(spark):
    r = random.Random(1)
    parts = ["a", "b ", "\n", "#x ", "é\t", "a b c d e f g h ", "\x0b", "  ", "|", "𝄞 ", "same line\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(250)] + [None, "", " \n ", "w " * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").select("doc_id", quality.measures(F.col("text")).alias("m"))
    for row in df.collect():
        assert tuple(row.m) == measured(texts[row.doc_id]) if row.doc_id != len(texts) - 1 else row.m.n_repeat_words == 5000


def test_hosts(spark):
    good, bad = "plain words that differ from one another in every one of these twenty odd places so that nothing at all is wrong here now", "short"
    rows = [(i, good, "fine") for i in range(30)] + [(100 + i, bad if i < 27 else good, "poor") for i in range(30)] + [(200, bad, "single"), (201, good, "single2"), (202, good, None), (203, None, None), (204, good, "poor"), (204, good, "poor")]
    df = spark.createDataFrame([(i, t, s, 7, True) for i, t, s in rows], "doc_id long, text string, source string, n_words int, kept boolean")
    out = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    assert quality.quality_rules(df).count() == len(rows) and quality.quality_rules(df.limit(0)).count() == 0
    assert all(out[i].kept for i in range(30)) and out[202].kept and out[201].kept
    assert out[128].host_rejected and not out[128].base_failed and not out[128].kept and not out[204].kept
    assert out[203].base_failed and out[203].host_rate is None


def plain_mix(rows):
    """Targets by the contract, round by round."""
    size: dict = {}
    for _, n, s in rows:
        size[s] = size.get(s, 0) + n
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(size.values()), set(order), {}
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w >= 2 * size[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        open_ -= over
    return size, target


def test_mixing(spark):
    r = random.Random(4)
    for n_sources in (1, 2, 7):
        docs = [(i, " ".join(["w"] * r.choice([0, 1, 5, 40, 300])), r.choice([*(f"s{k}" for k in range(n_sources)), None])) for i in range(400)] + [(400, None, "empty"), (401, "", "empty")]
        df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, size int, copies string").repartition(3)
        rows = mixing.mix_sources(df).collect()
        size, target = plain_mix([(i, len((t or "").split()), s) for i, t, s in docs])
        of = {i: s for i, _, s in docs}
        taken: dict = {}
        for x in rows:
            assert x.source_size == size[of[x.doc_id]] and abs(x.target - target[of[x.doc_id]]) < 1e-3 and x.taken <= 2 * x.size and x.taken == x.copies * x.size
            taken[of[x.doc_id]] = taken.get(of[x.doc_id], 0) + x.taken
        assert all(abs(taken[s] - t) <= max(3, 0.02 * t) for s, t in target.items()), (taken, target)
        assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_sources(df).collect()), key=str)
        same(mixing.mix_sources(df), *sql(oracles.MIXING, documents=df.select("doc_id", "text", "source").toPandas()))
    kept = mixing.mix_sources(df, keep=True)
    assert kept.columns == [*df.columns, "mix_copies"] and kept.count() == len(docs)
    assert mixing.mix_sources(df.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix_sources(df.where("source = 'empty'")).collect()} == {0}


def by_size(sizes, words):
    """Inclusion by size, certain ones first, round by round."""
    sure: set = set()
    while True:
        left = words - sum(sizes[i] for i in sure)
        squares = sum(n * n for i, n in enumerate(sizes) if i not in sure)
        more = {i for i, n in enumerate(sizes) if i not in sure and n * left / squares >= 1}
        if not more:
            return [1.0 if i in sure else n * left / squares for i, n in enumerate(sizes)]
        sure |= more


def test_inclusion_follows_each_documents_chance(spark):
    """Over many seeds a document comes in as often as its size says; ranks are not the order of the random numbers."""
    sizes = [1] * 20 + [5] * 20 + [20] * 20 + [60] * 6 + [2000]
    rest = 2300.0
    df = spark.createDataFrame([(i, " ".join(["w"] * n), "a") for i, n in enumerate(sizes)], "doc_id long, text string, source string").coalesce(1)
    base = written(df.select(*mixing.sizes(df)), "sizes")
    plan = mixing.inclusion(base, spark.createDataFrame([("a", rest)], "of_source string, rest double")).first()
    want = by_size(sizes, rest)
    got = [1.0 if n > plan.cut else plan.level * n for n in sizes]
    assert all(abs(g - w) < 1e-9 for g, w in zip(got, want, strict=True)) and got[-1] == 1.0 and plan.left == 300
    # The operator's own random numbers and ranks, one seed; then those of many seeds, made alike.
    ranked = mixing.with_rank(base.withColumns({"cut": F.lit(plan.cut), "level": F.lit(plan.level)}), 17).collect()
    number = lambda tie, seed: (int(hashlib.md5(f"{seed}:{tie}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52

    def rank(tie, n, seed):
        u, chance = number(tie, seed), plan.level * n
        odds = u / (1 - u) / (chance / (1 - chance))
        return odds / (1 + odds)

    assert all(abs(r["rank"] - rank(r.tie, r["size"], 17)) < 1e-12 if r["size"] <= plan.cut else r["rank"] is None for r in ranked)
    drawing = [(r.doc_id, r.tie, r["size"]) for r in ranked if r["size"] <= plan.cut]
    assert sorted(drawing, key=lambda r: rank(*r[1:], 17)) != sorted(drawing, key=lambda r: number(r[1], 17))
    drawn, seeds = [0] * len(sizes), 3000
    for seed in range(seeds):
        upto = 0
        for i, tie, n in sorted(drawing, key=lambda r: rank(*r[1:], seed)):
            upto += n
            if upto > plan.left + n / 2:
                break
            drawn[i] += 1
    for lo, hi in ((0, 20), (20, 40), (40, 60), (60, 66)):
        often, chance = sum(drawn[lo:hi]) / seeds / (hi - lo), sum(want[lo:hi]) / (hi - lo)
        assert abs(often - chance) < 0.15 * chance + 0.01, (lo, often, chance)


def test_repeated_rows_share_a_fate(spark):
    rows = [(1, "w " * 10, "a")] * 300 + [(1, "v " * 10, "a")] * 3 + [(i, "w " * 7, "a") for i in range(2, 300)] + [(None, "w", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(df, limit=1.3).collect()
    assert len(out) == len(rows) and all(r.taken <= 2 * r.size for r in out)
    assert len({r.copies for r in out if r.doc_id == 1}) <= 2
