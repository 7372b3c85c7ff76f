"""Strict JSON, comparable texts and statistics on rows small enough to check by eye."""

import json
import math
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from pairwright.functions import json as J
from pairwright.functions import stats
from pairwright.functions import text as T


def one(spark, column, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first().x


def test_strict_parsing(spark):
    good = [('{"b":1.10,"a":[1,2]}', '{"a":[1,2],"b":1.10}'), (" 1e5 ", "1e5"), ('"é"', '"é"'), ("null", "null"), ("123456789012345678901234567890.10", "123456789012345678901234567890.10")]
    for raw, want in good:
        r = one(spark, lambda c: J.read_json(c, []), raw)
        assert (r.error, r.canonical) == (None, want)
    for raw in ("Result: {}", '{"a":1} x', '{"a":1,"a":2}', '{"o":{"a":1,"a":1}}', "NaN", "[1,]", "01", "", "{'a':1}"):
        assert one(spark, lambda c: J.read_json(c, []), raw).error, raw
    assert one(spark, lambda c: J.read_json(c, []), None) is None


def test_pointers(spark):
    doc = '{"a/b":{"~":[10,{"x":null}]},"0":"zero","":7}'
    found = one(spark, lambda c: J.read_json(c, ["/a~1b/~0/0", "/a~1b/~0/1/x", "/a~1b/~0/2", "/0", "/", "", "/a~1b/~0/01"]), doc).found
    assert found[:5] == ["10", "null", None, '"zero"', "7"] and json.loads(found[5]) == json.loads(doc) and found[6] is None
    assert J.pointers_overlap("/a", "/a/b") and not J.pointers_overlap("/a", "/ab")


def test_diff_kinds(spark):
    rows = one(spark, J.diff, '{"a":1,"b":[1,{"c":1}],"d":"x","e":1}', '{"a":2,"b":[1,{"c":"1"},3],"d":"x","f":null}')
    assert {(r.path, r.kind) for r in rows} == {("/a", "value_changed"), ("/b/1/c", "type_changed"), ("/b/2", "added"), ("/e", "removed"), ("/f", "added")}
    assert [(r.path, r.kind) for r in one(spark, J.diff, "1", "2")] == [("/", "value_changed")]
    assert one(spark, J.diff, '{"a":1,"b":2}', '{"b":2,"a":1}') == []


def test_texts(spark):
    assert one(spark, T.normalized, "  A  b\t\nC ") == "a b c"
    assert one(spark, T.normalized, "ﬁ Ⅳ") == "fi iv" and one(spark, T.normalized, "CAF\u00c9") == one(spark, T.normalized, "cafe\u0301")
    dates = [("2024-2-9", "2024-02-09"), ("2023-02-30", None), ("9/2/2024", "2024-02-09"), ("x", None), ("0000-01-01", None)]
    for raw, want in dates[:4]:
        assert one(spark, lambda c: T.canonical_date(c, ("iso", "dmy_slash")), raw) == want, raw
    for raw, want in ((" 007 ", "7"), ("-0", "0"), ("+5", "5"), ("-012", "-12"), ("1.0", None), ("9" * 40, "9" * 40)):
        assert one(spark, T.canonical_integer, raw) == want, raw
    for raw, ok in (("1.10", True), ("+1", False), (" 1", False), (".5", False), ("5.", False), ("1e3", True), ("1E-10", True), ("1e-11", False), ("12.5e1", True), ("0e5", True), ("1e99", False), ("1.00000000005", False), ("1e-30", False)):
        assert (one(spark, T.decimal_text, raw) is not None) == ok, raw
    assert one(spark, T.sanitized, "a\nX-Api-Key: 1\nb") == "a\n[redacted]\nb"


def test_exponents_are_exact(spark):
    df = spark.createDataFrame([("1e3", "1000"), ("2.50E-1", "0.25"), ("-12.5e+1", "-125")], "a string, b string")
    assert df.where(T.decimal_text(F.col("a")) == T.decimal_text(F.col("b"))).count() == 3


def test_tails_of_large_counts():
    from math import comb
    for n, k in ((10, 3), (700, 300), (1000, 500), (5000, 2400)):
        assert abs(stats.binomial_tail(n, k) / (sum(comb(n, i) for i in range(k + 1)) / 2**n) - 1) < 1e-9
    assert abs(stats.binomial_tail(4_000_000_000, 2_000_000_000) - 0.5) < 1e-4 and stats.binomial_tail(10**10, 10) == 0.0


def test_mcnemar(spark):
    cases = [*product(range(9), repeat=2), (3, 9), (300, 350), (0, 0)]
    df = spark.createDataFrame(cases, "b long, c long").select("b", "c", stats.mcnemar(F.col("b"), F.col("c")).alias("p"))
    for r in df.collect():
        n = r.b + r.c
        want = 1.0 if not n else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(r.b, r.c) + 1)) / 2**n)
        assert abs(r.p - want) < 1e-9
    assert abs(next(r.p for r in df.collect() if (r.b, r.c) == (3, 9)) - 0.14599609375) < 1e-12


def test_paired_counts(spark):
    cells = [(True, True)] * 15 + [(True, False)] * 3 + [(False, True)] * 9 + [(False, False)] * 22
    df = spark.createDataFrame(cells, "b boolean, c boolean")
    r = df.agg(*stats.paired_counts(F.col("b"), F.col("c"))).first()
    assert (r.total, r.baseline_pass, r.candidate_pass) == (49, 18, 24) and abs(r.difference_pp - 12.244897959) < 1e-9
    empty = df.limit(0).agg(*stats.paired_counts(F.col("b"), F.col("c"))).first()
    assert (empty.total, empty.difference_pp) == (0, None)


def test_nearest_rank_rounds_up(spark):
    df = spark.range(1, 21).select(F.lit("a").alias("g"), F.col("id").alias("v"))
    r = stats.nearest_rank(df, ["g"], "v", {"p95": 0.95, "median": 0.5}).first()
    assert (r.p95, r.median) == (20, 11)


def test_nearest_rank_of_any_numbers(spark):
    """Long tails, ties, negative and tiny numbers, decimals, null groups: as sorting each group would have it."""
    r = random.Random(4)
    draws = {
        "tail": lambda: round(r.paretovariate(0.3), 6), "ties": lambda: float(r.choice([1, 1, 1, 2, 7])), "signs": lambda: r.gauss(0, 1e6), "tiny": lambda: r.random() * 1e-9, "one": lambda: 5.0, None: lambda: float(r.randrange(50)),
        "wide": lambda: r.choice([-1, 1]) * 10.0 ** r.randrange(-300, 300), "zeros": lambda: r.choice([0.0, 0.0, -3.5]),
    }
    rows = [(g, draw()) for g, draw in draws.items() for _ in range(r.choice([1, 2, 350]) if g != "tail" else 3000)] + [("gone", None), ("tail", None)]
    ranks = {"low": 0.0, "median": 0.5, "p95": 0.95, "top": 1.0, "third": 1 / 3}
    got = {x.g: x for x in stats.nearest_rank(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", ranks).collect()}
    assert set(got) == set(draws)
    for g in draws:
        values = sorted(v for k, v in rows if k == g and v is not None)
        for name, q in ranks.items():
            assert got[g][name] == values[math.ceil((len(values) - 1) * q)], (g, name)
    cents = spark.createDataFrame([(i % 97,) for i in range(500)], "c int").select((F.col("c") / 8).cast("decimal(20,6)").alias("v"))
    assert str(stats.nearest_rank(cents, [], "v", {"median": 0.5}).first().median) == "5.875000"
    assert stats.nearest_rank(cents.limit(0), [], "v", {"median": 0.5}).first().median is None


def test_no_stretch_holds_a_group(spark):
    """A hot group of distinct values: what is ordered at the end is a small share of it."""
    for values in (F.col("id").cast("double"), F.exp(F.col("id") / 5000), F.rand(3) * 1e-6):
        x = spark.range(50_000).select(values.alias("v"))
        part = (F.floor(stats.FINE * F.log2(1 + F.abs("v")))).cast("int")
        parts = x.groupBy(part.alias("p")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        joined = x.withColumn("p", part).join(parts, "p")
        most = joined.groupBy("p", stats.part_of(F.col("v"), F.col("lo"), F.col("hi"))).count().agg(F.max("count")).first()[0]
        assert most < 200


def test_bootstrap():
    low, high = stats.bootstrap(15, 3, 9, 22, 4000, 0.95, 1)
    assert low == stats.bootstrap(15, 3, 9, 22, 4000, 0.95, 1)[0] and -4 < low < 2 and 20 < high < 30
    assert stats.bootstrap(0, 0, 0, 0, 10, 0.95, 1) is None


def test_bad_plans():
    from pairwright.plans.paired import Evaluation, parsed_rule

    with pytest.raises(ValueError):
        Evaluation((("a", "/x", "exact"), ("a", "/y", "exact")))
    with pytest.raises(ValueError):
        Evaluation((("a", "x", "exact"),))
    assert parsed_rule("/a=exact") == ("/a", "exact")
    with pytest.raises(ValueError):
        parsed_rule("/a=what")
