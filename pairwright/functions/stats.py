"""Statistics of paired outcomes as Spark expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def paired_counts(baseline: Column, candidate: Column) -> list[Column]:
    """Aggregates: the four cells, both margins and the difference in percentage points (null over nothing)."""
    b, c = F.coalesce(baseline, F.lit(False)), F.coalesce(candidate, F.lit(False))
    n, wins, losses = F.count("*"), F.count_if(~b & c), F.count_if(b & ~c)
    return [
        n.alias("total"), F.count_if(b & c).alias("both_pass"), losses.alias("baseline_only"), wins.alias("candidate_only"),
        F.count_if(~b & ~c).alias("both_fail"), F.count_if(b).alias("baseline_pass"), F.count_if(c).alias("candidate_pass"),
        F.round(F.try_divide(100.0 * (wins - losses), n), 9).alias("difference_pp"),
    ]


def binomial_tail(n: int, k: int) -> float:
    """The probability of at most ``k`` of ``n`` fair coins, for 2 k <= n.

    Terms are summed from the largest down, in blocks, until they no longer tell: some square
    root of n of them, whatever the counts.
    """
    first = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2))
    total, term, i = first, first, k
    while i > 0 and term > total * 1e-18:
        down = np.arange(i, max(i - 4096, 0), -1, dtype=float)
        terms = term * np.cumprod(down / (n - down + 1))
        total, term, i = total + float(terms.sum()), float(terms[-1]), i - len(down)
    return total


def mcnemar(losses: Column, wins: Column) -> Column:
    """The exact two-sided McNemar p of discordant counts: twice the binomial tail at one half, at most 1.

    Without discordance p is 1.  A small helper over result rows: one number per group.
    """

    def p_of(b: int | None, c: int | None) -> float | None:
        if b is None or c is None:
            return None
        return 1.0 if b + c == 0 else min(1.0, 2 * binomial_tail(b + c, min(b, c)))

    return F.udf(p_of, "double", useArrow=True)(losses.cast("long"), wins.cast("long"))


#: Parts that a group's values are dealt to by size before any are ordered: of a doubling, and of what lies between the ends of one part.
FINE, PARTS = 64, 1024


def part_of(value: Column, low: Column, high: Column, parts: int = PARTS) -> Column:
    """Which of ``parts`` equal stretches from ``low`` to ``high`` a number lies in; larger numbers lie in no earlier one."""
    x, lo, hi = (c.cast("double") for c in (value, low, high))
    return F.coalesce(F.floor(F.try_divide(x - lo, hi - lo) * (parts - 1)), F.lit(0)).cast("int")


def nearest_rank(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, float]) -> DataFrame:
    """Per group, the sorted values at places ceil((n - 1) q), which round up where ``percentile_disc`` does not.

    Rows are first counted by value.  Values lie in parts by their logarithm, and only these parts'
    counts are summed in order; the part that holds a place is cut into equal stretches, and only
    the values of the stretch that holds it are ordered.  So no group is ordered in one task, nor
    are its distinct values, however many they are.
    """
    x = F.col(value).cast("double")
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_part", (F.signum(x) * F.floor(FINE * F.log2(1 + F.abs(x)))).cast("int"))

    def holding(sums: DataFrame, groups: list[str], order: str, place: Column) -> DataFrame:
        """Of each group the row in which a place lies, and which place of that row it is."""
        upto = F.sum("_n").over(Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        found = sums.withColumn("_upto", upto).withColumn("_at", place)
        return found.where((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_n") <= F.col("_at"))).withColumn("_at", F.col("_at") - F.col("_upto") + F.col("_n")).drop("_upto")

    def inside(found: DataFrame, *more: str) -> DataFrame:
        """The counted values of the parts that were found, with what is known of the parts."""
        other = found.select(*(F.col(k).alias(f"_of_{k}") for k in (*keys, "_part")), "_name", "_at", *more)
        same = F.lit(True)
        for k in (*keys, "_part"):
            same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
        return counts.join(other, same).drop(*(f"_of_{k}" for k in (*keys, "_part"))).withColumn("_stretch", part_of(F.col(value), F.col("_low"), F.col("_high")))

    sums = counts.groupBy(*keys, "_part").agg(F.sum("_n").alias("_n"), F.min(x).alias("_low"), F.max(x).alias("_high"))
    named = F.explode(F.array(*(F.struct(F.lit(name).alias("_name"), F.lit(q).alias("_q")) for name, q in ranks.items()))).alias("_r")
    sums = sums.withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys))).select("*", named).select(*sums.columns, "_all", "_r._name", "_r._q")
    parts = holding(sums, [*keys, "_name"], "_part", F.ceil((F.col("_all") - 1) * F.col("_q")))
    groups = [*keys, "_name"]
    stretches = inside(parts, "_low", "_high").groupBy(*groups, "_part", "_low", "_high", "_at", "_stretch").agg(F.sum("_n").alias("_n"))
    stretch = holding(stretches.withColumnRenamed("_at", "_place"), groups, "_stretch", F.col("_place")).withColumnRenamed("_stretch", "_wanted")
    found = holding(inside(stretch, "_low", "_high", "_wanted").where("_stretch = _wanted").withColumnRenamed("_at", "_place"), groups, value, F.col("_place"))
    return found.groupBy(*keys).agg(*(F.min(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in ranks))


def bootstrap(both: int, losses: int, wins: int, neither: int, samples: int, confidence: float, seed: int) -> tuple[float, float] | None:
    """The percentile interval of the difference in points; resampling pairs is drawing the cells' counts.

    Depends on the four counts alone, so it doesn't grow with the number of pairs.
    """
    n = both + losses + wins + neither
    if not n:
        return None
    drawn = np.random.default_rng(seed).multinomial(n, np.array([losses, wins, both + neither]) / n, size=samples)
    effects = 100.0 * (drawn[:, 1] - drawn[:, 0]) / n
    low, high = np.quantile(effects, [(1 - confidence) / 2, (1 + confidence) / 2])
    return float(low), float(high)


def interval(counts: tuple[Column, Column, Column, Column], samples: int, confidence: float, seed: int) -> Column:
    """``bootstrap`` of four counts (both, losses, wins, neither) as a struct of both ends; null over nothing.  One small row per group comes to a Python worker."""
    drawn = F.udf(lambda *cells: None if None in cells else bootstrap(*cells, samples, confidence, seed), "struct<lower_pp:double,upper_pp:double>", useArrow=True)
    return drawn(*(c.cast("long") for c in counts))
