"""Host-level quality rules [native].

Every document is measured and held against simple rules.  The failures are
summed by host, each host's failure rate is shrunk towards a beta prior fitted
to all hosts, and hosts whose shrunk rate is too high take their documents down.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.scratch import let, words, written

WINDOW = 8
SYMBOLS = "#*$%&|<>"


def _covered(words_: Column) -> Column:
    """How many words stand in a window of eight that occurs again in the text."""

    def marked(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            twice = F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        def span(p: Column) -> Column:
            step = F.transform(p, lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - i, F.lit(WINDOW))))
            return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))

        whole = let(let(ordered, starts), span)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(whole)

    windows = F.transform(F.sequence(F.lit(1), F.size(words_) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words_, i, WINDOW)))
    return F.when(F.size(words_) < WINDOW, F.lit(0).cast("long")).otherwise(let(windows, marked))


def measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            _covered(w).alias("n_repeat_words"),
        ),
    )


@dataclass(frozen=True)
class Limits:
    """Limits of the rules and of the host verdict."""

    least_words: int = 20
    repeat_percent: int = 30
    symbol_percent: int = 20
    dup_lines: int = 10
    least_length: int = 2
    most_length: int = 20
    host_rate: float = 0.5


def rules(limits: Limits) -> dict[str, Column]:
    """Each rule by name, true where a document fails it."""
    n = F.col("n_words")
    return {
        "few_words": n < limits.least_words,
        "repeats": 100 * F.col("n_repeat_words") > limits.repeat_percent * n,
        "symbols": 100 * F.col("n_symbols") > limits.symbol_percent * F.col("word_chars"),
        "dup_lines": F.col("n_dup_lines") > limits.dup_lines,
        "word_length": (F.col("word_chars") < limits.least_length * n) | (F.col("word_chars") > limits.most_length * n),
    }


def beta_prior(hosts: DataFrame, fails: str, n: str = "n_docs") -> tuple[float, float]:
    """Alpha and beta of the hosts' failure rates by the method of moments.

    One row comes back.  Hosts that differ no more than chance would make them get a
    prior as heavy as all documents; no hosts, or a rate of 0 or 1, a weight of one.
    """
    rate = F.col(fails) / F.col(n)
    sums = hosts.agg(F.count("*").alias("h"), F.sum(n).alias("n"), F.sum(fails).alias("k"), F.sum(F.col(n) * F.col(n).cast("double")).alias("n2"), F.sum(rate * F.col(fails)).alias("kp")).first()
    if not sums["n"]:
        return 0.5, 0.5
    mean = sums["k"] / sums["n"]
    room = sums["n"] - sums["n2"] / sums["n"] - (sums["h"] - 1)
    if mean in (0.0, 1.0) or room <= 0:
        return mean, 1 - mean
    spread = sums["kp"] - sums["n"] * mean * mean  # the sum of n (rate - mean)^2
    rho = (spread / (mean * (1 - mean)) - (sums["h"] - 1)) / room
    weight = min(max(1 / rho - 1, 1.0), float(sums["n"])) if rho > 0 else float(sums["n"])
    return mean * weight, (1 - mean) * weight


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limits: Limits = Limits()) -> DataFrame:
    """One row per document: the measures, ``base_failed``, the shrunk ``host_rate``, ``host_rejected`` and ``kept``.

    A null or empty text has no words and so fails.  A document without a host is judged
    alone.  Repeated rows each get a row.  Other columns are not read.
    """
    m = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), measures(F.col(text_col)).alias("m")).select("doc_id", "host", "m.*")
    failed = rules(limits)
    any_failed = None
    for rule in failed.values():
        any_failed = rule if any_failed is None else any_failed | rule
    m = written(m, "quality").withColumn("base_failed", failed["few_words"] | failed["repeats"])
    hosts = m.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n_docs"), *(F.count_if(rule).alias(f"k_{k}") for k, rule in [*failed.items(), ("any", any_failed)]))
    alpha, beta = beta_prior(hosts, "k_any")
    shrunk = (F.col("k_any") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta))
    verdicts = hosts.select(F.col("host").alias("of_host"), F.round(shrunk, 6).alias("host_rate"), (shrunk > limits.host_rate).alias("host_rejected"))
    # The side of hosts is broadcast only where its measured size is below Spark's threshold; else adaptive execution splits hot hosts.
    joined = m.join(verdicts, m["host"] == verdicts["of_host"], "left").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"), "host_rate", "host_rejected",
    )
