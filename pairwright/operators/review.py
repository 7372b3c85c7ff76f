"""Looking into a run: filters, pages, search, chunks, leaks, redaction, saved cases, replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairwright.functions.json import diff, read_json
from pairwright.functions.stats import part_of
from pairwright.functions.text import truncated
from pairwright.operators.pairing import transition


def filters(pairs: DataFrame) -> DataFrame:
    """Pairs with the names of the filters that they fall under."""
    b, c = (lambda n: F.col(f"baseline.{n}")), (lambda n: F.col(f"candidate.{n}"))
    either = lambda f: f(b) | f(c)
    moved = transition(b("semantic_success"), c("semantic_success"))
    named = {
        "regressions": moved == "baseline_only_pass", "improvements": moved == "candidate_only_pass", "both_wrong": moved == "both_fail",
        "valid_but_wrong": either(lambda s: s("valid_but_wrong")), "parse_failures": either(lambda s: ~s("parse_valid")), "schema_failures": either(lambda s: s("parse_valid") & ~s("schema_valid")),
        "evaluator_errors": either(lambda s: s("truth") == "error"), "adapter_errors": either(lambda s: s("status") != "ok"),
    }
    hits = F.filter(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in named.items())), lambda x: x.isNotNull())
    return pairs.withColumn("transition", moved).withColumn("filters", hits)


def discordant(pairs: DataFrame) -> DataFrame:
    """Pairs whose verdicts differ, or of which a side is valid but wrong."""
    return pairs.where((F.col("baseline.semantic_success") != F.col("candidate.semantic_success")) | F.col("baseline.valid_but_wrong") | F.col("candidate.valid_but_wrong"))


def page(cases: DataFrame, order: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of at most 500 cases, by order; the page is the feature, so its limit stays."""
    if not 1 <= limit <= 500 or not 0 <= offset <= 100_000:
        raise ValueError("a page has 1 to 500 cases and starts at 0 to 100,000")
    return cases.orderBy(order).offset(offset).limit(limit)


def search(cases: DataFrame, text: Column, query: str) -> DataFrame:
    """Cases whose text holds the query, letter case aside; its characters stand for themselves."""
    if len(query) > 256:
        raise ValueError("a query has at most 256 characters")
    return cases.where(F.contains(F.lower(text), F.lit(query.lower())))


def chunks(cases: DataFrame, ordinal: Column, size: int = 50) -> DataFrame:
    """Cases with the report chunk that they belong to and their place in it; ``ordinal`` counts from 0."""
    return cases.withColumn("chunk", F.floor(ordinal / size).cast("long")).withColumn("place", (ordinal % size).cast("long"))


def leaks(cases: DataFrame, visible: Column, gold: Column) -> DataFrame:
    """Cases whose gold leaf is one of the visible leaves; both are arrays of one row."""
    return cases.where(F.arrays_overlap(visible, gold))


def suspicious_id(id_: Column, label: Column) -> Column:
    """The id's words name the label."""
    return F.array_contains(F.split(F.lower(id_), r"[^\p{Alnum}]+"), F.lower(label))


def redacted(text: Column, secret: Column) -> Column:
    """A text, occurrences of a secret of four characters or more replaced; a text that is the secret always."""
    return F.when(text == secret, "[redacted]").when(F.length(secret) >= 4, F.replace(text, secret, F.lit("[redacted]"))).otherwise(text)


def pin_status(passes: Column, origin_passed: Column, before: Column) -> Column:
    """What became of a saved case in the current run."""
    return (
        F.when(passes.isNull(), "missing").when(passes & origin_passed, "passing").when(passes, "fixed")
        .when(origin_passed | F.coalesce(before.isin("passing", "fixed"), F.lit(False)), "reintroduced").otherwise("still_broken")
    )


def suite_summary(pins: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("suite_status") == s)
    return pins.agg(F.count("*").alias("total"), *(n(s).alias(s) for s in ("passing", "fixed", "still_broken", "reintroduced", "missing")), (n("reintroduced") + n("missing") > 0).alias("blocking"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest complete run of each kind; run ids sort by time."""
    return runs.where("status = 'complete'").groupBy("kind").agg(F.max("run_id").alias("run_id"))


def pin_history(history: DataFrame) -> DataFrame:
    """Each pin's status over its runs: a status depends on the one before, which a window of the pin's runs supplies."""
    runs = Window.partitionBy("pin_id").orderBy("run_id")
    ever = F.max(F.when(F.col("passes"), 1).otherwise(0)).over(runs.rowsBetween(Window.unboundedPreceding, -1)) == 1
    last = F.lag("passes").over(runs)
    before = F.when(F.coalesce(last, F.lit(False)), "passing").when(F.coalesce(ever, F.lit(False)), "reintroduced")
    return history.withColumn("suite_status", pin_status(F.col("passes"), F.col("origin_passed"), before))


def within_budget(logs: DataFrame, order: str, size: Column, budget: int, run: str = "run_id") -> DataFrame:
    """Log entries with what is left of their run's byte budget, in order; ``order`` is a number or a time.

    A run's entries are dealt to stretches of its order, whose sizes are summed in order; entries
    are ordered within their stretch alone, so no run's entries meet in one task.
    """
    at = F.col(order).cast("double")
    ends = logs.groupBy(run).agg(F.min(at).alias("_low"), F.max(at).alias("_high")).withColumnRenamed(run, "_run")
    dealt = logs.withColumn("_size", size).join(ends, F.col(run).eqNullSafe(F.col("_run"))).drop("_run")
    dealt = dealt.withColumn("_stretch", part_of(F.col(order), F.col("_low"), F.col("_high"))).drop("_low", "_high")
    sums = dealt.groupBy(run, "_stretch").agg(F.sum("_size").alias("_sum"))
    earlier = lambda keys, by, what: F.coalesce(F.sum(what).over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col(run).alias("_run"), F.col("_stretch").alias("_of"), earlier([run], "_stretch", "_sum").alias("_earlier"))
    whole = dealt.join(sums, F.col(run).eqNullSafe(F.col("_run")) & (F.col("_stretch") == F.col("_of")))
    before = F.col("_earlier") + earlier([run, "_stretch"], order, "_size")
    kept = whole.withColumn("remaining", F.greatest(F.lit(0), F.lit(budget) - before)).withColumn("kept_bytes", F.least("_size", "remaining"))
    return kept.drop("_size", "_stretch", "_run", "_of", "_earlier")


def replayed(stored: DataFrame, again: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of a run that a recomputation gives otherwise: changed, lost or new."""
    s, a = stored.select(key, F.struct(*columns).alias("s")), again.select(F.col(key).alias("_k"), F.struct(*columns).alias("a"))
    both = s.join(a, s[key] == a["_k"], "full_outer")
    how = F.when(F.col("s").isNull(), "new").when(F.col("a").isNull(), "lost").when(~F.to_json("s").eqNullSafe(F.to_json("a")), "changed")
    return both.select(F.coalesce(key, "_k").alias(key), how.alias("mismatch")).where("mismatch is not null")


def differences(rows: DataFrame, left: str, right: str, key: str) -> DataFrame:
    """Places at which two JSON documents of a row differ."""
    return rows.select(key, F.explode(diff(F.col(left), F.col(right))).alias("d")).select(key, "d.*")


def priced(input_tokens: Column, output_tokens: Column, price_in: str, price_out: str) -> Column:
    """The exact cost of a million-token price list; unknown if either count is."""
    price = lambda x: F.lit(x).cast("decimal(12,6)")
    return ((input_tokens.cast("decimal(18,0)") * price(price_in) + output_tokens.cast("decimal(18,0)") * price(price_out)) / 1_000_000).cast("decimal(38,12)")


def search_text(document: Column, pointers: list[str], *more: Column, longest: int = 4096) -> Column:
    """What a search looks through: further texts, and what a few pointers find in a document, each cut to ``longest`` characters."""
    if len(pointers) > 32:
        raise ValueError("at most 32 pointers are searched")
    found = F.transform(F.array_compact(read_json(document, pointers)["found"]), lambda x: F.substring(x, 1, longest))
    return F.lower(F.array_join(F.concat(F.array_compact(F.array(*more)), F.coalesce(found, F.array().cast("array<string>"))), " "))


def case_page(filtered: DataFrame, order: str, *, name: str = "all", query: str = "", pins: DataFrame | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the cases that a filter and a search leave, each with the number of them all.

    ``filtered`` has ``filters`` and, for a search, ``search_text``; a name that no filter has means all,
    ``pinned`` the cases of ``pins`` (case_id).  The total is one aggregate, joined back, so no
    window gathers the hits.
    """
    hits = filtered
    if name == "pinned":
        if pins is None:
            raise ValueError("pins are needed for that filter")
        hits = hits.join(pins.select("case_id"), "case_id", "left_semi")
    elif name in FILTERS:
        hits = hits.where(F.array_contains("filters", name))
    if query:
        hits = search(hits, F.col("search_text"), query)
    total = hits.agg(F.count("*").alias("total")).withColumn("_one", F.lit(1))
    return page(hits, order, limit, offset).withColumn("_one", F.lit(1)).join(total, "_one").drop("_one")


#: Names of filters that a page can be asked for.
FILTERS = ("regressions", "improvements", "both_wrong", "valid_but_wrong", "parse_failures", "schema_failures", "evaluator_errors", "adapter_errors")


def matches(pattern: Column, pointer: Column) -> Column:
    """The pointer has the pattern's steps, of which ``*`` is any."""
    steps, wanted = F.split(pointer, "/"), F.split(pattern, "/")
    return (F.size(steps) == F.size(wanted)) & F.forall(F.arrays_zip(wanted.alias("w"), steps.alias("s")), lambda x: (x["w"] == "*") | (x["w"] == x["s"]))


def case_view(pairs: DataFrame, secret: Column, *, max_bytes: int = 65536) -> DataFrame:
    """What a report shows of a case: both outputs without the secret, cut, and their state beside the reference."""
    shown = lambda s: truncated(redacted(F.col(f"{s}.raw_output"), secret), max_bytes).alias(f"{s}_output")
    state = lambda s: F.col(f"{s}.truth").alias(f"{s}_truth")
    return pairs.select("case_id", *(f(s) for s in ("baseline", "candidate") for f in (shown, state)))
