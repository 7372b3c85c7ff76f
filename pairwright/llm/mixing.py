"""Mixing sources to target weights by Pareto order sampling [native].

Each source gets a target size in words.  Every document first gets its certain whole
copies; what is left is drawn with inclusion in proportion to size.  Documents whose size
makes that certain come in first, and the rest of the words is spread over the others, which
are ranked by the odds of a random number over the odds of their inclusion; the lowest ranks
are taken until the source's words are used up, which fixes the sample's size in words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairwright.llm.scratch import words, written

#: Parts of the rank's range that are counted at each of two levels.
PARTS = 4096
#: Documents that may close a source's draw.
CLOSING = 3


def numbered(df: DataFrame, by: str) -> DataFrame:
    """Distinct rows with their place in the order of ``by``, nulls last, as ``place`` from 0.

    Spark deals out ranges; only the number of rows in each range comes to the driver.
    """
    ranged = written(df.repartitionByRange(F.asc_nulls_last(by)).withColumn("_part", F.spark_partition_id()), "numbered")
    before, offsets = 0, []
    for part, n in sorted((r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        offsets += [F.lit(part), F.lit(before)]
        before += n
    within = F.row_number().over(Window.partitionBy("_part").orderBy(F.asc_nulls_last(by))) - 1
    place = within + (F.element_at(F.create_map(*offsets), F.col("_part")) if offsets else F.lit(0))
    return ranged.withColumn("place", place.cast("long")).drop("_part")


def targets(sources: DataFrame, total: float, limit: float) -> DataFrame:
    """Add ``target``: ``total`` shared by ``weight``, at most ``limit`` times ``source_size``.

    What a limited source gives up goes to the others by weight, round by round; a round is
    one aggregate over the sources, of which one row comes back.
    """
    most = F.col("source_size") * F.lit(float(limit))
    level, n_full = 0.0, -1
    while True:
        full = most <= F.lit(level) * F.col("weight")
        got = sources.agg(F.count_if(full).alias("n"), F.sum(F.when(full, most).otherwise(0.0)).alias("given"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("w")).first()
        if got["n"] == n_full or not got["w"]:
            break
        n_full, level = got["n"], (total - got["given"]) / got["w"]
    return sources.withColumn("target", F.least(most, F.lit(level) * F.col("weight")))


def named(id_col: str, text_col: str) -> Column:
    """A row's name: its id and its text's digest."""
    return F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("")))


def uniform(name: Column, seed: int) -> Column:
    """A number above 0 and below 1 that follows from name and seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> list[Column]:
    """What the mixture needs of a row: id, source, name (``tie``) and size in words."""
    return [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), named(id_col, text_col).alias("tie"), F.size(words(F.col(text_col))).cast("long").alias("size")]


def inclusion(base: DataFrame, sources: DataFrame) -> DataFrame:
    """By source: documents larger than ``cut`` come in, others by ``level`` times their size; ``left`` words remain to be drawn.

    Documents are counted by size first.  From the largest size down, a size is certain while
    what is left of the words, spread over the smaller ones in proportion to size, would give
    it more than one; only a source's distinct sizes meet in a task.
    """
    by_size = base.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    by_size = by_size.join(sources.where("rest > 0").select("of_source", "rest"), F.col("source").eqNullSafe(F.col("of_source")))
    down = Window.partitionBy("of_source").orderBy(F.desc("size"))
    larger = F.coalesce(F.sum(F.col("n") * F.col("size")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    squares = F.sum((F.col("n") * F.col("size")).cast("decimal(38,0)") * F.col("size")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    by_size = by_size.withColumn("left", F.col("rest") - larger).withColumn("level", F.col("left") / squares.cast("double"))
    first = F.max(F.when(F.col("level") * F.col("size") < 1, F.struct("size", "level", "left"))).alias("x")
    found = by_size.groupBy("of_source").agg(first)
    return found.select(F.col("of_source").alias("i_source"), F.coalesce("x.size", F.lit(-1)).alias("cut"), F.coalesce("x.level", F.lit(0.0)).alias("level"), F.coalesce("x.left", F.lit(0.0)).alias("left"))


def _crossing(parts: DataFrame, part: str) -> DataFrame:
    """By source, the part in which its words are used up, and the words left there."""
    over = Window.partitionBy("source").orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = parts.withColumn("upto", F.sum("words").over(over))
    at = run.where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min(F.struct(part, (F.col("rest") - (F.col("upto") - F.col("words"))).alias("rest"))).alias("at"))
    return at.select(F.col("source").alias("of_source"), F.col(f"at.{part}").alias(f"last_{part}"), F.col("at.rest").alias(f"rest_{part}"))


def _plan(base: DataFrame, weights: tuple[float, ...], share: float, limit: float, seed: int) -> DataFrame:
    """One row per source: target, certain copies, inclusion by size, and where the drawing ends."""
    sources = written(numbered(base.groupBy("source").agg(F.sum("size").alias("source_size")), "source"), "sources")
    n = len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % n + 1).cast("int"))
    sources = sources.withColumn("weight", weight)
    total = sources.agg(F.sum("source_size").alias("s")).first()["s"] or 0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = written(
        targets(sources, share * total, limit)
        .withColumn("certain", F.floor(ratio))
        .withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size"))
        .select(F.col("source").alias("of_source"), "source_size", "target", "certain", "rest"),
        "targets",
    )
    by_size = inclusion(base, sources)
    sources = sources.join(by_size, sources["of_source"].eqNullSafe(by_size["i_source"]), "left").drop("i_source", "rest").withColumnRenamed("left", "rest")
    sources = written(sources, "inclusion")
    drawn = ranked(base, sources, seed)
    one = written(_crossing(drawn.groupBy("source", "part1").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")), "part1"), "part1")
    inner = _with(drawn.drop("rest", "of_source"), one).where(F.col("part1") == F.col("last_part1")).withColumnRenamed("rest_part1", "rest")
    two = written(_crossing(inner.groupBy("source", "part2").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")), "part2"), "part2")
    # What both levels leave is some sixteen-millionth of a source, and is put in order.
    last = _with(inner.drop("rest", "of_source"), two).where(F.col("part2") == F.col("last_part2"))
    over = Window.partitionBy("source").orderBy("rank", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.groupBy("source", "rank", "tie").agg(F.sum("size").alias("size"), F.first("rest_part2").alias("rest_part2"))
    taken = last.withColumn("upto", F.sum("size").over(over)).where(F.col("upto") <= F.col("rest_part2"))
    ends = taken.groupBy("source").agg(F.max(F.struct("upto", "rank", "tie")).alias("end")).select(F.col("source").alias("e_source"), "end")
    plan = _small(sources, one, two)
    plan = plan.join(ends, plan["of_source"].eqNullSafe(ends["e_source"]), "left").drop("e_source")
    plan = written(plan.withColumn("gap", F.coalesce(F.col("rest_part2") - F.coalesce(F.col("end.upto"), F.lit(0)), F.lit(0.0))), "plan")
    # Documents that come closest to what is still missing close the draw, one after the other.
    plan = plan.withColumn("closing", F.array().cast("array<string>"))
    for k in range(CLOSING):
        left = _with(ranked(base, plan, seed).drop("of_source"), plan.select("of_source", "last_part1", "last_part2", "end", "gap", "closing"))
        miss = F.abs(F.col("size") - F.col("gap"))
        left = left.where(~drawn_in() & ~F.array_contains("closing", F.col("tie")) & (miss < F.col("gap")))
        one = left.groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "rank", "tie", "size")).alias("one")).select(F.col("source").alias("c_source"), "one")
        plan = plan.join(one, plan["of_source"].eqNullSafe(one["c_source"]), "left")
        plan = plan.withColumn("closing", F.when(F.col("one").isNull(), F.col("closing")).otherwise(F.array_append("closing", F.col("one.tie"))))
        plan = written(plan.withColumn("gap", F.col("gap") - F.coalesce("one.size", F.lit(0))).drop("c_source", "one"), f"closing{k}")
    return plan


def _small(sources: DataFrame, *more: DataFrame) -> DataFrame:
    for k, df in enumerate(more):
        df = df.withColumnRenamed("of_source", f"_s{k}")
        sources = sources.join(df, sources["of_source"].eqNullSafe(df[f"_s{k}"]), "left").drop(f"_s{k}")
    return sources


def _with(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Join rows to their source; adaptive execution broadcasts a small measured side and splits a hot source."""
    return rows.join(sources, rows["source"].eqNullSafe(sources["of_source"]))


def with_rank(rows: DataFrame, seed: int) -> DataFrame:
    """Add ``rank`` (odds of the random number over odds of inclusion, folded to 0..1) and its parts; null where nothing is drawn."""
    u, chance = uniform(F.col("tie"), seed), F.col("level") * F.col("size")
    odds = (u / (1 - u)) / (chance / (1 - chance))
    df = rows.withColumn("rank", F.when((F.col("size") > 0) & (F.col("size") <= F.col("cut")) & (F.col("level") > 0), odds / (1 + odds)))
    at = F.col("rank") * PARTS
    return df.withColumn("part1", F.floor(at)).withColumn("part2", F.floor((at - F.floor(at)) * PARTS))


def ranked(base: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Rows that take part in the draw."""
    return with_rank(_with(base, sources.select("of_source", "cut", "level", "rest")), seed).where("rank is not null")


def drawn_in() -> Column:
    """True where a ranked row lies before the end of its source's draw; all do where the draw never ends."""
    before = F.struct("rank", "tie") <= F.struct(F.col("end.rank"), F.col("end.tie"))
    whole = F.col("last_part1").isNull() | (F.col("part1") < F.col("last_part1"))
    inner = (F.col("part1") == F.col("last_part1")) & (F.col("last_part2").isNull() | (F.col("part2") < F.col("last_part2")))
    edge = (F.col("part1") == F.col("last_part1")) & (F.col("part2") == F.col("last_part2")) & F.col("end").isNotNull() & before
    return F.coalesce(whole | inner | edge, F.lit(False))


def mix_sources(
    docs: DataFrame, *, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, limit: float = 2.0, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = False,
) -> DataFrame:
    """One row per document: size, its source's size and target, the words ``taken``, and ``copies``.

    Sources in code-point order, null last, weigh ``weights`` in turn.  Null or empty texts
    have size 0 and are never drawn.  Rows that share both id and text share one fate.  With
    ``keep`` the documents' own columns come back too, under their names, and the result's
    columns start with ``mix_``.
    """
    columns = sizes(docs, id_col, text_col, source_col)
    base = written(docs.select(*columns), "sizes")
    plan = _plan(base, weights, share, limit, seed)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *columns) if keep else base
    df = with_rank(_with(rows, plan), seed)
    drawn = F.col("rank").isNotNull() & (drawn_in() | F.coalesce(F.array_contains("closing", F.col("tie")), F.lit(False)))
    extra = F.when(F.coalesce(F.col("size") > F.col("cut"), F.lit(False)) | drawn, 1).otherwise(0)
    df = df.withColumn("copies", (F.col("certain") + extra).cast("long"))
    if keep:
        return df.select("row.*", F.col("copies").alias("mix_copies"))
    return df.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("size")).alias("taken"), "copies")
