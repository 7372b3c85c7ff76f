"""Cases and recorded outputs from JSON lines, JSON arrays and CSV, with their violations as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairwright.functions.json import json_items, json_string, read_json
from pairwright.functions.text import decimal_text

CASE_FIELDS = {"id": "/id", "input": "/input", "expected": "/expected", "model_visible_metadata": "/model_visible_metadata", "metadata": "/metadata"}
OUTPUT_FIELDS = ("case_id", "status", "raw_output", "parsed_output", "error", "latency_ms", "usage", "cost", "metadata", "retries")
STATUS = {"ok": "ok", "success": "ok", "error": "error", "failed": "error", "missing": "missing"}


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their place in their part of a file; a task reads parts one after the other, each in its order."""
    part, n = None, 0
    for batch in batches:
        files, starts = batch.column("file").to_pylist(), batch.column("start").to_pylist()
        places = []
        for here in zip(files, starts, strict=True):
            part, n = here, n + 1 if here == part else 0
            places.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=[*batch.schema.names, "place"])


def json_lines(spark: SparkSession, path: str, *, lenient: bool = False) -> DataFrame:
    """Lines with their file and number in it; blank lines stay (and are violations) unless ``lenient``.

    A file of any size is read in parts.  A line's number is its place in its part and the lines of
    the parts before it, which are counted by the byte where a part starts.
    """
    part = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    counts = spark.read.text(path).select(*part).groupBy("file", "start").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("file").alias("_file"), F.col("start").alias("_start"), before.alias("_before"))
    lines = spark.read.text(path).select(*part, F.col("value").alias("line")).mapInArrow(_placed, "file string, start long, line string, place long")
    placed = lines.join(counts, (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start")))
    lines = placed.select("file", (F.col("place") + F.col("_before") + 1).alias("source_line"), "line")
    return lines.where(F.trim("line") != "") if lenient else lines


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """The items of each file's JSON array, or its one object, as lines; a file is one value and so one task's."""
    text = spark.read.text(path, wholetext=True)
    items = json_items(F.col("value"))
    whole = F.when(items.isNull(), F.raise_error(F.lit("a file is no strict JSON"))).otherwise(items)
    return text.select(F.posexplode(whole).alias("place", "line")).select((F.col("place") + 1).cast("long").alias("source_line"), "line")


def csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """CSV rows with a header, all cells texts; a cell that is strict JSON other than a padded number stays as JSON, others become JSON strings."""
    rows = spark.read.csv(path, header=True, multiLine=True, mode="FAILFAST", quote='"', escape='"', inferSchema=False)
    cells = {}
    for name in rows.columns:
        read = read_json(F.col(name), [])
        cells[name] = F.when(F.col(name).isNotNull(), F.coalesce(read["canonical"], F.to_json(F.array(F.col(name))).substr(F.lit(2), F.length(F.to_json(F.array(F.col(name)))) - 2)))
    return rows.select(*(v.alias(k) for k, v in cells.items()))


def typed_cells(spark: SparkSession, path: str) -> DataFrame:
    """As ``csv_cells``, but only true, false, null, numbers, objects and arrays are JSON; JSON strings stay texts with their quotes."""
    rows = spark.read.csv(path, header=True, multiLine=True, mode="FAILFAST", quote='"', escape='"', inferSchema=False)
    out = []
    for name in rows.columns:
        cell, found = F.trim(name), read_json(F.trim(name), [])["canonical"]
        text = F.to_json(F.array(F.col(name)))
        out.append(F.when(F.col(name).isNotNull(), F.when(~cell.startswith('"') & found.isNotNull(), found).otherwise(text.substr(F.lit(2), F.length(text) - 2))).alias(name))
    return rows.select(*out)


def format_of(name: str, head: str) -> str:
    """The format of a file by its name, or else by how it begins: json, jsonl or csv."""
    last = name.lower().rpartition(".")[2]
    if last in ("json", "jsonl", "ndjson", "csv"):
        return "jsonl" if last == "ndjson" else last
    first = head.lstrip()[:1]
    if first == "[":
        return "json"
    return "jsonl" if first == "{" else "csv"


#: Where a part of a case or of an output may be found, the likeliest first.
CANDIDATES = {
    "id": ("/id", "/case_id", "/invoice_id", "/document_id", "/record_id"), "input": ("/input", "/payload", "/document", "/request", "/text"),
    "expected": ("/expected", "/ground_truth", "/reference", "/target", "/label"), "model_visible_metadata": ("/model_visible_metadata", "/visible_metadata"),
    "metadata": ("/metadata", "/evaluation_metadata", "/tags"), "output": ("/output", "/result", "/response", "/prediction", "/parsed_output"),
}


def inferred_fields(lines: DataFrame, parts: tuple[str, ...]) -> dict[str, str]:
    """The pointer of each part by the first line, which alone comes to the driver; a part not found has its usual pointer."""
    wanted = list(dict.fromkeys(p for part in parts for p in CANDIDATES[part]))
    first = lines.orderBy("source_line").limit(1).select(read_json(F.col("line"), wanted)["found"].alias("f")).first()
    there = set() if first is None or first.f is None else {p for p, x in zip(wanted, first.f, strict=True) if x is not None}
    return {part: next((p for p in CANDIDATES[part] if p in there), CANDIDATES[part][0]) for part in parts}


def mapped_outputs(lines: DataFrame, id_pointer: str, output_pointer: str, mapping: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Recorded outputs from lines of any shape, parts found by pointers, and the violations.

    ``mapping`` tells where status, latency_ms, usage, cost, metadata and error are.  A string output
    is the raw text, another value its JSON text.  A failed output without an error gets one.
    """
    at = {"status": "/status"} | {k: p for k, p in (mapping or {}).items() if p}
    if strange := set(at) - {"status", "latency_ms", "usage", "cost", "metadata", "error"}:
        raise ValueError(f"no such parts: {sorted(strange)}")
    wanted = list(dict.fromkeys([id_pointer, output_pointer, *at.values()]))
    found = lambda p: F.get("r.found", F.lit(wanted.index(p)))
    part = lambda k: found(at[k]) if k in at else F.lit(None).cast("string")
    read = lines.withColumn("r", read_json(F.col("line"), wanted))
    cols = read.select("source_line", F.col("r.error").alias("malformed"), json_string(found(id_pointer)).alias("case_id"), found(output_pointer).alias("_output"), *(part(k).alias(f"_{k}") for k in ("status", "latency_ms", "usage", "cost", "metadata", "error")))
    status = F.when(F.col("_status").isNull(), "ok").otherwise(json_string(F.col("_status")))
    cols = cols.withColumn("status", status)
    whole = F.col("malformed").isNull()
    rule = lambda name, when: F.when(when, F.lit(name))
    cols = cols.withColumn("faults", F.array_compact(F.array(
        rule("malformed_json", ~whole), rule("bad_id", whole & (F.trim(F.coalesce("case_id", F.lit(""))) == "")), rule("bad_status", whole & ~F.coalesce(F.col("status").isin("ok", "error", "missing"), F.lit(False))),
        rule("ok_without_output", whole & (F.col("status") == "ok") & F.col("_output").isNull()),
    )))
    error = F.col("_error")
    own = F.get_json_object(error, "$.kind").isNotNull() & F.get_json_object(error, "$.message").isNotNull()
    kind = F.when(F.col("status") == "missing", "missing_output").when(F.col("status") == "error", F.when(own, F.get_json_object(error, "$.kind")).otherwise("recorded_error"))
    told = F.when(own, F.get_json_object(error, "$.message")).when(error.startswith('"'), json_string(error)).when(error.isNotNull(), F.concat(F.lit("Recorded error: "), error)).otherwise("no error was recorded")
    good = cols.where(F.size("faults") == 0).select(
        "source_line", "case_id", "status", F.when(F.col("status") == "ok", F.coalesce(json_string(F.col("_output")), F.col("_output"))).alias("raw_output"), kind.alias("error_kind"),
        F.when(F.col("status") == "error", told).alias("error_message"), F.col("_latency_ms").try_cast("long").alias("latency_ms"), F.get_json_object("_usage", "$.input_tokens").try_cast("decimal(20,0)").alias("input_tokens"),
        F.get_json_object("_usage", "$.output_tokens").try_cast("decimal(20,0)").alias("output_tokens"), F.get_json_object("_cost", "$.amount").try_cast("decimal(28,10)").alias("cost"), F.get_json_object("_cost", "$.currency").alias("currency"), F.col("_metadata").alias("metadata"),
    )
    return good, cols.select("source_line", "case_id", F.explode("faults").alias("violation"))


def cases(lines: DataFrame, fields: dict[str, str] = CASE_FIELDS, max_line_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Cases (id, input, expected, visible metadata, metadata as JSON text, source_line) and the violations.

    Lines with a violation are no cases; of lines with one id the first is.
    """
    names = list(fields)
    read = lines.withColumn("r", read_json(F.col("line"), [fields[n] for n in names]))
    place = F.struct(F.col("file") if "file" in lines.columns else F.lit(""), F.col("source_line")).alias("place")
    cols = read.select("source_line", place, F.octet_length("line").alias("bytes"), F.col("r.error").alias("malformed"), (F.trim("line") == "").alias("blank"), *(F.get("r.found", F.lit(i)).alias(n) for i, n in enumerate(names)))
    cols = cols.withColumn("id", F.trim(json_string(F.col("id"))))
    repeated = cols.where("id <> ''").groupBy("id").agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1")
    rule = lambda name, when: F.when(when, F.lit(name))
    cols = cols.withColumn("faults", F.array_compact(F.array(
        rule("blank_line", F.col("blank")), rule("line_too_long", F.col("bytes") > max_line_bytes), rule("malformed_json", ~F.col("blank") & F.col("malformed").isNotNull()),
        rule("bad_id", F.col("malformed").isNull() & (F.coalesce("id", F.lit("")) == "")), rule("missing_input", F.col("malformed").isNull() & F.col("input").isNull()),
    )))
    broken = cols.select("source_line", F.explode("faults").alias("violation"))
    again = cols.join(repeated, "id").where(F.col("place") > F.col("first")).select("source_line", F.lit("duplicate_id").alias("violation"))
    valid = cols.where(F.size("faults") == 0).join(repeated.select(F.col("id").alias("_again"), "first"), F.col("id") == F.col("_again"), "left")
    return valid.where(F.col("first").isNull() | (F.col("place") == F.col("first"))).select(*names, "source_line"), broken.union(again)


def outputs(lines: DataFrame, known: DataFrame, max_line_bytes: int = 1 << 20, max_output_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Recorded outputs of one variant, and the violations: unknown fields or ids, repeats, status rules, costs.

    Lines with a violation are no outputs, so their cases count as missing; of lines with one id the first is,
    by file and line.
    """
    read = lines.withColumn("r", read_json(F.col("line"), [f"/{n}" for n in OUTPUT_FIELDS])).withColumn("o", F.col("r.found"))
    at = {n: F.get("o", F.lit(i)) for i, n in enumerate(OUTPUT_FIELDS)}
    text = lambda n: json_string(at[n])
    place = F.struct(F.col("file") if "file" in lines.columns else F.lit(""), F.col("source_line")).alias("place")
    cols = read.select(
        "source_line", place, F.octet_length("line").alias("bytes"), F.col("r.error").alias("malformed"), F.json_object_keys("r.canonical").alias("keys"), text("case_id").alias("case_id"), F.coalesce(text("status"), F.lit("ok")).alias("status"),
        text("raw_output").alias("raw_output"), at["parsed_output"].alias("parsed_output"), F.get_json_object(at["error"], "$.kind").alias("error_kind"), at["error"].isNotNull().alias("has_error"),
        at["latency_ms"].try_cast("long").alias("latency_ms"), F.get_json_object(at["usage"], "$.input_tokens").try_cast("decimal(20,0)").alias("input_tokens"), F.get_json_object(at["usage"], "$.output_tokens").try_cast("decimal(20,0)").alias("output_tokens"),
        F.get_json_object(at["cost"], "$.amount").alias("cost_text"), F.get_json_object(at["cost"], "$.currency").alias("currency"), F.json_array_length(at["retries"]).alias("retries"), at["cost"].isNotNull().alias("has_cost"),
    )
    has_output = F.col("raw_output").isNotNull() | F.col("parsed_output").isNotNull()
    raw = read_json(F.col("raw_output"), [])["canonical"]
    rule = lambda name, when: F.when(when, F.lit(name))
    cols = cols.withColumn("faults", F.array_compact(F.array(
        rule("line_too_long", F.col("bytes") > max_line_bytes), rule("output_too_long", F.greatest(F.octet_length("raw_output"), F.octet_length("parsed_output")) > max_output_bytes),
        rule("malformed_json", F.col("malformed").isNotNull()), rule("unknown_field", F.size(F.array_except("keys", F.array(*map(F.lit, OUTPUT_FIELDS)))) > 0),
        rule("blank_id", F.col("malformed").isNull() & (F.trim(F.coalesce("case_id", F.lit(""))) == "")), rule("bad_status", ~F.col("status").isin("ok", "error", "missing")),
        rule("ok_without_output", (F.col("status") == "ok") & F.col("malformed").isNull() & ~has_output), rule("ok_with_error", (F.col("status") == "ok") & F.col("has_error")),
        rule("failed_with_output", (F.col("status") != "ok") & has_output), rule("failed_without_error", (F.col("status") == "error") & ~F.col("has_error")),
        rule("outputs_differ", F.col("raw_output").isNotNull() & F.col("parsed_output").isNotNull() & ~raw.eqNullSafe(F.col("parsed_output"))),
        rule("bad_cost", F.col("has_cost") & (F.coalesce(decimal_text(F.col("cost_text")) < 0, F.lit(True)) | F.col("cost_text").startswith("-") | (F.trim(F.coalesce("currency", F.lit(""))) == ""))),
    )))
    broken = cols.select("source_line", "case_id", F.explode("faults").alias("violation"))
    strangers = cols.where("case_id is not null").join(known.select(F.col("id").alias("case_id")), "case_id", "left_anti").select("source_line", "case_id", F.lit("unknown_id").alias("violation"))
    repeated = cols.where("case_id is not null").groupBy("case_id").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("case_id").alias("_again"), "first")
    again = cols.join(repeated, F.col("case_id") == F.col("_again")).where(F.col("place") > F.col("first")).select("source_line", "case_id", F.lit("duplicate_id").alias("violation"))
    valid = cols.where(F.size("faults") == 0).join(known.select(F.col("id").alias("case_id")), "case_id", "left_semi").join(repeated, F.col("case_id") == F.col("_again"), "left")
    valid = valid.where(F.col("first").isNull() | (F.col("place") == F.col("first")))
    kept = valid.withColumn("raw_output", F.coalesce("raw_output", "parsed_output")).drop("place", "bytes", "keys", "malformed", "has_error", "has_cost", "parsed_output", "faults", "_again", "first")
    return kept, broken.union(strangers).union(again)


def simple_outputs(rows: DataFrame, id_col: str, output_col: str, status_col: str | None = None) -> DataFrame:
    """Rows of an id, an output and maybe a status in other words, as recorded outputs."""
    status = F.lit("ok") if status_col is None else F.coalesce(*(F.when(F.lower(status_col) == k, F.lit(v)) for k, v in STATUS.items()), F.lit("error"))
    return rows.select(F.col(id_col).cast("string").alias("case_id"), status.alias("status"), F.when(status == "ok", F.col(output_col)).alias("raw_output"), F.when(status == "error", F.lit("provider")).alias("error_kind"))


def expanded(counts: DataFrame) -> DataFrame:
    """Study rows from counts of the four cells: one row per case, numbered within its study."""
    cells = F.array(*(F.struct(F.lit(b).alias("baseline"), F.lit(c).alias("candidate"), F.col(n).cast("int").alias("n")) for n, b, c in (("both_pass", True, True), ("baseline_only_pass", True, False), ("candidate_only_pass", False, True), ("both_fail", False, False))))
    cell = counts.select("id", F.posexplode(cells).alias("cell", "c")).where("c.n > 0")
    return cell.select("id", "cell", F.explode(F.sequence(F.lit(1), F.col("c.n"))).alias("ordinal"), F.col("c.baseline").alias("baseline"), F.col("c.candidate").alias("candidate"))
