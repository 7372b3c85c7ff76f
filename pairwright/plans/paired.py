"""The evaluation plan: cases and recorded outputs of two variants to scored, paired rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.json import parse, pointers_overlap, read_values
from pairwright.functions.schema import refused, schema_errors
from pairwright.functions.text import DATE_FORMATS
from pairwright.operators import evaluators as E
from pairwright.operators import outcomes as O
from pairwright.operators.pairing import or_missing, paired


@dataclass(frozen=True)
class Rule:
    """An evaluator of a plan: its kind, the pointers into output and reference (the same unless told), and its options.

    ``keyed_array`` takes ``keys`` ({pointer: exact or normalized_string}) and ``fields``
    ({pointer: (comparison, options)}) of the items; ``financial_invariants`` points to items,
    subtotal, tax and total of the output, and its ``line`` to quantity, price and amount of an
    item; ``external`` has no pointers, its results come as a table.
    """

    id: str
    kind: str
    pointers: tuple[str, ...] = ()
    expected: tuple[str, ...] | None = None
    options: Mapping = field(default_factory=dict)

    @property
    def reference(self) -> tuple[str, ...]:
        return () if self.kind in ("required_fields", "financial_invariants", "external") else self.pointers if self.expected is None else self.expected


#: How a comparison gets its values: at each of the rule's pointers, and the items of the array at one, of reference and output.
Read = Callable[[str], Column]


@dataclass(frozen=True)
class Side:
    """What a document gave: values by pointer, and items of arrays by pointer and what is read of them."""

    value: Read
    items: Callable[[str, tuple[str, ...]], Column]


def _each(compare: Callable[..., Column]) -> Callable[..., Column]:
    """One comparison at every pointer; the worst counts."""

    def state(rule: Rule, e: Side, a: Side) -> Column:
        found = [compare(e.value(p), a.value(q), **rule.options) for p, q in zip(rule.reference, rule.pointers, strict=True)]
        return found[0] if len(found) == 1 else E.worst(*found)

    return state


def _inside(rule: Rule) -> tuple[str, ...]:
    """Pointers into the items of the rule's array."""
    if rule.kind == "keyed_array":
        return (*rule.options["keys"], *rule.options["fields"])
    return tuple(rule.options.get("line", ("/quantity", "/unit_price", "/amount"))) if rule.kind == "financial_invariants" else ()


def _keyed(rule: Rule, e: Side, a: Side) -> Column:
    inside, o = _inside(rule), rule.options
    return E.keyed_status(e.items(rule.reference[0], inside), a.items(rule.pointers[0], inside), tuple(o["keys"].values()), tuple((how, dict(more)) for how, more in o["fields"].values()))


def _financial(rule: Rule, e: Side, a: Side) -> Column:
    return E.financial_records(a.items(rule.pointers[0], _inside(rule)), *(a.value(p) for p in rule.pointers[1:]), tolerance=rule.options.get("tolerance", "0.00"))


#: Kinds of evaluators that a plan can name, each from what both documents gave, and the pointers each has.
KINDS: dict[str, tuple[Callable[..., Column], Callable[[int], bool]]] = {
    **{k: (_each(f), lambda n: n == 1) for k, f in E.COMPARISONS.items()},
    "enum_accuracy": (_each(E.same_json), lambda n: n == 1), "tool_selection": (_each(E.same_json), lambda n: n == 1),
    "tool_arguments": (_each(E.same_json), lambda n: n > 0), "pointers_exact": (_each(E.same_json), lambda n: n > 0),
    "required_fields": (lambda rule, e, a: E.required_fields(*(a.value(p)["json"] for p in rule.pointers)), lambda n: n > 0),
    "keyed_array": (_keyed, lambda n: n == 1), "financial_invariants": (_financial, lambda n: n == 4), "external": (None, lambda n: n == 0),
}


@dataclass(frozen=True)
class Evaluation:
    """What is compared: evaluators, what outputs have to look like, and how verdicts combine.

    An evaluator is a Rule, or short (id, pointer, kind).  Outputs are valid if fields have the
    required ``types`` and the whole keeps to ``schema``, the text of a JSON Schema.  ``primary``
    names the evaluators that make the outcome; all do unless told.
    """

    evaluators: tuple[Rule | tuple[str, str, str], ...]
    types: tuple[tuple[str, str], ...] = ()  # (pointer, JSON type)
    outcome: str = "all_of"
    primary: tuple[str, ...] | None = None
    schema: str | None = None

    @property
    def rules(self) -> tuple[Rule, ...]:
        return tuple(r if isinstance(r, Rule) else Rule(r[0], r[2], (r[1],)) for r in self.evaluators)

    @property
    def components(self) -> tuple[str, ...]:
        return tuple(r.id for r in self.rules) if self.primary is None else self.primary

    def __post_init__(self) -> None:
        rules = self.rules
        ids = [r.id for r in rules]
        if len(set(ids)) < len(ids) or not ids:
            raise ValueError("evaluators need different ids, and at least one")
        if bad := [r.id for r in rules if r.kind not in KINDS or not KINDS[r.kind][1](len(r.pointers)) or len(r.reference) not in (0, len(r.pointers))]:
            raise ValueError(f"no such kind, or not its pointers: {bad}")
        if bad := [p for r in rules for p in (*r.pointers, *r.reference) if p and not p.startswith("/")]:
            raise ValueError(f"no such pointer: {bad}")
        for r in rules:
            _checked(r)
        if self.schema is not None and (bad := refused(parse(self.schema))):
            raise ValueError(f"a schema that can't be checked: {bad}")
        if self.outcome not in ("all_of", "any_of"):
            raise ValueError("an outcome is all_of or any_of")
        if not self.components or (bad := sorted(set(self.components) - set(ids))):
            raise ValueError(f"an outcome needs evaluators of the plan: {bad if self.components else 'none given'}")


#: Options that a kind takes.
OPTIONS = {"normalized_string": {"case_insensitive"}, "canonical_date": {"formats"}, "decimal": {"absolute", "relative"}, "keyed_array": {"keys", "fields"}, "financial_invariants": {"line", "tolerance"}}


def _checked(r: Rule) -> None:
    if strange := set(r.options) - OPTIONS.get(r.kind, set()):
        raise ValueError(f"{r.id}: no such options: {sorted(strange)}")
    if set(r.options.get("formats", ())) - set(DATE_FORMATS):
        raise ValueError(f"{r.id}: formats are of {sorted(DATE_FORMATS)}")
    orders = {f.partition("_")[0] + f.partition("_")[2] for f in r.options.get("formats", ()) if f != "iso"}
    if any({f"dmy{s}", f"mdy{s}"} <= orders for s in ("slash", "dot", "dash")):
        raise ValueError(f"{r.id}: day first and month first can't be told apart")
    if r.kind == "keyed_array":
        keys, fields = r.options.get("keys", {}), r.options.get("fields", {})
        if not keys or set(keys.values()) - {"exact", "normalized_string"} or {how for how, _ in fields.values()} - set(E.COMPARISONS):
            raise ValueError(f"{r.id}: items need keys, and comparisons of {sorted(E.COMPARISONS)}")
        inside = [*keys, *fields]
        if any(pointers_overlap(p, q) for i, p in enumerate(inside) for q in inside[i + 1 :]):
            raise ValueError(f"{r.id}: keys and fields overlap")


def parsed_rule(text: str) -> tuple[str, str]:
    """``POINTER=KIND`` as a pointer and a kind of comparison."""
    pointer, _, kind = text.partition("=")
    if not pointer.startswith("/") or kind not in E.COMPARISONS:
        raise ValueError(f"{text!r} is not POINTER=KIND with a kind of {sorted(E.COMPARISONS)}")
    return pointer, kind


def _named(name: str) -> Column:
    """A column of any name; evaluators' ids may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def _references(plan: Evaluation) -> list[str]:
    return list(dict.fromkeys(p for r in plan.rules for p in r.reference))


def _pointers(plan: Evaluation) -> list[str]:
    return list(dict.fromkeys([p for r in plan.rules for p in r.pointers] + [p for p, _ in plan.types]))


def _arrays(plan: Evaluation, of_reference: bool) -> list[tuple[str, tuple[str, ...]]]:
    """Arrays whose items are read, of references or of outputs, and the pointers into them."""
    at = [((r.reference if of_reference else r.pointers)[:1], _inside(r)) for r in plan.rules if _inside(r)]
    return list(dict.fromkeys((p[0], inside) for p, inside in at if p))


def read_references(cases: DataFrame, plan: Evaluation) -> DataFrame:
    """Cases with what the plan reads of their references, as ``_e``."""
    return cases.withColumn("_e", read_values(F.col("expected"), _references(plan), _arrays(plan, True), whole=False))


def _side(column: str, pointers: list[str], arrays: list[tuple[str, tuple[str, ...]]]) -> Side:
    value = lambda p: F.get(f"{column}.found", F.lit(pointers.index(p)))
    return Side(value, lambda p, inside: F.get(f"{column}.items", F.lit(arrays.index((p, inside)))))


def dealt(cases: DataFrame) -> DataFrame:
    """Cases dealt by id to a fixed number of partitions, as small tables would else be parsed in one task."""
    return cases.repartition(int(cases.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")


def evaluate_all(cases: DataFrame, outputs: dict[str, DataFrame], plan: Evaluation, external: DataFrame | None = None) -> DataFrame:
    """One row per case and variant: state of the output, evaluators' states, outcome and flags.

    References are parsed once for all variants, outputs once each, strictly and for all pointers,
    in all forms that comparisons need; the rest is Spark expressions.  Cases are dealt by id,
    which serves the joins with every variant's outputs; after them texts are parsed where they lie,
    as Spark forgets how rows are dealt once Python has seen them.  ``external`` holds results of the plan's external
    evaluators (case_id, variant, evaluator, status); one that gave none is an error.
    """
    rows = _joined(dealt(cases), outputs, plan)
    outside = [r.id for r in plan.rules if r.kind == "external"]
    if outside:
        if external is None:
            raise ValueError(f"results are needed for {outside}")
        given = external.groupBy(F.col("case_id").alias("_id"), F.col("variant").alias("_variant")).agg(
            *(F.min(F.when(F.col("evaluator") == i, F.when(F.col("status").isin(E.PASSED, E.FAILED, E.NOT_APPLICABLE), F.col("status")).otherwise(E.ERROR))).alias(f"_given_{i}") for i in outside))
        rows = rows.join(given, (rows["id"] == given["_id"]) & (rows["variant"] == given["_variant"]), "left").drop("_id", "_variant")
    return _scored(rows, plan)


def _joined(known: DataFrame, outputs: dict[str, DataFrame], plan: Evaluation | None = None) -> DataFrame:
    """Every case once per variant, with its output, or with status ``missing``; of columns of both, the case's stay.  With a plan, also what is read of references."""
    kinds = {f.name: f.dataType for df in outputs.values() for f in df.schema if f.name not in (*known.columns, "variant", "case_id")}
    rows, sides = known, []
    for n, (variant, df) in enumerate(outputs.items()):
        whole = F.struct(*((F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in kinds.items()))
        side = df.select(F.col("case_id").alias(f"_id{n}"), whole.alias(f"_out{n}"))
        rows = rows.join(side, rows["id"] == side[f"_id{n}"], "left").drop(f"_id{n}")
        sides.append(F.struct(F.lit(variant).alias("variant"), F.col(f"_out{n}").alias("out")))
    rows, kept = (rows, known.columns) if plan is None else (read_references(rows, plan), [*known.columns, "_e"])
    rows = rows.select(*kept, F.explode(F.array(*sides)).alias("_side")).select(*kept, "_side.variant", "_side.out.*")
    return or_missing(rows)


#: Kinds that don't hold an output against a reference's values.
_ALONE = ("external", "required_fields", "financial_invariants")


def reference_issues(cases: DataFrame, plan: Evaluation) -> DataFrame:
    """Cases whose reference an evaluator of the plan can't take: id, evaluator, state.

    Every comparison is made of the reference with itself; where it doesn't pass, the fault is the
    reference's, so the state is an error.  A case without a reference is one.  Evaluators that
    compare with none are left out.
    """
    side = _side("_e", _references(plan), _arrays(plan, True))

    def itself(rule: Rule) -> Column:
        return KINDS[rule.kind][0](replace(rule, pointers=rule.reference), side, side)

    found = [F.struct(F.lit(r.id).alias("evaluator"), F.when(itself(r) == E.PASSED, E.PASSED).otherwise(E.ERROR).alias("state")) for r in plan.rules if r.kind not in _ALONE]
    if not found:
        return cases.where(F.lit(False)).select("id", F.lit("").alias("evaluator"), F.lit("").alias("state"))
    rows = read_references(dealt(cases.select("id", "expected")), plan)
    return rows.select("id", F.explode(F.array(*found)).alias("i")).select("id", "i.*").where("state <> 'passed'")


def first_failure(states: dict[str, Column], plan: Evaluation) -> Column:
    """The pointer of the first component of the outcome that failed, in the plan's order; null if none did."""
    return F.coalesce(*(F.when(states[r.id] == E.FAILED, F.lit(r.pointers[0] if r.pointers else r.id)) for r in plan.rules if r.id in plan.components))


def evaluate(cases: DataFrame, outputs: DataFrame, variant: str, plan: Evaluation) -> DataFrame:
    """One row per case: the evaluation of one variant."""
    return evaluate_all(cases, {variant: outputs}, plan)


def _scored(rows: DataFrame, plan: Evaluation) -> DataFrame:
    pointers, arrays = _pointers(plan), _arrays(plan, False)
    rows = rows.withColumn("_a", read_values(F.when(F.col("status") == "ok", F.col("raw_output")), pointers, arrays))
    expected, actual = _side("_e", _references(plan), _arrays(plan, True)), _side("_a", pointers, arrays)
    rows = rows.withColumn("parse_valid", F.coalesce((F.col("status") == "ok") & F.col("_a.error").isNull() & F.col("_a.canonical").isNotNull(), F.lit(False)))

    def state(r: Rule) -> Column:
        if r.kind == "external":
            return F.coalesce(_named(f"_given_{r.id}"), F.lit(E.ERROR))
        return E.parsed_only(F.col("parse_valid"), KINDS[r.kind][0](r, expected, actual))

    rows = rows.withColumns({f"{r.id}_state": state(r) for r in plan.rules})
    typed = F.col("parse_valid")
    for p, kind in plan.types:
        typed = typed & F.coalesce(actual.value(p)["type"] == kind, F.lit(False))
    if plan.schema is not None:
        rows = rows.withColumn("schema_errors", schema_errors(F.when(F.col("parse_valid"), F.col("raw_output")), plan.schema))
        typed = typed & F.coalesce(F.size("schema_errors") == 0, F.lit(False))
    rows = judged(rows.withColumn("schema_valid", typed), plan)
    return rows.withColumnRenamed("id", "case_id").withColumn("output", F.col("_a.canonical")).drop("_e", "_a", *(f"_given_{r.id}" for r in plan.rules))


def judged(rows: DataFrame, plan: Evaluation) -> DataFrame:
    """Outcome and flags of rows from their evaluators' states."""
    combine = O.all_of if plan.outcome == "all_of" else O.any_of
    rows = rows.withColumn("components", F.array(*(_named(f"{i}_state") for i in plan.components)))
    rows = rows.withColumns({"truth": combine(F.col("components")), "any_truth": O.any_of(F.col("components")), "fully_evaluated": O.fully_evaluated(F.col("components"))})
    return rows.withColumns(O.case_flags(F.col("status"), F.col("schema_valid"), F.col("truth"), F.col("fully_evaluated")))


def pairs(cases: DataFrame, baseline: DataFrame, candidate: DataFrame, plan: Evaluation, external: DataFrame | None = None) -> DataFrame:
    """Every case with the evaluations of both variants as structs."""
    return paired(evaluate_all(cases, {"baseline": baseline, "candidate": candidate}, plan, external))


# The provided tables hold no paired JSON, so orders become it: references, and two variants with known faults.
ORDERS = Evaluation((("priority", "/priority", "exact"), ("status", "/status", "exact"), ("cents", "/cents", "exact_integer")), (("/priority", "string"), ("/status", "string"), ("/cents", "integer")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    doc = F.to_json(F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")))
    return o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("custkey"), doc.alias("expected"))


def order_outputs(spark: SparkSession, sf_dir: str, variant: str) -> DataFrame:
    """Recorded outputs with faults that follow from the key: missing, failed, malformed and wrong ones."""
    o = table(spark, sf_dir, "orders")
    k, base = F.col("o_orderkey"), variant == "baseline"
    hit = lambda b, c: k % (b if base else c) == 0
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    doc = F.to_json(F.struct(
        F.when(hit(7, 11), "WRONG").otherwise(F.col("o_orderpriority")).alias("priority"), F.when(F.lit(base) | (k % 19 != 0), F.col("o_orderstatus")).alias("status"),
        F.when(hit(13, 17), cents + 1).otherwise(cents).alias("cents"),
    ))
    raw = F.when(hit(53, 59), F.concat(F.lit("Result: "), doc) if base else doc.substr(F.lit(1), F.length(doc) - 1)).otherwise(doc)
    failed = hit(89, 83)
    out = o.select(
        k.cast("string").alias("case_id"), F.when(failed, "error").otherwise("ok").alias("status"), F.when(failed, "timeout" if base else "provider").alias("error_kind"), F.when(~failed, raw).alias("raw_output"),
        (k % 1000 + (F.lit(0) if base else k % 37)).alias("latency_ms"), (k % 500).cast("long").alias("input_tokens"), (k % 200).cast("long").alias("output_tokens"), (k % 3).cast("int").alias("retries"),
        F.when(~failed, ((k % 100).cast("decimal(18,6)") / 1000).cast("decimal(18,6)")).alias("cost"), F.when(~failed, "USD").alias("currency"),
    )
    return out.where(F.col("case_id").cast("long") % 97 != 0) if base else out


def order_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both variants' evaluations of the orders, one row per case and variant."""
    return evaluate_all(order_cases(spark, sf_dir), {v: order_outputs(spark, sf_dir, v) for v in ("baseline", "candidate")}, ORDERS)


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired(order_evaluations(spark, sf_dir))
