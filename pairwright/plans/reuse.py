"""Registered queries over indexes, stored evaluations and what documents have in common; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.prompt import prompt
from pairwright.functions.schema import schema_errors
from pairwright.functions.subtrees import contains
from pairwright.operators import caseindex, discovery, gate, provenance, review
from pairwright.plans import config, incremental, preflight, proposal, retention
from pairwright.plans.config import loaded
from pairwright.plans.evaluations import EVALUATIONS
from pairwright.plans.inspection import CONFIG
from pairwright.plans.paired import ORDERS, evaluate_all, order_cases, order_outputs, order_pairs, table
from pairwright.sources import pins, staged, store
from pairwright.sources.scratch import shared_path, written

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


# The case index


def _indexed(spark: SparkSession, d: str) -> str:
    """An index of all documents by their texts and ids."""
    path = shared_path(spark, "case-index")
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws(" ", F.col("doc_id").cast("string"), "source", "text").alias("search_text"))
    caseindex.build(docs, path, id_col="doc_id", number="doc_id")
    return path


#: Searches: words, parts of words, a sentence's end, white space, two characters, one that nothing holds, and letters beyond ASCII.
SEARCHES = ("License", "tion of", "e.\n", "  ", "ß", "%_", "no such text at all", "ÜBER", "Src1 ")


@query("SELECT s AS query, doc_id AS k FROM documents, (SELECT unnest(" + repr(list(SEARCHES)).replace("\\n", "' || chr(10) || '") + ") AS s) WHERE contains(lower(concat_ws(' ', doc_id::VARCHAR, source, text)), lower(s))")
def case_search_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Documents that each search finds by the index."""
    path, out = _indexed(spark, d), None
    for text in SEARCHES:
        found = caseindex.search(spark, path, text).select(F.lit(text).alias("query"), F.col("case_id").alias("k"))
        out = found if out is None else out.union(found)
    return out


@query(EVALUATIONS + """
, h AS (SELECT pr.k FROM pr JOIN o ON o.k = pr.k WHERE b AND NOT c AND lower(priority) LIKE '%medium%')
SELECT k, 'baseline_only_pass' AS transition, (SELECT count(*) FROM h) AS total FROM h ORDER BY k LIMIT 5 OFFSET 2""")
def case_page_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The page is the feature: regressions that a search by the index finds, five from the third on, with their number."""
    path = shared_path(spark, "case-index")
    cases = order_cases(spark, d).select("id", "k", review.search_text(F.col("expected"), ["/priority", "/status"], F.col("id")).alias("search_text"))
    caseindex.build(cases, path, id_col="id", number="k")
    p = review.filters(order_pairs(spark, d)).select("case_id", F.col("baseline.k").alias("k"), "transition", "filters")
    hits = p.join(caseindex.search(spark, path, "Medium").select("case_id"), "case_id", "left_semi")
    return review.case_page(hits, "k", name="regressions", limit=5, offset=2).select("k", "transition", "total")


# Evaluations by content


@query(EVALUATIONS + """
, x AS (SELECT *, variant = 'candidate' AND status = 'ok' AND k % 100 = 1 AS changed FROM f)
SELECT variant, count(*) FILTER (WHERE NOT changed) AS reused, count(*) FILTER (WHERE changed) AS scored, count(*) FILTER (WHERE NOT changed AND truth = 'true') AS passed,
       (SELECT count(*) FROM x WHERE changed) AS stored FROM x GROUP BY variant""")
def incremental_run(spark: SparkSession, d: str) -> DataFrame:
    """A second run in which a hundredth of the candidate's outputs changed: rows reused and scored again, and what they came to."""
    cases, first = order_cases(spark, d), {v: order_outputs(spark, d, v) for v in ("baseline", "candidate")}
    _, made = incremental.evaluate_again(cases, first, ORDERS, None)
    stored = written(made, "evaluations")
    changed = F.when((F.col("case_id").cast("long") % 100 == 1) & (F.col("status") == "ok"), F.concat(F.lit('{"priority":"changed","k":'), "case_id", F.lit("}"))).otherwise(F.col("raw_output"))
    again, more = incremental.evaluate_again(cases, first | {"candidate": first["candidate"].withColumn("raw_output", changed)}, ORDERS, stored)
    told = again.groupBy("variant").agg(F.count_if("reused").alias("reused"), F.count_if(~F.col("reused")).alias("scored"), F.count_if(F.col("truth") == "true").alias("passed"))
    return told.join(more.agg(F.count("*").alias("stored")))


# Values inside documents


def _nested_cases(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a reference of objects and arrays, parts of which some inputs hold, keys in another order or one value off."""
    k = F.col("o_orderkey")
    party = lambda off=0: F.concat(F.lit('{"name":"c'), F.col("o_custkey") + off, F.lit('","tags":["'), F.col("o_orderpriority"), F.lit('",{"s":"'), F.col("o_orderstatus"), F.lit('"}]}'))
    turned = F.concat(F.lit('{ "tags" : ["'), F.col("o_orderpriority"), F.lit('", {"s":"'), F.col("o_orderstatus"), F.lit('"}], "name":"c'), F.col("o_custkey"), F.lit('"}'))
    inside = F.when(k % 30 == 0, party()).when(k % 30 == 1, turned).when(k % 30 == 2, party(1)).when(k % 30 == 3, F.concat(F.lit('{"s":"'), F.col("o_orderstatus"), F.lit('"}'))).otherwise("null")
    return table(spark, d, "orders").select(k.alias("k"), F.concat(F.lit('{"party":'), party(), F.lit(',"none":null,"list":[]}')).alias("expected"), F.concat(F.lit('{"ask":[1,{"deep":[['), inside, F.lit("]]}]}")).alias("input"))


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 30 WHEN 2 THEN '/party/tags' WHEN 3 THEN '/party/tags/1' ELSE '/party' END AS pointer, o_orderkey % 30 <= 1 AS whole FROM orders WHERE o_orderkey % 30 <= 3""")
def held_values(spark: SparkSession, d: str) -> DataFrame:
    """The largest values of references that stand in what is seen, and whether the whole party does."""
    rows = preflight.held_values(_nested_cases(spark, d))
    rows = rows.withColumn("whole", contains(F.col("input"), F.get_json_object("expected", "$.party")))
    return rows.select("k", F.explode("held").alias("pointer"), "whole")


# Discovery over all rows


def _order_documents(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines as a document: fields that only some have, types that differ, and arrays with members that repeat."""
    li = table(spark, d, "lineitem")
    by = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"))).alias("lines"))
    item = lambda x, i: F.struct(
        (i + 1).alias("line"), F.concat(F.lit("p"), x["l_partkey"], F.lit("-"), i).alias("sku"), x["l_returnflag"].alias("flag"), F.when(i > 0, x["l_suppkey"]).alias("supplier"),
        F.struct(x["l_quantity"].cast("int").alias("n")).alias("much"),
    )
    k = F.col("l_orderkey")
    text = F.to_json(F.struct(k.alias("id"), F.when(k % 3 == 0, k).alias("third"), F.struct(F.when(k % 2 == 0, "even").alias("a*b")).alias("note"), F.transform("lines", item).alias("lines")))
    mixed = F.when(k % 10 == 7, F.regexp_replace(text, '"id":([0-9]+)', '"id":"$1"')).when(k % 10 == 8, F.regexp_replace(text, '"id":([0-9]+)', '"id":$1.5')).otherwise(text)
    return by.select(k.alias("k"), mixed.alias("doc"))


_LINES = "WITH o AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT count(*) AS docs, sum(n)::BIGINT AS lines, sum(n - 1)::BIGINT AS later, count(*) FILTER (WHERE k % 3 = 0) AS thirds, count(*) FILTER (WHERE k % 2 = 0) AS evens FROM o) "


@query(_LINES + """SELECT x.* FROM t, LATERAL (VALUES ('', 'object', docs, NULL), ('/id', 'number,string', docs, true), ('/third', 'integer', thirds, false), ('/note', 'object', docs, true), ('/note/a~2b', 'string', evens, false),
  ('/lines', 'array', docs, true), ('/lines/*', 'object', lines, NULL), ('/lines/*/line', 'integer', lines, true), ('/lines/*/sku', 'string', lines, true), ('/lines/*/flag', 'string', lines, true),
  ('/lines/*/supplier', 'integer', later, false), ('/lines/*/much', 'object', lines, true), ('/lines/*/much/n', 'integer', lines, true)) AS x(place, types, n, required)""")
def discovered_fields(spark: SparkSession, d: str) -> DataFrame:
    """Every place of the orders' documents: its types, how often it is there, and whether all of its objects have it."""
    found = discovery.places(_order_documents(spark, d), "doc")
    return found.select("place", F.array_join(discovery.type_names(F.col("types")), ",").alias("types"), "n", "required")


@query("SELECT count(DISTINCT l_orderkey) AS documents, 0::BIGINT AS refused, count(DISTINCT l_orderkey) AS refused_after_a_change FROM lineitem")
def discovered_schema(spark: SparkSession, d: str) -> DataFrame:
    """Documents that their own schema refuses, and those that it refuses once a field has another type."""
    docs = written(_order_documents(spark, d), "documents")
    schema = discovery.discovered_schema(docs, "doc")
    broken = lambda text: F.size(schema_errors(text, schema)) > 0
    rows = docs.select(broken(F.col("doc")).alias("x"), broken(F.regexp_replace("doc", r'"lines":\[', '"lines":7,"more":[')).alias("y"))
    return rows.agg(F.count("*").alias("documents"), F.count_if("x").alias("refused"), F.count_if("y").alias("refused_after_a_change"))


@query("""WITH o AS (SELECT l_orderkey AS k, count(*) AS n, count(DISTINCT l_returnflag) AS f FROM lineitem GROUP BY 1), s AS (
  SELECT k, count(*) = count(DISTINCT l_suppkey) AS u FROM (SELECT l_orderkey AS k, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) AS i FROM lineitem) WHERE i > 1 GROUP BY 1
), t AS (SELECT count(*) AS docs, count(*) FILTER (WHERE n > 1) AS several, count(*) FILTER (WHERE n = f) AS flags, count(*) FILTER (WHERE n > 2) AS more FROM o), v AS (SELECT count(*) AS has, count(*) FILTER (WHERE u) AS u FROM s)
SELECT x.*, x.member = 'sku' AS chosen FROM t, v, LATERAL (VALUES ('line', docs, docs, docs, several), ('sku', docs, docs, docs, several), ('flag', docs, docs, flags, several), ('supplier', has, 0, u, more), ('much', docs, 0, docs, 0)) AS x(member, arrays, whole, "unique", several)""")
def array_members(spark: SparkSession, d: str) -> DataFrame:
    """Members of the lines' items, in how many arrays they are whole and tell items apart, and which is chosen as key."""
    docs = _order_documents(spark, d)
    read = written(discovery.survey(docs, "doc"), "survey")
    members = discovery.array_members(docs, "doc", read)
    keys = discovery.array_keys(members, discovery.places(docs, "doc", read))
    out = members.join(keys, "place", "left").select("member", "arrays", "whole", "unique", "several", F.coalesce(F.col("member") == F.col("key"), F.lit(False)).alias("chosen"))
    return out


@query("""WITH o AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem)
SELECT x.*, n AS passed FROM o, LATERAL (VALUES ('id', 'exact'), ('lines', 'keyed_array')) AS x(evaluator, kind)""")
def proposed_plan(spark: SparkSession, d: str) -> DataFrame:
    """Evaluators proposed for the orders' documents, and how many references each passes against themselves."""
    cases = written(_order_documents(spark, d).select(F.col("k").cast("string").alias("id"), F.col("doc").alias("expected")), "documents")
    plan = loaded(proposal.proposed(cases)).plan
    out = cases.select(F.col("id").alias("case_id"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error_kind"), F.col("expected").alias("raw_output"))
    e = evaluate_all(cases, {"baseline": out}, plan)
    states = F.explode(F.array(*(F.struct(F.lit(r.id).alias("evaluator"), F.lit(r.kind).alias("kind"), F.col(f"`{r.id}_state`").alias("state")) for r in plan.rules)))
    return e.select(states.alias("s")).groupBy("s.evaluator", "s.kind").agg(F.count_if(F.col("s.state") == "passed").alias("passed"))


# Prompts and settings

TEMPLATE = "Order {{ input.k }} of {{input.party.name}}:\n{{ input.tags[1] }} ({{ model_visible_metadata.state }})"


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 <> 0 THEN 'Order ' || o_orderkey || ' of c' || o_custkey || ':' || chr(10) || o_orderpriority || ' (' || CASE WHEN o_orderkey % 7 = 0 THEN 'null' ELSE '{"s":"' || o_orderstatus || '"}' END || ')' END AS prompt,
  CASE WHEN o_orderkey % 9 = 0 THEN 'input/party/name' END AS undefined FROM orders""")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of all orders; where a name leads nowhere there is none."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    party = F.struct(F.when(k % 9 != 0, F.concat(F.lit("c"), F.col("o_custkey"))).alias("name"))
    seen = F.when(k % 7 == 0, '{"state":null}').otherwise(F.to_json(F.struct(F.struct(F.col("o_orderstatus").alias("s")).alias("state"))))
    cases = o.select(k.alias("k"), F.to_json(F.struct(k.alias("k"), party.alias("party"), F.array(F.lit("x"), "o_orderpriority").alias("tags"))).alias("input"), seen.alias("model_visible_metadata"))
    made = cases.withColumn("p", prompt(TEMPLATE))
    return made.select("k", F.col("p.text").alias("prompt"), F.col("p.undefined").alias("undefined"))


def _customer_settings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A configuration per customer, and overrides that some have: of a value, of one that is the same, and of a new one."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    gate = F.struct(F.lit(100).alias("min_cases"), F.lit(0.5).alias("max_rate"))
    base = c.select(k.alias("k"), F.to_json(F.struct(F.col("c_name").alias("project"), gate.alias("gate"), F.array(F.lit("a"), F.lit("b")).alias("tags"))).alias("text"))
    more = F.when(k % 5 == 0, '{"gate":{"min_cases":200}}').when(k % 5 == 1, '{"gate":{"min_cases":100}}').when(k % 5 == 2, '{"seed":7,"tags":["a","c"]}')
    return base, c.select(k.alias("k"), more.alias("text")).where("text is not null")


@query("""SELECT source, pointer, sum(n)::BIGINT AS n FROM (
  SELECT CASE WHEN c_custkey % 5 = 0 AND p = '/gate/min_cases' OR c_custkey % 5 = 2 AND p = '/tags/1' THEN 'override' ELSE 'configuration' END AS source, p AS pointer, 1 AS n FROM customer, (SELECT unnest(['/project', '/gate/min_cases', '/gate/max_rate', '/tags/0', '/tags/1']) AS p)
  UNION ALL SELECT 'added', '/seed', 1 FROM customer WHERE c_custkey % 5 = 2) GROUP BY ALL""")
def setting_sources(spark: SparkSession, d: str) -> DataFrame:
    """Where each setting comes from once overrides are laid over the configurations."""
    base, more = _customer_settings(spark, d)
    found = provenance.overridden(provenance.settings(base, "k", "text"), provenance.settings(more, "k", "text"), "k")
    return found.groupBy("source", "pointer").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN '/gate/max_rate' ELSE '/gate/more' END AS pointer, CASE WHEN c_custkey % 4 = 0 THEN '0.6' ELSE '[]' END AS manifest, CASE WHEN c_custkey % 4 = 0 THEN '0.5' END AS configuration FROM customer WHERE c_custkey % 4 < 2""")
def manifest_disagreements(spark: SparkSession, d: str) -> DataFrame:
    """Settings of the gate in which manifests tell something else than their configurations; other differences don't count."""
    base, _ = _customer_settings(spark, d)
    k = F.col("k")
    told = F.when(k % 4 == 0, F.replace("text", F.lit('"max_rate":0.5'), F.lit('"max_rate":0.6'))).when(k % 4 == 1, F.replace("text", F.lit('"max_rate":0.5'), F.lit('"max_rate":0.5,"more":[]'))).otherwise(F.replace("text", F.lit('"b"'), F.lit('"z"')))
    return provenance.disagreements(provenance.settings(base.withColumn("text", told), "k", "text"), provenance.settings(base, "k", "text"), "k", ("/gate",))


# Stored runs, saved cases, staged files, retained outputs


@query(EVALUATIONS + """
SELECT x.* FROM (SELECT count(*) AS n FROM o) t, LATERAL (VALUES ('cases', n), ('variants', 2), ('variant_outputs', 2 * n), ('evaluator_results', 6 * n), ('outcome_results', 2 * n), ('paired_results', 2), ('events', 4), ('evaluations', 2 * n), ('summary', 2), ('gate', 26)) AS x(relation, n_rows)""")
def stored_relations(spark: SparkSession, d: str) -> DataFrame:
    """A run from a configuration is stored; the rows of its relations as they are read again."""
    made, cases, plan = _order_run(spark, d)
    base = shared_path(spark, "runs")
    store.write_run(base, "01", "test", store.relations(made, cases, plan))
    out = None
    for name in store.relations(made, cases, plan):
        row = store.read_relation(spark, base, "01", name).agg(F.lit(name).alias("relation"), F.count("*").alias("n_rows")).select("relation", "n_rows")
        out = row if out is None else out.union(row)
    return out


def _order_inputs(spark: SparkSession, d: str) -> tuple:
    """What a run of the orders takes: cases, both variants' outputs and a configuration."""
    cases = order_cases(spark, d).withColumn("input", F.to_json(F.struct("k")))
    return cases, order_outputs(spark, d, "baseline"), order_outputs(spark, d, "candidate"), loaded(CONFIG)


def _order_run(spark: SparkSession, d: str):
    cases, baseline, candidate, chosen = _order_inputs(spark, d)
    return config.run(cases, baseline, candidate, chosen), cases, chosen.plan


@query(EVALUATIONS + """
, suite AS (SELECT CASE WHEN k % 10 = 9 THEN 'missing' WHEN c AND b THEN 'passing' WHEN c THEN 'fixed' WHEN b OR k % 3 = 0 THEN 'reintroduced' ELSE 'still_broken' END AS suite_status FROM pr)
SELECT suite_status, count(*) AS n FROM suite GROUP BY 1""")
def pin_refresh(spark: SparkSession, d: str) -> DataFrame:
    """All orders are saved cases as the baseline left them; a first run passes every third, the candidate's run lacks every tenth."""
    base, p = shared_path(spark, "runs"), order_pairs(spark, d)
    origin = p.select("case_id", F.lit("00").alias("run_id"), F.lit(None).cast("string").alias("note"), F.col("baseline.semantic_success").alias("origin_passed"))
    pins.save(spark, base, origin)
    pins.refresh(spark, base, "01", p.select("case_id", (F.col("baseline.k") % 3 == 0).alias("passes")))
    pins.refresh(spark, base, "02", p.where(F.col("baseline.k") % 10 != 9).select("case_id", F.col("candidate.semantic_success").alias("passes")))
    return pins.saved(spark, base)[0].groupBy("suite_status").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT s) AS files, sum(n)::BIGINT AS lines, true AS intact FROM (SELECT coalesce(source, '?') AS s, count(*) AS n FROM documents GROUP BY 1)")
def staged_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents' ids written by source, staged by their digests, and loaded once they have been found to be the same."""
    path = shared_path(spark, "staged")
    docs = table(spark, d, "documents").select(F.coalesce("source", F.lit("?")).alias("source"), F.col("doc_id").cast("string").alias("id"))
    docs.repartition("source").write.partitionBy("source").text(path)
    known = written(staged.parts(spark, path, size=1000).where("file like '%.txt'"), "parts")
    same = staged.faults(spark, path, known, size=1000).where("file like '%.txt'").agg((F.count("*") == 0).alias("intact"))
    files = staged.files(known).select(F.regexp_extract("file", "source=([^/]*)", 1).alias("s")).agg(F.countDistinct("s").alias("files"))
    lines = spark.read.text(path).agg(F.count("*").alias("lines"))
    return files.join(lines).join(same)


@query(EVALUATIONS + "SELECT variant, truth, schema_valid, count(*) AS n, 0::BIGINT AS with_raw_text FROM f GROUP BY ALL")
def retained_replay(spark: SparkSession, d: str) -> DataFrame:
    """Evaluations from outputs of which only what is compared was kept, beside a secret that each text held."""
    cases, out = order_cases(spark, d), {v: order_outputs(spark, d, v) for v in ("baseline", "candidate")}
    secret = {v: df.withColumn("raw_output", F.regexp_replace("raw_output", r"^[{]", '{"secret":"s3cret",')) for v, df in out.items()}
    e = retention.evaluated(cases, {v: retention.retained(df, ORDERS) for v, df in secret.items()}, ORDERS)
    return e.groupBy("variant", "truth", "schema_valid").agg(F.count("*").alias("n"), F.count_if(F.contains("raw_output", F.lit("s3cret"))).alias("with_raw_text"))


@query("""SELECT x.* FROM (SELECT count(*) > 0 AS filled FROM orders) t, LATERAL (VALUES ('not replayed', 'not_verified', 'EVIDENCE NOT VERIFIED'), ('replayed', 'verified', 'DO NOT DEPLOY'), ('replayed otherwise', 'replay_failed', 'REPLAY FAILED'), ('rewritten', 'modified', 'EVIDENCE MODIFIED')) AS x(run, integrity, title) WHERE filled""")
def integrity_states(spark: SparkSession, d: str) -> DataFrame:
    """A stored run's integrity and title: not replayed, replayed, replayed to other verdicts, and after its files were changed."""
    made, cases, plan = _order_run(spark, d)
    base, e = shared_path(spark, "runs"), written(config.evaluations(*_order_inputs(spark, d)), "evaluations")  # the replay: from the inputs once more
    found = {name: df for name, df in store.relations(made, cases, plan).items() if name in ("evaluations", "gate")}
    made["gate"] = gate.rules(made["inputs"], {"max_error_rate": 0.0001})
    found["gate"] = made["gate"]
    written_run = store.write_run(base, "01", "test", found)
    other = e.withColumn("truth", F.when(F.col("case_id") == "5", "error").otherwise(F.col("truth")))
    shown = lambda name, again: store.stored_decision(spark, base, "01", again=again).select(F.lit(name).alias("run"), "integrity", "title")
    out = shown("not replayed", None).union(shown("replayed", e)).union(shown("replayed otherwise", other))
    out = written(out, "states")
    other.drop("expected", "raw_output").limit(10).write.mode("overwrite").parquet(written_run.tables["evaluations"][0])
    return out.union(shown("rewritten", e))
