"""Every registered query against its SQL over the smallest tables."""

import datetime
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from pairwright.plans.oracles import ORACLES
from pairwright.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(frame):
    def cell(v):
        if v is None or (not isinstance(v, (list, dict, datetime.date)) and pd.isna(v)):
            return "NULL"
        return str(round(float(v), 9)) if isinstance(v, float) or type(v).__name__ in ("Decimal", "float64") else str(v).removesuffix(".0")

    rows = [tuple(cell(v).removesuffix(".0") for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False)]
    return sorted(frame.columns), sorted(rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).iterdir():
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(duck.sql(ORACLES[name]).df())


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


def test_stream_scores_what_the_batch_does(spark, tmp_path):
    from pairwright.plans.paired import ORDERS, evaluate, order_cases, order_outputs
    from pairwright.streaming.paired import read_outputs, score_stream

    out = order_outputs(spark, SF, "candidate")
    out.repartition(3).write.parquet(str(tmp_path / "in"))
    query = score_stream(read_outputs(spark, str(tmp_path / "in"), out.schema, files_per_trigger=1), order_cases(spark, SF), "candidate", ORDERS, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("truth").count().collect()
    want = evaluate(order_cases(spark, SF), out, "candidate", ORDERS).groupBy("truth").count().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_entry_is_the_flagship_query(spark):
    import __spark_entry__

    row = __spark_entry__.entry(spark).first()
    assert row.total == row.both_pass + row.baseline_only + row.candidate_only + row.both_fail
