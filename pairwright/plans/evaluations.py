"""SQL that queries' oracles share."""

from __future__ import annotations

#: Both variants' evaluations of the orders, by arithmetic on the key alone.
EVALUATIONS = """
WITH o AS (
  SELECT o_orderkey AS k, o_custkey AS custkey, o_orderpriority AS priority, o_orderstatus AS ostatus, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders
), raw AS (
  SELECT *, 'baseline' AS variant, CASE WHEN k % 97 = 0 THEN 'missing' WHEN k % 89 = 0 THEN 'error' ELSE 'ok' END AS status,
         CASE WHEN k % 97 = 0 THEN 'missing_output' WHEN k % 89 = 0 THEN 'timeout' END AS error_kind, k % 53 = 0 AS broken,
         k % 7 = 0 AS bad_priority, false AS no_status, k % 13 = 0 AS bad_cents, CASE WHEN k % 97 <> 0 THEN k % 1000 END AS latency_ms FROM o
  UNION ALL
  SELECT *, 'candidate', CASE WHEN k % 83 = 0 THEN 'error' ELSE 'ok' END, CASE WHEN k % 83 = 0 THEN 'provider' END, k % 59 = 0,
         k % 11 = 0, k % 19 = 0, k % 17 = 0, k % 1000 + k % 37 FROM o
), p AS (
  SELECT *, status = 'ok' AND NOT broken AS parse_valid FROM raw
), s AS (
  SELECT *, parse_valid AND NOT no_status AS schema_valid,
    CASE WHEN NOT parse_valid THEN 'error' WHEN bad_priority THEN 'failed' ELSE 'passed' END AS priority_state,
    CASE WHEN NOT parse_valid THEN 'error' WHEN no_status THEN 'failed' ELSE 'passed' END AS status_state,
    CASE WHEN NOT parse_valid THEN 'error' WHEN bad_cents THEN 'failed' ELSE 'passed' END AS cents_state,
    CASE WHEN status <> 'missing' THEN k % 500 END AS input_tokens, CASE WHEN status <> 'missing' THEN k % 200 END AS output_tokens, CASE WHEN status <> 'missing' THEN k % 3 END AS retries,
    CASE WHEN status = 'ok' THEN (k % 100)::DECIMAL(18,6) / 1000 END AS cost, CASE WHEN status = 'ok' THEN 'USD' END AS currency FROM p
), e AS (
  SELECT *, parse_valid AS fully_evaluated,
    CASE WHEN NOT parse_valid THEN 'error' WHEN bad_priority OR no_status OR bad_cents THEN 'false' ELSE 'true' END AS truth,
    CASE WHEN NOT parse_valid THEN 'error' WHEN bad_priority AND no_status AND bad_cents THEN 'false' ELSE 'true' END AS any_truth FROM s
), f AS (
  SELECT *, truth = 'true' AS semantic, truth = 'true' AND schema_valid AND fully_evaluated AND status = 'ok' AS deployed, schema_valid AND truth = 'false' AS wrong FROM e
), pr AS (
  SELECT b.k, b.custkey, b.semantic AS b, c.semantic AS c, b.deployed AS bd, c.deployed AS cd, b.wrong AS bw, c.wrong AS cw, b.truth AS bt, c.truth AS ct, b.parse_valid AS bp, c.parse_valid AS cp,
         b.schema_valid AS bs, c.schema_valid AS cs, b.status AS bst, c.status AS cst, c.error_kind AS cek, b.latency_ms AS bl, c.latency_ms AS cl, b.cost AS bc, c.cost AS cc, c.no_status AS c_no_status,
         b.bad_priority AS b_bp, c.bad_priority AS c_bp, b.bad_cents AS b_bc, c.bad_cents AS c_bc
  FROM f b JOIN f c ON b.k = c.k WHERE b.variant = 'baseline' AND c.variant = 'candidate'
)
"""
