"""DuckDB SQL for the operators that SQL can express."""

QUALITY = r"""
WITH w AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, ws[i:i + 7] AS g FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 6)) AS i)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), cover AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
          - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
         coalesce(cover.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cover ON cover.doc_id = w.doc_id
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 20 * word_chars OR n_dup_lines > 10
         OR word_chars < 2 * n_words OR word_chars > 20 * n_words AS fails_any FROM m
), hosts AS (
  SELECT host, count(*) AS n, count(*) FILTER (WHERE fails_any) AS k FROM f WHERE host IS NOT NULL GROUP BY host
), s AS (
  SELECT count(*) AS h, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, sum(n::DOUBLE * n) AS n2, sum(k / n::DOUBLE * k) AS kp FROM hosts
), r AS (
  SELECT *, k / n AS mean, n - n2 / n - (h - 1) AS room FROM s
), p AS (
  SELECT *, CASE WHEN mean IN (0, 1) OR room <= 0 THEN 1.0
    WHEN (kp - n * mean * mean) / (mean * (1 - mean)) - (h - 1) <= 0 THEN n
    ELSE least(greatest(room / ((kp - n * mean * mean) / (mean * (1 - mean)) - (h - 1)) - 1, 1.0), n) END AS weight FROM r
), v AS (
  SELECT host, (k + mean * weight) / (hosts.n + weight) AS rate FROM hosts, (SELECT mean, weight FROM p)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) AS host_rate,
       coalesce(rate > 0.5, false) AS host_rejected, NOT base_failed AND NOT coalesce(rate > 0.5, false) AS kept
FROM f LEFT JOIN v ON f.host = v.host
"""

MIXING = r"""
WITH b AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '') AS tie,
         (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM b GROUP BY source
), w AS (
  SELECT source, source_size, [3.0, 1.0, 2.0][(n - 1) % 3 + 1]::DOUBLE AS w, 1.5 * sum(source_size) OVER () AS total FROM s
), c AS (
  SELECT *, (total - coalesce(sum(2.0 * source_size) OVER before, 0)) / sum(w) OVER upward AS level, 2.0 * source_size / w AS mine
  FROM w WINDOW before AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                upward AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), l AS (
  SELECT coalesce(min_by(level, mine) FILTER (WHERE level < mine), 0.0)::DOUBLE AS level FROM c
), t AS (
  SELECT source, source_size, least(2.0 * source_size, w * l.level)::DOUBLE AS target FROM w, l
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM t
), d AS (
  SELECT b.*, source_size, target, floor(ratio) AS certain, target - floor(ratio) * source_size AS rest
  FROM b JOIN q ON b.source IS NOT DISTINCT FROM q.source
), z AS (
  SELECT source, size, any_value(rest) AS rest, count(*) AS n FROM d WHERE size > 0 AND rest > 0 GROUP BY source, size
), y AS (
  SELECT source, size, rest - coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS words,
         (sum(n * size * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS squares FROM z
), i AS (
  SELECT source, coalesce(max(size) FILTER (WHERE words / squares * size < 1), -1) AS cut,
         coalesce(max_by(words / squares, size) FILTER (WHERE words / squares * size < 1), 0.0) AS level,
         coalesce(max_by(words, size) FILTER (WHERE words / squares * size < 1), 0.0) AS words FROM y GROUP BY source
), r AS (
  SELECT d.*, coalesce(size > cut, false) AS sure, words,
         CASE WHEN size > 0 AND size <= cut AND level > 0 THEN (u / (1 - u)) / (level * size / (1 - level * size)) END AS odds
  FROM d LEFT JOIN i ON d.source IS NOT DISTINCT FROM i.source
), p AS (
  SELECT *, odds / (1 + odds) AS rank FROM r
), o AS (
  SELECT *, CASE WHEN rank IS NOT NULL THEN sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS upto FROM p
), k AS (
  SELECT *, rank IS NOT NULL AND (min(CASE WHEN upto > words THEN rank END) OVER (PARTITION BY source) IS NULL
                                  OR rank < min(CASE WHEN upto > words THEN rank END) OVER (PARTITION BY source)) AS drawn FROM o
), g AS (
  SELECT *, words - coalesce(max(CASE WHEN drawn THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM k
)"""

#: A document closes the draw that comes closest to what is missing, if that is closer than none.
_CLOSING = """, f{k} AS (
  SELECT *, coalesce(rank IS NOT NULL AND NOT drawn AND abs(size - gap) < gap, false) AS may FROM {before}
), x{k} AS (
  SELECT *, may AND row_number() OVER (PARTITION BY source, may ORDER BY abs(size - gap), rank, tie) = 1 AS closes FROM f{k}
), g{k} AS (
  SELECT * EXCLUDE (may, closes, drawn, gap), drawn OR closes AS drawn,
         gap - coalesce(max(CASE WHEN closes THEN size END) OVER (PARTITION BY source), 0) AS gap FROM x{k}
)"""

MIXING += "".join(_CLOSING.format(k=k, before=f"g{k - 1}" if k else "g") for k in range(3))
MIXING += """
SELECT doc_id, size, source_size, round(target, 6) AS target,
       ((certain + CASE WHEN sure OR drawn THEN 1 ELSE 0 END) * size)::BIGINT AS taken,
       (certain + CASE WHEN sure OR drawn THEN 1 ELSE 0 END)::BIGINT AS copies
FROM g2
"""

_COMPONENTS = """
, ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links), reach AS (
  SELECT x AS node, x AS other FROM ways UNION SELECT reach.node, ways.y FROM reach JOIN ways ON ways.x = reach.other
), part AS (SELECT node, min(other) AS component FROM reach GROUP BY 1)
"""

NEAR_COPIES = (
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w
), n AS (
  SELECT w.doc_id, count(s) AS n FROM w LEFT JOIN sh ON sh.doc_id = w.doc_id GROUP BY 1
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)
)"""
    + _COMPONENTS
    + """SELECT doc_id, n AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept FROM n LEFT JOIN part ON node = doc_id"""
)

VECTORS = (
    """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= 0.98
)"""
    + _COMPONENTS
    + """, n AS (SELECT x, count(*) AS n FROM ways GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN part ON node = vec_id LEFT JOIN n ON x = vec_id"""
)

SEARCH = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), total AS (
  SELECT count(*) FILTER (WHERE len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d
), each_term AS (
  SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d
), posting AS (
  SELECT doc_id, n, term, count(*) AS tf FROM each_term GROUP BY ALL
), asked AS (
  SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark
), weight AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM posting, total GROUP BY term
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN posting USING (term) JOIN weight USING (term), total GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
