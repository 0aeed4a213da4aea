"""DuckDB SQL of the queries, on the same tables."""

from __future__ import annotations

from quire.plans.queries import NEEDLE, QUESTION, SAMPLES

#: Views that several queries begin with.
BLK = r"""blk AS (
  SELECT doc_id, i - 1 AS ord, parts[i] AS text,
    CASE WHEN NOT regexp_matches(parts[i], '\S') THEN 'blank'
         WHEN length(parts[i]) <= 80 AND NOT regexp_matches(parts[i], '[.!?;:,]$') THEN 'heading' ELSE 'text' END AS type
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d, LATERAL (SELECT unnest(generate_series(1, len(parts))) AS i) g)"""
TYPED = BLK + ", typed AS (SELECT * FROM blk WHERE type <> 'blank')"
EST = "(CASE WHEN length({t}) = 0 THEN 0 ELSE trunc(len(regexp_extract_all({t}, '[一-鿿]'))::DOUBLE / 1.6 + (length({t}) - len(regexp_extract_all({t}, '[一-鿿]')))::DOUBLE / 3.9)::BIGINT + 1 END)"
_PAIRS = "CASE WHEN length(w) = 1 THEN [w] ELSE list_transform(range(1, length(w)), lambda i: substr(w, i::INT, 2)) END"
TOKENS = rf"flatten(list_transform(regexp_extract_all({{t}}, '[A-Za-z][A-Za-z\-]{{{{1,}}}}|\d+(?:\.\d+)?|[一-鿿]+'), lambda w: CASE WHEN regexp_matches(w, '[一-鿿]') THEN {_PAIRS} ELSE [lower(w)] END))"
TURNS = "turns AS (SELECT conv_id AS doc_id, turn AS block_id, role, text FROM conversations)"
VARIANTS = "variants AS (SELECT user_id % 100 AS doc_id, event_id % 10 AS block_id, event_type AS provider, CASE WHEN value > 20 THEN 't' || event_id ELSE '' END AS text, CASE WHEN value > 90 THEN 'failed' ELSE 'ok' END AS quality, event_id AS seq FROM events)"
NOTES = "notes AS (SELECT user_id % 100 AS doc_id, event_id % 10 AS block_id, event_id AS id FROM events)"
USAGE = "usage AS (SELECT ts, CASE WHEN event_type IN ('click', 'view') THEN 'local' ELSE 'cloud' END AS provider, user_id AS tokens_in, event_id % 1000 AS tokens_out, floor(value)::BIGINT AS seconds FROM events)"
MARKS = "marks AS (SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, l_quantity AS x0, l_extendedprice AS y0 FROM lineitem)"
SAMPLE_ROWS = "lines AS (SELECT doc_id, ord, text FROM blk UNION ALL SELECT * FROM (VALUES " + ", ".join(f"(-1, {i}, '{t}')" for i, t in enumerate(SAMPLES)) + ") s(doc_id, ord, text))"
REPORT = r"""report AS (
  SELECT doc_id, sum(length(text))::BIGINT AS chars,
    sum(len(regexp_extract_all(text, '[\x{fffd}\x{25a1}\x{25a0}]')) + len(regexp_extract_all(text, '\(cid:\d+\)')))::BIGINT AS garbage,
    count(*) FILTER (type = 'text') AS paragraph_count, count(*) FILTER (type = 'heading') AS heading_count, count(DISTINCT ord // 10) AS page_count
  FROM blk GROUP BY doc_id),
rated AS (SELECT *, chars::DOUBLE / greatest(page_count, 1) / 2000 AS text_coverage, least(1.0, garbage::DOUBLE / greatest(chars, 1)) AS garbage_ratio FROM report)"""
GRIDS = """cells AS (SELECT n_regionkey::BIGINT AS doc_id, n_nationkey AS i, n_name AS a, r_name || ' <&> ''' || n_nationkey AS b FROM nation JOIN region ON n_regionkey = r_regionkey)"""
ESC = "replace(replace(replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
CHUNKS = rf"""costs AS (SELECT doc_id, ord, text, type, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS r, {EST.format(t="text")} + 24 AS cost FROM typed),
chunks AS (
  WITH RECURSIVE c(doc_id, ord, r, chunk_id, used) AS (
    SELECT doc_id, ord, r, 0::BIGINT, cost FROM costs WHERE r = 1
    UNION ALL
    SELECT n.doc_id, n.ord, n.r, CASE WHEN c.used + n.cost > {{budget}} THEN c.chunk_id + 1 ELSE c.chunk_id END, CASE WHEN c.used + n.cost > {{budget}} THEN n.cost ELSE c.used + n.cost END
    FROM c JOIN costs n ON n.doc_id = c.doc_id AND n.r = c.r + 1)
  SELECT doc_id, ord, chunk_id FROM c)"""


def _bm25(scope: str, k: int) -> str:
    from collections import Counter

    from quire.operators.retrieval import question_terms

    terms = Counter(question_terms(QUESTION))
    values = ", ".join(f"({i}, '{w}', {n})" for i, (w, n) in enumerate(terms.items()))
    part = f"PARTITION BY {scope}" if scope else ""
    col = f"{scope}, " if scope else ""
    on = f"USING ({scope})" if scope else "ON true"
    return f"""WITH q(i, w, times) AS (VALUES {values}),
units AS (SELECT doc_id, source, {TOKENS.format(t="text")} AS t FROM documents),
stats AS (SELECT {col}count(*) AS n, avg(len(t)) AS avg_len FROM units {f"GROUP BY {scope}" if scope else ""}),
tf AS (SELECT u.doc_id, u.source, q.i, q.times, len(list_filter(u.t, lambda x: x = q.w)) AS f, greatest(len(u.t), 1) AS len FROM units u, q),
df AS (SELECT {col}i, count(*) FILTER (f > 0) AS d FROM tf GROUP BY {col}i),
parts AS (SELECT tf.doc_id, tf.source, tf.i, tf.times * (ln(1 + (n - d + 0.5) / (d + 0.5)) * (f * 2.4::DOUBLE) / (f + 1.4::DOUBLE * (1 - 0.72::DOUBLE + 0.72::DOUBLE * len / avg_len))) AS s
  FROM tf JOIN df USING ({col}i) JOIN stats {on} WHERE f > 0),
scored AS (SELECT doc_id, source, sum(s ORDER BY i) AS s FROM parts GROUP BY doc_id, source),
ranked AS (SELECT *, row_number() OVER ({part} ORDER BY s DESC, doc_id) AS rank FROM scored WHERE s > 0)
SELECT {col}doc_id, round(s, 6) AS score, rank FROM ranked WHERE rank <= {k}"""


ORACLE_SQL: dict[str, str] = {
    "bm25_topk": _bm25("", 6),
    "bm25_topk_per_source": _bm25("source", 3),
    "tokenize_stats": f"WITH t AS (SELECT doc_id, {TOKENS.format(t='text')} AS t FROM documents) SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, coalesce(list_max(t), '') AS largest FROM t",
    "retrieval_text": f"""WITH {TURNS}, {VARIANTS}, good AS (SELECT * FROM variants WHERE regexp_matches(text, '\\S')),
own AS (SELECT doc_id, block_id, arg_max(text, seq) AS own FROM good WHERE provider = 'purchase' GROUP BY ALL),
any_ AS (SELECT doc_id, block_id, arg_max(text, seq) AS other FROM good GROUP BY ALL)
SELECT t.doc_id, t.block_id, coalesce(own, other, text) AS match_text FROM turns t LEFT JOIN own USING (doc_id, block_id) LEFT JOIN any_ USING (doc_id, block_id)""",
    "search_hits": f"WITH {TYPED} SELECT doc_id, ord FROM typed WHERE contains(lower(text), '{NEEDLE}')",
    "highlight": rf"SELECT doc_id, regexp_replace(text, '({NEEDLE})', '<mark>\1</mark>', 'gi') AS marked FROM documents",
    "token_estimate": f"SELECT doc_id, {EST.format(t='text')} AS tokens FROM documents",
    "doc_token_totals": f"SELECT lang, source, count(*) AS docs, sum({EST.format(t='text')})::BIGINT AS tokens FROM documents GROUP BY ALL",
    "select_translatable": rf"WITH {TYPED} SELECT doc_id, ord FROM typed WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 2 AND regexp_matches(text, '[A-Za-z一-鿿]')",
    "chunk_blocks": f"WITH {TYPED}, {CHUNKS.format(budget=300)} SELECT doc_id, ord, chunk_id FROM chunks",
    "chunk_estimate": f"""WITH {TYPED}, {CHUNKS.format(budget=1200)}, sums AS (SELECT (SELECT count(*) FROM typed) AS blocks, (SELECT count(DISTINCT (doc_id, chunk_id)) FROM chunks) AS chunks, (SELECT sum(cost - 24)::BIGINT FROM costs) AS text),
out AS (SELECT *, text + 700 * chunks AS tokens_in, trunc(text * 0.95::DOUBLE * 1.3::DOUBLE)::BIGINT AS tokens_out FROM sums)
SELECT blocks, chunks, tokens_in, tokens_out, tokens_in * 1.0::DOUBLE + tokens_out * 2.0::DOUBLE AS cost_micro, tokens_out // 30 + 2 * chunks AS seconds FROM out""",
    "context_window": f"WITH {TYPED} SELECT doc_id, ord, right(coalesce(string_agg(text, chr(10) ORDER BY ord) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ''), 1500) AS context FROM typed",
    "summary_pack": f"""WITH {TYPED}, sized AS (
  SELECT doc_id, ord, type, {EST.format(t="text")} AS cost, row_number() OVER (PARTITION BY doc_id, type ORDER BY ord) AS nth,
    greatest(1, trunc(count(*) FILTER (type = 'text') OVER (PARTITION BY doc_id) * 0.6::DOUBLE)) AS opening FROM typed),
parts AS (SELECT *, CASE WHEN type = 'heading' THEN 0 WHEN nth <= opening THEN 1 ELSE 3 END AS part FROM sized),
queue AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part, ord) AS r FROM parts),
picked AS (WITH RECURSIVE p(doc_id, ord, r, used, kept) AS (
    SELECT doc_id, ord, r, CASE WHEN part = 0 OR cost <= 500 THEN cost ELSE 0 END, part = 0 OR cost <= 500 FROM queue WHERE r = 1
    UNION ALL
    SELECT n.doc_id, n.ord, n.r, CASE WHEN n.part = 0 OR p.used + n.cost <= 500 THEN p.used + n.cost ELSE p.used END, n.part = 0 OR p.used + n.cost <= 500
    FROM p JOIN queue n ON n.doc_id = p.doc_id AND n.r = p.r + 1) SELECT * FROM p)
SELECT doc_id, ord FROM picked WHERE kept""",
    "summary_source": rf"WITH {TYPED} SELECT doc_id, string_agg('[' || type || '] ' || regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10) ORDER BY ord) AS source FROM typed GROUP BY doc_id",
    "budget_stop": f"""WITH {TYPED}, {CHUNKS.format(budget=300)}, sizes AS (SELECT doc_id, chunk_id, sum(cost - 24) AS cost FROM chunks JOIN costs USING (doc_id, ord) GROUP BY ALL),
open_ AS (SELECT doc_id, chunk_id, coalesce(sum(cost) OVER (PARTITION BY doc_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sizes)
SELECT doc_id, count(*) AS blocks FROM chunks JOIN open_ USING (doc_id, chunk_id) WHERE before <= 600 GROUP BY doc_id""",
    "table_flatten": f"WITH {GRIDS} SELECT doc_id, 'Name | Region' || chr(10) || string_agg(a || ' | ' || b, chr(10) ORDER BY i) AS flat FROM cells GROUP BY doc_id",
    # Borders of words are those between letters of any kind; the pattern engine knows ASCII ones, so other letters become "_".
    "candidate_terms": r"""WITH d AS (SELECT regexp_replace(text, '[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2C1}\x{370}-\x{373}\x{376}\x{377}\x{37B}-\x{37D}\x{37F}\x{386}\x{388}-\x{3FF}\x{400}-\x{481}\x{48A}-\x{52F}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}]', '_', 'g') AS text FROM documents),
found AS (
  SELECT unnest(list_filter(regexp_extract_all(text, '\b[A-Z][A-Za-z]*[A-Z][A-Za-z0-9\-]{1,12}\b'), lambda t: upper(t) NOT IN ('THE', 'AND', 'FOR', 'WITH'))) AS term FROM d
  UNION ALL
  SELECT trim(unnest(regexp_extract_all(text, '\b(?:[A-Z][a-z]{3,}\s){1,2}(?:[a-z]{4,}|[A-Z][a-z]{3,})\b'))) FROM d)
SELECT term, count(*) AS n FROM found GROUP BY term HAVING count(*) >= 2 ORDER BY n DESC, term LIMIT 80""",
    "mask_roundtrip": r"SELECT doc_id, regexp_replace(regexp_replace(text, '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS restored, 0::BIGINT AS issues FROM documents",
    "parse_report": f"WITH {BLK}, {REPORT} SELECT * FROM rated",
    "quality_score": f"""WITH {BLK}, {REPORT}, s AS (
  SELECT doc_id, greatest(0.0, least(100.0, 100.0::DOUBLE - least(40.0, garbage_ratio * 400) - CASE WHEN paragraph_count > 0 THEN 0 ELSE 30 END - CASE WHEN text_coverage > 0.02 THEN 0 ELSE 25 END))::DOUBLE AS score FROM rated)
SELECT doc_id, score, CASE WHEN score >= 80 THEN 'good' WHEN score >= 55 THEN 'fair' ELSE 'poor' END AS grade FROM s""",
    "dominant_mode": """WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS first FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED' GROUP BY ALL)
SELECT o_custkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, first) AS r FROM c) WHERE r = 1""",
    "usage_totals": f"WITH {USAGE} SELECT coalesce(sum(tokens_in) FILTER (provider = 'cloud'), 0)::BIGINT AS cloud_tokens_in, coalesce(sum(tokens_out) FILTER (provider = 'cloud'), 0)::BIGINT AS cloud_tokens_out, coalesce(sum(tokens_out) FILTER (provider = 'local'), 0)::BIGINT AS local_tokens_out, coalesce(sum(seconds) FILTER (provider = 'local'), 0)::BIGINT AS local_seconds FROM usage",
    "usage_cost": f"WITH {USAGE} SELECT provider, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, (sum(tokens_in) + 2 * sum(tokens_out))::BIGINT AS cost_micro FROM usage GROUP BY provider",
    "usage_windows": f"WITH {USAGE} SELECT epoch(date_trunc('hour', ts))::BIGINT AS start_s, provider, count(*) AS calls, sum(tokens_in + tokens_out)::BIGINT AS tokens FROM usage GROUP BY ALL",
    "quality_rollup": f"""WITH {TURNS}, {VARIANTS}, newest AS (SELECT doc_id, block_id, provider, arg_max(text, seq) AS text, arg_max(quality, seq) AS quality FROM variants GROUP BY ALL),
per AS (SELECT doc_id, block_id, bool_or(regexp_matches(text, '\\S')) AS has, arg_min(quality, provider) AS first FROM newest GROUP BY ALL)
SELECT t.doc_id, count(*) AS blocks, count(*) FILTER (has) AS translated, count(*) FILTER (first = 'ok') AS ok, count(*) FILTER (first = 'failed') AS failed FROM turns t LEFT JOIN per USING (doc_id, block_id) GROUP BY t.doc_id""",
    "label_rollup": "SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY lang",
    "hash_dedupe": "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "upsert_latest": f"WITH {VARIANTS} SELECT doc_id, block_id, provider, arg_max(text, seq) AS text, arg_max(quality, seq) AS quality, max(seq) AS seq FROM variants GROUP BY ALL",
    "upsert_locked_max": f"WITH {VARIANTS} SELECT doc_id, provider AS source, arg_max(text, seq) AS target, arg_max(quality, seq) AS note, max((seq % 50 = 0)::INT) AS locked FROM variants GROUP BY ALL",
    "cache_miss_antijoin": f"WITH {TURNS}, {VARIANTS} SELECT doc_id, block_id FROM turns t WHERE NOT EXISTS (SELECT 1 FROM variants v WHERE v.doc_id = t.doc_id AND v.block_id = t.block_id AND provider = 'purchase' AND quality <> 'failed' AND regexp_matches(v.text, '\\S'))",
    "cascade_delete": f"""WITH {TURNS}, {VARIANTS}, {NOTES}, gone AS (SELECT c_custkey AS doc_id FROM customer WHERE c_mktsegment = 'BUILDING'),
every AS (SELECT doc_id, 'blocks' AS kind FROM turns UNION ALL SELECT doc_id, 'translations' FROM variants UNION ALL SELECT doc_id, 'notes' FROM notes)
SELECT doc_id, count(*) AS n, kind FROM every e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = e.doc_id) GROUP BY ALL""",
    "blocks_with_variants": f"""WITH {TURNS}, {VARIANTS}, {NOTES}, newest AS (SELECT doc_id, block_id, provider, arg_max(text, seq) AS text FROM variants GROUP BY ALL),
shown AS (SELECT doc_id, block_id, string_agg(provider || '=' || text, ';' ORDER BY provider) AS translations FROM newest WHERE regexp_matches(text, '\\S') GROUP BY ALL),
counts AS (SELECT doc_id, block_id, count(*) AS n FROM notes GROUP BY ALL)
SELECT doc_id, block_id, coalesce(translations, '') AS translations, coalesce(n, 0)::BIGINT AS note_count FROM turns LEFT JOIN shown USING (doc_id, block_id) LEFT JOIN counts USING (doc_id, block_id)""",
    "note_counts": f"WITH {NOTES} SELECT doc_id, block_id, count(*) AS note_count FROM notes GROUP BY ALL",
    "extract_json": "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN props END AS json FROM events",
    "settings_cast": "SELECT event_id, (event_id % 3 = 1) OR event_id = -1 OR (event_id % 3 = 0 AND event_id::VARCHAR = '1') AS as_bool, CASE WHEN event_id % 3 = 0 THEN event_id ELSE -1 END AS as_int, CASE event_id % 3 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN 'Yes' ELSE 'x/y' END AS as_url FROM events",
    "caption_flags": rf"WITH {BLK}, {SAMPLE_ROWS} SELECT doc_id, ord, regexp_matches(text, '(?i)^\s*(figure|fig\.?|table|tab\.?|scheme|algorithm|listing)\s*\d+') AS caption FROM lines",
    "reference_flags": rf"WITH {BLK}, {SAMPLE_ROWS} SELECT doc_id, ord, regexp_matches(text, '^\s*(\[?\d{{1,3}}\]?[.)]?\s|[A-Z][a-z]+,\s+[A-Z]\.)') AS reference, regexp_matches(text, '(?i)^\s*(?:page\s+)?\d{{1,4}}\s*(?:of|/)\s*\d{{1,4}}\s*$') OR regexp_matches(text, '^\s*\d{{1,4}}\s*$') AS folio FROM lines",
    "section_heading_flags": rf"""WITH {BLK}, {SAMPLE_ROWS}, s AS (SELECT doc_id, ord, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM lines),
p AS (SELECT *, regexp_extract(s, '(?s)^(\d{{1,2}}(?:\.\d{{1,2}})*)(\.?)([\s.].*)$', 1) AS prefix, regexp_extract(s, '(?s)^(\d{{1,2}}(?:\.\d{{1,2}})*)(\.?)([\s.].*)$', 2) AS dot, trim(regexp_extract(s, '(?s)^(\d{{1,2}}(?:\.\d{{1,2}})*)(\.?)([\s.].*)$', 3)) AS rest FROM s),
w AS (SELECT *, regexp_extract(rest, '^\S+') AS word, len(string_split(prefix, '.')) AS levels FROM p)
SELECT doc_id, ord FROM w WHERE s <> '' AND length(s) <= 120
  AND NOT regexp_matches(s, '(?i)^(?:page\s+)?\d{{1,4}}\s*(?:of|/)\s*\d{{1,4}}$') AND NOT regexp_matches(s, '^\d{{1,4}}$') AND NOT regexp_matches(s, '(?i)^(figure|table|fig\.|tab\.)\s*\d')
  AND len(regexp_extract_all(s, '[A-Za-z一-鿿]')) >= 4 AND length(regexp_replace(s, '[^\pL\pN]+', '', 'g')) >= 6
  AND ((regexp_matches(s, '^[IVX]{{1,4}}[.)]?\s+\S') AND length(s) < 80)
    OR (prefix <> '' AND levels <= 3 AND NOT starts_with(prefix, '0.') AND regexp_matches(rest, '^[\pL\pN]') AND length(word) >= 2
      AND len(regexp_extract_all(word, '[A-Za-z]')) >= greatest(1, length(word) // 2) AND NOT regexp_matches(rest, '(?s)\d+(?:\.\d+)?\s*[a-zA-Z%]{{0,4}}\s*[,;].*\d') AND length(rest) >= 2
      AND (levels > 1 OR dot <> '' OR (regexp_matches(rest, '^\p{{Lu}}') AND lower(word) NOT IN ('january', 'february', 'march', 'april', 'may', 'june', 'july', 'august', 'september', 'october', 'november', 'december', 'and', 'or', 'of', 'the', 'in', 'on', 'at', 'for', 'with', 'to', 'by', 'cm', 'mm', 'kg', 'm', 's')))))""",
    "hyphen_repair": r"SELECT doc_id, trim(regexp_replace(replace(text, chr(10), ' '), '[ \t]{2,}', ' ', 'g')) AS text FROM documents",
    "running_branding": rf"""WITH {TYPED}, s AS (SELECT doc_id, ord, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM typed), c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM s)
SELECT doc_id, ord FROM c WHERE length(s) BETWEEN 8 AND 60 AND n >= 3 AND NOT ends_with(s, '.')""",
    "leading_meta_prefix": f"WITH {TYPED}, s AS (SELECT doc_id, ord, sum((type <> 'heading')::INT) OVER (PARTITION BY doc_id ORDER BY ord) AS seen FROM typed) SELECT doc_id, ord FROM s WHERE seen = 0",
    "outline": f"WITH {TYPED} SELECT doc_id, ord, 2::BIGINT AS level FROM typed WHERE type = 'heading'",
    "renumber": f"WITH {TYPED} SELECT doc_id, ord AS was, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS ord FROM typed",
    "mid_sentence_tails": rf"""WITH {TYPED}, s AS (SELECT doc_id, ord, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM typed)
SELECT doc_id, ord, length(s) >= 60 AND NOT regexp_matches(s, '[.。!！?？:：;；]\s*[»"”''’)\]]*$') AND (regexp_matches(right(s, 24), '[a-z,;]$')) AS cut FROM s""",
    "page_edge_join": r"""WITH d AS (SELECT doc_id, regexp_extract_all(replace(text, chr(10), ' '), '.{1,80}') AS l FROM documents),
lines AS (SELECT doc_id, i - 1 AS ord, l[i] AS text FROM d, LATERAL (SELECT unnest(generate_series(1, len(l))) AS i) g),
ends AS (SELECT doc_id, ord // 10 AS page, arg_max(text, ord) AS tail, arg_min(text, ord) AS head FROM lines GROUP BY ALL),
pairs AS (SELECT *, lead(head) OVER (PARTITION BY doc_id ORDER BY page) AS following, trim(tail) AS t FROM ends)
SELECT doc_id, page, length(tail) AS tail_chars, length(following) AS head_chars FROM pairs
WHERE following IS NOT NULL AND length(t) >= 60 AND NOT regexp_matches(t, '[.。!！?？:：;；]\s*[»"”''’)\]]*$') AND regexp_matches(right(t, 24), '[a-z,;]$') AND regexp_matches(ltrim(following), '^[a-z(\[]')""",
    "modal_start": f"WITH {MARKS}, c AS (SELECT a.k, a.x0, count(*) AS c FROM (SELECT DISTINCT k, x0 FROM marks) a JOIN marks b ON a.k = b.k AND abs(a.x0 - b.x0) <= 3 GROUP BY ALL) SELECT k, arg_min(x0, (-c, x0)) AS modal, max(c) AS n FROM c GROUP BY k",
    "x_clusters": f"""WITH {MARKS}, g AS (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY k ORDER BY x0) > 4 THEN 1 ELSE 0 END AS gap FROM marks),
c AS (SELECT k, x0, sum(gap) OVER (PARTITION BY k ORDER BY x0 RANGE UNBOUNDED PRECEDING)::BIGINT AS cluster FROM g) SELECT k, cluster, count(*) AS n, median(x0) AS middle FROM c GROUP BY ALL""",
    "row_runs": f"""WITH {MARKS}, g AS (SELECT *, x0 - lag(x0) OVER (PARTITION BY k ORDER BY x0) AS step FROM marks), distinct_ AS (SELECT k, n, x0, CASE WHEN step IS NULL OR step BETWEEN 2 AND 12 THEN 0 ELSE 1 END AS cut FROM g)
SELECT k, n, sum(cut) OVER (PARTITION BY k ORDER BY x0 RANGE UNBOUNDED PRECEDING)::BIGINT AS run FROM distinct_""",
    "line_steps": f"WITH {MARKS} SELECT k, n, y0 - lag(y0) OVER (PARTITION BY k ORDER BY n, y0) AS step FROM marks",
    "detect_gutter": """WITH b AS (SELECT l_suppkey AS page, CASE WHEN l_linenumber % 2 = 1 THEN 56.0 ELSE 310.0 END::DOUBLE AS x0, l_extendedprice % 700 AS y0, l_quantity AS w FROM lineitem),
box AS (SELECT page, x0, y0, x0 + 180 + w AS x1, y0 + 10 AS y1 FROM b),
n AS (SELECT page, count(*) AS n, count(*) FILTER (x0 = 56) AS a, count(*) FILTER (x0 = 310) AS b FROM box GROUP BY page),
sides AS (SELECT page, count(*) FILTER (x1 <= 311) AS l, count(*) FILTER (x0 >= 309) AS r, max(y1) FILTER (x1 <= 311) - min(y0) FILTER (x1 <= 311) AS ls, max(y1) FILTER (x0 >= 309) - min(y0) FILTER (x0 >= 309) AS rs FROM box GROUP BY page)
SELECT page, 310.0::DOUBLE AS gutter FROM n JOIN sides USING (page) WHERE n >= 10 AND a >= greatest(5, n * 0.15) AND b >= greatest(5, n * 0.15) AND l >= greatest(4, n * 0.1) AND r >= greatest(4, n * 0.12) AND least(ls, rs) >= 60""",
    "column_classes": """WITH r AS (SELECT l_suppkey AS page, l_quantity * 10 AS x0, l_quantity * 10 + l_linenumber * 30 AS x1, CASE WHEN l_suppkey % 3 <> 0 THEN 290.0 END AS g FROM lineitem),
c AS (SELECT page, g, CASE WHEN g IS NULL THEN 0 WHEN x0 < g - 1 AND x1 > g + 1 THEN -1 WHEN x1 <= g + 1 THEN 0 ELSE 1 END::BIGINT AS "column" FROM r),
a AS (SELECT *, count(*) FILTER ("column" = -1) OVER (PARTITION BY page) AS across, count(*) OVER (PARTITION BY page) AS n FROM c)
SELECT page, "column", CASE WHEN g IS NULL THEN 'single' WHEN across <= greatest(2, 0.15 * n) THEN 'double' ELSE 'mixed' END AS alignment, count(*) AS n FROM a GROUP BY ALL""",
    "nearest_caption": """WITH e AS (SELECT user_id % 50 AS page, event_id, event_type, value FROM events),
f AS (SELECT page, event_id AS figure, value * 10 AS y0, value * 10 + 20 AS y1 FROM e WHERE event_type = 'purchase'),
c AS (SELECT page, event_id AS ord, value * 10 AS y0, value * 10 + 5 AS y1 FROM e WHERE event_type = 'signup'),
g AS (SELECT f.page, figure, ord, greatest(c.y0 - f.y1, f.y0 - c.y1, 0.0) AS gap FROM f JOIN c USING (page)),
best AS (SELECT page, figure, arg_min(ord, (gap, ord)) AS ord FROM g WHERE gap < 90 GROUP BY ALL)
SELECT f.page, f.figure, 'c' || ord AS caption FROM f LEFT JOIN best USING (page, figure)""",
    "region_membership": """WITH l AS (SELECT l_suppkey % 20 AS page, l_orderkey AS k, l_linenumber::BIGINT AS n, l_quantity * 10 AS x0, l_discount * 1000 AS y0, row_number() OVER () AS rid FROM lineitem),
r AS (SELECT p_partkey % 20 AS page, min(p_partkey) AS region, (p_size * 8)::DOUBLE AS x0, 20.0::DOUBLE AS y0, (p_size * 8 + 90)::DOUBLE AS x1, 65.0::DOUBLE AS y1 FROM part GROUP BY ALL)
SELECT page, region, count(*) AS lines FROM (SELECT l.page, rid, min(region) AS region FROM l JOIN r USING (page)
WHERE greatest(0, least(l.x0 + 50, r.x1) - greatest(l.x0, r.x0)) * greatest(0, least(l.y0 + 10, r.y1) - greatest(l.y0, r.y0)) / greatest(1e-6, ((l.x0 + 50) - l.x0) * ((l.y0 + 10) - l.y0)) >= 0.55 GROUP BY ALL) GROUP BY ALL""",
    "table_html": f"WITH {GRIDS} SELECT doc_id, '<table class=\"doc-table\"><tr><th>Name</th><th>Region</th></tr>' || string_agg('<tr><td>' || {ESC.format(t='a')} || '</td><td>' || {ESC.format(t='b')} || '</td></tr>', '' ORDER BY i) || '</table>' AS html FROM cells GROUP BY doc_id",
    "pseudo_table_reject": f"""WITH {GRIDS}, r AS (SELECT doc_id, a, CASE WHEN doc_id % 2 = 0 THEN repeat(b, 9) ELSE b END AS b FROM cells UNION ALL SELECT DISTINCT doc_id, 'Name', CASE WHEN doc_id % 2 = 0 THEN repeat('Region', 9) ELSE 'Region' END FROM cells)
SELECT doc_id, count(*) FILTER (length(b) > 90) >= count(*) * 0.6 OR count(*) FILTER (regexp_matches(a, '[-=+<>^_{{}}|]')) >= greatest(2, count(*) * 0.5) AS pseudo FROM r GROUP BY doc_id""",
    "markdown_export": rf"WITH {TYPED} SELECT doc_id, string_agg(CASE WHEN type = 'heading' THEN '## ' ELSE '' END || regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10) || chr(10) ORDER BY ord) AS markdown FROM typed GROUP BY doc_id",
}
