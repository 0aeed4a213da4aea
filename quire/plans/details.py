"""Queries of single operators over the driver's tables, each beside its DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import chunking, export, layout, refine, regions, report, retrieval, store, terms, translate
from quire.plans.oracle import ORACLE_SQL as SQL
from quire.plans.oracle import BLK, MARKS, SAMPLE_ROWS, TOKENS, TURNS, TYPED, USAGE, VARIANTS
from quire.plans.queries import QUESTION, _blocks, _lines_with_samples, _turns, _typed, _usage, _variants
from quire.sources import adapters
from quire.sources.adapters import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _re(pattern: str) -> str:
    """A pattern as SQL text: flags and classes as that engine spells them."""
    p = re.sub(r"^\(\?([a-zA-Z]+)\)", lambda m: "(?i)" if "i" in m[1] else "", pattern)
    p = re.sub(r"\\u([0-9a-fA-F]{4})", r"\\x{\1}", p).replace(r"[\w\\]", r"[\pL\pN_\\]").replace(r"(\w)", r"[\pL\pN_]")
    return "'" + p.replace("'", "''") + "'"


def _has(pattern: str, of: str = "text") -> str:
    return f"regexp_matches({of}, {_re(pattern)})"


def _n(pattern: str, of: str) -> str:
    return f"len(regexp_extract_all({of}, {_re(pattern)}))"


# ---- Lines ----

_STRIPPED = rf"s AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM lines)"
_SYMBOLS = f"({_n(T.MATH_CHARS, 's')} + {_n(T.MATH_GLYPH, 's')})"
_FORMULA = f"""(CASE WHEN s = '' THEN false WHEN length(s) <= 3 AND {_has(T.MATH_GLYPH, "s")} THEN true WHEN length(s) > 110 THEN false WHEN {_has(T.EQUATION_NUMBER, "s")} THEN true
  ELSE {_SYMBOLS} > 0 AND NOT ({_n("[A-Za-z]{3,}", "s")} >= 3 AND {_n("[A-Za-z]", "s")} >= 18) AND {_SYMBOLS} >= 2 AND {_SYMBOLS}::DOUBLE / greatest(length(s), 1) >= 0.12 END)"""
_PROSE = f"(s <> '' AND NOT {_FORMULA} AND {_n('[A-Za-z]{2,}', 's')} >= 4 AND length(s) >= 30)"
_FOLIO = rf"({_has(T.PAGE_NUMBER, 's')} OR {_has(T.FOLIO_ONLY, 's')})"
_LINES = f"WITH {BLK}, {SAMPLE_ROWS}, {_STRIPPED}"


@query(f"{_LINES} SELECT doc_id, ord, {_has(T.HYPHEN_END)} AS hyphen, {_has(T.FORMULA_HINT)} AND length(text) < 220 AND NOT {_PROSE} AS hint, {_FORMULA} AS formula, {_PROSE} AS prose FROM s")
def formula_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _lines_with_samples(spark, sf_dir).select("doc_id", "ord", T.ends_in_hyphen(t).alias("hyphen"), T.hints_formula(t).alias("hint"), T.is_formula_line(t).alias("formula"), T.is_prose(t).alias("prose"))


@query(
    f"""{_LINES} SELECT doc_id, ord, {_has(T.META_LABEL)} OR {_has(T.META_INLINE)} AS meta, {_has("^(?:" + T.CITATION_FRAGMENT + ")", "left(s, 90)")} AS citation,
  {_has("(?i)^(?:" + T.RAIL_LABEL + ")")} AS rail, {_has(T.FRONT_MATTER_HEADING)} AS front, lower(s) IN ({", ".join(f"'{x}'" for x in T.STRUCTURAL_LABELS)}) AS structural FROM s"""
)
def metadata_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _lines_with_samples(spark, sf_dir).select("doc_id", "ord", T.is_meta_label(t).alias("meta"), T.starts_citation(t).alias("citation"), T.starts_rail(t).alias("rail"), T.is_front_matter(t).alias("front"), T.is_structural_label(t).alias("structural"))


@query(
    rf"""{_LINES} SELECT doc_id, ord,
  s <> '' AND length(s) <= 28 AND (regexp_matches(s, '^[\(\[]?[A-Za-z0-9]{{1,3}}[\)\].]?$') OR (len(regexp_split_to_array(s, '\s+')) <= 4 AND NOT regexp_matches(s, '[.!?;:]') AND length(s) <= 24)) AS label,
  s <> '' AND length(s) <= 90 AND ({_FOLIO} OR NOT regexp_matches(s, '^[a-z(\[]')) AS head FROM s"""
)
def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _lines_with_samples(spark, sf_dir).select("doc_id", "ord", T.is_figure_label(t).alias("label"), T.is_running_head(t, F.lit(80.0)).alias("head"))


@query(
    rf"""WITH {TYPED}, s AS (SELECT doc_id, ord, type, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s, text FROM typed)
SELECT doc_id, ord, type = 'text' AND length(s) >= 10 AND max((regexp_matches(s, '(?i)^(references|bibliography)$'))::INT) OVER (PARTITION BY doc_id ORDER BY ord) = 0 AND {_has("^(?:" + T.CITATION_FRAGMENT + ")", "left(s, 90)")} AS rail FROM s"""
)
def rail_splinters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = refine.isolate_rails(_typed(spark, sf_dir))
    return rows.select("doc_id", F.col("ord").cast("long").alias("ord"), (F.col("type") == "meta").alias("rail"))


#: A document's running heads, in the order of its lines.
HEADS = tuple(f"{'Journal of Field Methods' if i % 4 == 0 else f'Body number {i} goes on'}" for i in range(20))


@query(
    rf"""WITH {TYPED}, every AS (SELECT doc_id, ord, text FROM typed UNION ALL SELECT * FROM (VALUES {", ".join(f"(-2, {i}, '{t}')" for i, t in enumerate(HEADS))}) v(doc_id, ord, text)),
s AS (SELECT doc_id, ord, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM every), c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM s)
SELECT doc_id, ord FROM c WHERE length(s) BETWEEN 8 AND 60 AND n >= 3 AND NOT ends_with(s, '.')"""
)
def running_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _typed(spark, sf_dir).select("doc_id", F.col("ord").cast("long").alias("ord"), "text")
    more = spark.createDataFrame([(-2, i, t) for i, t in enumerate(HEADS)], "doc_id long, ord long, text string")
    rows = own.unionByName(more).withColumns({"size": F.lit(10.0), "flags": F.array().cast("array<string>"), "type": F.lit("text")})
    return refine.demote_branding(rows).where("type = 'header'").select("doc_id", "ord")


# ---- Blocks ----


@query(f"WITH {BLK} SELECT doc_id, ord FROM blk WHERE type IN ('heading', 'text')")
def kinds_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.of_types(_blocks(spark, sf_dir), "heading, text,").select("doc_id", F.col("ord").cast("long").alias("ord"))


@query("WITH b AS (SELECT l_suppkey AS page, l_orderkey AS k, l_quantity AS x0, l_extendedprice AS y0 FROM lineitem) SELECT k, round(x0 * 720 / 595, 6) AS left_, round(y0 * 720 / 595, 6) AS top FROM b WHERE page = 3")
def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.struct(F.col("l_quantity").alias("x0"), F.col("l_extendedprice").alias("y0"), F.col("l_quantity").alias("x1"), F.col("l_extendedprice").alias("y1"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_orderkey").alias("k"), box.alias("bbox"))
    out = layout.on_page(rows, 3, F.lit(595.0))
    return out.select("k", F.round(F.col("shown")[0], 6).alias("left_"), F.round(F.col("shown")[1], 6).alias("top"))


@query(
    """WITH l AS (SELECT doc_id, length(text) % 30 + 5 AS size, text, ord FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS ord FROM documents))
SELECT doc_id, ord, coalesce(CASE WHEN size / 10.0 >= 1.6 THEN 1 WHEN size / 10.0 >= 1.25 THEN 2
  WHEN regexp_matches(text, '^\\s*\\d{1,2}(?:\\.\\d{1,2})*\\.?\\s') THEN least(3, greatest(2, len(string_split(regexp_extract(text, '^\\s*(\\d{1,2}(?:\\.\\d{1,2})*)', 1), '.'))))
  WHEN length(text) < 60 THEN 3 END, 0)::BIGINT AS level FROM l"""
)
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = (F.length("text") % 30 + 5).cast("double")
    return _blocks(spark, sf_dir).select("doc_id", F.col("ord").cast("long").alias("ord"), F.coalesce(layout.heading_level(F.col("text"), size, F.lit(10.0)), F.lit(0)).cast("long").alias("level"))


@query(
    """WITH e AS (SELECT user_id % 50 AS page, event_id, event_type, value FROM events), f AS (SELECT page, event_id, value * 2 AS x0, value AS y0, value * 2 + value AS x1, value + 60 AS y1 FROM e WHERE event_type = 'purchase'),
t AS (SELECT page, value * 2 AS x0, value AS y0, value * 2 + 90 AS x1, value + 50 AS y1 FROM e WHERE event_type = 'error' AND value > 120),
x AS (SELECT page, value AS x0, value * 2 AS y0, value + 200 AS x1, value * 2 + 70 AS y1 FROM e WHERE event_type = 'signup' AND value > 90),
big AS (SELECT * FROM f WHERE x1 - x0 >= 8 AND y1 - y0 >= 8 AND (x1 - x0) * (y1 - y0) >= 250000 * 0.012)
SELECT page, event_id FROM big b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.page = b.page AND greatest(0, least(b.x1, t.x1) - greatest(b.x0, t.x0)) / (b.x1 - b.x0) > 0.5 AND greatest(0, least(b.y1, t.y1) - greatest(b.y0, t.y0)) / (b.y1 - b.y0) > 0.5)
  AND NOT EXISTS (SELECT 1 FROM x WHERE x.page = b.page AND greatest(0, least(b.x1, x.x1) - greatest(b.x0, x.x0)) / (b.x1 - b.x0) > 0.6 AND greatest(0, least(b.y1, x.y1) - greatest(b.y0, x.y0)) / (b.y1 - b.y0) > 0.8)"""
)
def figure_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as images, tables and texts on pages: which images are figures."""
    e = table(spark, sf_dir, "events").select(F.lit("d").alias("doc_id"), (F.col("user_id") % 50).cast("int").alias("page"), "event_id", "event_type", F.col("value").alias("v"))
    box = lambda df, x0, y0, x1, y1: df.select("doc_id", "page", "event_id", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    v = F.col("v")
    images = box(e.where("event_type = 'purchase'"), v * 2, v, v * 2 + v, v + 60)
    tables = box(e.where("event_type = 'error' AND v > 120"), v * 2, v, v * 2 + 90, v + 50)
    texts = box(e.where("event_type = 'signup' AND v > 90"), v, v * 2, v + 200, v * 2 + 70)
    captions = texts.select("doc_id", "page", F.col("event_id").alias("ord"), "y0", "y1", F.lit("c").alias("text")).limit(0)
    return regions.figures(images, tables, texts, captions, F.lit(250000.0)).select(F.col("page").cast("long").alias("page"), "event_id")


@query(
    f"""WITH {MARKS}, w AS (SELECT *, x0 * 10 AS left_, x0 * 10 + y0 / 100 AS right_ FROM marks), q AS (SELECT k, list_sort(list(right_ - left_)) AS l FROM w GROUP BY k),
wide AS (SELECT k, l[(floor(len(l) * 0.75) + 1)::INT] AS wide FROM q), lines AS (SELECT w.k, left_ FROM w JOIN wide USING (k) WHERE wide >= 120 AND right_ - left_ >= wide * 0.5),
c AS (SELECT a.k, a.left_, count(*) AS c FROM (SELECT DISTINCT k, left_ FROM lines) a JOIN lines b ON a.k = b.k AND abs(a.left_ - b.left_) <= 3 GROUP BY ALL) SELECT k, arg_min(left_, (-c, left_)) AS margin FROM c GROUP BY k"""
)
def column_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_quantity") * 10).alias("x0"), (F.col("l_quantity") * 10 + F.col("l_extendedprice") / 100).alias("x1"))
    return layout.margin(rows, ["k"])


@query(
    """WITH r AS (SELECT l_suppkey AS page, l_quantity AS w, l_linenumber % 2 AS c FROM lineitem), m AS (SELECT page, c, median(w * CASE WHEN page % 2 = 0 AND c = 1 THEN 0.3 ELSE 1 END) AS m FROM r GROUP BY ALL)
SELECT page, c::BIGINT AS side FROM m WHERE c > 0 AND m < 0.62 * (SELECT max(m) FROM m n WHERE n.page = m.page)"""
)
def narrow_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    column = (F.col("l_linenumber") % 2).alias("column")
    width = F.col("l_quantity") * F.when((F.col("l_suppkey") % 2 == 0) & (F.col("l_linenumber") % 2 == 1), 0.3).otherwise(1.0)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), column, F.lit("double").alias("alignment"), F.lit(0.0).alias("x0"), width.alias("x1"))
    return layout.side_columns(rows, ["page"]).select("page", F.col("side").cast("long").alias("side"))


@query("SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, CASE WHEN l_quantity * 12 < greatest(1.0, 595 - 170) * 0.55 THEN -1 ELSE 1 END::BIGINT AS \"column\" FROM lineitem")
def rail_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n"), F.lit(0.0).alias("x0"), (F.col("l_quantity") * 12).alias("x1"))
    return layout.split_rail(rows, F.lit(170.0), F.lit(595.0)).select("k", "n", F.col("column").cast("long").alias("column"))


# ---- Spans and recognised words ----

_SPANS = """spans AS (SELECT l_orderkey AS page, l_linenumber AS block_no, l_suppkey % 3 AS line_no, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_suppkey % 3 ORDER BY l_partkey, l_extendedprice) AS span_no,
  l_returnflag || l_partkey AS text, l_quantity AS x0, l_extendedprice AS y0, l_quantity + 20 AS x1, l_extendedprice + 10 AS y1, l_tax * 100 AS size, CASE WHEN l_returnflag = 'A' THEN 'Times-Bold' ELSE 'Times' END AS font, l_partkey * 1000 AS color FROM lineitem)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    own = Window.partitionBy("l_orderkey", "l_linenumber", F.col("l_suppkey") % 3).orderBy("l_partkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.lit("d").alias("doc_id"), F.col("l_orderkey").alias("page"), F.lit(595.0).alias("page_width"), F.lit(842.0).alias("page_height"), F.col("l_linenumber").alias("block_no"), (F.col("l_suppkey") % 3).alias("line_no"),
        F.row_number().over(own).alias("span_no"), F.concat("l_returnflag", "l_partkey").alias("text"), F.lit(None).cast("array<struct<c:string>>").alias("chars"), F.col("l_quantity").alias("x0"), F.col("l_extendedprice").alias("y0"),
        (F.col("l_quantity") + 20).alias("x1"), (F.col("l_extendedprice") + 10).alias("y1"), (F.col("l_tax") * 100).alias("size"), F.when(F.col("l_returnflag") == "A", "Times-Bold").otherwise("Times").alias("font"), F.lit(0).alias("flags"), (F.col("l_partkey") * 1000).cast("int").alias("color"),
    )


@query(
    f"""WITH {_SPANS}, l AS (SELECT page, string_agg(text, '' ORDER BY span_no) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(size) AS size, bool_or(font = 'Times-Bold') AS bold,
  avg(((color::BIGINT >> 16) & 255) / 255.0::DOUBLE) AS red, avg(((color::BIGINT >> 8) & 255) / 255.0::DOUBLE) AS green FROM spans GROUP BY page, block_no, line_no)
SELECT page, text, x0, y0, x1, round(size, 6) AS size, bold, round(red, 6) AS red, round(green, 6) AS green FROM l"""
)
def span_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = layout.lines(_spans(spark, sf_dir))
    return out.select("page", "text", "x0", "y0", "x1", F.round("size", 6).alias("size"), "bold", F.round("colour.r", 6).alias("red"), F.round("colour.g", 6).alias("green"))


@query(
    f"""WITH {_SPANS}, m AS (SELECT *, CASE WHEN (font = 'Times-Bold') = lag(font = 'Times-Bold') OVER w THEN 0 ELSE 1 END AS cut FROM spans WINDOW w AS (PARTITION BY page, block_no, line_no ORDER BY span_no)),
r AS (SELECT *, sum(cut) OVER (PARTITION BY page, block_no, line_no ORDER BY span_no) AS run FROM m) SELECT page, run::BIGINT - 1 AS run, font = 'Times-Bold' AS bold, string_agg(text, '' ORDER BY span_no) AS text FROM r GROUP BY page, block_no, line_no, run, font"""
)
def span_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = layout.lines(_spans(spark, sf_dir)).select("page", F.posexplode("runs").alias("run", "r"))
    return out.select("page", F.col("run").cast("long").alias("run"), F.col("r.bold").alias("bold"), F.col("r.text").alias("text"))


@query(
    f"""WITH {_SPANS}, m AS (SELECT *, CASE WHEN x0 - lag(x1) OVER w < 6 THEN 0 ELSE 1 END AS cut FROM spans WINDOW w AS (PARTITION BY page, block_no, line_no ORDER BY span_no)),
r AS (SELECT *, sum(cut) OVER (PARTITION BY page, block_no, line_no ORDER BY span_no) AS cell FROM m) SELECT page, cell::BIGINT - 1 AS cell, arg_min(x0, span_no) AS x0, arg_max(x1, span_no) AS x1, string_agg(text, '' ORDER BY span_no) AS text FROM r GROUP BY page, block_no, line_no, cell"""
)
def span_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = layout.lines(_spans(spark, sf_dir)).select("page", F.posexplode("cells").alias("cell", "c"))
    return out.select("page", F.col("cell").cast("long").alias("cell"), F.col("c.x0").alias("x0"), F.col("c.x1").alias("x1"), F.col("c.text").alias("text"))


@query(
    """WITH w AS (SELECT l_suppkey AS page, l_returnflag || ' ' || l_partkey AS text, l_tax * 10 + 0.2 AS conf, l_quantity * 72 / 200 AS x0, (l_quantity + l_linenumber * 12) * 72 / 200 - l_quantity * 72 / 200 AS h FROM lineitem), k AS (SELECT * FROM w WHERE conf >= 0.5),
p AS (SELECT page, median(h) AS m, avg(conf) AS c FROM k GROUP BY page) SELECT page, text, round(x0, 6) AS x0, round(least(20.0, greatest(7.0, m * 0.78)), 6) AS size, round(c, 6) AS page_conf FROM k JOIN p USING (page)"""
)
def recognised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    words = table(spark, sf_dir, "lineitem").select(F.lit("d").alias("doc_id"), F.col("l_suppkey").alias("page"), F.concat("l_returnflag", F.lit("  "), "l_partkey", F.lit(" ")).alias("text"), (F.col("l_tax") * 10 + 0.2).alias("conf"), q.alias("x0"), q.alias("y0"), q.alias("x1"), (q + F.col("l_linenumber") * 12).alias("y1"), F.lit(200).alias("dpi"))
    return adapters.ocr_rows(words).select("page", "text", F.round("x0", 6).alias("x0"), F.round("size", 6).alias("size"), F.round("page_conf", 6).alias("page_conf"))


@query(
    """WITH p AS (SELECT o_custkey AS page, count(*) * 60 AS chars, sum(o_totalprice) AS area FROM orders GROUP BY 1) SELECT page, round(least(1.0, area / 2000000), 6) AS image_coverage, chars < 240 AND least(1.0, area / 2000000) >= 0.35 AS ocr FROM p"""
)
def pages_to_recognise(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page")).agg((F.count(F.lit(1)) * 60).alias("chars"), F.sum("o_totalprice").alias("image_area"))
    return adapters.needs_ocr(pages.withColumn("page_area", F.lit(2_000_000.0))).select("page", F.round("image_coverage", 6).alias("image_coverage"), "ocr")


@query("SELECT c_custkey, array_to_string(list_filter([trim(c_name), trim(c_mktsegment), 'nation ' || c_nationkey], lambda x: x <> ''), '|') AS names FROM customer")
def author_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = F.concat("c_name", F.lit(" ; ,"), "c_mktsegment", F.lit(" and nation "), F.col("c_nationkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(adapters.authors_of(field), "|").alias("names"))


# ---- Stores, reports ----


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, (props->>'k')::BIGINT AS k FROM events")
def event_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", adapters.iso_time(F.col("ts")).alias("at"), F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT event_id, ((event_id * 7 - 3) % 11 + 11) % 11 AS hit FROM events")
def search_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", retrieval.cycle(F.col("event_id") * 7, -3, F.lit(11)).cast("long").alias("hit"))


@query("WITH f AS (SELECT sha256(text) AS sha256, doc_id FROM documents), k AS (SELECT DISTINCT sha256 FROM f JOIN labels USING (doc_id)) SELECT sha256, min(lpad(doc_id::VARCHAR, 9, '0')) AS path FROM f WHERE sha256 NOT IN (SELECT sha256 FROM k) GROUP BY 1")
def files_not_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(adapters.content_hash("text").alias("sha256"), "doc_id", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"))
    known = files.join(table(spark, sf_dir, "labels"), "doc_id").select("sha256")
    return store.new_content(files, known).select("sha256", "path")


@query("SELECT doc_id, source, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)")
def deleted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "labels").where("toxic = 1")
    return store.delete(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), gone, ["doc_id"])


@query(f"WITH {USAGE}, t AS (SELECT coalesce(sum(tokens_in) FILTER (provider = 'cloud'), 0) AS a, coalesce(sum(tokens_out) FILTER (provider = 'cloud'), 0) AS b, coalesce(sum(tokens_out) FILTER (provider = 'local'), 0) AS c, coalesce(sum(seconds) FILTER (provider = 'local'), 0) AS d FROM usage) SELECT a::BIGINT AS cloud_tokens_in, b::BIGINT AS cloud_tokens_out, c::BIGINT AS local_tokens_out, d::DOUBLE AS local_seconds, round(a / 1000000::DOUBLE + b / 1000000::DOUBLE * 2, 4) AS cost FROM t")
def usage_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.usage_response(report.usage_totals(_usage(spark, sf_dir)))


@query("SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def newest_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts")
    return report.newest(rows, "ts").select("id", adapters.iso_time(F.col("ts")).alias("at"))


@query(f"WITH {VARIANTS} SELECT doc_id, count(*) AS blocks, count(*) FILTER (quality = 'ok') AS ok, 0::BIGINT AS suspect, count(*) FILTER (quality = 'failed') AS failed, sum(length(text))::BIGINT AS tokens_in, sum(block_id)::BIGINT AS tokens_out FROM variants GROUP BY doc_id")
def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _variants(spark, sf_dir).withColumns({"tokens_in": F.length("text").cast("long"), "tokens_out": F.col("block_id")})
    return report.run_counters(rows)


@query(
    f"""WITH {BLK}, g AS (SELECT doc_id, sum(length(text))::BIGINT AS chars, count(DISTINCT ord // 10) AS pages FROM blk GROUP BY doc_id), p AS (SELECT DISTINCT doc_id, ord // 10 AS page, ord // 10 % 3 = doc_id % 3 AS ocr FROM blk),
o AS (SELECT doc_id, count(*) AS n, count(*) FILTER (ocr) AS ocr_pages, avg(CASE WHEN ocr THEN (page % 5) / 10.0::DOUBLE + 0.5 END) AS c FROM p GROUP BY doc_id),
a AS (SELECT doc_id, CASE WHEN page % 2 = 0 THEN 'single' ELSE 'double' END AS alignment, count(*) AS n, min(page) AS f FROM p GROUP BY ALL), d AS (SELECT doc_id, arg_min(alignment, (-n, f)) AS alignment FROM a GROUP BY doc_id)
SELECT doc_id, ocr_pages, round(c, 3) AS ocr_confidence, CASE WHEN ocr_pages = 0 THEN 'text-layer' WHEN ocr_pages >= greatest(1, floor(n * 0.5)) THEN 'ocr' ELSE 'text-layer+ocr' END AS channel, alignment FROM g JOIN o USING (doc_id) JOIN d USING (doc_id)"""
)
def report_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir).withColumn("page", F.floor(F.col("ord") / 10))
    pages = blocks.select("doc_id", "page").distinct().withColumns({"ocr": F.col("page") % 3 == F.col("doc_id") % 3, "alignment": F.when(F.col("page") % 2 == 0, "single").otherwise("double"), "ocr_confidence": F.col("page") % 5 / 10.0 + 0.5})
    return report.parse_report(blocks, pages).select("doc_id", "ocr_pages", "ocr_confidence", "channel", "alignment")


@query(
    """WITH e AS (SELECT event_id, value / 1000 AS g, event_id % 4 AS p, value / 5000 AS c, event_id % 60 AS o, (event_id % 10) / 10.0::DOUBLE AS k, event_id % 3 AS w FROM events)
SELECT event_id, round(greatest(0.0, least(100.0, 100 - least(40, g * 400) - CASE WHEN p > 0 THEN 0 ELSE 30 END - CASE WHEN c > 0.02 THEN 0 ELSE 25 END - CASE WHEN o > 0 THEN least(20, 4 + 0.06 * o) ELSE 0 END
  - CASE WHEN o > 0 AND k > 0 AND k < 0.85 THEN least(15, (0.85 - k) * 60) ELSE 0 END - 5 * w)), 6) AS score FROM e"""
)
def recognition_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    score = report.quality_score(v / 1000, i % 4, v / 5000, i % 60, (i % 10) / 10.0, i % 3)
    return table(spark, sf_dir, "events").select("event_id", F.round(score, 6).alias("score"))


@query("SELECT event_type AS key, CASE WHEN event_type = 'click' THEN 'true' ELSE max(props) END AS value FROM events WHERE event_type IN ('view', 'error', 'click') GROUP BY event_type")
def stored_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key")).agg(F.max("props").alias("value"))
    blank = spark.createDataFrame([("error2", " "), ("view2", None)], "key string, value string")
    return store.visible_settings(rows.unionByName(blank), ["view", "error", "error2", "view2"], ["click"])


@query("SELECT 'k' || event_id AS key, CASE event_id % 3 WHEN 0 THEN (event_id % 5)::VARCHAR ELSE 'old' END AS value, event_id % 3 = 0 AS changed FROM events WHERE event_id < 30")
def overridden_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty settings, of which every third is overridden by a number, and others by what is none."""
    rows = spark.range(30)
    settings = rows.select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.lit("old").alias("value"))
    changes = rows.select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.when(F.col("id") % 3 == 0, (F.col("id") % 5).cast("string")).otherwise("none").alias("value"))
    return store.apply_overrides(settings, changes, {f"k{i}": "int" for i in range(30)})


# ---- Terms, contexts, rendering ----

_GOOD_TERMS = "SELECT user_id % 100 AS doc_id, left(event_type, (event_id % 9)::INT) AS source, CASE WHEN event_id % 4 = 0 THEN '' ELSE 't' || event_id END AS target, repeat(event_type, 60) AS note, event_id AS pos FROM events"


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    target = F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("t"), i.cast("string")))
    return table(spark, sf_dir, "events").select((F.col("user_id") % 100).alias("doc_id"), F.substring(F.col("event_type"), F.lit(1), (i % 9).cast("int")).alias("source"), target.alias("target"), F.repeat("event_type", 60).alias("note"), i.alias("pos"))


@query(f"WITH r AS ({_GOOD_TERMS}), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM r WHERE length(source) > 1 AND length(source) <= 80 AND trim(target) <> '') SELECT doc_id, source, target, left(note, 200) AS note FROM k WHERE n <= 30")
def glossary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.usable_terms(_replies(spark, sf_dir))


@query(f"WITH {VARIANTS}, g AS (SELECT doc_id, provider AS source, arg_max(text, seq) AS target FROM variants GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY source) AS n FROM g) SELECT doc_id, string_agg(source || ' = ' || target, chr(10) ORDER BY n) AS glossary FROM k WHERE n <= 120 GROUP BY doc_id")
def glossary_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    glossary = _variants(spark, sf_dir).groupBy("doc_id", F.col("provider").alias("source")).agg(F.max_by("text", "seq").alias("target"))
    return terms.glossary_lines(glossary)


@query(
    f"""WITH {TURNS}, chosen AS (SELECT doc_id, block_id::VARCHAR AS id, block_id AS page, text, block_id + 1 AS position FROM turns), cited AS (SELECT user_id AS doc_id, (event_id % 10)::VARCHAR AS id, CASE WHEN event_id % 2 = 0 THEN 'q' || event_id END AS quote FROM events WHERE user_id % 2 = 0),
good AS (SELECT c.doc_id, c.id, h.page, coalesce(c.quote, left(h.text, 160)) AS quote FROM cited c JOIN chosen h USING (doc_id, id))
SELECT * FROM good UNION ALL SELECT doc_id, id, page, left(text, 160) FROM chosen WHERE position <= 3 AND doc_id NOT IN (SELECT doc_id FROM good)"""
)
def cited_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = _turns(spark, sf_dir).select("doc_id", F.col("block_id").cast("string").alias("id"), F.col("block_id").alias("page"), "text", (F.col("block_id") + 1).alias("position"))
    i = F.col("event_id")
    cited = table(spark, sf_dir, "events").where("user_id % 2 = 0").select(F.col("user_id").alias("doc_id"), (i % 10).cast("string").alias("id"), F.when(i % 2 == 0, F.concat(F.lit("q"), i.cast("string"))).alias("quote"))
    return retrieval.evidence(cited, chosen)


def _with_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir).withColumn("translation", F.when(F.col("ord") % 3 == 0, F.concat(F.lit("T "), F.substring("text", 1, 20))).when(F.col("ord") % 3 == 1, F.lit("  ")))


_TRANSLATED = rf"{TYPED}, t AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS own, CASE WHEN ord % 3 = 0 THEN regexp_replace('T ' || left(text, 20), '^\s+|\s+$', '', 'g') END AS other FROM typed)"


@query(f"WITH {_TRANSLATED} SELECT doc_id, string_agg(CASE WHEN type = 'heading' THEN '## ' ELSE '' END || coalesce(other, own), chr(10) || chr(10) ORDER BY ord) AS markdown FROM t GROUP BY doc_id")
def markdown_translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.markdown(_with_translation(spark, sf_dir), "translated")


@query(f"WITH {_TRANSLATED} SELECT doc_id, string_agg(CASE WHEN type = 'heading' THEN '## ' || own || coalesce(' / ' || other, '') ELSE own || coalesce(chr(10) || chr(10) || other, '') END, chr(10) || chr(10) ORDER BY ord) AS markdown FROM t GROUP BY doc_id")
def markdown_bilingual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.markdown(_with_translation(spark, sf_dir), "bilingual")


@query("SELECT user_id AS doc_id, string_agg('> ' || event_type || chr(10) || chr(10) || props, chr(10) || chr(10) ORDER BY event_id) AS notes FROM events GROUP BY 1")
def notes_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.notes_appendix(table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("id"), F.col("event_type").alias("quote"), F.col("props").alias("comment")))


@query("SELECT doc_id, '**' || left(text, 4) || '**' || substr(text, 5, 3) || '*' || substr(text, 8, 5) || '*' || substr(text, 13) AS marked FROM documents WHERE length(text) >= 12")
def emphasis_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = lambda a, b, style: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(style).alias("style"))
    return table(spark, sf_dir, "documents").where("length(text) >= 12").select("doc_id", export.emphasis_markup(F.col("text"), F.array(run(0, 4, "bold"), run(7, 12, "italic"))).alias("marked"))


@query("SELECT n_nationkey, '## Research question' || chr(10) || chr(10) || n_name || chr(10) || chr(10) || '## Key findings' || chr(10) || chr(10) || '- a ' || n_regionkey || chr(10) || '- b' AS summary FROM nation")
def summary_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.to_json(F.struct(F.col("n_name").alias("research_question"), F.lit(" ").alias("method"), F.array(F.concat(F.lit(" a "), F.col("n_regionkey").cast("string")), F.lit("b"), F.lit("")).alias("key_findings")))
    return table(spark, sf_dir, "nation").select("n_nationkey", export.summary_markdown(reply).alias("summary"))


@query("SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, CASE l_linenumber % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'suspect' ELSE 'ok' END AS quality FROM lineitem")
def table_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of three columns whose replies miss a row, stay as they were, or are new."""
    n = F.col("l_linenumber")
    grid = F.array(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("d"), F.lit("e"), F.lit("f")))
    fresh = F.array(F.array(F.lit("x"), F.lit("b"), F.lit("y")), F.array(F.lit("z"), F.lit("u"), F.lit("v")))
    reply = F.when(n % 4 == 0, F.slice(fresh, 1, 1)).when(n % 4 == 1, grid).otherwise(fresh)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), n.cast("long").alias("n"), translate.table_quality(grid, reply).alias("quality"))


@query(f"WITH {TYPED} SELECT doc_id, ord FROM typed WHERE contains(lower(text), 'than') OR (ord % 2 = 0 AND contains(lower('see ' || left(text, 9)), 'see t'))")
def search_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.when(F.col("ord") % 2 == 0, F.create_map(F.lit("p"), F.concat(F.lit("SEE "), F.substring("text", 1, 9))))
    rows = _typed(spark, sf_dir).withColumn("translations", both)
    plain = retrieval.search(rows, "than", "translations").select("doc_id", "ord")
    other = retrieval.search(rows.withColumn("text", F.lit("")), "See T", "translations").select("doc_id", "ord")
    return plain.unionByName(other).distinct().select("doc_id", F.col("ord").cast("long").alias("ord"))


@query(f"WITH {TYPED}, w AS (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS r, text FROM typed) SELECT doc_id, ord, CASE WHEN r % 2 = 0 THEN 'Name | ' || left(text, 5) || chr(10) || 'x | y' ELSE text END AS flat FROM w")
def flat_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    grid = F.when(F.col("r") % 2 == 0, F.array(F.array(F.lit("Name"), F.substring("text", 1, 5)), F.array(F.lit("x"), F.lit("y"))))
    return _typed(spark, sf_dir).withColumn("r", r).select("doc_id", F.col("ord").cast("long").alias("ord"), chunking.flat_table(grid, F.col("text")).alias("flat"))


# The predicates of formula_flags, which is among the queries.
ORACLE_SQL["formula_flags"] = rf"""{_LINES}, head AS (SELECT DISTINCT doc_id, ord FROM ({SQL["section_heading_flags"]}))
SELECT s.doc_id, s.ord, {_FORMULA} AS formula, {_PROSE} AS prose, regexp_replace(text, '^\s+', '') = '' OR head.ord IS NOT NULL OR {_has(T.CAPTION_START)} OR regexp_matches(regexp_replace(text, '^\s+', ''), '{T.RUN_IN_LABEL}') AS opens
FROM s LEFT JOIN head ON head.doc_id = s.doc_id AND head.ord = s.ord"""


def _contexts(k: int, requested: str) -> str:
    """The contexts of a question: requested, abstract, then ranked within each document."""
    from collections import Counter

    terms_ = Counter(retrieval.question_terms(QUESTION))
    values = ", ".join(f"({i}, '{w}', {n})" for i, (w, n) in enumerate(terms_.items()))
    return f"""WITH {TYPED}, q(i, w, times) AS (VALUES {values}),
units AS (SELECT doc_id, ord, {TOKENS.format(t="text")} AS t FROM typed),
stats AS (SELECT doc_id, count(*) AS n, avg(len(t)) AS avg_len FROM units GROUP BY doc_id),
tf AS (SELECT u.doc_id, u.ord, q.i, q.times, len(list_filter(u.t, lambda x: x = q.w)) AS f, greatest(len(u.t), 1) AS len FROM units u, q),
df AS (SELECT doc_id, i, count(*) FILTER (f > 0) AS d FROM tf GROUP BY doc_id, i),
parts AS (SELECT tf.doc_id, tf.ord, tf.i, tf.times * (ln(1 + (n - d + 0.5) / (d + 0.5)) * (f * 2.4::DOUBLE) / (f + 1.4::DOUBLE * (1 - 0.72::DOUBLE + 0.72::DOUBLE * len / avg_len))) AS s FROM tf JOIN df USING (doc_id, i) JOIN stats USING (doc_id) WHERE f > 0),
scored AS (SELECT doc_id, ord, sum(s ORDER BY i) AS s FROM parts GROUP BY doc_id, ord),
best AS (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, ord) AS rank FROM scored WHERE s > 0),
asked AS (SELECT doc_id, ord, 0 AS class, 1 AS place FROM typed WHERE ord::VARCHAR = '{requested}'),
opening AS (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM typed
  WHERE ord <= 1 AND type = 'text' AND (contains(lower(left(text, 40)), 'abstract') OR contains(left(text, 40), '摘要') OR length(text) > 400) AND ord::VARCHAR <> '{requested}'),
first AS (SELECT * FROM asked UNION ALL SELECT doc_id, ord, 1, ord FROM opening WHERE n <= 2),
every AS (SELECT * FROM first UNION ALL SELECT doc_id, ord, 2, rank FROM best b WHERE rank <= {k} AND NOT EXISTS (SELECT 1 FROM first f WHERE f.doc_id = b.doc_id AND f.ord = b.ord)),
placed AS (SELECT doc_id, ord, class, row_number() OVER (PARTITION BY doc_id ORDER BY class, place, ord) AS position, count(*) FILTER (class < 2) OVER (PARTITION BY doc_id) AS held FROM every)
SELECT doc_id, ord, position FROM placed WHERE (class < 2 OR held < {k}) AND position <= {max(k + 2, 6)}"""


# Contexts of a question, which are among the queries.
ORACLE_SQL["ask_context"] = _contexts(4, "3")
