"""The queries of the document operators over the driver's tables.

Adapters give the tables the roles that the operators expect: lines of ``documents`` are blocks, ``conversations`` are
documents whose turns are blocks, ``events`` are logs of translations and usage, and prices and quantities of ``lineitem``
stand in for positions on a page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import protect
from quire.functions import text as T
from quire.operators import chunking, export, layout, refine, regions, report, retrieval, store, terms, translate
from quire.sources.adapters import content_hash, table, text_blocks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
QUESTION = "the nation of order and the answer"
NEEDLE = "than"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_blocks(table(spark, sf_dir, "documents"))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).where("type <> 'blank'")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_id"), "role", "text")


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as translations of turns: 100 conversations of 10 turns, by event type as provider."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 100).alias("doc_id"), (F.col("event_id") % 10).alias("block_id"), F.col("event_type").alias("provider"), F.when(F.col("value") > 20, F.concat(F.lit("t"), F.col("event_id").cast("string"))).otherwise("").alias("text"), F.when(F.col("value") > 90, "failed").otherwise("ok").alias("quality"), F.col("event_id").alias("seq"))


# ---- Retrieval ----


@query
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = retrieval.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), QUESTION)
    return retrieval.top_k(scored, 6, ["doc_id"]).select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def bm25_topk_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = retrieval.bm25(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), QUESTION, scope=["source"])
    return retrieval.top_k(scored, 3, ["doc_id"], ["source"]).select("source", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.coalesce(F.array_max(t), F.lit("")).alias("largest"))


@query
def retrieval_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.retrieval_text(_turns(spark, sf_dir), _variants(spark, sf_dir), "purchase")
    return out.select("doc_id", "block_id", F.col("match_text"))


@query
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search(_typed(spark, sf_dir), NEEDLE).select("doc_id", F.col("ord").cast("long").alias("ord"))


@query
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.highlight(F.col("text"), NEEDLE).alias("marked"))


@query
def ask_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _typed(spark, sf_dir).withColumns({"page": F.col("ord"), "id": F.col("ord").cast("string")})
    return retrieval.contexts(rows, QUESTION, 4, ["3"]).select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("position").cast("long").alias("position"))


# ---- Tokens, chunks, packing ----


@query
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


@query
def doc_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").groupBy("lang", "source")
    return rows.agg(F.count(F.lit(1)).alias("docs"), F.sum(T.estimate_tokens(F.col("text"))).cast("long").alias("tokens"))


@query
def select_translatable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.select_blocks(_typed(spark, sf_dir), masked=False).select("doc_id", F.col("ord").cast("long").alias("ord"))


@query
def select_translatable_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.select_blocks(_typed(spark, sf_dir)).select("doc_id", F.col("ord").cast("long").alias("ord"))


@query
def chunk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(_typed(spark, sf_dir), 300).select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("chunk_id").cast("long").alias("chunk_id"))


@query
def chunk_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.estimate(chunking.chunk(_typed(spark, sf_dir)))


@query
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.context(_typed(spark, sf_dir)).select("doc_id", F.col("ord").cast("long").alias("ord"), "context")


@query
def summary_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.summary_pack(_typed(spark, sf_dir), 500).select("doc_id", F.col("ord").cast("long").alias("ord"))


@query
def summary_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.summary_source(chunking.summary_pack(_typed(spark, sf_dir), 100_000))


@query
def budget_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translate.within_budget(chunking.chunk(_typed(spark, sf_dir), 300), 600).groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"))


@query
def table_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grids(spark, sf_dir).select("doc_id", chunking.flat_table(F.col("rows")).alias("flat"))


# ---- Terms, protection ----


@query
def candidate_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.candidate_terms(table(spark, sf_dir, "documents")).select("term", "n")


@query
def mask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "documents").select("doc_id", protect.mask(F.col("text")).alias("m"))
    return m.select("doc_id", F.size("m.tokens").cast("long").alias("n"), F.explode_outer(protect.kind_counts(F.col("m"))).alias("kind", "n_kind"))


@query
def mask_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = T.strip(F.regexp_replace("text", "[ \t]{2,}", " "))
    m = table(spark, sf_dir, "documents").select("doc_id", clean.alias("text"), protect.mask(clean).alias("m"))
    back = m.withColumn("b", protect.unmask(F.col("m.text"), F.col("m.tokens")))
    return back.select("doc_id", F.col("b.text").alias("restored"), F.size("b.issues").cast("long").alias("issues"))


@query
def validate_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "documents").select("doc_id", "text", protect.mask(F.col("text")).alias("m")).where("size(m.tokens) > 0")
    kept = F.regexp_replace("m.text", r'<ph id="0"/>', "")
    out = m.withColumn("b", protect.unmask(kept, F.col("m.tokens")))
    return out.select("doc_id", F.array_join("b.issues", ";").alias("issues"), F.array_join(protect.validate(F.col("m"), F.col("b.text"), "en"), ";").alias("problems"))


# ---- Reports ----


@query
def parse_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.parse_report(_blocks(spark, sf_dir).withColumn("page", F.floor(F.col("ord") / 10)))
    return out.select("doc_id", F.col("chars").cast("long").alias("chars"), F.col("garbage").cast("long").alias("garbage"), "paragraph_count", "heading_count", "page_count", "text_coverage", "garbage_ratio")


@query
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.parse_report(_blocks(spark, sf_dir).withColumn("page", F.floor(F.col("ord") / 10)))
    score = report.quality_score(F.col("garbage_ratio"), F.col("paragraph_count"), F.col("text_coverage"))
    return rows.select("doc_id", score.alias("score"), report.grade(score).alias("grade"))


@query
def dominant_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.dominant(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey", ignore="4-NOT SPECIFIED")


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    provider = F.when(F.col("event_type").isin("click", "view"), "local").otherwise("cloud")
    return table(spark, sf_dir, "events").select(F.col("ts"), provider.alias("provider"), F.col("user_id").alias("tokens_in"), (F.col("event_id") % 1000).alias("tokens_out"), F.floor("value").cast("long").alias("seconds"))


@query
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.usage_totals(_usage(spark, sf_dir))


@query
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _usage(spark, sf_dir).groupBy("provider").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    return rows.select("provider", "tokens_in", "tokens_out", (report.cost(F.col("tokens_in"), F.col("tokens_out"), digits=None) * 1_000_000).cast("decimal(20,0)").cast("long").alias("cost_micro"))


@query
def usage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.streaming import usage

    rows = _usage(spark, sf_dir).withColumn("tokens", F.col("tokens_in") + F.col("tokens_out"))
    out = usage.usage_windows(rows, "1 hour")
    return out.select(F.unix_timestamp("start").alias("start_s"), "provider", "calls", "tokens")


@query
def quality_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.quality_rollup(store.with_variants(_turns(spark, sf_dir), _variants(spark, sf_dir), _notes(spark, sf_dir)))
    return out.select("doc_id", "blocks", "translated", "ok", "failed")


@query
def label_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))


# ---- Stores and joins ----


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 100).alias("doc_id"), (F.col("event_id") % 10).alias("block_id"), F.col("event_id").alias("id"))


@query
def hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(content_hash("text").alias("sha256"), "doc_id")
    return rows.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(_variants(spark, sf_dir), ["doc_id", "block_id", "provider"])


@query
def upsert_locked_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _variants(spark, sf_dir).select("doc_id", F.col("provider").alias("source"), F.col("text").alias("target"), F.col("quality").alias("note"), (F.col("seq") % 50 == 0).cast("int").alias("locked"), "seq")
    return store.upsert_glossary(v)


@query
def cache_miss_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.cache_misses(_turns(spark, sf_dir), _variants(spark, sf_dir), "purchase").select("doc_id", "block_id")


@query
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("doc_id"))
    left = store.cascade({"blocks": _turns(spark, sf_dir), "translations": _variants(spark, sf_dir), "notes": _notes(spark, sf_dir)}, gone)
    parts = [df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(k)) for k, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def blocks_with_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = store.with_variants(_turns(spark, sf_dir), _variants(spark, sf_dir), _notes(spark, sf_dir))
    shown = F.array_join(F.transform(F.map_entries("translations"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select("doc_id", "block_id", F.coalesce(shown, F.lit("")).alias("translations"), "note_count")


@query
def note_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes(spark, sf_dir).groupBy("doc_id", "block_id").agg(F.count(F.lit(1)).alias("note_count"))


@query
def extract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 4
    wrapped = F.when(n == 0, F.col("props")).when(n == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(n == 2, F.concat(F.lit("Here it is: "), "props", F.lit(" - done"))).otherwise("no json at all")
    return table(spark, sf_dir, "events").select("event_id", T.json_in(wrapped).alias("json"))


@query
def settings_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).when(F.col("event_id") % 3 == 1, "Yes").otherwise("x/y//")
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", store.setting(F.col("raw"), "bool").alias("as_bool"), F.coalesce(store.setting(F.col("raw"), "int"), F.lit(-1)).alias("as_int"), store.setting(F.col("raw"), "url").alias("as_url"))


# ---- Blocks: predicates, order, refinement ----


@query
def caption_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines_with_samples(spark, sf_dir).select("doc_id", "ord", T.starts_caption(F.col("text")).alias("caption"))


@query
def reference_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines_with_samples(spark, sf_dir).select("doc_id", "ord", T.starts_reference(F.col("text")).alias("reference"), T.is_page_number(F.col("text")).alias("folio"))


#: Lines that the driver's texts lack, united with them on both sides of a comparison.
SAMPLES = ("Fig. 3 A plot", "Table 12: values", "[12] Smith, J. 2020", "Smith, A. Title", "5 of 17", "42", "2.8. 3D Point Cloud", "IV. Results and so on", "0.72 to 0.97.", "29 June 2022) and", "100 images were taken", "Scheme 2", "figure two", "3/9", "1 Introduction", "2.1 Materials and Methods", "3. Results of the Trial", "XI. Outlook and limits", "x = y + z - 1", "(12)", "a broken wo-", "where a = b holds", "Keywords:", "Received: 1 May 2020", "Abstract",
    "Yang, W.; Zhai, R.; Li, X. A paper", "RESEARCH ARTICLE on plants", "(a)", "Panel of leaves", "Stem length: measured by hand", "12.5 kg, 3 and 4", "References", "this line of running text has many plain words and goes on", "Citation: Smith, A.")


def _lines_with_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _blocks(spark, sf_dir).select("doc_id", F.col("ord").cast("long").alias("ord"), "text")
    more = spark.createDataFrame([(-1, i, t) for i, t in enumerate(SAMPLES)], "doc_id long, ord long, text string")
    return own.unionByName(more)


@query
def section_heading_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines_with_samples(spark, sf_dir).where(T.is_section_heading(F.col("text"))).select("doc_id", "ord")


@query
def formula_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _lines_with_samples(spark, sf_dir).select("doc_id", "ord", T.is_formula_line(t).alias("formula"), T.is_prose(t).alias("prose"), T.opens_unit(t).alias("opens"))


@query
def hyphen_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.regexp_replace("text", "(tion)", "ti-\non")
    return table(spark, sf_dir, "documents").select("doc_id", T.repair_hyphens(broken).alias("text"))


@query
def running_branding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _typed(spark, sf_dir).withColumns({"size": F.lit(10.0), "flags": F.array().cast("array<string>"), "type": F.lit("text")})
    return refine.demote_branding(rows).where("type = 'header'").select("doc_id", F.col("ord").cast("long").alias("ord"))


@query
def leading_meta_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _typed(spark, sf_dir).withColumn("type", F.when(F.col("type") == "heading", "meta").otherwise("text"))
    return layout.leading_meta(rows).where("leading").select("doc_id", F.col("ord").cast("long").alias("ord"))


@query
def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.outline(_typed(spark, sf_dir)).select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("level").cast("long").alias("level"))


@query
def renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layout.renumber(_typed(spark, sf_dir).withColumn("was", F.col("ord")))
    return rows.select("doc_id", F.col("was").cast("long").alias("was"), F.col("ord").cast("long").alias("ord"))


@query
def mid_sentence_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir).select("doc_id", F.col("ord").cast("long").alias("ord"), T.ends_mid_sentence(F.col("text")).alias("cut"))


@query
def page_edge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents dealt to lines of 80 characters and pages of 10 lines: most pages stop mid-sentence."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all(F.regexp_replace("text", "\n", " "), F.lit("(.{1,80})"), F.lit(1))).alias("ord", "text"))
    pages = rows.withColumns({"page": F.floor(F.col("ord") / 10), "type": F.lit("text")})
    return refine.page_edges(pages).select("doc_id", F.col("page").cast("long").alias("page"), F.length("tail").cast("long").alias("tail_chars"), F.length("head").cast("long").alias("head_chars"))


# ---- Layout on numbers ----


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_quantity").alias("x0"), F.col("l_extendedprice").alias("y0"))


@query
def modal_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.modal_start(_marks(spark, sf_dir), ["k"], "x0")


@query
def x_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layout.clusters(_marks(spark, sf_dir), ["k"], "x0", 4.0)
    return rows.groupBy("k", F.col("cluster").cast("long").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.median("x0").alias("middle"))


@query
def row_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.row_runs(_marks(spark, sf_dir), ["k"], "x0", 2.0, 12.0).select("k", "n", F.col("run").cast("long").alias("run"))


@query
def line_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.line_steps(_marks(spark, sf_dir), ["k"], "y0", ["n", "y0"]).select("k", "n", "step")


@query
def detect_gutter(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey")).alias("page"), F.when(F.col("l_linenumber") % 2 == 1, 56.0).otherwise(310.0).alias("x0"), (F.col("l_extendedprice") % 700).alias("y0"), F.col("l_quantity").alias("w"))
    rows = box.select("page", "x0", "y0", (F.col("x0") + 180 + F.col("w")).alias("x1"), (F.col("y0") + 10).alias("y1"))
    return layout.detect_gutter(rows, ["page"], F.lit(595.0))


@query
def column_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n"), (F.col("l_quantity") * 10).alias("x0"), (F.col("l_quantity") * 10 + F.col("l_linenumber") * 30).cast("double").alias("x1"))
    gutters = rows.select("page").distinct().where("page % 3 <> 0").withColumn("gutter", F.lit(290.0))
    out = layout.classify_columns(rows, gutters, ["page"])
    return out.groupBy("page", F.col("column").cast("long").alias("column"), "alignment").agg(F.count(F.lit(1)).alias("n"))


@query
def nearest_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("page"), F.col("event_id"), "event_type", "value")
    figs = e.where("event_type = 'purchase'").select("page", F.col("event_id").alias("figure"), (F.col("value") * 10).alias("y0"), (F.col("value") * 10 + 20).alias("y1"))
    caps = e.where("event_type = 'signup'").select("page", F.col("event_id").alias("ord"), (F.col("value") * 10).alias("y0"), (F.col("value") * 10 + 5).alias("y1"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("text"))
    return regions.nearest_caption(figs, caps, ["page"]).select("page", "figure", "caption")


@query
def region_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("page"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n"), (F.col("l_quantity") * 10).alias("x0"), (F.col("l_discount") * 1000).alias("y0"))
    lines = lines.withColumns({"x1": F.col("x0") + 50, "y1": F.col("y0") + 10})
    rects = table(spark, sf_dir, "part").select((F.col("p_partkey") % 20).alias("page"), F.col("p_partkey").alias("region"), (F.col("p_size") * 8).cast("double").alias("x0"), F.lit(20.0).alias("y0"), (F.col("p_size") * 8 + 90).cast("double").alias("x1"), F.lit(65.0).alias("y1"))
    out = regions.members(lines, rects, keys=["page"])
    return out.where("region IS NOT NULL").groupBy("page", "region").agg(F.count(F.lit(1)).alias("lines"))


# ---- Rendering ----


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cells = F.struct(F.col("n_nationkey").alias("i"), F.array("n_name", F.concat("r_name", F.lit(" <&> '"), F.col("n_nationkey").cast("string"))).alias("r"))
    grid = rows.groupBy(F.col("n_regionkey").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(cells)).alias("all"))
    return grid.select("doc_id", F.concat(F.array(F.array(F.lit("Name"), F.lit("Region"))), F.transform("all", lambda x: x["r"])).alias("rows"))


@query
def table_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grids(spark, sf_dir).select("doc_id", export.table_html(F.col("rows")).alias("html"))


@query
def pseudo_table_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    prose = F.transform("rows", lambda r: F.array(F.element_at(r, 1), F.repeat(F.element_at(r, 2), F.when(F.col("doc_id") % 2 == 0, 9).otherwise(1))))
    return _grids(spark, sf_dir).select("doc_id", regions.is_pseudo_table(prose).alias("pseudo"))


@query
def markdown_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.markdown(_typed(spark, sf_dir), "original")


# ---- Provider pipelines ----


@query
def translate_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = translate.translate(_typed(spark, sf_dir), translate.EchoProvider(), "en")
    return out.select("doc_id", F.col("ord").cast("long").alias("ord"), "text", "quality", F.col("attempts").cast("long").alias("attempts"))


@query
def retry_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Echoed text fails the check for Chinese where it is long: those blocks are asked for twice and stay suspect."""
    out = translate.translate(_typed(spark, sf_dir), translate.EchoProvider(), "zh")
    return out.groupBy("quality", F.col("attempts").cast("long").alias("attempts")).agg(F.count(F.lit(1)).alias("n"))


@query
def parse_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts set as two-column pages of spans, parsed back to refined blocks."""
    words = F.regexp_extract_all(F.regexp_replace("text", "\n", " "), F.lit("(.{1,40})"), F.lit(1))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(words).alias("i", "text"))
    place = F.col("i") % 100
    x0 = F.when(place < 50, 56.0).otherwise(310.5)
    y0 = (place % 50) * 14.0 + 60
    spans = rows.select("doc_id", F.floor(F.col("i") / 100).cast("int").alias("page"), F.lit(595.0).alias("page_width"), F.lit(842.0).alias("page_height"), place.cast("int").alias("block_no"), F.lit(0).alias("line_no"), F.lit(0).alias("span_no"), "text", F.lit(None).cast("array<struct<c:string>>").alias("chars"), x0.alias("x0"), y0.alias("y0"), (x0 + F.length("text") * 5.6).alias("x1"), (y0 + 11).alias("y1"), F.lit(10.0).alias("size"), F.lit("Times").alias("font"), F.lit(0).alias("flags"), F.lit(0).alias("color"))
    out = refine.parse_documents(spans)
    return out.select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("page").cast("long").alias("page"), "type", F.col("column").cast("long").alias("column"), "text")


