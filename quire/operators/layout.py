"""Page layout: spans to lines, columns, paragraphs, reading order and blocks.

Everything is keyed by (doc_id, page), so one shuffle on these keys serves a page's steps, and a page is the most that a
window or list holds. Lines have x0, y0, x1, y1 in points from the top left.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

#: Tolerances in points and shares of the page.
PAGE = ("doc_id", "page")
CELL_GAP = 6.0
MODAL_NEAR = 3.0
CLUSTER_LEAST, CLUSTER_SHARE = 4.0, 0.01
GUTTER_BOXES = 10
GUTTER_STRONG = (5, 0.15)
GUTTER_RANGE = (0.03, 0.8)
GUTTER_LEFT, GUTTER_RIGHT = (4, 0.1), (4, 0.12)
GUTTER_SPAN = 60.0
SPANNING = (2, 0.15)
INDENT = (8, 30)
RAIL_WIDTH = 0.55
HEAD_BAND, FOOT_BAND = 0.06, 0.94
BOLD_NAMES, BOLD_ENDS = ("bold", "black", "semibold", "demi"), (".b", "-b", ",b", ".bd", "-bd")
ITALIC_NAMES, ITALIC_ENDS = ("italic", "oblique"), (".i", "-i", ",i", ".it", "-it", ".ob")

# ---- Spans to lines ----


def span_text() -> Column:
    return F.coalesce(F.when(F.col("text") != "", F.col("text")), F.array_join(F.transform("chars", lambda c: c["c"]), ""), F.lit(""))


def _styled(bit: int, names: Sequence[str], ends: Sequence[str]) -> Column:
    font = F.lower(F.coalesce("font", F.lit("")))
    style = F.coalesce(F.col("flags").bitwiseAND(bit) != 0, F.lit(False))
    for n in names:
        style = style | font.contains(n)
    for e in ends:
        style = style | font.endswith(e)
    return style


def lines(spans: DataFrame) -> DataFrame:
    """Lines in order: text, box, largest size, bold, mean colour, runs of one style, and cells apart by wide gaps."""
    # A page's lines are ordered below: dealt out by page at once, spans are dealt out only once.
    s = spans.repartition(*PAGE).withColumn("t", span_text()).withColumn("b", _styled(16, BOLD_NAMES, BOLD_ENDS)).withColumn("i", _styled(2, ITALIC_NAMES, ITALIC_ENDS))
    named = F.lower(F.coalesce("font", F.lit(""))).rlike("bold|black")
    channel = lambda shift: F.avg(F.shiftright("color", shift).bitwiseAND(255) / 255.0)
    span = F.struct("span_no", "t", "b", "i", "x0", "x1")
    rows = s.groupBy(*PAGE, "page_width", "page_height", "block_no", "line_no").agg(
        F.array_sort(F.collect_list(span)).alias("spans"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.max("size").alias("size"), F.max(named).alias("bold"),
        F.struct(channel(16).alias("r"), channel(8).alias("g"), channel(0).alias("b")).alias("colour"),
    )
    rows = rows.withColumn("text", F.array_join(F.transform("spans", lambda x: x["t"]), "")).where(~T.blank(F.col("text")))
    # Without style a line is one run.
    plain = F.array(F.struct(F.col("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic")))
    runs = F.when(F.exists("spans", lambda x: x["b"] | x["i"]), _runs(F.col("spans"))).otherwise(plain)
    rows = rows.withColumn("runs", runs).withColumn("cells", cells(F.col("spans"))).drop("spans")
    order = Window.partitionBy(*PAGE).orderBy(F.round("y0", 1), "x0", "block_no", "line_no")
    return rows.withColumn("line", F.row_number().over(order) - 1).drop("block_no", "line_no")


def _runs(spans: Column) -> Column:
    """array<struct<text, bold, italic>>: neighbours of one style merged."""
    none = F.array().cast("array<struct<text:string,bold:boolean,italic:boolean>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        same = F.coalesce((last["bold"] == s["b"]) & (last["italic"] == s["i"]), F.lit(False))
        grown = F.struct(F.concat(F.coalesce(F.when(same, last["text"]), F.lit("")), s["t"]).alias("text"), s["b"].alias("bold"), s["i"].alias("italic"))
        return F.array_append(F.when(same, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc), grown)

    return F.aggregate(spans, none, step)


def cells(spans: Column, gap: float = CELL_GAP) -> Column:
    """array<struct<x0, x1, text>>: spans less than a gap apart merged."""
    none = F.array().cast("array<struct<x0:double,x1:double,text:string>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        near = F.coalesce(s["x0"] - last["x1"] < gap, F.lit(False))
        joined = F.struct(F.coalesce(F.when(near, last["x0"]), s["x0"]).alias("x0"), s["x1"].alias("x1"), F.concat(F.coalesce(F.when(near, last["text"]), F.lit("")), s["t"]).alias("text"))
        return F.array_append(F.when(near, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc), joined)

    return F.aggregate(spans, none, step)


# ---- Numbers along an axis ----


def line_steps(rows: DataFrame, keys: Sequence[str], y: str, order: Sequence[str]) -> DataFrame:
    """rows with ``step``: how far below the row before."""
    return rows.withColumn("step", F.col(y) - F.lag(y).over(Window.partitionBy(*keys).orderBy(*order)))


def clusters(rows: DataFrame, keys: Sequence[str], x: str, tolerance: Column | float) -> DataFrame:
    """rows with ``cluster``, from 0: a value further than the tolerance from the one before begins a new one."""
    order = Window.partitionBy(*keys).orderBy(x)
    apart = F.coalesce(F.col(x) - F.lag(x).over(order) > tolerance, F.lit(False)).cast("int")
    return rows.withColumn("_apart", apart).withColumn("cluster", F.sum("_apart").over(order.rangeBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_apart")


def row_runs(rows: DataFrame, keys: Sequence[str], y: str, least: float = 6.0, most: float = 26.0) -> DataFrame:
    """rows with ``run``, from 0: rows go on in a run while their step is within bounds."""
    order = Window.partitionBy(*keys).orderBy(y)
    step = F.col(y) - F.lag(y).over(order)
    cut = (~F.coalesce(step.between(least, most), F.lit(True))).cast("int")
    return rows.withColumn("_cut", cut).withColumn("run", F.sum("_cut").over(order.rangeBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_cut")


def modal_start(rows: DataFrame, keys: Sequence[str], x: str, near: float = MODAL_NEAR) -> DataFrame:
    """(keys, modal, n): the value with the most values near it; of equals the least."""
    # A frame of fractional width has to be written as SQL.
    close = F.expr(f"count(1) OVER (PARTITION BY {', '.join(keys)} ORDER BY {x} RANGE BETWEEN {near}D PRECEDING AND {near}D FOLLOWING)")
    counted = rows.where(F.col(x).isNotNull()).withColumn("_n", close)
    return counted.groupBy(*keys).agg(F.min_by(x, F.struct((-F.col("_n")).alias("n"), F.col(x).alias("x"))).alias("modal"), F.max("_n").alias("n"))


def margin(rows: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """(keys, margin): the modal left edge of lines at least half as wide as the 75th of 100 widths; pages where that is below 120 are absent."""
    width = F.col("x1") - F.col("x0")
    wide = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(width)).alias("w")).withColumn("wide", F.element_at("w", (F.size("w") * 0.75).cast("int") + 1)).where("wide >= 120").drop("w")
    some = rows.join(wide, list(keys)).where(width >= F.col("wide") * 0.5)
    return modal_start(some, keys, "x0").select(*keys, F.col("modal").alias("margin"))


def step_limits(rows: DataFrame) -> DataFrame:
    """rows (steps, h, ...) with ``limit``: the step that begins a paragraph, from all steps of a column and its line height.

    Never below 1.3 of the median pitch, 1.25 of the height or 2 points; above that, midway between the two means if the
    steps fall into two kinds that are clearly apart. The means are refined up to 24 times.
    """
    height = F.col("h")
    usual = F.filter("steps", lambda v: (v > 0.2 * height) & (v < 4.0 * height))
    positive = F.filter("steps", lambda v: v > 0)
    rows = rows.withColumn("_usual", usual).withColumn("_pitch", F.array_sort(F.when(F.size("_usual") >= 4, F.col("_usual")).when(F.size(positive) > 0, positive).otherwise(F.col("steps"))))
    n = F.size("_pitch")
    middle = (F.try_element_at("_pitch", F.greatest(((n + 1) / 2).cast("int"), F.lit(1))) + F.try_element_at("_pitch", (n / 2).cast("int") + 1)) / 2.0
    rows = rows.withColumn("_floor", F.greatest(F.lit(2.0), middle * 1.3, height * 1.25))

    def refine(acc: Column, _: Column) -> Column:
        # Sums and counts of both kinds in one pass; a mean is kept where its kind is empty.
        def add(s: Column, v: Column) -> Column:
            low = F.abs(v - acc["low"]) <= F.abs(v - acc["high"])
            return F.struct((s["a"] + F.when(low, v).otherwise(0.0)).alias("a"), (s["m"] + low.cast("int")).alias("m"), (s["b"] + F.when(low, 0.0).otherwise(v)).alias("b"), (s["k"] + (~low).cast("int")).alias("k"))

        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0).alias("m"), F.lit(0.0).alias("b"), F.lit(0).alias("k"))
        done = lambda s: F.struct(F.when(s["m"] > 0, s["a"] / s["m"]).otherwise(acc["low"]).alias("low"), F.when(s["k"] > 0, s["b"] / s["k"]).otherwise(acc["high"]).alias("high"), (acc["one"] | (s["m"] == 0) | (s["k"] == 0)).alias("one"))
        return F.aggregate("_pitch", zero, add, done)

    start = F.struct(F.coalesce(F.array_min("_pitch"), F.lit(0.0)).alias("low"), F.coalesce(F.array_max("_pitch"), F.lit(0.0)).alias("high"), F.lit(False).alias("one"))
    spread = F.coalesce(F.array_max("_pitch") > F.array_min("_pitch") * 1.3, F.lit(False))
    rows = rows.withColumn("_means", F.when(spread, F.aggregate(F.sequence(F.lit(1), F.lit(24)), start, refine)))
    apart = F.coalesce(~F.col("_means.one") & (F.col("_means.high") >= F.col("_means.low") * 1.3), F.lit(False))
    limit = F.when(apart, F.greatest(F.col("_floor"), (F.col("_means.low") + F.col("_means.high")) / 2.0)).otherwise(F.col("_floor"))
    return rows.withColumn("limit", F.when(F.size("_pitch") > 0, limit).otherwise(F.greatest(F.lit(2.0), height * 1.5))).drop("_usual", "_pitch", "_floor", "_means")


# ---- Columns ----


def detect_gutter(boxes: DataFrame, keys: Sequence[str], page_width: Column) -> DataFrame:
    """(keys, gutter): the left-most start shared by many boxes that has text on both sides; pages without one are absent."""
    page = Window.partitionBy(*keys)
    rows = boxes.withColumn("_w", page_width).withColumn("_n", F.count(F.lit(1)).over(page)).where(F.col("_n") >= GUTTER_BOXES)
    rows = clusters(rows, keys, "x0", F.greatest(F.lit(CLUSTER_LEAST), F.col("_w") * CLUSTER_SHARE))
    strong = rows.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("c"), F.median("x0").alias("edge"), F.first("_n").alias("n"), F.first("_w").alias("w"))
    strong = strong.where(F.col("c") >= F.greatest(F.lit(GUTTER_STRONG[0]), F.col("n") * GUTTER_STRONG[1]))
    two = strong.withColumn("_k", F.count(F.lit(1)).over(page)).where((F.col("_k") >= 2) & F.col("edge").between(F.col("w") * GUTTER_RANGE[0], F.col("w") * GUTTER_RANGE[1]))
    pairs = rows.select(*keys, "x0", "y0", "x1", "y1").join(two.select(*keys, "edge", "n"), list(keys))
    left, right = F.col("x1") <= F.col("edge") + 1, F.col("x0") >= F.col("edge") - 1
    span = lambda side: F.max(F.when(side, F.col("y1"))) - F.min(F.when(side, F.col("y0")))
    sides = pairs.groupBy(*keys, "edge", "n").agg(F.count_if(left).alias("l"), F.count_if(right).alias("r"), span(left).alias("ls"), span(right).alias("rs"))
    enough = lambda c, share: F.col(c) >= F.greatest(F.lit(share[0]), F.col("n") * share[1])
    return sides.where(enough("l", GUTTER_LEFT) & enough("r", GUTTER_RIGHT) & (F.least("ls", "rs") >= GUTTER_SPAN)).groupBy(*keys).agg(F.min("edge").alias("gutter"))


def classify_columns(boxes: DataFrame, gutters: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """boxes with ``column`` (-1 across, 0 left, 1 right) and the page's ``alignment``."""
    rows = boxes.join(gutters, list(keys), "left")
    across = (F.col("x0") < F.col("gutter") - 1) & (F.col("x1") > F.col("gutter") + 1)
    column = F.when(F.col("gutter").isNull(), 0).when(across, -1).when(F.col("x1") <= F.col("gutter") + 1, 0).otherwise(1)
    page = Window.partitionBy(*keys)
    few = F.count_if(F.col("column") == -1).over(page) <= F.greatest(F.lit(SPANNING[0]), SPANNING[1] * F.count(F.lit(1)).over(page))
    return rows.withColumn("column", column).withColumn("alignment", F.when(F.col("gutter").isNull(), "single").when(few, "double").otherwise("mixed")).drop("gutter")


def split_rail(rows: DataFrame, boundary: Column, page_width: Column) -> DataFrame:
    """Lines of a page with a metadata rail: narrow ones are column -1, the body is 1."""
    narrow = (F.col("x1") - F.col("x0")) < F.greatest(F.lit(1.0), page_width - boundary) * RAIL_WIDTH
    return rows.withColumn("column", F.when(narrow, -1).otherwise(1))


def body_start(rows: DataFrame, page_width: Column, keys: Sequence[str] = PAGE) -> DataFrame:
    """(keys, start): where the body begins on a single-column page with a rail; pages without such a rail are absent."""
    sized = rows.withColumn("_w", page_width).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    wide = sized.where(F.col("x1") - F.col("x0") >= F.col("_w") * 0.5).withColumn("_wide", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    wide = wide.where(F.col("_wide") >= F.greatest(F.lit(5), F.col("_n") * 0.15))
    widths = wide.groupBy(*keys).agg(F.first("_w").alias("_w"))
    return modal_start(wide, keys, "x0").join(widths, list(keys)).where(F.col("modal") > F.col("_w") * 0.03).select(*keys, F.col("modal").alias("start"))


def railed_pages(rows: DataFrame, page_width: Column, keys: Sequence[str] = PAGE) -> DataFrame:
    """(keys): pages whose left edge has a band of lines, tall enough and with at least two labels of metadata."""
    page = Window.partitionBy(*keys)
    sized = rows.withColumn("_w", page_width).withColumn("_n", F.count(F.lit(1)).over(page)).where("_n >= 20")
    sized = sized.withColumn("_h", F.max("y1").over(page) - F.min("y0").over(page)).withColumn("_tol", F.greatest(F.lit(CLUSTER_LEAST), F.col("_w") * CLUSTER_SHARE))
    grouped = clusters(sized, keys, "x0", F.col("_tol"))
    strong = grouped.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("c"), F.median("x0").alias("edge"), F.first("_n").alias("n"))
    strong = strong.where(F.col("c") >= F.greatest(F.lit(6), F.col("n") * 0.18)).groupBy(*keys).agg(F.min("edge").alias("edge"), F.count(F.lit(1)).alias("k")).where("k >= 2")
    left = sized.join(strong, list(keys)).where((F.abs(F.col("x0") - F.col("edge")) <= F.col("_tol")) & (F.col("edge") <= F.col("_w") * 0.08))
    band = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.first("_n").alias("n"), F.first("_h").alias("h"), (F.max("y1") - F.min("y0")).alias("span"), F.count_if(T.matches(T.strip(F.col("text")), f"(?iU)(?:{T.RAIL_LABEL})")).alias("labels"))
    return band.where((F.col("c") >= F.greatest(F.lit(6), F.col("n") * 0.18)) & (F.col("labels") >= 2) & (F.col("h") > 0) & (F.col("span") >= F.col("h") * 0.35)).select(*keys)


def side_columns(rows: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """(keys, side): on pages of two columns the one, not the left, whose median width is below 62 % of the widest."""
    widths = rows.where("alignment = 'double' AND column >= 0").groupBy(*keys, "column").agg(F.median(F.col("x1") - F.col("x0")).alias("w"))
    widest = F.max("w").over(Window.partitionBy(*keys))
    return widths.where("column > 0").join(widths.withColumn("m", widest).groupBy(*keys).agg(F.max("m").alias("m")), list(keys)).where(F.col("w") < F.col("m") * 0.62).select(*keys, F.col("column").alias("side"))


# ---- Paragraphs and blocks ----


def paragraphs(rows: DataFrame) -> DataFrame:
    """Lines (with column) grouped to paragraphs, classified: (doc_id, page, column, para, text, type, box, size, tail_full, emphasis).

    Lines with ``cut`` count for the gaps between others but aren't part of the text; ``side`` is a page's side column, if any;
    ``runs`` may be null where nothing is styled.
    """
    rows = rows if "cut" in rows.columns else rows.withColumn("cut", F.lit(False))
    rows = rows if "side" in rows.columns else rows.withColumn("side", F.lit(None).cast("int"))
    rows = rows if "runs" in rows.columns else rows.withColumn("runs", F.array().cast("array<struct<text:string,bold:boolean,italic:boolean>>"))
    keys = [*PAGE, "column"]
    order = Window.partitionBy(*keys).orderBy(F.round("y0", 1), "x0", "line")
    height = F.when(F.col("y1") > F.col("y0"), F.col("y1") - F.col("y0"))
    stepped = line_steps(rows, keys, "y0", [F.round("y0", 1), F.col("x0"), F.col("line")])
    limits = stepped.groupBy(*keys).agg(F.array_compact(F.collect_list("step")).alias("steps"), F.coalesce(F.median(height), F.lit(11.0)).alias("h"), F.max("x1").alias("right"))
    limits = step_limits(limits.where(F.col("column").isNotNull())).groupBy(*PAGE).agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("limit", "right")))).alias("_limits"))
    # What holds for a page is joined before lines are put in order, which they then stay in.
    sizes = rows.groupBy(*PAGE).agg(F.coalesce(F.median(F.when(F.col("size") > 0, F.col("size"))), F.lit(10.0)).alias("median_size"))
    known = limits.join(sizes, list(PAGE)).join(margin(rows), list(PAGE), "left")
    stepped = rows.where(F.col("column").isNotNull()).join(known, list(PAGE)).withColumn("_limit", F.element_at("_limits", F.col("column"))).drop("_limits")
    width = F.col("x1") - F.col("x0")
    before = lambda c: F.lag(c).over(order)
    indented = (F.col("x0") > F.col("margin") + INDENT[0]) & (F.col("x0") < F.col("margin") + INDENT[1])
    stepped = stepped.withColumns({"limit": F.col("_limit.limit"), "right": F.col("_limit.right"), "alone": T.is_standalone(F.col("text")), "indented": F.coalesce(indented, F.lit(False)), "width": width}).drop("_limit")
    stepped = line_steps(stepped, keys, "y0", [F.round("y0", 1), F.col("x0"), F.col("line")])
    jump = F.abs(F.col("size") - before("size")) > F.greatest(F.lit(1.6), before("size") * 0.2)
    indent = F.col("indented") & (F.col("width") >= before("width") * 0.8) & ~before("indented")
    new = F.coalesce((F.col("step") > F.col("limit")) | (F.col("step") < 0) | jump | indent | F.col("alone") | before("alone"), F.lit(True))
    numbered = stepped.withColumn("_new", new.cast("int")).withColumns({"para": F.sum("_new").over(order), "_n": F.row_number().over(order)})
    # A heading's lines before others, and lines from a metadata label on, are paragraphs of their own.
    label = T.is_meta_label(T.strip(F.col("text"))) & (F.length(T.strip(F.col("text"))) <= 120) & (F.col("_new") == 0)
    latest = lambda when: F.max(F.when(when, F.col("_n"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = numbered.withColumns({"_start": latest(F.col("_new") == 1), "_other": latest(~T.is_section_heading(F.col("text"))), "_label": latest(label)})
    since = lambda c: F.coalesce(F.col(c) >= F.col("_start"), F.lit(False))
    part = F.when(~since("_other"), 0).otherwise(1 + since("_label").cast("int"))
    numbered = numbered.withColumn("part", part)
    line = F.struct(F.round("y0", 1).alias("y"), F.col("x0"), F.col("line"), T.strip(F.col("text")).alias("text"), F.col("x1"), "runs", F.col("colour") if "colour" in rows.columns else F.lit(None).cast("struct<r:double,g:double,b:double>").alias("colour"))
    grouped = numbered.where(~F.col("cut")).groupBy(*keys, "para", "part").agg(
        F.array_sort(F.collect_list(line)).alias("lines"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.max("size").alias("size"), F.first("right").alias("right"), F.first("median_size").alias("median_size"), F.first("page_height").alias("page_height"), F.first("side").alias("side"),
    )
    last = F.element_at("lines", -1)["x1"]
    grouped = grouped.withColumn("tail_full", last >= F.col("right") - F.greatest(F.lit(3.0), 0.015 * F.greatest(F.lit(1.0), last - F.col("x0"))))
    grouped = grouped.withColumn("text", T.repair_hyphens(F.array_join(F.transform("lines", lambda x: x["text"]), "\n"))).where("text != ''")
    grouped = grouped.withColumn("type", paragraph_type()).withColumn("faint", F.coalesce(_faint(F.element_at("lines", 1)["colour"]), F.lit(False)))
    plain = lambda x: F.array(F.struct(x["text"].alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic")))
    styled = F.exists("lines", lambda x: F.coalesce(F.exists(x["runs"], lambda r: r["bold"] | r["italic"]), F.lit(False)))
    runs = F.when(styled, F.transform("lines", lambda x: F.coalesce(x["runs"], plain(x))))
    return grouped.withColumn("emphasis", emphasis(runs)).drop("right", "lines", "side")


EMPHASIS = "array<struct<start:int,end:int,style:string>>"


def emphasis(lines: Column) -> Column:
    """Where a paragraph's text is bold or italic, from its lines' runs: (start, end, style), by the rules that join lines to text.

    Only paragraphs with a styled run go to Python.
    """

    @F.pandas_udf(EMPHASIS)
    def marked(paragraphs: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else _marks(json.loads(p)) for p in paragraphs])

    styled = F.exists(lines, lambda runs: F.exists(runs, lambda r: r["bold"] | r["italic"]))
    # As JSON: lists of lists of different lengths don't go through Arrow to pandas.
    return F.coalesce(marked(F.when(styled, F.to_json(lines))), F.array().cast(EMPHASIS))


def _marks(lines: Iterable[Iterable[dict]]) -> list[dict]:
    """Characters and their styles, joined like the text; then runs of one style."""
    chars: list[tuple[str, str]] = []
    for runs in lines:
        own = [(c, " ".join(n for n in ("bold", "italic") if r[n])) for r in runs for c in r["text"]]
        while own and own[0][0].isspace():
            own.pop(0)
        while own and own[-1][0].isspace():
            own.pop()
        if own and len(chars) > 1 and chars[-1][0] in "-\u2010\u2011" and (chars[-2][0].isalnum() or chars[-2][0] == "_"):
            chars.pop()
        elif own and chars:
            chars.append((" ", ""))
        chars += own
    kept: list[tuple[str, str]] = []
    for c, style in chars:
        gap = c in " \t"
        if not (gap and kept and kept[-1][0] == " "):
            kept.append((" " if gap else c, style))
    out: list[dict] = []
    for i, (_, style) in enumerate(kept):
        if out and out[-1]["style"] == style and out[-1]["end"] == i:
            out[-1]["end"] = i + 1
        elif style:
            out.append({"start": i, "end": i + 1, "style": style})
    return out


def _faint(colour: Column) -> Column:
    return F.least(colour["r"], colour["g"], colour["b"]) > 0.7


def paragraph_type() -> Column:
    """The first rule that holds, on text, lines, size, column and the page's median size."""
    text, first = F.col("text"), T.strip(F.element_at("lines", 1)["text"])
    meta = (F.length(text) <= 400) & (F.col("size") <= F.col("median_size") * 1.1) & (T.is_meta_label(first) | T.starts_rail(first))
    narrow = F.aggregate("lines", F.lit(0), lambda n, x: F.greatest(n, F.length(T.strip(x["text"])))) <= 120
    narrow_column = (F.col("column") < 0) | F.coalesce(F.col("column") == F.col("side"), F.lit(False))
    rail = narrow_column & (F.col("size") <= F.col("median_size") * 1.15) & (F.length(text) <= 300) & narrow
    large = (F.length(text) < 120) & ~text.rlike(r"[.!?](?:\s|$)") & ~text.rlike("[.。,;:]$") & (F.col("size") >= F.col("median_size") * 1.18)
    year = text.rlike(r"(?U)\b(19|20)\d{2}\b")
    return (
        F.when(T.starts_caption(text), "caption")
        .when(T.is_section_heading(text), "heading")
        .when(meta | rail, "meta")
        .when(large, "heading")
        .when(T.starts_reference(text) & (F.length(text) < 400) & year, "reference")
        .when((F.length(text) < 90) & text.rlike(r"(?U)^\s*\d{1,2}\s"), "footnote")
        .when(T.hints_formula(text), "formula")
        .otherwise("text")
    )


def heading_level(text: Column, size: Column, median: Column) -> Column:
    ratio = size / median
    depth = F.size(F.split(F.regexp_extract(text, r"^\s*(\d{1,2}(?:\.\d{1,2})*)", 1), r"\."))
    numbered = text.rlike(r"^\s*\d{1,2}(?:\.\d{1,2})*\.?\s")
    return F.when(ratio >= 1.6, 1).when(ratio >= 1.25, 2).when(numbered, F.least(F.lit(3), F.greatest(F.lit(2), depth))).when(F.length(text) < 60, 3)


GRID = "array<array<string>>"


def blocks(paras: DataFrame, page_height: Column) -> DataFrame:
    """Paragraphs, and tables, figures and equations among them, as blocks in reading order; ids count through the document.

    Full-width ones come first, then each column from top to bottom; what has no column counts to the first.
    """
    optional = {"emphasis": EMPHASIS, "image_path": "string", "caption": "string", "table_rows": GRID, "mark": "string"}
    p = paras.withColumns({c: F.lit(None).cast(kind) for c, kind in optional.items() if c not in paras.columns}).withColumn("_height", page_height)
    s = T.strip(F.col("text"))
    top, bottom = F.col("y1") < F.col("_height") * HEAD_BAND, F.col("y0") > F.col("_height") * FOOT_BAND
    moved = F.when(T.is_page_number(s), F.when(F.col("y0") < F.col("_height") * 0.5, "header").otherwise("footer"))
    moved = moved.when(F.col("type").isin("text", "formula", "caption", "heading") & F.col("image_path").isNull() & (F.length(s) <= 80), F.when(top, "header").when(bottom, "footer"))
    p = p.withColumn("type", F.coalesce(moved, F.when(F.col("faint"), "header"), F.col("type")))
    order = Window.partitionBy("doc_id").orderBy("page", F.when(F.col("column") < 0, 0).otherwise(1), F.greatest("column", F.lit(0)), "y0", "x0", "type", "para", "part")
    p = p.withColumn("ord", F.row_number().over(order) - 1)
    level = F.when((F.col("type") == "heading") & ~F.col("faint"), heading_level(F.col("text"), F.col("size"), F.col("median_size")))
    flags = F.array_compact(F.array(F.col("mark"), F.when(F.col("faint"), "faint-text"), F.when(F.col("tail_full"), "tail-full")))
    box = F.struct("x0", "y0", "x1", "y1").alias("bbox")
    more = [F.coalesce("emphasis", F.array().cast(EMPHASIS)).alias("emphasis"), "image_path", "caption", "table_rows"]
    return p.select(F.format_string("%s-b%05d", "doc_id", "ord").alias("id"), "doc_id", "ord", "page", "type", "text", box, F.greatest("column", F.lit(0)).alias("column"), level.alias("level"), "size", flags.alias("flags"), *more)


def parse(spans: DataFrame) -> DataFrame:
    """Spans to blocks: the whole page pipeline, without images and a finder of tables."""
    from quire.operators import pages

    return pages.parse(spans).blocks


def renumber(rows: DataFrame, doc: str = "doc_id", order: Sequence[str] = ("ord",)) -> DataFrame:
    """rows with ``ord`` dense from 0."""
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(doc).orderBy(*order)) - 1)


def outline(rows: DataFrame) -> DataFrame:
    """Headings with text, with their level (2 if none)."""
    level = F.coalesce(F.col("level"), F.lit(2)) if "level" in rows.columns else F.lit(2)
    return rows.where((F.col("type") == "heading") & ~T.blank(F.col("text"))).withColumn("level", level)


def leading_meta(rows: DataFrame) -> DataFrame:
    """Visible blocks with ``leading``: whether they stand in the prefix of metadata."""
    seen = Window.partitionBy("doc_id").orderBy("ord")
    return rows.where(~F.col("type").isin("header", "footer")).withColumn("leading", F.sum((F.col("type") != "meta").cast("int")).over(seen) == 0)


def on_page(rows: DataFrame, page: int, page_width: Column, shown: float = 720.0) -> DataFrame:
    """A page's blocks with their box scaled to the shown width."""
    scale = F.lit(shown) / page_width
    return rows.where(F.col("page") == page).withColumn("shown", F.transform(F.array("bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1"), lambda v: v * scale))
