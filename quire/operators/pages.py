"""The page pipeline: what stands on a page, taken apart in order and put together as blocks.

Recognised text replaces the lines of pages that need it; tables take the lines they reproduce; the rest falls into columns, of
which a rail or a narrow side column holds metadata; equations take their lines; paragraphs, tables, figures and equations
become blocks in reading order.

Every step is keyed by (doc_id, page), so a page is the most that a task needs to hold. Lines and paragraphs are looked at from
many sides; what is looked at often is written down between steps, which also keeps plans small. What comes beside the spans is a table each, all optional; nothing is decoded, recognised or drawn here.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import layout, regions
from quire.operators.layout import PAGE
from quire.sources import adapters
from quire.sources.scratch import forget, step

BOX = ("x0", "y0", "x1", "y1")


class Parsed(NamedTuple):
    """Blocks in reading order; one row a page (size, alignment, ocr, ocr_confidence, hoisted, block_count); what is to be cropped."""

    blocks: DataFrame
    pages: DataFrame
    crops: DataFrame


def parse(spans: DataFrame, tables: DataFrame | None = None, images: DataFrame | None = None, words: DataFrame | None = None, ocr: str = "off") -> Parsed:
    """Spans to blocks.

    ``tables`` (doc_id, page, box, rows) are those that a finder gave; ``images`` (doc_id, page, box) stand on pages; ``words`` are
    recognised ones (:func:`quire.sources.adapters.ocr_rows`), which replace the lines of pages that are forced to or, in mode
    auto, have little text under large images.
    """
    lines = layout.lines(spans).drop("cells")
    sheets = spans.groupBy(*PAGE).agg(F.max("page_width").alias("page_width"), F.max("page_height").alias("page_height"))
    if words is not None:
        sheets, lines = with_recognised(sheets, lines, images, words, ocr)
    else:
        sheets = sheets.withColumns({"ocr": F.lit(False), "ocr_confidence": F.lit(None).cast("double")})
    # A run that is the whole line, and plain, says no more than its text.
    styled = F.exists("runs", lambda r: r["bold"] | r["italic"])
    lines = lines.withColumn("runs", F.when((F.size("runs") != 1) | styled, F.col("runs")))
    sheets, lines = step(sheets), step(lines)

    grids, rest = without_tables(lines, tables)
    placed = placed_lines(rest)
    forget(lines)
    equations = step(regions.equation_regions(placed))
    marked = step(regions.in_equations(placed, equations))
    paras = step(layout.paragraphs(marked.withColumn("cut", F.col("region").isNotNull()).drop("region")))

    pictures = step(regions.used_equations(marked, equations))
    forget(marked)
    items = [paras, _formulas(pictures, sheets), _tables(grids, sheets)]
    crops = regions.crop_manifest(None, pictures)
    if images is not None:
        texts, captions = paras.select(*PAGE, *BOX), paras.where("type = 'caption'").select(*PAGE, F.monotonically_increasing_id().alias("ord"), "y0", "y1", "text")
        scanned = sheets.where("ocr").select(*PAGE)
        some = images.join(scanned, list(PAGE), "left_anti").join(sheets.select(*PAGE, "page_width", "page_height"), list(PAGE))
        figures = regions.figures(some, grids, texts, captions, F.greatest(F.lit(1.0), F.col("page_width") * F.col("page_height")))
        items.append(_figures(figures, sheets))
        crops = regions.crop_manifest(figures, pictures)
    every = items[0]
    for more in items[1:]:
        every = every.unionByName(more, allowMissingColumns=True)
    blocks = step(layout.blocks(every, F.col("page_height")))

    kinds = placed.groupBy(*PAGE).agg(F.first("alignment").alias("alignment"), F.max("hoisted").alias("hoisted"))
    counts = blocks.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("block_count"))
    pages = sheets.join(kinds, list(PAGE), "left").join(counts, list(PAGE), "left")
    pages = pages.withColumns({"alignment": F.coalesce("alignment", F.lit("unknown")), "hoisted": F.coalesce("hoisted", F.lit(False)), "block_count": F.coalesce("block_count", F.lit(0))})
    return Parsed(blocks, pages, crops)


def with_recognised(sheets: DataFrame, lines: DataFrame, images: DataFrame | None, words: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """Pages with ``ocr`` and its mean confidence, and lines, of which those of recognised pages are the recognised ones."""
    found = adapters.ocr_rows(words)
    chars = lines.groupBy(*PAGE).agg(F.sum(F.length("text")).alias("chars"))
    area = F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("image_area")
    covered = (images if images is not None else words.select(*PAGE, *BOX).limit(0)).groupBy(*PAGE).agg(area)
    seen = found.groupBy(*PAGE).agg(F.max("page_conf").alias("page_conf"))
    rows = sheets.join(chars, list(PAGE), "left").join(covered, list(PAGE), "left").join(seen, list(PAGE), "left")
    rows = rows.withColumns({"chars": F.coalesce("chars", F.lit(0)), "image_area": F.coalesce("image_area", F.lit(0.0)), "page_area": F.greatest(F.lit(1.0), F.col("page_width") * F.col("page_height"))})
    # A page on which nothing was recognised keeps what it has.
    rows = adapters.needs_ocr(rows, mode).withColumn("ocr", F.col("ocr") & F.col("page_conf").isNotNull())
    sheets = rows.select(*PAGE, "page_width", "page_height", "ocr", F.when(F.col("ocr"), F.col("page_conf")).alias("ocr_confidence"))

    read = sheets.where("ocr").select(*PAGE, "page_width", "page_height")
    fresh = found.join(read, list(PAGE)).withColumn("bold", F.lit(False))
    order = Window.partitionBy(*PAGE).orderBy(F.round("y0", 1), "x0", "text")
    fresh = fresh.withColumn("line", F.row_number().over(order) - 1).drop("conf", "page_conf")
    kept = lines.join(read.select(*PAGE), list(PAGE), "left_anti")
    return sheets, kept.unionByName(fresh, allowMissingColumns=True).withColumn("runs", F.coalesce("runs", F.array().cast("array<struct<text:string,bold:boolean,italic:boolean>>")))


def without_tables(lines: DataFrame, tables: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Tables that hold the text of the lines they cover, and the lines that no such table covers."""
    found = step(regions.detected_tables(lines, tables))
    kept = step(regions.kept_tables(lines, found))
    taken = kept.select(*PAGE, "region", F.lit(True).alias("_taken"))
    rest = regions.members(lines, found).join(taken, [*PAGE, "region"], "left").where("_taken IS NULL").drop("region", "_taken")
    return kept, rest


def placed_lines(lines: DataFrame) -> DataFrame:
    """Lines with column and alignment, ``side`` (a side column of the page) and ``hoisted`` (a rail was split off)."""
    # Only what pages have goes through the shared folder before lines do, which are wide.
    rows = layout.classify_columns(lines, step(layout.detect_gutter(lines, PAGE, F.col("page_width"))))
    # A single column may have a rail beside it: only with labels of metadata on its edge.
    single = rows.where("alignment = 'single'")
    rails = step(layout.body_start(single, F.col("page_width")).join(layout.railed_pages(single, F.col("page_width")), list(PAGE)))
    rows = rows.join(rails, list(PAGE), "left").withColumnRenamed("column", "_column").withColumn("hoisted", F.col("start").isNotNull())
    rows = layout.split_rail(rows, F.col("start"), F.col("page_width"))
    rows = rows.withColumns({"column": F.when(F.col("hoisted"), F.col("column")).otherwise(F.col("_column")), "alignment": F.when(F.col("hoisted"), "mixed").otherwise(F.col("alignment"))})
    rows = step(rows.drop("_column", "start"))
    return rows.join(step(layout.side_columns(rows)), list(PAGE), "left")


def _item(rows: DataFrame, sheets: DataFrame, kind: str, part: int, **more: Column) -> DataFrame:
    """What stands among paragraphs without being one: no text, in the first column."""
    fixed = {"column": F.lit(0), "text": F.lit(""), "type": F.lit(kind), "size": F.lit(10.0), "median_size": F.lit(10.0), "tail_full": F.lit(False), "faint": F.lit(False), "part": F.lit(part)}
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "x0"))
    out = rows.join(sheets.select(*PAGE, "page_height"), list(PAGE)).withColumns(fixed).withColumn("para", number.cast("long")).withColumns(more)
    return out.select(*PAGE, *BOX, "page_height", *fixed, "para", *more)


def _formulas(pictures: DataFrame, sheets: DataFrame) -> DataFrame:
    rows = pictures.select(*PAGE, *[F.col(f"crop.{c}").alias(c) for c in BOX], "image_path")
    return _item(rows, sheets, "formula", -1, image_path=F.col("image_path"), mark=F.lit("equation-image"))


def _tables(grids: DataFrame, sheets: DataFrame) -> DataFrame:
    return _item(grids, sheets, "table", -2, table_rows=F.col("rows"))


def _figures(figures: DataFrame, sheets: DataFrame) -> DataFrame:
    return _item(figures.drop("page_width", "page_height"), sheets, "figure", -3, image_path=F.col("image_path"), caption=F.col("caption"))
