"""The page pipeline on made-up pages that hold everything: tables, figures, equations, rails, recognised pages, emphasis."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.operators import export, layout, pages, refine, regions, report
from quire.sources import adapters

PROSE = "the plants were measured with a scanner in the field and the values were compared with those of the manual method"


def span(doc, page, block, text, x0, y0, x1, size=10.0, font="Times", line=0, no=0, flags=0, height=842.0):
    return (doc, page, 595.0, height, block, line, no, text, None, float(x0), float(y0), float(x1), float(y0 + size * 1.1), float(size), font, flags, 0)


def prose(doc, page, block, y, n=3, x0=72, x1=520):
    return [span(doc, page, block + i, f"{PROSE[: 90 - i]} {block + i}", x0, y + 13 * i, x1) for i in range(n)]


def full_page():
    """One page: heading, text, a ruled table, text, a numbered equation, text with bold words, a figure's caption."""
    rows = [span("d", 0, 0, "1. Introduction of the Work", 72, 90, 250, 12, "Times-Bold")]
    rows += prose("d", 0, 1, 120)
    for i, (a, b) in enumerate([("Model", "Score"), ("alpha", "0.91"), ("beta", "0.87"), ("gamma", "0.55")]):
        rows += [span("d", 0, 10 + 2 * i, a, 90, 200 + 14 * i, 140), span("d", 0, 11 + 2 * i, b, 300, 200 + 14 * i, 330)]
    rows += prose("d", 0, 20, 300)
    rows += [span("d", 0, 30, "L = a + b^2 - c", 150, 370, 260), span("d", 0, 31, "(3)", 500, 370, 520)]
    rows += prose("d", 0, 40, 410, 2)
    rows += [span("d", 0, 42, "which are ", 72, 436, 120, no=0), span("d", 0, 42, "very bold", 120, 436, 170, font="Times-Bold", no=1), span("d", 0, 42, " in the end.", 170, 436, 230, no=2)]
    rows += [span("d", 0, 50, "Figure 1 The scanner in the field", 72, 680, 300)]
    return rows


def spans(spark, rows):
    return spark.createDataFrame(rows, adapters.SPANS)


BOX = "doc_id string, page int, x0 double, y0 double, x1 double, y1 double"


@pytest.fixture(scope="module")
def parsed(spark):
    images = spark.createDataFrame([("d", 0, 72.0, 500.0, 400.0, 670.0), ("d", 0, 10.0, 10.0, 15.0, 15.0), ("d", 0, 72.0, 118.0, 300.0, 158.0)], BOX)
    return pages.parse(spans(spark, full_page()), images=images)


def test_a_page_with_everything(parsed):
    out = sorted(parsed.blocks.collect(), key=lambda r: r.ord)
    kinds = [r.type for r in out]
    assert kinds == ["heading", "text", "table", "text", "formula", "text", "figure", "caption"]
    assert out[2].table_rows == [["Model", "Score"], ["alpha", "0.91"], ["beta", "0.87"], ["gamma", "0.55"]]
    assert not any(w in r.text for r in out for w in ("Model", "0.87", "a + b", "(3)"))  # taken by the table and the equation
    assert out[4].image_path == "p0001_eq001.png" and out[4].flags == ["equation-image"] and out[4].text == ""
    assert out[6].caption == "Figure 1 The scanner in the field" and out[6].image_path.startswith("p0000_fig")
    bold = out[5]
    assert [bold.text[e.start : e.end] for e in bold.emphasis] == ["very bold"] and bold.emphasis[0].style == "bold"
    assert [r.id for r in out] == [f"d-b{i:05d}" for i in range(len(out))]


def test_pages_and_crops(parsed):
    (page,) = parsed.pages.collect()
    assert (page.alignment, page.ocr, page.block_count, page.hoisted) == ("single", False, 8, False)
    assert sorted((r.kind, r.image_path) for r in parsed.crops.collect()) == [("equation", "p0001_eq001.png"), ("figure", "p0000_fig001.png")]


def test_report_of_a_parsed_document(parsed):
    row = report.parse_report(parsed.blocks, parsed.pages).first()
    assert (row.table_count, row.figure_count, row.formula_count, row.heading_count, row.channel, row.alignment) == (1, 1, 1, 1, "text-layer", "single")


def test_refined_and_exported(spark, parsed):
    blocks = refine.refine(parsed.blocks)
    md = export.markdown(blocks, "original").first().markdown
    assert "| Model | Score |\n| --- | --- |\n| alpha | 0.91 |" in md and "![Figure 1 The scanner in the field](p0000_fig001.png)" in md


def test_no_text_is_lost(spark, parsed):
    """Every word of the spans is in a block, a table, or an equation's crop."""
    words = {w for r in full_page() for w in r[7].split()} - {"L", "=", "a", "+", "b^2", "-", "c", "(3)"}
    held = set()
    for r in parsed.blocks.collect():
        held |= set(r.text.split()) | {w for row in r.table_rows or [] for c in row for w in c.split()}
    assert words <= held


def test_given_tables_must_look_like_tables_and_hold_their_text(spark):
    rows = full_page()
    grid = [["Model", "Score"], ["alpha", "0.91"], ["beta", "0.87"], ["gamma", "0.55"]]
    given = [("d", 0, 80.0, 195.0, 340.0, 260.0, grid), ("d", 0, 70.0, 295.0, 530.0, 340.0, [["a", "b"], ["c", "d"]]), ("d", 0, 70.0, 115.0, 100.0, 125.0, grid)]
    out = pages.parse(spans(spark, rows), tables=spark.createDataFrame(given, BOX + ", rows array<array<string>>")).blocks.collect()
    assert [r.table_rows for r in out if r.type == "table"] == [grid]
    lossy = spark.createDataFrame([("d", 0, 70.0, 405.0, 530.0, 450.0, [["M", "S"], ["a", "0"]])], BOX + ", rows array<array<string>>")
    lines = layout.lines(spans(spark, [*rows, span("d", 0, 60, "right", 400, 410, 430), span("d", 0, 61, "left", 400, 424, 430), span("d", 0, 62, "more", 400, 437, 430)]))
    assert regions.detected_tables(lines, lossy).count() in (1, 2)
    kept, rest = pages.without_tables(lines, lossy)
    assert [r.rows for r in kept.collect()] == [grid] and rest.where(F.col("text").contains("in the end.")).count() == 1


def rail_page():
    """A single column with a rail at the left: labels, narrow lines, and a wide body beside them."""
    labels = ["Citation: Smith, A.;", "Received: 1 May 2020", "Accepted: 3 June 2020", "Published: 4 June 2020", "Academic Editor: B", "short note of it", "another line", "and one more"]
    rows = [span("r", 0, i, t, 36, 150 + 40 * i, 180, 8) for i, t in enumerate(labels)]  # they reach over the body's edge
    return rows + [span("r", 0, 100 + i, f"{PROSE[:80]} {i}", 170, 150 + 13 * i, 560) for i in range(30)]


def test_a_rail_is_metadata(spark):
    out = pages.parse(spans(spark, rail_page()))
    page = out.pages.first()
    assert (page.alignment, page.hoisted) == ("mixed", True)
    rows = out.blocks.collect()
    assert {r.type for r in rows if "Received" in r.text or "another" in r.text} == {"meta"}
    assert all("Received" not in r.text for r in rows if r.type == "text") and any(r.type == "text" and f"{PROSE[:80]} 7" in r.text for r in rows)


def test_a_narrow_side_column_is_metadata(spark):
    rows = [span("s", 0, i, f"{PROSE[:60]} {i}", 56, 100 + 13 * i, 400) for i in range(25)]
    rows += [span("s", 0, 50 + i, f"side note {i}", 430, 100 + 13 * i, 520) for i in range(25)]
    lines = pages.placed_lines(layout.lines(spans(spark, rows)))
    assert lines.select("alignment", "side").distinct().collect() == [("double", 1)]
    shorter = pages.parse(spans(spark, rows[:25] + rows[25:45])).blocks.collect()
    assert {r.type for r in shorter if r.text.startswith("side note")} == {"meta"}


def words_of(doc, page, texts, conf=0.98):
    return [(doc, page, t, conf, 200.0, 200.0 + 45 * i, 1400.0, 236.0 + 45 * i, 200) for i, t in enumerate(texts)]


WORDS = "doc_id string, page int, text string, conf double, x0 double, y0 double, x1 double, y1 double, dpi int"


def test_recognised_words_replace_a_scanned_page(spark):
    rows = [span("o", 0, 0, "stamp", 500, 20, 540), *[s for i in range(3) for s in prose("o", 1, 10 * i, 100 + 60 * i)]]
    images = spark.createDataFrame([("o", 0, 0.0, 0.0, 595.0, 800.0), ("o", 1, 0.0, 600.0, 100.0, 700.0)], BOX)
    words = spark.createDataFrame([*words_of("o", 0, [PROSE[:70], PROSE[10:80]]), *words_of("o", 0, ["unsure"], 0.3), *words_of("o", 1, ["not to be used"])], WORDS)
    out = pages.parse(spans(spark, rows), images=images, words=words, ocr="auto")
    sheets = {r.page: r for r in out.pages.collect()}
    assert (sheets[0].ocr, sheets[1].ocr, sheets[0].ocr_confidence) == (True, False, 0.98)
    text = {p: " ".join(r.text for r in out.blocks.where(F.col("page") == p).collect()) for p in (0, 1)}
    assert PROSE[:70] in text[0] and "stamp" not in text[0] and "unsure" not in text[0] and "not to be used" not in text[1]
    assert out.blocks.where("type = 'figure'").count() == 1  # the scan of page 0 is none
    row = report.parse_report(out.blocks, out.pages).first()
    assert (row.channel, row.ocr_pages) == ("ocr", 1)
    forced = pages.parse(spans(spark, rows), images=images, words=words, ocr="force").pages.collect()
    assert all(r.ocr for r in forced)
    off = pages.parse(spans(spark, rows), images=images, words=words).pages.collect()
    assert not any(r.ocr for r in off)


def test_equations_without_numbers_and_with_prose(spark):
    texts = ["x = y + z - 1", "a = b^2 + c", "q = [r + s] - t", f"{PROSE[:60]}", "plain words stand here"]
    rows = [("d", 0, t, 100.0, 100.0 + 12 * i, 300.0, 110.0 + 12 * i) for i, t in enumerate(texts)]
    lines = spark.createDataFrame(rows, "doc_id string, page int, text string, x0 double, y0 double, x1 double, y1 double")
    (found,) = regions.equation_regions(lines).collect()
    assert found.number == "" and found.y0 == 100.0 and found.crop.y1 <= 134.0 + 6
    taken = {r.text for r in regions.in_equations(lines, regions.equation_regions(lines)).where("region IS NOT NULL").collect()}
    assert taken == set(texts[:3])


def test_emphasis_follows_hyphens_and_spaces(spark):
    rows = [span("e", 0, 0, "a  wo", 72, 100, 300, no=0), span("e", 0, 0, "rd that is cut-", 300, 100, 520, font="Times-Italic", no=1), span("e", 0, 1, "ting on", 72, 113, 120, font="Times-Italic", no=0), span("e", 0, 1, " plain tail of it all", 120, 113, 500, no=1)]
    (row,) = pages.parse(spans(spark, rows)).blocks.collect()
    assert row.text == "a word that is cutting on plain tail of it all"
    assert [(row.text[e.start : e.end], e.style) for e in row.emphasis] == [("rd that is cutting on", "italic")]
    marked = pages.parse(spans(spark, rows)).blocks.select(export.emphasis_markup(F.col("text"), F.col("emphasis")).alias("m")).first().m
    assert marked == "a wo*rd that is cutting on* plain tail of it all"


def test_joined_paragraphs_keep_their_emphasis(spark):
    schema = "doc_id string, id string, ord int, page int, type string, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, column int, level int, size double, flags array<string>, emphasis array<struct<start:int,end:int,style:string>>"
    cut = "This paragraph is long enough to be cut by the end of the page and"
    rows = [("d", "d-0", 0, 0, "text", cut, (56.0, 700.0, 500.0, 800.0), 0, None, 10.0, ["tail-full"], [(0, 4, "bold")]), ("d", "d-1", 1, 1, "text", "goes on here.", (56.0, 200.0, 500.0, 300.0), 0, None, 10.0, [], [(5, 7, "italic")])]
    (out,) = refine.join_cut_paragraphs(spark.createDataFrame(rows, schema)).collect()
    assert [(out.text[e.start : e.end], e.style) for e in out.emphasis] == [("This", "bold"), ("on", "italic")]


def test_empty_spans(spark):
    out = pages.parse(spans(spark, []))
    assert out.blocks.count() == 0 and out.pages.count() == 0 and out.crops.count() == 0
