"""What the page pipeline leaves out for speed changes nothing: patterns, pages that aren't folded, tables between steps."""

from __future__ import annotations

import random
from pathlib import Path

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import layout, pages, refine, regions
from quire.sources import scratch
from tests.test_pages import PROSE, full_page, span, spans

LINE = "doc_id string, page int, text string, x0 double, y0 double, x1 double, y1 double"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_white_space_is_that_of_the_pattern(spark):
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c + "a" + c + "b" + c,) for c in chars] + [(c,) for c in chars] + [("",), (None,), (" \n x\n \n",)], "t string")
    t = F.col("t")
    both = rows.select("t", T.strip(t).alias("a"), F.regexp_replace(t, r"(?U)^\s+|\s+$", "").alias("b"), T.lstrip(t).alias("c"), F.regexp_replace(t, r"(?U)^\s+", "").alias("d"))
    assert both.where(~F.col("a").eqNullSafe(F.col("b")) | ~F.col("c").eqNullSafe(F.col("d"))).count() == 0
    assert "regexp_replace" not in plan(rows.select(T.strip(t)))


def test_formula_lines_are_those_of_all_patterns(spark):
    rng = random.Random(5)
    parts = ["the", "word", "(3)", "=", "+", "-", "−", "x", "é", "·", "‐", "", "2", " ", " ", "漢", "|", "*", "(", ")", "12", "Ж", "́", "%"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([1, 2, 3, 8, 20, 60]))) for _ in range(4000)]
    s = T.strip(F.col("t"))
    symbols = T.count_of(s, T.MATH_CHARS) + T.count_of(s, T.MATH_GLYPH)
    sentence = (T.count_of(s, "[A-Za-z]{3,}") >= 3) & (T.count_of(s, "[A-Za-z]") >= 18)
    dense = (symbols >= 2) & (symbols / F.greatest(F.length(s), F.lit(1)) >= 0.12)
    whole = F.when(s == "", False).when((F.length(s) <= 3) & T.matches(s, T.MATH_GLYPH), True).when(F.length(s) > 110, False)
    whole = whole.when(T.matches(s, T.EQUATION_NUMBER), True).otherwise((symbols > 0) & ~sentence & dense)
    rows = spark.createDataFrame([(t,) for t in [*texts, "(3)", "( 12 )", "", "a"]], "t string").select(T.is_formula_line(F.col("t")).alias("a"), whole.alias("b"))
    assert rows.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0
    assert rows.where("a").count() > 100 < rows.where("not a").count()


def test_pages_without_cells_are_not_folded_and_no_table_is_lost(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for page in range(60):
        for i in range(12):
            y = 100.0 + 14 * i + rng.choice([0, 0, 0, 0.04, 2.4])
            words = lambda: " ".join(rng.choice(["alpha", "0.9", "beta gamma", PROSE[:24]]) for _ in range(rng.choice([1, 1, 2])))
            rows += [("d", page, words(), x, y + rng.choice([0, 0, 0.03, 1.2]), x + 60.0, y + 11) for x in (72.0, 200.0, 330.0)[: rng.choice([1, 2, 2, 3])]]
    rows += [("p", page, f"{PROSE[:40]}", x, 60.0 + 14 * i, x + 224, 71.0 + 14 * i) for page in range(5) for x in (56.0, 310.5) for i in range(50)]
    lines = spark.createDataFrame(rows, LINE)
    assert regions._maybe_ruled(lines).where("doc_id = 'p'").count() == 0
    found = sorted(regions.rule_tables(lines).collect())
    monkeypatch.setattr(regions, "_maybe_ruled", lambda df: df)
    assert found == sorted(regions.rule_tables(lines).collect()) and len(found) >= 10


SCHEMA = "doc_id string, id string, ord int, page int, type string, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, column int, level int, size double, flags array<string>, table_rows array<array<string>>"


def test_many_documents_are_folded_together(spark):
    cut = "This paragraph is long enough to be cut by the end of the page and"
    rows = []
    for d in range(300):
        rows += [(f"d{d}", f"{d}-1", 5, 1, "text", f"goes on in {d}.", (56.0, 200.0, 500.0, 300.0), 0, None, 10.0, None, None), (f"d{d}", f"{d}-0", 2, 0, "text", cut, (56.0, 700.0, 500.0, 800.0), 0, 2, 10.0, ["tail-full"], None)]
        rows += [(f"d{d}", f"{d}-2", 9, None, "table", "", (56.0, 400.0, 500.0, 500.0), None, None, None, [], [["a"], ["b", None]])]
    joined = refine.join_cut_paragraphs(spark.createDataFrame(rows, SCHEMA))
    assert "FlatMapGroups" not in plan(joined)
    out = {(r.doc_id, r.ord): r for r in joined.collect()}
    assert len(out) == 600
    for d in range(300):
        a, b = out[f"d{d}", 0], out[f"d{d}", 1]
        assert (a.id, a.text, a.level, a.flags, a.bbox.y1) == (f"{d}-0", f"{cut} goes on in {d}.", 2, [], 800.0)
        assert (b.id, b.page, b.column, b.size, b.table_rows) == (f"{d}-2", None, None, None, [["a"], ["b", None]])


def test_no_documents_are_folded(spark):
    assert refine.join_cut_paragraphs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_lines_of_a_heading_and_labels_are_parted(spark):
    rows = [span("d", 0, i, t, 72, 100 + 13 * i, 500) for i, t in enumerate([f"{PROSE[:80]}", "Received: 1 May 2020", f"{PROSE[5:80]}", "Accepted: 2 June 2020", f"{PROSE[9:80]}"])]
    rows += [span("d", 0, 10 + i, t, 72, 200 + 13 * i, 500) for i, t in enumerate(["2. Methods of the Work", f"{PROSE[:70]}", f"{PROSE[4:70]}"])]
    paras = layout.paragraphs(layout.lines(spans(spark, rows)).withColumn("column", F.lit(0))).collect()
    texts = [(r.type, r.text, r.part) for r in sorted(paras, key=lambda r: (r.para, r.part))]
    labelled = f"Received: 1 May 2020 {PROSE[5:80]} Accepted: 2 June 2020 {PROSE[9:80]}"
    assert texts == [("text", PROSE[:80], 1), ("meta", labelled, 2), ("heading", "2. Methods of the Work", 0), ("text", f"{PROSE[:70]} {PROSE[4:70]}", 1)]


def test_tables_of_lines_go_once_they_are_read(spark):
    folder = Path(scratch.shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("step-*"))
    out = pages.parse(spans(spark, full_page()))
    left = [spark.read.parquet(str(p)).columns for p in set(folder.glob("step-*")) - before]
    assert sum("runs" in c for c in left) == 1  # what out.pages reads
    assert out.blocks.count() == 7 and out.pages.count() == 1 and out.crops.count() == 1
