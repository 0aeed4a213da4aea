from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import chunking, export, layout, refine, regions, report, retrieval, store, terms, translate
from quire.sources import adapters
from quire.streaming import usage

BLOCKS = "doc_id string, ord int, type string, text string"


def blocks(spark, rows):
    return spark.createDataFrame([("d", i, k, t) for i, (k, t) in enumerate(rows)], BLOCKS).withColumn("id", F.format_string("%s-b%05d", "doc_id", "ord"))


def test_chunks_keep_every_block(spark):
    rows = blocks(spark, [("text", "word " * 200)] * 8 + [("table", "x")] + [("text", "end")])
    got = chunking.chunk(rows, 300).orderBy("ord").collect()
    assert len(got) == 10 and len({r.chunk_id for r in got}) >= 3
    assert [r.chunk_id for r in got] == sorted(r.chunk_id for r in got)
    assert [r.chunk_id for r in got].count(got[8].chunk_id) == 1


def test_selection(spark):
    rows = blocks(spark, [("header", "a head"), ("text", " "), ("text", "5. 6. 7. 8."), ("text", "https://x.org/a"), ("caption", "Table 1. 3D point cloud accuracy"), ("text", "plain words")])
    assert sorted(r.ord for r in chunking.select_blocks(rows).collect()) == [4, 5]
    assert [r.ord for r in chunking.select_blocks(rows, ["d-b00005"]).collect()] == [5]


def test_summary_passes_over_what_does_not_fit(spark):
    rows = blocks(spark, [("text", "a" * 39), ("text", "b" * 3900), ("text", "c" * 39), ("heading", "H" * 39), ("caption", "d" * 39)])
    assert sorted(r.ord for r in chunking.summary_pack(rows, 60).collect()) == [0, 2, 3, 4]


def test_bm25_ranks_and_empty_questions(spark):
    rows = blocks(spark, [("text", "apple pie recipe"), ("text", "apple apple apple"), ("text", "stone wall"), ("text", "深度学习方法")])
    assert [r.ord for r in retrieval.top_k(retrieval.bm25(rows, "apple"), 2, ["ord"]).orderBy("rank").collect()] == [1, 0]
    assert [r.ord for r in retrieval.top_k(retrieval.bm25(rows, "深度"), 2, ["ord"]).collect()] == [3]
    assert retrieval.bm25(rows, "?!").count() == 4


def test_evidence_falls_back(spark):
    rows = blocks(spark, [("text", "apple pie"), ("text", "apple tart"), ("text", "stone")]).withColumn("page", F.lit(3))
    chosen = retrieval.contexts(rows, "apple", 2)
    cited = spark.createDataFrame([("d", "nowhere", "q")], "doc_id string, id string, quote string")
    assert {r.quote for r in retrieval.evidence(cited, chosen).collect()} == {"apple pie", "apple tart"}
    good = spark.createDataFrame([("d", "d-b00001", "q")], "doc_id string, id string, quote string")
    assert [(r.id, r.quote) for r in retrieval.evidence(good, chosen).collect()] == [("d-b00001", "q")]


def test_upserts_and_cascade(spark):
    log = spark.createDataFrame([("d", "s", "old", "n", 1, 1), ("d", "s", "new", "m", 0, 2)], "doc_id string, source string, target string, note string, locked int, seq int")
    row = store.upsert_glossary(log).first()
    assert (row.target, row.note, row.locked) == ("new", "m", 1)
    assert store.upsert(log.where("seq = 1"), log.where("seq = 2"), ["doc_id", "source"]).first().target == "new"
    left = store.cascade({"glossary": log, "usage": log}, log.select("doc_id"))
    assert left["glossary"].count() == 0 and left["usage"].count() == 2


def test_write_replaces_only_its_documents(spark, tmp_path):
    path = str(tmp_path / "b")
    store.write(spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, x int"), path)
    store.write(spark.createDataFrame([("a", 2)], "doc_id string, x int"), path)
    assert sorted((r.doc_id, r.x) for r in store.read(spark, path).collect()) == [("a", 2), ("b", 1)]


def test_quality_score(spark):
    df = spark.createDataFrame([(0.0, 5, 0.5, 0, 0.0, 0), (0.2, 0, 0.0, 3, 0.5, 2)], "g double, p int, c double, o int, k double, w int")
    score = report.quality_score(F.col("g"), F.col("p"), F.col("c"), F.col("o"), F.col("k"), F.col("w"))
    assert [r.s for r in df.select(score.alias("s")).collect()] == [100.0, 0.0]


def test_terms(spark):
    df = spark.createDataFrame([("GPUs and BERT with BERT. Deep Learning methods, Deep Learning methods",)], "text string")
    assert {(r.term, r.n) for r in terms.candidate_terms(df).collect()} >= {("BERT", 2)}


def page(lines):
    """Spans of one page from (text, x0, y0, x1, size)."""
    return [("d", 0, 595.0, 842.0, i, 0, 0, t, None, float(x0), float(y0), float(x1), float(y0 + s * 1.1), float(s), "Times-Bold" if s > 12 else "Times", 0, 0) for i, (t, x0, y0, x1, s) in enumerate(lines)]


def two_columns():
    left = [(f"left column line number {i} runs on and on", 56, 200 + 14 * i, 284, 10) for i in range(20)]
    right = [(f"right column line number {i} runs on and on", 310.5, 200 + 14 * i, 538, 10) for i in range(20)]
    return [("A Title Set Large Over Both Columns", 56, 80, 540, 17), *left, *right, ("2 of 9", 280, 815, 310, 8)]


def test_two_columns_are_read_one_after_the_other(spark):
    out = layout.parse(spark.createDataFrame(page(two_columns()), adapters.SPANS)).orderBy("ord").collect()
    assert [r.ord for r in out] == list(range(len(out))) and len({r.id for r in out}) == len(out)
    text = [r for r in out if r.type == "text"]
    assert {r.column for r in text} == {0, 1}
    assert max(r.ord for r in text if r.column == 0) < min(r.ord for r in text if r.column == 1)
    assert any(r.type == "heading" and r.level == 1 for r in out) and any(r.type == "footer" for r in out)
    joined = " ".join(r.text for r in out)
    assert all(f"{side} column line number {i} " in joined for side in ("left", "right") for i in range(20))


def test_single_column_paragraphs_split_at_gaps_and_headings(spark):
    lines, y = [], 100
    for s in range(3):
        lines.append((f"{s + 1}. Section Title Words", 72, y, 250, 12))
        y += 20
        for p in range(2):
            for k in range(4):
                lines.append((f"section {s} paragraph {p} line {k} full of words that fill it", 72, y, 520 if k < 3 else 300, 10))
                y += 13
            y += 12
    out = layout.parse(spark.createDataFrame(page(lines), adapters.SPANS)).collect()
    assert sum(r.type == "heading" for r in out) == 3 and sum(r.type == "text" for r in out) == 6


def test_lines_have_runs_and_cells(spark):
    spans = [("d", 0, 595.0, 842.0, 0, 0, k, t, None, x0, 50.0, x1, 60.0, 10.0, f, fl, 0xFF0000) for k, (t, x0, x1, f, fl) in enumerate([("a ", 10.0, 20.0, "Times", 0), ("b", 21.0, 30.0, "Times", 0), ("C", 90.0, 99.0, "Times-Bold", 16)])]
    row = layout.lines(spark.createDataFrame(spans, adapters.SPANS)).first()
    assert row.text == "a bC" and [(r.text, r.bold) for r in row.runs] == [("a b", False), ("C", True)]
    assert [c.text for c in row.cells] == ["a b", "C"] and row.bold and row.colour.r == 1.0


def block(i, page_, kind, text, x0=56.0, y0=100.0, x1=500.0, y1=150.0, flags=(), size=10.0):
    return ("d", f"d-b{i:05d}", i, page_, kind, text, tuple(map(float, (x0, y0, x1, y1))), 0, None, size, list(flags))


SCHEMA = "doc_id string, id string, ord int, page int, type string, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, column int, level int, size double, flags array<string>"


def test_cut_paragraphs_are_joined_over_pages(spark):
    cut = "This paragraph is long enough to be cut by the end of the page and"
    rows = [block(0, 0, "text", cut, y0=700, y1=800, flags=["tail-full"]), block(1, 1, "figure", ""), block(2, 1, "text", "goes on here.", y0=200, y1=300), block(3, 1, "text", "New one: here.", y0=400, y1=450)]
    out = refine.join_cut_paragraphs(spark.createDataFrame(rows, SCHEMA)).orderBy("ord").collect()
    assert [r.text for r in out if r.type == "text"] == [cut + " goes on here.", "New one: here."] and [r.ord for r in out] == [0, 1, 2]


def test_references_title_and_outline(spark):
    rows = [block(0, 0, "heading", "A Long Title of a Paper", y0=60, y1=80, size=18.0), block(1, 0, "heading", "and Its Second Line", y0=84, y1=104, size=18.0), block(2, 0, "text", "body " * 20, y0=400, y1=500)]
    rows += [block(3, 1, "heading", "1. Introduction Part", size=13.0), block(4, 1, "heading", "2. Methods Part", size=13.0), block(5, 1, "heading", "Agronomy News", size=10.0), block(6, 2, "text", "References", size=13.0), block(7, 2, "text", "[1] Smith, J. A paper. 2020.")]
    rows += [block(8 + i, 3 + i, "text", f"Body number {i} ends here.") for i in range(8)]
    out = {r.ord: r for r in refine.refine(spark.createDataFrame(rows, SCHEMA), hoist=False).collect()}
    assert out[0].text == "A Long Title of a Paper and Its Second Line" and out[0].level == 1 and "title-continuation" in out[1].flags
    assert out[5].type == "meta" and "outline-demoted" in out[5].flags and out[3].type == out[4].type == "heading"
    assert out[6].type == "heading" and out[7].type == "reference"


def test_front_matter_goes_first_where_it_is_mixed_in(spark):
    rows = [block(0, 0, "text", "body one"), block(1, 0, "meta", "Received: today"), block(2, 0, "text", "body two")]
    assert [r.text for r in refine.front_matter_first(spark.createDataFrame(rows, SCHEMA)).orderBy("ord").collect()] == ["Received: today", "body one", "body two"]


def test_rule_tables(spark):
    lines = []
    for i, (a, b) in enumerate([("Model", "Score"), ("alpha", "0.91"), ("beta", "0.87"), ("gamma", "0.55")]):
        lines += [("d", 0, a, 60.0, 100.0 + 14 * i, 110.0, 110.0 + 14 * i), ("d", 0, b, 300.0, 100.5 + 14 * i, 330.0, 110.0 + 14 * i)]
    lines.append(("d", 0, "prose under the table that is long", 60.0, 400.0, 500.0, 410.0))
    df = spark.createDataFrame(lines, "doc_id string, page int, text string, x0 double, y0 double, x1 double, y1 double")
    found = regions.rule_tables(df).collect()
    assert len(found) == 1 and found[0].rows[0] == ["Model", "Score"] and len(found[0].rows) == 4
    tables = regions.kept_tables(df, regions.rule_tables(df))
    assert regions.members(df, tables).where("region IS NULL").count() == 1


def test_equations(spark):
    rows = [("d", 0, t, 100.0, 100.0 + 14 * i, 300.0, 112.0 + 14 * i) for i, t in enumerate(["We write the loss as a sum of terms here", "L = a + b", "(3)", "where the terms are as given above"])]
    df = spark.createDataFrame(rows, "doc_id string, page int, text string, x0 double, y0 double, x1 double, y1 double")
    got = regions.equations(df).collect()
    assert len(got) == 1 and got[0].number == "3" and (got[0].y0, got[0].y1) == (114.0, 140.0)


def test_translation_with_a_dictionary_retries_and_caches(spark):
    rows = blocks(spark, [("text", "Hello there"), ("text", "42"), ("text", "word " * 40)])

    class Half:
        name, model = "local", "half"

        def reply(self, prompt):
            import json

            items = json.loads(prompt[prompt.rindex("\n{") + 1 :])["items"]
            return json.dumps({"items": [{"id": i["id"], "text": "你好" if len(i["text"]) < 20 else ""} for i in items]})

    got = {r.ord: r for r in translate.translate(rows, Half(), "zh").collect()}
    assert set(got) == {0, 2} and (got[0].quality, got[0].attempts) == ("ok", 1) and (got[2].quality, got[2].attempts) == ("failed", 2)
    cache = translate.translate(rows, Half(), "zh")
    assert [r.ord for r in translate.translate(rows, Half(), "zh", cache=cache).collect()] == [2]
    echo = {r.ord: r.quality for r in translate.translate(rows, translate.EchoProvider(), "en").collect()}
    assert echo == {0: "ok", 2: "suspect"}  # a long text without any character of the target's script


def test_retries_wait_twice_as_long_each_time():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "x"

    assert translate.with_retries(call, sleep=waits.append) == "x" and waits == [1.0, 2.0]


def test_rendering(spark):
    df = spark.createDataFrame([('{"method": " m ", "key_findings": ["a", " "], "novelty": "n"}',)], "j string")
    assert df.select(export.summary_markdown(F.col("j"))).first()[0] == "## Method\n\nm\n\n## Key findings\n\n- a\n\n## Novelty\n\n- n"
    runs = spark.createDataFrame([("bold and it", [(0, 4, "bold"), (9, 11, "italic")])], "t string, r array<struct<start:int,end:int,style:string>>")
    assert runs.select(export.emphasis_markup(F.col("t"), F.col("r"))).first()[0] == "**bold** and *it*"
    rows = blocks(spark, [("heading", "H"), ("header", "x"), ("text", "body")]).withColumn("translation", F.lit("T"))
    assert export.markdown(rows).first().markdown == "## H / T\n\nbody\n\nT"
    assert export.markdown(rows, "translated").first().markdown == "## T\n\nT"


def test_files_with_errors_have_no_content(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 small")
    (tmp_path / "b.txt").write_bytes(b"no")
    (tmp_path / "c.pdf").write_bytes(b"x" * 100)
    rows = {r.path.rsplit("/", 1)[1]: r for r in adapters.read_files(spark, str(tmp_path), max_bytes=50).collect()}
    assert rows["a.pdf"].error is None and rows["a.pdf"].sha256 and rows["b.txt"].error == "suffix" and rows["c.pdf"].error == "too large" and rows["c.pdf"].content is None


def test_usage_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("2024-01-01 00:10:00", "a", 5), ("2024-01-01 00:50:00", "a", 7), ("2024-01-01 03:00:00", "b", 1)], "t string, provider string, tokens long").select(F.to_timestamp("t").alias("ts"), "provider", "tokens").write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, provider string, tokens long").parquet(source)
    out = usage.usage_windows(stream).writeStream.format("memory").queryName("usage_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination(60)
    assert [(r.provider, r.calls, r.tokens) for r in spark.table("usage_out").collect()] == [("a", 2, 12)]


def test_nearest_caption_is_that_of_all_pairs_without_pairs(spark):
    import random
    import time

    rng = random.Random(4)
    side = lambda: rng.choice([None, *range(0, 400, 7)])
    num = lambda v: None if v is None else float(v)
    boxes = lambda n: [(rng.choice([None, 1, 2, 3]), k, num(a), num(rng.choice([side(), None if a is None else a + rng.randrange(60)]))) for k in range(n) for a in [side()]]
    figs = spark.createDataFrame(boxes(300), "page int, figure int, y0 double, y1 double")
    caps = spark.createDataFrame([(*b, f"c{b[1]}") for b in boxes(25)], "page int, ord int, y0 double, y1 double, text string").where("page IS NULL OR page < 3")
    got = sorted(regions.nearest_caption(figs, caps, ["page"]).select("figure", "caption").collect())
    away = F.greatest(F.col("c.y0") - F.col("f.y1"), F.col("f.y0") - F.col("c.y1"), F.lit(0.0))
    pairs = figs.alias("f").join(caps.alias("c"), "page").where(away < 90).groupBy("figure").agg(F.min(F.struct(away.alias("gap"), "ord", "text"))["text"].alias("caption"))
    assert got == sorted(figs.join(pairs, "figure", "left").select("figure", "caption").collect())
    assert len({c for _, c in got}) > 5

    many = spark.range(60_000).select(F.lit(1).alias("page"), F.col("id").alias("ord"), (F.col("id") * 7919 % 100_003 * 10).cast("double").alias("y0"))
    many = many.withColumns({"y1": F.col("y0") + 5, "text": F.col("ord").cast("string")})
    began = time.monotonic()
    assert regions.nearest_caption(many.drop("text", "ord"), many, ["page"]).where("caption IS NOT NULL").count() == 60_000
    assert time.monotonic() - began < 60  # 3.6 billion pairs
