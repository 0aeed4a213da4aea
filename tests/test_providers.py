"""Translation, summaries, glossaries and answers from end to end, with providers that need no network."""

from __future__ import annotations

import json

import pytest

from quire.operators import retrieval, translate
from quire.sources import adapters

SCHEMA = "doc_id string, id string, ord int, page int, type string, text string, table_rows array<array<string>>"


def blocks(spark, rows, doc="d"):
    return spark.createDataFrame([(doc, f"{doc}-b{i:05d}", i, i // 4, kind, text, grid) for i, (kind, text, *rest) in enumerate(rows) for grid in [rest[0] if rest else None]], SCHEMA)


def payload(prompt):
    return json.loads(prompt[prompt.rindex("\n{") + 1 :])


class Logged:
    """Answers by rule, and writes what it was asked to a folder."""

    name, model = "local", "logged"

    def __init__(self, folder, answer):
        self.folder, self.answer = str(folder), answer

    def reply(self, prompt):
        import os
        import uuid

        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
            f.write(prompt)
        return self.answer(prompt)

    def asked(self):
        import os

        return [open(os.path.join(self.folder, p)).read() for p in os.listdir(self.folder)]


def chinese(prompt):
    p = json.loads(prompt[prompt.rindex("\n{") + 1 :])
    import re

    keep = lambda t: "译文" + "".join(re.findall(r"<ph[^>]*>", t))
    if "rows" in p:
        return json.dumps({"rows": [[keep(c) for c in r] for r in p["rows"]]})
    return "Here: " + json.dumps({"items": [{"id": i["id"], "text": keep(i["text"])} for i in p["items"]]})


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "asked").mkdir()
    return tmp_path / "asked"


def test_a_document_with_a_table_and_a_glossary(spark, folder):
    grid = [["Model", "Score", "Unit"], ["ResNet", "0.91", "%"]]
    rows = blocks(spark, [("heading", "Methods of work"), ("text", "The scanner saw 12 plants [3]."), ("table", "", grid), ("text", "It was fine weather.")])
    glossary = spark.createDataFrame([("d", "scanner", "扫描仪"), ("other", "x", "y")], "doc_id string, source string, target string")
    provider = Logged(folder, chinese)
    got = translate.translate(rows, provider, "zh", glossary=glossary)
    out = {r.ord: r for r in got.collect()}
    assert set(out) == {0, 1, 2, 3} and {out[i].quality for i in (0, 1, 3)} == {"ok"}
    assert "12" in out[1].text and "[3]" in out[1].text and "译文" in out[1].text
    assert len(json.loads(out[2].text)) == 2 and "0.91" in json.loads(out[2].text)[1][1]
    asked = provider.asked()
    assert len(asked) == 2 and all("scanner = 扫描仪" in p for p in asked)  # one call for the chunk, one for the table
    got.collect()
    got.where("quality = 'ok'").count()
    assert len(provider.asked()) == 2  # replies are stored: looking again asks nobody


def test_context_of_a_chunk_is_the_text_before_it(spark, folder):
    rows = blocks(spark, [("text", f"Sentence number {i} " + "with many words " * 12) for i in range(4)])
    provider = Logged(folder, chinese)
    translate.translate(rows, provider, "zh", budget=150).collect()
    later = [p for p in provider.asked() if any(i["id"] == "3" for i in payload(p)["items"])]
    assert later and "Context, not to be translated" in later[0] and "Sentence number 1" in later[0][: later[0].rindex("\n{")]


def test_a_table_reply_of_another_shape_fails(spark):
    class Lossy:
        name, model = "local", "lossy"

        def reply(self, prompt):
            return json.dumps({"rows": [["a"]]})

    (out,) = translate.translate(blocks(spark, [("table", "", [["Name", "Value"], ["alpha", "beta"]])]), Lossy(), "zh").collect()
    assert (out.quality, out.text, out.problems) == ("failed", "", ["shape"])


class Down:
    name, model, wait = "local", "down", 0.0

    def reply(self, prompt):
        raise OSError("no connection")


def test_a_document_is_given_up_after_failures_in_a_row(spark):
    chunks = spark.createDataFrame([("a", i, "p") for i in range(6)] + [("b", 0, "p")], "doc_id string, chunk_id int, prompt string")
    rows = {(r.doc_id, r.chunk_id): r.error for r in translate.call_chunks(chunks, Down(), "zh").collect()}
    assert [rows["a", i] for i in range(6)] == ["OSError", "OSError"] + ["given up"] * 4 and rows["b", 0] == "OSError"
    assert {r.error for r in translate.call_chunks(chunks, Down(), "zh", give_up=None).collect()} == {"OSError"}


def test_summaries_are_made_once(spark, folder):
    rows = blocks(spark, [("heading", "Title of it"), ("text", "What was found is this.")]).unionByName(blocks(spark, [("text", "Another document.")], "e"))
    provider = Logged(folder, lambda p: json.dumps({"method": "by hand", "key_findings": [json.loads(p[p.rindex("\n{") + 1 :])["document"][:12]]}))
    out = {r.doc_id: r for r in translate.summarise(rows, provider, "en").collect()}
    assert out["d"].markdown == "## Method\n\nby hand\n\n## Key findings\n\n- [heading] Ti" and set(out) == {"d", "e"}
    cache = translate.summarise(rows.where("doc_id = 'd'"), provider, "en")
    assert [r.doc_id for r in translate.summarise(rows, provider, "en", cache=cache).collect()] == ["e"]


def test_a_glossary_is_built_from_candidates(spark, folder):
    rows = blocks(spark, [("text", "BERT and GPUs. BERT is used with GPUs. Deep Learning methods and Deep Learning methods.")])

    def answer(prompt):
        p = json.loads(prompt[prompt.rindex("\n{") + 1 :])
        return "```json\n" + json.dumps({"terms": [{"source": t, "target": f"{t}译", "note": "n" * 300} for t in p["candidates"]] + [{"source": "x", "target": "y"}, {"source": "empty", "target": " "}]}) + "\n```"

    provider = Logged(folder, answer)
    out = {r.source: r for r in translate.build_glossary(rows, provider).collect()}
    assert "BERT" in out and out["BERT"].target == "BERT译" and len(out["BERT"].note) == 200 and "x" not in out and "empty" not in out
    assert "BERT and GPUs" in payload(provider.asked()[0])["sample"]


def test_an_answer_with_its_evidence(spark, folder):
    rows = blocks(spark, [("text", "The scanner measures plants in the field."), ("text", "Weather was fine."), ("text", "Plants grow slowly."), ("heading", "The end")])

    def answer(prompt):
        found = json.loads(prompt[prompt.rindex("\n{") + 1 :])["passages"]
        return json.dumps({"answer": "It measures plants.", "evidence": [{"id": found[0]["id"], "quote": "measures plants"}, {"id": "nowhere", "quote": "made up"}]})

    provider = Logged(folder, answer)
    (out,) = translate.ask(rows, "what does the scanner measure", provider, "en", k=2).collect()
    assert out.answer == "It measures plants." and [(e.id, e.quote) for e in out.evidence] == [("d-b00000", "measures plants")]
    silent = Logged(folder, lambda p: json.dumps({"answer": "unknown", "evidence": []}))
    (spare,) = translate.ask(rows, "what does the scanner measure", silent, "en", k=2).collect()
    chosen = retrieval.contexts(rows, "what does the scanner measure", 2).where("position <= 3").count()
    assert len(spare.evidence) == chosen


def test_recognition_with_an_engine(spark):
    class Engine:
        def __call__(self):
            return lambda png: [(png.decode(), 0.9, 0.0, 0.0, 10.0, 10.0), ("unsure", 0.2, 0.0, 20.0, 10.0, 30.0)]

    pages = spark.createDataFrame([("d", 0, 200, bytearray(b"first")), ("d", 1, 200, bytearray(b"second"))], "doc_id string, page int, dpi int, png binary")
    words = adapters.recognise(pages, Engine())
    assert sorted((r.page, r.text, r.conf) for r in words.collect()) == [(0, "first", 0.9), (0, "unsure", 0.2), (1, "second", 0.9), (1, "unsure", 0.2)]
    assert sorted(r.text for r in adapters.ocr_rows(words).collect()) == ["first", "second"]


def test_translation_leaves_only_its_results_behind(spark):
    import os

    from quire.sources.scratch import shared_dir

    where = shared_dir(spark).removeprefix("file:")
    there = lambda: {n for n in os.listdir(where) if n.startswith("step-")}
    rows = blocks(spark, [("text", f"Line {i} of the words that are long enough to be looked at for Chinese signs.") for i in range(30)])
    before = there()
    out = translate.translate(rows, translate.EchoProvider(), "zh", budget=150)
    assert len(there() - before) == 2  # texts and tables
    assert [(r.ord, r.attempts, r.quality) for r in out.orderBy("ord").collect()] == [(i, 2, "suspect") for i in range(30)]
