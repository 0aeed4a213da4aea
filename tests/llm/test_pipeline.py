from __future__ import annotations

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from quire.llm import packing, pii, toxicity
from quire.llm.common import clean, shared_dir, table

from .conftest import frame, odd_texts, words
from .test_near_duplicates import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage took and gave, over the smallest tables."""
    docs, out = table(spark, SF, "documents"), []
    for name, stage in C.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def test_order_and_columns(stages):
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "packing"]
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_toxicity_keeps_clean_documents(spark, stages):
    before, after = stages["toxicity"]
    net = toxicity.train(before, table(spark, SF, "labels"))
    texts = {r.doc_id: r.text for r in before.collect()}
    score = dict(zip(texts, toxicity.Scorer(net)(list(texts.values())), strict=True))
    assert {r.doc_id for r in after.collect()} == {i for i, s in score.items() if s < toxicity.THRESHOLD}
    assert after.count() > 0.7 * before.count()


def test_near_duplicates_keep_one_of_each_class(stages):
    before, after = stages["near_duplicates"]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    classes, _ = brute([t for _, t in rows])
    assert sorted(r.doc_id for r in after.collect()) == sorted({rows[c][0] for c in classes})


def test_personal_data_is_gone_and_other_text_stays(stages):
    before, after = stages["pii"]
    was, now = ({r.doc_id: r for r in df.collect()} for df in (before, after))
    assert was.keys() == now.keys()
    for i, r in now.items():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
        if not pii.candidates(was[i].text, pii.base_spans(was[i].text)):
            assert r.text == was[i].text


def test_mixing_repeats_rows_as_they_were(stages):
    before, after = stages["mixing"]
    was = {r.doc_id: r for r in before.collect()}
    assert all(r == was[r.doc_id] for r in after.collect())


def test_packing_packs_every_row(stages):
    before, after = stages["packing"]
    ids = packing.Tokens(packing.TOKENIZER)([r.text for r in before.collect()])
    assert after.agg({"length": "sum"}).first()[0] == sum(len(b) // 4 + 1 for b in ids)


def test_empty_documents(spark, empty, tmp_path):
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_run_is_the_chain_of_its_stages(spark, stages):
    """And leaves no stage's table behind but what its result reads."""
    clean()
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = C.run(spark, SF).select(*kept).collect()
    folders = [p for p in os.listdir(shared_dir(spark).removeprefix("file:")) if p.startswith(("table-", "pipeline-"))]
    assert Counter(map(tuple, got)) == Counter(map(tuple, stages["packing"][1].select(*kept).collect()))
    assert len(folders) <= 2


HELPERS = ["_score", "score", "may", "key", "stays", "class_id", "salt", "row", "copies", "target", "rank", "src", "tie", "n", "t", "y", "l_id", "id", "h"]


def test_odd_documents_go_through_every_stage(spark, tmp_path):
    """Null, empty, long, tying and repeated texts, null and repeated ids, a null source, and columns named like helpers."""
    base = [t for t in odd_texts() if t is None or "\0" not in t]
    texts = base + base[:4] + [words(60, 7)] * 5 + [words(200, i) for i in range(12)] + ["call +1 212 555 0100 or mail a.b@c.example.com"] * 2
    ids = [None if i % 7 == 3 else i // 2 for i in range(len(texts))]
    docs = frame(spark, texts, ids).drop("size", "id")
    for i, c in enumerate(HELPERS):
        docs = docs.withColumn(c, F.lit(i))
    for name, stage in C.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == before.columns, name
            assert docs.select(*HELPERS).distinct().count() == 1, name
        if name == "toxicity":
            assert docs.count() >= before.count() - 2
        if name == "near_duplicates":
            rows = before.select("doc_id", "text").collect()
            classes, _ = brute([r.text for r in rows])
            assert docs.count() == len(set(classes))
    assert docs.select("doc_id", "piece").count() > 0
