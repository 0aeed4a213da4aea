"""Queries answer for every row of their tables: small tables whose rows lie outside former cuts."""

from __future__ import annotations

import pytest

from quire.plans.queries import QUERIES


@pytest.fixture
def tables(spark, tmp_path):
    """A writer of tables (rows, schema) by name to a folder, which it returns."""

    def write(**named) -> str:
        for name, (rows, schema) in named.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


TURNS = ([(c, t, "user", f"turn {c} {t}") for c in (0, 99, 100, 101, 250) for t in range(3)], "conv_id long, turn long, role string, text string")
EVENTS = "event_id long, user_id long, event_type string, value double"


def test_conversations_from_100_on_are_answered(spark, tables):
    events = [(10, 0, "purchase", 50.0), (21, 99, "view", 95.0), (32, 250, "click", 50.0)]
    d = tables(conversations=TURNS, events=(events, EVENTS))
    texts = {(r.doc_id, r.block_id): r.match_text for r in QUERIES["retrieval_text"](spark, d).collect()}
    assert texts == {(c, t): f"turn {c} {t}" for c, t, _, _ in TURNS[0]} | {(0, 0): "t10", (99, 1): "t21"}
    rollup = {r.doc_id: (r.blocks, r.translated, r.ok, r.failed) for r in QUERIES["quality_rollup"](spark, d).collect()}
    assert rollup == {0: (3, 1, 1, 0), 99: (3, 1, 0, 1), 100: (3, 0, 0, 0), 101: (3, 0, 0, 0), 250: (3, 0, 0, 0)}


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_terms_of_documents_beyond_ascii(spark, tables):
    d = tables(documents=([(i, t, "de", "s", len(t)) for i, t in enumerate(["Über die NATO heute", "Die NATO für alle, ÄÖÜX", "das ÄÖÜX"])], DOCUMENTS))
    terms = {r.term: r.n for r in QUERIES["candidate_terms"](spark, d).collect()}
    assert terms == {"NATO": 2}


def test_every_event_is_a_note(spark, tables):
    d = tables(conversations=TURNS, customer=([(99, "BUILDING")], "c_custkey long, c_mktsegment string"), events=([(i, 100 * i, "view", 50.0) for i in range(1, 15)], EVENTS))
    want = {(0, i % 10): sum(j % 10 == i % 10 for j in range(1, 15)) for i in range(1, 15)}
    assert {(r.doc_id, r.block_id): r.note_count for r in QUERIES["note_counts"](spark, d).collect()} == want
    shown = {(r.doc_id, r.block_id): r.note_count for r in QUERIES["blocks_with_variants"](spark, d).collect()}
    assert shown == {(c, t): want.get((c, t), 0) for c, t, _, _ in TURNS[0]}
    assert {(r.doc_id, r.n) for r in QUERIES["cascade_delete"](spark, d).collect() if r.kind == "notes"} == {(0, 14)}


def test_every_part_is_a_region(spark, tables):
    lines = ([(1, 1, 1, 10.0, 0.04)], "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double")
    d = tables(lineitem=lines, part=([(61, 11), (81, 11), (62, 11)], "p_partkey long, p_size int"))
    assert [(r.page, r.region, r.lines) for r in QUERIES["region_membership"](spark, d).collect()] == [(1, 61, 1)]


def test_sentences_end_where_blocks_do(spark, tables):
    long = "several words of a sentence that goes on and on " * 4
    d = tables(documents=([(0, long + "to its end.", "en", "s", 0), (1, "A whole sentence of many words that is closed. " * 4 + long + "and", "en", "s", 0)], DOCUMENTS))
    assert {r.doc_id: r.cut for r in QUERIES["mid_sentence_tails"](spark, d).collect()} == {0: False, 1: True}
