from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.retrieval import question_terms


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def over(spark, rule, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", rule(F.col("t")).alias("v")).orderBy("i").collect()]


def test_tokens(spark):
    text = "深度学习 3.5 x yz 好 GPU-2"
    want = ["深度", "度学", "学习", "3.5", "yz", "好", "gpu-", "2"]
    assert over(spark, T.tokens, [text]) == [want] and question_terms(text) == want


def test_estimate_tokens(spark):
    english, chinese = "The quick brown fox jumps over the lazy dog. " * 10, "敏捷的棕色狐狸跳过了懒狗身上然后跑进了深色的树林里面再也没有回来。" * 10
    a, b, empty = over(spark, T.estimate_tokens, [english, chinese, ""])
    assert 80 <= a <= 160 and b > a and empty == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2.8. 3D Point Cloud", True), ("1 Introduction", True), ("IV. Results and more", True), ("3.1.2. Fine Detail", True), ("0.72 to 0.97.", False), ("29 June 2022) and", False),
        ("100 images were taken", False), ("5 of 17", False), ("Figure 2. A", False), ("1.2.3.4 Too deep", False), ("8 positions where", False), ("2 0.5 cm, 0.42 cm, 3", False), ("", False), ("∑ 3", False),
    ],
)
def test_section_headings(spark, text, want):
    assert over(spark, T.is_section_heading, [text]) == [want]


def test_predicates(spark):
    assert over(spark, T.starts_caption, ["Fig. 3 x", "table 2", "Figures"]) == [True, True, False]
    assert over(spark, T.is_page_number, ["5 of 17", "Page 5 of 17", "12", "12 cats"]) == [True, True, True, False]
    assert over(spark, T.starts_citation, ["Yang, W.; Zhai, R. 3DPhenoMVS: A", "Yang wrote"]) == [True, False]
    assert over(spark, T.is_meta_label, ["Keywords: a, b", "ABSTRACT", "Scientific articles are long"]) == [True, True, False]
    assert over(spark, T.is_formula_line, ["x = y + z", "(12)", "a plain sentence with words = none at all here", ""]) == [True, True, False, False]
    assert over(spark, T.is_prose, ["…an R2 of 0.72 and a MAPE of 17.23% in the field", "x = y"]) == [True, False]
    long = "This sentence is long enough to be cut by the end of its page and"
    assert over(spark, T.ends_mid_sentence, [long, long + " ends.", "short and"]) == [True, False, False]
    assert over(spark, T.is_figure_label, ["(a)", "A B", "This is a sentence. It is"]) == [True, True, False]
    assert over(spark, T.opens_unit, ["Stem length: it is", "2.1. Methods Used", "and so on", ""]) == [True, True, False, True]
    assert over(spark, T.garbage_count, ["�□(cid:12)x"]) == [3]
    assert over(spark, T.is_standalone, ["Note:", "12", "a line of text that goes on"]) == [True, True, False]


def test_strip_takes_all_white_space(spark):
    assert over(spark, T.strip, ["\t a \n　"]) == ["a"]


def test_hyphens(spark):
    assert over(spark, T.repair_hyphens, ["hyphen-\nation and\nmore", "a - \nb"]) == ["hyphenation and more", "a - b"]


def test_json_is_recovered(spark):
    good = ['{"a": 1}', '```json\n{"a": 1}\n```', 'Sure: {"a": 1} as asked', "list [1, 2] end", "none", "{broken"]
    assert over(spark, T.json_in, good) == ['{"a": 1}', '{"a": 1}', '{"a": 1}', "[1, 2]", None, None]


def test_highlight_and_escape(spark):
    assert over(spark, lambda c: T.highlight(c, "a.b"), ["xA.Bx acb"]) == ["x<mark>A.B</mark>x acb"]
    assert over(spark, T.escape_html, ["<a href=\"x\">&'"]) == ["&lt;a href=&quot;x&quot;&gt;&amp;&#x27;"]
    assert re.escape("a.b") == r"a\.b"
