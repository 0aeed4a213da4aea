from __future__ import annotations

import os
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quire.llm import near_duplicates as N
from quire.llm.common import Sieve, clean, shared_dir

from .conftest import frame, odd_texts, words


def shingles(text: str | None) -> frozenset:
    w = (text or "").split()
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def brute(texts: list[str | None]) -> tuple[list[int], list[int]]:
    """Class (least index) and number of links of each text."""
    sets, root, links = [shingles(t) for t in texts], list(range(len(texts))), Counter()
    for i in range(len(texts)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if (union == 0) or len(sets[i] & sets[j]) / union >= 0.8 - 1e-12:
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                if a != b:
                    root = [min(a, b) if x in (a, b) else x for x in root]
    return root, [links[i] for i in range(len(texts))]


def family(base: str, n: int, edits: int, seed: int) -> list[str]:
    """Copies of a text with a few words changed in each."""
    r, out = random.Random(seed), []
    for i in range(n):
        w = base.split()
        for k in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"edit{seed}x{i}x{k}"
        out.append(" ".join(w))
    return out


def corpus() -> list[str | None]:
    shared = words(40, 9)
    out = odd_texts() + family(words(150, 3), 30, 3, 3) + family(words(60, 4), 20, 1, 4) + [f"{shared} {words(60, 100 + i)}" for i in range(30)]
    out += [words(150, 3)] * 5 + ["one two three", "one two three", "one two three four"]
    random.Random(8).shuffle(out)
    return out


def test_classes_and_links_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE", 8)  # many blocks a part
    texts = corpus()
    classes, links = brute(texts)
    rows = {r.doc_id: r for r in N.query(frame(spark, texts)).collect()}
    assert [rows[i].class_id for i in range(len(texts))] == classes
    assert [rows[i].n_links for i in range(len(texts))] == links


def test_keep_first(spark):
    texts = corpus()
    classes, _ = brute(texts)
    docs = frame(spark, texts)
    kept = N.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes))


def test_repeated_and_null_ids(spark):
    text, other = words(50, 1), words(50, 2)
    docs = frame(spark, [text, text, other, text, other], [7, 7, None, 3, None])
    rows = sorted(((r.doc_id is None, r.doc_id, r.class_id, r.n_links) for r in N.query(docs).collect()), key=str)
    assert rows == sorted([(False, 7, 3, 2), (False, 7, 3, 2), (False, 3, 3, 2), (True, None, None, 1), (True, None, None, 1)], key=str)
    assert sorted((r.doc_id or -1) for r in N.keep_first(docs).collect()) == [-1, 3]
    twice = frame(spark, [text, text, text], [7, 7, 8])
    assert [r.doc_id for r in N.keep_first(twice).collect()] == [7]


def test_empty_table(spark, empty):
    assert N.query(empty).count() == 0 and N.keep_first(empty).count() == 0


def test_banding_reaches_its_recall():
    bands, rows = N.banding()
    assert bands * rows <= N.HASHES and 1 - (1 - N.THRESHOLD**rows) ** bands >= N.RECALL
    r, sign, found = np.random.default_rng(1), N.Signer(bands, rows), 0
    for _ in range(200):
        grams = r.integers(0, 1 << 62, 100, dtype=np.uint64)
        one, two = grams[:90], np.concatenate([grams[:80], grams[90:]])  # similarity of 0.8
        found += bool((sign(one) == sign(two)).any())
    assert found >= 199


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (202, 201), (5, 5)]
    labels = {r.v: r.label for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({labels[i] for i in range(41)}) == 1 and len({labels[i] for i in range(100, 160)}) == 1 and len({labels[i] for i in (200, 201, 202)}) == 1
    assert len(set(labels.values())) == 3 and len(labels) == 41 + 60 + 3


def test_keep_first_keeps_unrelated_texts_with_equal_ids(spark):
    a, b, c, d = (words(50, i) for i in range(4))
    docs = frame(spark, [a, b, b, c, d, d], [None, None, None, 7, 7, 7])
    assert sorted(r.text for r in N.keep_first(docs).collect()) == sorted([a, b, c, d])
    # Two nodes of one class with the same id stay one document.
    near = family(words(150, 3), 8, 1, 3)
    assert N.keep_first(frame(spark, near, [5] * 8)).count() == 1


def test_links_with_as_many_blocks_as_nodes(spark, monkeypatch):
    """Some blocks get no node by hash: tiles with them count no links again."""
    monkeypatch.setattr(N, "TILE_CHARS", 1000)
    texts = family(words(150, 3), 6, 1, 3) + family(words(150, 5), 3, 1, 5) + family(words(150, 6), 2, 1, 6)
    classes, links = brute(texts)
    rows = {r.doc_id: r for r in N.query(frame(spark, texts)).collect()}
    assert [rows[i].class_id for i in range(len(texts))] == classes
    assert [rows[i].n_links for i in range(len(texts))] == links


def test_columns_named_like_helpers(spark):
    texts = family(words(150, 3), 5, 1, 3) + [words(30, 2), None, ""]
    docs = frame(spark, texts, [1, 1, 2, 3, None, 4, 5, 6])
    for c in ("_salt", "salt", "_key", "key", "_first", "may", "stays", "class_id", "n", "h"):
        docs = docs.withColumn(c, F.lit(c))
    kept = N.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5]
    assert N.query(docs).columns == ["doc_id", "class_id", "n_links"]


def test_size_classes_hold_every_pair_at_the_threshold(spark):
    pairs = [(n, m) for n in [*range(1, 400), 10**6, 10**9] for m in {n, -(-4 * n // 5)}]
    df = spark.createDataFrame(pairs, "n long, m long")
    assert df.where(N.size_class(F.col("n")) - N.size_class(F.col("m")) > 1).count() == 0


def test_sieve(spark):
    values = spark.range(5000).select((F.col("id") * 7).alias("v"))
    for most, false in ((1 << 27, 0.02), (1 << 16, 0.5)):
        sieve = Sieve(values, "v", most)
        assert values.where(~sieve.may_hold(F.col("v"))).count() == 0
        others = spark.range(5000).select((F.col("id") * 7 + 3).alias("v"))
        assert others.where(sieve.may_hold(F.col("v"))).count() <= false * 5000
    assert values.where(Sieve(values.limit(0), "v").may_hold(F.col("v"))).count() == 0


def test_scratch_tables_are_deleted(spark):
    clean()
    path = shared_dir(spark).removeprefix("file:")
    N.query(frame(spark, corpus())).collect()
    assert len([p for p in os.listdir(path) if p.startswith("table-")]) == 2  # what the result reads
    clean()
    assert not [p for p in os.listdir(path) if p.startswith("table-")]


def test_repeated_rows_are_never_broadcast(spark, tmp_path):
    from quire.llm.common import durable, salted_join

    few = durable(spark.range(2000).select(F.col("id").alias("k"), (F.col("id") + 1).alias("v")))
    many = spark.range(5000).select((F.col("id") % 2500).alias("k"), F.col("id").alias("n"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in ("10m", "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            for how, rows in (("inner", 4000), ("left", 5000), ("left_anti", 1000), ("left_semi", 4000)):
                found = salted_join(many, few, ["k"], how, [F.col("n")])
                plan = found._jdf.queryExecution().executedPlan().toString()
                assert not ("BroadcastHashJoin" in plan and "explode" in plan)
                assert found.count() == rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
