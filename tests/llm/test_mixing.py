from __future__ import annotations

import duckdb
import pytest

from quire.llm import mixing as M

from .conftest import frame, words

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = con.sql(M.ORACLE_SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = M.query(spark.read.parquet(f"{SF}/documents.parquet")).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got[expected.columns].equals(expected)


def test_targets_stop_at_three_times_and_share_the_excess(spark):
    sizes = {"a": 10, "b": 1000, "c": 3000, None: 500}
    s = spark.createDataFrame(list(sizes.items()), "src string, source_size long")
    got = {r.src: r.target for r in M.targets(s, (5, 2, 1), 3.0, "x").collect()}
    weights, total, capped = {"a": 5, "b": 2, "c": 1, None: 5}, 4510, {}
    while True:
        left, w = total - sum(capped.values()), sum(v for k, v in weights.items() if k not in capped)
        over = {k: 3.0 * sizes[k] for k in sizes if k not in capped and left * weights[k] / w > 3.0 * sizes[k]}
        if not over:
            break
        capped |= over
    want = {k: capped.get(k, left * weights[k] / w) for k in sizes}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(total)


def test_odd_rows(spark, odd, empty):
    rows = M.query(odd).collect()
    assert len(rows) == odd.count() and M.query(empty).count() == 0
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    assert {r.doc_id: r.size for r in rows}[0] == 0
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, M.query(odd.repartition(7)).collect()), key=str)


def test_taken_comes_near_the_targets_and_emits(spark):
    docs = frame(spark, [words(20 + i % 30, i) for i in range(600)])
    mixed = M.mix(docs)
    by: dict = {}
    for r in M.query(docs).collect():
        row = by.setdefault(r.source_size, [r.target, 0])
        row[1] += r.taken
    assert len(by) > 1 and all(abs(taken - target) <= 0.05 * target + 50 for target, taken in by.values())
    out = M.emitted(mixed)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in mixed.collect())


def test_repeated_rows(spark):
    docs = frame(spark, ["a b c d"] * 200, [1] * 200)
    assert sum(r.taken for r in M.query(docs).collect()) == pytest.approx(800, abs=30)
