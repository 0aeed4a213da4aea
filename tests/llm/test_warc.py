from __future__ import annotations

import base64
import hashlib

import pytest

from quire.llm import warc as W

EVIL = "x\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.0\r\nmore"
PAGES = [(i, f"http://a/{i}", EVIL * (i % 3) + "é" * i if i % 2 else "same") for i in range(200)] + [(None, None, None), (300, "http://x\r\ny", ""), (None, "u", "same"), (301, "u", "WARC/1.0\r\n" * 9)]


def digest(html: str | None) -> str:
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize(("split", "compression"), [("128m", "gzip"), ("4k", "none")])
def test_round_trip(spark, split, compression):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, size string").repartition(2)
        rows = W.query(pages, compression).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    first: dict[str, int] = {}
    for i, _, h in PAGES:
        if i is not None:
            first[digest(h)] = min(i, first.get(digest(h), i))
    want = []
    for i, _, h in PAGES:
        d = digest(h)
        revisit = d in first and first[d] != i
        want.append((i, len((h or "").encode()), d, "revisit" if revisit else "response", first[d] if revisit else None))
    assert sorted(map(str, (tuple(r)[:5] for r in rows))) == sorted(map(str, want))
    assert all(r.verified for r in rows if r.record_type == "response")


def test_small_payloads_need_no_revisit(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    W.write(pages, str(tmp_path / "w"), least=5)
    assert sorted((r.id, r.record_type) for r in W.read(spark, str(tmp_path / "w")).collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_junk_after_a_broken_length_is_not_reached(spark, tmp_path):
    record = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{}>\r\nContent-Length: {}\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    block = len("HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc")
    (tmp_path / "a.warc").write_bytes((record.format(1, block) + record.format(2, block + 7) + record.format(3, block)).encode())
    assert sorted(r.id for r in W.read(spark, str(tmp_path / "a.warc")).collect())[:1] == [1]
    assert 3 not in {r.id for r in W.read(spark, str(tmp_path / "a.warc")).collect()}


def test_empty_table(spark):
    assert W.query(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_damaged_payloads_are_reported(spark, tmp_path):
    """What is read back counts, not what the heads say: a changed byte changes the digest, also that of the revisits."""
    pages = spark.createDataFrame([(1, "u", "abcdef"), (2, "u", "abcdef"), (3, "u", "other text")], "page_id long, url string, html string")
    W.write(pages.coalesce(1), str(tmp_path / "w"), compression="none")
    (file,) = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-")]
    file.write_bytes(file.read_bytes().replace(b"abcdef", b"abXdef"))
    for crc in (tmp_path / "w").glob(".*.crc"):
        crc.unlink()
    rows = {r.id: r for r in W.read(spark, str(tmp_path / "w")).collect()}
    assert (rows[1].payload_digest, rows[1].payload_bytes, rows[1].verified) == (digest("abXdef"), 6, False)
    assert (rows[2].payload_digest, rows[2].record_type, rows[2].refers_to) == (digest("abXdef"), "revisit", 1)
    assert (rows[3].payload_digest, rows[3].verified) == (digest("other text"), True)


def test_a_revisit_without_its_response(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abcdef"), (2, "u", "abcdef")], "page_id long, url string, html string")
    W.write(pages.coalesce(1), str(tmp_path / "w"), compression="none")
    (file,) = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-")]
    records = file.read_bytes().split(b"WARC/1.0\r\n")
    (tmp_path / "a.warc").write_bytes(b"".join(b"WARC/1.0\r\n" + r for r in records if b"revisit" in r))
    (row,) = W.read(spark, str(tmp_path / "a.warc")).collect()
    assert (row.id, row.record_type, row.refers_to, row.payload_bytes, row.payload_digest) == (2, "revisit", 1, None, None)


def test_a_very_long_payload(spark):
    long = "漢字 and words\r\n" * 400_000
    rows = {r.page_id: r for r in W.query(spark.createDataFrame([(1, "u", long), (2, "u", long + "x"), (3, "u", long)], "page_id long, url string, html string")).collect()}
    assert [(rows[i].payload_bytes, rows[i].payload_digest, rows[i].refers_to) for i in (1, 2, 3)] == [(len(t.encode()), digest(t), r) for t, r in ((long, None), (long + "x", None), (long, 1))]
