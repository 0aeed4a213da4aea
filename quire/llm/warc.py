"""WARC archives: a writer with revisit records, and a reader that verifies the chain of record boundaries.

Writing: every row is a record whose payload is a text in UTF-8 behind a short HTTP head. Of rows with equal payloads of at
least ``least`` bytes the one with the smallest id is a response, the others are revisits of it with the head alone. A
record ends in two line ends, which is the line separator Spark's text writer is given: any store that Spark writes will do,
and a lost task is written again.

Reading: Spark's text reader cuts the files at the magic ``WARC/1.0`` wherever it stands, also within payloads, and splits
large files. Lengths summed by split, then over splits, give each piece its offset. A piece's head gives a candidate pair:
its own offset and, by Content-Length, its successor's. Pointer jumping in each split takes every candidate to where its
chain leaves the split; where files have several splits, doubling over these exits finds where the chain from the
file's start enters each; a last pass marks what is reached. Other candidates are magic inside payloads: their pieces
belong to the record before, and where a record was cut by one, its pieces are read again and joined.

Only heads, lengths and digests pass through the shuffles of the reader, never payloads, but for such cut records. Lengths and
digests are those of the bytes read back; a revisit has its response's. A response whose payload was damaged has the length
and digest of what is there, and ``verified`` is false of it.

Defined cases: a null text is an empty payload; a null id is last among equals, and null in ``refers_to``; rows with the same
smallest id and payload are all responses; repeated rows give repeated records; a revisit whose response is not in the archive
has neither length nor digest; very long payloads are payloads as others; an empty table gives an empty archive and no rows.
Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import durable, forget, salted_join, scratch_path

#: Fixed values of the format.
MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def base32(sha1_hex: Column) -> Column:
    """Of the 40 hexadecimal digits: the 32 characters that stand for five bits each."""
    five = lambda i: F.conv(F.substring(sha1_hex, (i / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("int")
    letter = lambda i: F.substring(F.lit(BASE32), F.call_function("shiftright", five(i), 15 - 5 * (i % 4)).bitwiseAND(31) + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def write(pages: DataFrame, path: str, id_col: str = "page_id", text_col: str = "html", url_col: str = "url", least: int = 0, compression: str = "gzip", most: int = 20_000) -> None:
    """One record for each row, under ``path``, in files of at most ``most`` records.

    A compressed file is read by one task; with compression none large files are split.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.regexp_replace(F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")), r"[\x00-\x20\x7F]", "").alias("url"), text.alias("text"))
    rows = rows.withColumn("size", F.octet_length("text").cast("long")).withColumn("sha1", F.sha1(F.col("text").cast("binary")))
    equal = rows.groupBy("sha1", "size").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("size") >= least)).drop("n")
    rows = salted_join(rows, equal, ["sha1", "size"], "left", [F.col("id")])
    again = F.coalesce(F.col("first") != F.col("id"), F.col("first").isNotNull() & F.col("id").isNull())
    name = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit(END))
    block = F.when(again, http).otherwise(F.concat(http, F.col("text")))
    lines = [
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.when(F.col("url") != "", F.concat(F.lit("WARC-Target-URI: "), F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha1"))),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), name(F.col("first")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    ]
    rows.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)).write.mode("overwrite").option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", most).text(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between one magic and the next: file, block (start of the split), at (offset of its magic), value.

    The piece before a file's first magic has at = -10; it is empty in a sound archive.
    """
    # From the reader on, order within a split is the order of the ids.
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), F.col("value"))


def placed(rows: DataFrame) -> DataFrame:
    """Rows (file, block, nth, bytes, ...) with ``at``, the offset of the magic before each."""
    in_block = Window.partitionBy("file", "block").orderBy("nth")
    span = F.col("bytes") + len(MAGIC)
    totals = rows.groupBy("file", "block").agg(F.sum(span).alias("span"))
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("file", "block", F.coalesce(F.sum("span").over(in_file), F.lit(0)).alias("start"))
    before = F.coalesce(F.sum(span).over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("before", before).join(starts, ["file", "block"]).withColumn("at", F.col("start") + F.col("before") - len(MAGIC)).drop("start", "before", "nth")


def _field(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf"(?im)^{name}: *([^\r\n]*)", 1)


def heads(rows: DataFrame) -> DataFrame:
    """Pieces without their text: lengths, the fields of the record's head, and the payload's size and digest."""
    head = F.substring_index("value", END, 1)
    rows = rows.withColumn("head", F.when(F.col("value").contains(END), head))
    rows = rows.withColumn("bytes", F.octet_length("value").cast("long")).withColumn("head_bytes", F.octet_length("head") + len(END))
    rows = rows.withColumn("length", _field(F.col("head"), "Content-Length").try_cast("long"))
    raw = F.col("value").cast("binary")
    block = F.substring(raw, F.col("head_bytes") + 1, F.col("length").cast("int"))
    http = F.substring_index(block.cast("string"), END, 1)
    rows = rows.withColumn("http", http)
    payload = F.substring(block, F.octet_length("http") + len(END) + 1, F.lit(2**31 - 1))
    return rows.select(
        "file", "block", "nth", "bytes", "length", "head_bytes",
        _field(F.col("head"), "WARC-Type").alias("record_type"),
        _field(F.col("head"), "WARC-Record-ID").alias("name"),
        _field(F.col("head"), "WARC-Refers-To").alias("refers"),
        F.regexp_replace(_field(F.col("head"), "WARC-Payload-Digest"), "^sha1:", "").alias("named_digest"),
        F.octet_length(payload).cast("long").alias("size"),
        F.sha1(payload).alias("sha1"),
    )


def _steps(at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """For each candidate the index of its successor in the same split, or its own."""
    found = np.searchsorted(at, to)
    inside = (found < len(at)) & (at[np.minimum(found, len(at) - 1)] == to)
    return np.where(inside, found, np.arange(len(at)))


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """Where the chain of each candidate of a split leaves it, by pointer jumping."""
    rows = rows.sort_values("at", ignore_index=True)
    at, to = rows["at"].to_numpy(), rows["to"].to_numpy()
    step = _steps(at, to)
    while True:
        further = step[step]
        if (further == step).all():
            break
        step = further
    return rows.assign(leaves=to[step])[["file", "at", "leaves"]]


def _reached(rows: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a split that the chain from where it is entered reaches, by pointer jumping."""
    rows = rows.sort_values("at", ignore_index=True)
    step = _steps(rows["at"].to_numpy(), rows["to"].to_numpy())
    on = rows["entered"].to_numpy().astype(bool)
    while True:
        # After k rounds ``step`` is 2^k links long and ``on`` has all candidates less than 2^k links from an entry.
        on[step[on]] = True
        further = step[step]
        if (further == step).all():
            return rows[on][["file", "at"]]
        step = further


def chain(candidates: DataFrame) -> DataFrame:
    """candidates (file, block, at, to) to the (file, at) that the chain from each file's start reaches."""
    splits = candidates.groupBy("file").agg(F.count_distinct("block").alias("n")).agg(F.max("n").alias("n")).first().n or 0
    entered = candidates.select("file", "block", "at", "to", (F.col("at") == 0).alias("entered"))
    if splits > 1:
        jump = durable(candidates.groupBy("file", "block").applyInPandas(_exits, "file string, at long, leaves long").where("leaves > at"))
        reach = candidates.where("at = 0").select("file", "at")
        for k in range((splits - 1).bit_length()):
            before, reach = reach, durable(reach.union(reach.join(jump, ["file", "at"]).select("file", F.col("leaves").alias("at"))).distinct())
            forget(before)
            if k + 1 < (splits - 1).bit_length():
                on = jump.select("file", F.col("at").alias("leaves"), F.col("leaves").alias("then"))
                before, jump = jump, durable(jump.join(on, ["file", "leaves"], "left").select("file", "at", F.coalesce("then", "leaves").alias("leaves")))
                forget(before)
        entered = candidates.join(reach.withColumn("entered", F.lit(True)), ["file", "at"], "left").select("file", "block", "at", "to", F.coalesce("entered", F.lit(False)).alias("entered"))
    return entered.groupBy("file", "block").applyInPandas(_reached, "file string, at long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to, verified), one row a record that the chain reaches, written down.

    ``verified``: the payload read back has the digest that the head gives; null for revisits.
    """
    slim = durable(placed(heads(pieces(spark, path))))
    found = slim.where("at >= 0 AND length IS NOT NULL").withColumn("to", F.col("at") + len(MAGIC) + F.col("head_bytes") + F.col("length") + len(END))
    reached = durable(chain(found.select("file", "block", "at", "to")))
    records = found.join(reached, ["file", "at"])
    # A reached record whose piece is shorter than the record was cut at a magic inside its payload.
    cut = records.where(F.col("to") > F.col("at") + len(MAGIC) + F.col("bytes"))
    if cut.limit(1).count():
        whole = records.join(_rejoined(spark, path, slim, reached, cut), ["file", "at"], "left")
        records = whole.withColumns({"size": F.coalesce("whole_size", "size"), "sha1": F.coalesce("whole_sha1", "sha1")})
    records = durable(records.select("name", "record_type", "refers", "named_digest", "size", base32(F.col("sha1")).alias("digest")))
    forget(slim, reached)
    right = F.col("digest") == F.col("named_digest")
    again = records.where("record_type = 'revisit'").select("name", "record_type", "refers", "named_digest")
    # Responses that are revisited, one row each; a third of all records may be revisits of one.
    named = again.select(F.col("refers").alias("name"), "named_digest").distinct()
    responses = records.where("record_type = 'response'")
    sources = responses.join(named, ["name", "named_digest"]).groupBy(F.col("name").alias("refers"), "named_digest").agg(F.max_by(F.struct("size", "digest"), right).alias("r"))
    revisits = salted_join(again, sources, ["refers", "named_digest"], "left", [F.col("name")])
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    row = lambda df, size, digest, refers, verified: df.select(number(F.col("name")).alias("id"), F.col(size).alias("payload_bytes"), F.col(digest).alias("payload_digest"), "record_type", refers.alias("refers_to"), verified.alias("verified"))
    out = row(responses, "size", "digest", F.lit(None).cast("long"), right).unionAll(row(revisits, "r.size", "r.digest", number(F.col("refers")), F.lit(None).cast("boolean")))
    written = durable(out)
    forget(records)
    return written


def _rejoined(spark: SparkSession, path: str, slim: DataFrame, reached: DataFrame, cut: DataFrame) -> DataFrame:
    """(file, at, whole_size, whole_sha1) of records that a magic inside the payload has cut."""
    # Each piece belongs to the last reached record at or before it; within a split, then from the splits before.
    marked = slim.select("file", "block", "at").join(reached.withColumn("own", F.col("at")), ["file", "at"], "left")
    ends = marked.groupBy("file", "block").agg(F.max("own").alias("top"))
    before = ends.select("file", "block", F.max("top").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    upto = Window.partitionBy("file", "block").orderBy("at")
    owned = marked.join(before, ["file", "block"]).select("file", "at", F.coalesce(F.max("own").over(upto), "carried").alias("record"))
    wanted = owned.join(cut.select("file", F.col("at").alias("record"), "head_bytes", "length"), ["file", "record"])
    again = placed(pieces(spark, path).withColumn("bytes", F.octet_length("value").cast("long")))
    parts = wanted.join(again.select("file", "at", "value"), ["file", "at"])
    whole = parts.groupBy("file", "record", "head_bytes", "length").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["value"]), MAGIC).cast("binary")
    block = F.substring(text, F.col("head_bytes") + 1, F.col("length").cast("int"))
    payload = F.substring(block, F.octet_length(F.substring_index(block.cast("string"), END, 1)) + len(END) + 1, F.lit(2**31 - 1))
    return whole.select("file", F.col("record").alias("at"), F.octet_length(payload).cast("long").alias("whole_size"), F.sha1(payload).alias("whole_sha1"))


def query(pages: DataFrame, compression: str = "gzip") -> DataFrame:
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path, compression=compression)
    back = read(pages.sparkSession, path)
    forget(path)
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


ORACLE_SQL = r"""
WITH hashed AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
coded AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest FROM hashed),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM coded)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, CASE WHEN page_id = first THEN true END AS verified FROM firsts
"""
