"""Block tables from plain text tables, and readers of document bytes and spans."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T

#: PyMuPDF's rawdict, flat: one row a span.
SPANS = "doc_id string, page int, page_width double, page_height double, block_no int, line_no int, span_no int, text string, chars array<struct<c: string>>, x0 double, y0 double, x1 double, y1 double, size double, font string, flags int, color int"
HEADING_MOST = 80


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One block a line: (doc_id, ord, text, type); type is blank, heading (short, unpunctuated) or text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("ord", "text"))
    kind = F.when(~F.col("text").rlike(r"\S"), "blank").when((F.length("text") <= HEADING_MOST) & ~F.col("text").rlike("[.!?;:,]$"), "heading").otherwise("text")
    return rows.withColumn("type", kind)


def content_hash(content: F.Column | str) -> F.Column:
    return F.sha2(F.col(content) if isinstance(content, str) else content, 256)


def read_files(spark: SparkSession, path: str, max_bytes: int = 200 * 1024 * 1024, suffix: str = ".pdf") -> DataFrame:
    """Files as (path, size, content, sha256, error): those with another suffix or beyond the cap have an error, no content."""
    files = spark.read.format("binaryFile").load(path)
    error = F.when(~F.lower("path").endswith(suffix), "suffix").when(F.col("length") > max_bytes, "too large")
    content = F.when(error.isNull(), F.col("content"))
    return files.select("path", F.col("length").alias("size"), content.alias("content"), content_hash(content).alias("sha256"), error.alias("error"))


def decode_pdf(files: DataFrame) -> DataFrame:
    """Spans of PDF files, where a decoder is installed on the executors; it is an optional part."""

    def run(batches):
        import pandas as pd

        try:
            import pymupdf
        except ImportError as e:
            raise RuntimeError("decode_pdf needs pymupdf on the executors; or bring a table of spans") from e
        for b in batches:
            for row in b.itertuples():
                if row.content is None:
                    continue
                pdf, rows = pymupdf.open(stream=bytes(row.content), filetype="pdf"), []
                for p, page in enumerate(pdf):
                    for bn, block in enumerate(x for x in page.get_text("dict")["blocks"] if x.get("type") == 0):
                        for ln, line in enumerate(block["lines"]):
                            rows += [(row.sha256[:12], p, page.rect.width, page.rect.height, bn, ln, sn, s["text"], None, *s["bbox"], s["size"], s["font"], s["flags"], s["color"]) for sn, s in enumerate(line["spans"])]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SPANS.replace("array<struct<c: string>>", "x").split(", ")])

    return files.select("sha256", "content").mapInPandas(run, SPANS)


def authors_of(author: F.Column) -> F.Column:
    """At most twelve names from a PDF's author field."""
    return F.slice(F.filter(F.transform(F.split(author, "[;,]| and "), T.strip), lambda x: x != ""), 1, 12)


def ocr_rows(words: DataFrame, least: float = 0.5) -> DataFrame:
    """Recognised words (doc_id, page, text, conf, box in pixels, dpi) as lines in points, the unsure ones dropped."""
    scale = F.lit(72.0) / F.col("dpi")
    kept = words.where(F.col("conf") >= least).withColumn("text", T.strip(F.regexp_replace("text", r"(?U)\s+", " ")))
    box = [(F.col(c) * scale).alias(c) for c in ("x0", "y0", "x1", "y1")]
    lines = kept.select("doc_id", "page", "text", "conf", *box)
    heights = lines.groupBy("doc_id", "page").agg(F.median(F.col("y1") - F.col("y0")).alias("h"), F.avg("conf").alias("page_conf"))
    return lines.join(heights, ["doc_id", "page"]).withColumn("size", F.least(F.lit(20.0), F.greatest(F.lit(7.0), F.col("h") * 0.78))).drop("h")


def needs_ocr(pages: DataFrame, mode: str = "auto") -> DataFrame:
    """pages (chars, image_area, page_area) with ``ocr``: forced, off, or for pages with little text under large images."""
    cover = F.least(F.lit(1.0), F.col("image_area") / F.col("page_area"))
    rule = {"force": F.lit(True), "off": F.lit(False)}.get(mode, (F.col("chars") < 240) & (cover >= 0.35))
    return pages.withColumn("image_coverage", cover).withColumn("ocr", rule)


def recognise(pages: DataFrame, engine: Callable[[], Callable[[bytes], Sequence[tuple[str, float, float, float, float, float]]]]) -> DataFrame:
    """Words of page images (doc_id, page, dpi, png) by a recogniser: (doc_id, page, text, conf, box in pixels, dpi).

    ``engine`` makes the recogniser, once in each worker, as loading its model takes long; that maps an image to
    (text, conf, x0, y0, x1, y1). An engine that can't be made fails the query, it isn't passed over.
    """
    kind = dict(pages.dtypes)["doc_id"]
    columns = ["doc_id", "page", "text", "conf", "x0", "y0", "x1", "y1", "dpi"]

    def run(batches):
        import pandas as pd

        held = sys.modules.setdefault("_quire_engine", types.ModuleType("_quire_engine")).__dict__
        if held.get("made_by") != repr(engine):
            held.update(made_by=repr(engine), read=engine())
        for b in batches:
            rows = [(r.doc_id, r.page, *word, r.dpi) for r in b.itertuples() for word in held["read"](bytes(r.png))]
            yield pd.DataFrame(rows, columns=columns)

    schema = f"doc_id {kind}, page int, text string, conf double, x0 double, y0 double, x1 double, y1 double, dpi int"
    return pages.select("doc_id", "page", "dpi", "png").mapInPandas(run, schema)


def iso_time(ts: F.Column) -> F.Column:
    """A time as text, to the second, in the session's zone."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
