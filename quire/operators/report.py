"""Reports on documents, translations and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

#: Weights of the quality score and what a page of text is expected to hold.
CHARS_PER_PAGE = 2000
OCR_LEAST_CONFIDENCE = 0.85
GOOD, FAIR = 80, 55


def parse_report(blocks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, chars, garbage_ratio, text_coverage, paragraphs, ...) from blocks, one aggregate a document.

    ``pages`` (doc_id, page, alignment, ocr, ocr_confidence) adds the dominant alignment and the channel.
    """
    body = F.col("type").isin("text")
    aggs = [
        F.sum(F.length("text")).alias("chars"),
        F.sum(T.garbage_count(F.col("text"))).alias("garbage"),
        F.count_if(body).alias("paragraph_count"),
        F.count_if(F.col("type") == "heading").alias("heading_count"),
        F.count_if(F.col("type") == "figure").alias("figure_count"),
        F.count_if(F.col("type") == "table").alias("table_count"),
        F.count_if(F.col("type") == "formula").alias("formula_count"),
        F.count_distinct("page").alias("page_count"),
    ]
    out = blocks.groupBy("doc_id").agg(*aggs)
    out = out.withColumn("text_coverage", F.col("chars") / F.greatest(F.col("page_count"), F.lit(1)) / CHARS_PER_PAGE)
    out = out.withColumn("garbage_ratio", F.least(F.lit(1.0), F.col("garbage") / F.greatest(F.col("chars"), F.lit(1))))
    if pages is None:
        return out
    ocr = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("ocr").alias("ocr_pages"), F.round(F.avg(F.when(F.col("ocr"), F.col("ocr_confidence"))), 3).alias("ocr_confidence"))
    mostly = F.col("ocr_pages") >= F.greatest(F.lit(1), F.floor(F.col("n") * 0.5))
    channel = F.when(F.col("ocr_pages") == 0, "text-layer").when(mostly, "ocr").otherwise("text-layer+ocr")
    return out.join(ocr.withColumn("channel", channel).drop("n"), "doc_id", "left").join(dominant(pages, "doc_id", "alignment", "page", ignore="unknown"), "doc_id", "left")


def dominant(rows: DataFrame, key: str, value: str, order: str, ignore: str | None = None) -> DataFrame:
    """(key, value): the most frequent value of each key; of equals the one that comes first in order."""
    kept = rows if ignore is None else rows.where(F.col(value) != ignore)
    counted = kept.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counted.groupBy(key).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), "first")).alias(value))


def quality_score(garbage_ratio: Column, paragraphs: Column, coverage: Column, ocr_pages: Column | None = None, confidence: Column | None = None, warnings: Column | None = None) -> Column:
    """0 to 100: what garbage, missing text, recognition and warnings leave."""
    score = F.lit(100.0) - F.least(F.lit(40.0), garbage_ratio * 400.0)
    score = score - F.when(paragraphs > 0, 0.0).otherwise(30.0) - F.when(coverage > 0.02, 0.0).otherwise(25.0)
    if ocr_pages is not None:
        score = score - F.when(ocr_pages > 0, F.least(F.lit(20.0), 4.0 + 0.06 * ocr_pages)).otherwise(0.0)
        if confidence is not None:
            unsure = (ocr_pages > 0) & (confidence > 0) & (confidence < OCR_LEAST_CONFIDENCE)
            score = score - F.when(unsure, F.least(F.lit(15.0), (OCR_LEAST_CONFIDENCE - confidence) * 60.0)).otherwise(0.0)
    if warnings is not None:
        score = score - 5.0 * warnings
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def grade(score: Column) -> Column:
    return F.when(score >= GOOD, "good").when(score >= FAIR, "fair").otherwise("poor")


def usage_totals(usage: DataFrame) -> DataFrame:
    """One row: tokens of the cloud in and out, of the local channel out, and its seconds."""
    of = lambda p, c: F.coalesce(F.sum(F.when(F.col("provider") == p, F.col(c))), F.lit(0))
    return usage.agg(of("cloud", "tokens_in").alias("cloud_tokens_in"), of("cloud", "tokens_out").alias("cloud_tokens_out"), of("local", "tokens_out").alias("local_tokens_out"), of("local", "seconds").alias("local_seconds"))


def cost(tokens_in: Column, tokens_out: Column, price_in: float = 1.0, price_out: float = 2.0, digits: int | None = 4) -> Column:
    """Price of tokens, given prices a million."""
    exact = tokens_in / 1_000_000 * price_in + tokens_out / 1_000_000 * price_out
    return exact if digits is None else F.round(exact, digits)


def run_counters(translations: DataFrame) -> DataFrame:
    """Of each document: translated, suspect, failed, and tokens."""
    of = lambda q: F.count_if(F.col("quality") == q).alias(q)
    return translations.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), of("ok"), of("suspect"), of("failed"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


def quality_rollup(blocks: DataFrame) -> DataFrame:
    """Of each document: blocks, those with any translation, and statuses of the first variant. For what with_variants gives."""
    first = F.try_element_at(F.map_values("translation_meta"), F.lit(1))["quality"]
    of = lambda q: F.count_if(first == q).alias(q)
    return blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.size("translations") > 0).alias("translated"), of("ok"), of("suspect"), of("failed"))


def usage_response(totals: DataFrame, price_in: float = 1.0, price_out: float = 2.0) -> DataFrame:
    """Totals with the cost of what the cloud took and gave, and the local seconds to a tenth."""
    price = cost(F.col("cloud_tokens_in"), F.col("cloud_tokens_out"), price_in, price_out)
    return totals.withColumn("cost", price).withColumn("local_seconds", F.round(F.col("local_seconds").cast("double"), 1))


def newest(rows: DataFrame, by: str, n: int = 50, tie: str = "id") -> DataFrame:
    """The n newest rows: a top-n, no total sort."""
    return rows.orderBy(F.col(by).desc(), F.col(tie).desc()).limit(n)
