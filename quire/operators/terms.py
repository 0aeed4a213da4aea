"""Mining of candidate glossary terms, and glossary rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The patterns of terms, words that are none, and the limits.
ACRONYM = r"(?U)\b[A-Z][A-Za-z]*[A-Z][A-Za-z0-9\-]{1,12}\b"
MULTIWORD = r"(?U)\b(?:[A-Z][a-z]{3,}\s){1,2}(?:[a-z]{4,}|[A-Z][a-z]{3,})\b"
NO_TERMS = ("THE", "AND", "FOR", "WITH")
LEAST_COUNT = 2
MOST_TERMS = 80
MOST_PROMPTED = 120
MOST_BUILT = 30


def candidate_terms(texts: DataFrame, text_col: str = "text", scope: list[str] | None = None, limit: int = MOST_TERMS) -> DataFrame:
    """(scope, term, n): acronyms and capitalised phrases that occur at least twice, the most frequent first."""
    scope = scope or []
    acronyms = F.filter(F.regexp_extract_all(text_col, F.lit(ACRONYM), F.lit(0)), lambda t: ~F.upper(t).isin(*NO_TERMS))
    phrases = F.transform(F.regexp_extract_all(text_col, F.lit(MULTIWORD), F.lit(0)), F.trim)
    found = texts.select(*scope, F.explode(F.concat(acronyms, phrases)).alias("term"))
    counted = found.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)
    if not scope:
        return counted.orderBy(F.col("n").desc(), "term").limit(limit)
    best = Window.partitionBy(*scope).orderBy(F.col("n").desc(), "term")
    return counted.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= limit).drop("_r")


def usable_terms(replies: DataFrame) -> DataFrame:
    """Terms of a reply (doc_id, source, target, note, pos) that are fit for the glossary, at most thirty a document."""
    fit = (F.length("source") > 1) & (F.length("source") <= 80) & (F.trim("target") != "")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    rows = replies.where(fit).withColumn("_r", rank).where(F.col("_r") <= MOST_BUILT)
    return rows.select("doc_id", "source", "target", F.substring("note", 1, 200).alias("note"))


def glossary_lines(glossary: DataFrame) -> DataFrame:
    """(doc_id, glossary): the first terms of each document as lines for a prompt."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("source"))
    rows = glossary.withColumn("_r", rank).where(F.col("_r") <= MOST_PROMPTED)
    lines = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("_r", F.concat_ws(" = ", "source", "target").alias("line")))).alias("all"))
    return lines.select("doc_id", F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("glossary"))
