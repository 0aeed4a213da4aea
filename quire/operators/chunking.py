"""Selecting, chunking and packing blocks under token budgets."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import protect
from quire.functions import text as T

#: Budgets, overheads and the types that are translated.
CHUNK_BUDGET = 1200
BLOCK_OVERHEAD = 24
CHUNK_OVERHEAD = 700
OUT_SHARE = (0.95, 1.3)
TOKENS_PER_SECOND = 30
SECONDS_PER_CHUNK = 2
CONTEXT_BLOCKS = 2
CONTEXT_CHARS = 1500
SUMMARY_BUDGET = 9000
SUMMARY_OPENING = 0.6
TRANSLATABLE = ("text", "heading", "caption", "reference", "footnote", "formula", "table")
SUMMARY_TYPES = ("heading", "text", "caption", "table", "reference")
LETTER = "[A-Za-z一-鿿]"


def flat_table(rows: Column, text: Column | None = None) -> Column:
    """A grid as text; the block's own text if there is no grid."""
    flat = F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")
    return flat if text is None else F.when(F.coalesce(F.size(rows), F.lit(0)) > 0, flat).otherwise(text)


def select_blocks(blocks: DataFrame, ids: list | None = None, id_col: str = "id", masked: bool = True) -> DataFrame:
    """Blocks worth translating: of a type that is, and with a letter left once protected parts are taken out.

    The native conditions come first, so that masking, which runs in Python, sees only what may stay.
    """
    rows = blocks if ids is None else blocks.where(F.col(id_col).isin(*ids))
    rows = rows.where(F.col("type").isin(*TRANSLATABLE))
    enough = F.length(T.strip(F.col("text"))) >= 2
    left = protect.residual(protect.mask(F.col("text"))) if masked else F.col("text")
    prose = (F.col("type") != "table") & enough & left.rlike(LETTER)
    if "table_rows" not in blocks.columns:
        return rows.where(prose)
    grid = (F.col("type") == "table") & (F.coalesce(F.size("table_rows"), F.lit(0)) >= 2) & (F.length(T.strip(flat_table(F.col("table_rows")))) >= 2)
    return rows.where(grid | prose)


def chunk(blocks: DataFrame, budget: int = CHUNK_BUDGET, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """blocks with ``chunk_id``, from 0 in each document: a chunk closes before the block that would exceed the budget.

    A table is a chunk of its own. A fold over a document's costs, not its texts, in one array, linear in their number; the
    blocks get their chunk back by position, so the array is all that a document needs to have in one place.
    """
    is_table = F.col("type") == "table" if "type" in blocks.columns else F.lit(False)
    cost = F.when(is_table, F.lit(-1)).otherwise(T.estimate_tokens(F.col("text")) + BLOCK_OVERHEAD)
    costs = blocks.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), cost.alias("c")))).alias("all"))

    @F.pandas_udf("array<int>")
    def numbers(lists: pd.Series) -> pd.Series:
        return lists.map(lambda each: _chunk_numbers(each, budget))

    numbered = costs.select(doc, F.arrays_zip(F.transform("all", lambda x: x["o"]).alias("o"), numbers(F.transform("all", lambda x: x["c"])).alias("k")).alias("z"))
    ids = numbered.select(doc, F.explode("z").alias("z")).select(doc, F.col("z")["o"].alias(order), F.col("z")["k"].alias("chunk_id"))
    return blocks.join(ids, [doc, order])


def _chunk_numbers(costs: Iterable[int], budget: int) -> list[int]:
    """The chunk of each cost in order; a negative one is a table."""
    out, number, used, closed = [], -1, 0, True
    for c in costs:
        fresh = c < 0 or closed or used + c > budget
        number += fresh
        used = c if fresh else used + c
        closed = c < 0
        out.append(number)
    return out


def _fitting(parts: Iterable[int], costs: Iterable[int], budget: int) -> list[bool]:
    """Which costs are taken, in order: those of part 0 always, others while they fit."""
    out, used = [], 0
    for part, c in zip(parts, costs, strict=True):
        fits = part == 0 or used + c <= budget
        used += c * fits
        out.append(bool(fits))
    return out


def estimate(chunked: DataFrame, price_in: float = 1.0, price_out: float = 2.0) -> DataFrame:
    """For all documents: blocks, chunks, tokens in and out, cost in millionths and seconds of local work."""
    each = chunked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), (F.max("chunk_id") + 1).alias("chunks"), F.sum(T.estimate_tokens(F.col("text"))).alias("text"))
    total = each.agg(F.sum("blocks").alias("blocks"), F.sum("chunks").cast("long").alias("chunks"), F.sum("text").alias("text"))
    out = (F.col("text") * F.lit(OUT_SHARE[0]) * F.lit(OUT_SHARE[1])).cast("long")
    total = total.withColumn("tokens_in", F.col("text") + CHUNK_OVERHEAD * F.col("chunks")).withColumn("tokens_out", out)
    seconds = F.floor(F.col("tokens_out") / TOKENS_PER_SECOND) + SECONDS_PER_CHUNK * F.col("chunks")
    return total.select("blocks", "chunks", "tokens_in", "tokens_out", (F.col("tokens_in") * price_in + F.col("tokens_out") * price_out).alias("cost_micro"), seconds.cast("long").alias("seconds"))


def context(blocks: DataFrame, before: int = CONTEXT_BLOCKS, chars: int = CONTEXT_CHARS, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """blocks with ``context``: the end of the texts of the blocks before, of text and heading."""
    near = Window.partitionBy(doc).orderBy(order).rowsBetween(-before, -1)
    joined = F.array_join(F.collect_list("text").over(near), "\n")
    return blocks.where(F.col("type").isin("text", "heading")).withColumn("context", F.right(joined, F.lit(chars)))


def summary_pack(blocks: DataFrame, budget: int = SUMMARY_BUDGET) -> DataFrame:
    """Blocks that a summary is made from: all headings, then openings, captions and the rest while they fit.

    What doesn't fit is passed over, and smaller blocks behind it may still fit: a fold over the costs in that order.
    """
    useful = blocks.where(F.col("type").isin(*SUMMARY_TYPES) & ~T.blank(F.col("text")))
    per_doc = Window.partitionBy("doc_id")
    body = F.row_number().over(Window.partitionBy("doc_id", "type").orderBy("ord"))
    opening = F.greatest(F.lit(1), (F.count_if(F.col("type") == "text").over(per_doc) * F.lit(SUMMARY_OPENING)).cast("int"))
    part = F.when(F.col("type") == "heading", 0).when(F.col("type") != "text", 2).when(body <= opening, 1).otherwise(3)
    rows = useful.withColumn("part", part).withColumn("cost", T.estimate_tokens(F.col("text")))
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "ord", "cost"))).alias("all"))

    @F.pandas_udf("array<boolean>")
    def fitting(parts: pd.Series, costs: pd.Series) -> pd.Series:
        return pd.Series([_fitting(p, c, budget) for p, c in zip(parts, costs, strict=True)])

    taken = F.arrays_zip(F.transform("all", lambda x: x["ord"]).alias("ord"), fitting(F.transform("all", lambda x: x["part"]), F.transform("all", lambda x: x["cost"])).alias("fits"))
    kept = lists.select("doc_id", F.explode(taken).alias("z")).where("z.fits").select("doc_id", F.col("z.ord").alias("ord"))
    return useful.join(kept, ["doc_id", "ord"])


def summary_source(packed: DataFrame) -> DataFrame:
    """(doc_id, source): the packed blocks as one text in reading order."""
    line = F.concat(F.lit("["), F.col("type"), F.lit("] "), T.strip(F.col("text")))
    lines = packed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("all"))
    return lines.select("doc_id", F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("source"))
