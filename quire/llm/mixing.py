"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Each source gets a target number of words; a document's expected copies are target / source size. Within a source the
expected copies are prefix-summed over the documents, one random offset is added, and a document is emitted once for each
integer that its interval crosses. The order of the prefix sum goes up by size, so that the copies of large and small
documents balance.

No task holds a source: the order is by (size class, id modulo ``SPREAD``, size, id); rows without an id are dealt by the hash of
their text instead. Counts for each (source, size class,
remainder) are summed first, of which a source has a bounded number, and only ranks inside such a group need its rows
together.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; null ids come first in their
size class; rows that tie in everything are interchangeable; an empty table gives an empty table; a source of size 0 has
target 0 and takes nothing. Other columns pass through :func:`mix` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import durable

#: Groups into which the documents of one source and size class are dealt.
SPREAD = 61
#: The random offset has this many values, so that adding it to a prefix sum of copies is exact.
OFFSETS = 1 << 20


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def size_class(size: Column) -> Column:
    """The leading four bits and the length in bits: classes an eighth apart, rising with the size."""
    bits = F.length(F.bin(size))
    drop = F.greatest(bits - 4, F.lit(0))
    return (bits * 16 + F.call_function("shiftright", size, drop)).cast("int")


def offset(source: Column, seed: str) -> Column:
    """In [0, 1), from the source's name and the seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\u0000null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("double") / OFFSETS


def targets(sources: DataFrame, weights: Sequence[float], cap: float, seed: str) -> DataFrame:
    """sources (src, source_size) with target, copies expected of each document (each) and offset (u).

    Filling by weight up to the caps: in the order of cap / weight a source is capped while the share that is left for it
    reaches its cap; the rest have the level at which that stopped. One row a source, so one task holds them all.
    """
    ordered = Window.orderBy(F.col("src").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1)
    s = sources.withColumn("w", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_fill = Window.orderBy(F.col("most") / F.col("w"), F.col("src").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("capped", F.col("level") * F.col("w") >= F.col("most"))
    s = s.withColumn("at", F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    s = s.withColumn("target", F.when(F.col("capped"), F.col("most")).otherwise(F.col("at") * F.col("w")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return s.select("src", "source_size", "target", each.alias("each"), offset(F.col("src"), seed).alias("u"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: str = "mix", keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` columns of each row as a struct ``row``, with size, source_size, target and copies (times the row is taken).

    ``keep`` is all columns by default; with fewer the shuffles carry less.
    """
    kept = docs.columns if keep is None else list(keep)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").alias("src"),
        word_count(F.col(f"`{text_col}`")).alias("size"),
        F.xxhash64(f"`{text_col}`").alias("tie"),
    )
    rows = rows.withColumn("cls", size_class(F.col("size"))).withColumn("rem", F.coalesce(F.pmod("id", F.lit(SPREAD)), -1 - F.pmod("tie", F.lit(SPREAD))).cast("int"))
    # The counts read the table on their own, once: their scan is pruned to what they need, and targets and starts share them.
    group_keys = ["src", "cls", "rem"]
    groups = durable(rows.groupBy(*group_keys).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")))
    in_source = Window.partitionBy("src").orderBy("cls", "rem")
    groups = groups.withColumn("start", F.coalesce(F.sum("n").over(in_source.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("source_size", F.sum("words").over(Window.partitionBy("src")))
    sources = groups.groupBy("src", "source_size").agg(F.sum("n").alias("docs"))
    goal = targets(sources, weights, cap, seed)
    plan = groups.select(F.col("src").alias("p_src"), F.col("cls").alias("p_cls"), F.col("rem").alias("p_rem"), "start").join(goal, F.col("p_src").eqNullSafe(F.col("src"))).drop("src")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group_keys).orderBy("size", "id", "tie")))
    out = ranked.join(plan, F.col("src").eqNullSafe(F.col("p_src")) & (F.col("cls") == F.col("p_cls")) & (F.col("rem") == F.col("p_rem")))
    upto = (F.col("start") + F.col("rank")).cast("double")
    copies = F.floor(upto * F.col("each") + F.col("u")) - F.floor((upto - 1) * F.col("each") + F.col("u"))
    return out.select("row", "size", "source_size", "target", copies.cast("long").alias("copies"))


def emitted(mixed: DataFrame) -> DataFrame:
    """The rows of the mix themselves, each as often as it is taken."""
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def query(docs: DataFrame) -> DataFrame:
    m = mix(docs, keep=["doc_id"])
    return m.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source AS src, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
rows AS (
  SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS cls, coalesce(((doc_id % 61) + 61) % 61, -1) AS rem FROM sized),
sources AS (SELECT src, sum(size)::BIGINT AS source_size FROM rows GROUP BY src),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 + 1)::INT] AS w, source_size * 3.0::DOUBLE AS most FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(most) OVER b, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS level FROM weighed
  WINDOW b AS (ORDER BY most / w, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, level * w >= most AS capped, most / w AS fill FROM levels),
goal AS (
  SELECT src, source_size, CASE WHEN capped THEN most ELSE w * (SELECT arg_min(level, fill) FROM capped WHERE NOT capped) END AS target FROM capped),
ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY cls, rem, size, doc_id NULLS FIRST) AS rank FROM rows),
joined AS (
  SELECT r.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS each,
    ('0x' || substr(md5('mix:' || coalesce(r.src, chr(0) || 'null')), 1, 5))::BIGINT::DOUBLE / 1048576 AS u
  FROM ranked r JOIN goal g ON r.src IS NOT DISTINCT FROM g.src),
taken AS (SELECT *, (floor(rank * each + u) - floor((rank - 1) * each + u))::BIGINT AS copies FROM joined)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM taken
"""
