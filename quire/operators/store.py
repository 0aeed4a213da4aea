"""Keyed tables as append logs: upserts, deletes, cache lookups, and the joined views on them.

A log row carries ``seq``, which orders it among rows of its key. A view is the latest of each key; nothing is updated in
place. Logs are partitioned by document where they are written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T

#: Keys of the tables, and what goes when a document goes. The usage log stays.
KEYS = {
    "documents": ("id",),
    "blocks": ("id",),
    "translations": ("block_id", "lang", "provider", "model"),
    "glossary": ("doc_id", "source"),
    "notes": ("id",),
    "summaries": ("doc_id", "lang", "provider", "model"),
    "settings": ("key",),
}
CASCADE = ("blocks", "translations", "glossary", "notes", "summaries", "documents")
SETTING_TRUE = ("1", "true", "yes", "on")


def latest(log: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """One row a key, the one of the highest seq. An aggregate: rows of a key are reduced before they are shuffled."""
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    return latest(table.unionByName(changes, allowMissingColumns=True), keys, seq)


def upsert_glossary(log: DataFrame, seq: str = "seq") -> DataFrame:
    """Latest target and note of each term; locked once it was ever locked."""
    return log.groupBy("doc_id", "source").agg(F.max_by("target", seq).alias("target"), F.max_by("note", seq).alias("note"), F.max("locked").alias("locked"))


def delete(table: DataFrame, gone: DataFrame, on: Sequence[str]) -> DataFrame:
    return table.join(gone.select(*on).distinct(), list(on), "left_anti")


def cascade(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of the documents in ``gone`` (doc_id)."""
    out = dict(tables)
    for name in CASCADE:
        if name in out:
            key = "id" if name == "documents" else "doc_id"
            out[name] = out[name].join(gone.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti")
    return out


def cache_misses(targets: DataFrame, stored: DataFrame, provider: str, model: str | None = None, force: bool = False, on: Sequence[str] = ("doc_id", "block_id")) -> DataFrame:
    """Targets without a usable translation by the provider and model."""
    if force:
        return targets
    good = stored.where((F.col("provider") == provider) & (F.col("quality") != "failed") & ~T.blank(F.col("text")))
    if model is not None:
        good = good.where(F.col("model") == model)
    return targets.join(good.select(*on), list(on), "left_anti")


def with_variants(blocks: DataFrame, variants: DataFrame, notes: DataFrame, on: Sequence[str] = ("doc_id", "block_id")) -> DataFrame:
    """blocks with translations (provider to text, blank ones dropped), their meta (blank ones kept) and note_count."""
    newest = latest(variants.select(*on, "provider", "text", "quality", "seq"), [*on, "provider"])
    usable = F.map_from_entries(F.array_sort(F.collect_list(F.when(~T.blank(F.col("text")), F.struct("provider", "text")))))
    meta = F.map_from_entries(F.array_sort(F.collect_list(F.struct("provider", F.struct("quality", "seq").alias("meta")))))
    per_block = newest.groupBy(*on).agg(usable.alias("translations"), meta.alias("translation_meta"))
    counts = notes.groupBy(*on).agg(F.count(F.lit(1)).alias("note_count"))
    out = blocks.join(per_block, list(on), "left").join(counts, list(on), "left")
    return out.withColumn("note_count", F.coalesce("note_count", F.lit(0)))


def of_types(blocks: DataFrame, kinds: str | None) -> DataFrame:
    """Blocks of the types in a comma-separated list; all without one."""
    wanted = [k.strip() for k in (kinds or "").split(",") if k.strip()]
    return blocks.where(F.col("type").isin(*wanted)) if wanted else blocks


def setting(value: Column, kind: str) -> Column:
    """A stored text as bool, int, float or str; null where it doesn't cast. Trailing slashes of base urls go."""
    trimmed = F.trim(value)
    if kind == "bool":
        return F.lower(trimmed).isin(*SETTING_TRUE)
    if kind in ("int", "float"):
        return trimmed.try_cast("bigint" if kind == "int" else "double")
    return F.regexp_replace(trimmed, "/+$", "") if kind == "url" else value


def visible_settings(settings: DataFrame, allowed: Sequence[str], secrets: Sequence[str] = ()) -> DataFrame:
    """(key, value) of settings that may be stored: allowed ones that aren't blank; of secrets only whether they are set."""
    rows = settings.where(F.col("key").isin(*allowed, *secrets) & ~T.blank(F.col("value")))
    return rows.select("key", F.when(F.col("key").isin(*secrets), F.lit("true")).otherwise(F.col("value")).alias("value"))


def apply_overrides(settings: DataFrame, overrides: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(key, value, changed): settings after overrides of the known keys; what doesn't cast to its kind is left out."""
    cast = F.lit(None).cast("string")
    for key, kind in kinds.items():
        cast = F.when(F.col("key") == key, setting(F.col("value"), kind).cast("string")).otherwise(cast)
    fit = overrides.withColumn("new", cast).where(F.col("new").isNotNull()).select("key", "new")
    both = settings.select("key", "value").join(fit, "key", "full")
    changed = F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("value"))
    return both.select("key", F.coalesce("new", "value").alias("value"), changed.alias("changed"))


def append(rows: DataFrame, path: str, by: str = "doc_id") -> None:
    """Rows of an append-only log, as the usage log is: nothing that is stored is touched."""
    rows.write.mode("append").partitionBy(by).parquet(path)


def write(table: DataFrame, path: str, by: str = "doc_id") -> None:
    """Rows of the documents at hand replace those stored of the same documents; others stay."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Files of all ages: columns that older ones lack are null."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def new_content(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose hash isn't stored, once each: the lowest path. Goes before decoding."""
    fresh = files.join(known.select("sha256").distinct(), "sha256", "left_anti")
    return fresh.groupBy("sha256").agg(F.min_by(F.struct("*"), "path").alias("f")).select("f.*")
