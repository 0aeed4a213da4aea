"""Streams: totals of the usage log by window, and ingestion of content not seen before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage_windows(usage: DataFrame, window: str = "1 hour", late: str = "10 minutes", ts: str = "ts", keys: tuple[str, ...] = ("provider",)) -> DataFrame:
    """Totals by window and key of an append-only log; for streams and tables alike. Later events than ``late`` are dropped by a stream."""
    rows = usage.withWatermark(ts, late)
    totals = rows.groupBy(F.window(ts, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"))
    return totals.select(F.col("w.start").alias("start"), *keys, "calls", "tokens")


def first_seen(files: DataFrame, late: str = "1 day", ts: str = "modificationTime", key: str = "sha256") -> DataFrame:
    """A stream of files without those whose content came before, within the watermark."""
    return files.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
