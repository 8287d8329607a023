"""Windowed counts over a stream of visits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(visits: DataFrame, by: list[str], at: str, width: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Visits per group and window of event time; rows later than ``late`` behind the newest are left to the state's own rule.

    Works on a stream and, without effect of the watermark, on a table.  Null times fall in no window.
    """
    t = visits.where(F.col(at).isNotNull())
    t = t.withWatermark(at, late) if visits.isStreaming else t
    g = t.groupBy(*by, F.window(at, width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
