"""Cube aggregates over a stream: the filter, unpivot and aggregate part of an expression, in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.reshape import col, unpivot


def windowed_totals(stream: DataFrame, time: str, keys: list[str], measures: list[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, keys, Measure, n, total): rows later than `late` behind the newest are dropped by the watermark, so
    state is bounded by the open windows' groups. Works on batches as on streams, with the same rows."""
    timed = stream.withColumn(time, col(time).cast("timestamp"))  # a watermark needs an instant
    marked = timed.withWatermark(time, late) if stream.isStreaming else timed
    long = unpivot(marked, [time, *keys], measures)
    grouped = long.groupBy(F.window(F.col(time), window).alias("_window"), *map(col, keys), "Measure")
    return grouped.agg(F.count("*").alias("n"), F.sum("Value").alias("total")).select(F.col("_window.start").alias("window_start"), *map(col, keys), "Measure", "n", "total")
