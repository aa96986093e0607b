"""Selecting samples: matchers, left-open range windows, and the latest sample of each series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepane.functions.labels import matches
from tidepane.plans.promql import Selector
from tidepane.sources.samples import Source

#: How far an instant selector looks back for a sample.
LOOKBACK_MS = 300_000


def matching(selector: Selector) -> Column:
    """Whether a sample belongs to the selector's series."""
    out = F.col("metric") == F.lit(selector.metric)
    for m in selector.matchers:
        out = out & matches("labels", m.name, m.op, m.value)
    return out


def selected(samples: DataFrame | Source, selector: Selector) -> DataFrame:
    """Samples of the selector's series, at any time."""
    if isinstance(samples, Source):
        return samples.select(selector.metric, selector.matchers)
    return samples.where(matching(selector))


def range_window(samples: DataFrame | Source, selector: Selector, end_ms: int, width_ms: int | None = None) -> DataFrame:
    """Samples in ``(end - width, end]`` without stale markers; ``end`` is already shifted by the offset."""
    width = selector.range_ms if width_ms is None else width_ms
    inside = (F.col("ts_ms") > F.lit(end_ms - width)) & (F.col("ts_ms") <= F.lit(end_ms))
    return selected(samples, selector).where(inside & ~F.col("is_stale"))


def instant_vector(samples: DataFrame | Source, selector: Selector, end_ms: int, lookback_ms: int = LOOKBACK_MS) -> DataFrame:
    """``series`` and ``value`` of the latest sample in the look-back window; of equal times the later arrival counts.

    A series whose latest sample is a stale marker has ended and gives no row.
    """
    inside = (F.col("ts_ms") > F.lit(end_ms - lookback_ms)) & (F.col("ts_ms") <= F.lit(end_ms))
    last = selected(samples, selector).where(inside).groupBy("series").agg(F.max(F.struct("ts_ms", "arrival", "is_stale", "value")).alias("last"))
    return last.where(~F.col("last.is_stale")).select("series", F.col("last.value").alias("value"))
