"""The sample table and ways to make one.

Columns: ``metric`` string, ``labels`` map<string,string> (without the metric
name), ``series`` string (identity of metric and labels), ``ts_ms`` bigint,
``value`` double, ``is_stale`` boolean, ``arrival`` bigint (order of arrival).
The stale marker is told apart here, before anything is stored: Parquet does not
keep the bits of a NaN.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepane.functions.labels import METRIC_LABEL, compared, label, matches, series_identity
from tidepane.functions.timeline import epoch_ms
from tidepane.plans.promql import Matcher

SCHEMA = "metric string, labels map<string,string>, series string, ts_ms bigint, value double, is_stale boolean, arrival bigint"
#: Bits of the NaN that marks a series as ended (a fixed value of the wire protocol).
STALE_BITS = 0x7FF0000000000002


def is_stale_marker(value: float) -> bool:
    return math.isnan(value) and struct.unpack("<Q", struct.pack("<d", value))[0] == STALE_BITS


def identity(metric: Column, labels: Column) -> Column:
    """Series identity: the label set with the metric name as ``__name__``."""
    return series_identity(F.map_concat(F.map_filter(labels, lambda k, _: k != METRIC_LABEL), F.create_map(F.lit(METRIC_LABEL), metric)))


def samples_table(df: DataFrame, metric: Column, labels: Column, ts_ms: Column, value: Column, arrival: Column, is_stale: Column | None = None) -> DataFrame:
    """Sample table from columns of any table. Rows with a null metric, time or value are left out; null labels are none."""
    stale = F.lit(False) if is_stale is None else is_stale
    empty = F.create_map().cast("map<string,string>")
    made = df.select(
        metric.alias("metric"), F.map_filter(F.coalesce(labels, empty), lambda k, v: (k != METRIC_LABEL) & (F.coalesce(v, F.lit("")) != "")).alias("labels"),
        ts_ms.cast("bigint").alias("ts_ms"), value.cast("double").alias("value"), F.coalesce(stale, F.lit(False)).alias("is_stale"), arrival.cast("bigint").alias("arrival"),
    ).where(F.col("metric").isNotNull() & F.col("ts_ms").isNotNull() & F.col("value").isNotNull())
    return made.select("metric", "labels", identity(F.col("metric"), F.col("labels")).alias("series"), "ts_ms", "value", "is_stale", "arrival")


def rows_to_samples(spark: SparkSession, rows: Iterable[tuple[Mapping[str, str], int, float]], first_arrival: int = 0) -> DataFrame:
    """Sample table of (labels with ``__name__``, ts_ms, value) rows, in order of arrival."""
    data = []
    for i, (labels, ts, value) in enumerate(rows):
        data.append((labels[METRIC_LABEL], dict(labels), int(ts), float(value), is_stale_marker(float(value)), first_arrival + i))
    raw = spark.createDataFrame(data, "metric string, labels map<string,string>, ts_ms bigint, value double, is_stale boolean, arrival bigint")
    return samples_table(raw, F.col("metric"), F.col("labels"), F.col("ts_ms"), F.col("value"), F.col("arrival"), F.col("is_stale"))


def stored_samples(samples: DataFrame, series: DataFrame) -> DataFrame:
    """Sample table of raw samples that refer to interned series by ``series_id``.

    Label sets are cleaned and turned into identities once per series, before
    the join. Samples with a null or unknown series, a null time or a null value
    are left out.
    """
    return timed_values(samples).join(known_series(series), "series_id").select("metric", "labels", "series", "ts_ms", "value", F.lit(False).alias("is_stale"), "arrival")


def known_series(series: DataFrame) -> DataFrame:
    """``series_id``, ``metric``, cleaned ``labels`` and identity ``series`` of interned series; one row a series."""
    named = F.coalesce(F.when(F.col("metric") != "", F.col("metric")), label("labels", METRIC_LABEL))
    nothing = F.lit(0)
    return samples_table(series.where(F.col("id").isNotNull()), named, F.col("labels"), nothing, nothing, F.col("id")).select(F.col("arrival").alias("series_id"), "metric", "labels", "series")


def timed_values(samples: DataFrame) -> DataFrame:
    """Raw samples with a time and a value."""
    kept = samples.where(F.col("timestamp_ms").isNotNull() & F.col("value").isNotNull())
    return kept.select("series_id", F.col("timestamp_ms").alias("ts_ms"), F.col("value").cast("double").alias("value"), "arrival")


class Source:
    """Samples that are selected before they take the form of the sample table."""

    def select(self, metric: str, matchers: Sequence[Matcher]) -> DataFrame:
        """Samples of the metric's series that fit: ``series``, ``ts_ms``, ``value``, ``is_stale``, ``arrival``."""
        raise NotImplementedError


@dataclass(frozen=True)
class Interned(Source):
    """Raw samples that refer to series by ``series_id``. Matchers are tested once per series, and samples meet the fitting series only."""

    samples: DataFrame
    series: DataFrame

    def select(self, metric: str, matchers: Sequence[Matcher]) -> DataFrame:
        wanted = known_series(self.series).where(F.col("metric") == F.lit(metric))
        for m in matchers:
            wanted = wanted.where(matches("labels", m.name, m.op, m.value))
        return timed_values(self.samples).join(wanted.select("series_id", "series"), "series_id").drop("series_id").withColumn("is_stale", F.lit(False))


@dataclass(frozen=True)
class Wide(Source):
    """A table whose rows are samples of one metric, with a column per label. Matchers become predicates on the columns, which reach the scan."""

    table: DataFrame
    metric: str
    labels: tuple[str, ...]
    ts_ms: Column
    value: Column
    arrival: Column

    def select(self, metric: str, matchers: Sequence[Matcher]) -> DataFrame:
        rows = self.table.where(F.lit(metric == self.metric))
        for m in matchers:
            if m.name == METRIC_LABEL or m.name not in self.labels:
                found = F.lit(self.metric if m.name == METRIC_LABEL else "")
            else:
                found = F.col(m.name) if dict(self.table.dtypes)[m.name] == "string" else F.col(m.name).cast("string")
                if m.op == "=" and m.value:
                    rows = rows.where(found == F.lit(m.value))
                    continue
                found = F.coalesce(found, F.lit(""))
            rows = rows.where(compared(found, m.op, m.value))
        pairs = [x for name in self.labels for x in (F.lit(name), F.col(name).cast("string"))]
        made = samples_table(rows, F.lit(self.metric), F.create_map(*pairs), self.ts_ms, self.value, self.arrival)
        return made.select("series", "ts_ms", "value", "is_stale", "arrival")


def event_source(events: DataFrame, metric: str = "events_value", labels: tuple[str, ...] = ("event_type", "user_id"), value: Column | None = None) -> Wide:
    """The events table as a source: one gauge with the given columns as labels."""
    return Wide(events, metric, labels, epoch_ms("ts"), F.col("value") if value is None else value, F.col("event_id"))


def event_samples(events: DataFrame, metric: str = "events_value", labels: tuple[str, ...] = ("event_type", "user_id"), value: Column | None = None) -> DataFrame:
    """Sample table of the events table: one gauge with the given columns as labels."""
    pairs = [x for name in labels for x in (F.lit(name), F.col(name).cast("string"))]
    return samples_table(events, F.lit(metric), F.create_map(*pairs), epoch_ms("ts"), F.col("value") if value is None else value, F.col("event_id"))
