"""Per-key results where a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepane.functions.labels import pairs
from tidepane.operators.partitioned import is_number, session_partitions
from tidepane.session import written


def series_states(samples: DataFrame) -> DataFrame:
    """One partial state per series: rows, values, their sum, and the latest sample.

    Built before anything is shuffled by key, so a series with a third of all
    rows shrinks to one state per map task. ``n_rows`` counts every row,
    ``n_values`` those whose value is neither null nor NaN, ``total`` their sum
    (infinities kept). The latest sample is the row with the largest
    (timestamp_ms, arrival) among those with a timestamp, whatever its value.
    Rows with null ``series_id`` belong to no series and are left out.
    """
    number = is_number(F.col("value"))
    return (
        samples.where(F.col("series_id").isNotNull())
        .groupBy("series_id")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count(F.when(number, 1)).alias("n_values"),
            F.sum(F.when(number, F.col("value"))).alias("total"),
            F.max(F.when(F.col("timestamp_ms").isNotNull(), F.struct("timestamp_ms", "arrival", "value"))).alias("latest"),
        )
    )


def stitched(states: DataFrame, keys: Sequence[str], spread: Sequence[str]) -> DataFrame:
    """Merge partial states per key without giving one task a heavy key.

    The states are range partitioned by (key, ``spread``) with sampled
    quantiles, so a heavy key is cut into several neighbouring partitions. Each
    partition merges what it holds; a key that crosses boundaries leaves one
    partial there per partition, and these few are stitched in the second
    aggregation. ``pieces`` says how many partitions a key was cut into.
    """
    laid = states.repartitionByRange(session_partitions(states), *keys, *spread).withColumn("__pid", F.spark_partition_id())
    merged: list[Column] = [
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_values").alias("n_values"),
        F.sum("total").alias("total"),
        F.max("latest").alias("latest"),
        (F.max("__pid") - F.min("__pid") + 1).alias("pieces"),
    ]
    return laid.groupBy(*keys).agg(*merged)


def _flat(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n_rows", "n_values", "total", F.col("latest.timestamp_ms").alias("latest_ms"), F.col("latest.arrival").alias("latest_arrival"), F.col("latest.value").alias("latest_value"), "pieces")


def with_series(states: DataFrame, series: DataFrame) -> DataFrame:
    """States joined to their series: one row a side and id, so no key is heavy. Of repeated ids the row that sorts first (metric, then pairs) counts.

    Written, as the sampling of quantiles would compute the states a second time.
    """
    row = F.struct("metric", pairs("labels").alias("pairs"))
    known = series.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("series_id")).agg(F.min(row).alias("row"))
    return written(states.join(known.select("series_id", "row.metric", "row.pairs"), "series_id", "inner"), "states")


def per_pair(samples: DataFrame, series: DataFrame) -> DataFrame:
    """Count, sum and latest sample of each label pair with a non-empty value (``name``, ``value``).

    ``__name__`` is a label like the others. Rows with null or unknown
    ``series_id`` and series with null labels have no pairs. Empty tables give
    no rows.
    """
    states = with_series(series_states(samples), series)
    exploded = states.select("series_id", "n_rows", "n_values", "total", "latest", F.explode("pairs").alias("p"))
    keyed = exploded.select(F.col("p.key").alias("name"), F.col("p.value").alias("value"), "series_id", "n_rows", "n_values", "total", "latest")
    return _flat(stitched(keyed, ["name", "value"], ["series_id"]), "name", "value")


def per_metric(samples: DataFrame, series: DataFrame) -> DataFrame:
    """The same per metric; series without one (null or empty) share the metric ``''``."""
    states = with_series(series_states(samples), series).withColumn("metric", F.coalesce("metric", F.lit("")))
    keyed = states.select("metric", "series_id", "n_rows", "n_values", "total", "latest")
    return _flat(stitched(keyed, ["metric"], ["series_id"]), "metric")


def heavy_pairs(samples: DataFrame, series: DataFrame, percent: int = 5) -> DataFrame:
    """Label pairs in at least ``percent`` % of all rows of ``samples``, also those without a series."""
    total = samples.count()
    return per_pair(samples, series).where(F.col("n_rows") * 100 >= F.lit(percent * total))


