"""Operators on instant vectors: ``series`` (identity), ``labels``, ``value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepane.functions.labels import METRIC_LABEL, only_labels, series_identity, without_labels
from tidepane.operators.states import _only_number_max, _only_number_min
from tidepane.plans.promql import Grouping


def labelled(values: DataFrame, keep_name: bool = False) -> DataFrame:
    """Give ``series`` and ``value`` their label sets back; functions drop the metric name."""
    labels = F.from_json("series", "map<string,string>")
    if not keep_name:
        labels = without_labels(labels, [METRIC_LABEL])
    return values.select("series", labels.alias("labels"), "value")


def group_labels(grouping: Grouping) -> Column:
    labels = F.col("labels")
    return without_labels(labels, [METRIC_LABEL, *grouping.labels]) if grouping.without else only_labels(labels, grouping.labels)


def aggregated(vector: DataFrame, op: str, grouping: Grouping) -> DataFrame:
    """One row per group; its labels are the grouping labels the members have."""
    v = F.col("value")
    value = {
        "sum": F.sum(v), "avg": F.avg(v), "count": F.count(v).cast("double"), "min": _only_number_min(v), "max": _only_number_max(v),
        "stddev": F.stddev_pop(v), "stdvar": F.var_pop(v), "group": F.max(F.lit(1.0)),
    }[op]
    keyed = vector.withColumn("series", F.coalesce(series_identity(group_labels(grouping)), F.lit("{}")))
    return labelled(keyed.groupBy("series").agg(value.alias("value")), keep_name=True)


def ranked(vector: DataFrame, op: str, k: int, grouping: Grouping) -> DataFrame:
    """The k largest (or smallest) rows of each group with their whole label sets, NaN last, ties by identity."""
    v = F.col("value")
    order = [F.isnan(v).asc(), v.desc() if op == "topk" else v.asc(), F.col("series").asc()]
    if k < 1:
        return vector.limit(0)
    if not grouping.labels and not grouping.without:
        return vector.orderBy(*order).limit(k)  # each task keeps k rows
    group = F.coalesce(series_identity(group_labels(grouping)), F.lit("{}"))
    place = F.row_number().over(Window.partitionBy("group").orderBy(*order))
    return vector.withColumn("group", group).withColumn("place", place).where(F.col("place") <= k).drop("group", "place")
