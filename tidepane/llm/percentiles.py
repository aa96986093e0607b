"""Exact percentiles per group from one full distributed sort.

The values are sorted once, across all groups; counts per partition and group
then say at which place of which partition an order statistic lies. The weighted
runs that are sorted are also the mergeable state: runs of different days or
files are united by :func:`merge_runs` and give the percentiles of the union,
with no error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepane.functions.labels import label
from tidepane.operators.partitioned import before, is_number, partition_count, skew_safe_join
from tidepane.session import written

QUANTILES = (0.5, 0.9, 0.99)
GROUP_LABELS = ("job", "region", "service")
#: Slices in which each sorted partition is counted.
SLICES = 64
#: Rows of wanted positions up to which they are broadcast (about 100 bytes each).
BROADCAST_POSITIONS = 100_000


def series_groups(series: DataFrame, samples: DataFrame) -> DataFrame:
    """Groups of each series: ``series_id``, ``metric`` and the group labels (``''`` where missing), and ``n``, its rows in ``samples``."""
    names = ["metric", *GROUP_LABELS]
    flat = series.where(F.col("id").isNotNull()).select(F.col("id").alias("series_id"), F.coalesce("metric", F.lit("")).alias("metric"), *[label("labels", g).alias(g) for g in GROUP_LABELS])
    flat = flat.groupBy("series_id").agg(F.min(F.struct(*names)).alias("g")).select("series_id", *[F.col(f"g.{c}").alias(c) for c in names])
    uses = samples.where(F.col("series_id").isNotNull()).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return written(flat.join(uses, "series_id"), "groups")


def value_runs(samples: DataFrame, series: DataFrame) -> DataFrame:
    """Weighted values: metric, group labels, ``value`` and ``n``, how often the groups have it.

    Null and NaN values and rows without a known series are left out, -0 counts
    as 0, infinities stay. A value that is repeated very often is one row, added
    up on the map side.
    """
    kept = samples.where(F.col("series_id").isNotNull() & is_number(F.col("value")))
    value = F.when(F.col("value") == 0, F.lit(0.0)).otherwise(F.col("value"))
    joined = skew_safe_join(kept.select("series_id", value.alias("value")), series_groups(series, samples).withColumnRenamed("n", "uses"), "series_id", "uses")
    keys = ["metric", *GROUP_LABELS, "value"]
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def merge_runs(*runs: DataFrame) -> DataFrame:
    """Runs of several days or files as the runs of their union."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    keys = [c for c in out.columns if c != "n"]
    return out.groupBy(*keys).agg(F.sum("n").alias("n"))


def _group(dimension: str) -> Column:
    """Value of a dimension: the column itself, or of several joined by commas the JSON array of their values."""
    columns = dimension.split(",")
    return F.col(dimension) if len(columns) == 1 else F.to_json(F.array(*[F.col(c) for c in columns]))


def percentiles(runs: DataFrame, dimensions: Sequence[str] = ("metric", *GROUP_LABELS), quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Percentiles of each value of each dimension: ``dimension``, ``grp``, ``q``, ``n``, ``value``.

    A dimension is a column of the runs, or several (``"metric,job"``) for each
    combination of their values.

    ``n`` counts the values of the group. With n values the percentile q lies at
    position q (n - 1), counted from 0, and is interpolated between its two
    neighbours. Between two equal neighbours it is their value, also if they are
    infinite; between an infinite and a finite one it is the infinite one,
    between -inf and +inf NaN. An empty input gives no rows.

    The runs are sorted by value over all partitions, ties by their groups, so a
    group with any share of the rows is spread like all others. Each partition
    is counted in ``SLICES`` slices; only the slices that hold a wanted position
    are read again.
    """
    order = ["value", *[c for c in runs.columns if c not in ("value", "n")]]
    spread = partition_count(runs)
    # Partition number in the upper bits, row number below: ascending in the order of the sort.
    laid = written(runs.repartitionByRange(spread, *order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id()), "sorted")
    rows = laid.count()
    step = 1 << max(8, (max(1, rows // (spread * SLICES)) - 1).bit_length())  # a power of two: no slice lies in two partitions
    dims = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), _group(d).alias("grp")) for d in dimensions]))
    slot = F.shiftright("seq", step.bit_length() - 1).alias("slot")
    split = laid.select(slot, "value", "n", dims.alias("d")).select("slot", "d.dimension", "d.grp", "value", "n")
    keys = ["dimension", "grp"]

    # A group has a sum per partition, summed up over the partitions, and within each at most SLICES slices with sums of their own.
    pid = F.shiftright("slot", 33 - (step.bit_length() - 1)).alias("pid")
    counts = written(split.groupBy(*keys, "slot").agg(F.sum("n").alias("here")).withColumn("pid", pid), "counts")
    parts = before(counts.groupBy(*keys, "pid").agg(F.sum("here").alias("part")), "part", "sum", keys, out="carried")
    parts = parts.withColumn("total", F.sum("part").over(Window.partitionBy(*keys))).drop("part")
    inner = F.sum("here").over(Window.partitionBy(*keys, "pid").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    placed = counts.withColumn("inner", F.coalesce(inner, F.lit(0))).join(parts, [*keys, "pid"]).withColumn("start", F.col("carried") + F.col("inner")).drop("carried", "inner", "pid")
    position = F.col("q") * (F.col("total") - 1)
    targets = placed.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles]))).withColumn("low", F.floor(position)).withColumn("high", F.ceil(position))
    sides = F.array(F.struct(F.lit("lo").alias("side"), F.col("low").alias("rank")), F.struct(F.lit("hi").alias("side"), F.col("high").alias("rank")))
    wanted = targets.select(*keys, "slot", "start", "here", "total", "q", F.explode(sides).alias("t"))
    inside = (F.col("t.rank") >= F.col("start")) & (F.col("t.rank") < F.col("start") + F.col("here"))
    wanted = wanted.where(inside).select(*keys, "slot", "q", "total", "t.side", (F.col("t.rank") - F.col("start")).alias("rank"))
    wanted = written(wanted.groupBy(*keys, "slot").agg(F.collect_list(F.struct("q", "total", "side", "rank")).alias("wants")), "positions")

    # Two positions a group and percentile: broadcast while that is small, else joined by a shuffle.
    small = wanted.count() <= BROADCAST_POSITIONS
    near = split.join(F.broadcast(wanted) if small else wanted, [*keys, "slot"])
    upto = F.sum("n").over(Window.partitionBy(*keys, "slot").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = near.withColumn("upto", upto)
    hits = ranked.withColumn("w", F.explode(F.filter("wants", lambda w: (w["rank"] < F.col("upto")) & (w["rank"] >= F.col("upto") - F.col("n")))))
    ends = [F.max(F.when(F.col("w.side") == side, F.col("value"))).alias(side) for side in ("lo", "hi")]
    found = hits.groupBy(*keys, F.col("w.q").alias("q"), F.col("w.total").alias("n")).agg(*ends)
    infinite = F.lit(float("inf"))
    share = F.col("q") * (F.col("n") - 1) - F.floor(F.col("q") * (F.col("n") - 1))
    value = (
        F.when(F.col("lo") == F.col("hi"), F.col("lo"))
        .when((F.col("lo") == -infinite) & (F.col("hi") == infinite), F.lit(float("nan")))
        .when(F.col("lo") == -infinite, F.col("lo"))
        .when(F.col("hi") == infinite, F.col("hi"))
        .otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * share)
    )
    return found.select(*keys, "q", "n", value.alias("value"))
