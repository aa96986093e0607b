"""Mergeable summary states: built from samples, merged over panes, and turned into values.

Every family groups by ``series`` and any further keys (a pane, say), so a state
built over a window equals the merge of states built over its panes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepane.functions.labels import label, series_identity, without_labels

KEY = "series"


def _only_number_max(c: Column) -> Column:
    """Maximum that ignores NaN unless there is nothing else."""
    return F.coalesce(F.max(F.when(~F.isnan(c), c)), F.max(c))


def _only_number_min(c: Column) -> Column:
    return F.coalesce(F.min(F.when(~F.isnan(c), c)), F.min(c))


@dataclass(frozen=True)
class Family:
    """A kind of summary; ``columns`` are its state, and ``newest`` that of them with the time of the newest sample, if it is there."""

    name: str
    columns: tuple[tuple[str, str], ...]
    newest: ClassVar[str | None] = None

    def build(self, samples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        raise NotImplementedError

    def merge(self, states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        raise NotImplementedError

    def estimate(self, states: DataFrame, start_ms: int, end_ms: int, function: str, q: float | None = None) -> DataFrame:
        """``series`` and ``value`` of states that cover ``(start_ms, end_ms]``."""
        raise NotImplementedError


@dataclass(frozen=True)
class Exact(Family):
    """Sum, count, extremes and the latest value: everything the simple functions need."""

    name: str = "exact"
    newest: ClassVar[str | None] = "last_ms"
    columns: tuple[tuple[str, str], ...] = (("sum", "double"), ("n", "bigint"), ("low", "double"), ("high", "double"), ("last_ms", "bigint"), ("last", "double"))

    def build(self, samples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        v = F.col("value")
        last = F.max(F.struct("ts_ms", "arrival", "value"))
        out = samples.groupBy(KEY, *keys).agg(F.sum(v).alias("sum"), F.count(F.lit(1)).alias("n"), _only_number_min(v).alias("low"), _only_number_max(v).alias("high"), last.alias("l"))
        return out.select(KEY, *keys, "sum", "n", "low", "high", F.col("l.ts_ms").alias("last_ms"), F.col("l.value").alias("last"))

    def merge(self, states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        last = F.max(F.struct("last_ms", "last"))
        out = states.groupBy(KEY, *keys).agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"), _only_number_min(F.col("low")).alias("low"), _only_number_max(F.col("high")).alias("high"), last.alias("l"))
        return out.select(KEY, *keys, "sum", "n", "low", "high", "l.last_ms", "l.last")

    def estimate(self, states: DataFrame, start_ms: int, end_ms: int, function: str, q: float | None = None) -> DataFrame:
        value = {"sum_over_time": F.col("sum"), "count_over_time": F.col("n").cast("double"), "avg_over_time": F.col("sum") / F.col("n"), "min_over_time": F.col("low"), "max_over_time": F.col("high"), "last_over_time": F.col("last")}[function]
        return states.select(KEY, value.alias("value"))


@dataclass(frozen=True)
class Counter(Family):
    """First and last sample, number of samples, and what resets took away."""

    name: str = "counter"
    newest: ClassVar[str | None] = "t1"
    columns: tuple[tuple[str, str], ...] = (("t0", "bigint"), ("v0", "double"), ("t1", "bigint"), ("v1", "double"), ("n", "bigint"), ("lost", "double"))
    #: Samples of a series are compared in blocks of this much time, whose states are then merged like panes.
    block_ms: int = 900_000

    def build(self, samples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        """A busy series is many blocks, so none is a single task."""
        blocked = samples.withColumn("__block", F.floor(F.col("ts_ms") / F.lit(self.block_ms)))
        return self.merge(self._block(blocked, [*keys, "__block"]), keys)

    def _block(self, samples: DataFrame, keys: Sequence[str]) -> DataFrame:
        before = F.lag("value").over(Window.partitionBy(KEY, *keys).orderBy("ts_ms", "arrival"))
        steps = samples.withColumn("before", before)
        ends = F.struct("ts_ms", "arrival", "value")
        out = steps.groupBy(KEY, *keys).agg(F.min(ends).alias("a"), F.max(ends).alias("b"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("value") < F.col("before"), F.col("before"))), F.lit(0.0)).alias("lost"))
        return out.select(KEY, *keys, F.col("a.ts_ms").alias("t0"), F.col("a.value").alias("v0"), F.col("b.ts_ms").alias("t1"), F.col("b.value").alias("v1"), "n", "lost")

    def merge(self, states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        """A series has one state per pane, so the look back at the pane before is short."""
        before = F.lag("v1").over(Window.partitionBy(KEY, *keys).orderBy("t0"))
        steps = states.withColumn("before", before)
        lost = F.sum(F.col("lost") + F.when(F.col("v0") < F.col("before"), F.col("before")).otherwise(F.lit(0.0)))
        out = steps.groupBy(KEY, *keys).agg(F.min(F.struct("t0", "v0")).alias("a"), F.max(F.struct("t1", "v1")).alias("b"), F.sum("n").alias("n"), lost.alias("lost"))
        return out.select(KEY, *keys, "a.t0", "a.v0", "b.t1", "b.v1", "n", "lost")

    def estimate(self, states: DataFrame, start_ms: int, end_ms: int, function: str, q: float | None = None) -> DataFrame:
        """Growth over the window, extrapolated to its ends as PromQL does; fewer than two samples give no row."""
        ok = states.where((F.col("n") >= 2) & (F.col("t1") > F.col("t0")))
        delta = F.col("v1") - F.col("v0") + F.col("lost")
        span = (F.col("t1") - F.col("t0")) / F.lit(1000.0)
        step = span / (F.col("n") - 1)
        reach = F.lit(1.1) * step
        left, right = (F.col("t0") - F.lit(start_ms)) / F.lit(1000.0), (F.lit(end_ms) - F.col("t1")) / F.lit(1000.0)
        left = F.when(left >= reach, step / 2).otherwise(left)
        right = F.when(right >= reach, step / 2).otherwise(right)
        # A counter cannot have been below zero at the start of the window.
        left = F.when((delta > 0) & (F.col("v0") >= 0), F.least(left, span * F.col("v0") / delta)).otherwise(left)
        grown = delta * ((span + left + right) / span)
        value = grown if function == "increase" else grown / F.lit((end_ms - start_ms) / 1000.0)
        return ok.select(KEY, value.alias("value"))


def _bucket(v: Column) -> Column:
    """Number of a narrow bucket (4,096 to a doubling) that rises with the value; NaN is the largest."""
    size = F.floor(F.log2(F.abs(v)) * F.lit(4096.0)) + F.lit(1 << 24)
    huge = F.abs(v) == F.lit(math.inf)
    side = F.when(v == 0, F.lit(0)).when(huge, F.lit(1 << 40)).otherwise(size)
    return F.when(F.isnan(v), F.lit(1 << 41)).when(v < 0, -side).otherwise(side).cast("bigint")


def _between(placed: DataFrame, value: Column) -> DataFrame:
    """``series`` and the value at ``rank``, interpolated between its neighbours; rows hold the places from ``upto`` - ``n`` to before ``upto``."""
    holds = lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n"))
    ends = placed.groupBy(KEY).agg(F.max("rank").alias("rank"), F.max(F.when(holds(F.floor("rank")), value)).alias("lo"), F.max(F.when(holds(F.ceil("rank")), value)).alias("hi"))
    share = F.col("rank") - F.floor("rank")
    return ends.select(KEY, F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * share).alias("value"))


@dataclass(frozen=True)
class ExactQuantile(Family):
    """Values themselves, with their number: exact, interpolated at rank q (n - 1)."""

    name: str = "values"
    columns: tuple[tuple[str, str], ...] = (("value", "double"), ("n", "bigint"))

    def build(self, samples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        return samples.groupBy(KEY, *keys, "value").agg(F.count(F.lit(1)).alias("n"))

    def merge(self, states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        return states.groupBy(KEY, *keys, "value").agg(F.sum("n").alias("n"))

    def estimate(self, states: DataFrame, start_ms: int, end_ms: int, function: str, q: float | None = None) -> DataFrame:
        assert q is not None
        if not 0 <= q <= 1:
            return states.select(KEY).distinct().withColumn("value", F.lit(math.copysign(math.inf, q if q < 0 else 1)))
        # Counts of narrow buckets of values say in which bucket an order statistic lies; only those are sorted.
        bucketed = states.withColumn("bucket", _bucket(F.col("value")))
        by = Window.partitionBy(KEY)
        upto = F.sum("here").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        counts = bucketed.groupBy(KEY, "bucket").agg(F.sum("n").alias("here")).withColumn("start", upto - F.col("here")).withColumn("rank", F.lit(float(q)) * (F.sum("here").over(by) - 1))
        wanted = counts.where((F.ceil("rank") >= F.col("start")) & (F.floor("rank") < F.col("start") + F.col("here"))).drop("here")
        place = F.sum("n").over(Window.partitionBy(KEY, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        placed = bucketed.join(wanted, [KEY, "bucket"]).withColumn("upto", F.col("start") + place)
        return _between(placed, F.col("value"))


@dataclass(frozen=True)
class Kll(Family):
    """KLL sketch of the values: bounded rank error, 0.997 % at k = 269 with 99 % confidence."""

    name: str = "kll"
    columns: tuple[tuple[str, str], ...] = (("sketch", "binary"), ("n", "bigint"))
    k: int = 269

    def build(self, samples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        kept = samples.where(~F.isnan("value"))
        return kept.groupBy(KEY, *keys).agg(F.expr(f"kll_sketch_agg_double(value, {self.k})").alias("sketch"), F.count(F.lit(1)).alias("n"))

    def merge(self, states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        return states.groupBy(KEY, *keys).agg(F.expr(f"kll_merge_agg_double(sketch, {self.k})").alias("sketch"), F.sum("n").alias("n"))

    def estimate(self, states: DataFrame, start_ms: int, end_ms: int, function: str, q: float | None = None) -> DataFrame:
        assert q is not None
        if not 0 <= q <= 1:
            return states.select(KEY, F.lit(math.copysign(math.inf, q if q < 0 else 1)).alias("value"))
        return states.select(KEY, F.expr(f"kll_sketch_get_quantile_double(sketch, {float(q)}D)").alias("value"))


@dataclass(frozen=True)
class DDSketch(Family):
    """Logarithmic buckets with a negative side and a zero bucket: bounded relative error.

    A state is a set of rows, one per bucket: sign, bucket and count. Values
    within a bucket differ by at most (1 + alpha) / (1 - alpha). The quantile is
    interpolated between the two order statistics around rank q (n - 1); its
    relative error is at most alpha if both have the same sign. NaN is left out.
    """

    name: str = "ddsketch"
    columns: tuple[tuple[str, str], ...] = (("sign", "int"), ("bucket", "bigint"), ("n", "bigint"))
    alpha: float = 0.05

    @property
    def gamma(self) -> float:
        return (1 + self.alpha) / (1 - self.alpha)

    def build(self, samples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        v = F.col("value")
        sign = F.when(v > 0, 1).when(v < 0, -1).otherwise(0).alias("sign")
        huge = F.abs(v) == F.lit(math.inf)
        bucket = F.when(v == 0, F.lit(0)).when(huge, F.lit(2**40)).otherwise(F.ceil(F.log(F.abs(v)) / F.lit(math.log(self.gamma)))).cast("bigint").alias("bucket")
        return samples.where(~F.isnan(v)).groupBy(KEY, *keys, sign, bucket).agg(F.count(F.lit(1)).alias("n"))

    def merge(self, states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        return states.groupBy(KEY, *keys, "sign", "bucket").agg(F.sum("n").alias("n"))

    def estimate(self, states: DataFrame, start_ms: int, end_ms: int, function: str, q: float | None = None) -> DataFrame:
        assert q is not None
        if not 0 <= q <= 1:
            return states.select(KEY).distinct().withColumn("value", F.lit(math.copysign(math.inf, q if q < 0 else 1)))
        by = Window.partitionBy(KEY)
        upto = F.sum("n").over(by.orderBy("sign", F.col("sign") * F.col("bucket")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        total = F.sum("n").over(by)
        inner = F.lit(2.0) * F.pow(F.lit(self.gamma), F.col("bucket").cast("double")) / F.lit(self.gamma + 1)
        middle = F.when(F.col("sign") == 0, F.lit(0.0)).when(F.col("bucket") == F.lit(2**40), F.col("sign") * F.lit(math.inf)).otherwise(F.col("sign") * inner)
        placed = states.withColumn("upto", upto).withColumn("rank", F.lit(float(q)) * (total - 1)).withColumn("middle", middle)
        return _between(placed, F.col("middle"))


def _item_of(item: str) -> tuple[Column, Column]:
    """Identity without the label ``item``, and the label's value (``''`` where missing)."""
    labels = F.from_json(KEY, "map<string,string>")
    return series_identity(without_labels(labels, [item])), label(labels, item)


@dataclass(frozen=True)
class ItemWeights(Family):
    """Weight of each item: the samples' label ``item`` is what is counted, and their value (or 1) its weight.

    A state is a row per item, so a series that is spread over very many items is
    many rows and never one buffer. Series that differ in the item only are one.
    """

    name: str = "items"
    columns: tuple[tuple[str, str], ...] = (("item", "string"), ("weight", "double"), ("n", "bigint"))
    item: str = "instance"
    by_value: bool = True

    def build(self, samples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        series, item = _item_of(self.item)
        weight = F.col("value") if self.by_value else F.lit(1.0)
        laid = samples.select(series.alias("__s"), *keys, item.alias("item"), weight.alias("weight")).withColumnRenamed("__s", KEY)
        return laid.groupBy(KEY, *keys, "item").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))

    def merge(self, states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        return states.groupBy(KEY, *keys, "item").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))

    def estimate(self, states: DataFrame, start_ms: int, end_ms: int, function: str, q: float | None = None) -> DataFrame:
        """``series`` with the item as its label again, and the weight."""
        labels = F.map_concat(F.from_json(KEY, "map<string,string>"), F.when(F.col("item") != "", F.create_map(F.lit(self.item), F.col("item"))).otherwise(F.create_map().cast("map<string,string>")))
        return states.select(series_identity(labels).alias(KEY), F.col("weight").alias("value"))

    def heaviest(self, states: DataFrame, k: int) -> DataFrame:
        """The ``k`` heaviest items of each series, ties by item."""
        place = F.row_number().over(Window.partitionBy(KEY).orderBy(F.col("weight").desc(), "item"))
        return states.withColumn("place", place).where(F.col("place") <= k).drop("place")


@dataclass(frozen=True)
class DistinctItems(Family):
    """How many different values the label ``item`` has, within about 1.04 / 2 ** (bits / 2) (one standard error)."""

    name: str = "distinct"
    columns: tuple[tuple[str, str], ...] = (("sketch", "binary"), ("n", "bigint"))
    item: str = "instance"
    bits: int = 14

    def build(self, samples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        series, item = _item_of(self.item)
        laid = samples.select(series.alias("__s"), *keys, item.alias("item")).withColumnRenamed("__s", KEY).where(F.col("item") != "")
        return laid.groupBy(KEY, *keys).agg(F.hll_sketch_agg("item", F.lit(self.bits)).alias("sketch"), F.count(F.lit(1)).alias("n"))

    def merge(self, states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        return states.groupBy(KEY, *keys).agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("n").alias("n"))

    def estimate(self, states: DataFrame, start_ms: int, end_ms: int, function: str, q: float | None = None) -> DataFrame:
        return states.select(KEY, F.hll_sketch_estimate("sketch").cast("double").alias("value"))


#: Families that deployments add, by name; see :func:`register_family`.
_REGISTERED: dict[str, Callable[..., Family]] = {"items": ItemWeights, "distinct": DistinctItems}


def register_family(name: str, make: Callable[..., Family]) -> None:
    """Let plans name a further family; ``make`` gets the parameters of a definition."""
    _REGISTERED[name] = make


def family_of(function: str, name: str | None = None, **parameters: float) -> Family:
    """The family that answers a range function: exact unless another is named."""
    if name in _REGISTERED:
        return _REGISTERED[name](**parameters)
    if function in ("rate", "increase"):
        return Counter()
    if function == "quantile_over_time":
        if name == "kll":
            return Kll(k=int(parameters.get("k", 269)))
        if name == "ddsketch":
            return DDSketch(alpha=float(parameters.get("alpha", 0.05)))
        return ExactQuantile()
    return Exact()
