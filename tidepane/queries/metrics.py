"""Instant queries over labelled samples and the parts they are made of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepane.functions.labels import METRIC_LABEL, label
from tidepane.functions.timeline import pane_end, within_ms
from tidepane.operators.evaluate import evaluate, window_of
from tidepane.operators.states import Counter, DDSketch, DistinctItems, Exact, ExactQuantile, ItemWeights, Kll
from tidepane.operators.vector import labelled
from tidepane.operators.windows import range_window
from tidepane.plans.promql import parse
from tidepane.queries.compare import quantised, quantised_sql
from tidepane.sources.samples import Interned, Wide, event_samples, event_source, stored_samples
from tidepane.sources.tables import table

DAY = 86_400_000
#: Evaluation times inside the data: 2024-01-21 for events, 2026-03-07 for samples.
T_EVENTS = 1_705_795_200_000
T_SAMPLES = 1_772_841_600_000
COUNTER = "edge_requests_total"
LABELS = ("env", "instance", "job", "pod", "region", "service")


Window = tuple[int, int] | None


def events(spark: SparkSession, folder: str, window: Window = None) -> DataFrame:
    """Samples of the events; a window is compared with the stored time, so that the scan can skip by it."""
    rows = table(spark, folder, "events")
    return event_samples(rows if window is None else rows.where(within_ms("ts", *window)))


def event_values(spark: SparkSession, folder: str, window: Window = None) -> Wide:
    rows = table(spark, folder, "events")
    return event_source(rows if window is None else rows.where(within_ms("ts", *window)))


def interned(spark: SparkSession, folder: str, window: Window = None) -> Interned:
    """Raw samples and their series; the time is a column of the table, so the evaluation's own filter reaches the scan."""
    return Interned(table(spark, folder, "samples"), table(spark, folder, "series"))


def signed_events(spark: SparkSession, folder: str, window: Window = None) -> DataFrame:
    return event_samples(table(spark, folder, "events"), value=F.col("value") - 50)


def stored(spark: SparkSession, folder: str, window: Window = None) -> DataFrame:
    """Stored samples; their time is a column of the table, so the evaluation's own filter reaches the scan."""
    return stored_samples(table(spark, folder, "samples"), table(spark, folder, "series"))


def flat(vector: DataFrame, *names: str) -> DataFrame:
    """A vector with its labels as columns."""
    return vector.select(*[label("labels", n).alias(n) for n in names], quantised("value"))


Source = Callable[..., DataFrame | Wide | Interned]


def instant(query: str, names: tuple[str, ...], source: Source = event_values, time_ms: int = T_EVENTS) -> Source:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return flat(evaluate(query, source(spark, folder, window_of(query, time_ms)), time_ms), *names)

    return run


_EVENTS = "e AS (SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) // 1000 AS ts_ms, value, event_id AS arrival FROM events WHERE value IS NOT NULL AND ts IS NOT NULL)"
_STORED = f"""e AS (SELECT {", ".join(f"coalesce(labels['{n}'], '') AS {n}" for n in LABELS)}, timestamp_ms AS ts_ms, value, arrival FROM samples JOIN series ON series_id = id
  WHERE coalesce(nullif(metric, ''), labels['__name__']) = '{COUNTER}' AND timestamp_ms IS NOT NULL AND value IS NOT NULL)"""


def _sql(value: str, by: tuple[str, ...], days: float, where: str = "TRUE", offset: int = 0, source: str = _EVENTS, time_ms: int = T_EVENTS) -> str:
    """CTEs ``e`` (samples) and ``v`` (value per series) for a range function."""
    end = time_ms - offset
    return f"WITH {source}, v AS (SELECT {', '.join(by)}, {value} AS value FROM e WHERE ts_ms > {end - int(days * DAY)} AND ts_ms <= {end} AND {where} GROUP BY {', '.join(by)})"


_USER = ("event_type", "user_id")
_OUT = quantised_sql("value") + " AS value"


def _per_series(value: str, days: float = 7, where: str = "TRUE", offset: int = 0) -> str:
    return _sql(value, _USER, days, where, offset) + f" SELECT event_type, user_id, {_OUT} FROM v"


def _by(op: str, value: str = "sum(value)", days: float = 1, by: str = "event_type") -> str:
    return _sql(value, _USER, days) + f", g AS (SELECT {by}, {op} AS value FROM v GROUP BY {by}) SELECT {by}, {_OUT} FROM g"


def _rate(function: str, hours: float) -> str:
    """PromQL's extrapolated growth, written out."""
    end, start = T_SAMPLES, T_SAMPLES - int(hours * 3_600_000)
    by = ", ".join(LABELS)
    growth = "delta * ((span + ds + de) / span)"
    value = growth if function == "increase" else f"{growth} / CAST({hours * 3600} AS DOUBLE)"
    return f"""WITH {_STORED}, w AS (
  SELECT *, lag(value) OVER (PARTITION BY {by} ORDER BY ts_ms, arrival) AS before FROM e WHERE ts_ms > {start} AND ts_ms <= {end}
), s AS (
  SELECT {by}, min(struct_pack(t := ts_ms, a := arrival, v := value)) AS a, max(struct_pack(t := ts_ms, a := arrival, v := value)) AS b, count(*) AS n,
         coalesce(sum(CASE WHEN value < before THEN before END), 0) AS lost FROM w GROUP BY {by}
), d AS (
  SELECT *, b.v - a.v + lost AS delta, (b.t - a.t) / CAST(1000 AS DOUBLE) AS span, (b.t - a.t) / CAST(1000 AS DOUBLE) / (n - 1) AS step,
         (a.t - {start}) / CAST(1000 AS DOUBLE) AS ds0, ({end} - b.t) / CAST(1000 AS DOUBLE) AS de0 FROM s WHERE n >= 2 AND b.t > a.t
), x AS (
  SELECT *, CASE WHEN ds0 >= CAST(1.1 AS DOUBLE) * step THEN step / 2 ELSE ds0 END AS ds1, CASE WHEN de0 >= CAST(1.1 AS DOUBLE) * step THEN step / 2 ELSE de0 END AS de FROM d
), y AS (SELECT *, CASE WHEN delta > 0 AND a.v >= 0 THEN least(ds1, span * a.v / delta) ELSE ds1 END AS ds FROM x
), v AS (SELECT {by}, {value} AS value FROM y)"""


_RANK = "row_number() OVER ({part} ORDER BY CAST(isnan(value) AS INTEGER), value {way}, event_type, user_id)"


def _topk(k: int, way: str = "DESC", part: str = "") -> str:
    place = _RANK.format(part=part, way=way)
    return _sql("sum(value)", _USER, 7) + f" SELECT event_type, user_id, {_OUT} FROM (SELECT *, {place} AS place FROM v) WHERE place <= {k}"


_INSTANT = f"""WITH {_EVENTS}, v AS (SELECT event_type, user_id, arg_max(value, struct_pack(t := ts_ms, a := arrival)) AS value FROM e
  WHERE ts_ms > {T_EVENTS - 300_000} AND ts_ms <= {T_EVENTS} GROUP BY event_type, user_id) SELECT event_type, user_id, {_OUT} FROM v"""
_SUM7 = "sum_over_time(events_value{}[7d])"


def pane_assign(spark: SparkSession, folder: str) -> DataFrame:
    """Daily left-open pane of every event."""
    return events(spark, folder).groupBy(pane_end("ts_ms", DAY).alias("pane_end_ms")).agg(F.count(F.lit(1)).alias("n"))


def _panes(samples: DataFrame, query: str, time_ms: int, pane_ms: int, family) -> DataFrame:
    """Value of a range function from states of its panes, merged."""
    e = parse(query)
    end = time_ms - e.selector.offset_ms
    window = range_window(samples, e.selector, end).withColumn("pane_end_ms", pane_end("ts_ms", pane_ms))
    states = family.merge(family.build(window, ["pane_end_ms"]))
    return labelled(family.estimate(states, end - e.selector.range_ms, end, e.function, e.q))


def pane_sum_merge(spark: SparkSession, folder: str) -> DataFrame:
    return flat(_panes(events(spark, folder, window_of("sum_over_time(events_value[7d])", T_EVENTS)), "sum_over_time(events_value[7d])", T_EVENTS, DAY, Exact()), *_USER)


def pane_counter_merge(spark: SparkSession, folder: str) -> DataFrame:
    return flat(_panes(stored(spark, folder), f"increase({COUNTER}[12h])", T_SAMPLES, 3_600_000, Counter()), *LABELS)


def _bounded(spark: SparkSession, folder: str, source: Source, family, q: float, bound: Callable) -> DataFrame:
    """Per event type: number of values, and whether the sketch of merged panes keeps its bound."""
    samples = source(spark, folder).where(F.col("ts_ms") <= T_EVENTS).withColumn("pane_end_ms", pane_end("ts_ms", DAY)).withColumn("series", F.to_json(F.map_filter("labels", lambda k, _: k == "event_type")))
    exact = ExactQuantile()
    sketch = family.estimate(family.merge(family.build(samples, ["pane_end_ms"])), 0, T_EVENTS, "quantile_over_time", q).withColumnRenamed("value", "estimate")
    true = exact.estimate(exact.build(samples), 0, T_EVENTS, "quantile_over_time", q).withColumnRenamed("value", "truth")
    both = samples.join(sketch, "series").join(true, "series").groupBy("series", "estimate", "truth")
    counted = both.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("value") <= F.col("estimate")).cast("double")).alias("rank"), F.avg((F.col("value") < F.col("estimate")).cast("double")).alias("low_rank"))
    return counted.select(F.get_json_object("series", "$.event_type").alias("event_type"), "n", bound().alias("within_bound"))


def pane_kll_within_bound(spark: SparkSession, folder: str) -> DataFrame:
    return _bounded(spark, folder, events, Kll(), 0.9, lambda: (F.col("rank") >= 0.9 - 0.01) & (F.col("low_rank") <= 0.9 + 0.01))


def _relative() -> Column:
    return F.abs(F.col("estimate") - F.col("truth")) <= F.lit(0.05) * F.abs("truth") + F.lit(1e-9)


def pane_ddsketch_within_bound(spark: SparkSession, folder: str) -> DataFrame:
    return _bounded(spark, folder, events, DDSketch(), 0.99, _relative)


def ddsketch_signed(spark: SparkSession, folder: str) -> DataFrame:
    return _bounded(spark, folder, signed_events, DDSketch(), 0.99, _relative)


def ddsketch_signed_low(spark: SparkSession, folder: str) -> DataFrame:
    """A low quantile of values of both signs, which lies among the negative ones."""
    return _bounded(spark, folder, signed_events, DDSketch(), 0.1, _relative)


def ddsketch_negative(spark: SparkSession, folder: str) -> DataFrame:
    """Values that are all negative."""
    return _bounded(spark, folder, lambda s, f: event_samples(table(s, f, "events"), value=-1 - F.abs("value")), DDSketch(), 0.5, _relative)


def _item_panes(spark: SparkSession, folder: str, family) -> DataFrame:
    """States per event type of daily panes, merged; users are the items."""
    samples = events(spark, folder).where(F.col("ts_ms") <= T_EVENTS).withColumn("pane_end_ms", pane_end("ts_ms", DAY))
    return family.merge(family.build(samples, ["pane_end_ms"]))


def item_weights(spark: SparkSession, folder: str) -> DataFrame:
    """The three heaviest users of each event type by their values."""
    family = ItemWeights(item="user_id")
    best = family.heaviest(_item_panes(spark, folder, family), 3)
    return flat(labelled(family.estimate(best, 0, T_EVENTS, "sum_over_time")), *_USER)


def distinct_within_bound(spark: SparkSession, folder: str) -> DataFrame:
    """Users of each event type from merged sketches, within three standard errors."""
    family = DistinctItems(item="user_id")
    found = labelled(family.estimate(_item_panes(spark, folder, family), 0, T_EVENTS, "count_over_time"))
    exact = table(spark, folder, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("n"))
    both = found.select(label("labels", "event_type").alias("event_type"), "value").join(exact, "event_type")
    return both.select("event_type", (F.abs(F.col("value") - F.col("n")) <= 0.025 * F.col("n") + 1).alias("within_bound"))


def topk_beyond(spark: SparkSession, folder: str) -> DataFrame:
    """More than there are: all rows of each group."""
    return instant("topk by (event_type) (1000000, sum_over_time(events_value[7d]))", _USER)(spark, folder)


def names_dropped(spark: SparkSession, folder: str) -> DataFrame:
    """Which vectors still carry the metric's name."""
    rows = []
    for kind, query in (("selector", "events_value"), ("last", "last_over_time(events_value[7d])"), ("sum", "sum_over_time(events_value[7d])"), ("ranked", "topk(3, events_value)"), ("grouped", "sum by (event_type) (events_value)")):
        found = evaluate(query, event_values(spark, folder), T_EVENTS).select(F.bool_and(label("labels", METRIC_LABEL) == "events_value").alias("named")).first()
        rows.append((kind, found["named"]))
    return spark.createDataFrame(rows, "vector string, named boolean")


_BOUND = f"WITH {_EVENTS} SELECT event_type, count(*) AS n, TRUE AS within_bound FROM e WHERE ts_ms <= {T_EVENTS} GROUP BY event_type"

QUERIES = {
    "sum_by": instant("sum by (event_type) (sum_over_time(events_value[1d]))", ("event_type",)),
    "sum_over_time": instant("sum_over_time(events_value[7d])", _USER),
    "count_over_time": instant("count_over_time(events_value[7d])", _USER),
    "avg_over_time": instant("avg_over_time(events_value[7d])", _USER),
    "min_over_time": instant("min_over_time(events_value[7d])", _USER),
    "max_over_time": instant("max_over_time(events_value[7d])", _USER),
    "last_over_time": instant("last_over_time(events_value[7d])", _USER),
    "quantile_over_time": instant("quantile_over_time(0.9, events_value[7d])", _USER),
    "instant_selector": instant("events_value", _USER),
    "offset": instant("sum_over_time(events_value[7d] offset 2d)", _USER),
    "matcher_eq": instant(_SUM7.format('{event_type="click"}'), _USER),
    "matcher_ne": instant(_SUM7.format('{event_type!="click"}'), _USER),
    "matcher_re": instant(_SUM7.format('{event_type=~"cl.*|view"}'), _USER),
    "matcher_nre": instant(_SUM7.format('{event_type!~"cl.*|view"}'), _USER),
    "matcher_missing": instant(_SUM7.format('{absent=""}'), _USER),
    "avg_by": instant("avg by (event_type) (sum_over_time(events_value[1d]))", ("event_type",)),
    "max_by": instant("max by (event_type) (sum_over_time(events_value[1d]))", ("event_type",)),
    "min_by": instant("min by (event_type) (sum_over_time(events_value[1d]))", ("event_type",)),
    "count_by": instant("count by (event_type) (sum_over_time(events_value[1d]))", ("event_type",)),
    "stddev_by": instant("stddev by (event_type) (sum_over_time(events_value[1d]))", ("event_type",)),
    "sum_without": instant("sum without (user_id) (sum_over_time(events_value[1d]))", ("event_type",)),
    "sum_all": instant("sum(sum_over_time(events_value[1d]))", ()),
    "topk": instant("topk(10, sum_over_time(events_value[7d]))", _USER),
    "bottomk": instant("bottomk(10, sum_over_time(events_value[7d]))", _USER),
    "topk_by": instant("topk by (event_type) (3, sum_over_time(events_value[7d]))", _USER),
    "bottomk_by": instant("bottomk by (event_type) (3, sum_over_time(events_value[7d]))", _USER),
    "topk_of_sum_by": instant("topk(3, sum by (event_type) (sum_over_time(events_value[7d])))", ("event_type",)),
    "avg_of_quantiles": instant("avg by (event_type) (quantile_over_time(0.99, events_value[7d]))", ("event_type",)),
    "rate": instant(f"rate({COUNTER}[12h])", LABELS, interned, T_SAMPLES),
    "increase": instant(f"increase({COUNTER}[12h])", LABELS, interned, T_SAMPLES),
    "sum_by_of_rate": instant(f"sum by (job) (rate({COUNTER}[12h]))", ("job",), interned, T_SAMPLES),
    "pane_assign": pane_assign,
    "pane_sum_merge": pane_sum_merge,
    "pane_counter_merge": pane_counter_merge,
    "pane_kll_within_bound": pane_kll_within_bound,
    "pane_ddsketch_within_bound": pane_ddsketch_within_bound,
    "ddsketch_signed": ddsketch_signed,
    "ddsketch_signed_low": ddsketch_signed_low,
    "ddsketch_negative": ddsketch_negative,
    "item_weights": item_weights,
    "distinct_within_bound": distinct_within_bound,
    "topk_beyond": topk_beyond,
    "names_dropped": names_dropped,
}

_REGEX = "regexp_full_match(event_type, 'cl.*|view')"
ORACLES = {
    "sum_by": _by("sum(value)"),
    "sum_over_time": _per_series("sum(value)"),
    "count_over_time": _per_series("CAST(count(*) AS DOUBLE)"),
    "avg_over_time": _per_series("avg(value)"),
    "min_over_time": _per_series("min(value)"),
    "max_over_time": _per_series("max(value)"),
    "last_over_time": _per_series("arg_max(value, struct_pack(t := ts_ms, a := arrival))"),
    "quantile_over_time": _per_series("quantile_cont(value, 0.9)"),
    "instant_selector": _INSTANT,
    "offset": _per_series("sum(value)", offset=2 * DAY),
    "matcher_eq": _per_series("sum(value)", where="event_type = 'click'"),
    "matcher_ne": _per_series("sum(value)", where="event_type <> 'click'"),
    "matcher_re": _per_series("sum(value)", where=_REGEX),
    "matcher_nre": _per_series("sum(value)", where="NOT " + _REGEX),
    "matcher_missing": _per_series("sum(value)"),
    "avg_by": _by("avg(value)"),
    "max_by": _by("max(value)"),
    "min_by": _by("min(value)"),
    "count_by": _by("CAST(count(value) AS DOUBLE)"),
    "stddev_by": _by("stddev_pop(value)"),
    "sum_without": _by("sum(value)"),
    "sum_all": _sql("sum(value)", _USER, 1) + f", g AS (SELECT sum(value) AS value FROM v HAVING count(*) > 0) SELECT {_OUT} FROM g",
    "topk": _topk(10),
    "bottomk": _topk(10, "ASC"),
    "topk_by": _topk(3, part="PARTITION BY event_type"),
    "bottomk_by": _topk(3, "ASC", "PARTITION BY event_type"),
    "topk_of_sum_by": _sql("sum(value)", ("event_type",), 7) + f" SELECT event_type, {_OUT} FROM (SELECT * FROM v ORDER BY value DESC, event_type LIMIT 3)",
    "avg_of_quantiles": _by("avg(value)", "quantile_cont(value, 0.99)", 7),
    "rate": _rate("rate", 12) + f" SELECT {', '.join(LABELS)}, {_OUT} FROM v",
    "increase": _rate("increase", 12) + f" SELECT {', '.join(LABELS)}, {_OUT} FROM v",
    "sum_by_of_rate": _rate("rate", 12) + f", g AS (SELECT job, sum(value) AS value FROM v GROUP BY job) SELECT job, {_OUT} FROM g",
    "pane_assign": f"WITH {_EVENTS} SELECT ts_ms + ((-ts_ms % {DAY}) + {DAY}) % {DAY} AS pane_end_ms, count(*) AS n FROM e GROUP BY 1",
    "pane_sum_merge": _per_series("sum(value)"),
    "pane_counter_merge": _rate("increase", 12) + f" SELECT {', '.join(LABELS)}, {_OUT} FROM v",
    "pane_kll_within_bound": _BOUND,
    "pane_ddsketch_within_bound": _BOUND,
    "ddsketch_signed": _BOUND,
    "ddsketch_signed_low": _BOUND,
    "ddsketch_negative": _BOUND,
    "item_weights": f"WITH {_EVENTS}, v AS (SELECT event_type, user_id, sum(value) AS value FROM e WHERE ts_ms <= {T_EVENTS} GROUP BY event_type, user_id) SELECT event_type, user_id, {_OUT} FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, user_id) AS place FROM v) WHERE place <= 3",
    "distinct_within_bound": "SELECT DISTINCT event_type, TRUE AS within_bound FROM events",
    "topk_beyond": _per_series("sum(value)"),
    "names_dropped": "SELECT * FROM (VALUES ('selector', TRUE), ('last', TRUE), ('sum', FALSE), ('ranked', TRUE), ('grouped', FALSE)) t(vector, named)",
}
