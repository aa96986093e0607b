"""Queries over samples as they arrive: duplicates, late rows, heavy keys, regular grids."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepane.operators import dedup, grid, heavy, late
from tidepane.operators.partitioned import finite
from tidepane.queries.compare import quantised, quantised_sql
from tidepane.session import scratch_path, written
from tidepane.sources.tables import table


#: Deliveries in which the messages arrive.
DELIVERIES = 6
#: Digits in which two solvers of the same normal equations agree.
GRID_DIGITS = 6


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    copies = dedup.surplus_copies(table(spark, folder, "time_series"))
    return copies.where("surplus").select("message_id", F.col("pos").cast("int").alias("pos"))


def p2_kept(spark: SparkSession, folder: str) -> DataFrame:
    kept = dedup.kept_copies(table(spark, folder, "time_series"), scratch_path(spark, "deliveries"), DELIVERIES)
    return kept.select("message_id", F.col("pos").cast("int").alias("pos"), "timestamp", "value")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return late.routed(table(spark, folder, "samples")).where("late").select("arrival")


def p4_panes(spark: SparkSession, folder: str) -> DataFrame:
    out = late.corrected_panes(table(spark, folder, "samples"), table(spark, folder, "series"), scratch_path(spark, "panes"))
    return out.select("metric", "pane_end_ms", "n", quantised("total"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy.heavy_pairs(table(spark, folder, "samples"), table(spark, folder, "series")).select("name", "value")


def _heavy_result(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n_rows", "n_values", quantised("total"), "latest_ms", "latest_arrival", "latest_value")


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _heavy_result(heavy.per_pair(table(spark, folder, "samples"), table(spark, folder, "series")), "name", "value")


def p5_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _heavy_result(heavy.per_metric(table(spark, folder, "samples"), table(spark, folder, "series")), "metric")


def _grid(spark: SparkSession, folder: str) -> DataFrame:
    return grid.regular_grid(table(spark, folder, "raw_samples"), table(spark, folder, "workload_sources"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _grid(spark, folder).where("missing").select("source_key", "period_end_ms")


def p6_grid(spark: SparkSession, folder: str) -> DataFrame:
    return _grid(spark, folder).select("source_key", "period_end_ms", "missing", quantised("value", GRID_DIGITS))


#: A growth that is zero but for rounding is zero.
_GROWTH = f"CASE WHEN abs(growth) < 1e-6 THEN CAST(0 AS DOUBLE) ELSE {quantised_sql('growth', 7)} END"


def p6_trend(spark: SparkSession, folder: str) -> DataFrame:
    """The regression without season: mean and growth per day of each source."""
    observed = written(grid.periods(table(spark, folder, "raw_samples"), table(spark, folder, "workload_sources")), "periods")
    fit = grid.season_fit(observed.where(finite(F.col("value"))), grid.origin_of(observed), 0, 0.0)
    fit = fit.where("n > 1").select("source_key", "n", F.element_at("coef", 2).alias("growth"))
    return fit.select("source_key", "n", F.expr(_GROWTH).alias("growth"))


QUERIES = {f.__name__: f for f in (p2_found, p2_kept, p4_found, p4_panes, p5_found, p5_pairs, p5_metrics, p6_found, p6_grid, p6_trend)}

_COPIES = """
WITH messages AS (
  SELECT message_id, samples, list_sort(list_distinct(list_transform(list_filter(labels, lambda p: p.value IS NOT NULL AND p.value <> ''), lambda p: {'n': p.name, 'v': p.value}))) AS identity
  FROM time_series WHERE labels IS NOT NULL
), elements AS (
  SELECT message_id, identity, unnest(range(len(samples))) AS pos, unnest(samples) AS sample FROM messages
), ranked AS (
  SELECT message_id, CAST(pos AS INTEGER) AS pos, sample.timestamp AS "timestamp", sample.value AS value,
         row_number() OVER (PARTITION BY identity, sample.timestamp ORDER BY message_id, pos) AS rank
  FROM elements WHERE sample.timestamp IS NOT NULL
)"""

_TIMED = """
WITH timed AS (
  SELECT *, timestamp_ms + ((-timestamp_ms % 3600000) + 3600000) % 3600000 AS pane_end_ms
  FROM samples WHERE timestamp_ms IS NOT NULL AND NOT coalesce(timestamp_ms - epoch_us(received_at) // 1000 > 300000, FALSE)
), per_batch AS (
  SELECT batch_id, max(timestamp_ms) AS newest FROM timed WHERE batch_id IS NOT NULL GROUP BY batch_id
), marks AS (
  SELECT batch_id, max(newest) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 7200000 AS watermark_ms FROM per_batch
), routed AS (
  SELECT timed.*, coalesce(pane_end_ms <= watermark_ms, FALSE) AS late FROM timed LEFT JOIN marks USING (batch_id)
)"""

_NUMBER = "(s.value IS NOT NULL AND NOT isnan(s.value))"
_STATES = f"""count(*) AS n_rows, count(*) FILTER ({_NUMBER}) AS n_values, sum(s.value) FILTER ({_NUMBER}) AS total,
  max(struct_pack(t := s.timestamp_ms, a := s.arrival)) FILTER (s.timestamp_ms IS NOT NULL) AS latest,
  arg_max(struct_pack(v := s.value), struct_pack(t := s.timestamp_ms, a := s.arrival)) FILTER (s.timestamp_ms IS NOT NULL) AS latest_of"""
_STATE_COLUMNS = f"n_rows, n_values, {quantised_sql('total')} AS total, latest.t AS latest_ms, latest.a AS latest_arrival, latest_of.v AS latest_value"
_PAIRS = """(SELECT id, unnest(map_entries(labels)) AS p FROM series WHERE labels IS NOT NULL)"""

_PERIODS = """
WITH counting AS (
  SELECT arrival, timestamp_ms, value, list_sort(list_filter(map_entries(labels), lambda p: p.value IS NOT NULL AND p.value <> '')) AS pairs, labels['__name__'] AS metric
  FROM raw_samples WHERE labels IS NOT NULL AND timestamp_ms IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)
), laid AS (
  SELECT array_to_string(list_transform(pairs, lambda p: p.key || '=' || p.value), ';') AS source_key, sample_interval_ms AS w,
         timestamp_ms + ((-timestamp_ms % sample_interval_ms) + sample_interval_ms) % sample_interval_ms AS period_end_ms, arrival, timestamp_ms, value
  FROM counting JOIN workload_sources USING (metric) WHERE sample_interval_ms > 0
), observed AS (SELECT DISTINCT source_key, w, period_end_ms FROM laid),
spans AS (SELECT source_key, w, min(period_end_ms) AS lo, max(period_end_ms) AS hi FROM observed GROUP BY source_key, w),
every AS (SELECT source_key, unnest(range(lo, hi + w, w)) AS period_end_ms FROM spans)"""

def _eliminated(size: int) -> str:
    """CTEs that solve the normal equations of ``sums`` (columns a_i_j for i <= j, and b_i) by elimination, one step each; ``c`` has c_0, c_1, ..."""
    ctes, last = [], "sums"
    for k in range(size):
        get = lambda i, j: f"a_{min(i, j)}_{max(i, j)}"
        rest = range(k + 1, size)
        kept = ["source_key", "tm", "s", *(f"a_{i}_{j}" for i in range(k + 1) for j in range(i, size)), *(f"b_{i}" for i in range(k + 1))]
        changed = [f"{get(i, j)} - {get(k, i)} * {get(k, j)} / {get(k, k)} AS {get(i, j)}" for i in rest for j in range(i, size)] + [f"b_{i} - {get(k, i)} * b_{k} / {get(k, k)} AS b_{i}" for i in rest]
        ctes.append(f"e{k} AS (SELECT {', '.join(kept + changed)} FROM {last})")
        last = f"e{k}"
    for k in reversed(range(size)):
        known = "".join(f" - a_{k}_{j} * c_{j}" for j in range(k + 1, size))
        ctes.append(f"s{k} AS (SELECT *, (b_{k}{known}) / a_{k}_{k} AS c_{k} FROM {last})")
        last = f"s{k}"
    return ", ".join(ctes) + f", c AS (SELECT * FROM {last})"


def _season(t: str, names: tuple[str, ...] = ("tm", "s")) -> list[str]:
    """Level, trend around the source's mean in its own spread, and harmonics at ``t``."""
    turn = f"CAST(({t} % 86400000 + 86400000) % 86400000 AS DOUBLE) * CAST({2 * math.pi / 86_400_000!r} AS DOUBLE)"
    waves = [f"{f}({turn} * {k})" for k in range(1, grid.HARMONICS + 1) for f in ("sin", "cos")]
    return ["CAST(1 AS DOUBLE)", f"CASE WHEN {names[1]} > 0 THEN ({t} - {names[0]}) / {names[1]} ELSE 0 END", *waves]


_SIZE = 2 + 2 * grid.HARMONICS
_FITTED = lambda t: "(" + " + ".join(f"c_{i} * ({x})" for i, x in enumerate(_season(t))) + ")"
_GRID = (
    """, valued AS (
  SELECT source_key, w, period_end_ms, arg_max(value, struct_pack(t := timestamp_ms, a := arrival)) AS value FROM laid GROUP BY source_key, w, period_end_ms
), usable AS (SELECT * FROM valued WHERE NOT isinf(value)
), centred AS (
  SELECT *, avg(period_end_ms) OVER p AS tm, stddev_pop(CAST(period_end_ms AS DOUBLE)) OVER p AS s FROM usable WINDOW p AS (PARTITION BY source_key)
), base AS (SELECT source_key, tm, s, value AS y, """
    + ", ".join(f"{x} AS x{i}" for i, x in enumerate(_season("period_end_ms")))
    + """ FROM centred
), sums AS (SELECT source_key, tm, s, """
    + ", ".join([f"sum(x{i} * x{j})" + (f" + CAST({grid.RIDGE!r} AS DOUBLE) * count(*)" if i == j and i else "") + f" AS a_{i}_{j}" for i in range(_SIZE) for j in range(i, _SIZE)] + [f"sum(x{i} * y) AS b_{i}" for i in range(_SIZE)])
    + f""" FROM base GROUP BY source_key, tm, s
), {_eliminated(_SIZE)}, ends AS (
  SELECT source_key, w, lag(period_end_ms) OVER o AS t0, lag(value) OVER o AS v0, period_end_ms AS t1, value AS v1 FROM valued WINDOW o AS (PARTITION BY source_key, w ORDER BY period_end_ms)
), missed AS (
  SELECT ends.*, unnest(range(t0 + w, t1, w)) AS t FROM ends WHERE t1 - t0 > w
), fits AS (
  SELECT missed.*, coalesce({_FITTED('t')}, 0) AS fit, CASE WHEN NOT isinf(v0) THEN v0 - {_FITTED('t0')} END AS r0, CASE WHEN NOT isinf(v1) THEN v1 - {_FITTED('t1')} END AS r1 FROM missed LEFT JOIN c USING (source_key)
), filled AS (
  SELECT source_key, period_end_ms, value, FALSE AS missing FROM valued
  UNION ALL SELECT source_key, t, fit + coalesce(r0, r1, 0) + (coalesce(r1, r0, 0) - coalesce(r0, r1, 0)) * ((t - t0) / CAST(t1 - t0 AS DOUBLE)), TRUE FROM fits
) SELECT source_key, period_end_ms, missing, {quantised_sql('value', GRID_DIGITS)} AS value FROM filled"""
)

ORACLES = {
    "p2_found": _COPIES + " SELECT message_id, pos FROM ranked WHERE rank > 1",
    "p2_kept": _COPIES + ' SELECT message_id, pos, "timestamp", value FROM ranked WHERE rank = 1',
    "p4_found": _TIMED + " SELECT arrival FROM routed WHERE late",
    "p4_panes": _TIMED + f""", panes AS (
  SELECT coalesce(metric, '') AS metric, pane_end_ms, count(*) FILTER ({_NUMBER}) AS n, sum(s.value) FILTER ({_NUMBER}) AS total
  FROM routed s LEFT JOIN series ON s.series_id = series.id WHERE NOT late GROUP BY 1, 2
) SELECT metric, pane_end_ms, n, {quantised_sql('total')} AS total FROM panes""",
    "p5_found": f"SELECT p.key AS name, p.value AS value FROM samples s JOIN {_PAIRS} l ON s.series_id = l.id WHERE p.value <> '' GROUP BY 1, 2 HAVING count(*) * 100 >= 5 * (SELECT count(*) FROM samples)",
    "p5_pairs": f"WITH g AS (SELECT p.key AS name, p.value AS value, {_STATES} FROM samples s JOIN {_PAIRS} l ON s.series_id = l.id WHERE p.value <> '' GROUP BY 1, 2) SELECT name, value, {_STATE_COLUMNS} FROM g",
    "p5_metrics": f"WITH g AS (SELECT coalesce(metric, '') AS metric, {_STATES} FROM samples s JOIN series ON s.series_id = series.id GROUP BY 1) SELECT metric, {_STATE_COLUMNS} FROM g",
    "p6_grid": _PERIODS + _GRID,
    "p6_trend": _PERIODS + f""", valued AS (SELECT source_key, period_end_ms, arg_max(value, struct_pack(t := timestamp_ms, a := arrival)) AS value FROM laid GROUP BY source_key, period_end_ms),
  g AS (SELECT source_key, count(*) AS n, coalesce(regr_slope(value, (period_end_ms - 1772409600000) / CAST(86400000 AS DOUBLE)), 0) AS growth FROM valued WHERE NOT isinf(value) GROUP BY source_key HAVING count(*) > 1)
  SELECT source_key, n, {_GROWTH} AS growth FROM g""",
    "p6_found": _PERIODS + " SELECT source_key, period_end_ms FROM every EXCEPT SELECT source_key, period_end_ms FROM observed",
}
