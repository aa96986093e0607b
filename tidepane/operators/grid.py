"""Irregular readings onto a regular grid, gaps filled by a seasonal regression bridged to its endpoints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepane.functions.labels import METRIC_LABEL, label, source_key
from tidepane.functions.timeline import pane_end
from tidepane.operators.partitioned import finite, is_number, skew_safe_join
from tidepane.session import written

DAY_MS = 86_400_000
#: Sine and cosine pairs of the daily season.
HARMONICS = 2
#: Added to the diagonal of the normal equations (per reading, not for the level), so a source with few readings has a solution.
RIDGE = 1e-6
#: Periods of one source are handled in blocks of this many, so a long or busy source is many groups.
BLOCK = 4096


def periods(raw_samples: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per source and period with a counting reading.

    Columns ``source_key``, ``width_ms``, ``period_end_ms``, ``value``, ``n``.
    A reading counts if labels, timestamp_ms and value are not null and the
    value is not NaN, and if its ``__name__`` is a metric of ``sources`` with a
    positive interval; infinities count. The value of a period is that of its
    newest reading, by (timestamp_ms, arrival). ``sources`` with a metric twice
    use the smallest interval; null metrics and intervals are left out.
    """
    widths = sources.where(F.col("metric").isNotNull() & (F.col("sample_interval_ms") > 0)).groupBy("metric").agg(F.min("sample_interval_ms").alias("width_ms"))
    counting = raw_samples.where(F.col("labels").isNotNull() & F.col("timestamp_ms").isNotNull() & is_number(F.col("value")))
    read = counting.select(label("labels", METRIC_LABEL).alias("metric"), source_key("labels").alias("source_key"), "timestamp_ms", "arrival", "value")
    # One row per metric; its size is left to the planner, which broadcasts below its threshold.
    laid = read.join(widths, "metric").select("source_key", "width_ms", pane_end("timestamp_ms", F.col("width_ms")).alias("period_end_ms"), "timestamp_ms", "arrival", "value")
    newest = F.max(F.struct("timestamp_ms", "arrival", "value"))
    return laid.groupBy("source_key", "width_ms", "period_end_ms").agg(newest.alias("last"), F.count(F.lit(1)).alias("n")).select("source_key", "width_ms", "period_end_ms", F.col("last.value").alias("value"), "n")


def _basis(t_ms: Column, harmonics: int, origin_ms: int) -> list[Column]:
    """Level, trend (in days from the origin) and daily harmonics at a time."""
    angle = F.pmod(t_ms, F.lit(DAY_MS)) * F.lit(2 * np.pi / DAY_MS)
    waves = [f(angle * F.lit(float(k))) for k in range(1, harmonics + 1) for f in (F.sin, F.cos)]
    return [F.lit(1.0), (t_ms - F.lit(origin_ms)) / F.lit(float(DAY_MS)), *waves]


def origin_of(observed: DataFrame) -> int:
    """The middle of all observed periods, from which the trend is measured; any other gives the same fit but for rounding."""
    span = observed.agg(F.avg("period_end_ms").alias("t")).first()["t"]
    return 0 if span is None else int(span)


def solved(xx: np.ndarray, xy: np.ndarray, ridge: float) -> np.ndarray:
    """Coefficients of many normal equations at once.

    The trend of each source is first moved to the source's own mean and scaled
    to its own spread, so a fit does not depend on where in time the source lies,
    and the ridge, which leaves out the level, weighs the same on all columns.
    """
    n, size = np.maximum(xx[:, 0, 0], 1.0), xx.shape[1]
    mean = xx[:, 0, 1] / n
    spread = np.sqrt(np.maximum(xx[:, 1, 1] / n - mean**2, 0.0))
    spread[spread < 1e-9 * (1 + np.abs(mean))] = 0.0
    to = np.tile(np.eye(size), (len(xx), 1, 1))
    to[:, 1, 1] = np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 0)
    to[:, 0, 1] = -mean * to[:, 1, 1]
    back = to.transpose(0, 2, 1)
    a, b = back @ xx @ to, back @ xy[:, :, None]
    a[:, range(1, size), range(1, size)] += (ridge * n)[:, None]
    with np.errstate(all="ignore"):
        try:
            found = np.linalg.solve(a, b)
        except np.linalg.LinAlgError:
            found = np.linalg.pinv(np.nan_to_num(a), hermitian=True) @ b
    return np.nan_to_num((to @ found)[:, :, 0], nan=0.0, posinf=0.0, neginf=0.0)


def season_fit(observed: DataFrame, origin_ms: int, harmonics: int = HARMONICS, ridge: float = RIDGE) -> DataFrame:
    """Regression coefficients per source: ``source_key``, ``n`` (its periods), ``coef`` array<double>.

    The normal equations are sums, so each task adds up its rows and only one
    small state per source and task is shuffled, however many readings a source
    has. The systems are then solved batch-wise, all sources of an Arrow batch
    at once. Infinite values stay out of the fit; a source without finite
    values gets coefficients 0.
    """
    size = 2 + 2 * harmonics
    usable = observed.withColumn("y", F.when(finite(F.col("value")), F.col("value")))
    x = [F.when(F.col("y").isNotNull(), c) for c in _basis(F.col("period_end_ms"), harmonics, origin_ms)]
    laid = usable.select("source_key", "y", *[c.alias(f"x{i}") for i, c in enumerate(x)])
    upper = [(i, j) for i in range(size) for j in range(i, size)]
    products = [F.coalesce(F.sum(F.col(f"x{i}") * F.col(f"x{j}")), F.lit(0.0)) for i, j in upper]
    moments = [F.coalesce(F.sum(F.col(f"x{i}") * F.col("y")), F.lit(0.0)) for i in range(size)]
    sums = laid.groupBy("source_key").agg(F.count(F.lit(1)).alias("n"), F.array(*products).alias("xx"), F.array(*moments).alias("xy"))

    def solve(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        rows, cols = (np.array(k) for k in zip(*upper, strict=True))
        for xx, xy in batches:
            if not len(xx):
                yield pd.Series([], dtype=object)
                continue
            a, flat = np.zeros((len(xx), size, size)), np.stack(xx.to_numpy())
            a[:, rows, cols] = flat
            a[:, cols, rows] = flat
            yield pd.Series(list(solved(a, np.stack(xy.to_numpy()), ridge)))

    return sums.select("source_key", "n", F.pandas_udf(solve, "array<double>")("xx", "xy").alias("coef"))


def gaps(observed: DataFrame, block: int = BLOCK) -> DataFrame:
    """Neighbouring observed periods of a source with missing ones between them.

    Columns ``source_key``, ``width_ms``, ``left_ms``, ``left_value``,
    ``right_ms``, ``right_value``. Neighbours are looked up inside blocks of
    ``block`` periods, then across the blocks of a source by their first and
    last period, so a source with very many periods is no single group.
    """
    number = F.floor(F.col("period_end_ms") / F.col("width_ms") / F.lit(block))
    blocked = observed.withColumn("block", number).withColumn("here", F.struct("period_end_ms", "value"))
    inside = blocked.withColumn("prior", F.lag("here").over(Window.partitionBy("source_key", "block").orderBy("period_end_ms")))
    edges = blocked.groupBy("source_key", "width_ms", "block").agg(F.min("here").alias("here"), F.max("here").alias("tail"))
    across = edges.withColumn("prior", F.lag("tail").over(Window.partitionBy("source_key").orderBy("block")))
    both = inside.select("source_key", "width_ms", "prior", "here").unionByName(across.select("source_key", "width_ms", "prior", "here"))
    wide = F.col("here.period_end_ms") - F.col("prior.period_end_ms") > F.col("width_ms")
    return both.where(wide).select("source_key", "width_ms", F.col("prior.period_end_ms").alias("left_ms"), F.col("prior.value").alias("left_value"), F.col("here.period_end_ms").alias("right_ms"), F.col("here.value").alias("right_value"))


def missing_periods(gap: DataFrame, step: int = BLOCK) -> DataFrame:
    """A row per missing period. A long gap is first cut into stretches of ``step`` periods, so no row holds a huge array."""
    count = F.call_function("div", F.col("right_ms") - F.col("left_ms"), F.col("width_ms")) - 1
    stretch = gap.withColumn("count", count).withColumn("from", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("count"), F.lit(step).cast("bigint"))))
    last = F.least(F.col("from") + F.lit(step - 1), F.col("count"))
    laid = stretch.withColumn("k", F.explode(F.sequence(F.col("from"), last)))
    return laid.withColumn("period_end_ms", F.col("left_ms") + F.col("k") * F.col("width_ms")).drop("from", "k", "count")


def regular_grid(raw_samples: DataFrame, sources: DataFrame, harmonics: int = HARMONICS, block: int = BLOCK) -> DataFrame:
    """One row per source and period between its first and last reading.

    Columns ``source_key``, ``period_end_ms``, ``value``, ``missing``. Observed
    periods keep their newest reading. A missing one gets the prediction of the
    source's seasonal regression plus the residual of the line between the
    residuals at the two observed ends of its gap, so the filled curve meets
    both ends. Where an end is infinite it has no residual and the other end's
    is carried over; where both are, the prediction stands alone. Empty tables
    and sources without a period give no rows.
    """
    observed = written(periods(raw_samples, sources), "periods")
    origin_ms = origin_of(observed)
    coefs = written(season_fit(observed, origin_ms, harmonics), "season")
    gap = skew_safe_join(gaps(observed, block), coefs, "source_key", "n", total=observed.count())
    laid = missing_periods(gap, block)

    def fitted(t: str) -> Column:
        terms = [F.element_at("coef", i + 1) * c for i, c in enumerate(_basis(F.col(t), harmonics, origin_ms))]
        out = terms[0]
        for term in terms[1:]:
            out = out + term
        return out

    ends = laid.withColumn("r0", F.when(finite(F.col("left_value")), F.col("left_value") - fitted("left_ms"))).withColumn("r1", F.when(finite(F.col("right_value")), F.col("right_value") - fitted("right_ms")))
    share = (F.col("period_end_ms") - F.col("left_ms")) / (F.col("right_ms") - F.col("left_ms"))
    r0, r1 = F.coalesce("r0", "r1", F.lit(0.0)), F.coalesce("r1", "r0", F.lit(0.0))
    filled = ends.select("source_key", "period_end_ms", (fitted("period_end_ms") + r0 + (r1 - r0) * share).alias("value"), F.lit(True).alias("missing"))
    return observed.select("source_key", "period_end_ms", "value", F.lit(False).alias("missing")).unionByName(filled)
