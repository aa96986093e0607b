"""Instant queries answered from raw samples: what every plan is measured against."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidepane.functions.timeline import INT64_MAX, INT64_MIN
from tidepane.operators.states import family_of
from tidepane.operators.vector import aggregated, labelled, ranked
from tidepane.operators.windows import LOOKBACK_MS, instant_vector, range_window
from tidepane.plans.promql import Aggregate, Expression, RangeCall, Ranking, Selector, leaf, parse
from tidepane.sources.samples import Source


class Unsupported(ValueError):
    """The expression cannot be evaluated."""


def shifted(time_ms: int, offset_ms: int) -> int:
    end = time_ms - offset_ms
    if not INT64_MIN <= end <= INT64_MAX:
        raise Unsupported("the offset leaves the range of times")
    return end


def window_of(query: str | Expression, time_ms: int, lookback_ms: int = LOOKBACK_MS) -> tuple[int, int]:
    """``(after, until]`` of the samples a query reads at ``time_ms``."""
    e = leaf(parse(query) if isinstance(query, str) else query)
    selector = e.selector if isinstance(e, RangeCall) else e
    end = shifted(time_ms, selector.offset_ms)
    return shifted(end, selector.range_ms or lookback_ms), end


def apply_outer(e: Expression, inner: DataFrame) -> DataFrame:
    """The aggregations and rankings of ``e`` over the vector of its leaf."""
    if isinstance(e, Aggregate):
        return aggregated(apply_outer(e.argument, inner), e.op, e.grouping)
    if isinstance(e, Ranking):
        return ranked(apply_outer(e.argument, inner), e.op, e.k, e.grouping)
    return inner


def leaf_vector(e: Selector | RangeCall, samples: DataFrame | Source, time_ms: int, lookback_ms: int = LOOKBACK_MS) -> DataFrame:
    if isinstance(e, Selector):
        return labelled(instant_vector(samples, e, shifted(time_ms, e.offset_ms), lookback_ms), keep_name=True)
    end = shifted(time_ms, e.selector.offset_ms)
    family = family_of(e.function)
    states = family.build(range_window(samples, e.selector, end))
    values = family.estimate(states, end - e.selector.range_ms, end, e.function, e.q)
    return labelled(values, keep_name=e.function == "last_over_time")


def evaluate(query: str | Expression, samples: DataFrame | Source, time_ms: int, lookback_ms: int = LOOKBACK_MS) -> DataFrame:
    """The instant vector of a query at ``time_ms``: ``series``, ``labels``, ``value``."""
    e = parse(query) if isinstance(query, str) else query
    return apply_outer(e, leaf_vector(leaf(e), samples, time_ms, lookback_ms))
