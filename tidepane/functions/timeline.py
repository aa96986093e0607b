"""Arithmetic on panes: tumbling, left-open, on a grid anchored at 0."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

INT64_MIN, INT64_MAX = -(2**63), 2**63 - 1


def pane_end(ts: Column | str, width_ms: Column | int) -> Column:
    """End of the pane ``(end - width, end]`` that holds ``ts``; null near the ends of the 64-bit range."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    width = F.lit(width_ms) if isinstance(width_ms, int) else width_ms
    safe = ts.between(F.lit(INT64_MIN) + width, F.lit(INT64_MAX) - width)
    return F.when(safe, ts + F.pmod(-F.when(safe, ts), width))


def pane_end_of(ts: int, width_ms: int) -> int | None:
    """The same for one value on the driver."""
    end = ts + (-ts) % width_ms
    return end if INT64_MIN + width_ms <= ts <= INT64_MAX - width_ms else None


def closed_end(watermark_ms: int, width_ms: int) -> int:
    """End of the newest pane that a watermark closes."""
    return watermark_ms - watermark_ms % width_ms


def clamp(x: int) -> int:
    """Saturating 64-bit arithmetic for values computed on the driver."""
    return max(INT64_MIN, min(INT64_MAX, x))


def within_ms(ts: Column | str, after_ms: int, until_ms: int) -> Column:
    """Whether a timestamp_ntz, rounded down to ms, lies in ``(after, until]``; a plain comparison, so scans can skip by it."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    start, end = (F.lit(str(datetime(1970, 1, 1) + timedelta(milliseconds=x + 1))).cast("timestamp_ntz") for x in (after_ms, until_ms))
    return (ts >= start) & (ts < end)


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds since 1970 of a timestamp_ntz, rounded down, whatever the session's time zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))
    whole = micros - F.pmod(micros, F.lit(1000))
    return F.call_function("div", whole, F.lit(1000).cast("bigint"))
