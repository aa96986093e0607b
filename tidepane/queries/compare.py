"""Values that two engines must agree on although they add up in different orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantised_sql(x: str, digits: int = 9) -> str:
    """SQL, the same for both engines, that cuts a double to ``digits`` significant digits.

    The cut lies at an odd fraction of a step, where sums of short decimals
    never fall, so values that differ in their last bits come out equal.
    Null, NaN, infinities and 0 stay; -0 becomes 0.
    """
    e = f"CAST(floor(log10(abs({x}))) AS INTEGER) - {digits - 1}"
    up, down = f"pow(CAST(10 AS DOUBLE), {e})", f"pow(CAST(10 AS DOUBLE), -({e}))"
    return (
        f"CASE WHEN {x} IS NULL OR isnan({x}) OR abs({x}) = CAST('Infinity' AS DOUBLE) THEN {x} WHEN {x} = 0 THEN CAST(0 AS DOUBLE) "
        f"WHEN {e} >= 0 THEN floor({x} / {up} + CAST(0.3713 AS DOUBLE)) * {up} ELSE floor({x} * {down} + CAST(0.3713 AS DOUBLE)) / {down} END"
    )


def quantised(name: str, digits: int = 9) -> Column:
    return F.expr(quantised_sql(name, digits)).alias(name)
