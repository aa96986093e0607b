"""Building blocks that keep work even: ordered partitions, prefix states, joins that split heavy keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepane.session import written

#: A key is heavy from this share of the rows on; so there are at most 1 / HEAVY_SHARE heavy keys.
HEAVY_SHARE = 0.001
#: A sorted partition should hold about this many bytes; files grow by the factor when they are read.
PARTITION_BYTES, EXPANSION = 256 << 20, 4
#: More tasks than these cost more than larger partitions, which then spill.
MAX_PARTITIONS = 400_000
#: Parts into which the rows of a heavy key are dealt.
SALTS = 64
#: Spark's estimate for what it knows nothing about is larger than this.
UNKNOWN_BYTES = 1 << 60


def scanned_bytes(df: DataFrame) -> int:
    """Bytes of the files a plan reads; leaves of unknown size (local rows) count as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length()))
    return sum(x for x in sizes if x < UNKNOWN_BYTES)


def session_partitions(df: DataFrame) -> int:
    """Partitions for what has been reduced before: the session's shuffle partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def partition_count(df: DataFrame) -> int:
    """Partitions for a sort of about all rows ``df`` reads: the session's shuffle partitions, more where its files are large."""
    wanted = -(-scanned_bytes(df) * EXPANSION // PARTITION_BYTES)
    return max(session_partitions(df), min(wanted, MAX_PARTITIONS))


def range_partitioned(df: DataFrame, order: Sequence[str], name: str, pid: str = "pid") -> DataFrame:
    """``df`` range partitioned and sorted by ``order``, written with its partition number ``pid``.

    Spark samples the quantiles of the composite key, so a key with many rows
    takes several partitions as far as the later columns of ``order`` tell its
    rows apart. Writing pins the partition numbers for every later read.
    """
    laid = df.repartitionByRange(session_partitions(df), *order).sortWithinPartitions(*order)
    return written(laid.withColumn(pid, F.spark_partition_id()), name)


def before(partials: DataFrame, value: str, how: str, keys: Sequence[str] = (), pid: str = "pid", out: str = "carried") -> DataFrame:
    """State of all earlier partitions per key, from one partial state per key and partition.

    ``how`` is ``sum``, ``min`` or ``max``. A key has at most as many partials as there
    are partitions, so no window here is larger than that.
    """
    w = Window.partitionBy(*keys).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    state = getattr(F, how)(F.col(value)).over(w)
    return partials.withColumn(out, F.coalesce(state, F.lit(0)) if how == "sum" else state)


def heavy_keys(counts: DataFrame, n: str, share: float = HEAVY_SHARE, total: int | None = None) -> DataFrame:
    """Rows of ``counts`` (one per key) whose ``n`` is at least ``share`` of the total: at most 1 / share rows."""
    if total is None:
        total = counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("t")).first()["t"]
    return counts.where(F.col(n) >= max(1.0, share * total))


def skew_safe_join(left: DataFrame, right: DataFrame, key: str, n: str, share: float = HEAVY_SHARE, total: int | None = None, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join rows of ``left`` to the one row of ``right`` with their ``key``, however uneven the keys.

    ``right`` has one row per key and in ``n`` the number of its rows in ``left``;
    it is read twice, so it should be a written table. ``left`` is read once: the
    rows of a heavy key, and those with a null key, are dealt to ``salts`` parts
    by the task that holds them, and the one row of a heavy key goes to all
    parts. Only the heavy keys themselves, at most 1 / share, reach the driver.
    The plan is the same whether there are any. Left rows with a null key find
    no partner. ``how`` is ``inner`` or ``left``.
    """
    found = [r[key] for r in heavy_keys(right, n, share, total).where(F.col(key).isNotNull()).select(key).collect()]
    heavy = F.coalesce(F.col(key).isin(found), F.lit(True)) if found else F.col(key).isNull()
    # The partition of a row is the same when a task is repeated, so the salt is too.
    dealt = left.withColumn("__salt", F.when(heavy, F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(F.lit(0)))
    copies = F.when(heavy, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(right.where(F.col(key).isNotNull()).withColumn("__salt", F.explode(copies)), [key, "__salt"], how).drop("__salt")


def finite(x: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def is_number(x: Column) -> Column:
    """Neither null nor NaN."""
    return x.isNotNull() & ~F.isnan(x)
