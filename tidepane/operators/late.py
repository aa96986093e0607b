"""Per-pane aggregates by event time that late rows correct until a cut-off."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepane.functions.timeline import epoch_ms, pane_end
from tidepane.operators.partitioned import before, is_number, range_partitioned, skew_safe_join
from tidepane.session import written
from tidepane.sources.files import Files

COLUMNS = ("arrival", "batch_id", "received_at", "series_id", "timestamp_ms", "value")
HOUR_MS = 3_600_000
CUT_OFF_MS = 7_200_000
FUTURE_MS = 300_000
DAY_MS = 86_400_000
#: Panes (rows of 24 bytes) up to which the table of closing batches is broadcast: 114 years of hours.
BROADCAST_PANES = 1_000_000
#: Folders of retained rows of one period that are made one.
COMPACT_FOLDERS = 16


@dataclass(frozen=True)
class LatePolicy:
    """Pane width, lateness that is still corrected, and how far ahead of its receipt a row may be."""

    pane_ms: int = HOUR_MS
    cut_off_ms: int = CUT_OFF_MS
    future_ms: int = FUTURE_MS


def timed_rows(samples: DataFrame, policy: LatePolicy) -> DataFrame:
    """Rows with an event time that is not from the future, with the ``pane_end_ms`` each belongs to.

    A null ``timestamp_ms`` has no pane and is left out. A row with null
    ``received_at`` cannot be compared with its receipt and counts as not from
    the future. Other columns of the input are ignored.
    """
    samples = samples.select(*COLUMNS)
    ahead = F.col("timestamp_ms") - epoch_ms("received_at") > F.lit(policy.future_ms)
    kept = samples.where(F.col("timestamp_ms").isNotNull() & ~F.coalesce(ahead, F.lit(False)))
    return kept.withColumn("pane_end_ms", pane_end("timestamp_ms", policy.pane_ms))


def batch_panes(samples: DataFrame, policy: LatePolicy) -> DataFrame:
    """One row per batch and pane: its newest event time and number of rows. What routing needs, from one pass over the rows."""
    rows = timed_rows(samples, policy).groupBy("batch_id", "pane_end_ms").agg(F.max("timestamp_ms").alias("newest"), F.count(F.lit(1)).alias("n"))
    return written(rows, "batch-panes")


def batch_watermarks(seen: DataFrame, policy: LatePolicy, newest_ms: int | None = None) -> DataFrame:
    """One row per batch of :func:`batch_panes`: ``watermark_ms`` in force when it arrives.

    The watermark is the newest event time of all earlier batches (and
    ``newest_ms``, that of batches seen before this call) minus the cut-off;
    null for the first. Batches are range partitioned by number; the running
    maximum runs inside each partition and takes up the maximum of the
    partitions before it, so no task sees all batches. Rows with a null
    ``batch_id`` belong to no batch.
    """
    per_batch = seen.where(F.col("batch_id").isNotNull()).groupBy("batch_id").agg(F.max("newest").alias("newest"))
    laid = range_partitioned(per_batch, ["batch_id"], "batches")
    carried = before(laid.groupBy("pid").agg(F.max("newest").alias("newest")), "newest", "max").select("pid", "carried")
    inside = F.max("newest").over(Window.partitionBy("pid").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1))
    # One row per partition: as many as there are shuffle partitions, whatever the data.
    reached = F.greatest(inside, F.col("carried"), F.lit(newest_ms).cast("bigint"))
    return laid.join(F.broadcast(carried), "pid").select("batch_id", (reached - F.lit(policy.cut_off_ms)).alias("watermark_ms"), "newest")


def closing_batches(seen: DataFrame, policy: LatePolicy, newest_ms: int | None = None) -> DataFrame:
    """One row per pane that has rows: ``closed_by``, the first batch whose watermark had passed it (null: none), and ``n``, its rows.

    The watermark never falls from batch to batch, so a row is late if its batch
    is that one or a later one. There are as many panes as the data's time has,
    however many rows and batches there are.
    """
    marks = batch_watermarks(seen, policy, newest_ms).where(F.col("watermark_ms").isNotNull())
    closed = F.col("watermark_ms") - F.pmod("watermark_ms", F.lit(policy.pane_ms))
    steps = marks.groupBy(closed.alias("at")).agg(F.min("batch_id").alias("first")).select("at", "first", F.lit(None).cast("bigint").alias("n"))
    panes = seen.where(F.col("pane_end_ms").isNotNull()).groupBy(F.col("pane_end_ms").alias("at")).agg(F.sum("n").alias("n")).select("at", F.lit(None).cast("bigint").alias("first"), "n")
    # From the latest time back; at the same time the watermark comes first, as it closes the pane that ends there.
    order = ["back", "is_pane"]
    both = steps.unionByName(panes).withColumn("back", -F.col("at")).withColumn("is_pane", F.col("n").isNotNull())
    laid = range_partitioned(both, order, "closing")
    carried = before(laid.groupBy("pid").agg(F.min("first").alias("first")), "first", "min").select("pid", "carried")
    inside = F.min("first").over(Window.partitionBy("pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # One row per partition.
    found = laid.join(F.broadcast(carried), "pid").select(F.col("at").alias("pane_end_ms"), F.least(inside, F.col("carried")).alias("closed_by"), "n")
    return written(found.where(F.col("n").isNotNull()), "closed")


def routed(samples: DataFrame, policy: LatePolicy = LatePolicy(), newest_ms: int | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Timed rows with ``pane_end_ms`` and ``late``: their pane ended at or before the watermark of their batch.

    Late rows are behind the cut-off; all others correct their pane. A row
    without a batch is late if the batches before this call had closed its pane,
    and one without a pane (a time near the ends of the 64-bit range) never. The
    rows stay where they are read: they are compared with a table of panes.
    ``seen`` is :func:`batch_panes` of the samples, if it is at hand.
    """
    closing = closing_batches(batch_panes(samples, policy) if seen is None else seen, policy, newest_ms)
    rows = timed_rows(samples, policy)
    if closing.count() <= BROADCAST_PANES:
        joined = rows.join(F.broadcast(closing.drop("n")), "pane_end_ms", "left")
    else:
        joined = skew_safe_join(rows, closing, "pane_end_ms", "n", how="left").drop("n")
    before_all = F.lit(None if newest_ms is None else newest_ms - policy.cut_off_ms).cast("bigint")
    late = F.when(F.col("batch_id").isNull(), F.col("pane_end_ms") <= before_all).otherwise(F.col("batch_id") >= F.col("closed_by"))
    return joined.withColumn("late", F.coalesce(late, F.lit(False))).drop("closed_by")


def pane_states(rows: DataFrame) -> DataFrame:
    """Count and sum per series and pane: the partial state, before the series is looked up."""
    number = is_number(F.col("value"))
    return rows.groupBy("series_id", "pane_end_ms").agg(F.count(F.when(number, 1)).alias("n"), F.sum(F.when(number, F.col("value"))).alias("total"))


def pane_results(rows: DataFrame, series: DataFrame) -> DataFrame:
    """``n`` and ``total`` of the values (neither null nor NaN) per metric and pane.

    Rows are first reduced to one state per series and pane, so the join with
    ``series`` meets no heavy key. Rows of no known series and of series
    without metric count under the metric ``''``. A pane whose rows all lack a
    value has n = 0 and a null total.
    """
    known = series.where(F.col("id").isNotNull()).select(F.col("id").alias("series_id"), "metric").groupBy("series_id").agg(F.max("metric").alias("metric"))
    states = pane_states(rows).join(known, "series_id", "left")
    return states.groupBy(F.coalesce("metric", F.lit("")).alias("metric"), "pane_end_ms").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@dataclass
class PaneTable:
    """Pane results kept in a folder and corrected by later batches.

    Retained raw rows and results lie in partitions of ``partition_ms`` of event
    time. ``ingest`` routes a delivery, appends its rows that are not late to the
    raw partitions they belong to, recomputes those partitions entirely from
    their retained rows, and nothing else is read. A commit is one small file
    made by rename: it says which folder holds the results of each partition, so
    readers see a delivery's partitions all or not at all, and an ingest that
    died half-way leaves nothing visible. Raw partitions whose panes are all
    behind the cut-off can not change any more: their rows are deleted. Folders
    a commit replaced are deleted with the next one, so readers have time.
    """

    spark: SparkSession
    path: str
    series: DataFrame
    policy: LatePolicy = field(default_factory=LatePolicy)
    partition_ms: int = DAY_MS

    def __post_init__(self) -> None:
        """Take up what earlier deliveries committed to the folder."""
        if self.partition_ms % self.policy.pane_ms:
            raise ValueError("a partition holds whole panes")
        self.files = Files(self.spark)
        #: Number of the last commit.
        self.version = max((int(n) for n in self.files.names(f"{self.path}/commits") if n.isdigit()), default=-1)
        state = json.loads(self.files.read(f"{self.path}/commits/{self.version}")) if self.version >= 0 else {}
        self.newest_ms: int | None = state.get("newest_ms")
        self.last_delivery: int | None = state.get("delivery")
        #: Folder of each partition's results, and folders of the retained rows of each open one.
        self.results: dict[int, str] = {int(k): v for k, v in state.get("results", {}).items()}
        self.retained: dict[int, list[str]] = {int(k): v for k, v in state.get("retained", {}).items()}
        self.garbage: list[str] = state.get("garbage", [])

    def _part(self) -> Column:
        """Number of the partition that holds a pane; it has the panes that end in (part, part + 1] times its width."""
        return F.floor((F.col("pane_end_ms") - 1) / F.lit(self.partition_ms)).cast("bigint")

    def _store(self, rows: DataFrame, folder: str) -> list[int]:
        """Write rows (with ``part``) partitioned and sorted by time, so a busy partition is many tasks; returns the partitions."""
        target = f"{self.path}/{folder}"
        rows.repartitionByRange("pane_end_ms", *([c] if (c := "timestamp_ms") in rows.columns else ["metric"])).write.mode("overwrite").partitionBy("part").parquet(target)
        return sorted(int(n.split("=")[1]) for n in self.files.names(target) if n.startswith("part="))

    def _rows_of(self, parts: Iterable[int], folders: dict[int, list[str]], schema: str) -> DataFrame:
        """Retained rows of some partitions; only folders that have rows of them are opened, and of these only their partitions."""
        parts = list(parts)
        held = sorted({f"{self.path}/{f}" for p in parts for f in folders[p]})
        return self.spark.read.schema(schema + ", part bigint").option("basePath", self.path).parquet(*held).where(F.col("part").isin(parts))

    def ingest(self, delivery: DataFrame, delivery_id: int | None = None) -> DataFrame:
        """Take in one delivery (one or more batches) and return its late rows.

        Delivery numbers rise: one at or below the last committed one does
        nothing and has no late rows, so a stream may repeat its micro-batches.
        """
        if delivery_id is not None and self.last_delivery is not None and delivery_id <= self.last_delivery:
            return routed(delivery.limit(0), self.policy)
        version = self.version + 1
        seen = batch_panes(delivery, self.policy)
        rows = routed(delivery, self.policy, self.newest_ms, seen)
        schema = "series_id bigint, timestamp_ms bigint, value double, pane_end_ms bigint"
        kept = rows.where(~F.col("late") & F.col("pane_end_ms").isNotNull()).select("series_id", "timestamp_ms", "value", "pane_end_ms", self._part().alias("part"))
        touched = self._store(kept, f"raw/version={version}")
        retained = {p: [*self.retained.get(p, []), f"raw/version={version}"] for p in touched}
        crowded = [p for p in touched if len(retained[p]) > COMPACT_FOLDERS]
        garbage: list[str] = []
        if crowded:
            self._store(self._rows_of(crowded, retained, schema), f"compact/version={version}")
            garbage += [f"{f}/part={p}" for p in crowded for f in retained[p]]
            retained |= dict.fromkeys(crowded, [f"compact/version={version}"])
        results = {}
        if touched:
            again = self._rows_of(touched, retained, schema)
            self._store(pane_results(again, self.series).withColumn("part", self._part()), f"panes/version={version}")
            results = dict.fromkeys(touched, f"panes/version={version}")
        reached = seen.agg(F.max("newest").alias("m")).first()["m"]
        newest = max((x for x in (self.newest_ms, reached) if x is not None), default=None)
        after = self.retained | retained
        final = [p for p in after if newest is not None and (p + 1) * self.partition_ms <= newest - self.policy.cut_off_ms]
        garbage += [f"{f}/part={p}" for p in final for f in after[p]]
        garbage += [f"{self.results[p]}/part={p}" for p in touched if p in self.results]
        after = {p: f for p, f in after.items() if p not in final}
        state = {"newest_ms": newest, "delivery": self.last_delivery if delivery_id is None else delivery_id, "results": self.results | results, "retained": after, "garbage": garbage}
        self.files.write(f"{self.path}/commits/{version}", json.dumps(state))
        late = rows.where(F.col("late"))
        gone, self.version, self.newest_ms, self.last_delivery = self.garbage, version, newest, state["delivery"]
        self.results, self.retained, self.garbage = state["results"], after, garbage
        for folder in gone:
            self.files.delete(f"{self.path}/{folder}")
        for old in self.files.names(f"{self.path}/commits"):
            if old.isdigit() and int(old) < version - 1:
                self.files.delete(f"{self.path}/commits/{old}")
        return late

    def panes(self) -> DataFrame:
        """The committed results of every pane."""
        schema = "metric string, pane_end_ms bigint, n bigint, total double"
        if not self.results:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}/part={p}" for p, f in sorted(self.results.items())])


def stream_into(samples: DataFrame, table: PaneTable, checkpoint: str, once: bool = False):
    """Stream a streaming table of samples into ``table``, one delivery per micro-batch; a repeated one does nothing."""
    writer = samples.writeStream.foreachBatch(lambda rows, n: table.ingest(rows, n) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def corrected_panes(samples: DataFrame, series: DataFrame, path: str, deliveries: int = 3, policy: LatePolicy = LatePolicy()) -> DataFrame:
    """Pane results after the batches came in ``deliveries`` groups of equal ranges of batch_id.

    Rows without a batch come with the first group.
    """
    table = PaneTable(samples.sparkSession, path, series, policy)
    span = samples.agg(F.min("batch_id").alias("lo"), F.max("batch_id").alias("hi")).first()
    if span["lo"] is None:
        table.ingest(samples)
        return table.panes()
    width = (span["hi"] - span["lo"]) // deliveries + 1
    for d in range(deliveries):
        lo = span["lo"] + d * width
        inside = F.col("batch_id").between(lo, lo + width - 1)
        table.ingest(samples.where(inside | F.col("batch_id").isNull() if d == 0 else inside))
    return table.panes()
