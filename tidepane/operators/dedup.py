"""Exactly one copy of messages that were delivered at least once."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepane.functions.labels import pair_set_digest
from tidepane.session import written
from tidepane.sources.files import Files

#: Sub-groups into which the copies of one identifier are dealt for the first ranking.
SALTS = 64
PERIOD_MS = 86_400_000
#: Hash buckets of the stored identifiers of a period.
BUCKETS = 16
#: Folders of one period and bucket that are made one.
COMPACT_FOLDERS = 16


def ranked_copies(df: DataFrame, keys: Sequence[str], order: Sequence[str], salts: int = SALTS, out: str = "surplus") -> DataFrame:
    """``df`` with a flag: whether the row is a copy after the first of its identifier.

    The identifier is ``keys`` (null equals null here), copies rank by ``order``,
    which must tell all rows of a group apart to be deterministic. Ranking runs
    twice: within (identifier, salt), where only the first survives as a
    candidate, then among the at most ``salts`` candidates of an identifier. So
    a group with a third of all rows is ranked by many tasks.
    """
    salt = F.pmod(F.xxhash64(*order), F.lit(salts))
    local = Window.partitionBy(*keys, "__salt").orderBy(*order)
    ranked = df.withColumn("__salt", salt).withColumn("__rank", F.row_number().over(local))
    overall = Window.partitionBy(*keys).orderBy(*order)
    # Rows that lost within their salt need no second ranking; they are told apart before the exchange.
    losers = ranked.where(F.col("__rank") > 1).withColumn(out, F.lit(True))
    winners = ranked.where(F.col("__rank") == 1).withColumn(out, F.row_number().over(overall) > 1)
    return losers.unionByName(winners).drop("__salt", "__rank")


def wire_copies(time_series: DataFrame) -> DataFrame:
    """One row per element of ``samples`` that has an identifier.

    Columns: ``identity`` (digest of the label set), ``timestamp``, ``message_id``,
    ``pos`` (0-based), ``value``. Messages with null labels and samples that are
    null or have a null timestamp carry no identifier and are left out; an empty
    or null ``samples`` gives no row. Other columns of the input are ignored.
    """
    keyed = time_series.select("message_id", pair_set_digest("labels").alias("identity"), "samples").where(F.col("identity").isNotNull())
    laid = keyed.select("message_id", "identity", F.posexplode("samples").alias("pos", "sample"))
    return laid.select("identity", F.col("sample.timestamp").alias("timestamp"), "message_id", "pos", F.col("sample.value").alias("value")).where(F.col("timestamp").isNotNull())


def surplus_copies(time_series: DataFrame, salts: int = SALTS) -> DataFrame:
    """Copies of :func:`wire_copies` with ``surplus``: false for the first in (message_id, pos), true for the rest."""
    return ranked_copies(wire_copies(time_series), ["identity", "timestamp"], ["message_id", "pos"], salts)


class DeliveryLog:
    """Keeps the first copy of each message over batches that arrive one after another.

    ``accept`` ranks the copies within the batch, drops identifiers that are
    already stored by an anti-join, stores the new ones, and returns their rows.
    The batch is reduced to one row per identifier before the join, so a message
    repeated millions of times is one row there. Kept rows lie in partitions by
    the period of ``time`` and a hash bucket of the identifier, and a batch is
    compared only with the partitions its own identifiers fall into, so what it
    costs does not grow with the number of batches before it.

    A batch is published by one small file made by rename, which lists the
    folders of every partition. One that died half-way leaves nothing visible and
    can be repeated; a number that was published before returns the rows it kept
    then.
    """

    def __init__(self, spark, path: str, keys: Sequence[str] = ("identity", "timestamp"), order: Sequence[str] = ("message_id", "pos"), time: str = "timestamp", period_ms: int = PERIOD_MS, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.order = spark, path, list(keys), list(order)
        self.time, self.period_ms, self.buckets = time, period_ms, buckets
        self.files = Files(spark)
        self.sequence = max((int(n) for n in self.files.names(f"{path}/commits") if n.isdigit()), default=-1)
        state = json.loads(self.files.read(f"{path}/commits/{self.sequence}")) if self.sequence >= 0 else {}
        #: Folder of the rows each batch kept, and the folders of each partition.
        self.batches: dict[int, str] = {int(k): v for k, v in state.get("batches", {}).items()}
        self.partitions: dict[str, list[str]] = state.get("partitions", {})

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Rows with their period and bucket."""
        return rows.withColumn("log_period", F.floor(F.col(self.time) / F.lit(self.period_ms)).cast("bigint")).withColumn("log_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _store(self, rows: DataFrame, folder: str) -> list[str]:
        """Write placed rows, a busy partition by several tasks; returns the partitions."""
        at = f"{self.path}/{folder}"
        rows.repartitionByRange("log_period", "log_bucket", *self.keys).write.mode("overwrite").partitionBy("log_period", "log_bucket").parquet(at)
        periods = [n for n in self.files.names(at) if n.startswith("log_period=")]
        return [f"{p}/{b}" for p in periods for b in self.files.names(f"{at}/{p}") if b.startswith("log_bucket=")]

    def _read(self, partitions: Iterable[str], schema) -> DataFrame | None:
        """Stored rows of some partitions; no other file is opened."""
        folders = [f"{self.path}/{f}/{p}" for p in partitions for f in self.partitions.get(p, [])]
        return self.spark.read.schema(schema).parquet(*folders) if folders else None

    def accept(self, copies: DataFrame, batch: int) -> DataFrame:
        """Rows of ``copies`` that are the first of their identifier, now and in all earlier batches."""
        if batch in self.batches:
            return self._rows(copies.schema, [self.batches[batch]])
        first = ranked_copies(copies, self.keys, self.order).where(~F.col("surplus")).drop("surplus")
        first = written(self._placed(first), "first")
        # One row per period and bucket the batch touches: its span of time, not its rows.
        touched = [f"log_period={r[0]}/log_bucket={r[1]}" for r in first.select("log_period", "log_bucket").distinct().collect()]
        known = self._read(touched, first.select(*self.keys).schema)
        fresh = first if known is None else first.join(known, self.keys, "left_anti")
        folder = f"kept/log_batch={batch}"
        stored = self._store(fresh, folder)
        after = dict(self.partitions)
        for p in stored:
            after[p] = [*after.get(p, []), folder]
        self._publish({**self.batches, batch: folder}, after)
        self._compact([p for p in stored if len(after[p]) > COMPACT_FOLDERS], first.drop("log_period", "log_bucket").schema)
        return self._rows(copies.schema, [folder])

    def _publish(self, batches: dict[int, str], partitions: dict[str, list[str]]) -> None:
        self.files.write(f"{self.path}/commits/{self.sequence + 1}", json.dumps({"batches": batches, "partitions": partitions}))
        self.sequence, self.batches, self.partitions = self.sequence + 1, batches, partitions
        for old in self.files.names(f"{self.path}/commits"):
            if old.isdigit() and int(old) < self.sequence - 1:
                self.files.delete(f"{self.path}/commits/{old}")

    def _compact(self, crowded: list[str], schema) -> None:
        """One folder instead of many for the identifiers of some partitions; the rows batches kept stay where they are."""
        if crowded:
            folder = f"compact/{self.sequence}"
            self._store(self._placed(self._read(crowded, schema).select(*dict.fromkeys([*self.keys, self.time]))), folder)
            self._publish(self.batches, self.partitions | {p: [folder] for p in crowded})

    def kept(self, schema) -> DataFrame | None:
        """The rows all batches kept."""
        return self._rows(schema, list(self.batches.values())) if self.batches else None

    def _rows(self, schema, folders: list[str]) -> DataFrame:
        found = self.spark.read.schema(schema).option("basePath", f"{self.path}/kept").parquet(*[f"{self.path}/{f}" for f in folders])
        return found.select(*schema.names)


def kept_copies(time_series: DataFrame, path: str, batches: int = 3) -> DataFrame:
    """The kept copies when the messages come in ``batches`` deliveries, by equal ranges of message_id.

    Every identifier appears once, with the copy that came first; a message
    without a number comes before all others.
    """
    log = DeliveryLog(time_series.sparkSession, path)
    span = time_series.agg(F.min("message_id").alias("lo"), F.max("message_id").alias("hi")).first()
    copies = wire_copies(time_series)
    if span["lo"] is None:
        return log.accept(copies, 0)
    width = (span["hi"] - span["lo"]) // batches + 1
    for b in range(batches):
        lo = span["lo"] + b * width
        inside = F.col("message_id").between(lo, lo + width - 1)
        log.accept(copies.where(inside | F.col("message_id").isNull() if b == 0 else inside), b)
    return log.kept(copies.schema)
