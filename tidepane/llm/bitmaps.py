"""Exact distinct counts from compressed, bucketed bitmaps that can be united later.

Identifiers and group labels become dense integers by one codebook; a bitmap is
stored as its non-zero 64-bit words, gathered in buckets of 1,024 words.
Building, uniting (OR), intersecting (AND) and counting are plain aggregations
over words, so they combine on the map side and run inside generated code. The
error is zero.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepane.functions.labels import label
from tidepane.operators.partitioned import partition_count, skew_safe_join
from tidepane.session import written

DAY_MS = 86_400_000
WORD_BITS = 64
#: Words in a stored bucket; a bucket covers 65,536 identifiers.
BUCKET_WORDS = 1024
GROUP_LABELS = ("region", "job", "service")
#: What is counted; ``counted`` is the place in this list.
COUNTED = ("series", "instance", "pod")
KEYS = ("day", *GROUP_LABELS, "counted")
#: Values of a group label up to which they are broadcast to name groups (a row of some 50 bytes each).
BROADCAST_LABELS = 1_000_000


def numbered(df: DataFrame, order: Sequence[str], out: str, name: str) -> DataFrame:
    """``df`` with ``out``: its rows numbered 0, 1, 2, ... without gaps along ``order``.

    The rows are range partitioned and sorted, each keeps its place within its
    partition, and a partition starts after the rows of those before it. Only
    one count per partition reaches the driver, whatever the data.
    """
    laid = df.repartitionByRange(partition_count(df), *order).sortWithinPartitions(*order)
    # Upper bits: partition; lower 33 bits: row. Written, so that both stay as they are.
    laid = written(laid.withColumn("__seq", F.monotonically_increasing_id()), name)
    laid = laid.withColumn("__pid", F.shiftright("__seq", 33).cast("int"))
    counts = sorted((r["__pid"], r["count"]) for r in laid.groupBy("__pid").count().collect())
    starts = itertools.accumulate((n for _, n in counts), initial=0)
    rows = [(pid, start) for (pid, _), start in zip(counts, starts)]
    place = F.col("start") + F.col("__seq").bitwiseAND(F.lit((1 << 33) - 1))
    return laid.join(F.broadcast(df.sparkSession.createDataFrame(rows, "__pid int, start bigint")), "__pid").withColumn(out, place).drop("__pid", "__seq", "start")


def _flat(series: DataFrame) -> DataFrame:
    """``series_id`` with its group and counted labels (``''`` where missing). Null ids are left out; a repeated id keeps the row that sorts first."""
    names = [*GROUP_LABELS, *COUNTED[1:]]
    flat = series.where(F.col("id").isNotNull()).select(F.col("id").alias("series_id"), *[label("labels", n).alias(n) for n in names])
    return flat.groupBy("series_id").agg(F.min(F.struct(*names)).alias("l")).select("series_id", *[F.col(f"l.{n}").alias(n) for n in names])


def _entries(flat: DataFrame) -> DataFrame:
    """A row per series and thing to encode: ``series_id``, ``kind``, ``value``, ``first`` (what orders its codes) and ``key`` (kind and value)."""
    group = [F.col(g) for g in GROUP_LABELS]
    none = F.lit("")
    kinds = [("series", F.col("series_id").cast("string"), [*group, F.col("instance"), F.col("pod")])]
    kinds += [(k, F.col(k), [*group, none, none]) for k in COUNTED[1:]]
    kinds += [(k, F.col(k), [none] * 5) for k in GROUP_LABELS]
    structs = [F.struct(F.lit(k).alias("kind"), v.alias("value"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("first")) for k, v, order in kinds]
    laid = flat.select("series_id", F.explode(F.array(*structs)).alias("e")).select("series_id", "e.*")
    # A missing group label is a group; a missing identifier is none.
    return laid.where((F.col("value") != "") | F.col("kind").isin(*GROUP_LABELS)).withColumn("key", F.concat("kind", F.lit("="), "value"))


@dataclass(frozen=True)
class Codebook:
    """``codes``: a row per ``key`` (``kind`` and ``value``) with its ``code`` and ``uses``, the series that have it; ``sizes``: the codes of each kind; ``uses``: of all keys."""

    codes: DataFrame
    sizes: dict[str, int]
    uses: int


def codebook(series: DataFrame, known: Codebook | None = None) -> Codebook:
    """Dense codes of series, their identifiers and group labels.

    Codes of a kind count from 0. Series are numbered along their group labels,
    and label values along the groups that use them, so the identifiers of a
    group lie close together and its bitmap has few words. With ``known``, an
    earlier codebook, its codes stay and new values are numbered after its
    largest, so bitmaps of both can be united.
    """
    values = _entries(_flat(series)).groupBy("key", "kind", "value").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("uses"))
    sizes = dict(known.sizes) if known else {}
    old = None
    if known:
        values = written(values.join(known.codes.select("key", "code"), "key", "left"), "values")
        gone = known.codes.join(values.select("key"), "key", "left_anti").withColumn("uses", F.lit(0).cast("bigint"))
        old = values.where(F.col("code").isNotNull()).drop("first").unionByName(gone)
        values = values.where(F.col("code").isNull()).drop("code")
    placed = numbered(values, ["kind", "first", "value"], "place", "codebook")
    offset, uses = F.lit(0), 0 if old is None else old.agg(F.coalesce(F.sum("uses"), F.lit(0)).alias("uses")).first()["uses"]
    # A row per kind.
    for r in placed.groupBy("kind").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"), F.sum("uses").alias("uses")).collect():
        offset = F.when(F.col("kind") == r["kind"], F.lit(sizes.get(r["kind"], 0) - r["place"])).otherwise(offset)
        sizes[r["kind"]] = sizes.get(r["kind"], 0) + r["n"]
        uses += r["uses"]
    fresh = placed.select("key", "kind", "value", (F.col("place") + offset).alias("code"), "uses")
    return Codebook(written(fresh if old is None else fresh.unionByName(old.select(*fresh.columns)), "codes"), sizes, uses)


def coded_series(series: DataFrame, book: Codebook) -> DataFrame:
    """Series with the codes of their labels: ``series_id``, ``region``, ``job``, ``service``, ``series``, ``instance`` and ``pod`` (null where missing)."""
    coded = skew_safe_join(_entries(_flat(series)).select("series_id", "key", "kind"), book.codes.select("key", "code", "uses"), "key", "uses", total=book.uses)
    return coded.groupBy("series_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("code"))).alias(k) for k in (*GROUP_LABELS, *COUNTED)])


def add_bits(df: DataFrame, groups: Sequence[str], code: str) -> DataFrame:
    """Words of the bitmap of each group: ``groups``, ``word`` (code div 64) and ``bits``."""
    bit = F.expr(f"shiftleft(1L, CAST(pmod(`{code}`, {WORD_BITS}) AS INT))")
    return df.where(F.col(code).isNotNull()).groupBy(*groups, F.expr(f"`{code}` >> 6").alias("word")).agg(F.bit_or(bit).alias("bits"))


def unite(words: DataFrame, groups: Sequence[str]) -> DataFrame:
    """OR of all bitmaps that agree in ``groups``."""
    return words.groupBy(*groups, "word").agg(F.bit_or("bits").alias("bits"))


def intersect(a: DataFrame, b: DataFrame, groups: Sequence[str]) -> DataFrame:
    """AND of the two bitmaps of each group; a word missing on one side is zero."""
    keys = [*groups, "word"]
    both = a.select(*keys, "bits").join(b.select(*keys, F.col("bits").alias("other")), keys)
    return both.select(*keys, F.col("bits").bitwiseAND(F.col("other")).alias("bits")).where(F.col("bits") != 0)


def cardinality(words: DataFrame, groups: Sequence[str], out: str = "n") -> DataFrame:
    """Number of set bits per group; the words of a group must be united."""
    return words.groupBy(*groups).agg(F.sum(F.bit_count("bits")).cast("bigint").alias(out))


def pack(words: DataFrame, groups: Sequence[str] = KEYS) -> DataFrame:
    """Stored form: a row per group and bucket with the sorted non-zero words of at most 65,536 identifiers."""
    keys = [*groups, F.floor(F.col("word") / BUCKET_WORDS).alias("bucket")]
    return words.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))


def unpack(packed: DataFrame, groups: Sequence[str] = KEYS) -> DataFrame:
    """Words of stored bitmaps."""
    return packed.select(*groups, F.explode("words").alias("w")).select(*groups, "w.word", "w.bits")


def daily_bitmaps(samples: DataFrame, coded: DataFrame) -> DataFrame:
    """Stored bitmaps per day, group and ``counted``, written: what days and files are united from.

    ``day`` counts UTC days from 1970 by ``timestamp_ms``; groups and identifiers
    are codes (:func:`coded_series`). Samples are reduced to distinct (day,
    series) before the join, so a series with a third of all rows is a few rows
    there. Samples with null time or null or unknown series are left out, and so
    are missing or empty identifiers; missing group labels form the group ``''``.
    """
    day = F.expr(f"CAST((timestamp_ms - pmod(timestamp_ms, {DAY_MS})) div {DAY_MS} AS bigint)")
    active = samples.where(F.col("timestamp_ms").isNotNull() & F.col("series_id").isNotNull()).select(day.alias("day"), "series_id").distinct()
    seen = active.join(coded, "series_id")
    kinds = [F.struct(F.lit(i).cast("tinyint").alias("counted"), F.col(n).alias("code")) for i, n in enumerate(COUNTED)]
    laid = seen.select("day", *GROUP_LABELS, F.explode(F.array(*kinds)).alias("k")).select("day", *GROUP_LABELS, "k.counted", "k.code")
    return written(pack(add_bits(laid, KEYS, "code")), "bitmaps")


def united_groups(words: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Bitmaps of every combination of the group labels; a label that is united away is null.

    ``keep`` are the other keys (``counted``, and ``day`` if days stay apart).
    """
    sets = [[*keep, "word", *[g for i, g in enumerate(GROUP_LABELS) if mask >> i & 1]] for mask in range(1 << len(GROUP_LABELS))]
    columns = [F.col(c) for c in (*keep, "word", *GROUP_LABELS)]
    return words.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.bit_or("bits").alias("bits"))


def counts_by_kind(words: DataFrame, groups: Sequence[str], book: Codebook) -> DataFrame:
    """Cardinalities as one column per counted kind: ``n_series``, ``n_instance``, ``n_pod`` (0 where none); groups by their values."""
    per = [F.coalesce(F.sum(F.when(F.col("counted") == i, F.bit_count("bits"))), F.lit(0)).cast("bigint").alias(f"n_{k}") for i, k in enumerate(COUNTED)]
    out = words.groupBy(*groups).agg(*per)
    named = [g for g in groups if g in GROUP_LABELS]
    for g in named:
        names = book.codes.where(F.col("kind") == g).select(F.col("code").alias(g), F.col("value").alias(f"{g}_value"))
        out = out.join(F.broadcast(names) if book.sizes.get(g, 0) <= BROADCAST_LABELS else names, g, "left")
    return out.select(*[F.col(f"{g}_value").alias(g) if g in named else F.col(g) for g in groups], *[f"n_{k}" for k in COUNTED])
