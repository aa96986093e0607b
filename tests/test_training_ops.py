"""Duplicates, late rows, heavy keys and regular grids on small awkward tables."""

import collections
import datetime
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tidepane.operators import dedup, grid, heavy, late, partitioned
from tidepane.operators.partitioned import before, heavy_keys, range_partitioned, skew_safe_join
from tidepane.session import scratch_path

TS = "message_id bigint, labels array<struct<name:string,value:string>>, samples array<struct<value:double,timestamp:bigint>>, surplus string"
SAMPLES = "arrival bigint, batch_id bigint, received_at timestamp_ntz, series_id bigint, timestamp_ms bigint, value double, late string, n string, watermark_ms string, pid string"
SERIES = "id bigint, metric string, labels map<string,string>, n bigint"
RAW = "arrival bigint, labels map<string,string>, timestamp_ms bigint, value double, missing string"
SOURCES = "metric string, sample_interval_ms bigint"
EPOCH = datetime.datetime(1970, 1, 1)


def at(ms):
    return EPOCH + datetime.timedelta(milliseconds=ms)


def identity(labels):
    return frozenset((n, v) for n, v in labels if v)


def messages(seed, n=200):
    r = random.Random(seed)
    rows = []
    for m in range(n):
        hot = r.random() < 0.4
        labels = None if r.random() < 0.03 else [("a", "hot")] if hot else [(r.choice("abc"), r.choice(["", "x", "y", None])) for _ in range(r.randint(0, 3))]
        if labels:
            r.shuffle(labels)
            labels += labels[:1]
        samples = None if r.random() < 0.03 else [None if r.random() < 0.05 else (r.choice([None, math.nan, 1.0]), None if r.random() < 0.1 else r.randint(0, 3)) for _ in range(r.randint(0, 4))]
        rows.append((m, labels, samples, "x"))
    return rows


def brute_copies(rows):
    seen, kept, surplus = set(), set(), set()
    for m, labels, samples, _ in sorted(rows):
        if labels is None:
            continue
        for pos, s in enumerate(samples or []):
            if s is None or s[1] is None:
                continue
            key = (identity(labels), s[1])
            (surplus if key in seen else kept).add((m, pos))
            seen.add(key)
    return kept, surplus


@pytest.mark.parametrize("salts", [1, 3, 64])
def test_surplus_copies(spark, salts):
    rows = messages(salts)
    kept, surplus = brute_copies(rows)
    got = dedup.surplus_copies(spark.createDataFrame(rows, TS), salts).collect()
    assert {(r["message_id"], r["pos"]) for r in got if r["surplus"]} == surplus
    assert {(r["message_id"], r["pos"]) for r in got if not r["surplus"]} == kept and len(got) == len(kept) + len(surplus)


def test_batches_keep_each_message_once(spark):
    rows = messages(9)
    kept, _ = brute_copies(rows)
    df = spark.createDataFrame(rows, TS)
    got = dedup.kept_copies(df, scratch_path(spark, "t"), 4)
    assert sorted((r["message_id"], r["pos"]) for r in got.collect()) == sorted(kept)
    log = dedup.DeliveryLog(spark, scratch_path(spark, "t"))
    copies = dedup.wire_copies(df)
    assert log.accept(copies, 0).count() == len(kept)
    assert log.accept(copies, 0).count() == len(kept)  # the same batch again gives what it kept
    assert log.accept(copies, 1).count() == 0
    assert dedup.surplus_copies(df.limit(0)).count() == 0 and dedup.kept_copies(df.limit(0), scratch_path(spark, "t")).count() == 0


def random_samples(seed, n=400):
    r = random.Random(seed)
    rows = []
    for a in range(n):
        batch = None if r.random() < 0.02 else a // 20 if r.random() < 0.7 else 7
        ts = None if r.random() < 0.05 else r.randint(-5, 40) * 900_000 + r.choice([0, 0, 1])
        received = None if r.random() < 0.05 else at(a * 90_000)
        value = r.choice([None, math.nan, math.inf, -0.0, 1.5, 2.25])
        rows.append((a, batch, received, r.choice([None, 0, 0, 0, 1, 2, 99]), ts, value, "x", "x", "x", "x"))
    return rows


def brute_late(rows, policy):
    def pane(ts):
        return -(-ts // policy.pane_ms) * policy.pane_ms

    timed = [r for r in rows if r[4] is not None and not (r[2] is not None and r[4] - (r[2] - EPOCH) // datetime.timedelta(milliseconds=1) > policy.future_ms)]
    out = {}
    for r in timed:
        newest = max((s[4] for s in timed if r[1] is not None and s[1] is not None and s[1] < r[1]), default=None)
        out[r[0]] = (pane(r[4]), newest is not None and pane(r[4]) <= newest - policy.cut_off_ms)
    return out


SERIES_ROWS = [(0, "m", {"__name__": "m", "job": "a", "region": ""}, 1), (1, "", {"job": "a"}, 1), (2, None, None, 1), (None, "z", None, 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_late_rows_and_corrected_panes(spark, seed):
    rows = random_samples(seed)
    policy = late.LatePolicy()
    want = brute_late(rows, policy)
    df, series = spark.createDataFrame(rows, SAMPLES), spark.createDataFrame(SERIES_ROWS, SERIES)
    got = {r["arrival"]: (r["pane_end_ms"], r["late"]) for r in late.routed(df, policy).collect()}
    assert got == want and any(x for _, x in want.values()) and not all(x for _, x in want.values())
    n, total = collections.Counter(), collections.defaultdict(float)
    panes = set()
    for r in rows:
        if r[0] in want and not want[r[0]][1]:
            key = ({0: "m"}.get(r[3], ""), want[r[0]][0])
            panes.add(key)
            if r[5] is not None and not math.isnan(r[5]):
                n[key] += 1
                total[key] += r[5]
    table = late.corrected_panes(df, series, scratch_path(spark, "t"), 3, policy)
    found = {(r["metric"], r["pane_end_ms"]): (r["n"], r["total"]) for r in table.collect()}
    assert found == {k: (n[k], total[k] if n[k] else None) for k in panes}


def test_a_failed_delivery_leaves_nothing(spark, monkeypatch):
    df, series = spark.createDataFrame(random_samples(3), SAMPLES), spark.createDataFrame(SERIES_ROWS, SERIES)
    table = late.PaneTable(spark, scratch_path(spark, "t"), series)
    table.ingest(df.where("arrival < 200"))
    before_it = sorted(map(tuple, table.panes().collect()), key=repr)
    with monkeypatch.context() as m:
        m.setattr(table.files, "write", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.ingest(df.where("arrival >= 200"))
    assert sorted(map(tuple, table.panes().collect()), key=repr) == before_it
    table.ingest(df.where("arrival >= 200"))
    assert table.version == 1
    empty = late.PaneTable(spark, scratch_path(spark, "t"), series)
    assert empty.panes().count() == 0
    empty.ingest(df.limit(0))
    assert empty.panes().count() == 0
    assert late.corrected_panes(df.limit(0), series, scratch_path(spark, "t")).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_a_delivery_reads_the_partitions_it_touches(spark, monkeypatch):
    """Rows of many hours in many deliveries: each recomputation opens a few partitions, closed ones lose their rows, folders are merged."""
    monkeypatch.setattr(late, "COMPACT_FOLDERS", 3)
    hour, series = 3_600_000, spark.createDataFrame(SERIES_ROWS, SERIES)
    rows = [(k, k // 4, None, k % 2, (k // 4) * hour // 2 - (k % 3) * 1_000_000, float(k), *"xxxx") for k in range(160)]
    df = spark.createDataFrame(rows, SAMPLES)
    table, read = late.PaneTable(spark, scratch_path(spark, "t"), series, partition_ms=2 * hour), []
    rows_of = table._rows_of
    monkeypatch.setattr(table, "_rows_of", lambda *a: read.append(rows_of(*a)) or read[-1])
    for d in range(20):
        table.ingest(df.where(f"batch_id BETWEEN {2 * d} AND {2 * d + 1}"), d)
        assert len(table.retained) <= 3 and all(len(f) <= 4 for f in table.retained.values())
        newest = read[-1]
        filters = [x for x in plan_of(newest).splitlines() if "PartitionFilters" in x]
        assert filters and all("part" in x.split("[", 1)[1] for x in filters)
        assert newest.select("part").distinct().count() <= 3
    assert len(table.results) > 8 and table.version == 19
    want = brute_late(rows, late.LatePolicy())
    kept = collections.Counter((("m" if rows[a][3] == 0 else ""), end) for a, (end, is_late) in want.items() if not is_late)
    assert {(r["metric"], r["pane_end_ms"]): r["n"] for r in table.panes().collect()} == kept
    assert {(r["metric"], r["pane_end_ms"]): r["n"] for r in late.PaneTable(spark, table.path, series, partition_ms=2 * hour).panes().collect()} == kept


def test_rows_are_not_shuffled_to_their_batch(spark):
    """Also without automatic broadcasts; and where panes are too many to broadcast, the result is the same."""
    df = spark.createDataFrame(random_samples(5), SAMPLES)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = late.routed(df)
        plan = plan_of(out)
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
        want = sorted((r["arrival"], r["late"]) for r in out.collect())
        late.BROADCAST_PANES, kept = 0, late.BROADCAST_PANES
        try:
            assert sorted((r["arrival"], r["late"]) for r in late.routed(df).collect()) == want
        finally:
            late.BROADCAST_PANES = kept
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_a_pane_table_is_taken_up_again_and_streams(spark, tmp_path):
    rows = random_samples(4)
    df, series = spark.createDataFrame(rows, SAMPLES), spark.createDataFrame(SERIES_ROWS, SERIES)
    early, late_part = df.where("coalesce(batch_id, 0) < 10"), df.where("batch_id >= 10")
    path = scratch_path(spark, "t")
    late.PaneTable(spark, path, series).ingest(early, 0)
    again = late.PaneTable(spark, path, series)
    assert again.newest_ms is not None and again.last_delivery == 0
    assert again.ingest(early, 0).count() == 0 and again.version == 0
    found = again.ingest(late_part, 1)
    want = brute_late(rows, late.LatePolicy())
    assert {r["arrival"] for r in found.collect()} == {a for a, (_, x) in want.items() if x and rows[a][1] is not None and rows[a][1] >= 10}
    for k, part in enumerate((early, late_part)):
        part.coalesce(1).write.parquet(str(tmp_path / f"x{k}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / f"x{k}").glob("part-*")).rename(tmp_path / "in" / f"{k}.parquet")
    streamed = late.PaneTable(spark, scratch_path(spark, "t"), series)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    late.stream_into(source, streamed, str(tmp_path / "ck"), once=True).awaitTermination()
    assert sorted(map(tuple, streamed.panes().collect()), key=repr) == sorted(map(tuple, again.panes().collect()), key=repr)


def test_a_delivery_log_is_taken_up_again(spark):
    df = spark.createDataFrame(messages(11), TS)
    path = scratch_path(spark, "t")
    kept = dedup.DeliveryLog(spark, path).accept(dedup.wire_copies(df), 3).count()
    again = dedup.DeliveryLog(spark, path)
    assert kept and set(again.batches) == {3} and again.accept(dedup.wire_copies(df), 4).count() == 0


def test_a_delivery_is_compared_with_the_partitions_it_falls_into(spark, monkeypatch):
    """Twenty deliveries, each a day with a few rows of the day before: what is read of the stored identifiers stays flat, also with merged folders."""
    monkeypatch.setattr(dedup, "COMPACT_FOLDERS", 3)
    log = dedup.DeliveryLog(spark, scratch_path(spark, "t"), buckets=2)
    opened, read = [], log._read
    monkeypatch.setattr(log, "_read", lambda parts, schema: [x := read(parts, schema), opened.append(0 if x is None else x.count())][0])
    schema = "identity string, timestamp bigint, message_id bigint, pos int, log_bucket string"
    seen = {}
    for d in range(20):
        rows = [(f"i{k}", (d - (k % 10 == 0)) * dedup.PERIOD_MS + k // 3, d * 1000 + k, 0, "x") for k in range(60)] + [(f"i{k}", d * dedup.PERIOD_MS + 7, d * 1000 + 500 + k, 1, "y") for k in range(30) if k % 10]
        want = []
        for r in sorted(rows, key=lambda r: r[2]):
            if seen.setdefault(r[:2], r) is r:
                want.append(r)
        got = log.accept(spark.createDataFrame(rows, schema).drop("log_bucket"), d)
        assert sorted((r["message_id"], r["pos"]) for r in got.collect()) == sorted(r[2:4] for r in want)
    assert max(opened[10:]) <= max(opened[:10]) * 1.2 and log.kept(got.schema).count() == len(seen)


def test_heavy_keys(spark):
    rows = random_samples(5)
    df, series = spark.createDataFrame(rows, SAMPLES), spark.createDataFrame(SERIES_ROWS, SERIES)
    labels = {i: {k: v for k, v in (m or {}).items() if v} for i, _, m, _ in SERIES_ROWS}
    by = collections.defaultdict(list)
    for r in rows:
        for pair in labels.get(r[3], {}).items() if r[3] is not None else []:
            by[pair].append(r)
    got = {(r["name"], r["value"]): r for r in heavy.per_pair(df, series).collect()}
    assert set(got) == set(by)
    for pair, members in by.items():
        g = got[pair]
        values = [r[5] for r in members if r[5] is not None and not math.isnan(r[5])]
        newest = max(((r[4], r[0]) for r in members if r[4] is not None), default=(None, None))
        assert (g["n_rows"], g["n_values"], g["total"], g["latest_ms"], g["latest_arrival"]) == (len(members), len(values), sum(values), *newest)
    percent = 40
    assert {(r["name"], r["value"]) for r in heavy.heavy_pairs(df, series, percent).collect()} == {p for p, m in by.items() if len(m) * 100 >= percent * len(rows)}
    metrics = {r["metric"]: r["n_rows"] for r in heavy.per_metric(df, series).collect()}
    assert metrics == {"m": sum(r[3] == 0 for r in rows), "": sum(r[3] in (1, 2) for r in rows)}
    assert heavy.heavy_pairs(df.limit(0), series).count() == 0 and heavy.per_pair(df, series.limit(0)).count() == 0


def test_heavy_keys_are_cut_into_pieces(spark):
    states = spark.range(4000).select(F.lit("k").alias("key"), F.col("id").alias("series_id"), F.lit(1).cast("bigint").alias("n_rows"), F.lit(1).cast("bigint").alias("n_values"), F.lit(1.0).alias("total"), F.struct(F.col("id").alias("timestamp_ms"), F.col("id").alias("arrival"), F.lit(1.0).alias("value")).alias("latest"))
    row = heavy.stitched(states, ["key"], ["series_id"]).first()
    assert row["n_rows"] == 4000 and row["latest"]["arrival"] == 3999 and row["pieces"] == 4


def brute_grid(rows, sources):
    width = dict(sources)
    seen = collections.defaultdict(dict)
    for a, labels, ts, value, _ in rows:
        if labels is None or ts is None or value is None or math.isnan(value) or labels.get("__name__") not in width:
            continue
        w = width[labels["__name__"]]
        key = ";".join(f"{k}={v}" for k, v in sorted(labels.items()) if v)
        end = -(-ts // w) * w
        best = seen[key, w].get(end)
        if best is None or (ts, a) > best[:2]:
            seen[key, w][end] = (ts, a, value)
    observed = {(k, e): x[2] for (k, _), ends in seen.items() for e, x in ends.items()}
    missing = {(k, e) for (k, w), ends in seen.items() for e in range(min(ends), max(ends) + 1, w) if e not in ends}
    return observed, missing


def readings(seed):
    r = random.Random(seed)
    rows = []
    for a in range(600):
        name = r.choice(["hot", "hot", "hot", "cold", "none"])
        labels = None if r.random() < 0.03 else {"__name__": name, "s": "1" if name == "hot" else r.choice("123"), "e": r.choice(["", ""])}
        ts = None if r.random() < 0.03 else r.choice([r.randint(-50_000, 50_000), r.randint(900_000, 930_000)])
        rows.append((a, labels, ts, r.choice([None, math.nan, math.inf, 1.0, 2.5, -3.0, 4.0]), "x"))
    return rows


@pytest.mark.parametrize("block", [4, 4096])
def test_grid(spark, block):
    rows, sources = readings(block), [("hot", 1000), ("cold", 7000)]
    observed, missing = brute_grid(rows, sources)
    out = grid.regular_grid(spark.createDataFrame(rows, RAW), spark.createDataFrame([*sources, ("bad", 0), (None, 5)], SOURCES), block=block).collect()
    assert {(r["source_key"], r["period_end_ms"]): r["value"] for r in out if not r["missing"]} == observed
    assert sorted((r["source_key"], r["period_end_ms"]) for r in out if r["missing"]) == sorted(missing)
    assert all(math.isfinite(r["value"]) for r in out if r["missing"])


def test_filled_values_follow_the_season(spark):
    day = 86_400_000
    t0 = 1_772_409_600_000

    def truth(t):
        return 20 + 3 * (t - t0) / (7 * day) + 5 * math.sin(2 * math.pi * (t % day) / day) + math.cos(4 * math.pi * (t % day) / day)

    w = 900_000
    times = [t0 + k * w for k in range(4 * 96)]
    r = random.Random(1)
    gone = set(r.sample(times[1:-1], 120)) | set(times[100:130])
    rows = [(i, {"__name__": "m", "s": "1"}, t, truth(t), "x") for i, t in enumerate(times) if t not in gone]
    out = grid.regular_grid(spark.createDataFrame(rows, RAW), spark.createDataFrame([("m", w)], SOURCES)).where("missing").collect()
    assert {x["period_end_ms"] for x in out} == gone
    assert max(abs(x["value"] - truth(x["period_end_ms"])) for x in out) < 0.01


def test_the_fit_does_not_depend_on_the_year(spark):
    """A day of readings every quarter of an hour with gaps: the filled values are the same when it lies decades away, and lie on the curve."""
    w, day, shift = 900_000, 86_400_000, 86_400_000 * 365 * 40
    curve = lambda t: 5 + 3 * t / day + 2 * math.sin(2 * math.pi * t / day)
    times = [i * w for i in range(300) if i % 7 or i < 5]
    sources = spark.createDataFrame([("m", w)], SOURCES)
    filled = []
    for origin in (0, shift, -shift):
        rows = [(i, {"__name__": "m"}, t + origin, curve(t), "x") for i, t in enumerate(times)]
        out = grid.regular_grid(spark.createDataFrame(rows, RAW), sources).where("missing").collect()
        filled.append({r["period_end_ms"] - origin: r["value"] for r in out})
    assert filled[0].keys() == filled[1].keys() == filled[2].keys() and len(filled[0]) > 30
    assert all(abs(f[t] - curve(t)) < 0.01 and abs(f[t] - filled[0][t]) < 1e-6 for f in filled for t in f)


def test_grid_of_nothing(spark):
    empty = spark.createDataFrame([], RAW)
    assert grid.regular_grid(empty, spark.createDataFrame([("m", 5)], SOURCES)).count() == 0
    assert grid.regular_grid(spark.createDataFrame(readings(1), RAW), spark.createDataFrame([], SOURCES)).count() == 0


def test_joins_that_split_heavy_keys(spark):
    left = spark.createDataFrame([(None if i % 9 == 0 else 0 if i % 3 else i, i) for i in range(300)], "k bigint, v bigint")
    counts = left.where("k IS NOT NULL").groupBy("k").count().withColumnRenamed("count", "n").withColumn("x", F.col("k") * 2).where("k <> 5")
    want = sorted((r["k"], r["v"], r["x"]) for r in left.join(counts, "k").collect())
    for share in (0.001, 0.1, 2.0):
        got = sorted((r["k"], r["v"], r["x"]) for r in skew_safe_join(left, counts, "k", "n", share).collect())
        assert got == want
        once = spark.range(50).select(F.col("id").alias("k"), F.lit(1).alias("w"))
        assert plan_of(skew_safe_join(once, counts, "k", "n", share)).count(") Range") <= 2  # the operator and its details
        both = skew_safe_join(left, counts, "k", "n", share, how="left")
        assert both.count() == 300 and both.where("x IS NOT NULL").count() == len(want)
    assert [r["k"] for r in heavy_keys(counts, "n", 0.5).collect()] == [0]


def test_partitions_grow_with_the_files(spark, tmp_path, monkeypatch):
    spark.range(10_000).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    size = partitioned.scanned_bytes(df.groupBy("id").count().join(df, "id"))
    assert size >= 2 * sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet")) * 0.9
    assert partitioned.partition_count(df) == 4
    monkeypatch.setattr(partitioned, "PARTITION_BYTES", 1000)
    assert partitioned.partition_count(df) > 20
    assert partitioned.partition_count(spark.createDataFrame([(1,)], "x int")) == 4


def test_ordered_partitions_carry_states(spark):
    laid = range_partitioned(spark.range(100).select(F.col("id")), ["id"], "t")
    rows = before(laid.groupBy("pid").agg(F.count(F.lit(1)).alias("n")), "n", "sum").orderBy("pid").collect()
    assert [r["carried"] for r in rows] == list(itertools.accumulate([0] + [r["n"] for r in rows][:-1]))
    assert rows[-1]["carried"] + rows[-1]["n"] == 100
