import math
import random

import pytest
from helpers import batch, series_rows, vector
from pyspark.sql import functions as F

from tidepane.functions.timeline import pane_end, pane_end_of
from tidepane.operators.evaluate import Unsupported, evaluate
from tidepane.operators.states import Counter, DDSketch, DistinctItems, Exact, ExactQuantile, ItemWeights, Kll, family_of, register_family
from tidepane.operators.vector import labelled
from tidepane.sources.samples import STALE_BITS, Interned, Wide, is_stale_marker

STALE = __import__("struct").unpack("<d", __import__("struct").pack("<Q", STALE_BITS))[0]


@pytest.mark.parametrize("ts,end", [(1, 600_000), (600_000, 600_000), (600_001, 1_200_000), (0, 0), (-1, 0), (-600_000, -600_000), (2**63 - 1, None), (-(2**63), None)])
def test_panes_are_left_open(spark, ts, end):
    assert pane_end_of(ts, 600_000) == end
    got = spark.createDataFrame([(ts,)], "ts bigint").select(pane_end("ts", 600_000).alias("e")).first()["e"]
    assert got == end


def test_sums_are_left_open_and_rates_extrapolate(spark):
    rows = series_rows("http_requests_total", ["a", "b"], 0, 600_000, value=lambda i, t: t / 1000)
    df = batch(spark, rows)
    assert vector(evaluate("sum by (job) (sum_over_time(http_requests_total[1m]))", df, 300_000), "job") == {("a",): 1110.0, ("b",): 1110.0}
    rates = vector(evaluate("sum by (job) (rate(http_requests_total[1m]))", df, 300_000), "job")
    assert rates == {("a",): pytest.approx(1.0), ("b",): pytest.approx(1.0)}
    assert vector(evaluate("rate(http_requests_total[10s])", df, 300_000), "job") == {}


def test_counter_resets_count(spark):
    values = [10.0, 20.0, 5.0, 15.0, 3.0]
    rows = [({"__name__": "c", "job": "a"}, 10_000 * i, v) for i, v in enumerate(values)]
    got = vector(evaluate("increase(c[50s])", batch(spark, rows), 40_000), "job")[("a",)]
    grown = 3.0 - 10.0 + 20.0 + 15.0
    # Samples reach from -10 s (the window's start) plus 10 s to its end; half a step is left before the first.
    assert got == pytest.approx(grown * (40 + min(10, 40 * 10 / grown)) / 40)


def test_panes_of_a_counter_merge_to_the_whole(spark):
    rows = [({"__name__": "c", "job": j}, t, float((t // 1000 * (k + 3)) % 97)) for k, j in enumerate("ab") for t in range(0, 600_000, 7_000)]
    df = batch(spark, rows)
    whole = Counter().build(df)
    panes = Counter().merge(Counter().build(df.withColumn("pane_end_ms", pane_end("ts_ms", 60_000)), ["pane_end_ms"]))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, panes.select(*whole.columns).collect()))


def test_instant_selector_takes_the_latest_and_ends_with_a_stale_marker(spark):
    one = {"__name__": "m", "job": "a"}
    two = {"__name__": "m", "job": "b"}
    df = batch(spark, [(one, 1000, 1.0), (one, 2000, 2.0), (one, 2000, 3.0), (two, 1000, 1.0), (two, 2000, STALE)])
    assert vector(evaluate("m", df, 2000), "job") == {("a",): 3.0}
    assert vector(evaluate("m", df, 1000), "job") == {("a",): 1.0, ("b",): 1.0}
    assert vector(evaluate("count_over_time(m[10s])", df, 2000), "job") == {("a",): 3.0, ("b",): 1.0}
    assert is_stale_marker(STALE) and not is_stale_marker(math.nan)
    assert "__name__" in evaluate("m", df, 2000).first()["labels"]


def test_matchers_are_anchored_and_missing_labels_are_empty(spark):
    rows = [({"__name__": "m", "job": j}, 1000, 1.0) for j in ("dev", "test", "devtest")] + [({"__name__": "m"}, 1000, 1.0)]
    df = batch(spark, rows)
    assert set(vector(evaluate('sum_over_time(m{job=~"dev|test"}[1m])', df, 1000), "job")) == {("dev",), ("test",)}
    assert set(vector(evaluate('sum_over_time(m{job!~"dev|test"}[1m])', df, 1000), "job")) == {("devtest",), (None,)}
    assert set(vector(evaluate('sum_over_time(m{job=""}[1m])', df, 1000), "job")) == {(None,)}


def test_rankings_return_whole_series(spark):
    rows = [({"__name__": "d", "instance": f"i{i}", "region": "e" if i < 3 else "w"}, 1000, float(v)) for i, v in enumerate([6, 60, 30, 9, math.nan])]
    df = batch(spark, rows)
    top = evaluate("topk(2, sum_over_time(d[1m]))", df, 1000)
    assert vector(top, "instance", "region") == {("i1", "e"): 60.0, ("i2", "e"): 30.0}
    by = vector(evaluate("topk by (region) (1, sum_over_time(d[1m]))", df, 1000), "instance")
    assert by == {("i1",): 60.0, ("i3",): 9.0}
    assert len(vector(evaluate("bottomk by (region) (9, sum_over_time(d[1m]))", df, 1000), "instance")) == 5
    assert evaluate("topk(0, sum_over_time(d[1m]))", df, 1000).count() == 0


def test_aggregations(spark):
    rows = [({"__name__": "d", "a": a, "b": b}, 1000, v) for a, b, v in [("x", "1", 1.0), ("x", "2", 4.0), ("y", "1", math.nan), ("y", "2", 2.0)]]
    df = batch(spark, rows)
    assert vector(evaluate("max by (a) (sum_over_time(d[1m]))", df, 1000), "a") == {("x",): 4.0, ("y",): 2.0}
    assert vector(evaluate("sum without (b) (count_over_time(d[1m]))", df, 1000), "a") == {("x",): 2.0, ("y",): 2.0}
    assert vector(evaluate("sum(count_over_time(d[1m]))", df, 1000)) == {(): 4.0}
    assert vector(evaluate("sum by (gone) (count_over_time(d[1m]))", df, 1000), "gone") == {(None,): 4.0}


def interpolated(q, xs):
    xs = sorted(xs)
    r = q * (len(xs) - 1)
    lo, hi = math.floor(r), math.ceil(r)
    return xs[lo] + (xs[hi] - xs[lo]) * (r - lo)


@pytest.mark.parametrize("shape", [[0.0, 3.0, 5.0], [-7.0, -3.0, 0.0, 2.0, 4.0], [-9.0, -8.0, -5.0, -1.0]])
def test_ddsketch_keeps_its_relative_error(spark, shape):
    values = {s: [(s + 1) * shape[i % len(shape)] for i in range(1000)] for s in range(4)}
    rows = [({"__name__": "d", "s": str(s)}, i * 100, v) for s, vs in values.items() for i, v in enumerate(vs)]
    df = batch(spark, rows).withColumn("pane_end_ms", pane_end("ts_ms", 1000))
    family = DDSketch(alpha=0.05)
    got = family.estimate(family.merge(family.build(df, ["pane_end_ms"])), 0, 1, "quantile_over_time", 0.99)
    for r in got.collect():
        exact = interpolated(0.99, values[int(__import__("json").loads(r["series"])["s"])])
        assert abs(r["value"] - exact) <= 0.05 * abs(exact) + 1e-12


def test_kll_of_merged_panes_keeps_its_rank_error(spark):
    rows = [({"__name__": "d"}, i, float((i * 7919) % 10007)) for i in range(10_000)]
    df = batch(spark, rows).withColumn("pane_end_ms", pane_end("ts_ms", 1000))
    family = Kll()
    value = family.estimate(family.merge(family.build(df, ["pane_end_ms"])), 0, 1, "quantile_over_time", 0.99).first()["value"]
    below = sum(r[2] <= value for r in rows) / len(rows)
    assert abs(below - 0.99) <= 0.011


def test_exact_quantile_and_quantiles_out_of_range(spark):
    rows = [({"__name__": "d"}, i, float(i)) for i in range(1, 11)]
    df = batch(spark, rows)
    assert vector(evaluate("quantile_over_time(0.5, d[1m])", df, 1000)) == {(): 5.5}
    assert vector(evaluate("quantile_over_time(-1, d[1m])", df, 1000)) == {(): -math.inf}
    assert vector(evaluate("quantile_over_time(2, d[1m])", df, 1000)) == {(): math.inf}
    assert ExactQuantile().merge(ExactQuantile().build(df)).agg(F.sum("n")).first()[0] == 10


def test_empty_samples_give_empty_vectors(spark):
    df = batch(spark, series_rows("m", ["a"], 0, 30_000)).limit(0)
    for q in ("m", "rate(m[1m])", "sum(sum_over_time(m[1m]))", "topk(3, avg by (job) (quantile_over_time(0.5, m[1m])))"):
        assert evaluate(q, df, 60_000).count() == 0
    assert Exact().merge(Exact().build(df)).count() == 0


def test_windows_compare_like_rounded_times(spark):
    from tidepane.functions.timeline import epoch_ms, within_ms
    from tidepane.operators.evaluate import window_of

    times = ["1969-12-31 23:59:59.999999", "1970-01-01 00:00:00.0", "1970-01-01 00:00:00.000999", "1970-01-01 00:00:00.001", "1970-01-01 00:00:00.005", "1970-01-01 00:00:00.005999", "1970-01-01 00:00:00.006"]
    df = spark.createDataFrame([(t,) for t in times], "s string").select(F.col("s").cast("timestamp_ntz").alias("ts"))
    got = df.select(epoch_ms("ts").alias("ms"), within_ms("ts", 0, 5).alias("inside")).collect()
    assert [r["ms"] for r in got] == [-1, 0, 0, 1, 5, 5, 6] and all(r["inside"] == (0 < r["ms"] <= 5) for r in got)
    assert window_of("sum by (a) (rate(x[1m] offset 10s))", 100_000) == (30_000, 90_000)
    assert window_of("x", 300_000) == (0, 300_000)


def test_offsets(spark):
    df = batch(spark, series_rows("m", ["a"], 0, 120_000))
    assert vector(evaluate("last_over_time(m[1m] offset 30s)", df, 100_000), "job") == {("a",): 60_000.0}
    with pytest.raises(Unsupported):
        evaluate("sum_over_time(m[1m] offset 100y)", df, -(2**63) + 5)


def test_a_busy_series_is_compared_in_blocks(spark):
    """One series has most rows: rate, increase and exact quantiles equal a plain computation, with resets, ties and infinities."""
    r = random.Random(7)
    rows, t = [], {"hot": 0, "cold": 0}
    for _ in range(3000):
        job = "cold" if r.random() < 0.1 else "hot"
        t[job] += r.choice([0, 1_000, 5_000, 200_000])
        rows.append(({"__name__": "m", "job": job}, t[job], r.choice([0.0, -0.0, float(r.randint(-9, 9)), r.uniform(-100, 100), 1e300, -1e-300])))
    samples, end = batch(spark, rows), max(t.values())
    for job in t:
        values = [v for labels, _, v in rows if labels["job"] == job]
        lost = sum(a for a, b in zip(values, values[1:]) if b < a)
        state = Counter(block_ms=60_000).build(samples.where(F.col("labels.job") == job)).first()
        assert (state["n"], state["v0"], state["v1"]) == (len(values), values[0], values[-1]) and state["lost"] == pytest.approx(lost)
        for q in (0.0, 0.1, 0.5, 0.99, 1.0):
            place, ordered = q * (len(values) - 1), sorted(values)
            lo, hi = ordered[math.floor(place)], ordered[math.ceil(place)]
            got = vector(evaluate(f'quantile_over_time({q}, m{{job="{job}"}}[{end + 1}ms])', samples, end + 1), "job")
            assert got[(job,)] == pytest.approx(lo + (hi - lo) * (place - math.floor(place)), rel=1e-12)


def test_matchers_reach_the_scan_and_the_series(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, i, float(i), i) for i in range(9)] + [("b", 2, i, 1.0, i) for i in range(9)] + [(None, 3, 5, 2.0, 1)], "job string, shard int, ms bigint, v double, at bigint")
    df.write.parquet(str(tmp_path / "t"))
    wide = Wide(spark.read.parquet(str(tmp_path / "t")), "m", ("job", "shard"), F.col("ms"), F.col("v"), F.col("at"))
    out = evaluate('sum_over_time(m{job="a"}[1h])', wide, 8)
    plan = out._jdf.queryExecution().toString()
    assert "EqualTo(job,a)" in plan and vector(out, "job", "shard") == {("a", "1"): 36.0}
    for matcher, want in (('job!="a"', {("b", "2"): 9.0, (None, "3"): 2.0}), ('shard=~"[23]"', {("b", "2"): 9.0, (None, "3"): 2.0}), ('job=""', {(None, "3"): 2.0}), ('other=""', 3), ('__name__="x"', {}), ('job!~"a|b"', {(None, "3"): 2.0})):
        got = vector(evaluate(f"sum_over_time(m{{{matcher}}}[1h])", wide, 8), "job", "shard")
        assert got == want or len(got) == want
    assert vector(evaluate("sum_over_time(k[1h])", wide, 8), "job") == {}
    series = spark.createDataFrame([(0, "m", {"__name__": "m", "job": "a"}), (1, "", {"__name__": "m", "job": "b"}), (2, None, None), (None, "m", {})], "id bigint, metric string, labels map<string,string>")
    raw = spark.createDataFrame([(0, 1, 1.0, 0), (1, 1, 2.0, 1), (9, 1, 4.0, 2), (None, 1, 8.0, 3), (0, None, 16.0, 4)], "series_id bigint, timestamp_ms bigint, value double, arrival bigint")
    assert vector(evaluate("sum_over_time(m[1h])", Interned(raw, series), 8), "job") == {("a",): 1.0, ("b",): 2.0}
    assert vector(evaluate('sum_over_time(m{job="b"}[1h])', Interned(raw, series), 8), "job") == {("b",): 2.0}


def test_items_and_their_weights(spark):
    rows = [({"__name__": "m", "job": "a", **({"user": u} if u else {})}, t * 1000, v) for t, (u, v) in enumerate([("x", 1.0), ("y", 5.0), ("x", 7.0), ("", 2.0), ("z", 5.0)])]
    samples = batch(spark, rows).withColumn("pane_end_ms", pane_end("ts_ms", 2000))
    for by_value, want in ((True, {("x",): 8.0, ("y",): 5.0, ("z",): 5.0, (None,): 2.0}), (False, {("x",): 2.0, ("y",): 1.0, ("z",): 1.0, (None,): 1.0})):
        family = family_of("sum_over_time", "items", item="user", by_value=by_value)
        states = family.merge(family.build(samples, ["pane_end_ms"]))
        assert vector(labelled(family.estimate(states, 0, 9, "")), "user") == want
    assert [r["item"] for r in family_of("", "items", item="user").heaviest(ItemWeights(item="user").build(samples), 2).orderBy("item").collect()] == ["x", "y"]
    distinct = DistinctItems(item="user")
    assert vector(labelled(distinct.estimate(distinct.merge(distinct.build(samples, ["pane_end_ms"])), 0, 9, "")), "job") == {("a",): 3.0}
    assert family_of("rate").name == "counter"
    register_family("late", lambda **p: Exact(name="late"))
    assert family_of("sum_over_time", "late").name == "late"
