import collections
import math
import random

import pytest

from tidepane.llm import percentiles as P

SAMPLES = "series_id bigint, value double, n bigint, metric string"
SERIES = "id bigint, metric string, labels map<string,string>, value double"
QS = (0.0, 0.25, 0.5, 0.9, 1.0)


def between(lo, hi, share):
    if lo == hi:
        return lo
    if math.isinf(lo) and math.isinf(hi):
        return math.nan
    return lo if math.isinf(lo) else hi if math.isinf(hi) else lo + (hi - lo) * share


def brute(rows, series, qs=QS):
    labels = {i: {"metric": m or "", **{g: (ls or {}).get(g) or "" for g in P.GROUP_LABELS}} for i, m, ls, _ in series if i is not None}
    groups = collections.defaultdict(list)
    for sid, v, _, _ in rows:
        if sid in labels and sid is not None and v is not None and not math.isnan(v):
            for d, g in labels[sid].items():
                groups[d, g].append(v + 0.0)
    out = {}
    for (d, g), vs in groups.items():
        vs.sort()
        for q in qs:
            r = q * (len(vs) - 1)
            out[d, g, q] = (len(vs), between(vs[math.floor(r)], vs[math.ceil(r)], r - math.floor(r)))
    return out


def tables(spark, seed, n=3000):
    r = random.Random(seed)
    series = [(i, r.choice(["m", "k", "", None]), None if i == 3 else {"job": r.choice(["a", ""]), "region": r.choice("xyz")}, 0.0) for i in range(30)] + [(None, "m", None, 0.0)]
    pick = lambda: r.choice([0, 0, None, 77, r.randint(0, 29)])
    rows = [(pick(), r.choice([None, math.nan, math.inf, -math.inf, -0.0, 0.0, 0.0, 0.0, r.uniform(-5, 5), float(r.randint(0, 9))]), 1, "x") for _ in range(n)]
    return spark.createDataFrame(rows, SAMPLES), spark.createDataFrame(series, SERIES), rows, series


def found(df):
    return {(r["dimension"], r["grp"], r["q"]): (r["n"], r["value"]) for r in df.collect()}


def same(got, want):
    assert set(got) == set(want)
    for k, (n, v) in want.items():
        assert got[k][0] == n and (got[k][1] == v or math.isnan(v) and math.isnan(got[k][1])), (k, got[k], (n, v))


@pytest.mark.parametrize("seed,n", [(1, 3000), (2, 40), (3, 1)])
def test_percentiles_are_exact(spark, seed, n):
    samples, series, rows, ls = tables(spark, seed, n)
    same(found(P.percentiles(P.value_runs(samples, series), quantiles=QS)), brute(rows, ls))


def test_days_unite(spark):
    samples, series, rows, ls = tables(spark, 4)
    one, two = P.value_runs(samples.where("series_id < 9"), series), P.value_runs(samples.where("series_id >= 9"), series)
    same(found(P.percentiles(P.merge_runs(one, two), quantiles=QS)), brute(rows, ls))


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(P, "BROADCAST_POSITIONS", 0)
    samples, series, rows, ls = tables(spark, 5)
    same(found(P.percentiles(P.value_runs(samples, series), quantiles=QS)), brute(rows, ls))


def test_empty(spark):
    samples, series, _, _ = tables(spark, 6, 20)
    assert P.percentiles(P.value_runs(samples.limit(0), series)).count() == 0
    assert P.percentiles(P.value_runs(samples, series.limit(0))).count() == 0
