import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidepane.llm import bitmaps

SAMPLES = "series_id bigint, timestamp_ms bigint, counted string"
SERIES = "id bigint, labels map<string,string>, day string"
DAY = bitmaps.DAY_MS


def tables(spark, seed, ids=120):
    r = random.Random(seed)
    series = []
    for i in range(ids):
        labels = None if r.random() < 0.03 else {k: v for k, v in {"region": r.choice(["r1", "r2", ""]), "job": r.choice("ab"), "service": "hot" if r.random() < 0.5 else r.choice("xyz"), "instance": r.choice(["", f"i{i % 17}"]), "pod": f"p{r.randint(0, 90)}"}.items() if r.random() < 0.9}
        series.append((i, labels, "x"))
    series.append((None, {"region": "r1"}, "x"))
    rows = [(r.choice([None, 0, 0, 0, ids + 5, r.randint(0, ids - 1)]), r.choice([None, -1, r.randint(0, 3 * DAY), r.randint(0, 3 * DAY)]), "x") for _ in range(1500)]
    return spark.createDataFrame(rows, SAMPLES), spark.createDataFrame(series, SERIES), rows, {i: labels or {} for i, labels, _ in series if i is not None}


def brute(rows, labels, days_apart=True):
    sets = collections.defaultdict(lambda: [set(), set(), set()])
    for sid, ts, _ in rows:
        if sid is None or ts is None or sid not in labels:
            continue
        own = labels[sid]
        group = tuple(own.get(k) or "" for k in bitmaps.GROUP_LABELS)
        for mask in itertools.product([0, 1], repeat=3):
            key = tuple(g if m else None for g, m in zip(group, mask, strict=True))
            s = sets[(ts // DAY, *key) if days_apart else key]
            for got, x in zip(s, (sid, own.get("instance"), own.get("pod")), strict=True):
                if x or x == 0:
                    got.add(x)
    return {k: tuple(map(len, v)) for k, v in sets.items()}


def counted(df, *keys):
    return {tuple(r[k] for k in keys): (r["n_series"], r["n_instance"], r["n_pod"]) for r in df.collect()}


def daily(samples, series):
    book = bitmaps.codebook(series)
    return bitmaps.unpack(bitmaps.daily_bitmaps(samples, bitmaps.coded_series(series, book))), book


def per_day(words, book):
    return bitmaps.counts_by_kind(bitmaps.united_groups(words, ["counted", "day"]), ["day", *bitmaps.GROUP_LABELS], book)


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_are_exact(spark, seed, monkeypatch):
    samples, series, rows, labels = tables(spark, seed)
    words, book = daily(samples, series)
    assert counted(per_day(words, book), "day", *bitmaps.GROUP_LABELS) == brute(rows, labels)
    monkeypatch.setattr(bitmaps, "BROADCAST_LABELS", 0)
    assert counted(per_day(words, book), "day", *bitmaps.GROUP_LABELS) == brute(rows, labels)


def test_days_built_apart_unite_and_intersect(spark):
    samples, series, rows, labels = tables(spark, 3)
    book = bitmaps.codebook(series)
    coded = bitmaps.coded_series(series, book)
    stored = [bitmaps.daily_bitmaps(samples.where(f"timestamp_ms div {DAY} = {d} AND timestamp_ms >= 0"), coded) for d in range(4)]
    stored.append(bitmaps.daily_bitmaps(samples.where("timestamp_ms < 0"), coded))
    words = bitmaps.unpack(stored[0])
    for s in stored[1:]:
        words = words.unionByName(bitmaps.unpack(s))
    united = bitmaps.counts_by_kind(bitmaps.united_groups(words, ["counted"]), bitmaps.GROUP_LABELS, book)
    assert counted(united, *bitmaps.GROUP_LABELS) == brute(rows, labels, False)
    one = bitmaps.unite(words.where("day = 0 AND counted = 0"), ["counted"])
    two = bitmaps.unite(words.where("day = 1 AND counted = 0"), ["counted"])
    both = bitmaps.cardinality(bitmaps.intersect(one, two, ["counted"]), ["counted"]).first()["n"]
    on = lambda d: {s for s, t, _ in rows if s in labels and t is not None and t // DAY == d}
    assert both == len(on(0) & on(1))


def test_codes_are_dense_and_extend(spark):
    samples, series, rows, labels = tables(spark, 4)
    known = bitmaps.codebook(series.where("id < 60"))
    more = bitmaps.codebook(series.where("id >= 20"), known)
    codes = lambda df: {r["key"]: r["code"] for r in df.codes.collect()}
    a, b = codes(known), codes(more)
    assert all(b[k] == v for k, v in a.items()) and len(b) > len(a)
    for kind in (*bitmaps.COUNTED, *bitmaps.GROUP_LABELS):
        of = sorted(v for k, v in b.items() if k.startswith(f"{kind}="))
        assert of == list(range(len(of)))
    assert sum(k.startswith("series=") for k in b) == len(labels)
    uses = {r["key"]: r["uses"] for r in more.codes.collect()}
    assert uses["job="] == sum(not v.get("job") for k, v in labels.items() if k >= 20) and all(uses[f"series={i}"] == (i >= 20) for i in labels)
    words = bitmaps.unpack(bitmaps.daily_bitmaps(samples, bitmaps.coded_series(series, more)))
    assert counted(per_day(words, more), "day", *bitmaps.GROUP_LABELS) == brute(rows, labels)


def test_numbers_without_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    got = sorted((r["v"], r["n"]) for r in bitmaps.numbered(df, ["v"], "n", "t").collect())
    assert got == [(i, i) for i in range(1000)]


def test_related_identifiers_share_words(spark):
    series = spark.range(6400).select("id", F.create_map(F.lit("region"), (F.col("id") % 10).cast("string"), F.lit("pod"), F.concat(F.lit("p"), F.col("id").cast("string"))).alias("labels"))
    samples = spark.range(6400).select(F.col("id").alias("series_id"), F.lit(5).cast("bigint").alias("timestamp_ms"))
    words, _ = daily(samples, series)
    assert words.where("counted = 2").count() <= 10 * (640 // 64 + 1)


def test_empty_tables(spark):
    samples, series, _, _ = tables(spark, 5)
    for a, b in ((samples.limit(0), series), (samples, series.limit(0))):
        words, book = daily(a, b)
        assert per_day(words, book).count() == 0
