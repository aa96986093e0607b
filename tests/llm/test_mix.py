import collections

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidepane.llm.mix import Node, mix, plan
from tidepane.llm.tokens import vocabulary

DOCS = "doc_id bigint, text string, lang string, source string, epoch string"
TARGETS = "source string, target_share double, max_repeats int"


def docs(spark, sizes, extra=()):
    rows, n = list(extra), 0
    for (source, lang), count in sizes.items():
        for i in range(count):
            rows.append((n, "word " * (3 + i % 7), lang, source, "x"))
            n += 1
    return spark.createDataFrame(rows, DOCS), rows


def run(spark, sizes, targets, **options):
    df, rows = docs(spark, sizes, [(900, None, "en", "a", "x"), (901, "", "en", "a", "x"), (902, "hi there", None, None, "x"), (903, "hi there", "en", "other", "x")])
    m = mix(df, spark.createDataFrame(targets, TARGETS), **options)
    used = m.selected.collect()
    shares = {r["source"]: r for r in m.shares.collect()}
    tokens = {r[0]: len(vocabulary().whole(r[1] or "")) for r in rows}
    source_of = {r[0]: r[3] for r in rows}
    repeats = {t[0]: t[2] for t in targets}
    per_doc = collections.Counter(r["doc_id"] for r in used)
    for d, n in per_doc.items():
        assert n <= repeats[source_of[d]] and tokens[d] > 0
    for s in shares:
        uses = [per_doc[d] for d in tokens if source_of[d] == s and tokens[d]]
        by_lang = collections.defaultdict(list)
        for r in rows:
            if r[3] == s and tokens[r[0]]:
                by_lang[r[2]].append(per_doc[r[0]])
        for counts in by_lang.values():
            assert max(counts) - min(counts) <= 1  # nobody comes a second time before all came once
        assert not uses or sum(r["n_tokens"] for r in used if r["source"] == s) == shares[s]["mix_tokens"]
    total = sum(r["n_tokens"] for r in used)
    for s, r in shares.items():
        assert r["actual_share"] == pytest.approx(r["mix_tokens"] / total if total else 0.0)
    return shares, used, total


def test_shares_are_met_as_far_as_repeats_allow(spark):
    sizes = {("a", "en"): 300, ("a", "de"): 200, ("b", "en"): 100, ("c", "xx"): 40}
    targets = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.19, 4), ("empty", 0.01, 5)]
    shares, _, total = run(spark, sizes, targets)
    for s, want in (("a", 0.5 / 0.99), ("b", 0.3 / 0.99), ("c", 0.19 / 0.99), ("empty", 0.0)):
        assert shares[s]["actual_share"] == pytest.approx(want, abs=0.01)
    assert shares["empty"]["documents"] == 0 and max(r["epochs"] for r in shares.values()) > 1


def test_a_given_size_redistributes_the_shortage(spark):
    sizes = {("a", "en"): 300, ("b", "en"): 10}
    shares, _, total = run(spark, sizes, [("a", 0.5, 1), ("b", 0.5, 2)], total_tokens=600)
    assert shares["b"]["mix_tokens"] == 2 * shares["b"]["available_tokens"] and shares["b"]["epochs"] == 2
    assert total == pytest.approx(600, abs=10)


def test_passes_set_the_size(spark):
    shares, _, total = run(spark, {("a", "en"): 100, ("b", "en"): 20}, [("a", 0.5, 3), ("b", 0.5, 2)], passes=1.0)
    have = sum(r["available_tokens"] for r in shares.values())
    assert total == pytest.approx(have, abs=10) and shares["b"]["mix_tokens"] == 2 * shares["b"]["available_tokens"]


def test_a_tiny_source_does_not_shrink_the_mix(spark):
    """One document with half of all shares: the mix keeps a quarter of what there is, and the report says who is exhausted."""
    shares, _, total = run(spark, {("a", "en"): 400, ("b", "en"): 1}, [("a", 0.5, 1), ("b", 0.5, 2)])
    have = sum(r["available_tokens"] for r in shares.values())
    assert total == pytest.approx(0.25 * have, abs=10)
    assert shares["b"]["exhausted"] and not shares["a"]["exhausted"]
    shares, _, total = run(spark, {("a", "en"): 400, ("b", "en"): 1}, [("a", 0.5, 1), ("b", 0.5, 2)], least_passes=0.0)
    assert total < 40


def test_stored_sizes_are_taken(spark):
    df, _ = docs(spark, {("a", "en"): 60, ("b", "en"): 60})
    targets = spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 1)], TARGETS)
    one = mix(df, targets)
    again = mix(df.drop("text"), targets, sizes=one.sizes)
    assert sorted(map(tuple, one.selected.collect())) == sorted(map(tuple, again.selected.collect()))


def test_many_leaves_are_planned_quickly():
    root = Node("root")
    for i in range(100_000):
        root.add(("d", f"l{i % 100}", f"s{i}"), 1.0 + i % 7, float(i % 50))
    root.assign(1_000_000.0)
    assert sum(root.leaves().values()) == pytest.approx(1_000_000.0)


def test_the_seed_decides(spark):
    sizes = {("a", "en"): 60, ("b", "en"): 60}
    one = sorted(map(tuple, run(spark, sizes, [("a", 0.9, 1), ("b", 0.1, 1)])[1]))
    again = sorted(map(tuple, run(spark, sizes, [("a", 0.9, 1), ("b", 0.1, 1)])[1]))
    other = sorted(map(tuple, run(spark, sizes, [("a", 0.9, 1), ("b", 0.1, 1)], seed=5)[1]))
    assert one == again != other


def test_nothing_to_mix(spark):
    df, _ = docs(spark, {("a", "en"): 3})
    for d, t in ((df.limit(0), [("a", 1.0, 1)]), (df, [("z", 1.0, 1)]), (df, [("a", 0.0, 1)]), (df, [("a", 1.0, 0)]), (df, [(None, 1.0, 1)]), (df, [("a", None, None)])):
        assert mix(d, spark.createDataFrame(t, TARGETS)).selected.count() == 0
    assert mix(df, spark.createDataFrame([], TARGETS)).shares.count() == 0


def test_siblings_make_up_shortages_before_ancestors():
    root = Node("root")
    root.add(("d1", "en", "a"), 0.4, 10)
    root.add(("d1", "en", "b"), 0.1, 100)
    root.add(("d2", "en", "c"), 0.5, 100)
    root.assign(100)
    assert root.leaves() == {("d1", "en", "a"): 10, ("d1", "en", "b"): 40, ("d2", "en", "c"): 50}
    root.assign(150)
    assert root.leaves() == {("d1", "en", "a"): 10, ("d1", "en", "b"): 65, ("d2", "en", "c"): 75}


@given(st.dictionaries(st.tuples(st.sampled_from("de"), st.sampled_from("xy"), st.sampled_from("pqrs")), st.integers(1, 1000), min_size=1), st.floats(1, 5000))
def test_plans_fit(leaves, total):
    rows = [(*k, v) for k, v in leaves.items()]
    targets = {s: (0.1 + i, 1 + i) for i, s in enumerate("pqrs")}
    budgets = plan(rows, targets, total)
    capacity = sum(v * targets[k[2]][1] for k, v in leaves.items())
    assert sum(budgets.values()) == pytest.approx(min(total, capacity))
    assert all(budgets[k] <= leaves[k] * targets[k[2]][1] + 1e-6 for k in budgets)
    exact = plan(rows, targets)
    assert plan(rows, targets, None, 0.0) == exact
    size, usable = sum(exact.values()), {k[2] for k in leaves}
    for s in usable:
        share = sum(v for k, v in exact.items() if k[2] == s) / size
        assert share == pytest.approx(targets[s][0] / sum(targets[x][0] for x in usable))
