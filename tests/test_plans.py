import json
from dataclasses import replace

import pytest

from tidepane.plans.plan import INGESTION, QUERY, Definition, Plan, PlanError, PlannedQuery, Stored, merged
from tidepane.plans.planner import Accuracy, Capabilities, RepeatingQuery, Settings, SourceStats, Workload, plan

M = 60_000
NO_RAW = Capabilities(raw_data_retained=False)


def workload(*queries, **sources):
    return Workload(tuple(queries), {k: v for k, v in sources.items()})


def rank(query, interval):
    return RepeatingQuery(query, interval, Accuracy(0.01, "rank", 0.01))


def relative(query, interval=1000, error=0.05):
    return RepeatingQuery(query, interval, Accuracy(error))


# Query texts, intervals and sizes of the workloads a plan has to be found for (fixed values).
RATES = workload(RepeatingQuery("sum by (job) (rate(http_requests_total[1m]))", 10_000), RepeatingQuery("topk by (job) (10, sum_over_time(http_requests_total[1m]))", 10_000, Accuracy(0.01)), http_requests_total=SourceStats(1_000_000, "counter", 15_000))


def test_with_raw_samples_nothing_is_stored_for_rates():
    p = plan(RATES)
    assert not p.stored and [q.query for q in p.queries] == [q.query for q in RATES.queries]


def test_without_raw_samples_panes_fit_range_and_interval():
    p = plan(RATES, NO_RAW)
    assert {(s.definition.family, s.definition.pane_ms, s.built_at) for s in p.stored.values()} == {("counter", 10_000, INGESTION), ("exact", 10_000, INGESTION)}
    hourly = plan(workload(rank("quantile_over_time(0.99, latency_ms[60m])", 10 * M), latency_ms=SourceStats(1000, None, 1000)), NO_RAW)
    (s,) = hourly.stored.values()
    assert (s.definition.family, s.definition.pane_ms, s.retention_ms) == ("kll", 10 * M, 60 * M)
    assert hourly.queries[0].ends(100 * M, s.definition.pane_ms) == [k * 10 * M for k in range(5, 11)]
    assert dict(s.definition.parameters)["k"] >= 269


def test_dense_samples_are_kept_as_panes_built_by_queries():
    p = plan(workload(rank("quantile_over_time(0.99, latency_ms[5m])", M), latency_ms=SourceStats(10, None, 1)))
    (s,) = p.stored.values()
    assert (s.built_at, s.definition.pane_ms, s.retention_ms) == (QUERY, M, 5 * M)
    sparse = plan(workload(rank("quantile_over_time(0.99, latency_ms[60m])", 10 * M), latency_ms=SourceStats(1000, None, 1000)))
    assert not sparse.stored
    assert not plan(workload(rank("quantile_over_time(0.99, latency_ms[5m])", M), latency_ms=SourceStats(10, None, 1)), Capabilities(query_time_results_retained=False)).stored


def test_one_query_without_a_plan_refuses_all():
    good = rank("quantile_over_time(0.99, latency_ms[60m])", 10 * M)
    with pytest.raises(PlanError):
        plan(workload(good, RepeatingQuery("latency_ms", M)), NO_RAW)
    with pytest.raises(PlanError):
        plan(replace(workload(good), language="sql"))
    with pytest.raises(PlanError):
        plan(workload(good, RepeatingQuery("latency_ms +", M)))
    with pytest.raises(PlanError):
        plan(workload(RepeatingQuery("quantile_over_time(0.9, x[1m])", M)), NO_RAW)
    with pytest.raises(PlanError):
        plan(workload(good), replace(NO_RAW, supported_summaries=frozenset({"exact"})))


def test_guarantees_through_outer_aggregations():
    average = relative("avg by (job) (quantile_over_time(0.99, data[100s]))")
    with pytest.raises(PlanError):
        plan(workload(average, data=SourceStats(1000, "gauge", 100)), NO_RAW)
    assert plan(workload(average, data=SourceStats(1000, "gauge", 100, True)), NO_RAW).accepted_without_guarantee == []
    assert plan(workload(average, data=SourceStats(1000, "gauge", 100)), NO_RAW, Settings(True)).accepted_without_guarantee == [0]
    top = relative("max by (job) (quantile_over_time(0.99, data[100s]))")
    (s,) = plan(workload(top, data=SourceStats(1000, "gauge", 100)), NO_RAW).stored.values()
    assert s.definition.family == "ddsketch" and s.definition.pane_ms == 1000


def test_queries_share_summaries_and_widths_stay_apart():
    shared = plan(workload(relative("quantile_over_time(0.9, data[100s])", 10_000), relative("avg by (region) (quantile_over_time(0.99, data[100s]))", 10_000), data=SourceStats(6, "gauge", 10_000, True)), NO_RAW)
    assert len(shared.stored) == 1
    apart = plan(workload(relative("topk by (r) (4, sum_over_time(data[1m]))", 1000), relative("topk by (r) (4, sum_over_time(data[20m]))", 30_000)), NO_RAW)
    assert {s.definition.pane_ms for s in apart.stored.values()} == {1000, 30_000}
    other = plan(workload(relative("sum_over_time(data[1m])", M), relative('sum_over_time(data{job="a"}[1m])', M)), NO_RAW)
    assert len(other.stored) == 2


def test_plans_survive_their_file(tmp_path):
    p = plan(RATES, NO_RAW)
    p.save(str(tmp_path / "plan.json"))
    again = Plan.load(str(tmp_path / "plan.json"))
    assert again == p
    raw = json.loads(p.to_json())
    raw["stored"].pop()
    (tmp_path / "plan.json").write_text(json.dumps(raw))
    with pytest.raises(PlanError):
        Plan.load(str(tmp_path / "plan.json"))


def test_workload_json():
    w = Workload.from_dict({"query_workload": {"language": "promql", "query_batch": None, "repeating_queries": [{"query": "x", "demand": {"fixed_interval": 5}, "requirements": {"accuracy": {"accuracy_metric": "rank", "max_error": 0.01, "failure_probability": 0.01}, "max_latency_ms": 200.0}}]}, "data_workload": {"arrival": {"ingesting": {"rows_per_second": 10.0}}, "sources": {"x": {"series_count": 3, "sample_interval": 7, "metric_type": None}}}})
    assert w.queries[0] == RepeatingQuery("x", 5, Accuracy(0.01, "rank", 0.01), 200.0) and w.sources["x"].sample_interval_ms == 7 and w.rows_per_second == 10
    assert Workload.from_dict({"query_workload": {"language": {"sql": "x"}}}).language == "other"


def test_installation_checks():
    a, b = Definition("m", (), "exact", (), 1000), Definition("m", (), "exact", (), 2000)
    with pytest.raises(PlanError, match="cycle"):
        Plan([], {a.key: Stored(a, INGESTION, 1, (b.key,)), b.key: Stored(b, INGESTION, 1, (a.key,))}).validate()
    with pytest.raises(PlanError, match="built by a query"):
        Plan([], {a.key: Stored(a, INGESTION, 1, (b.key,)), b.key: Stored(b, QUERY, 1)}).validate()
    with pytest.raises(PlanError, match="width"):
        z = replace(a, pane_ms=0)
        Plan([], {z.key: Stored(z, INGESTION, 1)}).validate()
    with pytest.raises(PlanError, match="retention"):
        Plan([], {a.key: Stored(a, INGESTION, 2**63)}).validate()
    with pytest.raises(PlanError, match="unknown"):
        Plan([PlannedQuery("sum_over_time(m[2s])", "gone")]).validate()
    with pytest.raises(PlanError, match="does not match"):
        Plan([PlannedQuery("sum_over_time(other[2s])", a.key)], {a.key: Stored(a, INGESTION, 1)}).validate()
    with pytest.raises(PlanError, match="multiple"):
        Plan([PlannedQuery("sum_over_time(m[1500ms])", a.key)], {a.key: Stored(a, INGESTION, 1)}).validate()
    one = merged([Stored(a, QUERY, 5), Stored(a, INGESTION, 3)])[a.key]
    assert (one.built_at, one.retention_ms) == (INGESTION, 5)


def test_command_line(tmp_path, capsys):
    from tidepane.__main__ import main

    work = {"query_workload": {"language": "promql", "repeating_queries": [{"query": "sum_over_time(m[1m])", "demand": {"fixed_interval": 10_000}}]}}
    (tmp_path / "w.json").write_text(json.dumps(work))
    assert main(["plan", str(tmp_path / "w.json"), str(tmp_path / "p.json"), "--no-raw-data"]) == 0
    assert len(Plan.load(str(tmp_path / "p.json")).stored) == 1 and "1 queries" in capsys.readouterr().out
    work["query_workload"]["repeating_queries"][0]["query"] = "m"
    (tmp_path / "w.json").write_text(json.dumps(work))
    assert main(["plan", str(tmp_path / "w.json"), str(tmp_path / "p.json"), "--no-raw-data"]) == 1


def test_costs_decide():
    """A query that raw samples answer too slowly gets panes; one nothing answers in time is refused; measured costs count."""
    stats = {"m": SourceStats(1_000_000, "gauge", 1000)}
    q = lambda latency: Workload((RepeatingQuery("sum_over_time(m[1h])", 60_000, None, latency),), stats)
    assert not plan(q(None)).stored and not plan(q(1e6)).stored
    (s,) = plan(q(5_000)).stored.values()  # 3.6e9 samples, but 6e7 states
    assert (s.built_at, s.definition.pane_ms) == (QUERY, 60_000)
    with pytest.raises(PlanError):
        plan(q(100))
    assert not plan(q(100), settings=Settings(measured={"raw": 1e-12})).stored
    assert plan(q(100), settings=Settings(measured={"exact": 1e-12})).stored
    with pytest.raises(PlanError):
        plan(q(100), Capabilities(raw_data_retained=False))


def test_rarer_failures_need_larger_sketches():
    size = lambda failure: dict(next(iter(plan(Workload((RepeatingQuery("quantile_over_time(0.9, m[1h])", 60_000, Accuracy(0.01, "rank", failure)),), {}), Capabilities(raw_data_retained=False)).stored.values())).definition.parameters)["k"]
    assert size(0.01) == size(0.05) == size(0.0) < size(0.001) < size(1e-6)
