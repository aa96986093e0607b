import http.server
import json
import threading
import urllib.error
import urllib.parse
import urllib.request

import pytest
from helpers import batch, series_rows, vector

from tidepane.engine import Engine, Incoming, Reply, admitted
from tidepane.http_api import EXECUTION_HEADER, forwarder, server
from tidepane.operators.evaluate import evaluate
from tidepane.plans.planner import Accuracy, Capabilities, RepeatingQuery, SourceStats, Workload, plan
from tidepane.sources import remote_write
from tidepane.streaming.ingest import Ingestion, Progress
from tidepane.streaming.panes import PaneStore
from tidepane.streaming.serve import QueryEngine, Unanswered
from tidepane.streaming.stream import sample_stream, start

M = 60_000
FAR = 10**13
NO_RAW = Capabilities(raw_data_retained=False)
P99 = "quantile_over_time(0.99, latency_ms[5m])"


def sums_plan(query="sum by (job) (sum_over_time(latency_ms[30m]))"):
    return plan(Workload((RepeatingQuery(query, 10 * M),), {}), NO_RAW)


@pytest.mark.parametrize("query", ["sum by (job) (sum_over_time(latency_ms[30m]))", "topk(1, sum by (job) (increase(latency_ms[30m])))", "avg(max_over_time(latency_ms[20m] offset 10m))", "rate(latency_ms[30m])"])
def test_panes_answer_as_raw_samples_do(spark, tmp_path, query):
    rows = series_rows("latency_ms", "ab", M, 75 * M, value=lambda i, t: float((i + 1) * (t // 15_000 % 240)))
    i = Ingestion(spark, sums_plan(query), str(tmp_path / "p"))
    samples = batch(spark, rows)
    i.ingest(samples, FAR)
    engine = QueryEngine(sums_plan(query), i.store)
    got, want = engine.answer(query, 70 * M, i.progress()), evaluate(query, samples, 70 * M)
    assert vector(got, "job") == pytest.approx(vector(want, "job"))


def test_why_a_query_is_not_answered(spark, tmp_path):
    p = sums_plan()
    q = p.queries[0].query
    i = Ingestion(spark, p, str(tmp_path / "p"))
    i.ingest(batch(spark, series_rows("latency_ms", "a", M, 75 * M)), FAR)
    engine = QueryEngine(p, i.store)
    for query, time_ms, kind, text in [("other", 70 * M, "not_planned", "planned"), (q, 70 * M + 1, "missing_pane", "multiples"), (q, 80 * M, "missing_pane", "no pane for"), (q, -(2**63) + 1, "unsupported", "range")]:
        with pytest.raises(Unanswered, match=text) as e:
            engine.answer(query, time_ms, i.progress())
        assert e.value.kind == kind
    prepared = engine.prepare(q, 70 * M)
    i.store.evict_before(p.stored[p.queries[0].definition].definition, 60 * M)
    with pytest.raises(Unanswered, match="removed"):
        engine.evaluate(prepared)


@pytest.fixture
def kept(spark, tmp_path):
    """A plan whose panes are built by queries, and raw samples for it."""
    p = plan(Workload((RepeatingQuery(P99, M, Accuracy(0.01, "rank", 0.01)),), {"latency_ms": SourceStats(10, None, 1)}))
    raw = batch(spark, series_rows("latency_ms", "ab", 0, 30 * M + 1, value=lambda i, t: float(100 * i + t // 15_000 * 25 % 101)))
    return p, QueryEngine(p, PaneStore(spark, str(tmp_path / "panes")), lambda: raw), raw


def test_queries_build_panes_and_use_them_again(kept):
    p, engine, raw = kept
    done = Progress(12 * M, {"latency_ms": 12 * M})
    first = vector(engine.answer(P99, 10 * M, done), "job")
    assert (engine.counters.built, engine.counters.kept, engine.counters.reused) == (5, 5, 0)
    again = vector(engine.answer(P99, 11 * M, done), "job")
    assert (engine.counters.built, engine.counters.reused) == (6, 4)
    for time_ms, got in ((10 * M, first), (11 * M, again)):
        exact = vector(evaluate("max_over_time(latency_ms[5m])", raw, time_ms), "job")
        assert got == exact  # 20 values a series: p99 is the largest
    assert engine.prepare(P99, 11 * M, done).windows == ()


def test_only_closed_panes_are_stored_and_progress_is_that_of_the_preparation(kept):
    p, engine, _ = kept
    engine.answer(P99, 10 * M, Progress(8 * M, {"latency_ms": 7 * M}))
    assert engine.counters.kept == 3 and engine.counters.stored_before_samples == 1
    prepared = engine.prepare(P99, 10 * M, Progress(None))
    assert [(w.start_ms, w.end_ms) for w in prepared.windows] == [(8 * M, 10 * M)]
    engine.evaluate(prepared)
    assert engine.counters.kept == 3


def test_panes_of_queries_are_evicted_by_retention(kept):
    p, engine, _ = kept
    (s,) = p.stored.values()
    engine.answer(P99, 10 * M, Progress(20 * M))
    assert engine.store.ends(s.definition) == []  # all end before 20 min less the retention of 5 min
    engine.answer(P99, 19 * M, Progress(20 * M))
    assert engine.store.ends(s.definition) == [k * M for k in range(15, 20)]
    prepared = engine.prepare(P99, 19 * M, Progress(20 * M))
    engine.store.evict_before(s.definition, 30 * M)
    with pytest.raises(Unanswered, match="removed"):
        engine.evaluate(prepared)


def test_a_pane_off_the_grid_is_built_by_a_query(kept):
    p, engine, raw = kept
    got = vector(engine.answer(P99, 10 * M + 7_000, Progress()), "job")
    assert got == vector(evaluate("max_over_time(latency_ms[5m])", raw, 10 * M + 7_000), "job")


def test_admission():
    assert admitted(0, 10**9) and admitted(5, 5, 10) and not admitted(6, 5, 10)


def body(rows):
    return remote_write.encode([(sorted(labels.items()), [(t, v)]) for labels, t, v in rows])


def test_engine_answers_forwards_and_refuses(spark, tmp_path):
    p = sums_plan()
    q = p.queries[0].query
    engine = Engine(spark, p, str(tmp_path / "e"))
    assert engine.write_body(body(series_rows("latency_ms", ["a"], M, 75 * M)), FAR) == Reply(204)
    assert engine.write_body(remote_write.encode([])) == Reply(204)
    assert engine.write_body(b"\xff\xff").status == 400
    assert engine.flush(120)
    reply = engine.query(q, 70 * M)
    assert reply.status == 200 and reply.execution == "plan"
    assert reply.body["data"]["result"] == [{"metric": {"job": "a"}, "value": [4200.0, str(sum(t for t in range(40 * M + 15_000, 70 * M + 1, 15_000)))]}]
    assert engine.query(q, 70 * M + 1).status == 422
    assert engine.query_range({"query": q}).execution == "refused"
    assert engine.query_request("query=x&time=1e30").status == 400
    assert engine.query_request("query=x&time=2020-01-01T00:00:00Z").execution == "refused"
    assert engine.advance_watermark("abc").status == 400 and engine.advance_watermark(80 * M, FAR).body["data"]["watermark_ms"] == 80 * M
    status = engine.status()
    assert status["answered"] == {"plan": 1, "forwarded": 0, "refused": 3} and status["ingestion"]["panes_built"] == 5
    with engine.writing:  # the worker waits, and what is queued counts
        engine.most_queued = 5
        assert engine.write_body(body(series_rows("latency_ms", ["a"], 90 * M, 91 * M)), FAR).status == 204
        assert engine.write_body(body(series_rows("latency_ms", ["a"], 91 * M, 92 * M)), FAR).status == 503
        assert engine.status()["queued"] == 4
        assert engine.query(q, 70 * M).execution == "plan"  # queries do not wait for it
    engine.most_rows = 0
    assert engine.query(q, 70 * M).status == 422
    engine.stop()
    assert engine.write_body(b"").status == 500 and not engine.ready()
    other = Engine(spark, p, str(tmp_path / "f"), forward=lambda r: Reply(200, {r.path: dict(r.params)}))
    assert other.query("up", 1500) == Reply(200, {"/api/v1/query": {"query": "up", "time": "1.500"}}, "forwarded")
    assert other.query_range({"query": "up", "start": "0"}).body == {"/api/v1/query_range": {"query": "up", "start": "0"}}
    with pytest.raises(ValueError):
        Engine(spark, plan(Workload((RepeatingQuery("latency_ms", M),), {})), str(tmp_path / "g"))


def test_http(spark, tmp_path):
    p = sums_plan()
    engine = Engine(spark, p, str(tmp_path / "h"))
    web = server(engine)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{web.server_port}"

    def call(path, data=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, data=data, method="POST" if data is not None else "GET")) as r:
                return r.status, r.headers, json.loads(r.read() or b"null")
        except urllib.error.HTTPError as e:
            return e.code, e.headers, json.loads(e.read() or b"null")

    try:
        assert call("/-/ready")[0] == 200
        assert call("/api/v1/write", body(series_rows("latency_ms", ["a"], M, 75 * M)))[0] == 204
        assert engine.flush(120)
        query = urllib.parse.urlencode({"query": p.queries[0].query, "time": 4200})
        status, headers, answer = call("/api/v1/query?" + query)
        assert (status, headers[EXECUTION_HEADER]) == (200, "plan") and len(answer["data"]["result"]) == 1
        assert call("/api/v1/query", query.encode())[2] == answer
        assert call("/api/v1/query_range?query=x")[0] == 422
        assert call("/api/v1/precompute/watermark?time_ms=x", b"")[0] == 400
        assert call("/api/v1/status/engine")[2]["data"]["answered"]["plan"] == 2
        assert call("/nothing")[0] == 404
        front = Engine(spark, p, str(tmp_path / "front"), forward=forwarder(base, 30))
        forwarded = front.query(p.queries[0].query, 4_200_000)  # it has no panes itself
        assert (forwarded.status, forwarded.execution) == (200, "forwarded") and forwarded.body == answer
        assert front.query("up", 0).status == 422
        assert forwarder("http://127.0.0.1:9", 1)(Incoming("/api/v1/query", {})).status == 502
        outer = server(front)
        threading.Thread(target=outer.serve_forever, daemon=True).start()
        asked = urllib.request.Request(f"http://127.0.0.1:{outer.server_port}/api/v1/query", data=query.encode(), method="POST", headers={"x-team": "a", "connection": "x-hop", "x-hop": "1"})
        with urllib.request.urlopen(asked) as r:
            assert json.loads(r.read()) == answer and r.headers.get_all(EXECUTION_HEADER) == ["forwarded"] and r.headers["content-type"] == "application/json"
        outer.shutdown()
    finally:
        web.shutdown()


def test_forwarding_keeps_method_body_and_headers():
    seen = []

    class Other(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.command, self.path, self.rfile.read(int(self.headers["content-length"])), {k.lower(): v for k, v in self.headers.items()}))
            self.send_response(418)
            self.send_header("x-answer", "yes")
            self.send_header("content-length", "3")
            self.end_headers()
            self.wfile.write(b"tea")

        def log_message(self, *args):
            pass

    web = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Other)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    try:
        sent = (("X-Team", "a"), ("Connection", "x-hop"), ("X-Hop", "1"), ("Content-Type", "application/x-www-form-urlencoded"))
        got = forwarder(f"http://127.0.0.1:{web.server_port}")(Incoming("/api/v1/query", {"query": "up"}, "POST", "a=b", b"query=up", sent))
    finally:
        web.shutdown()
    method, path, data, headers = seen[0]
    assert (method, path, data) == ("POST", "/api/v1/query?a=b", b"query=up") and headers["x-team"] == "a" and "x-hop" not in headers
    assert (got.status, got.raw, dict(got.headers)["x-answer"]) == (418, b"tea", "yes")


def test_a_worker_that_fails_makes_the_engine_unready(spark, tmp_path):
    engine = Engine(spark, sums_plan(), str(tmp_path / "e"))
    engine.ingestion.ingest = lambda *a: 1 / 0
    assert engine.write_body(body(series_rows("latency_ms", ["a"], M, 2 * M))).status == 204
    assert not engine.flush(60) and not engine.ready() and engine.write_body(b"").status == 500


def test_a_stream_gives_the_same_panes_as_batches(spark, tmp_path):
    p = sums_plan()
    (s,) = p.stored.values()
    rows = series_rows("latency_ms", "ab", M, 45 * M)
    source = tmp_path / "in"
    for k, cut in enumerate(range(0, len(rows), 120)):
        batch(spark, rows[cut : cut + 120]).coalesce(1).write.parquet(str(source / f"x{k}"))
    flat = tmp_path / "flat"
    flat.mkdir()
    for k, f in enumerate(sorted(source.glob("x*/part-*"), key=lambda f: int(f.parent.name[1:]))):
        f.rename(flat / f"{k:04}.parquet")
    streamed, replayed = Ingestion(spark, p, str(tmp_path / "s")), Ingestion(spark, p, str(tmp_path / "r"))
    for _ in range(2):  # the second run finds nothing new
        query = start(sample_stream(spark, str(flat)), streamed, str(tmp_path / "ck"), FAR, once=True)
        query.awaitTermination()
    replayed.ingest(spark.read.schema("metric string, labels map<string,string>, series string, ts_ms bigint, value double, is_stale boolean, arrival bigint").parquet(str(flat)), FAR)
    ends = replayed.store.ends(s.definition)
    assert streamed.store.ends(s.definition) == ends and len(ends) == 3
    assert sorted(map(tuple, streamed.store.read(s.definition, ends).collect())) == sorted(map(tuple, replayed.store.read(s.definition, ends).collect()))
