"""The engine: pushed samples in, answers to planned queries out."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Mapping
from dataclasses import asdict, dataclass, replace
from urllib.parse import parse_qsl

from pyspark.sql import DataFrame, SparkSession

from tidepane.functions.promfmt import BadTime, error_response, parse_instant, vector_response
from tidepane.plans.plan import Plan
from tidepane.plans.promql import Ranking, parse
from tidepane.sources import remote_write
from tidepane.sources.samples import rows_to_samples
from tidepane.streaming.ingest import Ingestion, Options
from tidepane.streaming.serve import QueryEngine, Unanswered

#: Paths of the query interface.
INSTANT, RANGE = "/api/v1/query", "/api/v1/query_range"
#: Samples that may wait for ingestion.
MAX_QUEUED = 2_000_000
#: Series an answer may have; more are refused, as they would have to pass through the driver.
MAX_ROWS = 1_000_000


def admitted(queued: int, arriving: int, most: int = MAX_QUEUED) -> bool:
    """Whether a request may join the queue: always if it is empty, else while the total fits."""
    return queued == 0 or queued + arriving <= most


@dataclass(frozen=True)
class Reply:
    """Status code and body of a request; ``execution`` says how a query was answered. A forwarded reply has its headers and its bytes as they came."""

    status: int
    body: dict | None = None
    execution: str | None = None
    headers: tuple[tuple[str, str], ...] = ()
    raw: bytes | None = None


@dataclass(frozen=True)
class Incoming:
    """A request that may be forwarded: its path and parameters, and as it came its method, query text, body and headers."""

    path: str
    params: Mapping[str, str]
    method: str = "GET"
    url_query: str | None = None
    body: bytes = b""
    headers: tuple[tuple[str, str], ...] = ()


@dataclass
class _Waiting:
    rows: list[tuple[Mapping[str, str], int, float]]
    now_ms: int | None


class Engine:
    """One plan over one folder of panes.

    ``raw`` gives the sample table of retained raw samples, if there is one.
    ``forward`` answers what the plan does not; without it such a query is
    refused with the reason, and a plan with queries that can never run is not
    installed.

    Pushed requests are queued and taken in by a worker, all that wait as one
    batch, so senders do not wait for Spark. Ingestion and queries have locks of
    their own: a query reads what was committed and does not wait for a batch.
    """

    def __init__(self, spark: SparkSession, plan: Plan, path: str, options: Options = Options(), raw: Callable[[], DataFrame] | None = None, forward: Callable[[Incoming], Reply] | None = None, most_queued: int = MAX_QUEUED, most_rows: int = MAX_ROWS):
        self.spark, self.plan, self.forward = spark, plan.validate(), forward
        self.ingestion = Ingestion(spark, plan, path, options)
        self.queries = QueryEngine(plan, self.ingestion.store, raw)
        bad = self.queries.unexecutable()
        if bad and forward is None:
            raise ValueError(f"the plan has queries that cannot run: {bad}")
        self.writing, self.querying = threading.Lock(), threading.Lock()
        self.most_queued, self.most_rows = most_queued, most_rows
        self.answered = {"plan": 0, "forwarded": 0, "refused": 0}
        self.arrivals = 0
        self._changed = threading.Condition()  # guards all below
        self._queue: deque[_Waiting] = deque()
        self._queued, self._busy, self.running = 0, False, True
        #: What made the worker stop, if anything did.
        self.fault: Exception | None = None
        self._worker: threading.Thread | None = None

    def write(self, samples: DataFrame | Iterable[tuple[Mapping[str, str], int, float]], now_ms: int | None = None) -> None:
        """Ingest a sample table, or rows of (labels, ms, value) in order of arrival, at once."""
        with self.writing:
            if not isinstance(samples, DataFrame):
                rows = list(samples)
                if not rows:
                    return
                samples = rows_to_samples(self.spark, rows, self.arrivals)
                self.arrivals += len(rows)
            self.ingestion.ingest(samples, now_ms)

    def write_body(self, body: bytes, now_ms: int | None = None, limits: remote_write.Limits = remote_write.Limits()) -> Reply:
        """A pushed request: 204 queued, 400 invalid, 413 too large to read, 503 busy, 500 stopped."""
        if not self.ready():
            return Reply(500, error_response("internal", "the engine is stopped"))
        if len(body) > limits.max_compressed_bytes:
            return Reply(413, error_response("bad_data", "the request is too large"))
        try:
            rows = list(remote_write.rows(remote_write.decode(body, limits)))
        except remote_write.BadRequest as e:
            return Reply(400, error_response("bad_data", str(e)))
        if not rows:
            return Reply(204)
        with self._changed:
            if not admitted(self._queued, len(rows), self.most_queued):
                return Reply(503, error_response("unavailable", "too many samples are waiting"))
            self._queued += len(rows)
            self._queue.append(_Waiting(rows, now_ms))
            if self._worker is None:
                self._worker = threading.Thread(target=self._work, daemon=True)
                self._worker.start()
            self._changed.notify_all()
        return Reply(204)

    def _work(self) -> None:
        """Take in what waits, in order, until the engine stops."""
        while True:
            with self._changed:
                self._changed.wait_for(lambda: self._queue or not self.running)
                if not self._queue:
                    return
                now_ms = self._queue[0].now_ms
                taken: list[_Waiting] = []
                while self._queue and self._queue[0].now_ms == now_ms:
                    taken.append(self._queue.popleft())
                self._busy = True
            rows = [r for w in taken for r in w.rows]
            try:
                self.write(rows, now_ms)
            except Exception as e:
                with self._changed:
                    self.fault, self.running, self._busy = e, False, False
                    self._changed.notify_all()
                return
            with self._changed:
                self._queued -= len(rows)
                self._busy = False
                self._changed.notify_all()

    def flush(self, timeout_s: float | None = None) -> bool:
        """Wait until all that was queued is taken in; False if it was not in time, or the worker stopped before."""
        with self._changed:
            self._changed.wait_for(lambda: not (self._queue or self._busy) or self.fault is not None, timeout_s)
            return not (self._queue or self._busy) and self.fault is None

    def advance_watermark(self, time_ms: str | int | None, now_ms: int | None = None) -> Reply:
        """An event-time barrier, after all that was queued before it; anything but an integer is refused."""
        try:
            barrier = int(str(time_ms))
        except ValueError:
            return Reply(400, error_response("bad_data", f"time_ms must be an integer, not {time_ms!r}"))
        if not self.flush():
            return Reply(500, error_response("internal", "the engine is stopped"))
        with self.writing:
            return Reply(200, {"status": "success", "data": {"watermark_ms": self.ingestion.advance_watermark(barrier, now_ms)}})

    def vector(self, query: str, time_ms: int) -> DataFrame:
        """Answer of a planned query; :class:`Unanswered` says why there is none."""
        with self.querying:
            return self.queries.answer(query, time_ms, self.ingestion.progress())

    def query(self, query: str, time_ms: int | None = None, request: Incoming | None = None) -> Reply:
        """An instant query: answered by the plan, forwarded, or refused with the reason."""
        at = int(time.time() * 1000) if time_ms is None else time_ms
        try:
            rows = [(r["labels"], r["value"]) for r in self.vector(query, at).limit(self.most_rows + 1).collect()]
            if len(rows) > self.most_rows:
                raise Unanswered("execution", f"the answer has more than {self.most_rows} series")
            self._keep_built()
            self.answered["plan"] += 1
            outer = parse(query)
            return Reply(200, vector_response(at, rows, outer.op if isinstance(outer, Ranking) else None), "plan")
        except Unanswered as e:
            time_s = {} if time_ms is None else {"time": f"{time_ms / 1000:.3f}"}
            return self._otherwise(request or Incoming(INSTANT, {"query": query} | time_s), str(e))

    def _keep_built(self) -> None:
        """Commit panes an evaluation stored. While a batch is taken in, its own commit does so."""
        if self.ingestion.store.changed and self.writing.acquire(blocking=False):
            try:
                self.ingestion.commit()
            finally:
                self.writing.release()

    def _otherwise(self, request: Incoming, reason: str) -> Reply:
        if self.forward is None:
            self.answered["refused"] += 1
            return Reply(422, error_response("execution", reason), "refused")
        self.answered["forwarded"] += 1
        return replace(self.forward(request), execution="forwarded")

    def query_request(self, url_query: str = "", form: str = "", request: Incoming | None = None) -> Reply:
        """An instant query as a request carries it."""
        try:
            found = parse_instant(url_query, form)
        except BadTime as e:
            return Reply(400, error_response("bad_data", str(e)))
        if found is None:
            return self._otherwise(request or Incoming(INSTANT, dict(parse_qsl(f"{url_query}&{form}"))), "the request has no query, or its time has another format")
        return self.query(*found, request)

    def query_range(self, params: Mapping[str, str], request: Incoming | None = None) -> Reply:
        """Range queries are never planned."""
        return self._otherwise(request or Incoming(RANGE, params), "range queries are not planned")

    def status(self) -> dict:
        i = self.ingestion
        with self._changed:
            queued = self._queued
        return {"ingestion": asdict(i.counters), "queries": asdict(self.queries.counters), "answered": dict(self.answered), "panes": len(i.store), "watermark_ms": i.watermark_ms, "queued": queued}

    def ready(self) -> bool:
        """Whether requests are taken: the engine was not stopped, its worker has no fault, and Spark still runs."""
        return self.running and self.fault is None and self.spark.sparkContext._jsc is not None and not self.spark.sparkContext._jsc.sc().isStopped()

    def stop(self) -> None:
        """Take in what waits, and no more."""
        with self._changed:
            self.running = False
            self._changed.notify_all()
        if self._worker is not None:
            self._worker.join()
