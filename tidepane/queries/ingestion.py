"""What happens to samples on their way into panes, and queries answered from the panes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepane.functions import promfmt
from tidepane.http_api import header_text
from tidepane.operators.evaluate import evaluate
from tidepane.plans.plan import INGESTION, QUERY, Definition, Plan, PlanError, PlannedQuery, Stored
from tidepane.plans.planner import Accuracy, Capabilities, RepeatingQuery, SourceStats, Workload, plan
from tidepane.plans.promql import Matcher, leaf, parse, selector_text
from tidepane.queries.compare import quantised, quantised_sql
from tidepane.queries.metrics import _EVENTS, COUNTER, DAY, T_EVENTS, events, flat, stored
from tidepane.session import scratch_path
from tidepane.sources import remote_write
from tidepane.sources.tables import table
from tidepane.streaming.ingest import Ingestion, Options, Progress
from tidepane.streaming.panes import PaneStore
from tidepane.streaming.serve import QueryEngine, Unanswered

HOUR = 3_600_000
#: A clock after all data.
CLOCK = 10**13
#: Arrivals are ingested in two batches, cut here (2026-03-05T00:00Z by time of the request).
CUT = "2026-03-05 00:00:00"
DEFINITION = Definition(COUNTER, (), "exact", (), HOUR)
RETENTION = 48 * HOUR


def _ingested(spark: SparkSession, folder: str) -> Ingestion:
    """The samples of one metric, and as unrouted ones all others, ingested in two batches."""
    ingestion = Ingestion(spark, Plan([], {DEFINITION.key: Stored(DEFINITION, INGESTION, RETENTION)}), scratch_path(spark, "ingest"))
    samples = stored(spark, folder)
    received = spark.read.parquet(f"{folder}/samples.parquet").select("arrival", (F.col("received_at") < F.lit(CUT).cast("timestamp_ntz")).alias("early"))
    both = samples.join(received, "arrival")
    ingestion.ingest(both.where("early").drop("early"), CLOCK, 0)
    ingestion.ingest(both.where("NOT early").drop("early"), CLOCK, 1)
    return ingestion


def ingest_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    c = _ingested(spark, folder).counters
    rows = [("accepted", c.accepted), ("late", c.late), ("duplicate", c.duplicate), ("first_pane", c.first_pane), ("future", c.ahead), ("unrouted", c.unrouted)]
    return spark.createDataFrame(rows, "outcome string, n bigint")


def ingest_panes(spark: SparkSession, folder: str) -> DataFrame:
    """Kept panes, also empty ones, with their samples and sums over all series."""
    ingestion = _ingested(spark, folder)
    ends = ingestion.store.ends(DEFINITION)
    sums = ingestion.store.read(DEFINITION, ends).groupBy("pane_end_ms").agg(F.sum("n").alias("n"), F.sum("sum").alias("total"))
    every = spark.createDataFrame([(e,) for e in ends], "pane_end_ms bigint")
    return every.join(sums, "pane_end_ms", "left").select("pane_end_ms", F.coalesce("n", F.lit(0)).alias("n"), quantised("total"))


def _planned(query: str, spark: SparkSession, folder: str) -> tuple[QueryEngine, Ingestion]:
    p = plan(Workload((RepeatingQuery(query, DAY),), {}), Capabilities(raw_data_retained=False))
    ingestion = Ingestion(spark, p, scratch_path(spark, "planned"))
    ingestion.ingest(events(spark, folder), CLOCK)
    return QueryEngine(p, ingestion.store), ingestion


def planned_sum_by(spark: SparkSession, folder: str) -> DataFrame:
    """Answered from daily panes built at ingestion, at the newest closed day."""
    query = "sum by (event_type) (sum_over_time(events_value[7d]))"
    engine, ingestion = _planned(query, spark, folder)
    newest = ingestion.watermark_ms - ingestion.watermark_ms % DAY
    return flat(engine.answer(query, newest, ingestion.progress()), "event_type")


def query_run_reuse(spark: SparkSession, folder: str) -> DataFrame:
    """Two evaluations a day apart of a query whose panes evaluations keep; values per series of the second."""
    query = "quantile_over_time(0.99, events_value[7d])"
    p = plan(Workload((RepeatingQuery(query, DAY, Accuracy(0.01, "rank", 0.01)),), {"events_value": SourceStats(1, None, 1)}))
    engine = QueryEngine(p, PaneStore(spark, scratch_path(spark, "kept")), lambda: events(spark, folder))
    seen = Progress(T_EVENTS, {"events_value": T_EVENTS})
    engine.answer(query, T_EVENTS - DAY, seen)
    answer = engine.answer(query, T_EVENTS, seen)
    exact = evaluate("count_over_time(events_value[7d])", events(spark, folder), T_EVENTS)
    c = engine.counters
    counted = exact.join(answer.select("series"), "series", "left_semi").agg(F.count(F.lit(1)).alias("series"))
    return counted.select("series", F.lit(c.built).alias("built"), F.lit(c.kept).alias("stored"), F.lit(c.reused).alias("reused"))


def unanswered(spark: SparkSession, folder: str) -> DataFrame:
    """Why queries are not answered."""
    query = "sum by (event_type) (sum_over_time(events_value[7d]))"
    engine, ingestion = _planned(query, spark, folder)
    rows = []
    for case, text, time_ms in [("unplanned", "up", T_EVENTS), ("off_grid", query, T_EVENTS + 1), ("not_built", query, T_EVENTS + 400 * DAY), ("out_of_range", query, -(2**63) + 1)]:
        try:
            engine.answer(text, time_ms, ingestion.progress())
            rows.append((case, "answered"))
        except Unanswered as e:
            rows.append((case, e.kind))
    return spark.createDataFrame(rows, "case_name string, reason string")


def pane_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries a joint plan stores for queries that share and do not share them."""
    queries = ["sum by (event_type) (sum_over_time(events_value[6h]))", "count_over_time(events_value[6h])", "rate(events_value[6h])", "sum_over_time(events_value[2d])"]
    p = plan(Workload(tuple(RepeatingQuery(q, HOUR if "6h" in q else DAY) for q in queries), {}), Capabilities(raw_data_retained=False))
    assert all(isinstance(q, PlannedQuery) for q in p.queries)
    rows = [(s.definition.family, s.definition.pane_ms, s.retention_ms) for s in p.stored.values()]
    return spark.createDataFrame(rows, "family string, pane_ms bigint, retention_ms bigint")


FINE = Definition(COUNTER, (), "exact", (), HOUR // 4)
#: A clock inside the data (2026-03-05T00:00Z), and a barrier.
NOON = 1_772_668_800_000
BARRIER = NOON + 5 * HOUR
SELECTED = Definition(COUNTER, (Matcher("region", "!=", ""), Matcher("env", "=", "prod")), "exact", (), HOUR)


def _ingest(spark: SparkSession, folder: str, definitions: list[Definition], retention: int = RETENTION, now: int = CLOCK, options: Options = Options(), early_only: bool = False) -> Ingestion:
    """The samples in one batch (or those received before CUT)."""
    ingestion = Ingestion(spark, Plan([], {d.key: Stored(d, INGESTION, retention) for d in definitions}), scratch_path(spark, "ingest"), options)
    samples = stored(spark, folder)
    if early_only:
        received = spark.read.parquet(f"{folder}/samples.parquet").where(F.col("received_at") < F.lit(CUT).cast("timestamp_ntz")).select("arrival")
        samples = samples.join(received, "arrival", "left_semi")
    ingestion.ingest(samples, now, 0)
    return ingestion


def _outcomes(spark: SparkSession, c) -> DataFrame:
    rows = [("accepted", c.accepted), ("late", c.late), ("duplicate", c.duplicate), ("first_pane", c.first_pane)]
    return spark.createDataFrame(rows, "outcome string, n bigint")


def ingest_outcomes_many(spark: SparkSession, folder: str) -> DataFrame:
    """Two definitions of one metric with other panes: a sample has the better of its outcomes."""
    return _outcomes(spark, _ingest(spark, folder, [DEFINITION, FINE]).counters)


def ingest_unselected(spark: SparkSession, folder: str) -> DataFrame:
    """Samples of series the definition does not select are accepted but in no pane."""
    ingestion = _ingest(spark, folder, [SELECTED])
    kept = ingestion.store.read(SELECTED, ingestion.store.ends(SELECTED)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kept")).first()["kept"]
    return _outcomes(spark, ingestion.counters).unionByName(spark.createDataFrame([("kept", kept)], "outcome string, n bigint"))


def ingest_ahead(spark: SparkSession, folder: str) -> DataFrame:
    """A clock inside the data: what lies more than five minutes ahead of it is left out, and the watermark stops at the clock."""
    ingestion = _ingest(spark, folder, [DEFINITION], now=NOON)
    return spark.createDataFrame([(ingestion.counters.ahead, ingestion.watermark_ms, max(ingestion.store.ends(DEFINITION)))], "ahead bigint, watermark_ms bigint, newest_end_ms bigint")


def ingest_barrier(spark: SparkSession, folder: str) -> DataFrame:
    """A barrier closes panes that no sample has passed; an older one changes nothing."""
    ingestion = _ingest(spark, folder, [DEFINITION], early_only=True)
    newest = max(ingestion.store.ends(DEFINITION))
    ingestion.advance_watermark(BARRIER + 90 * HOUR, CLOCK)
    ingestion.advance_watermark(BARRIER, CLOCK)
    ends = ingestion.store.ends(DEFINITION)
    return spark.createDataFrame([(newest, min(ends), max(ends), len(ends))], "before_ms bigint, oldest_ms bigint, newest_ms bigint, n bigint")


def ingest_whole_start(spark: SparkSession, folder: str) -> DataFrame:
    """Where everything was sent from a known time on, the first pane is built as well."""
    ingestion = _ingest(spark, folder, [DEFINITION], retention=10_000 * HOUR, options=Options(complete_from_ms=0))
    return spark.createDataFrame([(ingestion.counters.first_pane, min(ingestion.store.ends(DEFINITION)))], "first_pane bigint, oldest_ms bigint")


def ingest_expired(spark: SparkSession, folder: str) -> DataFrame:
    """Panes that are past their retention when the watermark passes them are not built."""
    c = _ingest(spark, folder, [DEFINITION]).counters
    return spark.createDataFrame([(c.panes_built, c.panes_expired)], "built bigint, expired bigint")


def query_run_eviction(spark: SparkSession, folder: str) -> DataFrame:
    """Three evaluations of a query that keeps daily panes: those past its range go, late newest samples are counted."""
    query = "quantile_over_time(0.99, events_value[7d])"
    p = plan(Workload((RepeatingQuery(query, DAY, Accuracy(0.01, "rank", 0.01)),), {"events_value": SourceStats(1, None, 1)}))
    engine = QueryEngine(p, PaneStore(spark, scratch_path(spark, "kept")), lambda: events(spark, folder))
    for days, newest in ((9, 9), (3, 4), (0, 0)):
        engine.answer(query, T_EVENTS - days * DAY, Progress(T_EVENTS - days * DAY, {"events_value": T_EVENTS - newest * DAY}))
    ends, c = engine.store.ends(next(iter(p.stored.values())).definition), engine.counters
    return spark.createDataFrame([(min(ends), max(ends), len(ends), c.built, c.reused, c.stored_before_samples)], "oldest_ms bigint, newest_ms bigint, kept bigint, built bigint, reused bigint, before_samples bigint")


def plan_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """What the planner makes of single queries with and without raw samples."""
    stats = {"m": SourceStats(100, "gauge", 1000, True), "s": SourceStats(100, "gauge", 1000, False)}
    rank, relative = Accuracy(0.01, "rank", 0.01), Accuracy(0.05, "relative", 0.01)
    cases = [
        ("sum", "sum_over_time(m[10m])", None), ("rate", "topk(10, sum by (job) (rate(m[5m])))", None), ("exact_quantile", "quantile_over_time(0.5, m[10m])", None), ("rank", "quantile_over_time(0.99, m[1h])", rank),
        ("relative", "max by (job) (quantile_over_time(0.99, m[1h]))", relative), ("average", "avg by (job) (quantile_over_time(0.99, m[1h]))", relative), ("signed_average", "avg by (job) (quantile_over_time(0.99, s[1h]))", relative),
        ("rank_sum", "sum by (job) (quantile_over_time(0.99, m[1h]))", rank), ("selector", "m", None), ("broken", "sum_over_time(m[10m]", None), ("offset", "sum_over_time(m[10m] offset 5m)", None),
    ]
    rows = []
    for kept in (True, False):
        for name, query, accuracy in cases:
            try:
                made = plan(Workload((RepeatingQuery(query, 60_000, accuracy),), stats), Capabilities(raw_data_retained=kept))
                shape = ",".join(f"{s.definition.family} {s.built_at} {s.definition.pane_ms} {s.retention_ms}" for s in made.stored.values()) or "raw"
            except PlanError:
                shape = "refused"
            rows.append((kept, name, shape))
    return spark.createDataFrame(rows, "raw_kept boolean, case_name string, shape string")


def refused_plans(spark: SparkSession, folder: str) -> DataFrame:
    """Plans and workloads that are refused as a whole, and why: the kind of fault."""
    key = lambda d: d.key
    d, other = DEFINITION, FINE
    query = f"sum_over_time({COUNTER}[1h])"
    plans = {
        "unknown_definition": lambda: Plan([PlannedQuery(query, "x")]).validate(), "other_series": lambda: Plan([PlannedQuery("sum_over_time(m[1h])", key(d))], {key(d): Stored(d, INGESTION, HOUR)}).validate(),
        "no_multiple": lambda: Plan([PlannedQuery(f"sum_over_time({COUNTER}[90m])", key(d))], {key(d): Stored(d, INGESTION, HOUR)}).validate(), "wrong_key": lambda: Plan([], {"x": Stored(d, INGESTION, HOUR)}).validate(),
        "cycle": lambda: Plan([], {key(d): Stored(d, INGESTION, HOUR, (key(other),)), key(other): Stored(other, INGESTION, HOUR, (key(d),))}).validate(), "retention": lambda: Plan([], {key(d): Stored(d, INGESTION, -1)}).validate(),
        "built_from_query": lambda: Plan([], {key(d): Stored(d, INGESTION, HOUR, (key(other),)), key(other): Stored(other, QUERY, HOUR)}).validate(), "stored_from_stored": lambda: Ingestion(spark, Plan([], {key(d): Stored(d, INGESTION, HOUR, (key(other),)), key(other): Stored(other, INGESTION, HOUR)}), scratch_path(spark, "refused")),
        "language": lambda: plan(Workload((RepeatingQuery(query, HOUR),), {}, "sql")), "one_bad_query": lambda: plan(Workload((RepeatingQuery(query, HOUR), RepeatingQuery("sum(", HOUR)), {})),
        "unsupported_summary": lambda: plan(Workload((RepeatingQuery(query, HOUR),), {}), Capabilities(frozenset({"kll"}), False)), "latency": lambda: plan(Workload((RepeatingQuery(query, HOUR, None, 0.001),), {COUNTER: SourceStats(10**9, None, 1000)}), Capabilities(raw_data_retained=False)),
        "fine": lambda: plan(Workload((RepeatingQuery(query, HOUR),), {})),
    }
    rows = []
    for name, make in plans.items():
        try:
            make()
            rows.append((name, "installed"))
        except PlanError:
            rows.append((name, "refused"))
        except ValueError:
            rows.append((name, "not supported"))
    return spark.createDataFrame(rows, "case_name string, outcome string")


def wire_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every message written as a request body and read again: whether it is valid, and its samples, their times and finite values."""
    messages = table(spark, folder, "time_series").select("message_id", "labels", "samples")
    back = remote_write.decoded_bodies(remote_write.encoded_messages(messages))
    finite = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    out = back.groupBy("message_id").agg(F.bool_and(F.col("refused").isNull()).alias("valid"), F.count("timestamp_ms").alias("n"), F.max("timestamp_ms").alias("newest_ms"), F.sum(finite).alias("total"), F.max(F.size("labels")).alias("pairs"))
    return out.select("message_id", "valid", "n", "newest_ms", quantised("total"), F.when(F.col("n") > 0, F.col("pairs")).alias("pairs"))


def text_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Times, values, selectors and header texts as the query interface reads and writes them."""
    rows = [(f"value {x!r}", promfmt.format_value(x)) for x in (1.0, -0.0, 0.1, 1e21, 1e-7, 2.5e-3, float("inf"), float("-inf"), float("nan"), 123456789.125)]
    rows += [(f"time {t}", str(promfmt.parse_instant(f"query=up&time={t}"))) for t in ("1.5", "0.0005", "-0.0015", "1e3", "2020-01-01T00:00:00Z", "")]
    for t in ("inf", "1e30"):
        try:
            rows.append((f"time {t}", str(promfmt.parse_instant(f"query=up&time={t}"))))
        except promfmt.BadTime:
            rows.append((f"time {t}", "refused"))
    rows += [(f"selector {i}", selector_text(getattr(leaf(parse(q)), "selector", leaf(parse(q))))) for i, q in enumerate(('m{a="b\\"c\\\\d"}', 'sum by (a) (rate(m{x=~"y.*",z!=""}[5m] offset 1m))', "m"))]
    rows += [("header", header_text("a\nb\u00e9~"))]
    answer = promfmt.vector_response(1500, [({"b": "2"}, 1.0), ({"b": "1"}, 3.0)])
    rows.append(("rows by label", ",".join(r["metric"]["b"] for r in answer["data"]["result"])))
    answer = promfmt.vector_response(1500, [({"b": "1"}, 1.0), ({"b": "2"}, 3.0)], "topk")
    rows.append(("rows by value", ",".join(r["metric"]["b"] for r in answer["data"]["result"])))
    return spark.createDataFrame(rows, "what string, form string")


QUERIES = {f.__name__: f for f in (ingest_outcomes, ingest_panes, planned_sum_by, query_run_reuse, unanswered, pane_plan, ingest_outcomes_many, ingest_unselected, ingest_ahead, ingest_barrier, ingest_whole_start, ingest_expired, query_run_eviction, plan_shapes, refused_plans, wire_round_trip, text_forms)}

_RUN = f"""WITH joined AS (
  SELECT arrival, timestamp_ms AS ts_ms, value, received_at < TIMESTAMP '{CUT}' AS early, coalesce(nullif(metric, ''), labels['__name__'], '') AS metric,
         list_sort(list_filter(map_entries(labels), lambda p: p.value <> '' AND p.key <> '__name__')) AS pairs
  FROM samples JOIN series ON series_id = id WHERE timestamp_ms IS NOT NULL AND value IS NOT NULL AND received_at IS NOT NULL
), mine AS (
  SELECT *, ts_ms + ((-ts_ms % {HOUR}) + {HOUR}) % {HOUR} AS pane_end FROM joined WHERE metric = '{COUNTER}'
), marks AS (
  SELECT arg_min(pane_end, arrival) FILTER (early) AS first_end, max(ts_ms) FILTER (early) - 15000 AS w1, max(ts_ms) - 15000 AS w2 FROM mine
), closed AS (
  SELECT *, greatest(first_end, w1 // {HOUR} * {HOUR}) AS built1, w2 // {HOUR} * {HOUR} AS last, w2 // {HOUR} * {HOUR} - {RETENTION} AS oldest FROM marks
), states AS (
  SELECT mine.*, closed.*, CASE WHEN pane_end = first_end THEN 'first_pane' WHEN pane_end <= (CASE WHEN early THEN first_end ELSE built1 END) THEN 'late' END AS state FROM mine, closed
), ranked AS (
  SELECT *, max(ts_ms) OVER (PARTITION BY pairs, pane_end, state IS NULL ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM states
), outcomes AS (
  SELECT *, coalesce(state, CASE WHEN ts_ms <= prior THEN 'duplicate' ELSE 'accepted' END) AS outcome FROM ranked
)"""

def _told(width: int, name: str, selected: str = "TRUE") -> str:
    """CTEs that tell the outcome of each sample of the metric in one batch; 1 late, 2 duplicate, 3 first pane, 4 accepted."""
    return f"""p{name} AS (SELECT *, ts_ms + ((-ts_ms % {width}) + {width}) % {width} AS pane_end, {selected} AS selected FROM mine),
f{name} AS (SELECT arg_min(pane_end, arrival) AS first_end, max(ts_ms) - 15000 AS w FROM p{name}),
r{name} AS (SELECT p.*, f.first_end, max(CASE WHEN selected THEN ts_ms END) OVER (PARTITION BY pairs, pane_end ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM p{name} p, f{name} f),
o{name} AS (SELECT *, CASE WHEN pane_end = first_end THEN 3 WHEN pane_end < first_end THEN 1 WHEN selected AND ts_ms <= prior THEN 2 ELSE 4 END AS outcome FROM r{name})"""


_MINE = _RUN[: _RUN.index("), marks AS (")].replace(f", ts_ms + ((-ts_ms % {HOUR}) + {HOUR}) % {HOUR} AS pane_end", "") + "), "
_KINDS = "(SELECT unnest(['late', 'duplicate', 'first_pane', 'accepted']) AS outcome, unnest([1, 2, 3, 4]) AS k)"
_EARLY = f"m AS (SELECT *, ts_ms + ((-ts_ms % {HOUR}) + {HOUR}) % {HOUR} AS pane_end FROM mine)"

ORACLES = {
    "ingest_outcomes": _RUN + f""" SELECT k.outcome, CASE WHEN k.outcome = 'unrouted' THEN (SELECT count(*) FROM joined WHERE metric <> '{COUNTER}') ELSE count(o.outcome) END AS n
  FROM (SELECT unnest(['accepted', 'late', 'duplicate', 'first_pane', 'future', 'unrouted']) AS outcome) k LEFT JOIN outcomes o ON o.outcome = k.outcome GROUP BY k.outcome""",
    "ingest_panes": _RUN + f""", ends AS (SELECT unnest(range(greatest(first_end + {HOUR}, oldest), last + 1, {HOUR})) AS pane_end FROM closed),
  sums AS (SELECT pane_end, count(*) AS n, sum(value) AS total FROM outcomes WHERE outcome = 'accepted' GROUP BY pane_end)
  SELECT ends.pane_end AS pane_end_ms, coalesce(n, 0) AS n, {quantised_sql('total')} AS total FROM ends LEFT JOIN sums ON sums.pane_end = ends.pane_end""",
    "planned_sum_by": f"""WITH {_EVENTS}, t AS (SELECT (max(ts_ms) - 15000) // {DAY} * {DAY} AS t FROM e), v AS (
  SELECT event_type, sum(value) AS value FROM e, t WHERE ts_ms > t - {7 * DAY} AND ts_ms <= t GROUP BY event_type) SELECT event_type, {quantised_sql('value')} AS value FROM v""",
    "query_run_reuse": f"WITH {_EVENTS} SELECT count(DISTINCT event_type || '/' || user_id) AS series, 8 AS built, 8 AS stored, 6 AS reused FROM e WHERE ts_ms > {T_EVENTS - 7 * DAY} AND ts_ms <= {T_EVENTS}",
    "unanswered": "SELECT * FROM (VALUES ('unplanned', 'not_planned'), ('off_grid', 'missing_pane'), ('not_built', 'missing_pane'), ('out_of_range', 'unsupported')) t(case_name, reason)",
    "pane_plan": f"SELECT * FROM (VALUES ('exact', CAST({HOUR} AS BIGINT), CAST({6 * HOUR} AS BIGINT)), ('counter', {HOUR}, {6 * HOUR}), ('exact', {DAY}, {2 * DAY})) t(family, pane_ms, retention_ms)",
    "ingest_outcomes_many": _MINE + _told(HOUR, "a") + ", " + _told(HOUR // 4, "b") + f""", best AS (SELECT greatest(oa.outcome, ob.outcome) AS k FROM oa JOIN ob USING (arrival))
  SELECT outcome, count(best.k) AS n FROM {_KINDS} kinds LEFT JOIN best USING (k) GROUP BY outcome""",
    "ingest_unselected": _MINE + _told(HOUR, "a", "len(list_filter(pairs, lambda p: p.key = 'region')) > 0 AND len(list_filter(pairs, lambda p: p.key = 'env' AND p.value = 'prod')) > 0") + f"""
  SELECT outcome, count(told.k) AS n FROM {_KINDS} kinds LEFT JOIN (SELECT outcome AS k FROM oa) told USING (k) GROUP BY outcome
  UNION ALL SELECT 'kept', count(*) FROM oa, fa WHERE outcome = 4 AND selected AND pane_end > fa.first_end AND pane_end <= w // {HOUR} * {HOUR} AND pane_end >= w // {HOUR} * {HOUR} - {RETENTION}""",
    "ingest_ahead": _MINE + f"""m AS (SELECT * FROM mine WHERE ts_ms <= {NOON + 300_000})
  SELECT (SELECT count(*) FROM mine WHERE ts_ms > {NOON + 300_000}) AS ahead, least(max(ts_ms), {NOON}) - 15000 AS watermark_ms, (least(max(ts_ms), {NOON}) - 15000) // {HOUR} * {HOUR} AS newest_end_ms FROM m""",
    "ingest_barrier": _MINE + f"""e AS (SELECT (max(ts_ms) - 15000) // {HOUR} * {HOUR} AS newest FROM mine WHERE early), b AS (SELECT {BARRIER + 90 * HOUR} AS barrier)
  SELECT newest AS before_ms, barrier - {RETENTION} AS oldest_ms, barrier AS newest_ms, {RETENTION // HOUR + 1} AS n FROM e, b""",
    "ingest_whole_start": _MINE + _EARLY + " SELECT 0 AS first_pane, arg_min(pane_end, arrival) AS oldest_ms FROM m",
    "ingest_expired": _MINE + _EARLY + f""", n AS (SELECT ((max(ts_ms) - 15000) // {HOUR} * {HOUR} - arg_min(pane_end, arrival)) // {HOUR} AS n FROM m) SELECT least(n, {RETENTION // HOUR + 1}) AS built, greatest(0, n - {RETENTION // HOUR + 1}) AS expired FROM n""",
    "query_run_eviction": f"SELECT {T_EVENTS - 7 * DAY} AS oldest_ms, {T_EVENTS} AS newest_ms, 8 AS kept, 16 AS built, 5 AS reused, 1 AS before_samples",
    "plan_shapes": """SELECT * FROM (VALUES (TRUE, 'sum', 'raw'), (TRUE, 'rate', 'raw'), (TRUE, 'exact_quantile', 'raw'), (TRUE, 'rank', 'raw'), (TRUE, 'relative', 'raw'), (TRUE, 'average', 'raw'), (TRUE, 'signed_average', 'raw'), (TRUE, 'rank_sum', 'raw'), (TRUE, 'selector', 'raw'), (TRUE, 'broken', 'refused'), (TRUE, 'offset', 'raw'),
  (FALSE, 'sum', 'exact ingestion_run 60000 600000'), (FALSE, 'rate', 'counter ingestion_run 60000 300000'), (FALSE, 'exact_quantile', 'refused'), (FALSE, 'rank', 'kll ingestion_run 60000 3600000'), (FALSE, 'relative', 'ddsketch ingestion_run 60000 3600000'), (FALSE, 'average', 'ddsketch ingestion_run 60000 3600000'),
  (FALSE, 'signed_average', 'refused'), (FALSE, 'rank_sum', 'refused'), (FALSE, 'selector', 'refused'), (FALSE, 'broken', 'refused'), (FALSE, 'offset', 'exact ingestion_run 60000 900000')) t(raw_kept, case_name, shape)""",
    "refused_plans": """SELECT * FROM (VALUES ('unknown_definition', 'refused'), ('other_series', 'refused'), ('no_multiple', 'refused'), ('wrong_key', 'refused'), ('cycle', 'refused'), ('retention', 'refused'), ('built_from_query', 'refused'), ('stored_from_stored', 'not supported'), ('language', 'refused'),
  ('one_bad_query', 'refused'), ('unsupported_summary', 'refused'), ('latency', 'refused'), ('fine', 'installed')) t(case_name, outcome)""",
    "wire_round_trip": f"""WITH m AS (
  SELECT message_id, coalesce(list_transform(list_filter(labels, lambda p: p IS NOT NULL), lambda p: coalesce(p.name, '')), []) AS names, coalesce(list_filter(samples, lambda x: x IS NOT NULL), []) AS samples FROM time_series
), v AS (SELECT *, list_contains(names, '__name__') AND len(list_distinct(names)) = len(names) AS valid FROM m
), x AS (SELECT message_id, unnest(samples) AS s FROM v WHERE valid
), g AS (
  SELECT message_id, count(*) AS n, max(coalesce(s.timestamp, 0)) AS newest_ms, sum(coalesce(s.value, 0)) FILTER (s.value IS NULL OR NOT isnan(s.value) AND NOT isinf(s.value)) AS total FROM x GROUP BY message_id
) SELECT v.message_id, valid, coalesce(n, 0) AS n, newest_ms, {quantised_sql('total')} AS total, CASE WHEN n > 0 THEN CAST(len(names) AS INTEGER) END AS pairs FROM v LEFT JOIN g USING (message_id)""",
    "text_forms": """SELECT * FROM (VALUES ('value 1.0', '1'), ('value -0.0', '-0'), ('value 0.1', '0.1'), ('value 1e+21', '1000000000000000000000'), ('value 1e-07', '0.0000001'), ('value 0.0025', '0.0025'), ('value inf', '+Inf'), ('value -inf', '-Inf'), ('value nan', 'NaN'), ('value 123456789.125', '123456789.125'),
  ('time 1.5', '(''up'', 1500)'), ('time 0.0005', '(''up'', 1)'), ('time -0.0015', '(''up'', -2)'), ('time 1e3', '(''up'', 1000000)'), ('time 2020-01-01T00:00:00Z', 'None'), ('time ', 'None'), ('time inf', 'refused'), ('time 1e30', 'refused'),
  ('selector 0', '{__name__="m",a="b\\"c\\\\d"}'), ('selector 1', '{__name__="m",x=~"y.*",z!=""}[300000ms] offset 60000ms'), ('selector 2', '{__name__="m"}'), ('header', 'a?b?~'), ('rows by label', '1,2'), ('rows by value', '2,1')) t(what, form)""",
}
