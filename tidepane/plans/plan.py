"""A plan: its queries, the summaries they read, and the file it is kept in."""

from __future__ import annotations

import graphlib
import json
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, field, replace

from tidepane.functions.timeline import INT64_MAX
from tidepane.operators.states import Family, family_of
from tidepane.plans.promql import Matcher, RangeCall, Selector, leaf, parse

INGESTION, QUERY = "ingestion_run", "query_run"


class PlanError(ValueError):
    """A workload cannot be planned, or a plan cannot be installed."""


@dataclass(frozen=True)
class Definition:
    """What a stored summary computes: whose samples, which family, how wide a pane."""

    metric: str
    matchers: tuple[Matcher, ...]
    family: str
    parameters: tuple[tuple[str, float], ...]
    pane_ms: int

    @property
    def key(self) -> str:
        """Canonical text; definitions with equal keys are one."""
        return json.dumps([self.metric, [[m.name, m.op, m.value] for m in self.matchers], self.family, list(self.parameters), self.pane_ms], ensure_ascii=False)

    @property
    def selector(self) -> Selector:
        return Selector(self.metric, self.matchers, self.pane_ms)

    def summary(self) -> Family:
        function = {"exact": "sum_over_time", "counter": "rate"}.get(self.family, "quantile_over_time")
        return family_of(function, self.family, **dict(self.parameters))


@dataclass(frozen=True)
class Stored:
    """How the panes of a definition are kept. ``inputs`` are keys of definitions it is built from."""

    definition: Definition
    built_at: str
    retention_ms: int
    inputs: tuple[str, ...] = ()

    def oldest_kept_end(self, watermark_ms: int) -> int:
        """Panes that end earlier are not read any more; one pane is kept beyond the retention."""
        newest_closed = watermark_ms - watermark_ms % self.definition.pane_ms
        return newest_closed - self.retention_ms


@dataclass(frozen=True)
class PlannedQuery:
    """``definition`` is the key of the panes it reads, or None: from raw samples."""

    query: str
    definition: str | None = None

    def ends(self, time_ms: int, pane_ms: int) -> list[int]:
        """Ends of the panes that make up the query's window at ``time_ms``, oldest first."""
        call = leaf(parse(self.query))
        assert isinstance(call, RangeCall)
        last = time_ms - call.selector.offset_ms
        count = -(-(call.selector.range_ms or 0) // pane_ms)
        return [last - i * pane_ms for i in reversed(range(count))]


@dataclass
class Plan:
    queries: list[PlannedQuery]
    stored: dict[str, Stored] = field(default_factory=dict)
    accepted_without_guarantee: list[int] = field(default_factory=list)

    def validate(self) -> Plan:
        """Raise :class:`PlanError` for a plan that cannot be installed."""
        for i, q in enumerate(self.queries):
            e = leaf(parse(q.query))
            if q.definition is None:
                continue
            if q.definition not in self.stored:
                raise PlanError(f"query {i} reads an unknown definition")
            d = self.stored[q.definition].definition
            if not isinstance(e, RangeCall) or (e.selector.metric, e.selector.matchers) != (d.metric, d.matchers):
                raise PlanError(f"query {i} does not match the definition it reads")
            if e.selector.range_ms % d.pane_ms:
                raise PlanError(f"query {i}: its range is no multiple of the pane width")
        for key, s in self.stored.items():
            if key != s.definition.key:
                raise PlanError("a definition is stored under another key")
            if s.definition.pane_ms <= 0:
                raise PlanError(f"{key}: a pane needs a width")
            if not 0 <= s.retention_ms <= INT64_MAX:
                raise PlanError(f"{key}: the retention does not fit")
            for i in s.inputs:
                if i not in self.stored:
                    raise PlanError(f"{key}: reads an unknown definition")
                if s.built_at == INGESTION and self.stored[i].built_at == QUERY:
                    raise PlanError(f"{key}: built at ingestion, it reads one built by a query")
        self.build_order()
        return self

    def build_order(self) -> list[str]:
        """Keys of the definitions built at ingestion, each after those it reads."""
        graph = {k: set(s.inputs) for k, s in self.stored.items()}
        try:
            order = list(graphlib.TopologicalSorter(graph).static_order())
        except graphlib.CycleError as e:
            raise PlanError(f"these wait for each other in a cycle: {e.args[1]}") from None
        return [k for k in order if self.stored[k].built_at == INGESTION]

    def to_json(self) -> str:
        return json.dumps({"queries": [asdict(q) for q in self.queries], "stored": [asdict(s) for s in self.stored.values()], "accepted_without_guarantee": self.accepted_without_guarantee}, indent=2, ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> Plan:
        raw = json.loads(text)
        stored = merged(_stored(s) for s in raw["stored"])
        return Plan([PlannedQuery(**q) for q in raw["queries"]], stored, list(raw.get("accepted_without_guarantee", []))).validate()

    def save(self, path: str) -> None:
        self.validate()
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.to_json())

    @staticmethod
    def load(path: str) -> Plan:
        with open(path, encoding="utf-8") as f:
            return Plan.from_json(f.read())


def _stored(raw: Mapping) -> Stored:
    d = raw["definition"]
    definition = Definition(d["metric"], tuple(Matcher(**m) for m in d["matchers"]), d["family"], tuple((k, v) for k, v in d["parameters"]), d["pane_ms"])
    return Stored(definition, raw["built_at"], raw["retention_ms"], tuple(raw.get("inputs", ())))


def merged(outputs: Iterable[Stored]) -> dict[str, Stored]:
    """Outputs of one definition together: built at ingestion if any is, kept as long as the longest."""
    found: dict[str, Stored] = {}
    for s in outputs:
        key = s.definition.key
        old = found.get(key)
        if old:
            s = replace(s, built_at=INGESTION if INGESTION in (old.built_at, s.built_at) else QUERY, retention_ms=max(old.retention_ms, s.retention_ms), inputs=tuple(dict.fromkeys(old.inputs + s.inputs)))
        found[key] = s
    return found
