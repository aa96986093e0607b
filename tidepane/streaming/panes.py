"""Stored panes: one immutable Parquet version per build, and a ledger of which pane is in which version."""

from __future__ import annotations

import hashlib
import json
import threading
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepane.plans.plan import Definition
from tidepane.sources.files import Files


class PaneStore:
    """Panes by definition and end. A pane that is stored is never changed; one without rows is stored too."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, Files(spark)
        #: For each definition key, the version that holds each stored pane end.
        self.ledger: dict[str, dict[int, int]] = {}
        self._next = 0
        self._garbage: list[str] = []
        self._condemned: list[str] = []
        self._added: dict[str, dict[int, int]] = {}
        self._gone: dict[str, int] = {}
        self.lock = threading.RLock()

    def _folder(self, d: Definition, version: int) -> str:
        return f"{self.path}/{hashlib.sha256(d.key.encode()).hexdigest()[:24]}/version={version}"

    def _schema(self, d: Definition) -> str:
        return "series string, pane_end_ms bigint, " + ", ".join(f"`{c}` {t}" for c, t in d.summary().columns)

    def insert(self, d: Definition, states: DataFrame | None, ends: Iterable[int]) -> None:
        """Store the panes that end at ``ends``; ``states`` has their rows (None: they are all empty)."""
        with self.lock:
            version = self._next
            self._next += 1
        if states is not None:
            columns = ["series", "pane_end_ms", *(c for c, _ in d.summary().columns)]
            states.select(*columns).write.mode("overwrite").parquet(self._folder(d, version))
        with self.lock:
            known = self.ledger.setdefault(d.key, {})
            ends = list(ends)
            for end in ends:
                if end in known:
                    raise ValueError(f"there is a pane ending at {end} already")
            for end in ends:
                known[end] = self._added.setdefault(d.key, {})[end] = version if states is not None else -1

    def ends(self, d: Definition) -> list[int]:
        with self.lock:
            return sorted(self.ledger.get(d.key, {}))

    def missing(self, d: Definition, ends: Iterable[int]) -> list[int]:
        known = self.ledger.get(d.key, {})
        return [e for e in ends if e not in known]

    def read(self, d: Definition, ends: Iterable[int]) -> DataFrame:
        """State rows of stored panes; only the versions that hold them are opened."""
        with self.lock:
            known, wanted = dict(self.ledger.get(d.key, {})), list(ends)
        folders = [self._folder(d, v) for v in sorted({known[e] for e in wanted} - {-1})]
        if not folders:
            return self.spark.createDataFrame([], self._schema(d))
        return self.spark.read.schema(self._schema(d)).parquet(*folders).where(F.col("pane_end_ms").isin(*wanted))

    def evict_before(self, d: Definition, end: int) -> int:
        """Forget panes that end before ``end``; versions nothing refers to go with :meth:`sweep`."""
        with self.lock:
            known = self.ledger.get(d.key, {})
            gone = [e for e in known if e < end]
            versions = {known.pop(e) for e in gone}
            if gone:
                self._gone[d.key] = max(end, self._gone.get(d.key, end))
            for v in versions - set(known.values()) - {-1}:
                self._garbage.append(self._folder(d, v))
            return len(gone)

    def sweep(self) -> None:
        """Delete the files of versions evicted before the last call; answers in the making have until the next one."""
        with self.lock:
            old, self._condemned, self._garbage = self._condemned, self._garbage, []
        for folder in old:
            self.files.delete(folder)

    def __len__(self) -> int:
        return sum(map(len, self.ledger.values()))

    @property
    def changed(self) -> bool:
        """Whether there is something to commit."""
        return bool(self._added or self._gone)

    def changes(self, whole: bool = False) -> dict:
        """What was added and evicted since the last call, or everything."""
        with self.lock:
            added, gone, self._added, self._gone = self._added, self._gone, {}, {}
            text = lambda ledger: {k: {str(e): v for e, v in x.items()} for k, x in ledger.items()}
            return {"next": self._next, "whole": whole, "added": text(self.ledger if whole else added), "gone": {} if whole else gone}

    def apply(self, state: dict) -> None:
        """Take up what :meth:`changes` told, in the same order."""
        self._next = state["next"]
        if state["whole"]:
            self.ledger = {}
        for k, x in state["added"].items():
            self.ledger.setdefault(k, {}).update({int(e): v for e, v in x.items()})
        for k, end in state["gone"].items():
            self.ledger[k] = {e: v for e, v in self.ledger.get(k, {}).items() if e >= end}


def dump(state: dict) -> str:
    return json.dumps(state, ensure_ascii=False, sort_keys=True)
