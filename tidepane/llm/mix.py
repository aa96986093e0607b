"""A mix of sources to target shares of its tokens."""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepane.llm.tokens import TOKENIZER, TOKENIZER_DIR, token_counts
from tidepane.session import written

#: Slices of an epoch's order; only the slice in which a budget ends is ordered row by row.
SLICE_BITS = 12
#: Leaves of the tree that the driver plans with; more targets than this are refused.
MAX_LEAVES = 1_000_000
#: The mix is not made smaller than this part of the tokens there are for the sake of a scarce source.
LEAST_PASSES = 0.25
LANGUAGES = ("en", "de", "fr", "es", "ja", "ru", "it", "pt", "nl", "pl", "zh", "ko")


@dataclass
class Node:
    """A node of the domain-language-source tree: target ``weight``, token ``capacity``, and its ``budget`` once planned."""

    name: str
    weight: float = 0.0
    capacity: float = 0.0
    children: dict[str, Node] = field(default_factory=dict)
    budget: float = 0.0

    def add(self, path: Sequence[str], weight: float, capacity: float) -> None:
        self.weight += weight
        self.capacity += capacity
        if path:
            self.children.setdefault(path[0], Node(path[0])).add(path[1:], weight, capacity)

    def assign(self, amount: float) -> None:
        """Give this node ``amount`` (at most its capacity) and share it out below.

        Children get it by weight. What a child cannot take goes to its siblings
        with room, by weight again; only what all children together cannot take
        was kept from this node by its own parent. So a shortage is made up
        among siblings before ancestors.
        """
        self.budget = min(amount, self.capacity)
        left, given = self.budget, dict.fromkeys(self.children, 0.0)
        room = sorted((c for c in self.children.values() if c.capacity > 0 and c.weight > 0), key=lambda c: c.capacity / c.weight)
        weights = list(itertools.accumulate(c.weight for c in reversed(room)))[::-1]
        # Those with the least room for their weight are filled first; what they leave is shared by the rest.
        for c, weight in zip(room, weights, strict=True):
            given[c.name] = min(c.capacity, left * c.weight / weight)
            left -= given[c.name]
        for c in self.children.values():
            c.assign(given[c.name])

    def leaves(self, path: tuple[str, ...] = ()) -> dict[tuple[str, ...], float]:
        if not self.children:
            return {path: self.budget}
        return {k: v for c in self.children.values() for k, v in c.leaves((*path, c.name)).items()}


def language(lang: Column) -> Column:
    """Primary language in lower case; null, empty and unknown spellings are ``und``."""
    first = F.lower(F.substring_index(F.regexp_replace(F.trim(lang), "_", "-"), "-", 1))
    return F.when(first.isin(*LANGUAGES), first).otherwise(F.lit("und"))


def domain(source: Column, domains: Mapping[str, str]) -> Column:
    """Domain of a source; one that ``domains`` does not name is a domain of its own."""
    pairs = [F.lit(x) for pair in domains.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), source), source) if pairs else source


PATH = ("domain", "language", "source")


def sized(documents: DataFrame, targets: DataFrame, domains: Mapping[str, str] = {}, name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """Documents of target sources with their place in the tree and their size in tokens, written once.

    Documents of other sources or with a null source stay out, and so do those
    without a token. Targets with a null or negative share or no repeats count
    as targets of share 0.
    """
    # One row per target source, fixed by the mix and not by the corpus; the planner picks the join.
    wanted = targets.where(F.col("source").isNotNull()).select("source").distinct()
    kept = documents.select("doc_id", "source", "lang", "text").join(wanted, "source", "left_semi")
    counted = token_counts(kept, name=name, folder=folder)
    return written(counted.where(F.col("n_tokens") > 0).select("doc_id", domain(F.col("source"), domains).alias("domain"), language(F.col("lang")).alias("language"), "source", "n_tokens"), "sized")


def plan(leaves: Sequence[tuple[str, str, str, int]], targets: Mapping[str, tuple[float, int]], total_tokens: float | None = None, least_passes: float = 0.0) -> dict[tuple[str, str, str], float]:
    """Token budget of each leaf (domain, language, source), from the tokens it has.

    The weight of a source goes to its leaves by the tokens they have. Without
    ``total_tokens`` the mix is as large as it can be with every source that has
    tokens at its share (of the shares of these sources), but not smaller than
    ``least_passes`` times the tokens there are. With it, sources that
    cannot fill their share even with all repeats are short, and the shortage is
    redistributed up the tree.
    """
    available: dict[str, int] = {}
    for _, _, source, tokens in leaves:
        available[source] = available.get(source, 0) + tokens
    usable = {s: (max(0.0, share or 0.0), max(0, repeats or 0)) for s, (share, repeats) in targets.items() if available.get(s)}
    usable = {s: x for s, x in usable.items() if x[0] > 0 and x[1] > 0}
    if not usable:
        return {}
    shares = sum(share for share, _ in usable.values())
    if total_tokens is None:
        total_tokens = min(available[s] * repeats * shares / share for s, (share, repeats) in usable.items())
        total_tokens = max(total_tokens, least_passes * sum(available[s] for s in usable))
    root = Node("root")
    for d, lang, s, tokens in leaves:
        if s in usable:
            share, repeats = usable[s]
            root.add((d, lang, s), share * tokens / available[s], float(tokens * repeats))
    root.assign(float(total_tokens))
    return {k: v for k, v in root.leaves().items() if len(k) == 3}


@dataclass(frozen=True)
class Mix:
    """``sizes``: the documents with their place in the tree and their tokens; ``budgets``: the tokens planned for each leaf; ``selected``: a row per use of a document (doc_id, source, language, epoch, n_tokens); ``shares``: a row per target source."""

    selected: DataFrame
    shares: DataFrame
    sizes: DataFrame
    budgets: Mapping[tuple[str, str, str], float]


def mix(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, passes: float | None = None, seed: int = 17, domains: Mapping[str, str] = {}, least_passes: float = LEAST_PASSES, sizes: DataFrame | None = None, name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> Mix:
    """Mix the documents so that each target source has its share of all tokens, as nearly as its repeats allow.

    Each leaf takes the prefix of its epochs: in every epoch all its documents
    in an order drawn from ``seed`` and the epoch, so a document comes a second
    time only after all others came once, and at most ``max_repeats`` times.
    Documents are used whole; the last one is taken if more than half of it
    fits, so a leaf misses its budget by half a document at most. Empty tables
    give no selected rows. The size is ``total_tokens``, or ``passes`` times the
    tokens that all target sources have, or as :func:`plan` chooses. A source without usable documents has share 0. Where
    a source is listed twice, its largest share and repeats count. ``shares`` also says whether a source is
    ``exhausted``: all its documents are used as often as they may be, and so it sets the size of the mix or is
    short. ``sizes`` is the table of :func:`sized`, where it was stored before; the texts are not read again then.
    """
    spark = documents.sparkSession
    docs = sized(documents, targets, domains, name, folder) if sizes is None else sizes
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    if wanted.count() * len(LANGUAGES) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    share_of = {r["source"]: (r["target_share"], r["max_repeats"]) for r in wanted.collect()}
    totals = [(r["domain"], r["language"], r["source"], r["t"]) for r in docs.groupBy(*PATH).agg(F.sum("n_tokens").alias("t")).collect()]
    if total_tokens is None and passes is not None:
        total_tokens = passes * sum(t for *_, t in totals)
    budgets = plan(totals, share_of, total_tokens, least_passes)
    rows = []
    for d, lang, s, tokens in totals:
        budget = budgets.get((d, lang, s), 0.0)
        full = min(int(math.floor(budget / tokens + 1e-9)), int(share_of[s][1] or 0))
        rest = budget - full * tokens if full < (share_of[s][1] or 0) else 0.0
        rows.append((d, lang, s, full, max(0.0, rest)))
    # One row per leaf: at most MAX_LEAVES, and as many as the targets have languages.
    leaves = F.broadcast(spark.createDataFrame(rows, "domain string, language string, source string, full int, rest double"))
    placed = docs.join(leaves, list(PATH))
    whole = placed.where(F.col("full") > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("full"))))

    # The last, partial epoch: slices before the one in which the budget ends are taken whole.
    drawn = F.xxhash64(F.lit(seed), F.col("full") + 1, F.col("doc_id"))
    last = placed.where(F.col("rest") > 0).withColumn("draw", drawn).withColumn("slice", F.shiftrightunsigned("draw", 64 - SLICE_BITS).cast("int"))
    sums = last.groupBy(*PATH, "slice").agg(F.sum("n_tokens").alias("here"))
    upto = F.sum("here").over(Window.partitionBy(*PATH).orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    starts = sums.withColumn("start", upto - F.col("here"))
    # At most 2 ** SLICE_BITS rows a leaf.
    at = last.join(starts, [*PATH, "slice"])
    inside = at.where(F.col("start") + F.col("here") <= F.col("rest"))
    edge = at.where((F.col("start") + F.col("here") > F.col("rest")) & (F.col("start") < F.col("rest")))
    run = F.sum("n_tokens").over(Window.partitionBy(*PATH, "slice").orderBy("draw", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = edge.withColumn("run", run).where(F.col("start") + F.col("run") - F.col("n_tokens") / 2 <= F.col("rest"))
    partial = inside.unionByName(edge.drop("run")).withColumn("epoch", F.col("full") + 1)
    columns = ["doc_id", "source", "language", F.col("epoch").cast("int").alias("epoch"), "n_tokens"]
    selected = whole.select(*columns).unionByName(partial.select(*columns))

    used = selected.groupBy("source").agg(F.sum("n_tokens").alias("mix_tokens"), F.max("epoch").alias("epochs"))
    have = docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("available_tokens"))
    total = F.sum("mix_tokens").over(Window.partitionBy())
    zero = F.lit(0).cast("bigint")
    report = wanted.join(have, "source", "left").join(used, "source", "left")
    shares = report.select(
        "source", "target_share", "max_repeats", F.coalesce("documents", zero).alias("documents"), F.coalesce("available_tokens", zero).alias("available_tokens"),
        F.coalesce("mix_tokens", zero).alias("mix_tokens"), F.coalesce("epochs", F.lit(0)).alias("epochs"), F.coalesce(F.col("mix_tokens") / total, F.lit(0.0)).alias("actual_share"),
        F.coalesce(F.col("mix_tokens") >= F.col("available_tokens") * F.col("max_repeats"), F.lit(False)).alias("exhausted"),
    )
    return Mix(selected, shares, docs, budgets)
