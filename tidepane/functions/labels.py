"""Label sets: canonical forms, look-ups and matchers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

METRIC_LABEL = "__name__"


def label(labels: Column | str, name: str) -> Column:
    """Value of a label; a missing one, a null one and null labels all give ``''``."""
    labels = F.col(labels) if isinstance(labels, str) else labels
    return F.coalesce(F.try_element_at(labels, F.lit(name)), F.lit(""))


def pairs(labels: Column | str) -> Column:
    """Entries of a label map without empty values, sorted by name; null for null labels."""
    labels = F.col(labels) if isinstance(labels, str) else labels
    return F.sort_array(F.filter(F.map_entries(labels), lambda e: F.coalesce(e["value"], F.lit("")) != ""))


def series_identity(labels: Column | str) -> Column:
    """One string per label set: JSON of the sorted pairs.

    JSON quotes names and values, so sets that differ only in where a name ends
    and its value begins stay distinct. Null labels give null.
    """
    return F.to_json(F.map_from_entries(pairs(labels)))


def source_key(labels: Column | str) -> Column:
    """Pairs with non-empty values as ``name=value``, sorted by name, joined by ``;``."""
    return F.concat_ws(";", F.transform(pairs(labels), lambda e: F.concat(e["key"], F.lit("="), e["value"])))


def pair_set_digest(pairs_array: Column | str) -> Column:
    """SHA-256 of an array of (name, value) structs read as a set.

    Pairs with empty or null value are left out, order and repetition do not
    count. The digest is taken over JSON, which keeps different sets apart, and
    is 256 bits long, so equal digests mean equal sets. Null arrays give null.
    """
    pairs_array = F.col(pairs_array) if isinstance(pairs_array, str) else pairs_array
    kept = F.filter(pairs_array, lambda p: p.isNotNull() & (F.coalesce(p["value"], F.lit("")) != ""))
    canonical = F.sort_array(F.array_distinct(F.transform(kept, lambda p: F.struct(p["name"].alias("n"), p["value"].alias("v")))))
    return F.when(pairs_array.isNotNull(), F.unhex(F.sha2(F.to_json(canonical), 256)))


def without_labels(labels: Column | str, names: Sequence[str]) -> Column:
    """The label map without the given names."""
    labels = F.col(labels) if isinstance(labels, str) else labels
    return F.map_filter(labels, lambda k, _: ~k.isin(*names)) if names else labels


def only_labels(labels: Column | str, names: Sequence[str]) -> Column:
    """The label map reduced to the given names, without empty values."""
    labels = F.col(labels) if isinstance(labels, str) else labels
    return F.map_filter(labels, lambda k, v: k.isin(*names) & (F.coalesce(v, F.lit("")) != "")) if names else F.create_map().cast("map<string,string>")


def matches(labels: Column | str, name: str, op: str, value: str) -> Column:
    """A matcher ``name op "value"``; regular expressions match the whole value."""
    return compared(label(labels, name), op, value)


def compared(found: Column, op: str, value: str) -> Column:
    """The comparison of a matcher with the value of its label, which is ``''`` where it is missing."""
    if op == "=":
        return found == F.lit(value)
    if op == "!=":
        return found != F.lit(value)
    whole = found.rlike(rf"\A(?s:{value})\z")
    if op == "=~":
        return whole
    if op == "!~":
        return ~whole
    raise ValueError(f"unknown matcher operator {op!r}")
