"""Folding of repeated rows by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_upserts(events: DataFrame, key: str, order: list[str | Column], mutable: list[str]) -> DataFrame:
    """A row for each key: the first row's values, and of the mutable columns the last row's, nulls included.

    Both halves are one pass with partial aggregation, so a key with many rows costs no more than any other.
    """
    fixed = [c for c in events.columns if c != key and c not in mutable]
    at = F.struct(*order)
    sides = [F.min_by(F.struct(*fixed), at).alias("first")] if fixed else []
    sides += [F.max_by(F.struct(*mutable), at).alias("last")] if mutable else []
    out = events.groupBy(key).agg(*sides) if sides else events.select(key).distinct()
    return out.select(*[F.col(c) if c == key else F.col(f"last.{c}" if c in mutable else f"first.{c}") for c in events.columns])


def latest_changes(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last change of each key by stream position."""
    last = F.max_by(F.struct(*[c for c in changes.columns if c not in keys]), F.struct(*order)).alias("last")
    return changes.groupBy(*keys).agg(last).select(*[F.col(c) if c in keys else F.col(f"last.{c}") for c in changes.columns])
