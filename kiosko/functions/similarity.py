"""Similarities of two listings."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kiosko.functions import rules


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the first text."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str | None, b: str | None) -> float:
    """100 where equal, falling with insertions and deletions; two empty texts are equal."""
    a, b = a or "", b or ""
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * _lcs(a, b) / total


def token_set_ratio(a: str | None, b: str | None) -> float:
    """Ratio over word sets, so that words of one side alone count little; 0 where a side has no word."""
    left, right = set((a or "").split()), set((b or "").split())
    if not left or not right:
        return 0.0
    both = " ".join(sorted(left & right))
    x, y = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if both and (not x or not y):
        return 100.0
    gap = 1 if both else 0
    base = len(both) + gap
    apart = len(x) + len(y) - 2 * _lcs(x, y)
    best = 100.0 * (1 - apart / (2 * base + len(x) + len(y)))
    if not both:
        return best
    return max(best, *(100.0 * (1 - (gap + len(t)) / (len(both) + base + len(t))) for t in (x, y)))


def _each(f: Callable[[str | None, str | None], float]) -> Callable[[Column | str, Column | str], Column]:
    """A function of two texts over Arrow batches; nulls stay null."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype="float64")

    return lambda a, b: F.pandas_udf(run, "double")(a, b)


token_set = _each(token_set_ratio)
plain_ratio = _each(ratio)


def title_similarity(a: Column, b: Column) -> Column:
    """Of two normalised titles, 0 to 1. Equal, empty and containing word sets are settled on the JVM."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    shared = F.size(F.array_intersect(x, y))
    inside = (shared > 0) & (shared == F.least(F.size(x), F.size(y)))
    hard = ~((a == "") | (b == "") | inside)
    return F.when((a == "") | (b == ""), 0.0).when(inside, 1.0).otherwise(token_set(F.when(hard, a), F.when(hard, b)) / 100)


def time_similarity(a: Column, b: Column, tolerance: int = 90, instants: tuple[Column, Column] | None = None) -> Column:
    """Of two local times: linear decay; midnight means an unknown time and is neutral on the same day. Where the clocks
    may be of different zones, the distance is that of the instants."""
    unknown = lambda t: F.date_format(t, "HHmmss") == "000000"
    first, second = instants or (a.cast("timestamp"), b.cast("timestamp"))
    minutes = F.abs(F.unix_timestamp(first) - F.unix_timestamp(second)) / 60
    return (
        F.when(unknown(a) != unknown(b), F.when(F.to_date(a) == F.to_date(b), 0.5).otherwise(0.0))
        .when(minutes > tolerance, 0.0)
        .otherwise(1 - minutes / tolerance)
    )


def distance_similarity(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """1 within 100 m, 0 beyond 2 km, linear between; null where a coordinate is missing."""
    metres = F.sqrt(F.pow((lat1 - lat2) * 111_000, 2) + F.pow((lon1 - lon2) * 74_000, 2))
    return F.when(metres < 100, 1.0).when(metres > 2000, 0.0).otherwise(1 - (metres - 100) / 1900)


def venue_similarity(name1: Column, lat1: Column, lon1: Column, name2: Column, lat2: Column, lon2: Column) -> Column:
    """Distance where both have coordinates, names where both have one, else neutral."""
    near = distance_similarity(lat1, lon1, lat2, lon2)
    named = (name1 != "") & (name2 != "")
    asked = near.isNull() & named
    return F.coalesce(near, F.when(named, token_set(F.lower(F.when(asked, name1)), F.lower(F.when(asked, name2))) / 100), F.lit(0.5))


def weighted(title: Column, time: Column, venue: Column) -> Column:
    w = rules.WEIGHTS
    return w["title"] * title + w["time"] * time + w["venue"] * venue
