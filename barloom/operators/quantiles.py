"""Exact quantiles by distributed selection.

The value of a rank is bracketed by a quantile sketch, whose error is a bounded share of the rows; one
count tells how many rows lie below the bracket and in it, so the rank within it is known, and a bracket
that misses the rank is widened. Each round leaves a few thousandths of the rows. What is left below
FEW rows is counted by value and looked up. So no buffer holds the distinct values of a column, the
driver gets at most FEW values a column and round, and the result is that of a full sort.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows of a bracket that are looked up on the driver.
FEW = 4096
#: Accuracy of the sketch: its ranks are within n / ACCURACY.
ACCURACY = 2000


@dataclass
class _Search:
    """The value of one rank of a column: `rank` counts from 0 within [low, high], which holds `n` rows."""

    rank: int
    n: int
    low: float | None = None
    high: float | None = None
    slack: float = 2.0
    value: float | None = None
    #: Rows of the bracket that aren't above the value.
    upto: int = 0

    def inside(self, x: Column) -> Column:
        test = x.isNotNull()
        return test if self.low is None else test & (x >= self.low) & (x <= self.high)

    def ends(self) -> tuple[float, float]:
        off = self.slack / ACCURACY
        return max(0.0, self.rank / self.n - off), min(1.0, (self.rank + 1) / self.n + off)


def select(df: DataFrame, ranks: dict[str, tuple[str, int, int]]) -> dict[str, tuple[float, int]]:
    """By name: (value, rows up to it) of the rank from 0 of a column (column, rank, its rows without null). Columns
    must have no value that isn't a number. df is read a few times: it should be a stored table."""
    found = {k: _Search(rank, n) for k, (_, rank, n) in ranks.items()}
    passed = dict.fromkeys(ranks, 0)  # rows below the bracket
    while left := [k for k, s in found.items() if s.value is None]:
        few = [k for k in left if found[k].n <= FEW]
        if few:
            tagged = [df.where(found[k].inside(F.col(ranks[k][0]))).select(F.lit(k).alias("k"), F.col(ranks[k][0]).cast("double").alias("x")) for k in few]
            both = tagged[0]
            for t in tagged[1:]:
                both = both.union(t)
            held: dict[str, list] = {k: [] for k in few}
            for r in both.groupBy("k", "x").count().collect():  # at most FEW a name
                held[r["k"]].append((r["x"], r["count"]))
            for k in few:
                upto = 0
                for x, n in sorted(held[k]):
                    upto += n
                    if upto > found[k].rank:
                        found[k].value, found[k].upto = x, upto + passed[k]
                        break
            continue
        row = df.agg(*(F.percentile_approx(F.when(found[k].inside(F.col(ranks[k][0])), F.col(ranks[k][0]).cast("double")), list(found[k].ends()), ACCURACY).alias(k) for k in left)).first()
        tests = []
        for k in left:
            x, (low, high) = F.col(ranks[k][0]), row[k]
            tests += [F.count_if(found[k].inside(x) & (x < low)).alias(f"{k}|below"), F.count_if(found[k].inside(x) & (x <= high)).alias(f"{k}|upto")]
        counts = df.agg(*tests).first()
        for k in left:
            s, (low, high), below, upto = found[k], row[k], counts[f"{k}|below"], counts[f"{k}|upto"]
            if not below <= s.rank < upto:
                s.slack *= 4  # the sketch missed it
            elif low == high:
                s.value, s.upto = low, passed[k] + upto
            elif upto - below == s.n:  # no narrower: halve between the ends
                mid = low / 2 + high / 2
                at = df.agg(F.count_if(s.inside(F.col(ranks[k][0])) & (F.col(ranks[k][0]) <= mid))).first()[0]
                if at > s.rank:
                    s.high, s.n = mid, at
                else:
                    s.low, s.rank, s.n, passed[k] = math.nextafter(mid, math.inf), s.rank - at, s.n - at, passed[k] + at
            else:
                s.low, s.high, s.rank, s.n, s.slack = low, high, s.rank - below, upto - below, 2.0
                passed[k] += below
    return {k: (s.value, s.upto) for k, s in found.items()}


def quantiles(df: DataFrame, wanted: dict[str, tuple[Column, float]]) -> dict[str, float | None]:
    """By name: the exact quantile of a column, linear between ranks; nulls and values that aren't finite are left
    out, and a column without any value gives None. Runs jobs, and holds df's columns while it does."""
    fine = {k: F.when(~F.isnan(c.cast("double")) & (F.abs(c) < float("inf")), c.cast("double")) for k, (c, _) in wanted.items()}
    held = df.select(*(c.alias(k) for k, c in fine.items())).persist()
    try:
        sizes = held.agg(*(F.count(k).alias(k) for k in wanted)).first()
        place = {k: q * (sizes[k] - 1) for k, (_, q) in wanted.items() if sizes[k]}
        low = select(held, {k: (k, math.floor(p), sizes[k]) for k, p in place.items()})
        out: dict[str, float | None] = dict.fromkeys(wanted)
        beyond = [k for k, p in place.items() if p > math.floor(p) and low[k][1] <= math.floor(p) + 1]
        above = held.agg(*(F.min(F.when(F.col(k) > low[k][0], F.col(k))).alias(k) for k in beyond)).first() if beyond else {}
        for k, p in place.items():
            a = low[k][0]
            out[k] = a + (above[k] - a) * (p - math.floor(p)) if k in beyond else a
        return out
    finally:
        held.unpersist()
