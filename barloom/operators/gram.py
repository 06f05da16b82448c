"""Correlations of all pairs of columns, or of all pairs of items over shared rows, by one Gram matrix.

A task adds up outer products of its rows, block by block: with values and marks of what is there as
two matrices, four products give the count and the sums of every pair over the rows where both are
there. Values are taken off a centre first, so that sums of squares lose no digits. Tasks send one row a pair;
rows are never joined with themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIRS = "a string, b string, n long, sa double, sb double, saa double, sbb double, sab double"


class _Gram:
    """Sums over rows for every pair of names; nan is a value that isn't there."""

    def __init__(self, names: list[str]):
        import numpy as np

        self.names = names
        self.n, self.s, self.ss, self.p = (np.zeros((len(names), len(names))) for _ in range(4))

    def add(self, x) -> None:
        import numpy as np

        there = ~np.isnan(x)
        x, m = np.where(there, x, 0.0), there.astype(float)
        self.n += m.T @ m
        self.s += x.T @ m
        self.ss += (x * x).T @ m
        self.p += x.T @ x

    def batch(self):
        import numpy as np
        import pyarrow as pa

        i, j = np.nonzero(np.triu(self.n, 1))
        names = pa.array(self.names, pa.string())
        cols = [names.take(pa.array(i)), names.take(pa.array(j)), pa.array(self.n[i, j].astype(np.int64)), *(pa.array(x) for x in (self.s[i, j], self.s[j, i], self.ss[i, j], self.ss[j, i], self.p[i, j]))]
        return pa.RecordBatch.from_arrays(cols, [f.split(" ")[0] for f in PAIRS.split(", ")])


def _correlation() -> Column:
    n, sa, sb = F.sum("n"), F.sum("sa"), F.sum("sb")
    cov, va, vb = F.sum("sab") - sa * sb / n, F.sum("saa") - sa * sa / n, F.sum("sbb") - sb * sb / n
    small = lambda v, s: v > 1e-13 * F.sum(s)  # noqa: E731  what is left of a constant is rounding
    return F.when(small(va, "saa") & small(vb, "sbb"), cov / (F.sqrt(va) * F.sqrt(vb)))


def _columns(batches: Iterable, names: list[str]) -> Iterator:
    import numpy as np

    gram = _Gram(names)
    for batch in batches:
        if batch.num_rows:
            gram.add(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]))
    yield gram.batch()


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, n, r for each pair of columns, in the order given: Pearson over the rows where both are there and finite;
    null if one is constant there. A pair that shares no row has n 0."""
    fine = [F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf")), F.col(c).cast("double")).alias(c) for c in columns]
    df = df.select(*fine)
    centre = df.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns)).first()  # a number a column
    shifted = df.select(*((F.col(c) - F.lit(centre[c])).alias(c) for c in columns))
    sums = shifted.mapInArrow(lambda it: _columns(it, columns), PAIRS).groupBy("a", "b").agg(F.sum("n").alias("n"), _correlation().alias("r"))
    place = {c: k for k, c in enumerate(columns)}
    every = df.sparkSession.createDataFrame([(a, b, place[a], place[b]) for a, b in combinations(columns, 2)] or [("", "", 0, 0)], "a string, b string, i int, j int").where("i < j")
    return every.join(sums, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"), "r")


def _items(batches: Iterable, names: list[str], block: int) -> Iterator:
    import numpy as np

    gram, place = _Gram(names), {n: k for k, n in enumerate(names)}
    for batch in batches:
        rows = batch.column(0)
        offsets, flat = rows.offsets.to_numpy(), rows.flatten()
        at = np.array([place[x] for x in flat.field(0).to_pylist()], np.int64)
        value, row = flat.field(1).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(rows)), np.diff(offsets))
        for s in range(0, len(rows), block):
            own = (row >= s) & (row < s + block)
            x = np.full((min(block, len(rows) - s), len(names)), np.nan)
            x[row[own] - s, at[own]] = value[own]
            gram.add(x)
    yield gram.batch()


def item_correlations(df: DataFrame, row: list[str], item: str, value: str, block: int = 1024) -> DataFrame:
    """a, b, n, r for each pair of items (a below b) that share a row: Pearson of their values over shared rows. df has one
    value a row and item; a row's values stand together as a list, whose length is the number of items at most."""
    x = F.col(value).cast("double")
    df = df.select(*row, F.col(item).cast("string").alias("_item"), F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x).alias("_x")).where("_item IS NOT NULL AND _x IS NOT NULL")
    centres = {r["_item"]: r["m"] for r in df.groupBy("_item").agg(F.avg("_x").alias("m")).collect()}  # the result has the square of it
    names = sorted(centres)
    mean = df.groupBy("_item").agg(F.avg("_x").alias("_m"))
    lists = df.join(mean, "_item").groupBy(*row).agg(F.collect_list(F.struct("_item", (F.col("_x") - F.col("_m")).alias("x"))).alias("_row"))
    return lists.select("_row").mapInArrow(lambda it: _items(it, names, block), PAIRS).groupBy("a", "b").agg(F.sum("n").alias("n"), _correlation().alias("r"))
