"""Array and date functions that have no name in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def searchsorted(edges: Column, value: Column, right: bool = False) -> Column:
    """How many of the edges, which are in order, are below a value (or, with right, not above it); null for a missing
    value. The edges are halved, not read through."""
    start = F.struct(F.lit(0).alias("a"), F.size(edges).alias("b"))

    def halve(x, _):
        mid = F.floor((x["a"] + x["b"]) / 2).cast("int")
        at = F.get(edges, mid)
        below = (at <= value) if right else (at < value)
        more = F.coalesce(below, F.lit(False)) & (x["a"] < x["b"])
        return F.struct(F.when(more, mid + 1).otherwise(x["a"]).alias("a"), F.when(more | (x["a"] >= x["b"]), x["b"]).otherwise(mid).alias("b"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(edges) + 1.0)).cast("int"))
    return F.when(value.isNotNull() & edges.isNotNull(), F.aggregate(steps, start, halve)["a"])


def bincount(values: Column, least: int) -> Column:
    """An array of at least `least` counts: how often 0, 1, ... occur in an array of whole numbers; a number below 0 is an error."""
    fine = F.transform(F.filter(values, lambda x: x.isNotNull()), lambda x: F.when(x >= 0, x).otherwise(F.raise_error(F.lit("bincount of a number below 0")).cast("int")))
    top = F.greatest(F.coalesce(F.array_max(fine), F.lit(-1)), F.lit(least - 1))
    places = F.when(top >= 0, F.sequence(F.lit(0), top)).otherwise(F.array().cast("array<int>"))
    sorted_ = F.array_sort(fine)
    return F.when(values.isNotNull(), F.transform(places, lambda k: searchsorted(sorted_, k, right=True) - searchsorted(sorted_, k)))


def strip_zone(text: Column) -> Column:
    """The wall-clock time of a text like 2024-01-01T05:00:00+02:00: its zone is left out, not applied."""
    return F.regexp_replace(F.regexp_replace(text, "T", " "), r"(Z|[+-][0-9]{2}:?[0-9]{2})$", "").try_cast("timestamp_ntz")
