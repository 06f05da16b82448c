"""Forward labels and first-touch outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import chunked, framed, numbered


def add_labels(tape: DataFrame, horizon: int, place: str | None = None) -> DataFrame:
    """label_open_next, label_close_h, label_min_h, label_max_h, label_max_first. Null where the
    horizon isn't complete. Equal extremes: the first bar counts."""
    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        ahead = w.rowsBetween(1, horizon)
        full = F.count(F.lit(1)).over(ahead) == horizon
        low = F.min(F.struct(F.col("low"), F.col("bar"))).over(ahead)
        high = F.min(F.struct(-F.col("high"), F.col("bar"))).over(ahead)
        return df.withColumns({
            "label_open_next": F.lead("open", 1).over(w),
            "label_close_h": F.lead("close", horizon).over(w),
            "label_min_h": F.when(full, low["low"]),
            "label_max_h": F.when(full, -high["col1"]),
            "label_max_first": F.when(full, (high["bar"] < low["bar"]).cast("int")),
        })

    return framed(tape, 0, horizon, compute, place=place)


def drop_tail(df: DataFrame, horizon: int) -> DataFrame:
    return numbered(df, "_rn", total="_n").where(F.col("_rn") < F.col("_n") - horizon).drop("_rn", "_n")


class Extrema:
    """The largest value of every run of 2^k rows, by k: a run's first row beyond a level is found in
    as many steps as there are k."""

    def __init__(self, values, longest: int):
        import numpy as np

        self.runs = [np.append(np.where(np.isnan(values), -np.inf, values), -np.inf)]  # nothing touches beyond the end
        for k in range(longest.bit_length() - 1):
            last, step = self.runs[-1], 1 << k
            self.runs.append(np.maximum(last, np.append(last[step:], np.full(min(step, len(last)), -np.inf))))

    def first(self, level, longest: int):
        """For each row: how many rows after it the first value of at least its level stands, 0 if
        none of the next `longest` is."""
        import numpy as np

        at, left, end = np.arange(len(level)) + 1, np.full(len(level), longest), len(self.runs[0]) - 1
        for k in range(len(self.runs) - 1, -1, -1):
            skip = (left >= 1 << k) & (self.runs[k][np.minimum(at, end)] < level)
            at[skip] += 1 << k
            left[skip] -= 1 << k
        return np.where(left > 0, longest - left + 1, 0)


def _outcomes(table, horizon: int, cases: list[tuple[str, float, float]]):
    """A chunk's core rows with the lists _ret and _off, an item for each case."""
    import numpy as np
    import pyarrow as pa

    table = table.sort_by("_pos").combine_chunks()
    price = {c: table.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("open", "high", "low", "close")}
    n = table.num_rows
    core = np.flatnonzero(table.column("_core").to_numpy())
    entry, last = np.full(n, np.nan), np.full(n, np.nan)
    entry[:-1] = price["open"][1:]
    if n > horizon:
        last[: n - horizon] = price["close"][horizon:]
    ok = np.isfinite(entry) & (entry > 0) & ~np.isnan(last)
    highest, lowest = Extrema(price["high"], horizon), Extrema(-price["low"], horizon)
    safe = np.where(ok, entry, np.inf)
    touch: dict[tuple[str, float], object] = {}  # a level is searched once for all cases that have it

    def touched(side: str, by: float):
        if (side, by) not in touch:
            level = safe * (1 + by / 100) if side == "up" else -safe * (1 - by / 100)
            touch[side, by] = (highest if side == "up" else lowest).first(np.where(ok, level, np.inf), horizon)
        return touch[side, by]

    ret, off = np.full((len(core), len(cases)), np.nan), np.full((len(core), len(cases)), -1, np.int32)
    for j, (direction, tp, sl) in enumerate(cases):
        long = direction == "long"
        tp_at, sl_at = (touched("up", tp), touched("down", sl)) if long else (touched("down", tp), touched("up", sl))
        stop = (sl_at > 0) & ((tp_at == 0) | (sl_at <= tp_at))
        with np.errstate(invalid="ignore"):
            held = (last / safe - 1) * (100 if long else -100)
        r = np.where(stop, -sl, np.where(tp_at > 0, tp, held))
        o = np.where(stop, sl_at, np.where(tp_at > 0, tp_at, horizon))
        ret[:, j], off[:, j] = np.where(ok, r, np.nan)[core], np.where(ok, o, -1)[core]
    out = table.take(pa.array(core)).drop_columns(["_pos", "_chunk", "_core"])
    flat = pa.array(ret.ravel(), from_pandas=True)  # not a number is null
    sizes = pa.array(np.arange(len(core) + 1, dtype=np.int32) * len(cases))
    out = out.append_column("_ret", pa.ListArray.from_arrays(sizes, flat))
    return out.append_column("_off", pa.ListArray.from_arrays(sizes, pa.array(off.ravel())))


def with_outcomes(tape: DataFrame, horizon: int, cases: list[tuple[str, float, float]], place: str | None = None) -> DataFrame:
    """The tape with the lists _ret and _off: for each (direction, tp, sl) the outcome of an entry at
    the next open and its bar ahead. A chunk of a symbol, with the horizon after it, is one group."""
    schema = T.StructType([*tape.schema.fields, T.StructField("_ret", T.ArrayType(T.DoubleType())), T.StructField("_off", T.ArrayType(T.IntegerType()))])
    return chunked(tape, 0, horizon, place=place).groupBy("symbol", "_chunk").applyInArrow(lambda table: _outcomes(table, horizon, cases), schema)


def barrier(tape: DataFrame, horizon: int, grid: list[tuple[float, float]], directions: tuple[str, ...] = ("long", "short"), place: str | None = None) -> DataFrame:
    """symbol, bar, direction, tp, sl, return_pct, exit_offset: the first of take-profit and
    stop that a later bar touches. Entry at the next open; a bar that touches both is a stop;
    none: the close at the horizon. Null and -1 where the horizon or the entry isn't there."""
    cases = [(d, float(tp), float(sl)) for d in directions for tp, sl in sorted(grid)]
    df = with_outcomes(tape.select("symbol", "datetime", "bar", "open", "high", "low", "close"), horizon, cases, place)
    named = F.array(*(F.struct(F.lit(d).alias("direction"), F.lit(tp).alias("tp"), F.lit(sl).alias("sl")) for d, tp, sl in cases))
    df = df.select("symbol", "bar", F.explode(F.arrays_zip(named.alias("c"), F.col("_ret").alias("r"), F.col("_off").alias("o"))).alias("x"))
    return df.select("symbol", "bar", "x.c.*", F.col("x.r").alias("return_pct"), F.col("x.o").alias("exit_offset"))


def pair_name(direction: str, tp: float, sl: float, what: str) -> str:
    """The column of an outcome of a wide tape: numbers are written shortly (2, 1.5, 0.25)."""
    return f"_{what}_{direction}_tp{tp:.8g}_sl{sl:.8g}"


def attach_barriers(tape: DataFrame, horizon: int, tps: list[float], sls: list[float], directions: tuple[str, ...] = ("long", "short"), place: str | None = None) -> DataFrame:
    """The tape with a return and an offset column for each direction and pair of the sorted grid."""
    cases = [(d, float(tp), float(sl)) for d in directions for tp in sorted(set(tps)) for sl in sorted(set(sls))]
    cols = [F.get(f"_{what}", F.lit(j)).alias(pair_name(d, tp, sl, what)) for j, (d, tp, sl) in enumerate(cases) for what in ("ret", "off")]
    return with_outcomes(tape, horizon, cases, place).select(*tape.columns, *cols)


def returns(df: DataFrame) -> DataFrame:
    """close_ret, max_ret, min_ret in percent of the entry."""
    of = lambda c: (F.try_divide(F.col(c), F.col("label_open_next")) - 1) * 100
    return df.withColumns({"close_ret": of("label_close_h"), "max_ret": of("label_max_h"), "min_ret": of("label_min_h")})


def aggregate_outcome(df: DataFrame, tp: float, sl: float, direction: str = "long") -> Column:
    """Outcome in percent from the horizon's extremes and which came first."""
    up, down = (F.col("max_ret"), F.col("min_ret")) if direction == "long" else (-F.col("min_ret"), -F.col("max_ret"))
    good_first = F.col("label_max_first") == (1 if direction == "long" else 0)
    close = F.col("close_ret") if direction == "long" else -F.col("close_ret")
    hit, lost = up >= tp, down <= -sl
    return F.when(hit & lost, F.when(good_first, tp).otherwise(-sl)).when(hit, tp).when(lost, -sl).otherwise(close)


def exit_reason(ret: Column, tp: Column, sl: Column, horizon: int) -> Column:
    return F.when(F.abs(ret - tp) <= 1e-5, "TP").when(F.abs(ret + sl) <= 1e-5, "SL").otherwise(f"Time_{horizon}")


def three_class(outcome: Column, tp: float, sl: float) -> Column:
    """2 win, 1 neither, 0 loss."""
    return F.when(outcome >= tp, 2).when(outcome <= -sl, 0).when(outcome.isNotNull(), 1)
