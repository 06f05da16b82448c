"""Backward-looking indicators, regimes, as-of alignment and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.sources.store import settled

from .chunks import carried, framed, numbered
from .quantiles import quantiles

BULLISH, RANGE, BEARISH, NOISY = 1, 0, -1, 2


def finite(col: Column) -> Column:
    return F.when(F.isnan(col) | (F.abs(col) == float("inf")), None).otherwise(col)


def _efficiency(df: DataFrame, w: WindowSpec, lookback: int, name: str) -> DataFrame:
    frame = w.rowsBetween(-(lookback - 1), 0)
    df = df.withColumn("_step", F.abs(F.col("close") - F.lag("close").over(w)))
    path = F.when(F.count("_step").over(frame) == lookback, F.sum("_step").over(frame))
    return df.withColumn(name, F.try_divide(F.col("close") - F.lag("close", lookback).over(w), F.nullif(path, F.lit(0.0)))).drop("_step")


def _range(df: DataFrame, w: WindowSpec, period: int, name: str) -> DataFrame:
    before, frame = F.lag("close").over(w), w.rowsBetween(-(period - 1), 0)
    df = df.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    return df.withColumn(name, F.when(F.count("_tr").over(frame) == period, F.avg("_tr").over(frame))).drop("_tr")


def _volatility(df: DataFrame, w: WindowSpec, window: int, name: str) -> DataFrame:
    before, frame = F.lag("close").over(w), w.rowsBetween(-(window - 1), 0)
    df = df.withColumn("_lr", F.when((F.col("close") > 0) & (before > 0), F.log(F.col("close") / before)))
    return df.withColumn(name, F.when(F.count("_lr").over(frame) == window, F.stddev_samp("_lr").over(frame))).drop("_lr")


def signed_efficiency(df: DataFrame, lookback: int, name: str = "efficiency", place: str | None = None) -> DataFrame:
    return framed(df, lookback, 0, lambda d, w: _efficiency(d, w, lookback, name), place=place)


def true_range(df: DataFrame, period: int, name: str = "atr") -> DataFrame:
    return framed(df, period, 0, lambda d, w: _range(d, w, period, name))


def realized_volatility(df: DataFrame, window: int, name: str = "rv") -> DataFrame:
    return framed(df, window, 0, lambda d, w: _volatility(d, w, window, name))


def price_indicators(df: DataFrame, lookback: int, efficiency: str = "efficiency", atr: str = "atr", rv: str = "rv", place: str | None = None) -> DataFrame:
    """The three above with one lookback, in one pass over the chunks."""
    return framed(df, lookback, 0, lambda d, w: _volatility(_range(_efficiency(d, w, lookback, efficiency), w, lookback, atr), w, lookback, rv), place=place)


def ema(df: DataFrame, spans: dict[str, int], place: str | None = None) -> DataFrame:
    """Exponential means of close by name: y = x at first, then a x + (1 - a) y. The rows of a
    symbol are numbered and cut into blocks; within a block the mean is a weighted running sum, and
    what the blocks before hand on is a fold over one row a block. So no task holds a symbol's tape."""
    import math

    alpha = {n: 2 / (span + 1) for n, span in spans.items()}
    # Weights within a block stay below 1e200.
    block = min([4096, *(max(1, int(460 / -math.log(1 - a))) for a in alpha.values() if a < 1)])
    df = df.withColumn("_n", F.col(place)) if place else numbered(df, "_n")
    df = df.withColumns({"_block": F.floor(F.col("_n") / block), "_pos": F.col("_n") % block})
    inside = Window.partitionBy("symbol", "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    local = {}
    for n, a in alpha.items():
        own = F.when(F.col("_n") == 0, F.col("close")).otherwise(a * F.col("close"))
        local[f"_{n}"] = own if a >= 1 else F.sum(own * F.pow(F.lit(1 - a), -F.col("_pos"))).over(inside) * F.pow(F.lit(1 - a), F.col("_pos"))
    df = df.withColumns(local)
    ends = df.groupBy("symbol", "_block").agg(F.count("*").alias("size"), *(F.max_by(f"_{n}", "_pos").alias(n) for n in alpha))
    ends = ends.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("_block", "size", *alpha))).alias("ends"))
    zero = F.struct(F.array().cast(f"array<struct<_block:bigint,{','.join(f'{n}:double' for n in alpha)}>>").alias("out"), *(F.lit(0.0).alias(n) for n in alpha))

    def step(acc, x):
        before = F.struct(x["_block"].cast("bigint").alias("_block"), *(acc[n].alias(n) for n in alpha))
        return F.struct(F.concat(acc["out"], F.array(before)).alias("out"), *((x[n] + F.pow(F.lit(1 - a), x["size"]) * acc[n]).alias(n) for n, a in alpha.items()))

    carried = ends.select("symbol", F.explode(F.aggregate("ends", zero, step, lambda acc: acc["out"])).alias("c"))
    carried = carried.select("symbol", F.col("c._block").alias("_block"), *(F.col(f"c.{n}").alias(f"_before_{n}") for n in alpha))
    out = df.join(carried, ["symbol", "_block"])
    out = out.withColumns({n: F.col(f"_{n}") + F.pow(F.lit(1 - a), F.col("_pos") + 1) * F.col(f"_before_{n}") for n, a in alpha.items()})
    return out.drop("_n", "_block", "_pos", *(f"_{n}" for n in alpha), *(f"_before_{n}" for n in alpha))


def structural_inputs(df: DataFrame, lookback: int, place: str = "_place") -> DataFrame:
    """efficiency, spread and rv, and the column place: a row's place in its symbol, taken as it is if df has it."""
    df = ema(df if place in df.columns else numbered(df, place), {"_fast": max(2, lookback // 2), "_slow": max(4, lookback)}, place)
    df = price_indicators(df, lookback, atr="_atr", place=place)
    return df.withColumn("spread", F.try_divide(F.col("_fast") - F.col("_slow"), F.nullif(F.col("_atr"), F.lit(0.0)))).drop("_fast", "_slow", "_atr")


def fit_thresholds(df: DataFrame, q_eff: float = 0.55, q_spread: float = 0.55, q_rv: float = 0.45) -> DataFrame:
    """One row: pooled exact quantiles, linear between ranks, by distributed selection. Runs jobs."""
    found = quantiles(df, {"eff_t": (F.abs("efficiency"), q_eff), "spread_t": (F.abs("spread"), q_spread), "rv_t": (F.col("rv"), q_rv)})
    return df.sparkSession.createDataFrame([tuple(found.values())], "eff_t double, spread_t double, rv_t double")


def classify(df: DataFrame, thresholds: DataFrame, name: str = "state") -> DataFrame:
    """Regime; a later assignment wins: bullish, bearish, range; anything missing is noisy."""
    df = df.crossJoin(F.broadcast(thresholds))  # one row
    e, s, v = F.col("efficiency"), F.col("spread"), F.col("rv")
    quiet = (F.abs(e) < F.col("eff_t")) & (v < F.col("rv_t")) & (v >= 0)
    up = (e >= F.col("eff_t")) & (s >= F.col("spread_t"))
    down = (e <= -F.col("eff_t")) & (s <= -F.col("spread_t"))
    return df.withColumn(name, F.when(quiet, RANGE).when(down, BEARISH).when(up, BULLISH).otherwise(NOISY)).drop("eff_t", "spread_t", "rv_t")


def higher_bars(tape: DataFrame, width: str, base_per_bar: int, complete: bool = True) -> DataFrame:
    out = tape.groupBy("symbol", F.window("datetime", width).alias("w")).agg(
        F.min_by("open", "datetime").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "datetime").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n_base"))
    out = out.select("symbol", F.col("w.start").alias("datetime"), F.col("w.end").alias("close_time"), "open", "high", "low", "close", "volume", "n_base")
    return out.where(F.col("n_base") == base_per_bar) if complete else out


def as_of(rows: DataFrame, states: DataFrame, at: Column, name: str) -> DataFrame:
    """The last state (symbol, close_time, state) known at a row's time, inclusive; none: noisy.
    Both sides are sorted by symbol and slot of time, no join of rows; slots hand their last state on."""
    left = rows.withColumn("_t", at).withColumn("_kind", F.lit(1)).withColumn(name, F.lit(None).cast("int"))
    right = states.select("symbol", F.col("close_time").alias("_t"), F.lit(0).alias("_kind"), F.col("state").cast("int").alias(name))
    both = carried(left.unionByName(right, allowMissingColumns=True), name, ["_t", "_kind"], "_t").where("_kind = 1")
    return both.withColumn(name, F.coalesce(F.col(name), F.lit(NOISY))).drop("_t", "_kind")


def permissions(df: DataFrame, lookback: int = 24, allow_mid_range: bool = True, include_range: bool = True, gate: bool = False, place: str | None = None) -> DataFrame:
    """Permission and pullback trigger of both directions from hwc, mwc and lwc states."""
    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        prior = w.rowsBetween(-lookback, -1)
        for d, good, bad in (("long", BULLISH, BEARISH), ("short", BEARISH, BULLISH)):
            mid = F.col("mwc_state").isin(good, RANGE) if allow_mid_range else F.col("mwc_state") == good
            df = df.withColumn(f"tf_permission_{d}", ((F.col("hwc_state") == good) & mid).cast("int"))
            mark = F.col("lwc_state").isin(bad, RANGE) if include_range else F.col("lwc_state") == bad
            mark = mark & (F.col(f"tf_permission_{d}") == 1) if gate else mark
            df = df.withColumn("_mark", mark.cast("int"))
            df = df.withColumn(f"lwc_pullback_reversal_{d}", ((F.col("lwc_state") == good) & (F.coalesce(F.sum("_mark").over(prior), F.lit(0)) > 0)).cast("int")).drop("_mark")
        return df

    return framed(df, lookback, 0, compute, place=place)


def fit_all(tape: DataFrame, lookback: int, mid: tuple[str, int], high: tuple[str, int], fraction: float = 0.65) -> dict[str, DataFrame]:
    """Thresholds of the three timeframes, each fitted on the first part of its own bars."""
    return {k: fit_thresholds(train_prefix(x, fraction)) for k, x in timeframes(tape, lookback, mid, high).items()}


def timeframes(tape: DataFrame, lookback: int, mid: tuple[str, int], high: tuple[str, int]) -> dict[str, DataFrame]:
    """The bars of the three timeframes with their structural inputs, stored: several steps read them."""
    bars = {"lwc": tape, "mwc": higher_bars(tape, *mid), "hwc": higher_bars(tape, *high)}
    return {k: settled(structural_inputs(x, lookback)) for k, x in bars.items()}


def enrich(tape: DataFrame, lookback: int, mid: tuple[str, int], high: tuple[str, int], base_step: str, fraction: float = 0.65, thresholds: dict[str, DataFrame] | None = None, warm_up: bool = True) -> DataFrame:
    """All seven context columns. Thresholds are fitted on each symbol's first part alone, unless
    they are given. warm_up=False leaves out rows whose own indicators aren't there yet."""
    inputs = timeframes(tape, lookback, mid, high)
    thresholds = thresholds or {k: fit_thresholds(train_prefix(x, fraction)) for k, x in inputs.items()}
    ready = F.col("efficiency").isNotNull() & F.col("spread").isNotNull() & F.col("rv").isNotNull()
    rows = classify(inputs["lwc"].withColumn("_ready", ready), thresholds["lwc"], "lwc_state").drop("efficiency", "spread", "rv")
    at = F.col("datetime") + F.expr(f"INTERVAL {base_step}")
    for key in ("mwc", "hwc"):
        states = classify(inputs[key], thresholds[key], "state")
        rows = as_of(rows, states.select("symbol", "close_time", "state"), at, f"{key}_state")
    rows = permissions(rows, place="_place")
    return (rows if warm_up else rows.where("_ready")).drop("_ready", "_place")


def enrich_target(target: DataFrame, history: DataFrame | None, lookback: int, mid: tuple[str, int], high: tuple[str, int], base_step: str, thresholds: dict[str, DataFrame]) -> DataFrame:
    """The rows of target with context, warmed up by history; thresholds are never fitted here.
    Raises if a key of the target occurs twice, or in the history too."""
    keys = ["datetime", "symbol"]
    if not target.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("the target has two rows of one key")
    if history is not None and not history.select(*keys).join(target.select(*keys), keys, "left_semi").isEmpty():
        raise ValueError("a key is both history and target")
    both = target if history is None else history.unionByName(target)
    return enrich(both, lookback, mid, high, base_step, thresholds=thresholds, warm_up=False).join(target.select(*keys), keys, "left_semi")


def train_prefix(df: DataFrame, fraction: float) -> DataFrame:
    return numbered(df, "_rn", total="_n").where(F.col("_rn") < F.floor(F.col("_n") * fraction)).drop("_rn", "_n")


def coverage(df: DataFrame, direction: str) -> DataFrame:
    """Counts of permission and trigger, in all and by symbol."""
    p, t = F.col(f"tf_permission_{direction}") == 1, F.col(f"lwc_pullback_reversal_{direction}") == 1
    return df.rollup("symbol").agg(
        F.count("*").alias("n_rows"), F.count_if(p).alias("permission"), F.count_if(t).alias("trigger"), F.count_if(p & t).alias("both"),
        F.count_if(p & ~t).alias("permission_only"), F.count_if(t & ~p).alias("trigger_only"), F.count_if(~p & ~t).alias("neither"),
    ).withColumn("symbol", F.coalesce("symbol", F.lit("ALL")))


def floor_failures(cov: DataFrame, floors: dict[str, int]) -> DataFrame:
    checks = [F.when(F.col(k) < v, F.lit(f"{k}<{v}")) for k, v in floors.items()]
    return cov.select("symbol", F.array_join(F.array_compact(F.array(*checks)), ";").alias("failures"))


#: The context columns of an enriched tape (fixed values).
STATES = ("hwc_state", "mwc_state", "lwc_state")
FLAGS = ("tf_permission_long", "tf_permission_short", "lwc_pullback_reversal_long", "lwc_pullback_reversal_short")


def context_faults(df: DataFrame, lookback: int = 24, allow_mid_range: bool = True) -> DataFrame:
    """One row of counts, all 0 for a sound enriched tape: missing values, unknown states, flags
    that aren't 0 or 1, permissions against the states, both permissions at once, and triggers
    that a recomputation doesn't give (only where a symbol's own rows cover the lookback)."""
    missing = [c for c in (*STATES, *FLAGS) if c not in df.columns]
    if missing:
        raise ValueError(f"no context columns {missing}")
    again = permissions(numbered(df.withColumns({f"_was_{c}": F.col(c) for c in FLAGS}), "_n"), lookback, allow_mid_range)
    c = F.col
    differs = lambda names: reduce(lambda a, b: a | b, (~c(f"_was_{n}").eqNullSafe(c(n)) for n in names))
    checks = {
        "missing": reduce(lambda a, b: a | b, (c(n).isNull() for n in (*STATES, *(f"_was_{f}" for f in FLAGS)))),
        "bad_state": reduce(lambda a, b: a | b, (~c(n).isin(BEARISH, RANGE, BULLISH, NOISY) for n in STATES)),
        "bad_flag": reduce(lambda a, b: a | b, (~c(f"_was_{n}").isin(0, 1) for n in FLAGS)),
        "bad_permission": differs(FLAGS[:2]), "both_permissions": (c("_was_tf_permission_long") == 1) & (c("_was_tf_permission_short") == 1),
        "bad_trigger": (c("_n") >= lookback) & differs(FLAGS[2:]),
    }
    return again.agg(F.count("*").alias("n_rows"), *(F.count_if(v).alias(k) for k, v in checks.items()))


def check_context(df: DataFrame, lookback: int = 24, allow_mid_range: bool = True) -> None:
    """Raise on any fault of an enriched tape."""
    faults = {k: v for k, v in context_faults(df, lookback, allow_mid_range).first().asDict().items() if k != "n_rows" and v}
    if faults:
        raise ValueError(f"context contract: {faults}")


def preflight(df: DataFrame, windows: dict[str, tuple[int, int]], direction: str, floors: dict[str, int]) -> DataFrame:
    """Coverage of each window that the search will sample (name: first and last bar), for all
    symbols and each, and the floors that it misses. One scan: a row goes to the windows it is in."""
    names = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in windows.items()))
    rows = df.withColumn("_w", F.explode(F.filter(names, lambda w: F.col("bar").between(w.a, w.b)))).withColumn("window", F.col("_w.name")).drop("_w")
    p, t = F.col(f"tf_permission_{direction}") == 1, F.col(f"lwc_pullback_reversal_{direction}") == 1
    cov = rows.groupBy("window", "symbol").agg(F.count("*").alias("n_rows"), F.count_if(p).alias("permission"), F.count_if(t).alias("trigger"), F.count_if(p & t).alias("both"))
    all_ = cov.groupBy("window").agg(F.lit("ALL").alias("symbol"), *(F.sum(k).alias(k) for k in ("n_rows", "permission", "trigger", "both")))
    both = all_.unionByName(cov)
    checks = [F.when(F.col(k) < v, F.lit(f"{k}<{v}")) for k, v in floors.items()]
    return both.withColumn("failures", F.array_join(F.array_compact(F.array(*checks)), ";"))
