"""Calendar windows of an account: summary, penalty and gates.

A row of `windows` is one window of one plan: window_id, total_return_pct, profit_factor,
max_drawdown_pct, trades. A plan has a bounded number of windows, so its ordered statistics are
one pass over a list of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gates import over, under


@dataclass(frozen=True)
class Months:
    """Limits of windows (values that results must be comparable under)."""

    good_return: float = 0.5
    flat: float = 0.50
    active_trades: int = 3
    trade_floor: int = 20
    recency: float = 2.2


def counts_as_good(ret: Column, least: float, above_zero: bool = False) -> Column:
    """A return of `least` or more; at a limit of zero, not below it, or above it on request."""
    return ret >= least if least > 0 else (ret > 0 if above_zero else ret >= 0)


def summary(windows: DataFrame, keys: list[str], m: Months = Months()) -> DataFrame:  # noqa: B008
    """22 statistics of each plan's windows."""
    cols = ["window_id", "total_return_pct", "profit_factor", "max_drawdown_pct", "trades"]
    rows = F.sort_array(F.collect_list(F.struct(*cols)))
    ret, pf, dd, n = F.col("total_return_pct"), F.col("profit_factor"), F.col("max_drawdown_pct"), F.col("trades")
    active = n >= max(1, m.active_trades)
    ratio = lambda c: F.count_if(c) / F.count("*")
    out = windows.groupBy(*keys).agg(
        F.count("*").alias("windows"), F.count_if(active & counts_as_good(ret, m.good_return)).alias("profitable_windows"), ratio(active & counts_as_good(ret, m.good_return)).alias("profitable_ratio"),
        F.avg(ret).alias("mean_return_pct"), F.median(ret).alias("median_return_pct"), F.min(ret).alias("worst_return_pct"), F.max_by("total_return_pct", "window_id").alias("latest_return_pct"),
        F.coalesce(F.avg(F.when(active, pf)), F.lit(0.0)).alias("mean_profit_factor"), F.coalesce(F.min(F.when(active, pf)), F.lit(0.0)).alias("worst_profit_factor"), F.max(dd).alias("worst_drawdown_pct"),
        F.min(n).alias("min_trades"), F.avg(n).alias("mean_trades"), F.count_if(active).alias("active_windows"), ratio(active).alias("active_ratio"), F.count_if(~active).alias("inactive_windows"),
        F.count_if(active & (ret < -m.flat)).alias("bearish_windows"), ratio(active & (ret < -m.flat)).alias("bearish_ratio"), rows.alias("_rows"),
    )
    size = F.size("_rows")
    weights = F.transform("_rows", lambda x, i: F.lit(1.0) + (m.recency - 1.0) * i / F.greatest(size - 1, F.lit(1)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    weighted = total(F.zip_with(weights, "_rows", lambda w, x: w * x.total_return_pct)) / total(weights)
    start = F.struct(F.lit(1.0).alias("eq"), F.lit(None).cast("double").alias("top"), F.lit(0.0).alias("dip"), F.lit(0.0).alias("sy"), F.lit(0.0).alias("sxy"), F.lit(0).alias("i"))

    def step(a, x):
        eq = a.eq * (1 + x.total_return_pct / 100)
        top = F.greatest(a.top, eq)
        dip = F.greatest(a.dip, (top - eq) / F.greatest(top, F.lit(1e-12)) * 100)
        return F.struct(eq.alias("eq"), top.alias("top"), dip.alias("dip"), (a.sy + eq).alias("sy"), (a.sxy + eq * a.i).alias("sxy"), (a.i + 1).alias("i"))

    out = out.withColumn("_end", F.aggregate("_rows", start, step)).withColumn("recency_weighted_return_pct", weighted)
    k = F.col("windows").cast("double")
    slope = (k * F.col("_end.sxy") - k * (k - 1) / 2 * F.col("_end.sy")) / (k * k * (k * k - 1) / 12)
    out = out.withColumns({"equity_slope": F.when(F.col("windows") >= 2, slope * 100).otherwise(F.col("latest_return_pct")), "max_equity_dip_pct": F.col("_end.dip"), "monthly_trade_floor": F.lit(max(1, m.active_trades))})
    c = F.col
    score = (
        0.65 * c("recency_weighted_return_pct") + 0.35 * c("mean_return_pct") + 0.75 * c("worst_return_pct") + 5 * c("worst_profit_factor") + 6 * c("profitable_ratio") + 3 * c("active_ratio") - 4 * c("bearish_ratio")
        + 1.5 * c("equity_slope") - 0.65 * c("worst_drawdown_pct") - 0.20 * c("max_equity_dip_pct") - under(c("min_trades"), m.trade_floor) * 0.08
    )
    return out.withColumn("score", score).drop("_rows", "_end")


def penalty(trade_floor: int = 20) -> Column:
    """Weighted shortfalls of a summary; 0 is best, 100 without windows."""
    c = F.col
    p = (
        under(c("worst_return_pct"), -1.5) * 1.2 + under(c("worst_profit_factor"), 1.0) * 8 + over(c("worst_drawdown_pct"), 8.0) * 0.7 + under(c("profitable_ratio"), 0.60) * 15 + under(c("active_ratio"), 0.60) * 15
        + over(c("bearish_ratio"), 0.50) * 15 + under(c("equity_slope"), 0.0) * 2 + under(c("latest_return_pct"), 0.0) * 0.6 + under(c("min_trades"), trade_floor) * 0.08
    )
    return F.when(c("windows") > 0, p).otherwise(100.0)


def admitted(least_good: float = 0.50, least_active: float = 0.60, most_bearish: float = 0.50) -> Column:
    """The monthly gate on a summary: enough good and active windows, few bearish ones."""
    return (F.col("profitable_ratio") >= least_good) & (F.col("active_ratio") >= least_active) & (F.col("bearish_ratio") <= most_bearish)


def cost_stress(metrics: DataFrame, keys: list[str], split: str = "split", fee: str = "fee_mult", least_return: float = 0.0, least_bound: float = 0.0) -> DataFrame:
    """By key: whether all splits hold their return and lower bound at every fee above the usual
    one, and the worst return there."""
    stressed = metrics.where(F.col(fee) > 1)
    ok = (F.col("total_return_pct") >= least_return) & (F.col("expectancy_lcb_pct") >= least_bound)
    return stressed.groupBy(*keys).agg(F.bool_and(ok).alias("passed"), F.min("total_return_pct").alias("worst_return_pct"), F.countDistinct(split, fee).alias("runs"))
