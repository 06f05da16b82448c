"""Streaming twins: bars of a tick stream, and a running account."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, symbol: str, ts: str, price: str, width: str, late: str) -> DataFrame:
    """Tumbling bars; a bar is final once the watermark passes its end. Ticks later than `late`
    are dropped from it."""
    return (
        ticks.withWatermark(ts, late)
        .groupBy(F.window(ts, width), F.col(symbol).alias("symbol"))
        .agg(F.min_by(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, ts).alias("close"), F.sum(price).alias("volume"), F.count("*").alias("ticks"))
        .select("symbol", F.col("window.start").alias("datetime"), "open", "high", "low", "close", "volume", "ticks")
    )


def running_equity(trades: DataFrame, key: str, pnl: str, initial: float = 1000.0, order: str = "seq", time: str | None = None, idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """Equity and deepest drawdown of each account after every micro-batch, from grouped state; a batch's trades are taken
    by `order`. With a time column under a watermark, an account without trades for idle_ms is forgotten."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k, batches, state: GroupState):
        import numpy as np
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(order)
        equity, peak, worst = state.get if state.exists else (initial, initial, 0.0)
        run = equity + pdf[pnl].cumsum().to_numpy(float)
        if len(run):
            peaks = np.maximum(np.maximum.accumulate(run), peak)
            falls = np.where(peaks > 0, (peaks - run) / np.where(peaks > 0, peaks, 1.0) * 100, 100.0)
            equity, peak, worst = float(run[-1]), float(peaks[-1]), max(worst, float(falls.max()))
        state.update((equity, peak, worst))
        if time:
            last = int(pdf[time].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({key: [k[0]], "equity": [equity], "drawdown_pct": [worst]})

    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    return trades.groupBy(key).applyInPandasWithState(step, f"{key} string, equity double, drawdown_pct double", "equity double, peak double, worst double", "update", timeout)
