"""The capital account: order-dependent, so one pass over the entries of each group.

A group is one account: a rule set on a split, a window, a fee level. Groups run in parallel;
only entries and outcomes reach Python, and metrics come from the trade log in Spark.

Account rules: positions are released in the order they were opened once their release row is
reached; equity changes at release alone. An account is ruined for good by any release that
leaves its equity not above zero, and stops, except in the joint mode. An entry takes equity x capital % x leverage, at most the exposure that is
left; below the least notional it is skipped. Fee: once, on the notional. Every entry is in the
log: closed, held (its symbol was open), skipped_..., no_return, or after_ruin.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG = (
    "symbol string, direction string, rule_index int, row_id long, release_row long, notional double, return_pct double, "
    "gross double, fee double, net double, equity_before double, equity_after double, trade_return double, exit_reason string, drawdown_pct double, status string, n_open int, exposure double"
)


@dataclass(frozen=True)
class Account:
    initial: float = 1000.0
    leverage: float = 1.0
    fee_pct: float = 0.20
    max_exposure_pct: float = 100.0
    min_notional: float = 1.0
    one_per_symbol: bool = True
    #: Long and short in one account: same side skipped, opposite side closes and reverses.
    joint: bool = False


class _Book:
    """Open positions and the running state of one account."""

    def __init__(self, a: Account):
        self.a, self.equity, self.peak, self.worst = a, a.initial, a.initial, 0.0
        self.ruined = False
        self.open: list[dict] = []
        self.log: list[dict] = []

    def exposure(self) -> float:
        return sum(p["notional"] for p in self.open)

    def holds(self, symbol: str) -> dict | None:
        return next((p for p in self.open if p["symbol"] == symbol), None)

    def close(self, p: dict, ret: float | None = None, at: int | None = None) -> None:
        if ret is not None:
            p |= {"return_pct": ret, "gross": p["notional"] * ret / 100, "net": p["notional"] * ret / 100 - p["fee"], "exit_reason": "Reverse", "release_row": at}
        before = self.equity
        self.equity += p["net"]
        self.ruined = self.ruined or self.equity <= 0
        self.peak = max(self.peak, self.equity)
        self.worst = max(self.worst, (self.peak - self.equity) / self.peak * 100 if self.peak > 0 else 100.0)
        if self.a.joint:
            p["trade_return"] = p["net"] / max(before, 1e-9)
        p |= {"equity_after": self.equity, "drawdown_pct": self.worst, "status": "closed"}
        self.log.append(p)

    def release(self, row: int) -> None:
        due = [p for p in self.open if p["release_row"] <= row]
        self.open = [p for p in self.open if p["release_row"] > row]
        for p in due:
            self.close(p)

    def enter(self, e: dict) -> None:
        a = self.a
        held = self.holds(e["symbol"])
        if a.joint and held is not None:
            if held["direction"] == e["direction"]:
                self.note(e, "skipped_same_side")
                return
            old, new = held["entry_price"], e["entry_price"]
            self.open.remove(held)
            if old > 0 and new == new:
                self.close(held, (new - old) / old * 100 * (1 if held["direction"] == "long" else -1), e["row_id"])
        elif a.one_per_symbol and held is not None:
            self.note(e, "held")
            return
        room = max(0.0, self.equity * a.max_exposure_pct / 100 * a.leverage - self.exposure())
        notional = min(self.equity * e["capital_pct"] / 100 * a.leverage, room)
        if notional < a.min_notional:
            self.note(e, "skipped_min_notional")
            return
        if a.joint and e["return_pct"] != e["return_pct"]:
            self.note(e, "no_return")
            return
        gross, fee = notional * e["return_pct"] / 100, notional * e.get("fee_pct", a.fee_pct) / 100
        self.open.append(e | {"notional": notional, "gross": gross, "fee": fee, "net": gross - fee, "equity_before": self.equity, "trade_return": (gross - fee) / self.equity if self.equity > 0 else 0.0})
        self.open[-1] |= {"n_open": len(self.open), "exposure": self.exposure()}

    def note(self, e: dict, status: str) -> None:
        self.log.append(e | {"equity_before": self.equity, "drawdown_pct": self.worst, "status": status})


def run_account(entries: list[dict], a: Account) -> list[dict]:
    book = _Book(a)
    for k, e in enumerate(entries):
        book.release(e["row_id"])
        if book.ruined and not a.joint:
            for late in entries[k:]:
                book.note(late, "after_ruin")
            break
        book.enter(e)
    book.release(1 << 62)
    return book.log


#: Columns that entries need beside the keys.
ENTRY = ("symbol", "direction", "rule_index", "row_id", "release_row", "capital_pct", "return_pct", "entry_price", "exit_reason", "time_rank", "symbol_priority")


def simulate(entries: DataFrame, keys: dict[str, str], account: Account) -> DataFrame:
    """The trade log of each group. keys: key column to its type. Order of allocation: time,
    rule, symbol priority, row; in the joint mode time, row, direction, rule, symbol priority.
    A column fee_pct in entries overrides the account's, so fee levels can be groups of one job."""
    order = ["time_rank", "row_id", "direction", "rule_index", "symbol_priority"] if account.joint else ["time_rank", "rule_index", "symbol_priority", "row_id"]
    names = [x.split()[0] for x in LOG.split(", ")]
    columns = [*ENTRY, *(["fee_pct"] if "fee_pct" in entries.columns else [])]

    def run(key, pdf):
        import pandas as pd

        log = run_account(pdf.sort_values(order, kind="stable")[columns].to_dict("records"), account)
        out = pd.DataFrame(log, columns=names)
        for k, v in zip(keys, key, strict=True):
            out.insert(0, k, v)
        out["n_open"] = out["n_open"].astype("Int32")
        return out[[*keys, *names]]

    wanted = list(dict.fromkeys([*keys, *columns]))
    return entries.select(*wanted).groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {t}" for k, t in keys.items()) + ", " + LOG)


def account_metrics(log: DataFrame, keys: list[str], initial: float = 1000.0, *, z: float = 1.645, tail: float = 0.10, cap: float = 20.0, full_trades: int = 20) -> DataFrame:
    """All metrics of each account. The lists behind the shortfall hold one account's trades."""
    done = F.col("status") == "closed"
    net = F.when(done, F.col("net"))
    ret = F.when(done, F.col("trade_return") * 100)
    gain, loss = F.sum(F.when(net > 0, net).otherwise(0.0)), F.sum(F.when(net < 0, -net).otherwise(0.0))
    down = F.sqrt(F.avg(F.pow(F.least(ret / 100, F.lit(0.0)), 2)))
    n = F.count(ret)
    mean, std = F.coalesce(F.avg(ret), F.lit(0.0)), F.coalesce(F.stddev_samp(ret), F.lit(0.0))
    raw = F.when(down > 0, F.least(F.avg(ret / 100) / down, F.lit(cap))).when(mean > 0, cap).otherwise(0.0)
    out = log.groupBy(*keys).agg(
        F.count("*").alias("raw_signals"), n.alias("trades"), F.count_if(net > 0).alias("wins"), F.count_if(net < 0).alias("losses"), F.count_if(done & F.col("exit_reason").startswith("Time")).alias("time_closed"),
        F.count_if(F.col("status") == "skipped_min_notional").alias("skipped_min_notional"), F.count_if(F.col("status") == "skipped_same_side").alias("skipped_same_side"), F.count_if(F.col("exit_reason") == "Reverse").alias("reversals"),
        (initial + F.coalesce(F.sum(net), F.lit(0.0))).alias("final_equity"), (F.coalesce(F.sum(net), F.lit(0.0)) / initial * 100).alias("total_return_pct"),
        F.when(loss > 0, gain / loss).when(gain > 0, 99.0).otherwise(0.0).alias("profit_factor"), F.coalesce(F.max("drawdown_pct"), F.lit(0.0)).alias("max_drawdown_pct"),
        F.when(n > 0, 100 * F.count_if(net > 0) / n).otherwise(0.0).alias("win_rate_pct"), F.coalesce(F.bool_or(F.col("equity_after") <= 0), F.lit(False)).alias("account_ruined"),
        F.coalesce(F.avg(F.when(done, F.col("notional"))), F.lit(0.0)).alias("mean_notional"), F.coalesce(F.max("n_open"), F.lit(0)).cast("long").alias("max_positions"), F.coalesce(F.max("exposure"), F.lit(0.0)).alias("max_exposure"),
        gain.alias("gross_profit"), loss.alias("gross_loss"), F.coalesce(F.max(F.when(net > 0, net)), F.lit(0.0)).alias("max_single_pnl"),
        (raw * F.least(F.lit(1.0), n / full_trades)).alias("sortino"), mean.alias("expectancy_pct"), std.alias("return_std_pct"),
        F.when(n > 0, mean - z * std / F.sqrt(n)).otherwise(0.0).alias("expectancy_lcb_pct"), F.sort_array(F.collect_list(ret)).alias("_sorted"),
    )
    size = F.size("_sorted")
    worst = F.slice("_sorted", F.lit(1), F.greatest(F.ceil(size * F.greatest(F.least(F.lit(tail), F.lit(1.0)), F.try_divide(F.lit(1.0), size))), F.lit(1)).cast("int"))
    short = F.when(size > 0, F.aggregate(worst, F.lit(0.0), lambda a, x: a + x) / F.size(worst)).otherwise(0.0)
    return out.withColumn("expected_shortfall_pct", short).drop("_sorted")


def symbol_metrics(log: DataFrame, keys: list[str]) -> DataFrame:
    """trade_count, win_rate_pct and net_pnl of each symbol of an account."""
    return log.where("status = 'closed'").groupBy(*keys, "symbol").agg(F.count("*").alias("trade_count"), (100 * F.avg((F.col("net") > 0).cast("double"))).alias("win_rate_pct"), F.sum("net").alias("net_pnl"))
