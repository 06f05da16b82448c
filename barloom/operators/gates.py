"""Gates, penalties and scores over account metrics.

Rows are candidates. `wide` puts the metrics of both splits side by side (train_..., valid_...);
all else is columns of such rows, so a candidate table of any size is judged in one pass. The
default limits are parameters with the values that results must be comparable under.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import factor_term, reasons, return_over_drawdown

#: What a split without any metrics counts as.
MISSING = {"total_return_pct": 0.0, "profit_factor": 0.0, "max_drawdown_pct": 100.0, "win_rate_pct": 0.0, "trades": 0, "raw_signals": 0, "skipped_min_notional": 0, "max_positions": 0,
           "expectancy_lcb_pct": 0.0, "expected_shortfall_pct": 0.0, "sortino": 0.0, "max_single_pnl": 0.0, "gross_profit": 0.0}


def wide(metrics: DataFrame, keys: list[str], split: str = "split", names: dict[str, str] | None = None) -> DataFrame:
    """One row for each key: train_x and valid_x of every metric x in MISSING. names: split value
    to prefix."""
    names = names or {"train": "train", "val": "valid"}
    pick = lambda value, m: F.coalesce(F.max(F.when(F.col(split) == value, F.col(m))), F.lit(MISSING[m]))
    return metrics.groupBy(*keys).agg(*(pick(value, m).alias(f"{p}_{m}") for value, p in names.items() for m in MISSING))


def _c(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}_{name}")


def over(value: Column, limit: float | Column) -> Column:
    return F.greatest(value - limit, F.lit(0.0))


def under(value: Column, limit: float | Column) -> Column:
    return F.greatest(limit - value, F.lit(0.0))


def execution_ok(prefix: str, max_skipped: float = 0.20, min_executed: float = 0.60) -> Column:
    """Signals exist, few were too small and most were executed."""
    raw = _c(prefix, "raw_signals")
    return (raw > 0) & (F.try_divide(_c(prefix, "skipped_min_notional"), raw) <= max_skipped) & (F.try_divide(_c(prefix, "trades"), raw) >= min_executed)


def health_penalty(prefix: str, role: str = "valid", max_skipped: float = 0.20, min_executed: float = 0.60, weights: tuple[float, float, float] = (3500.0, 2500.0, 120.0), positions: int = 10) -> Column:
    """Penalty of skipped and unexecuted signals and of too many positions; more in role test."""
    raw, skip, done = _c(prefix, "raw_signals"), _c(prefix, "skipped_min_notional"), _c(prefix, "trades")
    k, kp = (1.5, 1.2) if role == "test" else (1.0, 1.0)
    ratio = F.when(raw > 0, over(skip / raw, max_skipped) * weights[0] * k + under(done / raw, min_executed) * weights[1] * k).otherwise(0.0)
    return ratio + over(_c(prefix, "max_positions"), positions) * weights[2] * kp


@dataclass(frozen=True)
class Floors:
    """What both splits need. Returns must be above, the rest at least."""

    train_return: float = 0.25
    valid_return: float = 0.25
    train_factor: float = 1.02
    valid_factor: float = 1.02
    train_trades: int = 10
    valid_trades: int = 6
    health: bool = False
    #: Least lower bound of expectancy on either split; None: not asked for.
    lower_bound: float | None = None


def reject_reasons(f: Floors) -> Column:
    """The codes of the floors that a candidate misses, in order; empty if it passes."""
    checks = {
        "train_return_floor": _c("train", "total_return_pct") > f.train_return, "valid_return_floor": _c("valid", "total_return_pct") > f.valid_return,
        "train_profit_factor_floor": _c("train", "profit_factor") >= f.train_factor, "valid_profit_factor_floor": _c("valid", "profit_factor") >= f.valid_factor,
        "train_trade_floor": _c("train", "trades") >= f.train_trades, "valid_trade_floor": _c("valid", "trades") >= f.valid_trades,
    }
    if f.health:
        checks |= {"train_execution_health": execution_ok("train"), "valid_execution_health": execution_ok("valid")}
    return reasons(checks)


def positive_good(f: Floors) -> Column:
    ok = reject_reasons(f) == ""
    return ok if f.lower_bound is None else ok & (F.least(_c("train", "expectancy_lcb_pct"), _c("valid", "expectancy_lcb_pct")) >= f.lower_bound)


def shape(required: bool = True, ratios: tuple[float, float] = (0.90, 2.00), gaps: tuple[float, float] = (0.0, 12.0), weights: tuple[float, float, float] = (120.0, 180.0, 80.0)) -> tuple[Column, Column, Column]:
    """(ok, bonus, penalty) of how the training return stands to the validation return: within
    ratios and gaps, best in the middle."""
    if not required:
        return F.lit(True), F.lit(0.0), F.lit(0.0)
    t, v = _c("train", "total_return_pct"), _c("valid", "total_return_pct")
    low = F.greatest(v * ratios[0], v + gaps[0])
    high = F.least(v * ratios[1], v + gaps[1])
    high = F.when(high < low, low + max(0.5, gaps[0])).otherwise(high)
    both, unit = (t > 0) & (v > 0), F.greatest(F.abs(v), F.lit(1.0))
    ok = both & (t >= low) & (t <= high)
    near = F.greatest(F.lit(0.0), 1 - F.abs(t - (low + high) / 2) / F.greatest((high - low) / 2, F.lit(1e-9)))
    penalty = F.when(both, under(t, low) * weights[0] / unit + over(t, high) * weights[1] / unit).otherwise(0.0)
    return ok, F.when(ok, near * weights[2]).otherwise(0.0), penalty


def rule_score(f: Floors | None = None, dd_floor: float = 0.50, trade_penalty: float = 0.70, ratio_gap: float = 30.0, return_gap: float = 4.0, require_shape: bool = True) -> Column:
    """The composite score of a candidate: return over drawdown of both splits, factors, lower
    bounds and shape, less penalties for health, missed floors and gaps between the splits."""
    f = f or Floors()
    t, v = (lambda m: _c("train", m)), (lambda m: _c("valid", m))
    tr, vr = (return_over_drawdown(_c(p, "total_return_pct"), _c(p, "max_drawdown_pct"), dd_floor) for p in ("train", "valid"))
    ok, bonus, penalty = shape(require_shape)
    score = (
        60 * vr + 60 * tr + 3 * v("total_return_pct") + 3 * t("total_return_pct") + 14 * factor_term(v("profit_factor"), 5.0) + 5 * factor_term(t("profit_factor"), 5.0)
        + 0.06 * v("win_rate_pct") + 0.025 * t("win_rate_pct") - 0.25 * v("max_drawdown_pct") - 0.08 * t("max_drawdown_pct")
        + 12 * F.least(t("expectancy_lcb_pct"), v("expectancy_lcb_pct")) - 0.75 * F.greatest(-v("expected_shortfall_pct"), F.lit(0.0)) + bonus - penalty
        - health_penalty("train", "train") - health_penalty("valid")
    )
    for p, floor, fixed, slope in (("train", f.train_return, 500.0, 20.0), ("valid", f.valid_return, 1000.0, 30.0)):
        score = score - F.when(_c(p, "total_return_pct") <= floor, fixed + F.abs(_c(p, "total_return_pct")) * slope).otherwise(0.0)
    score = score - under(t("profit_factor"), f.train_factor) * 60 - under(v("profit_factor"), f.valid_factor) * 120
    score = score - under(t("trades"), f.train_trades) * trade_penalty - under(v("trades"), f.valid_trades) * trade_penalty * 1.5
    if require_shape:
        score = score - F.when(ok, 0.0).otherwise(250.0)
    return score - over(tr, vr) * ratio_gap - over(t("total_return_pct"), v("total_return_pct")) * return_gap


def fold_penalty(returns: Column) -> Column:
    """Penalty of a list of fold returns: a negative worst one, and a range that is wide against
    the mean. Nothing for fewer than two folds."""
    low, high = F.array_min(returns), F.array_max(returns)
    mean = F.aggregate(returns, F.lit(0.0), lambda a, x: a + x) / F.size(returns)
    wide_ = (F.abs(mean) > 0.01) & (high - low > 2 * F.abs(mean))
    p = F.when(low < 0, -low * 5).otherwise(0.0) + F.when(wide_, ((high - low) / F.greatest(F.abs(mean), F.lit(0.01)) - 2) * 5).otherwise(0.0)
    return F.when(F.size(returns) > 1, p).otherwise(0.0)


@dataclass(frozen=True)
class Admission:
    """Floors of the pool of rules."""

    train_trades: int = 15
    valid_trades: int = 10
    return_pct: float = 0.0
    factor: float = 1.15
    max_gap: float = 10.0
    max_concentration: float = 0.35
    max_ratio: float = 3.0


def concentration_ratio(prefix: str) -> Column:
    """The largest winning trade's share of all winnings."""
    return F.when(_c(prefix, "gross_profit") > 0, _c(prefix, "max_single_pnl") / F.greatest(_c(prefix, "gross_profit"), F.lit(1e-6))).otherwise(0.0)


def admission_reasons(a: Admission) -> Column:
    """Why a rule isn't admitted to the pool, in order; empty if it is."""
    f = Floors(a.return_pct, a.return_pct, a.factor, a.factor, a.train_trades, a.valid_trades)
    t, v = _c("train", "total_return_pct"), _c("valid", "total_return_pct")
    more = reasons({"train_valid_gap": t - v <= a.max_gap, "concentration": concentration_ratio("train") <= a.max_concentration, "overfit_ratio": t / F.greatest(v, F.lit(0.1)) <= a.max_ratio})
    return F.array_join(F.filter(F.array(reject_reasons(f), more), lambda x: x != ""), ";")


def support_penalty(trades: Column, target: int = 60, floor: int = 15, most: float = 5.0, exponent: float = 3.0) -> Column:
    """None from the target on, twice the most below the floor, a power of the shortfall between."""
    short = (target - trades) / max(target, 1)
    return F.when(trades >= target, 0.0).when(trades < floor, 2 * most).otherwise(F.least(F.pow(short, F.lit(exponent)) * most, F.lit(most)))


def feasibility_violation(a: Admission, factor: float = 1.0, valid: bool = True) -> Column:
    """How far a rule is from the floors of the search, whose factor is softer than that of
    admission; 0 if it is feasible."""
    def side(p: str, trades: int) -> Column:
        ret = _c(p, "total_return_pct")
        return under(_c(p, "trades"), trades) + F.when(ret <= a.return_pct, F.abs(a.return_pct - ret) + 1).otherwise(0.0) + under(_c(p, "profit_factor"), factor) * 5

    out = side("train", a.train_trades)
    return out + side("valid", a.valid_trades) + over(_c("train", "total_return_pct") - _c("valid", "total_return_pct"), a.max_gap) if valid else out


def robust(metric: str, joint: bool = True) -> Column:
    """The lesser of both splits, or the training one alone."""
    return F.least(_c("train", metric), _c("valid", metric)) if joint else _c("train", metric)


def deployability(joint: bool = False) -> Column:
    """Rank of archive entries and seeds: the weaker lower bound, a little factor and ratio, less
    drawdown."""
    dd = F.greatest(_c("train", "max_drawdown_pct"), _c("valid", "max_drawdown_pct")) if joint else _c("train", "max_drawdown_pct")
    return robust("expectancy_lcb_pct") + 0.25 * robust("profit_factor") + 0.1 * robust("sortino", joint) - 0.05 * dd


def profit_objective(weights: tuple[float, float, float, float, float] = (1.00, 1.60, 0.30, 0.04, 0.06)) -> Column:
    """The objective of the amplifier: returns of both splits, their balance, drawdown, health."""
    train, valid, balance, dd, health = weights
    t, v = _c("train", "total_return_pct"), _c("valid", "total_return_pct")
    return train * t + valid * v + balance * F.least(t, v) - dd * (_c("train", "max_drawdown_pct") + 1.35 * _c("valid", "max_drawdown_pct")) - health * (health_penalty("train", "train") + health_penalty("valid"))


def amplify(candidates: list[str], overlap: dict[tuple[str, str], float], evaluate, max_rules: int = 20, max_overlap: float = 0.45, least_gain: float = 0.02, least_return: float = 0.005, overlap_weight: float = 2.0) -> list[str]:
    """Greedy choice by marginal profit. evaluate scores a list of teams in one job: (objective,
    sum of returns, certified) of each. The best certified single rule starts; each step adds the
    rule with the largest gain less its overlap, while gain and return grow enough."""
    single = evaluate([[c] for c in candidates])
    seeds = [(s[0], -k) for k, s in enumerate(single) if s[2]]
    if not seeds:
        return []
    first = -max(seeds)[1]
    team, objective, total = [candidates[first]], single[first][0], single[first][1]
    shared = lambda c: max(overlap.get((c, x), overlap.get((x, c), 0.0)) for x in team)
    while len(team) < max_rules:
        left = [c for c in candidates if c not in team and shared(c) <= max_overlap]
        scored = list(zip(left, evaluate([[*team, c] for c in left]), strict=True)) if left else []
        good = [(o - objective - overlap_weight * shared(c), -k, o, r, c) for k, (c, (o, r, ok)) in enumerate(scored) if ok and o > objective + least_gain and r > total + least_return]
        if not good:
            break
        _, _, objective, total, best = max(good)
        team.append(best)
    return team


def symbol_certificate(symbols: DataFrame, keys: list[str], min_symbols: int = 2, min_trades: int = 6, max_share: float = 0.67, max_hhi: float = 0.60) -> DataFrame:
    """By key: qualifying symbols (enough trades, positive profit), the share and the name of the
    largest in absolute profit, the Herfindahl index, and the failed checks. symbols has a row
    for each key and symbol: trade_count, net_pnl."""
    part = F.sum(F.abs("net_pnl")).over(Window.partitionBy(*keys))
    s = symbols.withColumn("_share", F.coalesce(F.try_divide(F.abs("net_pnl"), part), F.lit(0.0)))
    good = (F.col("trade_count") >= min_trades) & (F.col("net_pnl") > 0)
    out = s.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set(F.when(good, F.col("symbol")))), ",").alias("qualifying"), F.count_if(good).alias("n_qualifying"), F.max("_share").alias("top_share"),
        F.max_by("symbol", F.struct(F.round("_share", 9), F.col("symbol"))).alias("top_symbol"), F.sum(F.pow("_share", 2)).alias("hhi"))
    checks = {"symbol_contribution": F.col("n_qualifying") >= min_symbols, "symbol_concentration": (F.col("top_share") <= max_share + 1e-12) & (F.col("hhi") <= max_hhi + 1e-12)}
    return out.withColumn("failed", reasons(checks))


def robustness_penalty(symbols: DataFrame, keys: list[str], initial: float = 1000.0, median_floor: float = 0.0, min_profitable: int = 2) -> DataFrame:
    """By key: how far the median profit of the symbols is below its floor, and 2 for each symbol
    that misses to the profitable ones wanted (no more than there are symbols)."""
    pct = F.col("net_pnl") / initial * 100
    s = symbols.groupBy(*keys).agg(F.median(pct).alias("_mid"), F.count_if(F.col("net_pnl") > 0).alias("_good"), F.count("*").alias("_n"))
    return s.select(*keys, (under(F.col("_mid"), median_floor) + 2.0 * F.greatest(F.least(F.lit(min_profitable), F.col("_n")) - F.col("_good"), F.lit(0))).alias("penalty"))


def symbol_policy(candidates: DataFrame, active: list[str], configured: int = 2, specialists: bool = True, allow_partial: bool = False, whole_universe: bool = True) -> DataFrame:
    """One row: the symbols that candidates cover before and after the tail gate, those that miss,
    and how many distinct symbols a team needs. The need falls to what is covered only where
    specialists may cover a part, and never for a release over the whole universe of several
    symbols. candidates: a row for each candidate and positive symbol, symbol and tail_ok."""
    known = F.lower(F.trim("symbol")).isin([a.strip().lower() for a in active])
    name = reduce(lambda c, a: F.when(F.lower(F.trim("symbol")) == a.strip().lower(), a).otherwise(c), active, F.lit(None).cast("string"))
    c = candidates.where(known).withColumn("_name", name)
    sets = c.agg(F.array_sort(F.collect_set("_name")).alias("before"), F.array_sort(F.collect_set(F.when(F.col("tail_ok"), F.col("_name")))).alias("covered"))
    partial = specialists and allow_partial and not (whole_universe and len(set(active)) > 1)
    n = F.size("covered")
    effective = F.when(F.lit(partial) & (n > 0) & (n < max(1, configured)), n).otherwise(max(1, configured))
    every = F.array_sort(F.array(*map(F.lit, sorted(set(active)))))
    text = lambda a: F.array_join(a, ",")
    return sets.select(text("before").alias("before_tail"), text("covered").alias("covered"), text(F.array_except("before", "covered")).alias("tail_rejected"), text(F.array_except(every, F.col("covered"))).alias("missing"), effective.alias("needed"))


def tail_ok(ret: Column, trades: Column, min_return: float = 0.0, min_trades: int = 4) -> Column:
    """The gate of the reserved last part of the validation rows; nothing there passes."""
    return ret.isNull() | ((ret >= min_return - 1e-12) & (trades >= min_trades))


def recency_rescue(returns: DataFrame, keys: list[str], order: str, ret: str) -> DataFrame:
    """By key: the lesser of the mean returns of both halves, in order."""
    w = Window.partitionBy(*keys)
    df = returns.withColumn("_k", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count(F.lit(1)).over(w))
    first = F.col("_k") * 2 <= F.col("_n")
    return df.groupBy(*keys).agg(F.least(F.coalesce(F.avg(F.when(first, F.col(ret))), F.avg(ret)), F.coalesce(F.avg(F.when(~first, F.col(ret))), F.avg(ret))).alias("rescue"))


def stage_budget(total: int, stage_a: int = 65, stage_b: int = 35, two_stages: bool = True) -> tuple[int, int]:
    """Generations of the exploring and of the refining stage."""
    if not two_stages or stage_a <= 0 or stage_b <= 0:
        return total, 0
    a = max(1, round(total * stage_a / (stage_a + stage_b)))
    return a, max(0, total - a)


def stage_at(done: int, total: int, **shares) -> tuple[str | None, int, bool]:
    """(stage, generations left in it, whether it begins now) after `done` generations."""
    a, b = stage_budget(total, **shares)
    if b <= 0:
        return ("A" if shares.get("two_stages", True) else None), max(0, total - done), False
    if done < a:
        return "A", a - done, False
    return "B", max(0, a + b - done), done == a


#: What the stages of the search change (fixed values); None is the search in one stage.
STAGES = {
    "A": {"mutation_rate": 0.35, "diversity_penalty": 8.0, "hamming": 3, "min_unique": 0.40, "inject": 0.30, "boost": 2.0, "patience": 12, "seed_fraction": 0.25, "return_floor": 0.0, "min_support": 8, "soft": True, "positive_splits": False},
    "B": {"mutation_rate": 0.20, "diversity_penalty": 4.0, "hamming": 2, "min_unique": 0.25, "inject": 0.20, "boost": 1.4, "patience": 8, "seed_fraction": 0.35, "return_floor": 0.25, "min_support": 60, "soft": False, "positive_splits": True},
}


def search_floors(stage: str | None, island_support: int | None = None) -> dict:
    """return_floor, min_support, soft, positive_splits of a stage; an island's support makes the
    exploring stage no stricter and sets that of the refining one."""
    s = dict(STAGES[stage or "B"])
    if island_support is not None:
        s["min_support"] = min(s["min_support"], island_support) if s["soft"] else island_support
    return {k: s[k] for k in ("return_floor", "min_support", "soft", "positive_splits")}


def scaled_floor(base: int, rows: int, reference: int, least: int = 1) -> int:
    """An integer floor, scaled to a part of the rows."""
    return max(least, round(base * rows / reference)) if reference > 0 else base


def objectives(a: Admission, return_floor: float = 0.25, target: int = 60, dd_gate: float = 20.0, weights: tuple[float, float, float] = (0.25, 0.6, 0.6)) -> dict[str, Column]:
    """f1 to f4, all to be minimised, of the training metrics: saturated Sortino ratio, drawdown,
    return, and the concentration of winnings; the first three carry a share of the support
    penalty, which counts missed floors of trades, return and factor."""
    p = support_penalty(_c("train", "trades"), target, a.train_trades)
    p = F.when(_c("train", "total_return_pct") < return_floor, F.greatest(p, F.lit(5.0))).otherwise(p) + under(_c("train", "profit_factor"), 1.0) * 5
    dd = _c("train", "max_drawdown_pct")
    return {
        "f1": -F.tanh(_c("train", "sortino") / 10) * 20 + weights[0] * p, "f2": dd + over(dd, dd_gate) * 2 + weights[1] * p,
        "f3": -_c("train", "total_return_pct") + weights[2] * p, "f4": concentration_ratio("train"),
    }
