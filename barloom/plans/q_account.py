"""Queries over accounts of candidates: evaluation tables, gates, scores, months, folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import gates as G  # noqa: N812
from barloom.operators import metrics as M  # noqa: N812
from barloom.operators import monthly as Y  # noqa: N812
from barloom.operators import rules as R  # noqa: N812
from barloom.operators import simulate as A  # noqa: N812
from barloom.operators import splits as S  # noqa: N812
from barloom.operators import strategy as T  # noqa: N812
from barloom.operators.chunks import shifted

from .account_sql import IDS, account_sql, entries_sql, rules_sql, touched
from .q_search import ACCOUNT, DRIFT, RULES, SPLIT, drifts, entries, outcomes
from .q_tape import BARS
from .registry import query, r6

#: Each rule alone: what a rule matches is not taken by an earlier one.
ALONE = f"""{BARS}, {IDS}, {DRIFT}, alone AS (SELECT symbol, bar, 0 AS rule_index FROM dr WHERE drift > 0.6 AND drift <= 0.8 UNION ALL SELECT symbol, bar, 1 FROM dr WHERE drift > 0.2 AND drift <= 0.4 AND symbol IN ('click', 'view') UNION ALL SELECT symbol, bar, 2 FROM dr),
{rules_sql(RULES)}, {touched(('long',))}, {entries_sql('alone')}"""
SOLO = f"{ALONE}, acc AS (SELECT *, rule_index || '|' || symbol || '|' || {SPLIT} AS grp FROM ent), {account_sql('acc')}, keyed AS (SELECT m.*, string_split(grp, '|')[1] || '|' || string_split(grp, '|')[2] AS plan, string_split(grp, '|')[3] AS split FROM sim_m m)"
METRICS = {k: v for k, v in G.MISSING.items()}
WIDE = "wide AS (SELECT plan, " + ", ".join(f"coalesce(max({m}) FILTER (split = '{s}'), {d}) AS {p}_{m}" for s, p in (("train", "train"), ("val", "valid")) for m, d in METRICS.items()) + " FROM keyed GROUP BY 1)"
CANDIDATES = f"WITH RECURSIVE {SOLO}, {WIDE}"
BY_RULE = f"{ALONE}, acc AS (SELECT *, rule_index || '|' || {SPLIT} AS grp FROM ent), {account_sql('acc')}"
SYMBOLS = "sym AS (SELECT split_part(grp, '|', 1) AS plan, symbol, count(*) AS trade_count, sum(net) AS net_pnl FROM sim_log WHERE status = 'closed' AND split_part(grp, '|', 2) = 'val' GROUP BY 1, 2)"


def alone(spark, sf_dir):
    """Entries of each rule by itself, with their split."""
    tape = shifted(drifts(spark, sf_dir), "entry_price", "open", 1)
    rows = None
    for k, r in enumerate(RULES):
        mine = tape.where(R.rule_mask(r["conditions"])).withColumns({"rule_index": F.lit(k), **{c: F.lit(float(r[c])) for c in ("tp", "sl", "capital_pct")}})
        rows = mine if rows is None else rows.unionByName(mine)
    return outcomes(rows, tape, RULES)


def accounts(e, **keys):
    """Trade log and metrics of entries by further columns."""
    log = A.simulate(e, keys, A.Account())
    return log, A.account_metrics(log, list(keys))


def candidates(spark, sf_dir):
    e = alone(spark, sf_dir).withColumn("plan", F.concat_ws("|", "rule_index", "symbol"))
    return G.wide(accounts(e, plan="string", split="string")[1], ["plan"])


def by_rule(spark, sf_dir):
    """Log and metrics of each rule over all symbols, by split."""
    return accounts(alone(spark, sf_dir).withColumn("plan", F.col("rule_index").cast("string")), plan="string", split="string")


def _codes(checks: dict[str, str]) -> str:
    return "concat_ws(';', " + ", ".join(f"CASE WHEN NOT ({c}) THEN '{k}' END" for k, c in checks.items()) + ")"


def _floors_sql(ret: float, pf: float, tt: int, vt: int, health: bool = False) -> dict[str, str]:
    out = {"train_return_floor": f"train_total_return_pct > {ret}", "valid_return_floor": f"valid_total_return_pct > {ret}", "train_profit_factor_floor": f"train_profit_factor >= {pf}", "valid_profit_factor_floor": f"valid_profit_factor >= {pf}", "train_trade_floor": f"train_trades >= {tt}", "valid_trade_floor": f"valid_trades >= {vt}"}
    return out | ({f"{p}_execution_health": _ok_sql(p) for p in ("train", "valid")} if health else {})


def _ok_sql(p: str) -> str:
    return f"({p}_raw_signals > 0 AND coalesce({p}_skipped_min_notional / nullif({p}_raw_signals, 0) <= 0.2 AND {p}_trades / nullif({p}_raw_signals, 0) >= 0.6, false))"


def _health_sql(p: str, k: float = 1.0, kp: float = 1.0) -> str:
    return f"(CASE WHEN {p}_raw_signals > 0 THEN greatest({p}_skipped_min_notional / {p}_raw_signals - 0.2, 0) * 3500 * {k} + greatest(0.6 - {p}_trades / {p}_raw_signals, 0) * 2500 * {k} ELSE 0 END + greatest({p}_max_positions - 10, 0) * 120 * {kp})"


@query("g34_execution_health", f"{CANDIDATES} SELECT plan, {_ok_sql('train')} AS train_ok, {_ok_sql('valid')} AS valid_ok, round({_health_sql('train')}, 6) AS train_penalty, round({_health_sql('valid', 1.5, 1.2)}, 6) AS test_penalty FROM wide")
def g34(spark, sf_dir):
    return candidates(spark, sf_dir).select("plan", G.execution_ok("train").alias("train_ok"), G.execution_ok("valid").alias("valid_ok"), r6(G.health_penalty("train", "train"), "train_penalty"), r6(G.health_penalty("valid", "test"), "test_penalty"))


@query("g35_positive_good", f"{CANDIDATES} SELECT plan, {_codes(_floors_sql(0.25, 1.02, 10, 6, True))} AS reasons, {_codes(_floors_sql(0.25, 1.02, 10, 6))} = '' AND least(train_expectancy_lcb_pct, valid_expectancy_lcb_pct) >= -1 AS good FROM wide")
def g35(spark, sf_dir):
    return candidates(spark, sf_dir).select("plan", G.reject_reasons(G.Floors(health=True)).alias("reasons"), G.positive_good(G.Floors(lower_bound=-1.0)).alias("good"))


_CONC = "CASE WHEN {p}_gross_profit > 0 THEN {p}_max_single_pnl / greatest({p}_gross_profit, 1e-6) ELSE 0 END"
_SUPPORT = "CASE WHEN train_trades >= 60 THEN 0 WHEN train_trades < 15 THEN 10 ELSE least(pow((60 - train_trades) / 60.0, 3) * 5, 5) END"
_SIDE = "greatest({t} - {p}_trades, 0) + CASE WHEN {p}_total_return_pct <= 0 THEN abs({p}_total_return_pct) + 1 ELSE 0 END + greatest(1 - {p}_profit_factor, 0) * 5"
_ADMIT = _codes(_floors_sql(0.0, 1.15, 15, 10) | {"train_valid_gap": "train_total_return_pct - valid_total_return_pct <= 10", "concentration": f"{_CONC.format(p='train')} <= 0.35", "overfit_ratio": "train_total_return_pct / greatest(valid_total_return_pct, 0.1) <= 3"})


@query("m13_admission", f"{CANDIDATES} SELECT plan, {_ADMIT} AS reasons, round({_SUPPORT}, 6) AS support_penalty, round({_SIDE.format(p='train', t=15)} + {_SIDE.format(p='valid', t=10)} + greatest(train_total_return_pct - valid_total_return_pct - 10, 0), 6) AS violation FROM wide")
def m13(spark, sf_dir):
    a = G.Admission()
    return candidates(spark, sf_dir).select("plan", G.admission_reasons(a).alias("reasons"), r6(G.support_penalty(F.col("train_trades")), "support_penalty"), r6(G.feasibility_violation(a), "violation"))


@query("m14_m37_deployability", f"{CANDIDATES} SELECT plan, round(least(train_expectancy_lcb_pct, valid_expectancy_lcb_pct) + 0.25 * least(train_profit_factor, valid_profit_factor) + 0.1 * train_sortino - 0.05 * train_max_drawdown_pct, 6) AS rank, round(least(train_total_return_pct, valid_total_return_pct), 6) AS robust_return, round(least(train_win_rate_pct, valid_win_rate_pct), 6) AS robust_win_rate FROM wide")
def m14(spark, sf_dir):
    return candidates(spark, sf_dir).select("plan", r6(G.deployability(), "rank"), r6(G.robust("total_return_pct"), "robust_return"), r6(G.robust("win_rate_pct"), "robust_win_rate"))


@query("m24_profit_objective", f"{CANDIDATES} SELECT plan, round(train_total_return_pct + 1.6 * valid_total_return_pct + 0.3 * least(train_total_return_pct, valid_total_return_pct) - 0.04 * (train_max_drawdown_pct + 1.35 * valid_max_drawdown_pct) - 0.06 * ({_health_sql('train')} + {_health_sql('valid')}), 6) AS objective FROM wide")
def m24(spark, sf_dir):
    return candidates(spark, sf_dir).select("plan", r6(G.profit_objective(), "objective"))


_PEN = f"(CASE WHEN train_total_return_pct < 0.25 THEN greatest({_SUPPORT}, 5) ELSE {_SUPPORT} END + greatest(1 - train_profit_factor, 0) * 5)"


@query("m1_objectives", f"{CANDIDATES} SELECT plan, round(-tanh(train_sortino / 10) * 20 + 0.25 * {_PEN}, 6) AS f1, round(train_max_drawdown_pct + greatest(train_max_drawdown_pct - 20, 0) * 2 + 0.6 * {_PEN}, 6) AS f2, round(-train_total_return_pct + 0.6 * {_PEN}, 6) AS f3, round({_CONC.format(p='train')}, 6) AS f4 FROM wide")
def m1(spark, sf_dir):
    return candidates(spark, sf_dir).select("plan", *(r6(c, k) for k, c in G.objectives(G.Admission()).items()))


_LOW, _HIGH0 = "greatest(v * 0.9, v)", "least(v * 2.0, v + 12)"
_RATIO = "{p}_total_return_pct / greatest(abs({p}_max_drawdown_pct), 0.5)"


@query("m18_rule_score", f"""{CANDIDATES}, k AS (SELECT *, train_total_return_pct AS t, valid_total_return_pct AS v, {_RATIO.format(p='train')} AS tr, {_RATIO.format(p='valid')} AS vr FROM wide),
k1 AS (SELECT *, {_LOW} AS low, CASE WHEN {_HIGH0} < {_LOW} THEN {_LOW} + 0.5 ELSE {_HIGH0} END AS high FROM k), k2 AS (SELECT *, t > 0 AND v > 0 AND t >= low AND t <= high AS ok FROM k1)
SELECT plan, ok, round(60 * vr + 60 * tr + 3 * v + 3 * t + 14 * least(greatest(valid_profit_factor, 0), 5) + 5 * least(greatest(train_profit_factor, 0), 5) + 0.06 * valid_win_rate_pct + 0.025 * train_win_rate_pct - 0.25 * valid_max_drawdown_pct - 0.08 * train_max_drawdown_pct
 + 12 * least(train_expectancy_lcb_pct, valid_expectancy_lcb_pct) - 0.75 * greatest(-valid_expected_shortfall_pct, 0) + CASE WHEN ok THEN greatest(0, 1 - abs(t - (low + high) / 2) / greatest((high - low) / 2, 1e-9)) * 80 ELSE 0 END
 - CASE WHEN t > 0 AND v > 0 THEN greatest(low - t, 0) * 120 / greatest(abs(v), 1) + greatest(t - high, 0) * 180 / greatest(abs(v), 1) ELSE 0 END - {_health_sql('train')} - {_health_sql('valid')}
 - CASE WHEN t <= 0.25 THEN 500 + abs(t) * 20 ELSE 0 END - CASE WHEN v <= 0.25 THEN 1000 + abs(v) * 30 ELSE 0 END - greatest(1.02 - train_profit_factor, 0) * 60 - greatest(1.02 - valid_profit_factor, 0) * 120
 - greatest(10 - train_trades, 0) * 0.7 - greatest(6 - valid_trades, 0) * 0.7 * 1.5 - CASE WHEN ok THEN 0 ELSE 250 END - greatest(tr - vr, 0) * 30 - greatest(t - v, 0) * 4, 5) AS score FROM k2""")
def m18(spark, sf_dir):
    return candidates(spark, sf_dir).select("plan", G.shape()[0].alias("ok"), F.round(G.rule_score(), 5).alias("score"))


@query("g36_symbol_certificates", f"WITH RECURSIVE {BY_RULE}, {SYMBOLS}, s AS (SELECT *, coalesce(abs(net_pnl) / nullif(sum(abs(net_pnl)) OVER (PARTITION BY plan), 0), 0) AS share FROM sym), c AS (SELECT plan, coalesce(string_agg(CASE WHEN trade_count >= 6 AND net_pnl > 0 THEN symbol END, ',' ORDER BY symbol), '') AS qualifying, count(*) FILTER (trade_count >= 6 AND net_pnl > 0) AS n, max(share) AS top_share, first(symbol ORDER BY round(share, 9) DESC, symbol DESC) AS top_symbol, sum(share * share) AS hhi FROM s GROUP BY 1) SELECT plan, qualifying, round(top_share, 6) AS top_share, top_symbol, round(hhi, 6) AS hhi, concat_ws(';', CASE WHEN n < 2 THEN 'symbol_contribution' END, CASE WHEN top_share > 0.67 + 1e-12 OR hhi > 0.6 + 1e-12 THEN 'symbol_concentration' END) AS failed FROM c")
def g36(spark, sf_dir):
    s = A.symbol_metrics(by_rule(spark, sf_dir)[0], ["plan", "split"]).where("split = 'val'")
    return G.symbol_certificate(s, ["plan"]).select("plan", "qualifying", r6("top_share", "top_share"), "top_symbol", r6("hhi", "hhi"), "failed")


@query("g38_robustness_penalty", f"WITH RECURSIVE {BY_RULE}, {SYMBOLS} SELECT plan, round(greatest(0 - median(net_pnl / 10), 0) + 2.0 * greatest(least(2, count(*)) - count(*) FILTER (net_pnl > 0), 0), 6) AS penalty FROM sym GROUP BY 1")
def g38(spark, sf_dir):
    s = A.symbol_metrics(by_rule(spark, sf_dir)[0], ["plan", "split"]).where("split = 'val'")
    return G.robustness_penalty(s, ["plan"]).select("plan", r6("penalty", "penalty"))


@query("m40_symbol_policy", f"WITH RECURSIVE {BY_RULE}, {SYMBOLS}, t AS (SELECT split_part(grp, '|', 1) AS plan, total_return_pct >= -1e-12 AND trades >= 4 AS tail_ok FROM sim_m WHERE split_part(grp, '|', 2) = 'val'), c AS (SELECT symbol, tail_ok FROM sym JOIN t USING (plan) WHERE trade_count >= 6 AND net_pnl > 0), a AS (SELECT list_sort(list(DISTINCT symbol)) AS b, list_sort(coalesce(list(DISTINCT symbol) FILTER (tail_ok), [])) AS k FROM c), u AS (SELECT ['click', 'error', 'purchase', 'signup', 'view'] AS every) SELECT array_to_string(coalesce(b, []), ',') AS before_tail, array_to_string(k, ',') AS covered, array_to_string(list_filter(coalesce(b, []), lambda x: NOT list_contains(k, x)), ',') AS tail_rejected, array_to_string(list_filter(every, lambda x: NOT list_contains(k, x)), ',') AS missing, CASE WHEN len(k) > 0 AND len(k) < 4 THEN len(k) ELSE 4 END AS needed FROM a, u")
def m40(spark, sf_dir):
    log, metrics = by_rule(spark, sf_dir)
    val = metrics.where("split = 'val'").select("plan", G.tail_ok(F.col("total_return_pct"), F.col("trades")).alias("tail_ok"))
    s = A.symbol_metrics(log, ["plan", "split"]).where("split = 'val' AND trade_count >= 6 AND net_pnl > 0")
    out = G.symbol_policy(s.join(val, "plan"), ["view", "click", "purchase", "signup", "error"], 4, allow_partial=True, whole_universe=False)
    return out.select("before_tail", "covered", "tail_rejected", "missing", F.col("needed").cast("long").alias("needed"))


MONTHS = f"{ALONE}, acc AS (SELECT *, rule_index || '|' || CAST(floor(bar / 42) AS BIGINT) AS grp FROM ent), {account_sql('acc')}, mon AS (SELECT split_part(grp, '|', 1) AS plan, CAST(split_part(grp, '|', 2) AS BIGINT) AS w, total_return_pct AS r, profit_factor AS pf, max_drawdown_pct AS dd, trades AS n, row_number() OVER (PARTITION BY split_part(grp, '|', 1) ORDER BY CAST(split_part(grp, '|', 2) AS BIGINT)) - 1 AS i, count(*) OVER (PARTITION BY split_part(grp, '|', 1)) AS k FROM sim_m)"
SUMMARY = f"""{MONTHS}, cum AS (SELECT plan, i, 1 + r / 100 AS eq FROM mon WHERE i = 0 UNION ALL SELECT m.plan, m.i, c.eq * (1 + m.r / 100) FROM cum c JOIN mon m ON m.plan = c.plan AND m.i = c.i + 1),
top AS (SELECT plan, i, eq, max(eq) OVER (PARTITION BY plan ORDER BY i) AS peak FROM cum), eqs AS (SELECT plan, regr_slope(eq, i) * 100 AS slope, max((peak - eq) / greatest(peak, 1e-12) * 100) AS dip FROM top GROUP BY 1),
s0 AS (SELECT plan, count(*) AS windows, count(*) FILTER (n >= 3 AND r >= 0.5) AS profitable_windows, avg(r) AS mean_return_pct, median(r) AS median_return_pct, min(r) AS worst_return_pct, arg_max(r, w) AS latest_return_pct, sum(r * (1 + 1.2 * i / greatest(k - 1, 1))) / sum(1 + 1.2 * i / greatest(k - 1, 1)) AS recency_weighted_return_pct,
 coalesce(avg(pf) FILTER (n >= 3), 0) AS mean_profit_factor, coalesce(min(pf) FILTER (n >= 3), 0) AS worst_profit_factor, max(dd) AS worst_drawdown_pct, min(n) AS min_trades, avg(n) AS mean_trades, count(*) FILTER (n >= 3) AS active_windows, count(*) FILTER (n < 3) AS inactive_windows, count(*) FILTER (n >= 3 AND r < -0.5) AS bearish_windows FROM mon GROUP BY 1),
s1 AS (SELECT s0.*, profitable_windows / windows AS profitable_ratio, active_windows / windows AS active_ratio, bearish_windows / windows AS bearish_ratio, CASE WHEN windows >= 2 THEN slope ELSE latest_return_pct END AS equity_slope, dip AS max_equity_dip_pct, 3 AS monthly_trade_floor FROM s0 JOIN eqs USING (plan)),
s AS (SELECT *, 0.65 * recency_weighted_return_pct + 0.35 * mean_return_pct + 0.75 * worst_return_pct + 5 * worst_profit_factor + 6 * profitable_ratio + 3 * active_ratio - 4 * bearish_ratio + 1.5 * equity_slope - 0.65 * worst_drawdown_pct - 0.2 * max_equity_dip_pct - greatest(20 - min_trades, 0) * 0.08 AS score FROM s1)"""
_COUNTS = ("windows", "profitable_windows", "min_trades", "active_windows", "inactive_windows", "bearish_windows", "monthly_trade_floor")
_VALUES = ("profitable_ratio", "mean_return_pct", "median_return_pct", "worst_return_pct", "latest_return_pct", "recency_weighted_return_pct", "mean_profit_factor", "worst_profit_factor", "worst_drawdown_pct", "mean_trades", "equity_slope", "max_equity_dip_pct", "score", "active_ratio", "bearish_ratio")


def months(spark, sf_dir):
    e = alone(spark, sf_dir).withColumn("plan", F.col("rule_index").cast("string")).withColumn("window_id", F.floor(F.col("bar") / 42))
    return Y.summary(accounts(e, plan="string", window_id="long")[1], ["plan"])


@query("g28_monthly_summary", f"WITH RECURSIVE {SUMMARY} SELECT plan, {', '.join(_COUNTS)}, {', '.join(f'round({v}, 5) AS {v}' for v in _VALUES)} FROM s")
def g28(spark, sf_dir):
    return months(spark, sf_dir).select("plan", *_COUNTS, *(F.round(v, 5).alias(v) for v in _VALUES))


@query("g29_m15_monthly_gate", f"WITH RECURSIVE {SUMMARY} SELECT plan, round(greatest(-1.5 - worst_return_pct, 0) * 1.2 + greatest(1 - worst_profit_factor, 0) * 8 + greatest(worst_drawdown_pct - 8, 0) * 0.7 + greatest(0.6 - profitable_ratio, 0) * 15 + greatest(0.6 - active_ratio, 0) * 15 + greatest(bearish_ratio - 0.5, 0) * 15 + greatest(-equity_slope, 0) * 2 + greatest(-latest_return_pct, 0) * 0.6 + greatest(20 - min_trades, 0) * 0.08, 5) AS penalty, profitable_ratio >= 0.5 AND active_ratio >= 0.6 AND bearish_ratio <= 0.5 AS admitted FROM s")
def g29(spark, sf_dir):
    return months(spark, sf_dir).select("plan", F.round(Y.penalty(), 5).alias("penalty"), Y.admitted().alias("admitted"))


@query("m25_recency_rescue", f"WITH RECURSIVE {MONTHS} SELECT plan, round(least(coalesce(avg(r) FILTER (2 * (i + 1) <= k), avg(r)), coalesce(avg(r) FILTER (2 * (i + 1) > k), avg(r))), 6) AS rescue FROM mon GROUP BY 1")
def m25(spark, sf_dir):
    e = alone(spark, sf_dir).withColumn("plan", F.col("rule_index").cast("string")).withColumn("window_id", F.floor(F.col("bar") / 42))
    m = accounts(e, plan="string", window_id="long")[1]
    return G.recency_rescue(m, ["plan"], "window_id", "total_return_pct").select("plan", r6("rescue", "rescue"))


@query("g8_evaluation_table", f"WITH RECURSIVE {ACCOUNT}, h AS (SELECT grp, coalesce(CASE WHEN stddev_samp(r / 100) > 1e-12 THEN avg(r) / stddev_samp(r) END, 0) AS sharpe FROM sim_d WHERE r IS NOT NULL GROUP BY 1) SELECT m.grp AS split, 3 AS num_rules, 3 AS num_conditions, round(win_rate_pct, 6) AS win_rate, round(max_drawdown_pct, 6) AS mdd_pct, round(total_return_pct, 6) AS total_return_pct, round(sortino, 6) AS sortino_ratio, round(profit_factor, 6) AS profit_factor, round(coalesce(sharpe, 0), 6) AS sharpe_ratio FROM sim_m m LEFT JOIN h USING (grp)")
def g8(spark, sf_dir):
    log = A.simulate(entries(spark, sf_dir), {"split": "string"}, A.Account())
    t = M.evaluation_table(A.account_metrics(log, ["split"]), log, ["split"], RULES)
    return t.select("split", "num_rules", "num_conditions", *(r6(c, c) for c in ("win_rate", "mdd_pct", "total_return_pct", "sortino_ratio", "profit_factor", "sharpe_ratio")))


@query("g9_rule_breakdown", f"WITH RECURSIVE {ACCOUNT}, t AS (SELECT *, max(equity_after) OVER (PARTITION BY grp, rule_index ORDER BY k) AS peak FROM sim_log WHERE status = 'closed'), z AS (SELECT s.grp, r.k AS rule_index FROM (SELECT DISTINCT grp FROM sim_log) s, range(0, 5) r(k)) SELECT z.grp AS split, CAST(z.rule_index AS INTEGER) AS rule_index, count(t.net) AS num_trades, round(coalesce(sum(net), 0), 6) AS total_pnl, round(coalesce(100.0 * count(*) FILTER (net > 0) / nullif(count(net), 0), 0), 6) AS win_rate, round(coalesce(max(CASE WHEN peak <> 0 THEN (peak - equity_after) / peak * 100 END), 0), 6) AS mdd_pct FROM z LEFT JOIN t ON t.grp = z.grp AND t.rule_index = z.rule_index GROUP BY 1, 2")
def g9(spark, sf_dir):
    """Five rules are listed, two of which never trade."""
    log = A.simulate(entries(spark, sf_dir), {"split": "string"}, A.Account())
    return M.rule_breakdown(log, ["split"], 5).select("split", "rule_index", "num_trades", *(r6(c, c) for c in ("total_pnl", "win_rate", "mdd_pct")))


_POSITIVE = "CASE WHEN {x} <= 0.2 THEN 'Very Low' WHEN {x} <= 0.4 THEN 'Low' WHEN {x} <= 0.6 THEN 'Medium' WHEN {x} <= 0.8 THEN 'High' WHEN {x} > 0.8 THEN 'Very High' END"


@query("g10_g18_c8_stratified", f"WITH RECURSIVE {ACCOUNT}, lab AS (SELECT i.row_id, {SPLIT.replace('bar', 'i.bar')} AS split, {_POSITIVE.format(x='d.drift')} AS drift, CASE WHEN d.close > d.open THEN 'Positive (1)' WHEN d.close < d.open THEN 'Negative (-1)' ELSE 'Neutral (0)' END AS turn FROM ids i JOIN dr d ON d.symbol = i.symbol AND d.bar = i.bar), u AS (SELECT row_id, split, 'drift' AS feature, drift AS fuzzy_value FROM lab UNION ALL SELECT row_id, split, 'turn', turn FROM lab), b AS (SELECT DISTINCT split, feature, fuzzy_value FROM u WHERE fuzzy_value IS NOT NULL), t AS (SELECT u.split, u.feature, u.fuzzy_value, l.net, l.trade_return FROM sim_log l JOIN u ON u.row_id = l.row_id AND u.split = l.grp WHERE l.status = 'closed') SELECT b.split, b.feature, b.fuzzy_value, count(net) AS num_trades, round(coalesce(sum(net), 0) / 10, 6) AS total_return_pct, round(coalesce(count(*) FILTER (net > 0) / nullif(count(net), 0), 0), 6) AS win_rate, round(coalesce(CASE WHEN stddev_samp(trade_return) > 1e-12 THEN avg(trade_return) / stddev_samp(trade_return) END, 0), 6) AS sharpe_ratio FROM b LEFT JOIN t ON t.split = b.split AND t.feature = b.feature AND t.fuzzy_value = b.fuzzy_value GROUP BY 1, 2, 3")
def g10(spark, sf_dir):
    log = A.simulate(entries(spark, sf_dir), {"split": "string"}, A.Account())
    tape = drifts(spark, sf_dir).withColumns({"split": F.when(F.col("bar") < 100, "train").otherwise("val"), "turn": F.signum(F.col("close") - F.col("open"))})
    out = M.stratified(log, tape, {"drift": "positive", "turn": "ternary"}, ["split"])
    return out.select("split", "feature", "fuzzy_value", "num_trades", *(r6(c, c) for c in ("total_return_pct", "win_rate", "sharpe_ratio")))


FOLDED = f"{ALONE}, sz AS (SELECT symbol, count(*) AS n, greatest(1, CAST(floor(count(*) * 0.4) AS BIGINT)) AS first FROM bars GROUP BY 1), fb AS (SELECT symbol, k AS fold, first + k * ((n - first) // 3) + least(k, (n - first) % 3) AS s, first + (k + 1) * ((n - first) // 3) + least(k + 1, (n - first) % 3) AS e FROM sz, range(0, 3) r(k)), acc AS (SELECT ent.*, fold || '|' || rule_index || '|' || CASE WHEN bar < greatest(s - 12, 0) THEN 'inner' ELSE 'outer' END AS grp FROM ent JOIN fb ON fb.symbol = ent.symbol AND (bar < greatest(s - 12, 0) OR (bar >= s AND bar < e))), {account_sql('acc')}"


def folded(spark, sf_dir):
    """Metrics of each rule on the inner and outer rows of nested folds."""
    e = alone(spark, sf_dir)
    b = S.nested_bounds(drifts(spark, sf_dir), 3, 0.4, 12)
    rows = S.fold_rows(e, b).withColumn("candidate", F.col("rule_index")).withColumn("role", F.when(F.col("role") == "train", "inner").otherwise("outer"))
    return accounts(rows, fold="int", candidate="int", role="string")[1]


@query("h8_nested_select", f"WITH RECURSIVE {FOLDED}, f AS (SELECT CAST(split_part(grp, '|', 1) AS INTEGER) AS fold, CAST(split_part(grp, '|', 2) AS INTEGER) AS candidate, max(total_return_pct) FILTER (split_part(grp, '|', 3) = 'inner') AS i, max(total_return_pct) FILTER (split_part(grp, '|', 3) = 'outer') AS o FROM sim_m GROUP BY 1, 2) SELECT fold, candidate, round(o, 6) AS outer_score FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY i DESC, candidate) AS k FROM f WHERE i IS NOT NULL) WHERE k = 1")
def h8(spark, sf_dir):
    return S.nested_select(folded(spark, sf_dir), "total_return_pct").select("fold", "candidate", r6("outer_score", "outer_score"))


_FOLD_M = "f AS (SELECT split_part(grp, '|', 2) AS plan, total_return_pct AS r, profit_factor AS pf, sortino AS so, max_drawdown_pct AS dd, trades AS n, win_rate_pct AS w, split_part(grp, '|', 1) AS fold FROM sim_m WHERE split_part(grp, '|', 3) = 'outer')"


@query("m16_g30_fold_metrics", f"WITH RECURSIVE {FOLDED}, {_FOLD_M} SELECT plan, count(*) AS folds, round(min(r), 6) AS worst_return, round(avg(r), 6) AS mean_return, round(median(r), 6) AS median_return, round(min(pf), 6) AS worst_factor, round(avg(pf), 6) AS mean_factor, round(median(pf), 6) AS median_factor, round(min(so), 6) AS worst_sortino, round(avg(so), 6) AS mean_sortino, round(max(dd), 6) AS worst_drawdown, min(n) AS min_trades, round(first(w ORDER BY r, fold), 6) AS worst_win_rate, round(avg(w), 6) AS mean_win_rate FROM f GROUP BY 1")
def m16(spark, sf_dir):
    f = folded(spark, sf_dir).where("role = 'outer'").withColumn("plan", F.col("candidate").cast("string"))
    out = M.collapse_folds(f, ["plan"])
    return out.select("plan", "folds", "min_trades", *(r6(c, c) for c in out.columns if c not in ("plan", "folds", "min_trades")))


GENES = [[0, 2], [2, 2], [5, 1], [3, 0], [1, 1]]


@query("l4_chromosome_batch", f"WITH RECURSIVE {BARS}, {IDS}, {DRIFT}, cl AS (SELECT symbol, bar, CASE WHEN drift <= 0.2 THEN 0 WHEN drift <= 0.4 THEN 1 WHEN drift <= 0.6 THEN 2 WHEN drift <= 0.8 THEN 3 WHEN drift > 0.8 THEN 4 END AS c0, CAST(close > open AS INTEGER) AS c1 FROM dr), genes(id, g0, g1) AS (VALUES {', '.join(f'({k}, {a}, {b})' for k, (a, b) in enumerate(GENES))}), hit AS (SELECT symbol, bar, id, 0 AS rule_index FROM cl JOIN genes ON (g0 = 5 OR g0 = c0) AND (g1 = 2 OR g1 = c1)), rules(k, tp, sl, capital_pct) AS (VALUES (0, 10.0::DOUBLE, 8.0::DOUBLE, 10.0::DOUBLE)), {touched(('long',))}, {entries_sql('hit')}, acc AS (SELECT *, CAST(id AS VARCHAR) AS grp FROM ent), {account_sql('acc')} SELECT CAST(grp AS INTEGER) AS rule_id, raw_signals, trades, round(total_return_pct, 6) AS total_return_pct, round(profit_factor, 6) AS profit_factor FROM sim_m")
def l4(spark, sf_dir):
    """A batch of chromosomes: each is an account of its own in one job."""
    from barloom.operators.search import match_dense

    tape = shifted(drifts(spark, sf_dir), "entry_price", "open", 1)
    classes = [R.bucket(F.col("drift"), "positive"), (F.col("close") > F.col("open")).cast("int")]
    chromosomes = spark.createDataFrame(list(enumerate(GENES)), "rule long, genes array<int>")
    hits = match_dense(tape, classes, chromosomes, [5, 2]).withColumn("rule_id", F.col("rule").cast("int")).drop("rule")
    rule = {"tp": 10.0, "sl": 8.0, "capital_pct": 10.0}
    e = outcomes(hits.withColumns({"rule_index": F.lit(0), **{k: F.lit(v) for k, v in rule.items()}}), tape, [rule])
    return accounts(e, rule_id="int")[1].select("rule_id", "raw_signals", "trades", r6("total_return_pct", "total_return_pct"), r6("profit_factor", "profit_factor"))


@query("n_account_udtf", f"WITH RECURSIVE {ACCOUNT} SELECT grp AS split, row_id, status, round(net, 6) AS net FROM sim_log")
def n_account(spark, sf_dir):
    """The account as a table function of SQL."""
    from barloom.functions.udtf import register

    register(spark)
    entries(spark, sf_dir).withColumn("plan", F.col("split")).createOrReplaceTempView("barloom_entries")
    return spark.sql("SELECT plan AS split, row_id, status, round(net, 6) AS net FROM capital_account(TABLE(SELECT plan, symbol, direction, rule_index, row_id, release_row, capital_pct, return_pct, entry_price, exit_reason, time_rank, symbol_priority FROM barloom_entries) PARTITION BY plan ORDER BY (time_rank, rule_index, symbol_priority, row_id))")


@query("a8_rule_table", "SELECT s_suppkey AS id, CASE WHEN s_nationkey % 2 = 0 THEN 'long' ELSE 'short' END AS direction, unnest([0, 1]) AS rule, unnest([2.0::DOUBLE, 3.0::DOUBLE]) AS tp, unnest([10.0::DOUBLE, CAST(s_nationkey + 1 AS DOUBLE)]) AS capital_pct, unnest(['a,b', 'c']) AS features, unnest(['1,x', '']) AS symbols FROM supplier")
def a8(spark, sf_dir):
    """Strategies that are JSON in a column, as a table of rules."""
    from barloom.sources.tape import table

    s = table(spark, sf_dir, "supplier")
    text = F.concat(F.lit('{"direction": "'), F.when(F.col("s_nationkey") % 2 == 0, "long").otherwise("short"), F.lit('", "capital_pct": '), (F.col("s_nationkey") + 1).cast("string"),
                    F.lit(', "rules_set": [{"conditions": ["[a] IS Low", "[b] IS High", "Symbol is 1.0, x"], "tp": 2, "sl": 1, "capital_pct": 10}, {"conditions": ["[c] IS Low"], "tp": 3, "sl": 1}]}'))
    out = T.rule_table(spark, s.select(F.col("s_suppkey").alias("id"), text.alias("json")))
    return out.select("id", "direction", "rule", "tp", "capital_pct", F.array_join("features", ",").alias("features"), F.array_join("symbols", ",").alias("symbols"))


@query("k_decode_genes", "SELECT p_partkey AS id, concat_ws(' AND ', '[a] IS ' || CASE p_size % 6 WHEN 0 THEN 'Very Low' WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' WHEN 4 THEN 'Very High' END, '[b] IS ' || CASE p_size % 3 WHEN 0 THEN 'Inactive (0)' WHEN 1 THEN 'Active (1)' END) AS conditions FROM part")
def k_decode(spark, sf_dir):
    from barloom.sources.tape import table

    z = F.col("p_size")
    genes = F.array((z % 6).cast("int"), (z % 3).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(T.decode(genes, [("a", "positive"), ("b", "binary")]), " AND ").alias("conditions"))
