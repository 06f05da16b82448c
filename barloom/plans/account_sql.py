"""SQL twins of the capital account: a recursive query that steps through the entries of all
groups at once. Its state holds the open positions as a list."""

from __future__ import annotations

from .q_tape import BARS, H, barrier_sql

FOREVER = 1 << 61
_OPEN = "STRUCT(symbol VARCHAR, direction VARCHAR, rel BIGINT, notional DOUBLE, net DOUBLE, fee DOUBLE, price DOUBLE, row_id BIGINT, reason VARCHAR)[]"
_CLOSED = "STRUCT(row_id BIGINT, direction VARCHAR, net DOUBLE, after DOUBLE, worst DOUBLE, reason VARCHAR, relative DOUBLE)[]"

IDS = "ids AS (SELECT symbol, bar, datetime, row_number() OVER (ORDER BY datetime, symbol) - 1 AS row_id, lead(open) OVER (PARTITION BY symbol ORDER BY datetime) AS next_open FROM bars)"


def touched(directions: tuple[str, ...]) -> str:
    return barrier_sql([(10.0, 8.0), (25.0, 15.0)], directions)


def rules_sql(rules: list[dict]) -> str:
    return "rules(k, tp, sl, capital_pct) AS (VALUES " + ", ".join(f"({k}, {r['tp']}::DOUBLE, {r['sl']}::DOUBLE, {r['capital_pct']}::DOUBLE)" for k, r in enumerate(rules)) + ")"


def entries_sql(assigned: str, name: str = "ent", direction: str = "long") -> str:
    """CTE of the entries: assigned has symbol, bar, rule_index."""
    return f"""{name} AS (SELECT a.*, '{direction}' AS direction, i.row_id, coalesce(j.row_id, {FOREVER}) AS release_row, r.capital_pct, t.return_pct, i.next_open AS entry_price,
 CASE WHEN abs(t.return_pct - r.tp) <= 1e-5 THEN 'TP' WHEN abs(t.return_pct + r.sl) <= 1e-5 THEN 'SL' ELSE 'Time_{H}' END AS reason, CAST(epoch(i.datetime) AS BIGINT) AS time_rank, 0.2::DOUBLE AS fee_pct
 FROM {assigned} a JOIN rules r ON r.k = a.rule_index JOIN touch t ON t.symbol = a.symbol AND t.bar = a.bar AND t.direction = '{direction}' AND t.tp = r.tp AND t.sl = r.sl AND t.exit_offset > 0
 JOIN ids i ON i.symbol = a.symbol AND i.bar = a.bar LEFT JOIN ids j ON j.symbol = a.symbol AND j.bar = a.bar + t.exit_offset)"""


_PATHS = """list_transform(range(1, len(path) + 1), lambda i: greatest(peak, list_max(path[1:i])))"""
_DIPS = "list_transform(range(1, len(path) + 1), lambda i: CASE WHEN peaks[i] > 0 THEN (peaks[i] - path[i]) / peaks[i] * 100 ELSE 100.0 END)"


def _closing(due: str, joint: bool = False) -> str:
    relative = "due[i].net / greatest(CASE WHEN i = 1 THEN equity ELSE path[i - 1] END, 1e-9)" if joint else "NULL::DOUBLE"
    return f"list_transform(range(1, len(path) + 1), lambda i: {{'row_id': {due}[i].row_id, 'direction': {due}[i].direction, 'net': {due}[i].net, 'after': path[i], 'worst': greatest(worst, list_max(dips[1:i])), 'reason': {due}[i].reason, 'relative': {relative}}})"


def account_sql(entries: str, name: str = "sim", joint: bool = False) -> str:
    """CTEs {name}_log (an entry each) and {name}_m (metrics by grp). entries has grp and the
    columns of entries_sql()."""
    order = "time_rank, row_id, direction, rule_index" if joint else "time_rank, rule_index, row_id"
    n = name
    held = "list_filter(rest, lambda p: p.symbol = e_symbol)[1]"
    if joint:
        # An opposite position leaves; it is closed at this entry's price if both prices are there.
        due = f"""CASE WHEN held IS NOT NULL AND held.direction <> e_direction AND held.price > 0 AND e_price IS NOT NULL THEN list_append(due0, struct_pack(symbol := held.symbol, direction := held.direction, rel := e_row, notional := held.notional,
   net := held.notional * ((e_price - held.price) / held.price * 100 * CASE held.direction WHEN 'long' THEN 1 ELSE -1 END) / 100 - held.fee, fee := held.fee, price := held.price, row_id := held.row_id, reason := 'Reverse')) ELSE due0 END"""
        rest = "CASE WHEN held IS NOT NULL AND held.direction <> e_direction THEN list_filter(rest0, lambda p: p.symbol <> e_symbol) ELSE rest0 END"
        status = "CASE WHEN held IS NOT NULL AND held.direction = e_direction THEN 'skipped_same_side' WHEN notional < 1 THEN 'skipped_min_notional' WHEN e_ret IS NULL THEN 'no_return' ELSE 'closed' END"
        stop, ruin = "true", "false"
    else:
        due, rest = "due0", "rest0"
        status = "CASE WHEN ruined THEN 'after_ruin' WHEN held IS NOT NULL THEN 'held' WHEN notional < 1 THEN 'skipped_min_notional' ELSE 'closed' END"
        stop, ruin = "NOT s.ruined", "s_ruined OR len(list_filter(path, lambda x: x <= 0)) > 0"
    return f"""{n}_e AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {order}) AS k FROM {entries}),
{n}_s AS (
 SELECT grp, 0::BIGINT AS k, 1000.0::DOUBLE AS equity, 1000.0::DOUBLE AS peak, 0.0::DOUBLE AS worst, false AS ruined, CAST([] AS {_OPEN}) AS open, NULL::DOUBLE AS notional, NULL::DOUBLE AS net, NULL::VARCHAR AS status,
  CAST([] AS {_CLOSED}) AS closed, 0::BIGINT AS n_open, 0.0::DOUBLE AS exposure FROM (SELECT DISTINCT grp FROM {n}_e)
 UNION ALL
 SELECT grp, k, eq AS equity, peak2 AS peak, worst2 AS worst, ruined, CASE WHEN status = 'closed' THEN list_append(rest, mine) ELSE rest END AS open, CASE WHEN status = 'closed' THEN notional END AS notional, CASE WHEN status = 'closed' THEN net END AS net,
  status, closed, CASE WHEN status = 'closed' THEN CAST(len(rest) + 1 AS BIGINT) ELSE 0 END AS n_open, CASE WHEN status = 'closed' THEN used + notional ELSE 0.0 END AS exposure FROM (
 SELECT *, {status} AS status, struct_pack(symbol := e_symbol, direction := e_direction, rel := e_rel, notional := notional, net := notional * e_ret / 100 - notional * e_fee / 100, fee := notional * e_fee / 100, price := e_price, row_id := e_row, reason := e_reason) AS mine,
  notional * e_ret / 100 - notional * e_fee / 100 AS net FROM (
 SELECT *, least(eq * e_cap / 100, greatest(0.0, eq - used)) AS notional FROM (
 SELECT *, coalesce(path[len(path)], equity) AS eq, coalesce(peaks[len(peaks)], peak) AS peak2, greatest(worst, coalesce(list_max(dips), 0.0)) AS worst2, {ruin} AS ruined, {_closing('due', joint)} AS closed,
  coalesce(list_sum(list_transform(rest, lambda p: p.notional)), 0.0) AS used FROM (
 SELECT *, {_DIPS} AS dips FROM (
 SELECT *, {_PATHS} AS peaks FROM (
 SELECT *, list_transform(range(1, len(due) + 1), lambda i: equity + list_sum(list_transform(due[1:i], lambda p: p.net))) AS path FROM (
 SELECT *, {due} AS due, {rest} AS rest FROM (
 SELECT *, {held.replace('rest', 'rest0')} AS held FROM (
 SELECT s.grp, e.k, s.equity, s.peak, s.worst, s.ruined AS s_ruined, e.symbol AS e_symbol, e.direction AS e_direction, e.row_id AS e_row, e.release_row AS e_rel, e.capital_pct AS e_cap, e.return_pct AS e_ret, e.entry_price AS e_price, e.fee_pct AS e_fee, e.reason AS e_reason,
  list_filter(s.open, lambda p: p.rel <= e.row_id) AS due0, list_filter(s.open, lambda p: p.rel > e.row_id) AS rest0
 FROM {n}_s s JOIN {n}_e e ON e.grp = s.grp AND e.k = s.k + 1 WHERE {stop})))))))))),
{n}_last AS (SELECT grp, equity, peak, worst, open AS due, list_transform(range(1, len(open) + 1), lambda i: equity + list_sum(list_transform(open[1:i], lambda p: p.net))) AS path FROM {n}_s QUALIFY row_number() OVER (PARTITION BY grp ORDER BY k DESC) = 1),
{n}_flush AS (SELECT grp, {_closing('due', joint)} AS closed FROM (SELECT *, {_DIPS} AS dips FROM (SELECT *, {_PATHS} AS peaks FROM {n}_last))),
{n}_closed AS (SELECT grp, c.* FROM (SELECT grp, unnest(closed) AS c FROM {n}_s UNION ALL SELECT grp, unnest(closed) AS c FROM {n}_flush)),
{n}_log AS (SELECT e.grp, e.symbol, e.direction, e.rule_index, e.row_id, e.bar, e.k, CASE WHEN s.k IS NULL THEN 'after_ruin' ELSE s.status END AS status, s.notional, coalesce(c.net, s.net) AS net, c.after AS equity_after, c.worst AS drawdown_pct, c.reason AS exit_reason, s.n_open, s.exposure,
  {'c.relative' if joint else 's.net / b.equity_before'} AS trade_return, b.equity_before FROM {n}_e e LEFT JOIN {n}_s s ON s.grp = e.grp AND s.k = e.k LEFT JOIN {n}_closed c ON c.grp = e.grp AND c.row_id = e.row_id AND c.direction = e.direction
  LEFT JOIN (SELECT grp, k, equity AS equity_before FROM {n}_s) b ON b.grp = e.grp AND b.k = e.k),
{n}_d AS (SELECT *, CASE WHEN status = 'closed' THEN 100 * trade_return END AS r FROM {n}_log),
{n}_sorted AS (SELECT grp, r, row_number() OVER (PARTITION BY grp ORDER BY r) AS rn, count(*) OVER (PARTITION BY grp) AS n FROM {n}_d WHERE r IS NOT NULL),
{n}_short AS (SELECT grp, avg(r) AS shortfall FROM {n}_sorted WHERE rn <= greatest(ceil(n * greatest(0.1, 1.0 / n)), 1) GROUP BY 1),
{n}_m0 AS (SELECT grp, count(*) AS raw_signals, count(r) AS trades, count(*) FILTER (status = 'closed' AND net > 0) AS wins, count(*) FILTER (status = 'closed' AND net < 0) AS losses, count(*) FILTER (status = 'closed' AND exit_reason LIKE 'Time%') AS time_closed,
  count(*) FILTER (status = 'skipped_min_notional') AS skipped_min_notional, count(*) FILTER (status = 'skipped_same_side') AS skipped_same_side, count(*) FILTER (exit_reason = 'Reverse') AS reversals, coalesce(sum(net) FILTER (status = 'closed'), 0) AS total,
  coalesce(sum(net) FILTER (status = 'closed' AND net > 0), 0) AS gross_profit, coalesce(-sum(net) FILTER (status = 'closed' AND net < 0), 0) AS gross_loss, coalesce(max(drawdown_pct), 0) AS max_drawdown_pct, coalesce(bool_or(equity_after <= 0), false) AS account_ruined,
  coalesce(avg(notional) FILTER (status = 'closed'), 0) AS mean_notional, CAST(coalesce(max(n_open), 0) AS BIGINT) AS max_positions, coalesce(max(exposure), 0) AS max_exposure, coalesce(max(net) FILTER (status = 'closed' AND net > 0), 0) AS max_single_pnl,
  coalesce(avg(r), 0) AS expectancy_pct, coalesce(stddev_samp(r), 0) AS return_std_pct, sqrt(avg(pow(least(r / 100, 0), 2))) AS down FROM {n}_d GROUP BY 1),
{n}_m AS (SELECT m.*, 1000 + total AS final_equity, total / 10 AS total_return_pct, CASE WHEN gross_loss > 0 THEN gross_profit / gross_loss WHEN gross_profit > 0 THEN 99 ELSE 0 END AS profit_factor, CASE WHEN trades > 0 THEN 100.0 * wins / trades ELSE 0 END AS win_rate_pct,
  CASE WHEN down > 0 THEN least(expectancy_pct / 100 / down, 20) WHEN expectancy_pct > 0 THEN 20 ELSE 0 END * least(1.0, trades / 20.0) AS sortino, CASE WHEN trades > 0 THEN expectancy_pct - 1.645 * return_std_pct / sqrt(trades) ELSE 0 END AS expectancy_lcb_pct,
  coalesce(h.shortfall, 0) AS expected_shortfall_pct FROM {n}_m0 m LEFT JOIN {n}_short h USING (grp))"""


def bars_sql(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join([BARS, *parts])
