"""Queries of the simulator and of search over rule tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import labels as L  # noqa: N812
from barloom.operators import pool as P  # noqa: N812
from barloom.operators import rules as R  # noqa: N812
from barloom.operators import search as Q  # noqa: N812
from barloom.operators import simulate as A  # noqa: N812
from barloom.operators import splits as S  # noqa: N812
from barloom.operators.chunks import shifted
from barloom.sources.tape import event_bars, table

from .account_sql import IDS, account_sql, entries_sql, rules_sql, touched
from .q_tape import BARS, H, barrier_sql
from .registry import query, r6

RULES = [
    {"conditions": ["[drift] IS High"], "tp": 10.0, "sl": 8.0, "capital_pct": 10.0},
    {"conditions": ["[drift] IS Low", "symbol is click, view"], "tp": 25.0, "sl": 15.0, "capital_pct": 20.0},
    {"conditions": [], "tp": 10.0, "sl": 8.0, "capital_pct": 5.0},
]
DRIFT = "dr AS (SELECT *, close / nullif(close + open, 0) AS drift FROM bars)"
ASSIGN = f"{BARS}, {DRIFT}, asg AS (SELECT *, CASE WHEN drift > 0.6 AND drift <= 0.8 THEN 0 WHEN drift > 0.2 AND drift <= 0.4 AND symbol IN ('click', 'view') THEN 1 ELSE 2 END AS rule_index FROM dr)"


#: The same rules with a pair that no bar touches: the exit is the horizon's.
FIXED = [r | {"tp": 1e6, "sl": 1e6} for r in RULES]


def drifts(spark, sf_dir):
    return S.row_ids(event_bars(spark, sf_dir)).withColumn("drift", F.try_divide(F.col("close"), F.col("close") + F.col("open")))


def outcomes(assigned, tape, rules, direction="long"):
    """Entries of rows with a rule (symbol, bar, tp, sl, capital_pct, rule_index): their outcome
    and the row at which they are released."""
    grid = sorted({(r["tp"], r["sl"]) for r in rules})
    out = L.barrier(tape, H, grid, (direction,), "bar").where("exit_offset > 0")
    rows = tape.select("symbol", F.col("bar").alias("exit_bar"), F.col("row_id").alias("release_row"))
    df = assigned.join(out, ["symbol", "bar", "tp", "sl"]).withColumn("exit_bar", F.col("bar") + F.col("exit_offset")).join(rows, ["symbol", "exit_bar"], "left")
    return df.withColumns({
        "release_row": F.coalesce("release_row", F.lit(1 << 61)), "exit_reason": L.exit_reason(F.col("return_pct"), F.col("tp"), F.col("sl"), H),
        "time_rank": F.unix_timestamp("datetime"), "symbol_priority": F.lit(0), "split": F.when(F.col("bar") < 100, "train").otherwise("val")})


def entries(spark, sf_dir, direction="long", rules=RULES, tape=None):
    tape = drifts(spark, sf_dir) if tape is None else tape
    return outcomes(R.assign(shifted(tape, "entry_price", "open", 1, "bar"), rules, direction), tape, rules, direction)


BASE = f"{BARS}, {IDS}, {DRIFT}, asg AS (SELECT symbol, bar, CASE WHEN drift > 0.6 AND drift <= 0.8 THEN 0 WHEN drift > 0.2 AND drift <= 0.4 AND symbol IN ('click', 'view') THEN 1 ELSE 2 END AS rule_index FROM dr), {rules_sql(RULES)}, {touched(('long',))}, {entries_sql('asg')}"
SPLIT = "CASE WHEN bar < 100 THEN 'train' ELSE 'val' END"
ACCOUNT = f"{BASE}, acc AS (SELECT *, {SPLIT} AS grp FROM ent), {account_sql('acc')}"
M6 = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query("l1_priority_assignment", f"WITH {ASSIGN} SELECT rule_index, symbol, count(*) AS n, min(bar) AS first_bar FROM asg GROUP BY 1, 2")
def l1(spark, sf_dir):
    tape = event_bars(spark, sf_dir).withColumn("drift", F.try_divide(F.col("close"), F.col("close") + F.col("open")))
    return R.assign(tape, RULES).groupBy("rule_index", "symbol").agg(F.count("*").alias("n"), F.min("bar").alias("first_bar"))


@query("l2_equity_state_machine", f"WITH RECURSIVE {ACCOUNT} SELECT grp AS split, raw_signals, trades, wins, losses, time_closed, skipped_min_notional, max_positions, account_ruined, {M6('final_equity', 'total_return_pct', 'profit_factor', 'max_drawdown_pct', 'win_rate_pct', 'sortino', 'expectancy_pct', 'return_std_pct', 'expectancy_lcb_pct', 'expected_shortfall_pct', 'mean_notional', 'max_exposure', 'gross_profit', 'gross_loss', 'max_single_pnl')} FROM sim_m")
def l2(spark, sf_dir):
    log = A.simulate(entries(spark, sf_dir), {"split": "string"}, A.Account())
    m = A.account_metrics(log, ["split"])
    rounded = ("final_equity", "total_return_pct", "profit_factor", "max_drawdown_pct", "win_rate_pct", "sortino", "expectancy_pct", "return_std_pct", "expectancy_lcb_pct", "expected_shortfall_pct", "mean_notional", "max_exposure", "gross_profit", "gross_loss", "max_single_pnl")
    return m.select("split", "raw_signals", "trades", "wins", "losses", "time_closed", "skipped_min_notional", "max_positions", "account_ruined", *(r6(c, c) for c in rounded))


@query("l2_trade_log", f"WITH RECURSIVE {ACCOUNT} SELECT grp AS split, symbol, rule_index, row_id, {M6('notional', 'net', 'equity_after')}, exit_reason, status FROM sim_log WHERE status <> 'held'")
def l2_log(spark, sf_dir):
    log = A.simulate(entries(spark, sf_dir), {"split": "string"}, A.Account()).where("status <> 'held'")
    reason = F.when(F.col("status") == "closed", F.col("exit_reason"))
    return log.select("split", "symbol", "rule_index", "row_id", r6("notional", "notional"), r6("net", "net"), r6("equity_after", "equity_after"), reason.alias("exit_reason"), "status")


@query("l2_ruined_account", f"WITH RECURSIVE {BASE}, acc AS (SELECT * REPLACE (100.0::DOUBLE AS capital_pct, -150.0::DOUBLE + 20 * (row_id % 7) AS return_pct), symbol AS grp FROM ent), {account_sql('acc')} SELECT grp AS symbol, raw_signals, trades, account_ruined, {M6('final_equity', 'max_drawdown_pct')} FROM sim_m")
def l2_ruin(spark, sf_dir):
    """Accounts that lose all: they stop for good."""
    e = entries(spark, sf_dir).withColumns({"capital_pct": F.lit(100.0), "return_pct": F.lit(-150.0) + 20 * (F.col("row_id") % 7)})
    m = A.account_metrics(A.simulate(e.withColumn("plan", F.col("symbol")), {"plan": "string"}, A.Account()), ["plan"])
    return m.select(F.col("plan").alias("symbol"), "raw_signals", "trades", "account_ruined", r6("final_equity", "final_equity"), r6("max_drawdown_pct", "max_drawdown_pct"))


JOINT = f"{BASE.replace(touched(('long',)), touched(('long', 'short')))}, {entries_sql('asg', 'ent_s', 'short')}, acc AS (SELECT *, {SPLIT} AS grp FROM (SELECT * FROM ent UNION ALL SELECT * FROM ent_s)), {account_sql('acc', joint=True)}"


@query("l6_joint_portfolio", f"WITH RECURSIVE {JOINT} SELECT grp AS split, trades, skipped_same_side, reversals, {M6('final_equity', 'max_drawdown_pct', 'expectancy_pct')} FROM sim_m")
def l6(spark, sf_dir):
    both = entries(spark, sf_dir).unionByName(entries(spark, sf_dir, "short"))
    m = A.account_metrics(A.simulate(both, {"split": "string"}, A.Account(joint=True)), ["split"])
    return m.select("split", "trades", "skipped_same_side", "reversals", r6("final_equity", "final_equity"), r6("max_drawdown_pct", "max_drawdown_pct"), r6("expectancy_pct", "expectancy_pct"))


FEES = f"{BASE}, acc AS (SELECT e.* REPLACE (0.2::DOUBLE * f.m AS fee_pct), f.m AS fee_mult, CAST(floor(bar / 42) AS BIGINT) AS window_id, {{grp}} AS grp FROM ent e, (VALUES (1.0::DOUBLE), (1.5::DOUBLE)) f(m)), {account_sql('acc')}"


def with_fees(df, *mults):
    """Each entry at several fee levels: one more grouping key, not one more job."""
    return df.withColumn("fee_mult", F.explode(F.array(*map(F.lit, mults)))).withColumn("fee_pct", 0.2 * F.col("fee_mult"))


@query("l9_monthly_accounts", "WITH RECURSIVE " + FEES.replace("{grp}", "floor(bar / 42) || '|' || f.m") + " SELECT g.window_id, g.fee_mult, trades, round(total_return_pct, 6) AS total_return_pct FROM sim_m JOIN (SELECT DISTINCT grp, window_id, fee_mult FROM acc) g USING (grp)")
def l9(spark, sf_dir):
    """An account for each window of 42 bars and each fee level, in one job."""
    e = with_fees(entries(spark, sf_dir).withColumn("window_id", F.floor(F.col("bar") / 42)), 1.0, 1.5)
    m = A.account_metrics(A.simulate(e, {"window_id": "long", "fee_mult": "double"}, A.Account()), ["window_id", "fee_mult"])
    return m.select("window_id", "fee_mult", "trades", r6("total_return_pct", "total_return_pct"))


@query("l10_cost_stress", "WITH RECURSIVE " + FEES.replace("{grp}", f"{SPLIT} || '|' || f.m") + " SELECT bool_and(total_return_pct >= 0 AND expectancy_lcb_pct >= 0) AS passed, round(min(total_return_pct), 6) AS worst_return_pct, count(*) AS runs FROM sim_m WHERE grp LIKE '%1.5'")
def l10(spark, sf_dir):
    from barloom.operators.monthly import cost_stress

    e = with_fees(entries(spark, sf_dir), 1.0, 1.5)
    m = A.account_metrics(A.simulate(e, {"split": "string", "fee_mult": "double"}, A.Account()), ["split", "fee_mult"])
    return cost_stress(m.withColumn("plan", F.lit(1)), ["plan"]).select("passed", r6("worst_return_pct", "worst_return_pct"), "runs")


PLANS = f"""{BASE}, frules AS (SELECT k, 1e6::DOUBLE AS tp, 1e6::DOUBLE AS sl, capital_pct FROM rules), {entries_sql('asg', 'ent_f').replace('JOIN rules r', 'JOIN frules r')},
sh AS (SELECT a.symbol, a.bar, b.drift FROM (SELECT symbol, bar, row_number() OVER (PARTITION BY symbol ORDER BY bar) AS k FROM dr) a JOIN (SELECT symbol, drift, row_number() OVER (PARTITION BY symbol ORDER BY md5('5|' || symbol || '|' || bar)) AS k FROM dr) b ON a.symbol = b.symbol AND a.k = b.k),
asg_s AS (SELECT symbol, bar, CASE WHEN drift > 0.6 AND drift <= 0.8 THEN 0 WHEN drift > 0.2 AND drift <= 0.4 AND symbol IN ('click', 'view') THEN 1 ELSE 2 END AS rule_index FROM sh), {entries_sql('asg_s', 'ent_s')},
acc AS (SELECT *, 'all' AS grp FROM ent UNION ALL SELECT * REPLACE (10.0::DOUBLE AS capital_pct), 'equal_weight' FROM ent UNION ALL SELECT *, 'random_entry' FROM ent WHERE CAST('0x' || substr(md5('3|' || row_id), 1, 8) AS BIGINT) % 100 < 3
 UNION ALL SELECT *, 'drop_rule_1' FROM ent WHERE rule_index <> 1 UNION ALL SELECT *, 'fixed_exit' FROM ent_f UNION ALL SELECT *, 'shuffled_feature' FROM ent_s), {account_sql('acc')}""".replace(touched(('long',)), barrier_sql([(10.0, 8.0), (25.0, 15.0), (1e6, 1e6)], ('long',)))


@query("l8_ablations", f"WITH RECURSIVE {PLANS} SELECT grp AS plan, trades, {M6('total_return_pct', 'max_drawdown_pct')} FROM sim_m")
def l8(spark, sf_dir):
    """Baselines as groups of one job: equal weight, random entries, a dropped rule, exits at the
    horizon alone, and a feature dealt anew."""
    from barloom.operators.features import shuffled

    tape = drifts(spark, sf_dir)
    e = entries(spark, sf_dir, tape=tape)
    some = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("3"), F.col("row_id").cast("string"))), 1, 8), 16, 10).cast("long") % 100 < 3
    fixed = entries(spark, sf_dir, rules=FIXED, tape=tape)
    null = entries(spark, sf_dir, tape=shuffled(tape, "drift", ["symbol"], ["bar"], 5))
    parts = {"all": e, "equal_weight": e.withColumn("capital_pct", F.lit(10.0)), "random_entry": e.where(some), "drop_rule_1": e.where("rule_index <> 1"), "fixed_exit": fixed, "shuffled_feature": null}
    df = None
    for plan, part in parts.items():
        part = part.select("symbol", "direction", *(c for c in A.ENTRY if c not in ("symbol", "direction"))).withColumn("plan", F.lit(plan))
        df = part if df is None else df.unionByName(part)
    m = A.account_metrics(A.simulate(df, {"plan": "string"}, A.Account()), ["plan"])
    return m.select("plan", "trades", r6("total_return_pct", "total_return_pct"), r6("max_drawdown_pct", "max_drawdown_pct"))


@query("m21_risk_grid", f"WITH {BARS}, {barrier_sql([(10.0, 8.0), (10.0, 15.0), (25.0, 8.0), (25.0, 15.0)], ('long',))}, s AS (SELECT tp, sl, CASE WHEN bar < 100 THEN 0 ELSE 1 END AS fold, avg(return_pct) AS r FROM touch WHERE exit_offset > 0 GROUP BY ALL) SELECT tp, sl, round(min(r), 6) AS worst_fold FROM s GROUP BY 1, 2")
def m21(spark, sf_dir):
    out = L.barrier(event_bars(spark, sf_dir), H, [(tp, sl) for tp in (10.0, 25.0) for sl in (8.0, 15.0)], ("long",), "bar").where("exit_offset > 0")
    s = out.groupBy("tp", "sl", F.when(F.col("bar") < 100, 0).otherwise(1).alias("fold")).agg(F.avg("return_pct").alias("r"))
    return s.groupBy("tp", "sl").agg(r6(F.min("r"), "worst_fold"))


#: A population of candidate rules: one for each supplier.
POP = "pop AS (SELECT s_suppkey AS id, s_nationkey AS island, -s_acctbal AS f1, CAST(s_suppkey * 7919 % 1000 AS DOUBLE) AS f2 FROM supplier)"


def population(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("island"), (-F.col("s_acctbal")).alias("f1"), (F.col("s_suppkey") * 7919 % 1000).cast("double").alias("f2"))


#: The front of a row is the length of the longest chain of rows that beat each other up to it.
CHAIN = "chain(id, k) AS (SELECT id, 1 FROM {t} UNION SELECT d.b, c.k + 1 FROM chain c JOIN dom d ON d.a = c.id), fr AS (SELECT id, max(k) AS front FROM chain GROUP BY 1)"
DOM = "dom AS (SELECT p.id AS a, q.id AS b FROM pop p JOIN pop q ON p.f1 <= q.f1 AND p.f2 <= q.f2 AND (p.f1 < q.f1 OR p.f2 < q.f2))"


@query("m2_pareto_fronts", f"WITH RECURSIVE {POP}, {DOM}, {CHAIN.format(t='pop')} SELECT id, front FROM fr")
def m2(spark, sf_dir):
    return Q.fronts(population(spark, sf_dir), "id", ["f1", "f2"]).select("id", "front")


@query("m3_constrained_front", f"WITH RECURSIVE {POP}, c AS (SELECT *, greatest(f1 + 5000, 0) AS v FROM pop), dom AS (SELECT p.id AS a, q.id AS b FROM c p JOIN c q ON CASE WHEN (p.v = 0) <> (q.v = 0) THEN p.v = 0 WHEN p.v > 0 AND p.v <> q.v THEN p.v < q.v ELSE p.f1 <= q.f1 AND p.f2 <= q.f2 AND (p.f1 < q.f1 OR p.f2 < q.f2) END), {CHAIN.format(t='pop')} SELECT c.id, front, round(v, 6) AS violation FROM fr JOIN c USING (id)")
def m3(spark, sf_dir):
    df = population(spark, sf_dir).withColumn("violation", Q.violation({"gain": (-F.col("f1"), 5000.0)}))
    return Q.fronts(df, "id", ["f1", "f2"], violation="violation").select("id", "front", r6("violation", "violation"))


@query("e20_crowding", f"WITH {POP}, w AS (SELECT id, island, count(*) OVER i AS n, lag(f1) OVER a AS p1, lead(f1) OVER a AS q1, lag(f2) OVER b AS p2, lead(f2) OVER b AS q2, max(f1) OVER i - min(f1) OVER i AS r1, max(f2) OVER i - min(f2) OVER i AS r2 FROM pop WINDOW a AS (PARTITION BY island ORDER BY f1, id), b AS (PARTITION BY island ORDER BY f2, id), i AS (PARTITION BY island)), e AS (SELECT *, n <= 2 OR p1 IS NULL OR q1 IS NULL OR p2 IS NULL OR q2 IS NULL AS edge FROM w) SELECT id, island AS front, edge, CASE WHEN NOT edge THEN round(CASE WHEN r1 > 0 THEN (q1 - p1) / r1 ELSE 0 END + CASE WHEN r2 > 0 THEN (q2 - p2) / r2 ELSE 0 END, 6) END AS crowding FROM e")
def e20(spark, sf_dir):
    p = population(spark, sf_dir).withColumnRenamed("island", "front")
    edge = F.col("crowding") == float("inf")
    return Q.crowding(p, "id", ["f1", "f2"]).select("id", "front", edge.alias("edge"), F.when(~edge, F.round("crowding", 6)).alias("crowding"))


@query("m4_hamming", "WITH g AS (SELECT p_partkey AS id, p_size % 3 AS a, p_size % 5 AS b, p_size % 7 AS c FROM part), k AS (SELECT n_nationkey % 3 AS a, n_nationkey % 5 AS b, n_nationkey % 7 AS c FROM nation) SELECT id, min(CAST(g.a <> k.a AS INTEGER) + CAST(g.b <> k.b AS INTEGER) + CAST(g.c <> k.c AS INTEGER)) AS nearest FROM g, k GROUP BY 1")
def m4(spark, sf_dir):
    """Least distance to an archive, which is a table."""
    z, n = F.col("p_size"), F.col("n_nationkey")
    g = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(z % 3, z % 5, z % 7).alias("genes"))
    k = table(spark, sf_dir, "nation").select(F.array(n % 3, n % 5, n % 7).alias("g"))
    return P.nearest_distance(g, "genes", k, 3).select("id", "nearest")


GENOTYPES = "ge AS (SELECT p_partkey AS id, [p_size % 4, p_partkey % 3, (p_partkey * 7) % 5, p_size % 3, p_partkey % 2, (p_size * 3) % 4] AS g, p_retailprice AS score, 1 + p_size % 4 AS front FROM part)"


def genotypes(spark, sf_dir):
    z, k = F.col("p_size"), F.col("p_partkey")
    genes = F.transform(F.array(z % 4, k % 3, (k * 7) % 5, z % 3, k % 2, (z * 3) % 4), lambda x: x.cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("id"), genes.alias("g"), F.col("p_retailprice").alias("score"), (1 + z % 4).alias("front"))


@query("m5_diversity_penalty", f"WITH {GENOTYPES}, r AS (SELECT * FROM ge WHERE front = 1), p AS (SELECT a.id, a.g, CAST(trunc(a.score / 50) AS INTEGER) AS b FROM ge a), q AS (SELECT DISTINCT g, CAST(trunc(score / 50) AS INTEGER) AS b FROM r), h AS (SELECT p.id, bool_or(p.g <> q.g AND len(list_filter(range(1, 7), lambda i: p.g[i] <> q.g[i])) <= 1) AS near, bool_or(p.g <> q.g AND p.b = q.b) AS same FROM p, q GROUP BY 1) SELECT id, CASE WHEN near OR same THEN 0.25 ELSE 0.0 END::DOUBLE AS penalty FROM h")
def m5b(spark, sf_dir):
    """Candidates near a reference in their genes, or in its phenotype with other genes."""
    df = genotypes(spark, sf_dir)
    return P.diversity_penalty(df, df.where("front = 1"), 6, 1, {"score": 50.0}, 0.25).select("id", "penalty")


@query("m8_encodings", "SELECT p_partkey AS id, CAST(p_size % 3 <> 2 AS INTEGER) + CAST(p_size % 5 <> 4 AS INTEGER) AS active, (p_size % 3) || ',' || (p_size % 5) AS dense FROM part")
def m8(spark, sf_dir):
    z = F.col("p_size")
    p = table(spark, sf_dir, "part").withColumn("slots", Q.to_sparse(F.array(z % 3, z % 5), [2, 4]))
    return p.select(F.col("p_partkey").alias("id"), F.size("slots").alias("active"), F.array_join(F.transform(Q.to_dense(F.col("slots"), [2, 4]), lambda g: g.cast("string")), ",").alias("dense"))


@query("m11_cache_misses", f"WITH {POP}, c AS (SELECT id FROM pop WHERE id % 3 = 0) SELECT count(*) AS misses, min(id) AS first_id FROM pop p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.id = p.id)")
def m11(spark, sf_dir):
    p = population(spark, sf_dir)
    return P.misses(p, p.where("id % 3 = 0"), ["id"]).agg(F.count("*").alias("misses"), F.min("id").alias("first_id"))


@query("m19_rule_overlap", "WITH m AS (SELECT DISTINCT l_linenumber AS rule, l_suppkey AS row FROM lineitem), s AS (SELECT rule, count(*) AS n FROM m GROUP BY 1), b AS (SELECT x.rule AS a, y.rule AS b, count(*) AS c FROM m x JOIN m y ON x.row = y.row AND x.rule < y.rule GROUP BY 1, 2) SELECT a, b, round(c / least(p.n, q.n), 6) AS coefficient FROM b JOIN s p ON p.rule = a JOIN s q ON q.rule = b")
def m19(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("rule"), F.col("l_suppkey").alias("row"))
    return Q.overlap(m).select("a", "b", r6("coefficient", "coefficient"))


@query("m22_capital_budget", f"WITH {POP} SELECT id, round(CASE WHEN sum(f2) OVER (PARTITION BY island) > 100 THEN f2 * 100 / sum(f2) OVER (PARTITION BY island) ELSE f2 END, 6) AS scaled FROM pop")
def m22(spark, sf_dir):
    return Q.scaled_budget(population(spark, sf_dir).withColumnRenamed("island", "plan"), "f2").select("id", "scaled")


@query("i7_round_robin", f"WITH {POP}, r AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY f2 DESC, id) AS turn FROM pop) SELECT id, island, turn FROM r ORDER BY turn, island LIMIT 30")
def i7(spark, sf_dir):
    return Q.round_robin(population(spark, sf_dir), "island", "f2", "id", 30).select("id", "island", "turn")


@query("i8_reserved_pool", f"WITH {POP}, r AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY f2 DESC, id) AS k FROM pop) SELECT id FROM r ORDER BY CASE WHEN k = 1 THEN 0 ELSE 1 END, f2 DESC, id LIMIT 40")
def i8(spark, sf_dir):
    w = Window.partitionBy("island").orderBy(F.desc("f2"), "id")
    return population(spark, sf_dir).withColumn("k", F.row_number().over(w)).orderBy((F.col("k") != 1).cast("int"), F.desc("f2"), "id").limit(40).select("id")


@query("i9_distinct_genotypes", "SELECT a, b, id FROM (SELECT p_size % 3 AS a, p_size % 5 AS b, p_partkey AS id, row_number() OVER (PARTITION BY p_size % 3, p_size % 5 ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn = 1")
def i9(spark, sf_dir):
    z = F.col("p_size")
    w = Window.partitionBy("a", "b").orderBy(F.desc("p_retailprice"), "id")
    return table(spark, sf_dir, "part").select((z % 3).alias("a"), (z % 5).alias("b"), F.col("p_partkey").alias("id"), "p_retailprice").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("a", "b", "id")


@query("m31_elite_niches", f"WITH {POP} SELECT island, id, f2 FROM (SELECT *, row_number() OVER (PARTITION BY island ORDER BY f2 DESC, id) AS k FROM pop) WHERE k <= 2")
def m31(spark, sf_dir):
    return P.niches(population(spark, sf_dir), {"niche": F.col("island")}, [F.desc("f2"), F.col("id")], 2).select("island", "id", "f2")


@query("m31_migrants", f"WITH {POP} SELECT id, island, (island + 1) % 25 AS target FROM (SELECT *, row_number() OVER (PARTITION BY island ORDER BY f2 DESC, id) AS k FROM pop) WHERE k <= 3")
def m31b(spark, sf_dir):
    return P.migrants(population(spark, sf_dir), "island", [F.desc("f2"), F.col("id")], 3, 25).select("id", "island", "target")


@query("m11_cache_round", "WITH c AS (SELECT DISTINCT p_size % 7 AS a, p_size % 5 AS b FROM part), k AS (SELECT n_nationkey % 7 AS a, n_nationkey % 5 AS b, max(n_nationkey) AS generation, CAST(max(n_nationkey) AS DOUBLE) AS figure FROM nation GROUP BY 1, 2), m AS (SELECT c.a, c.b, 100 AS generation, CAST(10 * c.a + c.b AS DOUBLE) AS figure FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.a = c.a AND k.b = c.b)), u AS (SELECT * FROM k UNION ALL SELECT * FROM m) SELECT a, b, generation, figure FROM u ORDER BY generation DESC, a, b LIMIT 30")
def m11b(spark, sf_dir):
    """A generation evaluates the genotypes that the cache lacks, and the bounded cache takes their figures."""
    z, n = F.col("p_size"), F.col("n_nationkey")
    candidates = table(spark, sf_dir, "part").select((z % 7).cast("int").alias("a"), (z % 5).cast("int").alias("b"))
    cache = table(spark, sf_dir, "nation").groupBy((n % 7).cast("int").alias("a"), (n % 5).cast("int").alias("b")).agg(F.max(n).cast("int").alias("generation"), F.max(n).cast("double").alias("figure"))
    new = P.misses(candidates, cache, ["a", "b"]).select("a", "b", F.lit(100).alias("generation"), (10 * F.col("a") + F.col("b")).cast("double").alias("figure"))
    return P.remember(cache, new, ["a", "b"], "generation", 30).select("a", "b", "generation", "figure")


@query("m32_rank_diversity", f"WITH {GENOTYPES} SELECT count(*) AS n, round(count(DISTINCT g) / count(*), 6) AS unique_ratio, round(avg(CAST(front = 1 AS DOUBLE)), 6) AS rank0_fraction, round(avg(CAST(front = 2 AS DOUBLE)), 6) AS rank1_fraction, max(front) - 1 AS max_rank, round(median(score), 6) AS median_score FROM ge")
def m32b(spark, sf_dir):
    """The ranks of a population; the sampled difference of pairs, of which tests know the value, is left out."""
    d = P.diagnostics(genotypes(spark, sf_dir), "score")
    one = spark.createDataFrame([(d["n"], d["unique_ratio"], d["rank0_fraction"], d["rank1_fraction"], d["max_rank"], d["median_score"])], "n long, unique_ratio double, rank0_fraction double, rank1_fraction double, max_rank long, median_score double")
    return one.select("n", *(r6(c, c) for c in ("unique_ratio", "rank0_fraction", "rank1_fraction")), "max_rank", r6("median_score", "median_score"))


@query("m32_population_diagnostics", "SELECT count(DISTINCT (p_size % 3, p_size % 5)) / count(*)::DOUBLE AS unique_ratio, count(*) AS n, median(p_retailprice) AS median_score FROM part")
def m32(spark, sf_dir):
    z = F.col("p_size")
    return table(spark, sf_dir, "part").agg((F.countDistinct(z % 3, z % 5) / F.count("*")).alias("unique_ratio"), F.count("*").alias("n"), F.median("p_retailprice").alias("median_score"))


@query("m36_pool_compatibility", "SELECT p_partkey AS id FROM part WHERE list_has_all(['a', 'b', 'c'], [chr(97 + p_size % 4), chr(97 + p_size % 5)])")
def m36(spark, sf_dir):
    z = F.col("p_size")
    used = F.array(F.chr((97 + z % 4).cast("long")), F.chr((97 + z % 5).cast("long")))
    selected = spark.createDataFrame([("a",), ("b",), ("c",)], "feature string")
    return P.compatible(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), used.alias("used")), "used", selected).select("id")


@query("m39_symbol_scope", "SELECT s_nationkey AS rule, array_to_string(list_sort(list(DISTINCT CAST(s_suppkey % 4 AS VARCHAR))), ',') AS symbols, count(*) FILTER (s_acctbal > 0) AS traded FROM supplier GROUP BY 1")
def m39(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("rule"), (F.col("s_suppkey") % 4).alias("symbol"), "s_acctbal")
    return P.symbol_scope(rows, "rule", "symbol", F.col("s_acctbal") > 0).select("rule", F.array_join("symbols", ",").alias("symbols"), "traded")
