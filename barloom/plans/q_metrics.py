"""Queries of metrics, splits and folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import labels as L  # noqa: N812
from barloom.operators import metrics as M  # noqa: N812
from barloom.operators import splits as S  # noqa: N812
from barloom.operators.chunks import numbered
from barloom.sources.tape import event_bars, table

from .q_tape import BARS, H, barrier_sql
from .registry import query, r6

TRADES = f"{BARS}, {barrier_sql([(10.0, 8.0)], ('long',))}, trades AS (SELECT symbol, bar, return_pct, exit_offset, bar % 4 AS rule, CASE WHEN bar < 100 THEN 'train' ELSE 'val' END AS split FROM touch WHERE exit_offset > 0)"


def trades(spark, sf_dir):
    t = L.barrier(event_bars(spark, sf_dir), H, [(10.0, 8.0)], ("long",), "bar").where("exit_offset > 0")
    return t.select("symbol", "bar", "return_pct", "exit_offset", (F.col("bar") % 4).alias("rule"), F.when(F.col("bar") < 100, "train").otherwise("val").alias("split"))


PF = "CASE WHEN sum(CASE WHEN return_pct < 0 THEN -return_pct ELSE 0 END) > 0 THEN sum(CASE WHEN return_pct > 0 THEN return_pct ELSE 0 END) / sum(CASE WHEN return_pct < 0 THEN -return_pct ELSE 0 END) WHEN sum(CASE WHEN return_pct > 0 THEN return_pct ELSE 0 END) > 0 THEN 99 ELSE 0 END"
DOWN = "sqrt(avg(pow(least(return_pct, 0), 2)))"
SORT = f"CASE WHEN {DOWN} > 0 THEN least(avg(return_pct) / {DOWN}, 20) WHEN avg(return_pct) > 0 THEN 20 ELSE 0 END"


@query("g1_g7_trade_metrics", f"WITH {TRADES} SELECT symbol, count(*) AS trade_count, round(100 * avg(CAST(return_pct > 0 AS DOUBLE)), 6) AS win_rate_pct, round(sum(return_pct), 6) AS net_pnl, round({PF}, 6) AS profit_factor, round(avg(return_pct) - 1.645 * coalesce(stddev_samp(return_pct), 0) / sqrt(count(*)), 6) AS lower_bound, round({SORT}, 6) AS sortino, round(tanh(({SORT}) / 10) * 20, 6) AS saturating, round(avg(return_pct) / stddev_samp(return_pct), 6) AS sharpe FROM trades GROUP BY 1")
def g1(spark, sf_dir):
    r = F.col("return_pct")
    return trades(spark, sf_dir).groupBy("symbol").agg(
        F.count("*").alias("trade_count"), r6(100 * F.avg((r > 0).cast("double")), "win_rate_pct"), r6(F.sum(r), "net_pnl"), r6(M.profit_factor(r), "profit_factor"), r6(M.lower_bound(r), "lower_bound"),
        r6(M.sortino(r), "sortino"), r6(M.saturating(M.sortino(r)), "saturating"), r6(M.sharpe(r), "sharpe"))


@query("g4_expected_shortfall", f"WITH {TRADES}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY return_pct, bar) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM trades) SELECT symbol, round(avg(return_pct), 6) AS shortfall FROM r WHERE rn <= greatest(ceil(n * 0.1), 1) GROUP BY 1")
def g4(spark, sf_dir):
    return M.expected_shortfall(trades(spark, sf_dir), ["symbol"]).select("symbol", r6("shortfall", "shortfall"))


@query("g11_concentration", f"WITH {TRADES}, p AS (SELECT rule AS plan, symbol, sum(return_pct) AS pnl FROM trades GROUP BY 1, 2), s AS (SELECT *, abs(pnl) / sum(abs(pnl)) OVER (PARTITION BY plan) AS share FROM p) SELECT plan, round(sum(share * share), 6) AS hhi, round(max(share), 6) AS top_share, first(symbol ORDER BY round(share, 9) DESC, symbol DESC) AS top_symbol FROM s GROUP BY 1")
def g11(spark, sf_dir):
    p = trades(spark, sf_dir).groupBy(F.col("rule").alias("plan"), "symbol").agg(F.sum("return_pct").alias("pnl"))
    return M.concentration(p, "pnl").select("plan", r6("hhi", "hhi"), r6("top_share", "top_share"), "top_symbol")


@query("g12_bucket_concentration", f"WITH {TRADES}, b AS (SELECT symbol, CAST(floor(return_pct / 5) AS BIGINT) AS bucket, count(*) AS n FROM trades GROUP BY 1, 2) SELECT symbol, first(bucket ORDER BY n DESC, bucket) AS top_bucket, round(max(n) / sum(n), 6) AS top_share, count(*) AS buckets FROM b GROUP BY 1")
def g12(spark, sf_dir):
    b = trades(spark, sf_dir).groupBy("symbol", F.floor(F.col("return_pct") / 5).alias("bucket")).agg(F.count("*").alias("n"))
    return b.groupBy("symbol").agg(F.max_by("bucket", F.struct(F.col("n"), -F.col("bucket"))).alias("top_bucket"), r6(F.max("n") / F.sum("n"), "top_share"), F.count("*").alias("buckets"))


@query("g13_generalization_shift", f"WITH {TRADES}, m AS (SELECT symbol, avg(return_pct) FILTER (split = 'train') AS a, avg(return_pct) FILTER (split = 'val') AS b FROM trades GROUP BY 1) SELECT symbol, round(a, 6) AS train, round(b, 6) AS val, round(b - a, 6) AS delta, sign(a) * sign(b) < 0 AS flipped FROM m")
def g13(spark, sf_dir):
    m = trades(spark, sf_dir).groupBy("symbol").pivot("split", ["train", "val"]).agg(F.avg("return_pct"))
    return m.select("symbol", r6("train", "train"), r6("val", "val"), r6(F.col("val") - F.col("train"), "delta"), (F.signum("train") * F.signum("val") < 0).alias("flipped"))


@query("e11_drawdown", f"WITH {TRADES}, e AS (SELECT symbol, bar, 1000 + sum(return_pct) OVER (PARTITION BY symbol ORDER BY bar) AS eq FROM trades), p AS (SELECT *, greatest(max(eq) OVER (PARTITION BY symbol ORDER BY bar), 1000) AS peak FROM e) SELECT symbol, round(max(CASE WHEN peak > 0 THEN (peak - eq) / peak * 100 ELSE 100 END), 6) AS max_drawdown_pct FROM p GROUP BY 1")
def e11(spark, sf_dir):
    return M.drawdown(trades(spark, sf_dir), ["symbol"]).select("symbol", r6("max_drawdown_pct", "max_drawdown_pct"))


@query("e12_compounded", f"WITH RECURSIVE {TRADES}, o AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY bar) AS k, CASE WHEN bar % 97 = 50 THEN -100 ELSE return_pct END AS r FROM trades), c AS (SELECT symbol, k, 1 + r / 100 AS eq FROM o WHERE k = 1 UNION ALL SELECT o.symbol, o.k, c.eq * (1 + o.r / 100) FROM c JOIN o ON o.symbol = c.symbol AND o.k = c.k + 1), p AS (SELECT *, max(eq) OVER (PARTITION BY symbol ORDER BY k) AS top FROM c) SELECT symbol, round(arg_max(eq, k), 6) AS equity, round(max((top - eq) / greatest(top, 1e-12) * 100), 6) AS dip_pct FROM p GROUP BY 1")
def e12(spark, sf_dir):
    """Some trades lose all: the product goes to zero and stays."""
    t = trades(spark, sf_dir).withColumn("return_pct", F.when(F.col("bar") % 97 == 50, -100.0).otherwise(F.col("return_pct")))
    return M.compounded(t, ["symbol"]).select("symbol", r6("equity", "equity"), r6("dip_pct", "dip_pct"))


@query("e14_trade_gap", f"WITH {TRADES} SELECT symbol, max(g) AS max_gap, round(avg(g), 6) AS mean_gap FROM (SELECT symbol, bar - lag(bar) OVER (PARTITION BY symbol, rule ORDER BY bar) AS g FROM trades) GROUP BY 1")
def e14(spark, sf_dir):
    g = F.col("bar") - F.lag("bar").over(Window.partitionBy("symbol", "rule").orderBy("bar"))
    return trades(spark, sf_dir).withColumn("g", g).groupBy("symbol").agg(F.max("g").alias("max_gap"), r6(F.avg("g"), "mean_gap"))


@query("e15_concurrency", f"WITH {TRADES}, e AS (SELECT symbol, bar AS at_bar, 1 AS d FROM trades UNION ALL SELECT symbol, bar + exit_offset, -1 FROM trades), n AS (SELECT symbol, at_bar, sum(d) AS d FROM e GROUP BY 1, 2) SELECT symbol, at_bar, CAST(sum(d) OVER (PARTITION BY symbol ORDER BY at_bar) AS BIGINT) AS n_open FROM n")
def e15(spark, sf_dir):
    return M.concurrency(trades(spark, sf_dir).withColumn("end", F.col("bar") + F.col("exit_offset")), "bar", "end")


@query("e18_e19_recency_slope", f"WITH {TRADES}, w AS (SELECT *, 1 + 1.2 * (row_number() OVER (PARTITION BY symbol ORDER BY bar) - 1) / greatest(count(*) OVER (PARTITION BY symbol) - 1, 1) AS wt FROM trades) SELECT symbol, round(sum(wt * return_pct) / sum(wt), 6) AS weighted_mean, round(regr_slope(return_pct, bar) * 100, 6) AS slope FROM w GROUP BY 1")
def e18(spark, sf_dir):
    df = S.numbered(trades(spark, sf_dir), order=["bar"]).withColumn("wt", 1 + 1.2 * (F.col("rn") - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    return df.groupBy("symbol").agg(r6(F.sum(F.col("wt") * F.col("return_pct")) / F.sum("wt"), "weighted_mean"), r6(F.regr_slope("return_pct", F.col("bar").cast("double")) * 100, "slope"))


@query("g27_fold_summary", f"WITH {TRADES}, f AS (SELECT symbol, CAST(floor(bar / 60) AS BIGINT) AS fold, sum(return_pct) AS ret, avg(CAST(return_pct > 0 AS DOUBLE)) AS win, count(*) AS n, {PF} AS pf FROM trades GROUP BY 1, 2) SELECT symbol, count(*) AS folds, round(min(ret), 6) AS worst, round(avg(ret), 6) AS mean, round(median(ret), 6) AS median_ret, round(median(pf), 6) AS median_pf, min(n) AS min_trades, round(arg_min(win, ret), 6) AS worst_win FROM f GROUP BY 1")
def g27(spark, sf_dir):
    r = F.col("return_pct")
    f = trades(spark, sf_dir).groupBy("symbol", F.floor(F.col("bar") / 60).alias("fold")).agg(F.sum(r).alias("ret"), F.avg((r > 0).cast("double")).alias("win"), F.count("*").alias("n"), M.profit_factor(r).alias("pf"))
    return f.groupBy("symbol").agg(F.count("*").alias("folds"), r6(F.min("ret"), "worst"), r6(F.avg("ret"), "mean"), r6(F.median("ret"), "median_ret"), r6(F.median("pf"), "median_pf"), F.min("n").alias("min_trades"), r6(F.min_by("win", "ret"), "worst_win"))


@query("g31_pbo", f"WITH {TRADES}, g AS (SELECT CAST(floor(bar / 30) AS BIGINT) AS fold, symbol, sum(CASE WHEN bar % 2 = 0 THEN return_pct ELSE 0 END) AS ins, sum(CASE WHEN bar % 2 = 1 THEN return_pct ELSE 0 END) AS oos FROM trades GROUP BY 1, 2), w AS (SELECT fold, arg_max(oos, ins) AS winner, median(oos) AS mid FROM g GROUP BY 1) SELECT round(avg(CAST(winner < mid AS DOUBLE)), 6) AS pbo FROM w")
def g31(spark, sf_dir):
    odd = F.col("bar") % 2 == 1
    g = trades(spark, sf_dir).groupBy(F.floor(F.col("bar") / 30).alias("fold"), F.col("symbol").alias("candidate")).agg(F.sum(F.when(~odd, F.col("return_pct")).otherwise(0.0)).alias("inside"), F.sum(F.when(odd, F.col("return_pct")).otherwise(0.0)).alias("outside"))
    return M.overfit_probability(g).select(r6("pbo", "pbo"))


def _cdf_sql(x: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({x})))"
    up = f"exp(-abs({x}) * abs({x}) / 2) / 2.5066282746310002 * ({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"CASE WHEN {x} >= 0 THEN 1 - {up} ELSE {up} END"


@query("g32_deflated_sharpe", f"WITH {TRADES}, s AS (SELECT symbol, avg(return_pct) / stddev_samp(return_pct) AS sr, CAST(count(*) AS DOUBLE) AS n FROM trades GROUP BY 1), z AS (SELECT symbol, (sr - sqrt(2 * ln(50.0)) / sqrt(n)) / sqrt(greatest((1 - 0.3 * sr + (1.2 - 1) / 4 * sr * sr) / n, 1e-12)) AS z, (sr - sqrt(2 * ln(50.0)) / sqrt(n)) / sqrt(greatest((1 - sr * sr / 4) / n, 1e-12)) AS z0 FROM s) SELECT symbol, round({_cdf_sql('z')}, 6) AS dsr_shaped, round({_cdf_sql('z0')}, 6) AS dsr FROM z")
def g32(spark, sf_dir):
    s = trades(spark, sf_dir).groupBy("symbol").agg(M.sharpe(F.col("return_pct")).alias("sr"), F.count("*").cast("double").alias("n"))
    return s.select("symbol", r6(M.deflated_sharpe(F.col("sr"), F.col("n"), 50, 0.3, 1.2), "dsr_shaped"), r6(M.deflated_sharpe(F.col("sr"), F.col("n"), 50), "dsr"))


ORD = "ord AS (SELECT o_orderstatus AS symbol, o_orderdate AS datetime, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)"


def ordered(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("symbol"), F.struct("o_orderdate", "o_orderkey").alias("datetime"), "o_orderkey", "o_totalprice")
    return numbered(o, "bar", span=86400)  # orders have a date, so a slot is a day


@query("h1_holdout", f"WITH {ORD}, s AS (SELECT *, CASE WHEN rn <= floor(n * 0.65) THEN 'train' WHEN rn > floor(n * 0.65) + 96 THEN 'val' END AS split FROM ord) SELECT symbol, split, count(*) AS n, min(rn) - 1 AS first_bar, round(sum(o_totalprice), 2) AS total FROM s WHERE split IS NOT NULL GROUP BY 1, 2")
def h1(spark, sf_dir):
    return S.holdout(ordered(spark, sf_dir)).groupBy("symbol", "split").agg(F.count("*").alias("n"), F.min("bar").alias("first_bar"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("h2_purged_halves", f"WITH {ORD}, s AS (SELECT *, CASE WHEN n <= 1 OR rn <= floor(n / 2) - 50 THEN 'fitness' WHEN rn > floor(n / 2) + 50 THEN 'selection' END AS half FROM ord) SELECT symbol, half, count(*) AS n, min(rn) - 1 AS first_bar FROM s WHERE half IS NOT NULL GROUP BY 1, 2")
def h2(spark, sf_dir):
    return S.purged_halves(ordered(spark, sf_dir), 50).groupBy("symbol", "half").agg(F.count("*").alias("n"), F.min("bar").alias("first_bar"))


FOLDS = f"{ORD}, nn AS (SELECT symbol, count(*) AS n, floor(count(*) * 0.7) AS usable FROM ord GROUP BY 1), b0 AS (SELECT *, floor(usable * 0.4) AS first, floor((usable - floor(usable * 0.4)) / 2) AS size FROM nn), b AS (SELECT symbol, k AS fold, CAST(CASE WHEN k = 2 THEN usable ELSE first + k * size END AS BIGINT) AS v_start, CAST(CASE WHEN k = 2 THEN n ELSE first + (k + 1) * size END AS BIGINT) AS v_end FROM b0, range(0, 3) r(k)), bounds AS (SELECT *, greatest(v_start - 96, 0) AS train_end FROM b)"


@query("h4_walk_forward", f"WITH {FOLDS}, r AS (SELECT o.symbol, fold, CASE WHEN rn - 1 < train_end THEN 'train' WHEN rn - 1 >= v_start AND rn - 1 < v_end THEN 'valid' END AS role, rn - 1 AS bar FROM ord o JOIN bounds USING (symbol)) SELECT symbol, fold, role, count(*) AS n, min(bar) AS first_bar, max(bar) AS last_bar FROM r WHERE role IS NOT NULL GROUP BY 1, 2, 3")
def h4(spark, sf_dir):
    df = ordered(spark, sf_dir)
    return S.fold_rows(df, S.fold_bounds(df, 2, 0.3, 0.4, 96)).groupBy("symbol", "fold", "role").agg(F.count("*").alias("n"), F.min("bar").alias("first_bar"), F.max("bar").alias("last_bar"))


@query("h6_forbidden_ranges", f"WITH {FOLDS} SELECT symbol, fold, greatest(0, v_start - 96) AS start, v_end AS stop FROM bounds WHERE fold < 2")
def h6(spark, sf_dir):
    return S.fold_bounds(ordered(spark, sf_dir), 2, 0.3, 0.4, 96).where("fold < 2").select("symbol", "fold", F.greatest(F.lit(0), F.col("v_start") - 96).alias("start"), F.col("v_end").alias("stop"))


@query("h9_linspace_folds", f"WITH {ORD}, f AS (SELECT *, CASE WHEN rn - 1 >= floor(n * 3 / 4) THEN 3 WHEN rn - 1 >= floor(n * 2 / 4) THEN 2 WHEN rn - 1 >= floor(n / 4) THEN 1 ELSE 0 END AS fold FROM ord) SELECT symbol, fold, count(*) AS n FROM f GROUP BY 1, 2")
def h9(spark, sf_dir):
    return S.linspace_folds(ordered(spark, sf_dir), 4).groupBy("symbol", "fold").agg(F.count("*").alias("n"))


@query("h11_largest_safe_range", "WITH r AS (SELECT CAST(l_returnflag AS VARCHAR) AS symbol, CAST(l_orderkey * 60 AS BIGINT) AS s, CAST(l_orderkey * 60 + l_quantity AS BIGINT) AS e FROM lineitem), x AS (SELECT * FROM r UNION ALL SELECT DISTINCT symbol, 1000000, 1000000 FROM r), g AS (SELECT symbol, s, coalesce(max(e) OVER (PARTITION BY symbol ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 0) AS start FROM x), z AS (SELECT symbol, start, greatest(s - start, 0) AS size FROM g) SELECT symbol, start, size FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY size DESC, start) AS k FROM z) WHERE k = 1")
def h11(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("symbol"), (F.col("l_orderkey") * 60).alias("s"), (F.col("l_orderkey") * 60 + F.col("l_quantity")).cast("long").alias("e"))
    return S.largest_gap(r, 0, 1_000_000)


@query("h12_aligned_sample", f"WITH {BARS}, t AS (SELECT min(m) AS m FROM (SELECT max(bar) AS m FROM bars GROUP BY symbol)), a AS (SELECT CAST('0x' || substr(sha256('7|2|'), 1, 12) AS BIGINT) % (greatest(0, m + 1 - 48) + 1) AS start FROM t) SELECT symbol, count(*) AS n, min(bar) AS first_bar FROM bars, a WHERE bar BETWEEN start AND start + 47 GROUP BY 1")
def h12(spark, sf_dir):
    """The window of the second epoch (h14): another epoch, another start."""
    return S.aligned_sample(event_bars(spark, sf_dir), 48, S.epoch_seed(7, 2)).groupBy("symbol").agg(F.count("*").alias("n"), F.min("bar").alias("first_bar"))


@query("j_set_operations", "SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 9) UNION ALL SELECT 'equal', CAST((SELECT count(*) FROM (SELECT DISTINCT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation)) = 0 AS BIGINT)")
def j(spark, sf_dir):
    c, s, n = (table(spark, sf_dir, t).select(F.col(k).alias("k")) for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey")))
    one = lambda op, df: df.agg(F.lit(op).alias("op"), F.count("*").alias("n"))
    equal = c.distinct().subtract(n).agg(F.lit("equal").alias("op"), (F.count("*") == 0).cast("long").alias("n"))
    return one("union", c.unionByName(s)).union(one("intersect", c.intersect(s))).union(one("except", n.subtract(s.where("k < 9")))).union(equal)
