"""Queries of feature scoring and selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import features as X  # noqa: N812
from barloom.operators import metrics as M  # noqa: N812
from barloom.operators import rules as R  # noqa: N812
from barloom.operators.gram import correlations, item_correlations
from barloom.sources.store import settled
from barloom.sources.tape import event_bars, table

from .q_tape import BARS, FEATURES, _case, features
from .registry import query, r6

COLS = ["f_pos", "f_signed", "f_sparse", "f_bin"]
LONG = f"{FEATURES}, lf AS ({' UNION ALL '.join(f'SELECT {chr(39)}{c}{chr(39)} AS feature, event_id, symbol, value, CAST({c} AS DOUBLE) AS x FROM feat' for c in COLS)})"


def long(spark, sf_dir):
    return X.long_form(features(spark, sf_dir), COLS, ["event_id", "symbol", "value"])


@query("g15_feature_modes", f"WITH {LONG}, a AS (SELECT feature, bool_and(coalesce(x, 0) IN (0, 1)) AS two, bool_and(coalesce(x, 0) IN (-1, 0, 1)) AS three, min(x) AS low, avg(CAST(coalesce(x, 0) = 0 AS DOUBLE)) AS zeros FROM lf GROUP BY 1) SELECT feature, CASE WHEN two THEN 'binary' WHEN three THEN 'ternary' WHEN low < 0 AND zeros > 0.3 THEN 'sparse_signed' WHEN low < 0 THEN 'signed' WHEN zeros > 0.3 THEN 'sparse_positive' ELSE 'positive' END AS mode, round(zeros, 6) AS zero_ratio FROM a")
def g15(spark, sf_dir):
    return X.modes(features(spark, sf_dir), COLS).select("feature", "mode", r6("zero_ratio", "zero_ratio"))


@query("g14_dispersion_filter", f"WITH {LONG}, c AS (SELECT feature, x, count(*) AS n FROM lf GROUP BY 1, 2) SELECT feature, round(max(n) / sum(n), 6) AS modal_share FROM c GROUP BY 1 HAVING max(n) / sum(n) <= 0.95")
def g14(spark, sf_dir):
    return X.dispersion(features(spark, sf_dir), COLS).where("modal_share <= 0.95").select("feature", r6("modal_share", "modal_share"))


@query("g16_ordinal_scales", "WITH a AS (SELECT 'linenumber' AS feature, min(l_linenumber) AS a, max(l_linenumber) AS b FROM lineitem UNION ALL SELECT 'centred', min(l_linenumber - 4), max(l_linenumber - 4) FROM lineitem) SELECT feature, CASE WHEN (b > 1 OR a < -1) AND a >= 0 AND b <= 4 THEN 4.0 WHEN (b > 1 OR a < -1) AND a >= -2 AND b <= 2 THEN 2.0 WHEN (b > 1 OR a < -1) AND a >= -5 AND b <= 5 THEN 5.0 END::DOUBLE AS scale FROM a")
def g16(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("linenumber"), (F.col("l_linenumber") - 4).alias("centred"))
    return X.ordinal_scales(df, ["linenumber", "centred"])


@query("g17_discretise", f"WITH {FEATURES} SELECT CASE WHEN f_pos < 0.2 THEN 0 WHEN f_pos < 0.4 THEN 1 WHEN f_pos < 0.6 THEN 2 WHEN f_pos < 0.8 THEN 3 ELSE 4 END AS left_closed, CASE WHEN f_pos <= 0.2 THEN 0 WHEN f_pos <= 0.4 THEN 1 WHEN f_pos <= 0.6 THEN 2 WHEN f_pos <= 0.8 THEN 3 ELSE 4 END AS right_closed, count(*) AS n FROM feat GROUP BY 1, 2")
def g17(spark, sf_dir):
    x = F.col("f_pos")
    return features(spark, sf_dir).groupBy(R.bucket(x, "positive", False).alias("left_closed"), R.bucket(x, "positive").alias("right_closed")).agg(F.count("*").alias("n"))


@query("g19_pearson_matrix", f"WITH {FEATURES} SELECT 'f_pos' AS a, 'f_signed' AS b, round(abs(corr(f_pos, f_signed)), 6) AS r FROM feat UNION ALL SELECT 'f_pos', 'f_sparse', round(abs(corr(f_pos, f_sparse)), 6) FROM feat UNION ALL SELECT 'f_signed', 'f_sparse', round(abs(corr(f_signed, f_sparse)), 6) FROM feat")
def g19(spark, sf_dir):
    out = correlations(features(spark, sf_dir), ["f_pos", "f_signed", "f_sparse"])
    return out.select("a", "b", r6(F.abs("r"), "r"))


#: Features of lineitem: those of one mode are correlated, some with missing values.
WIDE = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "CASE WHEN l_linenumber < 6 THEN l_discount END", "tax": "l_tax", "line": "l_linenumber", "centred": "l_discount - 0.05", "even": "CAST(l_linenumber % 2 = 0 AS INTEGER)"}
WIDE_SQL = "w AS (SELECT l_orderkey, l_linenumber, l_returnflag AS symbol, " + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in WIDE.items()) + " FROM lineitem)"


def wide(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("symbol"), *(F.expr(e).cast("double").alias(c) for c, e in WIDE.items()))


def _mode_group_sql() -> str:
    names = list(WIDE)
    modes = " UNION ALL ".join(f"SELECT '{c}' AS f, CASE WHEN bool_and(coalesce({c}, 0) IN (0, 1)) THEN 'binary' WHEN bool_and(coalesce({c}, 0) IN (-1, 0, 1)) THEN 'ternary' WHEN min({c}) < 0 AND avg(CAST(coalesce({c}, 0) = 0 AS DOUBLE)) > 0.3 THEN 'sparse_signed' WHEN min({c}) < 0 THEN 'signed' WHEN avg(CAST(coalesce({c}, 0) = 0 AS DOUBLE)) > 0.3 THEN 'sparse_positive' ELSE 'positive' END AS mode FROM w" for c in names)
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, corr({a}, {b}) AS r FROM w" for i, a in enumerate(names) for b in names[i + 1 :])
    return f"WITH {WIDE_SQL}, m AS ({modes}), p AS ({pairs}) SELECT x.mode, a, b, n, round(r, 6) AS r FROM p JOIN m x ON x.f = a JOIN m y ON y.f = b AND y.mode = x.mode"


@query("g19_mode_groups", _mode_group_sql())
def g19b(spark, sf_dir):
    """All pairs within each mode's group of features, from one Gram matrix a group."""
    df = wide(spark, sf_dir)
    groups: dict[str, list[str]] = {}
    found = {r["feature"]: r["mode"] for r in X.modes(df, list(WIDE)).collect()}  # a row a feature
    for c in WIDE:
        groups.setdefault(found[c], []).append(c)
    parts = [correlations(df, cols).select(F.lit(mode).alias("mode"), "a", "b", "n", r6("r", "r")) for mode, cols in groups.items() if len(cols) > 1]
    return reduce(lambda a, b: a.union(b), parts)


RANKS = "rk AS (SELECT feature, symbol, event_id, rank() OVER (PARTITION BY feature, symbol ORDER BY x) + (count(*) OVER (PARTITION BY feature, symbol, x) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY feature, symbol ORDER BY value) + (count(*) OVER (PARTITION BY feature, symbol, value) - 1) / 2.0 AS rb FROM lf)"
RHO = "rho AS (SELECT feature, symbol, count(*) AS n, CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) END AS rho FROM rk GROUP BY 1, 2)"


@query("g20_spearman", f"WITH {LONG}, {RANKS}, {RHO} SELECT feature, symbol, n, round(rho, 6) AS rho FROM rho")
def g20(spark, sf_dir):
    return M.spearman(long(spark, sf_dir), "x", "value", ["feature", "symbol"]).select("feature", "symbol", "n", r6("rho", "rho"))


@query("g22_sign_consistency", f"WITH {LONG}, {RANKS}, {RHO}, f AS (SELECT feature, count(rho) AS n, count(*) FILTER (rho >= 0.01) AS up, count(*) FILTER (rho <= -0.01) AS down FROM rho WHERE symbol <> 'view' GROUP BY 1) SELECT f.feature, up, down FROM f LEFT JOIN (SELECT feature, rho FROM rho WHERE symbol = 'view') v USING (feature) WHERE n >= 1 AND (up = 0 OR down = 0) AND NOT coalesce((up > 0 AND v.rho < -0.01) OR (down > 0 AND v.rho > 0.01), false)")
def g22(spark, sf_dir):
    """Folds are the symbols but one, which serves as validation."""
    rho = M.spearman(long(spark, sf_dir), "x", "value", ["feature", "symbol"])
    return X.sign_consistent(rho.where("symbol <> 'view'"), 0.01, 1, rho.where("symbol = 'view'"))


_FOLDS = " UNION ALL ".join(f"SELECT '{c}' AS feature, symbol, {c} AS x, price AS y FROM w WHERE {c} IS NOT NULL" for c in WIDE if c != "price")


@query("g22_consistent_features", f"WITH {WIDE_SQL}, lf AS ({_FOLDS}), k AS (SELECT feature, symbol, rank() OVER (PARTITION BY feature, symbol ORDER BY x) + (count(*) OVER (PARTITION BY feature, symbol, x) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY feature, symbol ORDER BY y) + (count(*) OVER (PARTITION BY feature, symbol, y) - 1) / 2.0 AS rb FROM lf), r AS (SELECT feature, symbol, corr(ra, rb) AS rho FROM k GROUP BY 1, 2), f AS (SELECT feature, count(*) FILTER (rho >= 0.05) AS up, count(*) FILTER (rho <= -0.05) AS down FROM r WHERE symbol <> 'R' GROUP BY 1) SELECT feature, up, down FROM f LEFT JOIN (SELECT feature, rho FROM r WHERE symbol = 'R') v USING (feature) WHERE (up = 0 OR down = 0) AND NOT coalesce((up > 0 AND v.rho < -0.05) OR (down > 0 AND v.rho > 0.05), false)")
def g22b(spark, sf_dir):
    """Folds are the return flags but one, which serves as validation; the target is the price."""
    rho = settled(M.spearman_wide(wide(spark, sf_dir), [c for c in WIDE if c != "price"], "price", ["symbol"]))
    return X.sign_consistent(rho.where("symbol <> 'R'"), 0.05, 1, rho.where("symbol = 'R'"))


MI = f"{FEATURES}, d AS (SELECT symbol, {_case('f_pos', 'positive')} AS c, CAST(value > 50 AS INTEGER) AS y, 'f_pos' AS feature FROM feat UNION ALL SELECT symbol, {_case('f_sparse', 'sparse_signed')}, CAST(value > 50 AS INTEGER), 'f_sparse' FROM feat), jc AS (SELECT feature, symbol, c, y, CAST(count(*) AS DOUBLE) AS n FROM d GROUP BY ALL), jm AS (SELECT *, sum(n) OVER (PARTITION BY feature, symbol, c) AS na, sum(n) OVER (PARTITION BY feature, symbol, y) AS nb, sum(n) OVER (PARTITION BY feature, symbol) AS nn FROM jc), mi AS (SELECT feature, symbol, sum(n / nn * ln(n * nn / (na * nb))) AS mi FROM jm GROUP BY 1, 2)"


def relevance(spark, sf_dir):
    df = features(spark, sf_dir)
    y = (F.col("value") > 50).cast("int").alias("y")
    d = df.select("symbol", R.bucket(F.col("f_pos"), "positive").alias("c"), y, F.lit("f_pos").alias("feature")).union(df.select("symbol", R.bucket(F.col("f_sparse"), "sparse_signed"), y, F.lit("f_sparse")))
    return X.mutual_information(d, "c", "y", ["feature", "symbol"])


@query("g23_mutual_information", f"WITH {MI} SELECT feature, symbol, round(mi, 6) AS mi FROM mi")
def g23(spark, sf_dir):
    return relevance(spark, sf_dir).select("feature", "symbol", r6("mi", "mi"))


def _digamma_sql(x: str) -> str:
    """By recurrence to 6 and the asymptotic series."""
    z = f"({x} + greatest(0, ceil(6 - {x})))"
    low = f"coalesce(list_sum(list_transform(range(0, CAST(greatest(0, ceil(6 - {x})) AS BIGINT)), lambda i: 1.0 / ({x} + i))), 0)"
    return f"(ln({z}) - 1 / (2 * {z}) - 1 / (12 * {z} ** 2) + 1 / (120 * {z} ** 4) - 1 / (252 * {z} ** 6) + 1 / (240 * {z} ** 8) - {low})"


KNN = f"""WITH d AS (SELECT row_number() OVER () AS id, event_type AS symbol, CAST(round(value * 100) AS DOUBLE) AS x, CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) > 50 AS INTEGER) AS y FROM events),
c AS (SELECT *, CAST(count(*) OVER (PARTITION BY symbol, y) AS DOUBLE) AS ny FROM d), e AS (SELECT *, least(3.0, ny - 1) AS k FROM c WHERE ny > 1),
nn AS (SELECT a.id, a.symbol, a.x, a.k, a.ny, abs(a.x - b.x) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.x - b.x)) AS rn FROM e a JOIN e b ON a.symbol = b.symbol AND a.y = b.y AND a.id <> b.id),
r AS (SELECT id, symbol, x, k, ny, dist AS r FROM nn WHERE rn = k), m AS (SELECT r.id, r.symbol, r.k, r.ny, CAST(count(*) AS DOUBLE) AS m FROM r JOIN e b ON b.symbol = r.symbol AND (abs(b.x - r.x) < r.r OR b.x = r.x) GROUP BY ALL),
s AS (SELECT symbol, CAST(count(*) AS DOUBLE) AS n, avg({_digamma_sql('k')} - {_digamma_sql('ny')} - {_digamma_sql('m')}) AS mean FROM m GROUP BY 1)
SELECT symbol, round(greatest({_digamma_sql('n')} + mean, 0), 6) AS mi FROM s"""


@query("g23_neighbour_information", KNN)
def g23b(spark, sf_dir):
    """Relevance of a continuous value for a class. Whole numbers, so that distances are exact."""
    df = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.round(F.col("value") * 100).alias("x"), (F.get_json_object("props", "$.k").cast("int") > 50).cast("int").alias("y"))
    return X.neighbour_information(df, "x", "y", ["symbol"]).select("symbol", r6("mi", "mi"))


@query("g24_cross_symbol_stability", f"WITH {MI} SELECT feature, round(greatest(least(1 - stddev_pop(mi) / nullif(avg(mi), 0), 1), 0) * avg(mi), 6) AS score FROM mi GROUP BY 1")
def g24(spark, sf_dir):
    return X.stability(relevance(spark, sf_dir)).select("feature", r6("score", "score"))


@query("g25_stationarity", f"WITH {MI}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY mi DESC, feature) AS rk FROM mi) SELECT feature, round(stddev_pop(mi) / avg(mi), 6) AS cv, max(rk) - min(rk) AS drift FROM r GROUP BY 1 HAVING stddev_pop(mi) / avg(mi) <= 2.0 AND max(rk) - min(rk) <= 8")
def g25(spark, sf_dir):
    return X.stationary(relevance(spark, sf_dir).withColumnRenamed("symbol", "fold"), 2.0, 8).select("feature", r6("cv", "cv"), "drift")


@query("g26_return_correlation", f"WITH {BARS}, r AS (SELECT symbol, bar, coalesce(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY datetime), 0) - 1, 0) AS r FROM bars) SELECT a.symbol AS a, b.symbol AS b, round(corr(a.r, b.r), 6) AS rho FROM r a JOIN r b ON a.bar = b.bar AND a.symbol < b.symbol GROUP BY 1, 2")
def g26(spark, sf_dir):
    from barloom.operators.chunks import shifted

    b = shifted(event_bars(spark, sf_dir), "before", "close", -1, "bar")
    r = b.select("symbol", "bar", F.coalesce(F.try_divide("close", F.nullif(F.col("before"), F.lit(0.0))) - 1, F.lit(0.0)).alias("r"))
    return item_correlations(r, ["bar"], "symbol", "r").select("a", "b", r6("r", "rho"))


@query("g26_symbol_profile", f"WITH {FEATURES} SELECT symbol, round(avg(f_pos), 6) AS f_pos, round(avg(f_signed), 6) AS f_signed, round(avg(f_bin), 6) AS f_bin FROM feat GROUP BY 1")
def g26b(spark, sf_dir):
    return features(spark, sf_dir).groupBy("symbol").agg(*(r6(F.avg(c), c) for c in ("f_pos", "f_signed", "f_bin")))


@query("g40_parameter_correlation", "WITH t AS (SELECT o_orderkey, o_custkey AS param, o_totalprice AS score FROM orders), r AS (SELECT row_number() OVER (ORDER BY param, o_orderkey) AS a, row_number() OVER (ORDER BY score, o_orderkey) AS b FROM t) SELECT round(corr(a, b), 6) AS rho FROM r")
def g40(spark, sf_dir):
    """Ranks without tie averaging over a table of trials, in strips."""
    from barloom.operators.splits import global_rank

    t = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderkey")
    r = global_rank(global_rank(t, ["o_custkey", "o_orderkey"], "a"), ["o_totalprice", "o_orderkey"], "b")
    return r.agg(r6(F.corr(F.col("a").cast("double"), F.col("b").cast("double")), "rho"))


@query("i3_top_features", f"WITH {MI} SELECT feature, symbol, round(mi, 6) AS mi FROM (SELECT * FROM mi ORDER BY mi DESC, feature, symbol LIMIT 4)")
def i3(spark, sf_dir):
    return relevance(spark, sf_dir).orderBy(F.desc("mi"), "feature", "symbol").limit(4).select("feature", "symbol", r6("mi", "mi"))


@query("i5_specialist_union", f"WITH {MI}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY mi DESC, feature) AS rn FROM mi) SELECT feature, round(max(mi), 6) AS score, count(*) AS symbols FROM r WHERE rn <= 1 GROUP BY 1")
def i5(spark, sf_dir):
    r = relevance(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("mi"), "feature")))
    return r.where("rn <= 1").groupBy("feature").agg(r6(F.max("mi"), "score"), F.count("*").alias("symbols"))


@query("k_scalar_functions", "SELECT o_orderkey, round(tanh(o_totalprice / 1e6), 6) AS t, greatest(least(floor(o_totalprice / 1000), 100), 10) AS clipped, substr(sha256('{\"k\":' || o_orderkey || ',\"s\":\"' || o_orderstatus || '\"}'), 1, 16) AS identity, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso FROM orders")
def k(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")))
    return o.select("o_orderkey", r6(F.tanh(F.col("o_totalprice") / 1e6), "t"), F.greatest(F.least(F.floor(F.col("o_totalprice") / 1000), F.lit(100)), F.lit(10)).alias("clipped"), F.substring(F.sha2(key, 256), 1, 16).alias("identity"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


def _profile(spark, sf_dir):
    return event_bars(spark, sf_dir).groupBy("symbol").agg(F.avg("close").alias("c"), F.stddev_samp("close").alias("s"))


@query("i11_balanced_clusters")
def i11(spark, sf_dir):
    found = X.balanced_clusters(_profile(spark, sf_dir), ["c", "s"], 2)
    return spark.createDataFrame(sorted(found.items()), "symbol string, cluster int")
