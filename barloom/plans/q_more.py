"""Further queries: variable offsets, nested folds, reports, objectives, certificates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.operators import labels as L  # noqa: N812
from barloom.operators import metrics as M  # noqa: N812
from barloom.operators import pool as P  # noqa: N812
from barloom.operators import search as Q  # noqa: N812
from barloom.operators import splits as S  # noqa: N812
from barloom.functions.arrays import bincount, searchsorted, strip_zone
from barloom.sources.tape import event_bars, table

from .q_features import COLS, LONG, long
from .q_metrics import ORD, ordered
from .q_search import POP, population
from .q_tape import BARS, FEATURES, GAPPED, H, LABELS, _case, barrier_sql, features, gapped
from .registry import query, r6


@query("c4_variable_release", f"WITH {BARS}, {GAPPED}, {barrier_sql([(10.0, 8.0)], ('long',))}, t AS (SELECT g.symbol, g.bar, g.total, CASE WHEN t.exit_offset >= 0 THEN g.bar + t.exit_offset END AS target FROM gapped g JOIN touch t ON t.symbol = g.symbol AND t.bar = g.bar) SELECT t.symbol, t.bar, coalesce(b.row_id, t.total) AS release_row FROM t ASOF LEFT JOIN gapped b ON t.symbol = b.symbol AND t.target <= b.bar")
def c4(spark, sf_dir):
    tape = gapped(spark, sf_dir).select("symbol", "bar", "row_id")
    total = tape.agg(F.count("*").alias("total"))  # one row
    t = L.barrier(event_bars(spark, sf_dir), H, [(10.0, 8.0)], ("long",)).select("symbol", "bar", "exit_offset")
    out = S.release_rows(tape.join(t, ["symbol", "bar"]), F.col("exit_offset"))
    return out.crossJoin(F.broadcast(total)).select("symbol", "bar", F.coalesce("release_row", "total").alias("release_row"))


@query("b23_sparse_slots", "SELECT p_size % 3 AS a, p_size % 5 AS b, count(*) AS n FROM part WHERE p_size % 3 = 1 AND p_size % 5 = 2 GROUP BY 1, 2")
def b23(spark, sf_dir):
    z = F.col("p_size")
    slots = F.array(F.struct(F.lit(0).alias("feat"), F.lit(1).alias("cls")), F.struct(F.lit(1).alias("feat"), F.lit(2).alias("cls")))
    df = table(spark, sf_dir, "part").withColumn("classes", F.array(z % 3, z % 5)).where(Q.match_sparse(F.col("classes"), slots))
    return df.groupBy((z % 3).alias("a"), (z % 5).alias("b")).agg(F.count("*").alias("n"))


@query("h3_half_geometry", f"WITH {ORD}, e AS (SELECT symbol, floor(n / 2) - 50 AS f, n - floor(n / 2) - 50 AS s FROM ord GROUP BY ALL) SELECT symbol, CAST(greatest(f, 0) AS BIGINT) AS fitness, CAST(greatest(s, 0) AS BIGINT) AS selection FROM e")
def h3(spark, sf_dir):
    h = S.purged_halves(ordered(spark, sf_dir), 50)
    return h.groupBy("symbol").agg(F.count_if(F.col("half") == "fitness").alias("fitness"), F.count_if(F.col("half") == "selection").alias("selection"))


@query("h5_h7_nested_folds", f"WITH {ORD}, a AS (SELECT symbol, n, greatest(1, CAST(floor(n * 0.4) AS BIGINT)) AS first FROM ord GROUP BY ALL), b AS (SELECT *, (n - first) // 3 AS base, (n - first) % 3 AS rest FROM a), f AS (SELECT symbol, k AS fold, first + k * base + least(k, rest) AS v_start, first + (k + 1) * base + least(k + 1, rest) AS v_end FROM b, range(0, 3) r(k)) SELECT symbol, fold, greatest(v_start - 96, 0) AS train_end, v_start, v_end, fold = max(fold) OVER (PARTITION BY symbol) AS is_holdout FROM f WHERE v_end > v_start")
def h5(spark, sf_dir):
    b = S.nested_bounds(ordered(spark, sf_dir), 3, 0.4, 96)
    both = S.select_folds(b, "holdout").withColumn("is_holdout", F.lit(True)).union(S.select_folds(b, "cv").withColumn("is_holdout", F.lit(False)))
    return both.select("symbol", "fold", "train_end", "v_start", "v_end", "is_holdout")


@query("h10_tail_folds", f"WITH {ORD}, f AS (SELECT symbol, rn - 1 AS pos, n, n - greatest(1, CAST(round_even(n * 0.25, 0) AS BIGINT)) AS head FROM ord), g AS (SELECT *, CASE WHEN pos >= head THEN 3 ELSE least(pos // greatest(head // 3, 1), 2) END AS fold FROM f) SELECT symbol, CAST(fold AS BIGINT) AS fold, count(*) AS n FROM g GROUP BY 1, 2")
def h10(spark, sf_dir):
    return S.tail_folds(ordered(spark, sf_dir), 3, 0.25).groupBy("symbol", "fold").agg(F.count("*").alias("n"))


@query("h15_training_rows", f"WITH {ORD}, a AS (SELECT symbol, n, greatest(1, CAST(floor(n * 0.4) AS BIGINT)) AS first FROM ord GROUP BY ALL), b AS (SELECT *, (n - first) // 3 AS base, (n - first) % 3 AS rest FROM a), v AS (SELECT symbol, first + 2 * base + least(2, rest) AS s, first + 3 * base + least(3, rest) AS e FROM b) SELECT o.symbol, count(*) AS n, max(rn - 1) AS last_bar FROM ord o JOIN v USING (symbol) WHERE NOT (rn - 1 >= greatest(s - 96, 0) AND rn - 1 < e) GROUP BY 1")
def h15(spark, sf_dir):
    df = ordered(spark, sf_dir)
    out = S.training_rows(df, S.select_folds(S.nested_bounds(df, 3, 0.4, 96), "holdout"), 96)
    return out.groupBy("symbol").agg(F.count("*").alias("n"), F.max("bar").alias("last_bar"))


@query("h13_scaled_floors", "SELECT o_orderstatus AS symbol, greatest(1, CAST(round(300 * count(*) / (SELECT count(*) FROM orders)) AS BIGINT)) AS floor_rows FROM orders GROUP BY 1")
def h13(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    total = o.agg(F.count("*").alias("total"))  # one row
    n = o.groupBy(F.col("o_orderstatus").alias("symbol")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(total)).select("symbol", F.greatest(F.lit(1), F.round(300 * F.col("n") / F.col("total")).cast("long")).alias("floor_rows"))


@query("g21_spearman_report", f"WITH {LONG}, s AS (SELECT *, CASE WHEN datetime_day < 18 THEN 'train' ELSE 'val' END AS split FROM (SELECT lf.*, day(ts) AS datetime_day FROM lf JOIN events USING (event_id))), rk AS (SELECT feature, split, rank() OVER (PARTITION BY feature, split ORDER BY x) + (count(*) OVER (PARTITION BY feature, split, x) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY feature, split ORDER BY s.value) + (count(*) OVER (PARTITION BY feature, split, s.value) - 1) / 2.0 AS rb FROM s) SELECT feature, round(corr(ra, rb) FILTER (split = 'train'), 6) AS train, round(corr(ra, rb) FILTER (split = 'val'), 6) AS val FROM rk GROUP BY 1")
def g21(spark, sf_dir):
    day = table(spark, sf_dir, "events").select("event_id", F.when(F.dayofmonth("ts") < 18, "train").otherwise("val").alias("split"))
    rho = M.spearman(long(spark, sf_dir).join(day, "event_id"), "x", "value", ["feature", "split"])
    return rho.groupBy("feature").pivot("split", ["train", "val"]).agg(F.first("rho")).select("feature", r6("train", "train"), r6("val", "val"))


@query("m5_phenotype_buckets", f"WITH {POP} SELECT CAST(f1 / 1000 AS INTEGER) AS bucket, count(*) AS n, round(0.1 * (count(*) - 1), 6) AS penalty FROM (SELECT trunc(f1 / 1000) * 1000 AS f1 FROM pop) GROUP BY 1")
def m5(spark, sf_dir):
    found = P.crowded(population(spark, sf_dir), {"f1": 1000.0}, 0.1)
    return found.select(F.get("bucket", F.lit(0)).alias("bucket"), "n", r6("penalty", "penalty"))


@query("m6_sampling_weights", f"WITH {POP} SELECT id, round(0.9 * exp(f2 / 1000 - (SELECT max(f2 / 1000) FROM pop)) / (SELECT sum(exp(f2 / 1000 - (SELECT max(f2 / 1000) FROM pop))) FROM pop) + 0.1 / (SELECT count(*) FROM pop), 9) AS weight FROM pop")
def m6(spark, sf_dir):
    p = population(spark, sf_dir).withColumn("x", F.col("f2") / 1000)
    return P.sampling_weights(p, "x").select("id", F.round("weight", 9).alias("weight"))


@query("g39_front_statistics", f"WITH {POP}, a AS (SELECT * FROM pop p WHERE NOT EXISTS (SELECT 1 FROM pop q WHERE q.f1 <= p.f1 AND q.f2 <= p.f2 AND (q.f1 < p.f1 OR q.f2 < p.f2))) SELECT count(*) AS n, round(avg(f1), 6) AS mean_f1, round(min(f2), 6) AS best_f2 FROM a")
def g39(spark, sf_dir):
    return Q.fronts(population(spark, sf_dir), "id", ["f1", "f2"]).where("front = 1").agg(F.count("*").alias("n"), r6(F.avg("f1"), "mean_f1"), r6(F.min("f2"), "best_f2"))


@query("a1_load_csv", f"WITH {LABELS}, t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY datetime DESC) AS rn FROM lab) SELECT symbol, datetime, row_number() OVER (PARTITION BY symbol ORDER BY datetime) - 1 AS bar, round(label_max_h, 6) AS label_max_h, coalesce(CASE WHEN ticks > 2 THEN ticks END, 0)::DOUBLE AS ff_ticks FROM t WHERE rn > {H} AND label_open_next IS NOT NULL AND label_close_h IS NOT NULL AND label_min_h IS NOT NULL AND label_max_h IS NOT NULL")
def a1_csv(spark, sf_dir):
    """The preparation of a CSV tape, read with the schema that its header gives."""
    from barloom.sources.load import load
    from barloom.sources.store import shared_folder
    from barloom.sources.tape import write_csv

    raw = event_bars(spark, sf_dir).select("datetime", "symbol", "open", "high", "low", "close", "volume", F.when(F.col("ticks") > 2, F.col("ticks")).alias("ff_ticks"))
    path = f"{shared_folder(spark)}/tape-{uuid.uuid4().hex}.csv"
    write_csv(raw, path)
    return load(spark, path, H).select("symbol", "datetime", "bar", r6("label_max_h", "label_max_h"), "ff_ticks")


@query("e10_time_codes", "WITH t AS (SELECT o_orderkey AS row, CASE WHEN o_orderkey % 50 <> 1 THEN o_orderdate END AS d FROM orders), c AS (SELECT *, CASE WHEN d IS NOT NULL THEN dense_rank() OVER (ORDER BY d NULLS LAST) - 1 END AS k, CASE WHEN d IS NULL THEN row_number() OVER (PARTITION BY d IS NULL ORDER BY row) - 1 END AS l FROM t) SELECT row, coalesce(k, (SELECT count(DISTINCT d) FROM t) + l) AS code FROM c")
def e10(spark, sf_dir):
    """Dense codes of order dates, some of which are missing."""
    from barloom.operators.chunks import time_codes

    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), F.when(F.col("o_orderkey") % 50 != 1, F.col("o_orderdate")).alias("at"))
    return time_codes(df, "at", "code", "row").select("row", "code")


@query("k_array_date", "SELECT o_orderkey, len(list_filter([10000.0, 50000.0, 100000.0, 200000.0], lambda e: e < o_totalprice)) AS below, len(list_filter([1, 3, 3, 6], lambda e: e <= o_orderkey % 8)) AS upto, list_transform(range(0, 4), lambda k: len(list_filter([o_orderkey % 4, o_orderkey % 3, 1], lambda x: x = k))) AS counts, CAST(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS at FROM orders")
def k_array_date(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 2 == 0, "+02:00").otherwise("Z"))
    return o.select(
        "o_orderkey", searchsorted(F.array(*map(F.lit, [10000.0, 50000.0, 100000.0, 200000.0])), F.col("o_totalprice").cast("double")).cast("long").alias("below"), searchsorted(F.array(*map(F.lit, [1, 3, 3, 6])), (k % 8).cast("int"), right=True).cast("long").alias("upto"),
        bincount(F.array((k % 4).cast("int"), (k % 3).cast("int"), F.lit(1)), 4).cast("array<long>").alias("counts"), strip_zone(text).alias("at"))


_UNIVARIATE = " UNION ALL ".join(f"SELECT '{c}' AS feature, {_case(c, f)} AS label, symbol, value FROM feat" for c, f in (("f_pos", "positive"), ("f_signed", "signed"))) + " UNION ALL SELECT 'f_bin', CASE f_bin WHEN 0 THEN 'Inactive (0)' WHEN 1 THEN 'Active (1)' END, symbol, value FROM feat"


@query("m23_univariate_pool", f"WITH {FEATURES}, l AS ({_UNIVARIATE}), e AS (SELECT symbol, avg(value) AS m FROM feat GROUP BY 1), o AS (SELECT symbol, feature, label, count(*) AS n, avg(value) AS mean FROM l WHERE label IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 10) SELECT symbol, '[' || feature || '] IS ' || label AS condition, n, round(mean, 6) AS mean, round(mean - m, 6) AS lift FROM o JOIN e USING (symbol)")
def m23(spark, sf_dir):
    """Every rule of one condition, by symbol."""
    from barloom.operators.features import univariate_pool

    out = univariate_pool(features(spark, sf_dir), {"f_pos": "positive", "f_signed": "signed", "f_bin": "binary"}, "value", ["symbol"], 10)
    return out.select("symbol", "condition", "n", r6("mean", "mean"), r6("lift", "lift"))


@query("g42_feature_masks", f"WITH {LONG} SELECT feature, symbol, coalesce(min(x) < max(x), false) AS present FROM lf GROUP BY 1, 2")
def g42(spark, sf_dir):
    from barloom.operators.features import feature_masks

    return feature_masks(features(spark, sf_dir), COLS, ["symbol"]).select("feature", "symbol", "present")
