"""Queries over the tape: scans, validation, rules, joins, labels, indicators, regimes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import indicators as I  # noqa: E741, N812
from barloom.operators import labels as L  # noqa: N812
from barloom.operators import masks as K  # noqa: N812
from barloom.operators import rules as R  # noqa: N812
from barloom.operators.chunks import shifted
from barloom.operators.pool import merge_archive
from barloom.sources.store import settled
from barloom.sources.tape import dataset_manifest, event_bars, table, with_bar_index

from .registry import query, r6

H = 12
GRID = [(10.0, 8.0), (25.0, 15.0)]

#: The tape of the SQL twins: 4-hour bars of events.
BARS = """bars0 AS (SELECT event_type AS symbol, time_bucket(INTERVAL '4 hours', ts) AS datetime, arg_min(value, ts) AS open,
  max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, sum(value) AS volume, count(*) AS ticks FROM events GROUP BY 1, 2),
bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY datetime) - 1 AS bar FROM bars0)"""
LABELS = f"""{BARS}, lab0 AS (SELECT *, lead(open, 1) OVER w AS label_open_next, lead(close, {H}) OVER w AS label_close_h,
  count(*) OVER a AS n_ahead, min(low) OVER a AS lo, max(high) OVER a AS hi,
  min(struct_pack(x := low, b := bar)) OVER a AS first_lo, min(struct_pack(x := -high, b := bar)) OVER a AS first_hi
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY datetime), a AS (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN 1 FOLLOWING AND {H} FOLLOWING)),
lab AS (SELECT * EXCLUDE (n_ahead, lo, hi, first_lo, first_hi), CASE WHEN n_ahead = {H} THEN lo END AS label_min_h, CASE WHEN n_ahead = {H} THEN hi END AS label_max_h,
  CASE WHEN n_ahead = {H} THEN CAST(first_hi.b < first_lo.b AS INTEGER) END AS label_max_first FROM lab0)"""
LAB_RET = f"""{LABELS}, ret AS (SELECT *, (label_close_h / nullif(label_open_next, 0) - 1) * 100 AS close_ret, (label_max_h / nullif(label_open_next, 0) - 1) * 100 AS max_ret,
  (label_min_h / nullif(label_open_next, 0) - 1) * 100 AS min_ret FROM lab)"""
FEATURES = """feat AS (SELECT event_id, event_type AS symbol, ts AS datetime, value, CAST(json_extract_string(props, '$.k') AS INTEGER) / 100.0::DOUBLE AS f_pos,
  CAST(json_extract_string(props, '$.k') AS INTEGER) / 50.0::DOUBLE - 1.0::DOUBLE AS f_signed, CASE WHEN user_id % 3 = 0 THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) / 200.0::DOUBLE - 0.25::DOUBLE END AS f_sparse,
  CAST(event_type = 'error' AS INTEGER) AS f_bin, user_id FROM events)"""


def features(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("symbol"), F.col("ts").alias("datetime"), "value", (k / 100.0).alias("f_pos"), (k / 50.0 - 1.0).alias("f_signed"),
        F.when(F.col("user_id") % 3 == 0, F.lit(0.0)).otherwise(k / 200.0 - 0.25).alias("f_sparse"), (F.col("event_type") == "error").cast("int").alias("f_bin"), "user_id",
    )


def labelled(spark, sf_dir, horizon=H):
    return L.add_labels(event_bars(spark, sf_dir), horizon, "bar")


def flagship(spark, sf_dir):
    """4-hour bars, forward outcomes, one rule of two conditions: trades by symbol."""
    tape = event_bars(spark, sf_dir)
    out = L.barrier(tape, H, [(10.0, 8.0)], ("long",), "bar")
    x = I.signed_efficiency(tape, 6, place="bar").withColumn("vol_rank", F.percent_rank().over(Window.partitionBy("symbol").orderBy("volume", "datetime")))
    hits = x.where(R.rule_mask(["[efficiency] IS Weak Bullish", "[vol_rank] IS High"]) | R.rule_mask(["[efficiency] IS Bullish"]))
    trades = hits.select("symbol", "bar").join(out.where("exit_offset > 0"), ["symbol", "bar"])
    return trades.groupBy("symbol").agg(F.count("*").alias("trade_count"), r6(100 * F.avg((F.col("return_pct") > 0).cast("double")), "win_rate_pct"), r6(F.sum("return_pct"), "sum_return_pct"))


EFF6 = """x0 AS (SELECT *, abs(close - lag(close) OVER w) AS step, lag(close, 6) OVER w AS back, volume AS v FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY datetime)),
x AS (SELECT *, CASE WHEN count(step) OVER a = 6 THEN (close - back) / nullif(sum(step) OVER a, 0) END AS efficiency,
  percent_rank() OVER (PARTITION BY symbol ORDER BY volume, datetime) AS vol_rank FROM x0 WINDOW a AS (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))"""


def barrier_sql(grid, directions=("long", "short")) -> str:
    cases = ", ".join(f"('{d}', {tp}::DOUBLE, {sl}::DOUBLE)" for d in directions for tp, sl in grid)
    return f"""entry AS (SELECT symbol, bar, lead(open, 1) OVER w AS entry, lead(close, {H}) OVER w AS last FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY datetime)),
cases(direction, tp, sl) AS (VALUES {cases}),
hits AS (SELECT e.symbol, e.bar, c.direction, c.tp, c.sl, e.entry, e.last, count(b.bar) AS n,
  min(CASE WHEN (c.direction = 'long' AND b.high >= e.entry * (1 + c.tp / 100)) OR (c.direction = 'short' AND b.low <= e.entry * (1 - c.tp / 100)) THEN b.bar - e.bar END) AS tp_at,
  min(CASE WHEN (c.direction = 'long' AND b.low <= e.entry * (1 - c.sl / 100)) OR (c.direction = 'short' AND b.high >= e.entry * (1 + c.sl / 100)) THEN b.bar - e.bar END) AS sl_at
  FROM entry e CROSS JOIN cases c LEFT JOIN bars b ON b.symbol = e.symbol AND b.bar BETWEEN e.bar + 1 AND e.bar + {H} GROUP BY ALL),
touch AS (SELECT symbol, bar, direction, tp, sl,
  CASE WHEN n < {H} OR coalesce(entry, 0) <= 0 THEN NULL WHEN sl_at IS NOT NULL AND (tp_at IS NULL OR sl_at <= tp_at) THEN -sl WHEN tp_at IS NOT NULL THEN tp
    ELSE (last / entry - 1) * 100 * CASE direction WHEN 'long' THEN 1 ELSE -1 END END AS return_pct,
  CASE WHEN n < {H} OR coalesce(entry, 0) <= 0 THEN -1 WHEN sl_at IS NOT NULL AND (tp_at IS NULL OR sl_at <= tp_at) THEN sl_at WHEN tp_at IS NOT NULL THEN tp_at ELSE {H} END AS exit_offset FROM hits)"""


query("flagship_rule_by_symbol", f"""WITH {BARS}, {EFF6}, {barrier_sql([(10.0, 8.0)], ("long",))}
SELECT x.symbol, count(*) AS trade_count, round(100 * avg(CAST(return_pct > 0 AS DOUBLE)), 6) AS win_rate_pct, round(sum(return_pct), 6) AS sum_return_pct
FROM x JOIN touch t ON t.symbol = x.symbol AND t.bar = x.bar AND exit_offset > 0
WHERE (efficiency > 0.2 AND efficiency <= 0.4 AND vol_rank > 0.6 AND vol_rank <= 0.8) OR (efficiency > 0.4 AND efficiency <= 0.6) GROUP BY 1""")(flagship)


@query("a1_prepared_tape", f"""WITH {LABELS}, t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY datetime DESC) AS rn FROM lab)
SELECT symbol, datetime, round(open, 6) AS open, round(close, 6) AS close, round(label_open_next, 6) AS label_open_next, round(label_close_h, 6) AS label_close_h,
 round(label_min_h, 6) AS label_min_h, round(label_max_h, 6) AS label_max_h, label_max_first, row_number() OVER (PARTITION BY symbol ORDER BY datetime) - 1 AS bar
FROM t WHERE rn > {H} AND label_close_h IS NOT NULL AND label_min_h IS NOT NULL""")
def a1(spark, sf_dir):
    df = L.drop_tail(labelled(spark, sf_dir), H).na.drop(subset=["label_close_h", "label_min_h"])
    df = with_bar_index(df.drop("bar"))
    return df.select("symbol", "datetime", *(r6(c, c) for c in ("open", "close", "label_open_next", "label_close_h", "label_min_h", "label_max_h")), "label_max_first", "bar")


@query("a11_dataset_manifest", f"WITH {BARS} SELECT count(*) AS n_rows, min(datetime) AS first_ts, max(datetime) AS last_ts, array_to_string(list_sort(list(DISTINCT symbol)), ',') AS symbols FROM bars")
def a11(spark, sf_dir):
    return dataset_manifest(event_bars(spark, sf_dir))


@query("a2_projected_scan", "SELECT event_type AS symbol, count(*) AS n_rows, min(ts) AS first_ts FROM events GROUP BY 1")
def a2(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol")).agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"))


@query("a14_archive_merge", "SELECT o_custkey AS key, o_orderkey AS best, score FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, o_totalprice AS score FROM orders) WHERE rn = 1 ORDER BY score DESC, best LIMIT 200")
def a14(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("best"), F.col("o_totalprice").alias("score"))
    odd = F.col("best") % 2 == 1  # two pools
    return merge_archive([df.where(odd), df.where(~odd)], ["key"], [F.desc("score"), F.col("best")], 200)


@query("b1_grid_validation", f"""WITH {BARS}, g AS (SELECT *, datetime - lag(datetime) OVER (PARTITION BY symbol ORDER BY datetime) AS gap FROM bars)
SELECT symbol, count(*) AS n_rows, count(*) FILTER (gap <> INTERVAL '4 hours') AS n_gaps, count(*) FILTER (hour(datetime) % 4 <> 0 OR minute(datetime) <> 0 OR second(datetime) <> 0) AS n_off_grid,
 count(*) - count(DISTINCT datetime) AS n_duplicates, count(*) FILTER (datetime IS NULL) AS n_null_ts FROM g GROUP BY 1""")
def b1(spark, sf_dir):
    df = shifted(event_bars(spark, sf_dir), "before", "datetime", -1, "bar")
    df = df.withColumn("gap", F.unix_timestamp("datetime") - F.unix_timestamp("before"))
    return df.groupBy("symbol").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("gap") != 4 * 3600).alias("n_gaps"), F.count_if((F.hour("datetime") % 4 != 0) | (F.minute("datetime") != 0) | (F.second("datetime") != 0)).alias("n_off_grid"),
        (F.count("*") - F.countDistinct("datetime")).alias("n_duplicates"), F.count_if(F.col("datetime").isNull()).alias("n_null_ts"))


@query("b5_null_policy", "SELECT l_returnflag AS symbol, count(*) AS n_rows, round(sum(coalesce(CASE WHEN l_discount > 0.05 THEN NULL ELSE l_discount END, 0)), 6) AS filled_sum FROM lineitem WHERE l_tax IS NOT NULL GROUP BY 1")
def b5(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").na.drop(subset=["l_tax"]).withColumn("f", F.when(F.col("l_discount") <= 0.05, F.col("l_discount"))).na.fill(0.0, ["f"])
    return df.groupBy(F.col("l_returnflag").alias("symbol")).agg(F.count("*").alias("n_rows"), r6(F.sum("f"), "filled_sum"))


@query("b8_downcast", "SELECT symbol, sum(CAST(CAST(f_pos * 100 AS INTEGER) AS SMALLINT)) AS total, max(CAST(f_bin AS TINYINT)) AS top FROM (WITH " + FEATURES + " SELECT * FROM feat) GROUP BY 1")
def b8(spark, sf_dir):
    return features(spark, sf_dir).groupBy("symbol").agg(F.sum(F.round(F.col("f_pos") * 100).cast("short")).cast("long").alias("total"), F.max(F.col("f_bin").cast("byte")).alias("top"))


def _case(col: str, family: str, closed: bool = True) -> str:
    labels, edges = R.FAMILIES[family]
    return "CASE " + " ".join(f"WHEN {col} {'<=' if closed else '<'} {e!r} THEN '{lab}'" for lab, e in zip(labels, edges, strict=False)) + f" ELSE '{labels[-1]}' END"


@query("b10_fuzzy_predicates", f"""WITH {FEATURES} SELECT family, label, count(*) AS n FROM (
 SELECT 'positive' AS family, {_case('f_pos', 'positive')} AS label FROM feat UNION ALL SELECT 'signed', {_case('f_signed', 'signed')} FROM feat
 UNION ALL SELECT 'sparse_signed', {_case('f_sparse', 'sparse_signed')} FROM feat) GROUP BY 1, 2""")
def b10(spark, sf_dir):
    df = features(spark, sf_dir)
    cols = {"positive": "f_pos", "signed": "f_signed", "sparse_signed": "f_sparse"}
    pairs = [(fam, lab) for fam, (labs, _) in R.FAMILIES.items() for lab in labs]
    one = df.agg(*(F.count_if(R.predicate(F.col(cols[fam]), lab)).alias(f"{fam}|{lab}") for fam, lab in pairs))
    out = one.unpivot([], list(one.columns), "k", "n").where("n > 0")
    return out.select(F.split("k", r"\|")[0].alias("family"), F.split("k", r"\|")[1].alias("label"), "n")


@query("b11_rule_mask", f"WITH {FEATURES} SELECT symbol, count(*) AS n, round(sum(value), 6) AS total FROM feat WHERE f_pos > 0.2 AND f_pos <= 0.4 AND f_signed > -0.8 AND f_signed <= -0.4 AND symbol IN ('view', 'click') GROUP BY 1")
def b11(spark, sf_dir):
    m = R.rule_mask(["[f_pos] IS Low", "symbol is view, click"]) & (R.rule_mask(["[f_signed] IS Strong Bearish"]) | R.rule_mask(["[f_signed] IS Bearish"]))
    return features(spark, sf_dir).where(m).groupBy("symbol").agg(F.count("*").alias("n"), r6(F.sum("value"), "total"))


@query("b14_symbol_normalise", "SELECT CASE c_custkey % 9 WHEN 0 THEN '__MISSING_SYMBOL__' WHEN 1 THEN '1' WHEN 2 THEN '1' WHEN 3 THEN '1000' WHEN 4 THEN 'A b' WHEN 5 THEN '-2' WHEN 6 THEN '1.5' WHEN 7 THEN 'X' ELSE 'zz' END AS symbol, count(*) AS n FROM customer GROUP BY 1")
def b14(spark, sf_dir):
    raw = F.get(F.array(*map(F.lit, [None, "'01'", " +1.0 ", "1e3", '[A b]', '"Symbol -2.0"', "1.50", "symbol X", "zz"])), (F.col("c_custkey") % 9).cast("int"))
    raw = F.when(raw == "1.50", "1.5").otherwise(raw)
    names = table(spark, sf_dir, "customer").groupBy(raw.alias("raw")).count()  # once for each distinct value
    return names.groupBy(R.normalize_symbol(F.col("raw")).alias("symbol")).agg(F.sum("count").alias("n"))


@query("b16_long_labels", f"WITH {FEATURES} SELECT count(*) FILTER (f_sparse <= -0.25) AS down, count(*) FILTER (f_sparse > -1e-5 AND f_sparse <= 1e-5) AS none, count(*) FILTER (f_sparse > 0.25) AS up, count(*) FILTER (f_bin = 1) AS active FROM feat")
def b16(spark, sf_dir):
    x = F.col("f_sparse")
    names = {"down": "Strong Negative (e.g. Big Down Gap)", "none": "Exactly Zero (No Gap)", "up": "Strong Positive (e.g. Big Up Gap)"}
    return features(spark, sf_dir).agg(*(F.count_if(R.predicate(x, v)).alias(k) for k, v in names.items()), F.count_if(R.predicate(F.col("f_bin"), "Active (1)")).alias("active"))


@query("b18_safe_region", f"WITH {BARS} SELECT symbol, count(*) AS n, min(bar) AS first_bar, max(bar) AS last_bar FROM bars WHERE NOT (bar BETWEEN 20 AND 40) AND NOT (bar BETWEEN 100 AND 130) GROUP BY 1")
def b18(spark, sf_dir):
    from barloom.operators.splits import outside

    return event_bars(spark, sf_dir).where(outside("bar", [(20, 40), (100, 130)])).groupBy("symbol").agg(F.count("*").alias("n"), F.min("bar").alias("first_bar"), F.max("bar").alias("last_bar"))


@query("b19_symbol_subset", "SELECT event_type AS symbol, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY 1")
def b19(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click", "error")).groupBy(F.col("event_type").alias("symbol")).agg(F.count("*").alias("n"))


@query("b22_chromosome_match", f"""WITH {FEATURES}, c AS (SELECT symbol, CASE WHEN f_pos <= 0.2 THEN 0 WHEN f_pos <= 0.4 THEN 1 WHEN f_pos <= 0.6 THEN 2 WHEN f_pos <= 0.8 THEN 3 ELSE 4 END AS c0, f_bin AS c1,
 {_case('f_signed', 'signed')} AS lab FROM feat), rules(rule_id, g0, g1) AS (VALUES (0, 0, 2), (1, 5, 1), (2, 3, 0), (3, 5, 2))
SELECT rule_id, symbol, count(*) AS n FROM c JOIN rules ON (g0 = 5 OR g0 = c0) AND (g1 = 2 OR g1 = c1) GROUP BY 1, 2""")
def b22(spark, sf_dir):
    from barloom.operators.search import match_dense

    rules = spark.createDataFrame([(0, [0, 2]), (1, [5, 1]), (2, [3, 0]), (3, [5, 2])], "rule long, genes array<int>")
    df = features(spark, sf_dir).select("symbol", "f_pos", "f_bin")
    hits = match_dense(df, [R.bucket(F.col("f_pos"), "positive"), F.col("f_bin")], rules, [5, 2])
    return hits.groupBy(F.col("rule").cast("int").alias("rule_id"), "symbol").agg(F.count("*").alias("n"))


MANY = f"""cl AS (SELECT symbol, CASE WHEN f_pos <= 0.2 THEN 0 WHEN f_pos <= 0.4 THEN 1 WHEN f_pos <= 0.6 THEN 2 WHEN f_pos <= 0.8 THEN 3 ELSE 4 END AS c0,
 {" + ".join(f"CAST(f_signed > {e} AS INTEGER)" for e in R.FAMILIES["signed"][1])} AS c1, f_bin AS c2 FROM feat),
pool AS (SELECT p_partkey AS rule, p_size % 6 AS g0, (p_partkey * 7) % 11 AS g1, p_partkey % 3 AS g2 FROM part)"""


@query("b22_rule_table", f"WITH {FEATURES}, {MANY} SELECT rule, symbol, count(*) AS n FROM cl JOIN pool ON (g0 = 5 OR g0 = c0) AND (g1 = 10 OR g1 = c1) AND (g2 = 2 OR g2 = c2) GROUP BY 1, 2")
def b22b(spark, sf_dir):
    """A rule for each part, read as a table: matched by counting; the plan has three columns of classes."""
    from barloom.operators.search import match_counts

    key = F.col("p_partkey")
    genes = F.transform(F.array(F.col("p_size") % 6, (key * 7) % 11, key % 3), lambda g: g.cast("int"))
    pool = table(spark, sf_dir, "part").select(key.alias("rule"), genes.alias("genes"))
    rows = features(spark, sf_dir).select("symbol", "f_pos", "f_signed", "f_bin")
    classes = [R.bucket(F.col("f_pos"), "positive"), R.bucket(F.col("f_signed"), "signed"), F.col("f_bin")]
    return match_counts(rows, classes, pool, [5, 10, 2], ["symbol"])


#: Rules of two conditions over the features: each positive label with each signed one, and those alone.
PAIRED = {100 + 10 * i + j: [f"[f_pos] IS {p}", f"[f_signed] IS {s}"] for i, p in enumerate(R.FAMILIES["positive"][0]) for j, s in enumerate(R.FAMILIES["signed"][0])}
PAIRED |= {i: [f"[f_pos] IS {p}"] for i, p in enumerate(R.FAMILIES["positive"][0])} | {10 + i: [f"[f_signed] IS {s}", "symbol is view, click"] for i, s in enumerate(R.FAMILIES["signed"][0])} | {99: []}


def _masks_sql() -> str:
    def test(label: str, col: str) -> str:
        low, high = R.interval(label)
        return " AND ".join([f"{col} > {low!r}"] * (low is not None) + [f"{col} <= {high!r}"] * (high is not None))

    def one(conditions: list[str]) -> str:
        parts = [test(c.split(" IS ")[1], c[1 : c.index("]")]) if c.startswith("[") else "symbol IN ('view', 'click')" for c in conditions]
        return " AND ".join(parts) or "true"

    return " UNION ALL ".join(f"SELECT {k} AS rule, event_id AS row FROM feat WHERE {one(c)}" for k, c in PAIRED.items())


def _masks(spark, sf_dir):
    rules = K.rule_conditions(spark, PAIRED)
    found = K.index(features(spark, sf_dir), "event_id", [c for _, c in K.conditions_of(PAIRED)])
    return K.masks(found, rules)


@query("b12_mask_index", f"WITH {FEATURES}, m AS ({_masks_sql()}) SELECT CAST(rule AS BIGINT) AS rule, count(*) AS n, min(row) AS first_row, CAST(sum(row) AS BIGINT) AS total FROM m GROUP BY 1")
def b12(spark, sf_dir):
    """Rows of 66 rules from one bitmap for each of their conditions."""
    rows = K.matched(_masks(spark, sf_dir))
    return rows.groupBy("rule").agg(F.count("*").alias("n"), F.min("row").alias("first_row"), F.sum("row").alias("total"))


@query("b12_mask_overlap", f"WITH {FEATURES}, m AS ({_masks_sql()}), s AS (SELECT rule, count(*) AS n FROM m GROUP BY 1), b AS (SELECT x.rule AS a, y.rule AS b, count(*) AS c FROM m x JOIN m y ON x.row = y.row AND x.rule < y.rule GROUP BY 1, 2) SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, c AS n_both, round(c / least(p.n, q.n), 6) AS coefficient FROM b JOIN s p ON p.rule = a JOIN s q ON q.rule = b")
def b12b(spark, sf_dir):
    return K.overlap(_masks(spark, sf_dir)).select("a", "b", F.col("both").alias("n_both"), r6("coefficient", "coefficient"))


@query("c1_one_to_one_join", f"WITH {LABELS} SELECT symbol, count(*) AS n, count(label_close_h) AS n_labels, round(sum(label_close_h), 6) AS total FROM lab GROUP BY 1")
def c1(spark, sf_dir):
    lab = labelled(spark, sf_dir).select("symbol", "datetime", "label_close_h")
    df = event_bars(spark, sf_dir).join(lab, ["symbol", "datetime"], "left")
    return df.groupBy("symbol").agg(F.count("*").alias("n"), F.count("label_close_h").alias("n_labels"), r6(F.sum("label_close_h"), "total"))


HIGH = """high AS (SELECT symbol, time_bucket(INTERVAL '12 hours', datetime) AS dt, time_bucket(INTERVAL '12 hours', datetime) + INTERVAL '12 hours' AS close_time, arg_min(open, datetime) AS open, max(high) AS high, min(low) AS low,
 arg_max(close, datetime) AS close, sum(volume) AS volume, count(*) AS n_base FROM bars GROUP BY 1, 2, 3 HAVING count(*) = 3)"""


@query("c2_as_of_backward", f"""WITH {BARS}, {HIGH}, s AS (SELECT symbol, close_time, CASE WHEN close >= open THEN 1 ELSE -1 END AS state FROM high),
r AS (SELECT symbol, datetime, datetime + INTERVAL '4 hours' AS t FROM bars) SELECT r.symbol, r.datetime, coalesce(s.state, 2) AS state FROM r ASOF LEFT JOIN s ON r.symbol = s.symbol AND r.t >= s.close_time""")
def c2(spark, sf_dir):
    tape = event_bars(spark, sf_dir)
    s = I.higher_bars(tape, "12 hours", 3).withColumn("state", F.when(F.col("close") >= F.col("open"), 1).otherwise(-1))
    return I.as_of(tape, s, F.col("datetime") + F.expr("INTERVAL 4 HOURS"), "state").select("symbol", "datetime", "state")


GAPPED = "gapped AS (SELECT *, row_number() OVER (ORDER BY datetime, symbol) - 1 AS row_id, count(*) OVER () AS total FROM bars WHERE NOT (bar BETWEEN 20 AND 40) AND NOT (bar BETWEEN 100 AND 130))"


def gapped(spark, sf_dir):
    """A tape without the bars of two forbidden ranges, numbered anew."""
    from barloom.operators.splits import outside, row_ids

    return row_ids(event_bars(spark, sf_dir).where(outside("bar", [(20, 40), (100, 130)])))


@query("c3_release_index", f"WITH {BARS}, {GAPPED} SELECT a.symbol, a.bar, coalesce(b.row_id, a.total) AS release_row FROM gapped a ASOF LEFT JOIN gapped b ON a.symbol = b.symbol AND a.bar + {H} <= b.bar")
def c3(spark, sf_dir):
    from barloom.operators.splits import release_rows

    tape = gapped(spark, sf_dir).select("symbol", "bar", "row_id")
    total = tape.agg(F.count("*").alias("total"))  # one row
    return release_rows(tape, F.lit(H)).crossJoin(F.broadcast(total)).select("symbol", "bar", F.coalesce("release_row", "total").alias("release_row"))


@query("c6_semi_and_c7_overlap", f"WITH {BARS}, k AS (SELECT symbol, datetime FROM bars WHERE bar % 5 = 0), h AS (SELECT symbol, datetime FROM bars WHERE bar < 50) SELECT (SELECT count(*) FROM bars b WHERE EXISTS (SELECT 1 FROM k WHERE k.symbol = b.symbol AND k.datetime = b.datetime)) AS kept, (SELECT count(*) FROM (SELECT * FROM k INTERSECT SELECT * FROM h)) AS overlap, (SELECT count(*) FROM (SELECT * FROM k EXCEPT SELECT * FROM h)) AS missing")
def c6(spark, sf_dir):
    b = event_bars(spark, sf_dir)
    k, h = b.where("bar % 5 = 0").select("symbol", "datetime"), b.where("bar < 50").select("symbol", "datetime")
    kept = b.join(k, ["symbol", "datetime"], "left_semi").agg(F.count("*").alias("kept"))
    both = k.intersect(h).agg(F.count("*").alias("overlap"))
    return kept.crossJoin(both).crossJoin(k.subtract(h).agg(F.count("*").alias("missing")))  # one row each


@query("d1_labels", f"WITH {LABELS} SELECT symbol, bar, round(label_open_next, 6) AS label_open_next, round(label_close_h, 6) AS label_close_h, round(label_min_h, 6) AS label_min_h, round(label_max_h, 6) AS label_max_h, label_max_first FROM lab")
def d1(spark, sf_dir):
    return labelled(spark, sf_dir).select("symbol", "bar", *(r6(c, c) for c in ("label_open_next", "label_close_h", "label_min_h", "label_max_h")), "label_max_first")


@query("d6_first_touch", f"WITH {BARS}, {barrier_sql(GRID)} SELECT symbol, bar, direction, tp, sl, round(return_pct, 6) AS return_pct, exit_offset FROM touch")
def d6(spark, sf_dir):
    return L.barrier(event_bars(spark, sf_dir), H, GRID, place="bar").select("symbol", "bar", "direction", "tp", "sl", r6("return_pct", "return_pct"), "exit_offset")


def _outcome_sql(direction: str, tp: float, sl: float) -> str:
    up, down, first, close = ("max_ret", "min_ret", 1, "close_ret") if direction == "long" else ("-min_ret", "-max_ret", 0, "-close_ret")
    return f"CASE WHEN {up} >= {tp} AND {down} <= {-sl} THEN CASE WHEN label_max_first = {first} THEN {tp} ELSE {-sl} END WHEN {up} >= {tp} THEN {tp} WHEN {down} <= {-sl} THEN {-sl} ELSE {close} END::DOUBLE"


@query("d8_aggregate_outcome", f"WITH {LAB_RET}, o AS (SELECT symbol, bar, {_outcome_sql('long', 10.0, 8.0)} AS o_long, {_outcome_sql('short', 10.0, 8.0)} AS o_short FROM ret) SELECT symbol, bar, round(o_long, 6) AS o_long, round(o_short, 6) AS o_short, CASE WHEN abs(o_long - 10) <= 1e-5 THEN 'TP' WHEN abs(o_long + 8) <= 1e-5 THEN 'SL' ELSE 'Time_{H}' END AS reason, CASE WHEN o_long >= 10 THEN 2 WHEN o_long <= -8 THEN 0 WHEN o_long IS NOT NULL THEN 1 END AS target FROM o")
def d8(spark, sf_dir):
    df = L.returns(labelled(spark, sf_dir))
    df = df.withColumns({"o_long": L.aggregate_outcome(df, 10.0, 8.0), "o_short": L.aggregate_outcome(df, 10.0, 8.0, "short")})
    return df.select("symbol", "bar", r6("o_long", "o_long"), r6("o_short", "o_short"), L.exit_reason(F.col("o_long"), F.lit(10.0), F.lit(8.0), H).alias("reason"), L.three_class(F.col("o_long"), 10.0, 8.0).alias("target"))


@query("d11_entry_time", f"WITH {BARS} SELECT symbol, bar, coalesce(lead(datetime) OVER (PARTITION BY symbol ORDER BY datetime), datetime + INTERVAL '4 hours') AS entry_time FROM bars")
def d11(spark, sf_dir):
    return shifted(event_bars(spark, sf_dir), "next", "datetime", 1, "bar").select("symbol", "bar", F.coalesce(F.col("next"), F.col("datetime") + F.expr("INTERVAL 4 HOURS")).alias("entry_time"))


IND = f"""i0 AS (SELECT *, lag(close) OVER w AS pc, lag(close, 6) OVER w AS pc6, abs(close - lag(close) OVER w) AS step,
 greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END AS lr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY datetime)),
i1 AS (SELECT *, CASE WHEN count(step) OVER a = 6 THEN (close - pc6) / nullif(sum(step) OVER a, 0) END AS efficiency, CASE WHEN count(tr) OVER a = 6 THEN avg(tr) OVER a END AS atr,
 CASE WHEN count(lr) OVER a = 6 THEN stddev_samp(lr) OVER a END AS rv FROM i0 WINDOW a AS (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))"""
EMA_SQL = """ema AS (SELECT symbol, bar, datetime, close AS f, close AS s FROM bars WHERE bar = 0
 UNION ALL SELECT b.symbol, b.bar, b.datetime, 0.5 * b.close + 0.5 * e.f, 2.0 / 7 * b.close + 5.0 / 7 * e.s FROM ema e JOIN bars b ON b.symbol = e.symbol AND b.bar = e.bar + 1)"""


@query("e1_e5_indicators", f"WITH {BARS}, {IND} SELECT symbol, bar, round(efficiency, 6) AS efficiency, round(atr, 6) AS atr, round(rv, 6) AS rv FROM i1")
def e1(spark, sf_dir):
    df = I.price_indicators(event_bars(spark, sf_dir), 6, place="bar")
    return df.select("symbol", "bar", r6("efficiency", "efficiency"), r6("atr", "atr"), r6("rv", "rv"))


@query("e3_ema_spread", f"WITH RECURSIVE {BARS}, {IND}, {EMA_SQL} SELECT e.symbol, e.bar, round((e.f - e.s) / nullif(i1.atr, 0), 6) AS spread FROM ema e JOIN i1 ON i1.symbol = e.symbol AND i1.bar = e.bar")
def e3(spark, sf_dir):
    return I.structural_inputs(event_bars(spark, sf_dir), 6, "bar").select("symbol", "bar", r6("spread", "spread"))


REGIME = f"""{BARS}, {IND}, {EMA_SQL}, si AS (SELECT i1.*, (e.f - e.s) / nullif(i1.atr, 0) AS spread, row_number() OVER (PARTITION BY i1.symbol ORDER BY i1.datetime) AS rn, count(*) OVER (PARTITION BY i1.symbol) AS total FROM i1 JOIN ema e ON e.symbol = i1.symbol AND e.bar = i1.bar),
th AS (SELECT quantile_cont(abs(efficiency), 0.55) AS te, quantile_cont(abs(spread), 0.55) AS ts, quantile_cont(rv, 0.45) AS tv FROM si WHERE rn <= floor(total * 0.65)),
st AS (SELECT si.*, CASE WHEN abs(efficiency) < te AND rv < tv AND rv >= 0 THEN 0 WHEN efficiency <= -te AND spread <= -ts THEN -1 WHEN efficiency >= te AND spread >= ts THEN 1 ELSE 2 END AS state FROM si, th)"""


@query("f2_thresholds", f"WITH RECURSIVE {REGIME} SELECT round(te, 6) AS eff_t, round(ts, 6) AS spread_t, round(tv, 6) AS rv_t FROM th")
def f2(spark, sf_dir):
    t = I.fit_thresholds(I.train_prefix(I.structural_inputs(event_bars(spark, sf_dir), 6, "bar"), 0.65))
    return t.select(*(r6(c, c) for c in t.columns))


@query("f4_regimes", f"WITH RECURSIVE {REGIME} SELECT symbol, bar, state FROM st")
def f4(spark, sf_dir):
    x = settled(I.structural_inputs(event_bars(spark, sf_dir), 6, "bar"))
    return I.classify(x, I.fit_thresholds(I.train_prefix(x, 0.65))).select("symbol", "bar", "state")


@query("f1_higher_bars", f"WITH {BARS}, {HIGH} SELECT symbol, dt AS datetime, close_time, round(open, 6) AS open, high, low, round(close, 6) AS close, round(volume, 4) AS volume, n_base FROM high")
def f1(spark, sf_dir):
    return I.higher_bars(event_bars(spark, sf_dir), "12 hours", 3).select("symbol", "datetime", "close_time", r6("open", "open"), "high", "low", r6("close", "close"), F.round("volume", 4).alias("volume"), "n_base")


CONTEXT = f"""{BARS}, m AS (SELECT *, CASE WHEN bar % 7 < 3 THEN 1 WHEN bar % 7 < 5 THEN -1 WHEN bar % 7 < 6 THEN 0 ELSE 2 END AS hwc_state, CASE WHEN bar % 5 < 2 THEN 1 WHEN bar % 5 < 3 THEN 0 ELSE -1 END AS mwc_state,
 CASE WHEN close > open THEN 1 WHEN close < open THEN -1 ELSE 0 END AS lwc_state FROM bars),
p AS (SELECT *, CAST(hwc_state = 1 AND mwc_state IN (1, 0) AS INTEGER) AS tf_permission_long, CAST(hwc_state = -1 AND mwc_state IN (-1, 0) AS INTEGER) AS tf_permission_short,
 CAST(lwc_state = 1 AND coalesce(sum(CAST(lwc_state IN (-1, 0) AS INTEGER)) OVER l, 0) > 0 AS INTEGER) AS lwc_pullback_reversal_long, CAST(lwc_state = -1 AND coalesce(sum(CAST(lwc_state IN (1, 0) AS INTEGER)) OVER l, 0) > 0 AS INTEGER) AS lwc_pullback_reversal_short
 FROM m WINDOW l AS (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))"""


def context(spark, sf_dir):
    b = F.col("bar")
    df = event_bars(spark, sf_dir).withColumns({
        "hwc_state": F.when(b % 7 < 3, 1).when(b % 7 < 5, -1).when(b % 7 < 6, 0).otherwise(2), "mwc_state": F.when(b % 5 < 2, 1).when(b % 5 < 3, 0).otherwise(-1),
        "lwc_state": F.when(F.col("close") > F.col("open"), 1).when(F.col("close") < F.col("open"), -1).otherwise(0)})
    return I.permissions(df, lookback=3, place="bar")


@query("e7_permissions_triggers", f"WITH {CONTEXT} SELECT symbol, bar, tf_permission_long, tf_permission_short, lwc_pullback_reversal_long, lwc_pullback_reversal_short FROM p")
def e7(spark, sf_dir):
    return context(spark, sf_dir).select("symbol", "bar", "tf_permission_long", "tf_permission_short", "lwc_pullback_reversal_long", "lwc_pullback_reversal_short")


@query("b2_context_contract", f"WITH {CONTEXT} SELECT count(*) AS n_rows, count(*) FILTER (hwc_state NOT IN (-1, 0, 1, 2)) AS bad_state, count(*) FILTER (tf_permission_long = 1 AND tf_permission_short = 1) AS both_permissions, count(*) FILTER (tf_permission_long <> CAST(hwc_state = 1 AND mwc_state IN (1, 0) AS INTEGER)) AS bad_long FROM p")
def b2(spark, sf_dir):
    c = F.col
    return context(spark, sf_dir).agg(
        F.count("*").alias("n_rows"), F.count_if(~c("hwc_state").isin(-1, 0, 1, 2)).alias("bad_state"), F.count_if((c("tf_permission_long") == 1) & (c("tf_permission_short") == 1)).alias("both_permissions"),
        F.count_if(c("tf_permission_long") != ((c("hwc_state") == 1) & c("mwc_state").isin(1, 0)).cast("int")).alias("bad_long"))


@query("f9_context_coverage", f"WITH {CONTEXT} SELECT coalesce(symbol, 'ALL') AS symbol, count(*) AS n_rows, count(*) FILTER (tf_permission_long = 1) AS permission, count(*) FILTER (lwc_pullback_reversal_long = 1) AS trigger, count(*) FILTER (tf_permission_long = 1 AND lwc_pullback_reversal_long = 1) AS both, count(*) FILTER (tf_permission_long = 1 AND lwc_pullback_reversal_long <> 1) AS permission_only, count(*) FILTER (tf_permission_long <> 1 AND lwc_pullback_reversal_long = 1) AS trigger_only, count(*) FILTER (tf_permission_long <> 1 AND lwc_pullback_reversal_long <> 1) AS neither FROM p GROUP BY ROLLUP (symbol)".replace("AS trigger,", 'AS "trigger",'))
def f9(spark, sf_dir):
    return I.coverage(context(spark, sf_dir), "long")


@query("f10_floor_failures", f"WITH {CONTEXT}, c AS (SELECT coalesce(symbol, 'ALL') AS symbol, count(*) FILTER (tf_permission_long = 1) AS permission, count(*) FILTER (tf_permission_long = 1 AND lwc_pullback_reversal_long = 1) AS n_both FROM p GROUP BY ROLLUP (symbol)) SELECT symbol, concat_ws(';', CASE WHEN permission < 60 THEN 'permission<60' END, CASE WHEN n_both < 15 THEN 'both<15' END) AS failures FROM c")
def f10(spark, sf_dir):
    return I.floor_failures(I.coverage(context(spark, sf_dir), "long"), {"permission": 60, "both": 15})


def regime_sql(src: str, t: str) -> str:
    """CTE {t}: the rows of src (with bar) and their state, by thresholds of its own first part;
    its indicators as efficiency, spread, rv."""
    return f"""{t}0 AS (SELECT *, lag(close, 6) OVER w AS pc6, abs(close - lag(close) OVER w) AS step, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr,
 CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END AS lr FROM {src} WINDOW w AS (PARTITION BY symbol ORDER BY datetime)),
{t}1 AS (SELECT *, CASE WHEN count(step) OVER a = 6 THEN (close - pc6) / nullif(sum(step) OVER a, 0) END AS efficiency, CASE WHEN count(tr) OVER a = 6 THEN avg(tr) OVER a END AS atr,
 CASE WHEN count(lr) OVER a = 6 THEN stddev_samp(lr) OVER a END AS rv FROM {t}0 WINDOW a AS (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
{t}e AS (SELECT symbol, bar, close AS f, close AS s FROM {src} WHERE bar = 0 UNION ALL SELECT b.symbol, b.bar, 0.5 * b.close + 0.5 * e.f, 2.0 / 7 * b.close + 5.0 / 7 * e.s FROM {t}e e JOIN {src} b ON b.symbol = e.symbol AND b.bar = e.bar + 1),
{t}s AS (SELECT x.*, (e.f - e.s) / nullif(x.atr, 0) AS spread, row_number() OVER (PARTITION BY x.symbol ORDER BY x.datetime) AS rn, count(*) OVER (PARTITION BY x.symbol) AS total FROM {t}1 x JOIN {t}e e ON e.symbol = x.symbol AND e.bar = x.bar),
{t}t AS (SELECT quantile_cont(abs(efficiency), 0.55) AS te, quantile_cont(abs(spread), 0.55) AS ts, quantile_cont(rv, 0.45) AS tv FROM {t}s WHERE rn <= floor(total * 0.65)),
{t} AS (SELECT s.*, CASE WHEN abs(efficiency) < te AND rv < tv AND rv >= 0 THEN 0 WHEN efficiency <= -te AND spread <= -ts THEN -1 WHEN efficiency >= te AND spread >= ts THEN 1 ELSE 2 END AS state FROM {t}s s, {t}t)"""


def higher_sql(name: str, width: str, n: int) -> str:
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY datetime) - 1 AS bar FROM (SELECT symbol, time_bucket(INTERVAL '{width}', datetime) AS datetime, time_bucket(INTERVAL '{width}', datetime) + INTERVAL '{width}' AS close_time,
 arg_min(open, datetime) AS open, max(high) AS high, min(low) AS low, arg_max(close, datetime) AS close FROM bars GROUP BY 1, 2, 3 HAVING count(*) = {n}))"""


ENRICHED = f"""{BARS}, {higher_sql('mid_bars', '12 hours', 3)}, {higher_sql('high_bars', '1 day', 6)}, {regime_sql('bars', 'lo')}, {regime_sql('mid_bars', 'mi')}, {regime_sql('high_bars', 'hi')},
al AS (SELECT a.symbol, a.datetime, a.bar, a.lwc_state, a.ready, a.mwc_state, coalesce(h.state, 2) AS hwc_state FROM (SELECT l.symbol, l.datetime, l.bar, l.state AS lwc_state, l.efficiency IS NOT NULL AND l.spread IS NOT NULL AND l.rv IS NOT NULL AS ready, coalesce(m.state, 2) AS mwc_state, l.datetime + INTERVAL '4 hours' AS t
 FROM lo l ASOF LEFT JOIN mi m ON l.symbol = m.symbol AND l.datetime + INTERVAL '4 hours' >= m.close_time) a ASOF LEFT JOIN hi h ON a.symbol = h.symbol AND a.t >= h.close_time),
enriched AS (SELECT *, CAST(hwc_state = 1 AND mwc_state IN (1, 0) AS INTEGER) AS tf_permission_long, CAST(hwc_state = -1 AND mwc_state IN (-1, 0) AS INTEGER) AS tf_permission_short,
 CAST(lwc_state = 1 AND coalesce(sum(CAST(lwc_state IN (-1, 0) AS INTEGER)) OVER l, 0) > 0 AS INTEGER) AS lwc_pullback_reversal_long, CAST(lwc_state = -1 AND coalesce(sum(CAST(lwc_state IN (1, 0) AS INTEGER)) OVER l, 0) > 0 AS INTEGER) AS lwc_pullback_reversal_short
 FROM al WINDOW l AS (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))"""
SEVEN = "hwc_state, mwc_state, lwc_state, tf_permission_long, tf_permission_short, lwc_pullback_reversal_long, lwc_pullback_reversal_short"
SCALES = (6, ("12 hours", 3), ("1 day", 6), "4 HOURS")


@query("f6_enriched_tape", f"WITH RECURSIVE {ENRICHED} SELECT symbol, datetime, bar, {SEVEN} FROM enriched WHERE ready")
def f6(spark, sf_dir):
    """All seven context columns of the tape, without the rows of the warm-up."""
    return I.enrich(event_bars(spark, sf_dir), *SCALES, warm_up=False).select("symbol", "datetime", "bar", *SEVEN.split(", "))


@query("f3_all_thresholds", f"WITH RECURSIVE {ENRICHED} " + " UNION ALL ".join(f"SELECT '{k}' AS timeframe, round(te, 6) AS eff_t, round(ts, 6) AS spread_t, round(tv, 6) AS rv_t FROM {t}t" for k, t in (("lwc", "lo"), ("mwc", "mi"), ("hwc", "hi"))))
def f3(spark, sf_dir):
    each = [t.select(F.lit(k).alias("timeframe"), *(r6(c, c) for c in ("eff_t", "spread_t", "rv_t"))) for k, t in I.fit_all(event_bars(spark, sf_dir), *SCALES[:3]).items()]
    return each[0].union(each[1]).union(each[2])


@query("f7_target_with_history", f"WITH RECURSIVE {ENRICHED} SELECT symbol, bar, {SEVEN} FROM enriched WHERE ready AND bar >= 60")
def f7(spark, sf_dir):
    """Rows from bar 60 on, warmed up by those before."""
    tape = event_bars(spark, sf_dir)
    out = I.enrich_target(tape.where("bar >= 60"), tape.where("bar < 60"), *SCALES, I.fit_all(tape, *SCALES[:3]))
    return out.select("symbol", "bar", *SEVEN.split(", "))


@query("f11_preflight", f"WITH {CONTEXT}, w(name, a, b) AS (VALUES ('early', 0, 60), ('late', 40, 120)), c AS (SELECT name, coalesce(symbol, 'ALL') AS symbol, count(*) AS n_rows, count(*) FILTER (tf_permission_short = 1) AS permission, count(*) FILTER (tf_permission_short = 1 AND lwc_pullback_reversal_short = 1) AS n_both FROM p JOIN w ON bar BETWEEN a AND b GROUP BY GROUPING SETS ((name), (name, symbol))) SELECT name AS window_name, symbol, n_rows, permission, n_both, concat_ws(';', CASE WHEN permission < 70 THEN 'permission<70' END, CASE WHEN n_both < 20 THEN 'both<20' END) AS failures FROM c")
def f11(spark, sf_dir):
    out = I.preflight(context(spark, sf_dir), {"early": (0, 60), "late": (40, 120)}, "short", {"permission": 70, "both": 20})
    return out.select(F.col("window").alias("window_name"), "symbol", "n_rows", "permission", F.col("both").alias("n_both"), "failures")


@query("b3_context_faults", f"WITH {CONTEXT} SELECT count(*) AS n_rows, 0 AS missing, count(*) FILTER (bar % 60 = 3) AS bad_state, 0 AS bad_flag, count(*) FILTER (bar % 60 = 3 AND (tf_permission_long = 1 OR tf_permission_short = 1)) AS bad_permission, 0 AS both_permissions, count(*) FILTER (bar >= 3 AND bar % 50 = 7) AS bad_trigger FROM p")
def b3(spark, sf_dir):
    """A tape with wrong states and turned triggers."""
    df = context(spark, sf_dir)
    bad = df.withColumns({"hwc_state": F.when(F.col("bar") % 60 == 3, 9).otherwise(F.col("hwc_state")), "lwc_pullback_reversal_long": F.when(F.col("bar") % 50 == 7, 1 - F.col("lwc_pullback_reversal_long")).otherwise(F.col("lwc_pullback_reversal_long"))})
    return I.context_faults(bad, lookback=3)


@query("a1_load_with_policy", f"WITH {LABELS}, t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY datetime DESC) AS rn FROM lab) SELECT symbol, datetime, row_number() OVER (PARTITION BY symbol ORDER BY datetime) - 1 AS bar, round(label_max_h, 6) AS label_max_h, coalesce(CASE WHEN ticks > 2 THEN ticks END, 0) AS ff_ticks, round(return_pct, 6) AS outcome FROM (SELECT t.*, x.return_pct FROM t LEFT JOIN touch x ON x.symbol = t.symbol AND x.bar = t.bar AND x.direction = 'long') WHERE rn > {H} AND label_open_next IS NOT NULL AND label_close_h IS NOT NULL AND label_min_h IS NOT NULL AND label_max_h IS NOT NULL AND label_max_first IS NOT NULL".replace(", t AS (", f", {barrier_sql([(10.0, 8.0)])}, t AS (", 1))
def a1_load(spark, sf_dir):
    """The whole preparation: labels derived, outcomes attached, tail cut, features filled."""
    from barloom.sources.load import prepare

    raw = event_bars(spark, sf_dir).select("datetime", "symbol", "open", "high", "low", "close", "volume", F.when(F.col("ticks") > 2, F.col("ticks")).alias("ff_ticks"))
    out = prepare(raw, H, barriers=([10.0], [8.0]))
    return out.select("symbol", "datetime", "bar", r6("label_max_h", "label_max_h"), "ff_ticks", r6(L.pair_name("long", 10.0, 8.0, "ret"), "outcome"))


@query("b6_feature_columns", "SELECT unnest(['ff_a', 'ff_b']) AS feature")
def b6(spark, sf_dir):
    """What may be a feature of an enriched, labelled tape."""
    from barloom.sources.load import feature_columns, slim

    df = L.add_labels(context(spark, sf_dir), H).withColumns({"ff_a": F.lit(1.0), "ff_b": F.lit(2), "_ret": F.lit(0.0)}).drop("ticks")
    kept = slim(df, ["ff_b"])
    names = feature_columns(df)
    assert "ff_a" not in kept.columns and {"_ret", "hwc_state", "label_max_h"} <= set(kept.columns)
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query("f8_monthly_windows", f"WITH {BARS}, w AS (SELECT *, CAST(floor((epoch(datetime) - min(epoch(datetime)) OVER ()) / (7 * 86400)) AS BIGINT) AS window_id FROM bars), k AS (SELECT window_id, count(*) AS n, row_number() OVER (ORDER BY window_id) AS rk FROM w GROUP BY 1 HAVING count(*) >= 100) SELECT window_id, n FROM k WHERE rk <= 24")
def f8(spark, sf_dir):
    from barloom.operators.splits import time_windows

    return time_windows(event_bars(spark, sf_dir), 7, 100, 24)
