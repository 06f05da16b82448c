"""Operators that are cut into pieces give what they give in one piece: borders in every frame."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from barloom.operators import chunks
from barloom.operators import indicators as I  # noqa: E741, N812
from barloom.operators import labels as L  # noqa: N812
from barloom.operators import quantiles as Q  # noqa: N812
from barloom.operators import splits as S  # noqa: N812

SCHEMA = "symbol string, datetime timestamp, bar long, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def tape(spark):
    """One long symbol, a short one, a single bar and one without a name; gaps in time."""
    r, rows = random.Random(5), []
    for symbol, n in (("A", 97), ("B", 11), ("C", 1), (None, 9)):
        at, price = dt.datetime(2024, 1, 1), 100.0
        for k in range(n):
            at += dt.timedelta(hours=4 * r.choice([1, 1, 1, 9]))
            close = max(1.0, price + r.gauss(0, 3))
            high, low = max(price, close) + r.random(), min(price, close) - r.random()
            rows.append((symbol, at, k, price, None if k % 23 == 7 else high, low, close, float(k)))
            price = close
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


def table(df):
    return sorted((tuple(None if isinstance(x, float) and math.isnan(x) else x for x in row) for row in df.collect()), key=str)


def same(whole, cut):
    assert len(whole) == len(cut) > 0
    for a, b in zip(whole, cut, strict=True):
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and y == pytest.approx(x, rel=1e-12, abs=1e-12)), (a, b)


def states(tape):
    return tape.where("bar % 4 = 0").select("symbol", (F.col("datetime") + F.expr("INTERVAL 4 HOURS")).alias("close_time"), (F.col("bar") % 3).alias("state"))


def context(tape):
    state = lambda k: F.when(F.col("bar") % k == 0, 1).when(F.col("bar") % k == 1, -1).otherwise(0)
    return tape.withColumns({"hwc_state": state(5), "mwc_state": state(3), "lwc_state": state(4)})


CASES = {
    "E1_E2_E5": lambda t: I.price_indicators(t, 6),
    "E1": lambda t: I.signed_efficiency(t, 7),
    "E2": lambda t: I.true_range(t, 5),
    "E3_E6": lambda t: I.structural_inputs(t, 6),
    "E5": lambda t: I.realized_volatility(t, 4),
    "E8": lambda t: I.permissions(context(t), lookback=9),
    "E9": lambda t: chunks.numbered(t, "place", total="rows"),
    "D2_D4": lambda t: L.add_labels(t, 13),
    "D6": lambda t: L.barrier(t, 13, [(1.0, 2.0), (3.0, 1.0), (8.0, 8.0)]),
    "D7": lambda t: L.attach_barriers(t, 7, [1.0, 4.0], [2.0]),
    "D12": lambda t: L.drop_tail(t, 12),
    "C2": lambda t: I.as_of(t, states(t), F.col("datetime") + F.expr("INTERVAL 4 HOURS"), "state"),
    "F2": lambda t: I.train_prefix(t, 0.4),
    "H1": lambda t: S.holdout(t, 0.6, 3),
    "shift": lambda t: chunks.shifted(chunks.shifted(t, "next", "open", 3), "before", "close", -2),
}


@pytest.mark.parametrize("name", CASES)
def test_chunks_give_what_one_piece_gives(tape, monkeypatch, name):
    monkeypatch.setattr(chunks, "ROWS", 1 << 30)
    monkeypatch.setattr(chunks, "SPAN", 1 << 40)
    whole = table(CASES[name](tape))
    monkeypatch.setattr(chunks, "ROWS", 5)
    monkeypatch.setattr(chunks, "SPAN", 86400)
    same(whole, table(CASES[name](tape)))


@pytest.mark.parametrize("name", CASES)
def test_no_task_holds_a_symbol(tape, name):
    """Windows by symbol alone are over one row a slot: they sum counts or hand a value on."""
    plan = CASES[name](tape)._jdf.queryExecution().executedPlan().toString()
    for line in re.findall(r"Window \[.*", plan):
        partition = re.findall(r"windowspecdefinition\(([^)]*?)(?: ASC| DESC|, specified)", line)
        if partition and re.fullmatch(r"symbol#\d+(, _slot#\d+L?)?", partition[0]) and "_chunk" not in line and "_slot" not in partition[0].split(",")[-1]:
            assert "sum(_n#" in line or "last(_end#" in line, line


def brute_touch(tape, horizon, cases):
    out = []
    by = {}
    for r in sorted(tape.collect(), key=lambda r: (r.symbol or "", r.datetime)):
        by.setdefault(r.symbol, []).append(r)
    for rows in by.values():
        for i, r in enumerate(rows):
            for d, tp, sl in cases:
                ret, off = None, -1
                if i + horizon < len(rows) and rows[i + 1].open and rows[i + 1].open > 0:
                    entry, off, sign = rows[i + 1].open, horizon, 1 if d == "long" else -1
                    ret = (rows[i + horizon].close / entry - 1) * 100 * sign
                    for o in range(1, horizon + 1):
                        high, low = rows[i + o].high, rows[i + o].low
                        up, down = (tp, sl) if d == "long" else (sl, tp)
                        above, below = high is not None and high >= entry * (1 + up / 100), low is not None and low <= entry * (1 - down / 100)
                        good, bad = (above, below) if d == "long" else (below, above)
                        if good or bad:
                            ret, off = (-sl if bad else tp), o
                            break
                out.append((r.symbol, r.bar, d, tp, sl, ret, off))
    return sorted(out, key=str)


@pytest.mark.parametrize("horizon", [1, 2, 7, 16, 31, 200])
def test_first_touch(tape, monkeypatch, horizon):
    monkeypatch.setattr(chunks, "ROWS", 10)
    grid = [(0.5, 1.0), (2.0, 2.0), (6.0, 3.0), (0.0, 50.0)]
    got = table(L.barrier(tape, horizon, grid))
    same(brute_touch(tape, horizon, [(d, tp, sl) for d in ("long", "short") for tp, sl in grid]), got)


def test_extrema_steps():
    import numpy as np

    r = np.random.default_rng(2)
    for longest in (1, 3, 8, 100):
        v = r.normal(size=60)
        v[5] = np.nan
        level = r.normal(size=60) + 1
        x = L.Extrema(v, longest)
        assert len(x.runs) == longest.bit_length()  # steps a level: the logarithm of the horizon
        want = [next((o for o in range(1, longest + 1) if i + o < 60 and v[i + o] >= level[i]), 0) for i in range(60)]
        assert x.first(level, longest).tolist() == want


@pytest.mark.parametrize(("few", "accuracy"), [(4096, 2000), (6, 20), (1, 10)])
def test_quantiles(spark, monkeypatch, few, accuracy):
    import numpy as np

    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "ACCURACY", accuracy)
    r = random.Random(3)
    n = 700
    cols = {
        "normal": [r.gauss(0, 1) for _ in range(n)],
        "ties": [float(r.choice([0, 0, 0, 1, 2])) for _ in range(n)],
        "wide": [r.choice([-1, 1]) * 10 ** r.uniform(-300, 300) for _ in range(n)],
        "holes": [r.choice([None, float("nan"), float("inf"), -float("inf"), 1.5, 2.5, 7.0]) for _ in range(n)],
        "one": [4.0] + [None] * (n - 1),
        "none": [None] * n,
        "steps": [float(k // 50) for k in range(n)],
    }
    df = spark.createDataFrame(list(zip(*cols.values(), strict=True)), ", ".join(f"{c} double" for c in cols)).repartition(5)
    for q in (0.0, 0.1, 0.45, 0.5, 0.777, 1.0):
        got = Q.quantiles(df, {c: (F.col(c), q) for c in cols})
        for c, values in cols.items():
            fine = [x for x in values if x is not None and math.isfinite(x)]
            assert got[c] == (pytest.approx(float(np.quantile(fine, q)), rel=1e-12) if fine else None), (c, q)


TRADES = "key string, bar long, return_pct double"


@pytest.fixture(scope="module")
def trades(spark):
    r = random.Random(8)
    rows = [("a", k, r.gauss(0, 30)) for k in range(83)] + [("b", 3 * k, r.choice([-250.0, 50.0, -40.0])) for k in range(17)] + [("c", 5, -100.0), ("c", 9, 10.0), (None, 2, -5.0), ("d", 1, None), ("d", 8, 3.0)]
    return spark.createDataFrame(rows, TRADES).repartition(3).persist()


def by_key(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.bar):
        out.setdefault(r.key, []).append(r)
    return out


@pytest.mark.parametrize("rows", [1, 4, 1 << 20])
def test_scans(trades, monkeypatch, rows):
    from barloom.operators import metrics as M  # noqa: N812
    from barloom.operators import scans

    monkeypatch.setattr(chunks, "ROWS", rows)
    fall, product, sums = [], [], []
    for key, own in by_key(trades).items():
        eq, peak, worst, total = 1000.0, 1000.0, None, None
        p, top, dip = 1.0, None, 0.0
        for r in own:
            if r.return_pct is not None:
                total = (total or 0.0) + r.return_pct
                eq = 1000.0 + total
                peak = max(peak, eq)
                worst = max(worst or 0.0, (peak - eq) / peak * 100)
                p *= 1 + r.return_pct / 100
                top = p if top is None else max(top, p)
                dip = max(dip, (top - p) / max(top, 1e-12) * 100)
            sums.append((key, r.bar, total))
        fall.append((key, worst))
        if key != "d":
            product.append((key, p, dip))
    same(sorted(fall, key=str), table(M.drawdown(trades, ["key"])))
    same(sorted(product, key=str), table(M.compounded(trades.where("coalesce(key, '') <> 'd'"), ["key"])))
    same(sorted(sums, key=str), table(scans.running_sum(trades, "return_pct", ["key"], "bar", "total").select("key", "bar", "total")))


@pytest.mark.parametrize("parts", [1, 2, 64])
def test_average_ranks(spark, monkeypatch, parts):
    from barloom.operators import ranks

    monkeypatch.setattr(ranks, "PARTS", parts)
    r = random.Random(6)
    # With two parts the border is a value that a third of the rows share.
    rows = [("a", k, float(r.choice([1, 2, 3, 5, 5, 5, 8, 9])), r.random()) for k in range(90)] + [("b", k, None if k % 3 else float(-k), 1.0) for k in range(9)] + [(None, 0, 2.0, 1.0), ("c", 1, float("nan"), 2.0), ("c", 2, 7.0, 3.0)]
    df = spark.createDataFrame(rows, "key string, id int, x double, y double").repartition(3)
    order = lambda x: (0, 0.0) if x is None else (2, 0.0) if x != x else (1, x)
    want = []
    for key in ("a", "b", "c", None):
        own = sorted((order(x), i) for k, i, x, _ in rows if k == key)
        for v, i in own:
            less, ties = sum(w < v for w, _ in own), sum(w == v for w, _ in own)
            want.append((key, i, less + (ties + 1) / 2))
    same(sorted(want, key=str), table(ranks.average_rank(df, "x", ["key"], "rank").select("key", "id", "rank")))
    import numpy as np

    own = [(x, y) for k, _, x, y in rows if k == "a"]
    rank = lambda v: [sum(w < x for w in v) + (sum(w == x for w in v) + 1) / 2 for x in v]
    rho = np.corrcoef(rank([x for x, _ in own]), rank([y for _, y in own]))[0, 1]
    got = {x.key: (x.n, x.rho) for x in ranks.spearman(df, "x", "y", ["key"]).collect()}
    assert got["a"] == (90, pytest.approx(rho, rel=1e-9)) and got["b"] == (3, None) and got[None] == (1, None)
    assert ranks.spearman(df.where("key = 'a'"), "x", "y", []).first().rho == pytest.approx(rho, rel=1e-9)


def test_correlations(spark):
    import numpy as np

    from barloom.operators.gram import correlations, item_correlations

    r = random.Random(2)
    rows = []
    for k in range(300):
        x = r.gauss(1e6, 1)
        rows.append((k, x, x * 2 + r.gauss(0, 1), None if k % 3 else r.random(), 7.0, float("nan") if k % 2 else -x, None))
    cols = ["p", "q", "holes", "same", "half", "none"]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in cols)).repartition(4)
    got = {(x.a, x.b): (x.n, x.r) for x in correlations(df, cols).collect()}
    assert list(got) and len(got) == 15
    for (i, a), (j, b) in ((x, y) for x in enumerate(cols) for y in enumerate(cols) if x[0] < y[0]):
        both = [(row[i + 1], row[j + 1]) for row in rows if all(v is not None and v == v for v in (row[i + 1], row[j + 1]))]
        n, value = got[a, b]
        assert n == len(both)
        if "same" in (a, b) or not both:
            assert value is None
        else:
            assert value == pytest.approx(np.corrcoef(*zip(*both, strict=True))[0, 1], rel=1e-6, abs=1e-6)
    long = df.selectExpr("id", "stack(3, 'p', p, 'q', q, 'holes', holes) AS (item, x)")
    items = {(x.a, x.b): (x.n, x.r) for x in item_correlations(long, ["id"], "item", "x", block=7).collect()}
    assert items == {("p", "q"): pytest.approx(got["p", "q"]), ("holes", "p"): pytest.approx(got["p", "holes"]), ("holes", "q"): pytest.approx(got["q", "holes"])}


def rule_rows(spark, n=2500):
    r = random.Random(12)
    rows = [(k * 40, r.choice(["A", "B", "1.0", None]), r.choice([None, float("nan"), r.random(), r.random()]), r.uniform(-1.1, 1.1), float(r.choice([0, 1, -1, 2, 1e300]))) for k in range(n)]
    return spark.createDataFrame(rows, "row long, symbol string, pos double, sig double, flag double").repartition(3)


TEXTS = [
    ["[pos] IS Low", "[sig] IS Bullish"], [], ["symbol is B, 1"], ["[pos] IS Low", "[pos] IS High"], ["[flag] IS Active (1)", "[pos] IS Very High", "symbol is A"],
    ["[sig] IS Exactly Zero (No Gap)"], ["[sig] IS Strong Positive", "[sig] IS Extreme Bullish"], ["[flag] IS Negative (-1)"], ["[pos] IS Low", "[pos] IS Low"],
]


def test_masks_from_the_index(spark):
    from barloom.operators import masks as K  # noqa: N812
    from barloom.operators import rules as R  # noqa: N812

    df = rule_rows(spark)
    rules = dict(enumerate(TEXTS))
    found = K.masks(K.index(df, "row", [c for _, c in K.conditions_of(rules)]), K.rule_conditions(spark, rules)).persist()
    want = {k: {x.row for x in df.where(R.rule_mask(t)).select("row").collect()} for k, t in rules.items()}
    got = {k: set() for k in rules}
    for x in K.matched(found).collect():
        got[x.rule].add(x.row)
    assert got == want and any(len(v) > 100 for v in want.values())
    pairs = {(x.a, x.b): (x.both, x.coefficient) for x in K.overlap(found).collect()}
    every = {(a, b): len(want[a] & want[b]) for a in want for b in want if a < b and want[a] & want[b]}
    assert pairs == {(a, b): (n, n / min(len(want[a]), len(want[b]))) for (a, b), n in every.items()}
    assert found.agg(F.max("bucket")).first()[0] > 2  # rows of several buckets


def test_many_rules_overlap(spark):
    """Far more rules in a row than 64."""
    from barloom.operators.search import overlap

    rows = [(rule, row) for rule in range(150) for row in range(0, 400, rule + 1)] * 2
    got = {(x.a, x.b): x.coefficient for x in overlap(spark.createDataFrame(rows, "rule long, row long")).collect()}
    for a, b in ((0, 149), (1, 2), (6, 9), (98, 100)):
        x, y = set(range(0, 400, a + 1)), set(range(0, 400, b + 1))
        assert got[a, b] == len(x & y) / min(len(x), len(y))
    assert len(got) == 150 * 149 // 2  # all of them match row 0


@pytest.mark.parametrize("held", [1 << 20, 300])
def test_rules_from_a_table(spark, monkeypatch, held):
    from barloom.operators import matcher
    from barloom.operators.search import match_dense

    monkeypatch.setattr(matcher, "HELD", held)
    r = random.Random(1)
    care = [4, 3, 7]
    rows = [(k, r.choice([None, 0, 1, 2, 3]), r.randrange(3), r.randrange(9)) for k in range(300)]
    pool = [(k, [r.randrange(5), r.randrange(4), r.randrange(8)]) for k in range(400)] + [(1000, care)]
    df = spark.createDataFrame(rows, "id int, a int, b int, c int").repartition(3)
    rules = spark.createDataFrame(pool, "rule long, genes array<int>")
    got = sorted((x.id, x.rule) for x in match_dense(df, [F.col("a"), F.col("b"), F.col("c")], rules, care).collect())
    want = sorted((row[0], k) for row in rows for k, genes in pool if all(g == d or g == x for g, d, x in zip(genes, care, row[1:], strict=True)))
    assert got == want and {k for _, k in got} >= {1000}


def test_assignment_of_a_thousand_rules(spark):
    """The first rule that matches, and a plan that doesn't grow with the rules."""
    from barloom.operators import rules as R  # noqa: N812

    df = rule_rows(spark, 400)
    r = random.Random(3)
    many = [[f"[pos] IS {r.choice(R.FAMILIES['positive'][0])}", f"[sig] IS {r.choice(R.FAMILIES['signed'][0])}", f"symbol is S{k}"] for k in range(1000)] + TEXTS[2:] + [TEXTS[1]]
    rules = [{"conditions": c, "tp": k + 1.0, "sl": 2.0, "capital_pct": 5.0} for k, c in enumerate(many)]
    out = R.assign(df, rules, use_context=False)
    first = F.coalesce(*(F.when(R.rule_mask(c), F.lit(k)) for k, c in enumerate(many) if k >= 1000))
    want = {x.row: x.k for x in df.select("row", first.alias("k")).where("k IS NOT NULL").collect()}
    assert {x.row: x.rule_index for x in out.collect()} == want and len(set(want.values())) > 3
    assert all(x.tp == x.rule_index + 1.0 for x in out.collect())
    plan = lambda x: len(x._jdf.queryExecution().optimizedPlan().toString())
    names = len(", ".join(f"S{k}" for k in range(1000)))
    assert plan(out) < plan(R.assign(df, rules[-5:], use_context=False)) + 40 * names
    table_ = spark.createDataFrame([(k, x["conditions"], x["tp"], x["sl"], x["capital_pct"]) for k, x in enumerate(rules)], "rule_index int, conditions array<string>, tp double, sl double, capital_pct double")
    assert {x.row: x.rule_index for x in R.assign(df, table_, use_context=False).collect()} == want


def peeled(points, violation):
    """Fronts by peeling. points: id to (group, objectives, violation)."""
    def beats(p, q):
        (_, a, v), (_, b, w) = points[p], points[q]
        if violation and (v > 0 or w > 0) and v != w:
            return v < w
        return None not in a + b and all(x <= y for x, y in zip(a, b, strict=True)) and a != b

    out, left, front = {}, set(points), 0
    while left:
        front += 1
        best = {q for q in left if not any(points[p][0] == points[q][0] and beats(p, q) for p in left)}
        out |= dict.fromkeys(best, front)
        left -= best
    return out


@pytest.mark.parametrize("width", [1, 2, 3])
@pytest.mark.parametrize("violation", [None, "v"])
def test_fronts_in_strips(spark, monkeypatch, width, violation):
    from barloom.operators import search as Q  # noqa: N812

    monkeypatch.setattr(Q, "STRIP", 16)
    r = random.Random(3)
    points = {k: ("ab"[k % 3 % 2], tuple(None if r.random() < 0.05 else float(r.randint(0, 9)) for _ in range(width)), float(max(0, r.randint(-4, 3)))) for k in range(120)}
    names = [f"f{j}" for j in range(width)]
    df = spark.createDataFrame([(k, g, v, *x) for k, (g, x, v) in points.items()], "id int, g string, v double, " + ", ".join(f"{n} double" for n in names))
    assert {x.id: x.front for x in Q.fronts(df, "id", names, "g", violation).collect()} == peeled(points, violation)
    one = {k: ("", x, v) for k, (_, x, v) in points.items()}
    assert {x.id: x.front for x in Q.fronts(df, "id", names, None, violation).collect()} == peeled(one, violation)


def test_fronts_of_a_long_chain(spark):
    from barloom.operators import search as Q  # noqa: N812

    df = spark.range(20_000).select("id", F.col("id").cast("double").alias("a"), (-F.col("id") % 2 + F.col("id")).cast("double").alias("b"))
    got = {r.id: r.front for r in Q.fronts(df, "id", ["a", "b"]).collect()}
    assert len(got) == 20_000 and max(got.values()) >= 10_000


def test_match_counts(spark):
    """Rules by pair and by count, with a class that is missing, equal rules, one without genes and one that meets no row."""
    from barloom.operators import search as Q  # noqa: N812

    rows = spark.createDataFrame([("a" if k % 3 else None, k % 4 if k % 7 else None, k % 2) for k in range(200)], "symbol string, x int, y int")
    rules = spark.createDataFrame([(1, [0, 2]), (2, [9, 2]), (3, [0, 2]), (4, [3, 1]), (5, [7, 2]), (6, [9, 0])], "rule long, genes array<int>")
    pairs = Q.match_dense(rows, [F.col("x"), F.col("y")], rules, [9, 2]).groupBy("rule", "symbol").agg(F.count("*").alias("n"))
    got = Q.match_counts(rows, [F.col("x"), F.col("y")], rules, [9, 2], ["symbol"])
    assert table(got) == table(pairs.select(*got.columns)) and {r.rule for r in got.collect()} == {1, 2, 3, 4, 6}


def test_largest_gap_in_strips(spark, monkeypatch):
    monkeypatch.setattr(S, "STRIP", 20)
    r = random.Random(9)
    rows = [(r.choice(["a", "b", None]), s, s + r.randint(-1, 12)) for s in (r.randint(0, 900) for _ in range(150))] + [("c", 0, 2000), ("c", 7, 8), ("c", 7, 7)]
    want = {}
    for symbol in {x[0] for x in rows}:
        reach, best = None, None
        for s, e in sorted([x[1:] for x in rows if x[0] == symbol] + [(1000, 1000)]):
            start = 5 if reach is None else reach + 1
            best = max(best or (-1, 0), (max(s - start, 0), -start))
            reach = e if reach is None else max(reach, e)
        want[symbol] = (-best[1], best[0])
    got = S.largest_gap(spark.createDataFrame(rows, "symbol string, s long, e long"), 5, 1000)
    assert {x[0]: (x[1], x[2]) for x in got.collect()} == want


def test_global_rank_in_strips(spark, monkeypatch):
    monkeypatch.setattr(S, "STRIP", 20)
    r = random.Random(4)
    rows = [(r.choice([None, 1.0, 2.0, 2.5]), k) for k in range(200)]
    got = {x.k: x.place for x in S.global_rank(spark.createDataFrame(rows, "x double, k int").repartition(3), ["x", "k"], "place").collect()}
    assert got == {k: n + 1 for n, (_, k) in enumerate(sorted(rows, key=lambda y: (y[0] is not None, y[0] or 0.0, y[1])))}


def test_orders_are_numbered_by_day(spark, tmp_path):
    """No window has the orders of a status; the plan has a slot beside it in each window over rows."""
    from barloom.plans.q_metrics import ordered

    at = dt.datetime(2024, 1, 1)
    rows = [(k, 1, "OFP"[k % 3], float(k), at + dt.timedelta(days=k * 7 % 40), "x") for k in range(90)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    df = ordered(spark, str(tmp_path))
    want = {}
    for status in "OFP":
        want |= {k: n for n, (_, k) in enumerate(sorted((x[4], x[0]) for x in rows if x[2] == status))}
    assert {x.o_orderkey: x.bar for x in df.collect()} == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert all("_slot" in line[line.index("], [") :] for line in plan.splitlines() if "row_number()" in line and "Window" in line)


@pytest.mark.parametrize("few", [0, 8, 1 << 16])
def test_spearman_of_wide_rows(spark, monkeypatch, few):
    from barloom.operators import features as X  # noqa: N812
    from barloom.operators import ranks as K  # noqa: N812

    monkeypatch.setattr(K, "FEW", few)
    monkeypatch.setattr(K, "STRIP", 20)
    r = random.Random(8)
    rows = [(r.choice(["a", "b", None]), r.choice([None, 1.0, 2.0]), float(r.randint(0, 40)), 7.0, r.choice([None, *(k / 4 for k in range(30))])) for _ in range(240)]
    df = spark.createDataFrame(rows, "symbol string, x double, y double, flat double, price double")
    long = K.spearman(X.long_form(df, ["x", "y", "flat"], ["symbol", "price"]), "x", "price", ["feature", "symbol"])
    same(table(long.select("feature", "symbol", "n", "rho")), table(K.spearman_wide(df, ["x", "y", "flat"], "price", ["symbol"])))
