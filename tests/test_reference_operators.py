"""Edge cases of the tape operators, and the simulator against a plain account."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from barloom.functions.identity import identity, row_identity
from barloom.operators import evolve as E  # noqa: N812
from barloom.operators import features as X  # noqa: N812
from barloom.operators import indicators as I  # noqa: E741, N812
from barloom.operators import labels as L  # noqa: N812
from barloom.operators import rules as R  # noqa: N812
from barloom.operators import simulate as A  # noqa: N812
from barloom.operators import splits as S  # noqa: N812
from barloom.sources import tape as T  # noqa: N812


@pytest.fixture(scope="module")
def bars(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for s, n in (("AA", 40), ("BB", 30), ("ONE", 1)):
        price = 100.0
        for k in range(n):
            o, price = price, price * (1 + 0.03 * ((k * 7 + len(s)) % 5 - 2) / 2)
            rows.append((t0 + dt.timedelta(hours=4 * k), s, o, max(o, price) * 1.01, min(o, price) * 0.99, price, 10.0 + k))
    return T.with_bar_index(spark.createDataFrame(rows, "datetime timestamp, symbol string, open double, high double, low double, close double, volume double"))


def test_predicates_are_right_closed(spark):
    df = spark.createDataFrame([(0.2,), (0.2000001,), (0.8,), (None,), (float("nan"),), (-0.25,), (0.0,)], "x double")
    one = df.select("x", *(R.predicate(F.col("x"), n).alias(n) for n in ("Very Low", "Low", "High", "Strong Negative", "Exactly Zero"))).collect()
    assert [r["Very Low"] for r in one] == [True, False, False, False, False, True, True]
    assert one[1]["Low"] and one[2]["High"] and one[5]["Strong Negative"] and one[6]["Exactly Zero"]
    assert df.select(R.bucket(F.col("x"), "positive", False).alias("k")).first().k == 1
    for bad in ("x IS Low", "[x] IS Nothing"):
        with pytest.raises(ValueError):
            R.predicate(F.col("x"), R.parse_condition(bad)[1])


def test_symbols(spark):
    assert R.parse_symbols("Symbol IS 1.0, 'b'") == ["1", "b"] and R.parse_symbols("[x] IS Low") is None
    texts = ["'1.0'", " symbol A ", "[b]", "nan", "", "1.5", "+1", "01", "1e3", "[ 2.0 ]", "-0.0", "1d", "'x", "\"SYMBOL 7\"", "1.", "inf"]
    want = ["1", "A", "b", "nan", "", "1.5", "1", "1", "1000", "2", "0", "1d", "'x", "7", "1", "inf"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, None)], "k int, s string").orderBy("k")
    assert [r[0] for r in df.select(R.normalize_symbol(F.col("s"))).collect()] == [*want, R.MISSING]
    assert [R.symbol_text(t) for t in texts] == want
    assert R.parse_symbols("[symbol] IS +1, 01,1e3") == ["1", "1", "1000"] and R.parse_symbols("symbolic is 1") is None and R.parse_symbols("symbol isnt 1") is None
    with pytest.raises(ValueError):
        R.parse_symbols("symbol is 1,,2")
    with pytest.raises(ValueError):
        R.split_conditions([f"symbol is {k}" for k in range(11)])
    for label in ("Active", "Inactive"):
        with pytest.raises(ValueError):
            R.predicate(F.col("s"), label)


def test_labels_and_tail(bars):
    lab = L.add_labels(bars, 6).collect()
    for s, n in (("AA", 40), ("BB", 30), ("ONE", 1)):
        mine = sorted((r for r in lab if r.symbol == s), key=lambda r: r.bar)
        assert [r.label_min_h is None for r in mine] == [k + 6 >= n for k in range(n)]
        for k in range(n - 6):
            ahead = mine[k + 1 : k + 7]
            assert mine[k].label_max_h == max(r.high for r in ahead) and mine[k].label_close_h == ahead[-1].close
            hi, lo = [r.high for r in ahead], [r.low for r in ahead]
            assert mine[k].label_max_first == int(hi.index(max(hi)) < lo.index(min(lo)))
    assert L.drop_tail(bars, 6).count() == 58


def test_barrier(bars):
    got = {(r.symbol, r.bar, r.direction, r.tp): r for r in L.barrier(bars, 6, [(2.0, 1.5), (5.0, 4.0)]).collect()}
    rows = {}
    for r in bars.collect():
        rows.setdefault(r.symbol, {})[r.bar] = r
    for (s, k, d, tp), r in got.items():
        sl = {2.0: 1.5, 5.0: 4.0}[tp]
        if k + 6 not in rows[s]:
            assert (r.return_pct, r.exit_offset) == (None, -1)
            continue
        entry, sign, want = rows[s][k + 1].open, 1 if d == "long" else -1, None
        for o in range(1, 7):
            b = rows[s][k + o]
            good, bad = (b.high, b.low) if d == "long" else (b.low, b.high)
            if sign * (bad - entry * (1 - sign * sl / 100)) <= 0:
                want = (-sl, o)
            elif sign * (good - entry * (1 + sign * tp / 100)) >= 0:
                want = (tp, o)
            if want:
                break
        want = want or (sign * (rows[s][k + 6].close / entry - 1) * 100, 6)
        assert (pytest.approx(want[0]), want[1]) == (r.return_pct, r.exit_offset)


def test_as_of_is_inclusive_and_causal(spark, bars):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    states = spark.createDataFrame([("AA", t(8), 1), ("AA", t(12), -1), ("BB", t(4), 0)], "symbol string, close_time timestamp, state int")
    got = {(r.symbol, r.bar): r.s for r in I.as_of(bars, states, F.col("datetime"), "s").collect()}
    assert [got["AA", k] for k in range(5)] == [2, 2, 1, -1, -1] and got["BB", 0] == 2 and got["BB", 1] == 0 and got["ONE", 0] == 2


def test_indicators_warm_up(bars):
    df = I.structural_inputs(bars, 6).where("symbol = 'ONE' OR bar < 5")
    assert df.where("efficiency IS NOT NULL OR rv IS NOT NULL OR spread IS NOT NULL").count() == 0
    full = I.enrich(bars, 4, ("12 hours", 3), ("1 day", 6), "4 HOURS")
    assert full.count() == 71 and full.where("hwc_state NOT IN (-1, 0, 1, 2)").count() == 0


def plain_account(entries, fee=0.2, initial=1000.0):
    equity, open_, log = initial, [], []
    for e in sorted(entries, key=lambda e: (e["time_rank"], e["rule_index"], e["symbol_priority"], e["row_id"])):
        for p in [p for p in open_ if p[0] <= e["row_id"]]:
            open_.remove(p)
            equity += p[2]
        if equity <= 0:
            break
        if any(p[3] == e["symbol"] for p in open_):
            continue
        n = min(equity * e["capital_pct"] / 100, max(0.0, equity - sum(p[1] for p in open_)))
        if n >= 1:
            open_.append((e["release_row"], n, n * e["return_pct"] / 100 - n * fee / 100, e["symbol"]))
            log.append(n)
    return equity + sum(p[2] for p in open_), log


def test_simulator(spark):
    rows = [
        dict(plan="p" if k % 2 else "q", symbol="ABC"[k % 3], direction="long", rule_index=k % 2, row_id=k, release_row=k + 1 + k % 7, capital_pct=30.0 + k % 50, return_pct=float((k * 37) % 21 - 9), entry_price=100.0 + k, exit_reason="TP", time_rank=k // 3, symbol_priority=0)
        for k in range(120)
    ]
    log = A.simulate(spark.createDataFrame(rows), {"plan": "string"}, A.Account())
    for r in A.account_metrics(log, ["plan"]).collect():
        equity, trades = plain_account([x for x in rows if x["plan"] == r["plan"]])
        assert r.final_equity == pytest.approx(equity) and r.trades == len(trades)
    ruin = [dict(rows[1], row_id=k, release_row=k + 1, capital_pct=100.0, return_pct=-120.0, time_rank=k) for k in range(4)]
    assert A.account_metrics(A.simulate(spark.createDataFrame(ruin), {"plan": "string"}, A.Account()), ["plan"]).first().trades == 1


def test_joint_reverses():
    e = dict(symbol="A", rule_index=0, capital_pct=50.0, entry_price=100.0, exit_reason="TP", return_pct=5.0, release_row=99)
    log = A.run_account([e | {"direction": "long", "row_id": 0}, e | {"direction": "long", "row_id": 1}, e | {"direction": "short", "row_id": 2, "entry_price": 110.0}], A.Account(joint=True, fee_pct=0.0))
    assert [x["status"] for x in log] == ["skipped_same_side", "closed", "closed"]
    assert log[1]["exit_reason"] == "Reverse" and log[1]["return_pct"] == pytest.approx(10.0) and log[2]["equity_after"] == pytest.approx(1050 + 525 * 0.05)


def test_splits(bars):
    df = S.holdout(bars, 0.5, 3)
    n = {(r.symbol, r.split): r["count"] for r in df.groupBy("symbol", "split").count().collect()}
    assert n == {("AA", "train"): 20, ("AA", "val"): 17, ("BB", "train"): 15, ("BB", "val"): 12}
    ids = [r.row_id for r in S.row_ids(bars).orderBy("datetime", "symbol").collect()]
    assert ids == list(range(71))
    b = S.fold_bounds(bars.where("symbol <> 'ONE'"), 2, 0.3, 0.4, 4)
    rows = S.fold_rows(bars, b)
    clash = rows.where("role = 'train'").groupBy("symbol", "fold").agg(F.max("bar").alias("t")).join(rows.where("role = 'valid'").groupBy("symbol", "fold").agg(F.min("bar").alias("v")), ["symbol", "fold"])
    assert clash.where("v - t <= 4").count() == 0 and clash.count() == 6
    one = S.aligned_sample(bars.where("symbol <> 'ONE'"), 8, 3)
    assert one.count() == 16 and one.select("bar").distinct().count() == 8


def test_sources(spark, bars, tmp_path):
    path = str(tmp_path / "tape")
    T.write_csv(bars.select(*T.TAPE_SCHEMA.fieldNames()), path)
    again = T.read_csv(spark, path)
    assert again.count() == 71 and again.schema == T.TAPE_SCHEMA and T.csv_columns(spark, path) == T.TAPE_SCHEMA.fieldNames()
    assert T.read_csv(spark, path, columns=["symbol"]).distinct().count() == 3
    with pytest.raises(ValueError):
        T.write_csv(bars, path, overwrite_source=path)
    T.write_splits(S.holdout(bars, 0.5, 3), str(tmp_path / "splits"))
    assert T.read_split(spark, str(tmp_path / "splits"), "val").count() == 29
    for k in range(2):
        T.append_ledger(spark, {"run": k}, str(tmp_path / "ledger"))
    assert sorted(json.loads(r.value)["run"] for r in spark.read.text(str(tmp_path / "ledger")).collect()) == [0, 1]
    m = T.file_manifest(spark, path, bars)
    assert m["n_rows"] == 71 and m["symbols"] == "AA,BB,ONE" and m["bytes"] > 1000 and len(m["sha256"]) == 64 and m == T.file_manifest(spark, path, bars)


def test_selection_and_identity(spark):
    assert X.greedy_uncorrelated(["a", "b", "c"], {("a", "b"): 0.99, ("b", "c"): 0.5}) == ["a", "c"]
    a, b = X.capped_overlap({"x": 3, "y": 2, "z": 1, "w": 0.5, "u": 0.4}, {"x": 1, "y": 3, "z": 2, "v": 0.5, "t": 0.4}, 3, 0.5)
    assert len(a) == len(b) == 3 and len(set(a) & set(b)) <= 2
    df = spark.createDataFrame([(1, "a")], "k long, s string")
    assert df.select(row_identity(16, k=F.col("k"), s=F.col("s"))).first()[0] == identity({"k": 1, "s": "a"})


def test_evolution():
    goal = (1, 0, 2, 3, 3, 3)
    score = lambda gs: [(float(sum(x != y for x, y in zip(g, goal, strict=True))), float(sum(x != 3 for x in g))) for g in gs]
    run = lambda: E.evolve(score, [3] * 6, E.softmax_weights([1.0] * 6), 20, 8, seed=4)
    best = run()
    assert best == run() and all(2 <= sum(x != 3 for x in g) <= 4 for g, _ in best) and min(s[0] for _, s in best) <= 1
    assert E.compose_team([1, 2, 3], lambda t: sum(t) - len(t) ** 2) == [3]
    assert E.farthest_subset([(0, 0), (0, 1), (1, 1)], 2) == [(0, 0), (1, 1)]


def test_stream_bars(spark, tmp_path):
    from barloom.streaming.bars import stream_bars

    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(minutes=7 * k), "AB"[k % 2], float(k)) for k in range(200)] + [(t0 + dt.timedelta(days=9), "A", 1.0)]
    df = spark.createDataFrame(rows, "ts timestamp, s string, x double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = stream_bars(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "s", "ts", "x", "1 hour", "10 minutes").writeStream.format("memory").queryName("bars_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    want = T.bars_from_ticks(df.where("ts < '2024-01-05'"), "s", "ts", "x", "1 hour").drop("ticks")
    assert spark.table("bars_out").drop("ticks").exceptAll(want).count() == 0 and spark.table("bars_out").count() == want.count()


def test_reference_points_and_niches():
    assert len(E.reference_points(3, 4)) == 15 and all(abs(sum(p) - 1) < 1e-12 for p in E.reference_points(3, 4))
    scores = [(float(k), 10.0 - k) for k in range(11)] + [(5.5 + k, 9.0 + k) for k in range(4)]
    keep = E.niche_survivors(scores, 5, E.reference_points(2, 4))
    assert len(set(keep)) == 5 and all(k < 11 for k in keep) and {0, 10} <= set(keep)
    assert set(E.niche_survivors(scores, 12, E.reference_points(2, 4))) >= set(range(11))


def test_search_resumes_and_caches():
    goal, seen = (1, 0, 2, 3, 3, 3), []

    def score(gs):
        seen.extend(gs)
        return [(float(sum(x != y for x, y in zip(g, goal, strict=True))), float(sum(x != 3 for x in g))) for g in gs]

    run = lambda n, state=None, **k: E.evolve(score, [3] * 6, E.softmax_weights([1.0] * 6), 20, n, seed=4, patience=99, state=state, **k)
    whole, state = run(6), {}
    run(3, state)
    assert state["generation"] == 3
    assert run(6, json.loads(json.dumps(state))) == whole
    assert run(4, points=E.reference_points(2, 6))
    cache = E.Cache(5)
    run(2, cache=cache)
    assert len(cache.kept) == 5
    del seen[:]
    both = E.evolve_islands(lambda d: {n: score(g) for n, g in d.items()}, ["a", "b"], [3] * 6, E.softmax_weights([1.0] * 6))
    assert set(both) == {"a", "b"} and min(s[0] for _, s in both["a"] + both["b"]) <= 2
    moved = E.migrate({"a": [((1,), (0.0,)), ((2,), (1.0,))], "b": [((1,), (0.0,))], "c": []})
    assert moved["b"] == [(2,)] and moved["c"] == [(1,), (2,)]
    assert E.archive_pool([((1,), (2.0,)), ((1,), (1.0,)), ((2,), (0.0,)), ((3,), (5.0,))], lambda gs: [g != (2,) for g in gs], 2) == [(1,), (3,)]
    trials = E.search_trials({"a": [1, 2, 3], "b": [1, 2]}, lambda xs: [float(x["a"] * x["b"]) for x in xs], 20)
    assert len(trials) == 6 and trials[0] == (6.0, {"a": 3, "b": 2})
    assert E.balanced_score(2.0, 0.0) == 0.0


def strategy(**more) -> dict:
    return {"direction": "long", "rules_set": [{"tp": "2", "sl": 1, "capital_pct": 60, "conditions": ["[x] IS Low", "symbol is A, 1.0", *G_CONTEXT]}]} | more


G_CONTEXT = ["[tf_permission_long] IS Active (1)", "[lwc_pullback_reversal_long] IS Active (1)"]


def test_strategy_files(spark, tmp_path):
    from barloom.operators import strategy as Y  # noqa: N812

    path = f"file://{tmp_path}/out/long.json"
    Y.write(spark, strategy(note="dropped", strategy_id="s1"), path)
    again = Y.read(spark, path)
    assert again == {"direction": "long", "rules_set": [strategy()["rules_set"][0] | {"tp": 2.0, "sl": 1.0, "capital_pct": 60.0}], "strategy_id": "s1"}
    assert set(json.loads((tmp_path / "out/evaluator_clean/long_evaluator_clean.json").read_text())) == {"direction", "rules_set"}
    rule = strategy()["rules_set"][0]
    for bad in (
        {"direction": "up"}, {"rules_set": []}, {"rules_set": "x"}, {"rules_set": [rule | {"tp": "a"}]}, {"rules_set": [rule | {"tp": 0, "sl": 0, "capital_pct": 0}]}, {"rules_set": [rule | {"conditions": []}]},
        {"rules_set": [rule | {"conditions": ["x IS Low"]}]}, {"rules_set": [rule | {"conditions": [*rule["conditions"], G_CONTEXT[0]]}]}, {"rules_set": [rule | {"conditions": ["[tf_permission_short] IS Active (1)"]}]}, {"rules_set": [{"tp": 1}]},
    ):
        with pytest.raises(Y.StrategyError):
            Y.check(strategy(**bad))
    with pytest.raises(Y.StrategyError):
        Y.check(strategy(rules_set=[rule | {"conditions": ["[x] IS Low"]}]), require_context=True)
    with pytest.raises(Y.StrategyError):
        Y.read(spark, f"file://{tmp_path}/none.json")
    assert Y.check(strategy(rules_set=[], deployment_accepted=False))["rules_set"] == []
    assert len(Y.check(strategy(rules_set=[rule] * 30))["rules_set"]) == 20
    assert Y.check(strategy(rules_set=[rule] * 30))["dropped_rules"] == [rule] * 10 and "dropped_rules" not in Y.check(strategy())
    assert Y.compile_rules({"TRADE_CAPITAL_PCT": 7, "rules_set": [{"tp": 1, "sl": 2, "conditions": ["[x] IS Low"]}]}) == [{"conditions": ["[x] IS Low"], "tp": 1.0, "sl": 2.0, "capital_pct": 7.0}]
    with pytest.raises(Y.StrategyError):
        Y.compile_rules({"rules_set": [{"tp": 1, "sl": 2}]})
    done = Y.assemble("long", [rule, rule | {"capital_pct": 90.0}], 96, "net")
    assert sum(r["capital_pct"] for r in done["rules_set"]) == pytest.approx(100) and len(done["strategy_id"]) == 20
    with pytest.raises(Y.StrategyError):
        Y.assemble("long", [rule | {"conditions": ["[x] IS Low"]}], 96, "net")
    assert Y.fail_closed(spark, f"file://{tmp_path}/closed", "short", "nothing passed")["deployment_accepted"] is False
    assert json.loads((tmp_path / "closed/evaluator_clean/short_evaluator_clean.json").read_text())["rules_set"] == []
    assert [len(R.split_conditions(r["conditions"])[1]) for r in Y.specialised({"conditions": ["[x] IS Low"]}, ["A", "B"])] == [1, 1, 2]


def test_runs(spark, bars, tmp_path):
    from barloom.sources import runs as U  # noqa: N812

    at = f"file://{tmp_path}"
    config = {"fraction": 0.5}
    (tmp_path / "tape.csv").write_text("x")
    splits = {s: bars for s in U.SPLITS}
    b = S.nested_bounds(bars.where("symbol <> 'ONE'"), 2, 0.4, 4)
    manifest = U.fold_manifest(b, config, 71)
    assert manifest["n_folds"] == 2 and [f["is_holdout"] for f in manifest["folds"]] == [False, True]
    U.write_splits(spark, splits, f"{at}/cache", manifest)
    get = lambda **k: U.fresh_splits(spark, f"{at}/cache", f"{at}/tape.csv", **({"config": config, "columns": ["bar"]} | k))
    assert get()["val"].count() == 71 and get(reference_rows=71) and not get(config={"fraction": 0.6}) and not get(columns=["no"]) and not get(reference_rows=70)
    import os
    import time

    os.utime(tmp_path / "tape.csv", (time.time() + 60, time.time() + 60))
    assert get() is None
    run = U.Run(spark, f"{at}/run", config)
    run.log("features", "started")
    run.finish("features", {"names": ["a"]})
    assert run.resume("features", ("names",)) == {"names": ["a"]} and run.resume("features", ("other",)) is None
    other = U.Run(spark, f"{at}/run", {"fraction": 0.7})
    assert other.id != run.id and other.resume("features") is None and other.drop_stale(["features", "rules"]) == ["features"]
    assert [(r.phase, r.status) for r in run.phases().orderBy("at").collect()] == [("features", "started"), ("features", "done")]
    U.claim_once(spark, f"{at}/locks", "abc")
    with pytest.raises(RuntimeError):
        U.claim_once(spark, f"{at}/locks", "abc")
    U.check_enriched(spark, "tape.csv", f"{at}/none", "v1")
    for text in (None, "{", "{}", '{"context_algorithm_version": "v0"}'):
        if text:
            (tmp_path / "m.json").write_text(text)
        with pytest.raises(RuntimeError):
            U.check_enriched(spark, "t_hwc_mwc_lwc.csv", f"{at}/m.json", "v1")
    (tmp_path / "m.json").write_text('{"context_contract": {"algorithm_version": "v1"}}')
    U.check_enriched(spark, "t_hwc_mwc_lwc.csv", f"{at}/m.json", "v1")
    assert U.count_trials({"a": [1, 2], "b": {"archive_size": 3, "generations": 4}}, {"x": {"selected_rules": 2, "risk_history": [1]}}) == 12
    good = {"initial": 1, "fee_pct": 0.2, "horizon": 96, "embargo": 96, "min_rules": 1, "max_rules": 20, "fraction": 0.65, "folds": 3, "max_exposure_pct": 100}
    assert U.check_config(good, U.CONFIG_CHECKS) == [] and U.check_config(good | {"embargo": 5, "fraction": None}, U.CONFIG_CHECKS) == ["embargo_covers_horizon", "split_fraction"]
    m = spark.createDataFrame([("train", 1.0), ("val", 2.0)], "split string, ret double")
    U.evaluation_outputs(spark, m, bars, f"{at}/eval")
    assert len(json.loads((tmp_path / "eval/summary.json").read_text())) == 2 and spark.read.csv(f"{at}/eval/trades", header=True).count() == 71
    assert U.split_report(spark, m.where("split = 'val'"), f"{at}/oos.json", "long", "val", True)["diagnostic_only"]
    t = U.enrichment_manifest({"lwc": m.limit(1)}, "v1", "tape.csv")
    assert len(t["threshold_hash"]) == 16


def test_load(spark, bars, tmp_path):
    from barloom.sources import load as D  # noqa: N812

    raw = bars.where("symbol <> 'ONE'").drop("bar").withColumn("ff", F.when(F.col("volume") > 15, F.col("volume")))
    raw.write.csv(str(tmp_path / "tape.csv"), header=True)
    got = D.load(spark, str(tmp_path / "tape.csv"), 6)
    assert got.count() == 58 and got.where("ff IS NULL").count() == 0 and D.feature_columns(got) == ["ff"]
    assert got.groupBy("symbol").agg(F.max("bar").alias("m")).where("m NOT IN (33, 23)").count() == 0
    assert D.prepare(D.prepare(raw, 6, tail=False).drop("bar"), 6, tail=False).count() == 58  # labels are kept
    with pytest.raises(ValueError):
        D.prepare(raw.withColumn("label_min_h", F.lit(1.0)), 6)
    with pytest.raises(ValueError):
        D.prepare(raw.drop("close"), 6)
    with pytest.raises(ValueError):
        D.prepare(raw.union(raw), 6)
    with pytest.raises(ValueError):
        D.prepare(raw, 6, context=True)
    rich = I.enrich(T.with_bar_index(raw), 4, ("12 hours", 3), ("1 day", 6), "4 HOURS")
    assert D.prepare(rich, 6).count() == 58
    with pytest.raises(ValueError):
        D.prepare(rich.withColumn("tf_permission_long", F.lit(1)), 6)
    wide = D.prepare(raw, 6, barriers=([2.0, 1.5], [1.0]))
    assert L.pair_name("short", 1.5, 1, "off") == "_off_short_tp1.5_sl1" and {L.pair_name(d, tp, 1.0, w) for d in ("long", "short") for tp in (1.5, 2.0) for w in ("ret", "off")} <= set(wide.columns)
    assert D.grid_faults(raw, 240).where("n_gaps + n_off_grid + n_duplicates + n_null_ts > 0").count() == 0
    assert D.grid_faults(raw.where("symbol = 'AA' AND volume <> 20").union(raw.limit(1)), 60).first()["n_gaps"] > 0
    rows, modes = D.for_evaluation(got.drop("bar"), raw, spark.createDataFrame([("ff", "positive"), ("zz", "signed")], "feature string, mode string"), 6)
    assert rows.count() == 58 and modes.count() == 1
    assert D.forward_symbols(raw, raw.withColumn("datetime", F.col("datetime") + F.expr("INTERVAL 90 DAYS"))).first().asDict() == {"same_symbols": True, "later": True}
    assert dict(D.downcast(rich.withColumn("x", F.lit(1.5))).dtypes)["x"] == "float"
    with pytest.raises(ValueError):
        I.enrich_target(raw, raw.limit(1), 4, ("12 hours", 3), ("1 day", 6), "4 HOURS", {})


def test_ema_matches_the_recursion(spark):
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), 100.0 + ((k * 37) % 23) - 11) for s, n in (("A", 900), ("B", 1)) for k in range(n)]
    df = I.ema(spark.createDataFrame(rows, "symbol string, datetime timestamp, close double"), {"one": 1, "two": 2, "slow": 50})
    got = {(r.symbol, r.datetime): r for r in df.collect()}
    for name, span in (("one", 1), ("two", 2), ("slow", 50)):
        y, a = None, 2 / (span + 1)
        for s, t, x in rows:
            y = x if y is None or s == "B" else a * x + (1 - a) * y
            assert got[s, t][name] == pytest.approx(y, rel=1e-11)


def test_release_rows_with_gaps(spark):
    df = spark.createDataFrame([("A", b, k, o) for k, (b, o) in enumerate([(0, 2), (1, 2), (5, 0), (6, -1), (9, 4)])], "symbol string, bar long, row_id long, off int")
    got = {r.bar: r.release_row for r in S.release_rows(df, F.col("off")).collect()}
    assert got == {0: 2, 1: 2, 5: 2, 6: None, 9: None}


def test_ruin_is_for_good():
    e = dict(symbol="A", direction="long", rule_index=0, capital_pct=60.0, entry_price=1.0, exit_reason="TP")
    entries = [e | {"row_id": 0, "release_row": 5, "return_pct": -200.0}, e | {"symbol": "B", "row_id": 1, "release_row": 5, "return_pct": 300.0, "capital_pct": 40.0}, e | {"row_id": 6, "release_row": 7, "return_pct": 1.0}]
    log = A.run_account(entries, A.Account(fee_pct=0.0))
    assert [x["status"] for x in log] == ["closed", "closed", "after_ruin"] and log[1]["equity_after"] == pytest.approx(1000.0)


def test_fronts_and_crowding(spark):
    from barloom.operators import search as Q  # noqa: N812

    df = spark.createDataFrame([(0, 1.0, 4.0), (1, 2.0, 2.0), (2, 4.0, 1.0), (3, 3.0, 3.0), (4, 4.0, 4.0), (5, float("nan"), 0.0)], "id int, a double, b double")
    assert {r.id: r.front for r in Q.fronts(df, "id", ["a", "b"]).collect()} == {0: 1, 1: 1, 2: 1, 3: 2, 4: 3, 5: 1}
    flat = spark.createDataFrame([(k, 1, 7.0, float(k * k)) for k in range(4)] + [(9, 2, 1.0, 1.0)], "id int, front int, a double, b double")
    got = {r.id: r.crowding for r in Q.crowding(flat, "id", ["a", "b"]).collect()}
    assert got[0] == got[3] == got[9] == float("inf") and got[1] == pytest.approx(4 / 9) and got[2] == pytest.approx(8 / 9)


def test_gates_amplify():
    from barloom.operators import gates as G  # noqa: N812

    value = {"a": 3.0, "b": 2.0, "c": 1.0, "d": 5.0}
    team = lambda teams: [(sum(value[x] for x in t), sum(value[x] for x in t), "d" not in t) for t in teams]
    assert G.amplify(["a", "b", "c", "d"], {("a", "b"): 0.9}, team) == ["a", "c"]
    assert G.amplify(["d"], {}, team) == []
    assert G.stage_budget(100) == (65, 35) and G.stage_at(65, 100) == ("B", 35, True) and G.stage_at(10, 100) == ("A", 55, False) and G.stage_at(5, 20, two_stages=False) == (None, 15, False)
    assert G.search_floors("A", 30)["min_support"] == 8 and G.search_floors("B", 30)["min_support"] == 30 and G.scaled_floor(60, 500, 1000) == 30


def test_deflated_sharpe_by_hand(spark):
    import math

    from barloom.operators import metrics as M  # noqa: N812

    df = spark.createDataFrame([(0.2, 100.0), (-0.1, 1.0), (1.5, 50.0)], "sr double, n double")
    for skew, kurt, trials in ((0.0, 0.0, 1), (0.5, 2.0, 20)):
        for r in df.select("sr", "n", M.deflated_sharpe(F.col("sr"), F.col("n"), trials, skew, kurt).alias("p")).collect():
            n = max(2, r.n)
            z = (r.sr - math.sqrt(2 * math.log(trials)) / math.sqrt(n)) / math.sqrt(max(1e-12, (1 - skew * r.sr + (kurt - 1) / 4 * r.sr**2) / n))
            assert r.p == pytest.approx(0.5 * (1 + math.erf(z / math.sqrt(2))), abs=2e-7)


def test_deflated_sharpe_of_infinite_ratios(spark):
    from barloom.operators import metrics as M  # noqa: N812

    df = spark.createDataFrame([(float("-inf"), 84.0), (float("inf"), 84.0)], "sr double, n double")
    got = {r.sr: (r.p, r.q) for r in df.select("sr", M.deflated_sharpe(F.col("sr"), F.col("n"), 50).alias("p"), M.deflated_sharpe(F.col("sr"), F.col("n"), 50, 0.3, 1.2).alias("q")).collect()}
    assert got[float("-inf")][0] == 0.0 and got[float("inf")][0] == 1.0 and all(q != q for _, q in got.values())


def test_sharpe_of_equal_returns(spark):
    from barloom.operators import metrics as M  # noqa: N812

    rows = [("down", -8.0), ("down", -8.0), ("up", 2.0), ("up", 2.0), ("zero", 0.0), ("zero", 0.0), ("one", 3.0), ("some", 1.0), ("some", 3.0)]
    got = {r.k: r.s for r in spark.createDataFrame(rows, "k string, r double").groupBy("k").agg(M.sharpe(F.col("r")).alias("s")).collect()}
    assert got["down"] == float("-inf") and got["up"] == float("inf") and got["zero"] != got["zero"] and got["one"] is None and got["some"] == pytest.approx(2 / 2**0.5)


def test_running_equity(spark, tmp_path):
    from barloom.streaming.bars import running_equity

    rows = [("p", k, float((k * 7) % 5 - 2) * 10) for k in range(30)] + [("q", k, -400.0) for k in range(3)]
    df = spark.createDataFrame(rows, "plan string, seq long, pnl double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = running_equity(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "plan", "pnl").writeStream.format("memory").queryName("equity_out").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.plan: (r.equity, r.drawdown_pct) for r in spark.table("equity_out").collect()}
    assert got["p"][0] == pytest.approx(1000 + sum(x for p, _, x in rows if p == "p")) and got["q"] == (pytest.approx(-200.0), pytest.approx(120.0))
