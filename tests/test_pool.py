"""Pools and archives of candidates, loaders, array functions, against plain versions."""

import datetime as dt
import random
import statistics
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from barloom.functions.arrays import bincount, searchsorted, strip_zone
from barloom.operators import pool as P  # noqa: N812

N = 6


def candidates(n=120, seed=3):
    r = random.Random(seed)
    return [(k, [r.choice([0, 1, 2, 3, None if g == 5 else 0]) for g in range(N)], r.uniform(0, 9), r.randrange(1, 4)) for k in range(n)]


SCHEMA = "id int, g array<int>, score double, front int"


def apart(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True))


def test_nearest_distance(spark):
    rows, archive = candidates(), candidates(9, 5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    known = spark.createDataFrame([(g,) for _, g, *_ in archive] * 2 + [([9] * N,)], "g array<int>")
    got = {x.id: x.nearest for x in P.nearest_distance(df, "g", known, N).collect()}
    assert got == {k: min(min(apart(g, h) for _, h, *_ in archive), apart(g, [9] * N)) for k, g, *_ in rows} and len(set(got.values())) > 3
    far = spark.createDataFrame([([9] * N,)], "g array<int>")
    assert {x.nearest for x in P.nearest_distance(df, "g", far, N).collect()} == {N}
    assert {x.nearest for x in P.nearest_distance(df, "g", known.where("false"), N).collect()} == {None}


def test_diversity_penalty(spark):
    rows = candidates()
    df = spark.createDataFrame(rows, SCHEMA)
    refs = [x for x in rows if x[3] == 1]
    got = {x.id: x.penalty for x in P.diversity_penalty(df, df.where("front = 1"), N, 2, {"score": 0.25}, 0.5).collect()}
    for k, g, score, _ in rows:
        near = any(0 < apart(g, h) <= 2 for _, h, *_ in refs)
        same = any(g != h and int(s / 0.25) == int(score / 0.25) for _, h, s, _ in refs)
        assert got[k] == (0.5 if near or same else 0.0)
    assert set(got.values()) == {0.0, 0.5}


def test_archive(spark, tmp_path):
    folder, features = f"file://{tmp_path}", [("x", "positive"), ("y", "binary")]
    order = [F.desc("score"), F.col("id")]
    rows = spark.createDataFrame(candidates(), SCHEMA)
    assert P.load_archive(spark, folder, "long", features) is None
    P.save_archive(spark, folder, "long", features, rows.where("id % 2 = 0"), ["g"], order, 30)
    P.save_archive(spark, folder, "long", features, rows.where("id % 2 = 1"), ["g"], order, 30, shared=True)
    best: dict = {}
    for k, g, score, _ in sorted(candidates(), key=lambda x: (-x[2], x[0])):
        best.setdefault(tuple(g), (score, k))
    first = sorted(best.values(), key=lambda x: (-x[0], x[1]))[:30]
    assert [(x.score, x.id) for x in P.load_archive(spark, folder, "long", features).orderBy(*order).collect()] == first
    for other in ([("x", "signed"), ("y", "binary")], features[::-1], []):
        assert P.load_archive(spark, folder, "long", other) is None
    assert P.load_archive(spark, folder, "short", features) is None
    (tmp_path / ".archive_long.json.crc").unlink(missing_ok=True)
    (tmp_path / "archive_long.json").write_text("{not json")
    assert P.load_archive(spark, folder, "long", features) is None
    assert P.save_archive(spark, folder, "long", features, rows.where("false"), ["g"], order, 5).count() == 0
    assert P.load_archive(spark, folder, "long", features) is None
    with pytest.raises(ValueError):
        P.save_archive(spark, folder, "up", features, rows, ["g"], order, 5)


def test_cache(spark):
    pool = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "id int, k string")
    cache = spark.createDataFrame([("a", 1.0, 5), ("z", 2.0, 1), ("y", 3.0, 2)], "k string, figure double, age int")
    assert sorted(x.k for x in P.misses(pool, cache, ["k"]).collect()) == ["b", "c"]
    assert sorted((x.id, x.known) for x in P.looked_up(pool, cache, ["k"]).collect()) == [(1, True), (2, False), (3, True), (4, False)]
    new = spark.createDataFrame([("b", 7.0, 9), ("a", 8.0, 9)], "k string, figure double, age int")
    assert sorted((x.k, x.figure) for x in P.remember(cache, new, ["k"], "age", 3).collect()) == [("a", 8.0), ("b", 7.0), ("y", 3.0)]


def test_niches_migrants_seeds_and_scope(spark):
    df = spark.createDataFrame([(k, k % 3, float(k * 7 % 10), [["p"], ["p", "q"], []][k % 3]) for k in range(12)], "id int, island int, f double, used array<string>")
    order = [F.desc("f"), F.col("id")]
    got = sorted((x.niche, x.id) for x in P.niches(df, {"niche": F.col("island") % 2}, order, 2).collect())
    want = sorted((n, k) for n in (0, 1) for k in [x[1] for x in sorted((-float(k * 7 % 10), k) for k in range(12) if k % 3 % 2 == n)][:2])
    assert got == want
    assert {x.target for x in P.migrants(df, "island", order, 1, 3).collect()} == {0, 1, 2}
    selected = spark.createDataFrame([("p",), ("p",)], "feature string")
    assert sorted(x.id for x in P.compatible(df, "used", selected).collect()) == [k for k in range(12) if k % 3 != 1]
    assert [x.id for x in P.seeds(df, "used", selected, order, 2).collect()] == [x[1] for x in sorted((-float(k * 7 % 10), k) for k in range(12) if k % 3 != 1)][:2]
    trades = spark.createDataFrame([(1, "B", 1), (1, "A", 0), (1, "B", 0), (2, "C", 0)], "rule int, symbol string, n int")
    scope = P.symbol_scope(trades, "rule", "symbol", F.col("n") > 0)
    assert sorted((x.rule, x.symbols, x.traded) for x in scope.collect()) == [(1, ["A", "B"], 1), (2, ["C"], 0)]
    rules = spark.createDataFrame([(1, ["[x] IS Low"]), (2, []), (3, ["[y] IS High"])], "rule int, conditions array<string>")
    assert {x.rule: x.conditions for x in P.scoped(rules, scope, "rule").collect()} == {1: ["[x] IS Low", "symbol is A, B"], 2: ["symbol is C"], 3: ["[y] IS High"]}


def test_weights_and_diagnostics(spark):
    import math

    rows = candidates(30)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {x.id: x.weight for x in P.sampling_weights(df, "score", 2.0, 0.2, least=1.0).collect()}
    x = {k: max(s, 1.0) / 2 for k, _, s, _ in rows}
    total = sum(math.exp(v) for v in x.values())
    assert all(got[k] == pytest.approx(0.8 * math.exp(v) / total + 0.2 / 30) for k, v in x.items()) and sum(got.values()) == pytest.approx(1)
    d = P.diagnostics(df, "score")
    first = [list(g) for g in {tuple(g) for _, g, _, f in rows if f == 1}]
    assert d["median_pairwise_hamming"] == statistics.median(apart(a, b) for a, b in combinations(first, 2))
    assert d["median_score"] == pytest.approx(statistics.median(s for _, _, s, _ in rows)) and d["max_rank"] == 2
    assert d["rank0_fraction"] == pytest.approx(sum(f == 1 for *_, f in rows) / 30)
    assert P.diagnostics(df.where("false"), "score")["median_pairwise_hamming"] == 0.0


def test_arrays_and_dates(spark):
    import bisect

    r = random.Random(1)
    rows = [(sorted(r.choice([1, 2, 3, 5, 8]) for _ in range(r.randrange(9))), r.randrange(10)) for _ in range(80)] + [(None, 1), ([1, 2], None)]
    df = spark.createDataFrame(rows, "e array<int>, v int")
    for right in (False, True):
        got = [x.k for x in df.select(searchsorted(F.col("e"), F.col("v"), right).alias("k")).collect()]
        find = bisect.bisect_right if right else bisect.bisect_left
        assert got == [None if e is None or v is None else find(e, v) for e, v in rows]
    counts = spark.createDataFrame([([3, 1, 1, None],), ([],), (None,)], "v array<int>").select(bincount(F.col("v"), 2).alias("c")).collect()
    assert [x.c for x in counts] == [[0, 2, 0, 1], [0, 0], None]
    with pytest.raises(Exception, match="below 0"):
        spark.createDataFrame([([-1],)], "v array<int>").select(bincount(F.col("v"), 0)).collect()
    texts = ["2024-01-01T05:00:00+02:00", "2024-01-01 05:00:00", "2024-01-01T05:00:00.250Z", "x"]
    got = [x.t for x in spark.createDataFrame([(t,) for t in texts], "s string").select(strip_zone(F.col("s")).alias("t")).collect()]
    five = dt.datetime(2024, 1, 1, 5)
    assert got == [five, five, five.replace(microsecond=250_000), None]


def test_time_codes(spark):
    from barloom.operators.chunks import time_codes

    at = [dt.datetime(2024, 1, 1 + d) if d is not None else None for d in (3, 0, None, 3, 9, None)]
    df = spark.createDataFrame(list(enumerate(at)), "row int, t timestamp")
    assert [x.code for x in time_codes(df, "t", "code", "row").orderBy("row").collect()] == [1, 0, 3, 1, 2, 4]


def test_csv_tapes(spark, tmp_path):
    import os

    from barloom.operators import indicators as I  # noqa: E741, N812
    from barloom.sources import load as D  # noqa: N812
    from barloom.sources.tape import event_bars, same_place, write_csv

    raw = event_bars(spark, "/root/testdata/sf0.001").select("datetime", "symbol", "open", "high", "low", "close", "volume") if os.path.exists("/root/testdata/sf0.001") else None
    if raw is None:
        pytest.skip("no test data")
    source, out = f"file://{tmp_path}/raw.csv", f"{tmp_path}/rich.csv"
    write_csv(raw, source)
    scales = {"lookback": 6, "mid": ("12 hours", 3), "high": ("1 day", 6)}
    thresholds = I.fit_all(raw, **scales)
    done = D.write_enriched(spark, source, out, base_step="4 HOURS", thresholds=thresholds, **scales)
    want = I.enrich(raw, **scales, base_step="4 HOURS", thresholds=thresholds, warm_up=False)
    key = lambda df: sorted((x.symbol, x.datetime, *(x[c] for c in D.CONTEXT)) for x in df.collect())
    assert key(done) == key(want) and done.count() > 0
    os.symlink(f"{tmp_path}/raw.csv", f"{tmp_path}/link.csv")
    for same in (source, f"{tmp_path}/raw.csv/", f"{tmp_path}/x/../raw.csv", f"{tmp_path}/link.csv", f"{tmp_path}/raw.csv/part"):
        assert same_place(spark, source, same)
        with pytest.raises(ValueError):
            D.write_enriched(spark, source, same, base_step="4 HOURS", thresholds=thresholds, **scales)
    assert not same_place(spark, source, out)
