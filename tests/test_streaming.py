"""Streams give what a batch over the same rows gives: late rows, restarts, ended symbols."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators as I  # noqa: E741, N812
from barloom.operators import labels as L  # noqa: N812
from barloom.streaming.labels import stream_as_of, stream_labels

BARS = "symbol string, datetime timestamp, open double, high double, low double, close double"
H = 3


@pytest.fixture
def rocks(spark):
    """The state store that these streams choose, undone after."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    yield spark
    if before:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    else:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def bars(n=40, symbols=("A", "B")):
    r, out = random.Random(7), []
    for s in symbols:
        price, at = 100.0, dt.datetime(2024, 1, 1)
        for _ in range(n):
            at += dt.timedelta(hours=r.choice([1, 1, 2]))
            close = price + r.gauss(0, 2)
            out.append((s, at, price, max(price, close) + 1, min(price, close) - 1, close))
            price = close
    return sorted(out, key=lambda x: (x[1], x[0]))


def feed(spark, folder, rows, schema=BARS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def run(stream, out, checkpoint):
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None


def rows_of(df, names):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect())


NAMES = ["symbol", "datetime", "bar", "label_open_next", "label_close_h", "label_min_h", "label_max_h", "label_max_first"]


def batch(spark, rows):
    df = spark.createDataFrame(rows, BARS)
    from barloom.sources.tape import with_bar_index

    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in L.add_labels(with_bar_index(df), H).select(*NAMES).collect()), key=str)


def test_labels_after_a_restart_with_late_rows(rocks, tmp_path):
    spark, src, out, check = rocks, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    rows = bars()
    r = random.Random(1)
    # Out of order, but within what the watermark allows.
    shuffled = sorted(rows, key=lambda x: x[1] + dt.timedelta(hours=r.uniform(0, 4)))
    parts = [shuffled[k : k + 16] for k in range(0, len(shuffled), 16)]
    start = lambda: stream_labels(spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(src), H, "6 hours", 20 * 3600)
    feed(spark, src, parts[0])
    for part in parts[1:3]:
        feed(spark, src, part)
    run(start(), out, check)
    early = spark.read.parquet(out).count()
    assert 0 < early < len(rows)
    # Far too late: the watermark has passed it, and it changes nothing. Then the rest, from the checkpoint.
    feed(spark, src, [("A", dt.datetime(2024, 1, 1, 0, 30), 1.0, 999.0, 0.5, 1.0)])
    for part in parts[3:]:
        feed(spark, src, part)
    feed(spark, src, [("Z", dt.datetime(2024, 2, 1), 1.0, 1.0, 1.0, 1.0)])  # moves the watermark past all others
    feed(spark, src, [("Z", dt.datetime(2024, 2, 1, 1), 1.0, 1.0, 1.0, 1.0)])
    run(start(), out, check)
    got = sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in spark.read.parquet(out).where("symbol <> 'Z'").select(*NAMES).collect()), key=str)
    assert got == batch(spark, rows)  # the last bars of the ended symbols, too, without labels
    assert sum(x[4] is None for x in got) == 2 * H


def test_as_of_of_two_streams(rocks, tmp_path):
    spark, out, check = rocks, str(tmp_path / "out"), str(tmp_path / "check")
    rows = [(s, t, k) for k, (s, t, *_) in enumerate(bars(25))]
    states = [(s, t, k % 3 - 1) for k, (s, t, _) in enumerate(rows) if k % 4 == 1]
    states += [("A", dt.datetime(2024, 1, 1, 9, 30), None)]
    names = ("symbol string, datetime timestamp, row_id long", "symbol string, close_time timestamp, state int")
    for part in range(4):
        if part < 2:
            feed(spark, str(tmp_path / "rows"), rows[part * 25 : part * 25 + 25], names[0])
            feed(spark, str(tmp_path / "states"), states[part::2], names[1])
        else:  # moves the watermark past all others
            feed(spark, str(tmp_path / "rows"), [("Z", dt.datetime(2024, part, 1), 900 + part)], names[0])
            feed(spark, str(tmp_path / "states"), [("Z", dt.datetime(2024, part, 1), 1)], names[1])
        read = lambda name, schema: spark.readStream.schema(schema).parquet(str(tmp_path / name))
        run(stream_as_of(read("rows", names[0]), read("states", names[1]), "60 hours", 3600), out, check)
    got = rows_of(spark.read.parquet(out).where("symbol <> 'Z'"), ["symbol", "datetime", "row_id", "state"])
    want = I.as_of(spark.createDataFrame(rows, names[0]), spark.createDataFrame(states, names[1]), F.col("datetime"), "state")
    assert got == rows_of(want, ["symbol", "datetime", "row_id", "state"]) and len({x[3] for x in got}) == 4


def test_accounts_are_forgotten(spark, tmp_path):
    from barloom.streaming.bars import running_equity

    schema, src = "plan string, n long, at timestamp, pnl double", str(tmp_path / "in")
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    batches = [[("p", 2, at(1), -100.0), ("p", 1, at(0), 50.0), ("q", 1, at(0), 10.0)], [("q", 2, at(30), -20.0)], [("q", 3, at(60), 1.0)], [("p", 3, at(61), 7.0)]]
    for k, rows in enumerate(batches):
        feed(spark, src, rows, schema)
        stream = spark.readStream.schema(schema).parquet(src).withWatermark("at", "1 hour")
        out = running_equity(stream, "plan", "pnl", order="n", time="at", idle_ms=20 * 3_600_000)
        seen = []
        q = out.writeStream.foreachBatch(lambda df, _, seen=seen: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination(120)
        last = {r.plan: (r.equity, round(r.drawdown_pct, 6)) for r in seen}
        if k == 0:
            assert last == {"p": (950.0, round(100 / 1050 * 100, 6)), "q": (1010.0, 0.0)}
    assert last == {"p": (1007.0, 0.0)}  # it began anew
