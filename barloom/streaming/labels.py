"""Forward labels and as-of states of streams, by event-time timers.

Rows of a symbol wait in state until the watermark has passed them; then nothing earlier can come
any more, and they are settled in order of time, whatever order they came in. A settled bar waits on
until its horizon is settled, too. So the state of a symbol is what lies between the watermark
and the newest row, and one horizon. A symbol without rows for `idle` ends: its last bars go out without labels, as
in a batch, and its state is cleared. Rows that come after the watermark has passed them are dropped.

A symbol has one timer: at its earliest waiting row, or at its end. State survives a restart from the
checkpoint; it needs the RocksDB state store, which these functions choose for the session.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _InOrder(StatefulProcessor):
    """Settles a key's rows in order of time. Subclasses say what a row is and what settling gives."""

    #: The columns of a waiting row, after its time in microseconds.
    WAITING = ""

    def __init__(self, time: str, idle_ms: int):
        self.time, self.idle_ms = time, idle_ms
        kinds = {"double": float, "long": int, "int": int}
        self.columns = {c.split()[0]: kinds[c.split()[1]] for c in self.WAITING.split(", ")}

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"t long, {self.WAITING}")
        #: Time of the last settled and of the newest row, and the timer that is set, in milliseconds.
        self.clock = handle.getValueState("clock", "settled long, newest long, timer long")

    def _clock(self) -> list[int]:
        return list(self.clock.get()) if self.clock.exists() else [-(1 << 62), -(1 << 62), -1]

    def _set_timer(self, clock: list[int], rows: list[tuple]) -> None:
        at = -(-min(r[0] for r in rows) // 1000) if rows else -(-clock[1] // 1000) + self.idle_ms
        if clock[2] != at:
            if clock[2] >= 0:
                self.handle.deleteTimer(clock[2])
            self.handle.registerTimer(at)
            clock[2] = at
        self.clock.update(tuple(clock))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        clock, held = self._clock(), [tuple(r) for r in self.waiting.get()]
        for pdf in rows:
            times = pdf[self.time].astype("datetime64[us]").astype("int64")
            late = times <= clock[0]
            clock[1] = max(clock[1], int(times.max()))
            own = pdf[~late]
            held += zip(times[~late].tolist(), *(_plain(own[c], kind) for c, kind in self.columns.items()), strict=True)
        if held:
            self.waiting.put(held)
            self._set_timer(clock, held)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        clock, held = self._clock(), [tuple(r) for r in self.waiting.get()]
        clock[2] = -1  # it has fired
        ready = sorted((r for r in held if r[0] <= mark), key=self.order)
        rest = [r for r in held if r[0] > mark]
        ended = not rest and mark >= clock[1] + self.idle_ms * 1000
        yield from self.settle(key, ready, ended)
        if ended:
            self.clear()
            self.clock.clear()
            self.waiting.clear()
            return
        clock[0] = max(clock[0], mark)
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        self._set_timer(clock, rest)

    @staticmethod
    def order(row: tuple):
        return row[0]

    def settle(self, key, rows: list[tuple], ended: bool) -> Iterator:
        raise NotImplementedError

    def clear(self) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _plain(column, kind) -> list:
    """Values as state takes them: a column with nulls comes as floats, and a float isn't a long there."""
    return [None if missing else kind(x) for x, missing in zip(column.tolist(), column.isna().tolist(), strict=True)]


def _frame(times: list[int], columns: dict[str, list]):
    import pandas as pd

    return pd.DataFrame({**columns, "datetime": pd.to_datetime(pd.Series(times, dtype="int64"), unit="us")})


LABELS = "symbol string, datetime timestamp, bar long, label_open_next double, label_close_h double, label_min_h double, label_max_h double, label_max_first int"


class _Labels(_InOrder):
    WAITING = "open double, high double, low double, close double"

    def __init__(self, horizon: int, time: str, idle_ms: int):
        super().__init__(time, idle_ms)
        self.horizon = horizon

    def init(self, handle) -> None:
        super().init(handle)
        #: Settled bars that wait for their horizon: at most as many as it has.
        self.open_bars = handle.getListState("open_bars", f"t long, {self.WAITING}")
        self.first = handle.getValueState("first", "bar long")

    def settle(self, key, rows: list[tuple], ended: bool) -> Iterator:
        import numpy as np

        bars = [tuple(r) for r in self.open_bars.get()] + rows
        first = self.first.get()[0] if self.first.exists() else 0
        n = max(0, len(bars) - self.horizon)
        out = len(bars) if ended else n
        if out:
            price = np.array([[np.nan if x is None else x for x in b[1:]] for b in bars], float)
            cols: dict[str, list] = {"symbol": [key[0]] * out, "bar": list(range(first, first + out))}
            number = lambda x: None if np.isnan(x) else float(x)
            cols["label_open_next"] = [number(price[i + 1, 0]) if i + 1 < len(bars) else None for i in range(out)]
            cols["label_close_h"] = [number(price[i + self.horizon, 3]) if i < n else None for i in range(out)]
            ahead = [price[i + 1 : i + 1 + self.horizon] for i in range(min(n, out))]
            low, high = [], []
            for a in ahead:  # nothing missing: the first bar of the least and of the greatest
                low.append((number(np.nanmin(a[:, 2])), int(np.nanargmin(a[:, 2]))) if not np.isnan(a[:, 2]).all() else (None, 0))
                high.append((number(np.nanmax(a[:, 1])), int(np.nanargmax(a[:, 1]))) if not np.isnan(a[:, 1]).all() else (None, 0))
            none = [None] * (out - len(ahead))
            cols["label_min_h"], cols["label_max_h"] = [x for x, _ in low] + none, [x for x, _ in high] + none
            cols["label_max_first"] = [int(h[1] < w[1]) for w, h in zip(low, high, strict=True)] + none
            frame = _frame([b[0] for b in bars[:out]], cols)
            frame["label_max_first"] = frame["label_max_first"].astype("Int32")
            yield frame
        if not ended:
            self.first.update((first + n,))
            if bars[n:]:
                self.open_bars.put(bars[n:])

    def clear(self) -> None:
        self.open_bars.clear()
        self.first.clear()


AS_OF = "symbol string, datetime timestamp, row_id long, state int"


class _AsOf(_InOrder):
    WAITING = "row_id long, state int"

    def __init__(self, time: str, idle_ms: int, none: int):
        super().__init__(time, idle_ms)
        self.none = none

    def init(self, handle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "state int")

    @staticmethod
    def order(row: tuple):
        return row[0], row[1] is not None  # a state holds from its own time on

    def settle(self, key, rows: list[tuple], ended: bool) -> Iterator:
        now = self.last.get()[0] if self.last.exists() else self.none
        times, ids, states = [], [], []
        for t, row_id, state in rows:
            if row_id is None:
                now = now if state is None else state
            else:
                times.append(t)
                ids.append(row_id)
                states.append(now)
        if rows and not ended:
            self.last.update((int(now),))
        if times:
            yield _frame(times, {"symbol": [key[0]] * len(times), "row_id": ids, "state": states})

    def clear(self) -> None:
        self.last.clear()


def _run(stream: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return stream.groupBy("symbol").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="eventTime")


def stream_labels(bars: DataFrame, horizon: int, late: str, idle_seconds: int) -> DataFrame:
    """symbol, datetime, bar and the labels of labels.add_labels() for a stream of bars: a row goes out when the
    watermark (`late` behind the newest bar) has passed its horizon, or when its symbol ends."""
    rows = bars.select(F.col("symbol").cast("string"), F.col("datetime").cast("timestamp"), *(F.col(c).cast("double") for c in ("open", "high", "low", "close")))
    return _run(rows.withWatermark("datetime", late), _Labels(horizon, "datetime", idle_seconds * 1000), LABELS)


def stream_as_of(rows: DataFrame, states: DataFrame, late: str, idle_seconds: int, none: int = 2) -> DataFrame:
    """symbol, datetime, row_id, state: the last state (symbol, close_time, state) that is known at a row's
    time (symbol, datetime, row_id), inclusive; `none` before the first. Two streams, one state for each symbol."""
    left = rows.select(F.col("symbol").cast("string"), F.col("datetime").cast("timestamp"), F.col("row_id").cast("long"), F.lit(None).cast("int").alias("state"))
    right = states.select(F.col("symbol").cast("string"), F.col("close_time").cast("timestamp").alias("datetime"), F.lit(None).cast("long").alias("row_id"), F.col("state").cast("int"))
    return _run(left.union(right).withWatermark("datetime", late), _AsOf("datetime", idle_seconds * 1000, none), AS_OF)
