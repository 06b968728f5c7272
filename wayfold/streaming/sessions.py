"""Streams: sessions by gaps, throttled progress and buffered calibration. Each has a batch counterpart that tests compare it with."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import series


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions of a stream (or batch): events exactly ``gap`` apart are in one. Closed ones come out when the watermark passes them."""
    return events.withWatermark(ts, late).groupBy(F.col(key), F.session_window(ts, gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def batch_sessions(events: DataFrame, key: str, ts: str, tie: str, value: str, gap: int) -> DataFrame:
    rows = series.runs(series.typed(events, key, ts, tie, value), gap)
    return rows.groupBy("series_id", "run_id").agg(F.min("t").alias("start"), F.max("t").alias("last"), F.count("*").alias("n"))


class Throttle(StatefulProcessor):
    """Lets a report (key, t, done) through if ``every`` microseconds have passed since the last that went; rates are over what was let through. ``done`` <= 0 sets the base anew."""

    def __init__(self, every: int):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t long, done long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.last.get() if self.last.exists() else None
        out = []
        for frame in rows:
            for t, done in frame.sort_values(["t", "done"])[["t", "done"]].itertuples(index=False):
                if done <= 0 or state is None:
                    state = (int(t), int(done))
                    continue
                if t - state[0] >= self.every:
                    out.append((key[0], int(t), int(done), (done - state[1]) / ((t - state[0]) / 1e6)))
                    state = (int(t), int(done))
        if state is not None:
            self.last.update(state)
        yield pd.DataFrame(out, columns=["key", "t", "done", "rate"])

    def close(self) -> None:
        pass


def throttled(reports: DataFrame, every: int) -> DataFrame:
    """Stream of reports (key, t, done) to those let through with their rate."""
    return reports.groupBy("key").transformWithStateInPandas(Throttle(every), "key string, t long, done long, rate double", "Append", "None")


class ThrottleDue(StatefulProcessor):
    """As Throttle, and a report that came too early goes out when its turn comes, whether or not another follows: an event-time timer holds its place. State: what went out last, what waits."""

    def __init__(self, every: int):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t long, done long")
        self.waits = handle.getValueState("waits", "t long, done long")

    def _due(self, last: tuple) -> int:
        return (last[0] + self.every) // 1000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get() if self.last.exists() else None
        waits = self.waits.get() if self.waits.exists() else None
        out = []
        if waits is not None:
            self.handle.deleteTimer(self._due(last))
            if self._due(last) <= timerValues.getCurrentWatermarkInMs():  # rows of a batch come before its timers
                out, last, waits = self._turn(key, last, waits)
        for t, done in pd.concat([f for f in rows]).sort_values(["t", "done"])[["t", "done"]].itertuples(index=False):
            if last is None:
                last = (int(t), int(done))
            elif t - last[0] >= self.every:
                out.append((key[0], int(t), int(done), (done - last[1]) / ((t - last[0]) / 1e6)))
                last, waits = (int(t), int(done)), None
            elif t >= last[0]:
                waits = (int(t), int(done))
        self.last.update(last)
        if waits is None:
            self.waits.clear()
        else:
            self.waits.update(waits)
            self.handle.registerTimer(self._due(last))
        yield pd.DataFrame(out, columns=["key", "t", "done", "rate"])

    def _turn(self, key, last: tuple, waits: tuple) -> tuple:
        """What waits goes out at its turn: rows, and the state after it."""
        t, done = last[0] + self.every, waits[1]
        return [(key[0], t, done, (done - last[1]) / (self.every / 1e6))], (t, done), None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.waits.exists():
            out, last, _ = self._turn(key, self.last.get(), self.waits.get())
            self.last.update(last)
            self.waits.clear()
        yield pd.DataFrame(out, columns=["key", "t", "done", "rate"])

    def close(self) -> None:
        pass


def throttled_due(reports: DataFrame, every: int, late: str = "0 seconds") -> DataFrame:
    """Stream of reports (key, ts, done) to one each ``every`` microseconds of a key: the first that comes after so long, or the latest that waits once event time (``late`` behind the newest report of
    any key) has passed its turn."""
    rows = reports.withWatermark("ts", late).withColumn("t", F.unix_micros("ts"))
    return rows.groupBy("key").transformWithStateInPandas(ThrottleDue(every), "key string, t long, done long, rate double", "Append", "EventTime")


class Calibrate(StatefulProcessor):
    """Holds the first ``need`` usable rows (key, frame, value) of a key, then sends them all with their upper median, and all later rows with it."""

    def __init__(self, need: int):
        self.need = need

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "frame long, value double")
        self.level = handle.getValueState("level", "level double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        level = self.level.get()[0] if self.level.exists() else None
        held = [tuple(r) for r in self.held.get()] if level is None else []
        out = []
        for frame in rows:
            for f, v in frame.sort_values("frame")[["frame", "value"]].itertuples(index=False):
                if level is not None:
                    out.append((key[0], int(f), float(v), level))
                    continue
                held.append((int(f), float(v)))
                if len(held) >= self.need:
                    s = sorted(v for _, v in held)
                    level = s[len(s) // 2]
                    out += [(key[0], a, b, level) for a, b in held]
                    held = []
        if level is None and held:
            self.held.put(held)
        elif level is not None:
            self.level.update((level,))
            self.held.clear()
        yield pd.DataFrame(out, columns=["key", "frame", "value", "level"])

    def close(self) -> None:
        pass


def calibrated(rows: DataFrame, need: int = 200) -> DataFrame:
    return rows.groupBy("key").transformWithStateInPandas(Calibrate(need), "key string, frame long, value double, level double", "Append", "None")


class CalibrateWhole(Calibrate):
    """As Calibrate, until a row without a frame says that the key has ended: rows still held then go out with the level they give, not reliable. What comes later gets that level too."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.short = handle.getValueState("short", "level double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ended = False

        def usable() -> Iterator[pd.DataFrame]:
            nonlocal ended
            for frame in rows:
                ended |= bool(frame["frame"].isna().any())
                yield frame[frame["frame"].notna()]

        if self.short.exists():
            level = self.short.get()[0]
            yield from (f[["key", "frame", "value"]].astype({"frame": "int64"}).assign(level=level, reliable=False) for f in usable())
            return
        for out in super().handleInputRows(key, usable(), timerValues):
            yield out.assign(reliable=True)
        held = sorted(tuple(r) for r in self.held.get()) if ended and not self.level.exists() else []
        if held:
            s = sorted(v for _, v in held)
            level = s[len(s) // 2]
            self.short.update((level,))
            self.held.clear()
            yield pd.DataFrame([(key[0], f, v, level, False) for f, v in held], columns=["key", "frame", "value", "level", "reliable"])


def calibrated_whole(rows: DataFrame, need: int = 200) -> DataFrame:
    """``calibrated`` with every row: a key's end is marked by a row with a null frame, and ``reliable`` is false where fewer than ``need`` rows gave the level."""
    return rows.groupBy("key").transformWithStateInPandas(CalibrateWhole(need), "key string, frame long, value double, level double, reliable boolean", "Append", "None")


class CalibrateIdle(Calibrate):
    """As Calibrate, until a key has been silent for ``idle`` milliseconds of event time: a timer, put off by each of its rows, then sends what is held with the level it gives, not reliable, and the
    key's state goes. A key that comes back begins anew."""

    def __init__(self, need: int, idle: int):
        super().__init__(need)
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.until = handle.getValueState("until", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = 0
        if self.until.exists() and self.until.get()[0] <= timerValues.getCurrentWatermarkInMs():  # rows of a batch come before its timers
            self.handle.deleteTimer(self.until.get()[0])
            yield self._flushed(key)

        def seen() -> Iterator[pd.DataFrame]:
            nonlocal newest
            for frame in rows:
                newest = max(newest, int(frame["at"].max()))
                yield frame

        for out in super().handleInputRows(key, seen(), timerValues):
            yield out.assign(reliable=True)
        at = newest + self.idle
        if self.until.exists():
            old = self.until.get()[0]
            at = max(at, old)
            if at != old:
                self.handle.deleteTimer(old)
        self.until.update((at,))
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._flushed(key)

    def _flushed(self, key) -> pd.DataFrame:
        held = sorted(tuple(r) for r in self.held.get())
        s = sorted(v for _, v in held)
        out = [(key[0], f, v, s[len(s) // 2], False) for f, v in held]
        self.held.clear()
        self.level.clear()
        self.until.clear()
        return pd.DataFrame(out, columns=["key", "frame", "value", "level", "reliable"])


def calibrated_idle(rows: DataFrame, need: int = 200, idle: str = "30 seconds", late: str = "0 seconds") -> DataFrame:
    """Stream of rows (key, ts, frame, value) as ``calibrated_whole``, with no marker for a key's end: it has ended when no row of it came for ``idle`` of event time."""
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    usable = rows.withWatermark("ts", late).withColumn("at", F.unix_millis("ts"))
    return usable.groupBy("key").transformWithStateInPandas(CalibrateIdle(need, ms), "key string, frame long, value double, level double, reliable boolean", "Append", "EventTime")


def calibrated_whole_batch(rows: DataFrame, need: int = 200) -> DataFrame:
    """The same in two passes; the end of the input is that of every key."""
    from pyspark.sql import Window

    from ..operators.stats import median_upper

    usable = rows.filter("frame IS NOT NULL")
    n = usable.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("frame")))
    level = n.filter(F.col("_r") <= need).groupBy(F.col("key").alias("_key")).agg(median_upper("value").alias("level"), (F.count("*") >= need).alias("reliable"))
    return usable.join(level, F.col("key").eqNullSafe(F.col("_key"))).drop("_key")


def calibrated_batch(rows: DataFrame, need: int = 200) -> DataFrame:
    """The same in two passes: the level of the first ``need`` rows, joined to all; keys with fewer have none."""
    from pyspark.sql import Window

    from ..operators.stats import median_upper

    n = rows.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("frame")))
    level = n.filter(F.col("_r") <= need).groupBy("key").agg(median_upper("value").alias("level"), F.count("*").alias("_n")).filter(F.col("_n") >= need).drop("_n")
    return rows.join(level, "key")
