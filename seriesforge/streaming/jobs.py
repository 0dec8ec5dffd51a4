"""Streaming forms of the analyses that go row by row.

Windowed jobs drop rows later than the watermark, which batch forms don't do.
The others keep a state for each entity in the session's state store, which must
be the one on disk (`session.STATE_STORE`): values, lists, times of life and
timers. A restarted query goes on from its checkpoint. Rows of an entity are
taken in the order of idx or seq within a trigger, and triggers in theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ensemble import WEIGHTS
from ..session import STATE_STORE


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts and sums by entity and day of a stream (entity, ts timestamp, value)."""
    g = events.withWatermark("ts", late).groupBy("entity", F.window("ts", "1 day"))
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("entity", F.to_date("window.start").alias("day"), "n", "value")


def bursts(events: DataFrame, gap: str = "7 days", least: int = 3, late: str = "1 day") -> DataFrame:
    """Sessions of an entity's events less than `gap` apart, of at least `least` events."""
    g = events.withWatermark("ts", late).groupBy("entity", F.session_window("ts", gap))
    return g.agg(F.count("*").alias("n")).where(F.col("n") >= least).select("entity", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def _stateful(rows: DataFrame, processor: StatefulProcessor, schema: str, key: str = "entity", time: str = "none") -> DataFrame:
    name, kind = next(iter(STATE_STORE.items()))
    if rows.sparkSession.conf.get(name, "") != kind:
        raise ValueError(f"set {name} to {kind}: it keeps lists, timers and times of life")
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode=time)


def _in_order(frames: Iterator[pd.DataFrame], column: str) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(column, kind="stable")


class _Cusum(StatefulProcessor):
    """State: rows seen, running mean and variance, and the two sums."""

    def __init__(self, threshold: float, span: int):
        self.threshold, self.a = threshold, 2 / (span + 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "n long, mean double, var double, up double, down double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, mean, var, up, down = self.sums.get() if self.sums.exists() else (0, 0.0, 0.0, 0.0, 0.0)
        out = []
        ordered = _in_order(rows, "idx")
        for i, v in zip(ordered["idx"], ordered["value"], strict=True):
            if n > 5 and var > 0:
                z = (v - mean) / var**0.5
                up, down = max(0.0, up + z), min(0.0, down + z)
                if up > self.threshold or down < -self.threshold:
                    out.append((key[0], int(i), float(up if up > self.threshold else down)))
                    up = down = 0.0
            w = max(self.a, 1 / (n + 1))
            d = v - mean
            mean += w * d
            var = (1 - w) * (var + w * d * d)
            n += 1
        self.sums.update((int(n), float(mean), float(var), float(up), float(down)))
        yield pd.DataFrame(out, columns=["entity", "idx", "sum"])

    def close(self) -> None:
        pass


def cusum(values: DataFrame, threshold: float = 5.0, span: int = 50) -> DataFrame:
    """Alarms of each entity's stream (entity, idx, value): sums of z-scores against a running mean and variance that forget with this span, started anew at an alarm."""
    kind = values.schema["entity"].dataType.simpleString()
    return _stateful(values, _Cusum(threshold, span), f"entity {kind}, idx long, sum double")


class _Ema(StatefulProcessor):
    def __init__(self, span: int):
        self.a = 2 / (span + 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "last double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        ordered = _in_order(rows, "idx")
        for i, v in zip(ordered["idx"], ordered["value"], strict=True):
            last = v if last is None else self.a * v + (1 - self.a) * last
            out.append((key[0], int(i), float(last)))
        if last is not None:
            self.last.update((float(last),))
        yield pd.DataFrame(out, columns=["entity", "idx", "ema"])

    def close(self) -> None:
        pass


def ema(values: DataFrame, span: int = 12) -> DataFrame:
    """The exponential mean after each row of an entity's stream (entity, idx, value)."""
    kind = values.schema["entity"].dataType.simpleString()
    return _stateful(values, _Ema(span), f"entity {kind}, idx long, ema double")


class _Weights(StatefulProcessor):
    """State: the last `keep` errors of each model, as a list; a timer that is set anew with each trigger that brings rows."""

    def __init__(self, keep: int, forget_ms: int | None, idle_ms: int | None):
        self.keep, self.forget, self.idle = keep, forget_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.errors = handle.getListState("errors", "model string, seq long, error double", self.forget)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = list(self.errors.get()) if self.errors.exists() else []
        new = _in_order(rows, "seq")
        error = (new["predicted"] - new["actual"]).abs() * new["confidence"]
        known += list(zip(new["model"], new["seq"].astype(int), error.astype(float), strict=True))
        kept = []
        for model in sorted({m for m, _, _ in known}):
            kept += sorted((r for r in known if r[0] == model), key=lambda r: r[1])[-self.keep :]
        self.errors.put([(str(m), int(s), float(e)) for m, s, e in kept])
        if self.idle:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        mean = {m: pd.Series([e for k, _, e in kept if k == m]).mean() for m in WEIGHTS}
        raw = {m: 1 / (1 + (1.0 if pd.isna(e) else e)) for m, e in mean.items()}
        total, last = sum(raw.values()), int(new["seq"].max())
        yield pd.DataFrame([(key[0], last, m, w / total) for m, w in raw.items()], columns=["entity", "seq", "model", "weight"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing came for long: the errors go, and the fixed weights hold again."""
        self.errors.clear()
        yield pd.DataFrame([(key[0], -1, m, w) for m, w in WEIGHTS.items()], columns=["entity", "seq", "model", "weight"])

    def close(self) -> None:
        pass


def meta_weights(history: DataFrame, keep: int = 100, forget_ms: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """Weights of the models after each trigger that brings rows of an entity's stream (entity, model, seq, predicted, actual, confidence): entity, seq (the last one), model, weight.

    As the batch form: by each model's mean error over its last `keep` rows. Errors older than forget_ms are forgotten; after
    idle_ms without rows an entity's errors go and the fixed weights come out, with seq -1.
    """
    kind = history.schema["entity"].dataType.simpleString()
    timed = "processingTime" if forget_ms or idle_ms else "none"
    return _stateful(history, _Weights(keep, forget_ms, idle_ms), f"entity {kind}, seq long, model string, weight double", time=timed)
