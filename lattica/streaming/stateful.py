"""Streams whose state outlives micro-batches in Spark's keyed state, with timers: windows over samples in event-time order, inference at the clock, and a selector that calibrates, predicts and calibrates anew.

Rows of a key wait in its state until the watermark has passed them and are then taken in order of time and number, whichever micro-batch brought them: results depend on the rows alone, not on how a
stream was cut. Rows later than the watermark are dropped by Spark and counted in its progress. The state store must be RocksDB, which ``started`` sets for its query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from lattica.session import shared_path

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ordered(StatefulProcessor):
    """Base of processors that take a key's rows in order. columns: those of a row after its time in milliseconds and its number; ``advance`` gets the rows that the watermark has passed.

    The state: the rows that wait, and one value of ``schema`` that ``advance`` reads and writes. A key that is silent for ``expiry_ms`` of event time is forgotten."""

    schema = ""  # of the value
    out: tuple[str, ...] = ()

    def __init__(self, waiting: str, columns: list[str], expiry_ms: int | None = None):
        self.waiting_schema, self.columns, self.expiry_ms = waiting, columns, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)
        self.value = handle.getValueState("value", self.schema)
        self.last = handle.getValueState("last", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(_plain(v) for v in r) for frame in rows if len(frame) for r in frame[self.columns].itertuples(index=False, name=None)]
        if not new:
            yield self._frame([])
            return
        self.waiting.appendList(new)
        self.handle.registerTimer(min(r[0] for r in new))
        if self.expiry_ms is not None:
            latest = max(r[0] for r in new)
            seen = max(latest, self.last.get()[0]) if self.last.exists() else latest
            self.last.update((seen,))
            self.handle.registerTimer(seen + self.expiry_ms)
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()]
        ready = sorted((r for r in held if r[0] <= passed), key=lambda r: r[:2])
        if ready:
            rest = [r for r in held if r[0] > passed]
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(min(r[0] for r in rest))
            else:
                self.waiting.clear()
            yield self._frame(self.advance(key[0], ready))
        if self.expiry_ms is not None and self.last.exists() and self.last.get()[0] + self.expiry_ms <= passed:
            self.value.clear()
            self.last.clear()
        yield self._frame([])

    def advance(self, key, rows: list[tuple]) -> list[tuple]:
        raise NotImplementedError

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=list(self.out))

    def close(self) -> None:
        pass


def _plain(v):
    """Values as the state store takes them."""
    if isinstance(v, np.ndarray):
        return [_plain(x) for x in v]
    if isinstance(v, np.generic):
        v = v.item()
    return None if v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v) else v


class Windows(Ordered):
    """Full windows over a key's samples, ``step`` apart, each scored as an array (channels, samples). The value: number of the first sample held, samples still to skip, samples."""

    schema = "first bigint, skip bigint, samples array<array<double>>"
    out = ("key", "start", "stop", "scores")

    def __init__(self, window: int, step: int, score: Callable[[np.ndarray], np.ndarray], expiry_ms: int | None = None):
        super().__init__("at bigint, n bigint, v array<double>", ["at_ms", "n", "v"], expiry_ms)
        self.window, self.step, self.score = window, step, score

    def advance(self, key, rows):
        first, skip, held = self.value.get() if self.value.exists() else (0, 0, [])
        held, out = [list(x) for x in held], []
        for _, _, v in rows:
            if skip:  # a step wider than the window passes over samples, some of which may come in later micro-batches
                skip -= 1
                continue
            held.append(list(v))
            if len(held) == self.window:
                out.append((key, first, first + self.window, np.asarray(self.score(np.array(held, np.float64).T), np.float64).ravel().tolist()))
                skip, held = max(0, self.step - self.window), held[self.step :]
                first += self.step
        self.value.update((first, skip, held))
        return out


#: Columns of a processor's rows must not begin with an underscore: frames are made of named tuples, which rename those.
def _waiting(df: DataFrame, key: str, ts: str, watermark: str, **columns: str) -> DataFrame:
    return df.withWatermark(ts, watermark).select(F.col(key).alias("of"), ts, F.unix_millis(ts).alias("at_ms"), *[F.col(c).alias(a) for a, c in columns.items()]).groupBy("of")


def windows(df: DataFrame, window: int, step: int, score: Callable[[np.ndarray], np.ndarray], key: str = "subject_id", number: str = "idx", ts: str = "ts", values: str = "values", watermark: str = "10 seconds", expiry_ms: int | None = None) -> DataFrame:
    """df: a stream of samples (key, number, ts, values array<double>, one a channel). (key, start, stop, scores): window from the start-th sample of the key on, in order of time and number, and what ``score`` says of it.

    Samples without values are passed over; late ones are put in order up to the watermark; the last samples come out once later ones move the watermark past them."""
    out = StructType([StructField("key", df.schema[key].dataType), *StructType.fromDDL("start bigint, stop bigint, scores array<double>").fields])
    return _waiting(df.filter(F.col(values).isNotNull()), key, ts, watermark, n=number, v=values).transformWithStateInPandas(Windows(window, step, score, expiry_ms), out, "Append", "EventTime").withColumnRenamed("key", key)


class Clocked(StatefulProcessor):
    """A key's newest window scored at every tick of the clock, whether or not samples came: the ring buffer of live inference."""

    def __init__(self, window: int, length: int, every_ms: int, score: Callable[[np.ndarray], np.ndarray], idle_ticks: int):
        self.window, self.length, self.every_ms, self.score, self.idle_ticks = window, length, every_ms, score, idle_ticks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("ring", "seen bigint, told bigint, idle int, samples array<array<double>>")

    def handleInputRows(self, key, rows, timerValues):
        seen, told, idle, held = self.ring.get() if self.ring.exists() else (0, -1, -1, [])
        new = sorted((tuple(_plain(v) for v in r) for f in rows if len(f) for r in f[["at_ms", "n", "v"]].itertuples(index=False, name=None)), key=lambda r: r[:2])
        held = [*map(list, held), *(list(v) for _, _, v in new)][-self.length :]
        if idle < 0:  # the clock of this key starts, or starts again after a pause
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.every_ms)
        self.ring.update((seen + len(new), told, 0, held))
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        seen, told, idle, held = self.ring.get()
        idle = 0 if seen > told else idle + 1
        if idle >= self.idle_ticks:  # stops until samples come
            self.ring.update((seen, told, -1, held))
            yield self._frame([])
            return
        self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.every_ms)
        out = []
        if len(held) >= self.window:
            x = np.array(held[-self.window :], np.float64).T
            out.append((key[0], seen - self.window, seen, seen == told, np.asarray(self.score(x), np.float64).ravel().tolist()))
            told = seen
        self.ring.update((seen, told, idle, held))
        yield self._frame(out)

    def _frame(self, rows):
        return pd.DataFrame(rows, columns=["key", "start", "stop", "repeated", "scores"])

    def close(self) -> None:
        pass


def clocked(df: DataFrame, window: int, length: int, every_ms: int, score: Callable[[np.ndarray], np.ndarray], idle_ticks: int = 100, key: str = "subject_id", number: str = "idx", ts: str = "ts", values: str = "values") -> DataFrame:
    """(key, start, stop, repeated, scores): every ``every_ms`` of the clock the newest ``window`` of the last ``length`` samples that have arrived; repeated where nothing new came. After ``idle_ticks`` such ticks a key
    falls silent until it has samples. What is told when depends on the clock, by intent: for results that depend on the rows alone take ``windows``."""
    if not 0 < window <= length:
        raise ValueError("a window is no longer than the ring that holds it")
    rows = df.filter(F.col(values).isNotNull()).select(F.col(key).alias("of"), F.unix_millis(ts).alias("at_ms"), F.col(number).alias("n"), F.col(values).alias("v")).groupBy("of")
    out = StructType([StructField("key", df.schema[key].dataType), *StructType.fromDDL("start bigint, stop bigint, repeated boolean, scores array<double>").fields])
    return rows.transformWithStateInPandas(Clocked(window, length, every_ms, score, idle_ticks), out, "Append", "ProcessingTime").withColumnRenamed("key", key)


class Candidate:
    """A pipeline that an online selector may choose: a name, the features it takes (by place; all if None) and a shrinkage. It is fitted from sums by class: a discriminant with a pooled covariance, shrunk; at 1 the nearest mean."""

    def __init__(self, name: str, take: list[int] | None = None, shrinkage: float = 1.0):
        self.name, self.take, self.shrinkage = name, take, shrinkage

    def vector(self, x) -> np.ndarray:
        x = np.asarray(x, np.float64)
        return x if self.take is None else x[self.take]

    def fit(self, rows: list[tuple[int, np.ndarray]]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(classes, weights, biases) of labelled vectors."""
        classes = sorted({y for y, _ in rows})
        x = np.stack([v for _, v in rows])
        y = np.array([y for y, _ in rows])
        means = np.stack([x[y == c].mean(0) for c in classes])
        spread = sum((x[y == c] - m).T @ (x[y == c] - m) for c, m in zip(classes, means, strict=True)) / max(1, len(x) - len(classes))
        p = spread.shape[0]
        scale = np.trace(spread) / p + 1e-9
        pooled = (1 - self.shrinkage) * spread + self.shrinkage * scale * np.eye(p) + 1e-9 * np.eye(p)
        w = np.linalg.solve(pooled, means.T).T
        return classes, w, -0.5 * (w * means).sum(1)

    def left_out_accuracy(self, rows: list[tuple[int, np.ndarray]]) -> float:
        """Each trial by the others; one whose class has no other trial counts as wrong."""
        right = 0
        for k, (y, v) in enumerate(rows):
            rest = rows[:k] + rows[k + 1 :]
            if any(c == y for c, _ in rest):
                classes, w, b = self.fit(rest)
                right += classes[int(np.argmax(w @ v + b))] == y
        return right / len(rows)


class Selector(Ordered):
    """Calibrates on the first labelled trials of a key, chooses among candidates, predicts, watches for drift and calibrates anew.

    The value: the phase's number, trials since calibration, rolling outcomes, low means in a row, the baseline, the candidate chosen and its fit, and the trials of a calibration under way."""

    schema = "round int, live bigint, outcomes array<double>, low int, baseline double, chosen int, classes array<int>, weights array<array<double>>, biases array<double>, labels array<int>, vectors array<array<double>>"
    out = ("key", "trial_id", "label", "predicted", "pipeline", "round", "phase", "rolling_accuracy", "baseline", "drift")

    def __init__(self, candidates: list[Candidate], calibrate: int, window: int, at_least: int, run: int, floor: float, drop: float, tick: int | None, expiry_ms: int | None = None):
        super().__init__("at bigint, n bigint, label int, v array<double>", ["at_ms", "n", "known", "v"], expiry_ms)
        self.candidates, self.calibrate, self.window, self.at_least, self.run, self.floor, self.drop, self.tick = candidates, calibrate, window, at_least, run, floor, drop, tick

    def advance(self, key, rows):
        s = dict(zip([f.split()[0] for f in self.schema.split(", ")], self.value.get(), strict=True)) if self.value.exists() else {"round": 0, "live": 0, "outcomes": [], "low": 0, "baseline": None, "chosen": None, "classes": [], "weights": [], "biases": [], "labels": [], "vectors": []}
        s = {k: [list(x) if isinstance(x, (list, tuple)) else x for x in v] if isinstance(v, (list, tuple)) else v for k, v in s.items()}
        out = []
        for _, trial, label, v in rows:
            label = label if label >= 0 else None
            if s["chosen"] is None:
                out.append((key, trial, label, None, None, s["round"], "calibrate", None, None, False))
                if label is not None:
                    s["labels"].append(label)
                    s["vectors"].append(list(v))
                    if len(s["labels"]) >= self.calibrate and len(set(s["labels"])) > 1:
                        self._choose(s)
                continue
            c = self.candidates[s["chosen"]]
            guess = s["classes"][int(np.argmax(np.array(s["weights"]) @ c.vector(v) + np.array(s["biases"])))]
            s["live"] += 1
            mean, drifted = None, False
            if label is not None:
                s["outcomes"] = [*s["outcomes"], float(guess == label)][-self.window :]
                if len(s["outcomes"]) >= self.at_least:
                    mean = sum(s["outcomes"]) / len(s["outcomes"])
                    s["low"] = s["low"] + 1 if mean < self.floor else 0
                    drifted = s["low"] >= self.run or s["baseline"] - mean >= self.drop
            out.append((key, trial, label, guess, c.name, s["round"], "live", mean, s["baseline"], drifted))
            if drifted or (self.tick and s["live"] >= self.tick):
                s |= {"round": s["round"] + 1, "live": 0, "outcomes": [], "low": 0, "baseline": None, "chosen": None, "classes": [], "weights": [], "biases": []}
        self.value.update(tuple(s.values()))
        return out

    def _choose(self, s: dict) -> None:
        scored = []
        for k, c in enumerate(self.candidates):
            rows = [(y, c.vector(v)) for y, v in zip(s["labels"], s["vectors"], strict=True)]
            scored.append((c.left_out_accuracy(rows), -k))
        s["baseline"], at = max(scored)
        s["chosen"] = -at
        c = self.candidates[s["chosen"]]
        classes, w, b = c.fit([(y, c.vector(v)) for y, v in zip(s["labels"], s["vectors"], strict=True)])
        s |= {"classes": classes, "weights": w.tolist(), "biases": b.tolist(), "labels": [], "vectors": []}

    def _frame(self, rows):
        return pd.DataFrame(rows, columns=list(self.out)).astype({"label": "Int32", "predicted": "Int32", "round": "Int32", "drift": "boolean"})


def selector(df: DataFrame, candidates: list[Candidate], calibrate: int = 20, window: int = 20, at_least: int = 10, run: int = 2, floor: float = 0.35, drop: float = 0.15, tick: int | None = None, key: str = "subject_id", number: str = "trial_id", label: str = "label", values: str = "features", ts: str = "ts", watermark: str = "10 seconds", expiry_ms: int | None = None) -> DataFrame:
    """df: a stream of trials (key, number, ts, label int or null, features). (key, trial_id, label, predicted, pipeline, round, phase, rolling_accuracy, baseline, drift), trials in order of time and number.

    ``calibrate`` labelled trials, and two classes at least, end a calibration: the candidate of the best leave-one-out accuracy (the first of equals) is fitted on them, and that accuracy is the
    baseline. Live trials with labels move the rolling accuracy; where its last ``run`` values lie below ``floor`` or it is ``drop`` below the baseline, or after ``tick`` live trials, the next round calibrates anew.
    Labels that are null or negative aren't known and come out as null: such trials are predicted and move nothing."""
    rows = _waiting(df.filter(F.col(values).isNotNull()).withColumn(label, F.coalesce(F.col(label).cast("int"), F.lit(-1))), key, ts, watermark, n=number, known=label, v=values)
    out = StructType([StructField("key", df.schema[key].dataType), *StructType.fromDDL("trial_id bigint, label int, predicted int, pipeline string, round int, phase string, rolling_accuracy double, baseline double, drift boolean").fields])
    return rows.transformWithStateInPandas(Selector(candidates, calibrate, window, at_least, run, floor, drop, tick, expiry_ms), out, "Append", "EventTime").withColumnRenamed("key", key)


def started(stream: DataFrame, path: str, trigger: dict | None = None):
    """Writes a stream with keyed state to Parquet at ``path``, its log beside it; all there is, then ends, unless a trigger says else."""
    spark = stream.sparkSession
    had = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        return stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}-log").trigger(**(trigger or {"availableNow": True})).start(path)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", had) if had else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run_once(stream: DataFrame) -> DataFrame:
    """Reads everything there is and returns the result as a table in the shared folder."""
    path = shared_path(stream.sparkSession, "stateful")
    started(stream, path).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
