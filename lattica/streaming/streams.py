"""Structured streams of samples and outcomes: windows, drift, online selection, replay.

Event time is the truth: the time column must be a ``timestamp`` (cast ``timestamp_ntz`` first), late data is cut by a watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lattica.session import shared_path


def replay(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, max_files: int | None = None) -> DataFrame:
    """A folder of files as a stream; with max_files so many a micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema if schema is not None else spark.read.format(fmt).load(path).schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def timed(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling(df: DataFrame, ts: str, size: str, by: list[str], aggs: list, watermark: str = "1 hour") -> DataFrame:
    return sliding(df, ts, size, size, by, aggs, watermark)


def sliding(df: DataFrame, ts: str, size: str, slide: str, by: list[str], aggs: list, watermark: str = "1 hour") -> DataFrame:
    """Works on streams and on tables alike; on a table the watermark has no effect."""
    w = df.withWatermark(ts, watermark) if df.isStreaming else df
    return w.groupBy(F.window(ts, size, slide).alias("window"), *by).agg(*aggs).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, *[c for c in _names(aggs)])


def sessions(df: DataFrame, ts: str, gap: str, by: list[str], aggs: list, watermark: str = "1 hour") -> DataFrame:
    w = df.withWatermark(ts, watermark) if df.isStreaming else df
    return w.groupBy(F.session_window(ts, gap).alias("window"), *by).agg(*aggs).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, *_names(aggs))


def _names(aggs) -> list[str]:
    return [a._jc.toString().rpartition(" AS ")[2].strip("`") for a in aggs]


DRIFT_SCHEMA = "subject_id long, event_id long, accuracy double, baseline double, drift boolean"
DRIFT_STATE = "outcomes array<double>, rolling array<double>, last long"


def drift_kernel(window: int, at_least: int, run: int, floor: float, drop: float, baseline: float) -> Callable:
    """Per subject: the mean of the last ``window`` outcomes; drift where the last ``run`` means are all below ``floor`` or the mean is ``drop`` below the baseline.

    The state is two bounded lists, carried across micro-batches; rows of a batch are put in order of event_id first, and rows at or before the last one seen are left out
    (``stateful`` has processors that put late rows in order)."""

    def kernel(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        outcomes, rolling, last = ([list(x) if isinstance(x, (list, tuple)) or hasattr(x, "__iter__") else x for x in state.get] if state.exists else [[], [], -(1 << 63)])
        rows = pd.concat(list(batches)).sort_values("event_id", kind="stable")
        out = []
        for event_id, correct in zip(rows["event_id"], rows["correct"], strict=True):
            if event_id <= last:
                continue
            last = int(event_id)
            outcomes = [*outcomes, float(correct)][-window:]
            mean = sum(outcomes) / len(outcomes) if len(outcomes) >= at_least else None
            drift = False
            if mean is not None:
                rolling = [*rolling, mean][-run:]
                drift = (len(rolling) == run and max(rolling) < floor) or baseline - mean >= drop
            out.append((key[0], last, mean, baseline, drift))
        state.update((outcomes, rolling, last))
        yield pd.DataFrame(out, columns=["subject_id", "event_id", "accuracy", "baseline", "drift"])

    return kernel


def drift(df: DataFrame, window: int = 20, at_least: int = 10, run: int = 2, floor: float = 0.35, drop: float = 0.15, baseline: float = 0.8) -> DataFrame:
    """df: a stream of (subject_id, event_id, correct)."""
    k = drift_kernel(window, at_least, run, floor, drop, baseline)
    return df.select("subject_id", "event_id", "correct").groupBy("subject_id").applyInPandasWithState(k, DRIFT_SCHEMA, DRIFT_STATE, "append", GroupStateTimeout.NoTimeout)


def drift_table(df: DataFrame, window: int = 20, at_least: int = 10, run: int = 2, floor: float = 0.35, drop: float = 0.15, baseline: float = 0.8) -> DataFrame:
    """The same rows from a table, in SQL windows: what the stream must equal."""
    from pyspark.sql import Window as W

    w = W.partitionBy("subject_id").orderBy("event_id")
    last = w.rowsBetween(-(window - 1), 0)
    r = df.select("subject_id", "event_id", "correct").withColumn("accuracy", F.when(F.count(F.lit(1)).over(last) >= at_least, F.avg("correct").over(last)))
    means = w.rowsBetween(-(run - 1), 0)
    low = (F.count("accuracy").over(means) == run) & (F.max("accuracy").over(means) < floor)
    return r.select("subject_id", "event_id", "accuracy", F.lit(baseline).alias("baseline"), F.coalesce(low | (F.lit(baseline) - F.col("accuracy") >= drop), F.lit(False)).alias("drift"))


RING_SCHEMA = "subject_id long, start long, stop long, total double"
RING_STATE = "first long, skip long, samples array<double>"


def ring_kernel(window: int, step: int) -> Callable:
    """Per subject: full windows of the newest samples, each ``step`` after the one before; the state holds the samples not yet behind every window, and how many of those to come lie between windows."""

    def kernel(key, batches, state: GroupState):
        first, skip, held = (state.get[0], state.get[1], list(state.get[2])) if state.exists else (0, 0, [])
        rows = pd.concat(list(batches)).sort_values("idx", kind="stable")
        new = [float(v) for v in rows["value"]]
        held, skip = held + new[skip:], max(0, skip - len(new))
        out = []
        while len(held) >= window:
            out.append((key[0], first, first + window, sum(held[:window])))
            skip = max(0, step - len(held))
            held, first = held[step:], first + step
        state.update((first, skip, held))
        yield pd.DataFrame(out, columns=["subject_id", "start", "stop", "total"])

    return kernel


def ring_windows(df: DataFrame, window: int, step: int) -> DataFrame:
    """df: a stream of (subject_id, idx, value), in order across micro-batches."""
    return df.select("subject_id", "idx", "value").groupBy("subject_id").applyInPandasWithState(ring_kernel(window, step), RING_SCHEMA, RING_STATE, "append", GroupStateTimeout.NoTimeout)


ONLINE_SCHEMA = "subject_id long, trial_id long, label int, predicted int, correct boolean, phase string"
ONLINE_STATE = "n int, labels array<int>, counts array<int>, sums array<double>"


def online_kernel(calibrate: int, width: int) -> Callable:
    """Per subject: the first ``calibrate`` labelled trials are learnt from (class means), later ones are predicted by the nearest mean. Without labelled trials nothing is
    predicted: predicted is null, and calibration goes on."""

    def kernel(key, batches, state: GroupState):
        n, labels, counts, sums = (state.get[0], list(state.get[1]), list(state.get[2]), list(state.get[3])) if state.exists else (0, [], [], [])
        rows = pd.concat(list(batches)).sort_values("trial_id", kind="stable")
        out = []
        for trial, label, x in zip(rows["trial_id"], rows["label"], rows["features"], strict=True):
            known = label is not None and label == label
            if n < calibrate:
                if known:
                    if int(label) not in labels:
                        labels.append(int(label))
                        counts.append(0)
                        sums += [0.0] * width
                    k = labels.index(int(label))
                    counts[k] += 1
                    for j in range(width):
                        sums[k * width + j] += float(x[j])
                    n += 1
                out.append((key[0], int(trial), int(label) if known else None, None, None, "calibrate"))
                continue
            far = [sum((float(x[j]) - sums[k * width + j] / counts[k]) ** 2 for j in range(width)) for k in range(len(labels))]
            guess = min(zip(far, labels, strict=True))[1]
            out.append((key[0], int(trial), int(label) if known else None, guess, bool(guess == int(label)) if known else None, "predict"))
        state.update((n, labels, counts, sums))
        df = pd.DataFrame(out, columns=["subject_id", "trial_id", "label", "predicted", "correct", "phase"])
        yield df.astype({"label": "Int32", "predicted": "Int32", "correct": "boolean"})

    return kernel


def online_selector(df: DataFrame, calibrate: int, width: int) -> DataFrame:
    """df: a stream of (subject_id, trial_id, label, features)."""
    return df.select("subject_id", "trial_id", "label", "features").groupBy("subject_id").applyInPandasWithState(online_kernel(calibrate, width), ONLINE_SCHEMA, ONLINE_STATE, "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Reads everything there is and returns the result as a table: files in the shared folder, appended, or (complete) written anew with each micro-batch."""
    spark = stream.sparkSession
    path = shared_path(spark, "stream")
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-log").trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").start(path)
    else:
        q = w.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def publish(stream: DataFrame, subscribers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, topic: str = "topic"):
    """Each micro-batch's rows go to the subscriber of their topic."""

    def batch(df: DataFrame, epoch: int) -> None:
        for name, f in subscribers.items():
            f(df.filter(F.col(topic) == name), epoch)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feedback(predictions: DataFrame, corrections: DataFrame, key: str = "trial_id", within: str = "1 hour") -> DataFrame:
    """Every prediction once, with its correction or without: (key, ts, predicted, corrected, corrected_ts, right). A stream-stream outer join on the trial, bounded in time.

    predictions: (key, ts, predicted); corrections: (key, ts, corrected), taken up to ``within`` after the prediction. A prediction without one comes out, with nulls, once the watermark has passed
    that time; its state goes then, and a correction's too, so each is handed on once. Of several corrections of a trial each comes out."""
    p = predictions.select(F.col(key), "ts", "predicted").withWatermark("ts", within)
    c = corrections.select(F.col(key).alias("_key"), F.col("ts").alias("corrected_ts"), "corrected").withWatermark("corrected_ts", within)
    near = F.col("corrected_ts").between(F.col("ts"), F.col("ts") + F.expr(f"interval {within}"))
    out = p.join(c, (F.col(key) == F.col("_key")) & near, "leftOuter")
    return out.select(key, "ts", "predicted", "corrected", "corrected_ts", (F.col("predicted") == F.col("corrected")).alias("right"))
