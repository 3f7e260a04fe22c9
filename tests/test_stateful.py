import random
import time

import numpy as np
import pytest

from lattica.streaming import stateful as T
from lattica.streaming import streams as R
from pyspark.sql import functions as F

SAMPLES = "subject_id long, idx long, ts timestamp, values array<double>"


def written(spark, rows, schema, path, cuts):
    """Rows as a stream of so many micro-batches, cut where told."""
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        part = spark.createDataFrame(rows[a:b], schema).coalesce(1)
        part.write.mode("append").parquet(str(path / f"p{k:02d}"))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(path))


def at(second):
    return time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(1_700_000_000 + second))


def samples(n, subjects=2):
    """In order but for neighbours, which change places; then a row that moves the watermark past all."""
    rng = random.Random(n)
    rows = [(s, k, k, [float(k), float(s)]) for k in range(n) for s in range(subjects)]
    for i in range(0, len(rows) - 4, 3):
        if rng.random() < 0.5:
            rows[i], rows[i + 4] = rows[i + 4], rows[i]
    return rows + [(99, 0, n + 1000, [0.0, 0.0])]


def timed(spark, rows):
    from datetime import datetime, timezone

    return [(s, k, datetime.fromtimestamp(1_700_000_000 + t, timezone.utc), v) for s, k, t, v in rows]


def test_windows_do_not_depend_on_micro_batches(spark, tmp_path):
    rows = timed(spark, samples(60))
    for window, step in ((8, 4), (2, 5), (5, 5)):
        want = sorted((s, a, a + window, [sum(range(a, a + window)), window * s]) for s in range(2) for a in range(0, 60 - window + 1, step))
        for k, cuts in enumerate(([], sorted(random.Random(window).sample(range(1, len(rows) - 1), 3)))):
            stream = written(spark, rows, SAMPLES, tmp_path / f"{window}-{step}-{k}", cuts)
            got = T.run_once(T.windows(stream, window, step, lambda x: x.sum(1), watermark="20 seconds")).filter("subject_id < 9").collect()
            assert sorted((r["subject_id"], r["start"], r["stop"], r["scores"]) for r in got) == want


def test_ring_windows_wider_steps_and_batches(spark):
    class State:
        def __init__(self):
            self.exists, self.get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    import pandas as pd

    for window, step in ((2, 5), (4, 2), (3, 3), (1, 4)):
        want = [(a, float(sum(range(a, a + window)))) for a in range(0, 40 - window + 1, step)]
        for seed in range(6):
            cuts = sorted(random.Random(seed).sample(range(1, 40), seed))
            kernel, state, got = R.ring_kernel(window, step), State(), []
            for a, b in zip([0, *cuts], [*cuts, 40]):
                frame = pd.DataFrame({"subject_id": 1, "idx": range(a, b), "value": np.arange(a, b, dtype=float)})
                got += [(r.start, r.total) for out in kernel((1,), iter([frame]), state) for r in out.itertuples(index=False)]
            assert got == want


def test_drift_keeps_negative_ids(spark, tmp_path):
    df = spark.range(40).select(F.lit(1).cast("long").alias("subject_id"), (F.col("id") - 20).alias("event_id"), (F.col("id") % 3 > 0).cast("double").alias("correct"))
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    got = R.run_once(R.drift(R.replay(spark, str(tmp_path / "d"), schema=df.schema)))
    assert got.count() == 40 and got.agg(F.min("event_id")).first()[0] == -20


TRIALS = "subject_id long, trial_id long, ts timestamp, label int, features array<double>"


def trials(n, turn):
    """Two classes told apart by the second feature; from trial ``turn`` on by its opposite. The first feature is louder and tells nothing."""
    from datetime import datetime, timezone

    rng = np.random.RandomState(3)
    rows = []
    for k in range(n):
        y = k % 2
        sign = 1 if k < turn else -1
        known = None if k % 11 == 7 else -1 if k % 11 == 5 else y
        rows.append((1, k, datetime.fromtimestamp(1_700_000_000 + k, timezone.utc), known, [float(5 * rng.normal()), float(sign * (2 * y - 1) + 0.2 * rng.normal())]))
    return rows + [(99, n, datetime.fromtimestamp(1_700_000_000 + n + 1000, timezone.utc), 0, [0.0, 0.0])]


def test_selector_chooses_predicts_drifts_and_calibrates_anew(spark, tmp_path):
    rows = trials(200, 100)
    candidates = [T.Candidate("loud", [0]), T.Candidate("telling", [1]), T.Candidate("both", None, 0.5)]
    results = []
    for k, cuts in enumerate(([], [17, 90, 133])):
        mixed = list(rows)
        if k:
            for i in range(0, 190, 5):
                mixed[i], mixed[i + 2] = mixed[i + 2], mixed[i]
        stream = written(spark, mixed, TRIALS, tmp_path / f"t{k}", cuts)
        out = T.run_once(T.selector(stream, candidates, calibrate=16, window=10, at_least=5, drop=0.3, watermark="15 seconds")).filter("subject_id = 1")
        results.append([tuple(r) for r in out.orderBy("trial_id").collect()])
    assert results[0] == results[1] and len(results[0]) == 200
    r = [dict(zip(("subject", "trial", "label", "guess", "pipeline", "round", "phase", "rolling", "baseline", "drift"), x)) for x in results[0]]
    first = [x for x in r if x["round"] == 0]
    assert sum(x["phase"] == "calibrate" and x["label"] is not None for x in first) == 16
    live = [x for x in r if x["phase"] == "live"]
    assert {x["pipeline"] for x in live} <= {"telling", "both"} and live[0]["baseline"] > 0.9
    drifts = [x["trial"] for x in r if x["drift"]]
    assert drifts and 100 < drifts[0] < 115
    late = [x for x in live if x["round"] == 1 and x["label"] is not None]
    assert late and np.mean([x["guess"] == x["label"] for x in late]) > 0.9
    assert all(x["guess"] is not None for x in live)


def test_ticks_end_a_round(spark, tmp_path):
    stream = written(spark, trials(120, 500), TRIALS, tmp_path / "tick", [])
    out = T.run_once(T.selector(stream, [T.Candidate("telling", [1])], calibrate=10, tick=20, watermark="5 seconds")).filter("subject_id = 1")
    by = {r["round"]: r["n"] for r in out.filter("phase = 'live'").groupBy("round").agg(F.count("*").alias("n")).collect()}
    assert by[0] == by[1] == 20 and len(by) >= 3


def test_candidates_fitted_from_labelled_vectors():
    rng = np.random.RandomState(0)
    rows = [(k % 3, rng.normal(size=4) + 3 * np.eye(4)[k % 3]) for k in range(60)]
    for shrinkage in (0.0, 0.3, 1.0):
        c = T.Candidate("x", None, shrinkage)
        right = 0
        for k, (y, v) in enumerate(rows):
            classes, w, b = c.fit(rows[:k] + rows[k + 1 :])
            right += classes[int(np.argmax(w @ v + b))] == y
        assert c.left_out_accuracy(rows) == right / 60 > 0.8
    x = np.stack([v for _, v in rows])
    means = np.stack([x[[y == c for y, _ in rows]].mean(0) for c in range(3)])
    classes, w, b = T.Candidate("x").fit(rows)  # shrunk whole: the nearest mean
    assert all(np.argmax(w @ v + b) == np.argmin(((means - v) ** 2).sum(1)) for v in x)
    assert T.Candidate("x").left_out_accuracy([(0, np.zeros(1)), (1, np.ones(1))]) == 0.0


def test_the_clock_repeats_the_last_window(spark, tmp_path):
    stream = written(spark, timed(spark, [(1, k, k, [float(k)]) for k in range(10)]), SAMPLES, tmp_path / "clock", [])
    path = str(tmp_path / "out")
    q = T.started(T.clocked(stream, 4, 8, 300, lambda x: x.sum(1), idle_ticks=3), path, {"processingTime": "300 milliseconds"})
    try:
        deadline = time.time() + 60
        got = []
        while time.time() < deadline and len(got) < 3:
            time.sleep(2)
            got = spark.read.schema("subject_id long, start long, stop long, repeated boolean, scores array<double>").parquet(path).collect() if (tmp_path / "out" / "_spark_metadata").exists() else []
        time.sleep(4)
        got = spark.read.parquet(path).collect()
    finally:
        q.stop()
    assert len(got) == 3  # one with samples, two idle ticks, then silence
    assert {(r["start"], r["stop"], tuple(r["scores"])) for r in got} == {(6, 10, (30.0,))} and sorted(r["repeated"] for r in got) == [False, True, True]
    with pytest.raises(ValueError):
        T.clocked(stream, 9, 8, 300, lambda x: x)


def test_feedback_hands_each_prediction_on_once(spark, tmp_path):
    from datetime import datetime, timezone

    t = lambda s: datetime.fromtimestamp(1_700_000_000 + s, timezone.utc)
    predictions = [(k, t(10 * k), k % 2) for k in range(20)] + [(999, t(100_000), 0)]
    corrections = [(k, t(10 * k + 5), 1) for k in range(0, 20, 3)] + [(4, t(40 + 7200), 1), (999, t(100_001), 0)]
    ps = written(spark, predictions, "trial_id long, ts timestamp, predicted int", tmp_path / "p", [7, 15])
    cs = written(spark, corrections, "trial_id long, ts timestamp, corrected int", tmp_path / "c", [3])
    got = R.run_once(R.feedback(ps, cs)).filter("trial_id < 999").collect()
    assert sorted((r["trial_id"], r["corrected"], r["right"]) for r in got) == [(k, 1 if k % 3 == 0 else None, k % 2 == 1 if k % 3 == 0 else None) for k in range(20)]
