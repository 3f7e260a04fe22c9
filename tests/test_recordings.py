import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_biosignal import gdf_file

from lattica.sources import biosignal as B
from lattica.sources import datasets as S
from lattica.sources import recordings as R


def edf_file(x, fs, marks, seconds=1, kind="EDF+C", begins=0.25):
    """x: whole numbers (channels, samples); marks: (seconds since the first sample, text), written in the record that is then going on."""
    n, per, room = len(x) + 1, int(fs * seconds), 60
    records = x.shape[1] // per
    cells = lambda values, w: b"".join(str(v).ljust(w).encode() for v in values)
    head = b"0".ljust(8) + b" " * 160 + b"01.01.0101.01.01" + cells([256 * (n + 1)], 8) + kind.ljust(44).encode() + cells([records, seconds, n], 8)[:16] + cells([n], 4)
    head += cells([f"C{k}" for k in range(n - 1)] + ["EDF Annotations"], 16) + b" " * 80 * n + cells(["uV"] * (n - 1) + [""], 8)
    head += cells([-100] * n, 8) + cells([100] * n, 8) + cells([-1000] * n, 8) + cells([1000] * n, 8) + b" " * 80 * n + cells([per] * (n - 1) + [room], 8) + b" " * 32 * n
    assert len(head) == 256 * (n + 1)
    body = b""
    for r in range(records):
        body += b"".join(c[r * per : (r + 1) * per].astype("<i2").tobytes() for c in x)
        text = b"+%g\x14\x14\x00" % (begins + r * seconds)
        text += b"".join(b"+%g\x152.5\x14%s\x14\x00" % (begins + t, w.encode()) for t, w in marks if r * seconds <= t < (r + 1) * seconds)
        body += text.ljust(2 * room, b"\0")
    return head + body


@pytest.mark.parametrize("split", [700, 1 << 20])
def test_ranges_of_a_file_give_what_the_whole_gives(spark, tmp_path, split):
    rng = np.random.RandomState(3)
    for k in (1, 2):
        events = [(s, c) for s, c in zip(range(20, 1900, 97), rng.choice([768, 769, 770, 771, 772], 20), strict=False)] + [(20, 769), (1960, 770), (5000, 771)]
        (tmp_path / f"A0{k}T.gdf").write_bytes(gdf_file(rng.randint(-1000, 1000, (3, 2000)), 100.0, events, (2.2, 1.25)[k - 1]))
    x = R.blocks(spark, str(tmp_path), "*.gdf", split=split)
    assert x.count() == 40 and (split > 1000 or x.rdd.getNumPartitions() > 20)
    key = lambda df: sorted((r["subject_id"], r["session"], r["trial_id"], r["label"], r["fs"], tuple(map(tuple, r["signal"]))) for r in df.collect())
    want = key(B.gdf(spark, str(tmp_path), seconds=2.0, channels=2))
    assert key(S.load("gdf_split", spark, path=str(tmp_path), seconds=2.0, channels=2, split=split)) == want and len(want) > 20
    assert {r[0] for r in R.gdf_split(spark, "file:" + str(tmp_path), 2.0, subjects=[2]).select("subject_id").distinct().collect()} == {2}


@pytest.mark.parametrize("seconds", [1, 0.1])
def test_edf_values_and_annotations(spark, tmp_path, seconds):
    x = np.random.RandomState(5).randint(-1000, 1000, (2, 1000))
    marks = [(0.0, "T0"), (1.5, "T1"), (4.22, "T2"), (9.5, "T1"), (8.3, "T2")]
    (tmp_path / "S001R04.edf").write_bytes(edf_file(x, 100, marks, seconds))
    got = R.blocks(spark, str(tmp_path), split=900).orderBy("block").collect()
    assert len(got) == 10 and [r["first"] for r in got] == list(range(0, 1000, 100)) and (got[0]["subject_id"], got[0]["session"], got[0]["fs"]) == (1, "R04", 100.0)
    assert np.allclose(np.concatenate([np.array(r["signal"]) for r in got], 1), x / 10 * 1e-6)
    e = R.events(spark, str(tmp_path), split=900)
    assert sorted((r["start"], r["code"]) for r in e.collect()) == sorted((round(t * 100), w) for t, w in marks)
    trials = R.edf(spark, str(tmp_path), seconds=2.0).orderBy("trial_id").collect()
    assert [r["label"] for r in trials] == [0, 1, 1]  # of the last movement too little is left
    assert np.allclose(trials[1]["signal"], x[:, 422:622] / 10 * 1e-6) and np.allclose(np.array(trials[2]["signal"])[:, 169:], x[:, -1:] / 10 * 1e-6)


def test_odd_recordings(spark, tmp_path):
    x = np.ones((1, 200), int)
    (tmp_path / "none1.edf").write_bytes(edf_file(x[:, :0], 100, []))
    (tmp_path / "cut2.edf").write_bytes(edf_file(x, 100, [(0.5, "T1")])[:-30])
    assert sorted((r["subject_id"], r["block"]) for r in R.blocks(spark, str(tmp_path)).collect()) == [(2, 0)]
    assert R.edf(spark, str(tmp_path), 1.0).count() == 0 and R.blocks(spark, str(tmp_path), "*.xyz").count() == 0
    (tmp_path / "d3.edf").write_bytes(edf_file(x, 100, [], kind="EDF+D"))
    with pytest.raises(Exception, match="discontinuous"):
        R.blocks(spark, str(tmp_path), "d3.edf").count()


def test_replay_arrives_with_the_clock_and_once(spark, tmp_path):
    x = np.random.RandomState(7).randint(-1000, 1000, (2, 3050))
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "S1R1.edf").write_bytes(edf_file(x, 100, []))
    reader = R.ReplayReader({"path": str(tmp_path / "r"), "speed": "2", "origin": str(time.time() - 5)})
    end = reader.latestOffset()
    assert 10_000 <= end["ms"] < 20_000 and len(reader.partitions({"ms": 0}, end)) == 1 and not reader.partitions({"ms": 30_000}, {"ms": 30_000})
    cut, seen = [0, 400, 1000, 1999, 17_301, 30_000], []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        seen += [k for p in reader.partitions({"ms": a}, {"ms": b}) for batch in reader.read(p) for k in batch.column(4).to_pylist()]
    assert seen == list(range(30))
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    origin = time.time()
    for speed in (4.0, 1000.0):  # stopped and restarted from its checkpoint
        q = R.replay(spark, str(tmp_path / "r"), speed=speed, origin=origin).writeStream.format("parquet").option("checkpointLocation", log).start(out)
        time.sleep(3)
        q.processAllAvailable()
        q.stop()
    got = spark.read.parquet(out)
    assert sorted(r[0] for r in got.select("block").collect()) == list(range(30)) and got.agg(F.max(F.size("signal"))).first()[0] == 2
