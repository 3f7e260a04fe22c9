"""Recordings (GDF, EDF and EDF+) as tables of blocks of samples and of events, read in ranges of a file's bytes; and their replay as a stream at the sample clock.

A block holds about a second: the fewest whole records that last so long. The driver only lists files; a task reads the header (a few kB) and the blocks that begin in its
range, so a file of any size is read by many tasks, none of which holds more than READ_BYTES of it. Files are opened by pyarrow's file systems, so paths may be local or on
HDFS, S3 or GCS. ``A01T.gdf`` is subject 1, session T; ``S001R04.edf`` is subject 1, session R04.

Defined results: a file without events has no row in the table of events; an event beyond the samples is kept there and makes no trial; a record that a file's end cuts short is left out, as the header's count can't hold;
a recording without samples has no block; channels of different rates and discontinuous EDF+ are errors that name the file.
"""

from __future__ import annotations

import fnmatch
import re
import time

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lattica.sources.biosignal import CUES, LEAST_SECONDS, Layout, edf_layout, edf_marks, gdf_events, gdf_layout
from lattica.sources.datasets import REGISTRY

#: Bytes of a file that one task reads, and that it holds at a time.
SPLIT_BYTES, READ_BYTES = 64 << 20, 4 << 20
#: Seconds that a block has at least, where the recording goes on so long.
BLOCK_SECONDS = 1.0

BLOCKS = "file string, subject_id long, session string, fs double, block long, first long, signal array<array<double>>"
EVENTS = "file string, subject_id long, session string, fs double, per long, samples long, start long, code string"


def _system(path: str):
    path = re.sub(r"^file:/*", "/", path)
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


def listed(path: str, pattern: str, subjects: set[int] | None = None) -> list[tuple[str, int]]:
    """(path, bytes) of the files below a path, or of that file, whose name fits."""
    system, inner = _system(path)
    top = system.get_file_info(inner)
    found = [top] if top.type == arrow_fs.FileType.File else system.get_file_info(arrow_fs.FileSelector(inner, recursive=True))
    scheme = path.split("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    out = [(scheme + f.path, f.size) for f in found if f.type == arrow_fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern)]
    return sorted(x for x in out if subjects is None or named(x[0])[0] in subjects)


def named(path: str) -> tuple[int | None, str]:
    """Subject and session from a file's name."""
    found = re.search(r"(\d+)([A-Za-z]+\d*)?", path.rsplit("/", 1)[-1].rsplit(".", 1)[0])
    return (int(found[1]), found[2] or "") if found else (None, "")


class Opened:
    """A recording of which the header has been read."""

    def __init__(self, path: str):
        system, inner = _system(path)
        self.path, self.file = path, system.open_input_file(inner)
        self.size = self.file.size()
        head = self.file.read_at(256, 0)
        gdf = head.startswith(b"GDF")
        n = (int.from_bytes(head[252:254], "little") if gdf else int(head[252:256])) if len(head) == 256 else 0
        try:
            head = self.file.read_at(256 * (n + 1), 0)
            self.layout: Layout = (gdf_layout if gdf else edf_layout)(head, self.size)
        except ValueError as e:
            raise ValueError(f"{path}: {e}") from e
        self.gdf = gdf
        at = self.layout
        self.records = min(at.records, (self.size - at.start) // at.record_bytes)  # whole ones
        self.group = max(1, int(np.ceil(BLOCK_SECONDS / at.record_seconds - 1e-9))) if at.record_seconds > 0 else 1
        self.blocks = -(-self.records // self.group)

    def within(self, low: int, high: int) -> range:
        """The blocks of which the first byte lies in [low, high)."""
        unit = self.layout.record_bytes * self.group
        edge = lambda x: min(self.blocks, max(0, -((self.layout.start - x) // unit)))  # noqa: E731  rounded up
        return range(edge(low), edge(high))

    def raw(self, blocks: range):
        """(first block, records as bytes), READ_BYTES or one block at a time."""
        at = self.layout
        step = max(1, READ_BYTES // (at.record_bytes * self.group))
        for k in range(blocks.start, blocks.stop, step):
            first, last = k * self.group, min(self.records, min(k + step, blocks.stop) * self.group)
            body = self.file.read_at((last - first) * at.record_bytes, at.start + first * at.record_bytes)
            yield k, np.frombuffer(body, np.uint8).reshape(-1, at.record_bytes)

    def signals(self, blocks: range, channels: int | None):
        """Arrow batches with the columns of BLOCKS."""
        subject, session = named(self.path)
        per = self.layout.per_record * self.group
        for k, body in self.raw(blocks):
            x = self.layout.signal(body)[:channels]
            cuts = np.r_[np.arange(0, x.shape[1], per), x.shape[1]]
            rows, size = len(cuts) - 1, np.diff(cuts)
            values = np.concatenate([x[:, a:b].ravel() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
            inner = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.repeat(size, len(x)))].astype(np.int32)), pa.array(values))
            signal = pa.ListArray.from_arrays(pa.array((np.arange(rows + 1) * len(x)).astype(np.int32)), inner)
            number = np.arange(k, k + rows, dtype=np.int64)
            same = lambda v, t, rows=rows: pa.array([v] * rows, t)
            columns = [same(self.path, pa.string()), same(subject, pa.int64()), same(session, pa.string()), same(self.layout.fs, pa.float64()), pa.array(number), pa.array(number * per), signal]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "subject_id", "session", "fs", "block", "first", "signal"])

    def events(self, low: int, high: int):
        """(sample, code) of the events that are written in [low, high): in the records there, or in a table at the end, which counts for the range that holds its first byte."""
        at = self.layout
        if not self.gdf:
            for k, body in self.raw(self.within(low, high)):
                yield from edf_marks(at, body, k * self.group)
            return
        table = at.start + at.records * at.record_bytes
        if low <= table < high:
            yield from ((start, str(code)) for start, code in gdf_events(self.file.read_at(self.size - table, table), at.version))


class ByteRange(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class RecordingReader(DataSourceReader):
    """A partition for each SPLIT_BYTES (option ``split``) of a file."""

    def __init__(self, options, events: bool):
        self.path, self.pattern, self.only_events = options["path"], options.get("pattern", "*"), events
        self.split, self.channels = int(options.get("split", SPLIT_BYTES)), int(options["channels"]) if options.get("channels") else None
        self.subjects = {int(s) for s in options["subjects"].split(",")} if options.get("subjects") else None

    def partitions(self):
        return [ByteRange(p, low, min(size, low + self.split)) for p, size in listed(self.path, self.pattern, self.subjects) for low in range(0, size, self.split)]

    def read(self, partition):
        if partition is None:  # no file at all
            return
        held = Opened(partition.path)
        if not self.only_events:
            yield from held.signals(held.within(partition.low, partition.high), self.channels)
            return
        found = list(held.events(partition.low, partition.high))
        subject, session = named(partition.path)
        fixed = (partition.path, subject, session, held.layout.fs, held.layout.per_record * held.group, held.records * held.layout.per_record)
        yield from ((*fixed, int(start), code) for start, code in found)


class MilliRange(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class ReplayReader(DataSourceStreamReader):
    """Offsets are milliseconds of recorded time. A block arrives when its last sample has; with ``speed`` at that multiple of the clock since ``origin`` (seconds since 1970), without it at once.

    A query that is restarted must be given the origin that it had: offsets are computed from it, never kept in memory."""

    def __init__(self, options):
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.channels = int(options["channels"]) if options.get("channels") else None
        self.speed, self.origin = float(options.get("speed", 0)), float(options.get("origin", 0))
        if self.speed and not self.origin:
            raise ValueError("a replay at a speed needs its origin")
        self.files = None

    def _files(self):
        if self.files is None:  # a header a file is read here, once
            self.files = [(p, self._ends(Opened(p))) for p, _ in listed(self.path, self.pattern)]
        return self.files

    @staticmethod
    def _ends(held: Opened) -> int:
        return int(np.ceil(held.records * held.layout.record_seconds * 1000))

    def initialOffset(self):  # noqa: N802
        return {"ms": 0}

    def latestOffset(self):  # noqa: N802
        last = max((ms for _, ms in self._files()), default=0)
        return {"ms": min(last, max(0, int((time.time() - self.origin) * 1000 * self.speed))) if self.speed else last}

    def partitions(self, start, end):
        return [MilliRange(p, start["ms"], end["ms"]) for p, ms in self._files() if start["ms"] < min(ms, end["ms"])]

    def read(self, partition):
        held = Opened(partition.path)
        whole = self._ends(held)
        per = held.layout.record_seconds * held.group * 1000
        done = lambda ms: held.blocks if ms >= whole else int(ms / per + 1e-9)  # noqa: E731  blocks that have ended
        yield from held.signals(range(done(partition.low), done(partition.high)), self.channels)


class Recordings(DataSource):
    """Blocks of samples; ``readStream`` replays them."""

    @classmethod
    def name(cls):
        return "recordings"

    def schema(self):
        return BLOCKS

    def reader(self, schema):
        return RecordingReader(self.options, False)

    def streamReader(self, schema):  # noqa: N802
        return ReplayReader(self.options)


class RecordingEvents(DataSource):
    @classmethod
    def name(cls):
        return "recording_events"

    def schema(self):
        return EVENTS

    def reader(self, schema):
        return RecordingReader(self.options, True)


def _given(**options) -> dict[str, str]:
    return {k: ",".join(map(str, v)) if isinstance(v, (list, tuple, set)) else str(v) for k, v in options.items() if v is not None}


def blocks(spark: SparkSession, path: str, pattern: str = "*", channels: int | None = None, subjects: list[int] | None = None, split: int = SPLIT_BYTES) -> DataFrame:
    """(file, subject_id, session, fs, block, first, signal): ``first`` is the number of the block's first sample, ``signal`` is by channel, in volts where the unit says so."""
    spark.dataSource.register(Recordings)
    return spark.read.format("recordings").options(**_given(path=path, pattern=pattern, channels=channels, subjects=subjects, split=split)).load()


def events(spark: SparkSession, path: str, pattern: str = "*", subjects: list[int] | None = None, split: int = SPLIT_BYTES) -> DataFrame:
    """(file, subject_id, session, fs, per, samples, start, code): ``start`` counts samples, ``per`` is the samples of a block, ``samples`` those of the recording."""
    spark.dataSource.register(RecordingEvents)
    return spark.read.format("recording_events").options(**_given(path=path, pattern=pattern, subjects=subjects, split=split)).load()


def replay(spark: SparkSession, path: str, pattern: str = "*", channels: int | None = None, speed: float | None = None, origin: float | None = None) -> DataFrame:
    """The blocks as a stream. With a speed, pass the same origin again where the query is restarted from its checkpoint; left out, it is now."""
    spark.dataSource.register(Recordings)
    origin = origin if origin is not None or not speed else time.time()
    return spark.readStream.format("recordings").options(**_given(path=path, pattern=pattern, channels=channels, speed=speed, origin=origin)).load()


def cut(samples: DataFrame, marks: DataFrame, codes: dict[str, int], seconds: float) -> DataFrame:
    """Trials of ``seconds`` from each event whose code has a label: an equi-join of events with the blocks that they touch, a few a trial.

    A trial that the recording's end cuts short counts from LEAST_SECONDS on, its last sample repeated; trial_id numbers the trials of a file in order of start and code."""
    label = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    n, left = F.floor(F.lit(seconds) * F.col("fs")).cast("int"), F.col("samples") - F.col("start")
    e = marks.filter(F.col("code").isin(list(codes)) & (F.col("start") >= 0)).withColumn("label", F.try_element_at(label, F.col("code")).cast("int")).withColumn("n", n)
    e = e.filter((left > 0) & (F.least(left, F.col("n")) >= F.floor(F.lit(LEAST_SECONDS) * F.col("fs"))))
    e = e.withColumn("trial_id", (F.row_number().over(W.partitionBy("file").orderBy("start", "code")) - 1).cast("long"))  # events of one file
    last = F.least(F.col("start") + F.col("n"), F.col("samples")) - 1
    e = e.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / F.col("per")), F.floor(last / F.col("per")))))
    met = e.select("file", "block", "trial_id", "label", "start", "n").join(samples, ["file", "block"])
    g = met.groupBy("file", "trial_id").agg(
        *[F.first(c).alias(c) for c in ("subject_id", "session", "fs", "label", "start", "n")], F.min("first").alias("first"), F.array_sort(F.collect_list(F.struct("block", "signal"))).alias("parts")
    )
    channels = F.sequence(F.lit(1), F.size(F.col("parts")[0]["signal"]))
    whole = F.transform(channels, lambda c: F.flatten(F.transform("parts", lambda p: F.element_at(p["signal"], c))))
    part = F.transform(whole, lambda x: F.slice(x, (F.col("start") - F.col("first") + 1).cast("int"), F.col("n")))
    full = F.transform(part, lambda x: F.concat(x, F.array_repeat(F.element_at(x, -1), F.col("n") - F.size(x))))
    return g.select("subject_id", "session", "trial_id", "label", "fs", full.alias("signal"))


def _trials(dataset: str, pattern: str, codes: dict[str, int]):
    def load(spark: SparkSession, path: str, seconds: float = 3.0, channels: int | None = None, subjects: list[int] | None = None, split: int = SPLIT_BYTES) -> DataFrame:
        x = cut(blocks(spark, path, pattern, channels, subjects, split), events(spark, path, pattern, subjects, split), codes, seconds)
        return x.select(F.lit(dataset).alias("dataset"), *x.columns)

    return load


#: Annotations of the two imagined movements of a run; rest (T0) is no trial.
MOVEMENTS = {"T1": 0, "T2": 1}

gdf_split = _trials("gdf", "*.gdf", {str(k): v for k, v in CUES.items()})
edf = _trials("edf", "*.edf", MOVEMENTS)
REGISTRY |= {"gdf_split": gdf_split, "edf": edf}
