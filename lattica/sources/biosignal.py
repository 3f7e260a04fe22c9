"""Trials from recordings: GDF (1.x and 2.x) and MAT (level 5) files, read by their public binary layouts.

Files are read with Spark's ``binaryFile``, so from any store; a file is one row and becomes its trials in one pass. ``A01T.gdf`` is subject 1, session T.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.sources.datasets import REGISTRY, TRIAL_SCHEMA

#: Sample types of GDF, by their numbers.
GDF_TYPES = {1: "<i1", 2: "<u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<i8", 8: "<u8", 16: "<f4", 17: "<f8"}
#: Codes of GDF 2 for the units V, mV, uV and nV, and their size in volts.
VOLTS = {4256: 1.0, 4274: 1e-3, 4275: 1e-6, 4276: 1e-9}
#: The same units by their names.
UNITS = {b"V": 1.0, b"mV": 1e-3, b"uV": 1e-6, b"nV": 1e-9}
#: The name of EDF+'s channels of annotations, and the form of a list of them: onset, duration or none, texts.
MARKS, _MARK = b"EDF Annotations", re.compile(rb"([+-]\d+(?:\.\d*)?)(?:\x15[\d.]*)?\x14([^\x00]*)\x00")
#: Trigger codes of the four cues (left hand, right hand, feet, tongue), in order of their labels.
CUES = {769: 0, 770: 1, 771: 2, 772: 3}
#: Numeric types of MAT elements, and the classes of arrays that hold numbers.
MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MAT_NUMBERS = range(6, 16)
#: A trial that a recording's end cuts short counts from so many seconds on; the last sample is repeated up to its full length.
LEAST_SECONDS = 1.5


@dataclass(frozen=True)
class Layout:
    """Where the samples of a recording lie, and their scale: records end to end from byte ``start``; in each the channels one after another."""

    fs: float
    names: list[str]
    start: int
    records: int
    per_record: int
    record_seconds: float
    kinds: list[str]
    edge: np.ndarray
    taken: list[int]
    digital_low: np.ndarray
    ratio: np.ndarray
    low: np.ndarray
    scale: np.ndarray
    version: float = 0.0

    @property
    def record_bytes(self) -> int:
        return int(self.edge[-1])

    def signal(self, body: np.ndarray) -> np.ndarray:
        """(channels, samples) in volts where the unit says so; body: bytes by record."""
        cells = [np.ascontiguousarray(body[:, self.edge[k] : self.edge[k + 1]]).view(self.kinds[k]).reshape(-1).astype(np.float64) for k in self.taken]
        digital = np.stack(cells) if cells else np.zeros((0, 0))
        return ((digital - self.digital_low[:, None]) * self.ratio[:, None] + self.low[:, None]) * self.scale[:, None]


def _ratio(low, high, digital_low, digital_high):
    return (high - low) / np.where(digital_high > digital_low, digital_high - digital_low, 1.0)


def gdf_layout(raw: bytes, size: int) -> Layout:
    """From the header: 256 bytes, and 256 a channel. size: bytes of the file."""
    text = raw[:8].decode("latin-1")
    if not text.startswith("GDF"):
        raise ValueError("not a GDF file")
    version = float(text[3:].strip().strip("\x00"))
    new = version >= 1.9
    header = struct.unpack_from("<H", raw, 184)[0] * 256 if new else struct.unpack_from("<q", raw, 184)[0]
    records, top, bottom = struct.unpack_from("<qII", raw, 236)
    n = struct.unpack_from("<H" if new else "<I", raw, 252)[0]
    at = 256

    def column(kind: str, skip: int = 0) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, n, at) if kind else np.zeros(0)
        at += n * (np.dtype(kind).itemsize if kind else skip)
        return out

    names = [x.split(b"\x00")[0].decode("latin-1").strip() for x in column("S16").tolist()]
    column("", 80)
    if new:
        column("", 6)
        scale = np.array([VOLTS.get(int(u), 1.0) for u in column("<u2")])
    else:
        scale = np.array([UNITS.get(u.split(b"\x00")[0].strip(), 1.0) for u in column("S8").tolist()])
    low, high = column("<f8"), column("<f8")
    digital_low, digital_high = (column("<f8" if new else "<i8").astype(np.float64) for _ in range(2))
    column("", 80)
    per_record, kinds = column("<u4").astype(int), [GDF_TYPES[int(k)] for k in column("<u4")]
    if n == 0 or len(set(per_record.tolist())) > 1:
        raise ValueError("channels of different rates")
    edge = np.r_[0, np.cumsum([k * np.dtype(t).itemsize for k, t in zip(per_record, kinds, strict=True)])]
    if records < 0:
        records = (size - header) // max(1, int(edge[-1]))
    return Layout(float(per_record[0]) * bottom / top, names, header, int(records), int(per_record[0]), top / bottom, kinds, edge, list(range(n)), digital_low, _ratio(low, high, digital_low, digital_high), low, scale, version)


def gdf_events(table: bytes, version: float) -> list[tuple[int, int]]:
    """(first sample, code) in order, from the table behind the records."""
    if len(table) < 8:
        return []
    count = int.from_bytes(table[1:4], "little") if version >= 1.94 else struct.unpack_from("<I", table, 4)[0]
    if table[0] not in (1, 3) or len(table) < 8 + 6 * count:
        return []
    place = np.frombuffer(table, "<u4", count, 8).astype(int) - 1  # counted from 1
    return sorted(zip(place.tolist(), np.frombuffer(table, "<u2", count, 8 + 4 * count).astype(int).tolist(), strict=True))


def read_gdf(raw: bytes) -> dict:
    """{fs, names, signal (channels, samples) in volts where the unit says so, events [(first sample, code)]} of a file whose channels share one rate."""
    at = gdf_layout(raw, len(raw))
    end = at.start + at.records * at.record_bytes
    body = np.frombuffer(raw, np.uint8, end - at.start, at.start).reshape(at.records, at.record_bytes)
    return {"fs": at.fs, "names": at.names, "signal": at.signal(body), "events": gdf_events(raw[end:], at.version)}


def edf_layout(raw: bytes, size: int) -> Layout:
    """From the header of EDF or EDF+: 256 bytes, and 256 a channel. Channels of annotations are not taken."""
    if raw[:8].strip() != b"0" or len(raw) < 512:
        raise ValueError("not an EDF file")
    if raw[192:197] == b"EDF+D":
        raise ValueError("a discontinuous recording")
    n, at = int(raw[252:256]), 256

    def column(width: int) -> list[bytes]:
        nonlocal at
        at += n * width
        return [raw[at - n * width + k * width :][:width].strip() for k in range(n)]

    names, _, units = column(16), column(80), column(8)
    low, high, digital_low, digital_high = (np.array([float(x) for x in column(8)]) for _ in range(4))
    column(80)
    per = [int(x) for x in column(8)]
    taken = [k for k in range(n) if names[k] != MARKS]
    if len({per[k] for k in taken}) > 1:
        raise ValueError("channels of different rates")
    edge = 2 * np.r_[0, np.cumsum(per)]
    start, records, seconds = int(raw[184:192]), int(raw[236:244]), float(raw[244:252])
    if records < 0:
        records = (size - start) // max(1, int(edge[-1]))
    rate = per[taken[0]] if taken else 0
    scale = np.array([UNITS.get(u, 1.0) for u in units])
    ratio = _ratio(low, high, digital_low, digital_high)
    return Layout(rate / seconds if seconds else 0.0, [names[k].decode("latin-1") for k in taken], start, records, rate, seconds, ["<i2"] * n, edge, taken, digital_low[taken], ratio[taken], low[taken], scale[taken])


def edf_marks(at: Layout, body: np.ndarray, first: int) -> list[tuple[int, str]]:
    """(sample, text) of the annotations in records (bytes by record), of which the first has number ``first``. An annotation's time counts from that of its record's own first entry."""
    out = []
    for k, record in enumerate(body):
        own = None
        for c in sorted(set(range(len(at.kinds))) - set(at.taken)):
            for onset, texts in _MARK.findall(record[at.edge[c] : at.edge[c + 1]].tobytes()):
                own = float(onset) if own is None else own
                place = (first + k) * at.per_record + round((float(onset) - own) * at.fs)
                out += [(place, x.decode("utf-8", "replace")) for x in texts.split(b"\x14") if x]
    return out


def _mat_elements(raw: bytes, order: str):
    """(type, data) of the elements end to end."""
    at = 0
    while at + 8 <= len(raw):
        kind, size = struct.unpack_from(order + "II", raw, at)
        if kind >> 16:  # a small element: size and type share a word
            yield kind & 0xFFFF, raw[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        yield kind, raw[at + 8 : at + 8 + size]
        at += 8 + size
        if kind != 15:
            at += -at % 8


def read_mat(raw: bytes) -> dict[str, np.ndarray]:
    """The numeric arrays of a level 5 file, by name; other classes are left out."""
    order = "<" if raw[126:128] == b"IM" else ">"
    out = {}
    if raw[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a MAT file of level 5")
    for kind, data in _mat_elements(raw[128:], order):
        if kind == 15:
            ((kind, data),) = list(_mat_elements(zlib.decompress(data), order))
        if kind != 14:
            continue
        parts = list(_mat_elements(data, order))
        if len(parts) < 4 or parts[0][1][0 if order == "<" else 3] not in MAT_NUMBERS:
            continue
        shape = np.frombuffer(parts[1][1], order + "i4")
        values = np.frombuffer(parts[3][1], order + MAT_TYPES[parts[3][0]])
        out[parts[2][1].decode("latin-1")] = values.reshape(shape, order="F").astype(np.float64)
    return out


def gdf_trials(raw: bytes, seconds: float, channels: int | None = None) -> tuple[float, list[tuple[int | None, np.ndarray]]]:
    """(rate, [(label, trial)]): from each cue on; a recording without any event is cut into unlabelled windows."""
    held = read_gdf(raw)
    fs, x = held["fs"], held["signal"][:channels]
    n = int(seconds * fs)
    if not held["events"]:
        return fs, [(None, x[:, a : a + n]) for a in range(0, x.shape[1] - n + 1, n)]
    out = []
    for start, code in held["events"]:
        part = x[:, start : start + n]
        if code in CUES and part.shape[1] >= int(LEAST_SECONDS * fs):
            out.append((CUES[code], np.pad(part, ((0, 0), (0, n - part.shape[1])), mode="edge")))
    return fs, out


def mat_trials(raw: bytes) -> list[tuple[int | None, np.ndarray]]:
    """``data`` as (samples, channels), cut evenly by the labels, or (trials, channels, samples), with ``class_labels`` or ``labels``; or ``X`` (trials, channels, samples) with ``y`` or ``labels``. Labels that begin at 1 are moved to 0."""
    held = read_mat(raw)
    named = lambda *names: next((held[k].ravel() for k in names if k in held), None)
    x, labels = (held["data"], named("class_labels", "labels")) if "data" in held else (held.get("X"), named("y", "labels"))
    if x is None:
        raise ValueError("neither data nor X in the file")
    if x.ndim == 2:
        if labels is None or not len(labels) or len(x) < len(labels):
            raise ValueError("continuous data need labels")
        n = len(x) // len(labels)
        x = np.stack([x[k * n : (k + 1) * n].T for k in range(len(labels))])
    if labels is None:
        return [(None, t) for t in x]
    first = 1 if len(labels) and labels.min() >= 1 else 0
    return [(int(v) - first if v >= first else None, t) for v, t in zip(labels, x, strict=True)]


def _recordings(spark: SparkSession, path: str, pattern: str, dataset: str, trials, subjects: list[int] | None) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.select(name.alias("name"), F.regexp_extract(name, r"(\d+)", 1).cast("long").alias("subject"), F.regexp_extract(name, r"\d+([A-Za-z]*)", 1).alias("session"), "content")
    if subjects is not None:
        files = files.filter(F.col("subject").isin(subjects))
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.list_(pa.float64()))]
    names = ["dataset", "subject_id", "session", "trial_id", "label", "fs", "signal"]

    def run(batches):
        for b in batches:
            for subject, session, content in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                fs, found = trials(content.as_py())
                for k in range(0, len(found), 16):
                    rows = [(dataset, subject, session, k + j, label, fs, x.tolist()) for j, (label, x) in enumerate(found[k : k + 16])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.mapInArrow(run, TRIAL_SCHEMA)


def gdf(spark: SparkSession, path: str, seconds: float = 3.0, channels: int | None = 22, subjects: list[int] | None = None) -> DataFrame:
    """Trials of the ``*.gdf`` files under a path; the first ``channels`` channels (the others of the usual recordings are of the eyes)."""
    return _recordings(spark, path, "*.gdf", "gdf", lambda raw: gdf_trials(raw, seconds, channels), subjects)


def mat(spark: SparkSession, path: str, fs: float = 250.0, subjects: list[int] | None = None) -> DataFrame:
    """Trials of the ``*.mat`` files under a path; these don't hold their rate."""
    return _recordings(spark, path, "*.mat", "mat", lambda raw: (fs, mat_trials(raw)), subjects)


REGISTRY |= {"gdf": gdf, "mat": mat}

