"""Array kernels on trials (signal array<array<double>>, [channel][sample]), Arrow batch by batch. Adjacent kernels run as one ``mapInArrow``."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from lattica.functions import dsp, linalg

Kernel = Callable[[np.ndarray], np.ndarray]
SIGNAL = ArrayType(ArrayType(DoubleType()))
VECTOR = ArrayType(DoubleType())


def bandpass(fs: float, low: float = 8, high: float = 30, order: int = 5, causal: bool = False) -> Kernel:
    b, a = dsp.butter_bandpass(order, low, high, fs)
    return (lambda x: dsp.lfilter(b, a, x)[0]) if causal else (lambda x: dsp.filtfilt(b, a, x))


def motor_band(fs: float, causal: bool = False) -> Kernel:
    return bandpass(fs, 8, 30, causal=causal)


def notch(fs: float, f0: float = 50, q: float = 30, causal: bool = False) -> Kernel:
    b, a = dsp.notch(f0, q, fs)
    return (lambda x: dsp.lfilter(b, a, x)[0]) if causal else (lambda x: dsp.filtfilt(b, a, x))


def car() -> Kernel:
    return lambda x: x - x.mean(0, keepdims=True)


def laplacian(neighbours: dict[int, list[int]]) -> Kernel:
    def run(x):
        out = x - x.mean(0, keepdims=True)
        for c, near in neighbours.items():
            if c < len(x) and (near := [n for n in near if n < len(x)]):
                out[c] = x[c] - x[near].mean(0)
        return out

    return run


def wavelet_denoise(levels: int = 4) -> Kernel:
    return lambda x: dsp.wavelet_denoise(x, levels)


def project(matrix: np.ndarray) -> Kernel:
    """Mixes channels: matrix (rows out, channels)."""
    return lambda x: matrix @ x


def ica_clean(x: np.ndarray, n: int = 15, drop: tuple = (), seed: int = 42) -> Kernel:
    """Fits on samples (n_samples, channels); keeps all components but ``drop`` and mixes back with the true inverse."""
    unmix, mix, mean = linalg.fast_ica(x, min(n, x.shape[1]), seed)
    keep = np.ones(len(unmix))
    keep[list(drop)] = 0
    back = mix @ (keep[:, None] * unmix)
    return lambda s: back @ (s - mean[:, None]) + mean[:, None]


def lead_field_denoise(lead: np.ndarray | None = None, share: float = 0.8) -> Kernel:
    """Components of a trial least like a forward model's covariance go: generalised eigenvectors against lead @ lead.T. A lead field must be given: without one there is nothing to compare with."""
    if lead is None:
        raise ValueError("a lead field is needed")
    model = lead @ lead.T
    return lambda x: linalg.gevd_denoise(x, model, share)


def mandatory(fs: float, reference: Kernel | None = None, causal: bool = False, low: float = 8, high: float = 30) -> list[Kernel]:
    """Notch, bandpass, reference, in that order."""
    return [notch(fs, causal=causal), bandpass(fs, low, high, causal=causal), reference or car()]


#: Steps that may be enabled by name after the mandatory ones; the second value says whether a step works one window at a time.
STEPS: dict[str, tuple[Callable[..., Kernel], bool]] = {"wavelet": (wavelet_denoise, True), "motor_band": (motor_band, True), "ica": (ica_clean, False), "project": (project, True), "lead_field": (lead_field_denoise, True)}


def chain(fs: float, enabled: list[tuple[str, dict]] = (), reference: Kernel | None = None, online: bool = False) -> list[Kernel]:
    """The mandatory kernels, then the enabled steps in the order given; online leaves out those that need more than a window."""
    return mandatory(fs, reference, causal=online) + [STEPS[n][0](**kw) for n, kw in enabled if STEPS[n][1] or not online]


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return _stacked(column)


def mapped(trials: DataFrame, kernels: list[Kernel], signal: str = "signal") -> DataFrame:
    """The same columns, with the kernels' result as the signal: one pass for all of them."""
    schema, at, names = trials.schema, trials.columns.index(signal), trials.columns

    def run(batches):
        for b in batches:
            out = []
            for x in _arrays(b.column(at)):
                for k in kernels:
                    x = k(x)
                out.append(x.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.list_(pa.float64()))) if i == at else c for i, c in enumerate(b.columns)], names=names)

    return trials.mapInArrow(run, StructType([StructField(f.name, SIGNAL if f.name == signal else f.dataType) for f in schema.fields]))


def mapped_by(trials: DataFrame, kernel: Callable, key: str, signal: str = "signal") -> DataFrame:
    """The same columns, with kernel(signal, the row's key) as the signal: one pass for all keys."""
    at, key_at, names = trials.columns.index(signal), trials.columns.index(key), trials.columns

    def run(batches):
        for b in batches:
            out = [kernel(x, k).tolist() for x, k in zip(_arrays(b.column(at)), b.column(key_at).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.list_(pa.float64()))) if i == at else c for i, c in enumerate(b.columns)], names=names)

    return trials.mapInArrow(run, StructType([StructField(f.name, SIGNAL if f.name == signal else f.dataType) for f in trials.schema.fields]))


def extracted(trials: DataFrame, feature: Kernel, signal: str = "signal", name: str = "features", kernels: list[Kernel] = ()) -> DataFrame:
    """The columns without the signal, and a vector per trial. Preprocessing kernels run in the same pass."""
    at = trials.columns.index(signal)
    fields = [f for f in trials.schema.fields if f.name != signal]
    names = [f.name for f in fields]

    def run(batches):
        for b in batches:
            out = []
            for x in _arrays(b.column(at)):
                for k in kernels:
                    x = k(x)
                out.append(np.asarray(feature(x), np.float64).ravel().tolist())
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), pa.array(out, pa.list_(pa.float64()))], names=[*names, name])

    return trials.mapInArrow(run, StructType([*fields, StructField(name, VECTOR)]))


def extracted_by(trials: DataFrame, feature: Callable, key: str, signal: str = "signal", name: str = "features", drop: tuple | None = None) -> DataFrame:
    """The columns without the signal, and feature(signal, the row's key) as a vector; the key column goes too unless ``drop`` says else."""
    gone = {signal, *((key,) if drop is None else drop), name}
    at, key_at, kept = trials.columns.index(signal), trials.columns.index(key), [i for i, c in enumerate(trials.columns) if c not in gone]
    fields = [trials.schema.fields[i] for i in kept]

    def run(batches):
        for b in batches:
            out = [np.asarray(feature(x, k), np.float64).ravel().tolist() for x, k in zip(_arrays(b.column(at)), b.column(key_at).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(out, pa.list_(pa.float64()))], names=[*(f.name for f in fields), name])

    return trials.mapInArrow(run, StructType([*fields, StructField(name, VECTOR)]))


def _stacked(column: pa.Array) -> list[np.ndarray]:
    """Rows of a column of numbers or (nested) lists as arrays, None for null: the values' buffer is reshaped where all rows have one shape, without a Python number each."""
    if not isinstance(column.type, pa.ListType):
        return [None if x is None else np.float64(x) for x in column.to_pylist()]
    inner, sizes = column, []
    while isinstance(inner.type, pa.ListType):
        if inner.null_count or not len(inner) or len(set(size := np.diff(inner.offsets.to_numpy()))) != 1:
            return [None if x is None else np.array(x, np.float64) for x in column.to_pylist()]
        sizes.append(int(size[0]))
        inner = inner.flatten()
    return list(inner.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), *sizes)) if not inner.null_count else [np.array(x, np.float64) for x in column.to_pylist()]


def gathered(df: DataFrame, column: str, start: Callable[[], object], add: Callable, label: str | None = None, given: dict | None = None):
    """Sums an array statistic over all rows, by label where one is named: partial sums a task and label, added entry by entry in Spark; the driver gets one array a label. For small matrices only.
    With ``given`` the statistic also gets the row's label and that table. Rows whose label or array is null don't count."""
    at = df.columns.index(column)
    label_at = df.columns.index(label) if label else None
    key_type = df.schema[label].dataType if label else LongType()
    kind = to_arrow_type(key_type)

    def run(batches):
        held: dict = {}
        for b in batches:
            keys = b.column(label_at).to_pylist() if label else [0] * b.num_rows
            for key, x in zip(keys, _stacked(b.column(at)), strict=True):
                if key is not None and x is not None:
                    n, total = held.get(key, (0, None))
                    v = np.asarray(add(x) if given is None else add(x, key, given), np.float64)
                    held[key] = n + 1, v if total is None else total + v
        for key, (n, total) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([n], pa.int64()), pa.array([list(total.shape)], pa.list_(pa.int64())), pa.array([total.ravel()], pa.list_(pa.float64()))], names=["key", "n", "shape", "total"])

    parts = df.mapInArrow(run, f"key {key_type.simpleString()}, n long, shape array<long>, total array<double>")
    entries = parts.select("key", "shape", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.col("n").cast("double").alias("v"))), F.transform("total", lambda v, k: F.struct(k.alias("at"), v.alias("v"))))).alias("e"))
    sums = entries.groupBy("key", "shape", "e.at").agg(F.sum("e.v").alias("v"))
    whole = sums.groupBy("key", "shape").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda e: e["v"]).alias("v"))  # a group is one array
    out: dict = {}
    for r in whole.collect():
        if r["key"] in out:
            raise ValueError(f"the statistic of {r['key']!r} has more than one shape")
        out[r["key"]] = int(r["v"][0]), np.array(r["v"][1:]).reshape(r["shape"])
    return out if label else out.get(0, (0, None))
