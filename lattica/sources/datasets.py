"""Trial sources and table sinks. Sources are lazy DataFrames of the trial schema; ``registry`` finds them by name."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TRIAL_SCHEMA = "dataset string, subject_id long, session string, trial_id long, label int, fs double, signal array<array<double>>"
SAMPLE_SCHEMA = "subject_id long, trial_id long, channel int, sample_idx long, value double"


def signs(seed: int, subject: int, trial: int, n: int) -> np.ndarray:
    return np.random.RandomState((seed * 1_000_003 + subject * 10_007 + trial) % 2**32).normal(size=n)


def synthetic_trial(subject: int, trial: int, channels: int, n: int, fs: float, classes: int, seed: int, snr: float | None = None) -> tuple[int, np.ndarray]:
    """(label, signal): 12 and 20 Hz, the first's amplitude by class and channel, and noise seeded by (seed, subject, trial)."""
    label = trial % classes
    t = np.arange(n) / fs
    gain = 1.0 + 0.8 * ((np.arange(channels)[:, None] + label) % classes == 0)
    x = gain * np.sin(2 * np.pi * 12 * t)[None] + 0.5 * np.sin(2 * np.pi * 20 * t)[None]
    noise = signs(seed, subject, trial, channels * n).reshape(channels, n)
    scale = 1.0 if snr is None else np.sqrt((x**2).mean() / (snr * (noise**2).mean()))
    return label, x + scale * noise


def synthetic(spark: SparkSession, subjects: int = 3, trials: int = 40, channels: int = 8, n: int = 500, fs: float = 250.0, classes: int = 4, seed: int = 42, snr: float | None = None) -> DataFrame:
    """One row per trial, made where it is read; every trial only depends on (seed, subject, trial)."""
    import pyarrow as pa

    kinds = pa.schema([("dataset", pa.string()), ("subject_id", pa.int64()), ("session", pa.string()), ("trial_id", pa.int64()), ("label", pa.int32()), ("fs", pa.float64()), ("signal", pa.list_(pa.list_(pa.float64())))])

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                subject, trial = divmod(k, trials)
                label, x = synthetic_trial(subject + 1, trial, channels, n, fs, classes, seed, snr)
                yield pa.RecordBatch.from_pylist([{"dataset": "synthetic", "subject_id": subject + 1, "session": "T", "trial_id": k, "label": label, "fs": fs, "signal": x.tolist()}], schema=kinds)

    return spark.range(subjects * trials).mapInArrow(run, TRIAL_SCHEMA)


class SubjectFile(InputPartition):
    def __init__(self, subject: int, path: str):
        self.subject, self.path = subject, path


class NpyReader(DataSourceReader):
    """One partition a subject: ``<subject>_x.npy`` (trials, channels, samples) and ``<subject>_y.npy``; a label of -1 is null."""

    def __init__(self, options: dict):
        self.path, self.fs = options["path"], float(options.get("fs", 250.0))
        self.subjects = options.get("subjects")

    def partitions(self):
        import glob
        import os

        found = sorted(glob.glob(f"{self.path}/*_x.npy"))
        parts = [SubjectFile(int(os.path.basename(f).split("_")[0]), f) for f in found]
        wanted = {int(s) for s in self.subjects.split(",")} if self.subjects else None
        return [p for p in parts if wanted is None or p.subject in wanted]

    def read(self, partition):
        x = np.load(partition.path, mmap_mode="r", allow_pickle=False)
        y = np.load(partition.path.replace("_x.npy", "_y.npy"), allow_pickle=False)
        for k in range(len(x)):
            yield ("npy", partition.subject, "T", k, None if y[k] < 0 else int(y[k]), self.fs, np.asarray(x[k], np.float64).tolist())


class NpyTrials(DataSource):
    @classmethod
    def name(cls):
        return "npy_trials"

    def schema(self):
        return TRIAL_SCHEMA

    def reader(self, schema):
        return NpyReader(self.options)


def npy(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(NpyTrials)
    return spark.read.format("npy_trials").options(path=path, **{k: str(v) for k, v in options.items()}).load()


def parquet(spark: SparkSession, path: str, subjects: list[int] | None = None, labelled: bool = False) -> DataFrame:
    """Trials in parquet; subject and label conditions reach the scan."""
    df = spark.read.parquet(path)
    if subjects is not None:
        df = df.filter(F.col("subject_id").isin(subjects))
    return df.filter(F.col("label").isNotNull()) if labelled else df


REGISTRY: dict[str, Callable[..., DataFrame]] = {"synthetic": synthetic, "npy": npy, "parquet": parquet}


def load(name: str, spark: SparkSession, **options) -> DataFrame:
    """A source by name; options that it doesn't know are left out."""
    import inspect

    import lattica.sources.biosignal  # noqa: F401  registers its formats
    import lattica.sources.recordings  # noqa: F401

    f = REGISTRY[name]
    known = inspect.signature(f).parameters
    open_ended = any(p.kind is p.VAR_KEYWORD for p in known.values())
    return f(spark, **{k: v for k, v in options.items() if open_ended or k in known})


def cut_by_events(samples: DataFrame, events: DataFrame, codes: dict[int, int], n: int, least: int) -> DataFrame:
    """Trials from continuous samples (subject_id, channel, sample_idx, value) and triggers (subject_id, start, code): n samples from each
    trigger, at least ``least``, the last value repeated up to n. A range join by tiles."""
    from pyspark.sql import Window as W

    from lattica.operators.windows import segments

    mapping = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    e = events.filter(F.col("code").isin(list(codes))).withColumn("label", F.try_element_at(mapping, F.col("code")).cast("int"))
    e = e.withColumn("trial_id", (F.row_number().over(W.partitionBy("subject_id").orderBy("start")) - 1).cast("long"))
    s = segments(e, samples, ["subject_id"], "start", "sample_idx", n)
    g = s.groupBy("subject_id", "trial_id", "label", "channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda v: v["value"]).alias("x"))
    g = g.filter(F.size("x") >= least).withColumn("x", F.concat("x", F.array_repeat(F.element_at("x", -1), F.lit(n) - F.size("x"))))
    return g.groupBy("subject_id", "trial_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "x"))), lambda v: v["x"]).alias("signal"))


def cut_unlabelled(samples: DataFrame, n: int) -> DataFrame:
    """Non-overlapping full windows of each subject's samples as trials without labels."""
    t = samples.withColumn("trial_id", F.floor(F.col("sample_idx") / n).cast("long"))
    g = t.groupBy("subject_id", "trial_id", "channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "value"))), lambda v: v["value"]).alias("x")).filter(F.size("x") == n)
    return g.groupBy("subject_id", "trial_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "x"))), lambda v: v["x"]).alias("signal")).withColumn("label", F.lit(None).cast("int"))


def label_index(df: DataFrame, name: str) -> DataFrame:
    """(name, label): string labels numbered in sorted order."""
    from pyspark.sql import Window as W

    return df.select(name).filter(F.col(name).isNotNull()).distinct().withColumn("label", (F.row_number().over(W.partitionBy(F.lit(0)).orderBy(name)) - 1).cast("int"))  # one row a class


@dataclass(frozen=True)
class Config:
    """Settings with a hash of 16 digits; ``merged`` overrides section by section."""

    values: dict = field(default_factory=dict)

    def merged(self, override: dict) -> Config:
        return Config({**self.values, **{k: {**self.values.get(k, {}), **v} if isinstance(v, dict) and isinstance(self.values.get(k, {}), dict) else v for k, v in override.items()}})

    def digest(self) -> str:
        import hashlib

        return hashlib.sha256(json.dumps(self.values, sort_keys=True).encode()).hexdigest()[:16]


def capabilities(channel_names: list[str], lead_field: bool = False) -> dict[str, bool]:
    """What a montage allows: neighbours need at least three 10-20 names."""
    standard = {"Fz", "Cz", "Pz", "Oz", "C3", "C4", "F3", "F4", "P3", "P4", "FC3", "FC4", "CP3", "CP4", "FCz", "CPz"}
    return {"laplacian": len(standard & set(channel_names)) >= 3, "car": len(channel_names) > 1, "lead_field": lead_field}


def spatial_method(asked: str, able: dict[str, bool]) -> str:
    """``*_strict`` raises where the montage doesn't allow it, ``*_auto`` (and plain names) fall back to car."""
    base, _, how = asked.partition("_")
    if able.get(base, base in ("none", "csp")):
        return base
    if how == "strict":
        raise ValueError(f"{base} isn't possible with these channels")
    return "car"


def write_csv(df: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json_table(df: DataFrame, path: str, meta: dict) -> None:
    """{"table": [...], "meta": {...}} as one line."""
    rows = df.agg(F.collect_list(F.struct(*df.columns)).alias("table"))
    rows.select("table", F.lit(json.dumps(meta)).alias("meta")).coalesce(1).write.mode("overwrite").json(path)


def read_json_table(spark: SparkSession, path: str) -> DataFrame:
    """A wrapped table or a bare list of rows."""
    df = spark.read.option("multiLine", True).json(path)
    return df.select(F.explode("table").alias("r")).select("r.*") if "table" in df.columns else df


def write_metrics(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.mode("append").partitionBy(*by).parquet(path)


def write_selected(spark: SparkSession, path: str, pipeline: str, run_id: str, metrics: dict[str, float], arrays: dict[str, np.ndarray] | None = None) -> None:
    """The pipeline chosen: one row with its metrics, and its fitted arrays beside it."""
    spark.createDataFrame([(run_id, pipeline, {k: float(v) for k, v in metrics.items() if v is not None})], "run_id string, pipeline string, metrics map<string,double>").coalesce(1).write.mode("overwrite").json(f"{path}/selected")
    if arrays:
        write_model(spark, f"{path}/model", arrays)


def write_online(metrics: DataFrame, predictions: DataFrame, path: str) -> None:
    """What an online session leaves: a row of metrics a pipeline as JSON, a row a trial as CSV (trial_index, true_label, predicted, correct)."""
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/pipeline_metrics")
    rows = predictions.select(F.col("trial_id").alias("trial_index"), F.col("label").alias("true_label"), "predicted", (F.col("label") == F.col("predicted")).alias("correct"))
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/live_predictions")


def latex_rows(df: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """A text column with one table row each."""
    cells = [F.format_string(f"%.{digits}f", F.col(c)) if t == "double" else F.coalesce(F.col(c).cast("string"), F.lit("--")) for c, t in df.select(*columns).dtypes]
    return df.select(F.concat(F.concat_ws(" & ", *cells), F.lit(r" \\")).alias("value"))


def run_metadata(spark: SparkSession, dataset: str, seed: int, config: Config) -> DataFrame:
    """One row for the table of runs."""
    return spark.range(1).select(F.concat_ws("-", F.date_format(F.current_timestamp(), "yyyyMMdd'T'HHmmss"), F.substring(F.expr("uuid()"), 1, 8)).alias("run_id"), F.lit(dataset).alias("dataset"), F.lit(seed).alias("seed"), F.lit(config.digest()).alias("config_hash"), F.current_timestamp().alias("at"))


def write_model(spark: SparkSession, path: str, arrays: dict[str, np.ndarray]) -> None:
    """Fitted arrays (filters, means, weights) as a table of a row each: no pickles."""
    rows = [(n, list(map(int, np.shape(a))), np.asarray(a, np.float64).ravel().tolist()) for n, a in arrays.items()]
    spark.createDataFrame(rows, "name string, shape array<long>, data array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r["name"]: np.array(r["data"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}
