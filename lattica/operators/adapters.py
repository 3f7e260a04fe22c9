"""Domain adapters on feature vectors: fitted on source and target rows, applied to source rows (or both, for transport)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import linalg
from lattica.operators.kernels import gathered


def _mapped(df: DataFrame, column: str, f) -> DataFrame:
    at, names = df.columns.index(column), df.columns

    def run(batches):
        for b in batches:
            out = [None if v is None else np.asarray(f(np.array(v, np.float64))).tolist() for v in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64())) if i == at else c for i, c in enumerate(b.columns)], names=names)

    return df.mapInArrow(run, df.schema)


def moments(df: DataFrame, column: str = "features") -> DataFrame:
    """(dim, mean, std, n): population moments by component, an aggregate in SQL."""
    long = df.select(F.posexplode(column).alias("dim", "x"))
    return long.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("x").alias("n"))


@dataclass
class ZScore:
    """Source z-scores moved to the target's mean and deviation; without a target only z-scores."""

    source: tuple
    target: tuple | None

    @staticmethod
    def fit(source: DataFrame, target: DataFrame | None = None, column: str = "features") -> ZScore:
        def held(df):
            rows = sorted(moments(df, column).collect(), key=lambda r: r["dim"])  # one row a component
            std = np.array([r["std"] for r in rows])
            return np.array([r["mean"] for r in rows]), np.where(std < 1e-10, 1.0, std)

        return ZScore(held(source), held(target) if target is not None else None)

    def transform(self, df: DataFrame, column: str = "features") -> DataFrame:
        """In SQL: one multiplication and addition a component."""
        m, s = self.source
        gain, shift = 1 / s, -m / s
        if self.target is not None:
            gain, shift = gain * self.target[1], shift * self.target[1] + self.target[0]
        g, h = F.array(*[F.lit(float(x)) for x in gain]), F.array(*[F.lit(float(x)) for x in shift])
        return df.withColumn(column, F.zip_with(F.zip_with(column, g, lambda a, b: a * b), h, lambda a, b: a + b))


def streamed_covariance(df: DataFrame, column: str = "features", eps: float = 1e-3) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, covariance, n) from partial sums of outer products."""
    n, total = gathered(df, column, dict, lambda v: np.vstack((np.outer(v, v), v)))
    if not n:
        raise ValueError("no rows to fit on")
    mean = total[-1] / n
    return mean, (total[:-1] - n * np.outer(mean, mean)) / max(1, n - 1) + eps * np.eye(len(mean)), n


@dataclass
class Coral:
    """Recolours source features by the target's covariance. Beyond ``most`` components it is the identity."""

    matrix: np.ndarray | None

    @staticmethod
    def fit(source: DataFrame, target: DataFrame, column: str = "features", eps: float = 1e-3, most: int = 256) -> Coral:
        first = source.select(F.size(column)).first()
        if first is None or first[0] > most:
            return Coral(None)
        _, cs, _ = streamed_covariance(source, column, eps)
        _, ct, _ = streamed_covariance(target, column, eps)
        return Coral(linalg.inv_sqrtm(cs) @ linalg.sqrtm(ct))

    def transform(self, df: DataFrame, column: str = "features") -> DataFrame:
        m = self.matrix
        return df if m is None else _mapped(df, column, lambda v: v @ m)


@dataclass
class RiemannTransport:
    """Moves triangles of covariances from the source mean to the target mean; vectors that are no triangle pass unchanged."""

    matrix: np.ndarray | None

    @staticmethod
    def fit(source: DataFrame, target: DataFrame, column: str = "features") -> RiemannTransport:
        first = source.select(F.size(column)).first()
        if first is None or linalg.side(first[0]) is None:
            return RiemannTransport(None)
        means = [linalg.expm(t / n) for n, t in (gathered(d, column, dict, lambda v: linalg.logm(linalg.unpack(v))) for d in (source, target))]
        return RiemannTransport(linalg.sqrtm(means[1]) @ linalg.inv_sqrtm(means[0]))

    def transform(self, df: DataFrame, column: str = "features") -> DataFrame:
        a = self.matrix
        return df if a is None else _mapped(df, column, lambda v: linalg.pack(a @ linalg.unpack(v) @ a.T))


class Identity:
    @staticmethod
    def fit(source, target=None, column="features"):
        return Identity()

    def transform(self, df, column="features"):
        return df


ADAPTERS = {"none": Identity, "zscore": ZScore, "coral": Coral, "riemann_transport": RiemannTransport}


def subject_weights(df: DataFrame, target: DataFrame, subject: str = "subject_id", column: str = "features") -> DataFrame:
    """(subject, weight): 1 / (1 + distance of mean vectors to the target's), summing to 1."""
    from pyspark.sql import Window as W

    mean = lambda d, *by: d.select(*by, F.posexplode(column).alias("dim", "x")).groupBy(*by, "dim").agg(F.avg("x").alias("m"))
    t = mean(target).withColumnRenamed("m", "t")
    d = mean(df, subject).join(t, "dim").groupBy(subject).agg(F.sqrt(F.sum((F.col("m") - F.col("t")) ** 2)).alias("distance"))
    w = 1.0 / (1.0 + F.col("distance"))
    return d.select(subject, "distance", (w / F.sum(w).over(W.partitionBy(F.lit(0)))).alias("weight"))  # one row a subject
