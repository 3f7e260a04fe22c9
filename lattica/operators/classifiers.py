"""Classifiers on feature vectors. State is a table or small arrays; scoring is one pass over the rows.

Every model's ``transform`` adds ``y_pred int`` and ``proba array<double>``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from lattica.functions import linalg
from lattica.functions.metrics import argmax
from lattica.operators.kernels import gathered


def centroids(df: DataFrame, by: list[str] = (), label: str = "label", column: str = "features") -> DataFrame:
    """(by, label, centroid array<double>): class means, component by component."""
    long = df.filter(F.col(label).isNotNull()).select(*by, label, F.posexplode(column).alias("dim", "x"))
    m = long.groupBy(*by, label, "dim").agg(F.avg("x").alias("m"))
    return m.groupBy(*by, label).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centroid"))


def squared_distance(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def nearest_centroid_folds(df: DataFrame, id_col: str = "trial_id", fold: str = "fold", label: str = "label", column: str = "features") -> DataFrame:
    """Out-of-fold predictions (id, fold, y_true, y_pred): each row meets the class means of the other folds.

    Sums and counts per fold, class and component give the means of all other folds by subtraction: one pass over the rows, however many folds. The table of
    means (folds x classes x components) is broadcast if it is small."""
    rows = df.filter(F.col(label).isNotNull())
    long = rows.select(fold, label, F.posexplode(column).alias("dim", "x"))
    s = long.groupBy(fold, label, "dim").agg(F.sum("x").alias("s"), F.count("x").alias("k"))
    total = s.groupBy(label, "dim").agg(F.sum("s").alias("ts"), F.sum("k").alias("tk"))
    folds = s.select(fold).distinct()
    own = s.withColumnRenamed("s", "os").withColumnRenamed("k", "ok")
    means = folds.crossJoin(total).join(own, [fold, label, "dim"], "left")  # folds x classes x components rows
    means = means.withColumn("k", F.col("tk") - F.coalesce("ok", F.lit(0))).filter("k > 0").withColumn("m", (F.col("ts") - F.coalesce("os", F.lit(0.0))) / F.col("k"))
    c = means.groupBy(fold, F.col(label).alias("cls")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda v: v["m"]).alias("centroid"))
    c = c.groupBy(fold).agg(F.collect_list(F.struct("cls", "centroid")).alias("classes"))
    d = F.transform("classes", lambda c: F.struct(F.aggregate(F.zip_with(c["centroid"], F.col(column), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, v: a + v).alias("d"), c["cls"].alias("cls")))
    return rows.join(F.broadcast(c) if folds.count() <= 1000 else c, fold).select(id_col, fold, F.col(label).alias("y_true"), F.array_min(d)["cls"].alias("y_pred"))


@dataclass
class Lda:
    """Linear discriminant with a pooled covariance: weights and biases by class."""

    classes: list
    weights: np.ndarray
    biases: np.ndarray

    @staticmethod
    def fit(df: DataFrame, shrinkage: float = 0.0, label: str = "label", column: str = "features") -> Lda:
        return Lda.of_sums(gathered(df.filter(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("long")), column, dict, Lda.statistic, label), shrinkage)

    @staticmethod
    def statistic(v: np.ndarray) -> np.ndarray:
        """What is added over the rows of a class: the outer product, and the vector."""
        return np.vstack((np.outer(v, v), v))

    @staticmethod
    def of_sums(sums: dict, shrinkage: float = 0.0) -> Lda:
        """From (rows, sum of statistics) by class."""
        classes = sorted(sums)
        n = sum(sums[k][0] for k in classes)
        means = np.stack([sums[k][1][-1] / sums[k][0] for k in classes])
        pooled = sum(sums[k][1][:-1] - sums[k][0] * np.outer(m, m) for k, m in zip(classes, means, strict=True)) / max(1, n - len(classes))
        p = len(pooled)
        pooled = (1 - shrinkage) * pooled + (shrinkage * np.trace(pooled) / p + 1e-9) * np.eye(p)
        w = np.linalg.solve(pooled, means.T).T
        prior = np.array([sums[k][0] / n for k in classes])
        return Lda(classes, w, np.log(prior) - 0.5 * (w * means).sum(1))

    def probabilities(self, v: np.ndarray) -> np.ndarray:
        """Of one vector, by class in order."""
        s = self.weights @ v + self.biases
        e = np.exp(s - s.max())
        return e / e.sum()

    def transform(self, df: DataFrame, column: str = "features") -> DataFrame:
        """Dot products in SQL."""
        dots = [F.aggregate(F.zip_with(column, F.array(*[F.lit(float(x)) for x in w]), lambda a, b: a * b), F.lit(float(b)), lambda s, v: s + v) for w, b in zip(self.weights, self.biases, strict=True)]
        s = df.withColumn("_s", F.array(*dots))
        e = F.transform("_s", lambda v: F.exp(v - F.array_max("_s")))
        s = s.withColumn("_e", e)
        s = s.withColumn("proba", F.transform("_e", lambda v: v / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)))
        return s.withColumn("y_pred", F.element_at(F.array(*[F.lit(int(c)) for c in self.classes]), argmax(F.col("proba")) + 1)).drop("_s", "_e")


@dataclass
class Mdm:
    """Minimum distance to class means of covariances (upper triangles). Absent classes have no mean and are never predicted."""

    classes: list
    means: list

    @staticmethod
    def fit(df: DataFrame, label: str = "label", column: str = "features", mean: str = "log_euclidean") -> Mdm:
        """mean: of a class, log_euclidean or riemann."""
        rows = df.filter(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("long"))
        if mean == "riemann":
            from lattica.operators.features import riemann_means

            means = riemann_means(rows, linalg.unpack, column, label)
            return Mdm(sorted(means), [means[k][1] for k in sorted(means)])
        return Mdm.of_sums(gathered(rows, column, dict, Mdm.statistic, label))

    @staticmethod
    def statistic(v: np.ndarray) -> np.ndarray:
        """What is added over the rows of a class: the logarithm of the matrix."""
        return linalg.logm(linalg.unpack(v))

    @staticmethod
    def of_sums(sums: dict) -> Mdm:
        """From (rows, sum of statistics) by class."""
        return Mdm(sorted(sums), [linalg.expm(sums[k][1] / sums[k][0]) for k in sorted(sums)])

    def probabilities(self, v: np.ndarray) -> np.ndarray:
        """Of one triangle, by class in order."""
        if not hasattr(self, "_back"):  # made once a process, not once a row
            self._back = linalg.inv_sqrtm(np.stack(self.means))
        w = np.linalg.eigvalsh(self._back @ linalg.unpack(v) @ self._back)
        d = np.sqrt((np.log(np.maximum(w, linalg.FLOOR)) ** 2).sum(-1))
        e = np.exp(-(d - d.min()))
        return e / e.sum()

    def transform(self, df: DataFrame, column: str = "features") -> DataFrame:
        means = [np.array(m) for m in self.means]

        @pandas_udf(ArrayType(DoubleType()))
        def proba(v):
            import pandas as pd

            mats = linalg.unpack(np.stack([np.asarray(x, np.float64) for x in v])) if len(v) else np.zeros((0, 1, 1))
            d = np.stack([linalg.riemann_distance(m, mats) for m in means], -1)
            e = np.exp(-(d - d.min(-1, keepdims=True)))
            return pd.Series(list(e / e.sum(-1, keepdims=True)))

        out = df.withColumn("proba", proba(column))
        return out.withColumn("y_pred", F.element_at(F.array(*[F.lit(int(c)) for c in self.classes]), argmax(F.col("proba")) + 1))


@dataclass
class MlModel:
    """A pyspark.ml classifier behind the same interface."""

    model: object

    @staticmethod
    def fit(df: DataFrame, kind: str = "logistic", label: str = "label", column: str = "features", **kw) -> MlModel:
        from pyspark.ml import classification as C

        rows = df.filter(F.col(label).isNotNull()).withColumn("_x", array_to_vector(column)).withColumn("_y", F.col(label).cast("double"))
        if kind == "logistic":
            grid = kw.pop("C_grid", None)
            c = kw.pop("C", 1.0) if grid is None else best_c(df, grid, label=label, column=column, **kw)
            est = C.LogisticRegression(featuresCol="_x", labelCol="_y", family="multinomial", regParam=1 / (c * max(1, rows.count())), **kw)
        elif kind == "random_forest":
            est = C.RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=kw.pop("trees", 200), maxDepth=kw.pop("depth", 10), minInstancesPerNode=kw.pop("leaf", 5), seed=kw.pop("seed", 42), **kw)
        elif kind == "mlp":
            k = int(rows.agg(F.max("_y")).first()[0]) + 1
            n = rows.select(F.size(column)).first()[0]
            est = C.MultilayerPerceptronClassifier(featuresCol="_x", labelCol="_y", layers=[n, *kw.pop("hidden", [256, 64]), k], seed=kw.pop("seed", 42), **kw)
        elif kind == "svm_rbf":  # support vectors under a Gaussian kernel, by random Fourier features of it
            return RbfSvm.fit(df, label, column, **kw)
        elif kind == "svm":
            est = C.OneVsRest(classifier=C.LinearSVC(maxIter=50, **kw), featuresCol="_x", labelCol="_y")
        else:
            raise ValueError(f"no classifier {kind!r}")
        return MlModel(est.fit(rows))

    def transform(self, df: DataFrame, column: str = "features") -> DataFrame:
        out = self.model.transform(df.withColumn("_x", array_to_vector(column)))
        if "probability" in out.columns:
            out = out.withColumn("proba", vector_to_array("probability"))
        else:
            raw = vector_to_array("rawPrediction")
            e = F.transform(raw, lambda v: F.exp(v - F.array_max(raw)))
            out = out.withColumn("_e", e).withColumn("proba", F.transform("_e", lambda v: v / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)))
        return out.withColumn("y_pred", F.col("prediction").cast("int")).drop("_x", "_e", "prediction", "probability", "rawPrediction")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)


@dataclass
class RbfSvm:
    """Linear support vectors over random Fourier features, whose products approach the Gaussian kernel exp(-gamma |a - b|**2)."""

    waves: np.ndarray
    shift: np.ndarray
    model: MlModel

    @staticmethod
    def _mapped(df: DataFrame, waves, shift, column: str) -> DataFrame:
        rest = [f for f in df.schema.fields if f.name != column]
        at, kept = df.columns.index(column), [i for i, c in enumerate(df.columns) if c != column]

        def run(batches):
            for b in batches:
                x = np.array(b.column(at).to_pylist(), np.float64).reshape(b.num_rows, -1)
                z = np.sqrt(2.0 / len(shift)) * np.cos(x @ waves + shift) if b.num_rows else np.zeros((0, len(shift)))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), b.column(at), pa.array(z.tolist(), pa.list_(pa.float64()))], names=[*(f.name for f in rest), column, "_rff"])

        return df.mapInArrow(run, StructType([*rest, df.schema[column], StructField("_rff", ArrayType(DoubleType()))]))

    @staticmethod
    def fit(df: DataFrame, label: str = "label", column: str = "features", gamma: float | None = None, n: int = 256, seed: int = 42, **kw) -> RbfSvm:
        """gamma: 1 / (length of a vector times the variance of all its values) if not given."""
        rows = df.filter(F.col(label).isNotNull())
        size = rows.select(F.size(column)).first()[0]
        variance = rows.select(F.explode(column).alias("v")).agg(F.var_pop("v")).first()[0]
        gamma = gamma or 1.0 / (size * (variance or 1.0))
        rng = np.random.RandomState(seed)
        waves, shift = rng.normal(size=(size, n)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, n)
        return RbfSvm(waves, shift, MlModel.fit(RbfSvm._mapped(rows, waves, shift, column), "svm", label, "_rff", **kw))

    def transform(self, df: DataFrame, column: str = "features") -> DataFrame:
        return self.model.transform(RbfSvm._mapped(df, self.waves, self.shift, column), "_rff").drop("_rff")


def best_c(df: DataFrame, grid: list[float] = (0.01, 0.1, 1.0, 10.0), k: int = 5, seed: int = 42, id_col: str = "trial_id", label: str = "label", column: str = "features", **kw) -> float:
    """The C of the best mean accuracy over stratified folds of these rows only (those of the sources); the first of equals. Folds: k, but no more than classes or half the rows, two at least."""
    from lattica.operators.splits import stratified_kfold

    rows = df.filter(F.col(label).isNotNull())
    n, classes = rows.agg(F.count("*"), F.count_distinct(label)).first()
    k = max(2, min(k, n // 2, classes))
    folded, best = stratified_kfold(rows, id_col, label, k, seed), (-1.0, None)
    for c in grid:
        scores = []
        for fold in range(k):
            train, test = folded.filter(F.col("fold") != fold).drop("fold"), folded.filter(F.col("fold") == fold).drop("fold")
            p = MlModel.fit(train, "logistic", label, column, C=c, **kw).transform(test, column)
            scores.append(p.agg(F.avg(F.when(F.col("y_pred") == F.col(label), 1.0).otherwise(0.0))).first()[0] or 0.0)
        best = max(best, (float(np.mean(scores)), c), key=lambda s: s[0])
    return best[1]


def platt(df: DataFrame, label: str = "label") -> DataFrame:
    """Per class a sigmoid of the class's probability fitted on the labelled rows, renormalised."""
    from pyspark.ml.classification import LogisticRegression

    k = df.select(F.size("proba")).first()[0]
    coefficients = []
    for c in range(k):
        rows = df.filter(F.col(label).isNotNull()).select(array_to_vector(F.array(F.col("proba")[c])).alias("x"), (F.col(label) == c).cast("double").alias("y"))
        m = LogisticRegression(featuresCol="x", labelCol="y", regParam=1e-6).fit(rows)
        coefficients.append((float(m.coefficients[0]), float(m.intercept)))
    p = [1.0 / (1.0 + F.exp(-(F.col("proba")[c] * a + b))) for c, (a, b) in enumerate(coefficients)]
    total = sum(p[1:], p[0])
    return df.withColumn("proba", F.array(*[x / total for x in p])).withColumn("y_pred", argmax(F.col("proba")))


def ensemble(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, proba, y_pred): the mean of several models' probabilities for the same rows."""
    m = df.select(*by, F.posexplode("proba").alias("cls", "p")).groupBy(*by, "cls").agg(F.avg("p").alias("p"))
    g = m.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("cls", "p"))), lambda s: s["p"]).alias("proba"))
    return g.withColumn("y_pred", argmax(F.col("proba")))


CLASSIFIERS = {"lda": Lda, "mdm": Mdm, "logistic": MlModel, "random_forest": MlModel, "mlp": MlModel, "svm": MlModel, "svm_rbf": MlModel, "transformer": Lda}


def fitted(name: str, df: DataFrame, **kw):
    if name not in CLASSIFIERS:
        raise ValueError(f"no classifier {name!r}")
    cls = CLASSIFIERS[name]
    return cls.fit(df, kind=name, **kw) if cls is MlModel else cls.fit(df, **kw)


def first_of_equal(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Duplicates of ``value`` within ``by`` go; the first by ``order`` stays."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by, value).orderBy(order))).filter("_r = 1").drop("_r")
