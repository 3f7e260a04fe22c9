"""Splits and folds by hashed order, and the guards that keep them apart. All splits are reproducible from (seed, id) alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.ranks import hash_rank, seeded, value_rank


def trial_split(df: DataFrame, id_col: str, ratio: float, seed: int = 42) -> DataFrame:
    """Adds role: train for the first floor(n * ratio) rows of the hashed order (1 to n - 1), else test."""
    r = hash_rank(df.withColumn("_key", seeded(seed, id_col)), "_key", "_rank", total="_n")
    k = F.greatest(F.lit(1), F.least(F.floor(F.col("_n") * ratio), F.col("_n") - 1))
    return r.withColumn("role", F.when(F.col("_rank") <= k, "train").otherwise("test")).drop("_key", "_rank", "_n")


def sequential_split(df: DataFrame, id_col: str, first: int, by: list[str] = ()) -> DataFrame:
    """Adds role: calibrate for the first rows by id (within ``by``), else test."""
    return value_rank(df, id_col, "_rank", by=by).withColumn("role", F.when(F.col("_rank") <= first, "calibrate").otherwise("test")).drop("_rank")


def first_n(df: DataFrame, id_col: str, n: int, by: list[str] = ()) -> DataFrame:
    """The first n rows by id (within ``by``)."""
    return value_rank(df, id_col, "_rank", by=by).filter(F.col("_rank") <= n).drop("_rank")


def kfold(df: DataFrame, id_col: str, k: int, seed: int = 42) -> DataFrame:
    """Adds fold 0..k-1; the first n % k folds have one row more. No rows if there are fewer rows than folds or k < 2."""
    if k < 2:
        return df.withColumn("fold", F.lit(0)).limit(0)
    r = hash_rank(df.withColumn("_key", seeded(seed, id_col)), "_key", "_rank", total="_n")
    small, more = F.floor(F.col("_n") / k), F.col("_n") % k
    at = F.col("_rank") - 1
    fold = F.when(at < more * (small + 1), F.floor(at / (small + 1))).otherwise(more + F.floor((at - more * (small + 1)) / F.greatest(small, F.lit(1))))
    return r.filter(F.col("_n") >= k).withColumn("fold", fold.cast("int")).drop("_key", "_rank", "_n")


def stratified_kfold(df: DataFrame, id_col: str, label_col: str, k: int, seed: int = 42) -> DataFrame:
    """Adds fold 0..k-1, dealt in turn within each label."""
    r = hash_rank(df.withColumn("_key", seeded(seed, id_col)), "_key", "_rank", by=[label_col])
    return r.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_key", "_rank")


def stratified_split(df: DataFrame, id_col: str, label_col: str, ratio: float, seed: int = 42) -> DataFrame:
    """Adds role: cal for a share of each label, else test."""
    r = hash_rank(df.withColumn("_key", seeded(seed, id_col)), "_key", "_rank", by=[label_col], total="_n")
    return r.withColumn("role", F.when(F.col("_rank") <= F.floor(F.col("_n") * ratio), "cal").otherwise("test")).drop("_key", "_rank", "_n")


def loso_holdout(df: DataFrame, subject_col: str, holdout) -> DataFrame:
    """Adds role: test for the subject held out, else train."""
    return df.withColumn("role", F.when(F.col(subject_col).eqNullSafe(F.lit(holdout)), "test").otherwise("train"))


def loso_folds(df: DataFrame, subject_col: str) -> DataFrame:
    """(fold subject, subject, role, n) for each subject held out in turn: a table of subjects; join it to rows on the subject."""
    s = df.filter(F.col(subject_col).isNotNull()).groupBy(subject_col).agg(F.count("*").alias("n"))
    held = s.select(F.col(subject_col).alias("holdout"))
    return held.join(s).select("holdout", F.col(subject_col).alias("subject_id"), F.when(F.col("holdout") == F.col(subject_col), "test").otherwise("train").alias("role"), "n")


def group_kfold(df: DataFrame, subject_col: str, k: int) -> DataFrame:
    """(subject, n, fold): subjects by falling size, each to the fold with the fewest rows so far. The table of subjects is small enough for the driver
    (``MOST_SUBJECTS``); rows get their fold by a join."""
    sizes = df.groupBy(F.col(subject_col).alias("subject_id")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "subject_id").limit(MOST_SUBJECTS + 1).collect()
    if len(sizes) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects; use hashed_group_kfold")
    load, out = [0] * k, []
    for row in sizes:
        fold = min(range(k), key=lambda i: (load[i], i))
        load[fold] += row["n"]
        out.append((row["subject_id"], row["n"], fold))
    kind = df.schema[subject_col].dataType.simpleString()
    return df.sparkSession.createDataFrame(out, f"subject_id {kind}, n long, fold int")


MOST_SUBJECTS = 1_000_000


def hashed_group_kfold(df: DataFrame, subject_col: str, k: int, seed: int = 42) -> DataFrame:
    """(subject, n, fold) for any number of subjects: folds by the subject's hashed rank."""
    s = df.groupBy(F.col(subject_col).alias("subject_id")).agg(F.count("*").alias("n"))
    r = hash_rank(s.withColumn("_key", seeded(seed, "subject_id")), "_key", "_rank")
    return r.select("subject_id", "n", ((F.col("_rank") - 1) % k).cast("int").alias("fold"))


def cross_session(df: DataFrame, session_col: str, source, target) -> DataFrame:
    """Adds role source or target; other sessions go."""
    return df.filter(F.col(session_col).isin(source, target)).withColumn("role", F.when(F.col(session_col) == source, "source").otherwise("target"))


def split(df: DataFrame, how: str, **kw) -> DataFrame:
    """The dispatcher: sequential, cross_session, loso or trial."""
    return {"sequential": sequential_split, "cross_session": cross_session, "loso": loso_holdout, "trial": trial_split}[how](df, **kw)


def overlap(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """The keys in both: none in a sound split."""
    return train.select(key).join(test.select(key), key, "left_semi").distinct()


def complement(df: DataFrame, holdout: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't held out."""
    return df.join(holdout.select(key), key, "left_anti")


def guard_report(splits: DataFrame, id_col: str, subject_col: str | None = None, order_col: str | None = None) -> DataFrame:
    """One row: ids and subjects in both train and test, whether sessions are in order, whether all rows are trained on. role: train or test.

    An id or subject is in both if its least and greatest role differ: one aggregate each, no join."""
    used = splits.filter(F.col("role").isin("train", "test"))

    def both(key):
        g = used.groupBy(key).agg(F.min("role").alias("a"), F.max("role").alias("b"))
        return g.agg(F.count(F.when(F.col("a") != F.col("b"), 1)).alias("n"))

    out = both(id_col).select(F.col("n").alias("ids_in_both"))
    if subject_col:
        out = out.crossJoin(both(subject_col).select(F.col("n").alias("subjects_in_both")))  # one row each
    train, test = F.col("role") == "train", F.col("role") == "test"
    aggs = [F.count(F.when(train, 1)).alias("n_train"), F.count(F.when(test, 1)).alias("n_test"), F.count("*").alias("n_total")]
    if order_col:
        aggs.append(F.coalesce(F.max(F.when(train, F.col(order_col))) < F.min(F.when(test, F.col(order_col))), F.lit(True)).alias("in_order"))
    counts = splits.agg(*aggs).withColumn("fits_all", (F.col("n_test") > 0) & (F.col("n_train") >= F.col("n_total")))
    return out.crossJoin(counts)


def check(splits: DataFrame, id_col: str, subject_col: str | None = None, order_col: str | None = None) -> DataFrame:
    """Returns the splits, or raises ValueError naming what leaks."""
    r = guard_report(splits, id_col, subject_col, order_col).first().asDict()
    found = [k for k in ("ids_in_both", "subjects_in_both") if r.get(k)] + ["fits_all"] * bool(r["fits_all"]) + ["in_order"] * (r.get("in_order") is False)
    if found:
        raise ValueError(f"leakage between train and test: {', '.join(found)} ({r})")
    return splits


def class_balance(df: DataFrame, label_col: str, ratio: float = 2.0) -> DataFrame:
    """(n_classes, smallest, largest, balanced): balanced if the largest class has at most ``ratio`` times the rows of the smallest."""
    c = df.filter(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("n_classes"), F.min("n").alias("smallest"), F.max("n").alias("largest"), (F.max("n") <= F.min("n") * ratio).alias("balanced"))
