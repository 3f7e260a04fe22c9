"""Every leave-one-out and out-of-fold fit of a trial table from a fixed number of passes, however many subjects, folds and pipelines.

What a model is fitted on are sums over trials by class: covariances, their logarithms, products of features. One pass adds them by (unit, class), a unit being a subject or a fold. The model that
leaves a unit out is made from the sums of all less its own, on the driver, where there are a few small arrays a unit and class. Features that are fitted themselves (spatial filters, a reference
matrix) take a second pass: a trial's features under each model that it trains are added by (unit left out, class). The last pass predicts each trial by the model of its unit, all models broadcast.

Rows without a unit are training rows of every model and are never predicted; rows without a label are predicted, and no classifier learns from them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from lattica.functions import linalg
from lattica.operators import classifiers, features, kernels
from lattica.operators.kernels import gathered

#: Bytes of all models of a job at most: they are broadcast.
MODELS_BYTES = 1 << 30


@dataclass
class Plan:
    """How a spec is fitted by sums. state: what a trial adds for a fitted feature, and how sums by class become the feature's state (both None for a feature without one); vector: of a trial and a state."""

    name: str
    steps: list
    adds: Callable | None
    state: Callable | None
    vector: Callable
    model: type
    options: dict
    unlabelled: bool = False  # whether rows without a label count for the state

    def prepared(self, x: np.ndarray) -> np.ndarray:
        for k in self.steps:
            x = k(x)
        return x


def plan(spec) -> Plan | None:
    """None for a spec whose fit isn't made of sums: iterative classifiers, adapters, alignment by subject."""
    models = {"lda": classifiers.Lda, "transformer": classifiers.Lda, "mdm": classifiers.Mdm}
    of_feature, of_model = dict(spec.options.get("feature", {})), dict(spec.options.get("classifier", {}))
    if spec.adapter != "none" or spec.classifier not in models or (spec.classifier == "mdm" and (spec.feature != "covariance" or of_model)):
        return None
    steps = kernels.chain(spec.fs, [(s, {}) for s in spec.steps if s in kernels.STEPS]) if spec.steps else []
    model = models[spec.classifier]
    if spec.feature == "csp":
        return Plan(spec.name, steps, linalg.covariance, lambda sums: features.CspLogVariance.of_sums(sums, **of_feature).filters, lambda x, w: np.log((w @ x).var(-1) + 1e-10), model, of_model)
    if spec.feature == "riemann_tangent" and not of_feature:
        whole = lambda sums: linalg.expm(sum(t for _, t in sums.values()) / sum(n for n, _ in sums.values()))
        return Plan(spec.name, steps, lambda x: linalg.logm(linalg.oas(x)), whole, lambda x, ref: linalg.tangent(linalg.oas(x), ref), model, of_model, unlabelled=True)
    made = features.FEATURES.get(spec.feature)
    if made is None or hasattr(made, "fit") or of_feature:
        return None
    kernel = made(spec.fs) if spec.feature in ("psd", "band_powers", "temporal") else made()
    return Plan(spec.name, steps, None, None, lambda x, _: np.asarray(kernel(x), np.float64).ravel(), model, of_model)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.ravel(p) for p in parts]) if parts else np.zeros(0)


def _cut(total: np.ndarray, shapes: list[tuple]) -> list[np.ndarray]:
    out, at = [], 0
    for shape in shapes:
        size = int(np.prod(shape))
        out.append(total[at : at + size].reshape(shape))
        at += size
    return out


def _less(all_sums: dict, own: dict) -> dict:
    """Sums by class of all units less those of one; a class without other rows is gone."""
    out = {}
    for c, (n, t) in all_sums.items():
        k, s = own.get(c, (0, 0.0))
        if n > k:
            out[c] = n - k, t - s
    return out


def predictions(trials: DataFrame, specs: list, unit: str = "subject_id", label: str = "label", id_col: str = "trial_id", signal: str = "signal") -> DataFrame:
    """(pipeline, holdout, trial_id, y_true, y_pred, proba): each trial by the model that was fitted without its unit. Three passes over the trials: sums, sums behind fitted features, predictions (two if no feature is fitted).
    A unit whose model has no class to tell apart gets no predictions."""
    plans = [plan(s) for s in specs]
    if not all(plans):
        raise ValueError(f"not fitted by sums: {[s.name for s, p in zip(specs, plans) if p is None]}")
    unit_type, kept = trials.schema[unit].dataType, [unit, label, id_col, signal]
    out = StructType([StructField("pipeline", StringType()), StructField("holdout", unit_type), trials.schema[id_col], StructField("y_true", trials.schema[label].dataType), StructField("y_pred", IntegerType()), StructField("proba", ArrayType(DoubleType()))])
    out = StructType([StructField("trial_id" if f.name == id_col else f.name, f.dataType) for f in out.fields])
    rows = trials.select(*kept)
    units = [r[0] for r in rows.filter(F.col(unit).isNotNull()).select(unit).distinct().collect()]  # a row a unit
    probe = rows.filter(F.col(signal).isNotNull()).select(signal).first()
    if probe is None or not units:
        return trials.sparkSession.createDataFrame([], out)
    probe = np.array(probe[0], np.float64)
    # units go by number, -1 for none: a key that any type of unit can have
    number = {u: k for k, u in enumerate(sorted(units, key=str))}
    numbers = trials.sparkSession.createDataFrame([(u, k) for u, k in number.items()], StructType([StructField("_unit", unit_type), StructField("_number", IntegerType())]))
    numbered = rows.join(F.broadcast(numbers) if len(units) <= 100_000 else numbers, F.col(unit) == F.col("_unit"), "left")
    keyed = numbered.withColumn("_key", F.to_json(F.array(F.coalesce("_number", F.lit(-1)).cast("long"), F.col(label).cast("long")))).select("_key", signal)

    def by_unit(sums: dict, shapes: list[tuple]) -> list[dict]:
        """For each statistic: number of the unit to class to (rows, sum); -1 for rows without one, None for all."""
        held: list[dict] = [{None: {}} for _ in shapes]
        for key, (n, total) in sums.items():
            u, c = json.loads(key)
            for p, place, part in zip(plans, held, _cut(total, shapes), strict=True):
                if c is None and not p.unlabelled:
                    continue
                place.setdefault(u, {})[c] = n, part
                m, t = place[None].get(c, (0, 0.0))
                place[None][c] = m + n, t + part
        return held

    # the first pass: what features are fitted on, or what models are where features aren't fitted
    first = [(p.adds if p.adds is not None else (lambda x, p=p: p.model.statistic(p.vector(x, None)))) for p in plans]

    def first_adds(x):
        return _joined([add(p.prepared(x)) for p, add in zip(plans, first, strict=True)])

    shapes = [np.shape(add(p.prepared(probe))) for p, add in zip(plans, first, strict=True)]
    sums = by_unit(gathered(keyed, signal, dict, first_adds, "_key"), shapes)
    states: list[dict] = [{k: (p.state(rest) if (rest := _less(held[None], held.get(k, {}))) else None) for k in number.values()} if p.state else {} for p, held in zip(plans, sums, strict=True)]
    models: list[dict] = [{} for _ in plans]
    fitted = [i for i, p in enumerate(plans) if p.state]
    for i, (p, held) in enumerate(zip(plans, sums, strict=True)):
        if not p.state:
            models[i] = {k: p.model.of_sums(rest, **p.options) for k in number.values() if (rest := _less(held[None], held.get(k, {})))}
    if fitted:
        spark = trials.sparkSession.sparkContext
        given = spark.broadcast([states[i] for i in fitted])
        # by model: the specs that have one, and the shapes of what a trial adds to them
        at_work = {k: [i for i in fitted if states[i][k] is not None] for k in number.values()}
        behind = {k: [np.shape(plans[i].model.statistic(plans[i].vector(plans[i].prepared(probe), states[i][k]))) for i in at] for k, at in at_work.items()}

        # the second pass: a trial adds to each model but that of its own unit
        def run(batches):
            held: dict = {}
            of = dict(zip(fitted, given.value, strict=True))
            for b in batches:
                for key, x in zip(b.column(0).to_pylist(), kernels._stacked(b.column(1)), strict=True):
                    if x is None:
                        continue
                    own, c = json.loads(key)
                    if c is None:
                        continue
                    ready = {i: plans[i].prepared(x) for i in fitted}
                    for k, at in at_work.items():
                        if k != own and at:
                            part = _joined([plans[i].model.statistic(plans[i].vector(ready[i], of[i][k])) for i in at])
                            n, total = held.get((k, c), (0, 0.0))
                            held[k, c] = n + 1, total + part
            for (k, c), (n, total) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([json.dumps([k, c])]), pa.array([[float(n), *total]], pa.list_(pa.float64()))], names=["_key", "_part"])

        parts = keyed.mapInArrow(run, "_key string, _part array<double>")
        for key, (_, total) in gathered(parts, "_part", dict, lambda v: v, "_key").items():
            k, c = json.loads(key)
            for i, part in zip(at_work[k], _cut(total[1:], behind[k]), strict=True):
                models[i].setdefault(k, {})[c] = int(total[0]), part
        for i in fitted:
            models[i] = {k: plans[i].model.of_sums(by_class, **plans[i].options) for k, by_class in models[i].items()}
    size = sum(np.size(a) for held in (*models, *states) for m in held.values() for a in (vars(m).values() if hasattr(m, "__dict__") else [m]))
    if 8 * size > MODELS_BYTES:
        raise ValueError(f"models of {len(units)} units take {8 * size} bytes: leave out groups of units instead")
    sent = trials.sparkSession.sparkContext.broadcast((models, states))
    places = {str(u): k for u, k in number.items()}
    kinds = [to_arrow_type(f.dataType) for f in out.fields]

    # the last pass
    def predicted(batches):
        models, states = sent.value
        for b in batches:
            made = []
            for row, (u, x) in enumerate(zip(b.column(0).to_pylist(), kernels._stacked(b.column(3)), strict=True)):
                k = None if u is None or x is None else places[str(u)]
                for p, held, state in zip(plans, models, states, strict=True):
                    if k is not None and k in held and (m := held[k]).classes:
                        proba = m.probabilities(p.vector(p.prepared(x), state.get(k)))
                        made.append((row, p.name, int(m.classes[int(np.argmax(proba))]), proba.tolist()))
            row, name, y, proba = zip(*made) if made else ((),) * 4
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), b.column(0).take(take), b.column(2).take(take), b.column(1).take(take), pa.array(y, pa.int32()), pa.array(proba, kinds[5])], names=out.names)

    return rows.mapInArrow(predicted, out)
