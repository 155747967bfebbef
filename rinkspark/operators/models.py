"""Logistic models per group, by full-batch gradient descent, with cross-validated scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranks import places
from ..plans.runtime import join_checked, stage

# The descent's settings.
STEPS, RATE, PENALTY = 600, 0.08, 0.01
#: Rows on which one model is fitted, at most; beyond it those of the smallest hash. Every row is scored.
FIT_ROWS = 50_000


def fit(x: np.ndarray, y: np.ndarray) -> dict[str, object]:
    """Means, scales and weights of standardized columns, the intercept, and a constant if there is one class only."""
    rate, width = float(y.mean()) if len(y) else 0.0, x.shape[1]
    if rate in (0.0, 1.0):
        return {"means": [0.0] * width, "scales": [1.0] * width, "weights": [0.0] * width, "intercept": 0.0, "constant": rate}
    means, scales = x.mean(axis=0), x.std(axis=0)
    scales[scales == 0] = 1.0
    z, w, b = (x - means) / scales, np.zeros(width), float(np.log(rate / (1 - rate)))
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-np.clip(z @ w + b, -700, 700))) - y
        b -= RATE * error.mean()
        w -= RATE * (z.T @ error / len(y) + PENALTY * w)
    return {"means": list(means), "scales": list(scales), "weights": list(w), "intercept": b, "constant": None}


MODEL = "means array<double>, scales array<double>, weights array<double>, intercept double, constant double"


def fit_groups(rows: DataFrame, groups: list[str], features: list[str], label: str, row_id: str) -> DataFrame:
    """One model a group; missing features count as 0."""
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(F.xxhash64(row_id), row_id))
    bounded = rows.withColumn("__n", place).filter(F.col("__n") <= FIT_ROWS).select(*groups, F.col(label).cast("double").alias("__y"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    kinds = dict(rows.dtypes)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        model = fit(part[features].to_numpy(float), part["__y"].to_numpy(float))
        return pd.DataFrame([dict(zip(groups, key)) | model])

    return bounded.groupBy(*groups).applyInPandas(run, ", ".join(f"`{g}` {kinds[g]}" for g in groups) + ", " + MODEL)


def predict(rows: DataFrame, models: DataFrame, groups: list[str], features: list[str], name: str = "score") -> DataFrame:
    """``rows`` with the probability by their group's model; an expression, no Python. Groups without a model: null."""
    joined = join_checked(rows, models, groups, "left")
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    terms = F.zip_with(F.zip_with(values, F.col("means"), lambda v, m: v - m), F.zip_with(F.col("weights"), F.col("scales"), lambda w, s: w / s), lambda d, w: d * w)
    z = F.col("intercept") + F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
    small = F.exp(-F.abs(z))
    probability = F.when(z >= 0, 1 / (1 + small)).otherwise(small / (1 + small))
    return joined.withColumn(name, F.coalesce("constant", probability)).drop("means", "scales", "weights", "intercept", "constant")


def cross_validated(rows: DataFrame, groups: list[str], features: list[str], label: str, row_id: str, folds: int = 5) -> DataFrame:
    """``rows`` with ``fold`` and ``score`` by a model that was fitted on the group's other folds.

    The fold is the place by ``row_id`` within the group, modulo ``folds``. A group of one fold is scored by itself.
    """
    placed = stage(places(rows, groups, [F.col(row_id)], "__place", "__rows"))
    folded = placed.withColumn("fold", ((F.col("__place") - 1) % folds).cast("int"))
    every = folded.withColumn("held_out", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    train = every.filter((F.col("fold") != F.col("held_out")) | (F.col("__rows") == 1)).drop("__place", "__rows")
    folded = folded.drop("__place", "__rows")
    models = fit_groups(train, [*groups, "held_out"], features, label, row_id)
    return predict(folded.withColumn("held_out", F.col("fold")), models, [*groups, "held_out"], features).drop("held_out")
