"""Baseline models on feature tables (Spark ML)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from wardpanel.operators.boosting import BoostedModel, fit_trees
from wardpanel.session import cut_lineage


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Row weight n / (classes * class size)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    total = sizes.agg(F.sum("__c").alias("n"), F.count(F.lit(1)).alias("k")).first()
    return df.join(sizes, label).withColumn(name, F.lit(float(total["n"])) / (F.lit(float(total["k"])) * F.col("__c"))).drop("__c")


def feature_columns(kind: str, baseline: Sequence[str], factors: Sequence[str]) -> list[str]:
    return {"baseline": list(baseline), "factors": list(factors), "combined": [*baseline, *factors]}[kind]


def fit_logistic(train: DataFrame, features: Sequence[str], label: str, reg: float | None = None, max_iter: int = 100, strength: float = 1.0):
    """Scaled, class-balanced logistic regression.

    Without `reg` the squared weights count half against `strength` times the summed loss, so the penalty per row falls with the rows.
    """
    if reg is None:
        reg = 1.0 / (strength * max(1, train.count()))
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(labelCol=label, weightCol="weight", regParam=reg, maxIter=max_iter, standardization=False),
    ]
    return Pipeline(stages=stages).fit(balanced_weights(train, label))


#: Rows of a shard of the stochastic fit (one task works through it in order), and rows of one step.
SHARD_ROWS, STEP_ROWS = 20_000, 32


@dataclass
class LinearModel:
    """Weights on scaled features, one column per class, or a single one for two classes."""

    features: list[str]
    classes: list[int]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # (features + 1, columns); the last row is the offset

    def margins(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """One column per class; several classes are each against the rest, brought to a sum of 1."""
        p = 1 / (1 + np.exp(-np.clip(self.margins(x), -500, 500)))
        return np.concatenate([1 - p, p], axis=1) if len(self.classes) == 2 else p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)

    def transform(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """`keep` columns, `prob` (array) and `pred` (the likeliest class)."""
        model, wanted = self, [f for f in df.schema.fields if f.name in keep]
        schema = StructType([*wanted, StructField("prob", ArrayType(DoubleType())), StructField("pred", IntegerType())])

        def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                p = model.probabilities(frame[model.features].to_numpy(dtype=np.float64))
                pred = np.array(model.classes)[p.argmax(axis=1)] if len(p) else []
                yield frame[[f.name for f in wanted]].assign(prob=list(p), pred=pred)

        return df.select(*dict.fromkeys([*[f.name for f in wanted], *self.features])).mapInPandas(rows, schema)


def sgd_pass(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray, alpha: float, rate: float, seen: int) -> np.ndarray:
    """One pass over a shard in small steps from `start`; the mean of the weights of all steps."""
    w, total, steps = start.copy(), np.zeros_like(start), 0
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    keep = np.append(np.ones(len(start) - 1), 0.0)[:, None]  # the offset is not held back
    for a in range(0, len(x), STEP_ROWS):
        part, n = slice(a, a + STEP_ROWS), min(STEP_ROWS, len(x) - a)
        p = 1 / (1 + np.exp(-np.clip(x[part] @ w, -500, 500)))
        step = rate / (1 + rate * alpha * (seen + a))
        w = w - step * (x[part].T @ ((p - y[part]) * weight[part]) / n + alpha * w * keep)
        total, steps = total + w, steps + 1
    return total / max(steps, 1)


def fit_sgd_logistic(train: DataFrame, features: Sequence[str], label: str, alpha: float = 1e-4, epochs: int = 20, rate: float = 0.1, tolerance: float = 1e-4) -> LinearModel:
    """Scaled, class-balanced logistic regression by stochastic gradients with averaged weights.

    Rows fall into shards of about `SHARD_ROWS` by a hash of their values and are walked through in the order of that hash, so the result
    does not depend on the partitioning.  In every epoch each shard starts from the same weights, and the weights they end with are
    averaged by rows; only weights reach the driver.  It stops when they move by less than `tolerance`.  Rows with a null feature or label
    are left out.  Labels are whole numbers; more than two are fitted each against the rest.
    """
    rows = train.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("int").alias("__y")).dropna()
    sizes = {r["__y"]: r["count"] for r in rows.groupBy("__y").count().collect()}  # one row a class
    classes, n = sorted(sizes), sum(sizes.values())
    if len(classes) < 2:
        raise ValueError("a fit needs two classes")
    stats = rows.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)]).first()
    mean = np.array([stats[f"m{i}"] for i in range(len(features))])
    scale = np.array([stats[f"s{i}"] or 1.0 for i in range(len(features))])
    hash_ = F.xxhash64(*features, "__y")
    shards = max(1, -(-n // SHARD_ROWS))
    held = cut_lineage(rows.withColumns({"__h": hash_, "__shard": F.pmod(hash_, F.lit(shards))}))
    balance = {c: n / (len(classes) * m) for c, m in sizes.items()}
    targets = classes[1:] if len(classes) == 2 else classes
    model = LinearModel(list(features), classes, mean, scale, np.zeros((len(features) + 1, len(targets))))

    for epoch in range(epochs):
        start = model.weights

        def walk(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["__h", *model.features, "__y"], kind="stable")
            x = (frame[model.features].to_numpy(dtype=np.float64) - mean) / scale
            label_ = frame["__y"].to_numpy()
            weight = np.array([balance[c] for c in label_.tolist()])[:, None]
            y = (label_[:, None] == np.array(targets)[None, :]).astype(np.float64)
            end = sgd_pass(x, y, weight, start, alpha, rate, epoch * len(x))
            return pd.DataFrame({"shard": [key[0]], "n": [len(x)], "w": [end.ravel()]})

        found = held.groupBy("__shard").applyInPandas(walk, "shard long, n long, w array<double>").collect()  # one row of weights a shard
        found.sort(key=lambda r: r["shard"])
        model.weights = sum(np.array(r["w"]) * r["n"] for r in found).reshape(start.shape) / n
        if np.abs(model.weights - start).max() < tolerance:
            break
    return model


def fit_boosted(train: DataFrame, features: Sequence[str], label: str, **settings) -> BoostedModel:
    """Class-balanced boosted trees, one model for all classes: up to 120 rounds of 31 leaves at rate 0.05, ended early (`boosting.fit_trees`)."""
    return fit_trees(train, features, label, **settings)


def fit_return_ranker(train: DataFrame, features: Sequence[str], label: str, max_iter: int = 20, seed: int = 0):
    """Boosted regression trees on normalised panel features."""
    tree = GBTRegressor(labelCol=label, maxIter=max_iter, seed=seed, predictionCol="signal")
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), tree]).fit(train)


def predictions(model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    if isinstance(model, BoostedModel):
        return model.transform(df, keep)
    out = model.transform(df)
    return out.select(*keep, vector_to_array("probability").alias("prob"), F.col("prediction").cast("int").alias("pred"))


def coefficient_importance(model, features: Sequence[str]) -> list[tuple[str, float]]:
    """Mean absolute coefficient per feature, largest first."""
    m = model.stages[-1].coefficientMatrix.toArray()
    means = abs(m).mean(axis=0)
    return sorted(((f, float(v)) for f, v in zip(features, means)), key=lambda p: (-p[1], p[0]))
