"""Ranking of features by models of the label; scores are long tables ``(feature, score)``."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpair.operators.matrix import correlation_scores, scaled_ranks, stratified_folds


def assembled(rows: DataFrame, columns: list[str], label: str) -> DataFrame:
    """``features, label`` of rows with a label."""
    known = rows.filter(F.col(label).isNotNull()).withColumn("label", F.col(label).cast("double"))
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(known)


def _table(rows: DataFrame, columns: list[str], values: list[float]) -> DataFrame:
    return rows.sparkSession.createDataFrame(pd.DataFrame({"feature": columns, "score": [float(v) for v in values]}), "feature string, score double")


def _linear(data: DataFrame, **options) -> list[float]:
    model = LinearRegression(maxIter=100, tol=1e-8, **options).fit(data)
    return [abs(float(c)) for c in model.coefficients]


def linear_scores(rows: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Absolute coefficients of least squares; a penalty of 1e-6 keeps collinear features apart."""
    return _table(rows, columns, _linear(assembled(rows, columns, label), solver="normal", standardization=True, regParam=1e-6))


def ridge_scores(rows: DataFrame, columns: list[str], label: str, alpha: float = 2.0) -> DataFrame:
    """Of squares plus ``alpha`` times squared coefficients."""
    data = assembled(rows, columns, label)
    return _table(rows, columns, _linear(data, solver="normal", elasticNetParam=0.0, regParam=alpha / max(1, data.count()), standardization=False))


def lasso_scores(rows: DataFrame, columns: list[str], label: str, alpha: float = 0.05) -> DataFrame:
    """Of half the mean square plus ``alpha`` times absolute coefficients."""
    return _table(rows, columns, _linear(assembled(rows, columns, label), elasticNetParam=1.0, regParam=alpha, standardization=False))


def stability_scores(rows: DataFrame, columns: list[str], label: str, alpha: float = 0.04, rounds: int = 8, share: float = 0.75, seed: int = 1) -> DataFrame:
    """How often a feature keeps a coefficient in lasso fits of seeded samples."""
    data = assembled(rows, columns, label).select("features", "label").persist()
    kept = [0] * len(columns)
    for k in range(rounds):
        fit = _linear(data.sample(share, seed + k), elasticNetParam=1.0, regParam=alpha, standardization=True)
        kept = [a + (c > 1e-9) for a, c in zip(kept, fit, strict=True)]
    data.unpersist()
    return _table(rows, columns, [a / rounds for a in kept])


def elimination_scores(rows: DataFrame, columns: list[str], label: str, keep: int = 50) -> DataFrame:
    """Rank at which recursive elimination by least squares drops a feature; 1 for those kept."""
    left, rank = list(columns), dict.fromkeys(columns, 1)
    order = []
    known = rows.filter(F.col(label).isNotNull()).persist()
    while len(left) > keep:
        fit = _linear(assembled(known, left, label), solver="normal", standardization=True, regParam=1e-6)
        order.append(left.pop(min(range(len(left)), key=lambda i: (fit[i], left[i]))))
    known.unpersist()
    for k, name in enumerate(reversed(order)):
        rank[name] = k + 2
    return _table(rows, columns, [rank[c] for c in columns])


def forest_scores(rows: DataFrame, columns: list[str], label: str, trees: int = 20, depth: int = 6, seed: int = 1) -> DataFrame:
    """Importances of a random forest."""
    model = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed).fit(assembled(rows, columns, label))
    return _table(rows, columns, model.featureImportances.toArray().tolist())


def boosting_scores(rows: DataFrame, columns: list[str], label: str, key: str, folds: int = 8, rounds: int = 20, seed: int = 1) -> DataFrame:
    """Importances of boosted trees, by gain, averaged over stratified folds."""
    dealt = stratified_folds(rows.filter(F.col(label).isNotNull()), key, label, folds).select(F.col(key).alias("_key"), F.col("fold").alias("_fold"))
    data = assembled(rows, columns, label).join(dealt, F.col(key) == F.col("_key")).persist()
    total = [0.0] * len(columns)
    for k in range(folds):
        model = GBTClassifier(maxIter=rounds, maxDepth=5, seed=seed).fit(data.filter(F.col("_fold") != k))
        total = [a + b / folds for a, b in zip(total, model.featureImportances.toArray().tolist(), strict=True)]
    data.unpersist()
    return _table(rows, columns, total)


#: Ranking methods by name, and the order in which scores count.
METHODS: dict[str, tuple[Callable[..., DataFrame], int]] = {
    "linear": (linear_scores, 1), "ridge": (ridge_scores, 1), "lasso": (lasso_scores, 1), "stability": (stability_scores, 1),
    "elimination": (elimination_scores, -1), "correlation": (lambda rows, columns, label: correlation_scores(rows, label, columns), 1), "forest": (forest_scores, 1), "boosting": (boosting_scores, 1),
}


def rank_features(rows: DataFrame, columns: list[str], label: str, methods: list[str], **options: dict) -> DataFrame:
    """``(feature, method, score)``: scores of several methods, each scaled to 0..1.  Options by method's name."""
    parts = []
    for m in methods:
        score, order = METHODS[m]
        parts.append(scaled_ranks(score(rows, columns, label, **options.get(m, {})), order).select("feature", F.lit(m).alias("method"), "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mean_ranks(ranks: DataFrame) -> DataFrame:
    """A row for each feature with a column for each method, and their mean."""
    wide = ranks.groupBy("feature").pivot("method").agg(F.first("score"))
    return wide.join(ranks.groupBy("feature").agg(F.round(F.avg("score"), 6).alias("mean")), "feature")
