"""Classifiers of pairs: out-of-fold predictions, searches and ensembles, on ``pyspark.ml``."""

from __future__ import annotations

import json
import random
from collections.abc import Callable

from pyspark.ml.base import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillpair.functions.numeric import log_loss
from quillpair.operators.ranking import assembled
from quillpair.sources.shared import drop_table, stage_table

#: Makers of estimators by family; keyword arguments are the estimator's.
FAMILIES: dict[str, Callable[..., Estimator]] = {
    "boosting": lambda **o: GBTClassifier(**({"maxIter": 20, "maxDepth": 5, "seed": 1} | o)),
    "forest": lambda **o: RandomForestClassifier(**({"numTrees": 40, "maxDepth": 8, "seed": 1} | o)),
    "logistic": lambda **o: LogisticRegression(**({"maxIter": 50} | o)),
    "network": lambda **o: MultilayerPerceptronClassifier(**({"maxIter": 50, "seed": 1} | o)),
}


def _estimator(family: str, inputs: int, options: dict) -> Estimator:
    options = dict(options)
    if family == "network":
        options["layers"] = [inputs, *options.pop("hidden", [16, 8]), 2]
    return FAMILIES[family](**options)


def _probability(model, rows: DataFrame, keys: list[str]) -> DataFrame:
    return model.transform(rows).select(*keys, vector_to_array("probability")[1].alias("prob"))


def _prepared(rows: DataFrame, columns: list[str], label: str, family: str, scaler=None):
    """Assembled rows, standardized for networks; the scaler comes from the training rows."""
    data = assembled(rows, columns, label)
    if family != "network":
        return data, None
    data = data.withColumnRenamed("features", "raw")
    scaler = scaler or StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(data)
    return scaler.transform(data), scaler


def out_of_fold(rows: DataFrame, key: str, columns: list[str], label: str, fold: str, family: str = "boosting", options: dict | None = None) -> DataFrame:
    """``key, fold, label, prob``: each row predicted by a model of all other folds.

    Rows without a label or a fold are left out.  The result is written to the shared
    folder, so models are not fitted again when it is read.
    """
    options = options or {}
    data = rows.filter(F.col(fold).isNotNull())
    folds = sorted(r[0] for r in data.select(fold).distinct().collect())  # one row for each fold
    parts = None
    for k in folds:
        train, scaler = _prepared(data.filter(F.col(fold) != k), columns, label, family)
        test, _ = _prepared(data.filter(F.col(fold) == k), columns, label, family, scaler)
        model = _estimator(family, len(columns), options).fit(train)
        part = _probability(model, test, [key, fold, "label"])
        parts = part if parts is None else parts.unionByName(part)
    return stage_table(parts, "out-of-fold")


def refit(train: DataFrame, test: DataFrame, key: str, columns: list[str], label: str, family: str = "boosting", options: dict | None = None) -> DataFrame:
    """``key, prob`` of ``test`` by a model of all labelled rows of ``train``."""
    data, scaler = _prepared(train, columns, label, family)
    model = _estimator(family, len(columns), options or {}).fit(data)
    rows, _ = _prepared(test.withColumn(label, F.lit(0)), columns, label, family, scaler)
    return _probability(model, rows, [key])


def bagged(train: DataFrame, test: DataFrame, key: str, columns: list[str], label: str, fold: str, family: str = "boosting", options: dict | None = None) -> DataFrame:
    """``key, prob`` of ``test``: the mean over models that each leave one fold out."""
    folds = sorted(r[0] for r in train.filter(F.col(fold).isNotNull()).select(fold).distinct().collect())
    parts = None
    for k in folds:
        part = refit(train.filter(F.col(fold) != k), test, key, columns, label, family, options)
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(key).agg(F.avg("prob").alias("prob"))


def evaluate(predicted: DataFrame, fold: str | None = None) -> DataFrame:
    """``loss, std, accuracy`` of ``label, prob``; by fold first if one is named, else over all rows and a null ``std``."""
    loss, hit = log_loss(F.col("label"), F.col("prob")), ((F.col("prob") >= 0.5).cast("double") == F.col("label")).cast("double")
    if fold is None:
        return predicted.agg(F.avg(loss).alias("loss"), F.lit(None).cast("double").alias("std"), F.avg(hit).alias("accuracy"))
    per = predicted.groupBy(fold).agg(F.avg(loss).alias("loss"), F.avg(hit).alias("hit"))
    return per.agg(F.avg("loss").alias("loss"), F.stddev_pop("loss").alias("std"), F.avg("hit").alias("accuracy"))


#: What a search draws from, by family.
SPACES: dict[str, dict[str, list]] = {
    "boosting": {"maxDepth": [3, 4, 5, 6], "maxIter": [10, 20, 30], "stepSize": [0.05, 0.1, 0.2], "subsamplingRate": [0.6, 0.8, 1.0]},
    "forest": {"maxDepth": [5, 8, 10], "numTrees": [20, 40, 80], "featureSubsetStrategy": ["sqrt", "log2", "onethird"]},
    "logistic": {"regParam": [0.0, 0.001, 0.01, 0.1], "elasticNetParam": [0.0, 0.5, 1.0]},
    "network": {"hidden": [[8], [16, 8], [32, 16]], "maxIter": [30, 60]},
}


def search(rows: DataFrame, key: str, columns: list[str], label: str, fold: str, family: str, trials: int, seed: int = 1, good: float = 0.25) -> DataFrame:
    """Trial log ``(trial, family, params, loss, std, accuracy)``.

    The first half of the trials is drawn at random; each later one draws every
    parameter in proportion to how often the better quarter of trials used a value
    against the rest -- the published tree-structured estimator for lists of values.
    """
    rng = random.Random(seed)
    space, log = SPACES[family], []
    for t in range(trials):
        if t < max(2, trials // 2):
            params = {k: rng.choice(v) for k, v in space.items()}
        else:
            ranked = sorted(log, key=lambda e: e["loss"])
            best = ranked[: max(1, int(len(ranked) * good))]
            params = {}
            for k, values in space.items():
                share = [(1 + sum(e["params"][k] == v for e in best)) / (1 + sum(e["params"][k] == v for e in ranked)) for v in values]
                params[k] = rng.choices(values, share)[0]
        predicted = out_of_fold(rows, key, columns, label, fold, family, params)
        result = evaluate(predicted, fold).first()
        drop_table(predicted)
        log.append({"trial": t, "params": params, "loss": result["loss"], "std": result["std"], "accuracy": result["accuracy"]})
    table = [(e["trial"], family, json.dumps(e["params"], sort_keys=True), e["loss"], e["std"], e["accuracy"]) for e in log]
    return rows.sparkSession.createDataFrame(table, "trial int, family string, params string, loss double, std double, accuracy double")


def select_ensemble(predictions: DataFrame, columns: list[str], label: str, rounds: int = 10) -> DataFrame:
    """``(round, model, loss)`` of greedy selection with replacement: each round adds the model that lowers the mean's loss most.

    Each round is one aggregation over the rows for all candidates; ties go to the first name.
    """
    chosen: list[str] = []
    out = []
    y = F.col(label).cast("double")
    for k in range(rounds):
        base: Column = F.lit(0.0)
        for c in chosen:
            base = base + F.col(c)
        losses = predictions.agg(*(F.avg(log_loss(y, (base + F.col(c)) / (k + 1))).alias(c) for c in columns)).first()
        best = min(sorted(columns), key=lambda c: losses[c])
        chosen.append(best)
        out.append((k, best, losses[best]))
    return predictions.sparkSession.createDataFrame(out, "round int, model string, loss double")
