"""Models by MLlib, with the scaling that textbook objectives need."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows with all features present, and their vector."""
    return VectorAssembler(inputCols=features, outputCol="features").transform(df.dropna(subset=features))


def standardised(train: DataFrame, *others: DataFrame) -> tuple[DataFrame, ...]:
    """Scaled by the training rows alone."""
    model = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(train)
    return tuple(model.transform(x).drop("features").withColumnRenamed("scaled", "features") for x in (train, *others))


def ridge(train: DataFrame, label: str, strength: float, mix: float = 0.0) -> LinearRegression:
    """Ridge (mix 0) or elastic net; ``strength`` is that of the unscaled sum of squares."""
    n = max(1, train.count())
    return LinearRegression(featuresCol="features", labelCol=label, regParam=strength / n, elasticNetParam=mix, standardization=False).fit(train)


def logistic(train: DataFrame, label: str, balanced: bool = True):
    if balanced:
        counts = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}  # a row a class
        total, weight = sum(counts.values()), F.lit(1.0)
        for k, n in counts.items():
            weight = F.when(F.col(label) == k, total / (len(counts) * n)).otherwise(weight)
        return LogisticRegression(featuresCol="features", labelCol=label, weightCol="_w").fit(train.withColumn("_w", weight))
    return LogisticRegression(featuresCol="features", labelCol=label).fit(train)


def forest(train: DataFrame, label: str, trees: int = 50, depth: int = 5, seed: int = 42):
    return RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit(train)


def boosted(train: DataFrame, label: str, rounds: int = 20, depth: int = 3, seed: int = 42):
    return GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed).fit(train)


def regimes(train: DataFrame, k: int = 5, seed: int = 42):
    """Clusters of market states."""
    return KMeans(featuresCol="features", k=k, seed=seed).fit(train)


def perceptron(train: DataFrame, label: str, layers: list[int], seed: int = 42):
    return MultilayerPerceptronClassifier(featuresCol="features", labelCol=label, layers=layers, seed=seed).fit(train)


def isotonic(train: DataFrame, p: str, y: str):
    return IsotonicRegression(featuresCol=p, labelCol=y).fit(train)


def platt(train: DataFrame, p: str, y: str):
    return LogisticRegression(featuresCol="features", labelCol=y).fit(VectorAssembler(inputCols=[p], outputCol="features").transform(train))


def probability(model, rows: DataFrame, out: str = "p") -> DataFrame:
    return model.transform(rows).withColumn(out, F.element_at(vector_to_array("probability"), 2)).drop("probability", "rawPrediction", "prediction")


def quantile_regression(rows: DataFrame, by: list[str], features: list[str], y: str, q: float, rounds: int = 60) -> DataFrame:
    """Coefficients per group by iteratively reweighted least squares; a group is one series."""
    import numpy as np
    import pandas as pd

    names = [*by, *[f"b_{f}" for f in features], "b_0"]
    schema = ", ".join(f"{c} {dict(rows.dtypes).get(c, 'double')}" for c in names)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        head = [pdf[b].iloc[0] for b in by]
        pdf = pdf.dropna(subset=[*features, y])
        if len(pdf) <= len(features):
            return pd.DataFrame([[*head, *[None] * (len(features) + 1)]], columns=names)
        x = np.column_stack([pdf[features].to_numpy(float), np.ones(len(pdf))])
        t, beta = pdf[y].to_numpy(float), np.linalg.lstsq(np.column_stack([pdf[features].to_numpy(float), np.ones(len(pdf))]), pdf[y].to_numpy(float), rcond=None)[0]
        for _ in range(rounds):
            e = t - x @ beta
            w = np.where(e >= 0, q, 1 - q) / np.maximum(np.abs(e), 1e-6)
            beta = np.linalg.solve((x * w[:, None]).T @ x + 1e-12 * np.eye(x.shape[1]), (x * w[:, None]).T @ t)
        return pd.DataFrame([[*head, *beta]], columns=names)

    return rows.groupBy(*by).applyInPandas(fit, schema)


def perturbation(model_score, rows: DataFrame, features: list[str]) -> DataFrame:
    """Attribution by mean substitution: change of the score when a feature takes its mean."""
    means = rows.agg(*[F.avg(f).alias(f"_m_{f}") for f in features])
    both = rows.crossJoin(F.broadcast(means))  # one row
    base = model_score({f: F.col(f) for f in features})
    return both.select(*rows.columns, *[(base - model_score({g: F.col(f"_m_{g}") if g == f else F.col(g) for g in features})).alias(f"effect_{f}") for f in features])
