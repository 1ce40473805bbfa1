"""Learning to rank: a logistic model over the feature columns, trained with the ML library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mulberry.session import checkpointed


def train(matrix: DataFrame, names: Sequence[str], label: str = "label", strength: float = 1.0, rounds: int = 100) -> dict:
    """A model for rerank.logistic_score: mean and (population) scale of each feature, coefficients, intercept.

    Classes weigh alike. The matrix is read in a few passes; only sums and coefficients reach the driver.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    told = checkpointed(matrix.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("__y"), *[F.col(n).cast("double").alias(n) for n in names]))
    sums = told.agg(F.count(F.lit(1)).alias("__n"), F.sum("__y").alias("__pos"), *[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names]).first()
    mean, scale = [sums[f"m_{n}"] or 0.0 for n in names], [sums[f"s_{n}"] or 0.0 for n in names]
    if not sums['__pos'] or sums['__pos'] == sums['__n']:
        return {"features": list(names), "intercept": 0.0, "coef": [0.0] * len(names), "mean": mean, "scale": scale}
    scaled = told.select("__y", *[((F.col(n) - m) / (s or 1.0)).alias(n) for n, m, s in zip(names, mean, scale)])
    weighed = scaled.withColumn("__w", F.when(F.col("__y") > 0, sums['__n'] / (2 * sums['__pos'])).otherwise(sums['__n'] / (2 * (sums['__n'] - sums['__pos']))))
    rows = VectorAssembler(inputCols=list(names), outputCol="__x").transform(weighed)
    fitted = LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="__w", standardization=False, regParam=1 / (strength * sums['__n']), maxIter=rounds).fit(rows)
    return {"features": list(names), "intercept": float(fitted.intercept), "coef": [float(c) for c in fitted.coefficients], "mean": mean, "scale": scale}
