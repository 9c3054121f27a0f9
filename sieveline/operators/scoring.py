"""Scorers: a deterministic linear one, Spark ML's logistic regression, and any callable on batches of texts.

None of them is the network that comparable tools download; they stand in its place behind the same gate and windows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Weight of each category in the linear scorer; others count DEFAULT.
WEIGHTS = {"DYNAMIC_CODE_EXECUTION": 2.0, "PROCESS_MANAGEMENT": 1.5, "NETWORK_HTTP_REQUEST": 1.0, "ENCODING_DECODING": 1.0, "STRING_SENSITIVE_FILE_PATH": 2.5, "STRING_URL": 0.5, "STRING_BASE64": 1.0}
BIAS, DEFAULT = -3.0, 0.0


def linear_score(tokens: Column, weights: dict[str, float] | None = None, bias: float = BIAS) -> Column:
    """Logistic of the bias and the weights of the distinct tokens."""
    table = WEIGHTS if weights is None else weights
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    total = F.aggregate(F.array_distinct(tokens), F.lit(float(bias)), lambda acc, t: acc + F.coalesce(known[t], F.lit(DEFAULT)))
    return 1 / (1 + F.exp(-total))


def external_score(rows: DataFrame, text: str, scorer: Callable[[list[str]], list[float]], out: str = "score") -> DataFrame:
    """A column of a batch scorer: it is called with lists of texts on the executors, once for each Arrow batch."""
    @F.pandas_udf("double")
    def run(batches: pd.Series) -> pd.Series:
        return pd.Series(scorer(batches.fillna("").tolist()), dtype="float64")

    return rows.withColumn(out, run(F.col(text)))


def hashed_counts(rows: DataFrame, tokens: str, features: int = 1 << 14) -> DataFrame:
    """rows with __tf, the hashed counts of their tokens."""
    from pyspark.ml.feature import HashingTF

    return HashingTF(inputCol=tokens, outputCol="__tf", numFeatures=features).transform(rows)


def fit_counts(counted: DataFrame, label: str, **options):
    """Model on hashed counts (__tf): inverse document frequencies and logistic regression. Its fit passes over the rows several times, so they should be stored."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF

    return Pipeline(stages=[IDF(inputCol="__tf", outputCol="__x"), LogisticRegression(featuresCol="__x", labelCol=label, **options)]).fit(counted)


def train_logistic(rows: DataFrame, tokens: str, label: str, features: int = 1 << 14, **options):
    """Spark ML pipeline: hashed token counts and logistic regression. The rows are computed once: their counts are written to the shared folder for the passes of the fit."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import HashingTF

    fitted = fit_counts(written(hashed_counts(rows, tokens, features).select(label, "__tf"), "counts"), label, **options)
    return PipelineModel([HashingTF(inputCol=tokens, outputCol="__tf", numFeatures=features), *fitted.stages])


def binary_metrics(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """accuracy, precision, recall, f1 of class 1; 0 where a denominator is 0."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    n = rows.agg(*(F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("double").alias(k) for k, c in (("tp", y & p), ("fp", ~y & p), ("fn", y & ~p), ("tn", ~y & ~p))))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    return n.select(over(tp + tn, tp + fp + fn + tn).alias("accuracy"), over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(2 * tp, 2 * tp + fp + fn).alias("f1"))
