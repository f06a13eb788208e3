"""Learning to rank: a feature vector per candidate and boosted trees fitted on labelled ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

#: Features of a candidate, in the order of the linear ranker's weights.
FEATURES = ("semantic", "rank", "asr", "visual", "object", "metadata")
#: Labelled candidates that trees are fitted on; others, by hash of the id, are left for testing.
FIT_ROWS = 200_000


def features(candidates: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Candidates with ``columns`` as numbers: missing columns, nulls and what isn't finite count 0."""
    def number(c: str) -> Column:
        if c not in candidates.columns:
            return F.lit(0.0)
        x = F.col(c).try_cast("double")
        return F.coalesce(F.when(F.abs(x) < float("inf"), x), F.lit(0.0))

    return candidates.withColumns({c: number(c) for c in columns})


def fit_boosted(labelled: DataFrame, key: str, label: str, columns: Sequence[str] = FEATURES, rounds: int = 20, depth: int = 3, most: int = FIT_ROWS) -> PipelineModel:
    """Boosted trees for the 0/1 ``label``, fitted on at most about ``most`` rows, chosen by a hash of ``key``, so that a retry takes the same."""
    rows = features(labelled, columns).filter(F.col(label).isNotNull())
    n = rows.count()
    if n > most:
        rows = rows.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * most / n))
    trees = GBTClassifier(featuresCol="__features", labelCol=label, maxIter=rounds, maxDepth=depth, seed=1)
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="__features"), trees]).fit(rows.withColumn(label, F.col(label).cast("double")))


def predicted(model: PipelineModel, candidates: DataFrame, columns: Sequence[str] = FEATURES, out: str = "probability") -> DataFrame:
    """Candidates with the model's probability of the label."""
    scored = model.transform(features(candidates, columns))
    return scored.withColumn("__p", vector_to_array("probability")[1]).drop("__features", "rawPrediction", "probability", "prediction").withColumnRenamed("__p", out)
