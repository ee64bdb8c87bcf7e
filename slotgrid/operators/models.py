"""Fitted models on anchors: a preprocessor learnt from training rows alone, classifiers, a leaf distribution, importances."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def guard_features(columns: list[str], forbidden: set[str]) -> None:
    """Refuses a feature set that holds a column from the future."""
    if found := forbidden & set(columns):
        raise ValueError(f"features know the future: {sorted(found)}")


def preprocessor(category: str, numbers: list[str]) -> list:
    """Stages that index and one-hot a category and assemble it with numbers; unknown categories and nulls are errors."""
    return [
        StringIndexer(inputCol=category, outputCol="_index", handleInvalid="error"),
        OneHotEncoder(inputCol="_index", outputCol="_hot", handleInvalid="error"),
        VectorAssembler(inputCols=["_hot", *numbers], outputCol="features", handleInvalid="error"),
    ]


def classifiers(seed: int = 7) -> dict:
    """Candidates by name: a logistic regression, a tree, and a forest of trees on drawn rows, each trying a third of the features at a node."""
    return {
        "logistic": LogisticRegression(featuresCol="features", labelCol="label", maxIter=20, regParam=0.01),
        "tree": DecisionTreeClassifier(featuresCol="features", labelCol="label", maxDepth=4, minInstancesPerNode=20, seed=seed),
        "forest": RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=40, maxDepth=6, minInstancesPerNode=20, subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=seed),
    }


def fit_and_reload(spark: SparkSession, train: DataFrame, stages: list, path: str) -> PipelineModel:
    """Fits the stages on `train`, saves the model below the shared folder and gives the one read back."""
    Pipeline(stages=stages).fit(train).write().save(path)
    return PipelineModel.load(path)


def probability(scored: DataFrame) -> DataFrame:
    """`scored` with p, the probability of label 1."""
    return scored.withColumn("p", vector_to_array("probability")[1])


def leaf_groups(train: DataFrame, rows: DataFrame, numbers: list[str], total: str, *, depth: int = 4, least: int = 20) -> DataFrame:
    """`rows` with `leaf`, the leaf of a regression tree for log1p of the total, fitted on `train`."""
    assemble = VectorAssembler(inputCols=numbers, outputCol="features", handleInvalid="error")
    tree = DecisionTreeRegressor(featuresCol="features", labelCol="_target", maxDepth=depth, minInstancesPerNode=least, leafCol="leaf", seed=7)
    model = Pipeline(stages=[assemble, tree]).fit(train.withColumn("_target", F.log1p(F.col(total).cast("double"))))
    return model.transform(rows).withColumn("leaf", F.col("leaf").cast("long").cast("string"))


def importances(spark: SparkSession, scored: DataFrame, model: PipelineModel) -> DataFrame:
    """(feature, importance) by the names in the vector's metadata: coefficients or impurity shares of the last stage."""
    groups = scored.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for kind in groups.values() for a in kind}
    last = model.stages[-1]
    values = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    return spark.createDataFrame([(names[i], float(values[i])) for i in sorted(names)], "feature string, importance double")
