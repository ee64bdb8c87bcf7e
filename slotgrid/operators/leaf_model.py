"""A stored model of conditional distributions: a tree that groups anchors, the distribution of each leaf, and the contract both were made under."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import GridSpec
from . import ecdf
from .models import guard_features
from .requests import answer

VERSION = 1
CONTRACT = "version int, features array<string>, step int, history int, future int, prior double, rows long, leaves long"
#: What an anchor knows of its own future; no feature may be one of these.
FUTURE = {"future_n", "future_total", "target_valid"}


@dataclass(frozen=True)
class LeafModel:
    """What `load` has read and checked."""

    tree: PipelineModel
    distribution: DataFrame
    features: list[str]
    spec: GridSpec
    prior: float

    def grouped(self, anchors: DataFrame) -> DataFrame:
        """`anchors` with `leaf`; one without a whole history has features that are unknown, and so no leaf."""
        known = self.tree.transform(anchors.where(F.col("history_n") == self.spec.history)).withColumn("leaf", F.col("leaf").cast("long").cast("string")).drop("features", "prediction")
        rest = anchors.where(F.coalesce(F.col("history_n") != self.spec.history, F.lit(True)))
        return known.unionByName(rest.withColumn("leaf", F.lit(None).cast("string")))

    def answer(self, asked: DataFrame, anchors: DataFrame) -> DataFrame:
        """`asked` (entity, epoch, threshold text) with reject_reason and p from the distribution of the leaf that the anchor falls in."""
        return answer(asked, self.grouped(anchors), self.distribution, self.spec, self.prior, "leaf")


def fit_and_save(train: DataFrame, features: list[str], total: str, spec: GridSpec, path: str, *, prior: float, depth: int = 5, least: int = 20, seed: int = 7) -> None:
    """Fits a tree for log1p of the total on `train`, and writes it with the distribution of the total in each leaf and the contract below `path`, which must be new.

    Features from the future are refused. Rows without a total take no part; a null feature is an error.
    """
    guard_features(features, FUTURE | {total})
    rows = train.where(F.col(total).isNotNull()).select(*features, F.col(total).cast("decimal(38,18)").alias("value"))
    tree = DecisionTreeRegressor(featuresCol="features", labelCol="_target", maxDepth=depth, minInstancesPerNode=least, leafCol="leaf", seed=seed)
    stages = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error"), tree]
    model = Pipeline(stages=stages).fit(rows.withColumn("_target", F.log1p(F.col("value").cast("double"))))
    model.write().save(f"{path}/tree")
    placed = model.transform(rows).select(F.col("leaf").cast("long").cast("string").alias("grp"), "value")
    ecdf.fit(placed, "grp", "value").write.parquet(f"{path}/distribution")
    spark = train.sparkSession
    sizes = spark.read.parquet(f"{path}/distribution").groupBy("grp").agg(F.max("n").alias("n")).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("leaves"))
    found = sizes.select(
        F.lit(VERSION).alias("version"), F.array(*[F.lit(f) for f in features]).alias("features"), *[F.lit(getattr(spec, n)).alias(n) for n in ("step", "history", "future")], F.lit(float(prior)).alias("prior"), "rows", "leaves"
    )
    found.coalesce(1).write.json(f"{path}/contract")


def load(spark: SparkSession, path: str, features: list[str], spec: GridSpec) -> LeafModel:
    """The model below `path`, if it was made for these features in this order and this grid, and its parts belong together; else a ValueError."""
    row = spark.read.schema(CONTRACT).json(f"{path}/contract").first()
    wanted = {"version": VERSION, "features": list(features), "step": spec.step, "history": spec.history, "future": spec.future}
    if row is None or (wrong := {k: row[k] for k, v in wanted.items() if row[k] != v}):
        raise ValueError(f"the model at {path} does not fit: {wrong if row else 'no contract'}")
    tree = PipelineModel.load(f"{path}/tree")
    if tree.stages[0].getInputCols() != list(features):
        raise ValueError(f"the tree at {path} reads other features than its contract names")
    distribution = spark.read.parquet(f"{path}/distribution")
    held = distribution.groupBy("grp").agg(F.max("n").alias("n"), F.max("cum_n").alias("last")).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("leaves"), F.count_if(F.col("n") != F.col("last")).alias("broken")).first()
    if (held["rows"], held["leaves"], held["broken"]) != (row["rows"], row["leaves"], 0):
        raise ValueError(f"the distribution at {path} is not the one that was written with the tree")
    return LeafModel(tree, distribution, list(features), spec, row["prior"])
