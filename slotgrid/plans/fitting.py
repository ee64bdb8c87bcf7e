"""Models fitted on the training anchors; their rows have no SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ecdf, folds, leaf_model, models, windows
from ..queries import DAY, EVAL_END, THRESHOLDS, TRAIN_END, _grid
from ..registry import query
from ..sources.shared import Scratch
from .scoring import _requests

NUMBERS = ["sum_2", "sum_all", "max_all", "std_all", "ratio"]


def _rows(spark, sf):
    out = windows.features(windows.targets(_grid(spark, sf, DAY), DAY), DAY).where("target_valid AND history_valid")
    out = out.withColumn("role", folds.fold_role(F.col("slot"), F.col("slot") + DAY.future * DAY.step, TRAIN_END, EVAL_END)).where("role IN ('TRAIN', 'VALIDATION')")
    models.guard_features(NUMBERS, {"future_total", "future_n", "target_valid"})
    weekday = F.dayofweek(F.timestamp_seconds("slot")).cast("string")
    return out.select("entity", "slot", "role", "future_total", weekday.alias("weekday"), *NUMBERS, (F.col("future_total") > 100).cast("double").alias("label"))


@query()
def m11_prep(spark, sf):
    """Assembled vectors of the validation rows by a preprocessor that saw training rows alone."""
    rows = _rows(spark, sf)
    model = models.fit_and_reload(spark, rows.where("role = 'TRAIN'"), models.preprocessor("weekday", NUMBERS), Scratch(spark, "prep").path())
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows.where("role = 'VALIDATION'")).select("entity", "slot", F.size(vector_to_array("features")).alias("width"))


@query()
def m12_classifiers(spark, sf):
    """A regression, a tree and a forest, saved, loaded and evaluated on the validation rows."""
    rows = Scratch(spark, "anchors").keep(_rows(spark, sf))
    out = None
    for name, last in models.classifiers().items():
        model = models.fit_and_reload(spark, rows.where("role = 'TRAIN'"), [*models.preprocessor("weekday", NUMBERS), last], Scratch(spark, name).path())
        scored = models.probability(model.transform(rows.where("role = 'VALIDATION'"))).select(F.lit(name).alias("model"), "label", "p")
        out = scored if out is None else out.unionByName(scored)
    return ecdf.metrics(out, ["model"]).select("model", "n", "brier", "log_loss")


@query()
def m14_leaf_cdf(spark, sf):
    """Anchors grouped by the leaf of a regression tree, and each leaf's share above the thresholds."""
    rows = Scratch(spark, "anchors").keep(_rows(spark, sf))
    train = rows.where("role = 'TRAIN'")
    placed = models.leaf_groups(train, train, NUMBERS, "future_total").select("leaf", F.col("future_total").alias("value"))
    found = ecdf.survival(ecdf.fit(placed, "leaf", "value"), "leaf", "value", THRESHOLDS)
    return ecdf.shrink(found, found.groupBy("threshold").agg(F.sum("n").alias("n"), F.sum("above").alias("above")), 50)


@query()
def m20_leaf_requests(spark, sf):
    """Requests answered by a stored tree and the distribution of the leaf that their past falls in, or refused with a reason."""
    anchors = Scratch(spark, "anchors").keep(windows.features(windows.targets(_grid(spark, sf, DAY), DAY), DAY))
    train = anchors.withColumn("role", folds.fold_role(F.col("slot"), F.col("slot") + DAY.future * DAY.step, TRAIN_END, EVAL_END)).where("role = 'TRAIN' AND target_valid AND history_valid")
    path = Scratch(spark, "leaf-model").path()
    leaf_model.fit_and_save(train, NUMBERS, "future_total", DAY, path, prior=50)
    model = leaf_model.load(spark, path, NUMBERS, DAY)
    return model.answer(_requests(spark, sf), anchors).select("request_id", "reject_reason", F.round("p", 8).alias("p"))


@query()
def m21_importance(spark, sf):
    """Coefficients of the logistic model by feature."""
    rows = _rows(spark, sf)
    train = rows.where("role = 'TRAIN'")
    model = models.fit_and_reload(spark, train, [*models.preprocessor("weekday", NUMBERS), models.classifiers()["logistic"]], Scratch(spark, "coefficients").path())
    return models.importances(spark, model.transform(train), model)
