"""Evaluation of candidates: groups, selection, ablation, skill and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ecdf, folds, windows
from ..queries import DAY, _grid
from ..registry import query
from .scoring import CANDIDATES, MODELS, candidates

ORDER = [m for m, _, _ in MODELS]
TABLE = CANDIDATES + ", tb AS (SELECT model, protocol, threshold, count(*) AS n, avg((p - label) * (p - label)) AS brier, avg(-(label * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - label) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)))) AS log_loss FROM sc GROUP BY 1, 2, 3)"
PLACE = "CASE model WHEN 'frequency' THEN 1 WHEN 'weekday' THEN 2 ELSE 3 END"
SELECTED = TABLE + f", pf AS (SELECT model, protocol, avg(brier) AS b FROM tb GROUP BY 1, 2), ms AS (SELECT model, avg(b) AS mean_brier, CAST({PLACE} AS INTEGER) AS place FROM pf GROUP BY 1)"


def _table(spark, sf):
    return ecdf.metrics(candidates(spark, sf), ["model", "protocol", "threshold"])


def _areas_sql(keys: str, source: str) -> str:
    return f"""bn AS (SELECT {keys}, CAST(least(floor(round(p, 10) * 1000), 999) AS INTEGER) AS bin, sum(label) AS pos, sum(1 - label) AS neg FROM {source} GROUP BY ALL),
 cv AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER (PARTITION BY {keys}) AS pa, sum(neg) OVER (PARTITION BY {keys}) AS na FROM bn WINDOW d AS (PARTITION BY {keys} ORDER BY bin DESC)),
 pv AS (SELECT *, tp / (tp + fp) AS pn, coalesce(lag(tp / (tp + fp)) OVER (PARTITION BY {keys} ORDER BY bin DESC), 1) AS pb FROM cv),
 ar AS (SELECT {keys}, CASE WHEN max(pa) > 0 AND max(na) > 0 THEN sum(neg * (tp - pos / 2)) / (max(pa) * max(na)) END AS roc_area, CASE WHEN max(pa) > 0 AND max(na) > 0 THEN sum(CASE WHEN pa > 0 THEN pos / pa * (pn + pb) / 2 END) END AS pr_area FROM pv GROUP BY ALL)"""


@query(f"WITH {CANDIDATES}, {_areas_sql('model, protocol, threshold', 'sc')} SELECT model, protocol, threshold, round(roc_area, 6) AS roc_area, round(pr_area, 6) AS pr_area FROM ar")
def w16_areas(spark, sf):
    scores = candidates(spark, sf).withColumn("p", F.round("p", 10))
    return ecdf.areas(scores, ["model", "protocol", "threshold"]).withColumns({c: F.round(c, 6) for c in ("roc_area", "pr_area")})


@query(f"WITH {CANDIDATES} SELECT model, threshold, count(*) AS n, round(avg(p), 8) AS mean_p, round(avg(label), 6) AS observed FROM sc WHERE round(p, 10) <= 0.35 GROUP BY 1, 2")
def e5_low_region(spark, sf):
    out = ecdf.low_region(candidates(spark, sf).withColumn("p", F.round("p", 10)), ["model", "threshold"], 0.35)
    return out.select("model", "threshold", "n", F.round("mean_p", 8).alias("mean_p"), F.round("observed", 6).alias("observed"))


GROUPED = CANDIDATES + """, gr AS (SELECT sc.*, 'history' AS grouping, CASE WHEN h.v > 100 THEN 'wet' ELSE 'dry' END AS level FROM sc JOIN a h ON h.entity = sc.entity AND h.slot = sc.slot WHERE model = 'entity'
 UNION ALL SELECT sc.*, 'weekday', CAST(dayofweek(make_timestamp(slot * 1000000)) + 1 AS VARCHAR) FROM sc WHERE model = 'entity')"""


def _grouped_scores(spark, sf):
    anchors = windows.targets(_grid(spark, sf, DAY), DAY).select("entity", "slot", "v")
    return candidates(spark, sf).where("model = 'entity'").join(anchors, ["entity", "slot"]).withColumn("p", F.round("p", 10))


def _groupings():
    return {"history": F.when(F.col("v") > 100, "wet").otherwise("dry"), "weekday": F.dayofweek(F.timestamp_seconds("slot")).cast("string")}


@query(f"""WITH {GROUPED}, cb AS (SELECT grouping, level, threshold, least(floor(round(p, 10) * 10), 9) AS bin, count(*) AS n, sum(round(p, 10)) AS sp, sum(label) AS sl, sum(pow(round(p, 10) - label, 2)) AS sq FROM gr GROUP BY 1, 2, 3, 4), ev AS (SELECT grouping, level, threshold, sum(n) AS n, sum(sq) / sum(n) AS brier, sum(abs(sp - sl)) / sum(n) AS ece FROM cb GROUP BY 1, 2, 3), {_areas_sql('grouping, level, threshold', 'gr')}
 SELECT grouping, level, threshold, CAST(n AS BIGINT) AS n, round(brier, 6) AS brier, round(ece, 6) AS ece, round(roc_area, 6) AS roc_area, round(pr_area, 6) AS pr_area, round(n / sum(n) OVER (PARTITION BY grouping, threshold), 6) AS coverage FROM ev JOIN ar USING (grouping, level, threshold)""")
def e6_groups(spark, sf):
    out = ecdf.grouped(_grouped_scores(spark, sf), _groupings(), ["threshold"])
    return out.withColumns({c: F.round(c, 6) for c in ("brier", "ece", "roc_area", "pr_area", "coverage")})


@query(f"""WITH {GROUPED}, o AS (SELECT CASE WHEN v > 100 THEN 'wet' ELSE 'dry' END AS level, count(*) AS observed, CAST(sum(CASE WHEN future_n = 2 AND history_n = 4 THEN 1 ELSE 0 END) AS BIGINT) AS eligible FROM a GROUP BY 1) SELECT level, observed, eligible, round(eligible / observed, 6) AS share FROM o""")
def e7_denominators(spark, sf):
    """Observed anchors of each group beside the eligible ones."""
    out = windows.targets(_grid(spark, sf, DAY), DAY)
    kept = folds.retention(out, F.when(F.col("v") > 100, "wet").otherwise("dry").alias("level"), F.col("target_valid") & F.col("history_valid"))
    return kept.select("level", F.col("anchors").alias("observed"), F.col("complete").alias("eligible"), F.round("rate", 6).alias("share"))


@query(f"WITH {SELECTED}, b AS (SELECT min(mean_brier) AS best FROM ms), f AS (SELECT min(place) AS first FROM ms, b WHERE mean_brier <= best + 1e-5) SELECT model, round(mean_brier, 6) AS mean_brier, place, CAST(place = first AS BIGINT) AS chosen FROM ms, f")
def e8_select(spark, sf):
    return ecdf.select_model(_table(spark, sf), ORDER).withColumn("mean_brier", F.round("mean_brier", 6))


@query(f"WITH {SELECTED} SELECT model, place, round(mean_brier, 6) AS mean_brier, round(mean_brier - lag(mean_brier) OVER (ORDER BY place), 6) AS delta FROM ms")
def e9_ablation(spark, sf):
    out = ecdf.ablation(ecdf.select_model(_table(spark, sf), ORDER))
    return out.select("model", "place", F.round("mean_brier", 6).alias("mean_brier"), F.round("delta", 6).alias("delta"))


@query(f"WITH {CANDIDATES}, q2 AS (SELECT model, protocol, threshold, round(p, 10) AS p, label FROM sc), tt AS (SELECT model, protocol, threshold, count(*) AS n, sum(label) AS positives, avg(p) AS mean_p FROM q2 GROUP BY 1, 2, 3) SELECT model, protocol, threshold, n, round(positives, 6) AS positives, round(mean_p, 6) AS mean_p, CAST(0 AS BIGINT) * n AS n_gap, CAST(1 AS BIGINT) AS close FROM tt")
def e11_reconcile(spark, sf):
    """Totals rebuilt from the calibration bins, held against the totals."""
    out = ecdf.reconcile_bins(candidates(spark, sf).withColumn("p", F.round("p", 10)), ["model", "protocol", "threshold"])
    close = (F.col("positives_gap") < 1e-6) & (F.col("mean_p_gap") < 1e-9)
    return out.select("model", "protocol", "threshold", "n", F.round("positives", 6).alias("positives"), F.round("mean_p", 6).alias("mean_p"), "n_gap", close.cast("long").alias("close"))


@query(f"WITH {TABLE} SELECT t.model, t.protocol, t.threshold, round(t.brier, 6) AS brier, round(CASE WHEN b.brier > 0 THEN 1 - t.brier / b.brier END, 6) AS skill FROM tb t JOIN tb b ON b.model = 'frequency' AND b.protocol = t.protocol AND b.threshold = t.threshold")
def e12_skill(spark, sf):
    out = ecdf.skill(_table(spark, sf), "frequency", ["protocol", "threshold"])
    return out.select("model", "protocol", "threshold", F.round("brier", 6).alias("brier"), F.round("skill", 6).alias("skill"))


@query(f"WITH {TABLE}, {_areas_sql('model, protocol, threshold', 'sc')} SELECT model, count(*) AS cells, round(avg(brier), 6) AS brier, round(avg(log_loss), 6) AS log_loss, round(avg(roc_area), 6) AS roc_area, round(avg(pr_area), 6) AS pr_area FROM tb JOIN ar USING (model, protocol, threshold) GROUP BY 1")
def e13_rollup(spark, sf):
    """Means over folds and thresholds; an unknown area takes no part."""
    keys = ["model", "protocol", "threshold"]
    scores = candidates(spark, sf)
    cells = ecdf.metrics(scores, keys).join(ecdf.areas(scores.withColumn("p", F.round("p", 10)), keys), keys)
    return cells.groupBy("model").agg(F.count(F.lit(1)).alias("cells"), *[F.round(F.avg(c), 6).alias(c) for c in ("brier", "log_loss", "roc_area", "pr_area")])
