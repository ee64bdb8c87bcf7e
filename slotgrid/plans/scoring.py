"""Distributions per group, request checks and scoring with a global fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import epoch_of
from ..operators import ecdf, folds, requests, windows
from ..queries import CDF, DAY, LEVELS, THRESHOLDS, _anchors, _cdf, _events, _grid, _slots
from ..registry import query
from ..sources.shared import Scratch
from .labels import FOLDS, ROLES

PRIOR = 50
#: Candidates in order of simplicity: (name, how an anchor is grouped, weight of the global share).
MODELS = [("frequency", "all", 0), ("weekday", "weekday", 20), ("entity", "entity", 50)]

# Each validation anchor of each fold is scored by each candidate, fitted on that fold's training anchors.
_WEEKDAY = "CAST(dayofweek(make_timestamp(slot * 1000000)) AS VARCHAR)"
_GROUP = {"all": "'all'", "weekday": _WEEKDAY, "entity": "CAST(entity AS VARCHAR)"}
_MODELS = " UNION ALL ".join(f"SELECT q.*, '{m}' AS model, {_GROUP[g]} AS grp, {w} AS prior FROM q" for m, g, w in MODELS)
CANDIDATES = ROLES + f""", q AS (SELECT r.entity, r.slot, r.protocol, r.role, a.future_total FROM roles r JOIN a ON r.entity = a.entity AND r.slot = a.slot WHERE r.protocol <> 'final' AND a.future_total IS NOT NULL AND r.role IN ('TRAIN', 'VALIDATION')),
 mm AS ({_MODELS}), ml AS (SELECT mm.*, CAST(threshold AS DOUBLE) AS threshold, CASE WHEN future_total > threshold THEN 1.0 ELSE 0.0 END AS label FROM mm, {LEVELS}),
 tr AS (SELECT protocol, model, grp, threshold, count(*) AS n, sum(label) AS above FROM ml WHERE role = 'TRAIN' GROUP BY 1, 2, 3, 4), gl AS (SELECT protocol, threshold, above / n AS share FROM tr WHERE model = 'frequency'),
 sc AS (SELECT ml.model, ml.protocol, ml.entity, ml.slot, ml.threshold, ml.label, coalesce((tr.above + prior * share) / (tr.n + prior), share) AS p FROM ml LEFT JOIN tr ON tr.protocol = ml.protocol AND tr.model = ml.model AND tr.grp = ml.grp AND tr.threshold = ml.threshold
 JOIN gl ON gl.protocol = ml.protocol AND gl.threshold = ml.threshold WHERE role = 'VALIDATION')"""


def _grouped(spark: SparkSession, sf: str) -> DataFrame:
    anchors = windows.targets(_grid(spark, sf, DAY), DAY).where("future_total IS NOT NULL")
    rows = folds.roles(anchors, "slot", DAY.future * DAY.step, FOLDS[:2]).where("role IN ('TRAIN', 'VALIDATION')")
    group = {"all": F.lit("all"), "weekday": F.dayofweek(F.timestamp_seconds("slot")).cast("string"), "entity": F.col("entity").cast("string")}
    each = [F.struct(F.lit(m).alias("model"), group[g].alias("grp"), F.lit(w).alias("prior")) for m, g, w in MODELS]
    return rows.select("entity", "slot", "protocol", "role", "future_total", F.explode(F.array(*each)).alias("_m")).select("*", "_m.*").drop("_m")


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """(model, protocol, entity, slot, threshold, label, p) of all candidates and folds, written once: fits, shares and what reads the scores start from stored rows."""
    scratch = Scratch(spark, "candidates")
    rows = scratch.keep(_grouped(spark, sf))
    keys = ["protocol", "model", "grp"]
    train = rows.where("role = 'TRAIN'").withColumn("key", F.struct(*keys))
    found = scratch.keep(ecdf.survival(ecdf.fit(train.select("key", F.col("future_total").alias("value")), "key", "value"), "key", "value", THRESHOLDS).select("key.*", "threshold", "n", "above"))
    overall = found.where("model = 'frequency'").select("protocol", "threshold", (F.col("above") / F.col("n")).alias("share"))
    asked = folds.expand(rows.where("role = 'VALIDATION'"), "future_total", THRESHOLDS)
    return scratch.keep(ecdf.score(asked, found, overall, [*keys, "threshold"], ["protocol", "threshold"], "prior").select("model", "protocol", "entity", "slot", "threshold", "label", "p"))


@query(f"WITH {CANDIDATES} SELECT model, protocol, entity, slot, threshold, label, round(p, 8) AS p FROM sc")
def j9_fallback(spark, sf):
    """Scores with groups the training rows lack: they get the global share."""
    return candidates(spark, sf).withColumn("p", F.round("p", 8))


@query(f"WITH {CANDIDATES} SELECT protocol, threshold, n, CAST(above AS BIGINT) AS above, round(above / n, 8) AS p FROM tr WHERE model = 'frequency'")
def m13_frequency(spark, sf):
    """The share of exceedances in the training rows of each fold."""
    rows = _grouped(spark, sf).where("role = 'TRAIN' AND model = 'frequency'")
    return ecdf.frequency(folds.expand(rows, "future_total", THRESHOLDS), ["protocol", "threshold"]).withColumn("p", F.round("p", 8))


@query(f"WITH {_slots(86_400)}, h AS (SELECT entity, slot, CAST(v AS DOUBLE) AS v, lag(CAST(v AS DOUBLE)) OVER (PARTITION BY entity ORDER BY slot RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ignore FROM g) SELECT entity, slot, concat_ws('|', CAST(entity AS VARCHAR), CAST(month(make_timestamp((slot + 28800) * 1000000)) AS VARCHAR), CAST(hour(make_timestamp((slot + 28800) * 1000000)) AS VARCHAR)) AS climate, CASE WHEN v <= 0 THEN 'B0' WHEN v <= 50 THEN 'B1' WHEN v <= 150 THEN 'B2' ELSE 'B3' END || '|' || CASE WHEN v > 100 THEN 'wet' ELSE 'dry' END AS recent FROM h")
def m15_groups(spark, sf):
    """Grouping keys of an anchor: its series, month and hour in a zone eight hours ahead, and the bin of its last amount with a wet flag."""
    grid = _grid(spark, sf, DAY).withColumn("v", F.col("v").cast("double"))
    return requests.group_keys(grid, "entity", "slot", "v", zone_seconds=28_800, cuts=[0, 50, 150], wet=100).select("entity", "slot", "climate", "recent")


KINDS = {0: "true", 1: "-0.1", 2: "NaN", 3: "0.0000000000000000001", 4: "1e20", 5: "0", 6: "50", 7: "100.5", 8: "", 9: "Infinity", 10: "0.000000000000000001", 11: "99999999999999999999"}
_TEXTS = "CASE event_id % 12 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in KINDS.items()) + " END"
REQUESTS = f"rq AS (SELECT event_id AS request_id, CASE WHEN event_id % 19 = 3 THEN -1 ELSE user_id END AS entity, CAST(floor(epoch(ts)) AS BIGINT) // 86400 * 86400 + CASE WHEN event_id % 17 = 2 THEN 7 ELSE 0 END AS epoch, {_TEXTS} AS threshold FROM events)"
# what is wrong with a threshold, text by text: the SQL side has no exact decimals beyond its own
_BAD = "CASE WHEN threshold IN ('true', 'NaN', '', 'Infinity') THEN 'NOT_A_NUMBER' WHEN threshold = '-0.1' THEN 'NEGATIVE' WHEN threshold = '1e20' THEN 'TOO_LARGE' WHEN threshold = '0.0000000000000000001' THEN 'TOO_MANY_DECIMALS' END"


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    k, text = F.col("event_id") % 12, F.lit(None).cast("string")
    for kind, value in KINDS.items():
        text = F.when(k == kind, value).otherwise(text)
    at = epoch_of(F.col("ts"))
    return _events(spark, sf).select(
        F.col("event_id").alias("request_id"), F.when(F.col("event_id") % 19 == 3, -1).otherwise(F.col("user_id")).alias("entity"),
        (F.floor(at / 86_400) * 86_400 + F.when(F.col("event_id") % 17 == 2, 7).otherwise(0)).alias("epoch"), text.alias("threshold"),
    )


@query(f"WITH {REQUESTS} SELECT request_id, {_BAD} AS problem FROM rq")
def m19_requests(spark, sf):
    return _requests(spark, sf).select("request_id", requests.threshold_problem(F.col("threshold")).alias("problem"))


@query(f"""WITH {CDF}, {REQUESTS}, c AS (SELECT request_id, rq.entity, rq.epoch, threshold, CASE WHEN {_BAD} IS NOT NULL THEN 'BAD_THRESHOLD' WHEN rq.entity NOT IN (SELECT entity FROM a) THEN 'UNKNOWN_ENTITY' WHEN rq.epoch % 86400 <> 0 THEN 'OFF_GRID' WHEN coalesce(a.history_n, 0) < 4 THEN 'INCOMPLETE_HISTORY' END AS reject_reason
  FROM rq LEFT JOIN a ON a.entity = rq.entity AND a.slot = rq.epoch), tt AS (SELECT entity AS grp, future_total FROM a WHERE future_total IS NOT NULL), ok AS (SELECT *, CAST(threshold AS DOUBLE) AS level FROM c WHERE reject_reason IS NULL),
  lv AS (SELECT DISTINCT level FROM ok), o AS (SELECT level, avg(CASE WHEN CAST(future_total AS DOUBLE) > level THEN 1.0 ELSE 0.0 END) AS share FROM lv, tt GROUP BY 1), w AS (SELECT grp, level, count(*) AS n, sum(CASE WHEN CAST(future_total AS DOUBLE) > level THEN 1 ELSE 0 END) AS above FROM lv, tt GROUP BY 1, 2)
  SELECT request_id, reject_reason, round(CASE WHEN reject_reason IS NULL THEN coalesce((above + {PRIOR} * share) / (n + {PRIOR}), share) END, 8) AS p FROM c LEFT JOIN (SELECT request_id, n, above, share FROM ok JOIN o USING (level) LEFT JOIN w ON w.grp = ok.entity AND w.level = ok.level) USING (request_id)""")
def m20_request_scores(spark, sf):
    """Requests (entity, epoch, threshold) answered from past data alone, or refused with a reason."""
    anchors = windows.targets(_grid(spark, sf, DAY), DAY)
    return requests.answer(_requests(spark, sf), anchors, _cdf(spark, sf), DAY, PRIOR).select("request_id", "reject_reason", F.round("p", 8).alias("p"))


@query(f"WITH {CDF}, c AS (SELECT grp, value, cum_n, n, lag(cum_n) OVER (PARTITION BY grp ORDER BY value) AS b, max(cum_n) OVER (PARTITION BY grp) AS m FROM d), f AS (SELECT grp, any_value(n) AS n FROM d GROUP BY 1) SELECT CAST(sum(CASE WHEN b >= cum_n THEN 1 ELSE 0 END) AS BIGINT) AS not_rising, CAST(sum(CASE WHEN m <> n THEN 1 ELSE 0 END) AS BIGINT) AS wrong_last, (SELECT CAST(sum(n) AS BIGINT) FROM f) AS group_rows, (SELECT count(*) FROM a WHERE future_total IS NOT NULL) AS all_rows FROM c")
def e10_cdf_check(spark, sf):
    known = windows.targets(_grid(spark, sf, DAY), DAY).where("future_total IS NOT NULL")
    return ecdf.check(_cdf(spark, sf), "grp", "value", known.select(F.lit(1).alias("one")))


@query(f"WITH {CDF}, k2 AS (SELECT future_total AS value, count(*) AS k FROM a WHERE future_total IS NOT NULL GROUP BY 1) SELECT CAST(value AS DOUBLE) AS value, CAST(sum(k) OVER (ORDER BY value) AS BIGINT) AS cum_n FROM k2")
def m16_global_ecdf(spark, sf):
    """The distribution over all groups: range partitions are summed first, so that no task gets every value."""
    known = windows.targets(_grid(spark, sf, DAY), DAY).where("future_total IS NOT NULL").select(F.col("future_total").alias("value"))
    return ecdf.fit_all(known, "value").select(F.col("value").cast("double").alias("value"), "cum_n")


@query(f"WITH {CANDIDATES} SELECT (SELECT count(*) FROM sc) AS matched, round((SELECT max(abs(a.p - b.p)) FROM sc a JOIN sc b ON a.entity = b.entity AND a.slot = b.slot AND a.threshold = b.threshold AND a.protocol = b.protocol AND a.model = 'weekday' AND b.model = 'entity'), 8) AS max_difference")
def j11_score_difference(spark, sf):
    """Two candidates' scores of the same anchors side by side."""
    out = candidates(spark, sf)
    keys = ["protocol", "entity", "slot", "threshold"]
    from ..operators import joins

    pair = joins.score_difference(out.where("model = 'weekday'"), out.where("model = 'entity'"), keys)
    return pair.select((F.col("matched") * 3).alias("matched"), F.round("max_difference", 8).alias("max_difference"))


@query(f"WITH {CANDIDATES} SELECT protocol, model, count(*) AS n, CAST(sum(CASE WHEN p IS NULL OR isnan(p) THEN 1 ELSE 0 END) AS BIGINT) AS unknown_p, CAST(sum(CASE WHEN p < 0 OR p > 1 THEN 1 ELSE 0 END) AS BIGINT) AS outside, CAST(sum(CASE WHEN label IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_labels, round(min(p), 8) AS least, round(max(p), 8) AS most FROM sc GROUP BY 1, 2")
def e1_valid(spark, sf):
    out = ecdf.validity(candidates(spark, sf), ["protocol", "model"])
    return out.withColumns({c: F.round(c, 8) for c in ("least", "most")})
