"""Anchors with exact future totals: completeness, fold roles, expansion, support and retention."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..operators import folds, windows
from ..queries import DAY, EXPANDED, FEATURES, ROLE, TARGETS, THRESHOLDS, TRAIN_END, EVAL_END, _anchors, _grid, _over, _slots
from ..registry import query
from ..sources import periods
from ..sources.shared import Scratch

#: (name, end of training, end of evaluation): each fold trains on all before and is judged on the block after.
FOLDS = [("fold1", 1_704_672_000, 1_705_276_800), ("fold2", TRAIN_END, EVAL_END), ("final", EVAL_END, 1_706_486_400)]
START, STOP = 1_704_844_800, 1_705_449_600


def role_sql(train_end: int, eval_end: int) -> str:
    return ROLE.replace(str(TRAIN_END), "@").replace(str(EVAL_END), str(eval_end)).replace("@", str(train_end))


ROLES = TARGETS + ", roles AS (" + " UNION ALL ".join(f"SELECT entity, slot, future_n = 2 AND history_n = 4 AS eligible, '{n}' AS protocol, {role_sql(a, b)} AS role FROM a" for n, a, b in FOLDS) + ")"


@query(f"WITH {TARGETS} SELECT entity, slot, history_n, CAST(history_n = 4 AS BIGINT) AS history_valid FROM a")
def w6_history_count(spark, sf):
    return windows.targets(_grid(spark, sf, DAY), DAY).select("entity", "slot", "history_n", F.col("history_valid").cast("long").alias("history_valid"))


@query(f"WITH {TARGETS} SELECT entity, slot, future_n, history_n, CAST(future_total AS DOUBLE) AS future_total FROM a")
def w5_bucketed(spark, sf):
    """The future total with each series cut into buckets of 8 slots."""
    out = windows.over_buckets(_grid(spark, sf, DAY), DAY, 8, windows.targets)
    return out.select("entity", "slot", "future_n", "history_n", F.col("future_total").cast("double").alias("future_total"))


@query(f"WITH {FEATURES} SELECT entity, slot, round(CASE WHEN n2 = 2 THEN s2 END, 4) AS sum_2, round(CASE WHEN n4 = 4 THEN s4 END, 4) AS sum_all, round(CASE WHEN n4 = 4 THEN d4 END, 4) AS std_all FROM h")
def w8_bucketed(spark, sf):
    out = windows.over_buckets(_grid(spark, sf, DAY), DAY, 8, windows.features)
    return out.select("entity", "slot", *[F.round(c, 4).alias(c) for c in ("sum_2", "sum_all", "std_all")])


CHANGES = _slots(86_400) + f""", h AS (SELECT entity, slot, CAST(v AS DOUBLE) AS v, count(v) {_over(-1, 0, 86_400)} AS n2, count(v) {_over(-3, -2, 86_400)} AS m2, count(v) {_over(-3, 0, 86_400)} AS n4,
 CAST(sum(v) {_over(-1, 0, 86_400)} AS DOUBLE) AS s2, CAST(sum(v) {_over(-3, -2, 86_400)} AS DOUBLE) AS t2, CAST(sum(v) {_over(-3, 0, 86_400)} AS DOUBLE) AS s4 FROM g)"""


@query(f"WITH {CHANGES} SELECT entity, slot, round(CASE WHEN m2 = 2 THEN t2 END, 4) AS sum_before_2, round(CASE WHEN n2 = 2 AND m2 = 2 THEN s2 - t2 END, 4) AS change_2, round(CASE WHEN n4 = 4 THEN CASE WHEN s4 = 0 THEN 0 ELSE s2 / s4 END END, 6) AS ratio FROM h")
def w11_changes(spark, sf):
    out = windows.features(_grid(spark, sf, DAY), DAY)
    return out.select("entity", "slot", F.round("sum_before_2", 4).alias("sum_before_2"), F.round("change_2", 4).alias("change_2"), F.round("ratio", 6).alias("ratio"))


# dry days are rare in the events, so a day counts as wet above 20 here and every flag moves
WET = _slots(86_400) + f""", z AS (SELECT entity, slot, CASE WHEN v > 20 THEN 1 ELSE 0 END AS wet FROM g), h AS (SELECT entity, slot, count(*) {_over(-3, 0, 86_400)} AS n, max(CASE WHEN wet = 1 THEN slot END) {_over(-3, 0, 86_400)} AS ev, max(CASE WHEN wet = 0 THEN slot END) {_over(-3, 0, 86_400)} AS st FROM z)"""


@query(f"WITH {WET} SELECT entity, slot, CASE WHEN n = 4 THEN CASE WHEN st IS NULL THEN 4 ELSE (slot - st) // 86400 END END AS run_slots, CASE WHEN n = 4 THEN CAST(st IS NULL AS BIGINT) END AS run_censored, CASE WHEN n = 4 THEN slot - ev END AS since_event_s, CASE WHEN n = 4 THEN CAST(ev IS NULL AS BIGINT) END AS no_event, CASE WHEN n = 4 THEN coalesce(slot - ev, 345600) END AS since_event_code FROM h")
def w12_censored_runs(spark, sf):
    grid = _grid(spark, sf, DAY).withColumn("v", F.when(F.col("v") > 20, 1).otherwise(0).cast("decimal(18,2)"))
    return windows.features(grid, DAY).select("entity", "slot", "run_slots", "run_censored", "since_event_s", "no_event", "since_event_code")


@query(f"WITH {TARGETS}, s AS (SELECT min(slot) AS first, max(slot) AS last FROM a) SELECT entity, slot, concat_ws('|', CASE WHEN future_n <> 2 AND slot + 172800 > last THEN 'DATASET_END' END, CASE WHEN history_n <> 4 AND slot - 259200 < first THEN 'DATASET_START' END) AS edges FROM a, s")
def w7_edge_reasons(spark, sf):
    return windows.edge_reasons(windows.targets(_grid(spark, sf, DAY), DAY), DAY).select("entity", "slot", F.array_join("edge_reason", "|").alias("edges"))


@query(f"WITH {TARGETS} SELECT entity, slot, history_n, CAST(future_total AS DOUBLE) AS future_total FROM a WHERE slot >= {START} AND slot < {STOP}")
def p13_padded_period(spark, sf):
    """One period alone: only its rows and what its windows see are read."""
    out = windows.padded(_grid(spark, sf, DAY), DAY, START, STOP, windows.targets)
    return out.select("entity", "slot", "history_n", F.col("future_total").cast("double").alias("future_total"))


@query(f"WITH {TARGETS} SELECT entity, slot, history_n, CAST(future_total AS DOUBLE) AS future_total FROM a WHERE slot >= {START} AND slot < {STOP}")
def p13_pruned_period(spark, sf):
    """The same from a table in folders of weeks: only the folders of the period and of what its windows see are read."""
    path = Scratch(spark, "weeks").path()
    periods.write_periods(_grid(spark, sf, DAY), path, "slot", "week")
    out = periods.padded_period(spark, path, "week", DAY, START, STOP, windows.targets)
    return out.select("entity", "slot", "history_n", F.col("future_total").cast("double").alias("future_total"))


@query(f"WITH {_slots(86_400)} SELECT entity, slot, CAST(CASE WHEN slot >= {START} AND slot < {STOP} THEN v + 1 ELSE v END AS DOUBLE) AS v FROM g")
def io8_rewritten_periods(spark, sf):
    """A table in folders of days, of which a week is written again; the other folders keep their files."""
    path = Scratch(spark, "days").path()
    grid = _grid(spark, sf, DAY).select("entity", "slot", "v")
    periods.write_periods(grid, path, "slot", "day")
    again = periods.read_periods(spark, path, "day", START, STOP).drop(periods.PERIOD).withColumn("v", (F.col("v") + 1).cast("decimal(18,2)"))
    periods.write_periods(Scratch(spark, "again").keep(again), path, "slot", "day", replace=True)
    return spark.read.parquet(path).select("entity", "slot", F.col("v").cast("double").alias("v"))


@query(f"WITH {ROLES} SELECT entity, slot, protocol, role FROM roles")
def m5_roles(spark, sf):
    return folds.roles(windows.targets(_grid(spark, sf, DAY), DAY), "slot", DAY.future * DAY.step, FOLDS).select("entity", "slot", "protocol", "role")


@query(f"WITH {ROLES} SELECT protocol, role, count(*) AS anchors, CAST(sum(CASE WHEN eligible THEN 1 ELSE 0 END) AS BIGINT) AS eligible FROM roles GROUP BY 1, 2")
def a18_protocol_counts(spark, sf):
    out = folds.roles(windows.targets(_grid(spark, sf, DAY), DAY), "slot", DAY.future * DAY.step, FOLDS)
    return out.groupBy("protocol", "role").agg(F.count(F.lit(1)).alias("anchors"), F.sum((F.col("target_valid") & F.col("history_valid")).cast("long")).alias("eligible"))


@query(f"WITH {TARGETS} SELECT entity, CAST(month(make_timestamp(slot * 1000000)) AS INTEGER) AS month, count(*) AS anchors, CAST(sum(CASE WHEN future_n = 2 THEN 1 ELSE 0 END) AS BIGINT) AS complete_future, CAST(sum(CASE WHEN history_n = 4 THEN 1 ELSE 0 END) AS BIGINT) AS complete_history FROM a GROUP BY 1, 2")
def a19_target_quality(spark, sf):
    out = windows.targets(_grid(spark, sf, DAY), DAY).groupBy("entity", F.month(F.timestamp_seconds("slot")).alias("month"))
    return out.agg(F.count(F.lit(1)).alias("anchors"), F.sum(F.col("target_valid").cast("long")).alias("complete_future"), F.sum(F.col("history_valid").cast("long")).alias("complete_history"))


@query(f"WITH {TARGETS} SELECT CAST(slot // 604800 AS BIGINT) AS week, count(*) AS anchors, CAST(sum(CASE WHEN history_n = 4 THEN 1 ELSE 0 END) AS BIGINT) AS complete, CAST(sum(CASE WHEN history_n = 4 THEN 0 ELSE 1 END) AS BIGINT) AS incomplete, round(avg(CASE WHEN history_n = 4 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM a GROUP BY 1")
def a31_retention(spark, sf):
    out = windows.targets(_grid(spark, sf, DAY), DAY)
    return folds.retention(out, F.floor(F.col("slot") / 604_800).cast("long").alias("week"), F.col("history_valid")).withColumn("rate", F.round("rate", 6))


@query(f"WITH {TARGETS}, s AS (SELECT count(*) AS n, sum(CASE WHEN future_n <> 2 THEN 1 ELSE 0 END) AS f, sum(CASE WHEN history_n <> 4 THEN 1 ELSE 0 END) AS h, sum(CASE WHEN future_n <> 2 AND history_n <> 4 THEN 1 ELSE 0 END) AS b FROM a) SELECT loss, CAST(k AS BIGINT) AS n, n AS of_n, round(100 * k / n, 6) AS percent FROM (SELECT n, unnest(['FUTURE', 'HISTORY', 'BOTH']) AS loss, unnest([f, h, b]) AS k FROM s)")
def a29_losses(spark, sf):
    out = windows.targets(_grid(spark, sf, DAY), DAY)
    f, h = ~F.col("target_valid"), ~F.col("history_valid")
    return folds.losses(out, {"FUTURE": f, "HISTORY": h, "BOTH": f & h}).withColumn("percent", F.round("percent", 6))


@query(f"WITH {EXPANDED}, k AS (SELECT entity, slot, threshold, count(*) AS n, sum(CASE WHEN label IS NULL THEN 1 ELSE 0 END) AS m FROM x GROUP BY 1, 2, 3) SELECT (SELECT count(*) FROM a) AS anchors, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n) = (SELECT count(*) FROM a) * 4 AS BIGINT) AS whole, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS repeated_keys, CAST(sum(m) AS BIGINT) AS null_labels FROM k")
def m3_expand_audit(spark, sf):
    anchors = _anchors(spark, sf)
    return folds.audit_expansion(anchors, folds.expand(anchors, "future_total", THRESHOLDS), ["entity", "slot"], len(THRESHOLDS))


@query(f"WITH {EXPANDED} SELECT threshold, CAST(sum(label) AS BIGINT) AS positives, CAST(sum(1 - label) AS BIGINT) AS negatives FROM x WHERE role = 'TRAIN' GROUP BY 1 HAVING sum(label) >= 30 AND sum(1 - label) >= 30")
def m4_kept_thresholds(spark, sf):
    return folds.kept_thresholds(folds.expand(_anchors(spark, sf).where("role = 'TRAIN'"), "future_total", THRESHOLDS), 30)


@query(f"WITH {TARGETS}, r AS (SELECT *, {ROLE} AS role FROM a), e AS (SELECT entity FROM r WHERE role = 'TRAIN' AND future_n = 2 AND history_n = 4 GROUP BY 1 HAVING count(*) >= 5) SELECT entity, slot FROM r WHERE role = 'TRAIN' AND future_n = 2 AND history_n = 4 AND entity IN (SELECT entity FROM e)")
def p14_training_anchors(spark, sf):
    return folds.training_anchors(_anchors(spark, sf), "entity", 5).select("entity", "slot")


@query(f"WITH {TARGETS}, r AS (SELECT *, {ROLE} AS role FROM a), e AS (SELECT entity FROM r WHERE role = 'TRAIN' AND future_n = 2 AND history_n = 4 GROUP BY 1 HAVING count(*) >= 5), c AS (SELECT count(*) AS observed, sum(CASE WHEN history_n = 4 THEN 1 ELSE 0 END) AS history, sum(CASE WHEN history_n = 4 AND future_n = 2 THEN 1 ELSE 0 END) AS eligible, sum(CASE WHEN history_n = 4 AND future_n = 2 AND role = 'TRAIN' AND entity IN (SELECT entity FROM e) THEN 1 ELSE 0 END) AS used FROM r) SELECT stage, CAST(n AS BIGINT) AS n FROM (SELECT unnest(['OBSERVED', 'HISTORY_VALID', 'ELIGIBLE', 'USED']) AS stage, unnest([observed, history, eligible, used]) AS n FROM c)")
def m7_flow(spark, sf):
    return folds.flow(_anchors(spark, sf), "entity", 5)


@query(f"WITH {TARGETS}, c AS (SELECT entity, count(*) AS n FROM a WHERE future_n = 2 GROUP BY 1) SELECT entity, n FROM c ORDER BY n DESC, entity LIMIT 5")
def t5_top_groups(spark, sf):
    return _anchors(spark, sf).where("target_valid").groupBy("entity").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity").limit(5)


@query(f"WITH {TARGETS} SELECT entity, slot, CAST(row_number() OVER (PARTITION BY entity ORDER BY slot) AS INTEGER) AS place FROM a WHERE future_n <> 2 QUALIFY place <= 2")
def t6_first_cases(spark, sf):
    return folds.first_cases(_anchors(spark, sf).where("NOT target_valid"), ["entity"], ["slot"], 2).select("entity", "slot", "place")


@query()
def t7_hash_pick(spark, sf):
    """The 20 anchors of smallest hash: the pick is the feature."""
    return _anchors(spark, sf).orderBy(F.xxhash64("entity", "slot", F.lit(7)), "entity", "slot").limit(20).select("entity", "slot")


@query(f"WITH {TARGETS}, s AS (SELECT entity, min(slot) AS first, max(slot) AS last FROM a GROUP BY 1) SELECT entity, slot, CASE WHEN slot = first THEN 'FIRST' WHEN slot = last THEN 'LAST' ELSE 'SAMPLE' END AS kind FROM a JOIN s USING (entity) WHERE slot IN (first, last) OR (entity * 7919 + slot // 86400 * 104729 + 7) % 10007 < 200")
def m10_probes(spark, sf):
    """Boundary anchors of every series and a stable sample, for checks against an oracle."""
    return folds.probes(_anchors(spark, sf), "entity", "slot", partial(folds.in_sample, keys={"entity": 1, "slot": 86_400}, share=200)).select("entity", "slot", "kind")
