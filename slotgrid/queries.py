"""Registered queries over the driver tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.cyclic import clock_and_season
from .functions.predicates import blank, usable
from .grid import GridSpec, epoch_of, to_grid
from .registry import QUERIES, ORACLE_SQL, query  # noqa: F401
from .operators import clean, collide, coverage, ecdf, folds, joins, rules, windows
from .sources import tables
from .sources.shared import Scratch

DAY = GridSpec(step=86_400, history=4, future=2)
SIX_HOURS = GridSpec(step=21_600, history=4, future=2)
FIVE = GridSpec(step=300)
THRESHOLDS = ["0", "50", "100", "200"]
YEARS = [1996, 1997, 1998, 1999, 2000]
TRAIN_END, EVAL_END = 1_705_276_800, 1_705_881_600


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def _grid(spark: SparkSession, sf: str, spec: GridSpec) -> DataFrame:
    return to_grid(_events(spark, sf), spec, entity="user_id", ts="ts", value="value", order="event_id")


def _slots(step: int) -> str:
    e = "CAST(floor(epoch(ts)) AS BIGINT)"
    return f"g AS (SELECT user_id AS entity, {e} - {e} % {step} AS slot, CAST(arg_min(value, event_id) AS DECIMAL(18,2)) AS v, count(*) AS n FROM events GROUP BY 1, 2)"


def _over(a: int, b: int, step: int) -> str:
    def end(k: int) -> str:
        return f"{abs(k) * step} {'FOLLOWING' if k >= 0 else 'PRECEDING'}" if k else "CURRENT ROW"

    return f"OVER (PARTITION BY entity ORDER BY slot RANGE BETWEEN {end(a)} AND {end(b)})"


# --- raw lines ---------------------------------------------------------------------------------------------------

HEADER = "event_id,epoch,user_id,value"
LINE = """l AS (SELECT event_id, concat_ws(',', CAST(event_id AS VARCHAR),
  CAST(CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) % 300 + CASE WHEN event_id % 17 = 3 THEN 299 ELSE 0 END AS VARCHAR),
  CASE WHEN event_id % 17 = 1 THEN '' ELSE CAST(user_id AS VARCHAR) END,
  CASE WHEN event_id % 17 = 0 THEN 'broken' WHEN event_id % 17 = 4 THEN '-1' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END
  || CASE WHEN event_id % 17 = 2 THEN ',x' ELSE '' END) AS line FROM events)"""
PARSED = LINE + """, p AS (SELECT event_id, line, len(string_split(line, ',')) AS fields, string_split(line, ',')[2] AS epoch_text,
  string_split(line, ',')[3] AS user_text, string_split(line, ',')[4] AS value_text FROM l)"""
REASONS = """ r AS (SELECT event_id, line, list_filter([CASE WHEN fields <> 4 THEN 'FIELD_COUNT' END, CASE WHEN trim(user_text) = '' THEN 'MISSING_USER' END,
  CASE WHEN try_cast(value_text AS DOUBLE) IS NULL THEN 'BAD_VALUE' END, CASE WHEN try_cast(value_text AS DOUBLE) < 0 THEN 'NEGATIVE' END,
  CASE WHEN CAST(epoch_text AS BIGINT) % 300 <> 0 THEN 'OFF_GRID' END], lambda x: x IS NOT NULL) AS why FROM p)"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Raw text with deterministic damage: bad number, missing user, extra field, off-phase time, negative value."""
    at, kind = epoch_of(F.col("ts")), F.col("event_id") % 17
    parts = [
        F.col("event_id").cast("string"),
        (at - at % 300 + F.when(kind == 3, 299).otherwise(0)).cast("string"),
        F.when(kind == 1, "").otherwise(F.col("user_id").cast("string")),
        F.concat(F.when(kind == 0, "broken").when(kind == 4, "-1").otherwise(F.col("value").cast("decimal(18,2)").cast("string")), F.when(kind == 2, ",x").otherwise("")),
    ]
    return _events(spark, sf).select("event_id", F.concat_ws(",", *parts).alias("line"))


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    row = tables.decode_csv(F.col("line"), HEADER.split(",")).alias("row")
    return _lines(spark, sf).select("event_id", "line", F.size(F.split("line", ",")).alias("fields"), row)


def _rules() -> dict:
    value = F.expr("try_cast(row.value AS DOUBLE)")
    return {
        "FIELD_COUNT": F.col("fields") != 4,
        "MISSING_USER": blank(F.col("row.user_id")),
        "BAD_VALUE": ~usable(value),
        "NEGATIVE": value < 0,
        "OFF_GRID": F.expr("try_cast(row.epoch AS BIGINT)") % 300 != 0,
    }


@query(f"WITH {LINE} SELECT count(*) AS lines, CAST(0 AS BIGINT) AS header_lines, CAST(0 AS BIGINT) AS blank_lines FROM l")
def io1_line_stats(spark, sf):
    return tables.line_stats(_lines(spark, sf), HEADER, "line")


@query(f"WITH {PARSED} SELECT event_id, CAST(fields AS BIGINT) AS fields, epoch_text AS epoch, value_text AS value, CAST(fields <> 4 AS BIGINT) AS corrupt FROM p")
def io2_csv_decode(spark, sf):
    r = F.col("row")
    return _parsed(spark, sf).select("event_id", F.col("fields").cast("long").alias("fields"), r["epoch"].alias("epoch"), r["value"].alias("value"), r["_corrupt_record"].isNotNull().cast("long").alias("corrupt"))


@query(f"WITH {PARSED}, {REASONS} SELECT " + ", ".join(f"CAST(sum(CASE WHEN list_contains(why, '{n}') THEN 1 ELSE 0 END) AS BIGINT) AS {n}_rows" for n in ("FIELD_COUNT", "MISSING_USER", "BAD_VALUE", "NEGATIVE", "OFF_GRID")) + " FROM r")
def p1_rule_counts(spark, sf):
    return rules.rule_counts(_parsed(spark, sf), _rules())


@query(f"WITH {PARSED}, {REASONS} SELECT event_id, array_to_string(why, '|') AS reasons FROM r WHERE len(why) > 0")
def p2_reason_array(spark, sf):
    out = _parsed(spark, sf).withColumn("why", rules.reasons(_rules()))
    return out.where(F.size("why") > 0).select("event_id", F.array_join("why", "|").alias("reasons"))


@query(f"WITH {PARSED}, {REASONS} SELECT reason, count(*) AS n FROM (SELECT unnest(why) AS reason FROM r) GROUP BY 1")
def a13_reason_counts(spark, sf):
    return rules.reason_counts(_parsed(spark, sf).withColumn("why", rules.reasons(_rules())), "why")


@query(f"WITH {PARSED}, {REASONS}, e AS (SELECT event_id, unnest(why) AS reason FROM r) SELECT event_id, reason, CAST(row_number() OVER (PARTITION BY reason ORDER BY event_id) AS INTEGER) AS place FROM e QUALIFY place <= 5")
def t3_examples_per_reason(spark, sf):
    return rules.examples(_parsed(spark, sf).withColumn("why", rules.reasons(_rules())), "why", "event_id")


@query(f"WITH {PARSED} SELECT event_id, CASE WHEN CAST(epoch_text AS BIGINT) % 300 = 299 THEN CAST(epoch_text AS BIGINT) + 1 ELSE CAST(epoch_text AS BIGINT) END AS aligned, sha256(line) AS record_hash FROM p")
def p9_phase_align(spark, sf):
    at = F.expr("try_cast(row.epoch AS BIGINT)")
    return _parsed(spark, sf).select("event_id", clean.align_phase(at, 300, 299, 1, F.lit(True)).alias("aligned"), F.sha2("line", 256).alias("record_hash"))


# --- profiles and collisions -------------------------------------------------------------------------------------

E = "CAST(floor(epoch(ts)) AS BIGINT)"
FIVE_KEYS = f"k AS (SELECT event_id, user_id AS entity, {E} - {E} % 300 AS slot, CAST(value AS DECIMAL(18,2)) AS v FROM events)"


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    at = epoch_of(F.col("ts"))
    return _events(spark, sf).select("event_id", F.col("user_id").alias("entity"), (at - at % 300).alias("slot"), F.col("value").cast("decimal(18,2)").alias("v"))


@query(f"SELECT count(*) AS n, count(DISTINCT user_id) AS entities, min({E}) AS first_epoch, max({E}) AS last_epoch, min(value) AS least, max(value) AS most, CAST(sum(CASE WHEN value > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive FROM events")
def a1_profile(spark, sf):
    at = epoch_of(F.col("ts"))
    return _events(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("entities"), F.min(at).alias("first_epoch"), F.max(at).alias("last_epoch"), F.min("value").alias("least"), F.max("value").alias("most"), F.sum((F.col("value") > 0).cast("long")).alias("positive"))


@query()
def a2_percentiles(spark, sf):
    return _events(spark, sf).agg(F.percentile_approx("value", [0.5, 0.95, 0.99], 10_000).alias("p"))


@query("WITH k AS (SELECT user_id, ts, count(*) AS n, count(DISTINCT (event_type, value)) AS m FROM events GROUP BY 1, 2) SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS keys, CAST(sum(n - m) AS BIGINT) AS exact_copies FROM k")
def a1_exact_copies(spark, sf):
    """Rows, keys and rows that repeat another one in every field."""
    out = clean.duplicate_profile(_events(spark, sf).drop("event_id"), ["user_id", "ts"], ["value"], F.lit(True))
    return clean.duplicate_totals(out).select(F.col("rows").alias("n"), F.col("unique_keys").alias("keys"), "exact_copies")


@query("SELECT event_type, hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def a4_freq(spark, sf):
    return _events(spark, sf).groupBy("event_type", F.hour("ts").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FIVE_KEYS} SELECT entity, slot, count(*) AS n, count(DISTINCT v) AS n_values FROM k GROUP BY 1, 2")
def a5_key_profile(spark, sf):
    return clean.key_profile(_keyed(spark, sf), ["entity", "slot"], "v")


@query(f"WITH {FIVE_KEYS}, q AS (SELECT count(*) AS n, count(DISTINCT v) AS m FROM k GROUP BY entity, slot) SELECT count(*) AS unique_keys, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_groups, CAST(sum(n - 1) AS BIGINT) AS excess_rows, CAST(sum(CASE WHEN n > 1 AND m > 1 THEN 1 ELSE 0 END) AS BIGINT) AS conflicting_groups FROM q")
def a6_dup_summary(spark, sf):
    return clean.duplicate_summary(clean.key_profile(_keyed(spark, sf), ["entity", "slot"], "v"))


HOURS = f"r AS (SELECT user_id AS entity, {E} - {E} % 3600 AS slot, event_type AS name, CAST(floor(value / 25) AS INTEGER) AS v FROM events)"
PROFILE = HOURS + ", q AS (SELECT entity, slot, count(*) AS n, count(DISTINCT (name, v)) AS distinct_rows, count(DISTINCT v) AS distinct_readings, CAST(sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS BIGINT) AS candidate_rows FROM r GROUP BY 1, 2)"


def _hours(spark: SparkSession, sf: str) -> DataFrame:
    """The events by hour with rough values, so that keys, readings and whole rows repeat."""
    at = epoch_of(F.col("ts"))
    return _events(spark, sf).select(F.col("user_id").alias("entity"), (at - at % 3_600).alias("slot"), F.col("event_type").alias("name"), F.floor(F.col("value") / 25).cast("int").alias("v"))


@query(f"WITH {PROFILE} SELECT * FROM q")
def a5_duplicate_profile(spark, sf):
    return clean.duplicate_profile(_hours(spark, sf), ["entity", "slot"], ["v"], F.col("v") > 0)


@query(f"WITH {PROFILE} SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS unique_keys, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS shared_keys, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS rows_on_shared_keys, CAST(sum(n - 1) AS BIGINT) AS excess_rows, CAST(sum(n - distinct_rows) AS BIGINT) AS exact_copies, CAST(sum(CASE WHEN distinct_readings > 1 THEN 1 ELSE 0 END) AS BIGINT) AS conflicting_keys, CAST(sum(CASE WHEN candidate_rows > 0 THEN 1 ELSE 0 END) AS BIGINT) AS candidate_keys FROM q")
def a6_duplicate_totals(spark, sf):
    return clean.duplicate_totals(clean.duplicate_profile(_hours(spark, sf), ["entity", "slot"], ["v"], F.col("v") > 0))


@query(f"WITH {HOURS} SELECT entity, name, v, count(*) AS n, min(slot) AS first, max(slot) AS last FROM r GROUP BY 1, 2, 3")
def a7_variant_history(spark, sf):
    """Every variant of an entity's metadata with its rows and first and last epoch."""
    return clean.variant_history(_hours(spark, sf), "entity", ["name", "v"], "slot")


@query(f"WITH {HOURS} SELECT entity, count(*) AS n, min(slot) AS first, max(slot) AS last, count(DISTINCT name) AS name_variants, count(DISTINCT v) AS v_variants FROM r GROUP BY 1")
def a7_variant_counts(spark, sf):
    return clean.variant_counts(clean.variant_history(_hours(spark, sf), "entity", ["name", "v"], "slot"), "entity", ["name", "v"])


@query("SELECT user_id, count(DISTINCT event_type) AS variants, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1")
def a7_variants(spark, sf):
    return _events(spark, sf).groupBy("user_id").agg(F.count_distinct("event_type").alias("variants"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


RESOLVED = f"{FIVE_KEYS}, d AS (SELECT *, row_number() OVER (PARTITION BY entity, slot ORDER BY event_id) AS rk, count(*) OVER (PARTITION BY entity, slot) AS n, min(v) OVER (PARTITION BY entity, slot) IS NOT DISTINCT FROM max(v) OVER (PARTITION BY entity, slot) AS same FROM k), f AS (SELECT event_id, v, CAST(rk AS INTEGER) AS collision_rank, CASE WHEN n = 1 THEN 'unique' WHEN NOT same THEN 'quarantined' WHEN rk = 1 THEN 'kept' ELSE 'merged' END AS disposition FROM d)"


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    return collide.resolve(_keyed(spark, sf), ["entity", "slot"], "v", ["entity"], ["event_id"], "event_id")


@query(f"WITH {RESOLVED} SELECT event_id, collision_rank, disposition FROM f")
def w3_resolve_collisions(spark, sf):
    return _resolved(spark, sf).select("event_id", "collision_rank", "disposition")


@query(f"WITH {RESOLVED} SELECT disposition, count(*) AS n, CAST(sum(v) AS DOUBLE) AS amount FROM f GROUP BY 1")
def a12_amount_ledger(spark, sf):
    out = clean.ledger(_resolved(spark, sf), "v")
    return out.withColumn("amount", F.col("amount").cast("double"))


@query(f"WITH {_slots(300)}, q AS (SELECT slot - lag(slot) OVER (PARTITION BY entity ORDER BY slot) AS gap_s FROM g) SELECT gap_s, count(*) AS n FROM q WHERE gap_s IS NOT NULL GROUP BY 1")
def w1_gaps(spark, sf):
    return clean.gaps(_grid(spark, sf, FIVE), "entity", "slot")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 15")
def t2_topk(spark, sf):
    return _events(spark, sf).select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(15)


# --- windows and features ----------------------------------------------------------------------------------------

TARGETS = _slots(86_400) + f""", t AS (SELECT entity, slot, v, count(v) {_over(1, 2, 86_400)} AS future_n, count(v) {_over(-3, 0, 86_400)} AS history_n, sum(v) {_over(1, 2, 86_400)} AS ahead FROM g),
 a AS (SELECT entity, slot, v, future_n, history_n, CASE WHEN future_n = 2 THEN ahead END AS future_total FROM t)"""


@query(f"WITH {TARGETS} SELECT entity, slot, future_n, history_n, CAST(future_total AS DOUBLE) AS future_total FROM a")
def w5_future_total(spark, sf):
    return windows.targets(_grid(spark, sf, DAY), DAY).select("entity", "slot", "future_n", "history_n", F.col("future_total").cast("double").alias("future_total"))


@query(f"WITH {_slots(21_600)}, t AS (SELECT entity, slot, list(slot) {_over(1, 2, 21_600)} AS seen FROM g) SELECT entity, slot, array_to_string(list_filter([21600, 43200], lambda o: NOT coalesce(list_contains(seen, slot + o), false)), ',') AS missing FROM t")
def w7_missing_offsets(spark, sf):
    grid = _grid(spark, sf, SIX_HOURS)
    return grid.select("entity", "slot", F.array_join(F.array_sort(windows.missing_offsets(grid, SIX_HOURS, 1, 2)).cast("array<string>"), ",").alias("missing"))


@query(f"WITH {TARGETS} SELECT entity, slot, concat_ws('|', CASE WHEN future_n <> 2 THEN 'FUTURE_INCOMPLETE' END, CASE WHEN history_n <> 4 THEN 'HISTORY_INCOMPLETE' END) AS reasons FROM a WHERE future_n <> 2 OR history_n <> 4")
def p2_invalid_reasons(spark, sf):
    out = windows.targets(_grid(spark, sf, DAY), DAY)
    return out.where(F.size("invalid_reason") > 0).select("entity", "slot", F.array_join("invalid_reason", "|").alias("reasons"))


FEATURES = _slots(86_400) + f""", h AS (SELECT entity, slot, CAST(v AS DOUBLE) AS v, count(v) {_over(-1, 0, 86_400)} AS n2, count(v) {_over(-3, 0, 86_400)} AS n4,
 CAST(sum(v) {_over(-1, 0, 86_400)} AS DOUBLE) AS s2, CAST(sum(v) {_over(-3, 0, 86_400)} AS DOUBLE) AS s4, CAST(max(v) {_over(-3, 0, 86_400)} AS DOUBLE) AS m4, stddev_pop(CAST(v AS DOUBLE)) {_over(-3, 0, 86_400)} AS d4,
 sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) {_over(-3, 0, 86_400)} AS w4, CAST(max(v) {_over(-1, -1, 86_400)} AS DOUBLE) AS lag_1,
 max(CASE WHEN v > 0 THEN slot END) {_over(-3, 0, 86_400)} AS ev, max(CASE WHEN v = 0 THEN slot END) {_over(-3, 0, 86_400)} AS st FROM g)"""


@query(f"WITH {FEATURES} SELECT entity, slot, round(CASE WHEN n2 = 2 THEN s2 END, 4) AS sum_2, round(CASE WHEN n4 = 4 THEN s4 END, 4) AS sum_all FROM h")
def w8_rolling(spark, sf):
    return windows.features(_grid(spark, sf, DAY), DAY).select("entity", "slot", F.round("sum_2", 4).alias("sum_2"), F.round("sum_all", 4).alias("sum_all"))


@query(f"WITH {FEATURES} SELECT entity, slot, CASE WHEN n4 = 4 THEN m4 END AS max_all, round(CASE WHEN n4 = 4 THEN d4 END, 4) AS std_all, CAST(CASE WHEN n4 = 4 THEN w4 END AS BIGINT) AS wet_all FROM h")
def w9_max_std(spark, sf):
    return windows.features(_grid(spark, sf, DAY), DAY).select("entity", "slot", "max_all", F.round("std_all", 4).alias("std_all"), "wet_all")


@query(f"WITH {FEATURES} SELECT entity, slot, lag_1, round(v - lag_1, 4) AS change_1 FROM h")
def w10_exact_lag(spark, sf):
    return windows.features(_grid(spark, sf, DAY), DAY).select("entity", "slot", "lag_1", F.round("change_1", 4).alias("change_1"))


@query(f"WITH {FEATURES} SELECT entity, slot, CAST(CASE WHEN n4 = 4 THEN CASE WHEN st IS NULL THEN 4 ELSE (slot - st) // 86400 END END AS BIGINT) AS run_slots, CAST(CASE WHEN n4 = 4 THEN slot - ev END AS BIGINT) AS since_event_s FROM h")
def w12_runs(spark, sf):
    return windows.features(_grid(spark, sf, DAY), DAY).select("entity", "slot", "run_slots", "since_event_s")


@query(f"SELECT event_id, round(sin(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24), 6) AS sin_day, round(cos(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24), 6) AS cos_day FROM events")
def p17_cyclic(spark, sf):
    found = clock_and_season(F.col("ts"))
    return _events(spark, sf).select("event_id", F.round(found["hour_sin"], 6).alias("sin_day"), F.round(found["hour_cos"], 6).alias("cos_day"))


@query("SELECT l_orderkey, l_linenumber, round(sin(2 * pi() * (month(l_shipdate) - 1) / 12), 6) AS month_sin, round(cos(2 * pi() * (month(l_shipdate) - 1) / 12), 6) AS month_cos FROM lineitem")
def p17_month(spark, sf):
    found = clock_and_season(F.to_timestamp("l_shipdate"))
    return spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", *[F.round(found[c], 6).alias(c) for c in ("month_sin", "month_cos")])


# --- folds, samples, labels --------------------------------------------------------------------------------------


def _anchors(spark: SparkSession, sf: str) -> DataFrame:
    out = windows.targets(_grid(spark, sf, DAY), DAY)
    return out.withColumn("role", folds.fold_role(F.col("slot"), F.col("slot") + DAY.future * DAY.step, TRAIN_END, EVAL_END))


ROLE = f"CASE WHEN slot < {TRAIN_END} THEN CASE WHEN slot + 172800 >= {TRAIN_END} THEN 'EXCLUDED_BOUNDARY' ELSE 'TRAIN' END WHEN slot < {EVAL_END} THEN CASE WHEN slot + 172800 >= {EVAL_END} THEN 'EXCLUDED_BOUNDARY' ELSE 'VALIDATION' END ELSE 'UNUSED' END"
LEVELS = "(VALUES (0.0), (50.0), (100.0), (200.0)) AS l(threshold)"
EXPANDED = TARGETS + f", x AS (SELECT entity, slot, v, CAST(threshold AS DOUBLE) AS threshold, CAST(CASE WHEN future_total > threshold THEN 1 WHEN future_total <= threshold THEN 0 END AS DOUBLE) AS label, {ROLE} AS role FROM a, {LEVELS})"


@query(f"WITH {TARGETS} SELECT {ROLE} AS role, count(*) AS anchors, CAST(sum(CASE WHEN future_n = 2 AND history_n = 4 THEN 1 ELSE 0 END) AS BIGINT) AS eligible FROM a GROUP BY 1")
def a18_role_counts(spark, sf):
    return _anchors(spark, sf).groupBy("role").agg(F.count(F.lit(1)).alias("anchors"), F.sum((F.col("target_valid") & F.col("history_valid")).cast("long")).alias("eligible"))


@query(f"WITH {EXPANDED} SELECT entity, slot, threshold, label FROM x")
def m2_expand(spark, sf):
    return folds.expand(_anchors(spark, sf), "future_total", THRESHOLDS).select("entity", "slot", "threshold", "label")


@query(f"WITH {EXPANDED} SELECT threshold, CAST(sum(label) AS BIGINT) AS positives, CAST(sum(1 - label) AS BIGINT) AS negatives FROM x WHERE role = 'TRAIN' GROUP BY 1")
def m4_support(spark, sf):
    out = folds.expand(_anchors(spark, sf).where("role = 'TRAIN'"), "future_total", THRESHOLDS)
    return out.groupBy("threshold").agg(F.sum("label").cast("long").alias("positives"), F.sum(1 - F.col("label")).cast("long").alias("negatives"))


@query(f"WITH {TARGETS} SELECT entity, slot FROM a WHERE entity IN (SELECT entity FROM a GROUP BY 1 HAVING count(*) >= 20)")
def m6_entity_support(spark, sf):
    return folds.supported(_anchors(spark, sf), "entity", 20).select("entity", "slot")


@query(f"WITH {TARGETS} SELECT entity, slot FROM a WHERE (entity * 7919 + slot // 86400 * 104729 + 7) % 10007 < 1000")
def m1_sample(spark, sf):
    return folds.sample(_anchors(spark, sf), {"entity": 1, "slot": 86_400}, 1_000).select("entity", "slot")


@query()
def m8_signature(spark, sf):
    return joins.signature(_anchors(spark, sf), ["role"], ["entity", "slot", "future_total"])


# --- joins -------------------------------------------------------------------------------------------------------


@query(f"WITH {_slots(86_400)}, b AS (SELECT * FROM g WHERE entity % 3 <> 0), c AS (SELECT * FROM g WHERE entity % 5 <> 0) SELECT CAST(sum(CASE WHEN c.slot IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS left_only, CAST(sum(CASE WHEN b.slot IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS right_only, CAST(sum(CASE WHEN b.slot IS NOT NULL AND c.slot IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS joined FROM b FULL JOIN c ON b.entity = c.entity AND b.slot = c.slot")
def j5_reconcile(spark, sf):
    grid = _grid(spark, sf, DAY)
    return joins.reconcile(grid.where("entity % 3 <> 0"), grid.where("entity % 5 <> 0"), ["entity", "slot"])


@query(f"WITH {_slots(86_400)}, f AS (SELECT g.slot AS a, b.slot AS b FROM g FULL JOIN (SELECT entity, slot + 86400 AS slot FROM g) b ON g.entity = b.entity AND g.slot = b.slot) SELECT CAST(sum(CASE WHEN b IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS left_only, CAST(sum(CASE WHEN a IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS right_only, CAST(sum(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS joined FROM f")
def j5_neighbours(spark, sf):
    """The whole grid against itself a day later: slots without the one before, without the one after, and with it."""
    grid = _grid(spark, sf, DAY)
    return joins.reconcile(grid, grid.withColumn("slot", F.col("slot") + DAY.step), ["entity", "slot"])


@query(f"WITH {FIVE_KEYS}, {_slots(300)}, l AS (SELECT entity, slot, count(*) AS n FROM k GROUP BY 1, 2), r AS (SELECT entity, slot, count(*) AS n FROM g GROUP BY 1, 2), b AS (SELECT l.entity AS le, l.slot AS ls, l.n AS ln, r.entity AS re, r.slot AS rs, r.n AS rn FROM l FULL JOIN r ON l.entity = r.entity AND l.slot = r.slot), s AS (SELECT CAST(sum(ln) AS BIGINT) AS left_rows, CAST(sum(rn) AS BIGINT) AS right_rows, CAST(sum(CASE WHEN ln > 1 THEN 1 ELSE 0 END) AS BIGINT) AS left_duplicates, CAST(sum(CASE WHEN rn > 1 THEN 1 ELSE 0 END) AS BIGINT) AS right_duplicates, CAST(sum(CASE WHEN ln > 0 AND (le IS NULL OR ls IS NULL) THEN ln ELSE 0 END) AS BIGINT) AS left_null_keys, CAST(sum(CASE WHEN rn > 0 AND (re IS NULL OR rs IS NULL) THEN rn ELSE 0 END) AS BIGINT) AS right_null_keys, CAST(sum(CASE WHEN ln > 0 AND rn > 0 THEN 1 ELSE 0 END) AS BIGINT) AS matched_keys FROM b) SELECT *, CAST(left_duplicates + right_duplicates + left_null_keys + right_null_keys = 0 AS BIGINT) AS passed FROM s")
def j8_join_audit(spark, sf):
    out = joins.guard_join(_keyed(spark, sf), _grid(spark, sf, FIVE), ["entity", "slot"])
    return out.withColumn("passed", (F.col("verdict") == "PASS").cast("long")).drop("verdict", "left_match_rate", "right_match_rate")


@query(f"WITH {_slots(86_400)}, b AS (SELECT entity, slot, v + CASE WHEN entity % 7 = 0 THEN 1 ELSE 0 END AS w FROM g) SELECT CAST(sum(CASE WHEN g.v IS DISTINCT FROM b.w THEN 1 ELSE 0 END) AS BIGINT) AS unequal, CAST(max(abs(g.v - b.w)) AS DOUBLE) AS max_difference FROM g JOIN b ON g.entity = b.entity AND g.slot = b.slot")
def j6_compare(spark, sf):
    grid = _grid(spark, sf, DAY)
    other = grid.withColumn("v", (F.col("v") + F.when(F.col("entity") % 7 == 0, 1).otherwise(0)).cast("decimal(20,2)"))
    return joins.compare_columns(grid, other, ["entity", "slot"], ["v"]).select("unequal", "max_difference")


@query("WITH n AS (SELECT * FROM nation WHERE n_regionkey IN (1, 3)) SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM n)")
def j3_semi(spark, sf):
    nations = spark.read.parquet(f"{sf}/nation.parquet").where("n_regionkey IN (1, 3)").select(F.col("n_nationkey").alias("s_nationkey"))
    return spark.read.parquet(f"{sf}/supplier.parquet").join(nations, "s_nationkey", "left_semi").select("s_suppkey", "s_nationkey")


# --- coverage ----------------------------------------------------------------------------------------------------

CELLS = """c AS (SELECT entity, CAST(year(m) AS INTEGER) AS year, CAST(month(m) AS INTEGER) AS month, days, total, day(last_day(m)) AS expected, days / day(last_day(m)) AS coverage FROM
 (SELECT l_suppkey AS entity, date_trunc('month', CAST(l_shipdate AS DATE)) AS m, count(DISTINCT CAST(l_shipdate AS DATE)) AS days, sum(l_quantity) AS total FROM lineitem GROUP BY 1, 2))"""
PANEL = CELLS + ", f AS (SELECT month, entity FROM c WHERE year BETWEEN 1996 AND 2000 AND coverage >= 0.10 GROUP BY 1, 2 HAVING count(DISTINCT year) = 5)"


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", F.to_date("l_shipdate").alias("day"), "l_quantity")
    return coverage.month_cells(rows, "l_suppkey", "day", "l_quantity")


@query(f"WITH {CELLS} SELECT entity, year, month, days, round(total, 4) AS total, round(coverage, 6) AS coverage FROM c")
def a14_month(spark, sf):
    return _cells(spark, sf).select("entity", "year", "month", "days", F.round("total", 4).alias("total"), F.round("coverage", 6).alias("coverage"))


@query(f"WITH {CELLS} SELECT e.entity, m.year, m.month, coalesce(c.days, 0) AS days FROM (SELECT DISTINCT entity FROM c) e CROSS JOIN (SELECT DISTINCT year, month FROM c) m LEFT JOIN c ON c.entity = e.entity AND c.year = m.year AND c.month = m.month")
def j13_spine(spark, sf):
    return coverage.spine(_cells(spark, sf))


@query(f"WITH {PANEL} SELECT month, entity FROM f")
def a20_panel(spark, sf):
    return coverage.panel(_cells(spark, sf), 0.10, YEARS)


@query(f"WITH {PANEL} SELECT c.year, c.month, count(*) AS n, round(avg(total / days), 6) AS mean FROM c JOIN f ON c.month = f.month AND c.entity = f.entity WHERE c.year BETWEEN 1996 AND 2000 GROUP BY 1, 2")
def a21_panel_means(spark, sf):
    cells = _cells(spark, sf)
    return coverage.panel_means(cells, coverage.panel(cells, 0.10, YEARS), YEARS).withColumn("mean", F.round("mean", 6))


@query(f"WITH {CELLS}, q AS (SELECT * FROM c WHERE coverage >= 0.10) SELECT a.year, a.month, count(*) AS n, round(avg(b.total / b.days - a.total / a.days), 6) AS delta FROM q a JOIN q b ON a.entity = b.entity AND a.month = b.month AND b.year = a.year + 1 GROUP BY 1, 2")
def a25_paired_years(spark, sf):
    return coverage.paired_years(_cells(spark, sf), 0.10).withColumn("delta", F.round("delta", 6))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS entities FROM events GROUP BY 1")
def a16_daily(spark, sf):
    return _events(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("entities"))


@query("WITH d AS (SELECT user_id AS entity, CAST(ts AS DATE) AS day FROM events) SELECT entity, count(DISTINCT day) AS present, max(day) - min(day) + 1 - count(DISTINCT day) AS absent FROM d GROUP BY 1")
def a16_entity_days(spark, sf):
    """Days with and without rows between the first and the last of each entity."""
    days = _events(spark, sf).select(F.col("user_id").alias("entity"), F.to_date("ts").alias("day")).distinct()
    out = days.groupBy("entity").agg(F.count(F.lit(1)).alias("present"), F.min("day").alias("a"), F.max("day").alias("b"))
    return out.select("entity", "present", (F.datediff("b", "a") + 1 - F.col("present")).alias("absent"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def a28_latest_meta(spark, sf):
    return _events(spark, sf).groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))


# --- distributions and scores ------------------------------------------------------------------------------------

CDF = TARGETS + ", k AS (SELECT entity AS grp, future_total AS value, count(*) AS k FROM a WHERE future_total IS NOT NULL GROUP BY 1, 2), d AS (SELECT grp, value, CAST(sum(k) OVER (PARTITION BY grp ORDER BY value) AS BIGINT) AS cum_n, CAST(sum(k) OVER (PARTITION BY grp) AS BIGINT) AS n FROM k)"
SURVIVAL = CDF + f", s AS (SELECT grp, CAST(threshold AS DOUBLE) AS threshold, max(n) AS n, max(n) - coalesce(max(CASE WHEN value <= threshold THEN cum_n END), 0) AS above FROM d, {LEVELS} GROUP BY 1, 2), o AS (SELECT threshold, sum(above) / sum(n) AS share FROM s GROUP BY 1), w AS (SELECT s.grp, s.threshold, s.n, s.above, (s.above + 50 * o.share) / (s.n + 50) AS p FROM s JOIN o ON s.threshold = o.threshold)"
SCORES = SURVIVAL + ", z AS (SELECT x.entity, x.slot, x.threshold, x.label, w.p FROM (SELECT entity, slot, CAST(threshold AS DOUBLE) AS threshold, CAST(CASE WHEN future_total > threshold THEN 1 ELSE 0 END AS DOUBLE) AS label FROM a, " + LEVELS + " WHERE future_total IS NOT NULL) x JOIN w ON w.grp = x.entity AND w.threshold = x.threshold)"


def _cdf(spark: SparkSession, sf: str) -> DataFrame:
    known = windows.targets(_grid(spark, sf, DAY), DAY).select(F.col("entity").alias("grp"), F.col("future_total").alias("value"))
    return ecdf.fit(known, "grp", "value")


def _known(spark: SparkSession, sf: str, scratch: Scratch) -> DataFrame:
    """Anchors with a known future total, written once: distributions, scores and their evaluation all start from them."""
    return scratch.keep(windows.targets(_grid(spark, sf, DAY), DAY).where("future_total IS NOT NULL").select("entity", "slot", "future_total"))


def _shrunk(spark: SparkSession, sf: str, known: DataFrame | None = None) -> DataFrame:
    scratch = Scratch(spark, "shrunk")
    known = _known(spark, sf, scratch) if known is None else known
    cdf = ecdf.fit(known.select(F.col("entity").alias("grp"), F.col("future_total").alias("value")), "grp", "value")
    found = scratch.keep(ecdf.survival(cdf, "grp", "value", THRESHOLDS))
    return ecdf.shrink(found, found.groupBy("threshold").agg(F.sum("n").alias("n"), F.sum("above").alias("above")), 50)


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    known = _known(spark, sf, Scratch(spark, "scores"))
    p = _shrunk(spark, sf, known).select(F.col("grp").alias("entity"), "threshold", "p")
    return folds.expand(known, "future_total", THRESHOLDS).join(p, ["entity", "threshold"]).select("entity", "slot", "threshold", "label", "p")


@query(f"WITH {CDF} SELECT grp, CAST(value AS DOUBLE) AS value, cum_n, n FROM d")
def m16_ecdf(spark, sf):
    return _cdf(spark, sf).withColumn("value", F.col("value").cast("double"))


@query(f"WITH {SURVIVAL} SELECT grp, threshold, n, above FROM s")
def j12_survival(spark, sf):
    return ecdf.survival(_cdf(spark, sf), "grp", "value", THRESHOLDS)


@query(f"WITH {SURVIVAL} SELECT grp, threshold, round(p, 8) AS p FROM w")
def m17_shrunk(spark, sf):
    return _shrunk(spark, sf).select("grp", "threshold", F.round("p", 8).alias("p"))


@query(f"WITH {SCORES} SELECT entity, slot, threshold, label, round(p, 8) AS p FROM z")
def m18_scores(spark, sf):
    return _scores(spark, sf).withColumn("p", F.round("p", 8))


@query(f"WITH {SCORES} SELECT threshold, count(*) AS n, round(avg(label), 6) AS base_rate, round(avg(p), 6) AS mean_p, round(avg((p - label) * (p - label)), 6) AS brier, round(avg(-(label * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - label) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)))), 6) AS log_loss FROM z GROUP BY 1")
def e2_brier(spark, sf):
    out = ecdf.metrics(_scores(spark, sf), ["threshold"])
    return out.select("threshold", "n", *[F.round(c, 6).alias(c) for c in ("base_rate", "mean_p", "brier", "log_loss")])


BINS = SCORES + ", y AS (SELECT threshold, CAST(least(floor(round(p, 10) * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mean_p, avg(label) AS observed FROM z GROUP BY 1, 2)"


def _bins(spark: SparkSession, sf: str) -> DataFrame:
    return ecdf.calibration(_scores(spark, sf).withColumn("p", F.round("p", 10)))


@query(f"WITH {BINS} SELECT threshold, bin, n, round(mean_p, 6) AS mean_p, round(observed, 6) AS observed FROM y")
def e4_calibration(spark, sf):
    return _bins(spark, sf).select("threshold", "bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("observed", 6).alias("observed"))


@query(f"WITH {BINS} SELECT threshold, round(sum(n * abs(mean_p - observed)) / sum(n), 6) AS ece FROM y GROUP BY 1")
def e5_ece(spark, sf):
    return ecdf.calibration_error(_bins(spark, sf)).withColumn("ece", F.round("ece", 6))


@query(f"WITH {SCORES}, b AS (SELECT threshold, CAST(least(floor(round(p, 10) * 1000), 999) AS INTEGER) AS bin, sum(label) AS pos, sum(1 - label) AS neg FROM z GROUP BY 1, 2), c AS (SELECT *, neg * (sum(pos) OVER (PARTITION BY threshold ORDER BY bin DESC) - pos / 2) AS area FROM b) SELECT threshold, round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(area) / (sum(pos) * sum(neg)) END, 6) AS roc_auc FROM c GROUP BY 1")
def e3_binned_auc(spark, sf):
    return ecdf.areas(_scores(spark, sf).withColumn("p", F.round("p", 10)), ["threshold"]).select("threshold", F.round("roc_area", 6).alias("roc_auc"))


@query(f"WITH {SURVIVAL}, q AS (SELECT p - lag(p) OVER (PARTITION BY grp ORDER BY threshold) AS rise FROM w) SELECT CAST(coalesce(sum(CASE WHEN rise > 1e-12 THEN 1 ELSE 0 END), 0) AS BIGINT) AS violations FROM q")
def w13_monotone(spark, sf):
    rise = F.col("p") - F.lag("p").over(Window.partitionBy("grp").orderBy("threshold"))
    return _shrunk(spark, sf).select(rise.alias("rise")).agg(F.coalesce(F.sum((F.col("rise") > 1e-12).cast("long")), F.lit(0)).alias("violations"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Eligible anchors with past-only features and the exact future total."""
    out = windows.features(windows.targets(_grid(spark, sf, DAY), DAY), DAY)
    return out.where("target_valid AND history_valid").select("entity", "slot", "future_total", "sum_2", "sum_all", "max_all", "std_all", "lag_1", "ratio", "run_slots")
