"""From damaged raw text to clean observations: decode, type, rules, alignment, collisions, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import blank, usable
from ..grid import epoch_of
from ..operators import collide, records, rules
from ..queries import _events
from ..registry import query
from ..sources import observed, tables, text_files
from ..sources.shared import Scratch

NAMES = ["stamp", "updated", "station", "name", "lon", "lat", "value", "unit"]
HEADER = ",".join(NAMES)
STEP, CUT = 300, 1_704_672_000

# The same damage in both languages: `k` picks what is wrong with a line.
_E = "CAST(floor(epoch(ts)) AS BIGINT)"
RAW = f"""raw0 AS (SELECT event_id, event_id % 23 AS k, {_E} - {_E} % 300 + CASE WHEN event_id % 23 = 3 THEN 299 ELSE 0 END AS e,
  CASE event_id % 7 WHEN 1 THEN -60 WHEN 2 THEN 0 WHEN 3 THEN 200 WHEN 4 THEN 1800 WHEN 5 THEN 40000 WHEN 6 THEN CASE WHEN event_id % 2 = 0 THEN 300000 ELSE 700000 END END AS delay,
  user_id, event_type, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS v FROM events),
raw AS (SELECT event_id, k, CASE WHEN k = 11 THEN '{HEADER}' WHEN k = 12 THEN '  ' ELSE concat_ws(',',
  CASE WHEN k = 13 THEN 'soon' ELSE strftime(make_timestamp((e + 28800) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+08:00' END,
  CASE WHEN delay IS NULL THEN 'n/a' ELSE strftime(make_timestamp((e + delay + 28800) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+08:00' END,
  CASE WHEN k = 1 THEN ' ' ELSE 'S' || user_id END, CASE WHEN k = 7 THEN '' ELSE event_type END,
  CASE WHEN k = 14 THEN '200.5' ELSE '103.' || user_id % 10 END, '1.' || user_id % 7,
  CASE k WHEN 0 THEN 'broken' WHEN 4 THEN '-1' WHEN 5 THEN 'NaN' WHEN 6 THEN '2e-1' WHEN 8 THEN '0.123456789012345678' WHEN 9 THEN '0.1234567890123456789' WHEN 15 THEN '' ELSE v END,
  CASE WHEN k = 10 THEN 'inch' ELSE 'mm' END) || CASE WHEN k = 2 THEN ',x' ELSE '' END END AS line FROM raw0)"""
_PARTS = ", ".join(f"string_split(line, ',')[{i}] AS {n}" for i, n in enumerate(NAMES, 1))
PARSED = RAW + f""", cut AS (SELECT event_id, line, len(string_split(line, ',')) AS fields, {_PARTS} FROM raw WHERE line <> '{HEADER}'),
typed AS (SELECT *, CAST(epoch(try_strptime(stamp, '%Y-%m-%dT%H:%M:%S%z')) AS BIGINT) AS epoch, CAST(epoch(try_strptime(updated, '%Y-%m-%dT%H:%M:%S%z')) AS BIGINT) AS update_epoch,
  try_cast(nullif(value, '') AS DOUBLE) AS value_double FROM cut)"""
CHECKS = """, checked AS (SELECT *, list_filter([CASE WHEN fields <> 8 THEN 'FIELD_COUNT' END, CASE WHEN epoch IS NULL THEN 'BAD_TIME' END, CASE WHEN trim(coalesce(station, '')) = '' THEN 'NO_STATION' END,
  CASE WHEN value_double IS NULL OR NOT isfinite(value_double) THEN 'BAD_VALUE' END, CASE WHEN value_double < 0 THEN 'NEGATIVE' END, CASE WHEN unit <> 'mm' THEN 'BAD_UNIT' END,
  CASE WHEN epoch % 300 NOT IN (0, 299) THEN 'OFF_PHASE' END], lambda x: x IS NOT NULL) AS why FROM typed)"""
# decimal texts without exponent only, so the SQL side needs no sign arithmetic beyond the one '2e-1'
ALIGNED = PARSED + CHECKS + f""", aligned AS (SELECT *, CASE WHEN epoch % 300 = 299 AND epoch < {CUT} THEN 1 ELSE 0 END AS shift FROM checked),
good AS (SELECT event_id, station, name, epoch + shift AS slot, shift, sha256(line) AS record_hash, CAST(value_double AS DECIMAL(18,6)) AS v FROM aligned WHERE len(why) = 0)"""
RESOLVED = ALIGNED + """, st AS (SELECT station, slot, count(*) AS n, count(DISTINCT v) AS value_variants, count(DISTINCT coalesce(name, '')) AS metadata_variants FROM good GROUP BY 1, 2 HAVING count(*) > 1),
done AS (SELECT g.event_id, g.v, CAST(row_number() OVER w AS INTEGER) AS collision_rank, first_value(g.event_id) OVER w AS retained_id, coalesce(metadata_variants, 1) AS metadata_variants,
  CASE WHEN n IS NULL THEN 'unique' WHEN value_variants > 1 THEN 'quarantined' WHEN row_number() OVER w = 1 THEN 'kept' ELSE 'merged' END AS disposition
  FROM good g LEFT JOIN st USING (station, slot) WINDOW w AS (PARTITION BY station, slot ORDER BY shift, record_hash, event_id))"""


def raw_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, line): the events as damaged text, with repeated headers and blank lines."""
    at, k = epoch_of(F.col("ts")), F.col("event_id") % 23
    e = at - at % STEP + F.when(k == 3, 299).otherwise(0)
    w = F.col("event_id") % 7
    delay = F.when(w == 1, -60).when(w == 2, 0).when(w == 3, 200).when(w == 4, 1800).when(w == 5, 40_000).when(w == 6, F.when(F.col("event_id") % 2 == 0, 300_000).otherwise(700_000))

    def iso(seconds):
        return F.concat(F.date_format(F.timestamp_seconds(seconds + 28_800), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))

    value = F.col("value").cast("decimal(18,2)").cast("string")
    for kind, text in {0: "broken", 4: "-1", 5: "NaN", 6: "2e-1", 8: "0.123456789012345678", 9: "0.1234567890123456789", 15: ""}.items():
        value = F.when(k == kind, text).otherwise(value)
    parts = [
        F.when(k == 13, "soon").otherwise(iso(e)), F.when(delay.isNull(), "n/a").otherwise(iso(e + delay)), F.when(k == 1, " ").otherwise(F.concat(F.lit("S"), F.col("user_id"))),
        F.when(k == 7, "").otherwise(F.col("event_type")), F.when(k == 14, "200.5").otherwise(F.concat(F.lit("103."), F.col("user_id") % 10)), F.concat(F.lit("1."), F.col("user_id") % 7),
        value, F.when(k == 10, "inch").otherwise("mm"),
    ]
    line = F.concat(F.concat_ws(",", *parts), F.when(k == 2, ",x").otherwise(""))
    return _events(spark, sf).select("event_id", F.when(k == 11, HEADER).when(k == 12, "  ").otherwise(line).alias("line"))


def decoded(spark: SparkSession, sf: str) -> DataFrame:
    lines = raw_lines(spark, sf).where(F.col("line") != HEADER)
    row = tables.decode_csv(F.col("line"), NAMES)
    out = lines.select("event_id", "line", F.size(F.split("line", ",")).alias("fields"), row.alias("r")).select("event_id", "line", "fields", "r.*")
    return records.typed(out, timestamp="stamp", update="updated", value="value")


def checks() -> dict:
    value = F.col("value_double")
    return {
        "FIELD_COUNT": F.col("fields") != len(NAMES), "BAD_TIME": F.col("epoch").isNull(), "NO_STATION": blank(F.col("station")), "BAD_VALUE": ~usable(value),
        "NEGATIVE": value < 0, "BAD_UNIT": F.col("unit") != "mm", "OFF_PHASE": ~F.pmod("epoch", F.lit(STEP)).isin(0, STEP - 1),
    }


def aligned(spark: SparkSession, sf: str) -> DataFrame:
    out = decoded(spark, sf).withColumn("why", rules.reasons(checks()))
    return records.align(out, "epoch", STEP, STEP - 1, 1, F.col("epoch") < CUT, "EARLY_END_OF_INTERVAL")


def good(spark: SparkSession, sf: str) -> DataFrame:
    kept, _ = records.split_valid(aligned(spark, sf), "why")
    return kept.select("event_id", "station", F.coalesce("name", F.lit("")).alias("name"), F.col("aligned").alias("slot"), F.col("align_offset_s").alias("shift"), F.sha2("line", 256).alias("record_hash"), F.col("value_double").cast("decimal(18,6)").alias("v"))


def resolved(spark: SparkSession, sf: str) -> DataFrame:
    return collide.resolve(good(spark, sf), ["station", "slot"], "v", ["name"], ["shift", "record_hash", "event_id"], "event_id")


@query(f"WITH {RAW} SELECT count(*) AS lines, CAST(sum(CASE WHEN line = '{HEADER}' THEN 1 ELSE 0 END) AS BIGINT) AS header_lines, CAST(sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) AS BIGINT) AS blank_lines FROM raw")
def io1_header_control(spark, sf):
    return tables.line_stats(raw_lines(spark, sf), HEADER, "line")


RECORD_NAMES = ["id", "name", "value"]


def _record_files(spark: SparkSession, sf: str) -> str:
    """The events as text files with quoted commas, quoted line ends, doubled and broken quotes, headers in between and blank lines."""
    k, event = F.col("event_id") % 100, F.col("event_id").cast("string")
    name = F.when(k == 3, F.concat(F.lit('"x,'), event, F.lit('"'))).when(k == 20, '"two\nlines"').when(k == 60, '"broken').when(k == 80, '"say ""hi"""').otherwise(F.col("event_type"))
    before = F.when(k == 40, ",".join(RECORD_NAMES) + "\n").when(k == 41, "  \n").otherwise("")
    text = F.concat(before, F.concat_ws(",", event, name, F.col("value").cast("decimal(18,2)").cast("string")))
    path = Scratch(spark, "records").path()
    _events(spark, sf).repartitionByRange(6, "event_id").sortWithinPartitions("event_id").select(text.alias("value")).write.text(path)
    return path


@query("SELECT event_id, CASE event_id % 100 WHEN 3 THEN 'x,' || event_id WHEN 20 THEN 'two' || chr(10) || 'lines' WHEN 60 THEN NULL WHEN 80 THEN 'say \"hi\"' ELSE event_type END AS name, CASE WHEN event_id % 100 <> 60 THEN CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS value, CAST(CASE WHEN event_id % 100 = 20 THEN 2 ELSE 1 END AS BIGINT) AS n_lines, CAST(event_id % 100 = 60 AS BIGINT) AS odd_quote FROM events")
def io2_file_records(spark, sf):
    """Records of written text files, some of which span lines; a record with a broken quote keeps its number and its flag alone."""
    out = text_files.read_records(spark, _record_files(spark, sf), ",".join(RECORD_NAMES), RECORD_NAMES, Scratch(spark, "lines"))
    good = ~F.col("odd_quote")
    number = F.element_at(F.split("record", ","), 1).cast("long")
    return out.select(number.alias("event_id"), F.when(good, F.col("row.name")).alias("name"), F.when(good, F.col("row.value")).alias("value"), "n_lines", F.col("odd_quote").cast("long").alias("odd_quote"))


@query("SELECT count(*) + CAST(sum(CASE WHEN event_id % 100 IN (20, 40, 41) THEN 1 ELSE 0 END) AS BIGINT) AS lines, CAST(sum(CASE WHEN event_id % 100 = 40 THEN 1 ELSE 0 END) AS BIGINT) AS header_lines, CAST(sum(CASE WHEN event_id % 100 = 41 THEN 1 ELSE 0 END) AS BIGINT) AS blank_lines FROM events")
def io1_file_lines(spark, sf):
    """Lines, repeated headers and blank lines of written text files."""
    return tables.line_stats(spark.read.text(_record_files(spark, sf)), ",".join(RECORD_NAMES))


@query(f"WITH {PARSED} SELECT event_id, epoch, update_epoch, CASE WHEN isfinite(value_double) THEN round(value_double, 9) END AS value_double, round(CAST(CASE WHEN isfinite(value_double) THEN try_cast(value AS DECIMAL(38,18)) END AS DOUBLE), 9) AS value_exact FROM typed")
def p8_typed(spark, sf):
    number = F.when(usable(F.col("value_double")), F.col("value_double"))
    return decoded(spark, sf).select("event_id", "epoch", "update_epoch", F.round(number, 9).alias("value_double"), F.round(F.col("value_exact").cast("double"), 9).alias("value_exact"))


@query(f"""WITH {PARSED}, d AS (SELECT event_id, value, CASE WHEN value LIKE '%e%' THEN 1 ELSE len(rtrim(split_part(value, '.', 2), '0')) END AS scale,
  CASE WHEN value LIKE '%e%' THEN 0 ELSE len(ltrim(ltrim(split_part(value, '.', 1), '-'), '0')) END AS integer_digits, CASE WHEN value LIKE '%e%' THEN -1 ELSE 0 END AS exponent FROM typed WHERE regexp_matches(value, '^-?[0-9.]+(e-1)?$'))
  SELECT event_id, CAST(scale AS INTEGER) AS scale, CAST(integer_digits AS INTEGER) AS integer_digits, CAST(exponent AS INTEGER) AS exponent, CAST(scale <= 18 AND integer_digits <= 20 AS BIGINT) AS fits FROM d""")
def p7_decimal_guard(spark, sf):
    out = decoded(spark, sf).withColumns(records.decimal_shape(F.col("value")))
    return out.where("fits IS NOT NULL").select("event_id", "scale", "integer_digits", "exponent", F.col("fits").cast("long").alias("fits"))


@query(f"WITH {PARSED}{CHECKS} SELECT CASE WHEN len(why) = 0 THEN 'valid' ELSE 'quarantined' END AS part, count(*) AS n, CAST(sum(len(why)) AS BIGINT) AS reasons FROM checked GROUP BY 1")
def p3_split(spark, sf):
    parts = zip(("valid", "quarantined"), records.split_valid(aligned(spark, sf), "why"))
    valid, bad = (df.select(F.lit(name).alias("part"), "why") for name, df in parts)
    return valid.unionByName(bad).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("why")).cast("long").alias("reasons"))


@query(f"""WITH {PARSED}, l AS (SELECT event_id, fields = 8 AS a, epoch IS NOT NULL AND trim(coalesce(station, '')) <> '' AS b, value_double IS NOT NULL AND isfinite(value_double) AND value_double >= 0 AND unit = 'mm' AS c FROM typed)
  SELECT event_id, CAST(a AS BIGINT) AS structural, CAST(a AND b AS BIGINT) AS key_eligible, CAST(coalesce(a AND b AND c, false) AS BIGINT) AS candidate_valid FROM l""")
def p5_layers(spark, sf):
    value = F.col("value_double")
    out = records.layers(decoded(spark, sf), F.col("fields") == len(NAMES), F.col("epoch").isNotNull() & ~blank(F.col("station")), usable(value) & (value >= 0) & (F.col("unit") == "mm"))
    return out.select("event_id", *[F.col(c).cast("long").alias(c) for c in ("structural", "key_eligible", "candidate_valid")])


@query(f"WITH {PARSED} SELECT event_id, CAST(trim(coalesce(name, '')) = '' OR NOT coalesce(try_cast(lon AS DOUBLE) BETWEEN -180 AND 180 AND try_cast(lat AS DOUBLE) BETWEEN -90 AND 90, false) OR update_epoch IS NULL AS BIGINT) AS warned FROM typed")
def p6_soft_warning(spark, sf):
    c = F.col
    return decoded(spark, sf).select("event_id", records.soft_warning(c("name"), c("lon"), c("lat"), c("update_epoch")).cast("long").alias("warned"))


@query(f"WITH {ALIGNED} SELECT event_id, epoch + shift AS aligned, CAST(shift AS BIGINT) AS align_offset_s, CASE WHEN shift = 1 THEN 'EARLY_END_OF_INTERVAL' END AS align_rule FROM aligned")
def p9_align_rule(spark, sf):
    return aligned(spark, sf).select("event_id", "aligned", "align_offset_s", "align_rule")


@query(f"""WITH {PARSED} SELECT event_id, epoch - 300 AS period_start, CAST(make_timestamp(epoch * 1000000) AS DATE) AS observation_date, CAST(make_timestamp((epoch - 300) * 1000000) AS DATE) AS period_date,
  CAST(hour(make_timestamp((epoch - 300) * 1000000)) AS INTEGER) AS period_hour, CAST(year(make_timestamp((epoch - 300) * 1000000)) AS INTEGER) AS year, CAST(month(make_timestamp((epoch - 300) * 1000000)) AS INTEGER) AS month FROM typed WHERE epoch IS NOT NULL""")
def p10_interval_calendar(spark, sf):
    found = records.interval_calendar(F.col("epoch"), STEP)
    return decoded(spark, sf).where("epoch IS NOT NULL").select("event_id", *[c.alias(n) for n, c in found.items()])


@query(f"WITH {PARSED} SELECT event_id, station AS raw_station, nullif(value, '') AS raw_value, 'events' AS source_file, sha256('events') AS source_hash, sha256(line) AS record_hash FROM typed")
def p11_lineage(spark, sf):
    out = records.lineage(decoded(spark, sf), ["station", "value"], "line", "events", F.sha2(F.lit("events"), 256))
    return out.select("event_id", "raw_station", "raw_value", "source_file", "source_hash", "record_hash")


@query(f"""WITH {PARSED}, d AS (SELECT update_epoch - epoch AS d FROM typed) SELECT CASE WHEN d IS NULL THEN 'UNKNOWN' WHEN d < 0 THEN 'NEGATIVE' WHEN d = 0 THEN 'ZERO' WHEN d <= 300 THEN 'UP_TO_5_MIN' WHEN d <= 3600 THEN 'UP_TO_1_H'
  WHEN d <= 86400 THEN 'UP_TO_1_D' WHEN d <= 604800 THEN 'UP_TO_7_D' ELSE 'OVER_7_D' END AS delay_class, count(*) AS n, min(d) AS least, max(d) AS most FROM d GROUP BY 1""")
def p12_delay_class(spark, sf):
    d = F.col("update_epoch") - F.col("epoch")
    return decoded(spark, sf).select(d.alias("d")).groupBy(records.delay_class(F.col("d")).alias("delay_class")).agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("least"), F.max("d").alias("most"))


@query(f"WITH {RESOLVED} SELECT station, slot, n, value_variants, metadata_variants FROM st")
def a9_collision_stats(spark, sf):
    return collide.collision_stats(good(spark, sf), ["station", "slot"], "v", ["name"])


@query(f"WITH {RESOLVED} SELECT event_id, collision_rank, retained_id, metadata_variants, disposition FROM done")
def w4_retained(spark, sf):
    return resolved(spark, sf).select("event_id", "collision_rank", "retained_id", "metadata_variants", "disposition")


@query(f"WITH {RESOLVED} SELECT g.event_id, st.n FROM good g JOIN st USING (station, slot)")
def j1_collision_rows(spark, sf):
    rows = good(spark, sf)
    return rows.join(collide.collision_stats(rows, ["station", "slot"], "v", ["name"]), ["station", "slot"]).select("event_id", "n")


@query(f"WITH {RESOLVED} SELECT g.event_id FROM good g ANTI JOIN st USING (station, slot)")
def j2_unmatched_rows(spark, sf):
    rows = good(spark, sf)
    return rows.join(collide.collision_stats(rows, ["station", "slot"], "v", ["name"]), ["station", "slot"], "left_anti").select("event_id")


@query(f"""WITH {RESOLVED}, q AS (SELECT event_id, 'RULES' AS cause FROM aligned WHERE len(why) > 0 UNION ALL SELECT event_id, 'VALUE_CONFLICT' FROM done WHERE disposition = 'quarantined') SELECT event_id, cause FROM q""")
def u1_quarantine(spark, sf):
    """Rows refused by the rules and rows in conflict, as one table."""
    _, bad = records.split_valid(aligned(spark, sf), "why")
    clash = resolved(spark, sf).where("disposition = 'quarantined'")
    return bad.select("event_id", F.lit("RULES").alias("cause")).unionByName(clash.select(F.lit("VALUE_CONFLICT").alias("cause"), "event_id"))


_SUMS = [f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT) AS {n}_rows, CAST(coalesce(sum(CASE WHEN {c} THEN v END), 0) AS DOUBLE) AS {n}_amount" for n, c in (("raw", "true"), ("kept", "disposition IN ('unique', 'kept')"), ("merged", "disposition = 'merged'"), ("quarantined", "disposition = 'quarantined'"))]


@query(f"WITH {RESOLVED}, t AS (SELECT {', '.join(_SUMS)} FROM done) SELECT *, CAST(raw_rows = kept_rows + merged_rows + quarantined_rows AS BIGINT) AS rows_balance, CAST(abs(raw_amount - kept_amount - merged_amount - quarantined_amount) < 1e-6 AS BIGINT) AS amount_balance FROM t")
def a11_ledger(spark, sf):
    out = collide.balance(resolved(spark, sf), F.col("v").cast("decimal(28,6)"))
    return out.withColumns({c: F.col(c).cast("double") for c in out.columns if c.endswith("_amount")})


@query(f"""WITH {RESOLVED} SELECT CAST(sum(CASE WHEN slot % 300 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS off_grid_rows, CAST(sum(CASE WHEN shift = 1 AND slot - 1 >= {CUT} THEN 1 ELSE 0 END) AS BIGINT) AS bad_alignment_rows, CAST(sum(CASE WHEN v < 0 THEN 1 ELSE 0 END) AS BIGINT) AS invalid_kept_rows,
  CAST(sum(CASE WHEN year(make_timestamp((slot - 300) * 1000000)) <> year(make_timestamp(slot * 1000000)) THEN 1 ELSE 0 END) AS BIGINT) AS period_in_other_year_rows, count(*) AS n FROM good""")
def a10_invariants(spark, sf):
    slot = F.col("slot")
    found = {"off_grid": slot % STEP != 0, "bad_alignment": (F.col("shift") == 1) & (slot - 1 >= CUT), "invalid_kept": F.col("v") < 0, "period_in_other_year": F.year(F.timestamp_seconds(slot - STEP)) != F.year(F.timestamp_seconds(slot))}
    return good(spark, sf).agg(*[F.sum(c.cast("long")).alias(f"{n}_rows") for n, c in found.items()], F.count(F.lit(1)).alias("n"))


@query(f"WITH {RESOLVED}, t AS (SELECT {', '.join(_SUMS)} FROM done) SELECT *, CAST(raw_rows = kept_rows + merged_rows + quarantined_rows AS BIGINT) AS rows_balance, CAST(abs(raw_amount - kept_amount - merged_amount - quarantined_amount) < 1e-6 AS BIGINT) AS amount_balance FROM t")
def a11_written_ledger(spark, sf):
    """The ledger of the observations and the refused ones, taken by the job that writes them."""
    measures = collide.balance_measures(F.col("v").cast("decimal(28,6)"))
    row = observed.write_observed(resolved(spark, sf), Scratch(spark, "ledger").path(), measures, ["disposition"])
    out = collide.with_balance(row)
    return out.withColumns({c: F.col(c).cast("double") for c in out.columns if c.endswith("_amount")})


@query(f"""WITH {RESOLVED} SELECT count(*) AS n, CAST(sum(CASE WHEN slot % 300 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS off_grid_rows, CAST(sum(CASE WHEN done.v < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_rows,
  CAST(sum(CASE WHEN year(make_timestamp((slot - 300) * 1000000)) <> year(make_timestamp(slot * 1000000)) THEN 1 ELSE 0 END) AS BIGINT) AS period_in_other_year_rows FROM good JOIN done USING (event_id) WHERE disposition IN ('unique', 'kept')""")
def a10_written_invariants(spark, sf):
    """Invariants of the kept observations, counted by the job that writes them in folders of months."""
    slot = F.col("slot")
    rows = resolved(spark, sf).where("disposition IN ('unique', 'kept')").withColumn("month", F.trunc(F.timestamp_seconds("slot"), "month"))
    checks = {"off_grid": slot % STEP == 0, "negative": F.col("v") >= 0, "period_in_other_year": F.year(F.timestamp_seconds(slot - STEP)) == F.year(F.timestamp_seconds(slot))}
    return observed.written_rows(rows, Scratch(spark, "kept").path(), ["month"], checks)


@query(f"""WITH {ALIGNED}, w AS (SELECT station, epoch, coalesce(name, '') AS name, value_double AS v, CASE WHEN epoch % 300 = 299 THEN epoch + 1 ELSE epoch END AS moved FROM aligned WHERE len(why) = 0),
  k AS (SELECT station, moved, count(*) AS n, count(DISTINCT v) AS vs, count(DISTINCT name) AS ms, sum(CASE WHEN CAST(make_timestamp(epoch * 1000000) AS DATE) <> CAST(make_timestamp(moved * 1000000) AS DATE) THEN 1 ELSE 0 END) AS d FROM w GROUP BY 1, 2)
, b AS (SELECT count(*) AS crowded FROM (SELECT 1 FROM w GROUP BY station, epoch HAVING count(*) > 1))
  SELECT count(*) AS keys, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS collision_groups, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) - (SELECT crowded FROM b) AS BIGINT) AS added_groups, CAST(sum(n - 1) AS BIGINT) AS excess_rows, CAST(sum(CASE WHEN n > 1 AND vs > 1 THEN 1 ELSE 0 END) AS BIGINT) AS value_conflicts,
  CAST(sum(CASE WHEN n > 1 AND ms > 1 THEN 1 ELSE 0 END) AS BIGINT) AS metadata_conflicts, CAST(sum(d) AS BIGINT) AS date_changes, CAST(sum(n) AS BIGINT) AS rows_keep_all, count(*) AS rows_keep_first, CAST(sum(CASE WHEN vs > 1 THEN 0 ELSE 1 END) AS BIGINT) AS rows_drop_conflicts FROM k""")
def a33_align_whatif(spark, sf):
    kept, _ = records.split_valid(aligned(spark, sf), "why")
    rows = kept.select("station", "epoch", F.coalesce("name", F.lit("")).alias("name"), F.col("value_double").alias("v"))
    rows = rows.withColumn("moved", F.col("epoch") + (F.col("epoch") % STEP == STEP - 1).cast("int"))
    day = [F.to_date(F.timestamp_seconds(c)) for c in ("epoch", "moved")]
    return collide.what_if(rows, "station", "epoch", "moved", "v", ["name"], *day)
