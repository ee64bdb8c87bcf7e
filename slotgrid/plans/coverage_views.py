"""Coverage of entities and months, and comparisons that need support."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..grid import epoch_of
from ..operators import coverage, quantiles, separation
from ..queries import CELLS, FIVE, PANEL, YEARS, _cells, _events, _grid, _slots
from ..registry import query
from ..sources.shared import Scratch

E = "CAST(floor(epoch(ts)) AS BIGINT)"
LINES = "d AS (SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS day, l_quantity AS q FROM lineitem)"


def _lines(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_suppkey").alias("entity"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("q"))


@query(f"""WITH k AS (SELECT user_id AS entity, date_trunc('month', ts) AS m, {E} - {E} % 60 AS sec, count(*) AS k FROM events GROUP BY 1, 2, 3)
 SELECT entity, CAST(month(m) AS INTEGER) AS month, CAST(sum(k) AS BIGINT) AS n, count(*) AS stamps, count(DISTINCT sec // 300) AS occupied, count(DISTINCT sec % 300) AS phases, CAST(sum(CASE WHEN sec % 300 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS off_grid,
 count(*) - count(DISTINCT sec // 300) AS slot_collisions, CAST(any_value(day(last_day(m))) * 288 AS BIGINT) AS expected, max(sec) // 300 - min(sec) // 300 + 1 AS span_slots FROM k GROUP BY 1, m""")
def a8_coverage(spark, sf):
    at = epoch_of(F.col("ts"))
    stamps = _events(spark, sf).select("user_id", (at - at % 60).alias("at"))
    out = coverage.slot_coverage(stamps, "user_id", "at", 300)
    return out.select("entity", F.month("month_start").alias("month"), "n", "stamps", "occupied", "phases", "off_grid", "slot_collisions", "expected", "span_slots")


@query("SELECT user_id AS entity, event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events WHERE value > 10 GROUP BY 1, 2")
def a3_group_quantiles(spark, sf):
    """Quantiles of the values above a floor, exact; groups with none are absent."""
    v = F.when(F.col("value") > 10, F.col("value"))
    out = _events(spark, sf).groupBy(F.col("user_id").alias("entity"), "event_type").agg(F.count(v).alias("n"), F.percentile(v, F.array(F.lit(0.5), F.lit(0.95))).alias("p"))
    return out.where("n > 0").select("entity", "event_type", "n", F.round(F.col("p")[0], 6).alias("p50"), F.round(F.col("p")[1], 6).alias("p95"))


@query(f"WITH {LINES} SELECT entity, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month, count(DISTINCT day) AS days, round(sum(q), 4) AS total, CAST(sum(CASE WHEN q > 40 THEN 1 ELSE 0 END) AS BIGINT) AS wet, max(q) AS most, round(avg(CASE WHEN q > 40 THEN 1.0 ELSE 0.0 END), 6) AS wet_fraction, round(avg(q), 6) AS mean FROM d GROUP BY 1, 2, 3")
def a14_month_totals(spark, sf):
    out = _lines(spark, sf).groupBy("entity", F.year("day").alias("year"), F.month("day").alias("month"))
    wet = (F.col("q") > 40).cast("long")
    return out.agg(F.count_distinct("day").alias("days"), F.round(F.sum("q"), 4).alias("total"), F.sum(wet).alias("wet"), F.max("q").alias("most"), F.round(F.avg(wet), 6).alias("wet_fraction"), F.round(F.avg("q"), 6).alias("mean"))


@query("SELECT user_id AS entity, CAST(month(ts) AS INTEGER) AS month, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def a15_hour(spark, sf):
    out = _events(spark, sf).groupBy(F.col("user_id").alias("entity"), F.month("ts").alias("month"), F.hour("ts").alias("hour"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("WITH d AS (SELECT CAST(ts AS DATE) AS day, user_id FROM events WHERE event_type = 'error'), s AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS DATE) AS day) SELECT s.day, count(user_id) AS n, count(DISTINCT user_id) AS entities, CAST(count(user_id) = 0 AS BIGINT) AS absent FROM s LEFT JOIN d ON s.day = d.day GROUP BY 1")
def a16_absent_days(spark, sf):
    """Every date from the first to the last one with an error, those without any as well."""
    rows = _events(spark, sf).where("event_type = 'error'").select(F.to_date("ts").alias("day"), "user_id")
    days = rows.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(rows, "day", "left").groupBy("day").agg(F.count("user_id").alias("n"), F.count_distinct("user_id").alias("entities"), (F.count("user_id") == 0).cast("long").alias("absent"))


@query(f"WITH {_slots(300)} SELECT entity, CAST(year(make_timestamp((slot - 300) * 1000000)) AS INTEGER) AS year, CAST(month(make_timestamp((slot - 300) * 1000000)) AS INTEGER) AS month, count(*) AS slots, round(CAST(sum(v) AS DOUBLE), 4) AS total, CAST(sum(CASE WHEN month(make_timestamp((slot - 300) * 1000000)) <> month(make_timestamp(slot * 1000000)) THEN 1 ELSE 0 END) AS BIGINT) AS from_next_file FROM g GROUP BY 1, 2, 3")
def a17_period(spark, sf):
    """Contributions by the month in which an interval starts, though its row may lie in the next month's file."""
    start, end = F.timestamp_seconds(F.col("slot") - 300), F.timestamp_seconds("slot")
    out = _grid(spark, sf, FIVE).groupBy("entity", F.year(start).alias("year"), F.month(start).alias("month"))
    return out.agg(F.count(F.lit(1)).alias("slots"), F.round(F.sum("v").cast("double"), 4).alias("total"), F.sum((F.month(start) != F.month(end)).cast("long")).alias("from_next_file"))


@query(f"WITH {CELLS}, s AS (SELECT cutoff, month, entity, count(DISTINCT year) AS y FROM c, (VALUES (0.05), (0.10), (0.15), (0.20)) AS t(cutoff) WHERE year BETWEEN 1996 AND 2000 AND coverage >= cutoff GROUP BY 1, 2, 3) SELECT CAST(cutoff AS DOUBLE) AS cutoff, month, count(*) AS entities FROM s WHERE y = 5 GROUP BY 1, 2")
def a20_panel_support(spark, sf):
    """How many entities a panel has at several cutoffs; one pass over the cells serves all."""
    good = _cells(spark, sf).where(F.col("year").isin(YEARS)).withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in (0.05, 0.10, 0.15, 0.20)]))).where(F.col("coverage") >= F.col("cutoff"))
    held = good.groupBy("cutoff", "month", "entity").agg(F.count_distinct("year").alias("y")).where(F.col("y") == len(YEARS))
    return held.groupBy("cutoff", "month").agg(F.count(F.lit(1)).alias("entities"))


@query(f"WITH {CELLS} SELECT CAST(cutoff AS DOUBLE) AS cutoff, entity FROM c, (VALUES (0.03), (0.05), (0.10)) AS t(cutoff) WHERE year BETWEEN 1996 AND 2000 AND coverage >= cutoff GROUP BY 1, 2 HAVING count(*) = 60")
def a20_all_months(spark, sf):
    return coverage.all_months(_cells(spark, sf), [0.03, 0.05, 0.10], YEARS)


@query(f"WITH {PANEL} SELECT c.year, c.month, count(*) AS n, round(avg(total / days), 6) AS varying_mean, count(f.entity) AS fixed_n, round(avg(CASE WHEN f.entity IS NOT NULL THEN total / days END), 6) AS fixed_mean FROM c LEFT JOIN f ON c.month = f.month AND c.entity = f.entity WHERE c.year BETWEEN 1996 AND 2000 AND coverage >= 0.10 GROUP BY 1, 2")
def a21_varying_panel(spark, sf):
    """Means of the varying panel beside those of the fixed one; membership is a window over an entity's own months."""
    good = _cells(spark, sf).where(F.col("year").isin(YEARS) & (F.col("coverage") >= 0.10))
    own = good.groupBy("month", "entity").agg(F.count(F.lit(1)).alias("y"))
    rows = good.join(own, ["month", "entity"]).withColumn("mean", F.col("total") / F.col("days"))
    fixed = F.col("y") == len(YEARS)
    return rows.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("mean"), 6).alias("varying_mean"), F.sum(fixed.cast("long")).alias("fixed_n"), F.round(F.avg(F.when(fixed, F.col("mean"))), 6).alias("fixed_mean"))


@query("WITH c AS (SELECT user_id AS entity, CAST(hour(ts) AS INTEGER) AS hour, count(DISTINCT CAST(ts AS DATE)) AS days, avg(value) AS mean FROM events GROUP BY 1, 2), w AS (SELECT entity FROM c WHERE days >= 1 GROUP BY 1 HAVING count(*) = 24) SELECT hour, count(*) AS entities, round(avg(mean), 6) AS mean FROM c WHERE entity IN (SELECT entity FROM w) GROUP BY 1")
def a22_hour_panel(spark, sf):
    rows = _events(spark, sf).select(F.col("user_id").alias("entity"), epoch_of(F.col("ts")).alias("at"), "value")
    return coverage.hour_panel(rows, "entity", "at", "value", 24, 1).withColumn("mean", F.round("mean", 6))


@query(f"WITH {CELLS}, f AS (SELECT entity FROM c WHERE year BETWEEN 1996 AND 2000 AND coverage >= 0.05 GROUP BY 1 HAVING count(*) = 60), t AS (SELECT entity, year, sum(total) AS total FROM c WHERE year BETWEEN 1996 AND 2000 GROUP BY 1, 2) SELECT year, count(*) AS entities, round(avg(total), 4) AS mean_total, count(f.entity) AS fixed_entities, round(avg(CASE WHEN f.entity IS NOT NULL THEN total END), 4) AS fixed_mean FROM t LEFT JOIN f ON t.entity = f.entity GROUP BY 1")
def a23_annual(spark, sf):
    out = coverage.annual(_cells(spark, sf), YEARS, 0.05)
    return out.select("year", "entities", F.round("mean_total", 4).alias("mean_total"), "fixed_entities", F.round("fixed_mean", 4).alias("fixed_mean"))


QUANTILES = [0.05, 0.5, 0.95, 0.99]


@query("SELECT event_type, unnest(CAST([0.05, 0.5, 0.95, 0.99] AS DOUBLE[])) AS quantile, count(*) AS n, round(unnest(quantile_cont(value, [0.05, 0.5, 0.95, 0.99])), 6) AS value FROM events GROUP BY 1")
def a3_selected_quantiles(spark, sf):
    """Exact quantiles of few large groups by distributed selection."""
    out = quantiles.exact(_events(spark, sf), ["event_type"], "value", QUANTILES, few=256)
    return out.select("event_type", "quantile", "n", F.round("value", 6).alias("value"))


@query("SELECT event_type, unnest(CAST([0.05, 0.5, 0.95, 0.99] AS DOUBLE[])) AS quantile, count(*) AS n, CAST(1 AS BIGINT) AS close FROM events GROUP BY 1")
def a2_sketch_quantiles(spark, sf):
    """Quantiles from sketches stored per day and merged afterwards, each with whether its measured rank is within a hundredth of what was asked."""
    days = quantiles.sketches(_events(spark, sf).withColumn("day", F.to_date("ts")), ["event_type", "day"], "value")
    found = quantiles.of_sketches(quantiles.merged(Scratch(spark, "sketches").keep(days), ["event_type"]), ["event_type"], QUANTILES)
    errors = quantiles.rank_errors(_events(spark, sf), found, ["event_type"], "value")
    return errors.select("event_type", "quantile", "n", (F.col("rank_error") <= 0.01).cast("long").alias("close"))


@query(f"WITH {LINES}, s AS (SELECT entity, CAST(month(day) AS INTEGER) AS month, CAST(year(day) AS INTEGER) AS year, quantile_cont(CASE WHEN q > 20 THEN q END, 0.95) AS high, avg(CASE WHEN q > 20 THEN 1.0 ELSE 0.0 END) AS share FROM d GROUP BY 1, 2, 3), y AS (SELECT month, year, avg(high) AS high, avg(share) AS share FROM s GROUP BY 1, 2) SELECT month, round(avg(high), 6) AS intensity, count(high) AS intensity_years, round(avg(share), 6) AS frequency, count(share) AS frequency_years FROM y GROUP BY 1")
def a24_freq_intensity(spark, sf):
    """How often and how much: quantiles per entity and month, averaged over entities, then over years."""
    q = F.when(F.col("q") > 20, F.col("q"))
    cells = _lines(spark, sf).groupBy("entity", F.month("day").alias("month"), F.year("day").alias("year")).agg(F.percentile(q, 0.95).alias("intensity"), F.avg((F.col("q") > 20).cast("int")).alias("frequency"))
    out = coverage.mean_of_means(cells, ["month"], ["year"], ["intensity", "frequency"])
    return out.select("month", F.round("intensity", 6).alias("intensity"), F.col("n_intensity").alias("intensity_years"), F.round("frequency", 6).alias("frequency"), F.col("n_frequency").alias("frequency_years"))


@query(f"""WITH {CELLS}, q AS (SELECT *, total / days AS mean FROM c WHERE coverage >= 0.15), p AS (SELECT DISTINCT c.year, c.month FROM c JOIN c b ON b.year = c.year + 1 AND b.month = c.month),
 f AS (SELECT a.year, a.month, count(*) AS n, avg(a.mean) AS before, avg(b.mean) AS after FROM q a JOIN q b ON a.entity = b.entity AND a.month = b.month AND b.year = a.year + 1 GROUP BY 1, 2)
 SELECT p.year, p.month, coalesce(n, 0) AS n, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS delta, CASE WHEN n > 0 THEN 'SUPPORTED' ELSE 'NO_COMMON' END AS status FROM p LEFT JOIN f USING (year, month)""")
def a25_paired_support(spark, sf):
    out = coverage.paired_support(_cells(spark, sf), 0.15)
    return out.select("year", "month", "n", *[F.round(c, 6).alias(c) for c in ("before", "after", "delta")], "status")


def _cutoff_means(spark, sf):
    cells = _cells(spark, sf).where(F.col("year").isin(YEARS)).withColumn("cutoff", F.explode(F.array(F.lit(0.05), F.lit(0.10)))).where(F.col("coverage") >= F.col("cutoff"))
    return cells.groupBy("cutoff", "month", "year").agg(F.round(F.avg(F.col("total") / F.col("days")), 9).alias("mean"))


MEANS = CELLS + ", m AS (SELECT CAST(cutoff AS DOUBLE) AS cutoff, month, year, round(avg(total / days), 9) AS mean FROM c, (VALUES (0.05), (0.10)) AS t(cutoff) WHERE year BETWEEN 1996 AND 2000 AND coverage >= cutoff GROUP BY 1, 2, 3)"


@query(f"WITH {MEANS}, e AS (SELECT cutoff, month, arg_min(year, (mean, year)) AS low, arg_max(year, (mean, -year)) AS high FROM m GROUP BY 1, 2), d AS (SELECT a.month, max(abs(a.mean - b.mean)) AS most FROM m a JOIN m b ON a.cutoff = 0.05 AND b.cutoff = 0.10 AND a.month = b.month AND a.year = b.year GROUP BY 1) SELECT d.month, a.low AS low_wide, b.low AS low_strict, a.high AS high_wide, b.high AS high_strict, CAST(a.low = b.low AND a.high = b.high AS BIGINT) AS agree, round(most, 6) AS max_difference FROM d JOIN e a ON a.month = d.month AND a.cutoff = 0.05 JOIN e b ON b.month = d.month AND b.cutoff = 0.10")
def a26_sensitivity(spark, sf):
    """Lowest and highest year under two cutoffs; both are columns of one row a month, so nothing joins itself."""
    means = _cutoff_means(spark, sf)
    by = means.groupBy("month", "year").agg(*[F.max(F.when(F.col("cutoff") == c, F.col("mean"))).alias(n) for c, n in ((0.05, "wide"), (0.10, "strict"))])
    ends = []
    for n in ("wide", "strict"):
        ends += [F.min_by("year", F.when(F.col(n).isNotNull(), F.struct(n, "year"))).alias(f"low_{n}"), F.max_by("year", F.when(F.col(n).isNotNull(), F.struct(F.col(n), -F.col("year")))).alias(f"high_{n}")]
    out = by.groupBy("month").agg(*ends, F.round(F.max(F.abs(F.col("wide") - F.col("strict"))), 6).alias("max_difference"))
    return out.where("max_difference IS NOT NULL").withColumn("agree", ((F.col("low_wide") == F.col("low_strict")) & (F.col("high_wide") == F.col("high_strict"))).cast("long"))


@query(f"WITH {PANEL}, b AS (SELECT arg_min(month, (-n, month)) AS month FROM (SELECT month, count(*) AS n FROM f GROUP BY 1)) SELECT c.entity, c.month, count(*) AS years, round(avg(total / days), 6) AS mean, round(min(total / days), 6) AS least, round(max(total / days), 6) AS most FROM c JOIN f ON c.month = f.month AND c.entity = f.entity JOIN b ON b.month = c.month WHERE year BETWEEN 1996 AND 2000 GROUP BY 1, 2")
def a27_spatial(spark, sf):
    """Per entity of the panel in the month with the largest one (ties: the earliest)."""
    cells = _cells(spark, sf)
    fixed = coverage.panel(cells, 0.10, YEARS)
    best = fixed.groupBy("month").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "month").limit(1).select("month")
    chosen = fixed.join(F.broadcast(best), "month")  # one row
    rows = cells.where(F.col("year").isin(YEARS)).join(chosen, ["month", "entity"], "left_semi").withColumn("m", F.col("total") / F.col("days"))
    return rows.groupBy("entity", "month").agg(F.count(F.lit(1)).alias("years"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.min("m"), 6).alias("least"), F.round(F.max("m"), 6).alias("most"))


@query(f"WITH {CELLS}, e AS (SELECT entity FROM c WHERE year BETWEEN 1996 AND 2000 GROUP BY 1 HAVING count(DISTINCT year) = 5) SELECT year, month, count(*) AS entities, CAST(sum(days) AS BIGINT) AS observed, CAST(sum(expected) AS BIGINT) AS expected, round(sum(days) / sum(expected), 6) AS coverage FROM c WHERE year BETWEEN 1996 AND 2000 AND entity IN (SELECT entity FROM e) GROUP BY 1, 2")
def a30_network(spark, sf):
    cells = _cells(spark, sf).where(F.col("year").isin(YEARS))
    common = cells.groupBy("entity").agg(F.count_distinct("year").alias("y")).where(F.col("y") == len(YEARS)).select("entity")
    out = cells.join(common, "entity", "left_semi").groupBy("year", "month").agg(F.count(F.lit(1)).alias("entities"), F.sum("days").alias("observed"), F.sum("expected").cast("long").alias("expected"))
    return out.withColumn("coverage", F.round(F.col("observed") / F.col("expected"), 6))


@query(f"WITH {MEANS} SELECT cutoff, arg_min(month, (mean, month)) AS low_month, min(mean) AS low, arg_max(month, (mean, -month)) AS high_month, max(mean) AS high FROM (SELECT cutoff, month, round(avg(mean), 9) AS mean FROM m GROUP BY 1, 2) GROUP BY 1")
def a32_extremes(spark, sf):
    months = _cutoff_means(spark, sf).groupBy("cutoff", "month").agg(F.round(F.avg("mean"), 9).alias("mean"))
    return coverage.extremes(months, ["cutoff"], "month", "mean")


@query(f"WITH {CELLS} SELECT entity FROM c WHERE year = 1996 AND coverage >= 0.10 INTERSECT SELECT entity FROM c WHERE year = 2000 AND coverage >= 0.10")
def u4_intersection(spark, sf):
    cells = _cells(spark, sf).where(F.col("coverage") >= 0.10)
    first, last = (cells.where(F.col("year") == y).select("entity") for y in (1996, 2000))
    return first.intersect(last)


@query(f"WITH {CELLS} SELECT DISTINCT entity, month FROM c WHERE coverage >= 0.15")
def u3_distinct_keys(spark, sf):
    return _cells(spark, sf).where(F.col("coverage") >= 0.15).dropDuplicates(["entity", "month"]).select("entity", "month")


PLACES = "p AS (SELECT DISTINCT l_suppkey AS entity, 1 + (l_suppkey * 37 + l_linenumber) % 60 / 100.0 AS lat, 103 + (l_suppkey * 11 + l_linenumber * 7) % 90 / 100.0 AS lon FROM lineitem)"
HAVERSINE = "2 * 6371.0088 * asin(sqrt(least(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 1)))"


@query(f"WITH {PLACES} SELECT a.entity, count(DISTINCT (a.lat, a.lon)) AS places, round(max({HAVERSINE}), 6) AS km FROM p a JOIN p b ON a.entity = b.entity GROUP BY 1")
def j15_distance(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.col("l_suppkey").alias("entity"), (1 + (F.col("l_suppkey") * 37 + F.col("l_linenumber")) % 60 / F.lit(100.0)).alias("lat"), (103 + (F.col("l_suppkey") * 11 + F.col("l_linenumber") * 7) % 90 / F.lit(100.0)).alias("lon")
    )
    return separation.widest_separation(rows, "entity", "lat", "lon").withColumn("km", F.round("km", 6))


@query(f"WITH {CELLS}, y AS (SELECT entity, year, min(month) AS first, max(month) AS last FROM c WHERE coverage >= 0.10 GROUP BY 1, 2), n AS (SELECT *, lead(year) OVER w AS next_year, lead(first) OVER w AS next_first FROM y WINDOW w AS (PARTITION BY entity ORDER BY year)) SELECT entity, year, next_year, (next_year - year) * 12 + next_first - last AS gap_months FROM n WHERE next_year IS NOT NULL")
def w14_period_gaps(spark, sf):
    return coverage.period_gaps(_cells(spark, sf).where(F.col("coverage") >= 0.10)).select("entity", "year", "next_year", "gap_months")


@query(f"WITH {_slots(300)}, q AS (SELECT slot - lag(slot) OVER (PARTITION BY entity ORDER BY slot) AS gap FROM g) SELECT CASE WHEN gap = 300 THEN 'STEP' WHEN gap < 300 THEN 'SHORTER' WHEN gap % 300 <> 0 THEN 'OFF_STEP' ELSE 'LONGER' END AS kind, count(*) AS n, max(gap) AS longest FROM q WHERE gap IS NOT NULL GROUP BY 1")
def w1_gap_classes(spark, sf):
    return coverage.gap_classes(_grid(spark, sf, FIVE), "entity", "slot", 300)


@query(f"""WITH p AS (SELECT user_id AS entity, {E} AS sec, {E} % 300 // 60 AS phase FROM events), l AS (SELECT entity, sec, phase, sec - lag(sec, 1) OVER w AS gap, {', '.join(f'lag(phase, {k}) OVER w AS p{k}' for k in range(1, 5))} FROM p WINDOW w AS (PARTITION BY entity ORDER BY sec))
 SELECT entity, sec, phase, p1, gap, CAST(p1 = p2 AND p2 = p3 AND p3 = p4 AS BIGINT) AS steady_before FROM l WHERE p4 IS NOT NULL AND phase <> p1""")
def w2_phase_transitions(spark, sf):
    """Rows whose phase differs from the one before, with whether the four before agreed."""
    at = epoch_of(F.col("ts"))
    rows = _events(spark, sf).select(F.col("user_id").alias("entity"), at.alias("sec"), F.floor(at % 300 / 60).alias("phase"))
    return coverage.phase_transitions(rows, "entity", "sec", "phase")
