"""Sources and sinks, joins with their audits, table comparisons and signatures."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..grid import epoch_of
from ..operators import hash_tree, joins, windows
from ..queries import DAY, FEATURES, FIVE, FIVE_KEYS, ROLE, SCORES, TARGETS, _anchors, _events, _grid, _keyed, _scores, _slots
from ..registry import query
from ..sources import buckets, tables
from ..sources.shared import Scratch

E = "CAST(floor(epoch(ts)) AS BIGINT)"
BASE = f"r AS (SELECT event_id, user_id AS entity, {E} AS sec, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day, CAST(value AS DECIMAL(18,2)) AS v FROM events)"
CONTRACT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("entity", T.LongType()), T.StructField("sec", T.LongType()), T.StructField("v", T.DecimalType(18, 2)), T.StructField("day", T.IntegerType())])


def _rows(spark, sf):
    return _events(spark, sf).select("event_id", F.col("user_id").alias("entity"), epoch_of(F.col("ts")).alias("sec"), F.col("value").cast("decimal(18,2)").alias("v"), F.dayofmonth("ts").alias("day"))


def _table(spark, sf):
    """The events as a table partitioned by day, written once below the shared folder."""
    path = Scratch(spark, "table").path()
    tables.write_partitioned(_rows(spark, sf), path, ["day"])
    return path


@query(f"WITH {BASE} SELECT event_id, entity, sec, CAST(v AS DOUBLE) AS v, day FROM r")
def io3_strict_csv(spark, sf):
    path = Scratch(spark, "csv").path()
    _rows(spark, sf).write.option("header", True).csv(path)
    return tables.read_strict_csv(spark, path, "event_id long, entity long, sec long, v decimal(18,2), day int").withColumn("v", F.col("v").cast("double"))


@query(f"WITH {BASE} SELECT day, count(*) AS n, CAST(sum(v) AS DOUBLE) AS total FROM r WHERE day BETWEEN 5 AND 9 GROUP BY 1")
def io4_partition_scan(spark, sf):
    out = spark.read.parquet(_table(spark, sf)).where("day BETWEEN 5 AND 9")
    return out.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("v").cast("double").alias("total"))


@query(f"WITH {BASE} SELECT event_id, day FROM r WHERE day = 7")
def io5_one_partition(spark, sf):
    return tables.read_partition(spark, _table(spark, sf), "day=7").select("event_id", "day")


@query(f"WITH {BASE} SELECT 'events' AS name, count(*) AS n, min(sec) AS first, max(sec) AS last FROM r UNION ALL SELECT 'days', count(DISTINCT day), min(day), max(day) FROM r")
def io6_contract_read(spark, sf):
    """Several tables of one root, each held against its contract."""
    root = Scratch(spark, "root").path()
    rows = _rows(spark, sf)
    tables.write_partitioned(rows, f"{root}/events", ["day"])
    tables.write_small(rows.select("day").distinct(), f"{root}/days")
    found = tables.read_tables(spark, root, {"events": CONTRACT, "days": T.StructType([T.StructField("day", T.IntegerType())])}, zone="UTC")
    first = found["events"].agg(F.lit("events").alias("name"), F.count(F.lit(1)).alias("n"), F.min("sec").alias("first"), F.max("sec").alias("last"))
    return first.unionByName(found["days"].agg(F.lit("days").alias("name"), F.count(F.lit(1)).alias("n"), F.min("day").cast("long").alias("first"), F.max("day").cast("long").alias("last")))


@query(f"WITH {BASE}, b AS (SELECT * FROM r WHERE event_id % 31 <> 0 UNION ALL SELECT * FROM r WHERE event_id % 29 = 0) SELECT (SELECT count(*) FROM (FROM r EXCEPT ALL FROM b)) AS only_left, (SELECT count(*) FROM (FROM b EXCEPT ALL FROM r)) AS only_right, (SELECT count(*) FROM r) AS written")
def io11_roundtrip(spark, sf):
    """What was written is read back and held against a damaged copy, both ways."""
    rows = _rows(spark, sf)
    path = Scratch(spark, "once").path()
    tables.write_once(rows, path)
    back = spark.read.parquet(path)
    damaged = rows.where("event_id % 31 <> 0").unionByName(rows.where("event_id % 29 = 0"))
    return tables.differences(back, damaged)


@query(f"WITH {BASE} SELECT event_id, day FROM r WHERE day IN (3, 11) AND entity % 2 = 1")
def io12_literal_keys(spark, sf):
    """Rows of a few keys given by the caller, as a literal table."""
    keys = spark.createDataFrame([(3,), (11,)], "day int")
    return _rows(spark, sf).join(F.broadcast(keys), "day", "left_semi").where("entity % 2 = 1").select("event_id", "day")


@query(f"WITH {BASE} SELECT entity, day, count(*) AS n, CAST(sum(v) AS DOUBLE) AS total FROM r GROUP BY 1, 2")
def io13_export(spark, sf):
    """An aggregate written as text by the executors, then read again."""
    path = Scratch(spark, "export").path()
    _rows(spark, sf).groupBy("entity", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")).write.option("header", True).csv(path)
    return tables.read_strict_csv(spark, path, "entity long, day int, n long, total decimal(28,2)").withColumn("total", F.col("total").cast("double"))


@query(f"WITH {BASE} SELECT CASE WHEN day < 20 THEN 'TRAIN' ELSE 'TEST' END AS role, count(*) AS n, CAST(sum(v) AS DOUBLE) AS total FROM r GROUP BY 1")
def io10_role_partitions(spark, sf):
    path = Scratch(spark, "roles").path()
    tables.write_partitioned(_rows(spark, sf).withColumn("role", F.when(F.col("day") < 20, "TRAIN").otherwise("TEST")), path, ["role"])
    return spark.read.parquet(path).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum("v").cast("double").alias("total"))


@query(f"WITH {BASE} SELECT day, CAST(sum(CASE WHEN day <> day(make_timestamp(sec * 1000000)) THEN 1 ELSE 0 END) AS BIGINT) AS violations, CAST(sum(CASE WHEN day(make_timestamp((sec + 10800) * 1000000)) <> day THEN 1 ELSE 0 END) AS BIGINT) AS shifted_violations FROM r GROUP BY 1")
def p16_partition_check(spark, sf):
    """Rows whose epoch does not belong to the partition they lie in; the second count takes the epochs three hours later."""
    out = spark.read.parquet(_table(spark, sf))
    return joins.partition_violations(out, "sec", "day", {"violations": 0, "shifted_violations": 10_800})


@query(f"WITH {_slots(86_400)} SELECT g.entity, slot, s_nationkey AS nation FROM g JOIN supplier ON s_suppkey = g.entity")
def j4_lookup(spark, sf):
    side = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("nation"))
    return joins.lookup(_grid(spark, sf, DAY), side, ["entity"], "inner").select("entity", "slot", "nation")


MULTI = _slots(86_400) + ", b AS (SELECT entity, CASE WHEN entity % 11 = 3 THEN slot + 1 ELSE slot END AS slot, CASE WHEN entity % 13 = 2 THEN NULL WHEN entity % 7 = 0 THEN v + 1 ELSE v END AS v, n + CASE WHEN slot % 7 = 0 THEN 1 ELSE 0 END AS n FROM g), f AS (SELECT g.v AS v1, b.v AS v2, g.n AS n1, b.n AS n2, g.slot AS s1, b.slot AS s2 FROM g FULL JOIN b ON g.entity = b.entity AND g.slot = b.slot)"


def _other(spark, sf):
    e = F.col("entity")
    grid = _grid(spark, sf, DAY)
    v = F.when(e % 13 != 2, F.when(e % 7 == 0, F.col("v") + 1).otherwise(F.col("v"))).cast("decimal(18,2)")
    return grid, grid.select("entity", F.when(e % 11 == 3, F.col("slot") + 1).otherwise(F.col("slot")).alias("slot"), v.alias("v"), (F.col("n") + F.when(F.col("slot") % 7 == 0, 1).otherwise(0)).alias("n"))


@query(f"""WITH {MULTI}, c AS (SELECT 'v' AS name, CAST(v1 AS DOUBLE) AS x, CAST(v2 AS DOUBLE) AS y FROM f WHERE s1 IS NOT NULL AND s2 IS NOT NULL UNION ALL SELECT 'n', CAST(n1 AS DOUBLE), CAST(n2 AS DOUBLE) FROM f WHERE s1 IS NOT NULL AND s2 IS NOT NULL)
 SELECT name, count(*) AS compared, CAST(sum(CASE WHEN x IS DISTINCT FROM y THEN 1 ELSE 0 END) AS BIGINT) AS unequal, CAST(sum(CASE WHEN (x IS NULL) <> (y IS NULL) THEN 1 ELSE 0 END) AS BIGINT) AS null_mismatch, max(abs(x - y)) AS max_difference, (SELECT count(*) FROM f WHERE s2 IS NULL) AS only_left, (SELECT count(*) FROM f WHERE s1 IS NULL) AS only_right FROM c GROUP BY 1""")
def j6_columns(spark, sf):
    return joins.compare_columns(*_other(spark, sf), ["entity", "slot"], ["v", "n"])


@query(f"WITH {MULTI} SELECT entity, slot, CAST(row_number() OVER (ORDER BY entity, slot) AS INTEGER) AS place FROM (SELECT g.entity, g.slot FROM g JOIN b ON g.entity = b.entity AND g.slot = b.slot WHERE g.v IS DISTINCT FROM b.v) QUALIFY place <= 5")
def j6_examples(spark, sf):
    """The five unequal keys that come first."""
    return joins.unequal_examples(*_other(spark, sf), ["entity", "slot"], "v", 5)


@query(f"WITH {FIVE_KEYS}, l AS (SELECT DISTINCT entity, slot FROM k), j AS (SELECT l.entity, count(*) AS n FROM l LEFT JOIN k ON l.entity = k.entity AND l.slot = k.slot GROUP BY 1) SELECT (SELECT count(*) FROM l) AS left_rows, CAST(sum(n) AS BIGINT) AS joined_rows, CAST(sum(n) - (SELECT count(*) FROM l) AS BIGINT) AS inflation FROM j")
def j7_inflation(spark, sf):
    rows = _keyed(spark, sf)
    return joins.inflation(rows.select("entity", "slot").distinct(), rows, ["entity", "slot"])


GUARD = f"""{FIVE_KEYS}, l AS (SELECT CASE WHEN event_id % 97 = 5 THEN NULL ELSE entity END AS entity, slot FROM k), r AS (SELECT entity, slot FROM k WHERE entity % 9 <> 4 UNION ALL SELECT entity, slot FROM k WHERE event_id % 101 = 1),
 lc AS (SELECT entity, slot, count(*) AS n FROM l GROUP BY 1, 2), rc AS (SELECT entity, slot, count(*) AS n FROM r GROUP BY 1, 2),
 s AS (SELECT (SELECT count(*) FROM l) AS left_rows, (SELECT count(*) FROM r) AS right_rows, (SELECT count(*) FROM l WHERE entity IS NULL) AS left_null_keys, (SELECT count(*) FROM r WHERE entity IS NULL) AS right_null_keys,
 (SELECT count(*) FROM lc WHERE n > 1 AND entity IS NOT NULL) AS left_duplicates, (SELECT count(*) FROM rc WHERE n > 1 AND entity IS NOT NULL) AS right_duplicates,
 (SELECT count(*) FROM lc WHERE entity IS NOT NULL) AS left_keys, (SELECT count(*) FROM rc WHERE entity IS NOT NULL) AS right_keys, (SELECT count(*) FROM lc JOIN rc USING (entity, slot)) AS matched_keys)"""


@query(f"WITH {GUARD} SELECT left_rows, right_rows, left_null_keys, right_null_keys, left_duplicates, right_duplicates, matched_keys, round(matched_keys / left_keys, 6) AS left_match_rate, round(matched_keys / right_keys, 6) AS right_match_rate, CASE WHEN left_null_keys + right_null_keys + left_duplicates + right_duplicates > 0 OR matched_keys < left_keys THEN 'FAIL' ELSE 'PASS' END AS verdict FROM s")
def j8_guarded(spark, sf):
    rows = _keyed(spark, sf)
    left = rows.select(F.when(F.col("event_id") % 97 != 5, F.col("entity")).alias("entity"), "slot")
    right = rows.where("entity % 9 <> 4").unionByName(rows.where("event_id % 101 = 1")).select("entity", "slot")
    out = joins.guard_join(left, right, ["entity", "slot"], require_all_left=True)
    return out.withColumns({c: F.round(c, 6) for c in ("left_match_rate", "right_match_rate")})


@query(f"WITH {_slots(86_400)}, a AS (SELECT * FROM g WHERE n = 1), j AS (SELECT g.entity, g.slot FROM g JOIN a USING (entity, slot)) SELECT (SELECT count(*) FROM g) AS left_rows, (SELECT count(*) FROM a) AS right_rows, (SELECT count(*) FROM j) AS joined_rows, CAST((SELECT count(*) FROM j) = (SELECT count(*) FROM g) AS BIGINT) AS whole")
def j10_counted_join(spark, sf):
    grid = _grid(spark, sf, DAY)
    return joins.counted_join(grid.select("entity", "slot"), grid.where("n = 1").select("entity", "slot"), ["entity", "slot"])


JOINED = FEATURES + TARGETS.removeprefix(_slots(86_400))


@query(f"WITH {JOINED} SELECT h.entity, h.slot, future_n, CAST(future_total AS DOUBLE) AS future_total, round(CASE WHEN n2 = 2 THEN s2 END, 4) AS sum_2, round(CASE WHEN n4 = 4 THEN s4 END, 4) AS sum_all FROM h JOIN a ON h.entity = a.entity AND h.slot = a.slot")
def j10_bucketed_join(spark, sf):
    """Anchors with their features, from two tables bucketed alike on disk; every row of both must be met once."""
    grid = _grid(spark, sf, DAY)
    anchors = windows.targets(grid, DAY).select("entity", "slot", "future_n", "future_total")
    features = windows.features(grid, DAY).select("entity", "slot", "sum_2", "sum_all")
    scratch, keys = Scratch(spark, "buckets"), ["entity", "slot"]
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = buckets.whole_join(*[buckets.write_bucketed(df, scratch.path(), keys, wide) for df in (anchors, features)], keys)
    return out.select(*keys, "future_n", F.col("future_total").cast("double").alias("future_total"), F.round("sum_2", 4).alias("sum_2"), F.round("sum_all", 4).alias("sum_all"))


CHANGED = f"{FIVE_KEYS}, b AS (SELECT event_id, entity, slot, CASE WHEN event_id % 1009 = 5 THEN v + 1 ELSE v END AS v FROM k WHERE event_id % 2003 <> 7)"


@query(f"WITH {CHANGED} SELECT 'left' AS side, event_id, CAST(v AS DOUBLE) AS v FROM (FROM k EXCEPT ALL FROM b) UNION ALL SELECT 'right', event_id, CAST(v AS DOUBLE) FROM (FROM b EXCEPT ALL FROM k)")
def u2_hash_tree(spark, sf):
    """Rows of each of two written tables that the other lacks; trees of hashes tell which ranges of keys to read."""
    rows = _keyed(spark, sf).select("event_id", "entity", "slot", "v")
    other = rows.where("event_id % 2003 <> 7").withColumn("v", F.when(F.col("event_id") % 1009 == 5, F.col("v") + 1).otherwise(F.col("v")).cast("decimal(18,2)"))
    scratch = Scratch(spark, "hashed")
    paths = [scratch.path() for _ in range(2)]
    for df, path in zip((rows, other), paths):
        hash_tree.write_hashed(df, path, ["event_id"], 3, 1)
    return hash_tree.differences(spark, *paths, 3, 1).select("side", "event_id", F.col("v").cast("double").alias("v"))


@query(f"WITH {FIVE_KEYS}, b AS (SELECT event_id, entity, slot, CASE WHEN event_id % 50 = 0 THEN v + 1 ELSE v END AS v FROM k UNION ALL SELECT event_id, entity, slot, v FROM k WHERE event_id % 40 = 0) SELECT 'left' AS side, event_id, CAST(v AS DOUBLE) AS v FROM (FROM k EXCEPT ALL FROM b) UNION ALL SELECT 'right', event_id, CAST(v AS DOUBLE) FROM (FROM b EXCEPT ALL FROM k)")
def u2_except_all(spark, sf):
    """Rows of each table that the other lacks, with multiplicity."""
    rows = _keyed(spark, sf).select("event_id", "entity", "slot", "v")
    changed = rows.withColumn("v", F.when(F.col("event_id") % 50 == 0, F.col("v") + 1).otherwise(F.col("v")).cast("decimal(18,2)"))
    other = changed.unionByName(rows.where("event_id % 40 = 0"))
    parts = [(n, a.exceptAll(b)) for n, a, b in (("left", rows, other), ("right", other, rows))]
    left, right = (df.select(F.lit(n).alias("side"), "event_id", F.col("v").cast("double").alias("v")) for n, df in parts)
    return left.unionByName(right)


@query()
def m8_paired_sums(spark, sf):
    """Per role two hash sums with different seeds."""
    return joins.signature(_anchors(spark, sf), ["role"], ["entity", "slot", "future_total"], sums=2)


@query()
def m9_column_signature(spark, sf):
    """Per column the sum of the hashes of key and value, and its nulls: differing tables show where."""
    return joins.column_signature(_anchors(spark, sf), ["entity", "slot"], ["v", "future_total", "history_n", "role"])


def _number(columns: list[str], seed: int) -> str:
    """The SQL of `joins.arithmetic`."""
    total = str(seed)
    for factor, c in zip(joins.FACTORS, columns):
        total = f"((({total}) * 31 + ((coalesce({c}, -1) % {joins.MODULUS} + {joins.MODULUS}) % {joins.MODULUS}) * {factor}) % {joins.MODULUS})"
    return total


WHOLE = TARGETS + f", w AS (SELECT entity, slot, CAST(v * 100 AS BIGINT) AS cents, CAST(future_total * 100 AS BIGINT) AS future_cents, {ROLE} AS role FROM a)"


def _whole_numbers(spark, sf):
    return _anchors(spark, sf).select("entity", "slot", (F.col("v") * 100).cast("long").alias("cents"), (F.col("future_total") * 100).cast("long").alias("future_cents"), "role")


@query(f"WITH {WHOLE} SELECT role, count(*) AS n, CAST(sum({_number(['entity', 'slot', 'cents', 'future_cents'], 0)}) AS BIGINT) AS hash_sum, CAST(sum({_number(['entity', 'slot', 'cents', 'future_cents'], 1)}) AS BIGINT) AS hash_sum_1 FROM w GROUP BY 1")
def m8_arithmetic_sums(spark, sf):
    """Per role two sums of row numbers that any engine can form."""
    out = joins.signature(_whole_numbers(spark, sf), ["role"], ["entity", "slot", "cents", "future_cents"], 2, joins.arithmetic)
    return out.withColumns({c: F.col(c).cast("long") for c in ("hash_sum", "hash_sum_1")})


@query(f"WITH {WHOLE} " + " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS n, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls, CAST(sum({_number(['entity', 'slot', c], 0)}) AS BIGINT) AS hash_sum FROM w" for c in ("cents", "future_cents")))
def m9_arithmetic_columns(spark, sf):
    out = joins.column_signature(_whole_numbers(spark, sf), ["entity", "slot"], ["cents", "future_cents"], joins.arithmetic)
    return out.withColumn("hash_sum", F.col("hash_sum").cast("long"))


@query(f"WITH {WHOLE} SELECT entity, slot FROM w ORDER BY {_number(['entity', 'slot'], 7)}, entity, slot LIMIT 20")
def t7_arithmetic_pick(spark, sf):
    """The 20 anchors of smallest row number: the pick is the feature."""
    return _anchors(spark, sf).orderBy(joins.arithmetic(["entity", "slot"], 7), "entity", "slot").limit(20).select("entity", "slot")


@query(f"WITH {SCORES} SELECT threshold, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, round(avg(p), 8) AS mean_p FROM z WHERE threshold IN (50, 200) GROUP BY 1")
def io10_threshold_partitions(spark, sf):
    """Scores in one folder a threshold, of which two are read again."""
    path = Scratch(spark, "thresholds").path()
    tables.write_partitioned(_scores(spark, sf), path, ["threshold"])
    out = spark.read.parquet(path).where("threshold IN (50, 200)")
    return out.groupBy(F.col("threshold").cast("double").alias("threshold")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("positives"), F.round(F.avg("p"), 8).alias("mean_p"))


@query(f"WITH {_slots(300)}, s AS (SELECT min(slot) AS a FROM g) SELECT CAST(bool_or(n > 1) AS BIGINT) AS any_repeated, CAST(bool_or(v < 0) AS BIGINT) AS any_negative FROM g")
def t4_existence(spark, sf):
    grid = _grid(spark, sf, FIVE)
    return joins.existence(grid, {"any_repeated": F.col("n") > 1, "any_negative": F.col("v") < 0})
