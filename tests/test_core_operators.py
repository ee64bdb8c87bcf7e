"""Operators on small shapes whose results are known by hand, with nulls, ties and empty tables."""

import pytest
from pyspark.sql import functions as F

from slotgrid.functions.predicates import blank, usable
from slotgrid.grid import GridSpec
from slotgrid.operators import collide, coverage, ecdf, folds, joins, models, records, requests, windows
from slotgrid.sources import tables
from slotgrid.sources.shared import Scratch

SPEC = GridSpec(step=300, history=12, future=6)


def rows(df):
    return [tuple(r) for r in df.collect()]


def series(spark, shapes):
    data = [(name, 1_000_200 + 300 * i, None if v is None else str(v)) for name, values in shapes.items() for i, v in enumerate(values) if v != "-"]
    return spark.createDataFrame(data, "entity string, slot long, v string").withColumn("v", F.col("v").cast("decimal(18,2)"))


def test_runs_and_recency(spark):
    """Six shapes of twelve slots: all wet, all dry, the last three wet, stopped, alternating, one slot missing or null."""
    shapes = {
        "wet": [1] * 12, "dry": [0] * 12, "last": [0] * 9 + [1] * 3, "stopped": [1] * 10 + [0] * 2, "alternating": [0, 1] * 6,
        "missing": [1] * 4 + ["-"] + [1] * 7, "null": [1] * 4 + [None] + [1] * 7,
    }
    out = windows.features(series(spark, shapes), SPEC).where("slot = 1000200 + 3300")
    got = {r["entity"]: (r["run_slots"], r["run_censored"], r["since_event_s"], r["no_event"], r["since_event_code"], r["ratio"]) for r in out.collect()}
    assert got["wet"] == (12, 1, 0, 0, 0, pytest.approx(2 / 12))
    assert got["dry"] == (0, 0, None, 1, 3600, 0.0)
    assert got["last"] == (3, 0, 0, 0, 0, pytest.approx(2 / 3))
    assert got["stopped"][:5] == (0, 0, 600, 0, 600)
    assert got["alternating"][:5] == (1, 0, 0, 0, 0)
    assert got["missing"] == got["null"] == (None,) * 6


def test_future_total_is_exact_and_null_when_unknown(spark):
    grid = series(spark, {"normal": [0] + ["0.05"] * 6, "gap": [0, 1, "-", 1, 1, 1, 1], "null": [0, 1, None, 1, 1, 1, 1]})
    anchors = windows.edge_reasons(windows.targets(grid, SPEC), SPEC)
    got = {r["entity"]: r for r in anchors.where("slot = 1000200").collect()}
    assert str(got["normal"]["future_total"]) == "0.30" and got["normal"]["edge_reason"] == ["DATASET_START"]
    for name in ("gap", "null"):
        assert got[name]["future_total"] is None and "FUTURE_INCOMPLETE" in got[name]["invalid_reason"]
    offsets = grid.select("entity", "slot", windows.missing_offsets(grid, SPEC, 1, 6).alias("o")).where("slot = 1000200")
    assert {r["entity"]: r["o"] for r in offsets.collect()} == {"normal": [], "gap": [600], "null": [600]}


def test_buckets_and_padding_change_nothing(spark):
    spec = GridSpec(step=300, history=4, future=2)
    grid = spark.range(400).selectExpr("CAST(id % 3 AS STRING) AS entity", "300 * (id DIV 3 + (id DIV 40) % 5) AS slot", "CAST(id % 7 AS DECIMAL(18,2)) AS v").dropDuplicates(["entity", "slot"])
    plain = windows.targets(grid, spec)
    dealt = windows.over_buckets(grid, spec, 8, windows.targets)
    assert rows(tables.differences(plain, dealt.select(plain.columns)))[0][:2] == (0, 0)
    part = windows.padded(grid, spec, 9_000, 21_000, windows.targets)
    assert rows(tables.differences(plain.where("slot >= 9000 AND slot < 21000"), part.select(plain.columns)))[0][:2] == (0, 0)
    with pytest.raises(ValueError):
        windows.over_buckets(grid, spec, 4, windows.targets)


def test_blank_and_usable(spark):
    df = spark.createDataFrame([(None, None), ("", float("nan")), ("  ", float("inf")), ("x", -float("inf")), ("y ", 1.5)], "a string, b double")
    assert rows(df.select(blank(F.col("a")), usable(F.col("b")))) == [(True, False), (True, False), (True, False), (False, False), (False, True)]


def test_decimal_shape(spark):
    cases = {"0.123456789012345678": (18, 0, 0, True), "0.1234567890123456789": (19, 0, 0, False), "2e-1": (1, 0, -1, True), "1e20": (0, 21, 20, False), "00.500": (1, 0, 0, True), "-12.5": (1, 2, 0, True), "0": (0, 0, 0, True), "0e5": (0, 0, 5, True), "": None, "NaN": None, ".": None, "1e": None}
    df = spark.createDataFrame([(c,) for c in [*cases, None]], "t string")
    shape = records.decimal_shape(F.col("t"))
    got = {r[0]: tuple(r)[1:] for r in df.select("t", *shape.values()).collect()}
    assert got == {t: want or (None,) * 4 for t, want in {**cases, None: None}.items()}


def test_resolve_collisions(spark):
    data = [(1, "S1", 300, "1", "a", 0), (2, "S1", 300, "1", "b", 1), (3, "S2", 300, "1", "a", 0), (4, "S2", 300, "2", "a", 1), (5, "S3", 300, "0", "a", 0), (6, None, 300, "3", "a", 0)]
    df = spark.createDataFrame(data, "id long, station string, slot long, v string, name string, shift int")
    out = collide.resolve(df, ["station", "slot"], "v", ["name"], ["shift", "id"], "id")
    got = {r["id"]: (r["disposition"], r["retained_id"], r["metadata_variants"]) for r in out.collect()}
    assert got == {1: ("kept", 1, 2), 2: ("merged", 1, 2), 3: ("quarantined", 3, 1), 4: ("quarantined", 3, 1), 5: ("unique", 5, 1), 6: ("unique", 6, 1)}
    row = collide.balance(out, F.col("v").cast("decimal(20,2)")).first()
    assert (row["raw_rows"], row["kept_rows"], row["merged_rows"], row["quarantined_rows"], row["rows_balance"], row["amount_balance"]) == (6, 3, 1, 2, 1, 1)
    assert collide.resolve(df.limit(0), ["station", "slot"], "v", ["name"], ["shift", "id"], "id").count() == 0


def test_guard_join(spark):
    def verdict(left, right, **kw):
        a, b = (spark.createDataFrame(x, "s string, t long") for x in (left, right))
        return joins.guard_join(a, b, ["s", "t"], **kw).first()["verdict"]

    base = [("S1", 300), ("S1", 600)]
    assert verdict(base, base, require_all_left=True, require_all_right=True) == "PASS"
    assert verdict([*base, base[0]], base) == verdict(base, [*base, base[0]]) == "FAIL"
    assert verdict(base, base[:1]) == "PASS" and verdict(base, base[:1], require_all_left=True) == "FAIL"
    assert verdict(base[:1], base, require_all_right=True) == "FAIL"
    assert verdict([*base, (None, 300)], base) == "FAIL" and verdict([], []) == "PASS"


def test_compare_columns(spark):
    a = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None), ("d", 4.0)], "k string, x double")
    b = spark.createDataFrame([("a", 1.0 + 2.220446049250313e-16), ("b", 2.0), ("c", 3.0), ("e", 4.0)], "k string, x double")
    row = joins.compare_columns(a, b, ["k"], ["x"]).first()
    assert (row["compared"], row["unequal"], row["null_mismatch"], row["only_left"], row["only_right"]) == (3, 2, 1, 1, 1)
    assert row["max_difference"] == 2.220446049250313e-16
    assert rows(joins.unequal_examples(a, b, ["k"], "x", 1)) == [("a", 1)]


def test_distribution(spark):
    """Global values 0, 0.5, 0.5 + 1e-18, 2 with counts 6, 7, 8, 10; a group with 0 and 1; prior 10."""
    values = ["0"] * 6 + ["0.5", "0.500000000000000001", "2", "2"]
    df = spark.createDataFrame([("all", v) for v in values] + [("a", "0"), ("a", "1")], "g string, t string").select("g", F.col("t").cast("decimal(38,18)").alias("v"))
    cdf = ecdf.fit(df, "g", "v")
    asked = spark.createDataFrame([("all", t) for t in ("0.5", "0.500000000000000001", "2", "-1")] + [("a", "0.5"), ("none", "1")], "g string, l string").withColumn("l", F.col("l").cast("decimal(38,18)"))
    got = {(r["g"], float(r["l"])): r["above"] / r["n"] for r in ecdf.as_of(cdf, asked.where("l <> 0.5 OR g = 'a'").union(asked.where("l = 0.5 AND g = 'all'")), "g", "v", "l").collect()}
    assert got[("all", 2.0)] == 0 and got[("all", -1.0)] == 1 and got[("a", 0.5)] == 0.5 and ("none", 1.0) not in got
    exact = ecdf.survival(cdf.where("g = 'all'"), "g", "v", ["0.5", "0.500000000000000001"]).orderBy(F.desc("above"))
    assert [r["above"] / r["n"] for r in exact.collect()] == [0.3, 0.2]
    shares = ecdf.as_of_all(cdf.where("g = 'all'"), asked.select("l").distinct(), "g", "v", "l")
    assert sorted(round(r["share"], 12) for r in shares.collect()) == [0.0, 0.2, 0.3, 0.3, 1.0] or sorted(round(r["share"], 12) for r in shares.collect()) == [0.0, 0.2, 0.2, 0.3, 1.0]
    assert rows(ecdf.check(cdf, "g", "v", df)) == [(0, 0, 12, 12)]
    assert sorted(rows(ecdf.fit_all(df.where("g = 'all'"), "v").select("cum_n"))) == [(6,), (7,), (8,), (10,)]


def test_strict_labels_and_nested_samples(spark):
    totals = ["0", "0.5", "0.500000000000000001", "1", "2", "5", "5.000000000000000001"]
    df = spark.createDataFrame([(t,) for t in [*totals, None]], "t string").withColumn("t", F.col("t").cast("decimal(38,18)"))
    out = folds.expand(df, "t", ["0", "0.5", "1", "2", "5"])
    assert out.where("t IS NOT NULL").agg(F.sum("label")).first()[0] == 6 + 5 + 3 + 2 + 1 and out.where("label IS NULL").count() == 5
    keys = spark.range(2000).selectExpr("id AS entity", "300 * id AS slot")
    small, large = (set(rows(folds.sample(keys, {"entity": 1, "slot": 300}, share))) for share in (100, 1000))
    assert small < large and large == set(rows(folds.sample(keys.orderBy(F.desc("entity")), {"entity": 1, "slot": 300}, 1000)))


def test_thresholds(spark):
    cases = {"true": "NOT_A_NUMBER", "-0.1": "NEGATIVE", "NaN": "NOT_A_NUMBER", "inf": "NOT_A_NUMBER", "0.0000000000000000001": "TOO_MANY_DECIMALS", "1e-19": "TOO_MANY_DECIMALS", "1e20": "TOO_LARGE", "0": None, "-0": None, "0.5": None, "": "NOT_A_NUMBER"}
    df = spark.createDataFrame([(t,) for t in [*cases, None]], "t string")
    assert dict(rows(df.select("t", requests.threshold_problem(F.col("t"))))) == {**cases, None: "NOT_A_NUMBER"}


def test_roles_purge_the_boundary(spark):
    df = spark.createDataFrame([(t,) for t in (0, 999, 1000, 1300, 2000)], "slot long")
    got = [r["role"] for r in folds.roles(df, "slot", 300, [("f", 1300, 2000)]).orderBy("slot").collect()]
    assert got == ["TRAIN", "TRAIN", "EXCLUDED_BOUNDARY", "VALIDATION", "UNUSED"]


def test_areas(spark):
    one = spark.createDataFrame([("m", 0.9, 1.0), ("m", 0.8, 0.0), ("m", 0.7, 1.0), ("m", 0.1, 0.0), ("n", 0.5, 1.0)], "g string, p double, label double")
    got = {r["g"]: (r["roc_area"], r["pr_area"]) for r in ecdf.areas(one, ["g"]).collect()}
    assert got["m"][0] == pytest.approx(0.75) and got["m"][1] == pytest.approx(0.5 * (1 + 1) / 2 + 0.5 * (2 / 3 + 1 / 2) / 2) and got["n"] == (None, None)


def test_selection_prefers_the_simpler_within_tolerance(spark):
    table = spark.createDataFrame([("a", "f1", 0.20005), ("b", "f1", 0.2), ("c", "f1", 0.2)], "model string, protocol string, brier double")
    assert [r["model"] for r in ecdf.select_model(table, ["a", "b", "c"]).where("chosen = 1").collect()] == ["b"]
    assert [r["model"] for r in ecdf.select_model(table, ["a", "b", "c"], 1e-4).where("chosen = 1").collect()] == ["a"]


def test_coverage_of_leap_months_and_distances(spark):
    df = spark.createDataFrame([("a", 1_709_164_800 + 300 * i) for i in range(288)] + [("a", None)], "e string, t long")
    row = coverage.slot_coverage(df, "e", "t", 300).first()
    assert (row["stamps"], row["occupied"], row["expected"], row["slot_collisions"]) == (288, 288, 29 * 288, 0)
    places = spark.createDataFrame([("a", 0.0, 0.0), ("a", 0.0, 90.0), ("b", 1.0, 1.0), ("c", None, 1.0)], "e string, lat double, lon double")
    got = {r["e"]: round(r["km"], 3) for r in coverage.widest_separation(places, "e", "lat", "lon").collect()}
    assert got == {"a": round(6371.0088 * 3.141592653589793 / 2, 3), "b": 0.0}


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, t string")
    path = Scratch(spark, "t").path()
    tables.write_once(df, path)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        tables.write_once(df, path)
    with pytest.raises(ValueError, match="schema drift"):
        tables.read_contract(spark, path, spark.createDataFrame([], "id int, t string").schema)
    assert rows(tables.differences(spark.read.parquet(path), df.distinct())) == [(1, 0, 3)]
    (tmp_path / "bad.csv").write_text("id,t\n1,a\nx,b\n")
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILED_READ_FILE"):
        tables.read_strict_csv(spark, str(tmp_path / "bad.csv"), "id long, t string").collect()
    (tmp_path / "lines.txt").write_text('h,i\n1,"a,b"\nh,i\n\n  \n2,c,d\n3\n4,"x\n')
    lines = spark.read.text(str(tmp_path / "lines.txt"))
    assert rows(tables.line_stats(lines, "h,i")) == [(8, 2, 2)]
    got = {r["value"]: r["r"] for r in lines.select("value", tables.decode_csv(F.col("value"), ["h", "i"]).alias("r")).collect()}
    assert got['1,"a,b"']["i"] == "a,b" and got['1,"a,b"']["_corrupt_record"] is None
    assert got["2,c,d"]["_corrupt_record"] and got["3"]["_corrupt_record"]


def test_guard_of_features():
    models.guard_features(["a"], {"b"})
    with pytest.raises(ValueError):
        models.guard_features(["a", "b"], {"b"})
