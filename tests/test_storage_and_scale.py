"""Stored tables and operators that large groups depend on: plans, files and results held against plain versions."""

import os
import random
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from slotgrid.grid import GridSpec
from slotgrid.operators import collide, ecdf, hash_tree, leaf_model, quantiles, records, requests, separation, windows
from slotgrid.sources import buckets, observed, periods, tables, text_files
from slotgrid.sources.shared import Scratch

SPEC = GridSpec(step=300, history=4, future=2)


def rows(df):
    return [tuple(r) for r in df.collect()]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files(path):
    found = {}
    for top, _, names in os.walk(path.removeprefix("file://")):
        for name in names:
            if name.endswith(".parquet"):
                found[os.path.relpath(os.path.join(top, name), path.removeprefix("file://"))] = os.stat(os.path.join(top, name)).st_mtime_ns
    return found


def grid(spark, n=6_000):
    return spark.range(n).selectExpr("CAST(id % 3 AS STRING) AS entity", "1704067200 + 300 * (id DIV 3 + (id DIV 400) % 5) AS slot", "CAST(id % 7 AS DECIMAL(18,2)) AS v").dropDuplicates(["entity", "slot"])


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_running_sums_keep_every_row(spark, adaptive):
    """400,000 rows with further columns on 8 partitions, written and read again, as the sums over all of them want."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        df = spark.range(400_000).selectExpr("id", "CAST(id * 7919 % 100003 AS INT) AS o", "id % 11 AS k", "CAST(id AS STRING) AS more", "id % 5 AS k2")
        out = Scratch(spark, "t").keep(ecdf.running(df, ["o"], "k"))
        got = out.select("id", "o", "k", "running").toPandas().sort_values("o", kind="stable")
        assert len(got) == 400_000 and got.id.nunique() == 400_000
        want = got.groupby("o").k.sum().cumsum()
        assert (got.running.to_numpy() == want.loc[got.o].to_numpy()).all()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert ecdf.running(df.limit(0), ["o"], "k").count() == 0


def test_exponents_beyond_an_int(spark):
    df = spark.createDataFrame([(t,) for t in ("1e99999999999", "1e-99999999999", "0e99999999999", "1e2147483647", "1e-2147483647", "1e2")], "t string")
    shape = records.decimal_shape(F.col("t"))
    got = {r["t"]: r for r in df.select("t", shape["exponent"].alias("e"), shape["fits"].alias("f"), requests.threshold_problem(F.col("t")).alias("p")).collect()}
    assert all(got[t]["e"] is None and got[t]["f"] is False and got[t]["p"] == "BAD_EXPONENT" for t in ("1e99999999999", "1e-99999999999", "0e99999999999"))
    assert (got["1e2147483647"]["p"], got["1e-2147483647"]["p"], got["1e2"]["p"], got["1e2"]["f"]) == ("TOO_LARGE", "TOO_MANY_DECIMALS", None, True)


def test_rows_with_a_null_key_collide(spark):
    data = [(1, None, 300, "1", "a"), (2, None, 300, "1", "b"), (3, None, 600, "1", "a"), (4, "S", None, "1", "a"), (5, "S", None, "2", "a"), (6, "S", 300, None, "a"), (7, "S", 300, "1", "a")]
    df = spark.createDataFrame(data, "id long, station string, slot long, v string, name string")
    got = {r["id"]: (r["disposition"], r["collision_rank"], r["retained_id"], r["metadata_variants"]) for r in collide.resolve(df, ["station", "slot"], "v", ["name"], ["id"], "id").collect()}
    assert got == {1: ("kept", 1, 1, 2), 2: ("merged", 2, 1, 2), 3: ("unique", 1, 3, 1), 4: ("quarantined", 1, 4, 1), 5: ("quarantined", 2, 4, 1), 6: ("kept", 1, 6, 1), 7: ("merged", 2, 6, 1)}


def test_ledger_of_the_job_that_writes(spark):
    df = grid(spark).selectExpr("CAST(slot AS STRING) || entity AS id", "entity", "slot - slot % 900 AS slot", "v", "'x' AS name")
    done = Scratch(spark, "t").keep(collide.resolve(df, ["entity", "slot"], "v", ["name"], ["id"], "id"))
    path = Scratch(spark, "t").path()
    row = collide.with_balance(observed.write_observed(done, path, collide.balance_measures(F.col("v")), ["disposition"]))
    want = collide.balance(done, F.col("v"))
    assert row.schema == want.schema and rows(row) == rows(want)
    back = spark.read.parquet(path)
    assert dict(rows(back.groupBy("disposition").count())) == dict(rows(done.groupBy("disposition").count()))
    checked = observed.written_rows(done, Scratch(spark, "t").path(), ["disposition"], {"dear": F.col("v") < 5, "unknown": F.lit(None).cast("boolean")})
    assert rows(checked) == [(done.count(), done.where("v >= 5").count(), done.count())]


def test_ledger_of_an_empty_table(spark):
    """No rows, known before or only after reading, give counts of 0."""
    kept = Scratch(spark, "t").keep(spark.range(5).selectExpr("id", "id % 2 AS p"))
    for df in (kept.limit(0), kept.where("id > 100"), spark.createDataFrame([], "id long, p long")):
        assert rows(observed.written_rows(df, Scratch(spark, "t").path(), ["p"], {"a": F.col("id") > 1})) == [(0, 0)]


def test_periods_are_pruned_and_rewritten_alone(spark):
    path, df = Scratch(spark, "t").path(), grid(spark)
    periods.write_periods(df, path, "slot", "day", most_rows=100)
    start, stop = 1_704_067_200 + 2 * 86_400, 1_704_067_200 + 3 * 86_400
    part = periods.padded_period(spark, path, "day", SPEC, start, stop, windows.targets)
    assert "PartitionFilters: [isnotnull(period" in plan(part) and "2024-01-02" in plan(part) and "2024-01-04" in plan(part)
    whole = windows.targets(df, SPEC).where(F.col("slot").between(start, stop - 1))
    assert rows(tables.differences(whole, part.select(whole.columns)))[0][:2] == (0, 0) and part.count() > 0
    assert all(n <= 100 for (n,) in rows(spark.read.parquet(path).groupBy(F.input_file_name()).count().select("count")))

    before = files(path)
    again = Scratch(spark, "t").keep(periods.read_periods(spark, path, "day", start, stop).drop("period").withColumn("v", (F.col("v") + 1).cast("decimal(18,2)")))
    periods.write_periods(again, path, "slot", "day", replace=True)
    after = files(path)
    assert {f: t for f, t in before.items() if "2024-01-03" not in f} == {f: t for f, t in after.items() if "2024-01-03" not in f}
    assert not {f for f in before if "2024-01-03" in f} & set(after)
    want = df.withColumn("v", F.when(F.col("slot").between(start, stop - 1), F.col("v") + 1).otherwise(F.col("v")).cast("decimal(18,2)"))
    assert rows(tables.differences(want, spark.read.parquet(path).select(df.columns)))[0][:2] == (0, 0)


def test_bucketed_tables_join_without_an_exchange(spark):
    df, scratch, keys = grid(spark), Scratch(spark, "t"), ["entity", "slot"]
    left = buckets.write_bucketed(df, scratch.path(), keys, 4)
    right = buckets.write_bucketed(df.select(*keys, (F.col("v") * 2).alias("w")), scratch.path(), keys, 4)
    out = buckets.whole_join(left, right, keys)
    assert "Exchange" not in plan(out) and "SortMergeJoin" in plan(out)
    assert out.where("w = 2 * v").count() == df.count()
    for bad in (df.where("v > 0"), df.union(df.limit(1))):
        with pytest.raises(ValueError, match="the join gives"):
            buckets.whole_join(left, buckets.write_bucketed(bad.select(*keys, F.col("v").alias("w")), scratch.path(), keys, 4), keys)


@pytest.mark.parametrize("limit", [quantiles.BROADCAST_ROWS, 0])
def test_exact_quantiles_of_a_hot_group(spark, monkeypatch, limit):
    monkeypatch.setattr(quantiles, "BROADCAST_ROWS", limit)
    rng = np.random.default_rng(3)
    data = [("hot", float(x)) for x in np.concatenate([rng.lognormal(0, 8, 6_000), np.full(4_000, 2.5), [-1e300, 1e300]])]
    data += [(f"g{i % 40}", float(x)) for i, x in enumerate(rng.integers(0, 50, 8_000))] + [(None, 1.0), (None, 2.0), ("one", -0.5), ("none", None), ("none", float("nan"))]
    df = spark.createDataFrame(data, "g string, x double")
    asked = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {(r["g"], r["quantile"]): (r["n"], r["value"]) for r in quantiles.exact(df, ["g"], "x", asked, few=50).collect()}
    groups = {}
    for g, x in data:
        if x is not None and x == x:
            groups.setdefault(g, []).append(x)
    con = duckdb.connect()
    for g, values in groups.items():
        want = con.execute("SELECT quantile_cont(x, ?) FROM (SELECT unnest(?) AS x)", [asked, values]).fetchone()[0]
        for q, w in zip(asked, want):
            assert got[g, q][0] == len(values) and got[g, q][1] == pytest.approx(w, rel=1e-12)
    assert len(got) == len(groups) * len(asked)
    assert quantiles.exact(df.limit(0), ["g"], "x", asked).count() == 0


def test_sketches_merge_over_periods(spark):
    df = spark.range(60_000).selectExpr("id % 3 AS g", "id % 30 AS day", "CASE WHEN id % 1000 = 0 THEN NULL WHEN id % 1000 = 1 THEN CAST('NaN' AS DOUBLE) ELSE CAST(id * 7919 % 60013 AS DOUBLE) END AS x")
    days = Scratch(spark, "t").keep(quantiles.sketches(df, ["g", "day"], "x"))
    found = quantiles.of_sketches(quantiles.merged(days, ["g"]), ["g"], [0.0, 0.1, 0.5, 0.99, 1.0])
    errors = quantiles.rank_errors(df, found, ["g"], "x").collect()
    assert len(errors) == 15 and max(r["rank_error"] for r in errors) < 0.005
    assert sum(r["n"] for r in errors) == 5 * (60_000 - 120)
    wrong = found.withColumn("value", F.col("value") + 6_000)
    assert max(r["rank_error"] for r in quantiles.rank_errors(df, wrong.where("quantile = 0.5"), ["g"], "x").collect()) > 0.05


def brute_km(lat, lon):
    phi, lam = np.radians(lat), np.radians(lon)
    p = np.stack([np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi)], 1)
    best = 0.0
    for i in range(0, len(p), 2_000):
        d = p[i : i + 2_000, None, :] - p[None, :, :] if len(p) < 3_000 else None
        best = max(best, float((d**2).sum(2).max()) if d is not None else float((2 - 2 * (p[i : i + 2_000] @ p.T)).max()))
    return 2 * separation.RADIUS_KM * np.arcsin(min(1.0, best**0.5 / 2))


@pytest.mark.parametrize("pairs", [separation.ALL_PAIRS, 0])
def test_widest_separation_of_many_places(spark, monkeypatch, pairs):
    """100,000 places of one entity in a disc, two distant swarms, a great circle, a triangle, all of the globe, one place and two."""
    monkeypatch.setattr(separation, "ALL_PAIRS", pairs)
    rng = np.random.default_rng(5)
    shapes = {
        "disc": (1.3 + rng.normal(0, 0.1, 100_000), 103.8 + rng.normal(0, 0.1, 100_000)),
        "swarms": (np.concatenate([10 + rng.normal(0, 0.001, 700), -20 + rng.normal(0, 0.001, 700)]), np.concatenate([20 + rng.normal(0, 0.001, 700), 60 + rng.normal(0, 0.001, 700)])),
        "equator": (np.zeros(900), np.linspace(0, 170, 900)),
        "triangle": (np.array([0, 0, 8.66, 3.0]), np.array([-5, 5, 0.0, 0.1])),
        "globe": (np.degrees(np.arcsin(rng.uniform(-1, 1, 2_000))), rng.uniform(-180, 180, 2_000)),
        "one": (np.array([4.0, 4.0]), np.array([5.0, 5.0])),
        "two": (np.array([4.0, 4.0]), np.array([5.0, 5.00001])),
    }
    import pandas as pd

    frame = pd.concat([pd.DataFrame({"e": e, "lat": a, "lon": b}) for e, (a, b) in shapes.items()] + [pd.DataFrame({"e": ["none"], "lat": [float("nan")], "lon": [1.0]})]).replace({float("nan"): None})
    out = {r["e"]: (r["places"], r["km"]) for r in separation.widest_separation(spark.createDataFrame(frame, "e string, lat double, lon double"), "e", "lat", "lon").collect()}
    assert set(out) == set(shapes)
    for e, (lat, lon) in shapes.items():
        assert out[e][0] == len(set(zip(lat, lon))) and out[e][1] == pytest.approx(brute_km(lat, lon), rel=1e-7, abs=1e-4), e


def test_hash_trees_find_few_rows(spark):
    df = spark.range(50_000).selectExpr("id", "CAST(id % 97 AS STRING) AS t", "CAST(id AS DECIMAL(12,2)) AS v")
    other = df.where("id <> 123").withColumn("t", F.when(F.col("id") == 40_000, "changed").otherwise(F.col("t"))).union(df.where("id = 9"))
    scratch = Scratch(spark, "t")
    paths = [scratch.path() for _ in range(3)]
    for frame, path in zip((df, other, df.orderBy(F.desc("id"))), paths):
        hash_tree.write_hashed(frame, path, ["id"], folders_at=1)
    leaves = hash_tree.differing_leaves(spark, paths[0], paths[1])
    assert 1 <= leaves.count() <= 3
    out = hash_tree.differences(spark, paths[0], paths[1], folders_at=1)
    assert sorted((r["side"], r["id"], r["t"]) for r in out.collect()) == [("left", 123, "26"), ("left", 40_000, "36"), ("right", 9, "9"), ("right", 40_000, "changed")]
    assert "PartitionFilters: [_folder" in plan(out) or "PartitionFilters: [isnotnull(_folder" in plan(out)
    assert hash_tree.differences(spark, paths[0], paths[2], folders_at=1).count() == 0
    tree = spark.read.parquet(f"{paths[0]}/{hash_tree.TREE}")
    assert all(n == 50_000 for (n,) in rows(tree.groupBy("level").agg(F.sum("n").alias("n")).select("n")))


def test_stored_leaf_model(spark):
    rng = random.Random(4)
    data = [("s%d" % (i % 5), 300 * (i // 5), Decimal(str(rng.choice([0, 0, 1, 2, 5])))) for i in range(4_000)]
    frame = spark.createDataFrame(data, "entity string, slot long, v decimal(18,2)").where("entity <> 's1' OR slot % 6000 <> 0")
    anchors = Scratch(spark, "t").keep(windows.features(windows.targets(frame, SPEC), SPEC))
    features, path = ["sum_2", "sum_all", "max_all"], Scratch(spark, "t").path()
    train = anchors.where("target_valid AND history_valid")
    with pytest.raises(ValueError, match="know the future"):
        leaf_model.fit_and_save(train, [*features, "future_n"], "future_total", SPEC, path, prior=10)
    leaf_model.fit_and_save(train, features, "future_total", SPEC, path, prior=10)
    for wrong in (dict(features=features[::-1], spec=SPEC), dict(features=features, spec=GridSpec(step=300, history=5, future=2))):
        with pytest.raises(ValueError, match="does not fit"):
            leaf_model.load(spark, path, **wrong)
    model = leaf_model.load(spark, path, features, SPEC)
    asked = spark.createDataFrame([(1, "s0", 1_500, "1.5"), (2, "s0", 3_000, "0"), (3, "s1", 6_000, "1"), (4, "s9", 1_500, "1"), (5, "s0", 1_501, "1"), (6, "s0", 1_500, "-1"), (7, "s0", 0, "1"), (8, "s2", 9_000, "1e99999999999")], "id int, entity string, epoch long, threshold string")
    got = {r["id"]: (r["reject_reason"], r["p"]) for r in model.answer(asked, anchors).collect()}
    assert {i: r for i, (r, _) in got.items() if r} == {3: "INCOMPLETE_HISTORY", 4: "UNKNOWN_ENTITY", 5: "OFF_GRID", 6: "BAD_THRESHOLD", 7: "INCOMPLETE_HISTORY", 8: "BAD_THRESHOLD"}
    placed = model.grouped(train).select("entity", "slot", "leaf", "future_total").collect()
    assert len({r["leaf"] for r in placed}) > 2
    for i, slot, level in ((1, 1_500, Decimal("1.5")), (2, 3_000, Decimal(0))):
        leaf = next(r["leaf"] for r in model.grouped(anchors.where(f"entity = 's0' AND slot = {slot}")).collect())
        own = [r["future_total"] > level for r in placed if r["leaf"] == leaf]
        share = sum(r["future_total"] > level for r in placed) / len(placed)
        assert got[i][1] == pytest.approx((sum(own) + 10 * share) / (len(own) + 10))
    spark.read.parquet(f"{path}/distribution").limit(3).write.mode("overwrite").parquet(f"{path}/distribution2")
    os.rename(f"{path}/distribution".removeprefix("file://"), f"{path}/distribution1".removeprefix("file://"))
    os.rename(f"{path}/distribution2".removeprefix("file://"), f"{path}/distribution".removeprefix("file://"))
    with pytest.raises(ValueError, match="not the one"):
        leaf_model.load(spark, path, features, SPEC)


def test_records_of_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text('id,t\n1,plain\n2,"two\nlines, one comma"\n3,"broken\n' + "".join(f"{i},x\n" for i in range(4, 16)) + '16,"say ""hi"""\nid,t\n   \n17,"id,t\n\nlast"\n18,a,b\n19,"open at the end\n')
    (tmp_path / "b.txt").write_text("id,t\n1,other\n")
    got = {(r["file"][-5:], r["line_no"]): r for r in text_files.read_records(spark, str(tmp_path), "id,t", ["id", "t"], Scratch(spark, "t")).collect()}
    lines = {k[1]: r for k, r in got.items() if k[0] == "a.txt"}
    assert lines[3]["n_lines"] == 2 and lines[3]["row"]["t"] == "two\nlines, one comma" and not lines[3]["odd_quote"]
    assert lines[5]["odd_quote"] and lines[5]["n_lines"] == 1 and lines[6]["row"]["id"] == "4"
    assert lines[18]["row"]["t"] == 'say "hi"' and lines[21]["n_lines"] == 3 and lines[21]["row"]["t"] == "id,t\n\nlast"
    assert lines[24]["row"]["_corrupt_record"] and lines[25]["odd_quote"] and ("b.txt", 2) in got
    assert sorted(lines) == [2, 3, *range(5, 19), 21, 24, 25]
    numbered = text_files.file_lines(spark, str(tmp_path), Scratch(spark, "t"))
    assert [r["line_no"] for r in numbered.where("file LIKE '%a.txt'").orderBy("line_no").collect()] == list(range(1, 26))


def test_line_numbers_over_many_splits(spark, tmp_path):
    (tmp_path / "long.txt").write_text("".join(f"{i},{'y' * (i % 50)}\n" for i in range(1, 20_001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        out = text_files.file_lines(spark, str(tmp_path), Scratch(spark, "t"))
        assert out.where(F.split("line", ",")[0].cast("long") == F.col("line_no")).count() == out.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
