"""Facts of the blueprint: small surfaces with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions import classes, grid, scalars
from gridloom.operators import agreement, contract, neighbours, regrid, series, trends

CELL = "lat_idx int, lon_idx int"


def surface(spark, **grids):
    rows = [(d, i, j, v) for d, g in grids.items() for i, r in enumerate(g) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, f"dataset_id string, {CELL}, value double")


def cells(df, *names):
    return {(r["lat_idx"], r["lon_idx"]): tuple(r[n] for n in names) for r in df.collect()}


def close(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, abs_tol=1e-7))


def test_binary_votes_and_pairs(spark):
    s = surface(spark, wad2m=[[1.0, 0.8], [0.1, 0.6]], swamps=[[0.9, 0.2], [0.2, 0.7]], g2017=[[0.6, 0.4], [0.2, 0.8]])
    got = cells(agreement.binary_votes(s), "participant_count", "vote_fraction", "disagreement")
    want = {(0, 0): (3, 1.0, 0.0), (0, 1): (3, 1 / 3, 2 / 3), (1, 0): (3, 0.0, 0.0), (1, 1): (3, 1.0, 0.0)}
    assert all(close(x, y) for k in want for x, y in zip(got[k], want[k], strict=True))
    pairs = {(r["dataset_a"], r["dataset_b"]): r for r in agreement.pair_metrics(s).collect()}
    assert sorted(pairs) == [("g2017", "swamps"), ("g2017", "wad2m"), ("swamps", "wad2m")]
    r = pairs["swamps", "wad2m"]
    assert (r["n_cells"], r["overall_accuracy"], r["f1"]) == (4, 0.75, 0.8)


def test_dispersion_counts_and_exclusions(spark):
    s = surface(spark, a=[[0.8, 0.2], [None, 0.7]], b=[[0.9, 0.8], [None, 0.4]], c=[[0.1, 0.6], [0.3, None]])
    got = cells(agreement.cell_dispersion(s), "mean_value", "std_value", "participant_count")
    want = {(0, 0): (0.6, 0.3559026, 3), (0, 1): (0.5333333333, 0.24944383, 3), (1, 0): (0.3, None, 1), (1, 1): (0.55, 0.15, 2)}
    assert all(close(x, y) for k in want for x, y in zip(got[k], want[k], strict=True))
    one = surface(spark, berkeley_rwawc=[[1.0]], g2017=[[1.0]], glwd_v2=[[1.0]], giems_mc=[[0.0]], swamps=[[1.0]])
    r = agreement.cell_dispersion(one).first()
    assert (r["mean_value"], r["std_value"], r["participant_count"]) == (0.8, 0.5, 2)


def test_landmask(spark):
    s = surface(spark, glwd_v2=[[0.0, None], [0.2, 0.1]], swamps=[[0.7, 0.9], [0.4, 0.3]])
    got = cells(agreement.landmask(s).filter("dataset_id = 'swamps'"), "value")
    assert got == {(0, 0): (0.7,), (0, 1): (None,), (1, 0): (0.4,), (1, 1): (0.3,)}


def votes(spark, **grids):
    return surface(spark, **{d: [[None if v is None else float(v) for v in r] for r in g] for d, g in grids.items()}).withColumn("class_id", F.col("value").cast("int"))


def test_class_agreement_and_entropy(spark):
    v = votes(spark, g=[[1, 2], [2, None]], l=[[1, 1], [2, None]], w=[[2, 1], [2, None]])
    assert cells(agreement.class_agreement(v), "majority_class", "agreement_count") == {(0, 0): (1, 2), (0, 1): (1, 2), (1, 0): (2, 3)}
    e = votes(spark, a=[[0, 2]], b=[[1, 2]], c=[[2, 2]], d=[[3, 2]])
    got = cells(agreement.class_entropy(e, 4), "entropy")
    assert close(got[0, 0][0], 1.0) and got[0, 1][0] == 0.0


def test_vote_entropy_of_three(spark):
    v = votes(spark, a=[[5, 1, 4, 1]], b=[[5, 6, 4, 2]], c=[[5, 3, 6, None]])
    got = cells(agreement.vote_entropy3(v), "entropy", "majority_class", "agreement_count")
    assert got[0, 0] == (0.0, 5, 3) and got[0, 1] == (1.0, 1, 1) and (0, 3) not in got
    assert close(round(got[0, 2][0], 4), 0.5794) and got[0, 2][1:] == (4, 2)


def test_dominant_classes(spark):
    f = spark.createDataFrame([(0, 0, 1, 0.5), (0, 0, 6, 0.5), (0, 1, 3, 0.4), (0, 1, 2, 0.6)], f"{CELL}, class_id int, fraction double")
    assert cells(agreement.dominant_class(f), "dominant_class") == {(0, 0): (1,), (0, 1): (2,)}
    t = spark.createDataFrame([(0, 0, 0, 0.7), (0, 0, 1, 0.2), (0, 0, 3, 0.1), (0, 1, 0, 0.4), (0, 1, 1, 0.6), (0, 1, 3, 0.0)], f"{CELL}, class_id int, fraction double")
    assert cells(agreement.tiered_dominant_class(t), "dominant_class") == {(0, 0): (3,), (0, 1): (1,)}


def test_temporal_mode_and_crosswalk(spark):
    c = spark.createDataFrame([("gwd30", 0, 0, k) for k in (8, 8, 10)], f"dataset_id string, {CELL}, class_id int")
    m = agreement.temporal_mode(c).withColumnRenamed("mode_class", "class_id")
    assert classes.mapped(m, "fine4").first()["target_class"] == 2
    assert {t: sorted(r[1] for r in classes.CROSSWALK_ROWS if r[0] == "gwd30" and r[2] == t) for t in (1, 7, 2)} == {1: [1, 2, 3, 4, 5, 6, 14], 7: [7], 2: [8]}
    assert classes.mapped(c.withColumn("class_id", F.lit(99)), "fine4").first()["target_class"] is None


def test_unified_fractions(spark):
    rows = [("gwd30", 0, 0, 8, f) for f in (0.7, 0.5)] + [("gwd30", 0, 0, 9, f) for f in (0.1, 0.3)] + [("gwd30", 0, 1, 8, 0.0), ("gwd30", 0, 2, 8, None)]
    f = series.unified_fractions(spark.createDataFrame(rows, f"dataset_id string, {CELL}, class_id int, fraction double"))
    got = {(r["lon_idx"], r["class_id"]): r["fraction"] for r in f.collect()}
    assert close(got[0, 2], 0.6) and close(got[0, 3], 0.2) and got[1, 2] is None and got[2, 2] is None


def test_regional_series(spark):
    rows = [("d", "r", "2020-01-01", 0, 0, 0.2, 1.0), ("d", "r", "2020-01-01", 0, 1, 0.8, 0.5), ("d", "r", "2020-02-01", 0, 0, 0.4, 1.0), ("d", "r", "2020-02-01", 0, 1, None, 0.5)]
    c = spark.createDataFrame(rows, f"dataset_id string, region_id string, ts string, {CELL}, value double, weight double").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((str(r["month"]), r["wetland_percentage"]) for r in series.regional_monthly(c, "weight").collect())
    assert [m for m, _ in got] == ["2020-01-01", "2020-02-01"] and all(close(p, 40.0) for _, p in got)
    monthly = spark.createDataFrame([("d", "r", f"{y}-{m:02d}-01", float(m)) for y in (2020, 2021) for m in range(1, 13) if (y, m) != (2021, 5)], "dataset_id string, region_id string, month string, value double").withColumn("month", F.col("month").cast("date"))
    assert [(r["year"], r["value"], r["observation_count"]) for r in series.complete_years(monthly).collect()] == [(2020, 6.5, 12)]
    assert series.climatology(monthly).count() == 12


def one_series(spark, values):
    return spark.createDataFrame([("d", 0, 0, 2000 + i, v) for i, v in enumerate(values)], f"dataset_id string, {CELL}, year int, value double")


@pytest.mark.parametrize(
    ("values", "want"),
    [([0.1, 0.3, 0.5, 0.7, 0.9], (1, 2 / 120)), ([0.9, 0.7, 0.5, 0.3, 0.1], (-1, 2 / 120)), ([0.5] * 20, (0, 1.0)), ([None, None, 1.0, 2.0, 3.0], (0, 1.0))],
)
def test_mann_kendall(spark, values, want):
    r = trends.pixel_trends(one_series(spark, values)).first()
    assert r["status"] == "computed" and r["trend_direction"] == want[0] and close(r["p_value"], want[1])
    assert (r["sens_slope"] is None) == (values[0] is None)


def test_too_few_steps(spark):
    r = trends.pixel_trends(one_series(spark, [1.0, 2.0, 3.0])).first()
    assert (r["status"], r["sens_slope"], r["significant"], r["trend_direction"]) == ("insufficient_observations", None, False, 0)


def test_exact_p_counts_orders():
    assert trends.inversion_counts(4) == [1, 3, 5, 6, 5, 3, 1]
    assert sum(trends.inversion_counts(7)) == math.factorial(7)
    assert trends.kendall_p(4, 5, [2]) < 1
    assert close(trends.kendall_p(40, 780, []), 2 / math.factorial(40)) and close(trends.kendall_p(40, 778, []), 2 / math.factorial(39))


def test_sen_matches_the_test(spark):
    s = one_series(spark, [1.0, None, 3.0, 2.0, 5.0, 4.5])
    a, b = trends.sen_kendall(s).first(), trends.pixel_trends(s).first()
    assert close(a["sens_slope"], b["sens_slope"]) and a["n_obs"] == 5


def test_agreement_of_trends(spark):
    rows = [("a", 0, 0, 1, 0.1), ("b", 0, 0, 1, 0.2), ("c", 0, 0, 1, 0.3), ("a", 0, 1, 1, 1.0), ("b", 0, 1, -1, -1.0), ("c", 0, 1, 0, None), ("a", 1, 0, 0, 0.0), ("b", 1, 0, 0, 0.0), ("c", 1, 0, 0, 0.0)]
    made = spark.createDataFrame(rows, f"dataset_id string, {CELL}, trend_direction int, sens_slope double").withColumn("status", F.lit("computed"))
    got = cells(trends.trend_agreement(made, 3), "agreement_ratio", "robust_increase", "robust_stable", "disputed", "mean_slope", "slope_std")
    assert {k: v[:4] for k, v in got.items()} == {(0, 0): (1.0, True, False, False), (0, 1): (1 / 3, False, False, True), (1, 0): (1.0, False, True, False)}
    assert close(got[0, 0][4], 0.2) and close(got[0, 0][5], math.sqrt(0.02 / 3)) and close(got[0, 1][5], 1.0)
    spans = lambda stop: spark.createDataFrame([("a", "2000-01-01", stop), ("b", "2001-01-01", "2015-01-01")], "dataset_id string, start string, stop string").select("dataset_id", *[F.col(c).cast("date").alias(c) for c in ("start", "stop")])
    agreed, window = trends.gated_agreement(made, spans("2010-01-01"))
    assert agreed.count() == 3 and window.first()["status"] == "computed"
    agreed, window = trends.gated_agreement(made, spans("2003-01-01"))
    assert agreed.count() == 0 and window.first()["status"] == "overlap_window_empty"


def test_overlap(spark):
    make = lambda *r: trends.overlap_window(spark.createDataFrame(r, "start string, stop string").select(F.col("start").cast("date"), F.col("stop").cast("date"))).first()
    r = make(("2000-01-01", "2010-12-31"), ("2003-01-01", "2015-12-31"))
    assert (str(r["overlap_start"]), str(r["overlap_end"]), r["status"]) == ("2003-01-01", "2010-12-31", "computed")
    assert make(("2000-01-01", "2004-06-30"), ("2003-01-01", "2015-12-31"))["status"] == "overlap_window_empty"


def test_year_over_year_needs_the_year_before(spark):
    s = one_series(spark, [1.0, 2.0, None, 1.0]).filter("year <> 2001")
    got = {r["year"]: (r["delta"], r["direction"]) for r in trends.year_over_year(s).collect()}
    assert got == {2000: (None, 0), 2002: (None, 0), 2003: (None, 0)}


def test_local_maximum_and_box(spark):
    s = surface(spark, a=[[0.1, 0.9], [0.4, 0.6]]).drop("dataset_id")
    assert cells(neighbours.local_maxima(s), "value") == {(0, 1): (0.9,)}
    assert all(close(v[0], 2.0) and v[1] == 4 for v in cells(neighbours.box(s, 1), "box_sum", "box_count").values())


def test_components(spark):
    s = spark.createDataFrame([("g", 0, 0), ("g", 0, 1), ("g", 1, 1), ("g", 3, 0), ("g", 2, 1), ("g", 4, 4), ("h", 0, 0)], f"region_id string, {CELL}")
    got = {(r["region_id"], r["lat_idx"], r["lon_idx"]): (r["seed_lat_idx"], r["seed_lon_idx"]) for r in neighbours.components(s, ("region_id",)).collect()}
    assert got["g", 2, 1] == (0, 0) and got["g", 3, 0] == (3, 0) and got["g", 4, 4] == (4, 4) and got["h", 0, 0] == (0, 0)


def test_spacing_keeps_its_distance(spark):
    pts = spark.createDataFrame([("r", 1.0 - i / 100, float(i % 7), float(i // 7)) for i in range(49)], "region_id string, score double, lat double, lon double")
    got = [(r["lat"], r["lon"]) for r in neighbours.spaced(pts, "region_id", ["score", "lat", "lon"], 2.0, 10).collect()]
    assert (0.0, 0.0) in got and all(math.hypot(a - c, b - d) >= 2 for i, (a, b) in enumerate(got) for c, d in got[:i])


def test_quotas(spark):
    r = spark.createDataFrame([("a", 1, 4.0), ("b", 2, 2.0), ("c", 3, 1.0)], "region_id string, ord int, area double")
    assert {x["region_id"]: x["quota"] for x in neighbours.hamilton_quotas(r, 10).collect()} == {"a": 5, "b": 3, "c": 2}


def test_box_around_stays_on_the_globe(spark):
    b = spark.range(1).select(grid.box_around(F.lit(89.9), F.lit(179.9), 0.5).alias("b")).first()["b"]
    assert all(close(x, y) for x, y in zip(b, (179.65, 89.65, 180.0, 90.0), strict=True))


def test_first_region_wins(spark):
    boxes = [("brazil", -75.0, -35.0, -34.0, 6.0), ("indonesia", 95.0, -11.0, 141.0, 6.0), ("southeast_asia", 90.0, -11.0, 130.0, 24.0)]
    p = spark.createDataFrame([(-4.5, -60.5), (0.5, 110.5), (20.0, 100.0), (50.0, 0.0)], "lat double, lon double")
    assert [r["region_id"] for r in grid.first_region(p, boxes).orderBy("lat").collect()] == ["brazil", "indonesia", "southeast_asia", "other"]


def test_ensembles(spark):
    rows = [("a", "x", 0, 0, 0.2), ("a", "y", 0, 0, 0.4), ("b", "x", 0, 0, 0.9)]
    m = spark.createDataFrame(rows, f"config string, forcing string, {CELL}, value double")
    assert close(series.ensemble_joint(m, ["lat_idx"]).first()["value"], 0.5)
    assert close(series.ensemble_two_step(m, ["lat_idx"], "config", "forcing").first()["value"], (0.55 + 0.4) / 2)


def test_ledger_ranks_and_ids(spark):
    make = lambda n: spark.createDataFrame([("r", i + 1, 1.0 / (i + 1), 0, i) for i in range(n)], f"region_id string, hotspot_rank int, score double, {CELL}")
    made = contract.ledger({"percentage": make(2), "classification": make(1), "trend": make(2)}).orderBy("family_order", "hotspot_rank").collect()
    assert [r["rank_percentile"] for r in made] == [1.0, 0.0, 1.0, 1.0, 0.0]
    assert made[0]["analysis_object_id"] == "per-r-obs-001" and len({r["analysis_object_id"] for r in made}) == 5


def test_stems():
    assert contract.stem("gwd30+wad2m", "amazon", "trend_hotspot_manifest") == "gwd30+wad2m__amazon__trend_hotspot_manifest"
    with pytest.raises(ValueError, match="part of a name"):
        contract.stem("a__b", "r", "s")


def test_dataset_key_and_tokens(spark):
    r = spark.range(1).select(
        scalars.dataset_key(F.array(F.lit("wad2m"), F.lit("gwd30"), F.lit("wad2m"))).alias("key"),
        scalars.year_month_token(F.lit("x_2019-07.nc")).alias("month"),
        scalars.year_month_token(F.lit("x_2019-17.nc")).alias("none"),
        scalars.tile_code_token(F.lit("GWD_48PXS_2016.tif")).alias("tile"),
        scalars.normal_dataset_id(F.lit("GWD30_2016")).alias("id"),
    ).first()
    assert (r["key"], str(r["month"]), r["none"], r["tile"], r["id"]) == ("gwd30+wad2m", "2019-07-01", None, "48PXS", "gwd30")


def test_grid_and_area(spark):
    g = grid.lattice(spark, 100.0, -1.0, 101.0, 1.0, 0.5)
    assert g.count() == 8 and g.agg(F.max("lat")).first()[0] == 1.0
    total = spark.range(1).select(grid.cell_area_km2(F.lit(-90.0), F.lit(90.0), F.lit(-180.0), F.lit(180.0))).first()[0]
    assert math.isclose(total, 4 * math.pi * 6371.0088**2, rel_tol=1e-12)


def test_missing_source_counts_in_class_fractions(spark):
    axis = spark.createDataFrame([(0, 0.0, 1.0), (1, 1.0, 2.0)], "idx int, low double, high double")
    one = spark.createDataFrame([(0, 0.0, 2.0)], "idx int, low double, high double")
    w = regrid.overlap_weights(axis, one)
    c = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 0, 2), (1, 1, None)], f"{CELL}, class_id int")
    share = lambda m: {r["class_id"]: r["fraction"] for r in regrid.class_fractions(c, w, w, missing_counts=m).collect()}
    assert share(True) == {1: 0.5, 2: 0.25} and close(share(False)[1], 2 / 3)


def test_nan_is_missing(spark):
    s = scalars.nan_to_null(spark.createDataFrame([(float("nan"),), (2.0,)], "value double"))
    assert s.agg(F.avg("value")).first()[0] == 2.0
    assert spark.range(1).select(scalars.clip(F.lit(None).cast("double")).alias("c")).first()["c"] is None
