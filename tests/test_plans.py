"""Pipelines, artefacts, tiles, imagery arithmetic and UTM codes."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions import imagery, tiling
from gridloom.operators import tiles
from gridloom.plans import pipelines
from gridloom.schema import ContractError
from gridloom.sources import artefacts
from gridloom.sources.driver_tables import REGIONS, regions
from tests.test_golden import cells, surface


def test_rough_pipeline(spark):
    s = surface(spark, wad2m=[[1.0, 0.8], [0.1, 0.6]], swamps=[[0.9, 0.2], [0.2, 0.7]], g2017=[[0.6, 0.4], [0.2, 0.8]], berkeley_rwawc=[[1.0, 1.0], [1.0, 1.0]], topmodel=[[None, None], [None, None]])
    r = pipelines.rough(s.withColumns({"lat": 17.5 - 5 * F.col("lat_idx"), "lon": 102.5 + 5 * F.col("lon_idx")}), [x[0:1] + x[2:] for x in REGIONS])
    assert {x["dataset_id"]: x["status"] for x in r.statuses.collect()} == {"wad2m": "participating", "swamps": "participating", "g2017": "participating", "berkeley_rwawc": "skipped_not_eligible", "topmodel": "failed_empty_harmonized_surface"}
    assert r.pairs.count() == 3 and cells(r.cells, "participant_count")[0, 0] == (3,)
    assert [(x["lat_idx"], x["lon_idx"]) for x in r.focus().collect()] == [(0, 1)]


def test_classification_pipeline(spark):
    rows = [("gwd30", 0, 0, 8, 1.0), ("g2017", 0, 0, 80, 1.0), ("glwd_v2", 0, 0, 9, 1.0), ("gwd30", 0, 1, 8, 1.0), ("g2017", 0, 1, 10, 1.0), ("glwd_v2", 0, 1, 9, 1.0), ("gwd30", 0, 2, 8, 1.0)]
    _, e = pipelines.classification(spark.createDataFrame(rows, "dataset_id string, lat_idx int, lon_idx int, class_id int, fraction double"))
    got = cells(e, "entropy", "majority_class", "agreement_count")
    assert got[0, 0] == (0.0, 2, 3) and got[0, 1][1:] == (2, 2) and (0, 2) not in got


def test_regional_and_trend_pipelines(spark):
    rows = [("d", f"{2000 + y}-{m:02d}-01", 0, 0, 17.5, 102.5, y / 10) for y in range(6) for m in range(1, 13)]
    c = spark.createDataFrame(rows, "dataset_id string, ts string, lat_idx int, lon_idx int, lat double, lon double, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    made = pipelines.regional(c, regions(spark), 5.0).groupBy("series_type", "region_id").count().collect()
    assert {(r["series_type"], r["region_id"]): r["count"] for r in made} == {("monthly", "north_west"): 72, ("annual", "north_west"): 6, ("climatology", "north_west"): 12}
    tested, agreed, window = pipelines.trend(c, 1)
    assert tested.first()["trend_direction"] == 1 and agreed.first()["robust_increase"] and window.first()["status"] == "computed"


def test_artefacts(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int")
    artefacts.write(df, str(tmp_path), "percentage_hotspot_table", "amazon", "gwd30", unique=("id",), year="2016")
    assert artefacts.read(spark, str(tmp_path), "percentage_hotspot_table", "amazon", "gwd30", year="2016").count() == 2
    with pytest.raises(ContractError, match="identity"):
        artefacts.read(spark, str(tmp_path), "percentage_hotspot_table", "amazon", "gwd30", year="2017")
    assert artefacts.status(spark, str(tmp_path), "percentage_hotspot_table", "amazon", "gwd30") == "ready"
    assert artefacts.status(spark, str(tmp_path), "percentage_hotspot_table", "congo", "gwd30") == "missing"
    m = artefacts.manifest(spark, str(tmp_path), "percentage_hotspot_table", "amazon", "gwd30")
    spark.createDataFrame([("c", 3)], df.schema).write.mode("append").parquet(m["rows"])
    assert artefacts.status(spark, str(tmp_path), "percentage_hotspot_table", "amazon", "gwd30") == "partial"
    with pytest.raises(ContractError):
        artefacts.write(df.union(df), str(tmp_path), "x", "amazon", "gwd30", unique=("id",))


def test_tiles(spark):
    arrays = spark.createDataFrame([("t", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])], "tile_id string, v array<double>")
    flat = tiles.unrolled(arrays, ["tile_id"], "v", 3)
    assert {(r["lat_idx"], r["lon_idx"]): r["value"] for r in flat.collect()}[1, 2] == 6.0
    made = tiles.transform_tiles(flat, "tile_id", lambda p: pd.DataFrame({"tile_id": p.tile_id[:1], "total": [p.value.sum()]}), "tile_id string, total double", "total", 2).first()
    assert (made["total"], made["transform_name"], made["transform_version"]) == (21.0, "total", 2)
    px = spark.createDataFrame([("t", y, x, b, c) for y in range(2) for x in range(2) for b, c in enumerate((8, 0 if x else 8))], "tile_id string, pixel_y int, pixel_x int, band int, class_id int")
    cell = [F.lit(0), F.lit(0)]
    assert tiles.binary_surface(px, [8], cell).first()["value"] == 0.75
    assert tiles.binary_surface(px, [8], cell, "max").first()["value"] == 1.0
    got = {(r["band"], r["class_id"]): (r["weighted"], r["coverage"]) for r in tiles.band_partials(px, ["band"], cell).collect()}
    assert got == {(0, 8): (4, 4), (1, 8): (2, 4), (1, 0): (2, 4)}


def test_imagery(spark):
    px = spark.createDataFrame([(1, 10, 0), (1, 30, 0), (1, 90, 8), (2, 5, 8)], "k int, v int, qa int")
    assert {r["k"]: (r["v"], r["n_clear"]) for r in imagery.clear_median(px, ["k"], "v", "qa", 3).collect()} == {1: (20.0, 2), 2: (None, 0)}
    r = spark.range(1).select(imagery.eight_day_composite(F.lit("2000-12-31").cast("date"), "2000-02-24").alias("c"), imagery.bit(F.lit(0b1100), 2, 2).alias("b"), imagery.fusion_window(F.lit("2000-03-10").cast("date"), 1, "2000-02-24", "2020-12-31").alias("w"), imagery.failure_status(F.lit("Total request size must be at most 32 MB")).alias("s")).first()
    assert (str(r["c"]), r["b"], str(r["w"]["start"]), str(r["w"]["stop"]), r["s"]) == ("2000-12-26", 3, "2000-02-24", "2000-04-30", "download_limit_exceeded")
    f = spark.createDataFrame([("g", i, 40) for i in range(5)], "g string, i int, size long")
    assert [r["batch"] for r in imagery.size_batches(f, "g", "i", "size", 100).orderBy("i").collect()] == [0, 0, 1, 1, 2]
    messages = ["User memory limit exceeded", "Request too large", "Pixel grid dimensions must be at most 10000", "timed out"]
    got = [r[0] for r in spark.createDataFrame([(m,) for m in messages], "m string").select(imagery.failure_status(F.col("m"))).collect()]
    assert got == ["download_failed", "download_limit_exceeded", "download_limit_exceeded", "download_failed"]


def test_utm(spark):
    p = spark.createDataFrame([(40.7128, -74.0060), (-6.2088, 106.8456), (0.0, 3.0), (85.0, 0.0)], "lat double, lon double")
    x, y = tiling.to_plane(F.col("lat"), F.col("lon"), tiling.zone(F.col("lon")))
    made = p.withColumns({"x": x, "y": y, "z": tiling.zone(F.col("lon")), "code": tiling.tile_code(F.col("lat"), F.col("lon"))})
    lat, lon = tiling.to_globe(F.col("x"), F.col("y"), F.col("z"), F.col("lat") < 0)
    rows = made.withColumns({"lat2": lat, "lon2": lon}).collect()
    assert [r["code"] for r in rows] == ["18TWL", "48MYU", "31NEA", None]
    assert abs(rows[0]["x"] - 583959) < 2 and abs(rows[0]["y"] - 4507351) < 2 and abs(rows[2]["x"] - 500000) < 1e-6
    assert all(math.isclose(r["lat"], r["lat2"], abs_tol=1e-8) and math.isclose(r["lon"], r["lon2"], abs_tol=1e-8) for r in rows[:3])
