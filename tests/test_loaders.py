"""Loaders: names, periods, members, classes, mosaics, and what they refuse."""

import json

import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.sources import loaders, store


def test_names_of_axes(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "latitude double, longitude double, x double, y double")
    assert loaders.normalized(df).columns == ["lat", "lon", "x", "y"]
    xy = df.select("x", "y")
    assert loaders.normalized(xy, "EPSG:32633").columns == ["x", "y"] and loaders.normalized(xy, "epsg:4326").columns == ["lon", "lat"]
    with pytest.raises(ValueError, match="coordinate system"):
        loaders.checked_grid(["lat", "lon"], None)
    with pytest.raises(ValueError, match="needs lat"):
        loaders.checked_grid(["a"], "EPSG:4326")
    loaders.checked_grid(["y", "x"], "EPSG:4326")


def test_period_box_and_metadata(spark):
    df = spark.sql("select 1.0D as latitude, 5.0D as longitude, t as time, 2.0D as value from values ('2000-01-01'), ('2000-06-01'), ('2001-01-01') as v(t)")
    made = loaders.finalize(df, {"source": "x"}, (0.0, 0.0, 5.0, 5.0), ("2000-01-01", "2000-12-31")).collect()
    assert len(made) == 2 and {r["source"] for r in made} == {"x"} and set(made[0].asDict()) == {"lat", "lon", "value", "ts", "source"}
    assert loaders.finalize(df, {}, (10.0, 0.0, 20.0, 5.0)).count() == 0
    assert loaders.coverage({"time_range": {"start": 2000}}) == ("2000", None) and loaders.coverage({"years": [3, 1]}) == ("1", "3") and loaders.coverage({}) is None


def test_months_in_names(spark):
    rows = [("/b/m_2000-02.nc", 1, 0, 0, 0.5), ("/b/m_2000-02.nc", 2, 0, 0, 0.7), ("/b/m_2001m11.nc", 1, 0, 0, 0.1)]
    raw = spark.createDataFrame(rows, "path string, time int, lat_idx int, lon_idx int, watermask double")
    got = {str(r["ts"])[:10]: r["value"] for r in store.load(spark, "monthly_files", "d", raw=raw).collect()}
    assert got == {"2000-02-01": 0.5, "2001-11-01": 0.1}
    assert store.load(spark, "monthly_files", "d", raw=raw, period=("2001-01-01", "2001-12-31")).count() == 1
    with pytest.raises(Exception, match="no month in"):
        store.load(spark, "monthly_files", "d", raw=raw.withColumn("path", F.lit("/b/20010512.nc"))).collect()
    with pytest.raises(store.UnsupportedDataset, match="no column"):
        store.load(spark, "monthly_files", "d", raw=raw.withColumnRenamed("watermask", "other"))
    assert loaders.spelled(["water-mask"], "water_mask") == "water-mask"


def test_days_members_and_classes(spark):
    raw = spark.createDataFrame([("/s/fw_20000229.nc", 0, 0, 50.0, 1), ("/s/fw_20000229.nc", 0, 1, -9999.0, 0)], "path string, lat_idx int, lon_idx int, fw double, flag int")
    got = {r["lon_idx"]: (str(r["ts"])[:10], r["value"], r["flag"]) for r in store.load(spark, "daily_files", "d", raw=raw).collect()}
    assert got == {0: ("2000-02-29", 0.5, 1), 1: ("2000-02-29", None, 0)}
    raw = spark.createDataFrame([("/t/c1/f1/fwet_a_reso025_1999.nc", 3, 0, 0, 0.2), ("/t/c2/f1/fwet_a_reso025_2001.nc", 12, 0, 0, 0.4)], "path string, time int, lat_idx int, lon_idx int, fwet double")
    got = {(r["config"], r["forcing"], str(r["ts"])[:10]) for r in store.load(spark, "ensemble_files", "d", raw=raw).collect()}
    assert got == {("c1", "f1", "1999-03-01"), ("c2", "f1", "2001-12-01")}
    combined = spark.createDataFrame([(0, 0, 255), (0, 1, 8)], "lat_idx int, lon_idx int, class_id int")
    area = lambda k: spark.createDataFrame([(f"/g/glwd_class_0{k}_ha.tif", 0, 0, 10.0), ("/g/glwd_class_09_ha.tif", 5, 5, 1.0)], "path string, lat_idx int, lon_idx int, value double")
    got = {(r["lat_idx"], r["lon_idx"], r["glwd_class"]): (r["combined_class"], r["area_ha"], r["area_pct"]) for r in store.load(spark, "class_areas", "d", combined=combined, hectares=area(1), percent=area(2), ha_scale=0.1).collect()}
    assert got == {(0, 0, 1): (None, 1.0, None), (0, 0, 2): (None, None, 10.0), (0, 1, None): (8, None, None), (5, 5, 9): (None, 0.1, 1.0)}


def test_first_tile_wins(spark):
    tiles = spark.createDataFrame([("/t/2001/01NAB_a.tif", 2001, 1, 0.0, 0.0, 5.0, 5.0), ("/t/2001/02NAB_b.tif", 2001, 2, 0.0, 0.0, 5.0, 5.0), ("/t/2001/03NAB_c.tif", 2001, 0, 50.0, 0.0, 55.0, 5.0), ("/t/2002/01NAB_a.tif", 2002, 0, 0.0, 0.0, 5.0, 5.0)], "path string, year int, tile_order int, west double, south double, east double, north double")
    pixels = spark.createDataFrame([("/t/2001/01NAB_a.tif", 0, 0, 0, None), ("/t/2001/02NAB_b.tif", 0, 0, 0, 7), ("/t/2001/01NAB_a.tif", 0, 0, 1, 3), ("/t/2001/02NAB_b.tif", 0, 0, 1, 9), ("/t/2001/03NAB_c.tif", 0, 0, 1, 1)], "path string, band int, lat_idx int, lon_idx int, value int")
    made = {(r["lon_idx"]): (r["value"], r["tile_code"]) for r in store.load(spark, "tile_mosaic", "d", tiles=tiles, pixels=pixels, bbox=(4.0, 4.0, 9.0, 9.0), years=[2001]).collect()}
    assert made == {0: (7, "02NAB"), 1: (3, "01NAB")}


def test_configuration_and_boxes(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"a": {"loader": "table"}}, indent=2))
    bad.write_text(json.dumps({"a": {"years": [1]}}))
    assert loaders.configured(spark, str(good)) == {"a": {"loader": "table"}}
    with pytest.raises(ValueError, match="no loader"):
        loaders.configured(spark, str(bad))
    text = spark.createDataFrame([("1, 2, 3.5, 4",)], "t string")
    assert tuple(text.select(scalars.box_of_text(F.col("t")).alias("b")).first()["b"]) == (1.0, 2.0, 3.5, 4.0)
    for wrong in ("3,2,1,4", "1,2,3", "1,2,x,4", "1,2,200,4"):
        with pytest.raises(Exception, match="not a box"):
            spark.createDataFrame([(wrong,)], "t string").select(scalars.box_of_text(F.col("t"))).collect()


def test_rows_know_their_file(spark, tmp_path):
    spark.createDataFrame([(0, 0, 1.0)], "lat_idx int, lon_idx int, fwet double").withColumn("time", F.lit(2)).coalesce(1).write.parquet(f"{tmp_path}/c/f")
    made = loaders.rows_of(spark, str(tmp_path), pattern="*.parquet").first()
    assert made["path"].startswith("file:") and made["name"].endswith(".parquet") and "/c/f/" in made["path"]
