"""Files by name, tables of places, order and choice."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridloom.functions import grid
from gridloom.operators import summaries
from gridloom.sources import files
from gridloom.sources.driver_tables import regions


def test_listing_and_tokens(spark, tmp_path):
    for p in ("cfg1/frc1/fwet_2001_reso025.nc", "cfg1/frc2/fwet_2002_reso025.nc", "m/ww_200107.nc", "m/ww_200112.nc", "t/GWD_48MYU_2016.tif"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    every = files.listed(spark, str(tmp_path))
    assert every.count() == 5
    assert [r["name"] for r in files.by_month(every.filter("name like 'ww%'"), "2001-06-15", "2001-11-01").collect()] == ["ww_200107.nc"]
    got = {(r["config"], r["forcing"], r["year"]) for r in files.members(every.filter("name like 'fwet%'")).collect()}
    assert got == {("cfg1", "frc1", 2001), ("cfg1", "frc2", 2002)}
    assert [r["tile_code"] for r in files.tiles(every.filter("name like 'GWD%'")).collect()] == ["48MYU"]


def test_years():
    assert files.selected_years([2001, 2003, 2002], None) == [2001, 2002, 2003]
    with pytest.raises(ValueError, match="2009"):
        files.selected_years([2001], [2001, 2009])


def test_places(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,bbox\na,"[1.0, 2.0, 3.0, 4.0]"\n')
    assert tuple(files.places(spark, f"{tmp_path}/a.csv").first()) == ("a", 1.0, 2.0, 3.0, 4.0)
    (tmp_path / "b.csv").write_text('id,bbox\nb,"[3.0, 2.0, 1.0, 4.0]"\n')
    with pytest.raises(PySparkException, match="not a box"):
        files.places(spark, f"{tmp_path}/b.csv").collect()


def test_order_and_choice(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, v int")
    assert [r["id"] for r in files.in_order(df, "id", ["c", "a"]).collect()] == ["c", "a"]
    r = spark.createDataFrame([("g", "x", 1, 9), ("g", "y", 0, 3), ("g", "z", 0, 5)], "`group` string, name string, priority int, valid_count int")
    assert files.best_raster(r).first()["name"] == "z"


def test_region_subsets(spark):
    assert [r["region_id"] for r in grid.region_subset(regions(spark), ["middle", "north_west"], {}).collect()] == ["north_west", "middle"]
    with pytest.raises(ValueError, match="unknown"):
        grid.region_subset(regions(spark), ["nowhere"], {})


def test_a_hole_makes_the_wetland_fraction_missing(spark):
    f = spark.createDataFrame([("d", 0, 0, 8, 0.7), ("d", 0, 0, 9, 0.6), ("d", 0, 1, 8, None), ("d", 0, 1, 9, 0.2), ("d", 0, 0, 0, 0.3)], "dataset_id string, lat_idx int, lon_idx int, class_id int, fraction double")
    got = {r["lon_idx"]: r["value"] for r in summaries.wetland_fraction(f, None).collect()}
    assert got == {0: 1.0, 1: None}


def test_weighted_summary(spark):
    e = spark.createDataFrame([(0.0, 1.0), (60.0, 0.0), (0.0, None)], "lat double, entropy double")
    r = summaries.weighted_entropy_summary(e, F.col("lat")).first()
    assert abs(r["mean_entropy"] - 1 / 1.5) < 1e-12 and abs(r["valid_share"] - 1.5 / 2.5) < 1e-12
