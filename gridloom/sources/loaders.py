"""Loaders: files of six datasets as tables of cells.

Each takes the rows of a dataset's files, with the file's ``path`` beside them
(``rows_of`` reads them from Parquet, CSV or ORC), and returns long cells; what
the file's name says becomes columns, and filters on these reach the listing of
files. ``finalize`` gives all of them the same names, box, period and metadata.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.grid import in_box
from ..functions.scalars import first_integer_token, nan_to_null, sentinel_to_null, tile_code_token, year_month_token
from .store import UnsupportedDataset, register_loader

CELL = ["lat_idx", "lon_idx"]
# Missing values of the daily water product and of class rasters, and the scale of its percentages.
DAILY_MISSING, CLASS_MISSING, PERCENT = -9999.0, 255, 100.0
# Spatial names and what they become; x and y only where the grid is in degrees.
NAMES, PLANAR, DEGREES = {"latitude": "lat", "longitude": "lon"}, {"x": "lon", "y": "lat"}, "4326"


def rows_of(spark: SparkSession, root: str, kind: str = "parquet", pattern: str = "*") -> DataFrame:
    """The rows of all files under a folder, with path and name of their file."""
    raw = spark.read.format(kind).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    raw = (raw.option("header", True).option("inferSchema", True) if kind == "csv" else raw).load(root)
    return named(raw.withColumn("path", F.col("_metadata.file_path")))


def named(raw: DataFrame) -> DataFrame:
    """Rows with ``name``, the last part of their path."""
    return raw.withColumn("name", F.element_at(F.split("path", "/"), -1))


def normalized(df: DataFrame, crs: str | None = None) -> DataFrame:
    """latitude and longitude as lat and lon; x and y too if the grid is in degrees. Names that are there stay."""
    wanted = list(NAMES.items()) + (list(PLANAR.items()) if crs is not None and crs.upper().endswith(DEGREES) and {"x", "y"} <= set(df.columns) else [])
    for old, new in wanted:
        df = df.withColumnRenamed(old, new) if new not in df.columns else df
    return df


def timed(df: DataFrame, time: str = "time") -> DataFrame:
    """The time column as timestamps named ts; tables without one stay as they are."""
    return df.withColumn("ts", F.col(time).cast("timestamp_ntz")).drop(time) if time in df.columns else df


def in_period(df: DataFrame, period: tuple[str, str] | None, time: str = "ts") -> DataFrame:
    """Rows of a closed period; tables without time stay as they are."""
    if period is None or time not in df.columns:
        return df
    return df.filter(F.col(time).between(F.lit(period[0]).cast("timestamp_ntz"), F.lit(period[1]).cast("timestamp_ntz")))


def checked_grid(columns: list[str], crs: str | None) -> None:
    """A reference grid has a coordinate system and a pair of spatial axes."""
    if not crs:
        raise ValueError("a reference grid needs a coordinate system")
    if not ({"lat", "lon"} <= set(columns) or {"y", "x"} <= set(columns)):
        raise ValueError(f"a reference grid needs lat and lon or y and x, not {sorted(columns)}")


def finalize(cells: DataFrame, metadata: dict[str, str], bbox: tuple[float, float, float, float] | None = None, period: tuple[str, str] | None = None, crs: str | None = None) -> DataFrame:
    """Names, box and period that all datasets share, and the dataset's metadata as columns."""
    made = in_period(timed(normalized(cells, crs)), period)
    if bbox is not None and {"lat", "lon"} <= set(made.columns):
        made = made.filter(in_box(F.col("lat"), F.col("lon"), *bbox))
    return nan_to_null(made).withColumns({k: F.lit(v) for k, v in metadata.items()})


def coverage(config: dict) -> tuple[str | None, str | None] | None:
    """First and last of a dataset's period as its configuration has it: time_range, or the least and largest of years."""
    period, years = config.get("time_range"), config.get("years")
    if isinstance(period, dict):
        return tuple(None if period.get(k) is None else str(period[k]) for k in ("start", "end"))
    return (str(min(years)), str(max(years))) if isinstance(years, list) and years else None


def configured(spark: SparkSession, path: str) -> dict[str, dict]:
    """Datasets' settings from a file of JSON, an object by id; each needs a loader."""
    found = json.loads("\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect()))
    if not isinstance(found, dict) or not found:
        raise ValueError(f"{path} names no datasets")
    lacking = sorted(k for k, v in found.items() if not isinstance(v, dict) or not v.get("loader"))
    if lacking:
        raise ValueError(f"{path}: no loader for {lacking}")
    return found


def spelled(columns: list[str], wanted: str, *others: str) -> str:
    """The column that has the wanted name, or that name spelled without or with other separators, or one of ``others``."""
    tried = [wanted, wanted.replace("_", ""), wanted.replace("_", "-"), *others]
    found = next((c for c in tried if c in columns), None)
    if found is None:
        raise UnsupportedDataset(f"no column of {tried} among {sorted(columns)}")
    return found


def _month_of(name: Column) -> Column:
    found = year_month_token(name)
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no month in "), name)).cast("date"))


@register_loader("monthly_files")
def monthly_files(spark: SparkSession, raw: DataFrame, dataset_id: str, variable: str = "watermask", period: tuple[str, str] | None = None) -> DataFrame:
    """Files of a month each, which their names give; of a file with several time steps the first counts."""
    v = spelled(raw.columns, variable, "watermask", "water_mask")
    rows = named(raw)
    months = _month_of(F.col("name"))
    rows = rows.withColumn("ts", months.cast("timestamp_ntz"))
    if period is not None:
        rows = rows.filter(F.col("ts").between(F.lit(period[0]).cast("timestamp_ntz"), F.lit(period[1]).cast("timestamp_ntz")))
    if "time" in raw.columns:
        first = F.min("time").over(Window.partitionBy("path", *CELL))
        rows = rows.withColumn("_first", first).filter(F.col("time") == F.col("_first"))
    return rows.select(F.lit(dataset_id).alias("dataset_id"), "ts", *CELL, F.col(f"`{v}`").cast("double").alias("value"))


@register_loader("daily_files")
def daily_files(spark: SparkSession, raw: DataFrame, dataset_id: str, variable: str = "fw", period: tuple[str, str] | None = None) -> DataFrame:
    """Files of a day each, YYYYMMDD in their names: percentages as fractions, -9999 as missing, and the quality flag if there is one."""
    rows = named(raw)
    day = F.regexp_extract("name", r"(?<!\d)(\d{8})(?!\d)", 1)
    rows = rows.withColumn("ts", F.to_date(F.when(day != "", day), "yyyyMMdd").cast("timestamp_ntz"))
    if period is not None:  # files go by month
        month = F.trunc("ts", "MM")
        rows = rows.filter(month.between(F.trunc(F.lit(period[0]).cast("date"), "MM"), F.lit(period[1]).cast("date")))
    value = sentinel_to_null(F.col(variable).cast("double"), DAILY_MISSING) / PERCENT
    return rows.select(F.lit(dataset_id).alias("dataset_id"), "ts", *CELL, value.alias("value"), *(["flag"] if "flag" in raw.columns else []))


@register_loader("ensemble_files")
def ensemble_files(spark: SparkSession, raw: DataFrame, dataset_id: str, variable: str = "fwet", years: tuple[int, int] | None = None) -> DataFrame:
    """Files of a member and year each: configuration and forcing from their folders, the year from their name, months from ``time``.

    Members stay rows, so that one that lacks a step or a forcing just has no rows there.
    """
    parts = F.split("path", "/")
    rows = named(raw).withColumns({"config": F.element_at(parts, -3), "forcing": F.element_at(parts, -2)})
    rows = rows.withColumn("year", first_integer_token(F.regexp_extract("name", r"_(\d{4})\D", 1)).cast("int"))
    if years is not None:
        rows = rows.filter(F.col("year").between(*years))
    ts = F.make_date("year", F.col("time").cast("int"), F.lit(1)).cast("timestamp_ntz")
    return rows.select(F.lit(dataset_id).alias("dataset_id"), "config", "forcing", ts.alias("ts"), *CELL, F.col(variable).cast("double").alias("value"))


@register_loader("class_areas")
def class_areas(spark: SparkSession, combined: DataFrame, hectares: DataFrame, percent: DataFrame, dataset_id: str, ha_scale: float = 1.0, pct_scale: float = 1.0) -> DataFrame:
    """A combined class raster beside rasters of each class's area: a row a cell and class, and cells that only one of them has.

    Rasters of areas are one file a class, whose number is the first in the
    name; 255 of the combined raster is missing.
    """
    own = combined.select(*CELL, sentinel_to_null(F.col("class_id"), CLASS_MISSING).cast("int").alias("combined_class"))

    def stacked(raw: DataFrame, scale: float, name: str) -> DataFrame:
        number = first_integer_token(F.regexp_extract("name", r"class_?(\d+)", 1)).cast("int")
        return named(raw).select(*CELL, number.alias("glwd_class"), (F.col("value").cast("double") * scale).alias(name))

    areas = stacked(hectares, ha_scale, "area_ha").join(stacked(percent, pct_scale, "area_pct"), [*CELL, "glwd_class"], "full_outer")
    return own.join(areas, CELL, "full_outer").select(F.lit(dataset_id).alias("dataset_id"), *CELL, "glwd_class", "combined_class", "area_ha", "area_pct")


@register_loader("aligned_rasters")
def aligned_rasters(spark: SparkSession, rasters: dict[str, DataFrame], dataset_id: str) -> DataFrame:
    """Rasters (cell, value) of one grid side by side, for the cells that all have."""
    parts = [df.select(*CELL, F.col("value").alias(name)) for name, df in rasters.items()]
    return reduce(lambda a, b: a.join(b, CELL), parts).withColumn("dataset_id", F.lit(dataset_id))


@register_loader("tile_mosaic")
def tile_mosaic(spark: SparkSession, tiles: DataFrame, pixels: DataFrame, dataset_id: str, bbox: tuple[float, float, float, float] | None = None, years: list[int] | None = None) -> DataFrame:
    """Pixels of tiles on one grid: tiles of the years that touch the box, and where tiles overlap the first that has a value.

    ``tiles`` has path, year, tile_order, west, south, east, north; ``pixels``
    path, band and cell and value. Tiles are chosen before their pixels are read.
    """
    chosen = tiles if years is None else tiles.filter(F.col("year").isin(*years))
    if bbox is not None:
        chosen = chosen.filter((F.col("west") <= bbox[2]) & (F.col("east") >= bbox[0]) & (F.col("south") <= bbox[3]) & (F.col("north") >= bbox[1]))
    chosen = named(chosen).select(F.col("path").alias("_path"), "year", "tile_order", tile_code_token(F.col("name")).alias("tile_code"))
    met = pixels.filter(F.col("value").isNotNull()).join(chosen, F.col("path") == F.col("_path"))
    return met.groupBy("year", "band", *CELL).agg(F.min_by("value", "tile_order").alias("value"), F.min_by("tile_code", "tile_order").alias("tile_code")).withColumn("dataset_id", F.lit(dataset_id))


def nearest_time(cells: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Per key the time step nearest to a day, the earlier of two."""
    apart = F.abs(F.datediff(F.col("ts"), F.lit(target).cast("date")))
    best = F.min(F.struct(apart, "ts")).over(Window.partitionBy(*keys))
    return cells.withColumn("_best", best).filter(F.struct(apart, F.col("ts")) == F.col("_best")).drop("_best")
