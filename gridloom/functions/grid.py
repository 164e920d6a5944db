"""Lattices: axes, cell edges and areas, boxes and regions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed value: mean radius of the earth in kilometres.
EARTH_RADIUS_KM = 6371.0088
#: Regions of a catalogue, at most, which is broadcast.
MOST_REGIONS = 10_000
# Fixed value: metres of a degree where a resolution is given in metres.
METRES_PER_DEGREE = 111_320.0


def lattice(spark: SparkSession, west: float, south: float, east: float, north: float, step: float) -> DataFrame:
    """lat_idx, lon_idx, lat, lon: cells by their north and west edges, rows from the north.

    Both axes are ranges; the product is as large as the grid that is asked for.
    """
    rows = max(0, -int(-((north - south) / step - 1e-9) // 1))
    columns = max(0, -int(-((east - west) / step - 1e-9) // 1))
    cells = spark.range(rows * columns)
    lat, lon = F.expr(f"cast(id div {max(1, columns)} as int)"), F.expr(f"cast(id % {max(1, columns)} as int)")
    return cells.select(lat.alias("lat_idx"), lon.alias("lon_idx")).withColumns({"lat": F.lit(north) - F.col("lat_idx") * step, "lon": F.lit(west) + F.col("lon_idx") * step})


def degrees(metres: float) -> float:
    return metres / METRES_PER_DEGREE


def cell_area_km2(south: Column, north: Column, west: Column, east: Column) -> Column:
    """Area of a cell on the sphere."""
    return F.lit(EARTH_RADIUS_KM**2) * (F.sin(F.radians(north)) - F.sin(F.radians(south))) * F.radians(east - west)


def axis_edges(axis: DataFrame, index: str, value: str, single: float = 0.5) -> DataFrame:
    """``axis`` with low and high: midpoints between neighbours, ends extrapolated; one value alone spans ``single`` each way.

    An axis is as long as one side of a grid, which is why it may be one window.
    """
    w = Window.orderBy(index)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    v = F.col(value)
    first = F.coalesce((v + before) / 2, v - (after - v) / 2, v - single)
    second = F.coalesce((v + after) / 2, v + (v - before) / 2, v + single)
    return axis.withColumns({"low": F.least(first, second), "high": F.greatest(first, second)})


def in_box(lat: Column, lon: Column, west: float, south: float, east: float, north: float) -> Column:
    """Inside a box, edges included, whichever way the axes run."""
    return lat.between(south, north) & lon.between(west, east)


def boxes_touch(a: dict[str, Column], b: dict[str, Column], strict: bool = False) -> Column:
    """Whether boxes of west, south, east, north meet; strict: share more than an edge."""
    if strict:
        return (a["west"] < b["east"]) & (a["east"] > b["west"]) & (a["south"] < b["north"]) & (a["north"] > b["south"])
    return (a["west"] <= b["east"]) & (a["east"] >= b["west"]) & (a["south"] <= b["north"]) & (a["north"] >= b["south"])


def box_around(lat: Column, lon: Column, size: float) -> Column:
    """A square box around a point, kept on the globe."""
    half = size / 2
    return F.struct(
        F.greatest(F.lit(-180.0), lon - half).alias("west"),
        F.greatest(F.lit(-90.0), lat - half).alias("south"),
        F.least(F.lit(180.0), lon + half).alias("east"),
        F.least(F.lit(90.0), lat + half).alias("north"),
    )


def all_regions(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Cells once for each region that holds them; regions may overlap.

    Regions are a catalogue of a few rows, which is broadcast for the range test.
    """
    r = regions.select("region_id", "west", "south", "east", "north")
    if r.limit(MOST_REGIONS + 1).count() > MOST_REGIONS:
        raise ValueError(f"more than {MOST_REGIONS} regions are no catalogue; join them by grid_hash_join")
    return cells.join(F.broadcast(r), F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))).drop("west", "south", "east", "north")


def first_region(cells: DataFrame, regions: list[tuple[str, float, float, float, float]], other: str = "other") -> DataFrame:
    """Cells with region_id, the first of the listed boxes that holds them."""
    found = F.lit(other)
    for name, west, south, east, north in reversed(regions):
        found = F.when(in_box(F.col("lat"), F.col("lon"), west, south, east, north), name).otherwise(found)
    return cells.withColumn("region_id", found)


def grid_hash_join(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Boxes joined to the boxes they touch by a hash of grid cells of ``size`` degrees.

    Both sides have id, west, south, east, north. Each box is listed under the
    grid cells that it touches; equal cells meet in an equi-join and the exact
    test drops the rest. A pair is found once.
    """

    def listed(df: DataFrame, p: str) -> DataFrame:
        span = lambda a, b: F.sequence(F.floor(F.col(a) / size).cast("int"), F.floor(F.col(b) / size).cast("int"))
        return df.select(*[F.col(c).alias(p + c) for c in ("id", "west", "south", "east", "north")], F.explode(span("west", "east")).alias("gx"), span("south", "north").alias("ys")).withColumn("gy", F.explode("ys")).drop("ys")

    a, b = listed(points, "a_"), listed(boxes, "b_")
    touch = boxes_touch({k: F.col(f"a_{k}") for k in ("west", "south", "east", "north")}, {k: F.col(f"b_{k}") for k in ("west", "south", "east", "north")})
    return a.join(b, ["gx", "gy"]).filter(touch).select(F.col("a_id").alias("left_id"), F.col("b_id").alias("right_id")).distinct()


def cos_weighted_bins(cells: DataFrame, west: float, south: float, step: float, keys: tuple[str, ...] = (), value: str = "value", east: float | None = None, north: float | None = None) -> DataFrame:
    """Means by square of ``step`` degrees, each cell weighing as the cosine of its latitude; missing cells have no weight.

    With ``east`` and ``north``, cells outside the box are left out and a cell
    on a far edge belongs to the last square.
    """
    w = F.cos(F.radians("lat"))
    lat, lon = F.col("lat"), F.col("lon")
    if east is not None and north is not None:
        cells = cells.filter(in_box(lat, lon, west, south, east, north))
        lat, lon = F.least(lat, F.lit(north - step * 1e-6)), F.least(lon, F.lit(east - step * 1e-6))
    bins = [F.floor((lat - south) / step).cast("int").alias("lat_idx"), F.floor((lon - west) / step).cast("int").alias("lon_idx")]
    grouped = cells.withColumn("_w", F.when(F.col(value).isNotNull(), w)).drop("lat_idx", "lon_idx").groupBy(*keys, *bins)
    return grouped.agg(F.try_divide(F.sum(F.col(value) * F.col("_w")), F.sum("_w")).alias("value"), F.count(value).alias("n_source"))


def cell_boxes(cells: DataFrame, lat_axis: DataFrame, lon_axis: DataFrame) -> DataFrame:
    """Cells with the box between their axes' edges: west, south, east, north. Axes are those of axis_edges()."""
    a = lat_axis.select(F.col("lat_idx").alias("_a"), F.col("low").alias("south"), F.col("high").alias("north"))
    b = lon_axis.select(F.col("lon_idx").alias("_b"), F.col("low").alias("west"), F.col("high").alias("east"))
    return cells.join(a, F.col("lat_idx") == F.col("_a")).join(b, F.col("lon_idx") == F.col("_b")).drop("_a", "_b")


def sub_lattice(spark: SparkSession, west: float, south: float, east: float, north: float, step: float, box: tuple[float, float, float, float]) -> DataFrame:
    """The cells of a lattice that a box touches, with their indices in the whole lattice; by arithmetic, without making the rest."""
    rows = max(0, -int(-((north - south) / step - 1e-9) // 1))
    columns = max(0, -int(-((east - west) / step - 1e-9) // 1))
    r0, r1 = max(0, math.floor((north - box[3]) / step + 1e-9)), min(rows, math.ceil((north - box[1]) / step - 1e-9))
    c0, c1 = max(0, math.floor((box[0] - west) / step + 1e-9)), min(columns, math.ceil((box[2] - west) / step - 1e-9))
    wide = max(0, c1 - c0)
    cells = spark.range(max(0, r1 - r0) * wide)
    lat, lon = F.expr(f"cast(id div {max(1, wide)} + {r0} as int)"), F.expr(f"cast(id % {max(1, wide)} + {c0} as int)")
    return cells.select(lat.alias("lat_idx"), lon.alias("lon_idx")).withColumns({"lat": F.lit(north) - F.col("lat_idx") * step, "lon": F.lit(west) + F.col("lon_idx") * step})


def same_axis(a: DataFrame, b: DataFrame, index: str, value: str, relative: float = 1e-6) -> DataFrame:
    """One row: whether two axes have the same length and, index by index, values as near as ``relative`` of the second's."""
    x, y = a.select(F.col(index).alias("_i"), F.col(value).cast("double").alias("_x")), b.select(F.col(index).alias("_j"), F.col(value).cast("double").alias("_y"))
    near = F.abs(F.col("_x") - F.col("_y")) <= relative * F.abs(F.col("_y"))
    met = x.join(y, F.col("_i") == F.col("_j"), "full_outer")
    return met.agg(F.coalesce(F.bool_and(F.coalesce(near, F.lit(False))), F.lit(True)).alias("aligned"))


def one_cell_everywhere(cells: DataFrame, grid: DataFrame, lat_step: float, lon_step: float, value: str = "value") -> DataFrame:
    """The grid's cells with the value of a source of one cell, where that cell's extent of a grid step reaches their centre; others are null."""
    one = cells.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col(value).alias("_v"))  # one row
    reach = lambda c, o, step: F.abs(F.col(c) - F.col(o)) <= step / 2 + step * 1e-6
    met = grid.join(F.broadcast(one), reach("lat", "_lat", lat_step) & reach("lon", "_lon", lon_step), "left")
    return met.withColumn(value, F.col("_v").cast("double")).drop("_lat", "_lon", "_v")


def mask_fraction(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """Cells with mask_fraction, zero where the mask has no cell."""
    m = mask.select(F.col("lat_idx").alias("_a"), F.col("lon_idx").alias("_b"), F.col("mask_fraction").alias("_m"))
    return cells.join(m, (F.col("lat_idx") == F.col("_a")) & (F.col("lon_idx") == F.col("_b")), "left").withColumn("mask_fraction", F.coalesce("_m", F.lit(0.0))).drop("_a", "_b", "_m")


def region_subset(regions: DataFrame, wanted: list[str] | None, named: dict[str, list[str]], subset: str | None = None) -> DataFrame:
    """Regions of a named subset or those asked for, in the catalogue's order; unknown ids are an error."""
    ids = wanted if wanted is not None else named[subset] if subset else None
    if ids is None:
        return regions.orderBy("ord")
    known = {r["region_id"] for r in regions.select("region_id").collect()}  # a catalogue
    unknown = sorted(set(ids) - known)
    if unknown:
        raise ValueError(f"unknown regions {unknown}")
    return regions.filter(F.col("region_id").isin(*ids)).orderBy("ord")
