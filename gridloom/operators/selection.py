"""Selections that depend on what was chosen before: spaced picks over all regions, with caps and quotas.

The best row that is far enough from all rows chosen so far is one distributed
top-1 over the candidates; a row that was passed over stays passed over, so
that picking it again and again is the same as going through all candidates in
order. What comes to the driver are the chosen rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grid import box_around
from ..sources.store import checkpoint

# Places of known wetlands (id, region, longitude, latitude).
REPRESENTATIVE_SITES = [
    ("rep-brazil-amazon", "brazil", -60.5, -3.5),
    ("rep-brazil-pantanal", "brazil", -57.0, -18.0),
    ("rep-africa-congo", "africa", 18.0, 0.0),
    ("rep-africa-sudd", "africa", 31.5, 7.5),
    ("rep-sea-tonlesap", "southeast_asia", 104.0, 13.0),
    ("rep-sea-irrawaddy", "southeast_asia", 95.5, 16.0),
    ("rep-indonesia-borneo", "indonesia", 111.0, -1.0),
    ("rep-indonesia-papua", "indonesia", 137.0, -5.5),
]


def far_from(chosen: list[Row], distance: float) -> Column:
    """Whether a row is at least ``distance`` degrees from each chosen one and none of them."""
    tests = [(F.hypot(F.col("lat") - r["lat"], F.col("lon") - r["lon"]) >= distance) & ((F.col("lat") != r["lat"]) | (F.col("lon") != r["lon"])) for r in chosen]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def first_far(candidates: DataFrame, order: list[Column], chosen: list[Row], distance: float) -> Row | None:
    rows = candidates.filter(far_from(chosen, distance)).orderBy(*order).limit(1).collect()
    return rows[0] if rows else None


def spread_out(candidates: DataFrame, order: list[Column], n: int, distance: float, per_region: int, chosen: list[Row] | None = None) -> list[Row]:
    """``chosen`` and more, up to ``n``, in order, at most ``per_region`` of a region_id."""
    chosen = list(chosen or [])
    while len(chosen) < n:
        held = [r["region_id"] for r in chosen]
        full = sorted({r for r in held if held.count(r) >= per_region})
        found = first_far(candidates.filter(~F.col("region_id").isin(*full)) if full else candidates, order, chosen, distance)
        if found is None:
            break
        chosen.append(found)
    return chosen


def as_table(like: DataFrame, chosen: list[Row], name: str = "hotspot_rank") -> DataFrame:
    """The chosen rows, numbered from 1."""
    schema = T.StructType([*like.schema.fields, T.StructField(name, T.IntegerType())])
    return like.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(chosen, 1)], schema)


def focus_areas(cells: DataFrame, regions: list[str], n: int = 8, per_region: int = 2, distance: float = 3.0) -> DataFrame:
    """Areas of high disagreement: first the best of each region in turn, then the best of all, spaced over all chosen.

    ``cells`` has region_id, lat, lon, score and participant_count; scores of
    zero or less take no part.
    """
    order = [F.desc("score"), F.desc("participant_count"), F.desc("lat"), F.asc("lon")]
    candidates = checkpoint(cells.filter("score > 0"))
    chosen: list[Row] = []
    for region in regions:
        found = first_far(candidates.filter(F.col("region_id") == region), order, chosen, distance) if len(chosen) < n else None
        chosen += [found] if found else []
    return as_table(candidates, spread_out(candidates, order, n, distance, per_region, chosen) if len(chosen) < n else chosen)


def named_areas(areas: DataFrame, month: str, size: float = 2.0, prefix: str = "rough") -> DataFrame:
    """Areas with their id, prefix-YYYYMM-region-NNN, and the box around their centre."""
    stamp = F.date_format(F.lit(month).cast("date"), "yyyyMM")
    ident = F.concat(F.lit(f"{prefix}-"), stamp, F.lit("-"), F.col("region_id"), F.lit("-"), F.lpad(F.col("hotspot_rank").cast("string"), 3, "0"))
    return areas.withColumn("aoi_id", ident).withColumn("_box", box_around(F.col("lat"), F.col("lon"), size)).select("*", "_box.*").drop("_box")


def representative_sites(existing: DataFrame, distance: float = 3.0) -> DataFrame:
    """The known places that are far from all existing hotspots and from each other; what exists is a list of chosen places."""
    spark = existing.sparkSession
    sites = spark.createDataFrame([(i, *s) for i, s in enumerate(REPRESENTATIVE_SITES)], "ord int, site_id string, region_id string, lon double, lat double")
    taken = F.broadcast(existing.select(F.col("lat").alias("_a"), F.col("lon").alias("_b")))
    free = sites.join(taken, F.hypot(F.col("lat") - F.col("_a"), F.col("lon") - F.col("_b")) < distance, "left_anti")
    chosen = spread_out(free, [F.asc("ord")], len(REPRESENTATIVE_SITES), distance, len(REPRESENTATIVE_SITES))
    return as_table(sites, chosen, "site_rank").drop("ord")
