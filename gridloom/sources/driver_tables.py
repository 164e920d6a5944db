"""The benchmark's relational tables as gridded observations.

``OBS_SQL`` is one projection for Spark and for any other SQL engine: line
items are observations of three datasets on an 8 by 8 grid, in hundredths so
that sums are exact, with some missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

OBS_SQL = """
select lower(l_returnflag) as dataset_id, l_shipdate as ts,
       cast(l_suppkey % 8 as int) as lat_idx, cast(l_partkey % 8 as int) as lon_idx,
       case when l_orderkey % 11 = 0 then null else cast(round(l_discount * 1000) as bigint) end as value,
       cast((l_partkey + l_suppkey + l_linenumber) % 8 as int) as class_id,
       cast(l_orderkey as bigint) as order_id, cast(l_suppkey as bigint) as supplier_id, cast(l_linenumber as int) as line
from lineitem
"""
#: lat = 17.5 - 5 * lat_idx, lon = 102.5 + 5 * lon_idx: centres of cells of five degrees.
REGIONS = [
    ("north_west", 1, 100.0, 0.0, 120.0, 20.0),
    ("north_east", 2, 120.0, 0.0, 140.0, 20.0),
    ("south_west", 3, 100.0, -20.0, 120.0, 0.0),
    ("middle", 4, 110.0, -10.0, 130.0, 10.0),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(OBS_SQL.replace("from lineitem", "from {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGIONS, "region_id string, ord int, west double, south double, east double, north double")
