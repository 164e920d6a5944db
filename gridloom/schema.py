"""Column contracts of the tables that operators exchange.

A raster is a long table of cells keyed by integer grid indices; floating
coordinates are attributes and are never joined on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    types = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType()}
    return T.StructType([T.StructField(name, types[kind]) for name, kind in (c.split() for c in text.split(","))])


CELL = _struct("dataset_id string, ts timestamp_ntz, lat_idx int, lon_idx int, value double")
CLASS_CELL = _struct("dataset_id string, lat_idx int, lon_idx int, class_id int, fraction double")
REGION = _struct("region_id string, label string, ord int, west double, south double, east double, north double")
CROSSWALK = _struct("scheme string, dataset_id string, source_class int, target_class int")
TREND = _struct("dataset_id string, lat_idx int, lon_idx int, sens_slope double, p_value double, z_score double, significant boolean, trend_direction int")
LEDGER = _struct("region_id string, metric_family string, hotspot_rank int, analysis_object_id string, rank_percentile double, score double, line_specific_json string")


class ContractError(ValueError):
    """A table does not keep to its contract."""


def require(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema``, or an error that names what is missing or of another type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name not in have]
    other = [f"{f.name}: {have[f.name].simpleString()} for {f.dataType.simpleString()}" for f in schema.fields if f.name in have and have[f.name] != f.dataType]
    if missing or other:
        raise ContractError(f"missing {missing}, of another type {other}")
    return df.select(*[f.name for f in schema.fields])


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, if no two rows share ``keys``."""
    twice = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ContractError(f"rows repeat {dict(zip(keys, twice[0], strict=False))}")
    return df
