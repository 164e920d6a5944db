"""Artefacts: tables with an identity, a digest and checks before they are visible and when they are read."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contract import stem, table_digest
from ..schema import ContractError, require_unique


def _path(root: str, kind: str, region_id: str, key: str) -> str:
    return f"{root}/kind={kind}/{stem(key, region_id, kind)}"


def write(df: DataFrame, root: str, kind: str, region_id: str, key: str, unique: tuple[str, ...] = (), **identity: str) -> str:
    """Write a table with a manifest of its identity, row count and digest.

    The rows go to a name of their own and are checked there; the manifest,
    which points to them, is written last.
    """
    spark, path, order = df.sparkSession, _path(root, kind, region_id, key), list(df.columns)
    rows = f"{path}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(rows)
    back = spark.read.schema(df.schema).parquet(rows)
    if unique:
        require_unique(back, *unique)
    d = table_digest(back, order).first()
    body = {"kind": kind, "region_id": region_id, "key": key, "rows": rows, "row_count": int(d["row_count"]), "table_sha256": d["table_sha256"], **identity}
    spark.createDataFrame([(json.dumps(body, sort_keys=True, allow_nan=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return path


def manifest(spark: SparkSession, root: str, kind: str, region_id: str, key: str) -> dict:
    return json.loads(spark.read.text(f"{_path(root, kind, region_id, key)}/manifest").first()["value"])


def read(spark: SparkSession, root: str, kind: str, region_id: str, key: str, **identity: str) -> DataFrame:
    """The table, if its manifest has the identity asked for and its rows the digest of the manifest."""
    m = manifest(spark, root, kind, region_id, key)
    other = {k: (m.get(k), v) for k, v in identity.items() if m.get(k) != v}
    if other:
        raise ContractError(f"another identity: {other}")
    df = spark.read.parquet(m["rows"])
    d = table_digest(df, df.columns).first()
    if (d["row_count"], d["table_sha256"]) != (m["row_count"], m["table_sha256"]):
        raise ContractError(f"rows are not those of the manifest: {m['rows']}")
    return df


def status(spark: SparkSession, root: str, kind: str, region_id: str, key: str) -> str:
    """ready, partial (a manifest whose rows fail their check) or missing."""
    try:
        read(spark, root, kind, region_id, key).limit(1).count()
    except ContractError:
        return "partial"
    except Exception as error:  # noqa: BLE001 - the reader's error says what is missing
        return "missing" if "PATH_NOT_FOUND" in str(error) else "partial"
    return "ready"


def write_pack(tables: dict[str, DataFrame], root: str, region_id: str, key: str, **identity: str) -> DataFrame:
    """Write several tables of one run, and then what they are: kind, row_count, table_sha256 and status of each.

    A table whose write or check fails leaves the others; it is listed as partial or missing.
    """
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for kind, df in tables.items():
        try:
            write(df, root, kind, region_id, key, **identity)
        except ContractError as error:
            rows.append((kind, None, None, f"partial: {error}"))
            continue
        m = manifest(spark, root, kind, region_id, key)
        rows.append((kind, int(m["row_count"]), m["table_sha256"], status(spark, root, kind, region_id, key)))
    listed = spark.createDataFrame(rows, "kind string, row_count long, table_sha256 string, status string")
    write(listed, root, "pack_manifest", region_id, key, **identity)
    return listed


def feature_collection(boxes: DataFrame) -> DataFrame:
    """Boxes (id, west, south, east, north) as a row of GeoJSON each."""
    ring = F.array(*[F.array(F.col(x), F.col(y)) for x, y in (("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south"))])
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return boxes.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("id").alias("properties"), geometry.alias("geometry"))).alias("feature"))
