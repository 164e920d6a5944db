"""Artefact contracts: stems, canonical JSON, digests, ledgers, evidence, readiness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ContractError
from .neighbours import rank_percentile

# The families of evidence, in their order.
FAMILIES = ("percentage", "classification", "trend")


def stem(key: str, region_id: str, suffix: str) -> str:
    """The name of an artefact; parts are not empty and hold neither two underscores nor path separators."""
    for part in (key, region_id, suffix):
        if not part or "__" in part or "/" in part or "\\" in part:
            raise ValueError(f"not a part of a name: {part!r}")
    return f"{key}__{region_id}__{suffix}"


def hotspot_id(prefix: str, region: Column, key: str | None, rank: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), region, F.lit(f"-{key}-" if key else "-"), F.lpad(rank.cast("string"), 3, "0"))


def canonical_json(*columns: str) -> Column:
    """An object of the columns in the order of their names."""
    return F.to_json(F.struct(*sorted(columns)))


def table_digest(df: DataFrame, order: list[str]) -> DataFrame:
    """A digest of the rows, whatever their order: SHA-256 of the count and of the sums of the four quarters of each row's SHA-256.

    A row's digest is that of its columns as JSON, the ``order`` columns first.
    """
    row = F.to_json(F.struct(*order, *[c for c in df.columns if c not in order]), {"ignoreNullFields": "false"})
    rows = df.select(F.sha2(row.cast("binary"), 256).alias("d"))
    quarter = lambda i: F.conv(F.substring("d", 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)")
    total = rows.agg(F.count(F.lit(1)).alias("row_count"), *[F.sum(quarter(i)).alias(f"_{i}") for i in range(4)])
    return total.select("row_count", F.sha2(F.concat_ws(":", "row_count", *[f"_{i}" for i in range(4)]).cast("binary"), 256).alias("table_sha256"))


def ledger(families: dict[str, DataFrame]) -> DataFrame:
    """One ledger of all families' hotspots.

    Each table has region_id, hotspot_rank, score and lat_idx, lon_idx; ranks
    become percentiles in family and region, what a family has besides goes to
    line_specific_json. Rows are in the order of family, rank and id; an id
    that occurs twice is an error when the ledger is read.
    """
    parts = []
    for n, (family, df) in enumerate(families.items()):
        parts.append(
            df.select(
                "region_id",
                F.lit(family).alias("metric_family"),
                F.lit(n).alias("family_order"),
                "hotspot_rank",
                hotspot_id(family[:3], F.col("region_id"), "obs", F.col("hotspot_rank")).alias("analysis_object_id"),
                F.round(rank_percentile([F.col("hotspot_rank")], ("region_id",)), 9).alias("rank_percentile"),
                F.col("score").cast("double").alias("score"),
                canonical_json("lat_idx", "lon_idx").alias("line_specific_json"),
            )
        )
    every = reduce(DataFrame.unionByName, parts)
    times = F.count(F.lit(1)).over(Window.partitionBy("analysis_object_id"))
    once = F.when(times > 1, F.raise_error(F.concat(F.lit("not one row: "), F.col("analysis_object_id")))).otherwise(F.col("analysis_object_id"))
    return every.withColumn("analysis_object_id", once.cast("string")).orderBy("region_id", "family_order", "hotspot_rank", "analysis_object_id")


def single_row(table: DataFrame, region_id: str, family: str) -> DataFrame:
    """The one row of a region, or an error that says how many there are."""
    own = table.filter(F.col("region_id") == region_id)
    n = own.limit(2).count()
    if n != 1:
        raise ContractError(f"{family}, {region_id}: {'no row' if not n else 'more than one row'}")
    return own


def wide_evidence(regions: DataFrame, summaries: DataFrame, metrics: list[str]) -> DataFrame:
    """One row a region with each family's metrics as columns, family_metric; ``summaries`` has region_id, metric_family and metrics."""
    named = [F.max(F.when(F.col("metric_family") == f, F.col(m))).alias(f"{f}_{m}") for f in FAMILIES for m in metrics]
    own = summaries.groupBy(F.col("region_id").alias("_r")).agg(*named, F.countDistinct("metric_family").alias("n_families"))
    return regions.join(own, F.col("region_id") == F.col("_r"), "left").drop("_r").withColumn("n_families", F.coalesce("n_families", F.lit(0)))


def readiness(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """Per region and family ready, partial or missing, and whether all of a region's families are ready.

    ``rows`` has region_id, metric_family, n_objects, n_expected.
    """
    wanted = regions.select("region_id").join(rows.sparkSession.createDataFrame([(f,) for f in FAMILIES], "metric_family string"))  # a catalogue times three
    met = wanted.join(rows, ["region_id", "metric_family"], "left")
    status = F.when(F.coalesce("n_objects", F.lit(0)) == 0, "missing").when(F.col("n_objects") < F.col("n_expected"), "partial").otherwise("ready")
    return met.select("region_id", "metric_family", status.alias("status")).withColumn("region_ready", F.min((F.col("status") == "ready").cast("int")).over(Window.partitionBy("region_id")) == 1)


def overall_status(statuses: Column) -> Column:
    """The status of a run from those of its datasets."""
    return F.when(F.exists(statuses, lambda s: s == "participating") & F.exists(statuses, lambda s: s.startswith("failed")), "partial").when(F.exists(statuses, lambda s: s == "participating"), "ok").when(F.size(statuses) == 0, "empty").otherwise("failed")


def evidence_rows(regions: DataFrame, **families: DataFrame) -> DataFrame:
    """One row a region with each family's columns, prefixed by its name; regions without a row keep nulls."""
    out = regions
    for name, df in families.items():
        own = df.select(F.col("region_id").alias("_r"), *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != "region_id"])
        out = out.join(own, F.col("region_id") == F.col("_r"), "left").drop("_r")
    return out


def manifest_check(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Each listed path with ok, missing or size_mismatch."""
    f = found.select(F.col("path").alias("_p"), F.col("size").alias("found_size"))
    status = F.when(F.col("_p").isNull(), "missing").when(F.col("size") != F.col("found_size"), "size_mismatch").otherwise("ok")
    return manifest.join(f, F.col("path") == F.col("_p"), "left").withColumn("status", status).drop("_p")
