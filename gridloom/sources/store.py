"""Stored tables: cells partitioned by dataset and year, caches, manifests, loader registry."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import in_box
from ..functions.scalars import nan_to_null

# Datasets that the comparison leaves out, and those with classes fine enough to compare.
EXCLUDED_BINARY = ("berkeley_rwawc", "lstm_wetland")
FINE = ("g2017", "glwd_v2", "gwd30")


class UnsupportedDataset(ValueError):
    pass


_loaders: dict[str, Callable[..., DataFrame]] = {}


def register_loader(kind: str):
    """A decorator that names a function (spark, **options) -> cells."""

    def put(f):
        _loaders[kind] = f
        return f

    return put


def load(spark: SparkSession, kind: str, dataset_id: str, **options) -> DataFrame:
    if dataset_id == "lstm_wetland" or kind not in _loaders:
        raise UnsupportedDataset(f"{dataset_id}: {kind}")
    return _loaders[kind](spark, dataset_id=dataset_id, **options)


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, root: str, dataset_id: str) -> list[str]:
    """The names of a dataset's manifests, oldest first."""
    fs, p = _folder(spark, f"{root}/manifests/{dataset_id}")
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def dataset_ids(spark: SparkSession, root: str) -> list[str]:
    fs, p = _folder(spark, f"{root}/manifests")
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def current(spark: SparkSession, root: str, dataset_id: str) -> str:
    """The folder of a dataset's rows as of its last complete write."""
    names = _versions(spark, root, dataset_id)
    if not names:
        raise FileNotFoundError(f"{dataset_id} is not in {root}")
    return f"{root}/{names[-1].split('.', 1)[1]}"


@register_loader("standardized")
def standardized(spark: SparkSession, dataset_id: str, root: str, years: list[int] | None = None, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Cells of one dataset; years and box become partition and row-group filters."""
    cells = spark.read.parquet(current(spark, root, dataset_id)).filter(F.col("dataset_id") == dataset_id)
    if years is not None:
        cells = cells.filter(F.col("year").isin(*years) | F.col("year").isNull())
    if bbox is not None:
        cells = cells.filter(in_box(F.col("lat"), F.col("lon"), *bbox))
    return cells


def every_dataset(spark: SparkSession, root: str, year: int, exclude: tuple[str, ...] = (), bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """All static datasets, and one year of the others, as one table."""
    parts = [standardized(spark, d, root, [year], bbox) for d in dataset_ids(spark, root) if d not in exclude]
    if not parts:
        raise FileNotFoundError(f"no dataset in {root}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_cells(cells: DataFrame, root: str) -> None:
    """Cells as zstd Parquet by dataset and year; static datasets have a null year.

    Rows go to a folder of their own. A manifest a dataset, created last and
    whole or not at all, makes them that dataset's rows from then on; other
    datasets of the store stay as they are, and readers keep what they have
    begun to read. ``vacuum`` deletes what no manifest names any more.
    """
    spark, name = cells.sparkSession, f"rows-{uuid.uuid4().hex}"
    nan_to_null(cells).write.option("compression", "zstd").partitionBy("dataset_id", "year").parquet(f"{root}/{name}")
    fs, p = _folder(spark, f"{root}/{name}")
    for f in fs.listStatus(p):
        if not f.isDirectory():
            continue
        dataset_id = f.getPath().getName().removeprefix("dataset_id=")
        number = len(_versions(spark, root, dataset_id))
        _, manifest = _folder(spark, f"{root}/manifests/{dataset_id}/{number:09d}.{name}")
        if not fs.createNewFile(manifest):
            raise FileExistsError(f"another write of {dataset_id} came first")


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete the rows that no dataset's last manifest names, once nobody reads them; returns how many folders."""
    live = {_versions(spark, root, d)[-1].split(".", 1)[1] for d in dataset_ids(spark, root)}
    fs, p = _folder(spark, root)
    gone = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName().startswith("rows-") and f.getPath().getName() not in live]
    for path in gone:
        fs.delete(path, True)
    return len(gone)


@register_loader("table")
def melted_table(spark: SparkSession, dataset_id: str, path: str, variable: str, sentinels: tuple[float, ...] = (), scale: float = 1.0) -> DataFrame:
    """A wide Parquet or CSV table with lat_idx, lon_idx, ts and a variable, as cells."""
    raw = spark.read.option("header", True).option("inferSchema", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    v = F.col(variable).cast("double")
    v = F.when(~v.isin(*sentinels), v) if sentinels else v
    return nan_to_null(raw.select(F.lit(dataset_id).alias("dataset_id"), "ts", "lat_idx", "lon_idx", (v / scale).alias("value")))


def shared_folder(spark: SparkSession) -> None:
    """See that there is a checkpoint folder: that of spark.checkpoint.dir, or one of our own where none is set and the master is local."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        own = context.getConf().get("spark.checkpoint.dir")
        if not own and context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(own or tempfile.mkdtemp(prefix="checkpoints-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cached_surfaces(spark: SparkSession, root: str, dataset_ids: list[str], version: int) -> tuple[DataFrame | None, dict[str, str]]:
    """Cached coarse surfaces of one version, and why others were skipped."""
    found, skipped = None, {}
    for d in dataset_ids:
        try:
            df = spark.read.parquet(f"{root}/{d}")
        except Exception as error:  # noqa: BLE001 - the reader's error says what is missing
            skipped[d] = "missing" if "PATH_NOT_FOUND" in str(error) else "unreadable"
            continue
        if df.filter(F.col("cache_version") != version).limit(1).count():
            skipped[d] = "stale"
            continue
        found = df if found is None else found.unionByName(df)
    return found, skipped


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def participants(surfaces: DataFrame, fine: bool = False) -> DataFrame:
    return surfaces.filter(F.col("dataset_id").isin(*FINE)) if fine else surfaces.filter(~F.col("dataset_id").isin(*EXCLUDED_BINARY))


def month_slice(cells: DataFrame, target: str) -> DataFrame:
    """The time step of ``target``'s month; more than one is an error, none an empty result."""
    chosen = cells.filter(F.trunc("ts", "MM") == F.trunc(F.lit(target).cast("date"), "MM"))
    steps = chosen.select("ts").distinct().limit(2).count()
    if steps > 1:
        raise ValueError(f"{target} names more than one time step of its month")
    return chosen
