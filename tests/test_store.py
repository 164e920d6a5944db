"""Stored tables, registry, caches, manifests and streaming."""

import pytest
from pyspark.sql import functions as F

from gridloom import schema
from gridloom.sources import store
from gridloom.streaming import running


def cells(spark):
    rows = [("a", 2000 + i % 3, i % 4, i % 5, 1.0 * (i % 4), 2.0 * (i % 5), float("nan") if i == 7 else i / 10) for i in range(30)] + [("s", None, 0, 0, 0.0, 0.0, 1.0)]
    return spark.createDataFrame(rows, "dataset_id string, year int, lat_idx int, lon_idx int, lat double, lon double, value double")


def test_standardized_round_trip_and_pruning(spark, tmp_path):
    store.write_cells(cells(spark), f"{tmp_path}/cells")
    got = store.load(spark, "standardized", "a", root=f"{tmp_path}/cells", years=[2001], bbox=(0.0, 0.0, 4.0, 2.0))
    assert {r["year"] for r in got.select("year").distinct().collect()} == {2001}
    assert got.filter("value is null or value = 'NaN'").count() <= 1 and got.filter(F.isnan("value")).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset_id" in plan and "GreaterThanOrEqual(lat" in plan
    assert store.load(spark, "standardized", "s", root=f"{tmp_path}/cells", years=[2001]).count() == 1


def test_writes_leave_other_datasets_alone(spark, tmp_path):
    root = f"{tmp_path}/cells"
    c = cells(spark)
    store.write_cells(c.filter("dataset_id = 'a'"), root)
    first = store.standardized(spark, "a", root)
    store.write_cells(c.filter("dataset_id = 's'"), root)
    assert store.dataset_ids(spark, root) == ["a", "s"] and store.standardized(spark, "a", root).count() == 30
    store.write_cells(c.filter("dataset_id = 'a' and year = 2000"), root)
    assert store.standardized(spark, "a", root).count() == 10 and store.standardized(spark, "s", root).count() == 1
    assert first.count() == 30  # who had begun to read the first rows still can
    assert store.vacuum(spark, root) == 1 and store.every_dataset(spark, root, 2000).count() == 11
    with pytest.raises(FileNotFoundError):
        store.standardized(spark, "b", root)


def test_unknown_loaders(spark):
    with pytest.raises(store.UnsupportedDataset):
        store.load(spark, "standardized", "lstm_wetland", root="x")
    with pytest.raises(store.UnsupportedDataset):
        store.load(spark, "nothing", "a")


def test_caches(spark, tmp_path):
    make = lambda v: spark.createDataFrame([(0, 0, 0.5, v)], "lat_idx int, lon_idx int, value double, cache_version int")
    make(2).write.parquet(f"{tmp_path}/a")
    make(1).write.parquet(f"{tmp_path}/b")
    found, skipped = store.cached_surfaces(spark, str(tmp_path), ["a", "b", "c"], 2)
    assert found.count() == 1 and skipped == {"b": "stale", "c": "missing"}


def test_month_slice(spark):
    c = spark.sql("select 'a' as dataset_id, cast(t as timestamp) as ts from values ('2000-01-05'), ('2000-02-05'), ('2000-02-06') as v(t)")
    assert store.month_slice(c, "2000-01-31").count() == 1 and store.month_slice(c, "2001-01-01").count() == 0
    with pytest.raises(ValueError, match="more than one"):
        store.month_slice(c, "2000-02-01")


def test_schema_contract(spark):
    with pytest.raises(schema.ContractError, match="missing"):
        schema.require(spark.range(1), schema.REGION)
    with pytest.raises(schema.ContractError):
        schema.require_unique(spark.createDataFrame([(1,), (1,)], "k int"), "k")


def test_sessions_stream(spark, tmp_path):
    rows = spark.sql("select 'u' as user_id, cast(t as timestamp) as ts from values ('2000-01-01 00:00:00'), ('2000-01-01 00:04:00'), ('2000-01-01 01:00:00') as v(t)")
    rows.write.parquet(f"{tmp_path}/in")
    s = running.sessions(running.event_stream(spark, f"{tmp_path}/in", rows.schema), "10 minutes", "user_id")
    got = running.drained(s, "sessions_test", "complete", f"{tmp_path}/state").orderBy("session_start").collect()
    assert [r["n_events"] for r in got] == [2, 1]
