"""Queries of loaders, selections, contracts, tiles and whole comparisons over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import classes, grid, imagery, scalars, tiling
from ..operators import agreement, contract, hotspots, neighbours, selection, series, summaries, tiles
from ..sources import artefacts, files, loaders, store
from ..sources.driver_tables import REGIONS, observations, regions, table
from . import pipelines
from .registry import CELL, annual, fractions, placed, query, surfaces, votes

BOXES = [r[0:1] + r[2:] for r in REGIONS]
_OWN = "cast(sum(value) as bigint) as total, count(value) as n_values, count(*) as n"


def _own(df, *keys):
    return df.groupBy(*keys).agg(F.sum("value").alias("total"), F.count("value").alias("n_values"), F.count(F.lit(1)).alias("n"))


def _shared(spark) -> str:
    """A folder of this query's own in the shared checkpoint folder."""
    store.shared_folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/query-{uuid.uuid4().hex}"


# --- loaders -------------------------------------------------------------------------------------


@query(f"select dataset_id, 'gridded' as kind, cast(min(ts) as date) as first_day, {_OWN} from placed where lat between -10 and 10 and lon between 105 and 130 and ts between timestamp '1993-01-01' and timestamp '1996-06-30' group by all", "placed")
def finalized_cells(spark, sf):
    raw = placed(observations(spark, sf)).withColumnsRenamed({"lat": "latitude", "lon": "x", "ts": "time"}).withColumn("y", F.col("latitude"))
    made = loaders.finalize(raw, {"kind": "gridded"}, (105.0, -10.0, 130.0, 10.0), ("1993-01-01", "1996-06-30"), "EPSG:4326")
    own = made.groupBy("dataset_id", "kind").agg(F.min("ts").cast("date").alias("first_day"), F.sum("value").alias("total"), F.count("value").alias("n_values"), F.count(F.lit(1)).alias("n"))
    return own


_STEP = "select dataset_id, ts, lat_idx, lon_idx, sum(value) as v, min(class_id) as c from obs group by all"


def _steps(spark, sf):
    return observations(spark, sf).groupBy("dataset_id", "ts", *CELL).agg(F.sum("value").alias("v"), F.min("class_id").alias("c"))


@query(f"select month as ts, lat_idx, lon_idx, cast(v as double) as value from (select *, row_number() over (partition by month, lat_idx, lon_idx order by ts) as r from (select *, date_trunc('month', ts) as month from ({_STEP}) where dataset_id = 'r')) where r = 1 and month between timestamp '1992-03-01' and timestamp '1994-11-15'")
def monthly_file_loader(spark, sf):
    raw = _steps(spark, sf).filter("dataset_id = 'r'").select(F.concat(F.lit("/water/mask_"), F.date_format("ts", "yyyy-MM"), F.lit(".nc")).alias("path"), F.col("ts").alias("time"), *CELL, F.col("v").alias("water_mask"))
    made = store.load(spark, "monthly_files", "berkeley", raw=raw, variable="watermask", period=("1992-03-01", "1994-11-15"))
    return made.drop("dataset_id")


@query(f"select cast(date_trunc('month', ts) as date) as month, flag, count(*) as n, count(v) as n_values, round(sum(v), 6) as total from (select ts, c as flag, case when v is not null then cast(v as double) / 100 end as v from ({_STEP}) where ts >= timestamp '1993-02-01' and ts < timestamp '1995-04-01') group by all")
def daily_file_loader(spark, sf):
    raw = _steps(spark, sf).select(F.concat(F.lit("/swamps/fw_"), F.date_format("ts", "yyyyMMdd"), F.lit(".nc")).alias("path"), *CELL, F.coalesce("v", F.lit(-9999)).alias("fw"), F.col("c").alias("flag"))
    made = store.load(spark, "daily_files", "swamps", raw=raw, period=("1993-02-11", "1995-03-05"))
    return made.groupBy(F.trunc("ts", "MM").alias("month"), "flag").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"), F.round(F.sum("value"), 6).alias("total"))


@query(f"select dataset_id as config, 'f' || c as forcing, cast(year(ts) as int) as year, cast(month(ts) as int) as month, count(*) as n, cast(sum(v) as double) as total from ({_STEP}) where year(ts) between 1994 and 1996 group by all")
def ensemble_loader(spark, sf):
    raw = _steps(spark, sf).select(F.concat(F.lit("/top/"), "dataset_id", F.lit("/f"), F.col("c").cast("string"), F.lit("/fwet_x_reso025_"), F.year("ts").cast("string"), F.lit(".nc")).alias("path"), F.month("ts").alias("time"), *CELL, F.col("v").alias("fwet"))
    made = store.load(spark, "ensemble_files", "topmodel", raw=raw, years=(1994, 1996))
    return made.groupBy("config", "forcing", F.year("ts").alias("year"), F.month("ts").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("select config, cast(year as int) as year, lat_idx, lon_idx, round(cast(sum(value) as double) / count(value), 9) as value from (select dataset_id as config, year(ts) as year, * from obs) group by all")
def stacked_members(spark, sf):
    o = observations(spark, sf).withColumnRenamed("dataset_id", "config")
    early = F.year("ts") < 1996
    parts = [o.filter(~early), o.filter(early)]
    made = series.concatenated(parts)
    return made.groupBy("config", F.year("ts").alias("year"), *CELL).agg(scalars.mean(made, "value").alias("value"))


@query("select coalesce(c.lat_idx, h.lat_idx) as lat_idx, coalesce(c.lon_idx, h.lon_idx) as lon_idx, cast(h.k as int) as glwd_class, cast(nullif(c.class_id, 0) as int) as combined_class, h.ha as area_ha, h.pct as area_pct from (select * from votes where dataset_id = 'a') c full join (select coalesce(a.lat_idx, b.lat_idx) as lat_idx, coalesce(a.lon_idx, b.lon_idx) as lon_idx, coalesce(a.class_id, b.class_id) as k, a.n * 0.5::double as ha, b.n * 0.25::double as pct from (select * from fracs where dataset_id = 'n') a full join (select * from fracs where dataset_id = 'r') b on a.lat_idx = b.lat_idx and a.lon_idx = b.lon_idx and a.class_id = b.class_id) h on h.lat_idx = c.lat_idx and h.lon_idx = c.lon_idx", "votes fracs")
def class_area_loader(spark, sf):
    combined = votes(spark, sf).filter("dataset_id = 'a'").withColumn("class_id", F.when(F.col("class_id") == 0, 255).otherwise(F.col("class_id")))
    f = fractions(spark, sf)
    stack = lambda d, kind: f.filter(F.col("dataset_id") == d).select(F.concat(F.lit("/glwd/class_"), F.lpad(F.col("class_id").cast("string"), 2, "0"), F.lit(f"_{kind}.tif")).alias("path"), *CELL, F.col("n").alias("value"))
    return store.load(spark, "class_areas", "glwd_v2", combined=combined, hectares=stack("n", "ha"), percent=stack("r", "pct"), ha_scale=0.5, pct_scale=0.25).drop("dataset_id")


@query("select a.lat_idx, a.lon_idx, round(a.v, 9) as wetland, round(b.v, 9) as wetland_nolake, round(c.v, 9) as peatland from (select * from surf where dataset_id = 'a') a join (select * from surf where dataset_id = 'n') b on a.lat_idx = b.lat_idx and a.lon_idx = b.lon_idx join (select * from surf where dataset_id = 'r') c on a.lat_idx = c.lat_idx and a.lon_idx = c.lon_idx", "surf")
def aligned_raster_loader(spark, sf):
    s = surfaces(spark, sf)
    rasters = {name: s.filter(F.col("dataset_id") == d) for name, d in (("wetland", "a"), ("wetland_nolake", "n"), ("peatland", "r"))}
    return store.load(spark, "aligned_rasters", "g2017", rasters=rasters).drop("dataset_id")


_TILE = "select s_suppkey as tile_order, cast(s_suppkey % 30 as double) * 4 as west, cast(s_suppkey % 20 as double) * 2 - 20 as south from supplier"


@query(f"select cast(year as int) as year, cast(band as int) as band, lat_idx, lon_idx, arg_min(value, tile_order) as value, arg_min(lpad(cast(tile_order % 60 + 1 as varchar), 2, '0') || 'NAB', tile_order) as tile_code from (select supplier_id as tile_order, year(ts) as year, dayofyear(ts) // 92 as band, lat_idx, lon_idx, max(value) as value from obs where value is not null group by all) p join (select tile_order as t, west, south from ({_TILE})) t on t.t = p.tile_order where year in (1993, 1994) and west <= 60 and west + 5 >= 30 and south <= 5 and south + 5 >= -10 group by all")
def tile_mosaic_loader(spark, sf):
    k = F.col("s_suppkey")
    path = lambda tile, year: F.concat(F.lit("/tiles/"), year.cast("string"), F.lit("/"), F.lpad((tile % 60 + 1).cast("string"), 2, "0"), F.lit("NAB_"), tile.cast("string"), F.lit(".tif"))
    west, south = (k % 30).cast("double") * 4, (k % 20).cast("double") * 2 - 20
    listed = table(spark, sf, "supplier").withColumn("year", F.explode(F.array(*map(F.lit, range(1992, 1999)))))
    listed = listed.select(path(k, F.col("year")).alias("path"), "year", k.alias("tile_order"), west.alias("west"), south.alias("south"), (west + 5).alias("east"), (south + 5).alias("north"))
    o = observations(spark, sf)
    pixels = o.groupBy(path(F.col("supplier_id"), F.year("ts")).alias("path"), F.floor(F.dayofyear("ts") / 92).cast("int").alias("band"), *CELL).agg(F.max("value").alias("value"))
    made = store.load(spark, "tile_mosaic", "gwd30", tiles=listed, pixels=pixels, bbox=(30.0, -10.0, 60.0, 5.0), years=[1993, 1994])
    return made.drop("dataset_id")


@query("select dataset_id, cast(year as int) as year, count(*) as n, cast(sum(value) as double) as total from (select dataset_id, case when dataset_id = 'n' then null else year(ts) end as year, value * case when dataset_id = 'a' then 2 else 1 end as value from obs) where year is null or year = 1995 group by all")
def stored_datasets(spark, sf):
    """Datasets written one after another, one of them twice, read back for a year."""
    root = _shared(spark)
    o = placed(observations(spark, sf)).withColumn("year", F.when(F.col("dataset_id") != "n", F.year("ts"))).withColumn("value", F.col("value").cast("double"))
    store.write_cells(o.filter("dataset_id <> 'r'"), root)
    store.write_cells(o.filter("dataset_id = 'r'"), root)
    store.write_cells(o.filter("dataset_id = 'a'").withColumn("value", 2 * F.col("value")), root)
    store.vacuum(spark, root)
    return store.every_dataset(spark, root, 1995).groupBy("dataset_id", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("select dataset_id, case when dataset_id = 'n' then []::int[] else list_sort(list(distinct cast(year(ts) as int))) end as years, dataset_id = 'n' as is_static from obs group by dataset_id")
def listed_datasets(spark, sf):
    root = _shared(spark)
    o = observations(spark, sf).withColumn("year", F.when(F.col("dataset_id") != "n", F.year("ts")))
    store.write_cells(o.select("dataset_id", "year", *CELL, "value").distinct(), root)
    return files.available(spark, root)


@query("select dataset_id, cast(min(ts) as date) as start, cast(max(ts) as date) as stop from obs group by all")
def dataset_periods(spark, sf):
    return files.date_range(observations(spark, sf))


@query("select cast(make_date(cast(year as int), 1, 1) as date) as month, count(*) as n from (select distinct year(ts) as year, supplier_id from obs) where year between 1993 and 1996 group by all")
def files_of_period(spark, sf):
    named = observations(spark, sf).select(F.concat(F.lit("x_"), F.year("ts").cast("string"), F.lit("-01_"), F.col("supplier_id").cast("string"), F.lit("m.nc")).alias("name")).distinct()
    return files.by_month(named, "1993-01-31", "1996-01-01").groupBy("month").agg(F.count(F.lit(1)).alias("n"))


@query("select dataset_id as config, 'f' || class_id as forcing, cast(year(ts) as bigint) as year, count(*) as n from obs group by all")
def ensemble_members(spark, sf):
    o = observations(spark, sf)
    paths = o.select(F.concat(F.lit("/t/"), "dataset_id", F.lit("/f"), F.col("class_id").cast("string"), F.lit("/fwet_x_reso025_"), F.year("ts").cast("string"), F.lit(".nc")).alias("path"))
    return files.members(loaders.named(paths)).groupBy("config", "forcing", "year").agg(F.count(F.lit(1)).alias("n"))


@query("select cast(date_trunc('month', ts) as date) as month, dataset_id, count(*) as n, round(avg(v), 9) as mean_value from (select dataset_id, lat_idx, lon_idx, date_trunc('month', ts) as ts, cast(sum(value) as double) / count(value) as v from obs group by all) where ts = timestamp '1995-06-01' group by all")
def comparison_month(spark, sf):
    m = series.by_month(observations(spark, sf)).withColumnRenamed("month", "ts")
    return store.month_slice(m, "1995-06-17").groupBy(F.col("ts").alias("month"), "dataset_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))


@query("select d as dataset_id, count(*) filter (d <> 'berkeley_rwawc') as n_binary, count(*) filter (d <> 'swamps') as n_fine from (select case dataset_id when 'a' then 'berkeley_rwawc' when 'n' then 'gwd30' else 'swamps' end as d from obs) group by d")
def eligible_datasets(spark, sf):
    names = F.when(F.col("dataset_id") == "a", "berkeley_rwawc").when(F.col("dataset_id") == "n", "gwd30").otherwise("swamps")
    o = observations(spark, sf).withColumn("dataset_id", names)
    binary, fine = store.participants(o).withColumn("b", F.lit(1)), store.participants(o.withColumn("dataset_id", F.when(F.col("dataset_id") == "berkeley_rwawc", "glwd_v2").otherwise(F.col("dataset_id"))), fine=True)
    fine = fine.withColumn("dataset_id", F.when(F.col("dataset_id") == "glwd_v2", "berkeley_rwawc").otherwise(F.col("dataset_id")))
    counts = lambda df, name: df.groupBy("dataset_id").agg(F.count(F.lit(1)).alias(name))
    every = o.select("dataset_id").distinct()
    return every.join(counts(binary, "n_binary"), "dataset_id", "left").join(counts(fine, "n_fine"), "dataset_id", "left").select("dataset_id", F.coalesce("n_binary", F.lit(0)).alias("n_binary"), F.coalesce("n_fine", F.lit(0)).alias("n_fine"))


@query("select dataset_id, count(*) as n_rows, count(value) as n_values, count(*) filter (value is null) as n_missing, cast(min(ts) as date) as first_day, cast(max(ts) as date) as last_day, min(lat_idx) as top, max(lat_idx) as bottom, min(lon_idx) as \"left\", max(lon_idx) as \"right\" from obs group by all")
def loader_profile(spark, sf):
    return summaries.profile(observations(spark, sf), ["dataset_id"])


@query("select dataset_id, lat_idx, lon_idx from obs o where value is not null and ts = (select min(ts) from obs i where i.dataset_id = o.dataset_id) group by all")
def footprint_mask(spark, sf):
    return series.footprint(observations(spark, sf))


# --- scalars -------------------------------------------------------------------------------------


@query("select dataset_id, round(sum(case when value is not null then greatest(0, least(1, (value - 20) / 60::double)) end), 6) as total, count(value) as n from obs group by all")
def clipped_fractions(spark, sf):
    o = observations(spark, sf).withColumn("f", scalars.clip((F.col("value") - 20) / 60.0))
    return o.groupBy("dataset_id").agg(F.round(F.sum("f"), 6).alias("total"), F.count("f").alias("n"))


_WET = " union all ".join(f"select '{d}' as dataset_id, {w} as with_water, cast(unnest([{', '.join(map(str, sorted(classes.wetland_classes(d, w))))}]) as int) as class_id" for d in ("g2017", "gwd30") for w in (False, True))


@query("select dataset_id, with_water, class_id from (values " + ", ".join(f"('{r[0]}', {r[1]}, {r[2]})" for r in classes.CROSSWALK_ROWS if r[0] in ("g2017", "gwd30")) + ") as t(dataset_id, class_id, target) cross join (values (true), (false)) as w(with_water) where target <> 0 and (with_water or target <> 1)", "")
def wetland_class_ids(spark, sf):
    rows = [(d, w, c) for d in ("g2017", "gwd30") for w in (True, False) for c in classes.wetland_classes(d, w)]
    return spark.createDataFrame(rows, "dataset_id string, with_water boolean, class_id int")


@query("select lower(regexp_replace(o_orderpriority || '_' || year(o_orderdate), '_\\d{4}$', '')) as dataset_id, count(*) as n from orders group by all", "")
def normal_dataset_ids(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy(scalars.normal_dataset_id(F.concat_ws("_", "o_orderpriority", F.year("o_orderdate").cast("string"))).alias("dataset_id")).agg(F.count(F.lit(1)).alias("n"))


@query("select case when s_suppkey % 3 <> 0 then lpad(cast(s_suppkey % 60 + 1 as varchar), 2, '0') || 'NAB' end as tile_code, count(*) as n from supplier group by all", "")
def tile_codes_of_names(spark, sf):
    k = F.col("s_suppkey")
    name = F.when(k % 3 != 0, F.concat(F.lit("wet_"), F.lpad((k % 60 + 1).cast("string"), 2, "0"), F.lit("NAB-2001.tif"))).otherwise("wet_2001.tif")
    return table(spark, sf, "supplier").groupBy(scalars.tile_code_token(name).alias("tile_code")).agg(F.count(F.lit(1)).alias("n"))


@query("select strftime(ts, '%Y-%m-%dT%H:%M:%S') as source_time, count(*) as n from obs group by all")
def source_times(spark, sf):
    return observations(spark, sf).groupBy(scalars.iso_time(F.col("ts")).alias("source_time")).agg(F.count(F.lit(1)).alias("n"))


@query("select case when o_orderkey % 3 = 0 then null else 'v' || o_custkey % 7 end as variable, count(*) as n from orders group by all", "")
def named_variables(spark, sf):
    o = table(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, "nothing named").otherwise(F.concat(F.lit("no variable 'v"), (F.col("o_custkey") % 7).cast("string"), F.lit("' in file")))
    return o.groupBy(scalars.named_variable(text).alias("variable")).agg(F.count(F.lit(1)).alias("n"))


@query("select cast(s_suppkey % 37 as double) as west, cast(s_suppkey % 23 as double) - 40 as south, cast(s_suppkey % 37 as double) + 2.5 as east, cast(s_suppkey % 23 as double) - 38.5 as north, count(*) as n from supplier group by all", "")
def boxes_of_text(spark, sf):
    k = F.col("s_suppkey")
    text = F.concat_ws(", ", (k % 37).cast("string"), (k % 23 - 40).cast("string"), (k % 37 + 2.5).cast("string"), (k % 23 - 38.5).cast("string"))
    return table(spark, sf, "supplier").select(scalars.box_of_text(text).alias("b")).groupBy("b.west", "b.south", "b.east", "b.north").agg(F.count(F.lit(1)).alias("n"))


@query("select s_suppkey as id, greatest(-180, lon - 1.5) as west, greatest(-90, lat - 1.5) as south, least(180, lon + 1.5) as east, least(90, lat + 1.5) as north from (select s_suppkey, cast(s_suppkey % 181 as double) - 90 as lat, cast(s_suppkey * 7 % 361 as double) - 180 as lon from supplier)", "")
def boxes_around(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("id"), grid.box_around((k % 181).cast("double") - 90, (k * 7 % 361).cast("double") - 180, 3.0).alias("b")).select("id", "b.*")


@query("select cast(floor(lat_idx / 3) as varchar) || '_' || cast(floor(lon_idx / 3) as varchar) as chunk, count(*) as n from (select cast(lat_idx as double) as lat_idx, cast(lon_idx as double) as lon_idx from obs) group by all" .replace("cast(floor(lat_idx / 3) as varchar)", "cast(cast(floor(lat_idx / 3) as int) as varchar)").replace("cast(floor(lon_idx / 3) as varchar)", "cast(cast(floor(lon_idx / 3) as int) as varchar)"))
def grid_chunks(spark, sf):
    return observations(spark, sf).groupBy(tiles.chunk_key(F.col("lat_idx"), F.col("lon_idx"), 3).alias("chunk")).agg(F.count(F.lit(1)).alias("n"))


@query("select cast(greatest(date_trunc('month', d) - interval 1 month, date '1993-01-01') as date) as start, cast(least(last_day(cast(date_trunc('month', d) + interval 1 month as date)), date '1997-12-31') as date) as stop, count(*) as n from (select cast(ts as date) as d from obs) group by all")
def fusion_windows(spark, sf):
    w = imagery.fusion_window(F.col("ts").cast("date"), 1, "1993-01-01", "1997-12-31")
    return observations(spark, sf).select(w.alias("w")).groupBy("w.start", "w.stop").agg(F.count(F.lit(1)).alias("n"))


@query("select cast(greatest(make_date(cast(year(ts) as int), 1, 1) + cast((dayofyear(ts) - 1) // 8 * 8 as int), date '1993-02-18') as date) as composite, count(*) as n from obs group by all")
def composite_days(spark, sf):
    return observations(spark, sf).groupBy(imagery.eight_day_composite(F.col("ts").cast("date"), "1993-02-18").alias("composite")).agg(F.count(F.lit(1)).alias("n"))


@query("select make_date(cast(year(ts) as int), 1, 1) as start, make_date(cast(year(ts) as int) + 1, 1, 1) as stop, count(*) as n from obs group by all")
def annual_windows(spark, sf):
    return observations(spark, sf).select(imagery.annual_window(F.year("ts")).alias("w")).groupBy("w.start", "w.stop").agg(F.count(F.lit(1)).alias("n"))


# --- grids ---------------------------------------------------------------------------------------


@query("select lat_idx, lon_idx, 100.0::double + 5 * lon_idx as west, 15.0::double - 5 * lat_idx as south, 105.0::double + 5 * lon_idx as east, 20.0::double - 5 * lat_idx as north from obs group by lat_idx, lon_idx")
def cell_boxes(spark, sf):
    cells = observations(spark, sf).select(*CELL).distinct()
    lat = cells.select("lat_idx").distinct().withColumn("v", 17.5 - 5 * F.col("lat_idx"))
    lon = cells.select("lon_idx").distinct().withColumn("v", 102.5 + 5 * F.col("lon_idx"))
    return grid.cell_boxes(cells, grid.axis_edges(lat, "lat_idx", "v"), grid.axis_edges(lon, "lon_idx", "v"))


@query("select cast(i as int) as lat_idx, cast(j as int) as lon_idx, 20.0::double - i * 0.5::double as lat, 100.0::double + j * 0.5::double as lon from range(80) as a(i), range(80) as b(j) where 20 - i * 0.5 > -3.2 and 20 - (i + 1) * 0.5 < 7.3 and 100 + j * 0.5 < 131 and 100 + (j + 1) * 0.5 > 110.25", "")
def lattice_window(spark, sf):
    return grid.sub_lattice(spark, 100.0, -20.0, 140.0, 20.0, 0.5, (110.25, -3.2, 131.0, 7.3))


@query("select true as same, false as shifted, false as shorter from obs limit 1")
def aligned_axes(spark, sf):
    axis = observations(spark, sf).select("lat_idx").distinct().withColumn("lat", 17.5 - 5 * F.col("lat_idx"))
    test = lambda other: grid.same_axis(axis, other, "lat_idx", "lat")
    near, far = axis.withColumn("lat", F.col("lat") * (1 + 1e-9)), axis.withColumn("lat", F.col("lat") + 0.1)
    return test(near).select(F.col("aligned").alias("same")).join(test(far).select(F.col("aligned").alias("shifted"))).join(test(axis.filter("lat_idx < 7")).select(F.col("aligned").alias("shorter")))


@query("select cast(i as int) as lat_idx, cast(j as int) as lon_idx, 17.5::double - 5 * i as lat, 102.5::double + 5 * j as lon, case when abs(17.5 - 5 * i - 3) <= 2.5 and abs(102.5 + 5 * j - 121) <= 2.5 then (select cast(sum(value) as double) from obs) end as value from range(8) as a(i), range(8) as b(j)")
def single_cell_surface(spark, sf):
    one = observations(spark, sf).agg(F.sum("value").alias("value")).withColumns({"lat": F.lit(3.0), "lon": F.lit(121.0)})
    lattice = placed(spark.range(64).select(F.expr("cast(id div 8 as int)").alias("lat_idx"), F.expr("cast(id % 8 as int)").alias("lon_idx")))
    return grid.one_cell_everywhere(one, lattice, 5.0, 5.0)


@query("select dataset_id, lat_idx, lon_idx, round(v, 9) as value, case when exists (select 1 from surf m where m.dataset_id = 'a' and m.v >= 0.5 and m.lat_idx = s.lat_idx and m.lon_idx = s.lon_idx) then 1.0::double else 0 end as mask_fraction from surf s", "surf")
def shared_mask(spark, sf):
    s = surfaces(spark, sf)
    return grid.mask_fraction(s, s.filter("dataset_id = 'a' and value >= 0.5").select(*CELL, F.lit(1.0).alias("mask_fraction")))


_TRIANGLE = "select s_suppkey as id, cast(s_suppkey % 17 as double) as x, cast(s_suppkey % 13 as double) as y, cast(s_suppkey % 5 + 1 as double) as d from supplier"


@query(f"""select id, -- a right triangle (x, y), (x + d, y), (x, y + d) and the box 4..8 by 3..6: they meet if the box's nearest point to the legs lies under the hypotenuse
    x <= 8 and y <= 6 and x + d >= 4 and y + d >= 3 and greatest(x, 4) + greatest(y, 3) <= x + y + d as meets from ({_TRIANGLE})""", "")
def polygons_meet_boxes(spark, sf):
    k = F.col("s_suppkey")
    x, y, d = (k % 17).cast("double"), (k % 13).cast("double"), (k % 5 + 1).cast("double")
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    t = table(spark, sf, "supplier").select(k.alias("id"), F.array(point(x, y), point(x + d, y), point(x, y + d)).alias("polygon"))
    return t.select("id", tiling.polygon_meets_box("polygon", "4.0D", "3.0D", "8.0D", "6.0D").alias("meets"))


# --- tiles ---------------------------------------------------------------------------------------

_PIXEL = "select supplier_id % 5 as tile_id, lat_idx as pixel_y, lon_idx as pixel_x, class_id from obs"


@query(f"select cast(pixel_y // 2 as int) as lat_idx, cast(pixel_x // 2 as int) as lon_idx, round(sum(v) / count(v), 9) as value from (select tile_id, pixel_y, pixel_x, avg(case when class_id in (2, 3, 5) then 1.0::double else 0 end) as v from ({_PIXEL}) group by all) group by all")
def binary_surface(spark, sf):
    o = observations(spark, sf).select((F.col("supplier_id") % 5).alias("tile_id"), F.col("lat_idx").alias("pixel_y"), F.col("lon_idx").alias("pixel_x"), "class_id")
    return tiles.binary_surface(o, [2, 3, 5], [F.expr("cast(pixel_y div 2 as int)"), F.expr("cast(pixel_x div 2 as int)")])


@query("select lat_idx, lon_idx, count(f) as n_valid, round(avg(f), 9) as mean_fraction, round(stddev_pop(f), 9) as std_fraction from (select lat_idx, lon_idx, year(ts), cast(sum(value) as double) / nullif(count(value), 0) as f from obs group by all) group by all")
def pixel_statistics(spark, sf):
    stacks = observations(spark, sf).groupBy(*CELL, F.year("ts").alias("year")).agg(F.sum("value").alias("weighted"), F.count("value").alias("coverage"))
    return tiles.pixel_statistics(stacks, CELL)


@query("select supplier_id, lat_idx, lon_idx, case when count(value) > 0 then (sum(value) > 0)::int::double end as wet, (count(value) > 0)::int::double as covered, round(cast(sum(value) as double) / nullif(count(value), 0), 9) as fraction from obs group by all")
def tile_transforms(spark, sf):
    t = observations(spark, sf).groupBy("supplier_id", *CELL).agg(F.sum("value").alias("weighted"), F.count("value").alias("coverage"))
    for name in ("wet", "covered", "fraction"):
        t = tiles.transformed(t, name).withColumnRenamed("value", name)
    return t.drop("weighted", "coverage")


@query("select dataset_id, cast(sum(value) as bigint) as total, count(value) as n, max(value) as most from obs group by all")
def merged_by_tree(spark, sf):
    import pandas as pd

    schema = "dataset_id string, total long, n long, most long"
    parts = observations(spark, sf).filter("value is not null").groupBy("dataset_id", "supplier_id").agg(F.sum("value").alias("total"), F.count("value").alias("n"), F.max("value").alias("most")).drop("supplier_id")
    merge = lambda rows: pd.DataFrame([(rows["dataset_id"].iloc[0], rows["total"].sum(), rows["n"].sum(), rows["most"].max())], columns=["dataset_id", "total", "n", "most"])
    return tiles.tree_merged(parts, ["dataset_id"], merge, schema)


@query("select 'tile_' || k as path, case when not there then 'missing' when not listed then 'extra' when len <> 8 + k % 3 then 'size_mismatch' when k % 5 = 0 then 'not_tiff' else 'ok' end as status from (select s_suppkey as k, s_suppkey % 7 <> 0 as there, s_suppkey % 11 <> 0 as listed, case when s_suppkey % 13 = 0 then 99 else 8 + s_suppkey % 3 end as len from supplier) where there or listed", "")
def tile_audit(spark, sf):
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier")
    length = F.when(k % 13 == 0, 99).otherwise(8 + k % 3)
    content = F.when(k % 5 == 0, F.unhex(F.lit("47494638"))).when(k % 2 == 0, F.unhex(F.lit("49492A0008"))).otherwise(F.unhex(F.lit("4D4D002A00")))
    found = s.filter(k % 7 != 0).select(F.concat(F.lit("tile_"), k.cast("string")).alias("path"), length.alias("length"), content.alias("content"))
    listed = s.filter(k % 11 != 0).select(F.concat(F.lit("tile_"), k.cast("string")).alias("path"), (8 + k % 3).alias("size"))
    return tiles.tile_audit(found, listed)


@query("select cast(a.lat_idx // 2 as int) as lat_idx, cast(a.lon_idx // 2 as int) as lon_idx, cast(year(ts) as int) as band, round(cast(sum(value) as double) / count(value), 9) as value, count(value) as n_source from obs a group by all")
def regridded_bands(spark, sf):
    from ..operators import regrid

    return regrid.coarsen(observations(spark, sf).withColumn("band", F.year("ts")), 2, ("band",))


@query("select lat_idx, lon_idx, round(cast(sum(value) as double) / count(value), 9) as value, count(value) as n from placed where year(ts) = 1996 and lat between -15 and 15 and lon between 100 and 130 group by all", "placed")
def year_surface(spark, sf):
    return series.year_surface(placed(observations(spark, sf)), 1996, (100.0, -15.0, 130.0, 15.0))


# --- selections ----------------------------------------------------------------------------------

_SCORED = "select lat_idx, lon_idx, lat, lon, region_id, round(1 - abs(2 * (cast(count(*) filter (v >= 0.5) as double) / count(v)) - 1), 9) as score, count(v) as participant_count from (select s.*, 17.5::double - 5 * lat_idx as lat, 102.5::double + 5 * lon_idx as lon, coalesce((select arg_min(r.region_id, r.ord) from regions r where 17.5 - 5 * s.lat_idx between r.south and r.north and 102.5 + 5 * s.lon_idx between r.west and r.east), 'other') as region_id from yearly s) group by all having count(v) >= 2"
_YEARLY = "select dataset_id || year as dataset_id, lat_idx, lon_idx, v / 100 as v from annual where v is not null"


def _scored(spark, sf):
    s = annual(spark, sf).filter("value is not null").select(F.concat("dataset_id", F.col("year").cast("string")).alias("dataset_id"), *CELL, (F.col("value") / 100).alias("value"))
    v = agreement.binary_votes(s).filter("participant_count >= 2").withColumn("score", F.round("disagreement", 9))
    return grid.first_region(placed(v), BOXES).select(*CELL, "lat", "lon", "region_id", "score", "participant_count")


def _greedy(candidates: str, steps: str, n: int, cap: int, distance: float, order: str) -> str:
    """SQL of the two-pass selection: a step a region in order, then steps over all; the state is the list of those chosen."""
    far = f"len(list_filter(chosen, lambda y: sqrt(pow(y.lat - x.lat, 2) + pow(y.lon - x.lon, 2)) < {distance})) = 0"
    return f"""cand as ({candidates}), all_c as (select list(struct_pack(lat_idx := lat_idx, lon_idx := lon_idx, lat := lat, lon := lon, region_id := region_id, score := score) order by {order}) as c from cand where score > 0),
names as (select {steps} as r),
pick(k, chosen, c, r) as (select 0, c[1:0], c, r from all_c, names union all
    select k + 1, case when len(chosen) >= {n} then chosen else list_concat(chosen, list_filter(c, lambda x: {far} and case when k < len(r) then x.region_id = r[k + 1] else len(list_filter(chosen, lambda y: y.region_id = x.region_id)) < {cap} end)[1:1]) end, c, r
    from pick where k < len(r) + {n}),
last as (select chosen from pick order by k desc limit 1), done as (select unnest(range(1, len(chosen) + 1)) as i, chosen from last)
select chosen[i].region_id as region_id, chosen[i].lat_idx as lat_idx, chosen[i].lon_idx as lon_idx, chosen[i].score as score, cast(i as int) as hotspot_rank"""


_NAMES = "[" + ", ".join(f"'{r[0]}'" for r in REGIONS) + "]"


@query(f"yearly as ({_YEARLY}), {_greedy(_SCORED, _NAMES, 8, 2, 7.5, 'score desc, participant_count desc, lat desc, lon')}, 'rough-199706-' || chosen[i].region_id || '-' || lpad(cast(i as varchar), 3, '0') as aoi_id, chosen[i].lon - 1 as west, chosen[i].lat - 1 as south, chosen[i].lon + 1 as east, chosen[i].lat + 1 as north from done", "annual regions", recursive=True)
def focus_areas(spark, sf):
    made = selection.focus_areas(_scored(spark, sf), [r[0] for r in REGIONS], 8, 2, 7.5)
    return selection.named_areas(made, "1997-06-15").select("region_id", *CELL, "score", "hotspot_rank", "aoi_id", "west", "south", "east", "north")


_ENTROPY = "select lat_idx, lon_idx, sum(-p * log2(p)) / log2(8) as e from (select lat_idx, lon_idx, class_id, cast(count(*) as double) / sum(count(*)) over (partition by lat_idx, lon_idx) as p from obs group by lat_idx, lon_idx, class_id) group by all"
_CLUSTERS = f"""ent as ({_ENTROPY}), hot as (select lat_idx, lon_idx, e from ent where e >= (select quantile_cont(e, 0.5) from ent)),
reach(lat_idx, lon_idx, a, b) as (select lat_idx, lon_idx, lat_idx, lon_idx from hot union select h.lat_idx, h.lon_idx, r.a, r.b from reach r join hot h on abs(h.lat_idx - r.lat_idx) + abs(h.lon_idx - r.lon_idx) = 1),
lab as (select lat_idx, lon_idx, min(a * 1000 + b) as seed from reach group by all),
clu as (select cast(seed // 1000 as int) as lat_idx, cast(seed % 1000 as int) as lon_idx, count(*) as n_cells, avg(e) as mean_value, avg(17.5::double - 5 * l.lat_idx) as lat, avg(102.5::double + 5 * l.lon_idx) as lon from lab l join hot h on h.lat_idx = l.lat_idx and h.lon_idx = l.lon_idx group by seed having count(*) >= 2)"""
_CLU = "select *, round(mean_value, 9) as score, coalesce((select arg_min(r.region_id, r.ord) from regions r where c.lat between r.south and r.north and c.lon between r.west and r.east), 'other') as region_id from clu c"


@query(f"{_CLUSTERS}, {_greedy(_CLU, '[]::varchar[]', 5, 2, 6.0, 'score desc, lat_idx, lon_idx')}, 'entropy-' || chosen[i].region_id || '-' || lpad(cast(i as varchar), 3, '0') as hotspot_id from done", "obs regions", recursive=True)
def entropy_hotspots(spark, sf):
    e = placed(agreement.class_entropy(observations(spark, sf), 8))
    made = hotspots.entropy_hotspots(e, BOXES, 0.5, 2, 6.0, 5, 2)
    return made.select("region_id", F.col("seed_lat_idx").alias("lat_idx"), F.col("seed_lon_idx").alias("lon_idx"), F.round("mean_value", 9).alias("score"), "hotspot_rank", "hotspot_id")


_SITES = ", ".join(f"({i}, '{s[0]}', '{s[1]}', {s[2]}::double, {s[3]}::double)" for i, s in enumerate(selection.REPRESENTATIVE_SITES))


@query(f"select site_id, region_id, lon, lat, cast(row_number() over (order by ord) as int) as site_rank from (values {_SITES}) as t(ord, site_id, region_id, lon, lat) where not exists (select 1 from (select distinct 17.5::double - 5 * lat_idx as a, 102.5::double + 5 * lon_idx as b from obs) where sqrt(pow(lat - a, 2) + pow(lon - b, 2)) < 3)")
def representative_sites(spark, sf):
    return selection.representative_sites(placed(observations(spark, sf).select(*CELL).distinct()), 3.0)


_WALK = """listed as (select *, row_number() over (partition by region_id order by score desc, lat desc, lon) as pos from cand),
walk(region_id, pos, chosen) as (select region_id, 1, [struct_pack(lat := lat, lon := lon, lat_idx := lat_idx, lon_idx := lon_idx)] from listed where pos = 1 union all
    select l.region_id, l.pos, case when len(chosen) < 3 and len(list_filter(chosen, lambda y: sqrt(pow(y.lat - l.lat, 2) + pow(y.lon - l.lon, 2)) < 8)) = 0 then list_append(chosen, struct_pack(lat := l.lat, lon := l.lon, lat_idx := l.lat_idx, lon_idx := l.lon_idx)) else chosen end
    from walk w join listed l on l.region_id = w.region_id and l.pos = w.pos + 1)"""


@query(f"cand as (select region_id, lat_idx, lon_idx, 17.5::double - 5 * lat_idx as lat, 102.5::double + 5 * lon_idx as lon, cast(s as double) as score from (select lat_idx, lon_idx, sum(value) as s from obs group by all) c join regions r on 17.5 - 5 * lat_idx between r.south and r.north and 102.5 + 5 * lon_idx between r.west and r.east), {_WALK} select region_id, x.lat_idx as lat_idx, x.lon_idx as lon_idx from (select region_id, unnest(chosen) as x from walk qualify pos = max(pos) over (partition by region_id))", "obs regions", recursive=True)
def spaced_candidates(spark, sf):
    sums = observations(spark, sf).groupBy(*CELL).agg(F.sum("value").cast("double").alias("score"))
    c = grid.all_regions(placed(sums), regions(spark)).select("region_id", *CELL, "lat", "lon", "score")
    return neighbours.spaced(c, "region_id", ["score", "lat", "lon"], 8.0, 3).select("region_id", *CELL)


_WIN = "win as (select r.region_id, a.lat_idx, a.lon_idx, 17.5::double - 5 * a.lat_idx as lat, 102.5::double + 5 * a.lon_idx as lon, cast(sum(b.value) as double) / count(b.value) as score, count(b.value) as n_cells from sums a join sums b on abs(a.lat_idx - b.lat_idx) <= 1 and abs(a.lon_idx - b.lon_idx) <= 1 join regions r on 17.5 - 5 * a.lat_idx between r.south and r.north and 102.5 + 5 * a.lon_idx between r.west and r.east group by all)"


@query(f"sums as (select lat_idx, lon_idx, sum(value) as value from obs group by all), {_WIN}, high as (select w.* from win w join (select region_id as g, quantile_cont(score, 0.6) as t from win group by region_id) on g = region_id where score >= t), cand as (select * from high where n_cells >= 6), {_WALK} select region_id, count(*) as n_coarse, (select count(*) from win i where i.region_id = o.region_id) as n_valid, (select count(*) from high i where i.region_id = o.region_id) as n_candidates from (select region_id, unnest(chosen) as x from walk qualify pos = max(pos) over (partition by region_id)) o group by all", "obs regions", recursive=True)
def regional_selection(spark, sf):
    """Windows to hotspots of a region; counts of each stage. Refinement keeps all, at their own score."""
    sums = observations(spark, sf).groupBy(*CELL).agg(F.sum("value").alias("value"))
    boxed = neighbours.box(sums, 1)
    windows = grid.all_regions(placed(boxed), regions(spark)).select("region_id", *CELL, "lat", "lon", F.col("box_mean").alias("score"), F.col("box_count").alias("n_cells"))
    quotas = regions(spark).select("region_id", F.lit(3).alias("quota"))
    refine = lambda c: c.select("candidate_id", F.lit(1.0).alias("score"), F.lit(1).cast("long").alias("n_cells"))
    _, summary = hotspots.regional_selection(windows, quotas, refine, 0.6, 6, 8.0, 1)
    return summary.select("region_id", F.col("n_coarse").cast("long").alias("n_coarse"), F.col("n_valid").cast("long").alias("n_valid"), F.col("n_candidates").cast("long").alias("n_candidates"))


@query(f"select lat_idx, lon_idx, participant_count, round(score, 9) as disagreement, n_scores, min_score, max_score, round(mean_score, 9) as mean_score from (select *, count(*) over () as n_scores, min(score) over () as min_score, max(score) over () as max_score, avg(score) over () as mean_score from ({_SCORED})) order by score desc, participant_count desc, lat_idx, lon_idx limit 12".replace("from yearly s", f"from ({_YEARLY}) s"), "annual regions")
def disagreement_preview(spark, sf):
    v = _scored(spark, sf).withColumnRenamed("score", "disagreement")
    top, whole = summaries.disagreement(v, 12)
    return top.select(*CELL, "participant_count", "disagreement").join(F.broadcast(whole))


# --- contracts, evidence -------------------------------------------------------------------------


@query("select 'ready' as status, count(*) as row_count, round(sum(v), 6) as total from surf", "surf")
def artefact_round_trip(spark, sf):
    root = _shared(spark)
    s = surfaces(spark, sf)
    artefacts.write(s, root, "percentage_surface", "global", "obs", ("dataset_id", *CELL), year="all")
    back = artefacts.read(spark, root, "percentage_surface", "global", "obs", year="all")
    status = artefacts.status(spark, root, "percentage_surface", "global", "obs")
    return back.agg(F.count(F.lit(1)).alias("row_count"), F.round(F.sum("value"), 6).alias("total")).withColumn("status", F.lit(status))


@query("select '{\"type\":\"Feature\",\"properties\":{\"id\":' || s_suppkey || '},\"geometry\":{\"type\":\"Polygon\",\"coordinates\":[[[' || w || ',' || s || '],[' || e || ',' || s || '],[' || e || ',' || n || '],[' || w || ',' || n || '],[' || w || ',' || s || ']]]}}' as feature from (select s_suppkey, cast(s_suppkey % 37 as double) + 0.5 as w, cast(s_suppkey % 23 as double) + 0.5 as s, cast(s_suppkey % 37 as double) + 1.5 as e, cast(s_suppkey % 23 as double) + 1.5 as n from supplier)", "")
def box_features(spark, sf):
    k = F.col("s_suppkey")
    w, s = (k % 37).cast("double") + 0.5, (k % 23).cast("double") + 0.5
    return artefacts.feature_collection(table(spark, sf, "supplier").select(k.alias("id"), w.alias("west"), s.alias("south"), (w + 1).alias("east"), (s + 1).alias("north")))


@query("select o_orderpriority, case when ok and bad then 'partial' when ok then 'ok' else 'failed' end as status from (select o_orderpriority, bool_or(o_custkey % 50 = 1) as ok, bool_or(o_custkey % 50 = 2) as bad from orders group by all)", "")
def overall_statuses(spark, sf):
    k = F.col("o_custkey") % 50
    s = F.when(k == 1, "participating").when(k == 2, "failed_empty_harmonized_surface").otherwise("skipped_time_window")
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.collect_set(s).alias("s")).select("o_orderpriority", contract.overall_status(F.col("s")).alias("status"))


@query("select 'regional_table' as kind, count(*) as row_count, 'ready' as status from regions union all select 'surface', count(*), 'ready' from surf", "surf regions")
def evidence_pack(spark, sf):
    """Tables of a run written together, each with its manifest, and what they are."""
    tables = {"regional_table": regions(spark), "surface": surfaces(spark, sf)}
    return artefacts.write_pack(tables, _shared(spark), "global", "obs", year="all").select("kind", "row_count", "status")


_FAM = "select region_id, case dataset_id when 'a' then 'percentage' when 'n' then 'classification' else 'trend' end as metric_family, {} from placed p join regions r on p.lat between r.south and r.north and p.lon between r.west and r.east where not (dataset_id = 'n' and region_id = 'middle') group by all"


@query("select g.region_id, " + ", ".join(f"max(case when metric_family = '{f}' then {m} end) as {f}_{m}" for f in contract.FAMILIES for m in ("n_cells", "total")) + ", count(distinct metric_family) as n_families from regions g left join (" + _FAM.format("count(*) as n_cells, cast(sum(value) as bigint) as total") + ") f on f.region_id = g.region_id group by all", "placed regions")
def evidence_table(spark, sf):
    names = F.when(F.col("dataset_id") == "a", "percentage").when(F.col("dataset_id") == "n", "classification").otherwise("trend")
    o = grid.all_regions(placed(observations(spark, sf)), regions(spark)).filter("not (dataset_id = 'n' and region_id = 'middle')")
    s = o.groupBy("region_id", names.alias("metric_family")).agg(F.count(F.lit(1)).alias("n_cells"), F.sum("value").alias("total"))
    return contract.wide_evidence(regions(spark).select("region_id"), s, ["n_cells", "total"])


@query("select region_id, count(*) as n from placed p join regions r on p.lat between r.south and r.north and p.lon between r.west and r.east where region_id = 'south_west' group by all", "placed regions")
def single_summary_row(spark, sf):
    n = grid.all_regions(placed(observations(spark, sf)), regions(spark)).groupBy("region_id").agg(F.count(F.lit(1)).alias("n"))
    return contract.single_row(n, "south_west", "percentage")


@query("select a.s_suppkey as aoi_id, case when a.s_suppkey % 3 = 0 then 'img_' || a.s_suppkey end as image, (select count(*) from supplier) as n_areas from supplier a", "")
def review_manifest(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("aoi_id"))
    images = s.filter("aoi_id % 3 = 0").select("aoi_id", F.concat(F.lit("img_"), F.col("aoi_id").cast("string")).alias("image"))
    return summaries.review_manifest(s, images, s.agg(F.count(F.lit(1)).alias("n_areas")))


@query("select lat_idx, lon_idx, round(v, 9) as surface, cast(c as int) as class, round(m, 9) as masked, case when v is null then 'surface' when c is null then 'class' when m is null then 'masked' end as lost_at from (select g.lat_idx, g.lon_idx, s.v, k.class_id as c, case when s.v >= 0.5 then s.v end as m from (select distinct lat_idx, lon_idx from obs) g left join (select * from surf where dataset_id = 'a') s on s.lat_idx = g.lat_idx and s.lon_idx = g.lon_idx left join (select * from votes where dataset_id = 'a' and class_id <> 1) k on k.lat_idx = g.lat_idx and k.lon_idx = g.lon_idx)", "surf votes")
def hotspot_lineage(spark, sf):
    points = observations(spark, sf).select(*CELL).distinct()
    s = surfaces(spark, sf).filter("dataset_id = 'a'")
    stages = {"surface": s, "class": votes(spark, sf).filter("dataset_id = 'a' and class_id <> 1").withColumnRenamed("class_id", "value"), "masked": s.filter("value >= 0.5")}
    return summaries.lineage(points, stages, CELL)


_VALID = "select lat_idx, lon_idx, sum(case when class_id < 3 then 1 else 0 end) > 2 as joint_valid, mode_c as majority_class from (select o.*, m.mode_c from obs o join (select lat_idx as a, lon_idx as b, arg_max(class_id, n * 100 - class_id) as mode_c from (select lat_idx, lon_idx, class_id, count(*) as n from obs group by all) group by all) m on m.a = o.lat_idx and m.b = o.lon_idx) group by all"


@query(f"select count(*) as n_cells, count(*) filter (joint_valid and majority_class <> 0) as n_valid, round(sum(case when joint_valid and majority_class <> 0 then e end), 6) as shown from ({_VALID}) v join ({_ENTROPY}) e on e.lat_idx = v.lat_idx and e.lon_idx = v.lon_idx")
def valid_wetland_cells(spark, sf):
    o = observations(spark, sf)
    joint = o.groupBy(*CELL).agg((F.count_if(F.col("class_id") < 3) > 2).alias("joint_valid"))
    cells = joint.join(agreement.class_agreement(o), CELL).join(agreement.class_entropy(o, 8), CELL)
    valid = summaries.valid_wetland(cells).agg(F.count(F.lit(1)).alias("n_valid"))
    shown = summaries.shown_entropy(cells).agg(F.count(F.lit(1)).alias("n_cells"), F.round(F.sum("entropy"), 6).alias("shown"))
    return shown.join(valid)


# --- whole comparisons ---------------------------------------------------------------------------


@query("select region_id, month, dataset_id, count(*) filter (v >= 0.5) as n_wet, count(v) as n_cells from (select dataset_id, lat_idx, lon_idx, cast(date_trunc('month', ts) as date) as month, cast(sum(value) as double) / count(value) / 100 as v from obs group by all) c join regions r on 17.5 - 5 * lat_idx between r.south and r.north and 102.5 + 5 * lon_idx between r.west and r.east group by all", "obs regions")
def region_month_batch(spark, sf):
    """Regions times months as keys of one job."""
    m = series.by_month(observations(spark, sf)).withColumn("value", F.col("value") / 100)
    return grid.all_regions(placed(m), regions(spark)).groupBy("region_id", "month", "dataset_id").agg(F.count_if(F.col("value") >= 0.5).alias("n_wet"), F.count("value").alias("n_cells"))


_ROUGH = "case dataset_id when 'a' then 'berkeley_rwawc' when 'n' then 'gwd30' else 'swamps' end"


def _rough(spark, sf):
    names = F.when(F.col("dataset_id") == "a", "berkeley_rwawc").when(F.col("dataset_id") == "n", "gwd30").otherwise("swamps")
    s = placed(surfaces(spark, sf)).withColumns({"dataset_id": names, "value": F.when(names != "swamps", F.col("value")).otherwise(F.col("value") - 0.01)})
    return pipelines.rough(s, BOXES)


@query(f"select {_ROUGH} as dataset_id, count(v) as n_values, case when dataset_id = 'a' then 'skipped_not_eligible' else 'participating' end as status from surf group by all", "surf")
def rough_statuses(spark, sf):
    return _rough(spark, sf).statuses


@query("select lat_idx, lon_idx, count(v) as participant_count, round(cast(count(*) filter (v >= 0.5) as double) / count(v), 9) as vote_fraction, round(case when count(v) >= 2 then 1 - abs(2 * (cast(count(*) filter (v >= 0.5) as double) / count(v)) - 1) end, 9) as disagreement from (select lat_idx, lon_idx, case when dataset_id = 'r' then v - 0.01 else v end as v from surf where dataset_id <> 'a') group by all", "surf")
def rough_votes(spark, sf):
    return _rough(spark, sf).cells


@query("select series_type, region_id, dataset_id, count(*) as n, round(sum(value), 6) as total from (select 'monthly' as series_type, region_id, dataset_id, 100 * w / a as value from mon union all select 'annual', region_id, dataset_id, v from (select region_id, dataset_id, year(month) as y, avg(100 * w / a) as v from mon group by all having count(distinct month) = 12) union all select 'climatology', region_id, dataset_id, v from (select region_id, dataset_id, month(month) as m, avg(100 * w / a) as v from mon group by all)) group by all".replace("from mon ", "from (select region_id, dataset_id, cast(date_trunc('month', ts) as date) as month, sum(value * a) as w, sum(case when value is not null then a end) as a from (select p.*, r.region_id, (6371.0088 * 6371.0088 * (sin(radians(lat + 2.5)) - sin(radians(lat - 2.5))) * radians(5.0)) as a from placed p join regions r on p.lat between r.south and r.north and p.lon between r.west and r.east) group by all) mon ").replace("from mon)", "from (select 1) mon)"), "placed regions")
def regional_series(spark, sf):
    made = pipelines.regional(placed(observations(spark, sf)), regions(spark), 5.0)
    value = F.coalesce("value", F.when(F.col("series_type") == "monthly", F.col("wetland_percentage")))
    return made.groupBy("series_type", "region_id", "dataset_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 6).alias("total"))


@query("select count(*) as n, count(*) filter (status = 'computed') as n_computed, (select count(*) from (select lat_idx, lon_idx from tests where status = 'computed' group by all)) as n_cells, 'computed' as status from tests", "tests")
def trend_comparison(spark, sf):
    tested, agreed, window = pipelines.trend(observations(spark, sf), 3)
    counts = tested.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "computed").alias("n_computed"))
    return counts.join(agreed.agg(F.count(F.lit(1)).alias("n_cells"))).join(window.select("status"))


_NAMED = "case dataset_id when 'a' then 'g2017' when 'n' then 'glwd_v2' else 'gwd30' end"


@query("select dataset_id, count(*) as n, round(sum(case when class_id between 2 and 7 then fraction end), 6) as wet from fracs group by all", "fracs")
def standardized_classes(spark, sf):
    """Classes of each dataset on a common grid, and the share of the wet ones."""
    o = observations(spark, sf)
    one = spark.range(8).select(F.col("id").cast("int").alias("src"), F.col("id").cast("int").alias("dst"), F.lit(1.0).alias("weight"))
    f = pipelines.standardize(o, one, one, ("dataset_id",), classes=True)
    return f.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.when(F.col("class_id").between(2, 7), F.col("fraction"))), 6).alias("wet"))


@query("select dataset_id, lat_idx, lon_idx, round(greatest(0, least(1, v)), 9) as value from surf", "surf")
def standardized_fractions(spark, sf):
    one = spark.range(8).select(F.col("id").cast("int").alias("src"), F.col("id").cast("int").alias("dst"), F.lit(1.0).alias("weight"))
    return pipelines.standardize(surfaces(spark, sf), one, one, ("dataset_id",))


@query("select dataset_id, lat_idx, lon_idx, round(v, 9) as value from surf", "surf")
def surface_bundle(spark, sf):
    s = surfaces(spark, sf)
    return series.bundle({d: s.filter(F.col("dataset_id") == d).select(*CELL, "value") for d in ("a", "n", "r")})


@query("select region_id, metric_family, cast(fo as int) as family_order, cast(r as int) as hotspot_rank, lat_idx, lon_idx from (select region_id, metric_family, fo, lat_idx, lon_idx, row_number() over (partition by region_id, metric_family order by x desc, lat_idx, lon_idx) as r from (select 'percentage' as metric_family, 0 as fo, lat_idx, lon_idx, cast(sum(value) as bigint) as x from obs group by lat_idx, lon_idx union all select 'classification', 1, lat_idx, lon_idx, max(n) from (select lat_idx, lon_idx, class_id, count(*) as n from obs group by all) group by lat_idx, lon_idx union all select 'trend', 2, lat_idx, lon_idx, count(*) from obs where value is null group by lat_idx, lon_idx) f join regions g on 17.5 - 5 * f.lat_idx between g.south and g.north and 102.5 + 5 * f.lon_idx between g.west and g.east) where r <= 2 and region_id in ('south_west', 'middle')", "obs regions")
def ordered_hotspot_rows(spark, sf):
    """The ledger of all three families, for the regions asked for in that order."""
    o = observations(spark, sf)
    top = lambda q, v: hotspots.ranked_top(grid.all_regions(placed(q), regions(spark)), "region_id", [F.desc(v), F.asc("lat_idx"), F.asc("lon_idx")], 2).withColumn("score", F.col(v).cast("double"))
    ledger = contract.ledger({
        "percentage": top(o.groupBy(*CELL).agg(F.sum("value").alias("v")), "v"),
        "classification": top(agreement.class_agreement(o), "agreement_count"),
        "trend": top(o.filter("value is null").groupBy(*CELL).agg(F.count(F.lit(1)).alias("v")), "v"),
    })
    rows = files.in_order(ledger, "region_id", ["south_west", "middle"])
    place = F.from_json("line_specific_json", "lat_idx int, lon_idx int")
    return rows.select("region_id", "metric_family", "family_order", "hotspot_rank", place["lat_idx"].alias("lat_idx"), place["lon_idx"].alias("lon_idx"))


@query("select o_orderpriority, count(*) as n_tasks from orders o left join (select l_orderkey as k, count(*) as n from lineitem where l_linenumber > 1 group by all) l on l.k = o.o_orderkey where coalesce(n, 0) <> o_custkey % 4 group by all", "")
def download_tasks(spark, sf):
    """What a manifest lists and is missing or of another size, to be loaded again."""
    m = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), (F.col("o_custkey") % 4).alias("size"), "o_orderpriority")
    found = table(spark, sf, "lineitem").filter("l_linenumber > 1").groupBy(F.col("l_orderkey").alias("path")).agg(F.count(F.lit(1)).alias("size"))
    checked = contract.manifest_check(m.filter("size <> 0"), found).filter("status <> 'ok'").unionByName(contract.manifest_check(m.filter("size = 0"), found).filter("status = 'size_mismatch'"))
    return checked.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_tasks"))


@query("select event_id, user_id, arg_max(e2, ts2) as latest_view from (select a.event_id, a.user_id, b.event_id as e2, b.ts as ts2 from events a left join events b on b.user_id = a.user_id and b.event_type = 'view' and b.ts < a.ts where a.event_type <> 'view') group by all", "")
def as_of_events(spark, sf):
    """Each event with the same user's last view before it: one sort by user and time, no pairs."""
    e = table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    return e.withColumn("latest_view", F.max_by(F.when(F.col("event_type") == "view", F.col("event_id")), F.when(F.col("event_type") == "view", F.col("ts"))).over(w)).filter("event_type <> 'view'").select("event_id", "user_id", "latest_view")


@query("select dataset_id, cast(year(ts) as int) as year, count(*) as n from obs group by rollup (dataset_id, year(ts))")
def rolled_up_counts(spark, sf):
    return observations(spark, sf).withColumn("year", F.year("ts")).rollup("dataset_id", "year").agg(F.count(F.lit(1)).alias("n"))
