"""The library's queries over the driver's tables: agreement, classes, series, trends, neighbourhoods, grids."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import classes, grid, imagery, scalars, tiling
from ..operators import agreement, contract, hotspots, neighbours, regrid, series, summaries, tiles, trends
from ..sources import files, store
from ..sources.driver_tables import REGIONS, observations, regions, table
from ..streaming import running
from .registry import AREA, CELL, ERFC, annual, fractions, placed, query, surfaces, votes

# --- dispersion, binary votes, pairs -------------------------------------------------------------


@query("select lat_idx, lon_idx, round(cast(sum(value) as double) / count(value), 9) as mean_value, round(case when count(value) >= 2 then sqrt(cast(count(value) * sum(value * value) - sum(value) * sum(value) as double) / cast(count(value) * count(value) as double)) end, 9) as std_value, count(value) as participant_count from obs group by all")
def cell_dispersion(spark, sf):
    return agreement.cell_dispersion(observations(spark, sf), excluded=())


@query("select lat_idx, lon_idx, round(cast(sum(value) as double) / count(value), 9) as mean_value, round(case when count(value) filter (dataset_id <> 'r') >= 2 then sqrt(cast(count(value) filter (dataset_id <> 'r') * sum(value * value) filter (dataset_id <> 'r') - (sum(value) filter (dataset_id <> 'r')) * (sum(value) filter (dataset_id <> 'r')) as double) / cast((count(value) filter (dataset_id <> 'r')) * (count(value) filter (dataset_id <> 'r')) as double)) end, 9) as std_value, count(value) filter (dataset_id <> 'r') as participant_count from obs group by all")
def std_eligible_dispersion(spark, sf):
    return agreement.cell_dispersion(observations(spark, sf), excluded=("r",))


@query("select dataset_id, lat_idx, lon_idx, count(value) as n from (select o.dataset_id, o.lat_idx, o.lon_idx, case when exists (select 1 from obs m where m.dataset_id = 'r' and m.value >= 95 and m.supplier_id % 3 = 0 and m.lat_idx = o.lat_idx and m.lon_idx = o.lon_idx) then o.value end as value from obs o) group by all")
def landmask_cells(spark, sf):
    o = observations(spark, sf)
    mask = o.filter((F.col("dataset_id") == "r") & (F.col("value") >= 95) & (F.col("supplier_id") % 3 == 0)).withColumn("dataset_id", F.lit("mask"))
    kept = agreement.landmask(o.unionByName(mask), "mask").filter("dataset_id <> 'mask'")
    return kept.groupBy("dataset_id", *CELL).agg(F.count("value").alias("n"))


@query("select lat_idx, lon_idx, count(v) as participant_count, round(cast(count(*) filter (v >= 0.5) as double) / count(v), 9) as vote_fraction, round(case when count(v) >= 2 then 1 - abs(2 * (cast(count(*) filter (v >= 0.5) as double) / count(v)) - 1) end, 9) as disagreement from surf group by all", "surf")
def rough_binary_cells(spark, sf):
    return agreement.binary_votes(surfaces(spark, sf))


_PAIR = "select a.dataset_id as dataset_a, b.dataset_id as dataset_b, count(*) filter (a.v >= 0.5 and b.v >= 0.5) as tp, count(*) filter (a.v < 0.5 and b.v < 0.5) as tn, count(*) filter (a.v >= 0.5 and b.v < 0.5) as fp, count(*) filter (a.v < 0.5 and b.v >= 0.5) as fn from surf a join surf b on a.lat_idx = b.lat_idx and a.lon_idx = b.lon_idx and a.dataset_id < b.dataset_id where a.v is not null and b.v is not null group by all"


@query(f"select *, tp + tn + fp + fn as n_cells, round(cast(tp + tn as double) / nullif(tp + tn + fp + fn, 0), 9) as overall_accuracy, round(cast(tp as double) / nullif(tp + fn, 0), 9) as producer_accuracy, round(cast(tp as double) / nullif(tp + fp, 0), 9) as user_accuracy, round(cast(tp as double) / nullif(tp + fp + fn, 0), 9) as iou, round(cast(2 * tp as double) / nullif(2 * tp + fp + fn, 0), 9) as f1 from ({_PAIR})", "surf")
def pairwise_metrics(spark, sf):
    return agreement.pair_metrics(surfaces(spark, sf)).drop("kappa")


@query(f"select dataset_a, dataset_b, round(case when abs(1 - pe) > 1e-8 then (po - pe) / (1 - pe) end, 9) as kappa from (select *, cast(tp + tn as double) / (tp + tn + fp + fn) as po, cast((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn) as double) / (cast(tp + tn + fp + fn as double) * (tp + tn + fp + fn)) as pe from ({_PAIR}))", "surf")
def pairwise_kappa(spark, sf):
    return agreement.pair_metrics(surfaces(spark, sf)).select("dataset_a", "dataset_b", "kappa")


@query(f"select round(max(iou), 9) as max_iou, round(min(iou), 9) as min_iou, count(*) as n_pairs from (select cast(tp as double) / nullif(tp + fp + fn, 0) as iou from ({_PAIR}))", "surf")
def pairwise_summary(spark, sf):
    return agreement.pair_metrics(surfaces(spark, sf)).agg(F.max("iou").alias("max_iou"), F.min("iou").alias("min_iou"), F.count(F.lit(1)).alias("n_pairs"))


# --- classes -------------------------------------------------------------------------------------


@query("select lat_idx, lon_idx, cast(sum(n) as bigint) as valid_count, arg_max(class_id, n * 100 - class_id) as majority_class, max(n) as agreement_count from (select lat_idx, lon_idx, class_id, count(*) as n from obs group by all) group by all")
def class_agreement(spark, sf):
    return agreement.class_agreement(observations(spark, sf))


_ENTROPY = "select lat_idx, lon_idx, round(sum(case when class_id between 0 and {k} - 1 then -p * log2(p) else 0 end) / log2({k}), 9) as entropy from (select lat_idx, lon_idx, class_id, cast(count(*) as double) / sum(count(*)) over (partition by lat_idx, lon_idx) as p from obs group by lat_idx, lon_idx, class_id) group by all"


@query(_ENTROPY.format(k=4))
def entropy_k4(spark, sf):
    return agreement.class_entropy(observations(spark, sf), 4)


@query(_ENTROPY.format(k=8))
def entropy_k8(spark, sf):
    return agreement.class_entropy(observations(spark, sf), 8)


_RANK = "case class_id " + " ".join(f"when {c} then {i}" for i, c in enumerate(classes.PRIORITY)) + " end"


@query(f"select lat_idx, lon_idx, round(case max(n) when 3 then 0 when 2 then (-(2.0::double/3) * log2(2.0::double/3) - (1.0::double/3) * log2(1.0::double/3)) / log2(3) else 1 end, 9) as entropy, arg_max(class_id, n * 100 - {_RANK}) as majority_class, max(n) as agreement_count from (select lat_idx, lon_idx, class_id, count(*) as n from votes group by all) group by lat_idx, lon_idx having sum(n) = 3", "votes")
def vote_entropy3(spark, sf):
    return agreement.vote_entropy3(votes(spark, sf))


@query(f"select dataset_id, lat_idx, lon_idx, class_id as dominant_class from (select *, row_number() over (partition by dataset_id, lat_idx, lon_idx order by {_RANK}) as r from (select *, max(fraction) over (partition by dataset_id, lat_idx, lon_idx) as top from fracs) where fraction >= top - 1e-12) where r = 1", "fracs")
def dominant_priority(spark, sf):
    return agreement.dominant_class(fractions(spark, sf), keys=("dataset_id", *CELL))


@query(f"select dataset_id, lat_idx, lon_idx, class_id as dominant_class from (select *, row_number() over (partition by dataset_id, lat_idx, lon_idx order by {_RANK}) as r from (select *, max(fraction) over (partition by dataset_id, lat_idx, lon_idx) as top from (select *, max(case when class_id not in (0, 1) then 1 else 0 end) over (partition by dataset_id, lat_idx, lon_idx) as wet from fracs) where wet = case when class_id in (0, 1) then 0 else 1 end) where fraction >= top - 1e-12) where r = 1", "fracs")
def dominant_tiered(spark, sf):
    return agreement.tiered_dominant_class(fractions(spark, sf), keys=("dataset_id", *CELL))


@query("select dataset_id, lat_idx, lon_idx, arg_max(class_id, n * 100 - class_id) as dominant_class from fracs group by all", "fracs")
def source_dominant(spark, sf):
    return agreement.source_dominant_class(fractions(spark, sf))


@query("select dataset_id, lat_idx, lon_idx, class_id as mode_class from votes", "votes")
def temporal_mode(spark, sf):
    return agreement.temporal_mode(observations(spark, sf))


_XW = ", ".join(f"('{s}', '{r[0]}', {r[1]}, {r[2 + i]})" for i, s in enumerate(classes.SCHEMES) for r in classes.CROSSWALK_ROWS)


@query(f"select dataset_id, target_class, count(*) as n from (select 'gwd30' as dataset_id, cast(x.t as int) as target_class from obs o left join (select * from (values {_XW}) as w(scheme, d, c, t)) x on x.scheme = 'fine8' and x.d = 'gwd30' and x.c = o.class_id * 2) group by all")
def class_crosswalk(spark, sf):
    o = observations(spark, sf).select(F.lit("gwd30").alias("dataset_id"), (F.col("class_id") * 2).alias("class_id"))
    return classes.mapped(o, "fine8").groupBy("dataset_id", "target_class").agg(F.count(F.lit(1)).alias("n"))


@query(f"select cast(scheme as varchar) as scheme, d as dataset_id, cast(count(*) as bigint) as n_source, cast(count(distinct t) as bigint) as n_target from (values {_XW}) as w(scheme, d, c, t) group by all", "")
def crosswalk_sizes(spark, sf):
    return classes.crosswalk(spark).groupBy("scheme", "dataset_id").agg(F.count(F.lit(1)).alias("n_source"), F.countDistinct("target_class").alias("n_target"))


@query("select dataset_id, lat_idx, lon_idx, class_id, round(fraction, 9) as fraction from fracs", "fracs")
def class_fractions(spark, sf):
    return fractions(spark, sf).drop("n")


@query(f"select ds as dataset_id, lat_idx, lon_idx, class_id, round(sum(f), 9) as fraction from (select case f.dataset_id when 'a' then 'g2017' when 'n' then 'glwd_v2' else 'gwd30' end as ds, lat_idx, lon_idx, cast(x.t as int) as class_id, fraction as f from fracs f join (select * from (values {_XW}) as w(scheme, d, c, t)) x on x.scheme = 'yaml8' and x.d = case f.dataset_id when 'a' then 'g2017' when 'n' then 'glwd_v2' else 'gwd30' end and x.c = f.class_id + 7) group by all", "fracs")
def unified_fractions(spark, sf):
    names = F.when(F.col("dataset_id") == "a", "g2017").when(F.col("dataset_id") == "n", "glwd_v2").otherwise("gwd30")
    f = fractions(spark, sf).select(names.alias("dataset_id"), *CELL, (F.col("class_id") + 7).cast("int").alias("class_id"), "fraction")
    return series.unified_fractions(f)


@query("select lat_idx, lon_idx, count(*) filter (s > 0) as valid_datasets, count(*) filter (s > 0) = 3 as joint_valid from (select dataset_id, lat_idx, lon_idx, sum(case when class_id < 3 then n else 0 end) as s from fracs group by all) group by all", "fracs")
def joint_valid(spark, sf):
    f = fractions(spark, sf).withColumn("fraction", F.when(F.col("class_id") < 3, F.col("fraction")).otherwise(0.0))
    return agreement.joint_valid(f, 3)


@query("select a.class_id as from_class, b.class_id as to_class, count(*) as n_cells from votes a join votes b on a.lat_idx = b.lat_idx and a.lon_idx = b.lon_idx and a.dataset_id = 'a' and b.dataset_id = 'n' group by all", "votes")
def transition_matrix(spark, sf):
    v = votes(spark, sf)
    return agreement.transitions(v.filter("dataset_id = 'a'"), v.filter("dataset_id = 'n'"), "class_id")


@query("select a.class_id, count(*) as n_cells, max(abs(a.n - b.n)) as max_abs_diff, round(cast(sum(abs(a.n - b.n)) as double) / count(*), 9) as mean_abs_diff, count(*) filter (a.n <> b.n) as changed_cells from fracs a join fracs b on a.lat_idx = b.lat_idx and a.lon_idx = b.lon_idx and a.class_id = b.class_id and a.dataset_id = 'a' and b.dataset_id = 'n' group by all", "fracs")
def cube_abs_diff(spark, sf):
    f = fractions(spark, sf)
    return agreement.cube_difference(f.filter("dataset_id = 'a'"), f.filter("dataset_id = 'n'"), [*CELL, "class_id"], "n")


@query(f"select class_id, round(100 * sum({AREA} * n) / sum(sum({AREA} * n)) over (), 9) as area_share from fracs group by class_id", "fracs")
def area_share_by_class(spark, sf):
    area = grid.cell_area_km2(15.0 - 5 * F.col("lat_idx"), 20.0 - 5 * F.col("lat_idx"), F.lit(0.0), F.lit(5.0))
    of = fractions(spark, sf).groupBy("class_id").agg(F.sum(area * F.col("n")).alias("a"))  # a row a class
    return of.select("class_id", (100 * F.col("a") / F.sum("a").over(Window.partitionBy(F.lit(1)))).alias("area_share"))


# --- time ----------------------------------------------------------------------------------------


@query("select dataset_id, lat_idx, lon_idx, cast(date_trunc('month', ts) as date) as month, round(cast(sum(value) as double) / count(value), 9) as value, count(value) as n from obs group by all")
def monthly_mean(spark, sf):
    return series.by_month(observations(spark, sf))


@query("select dataset_id, lat_idx, lon_idx, cast(date_trunc('month', ts) as date) as month, cast(max(value) as double) as value, count(value) as n from obs group by all")
def monthly_max(spark, sf):
    return series.by_month(observations(spark, sf), "max")


@query("select dataset_id, lat_idx, lon_idx, cast(year(ts) as int) as year, round(cast(sum(value) as double) / count(value), 9) as value, count(value) as n from obs group by all")
def annual_mean(spark, sf):
    return annual(spark, sf)


@query("select dataset_id, lat_idx, lon_idx, case when month(ts) in (12, 1, 2) then 'DJF' when month(ts) <= 5 then 'MAM' when month(ts) <= 8 then 'JJA' else 'SON' end as season, round(cast(sum(value) as double) / count(value), 9) as value, count(value) as n from obs group by all")
def seasonal_mean(spark, sf):
    return series.by_season(observations(spark, sf))


@query("select lat_idx, lon_idx, round(cast(sum(value) as double) / count(value), 9) as value from obs group by all")
def ensemble_mean_joint(spark, sf):
    return series.ensemble_joint(observations(spark, sf), CELL)


@query("select lat_idx, lon_idx, round(avg(v), 9) as value from (select lat_idx, lon_idx, dataset_id, cast(sum(value) as double) / count(value) as v from obs group by all) group by all")
def ensemble_mean_twostep(spark, sf):
    return series.ensemble_two_step(observations(spark, sf), CELL, "line", "dataset_id")


def _regional(spark, sf):
    cells = grid.all_regions(placed(observations(spark, sf)), regions(spark)).withColumn("weight", F.lit(1).cast("long"))
    return series.regional_monthly(cells, "weight", scale=100.0)


@query("select dataset_id, region_id, month, round(cast(coalesce(s, 0) as double) / 100, 9) as wetland_area, cast(c as double) as valid_area, round(100 * (cast(s as double) / nullif(c, 0)) / 100, 9) as wetland_percentage from monthly", "monthly")
def regional_monthly(spark, sf):
    return _regional(spark, sf)


_COMPLETE = "select dataset_id, region_id, cast(year(month) as int) as year, round(avg(cast(s as double) / nullif(c, 0)), 9) as value, cast(12 as bigint) as observation_count from monthly group by dataset_id, region_id, year(month) having count(distinct month) = 12"


@query(_COMPLETE, "monthly")
def regional_annual_complete(spark, sf):
    return series.complete_years(_regional(spark, sf), "wetland_percentage")


_CLIMATE = "select dataset_id, region_id, make_date(2000, cast(month(month) as int), 1) as month, round(avg(cast(s as double) / nullif(c, 0)), 9) as value, count(s) as observation_count from monthly group by dataset_id, region_id, month(month)"


@query(_CLIMATE, "monthly")
def regional_climatology(spark, sf):
    return series.climatology(_regional(spark, sf), "wetland_percentage")


@query(f"select 'annual' as series_type, region_id, count(*) as n_rows from ({_COMPLETE}) group by region_id union all select 'climatology', region_id, count(*) from ({_CLIMATE}) group by region_id union all select 'monthly', region_id, count(*) from monthly group by region_id", "monthly")
def regional_series_union(spark, sf):
    m = _regional(spark, sf)
    u = series.series_union(monthly=m, annual=series.complete_years(m, "wetland_percentage"), climatology=series.climatology(m, "wetland_percentage"))
    return u.groupBy("series_type", "region_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"select dataset_id, cast(date_trunc('month', ts) as date) as month, round(sum({AREA} * value) / sum(case when value is not null then {AREA} end), 9) as value from obs group by all")
def area_weighted_monthly(spark, sf):
    area = grid.cell_area_km2(15.0 - 5 * F.col("lat_idx"), 20.0 - 5 * F.col("lat_idx"), F.lit(0.0), F.lit(5.0))
    cells = observations(spark, sf).withColumns({"region_id": F.lit("global"), "weight": area})
    return series.regional_monthly(cells, "weight").select("dataset_id", "month", (F.col("wetland_percentage") / 100).alias("value"))


@query("select lat_idx, lon_idx, class_id, cast(sum(value) as bigint) as weighted, count(value) as coverage, round(cast(sum(value) as double) / nullif(count(value), 0), 9) as fraction from obs group by all")
def tile_partial_merge(spark, sf):
    tiles = observations(spark, sf).groupBy("supplier_id", *CELL, "class_id").agg(F.sum("value").alias("weighted"), F.count("value").alias("coverage"))
    return series.merged_partials(tiles, [*CELL, "class_id"])


@query("select lat_idx, lon_idx, round(cast(sum(value) as double) / count(value), 9) as value, count(value) as n from obs group by all")
def shard_reduce(spark, sf):
    shards = observations(spark, sf).groupBy((F.col("order_id") % 16).alias("shard"), *CELL).agg(F.sum("value").alias("weighted"), F.count("value").alias("coverage"))
    return series.merged_partials(shards, CELL).select(*CELL, F.col("fraction").alias("value"), F.col("coverage").alias("n"))


@query("select dataset_id, lat_idx, lon_idx, arg_min(value, order_id * 100 + line) as value from obs where value is not null group by all")
def first_valid_wins(spark, sf):
    o = observations(spark, sf).withColumn("tile_order", F.col("order_id") * 100 + F.col("line"))
    return series.first_valid(o, ["dataset_id", *CELL], "tile_order")


@query("select cast(m as date) as month, n as n_datasets from (select m, count(distinct d) as n from (select distinct date_trunc('month', ts) as m from obs) c join (select dataset_id as d, min(ts) as a, max(ts) as b from obs group by dataset_id) w on m between date_trunc('month', a) and b group by m) order by n desc, m limit 1")
def best_month(spark, sf):
    o = observations(spark, sf)
    starts = o.select(scalars.month(F.col("ts")).alias("month"))
    windows = o.groupBy("dataset_id").agg(scalars.month(F.min("ts")).alias("start"), F.max("ts").cast("date").alias("stop"))
    return series.best_month(starts, windows)


# --- trends --------------------------------------------------------------------------------------


@query("select dataset_id, lat_idx, lon_idx, n_obs, kendall_s, n_ties, round(sens_slope, 9) as sens_slope from sen", "sen")
def sen_slope(spark, sf):
    return trends.sen_kendall(annual(spark, sf))


def _trends(spark, sf):
    return trends.pixel_trends(annual(spark, sf))


@query("select dataset_id, lat_idx, lon_idx, trend_direction from tests", "tests")
def trend_direction(spark, sf):
    return _trends(spark, sf).select("dataset_id", *CELL, "trend_direction")


@query("select dataset_id, lat_idx, lon_idx, round(p_value, 9) as p_value from tests", "tests")
def mann_kendall_p(spark, sf):
    return _trends(spark, sf).select("dataset_id", *CELL, "p_value")


#: z of a two-sided p-value by Newton's steps on its tail, which is convex: from zero they never pass the root.
_NORMAL = f"list_reduce(list_prepend(0.0::double, list_transform(range(0, 40), lambda i: i::double)), lambda z, i: z + ({ERFC.format(x='(z / sqrt(2))')} - p_value) / (sqrt(2 / pi()) * exp(-z * z / 2)))"


@query(f"select t.dataset_id, t.lat_idx, t.lon_idx, round(case when status = 'computed' and most_n and coalesce(s.kendall_s, 0) <> 0 and t.p_value < 1 then {_NORMAL} * sign(s.kendall_s) when status = 'computed' then 0 end, 9) as z_score, round(case when status = 'computed' and flat then 0 else t.sens_slope end, 9) as sens_slope, round(p_value, 9) as p_value, significant, trend_direction, status from (select *, p_value is not null as most_n, false as flat from tests) t left join sen s on s.dataset_id = t.dataset_id and s.lat_idx = t.lat_idx and s.lon_idx = t.lon_idx", "tests sen")
def pixel_trends(spark, sf):
    return _trends(spark, sf)


_AGREE = "select lat_idx, lon_idx, n_up, n_down, n_stable, cast(greatest(n_up, n_down, n_stable) as double) / 3 as agreement_ratio, n_up = 3 as robust_increase, n_down = 3 as robust_decrease, n_stable = 3 as robust_stable, greatest(n_up, n_down, n_stable) < 3 as disputed, mean_slope, slope_std from (select lat_idx, lon_idx, count(*) filter (trend_direction > 0) as n_up, count(*) filter (trend_direction < 0) as n_down, count(*) filter (trend_direction = 0) as n_stable, avg(sens_slope) as mean_slope, stddev_pop(sens_slope) as slope_std from tests group by lat_idx, lon_idx)"


@query(f"select * replace (round(agreement_ratio, 9) as agreement_ratio, round(mean_slope, 9) as mean_slope, round(slope_std, 9) as slope_std) from ({_AGREE})", "tests")
def trend_agreement(spark, sf):
    return trends.trend_agreement(_trends(spark, sf), 3)


@query("select dataset_id, region_id, count(sens_slope) as n_valid, round(quantile_cont(sens_slope, 0.5), 9) as median_slope, round(cast(count(*) filter (trend_direction > 0) as double) / count(sens_slope), 9) as share_increasing, round(cast(count(*) filter (trend_direction < 0) as double) / count(sens_slope), 9) as share_decreasing, round(cast(count(*) filter (trend_direction = 0 and sens_slope is not null) as double) / count(sens_slope), 9) as share_stable from tests d join regions r on 17.5 - 5 * d.lat_idx between r.south and r.north and 102.5 + 5 * d.lon_idx between r.west and r.east group by all", "tests regions")
def trend_regional(spark, sf):
    return trends.regional_summary(grid.all_regions(placed(_trends(spark, sf)), regions(spark)))


@query("select cast(max(a) as date) as overlap_start, cast(min(b) as date) as overlap_end, round(cast(date_diff('day', cast(max(a) as date), cast(min(b) as date)) as double) / 365.25::double, 9) as overlap_years, case when cast(date_diff('day', cast(max(a) as date), cast(min(b) as date)) as double) / 365.25::double >= 5 then 'computed' else 'overlap_window_empty' end as status from (select min(ts) as a, max(ts) as b from obs group by dataset_id)")
def overlap_window(spark, sf):
    return trends.overlap_window(observations(spark, sf).groupBy("dataset_id").agg(F.min("ts").cast("date").alias("start"), F.max("ts").cast("date").alias("stop")))


@query("select dataset_id, lat_idx, lon_idx, cast(year as int) as year, round(d, 9) as delta, cast(coalesce(sign(d), 0) as int) as direction from (select *, case when lag(year) over w = year - 1 then v - lag(v) over w end as d from annual window w as (partition by dataset_id, lat_idx, lon_idx order by year))", "annual")
def yoy_change(spark, sf):
    return trends.year_over_year(annual(spark, sf)).select("dataset_id", *CELL, "year", "delta", "direction")


# --- neighbourhoods, hotspots --------------------------------------------------------------------

_CELLSUM = "select lat_idx, lon_idx, cast(sum(value) as bigint) as value from obs group by all"


def cell_sums(spark, sf):
    return observations(spark, sf).groupBy(*CELL).agg(F.sum("value").alias("value"))


@query(f"select a.lat_idx, a.lon_idx, cast(sum(b.value) as bigint) as box_sum, count(b.value) as box_count, max(b.value) as box_max, round(cast(sum(b.value) as double) / count(b.value), 9) as box_mean from ({_CELLSUM}) a join ({_CELLSUM}) b on abs(a.lat_idx - b.lat_idx) <= 2 and abs(a.lon_idx - b.lon_idx) <= 2 group by all")
def box_mean_window(spark, sf):
    return neighbours.box(cell_sums(spark, sf), 2).drop("value")


_PEAK = f"select a.lat_idx, a.lon_idx, a.value from ({_CELLSUM}) a where abs(a.value - (select max(b.value) from ({_CELLSUM}) b where abs(a.lat_idx - b.lat_idx) <= 1 and abs(a.lon_idx - b.lon_idx) <= 1)) <= 1e-8 + 1e-5 * a.value"


@query(_PEAK)
def local_max3x3(spark, sf):
    return neighbours.local_maxima(cell_sums(spark, sf))


@query(f"select lat_idx, lon_idx, value from ({_CELLSUM}) where value >= (select quantile_cont(cast(value as double), 0.8) from ({_CELLSUM}))")
def percentile_mask(spark, sf):
    return neighbours.above_percentile(cell_sums(spark, sf).withColumn("region_id", F.lit("global")), 0.8, ("region_id",)).select(*CELL, "value")


@query(f"""hot as (select lat_idx, lon_idx from ({_CELLSUM}) where value >= (select quantile_cont(cast(value as double), 0.6) from ({_CELLSUM}))),
reach(lat_idx, lon_idx, a, b) as (select lat_idx, lon_idx, lat_idx, lon_idx from hot union select h.lat_idx, h.lon_idx, r.a, r.b from reach r join hot h on abs(h.lat_idx - r.lat_idx) + abs(h.lon_idx - r.lon_idx) = 1)
select lat_idx, lon_idx, cast(min(a * 1000 + b) // 1000 as int) as seed_lat_idx, cast(min(a * 1000 + b) % 1000 as int) as seed_lon_idx from reach group by all""", recursive=True)
def components4(spark, sf):
    hot = neighbours.above_percentile(cell_sums(spark, sf).withColumn("region_id", F.lit("global")), 0.6, ("region_id",))
    return neighbours.components(hot, ("region_id",)).select(*CELL, "seed_lat_idx", "seed_lon_idx")


_TOP = f"select row_number() over (order by value desc, lat_idx, lon_idx) as r, * from ({_PEAK})"


@query(f"select cast(r as int) as hotspot_rank, lat_idx, lon_idx, cast(value as double) as score from ({_TOP}) where r <= 10")
def pct_hotspots(spark, sf):
    cells = placed(cell_sums(spark, sf)).withColumn("region_id", F.lit("global"))
    return hotspots.percentage_hotspots(cells, "region_id").select("hotspot_rank", *CELL, "score")


@query(f"select cast(row_number() over (order by round(1 - agreement_ratio, 9) desc, round(slope_std, 9) desc, lat_idx, lon_idx) as int) as hotspot_rank, lat_idx, lon_idx, round(1 - agreement_ratio, 9) as score, round(slope_std, 9) as slope_std from ({_AGREE}) where disputed and slope_std is not null qualify hotspot_rank <= 10", "tests")
def trend_hotspots(spark, sf):
    a = placed(trends.trend_agreement(_trends(spark, sf), 3)).withColumn("region_id", F.lit("global"))
    return hotspots.trend_hotspots(a, "region_id").select("hotspot_rank", *CELL, "score", "slope_std")


@query(f"select dataset_id, cast(r as int) as hotspot_rank, round(case when n = 1 then 1 else 1 - cast(r - 1 as double) / (n - 1) end, 9) as rank_percentile from (select dataset_id, row_number() over (partition by dataset_id order by v desc, lat_idx, lon_idx) as r, count(*) over (partition by dataset_id) as n from surf where v is not null)", "surf")
def rank_percentile(spark, sf):
    s = surfaces(spark, sf).filter("value is not null")
    w = Window.partitionBy("dataset_id").orderBy(F.desc("value"), *CELL)
    ranked = s.withColumn("hotspot_rank", F.row_number().over(w).cast("int"))
    return ranked.select("dataset_id", "hotspot_rank", neighbours.rank_percentile([F.col("hotspot_rank")], ("dataset_id",)).alias("rank_percentile"))


@query("select region_id, cast(1 + base + case when place <= 10 - n - sum(base) over () then 1 else 0 end as int) as quota from (select *, row_number() over (order by rest desc, area desc, ord, region_id) as place from (select *, cast(floor(round(share, 9)) as int) as base, round(share - floor(round(share, 9)), 9) as rest from (select region_id, ord, (east - west) * (north - south) as area, count(*) over () as n, (east - west) * (north - south) / sum((east - west) * (north - south)) over () * (10 - count(*) over ()) as share from regions)))", "regions")
def hamilton_quota(spark, sf):
    r = regions(spark).withColumn("area", (F.col("east") - F.col("west")) * (F.col("north") - F.col("south")))
    return neighbours.hamilton_quotas(r, 10).select("region_id", "quota")


# --- contracts -----------------------------------------------------------------------------------


def _ledger(spark, sf):
    top = lambda q, v: hotspots.ranked_top(grid.all_regions(placed(q), regions(spark)), "region_id", [F.desc(v), F.asc("lat_idx"), F.asc("lon_idx")], 3).withColumn("score", F.col(v).cast("double"))
    pct = top(cell_sums(spark, sf), "value")
    cls = top(agreement.class_agreement(observations(spark, sf)), "agreement_count")
    return contract.ledger({"percentage": pct, "classification": cls})


_LEDGER = """select region_id, metric_family, cast(fo as int) as family_order, cast(r as int) as hotspot_rank, substr(metric_family, 1, 3) || '-' || region_id || '-obs-' || lpad(cast(r as varchar), 3, '0') as analysis_object_id, round(case when n = 1 then 1 else 1 - cast(r - 1 as double) / (n - 1) end, 9) as rank_percentile, cast(x as double) as score, '{"lat_idx":' || lat_idx || ',"lon_idx":' || lon_idx || '}' as line_specific_json
from (select *, count(*) over (partition by region_id, metric_family) as n from (select t.*, row_number() over (partition by region_id, metric_family order by x desc, lat_idx, lon_idx) as r from
(select region_id, f.* from (select 'percentage' as metric_family, 0 as fo, lat_idx, lon_idx, cast(sum(value) as bigint) as x from obs group by lat_idx, lon_idx union all select 'classification', 1, lat_idx, lon_idx, max(n) from (select lat_idx, lon_idx, class_id, count(*) as n from obs group by all) group by lat_idx, lon_idx) f join regions g on 17.5 - 5 * f.lat_idx between g.south and g.north and 102.5 + 5 * f.lon_idx between g.west and g.east) t) where r <= 3)"""


@query(_LEDGER, "obs regions")
def hotspot_ledger(spark, sf):
    return _ledger(spark, sf)


@query(f"select g.region_id, m.metric_family, case when coalesce(n, 0) = 0 then 'missing' when n < 3 then 'partial' else 'ready' end as status, false as region_ready from regions g cross join (values ('percentage'), ('classification'), ('trend')) as m(metric_family) left join (select region_id, metric_family, count(*) as n from ({_LEDGER}) group by all) l on l.region_id = g.region_id and l.metric_family = m.metric_family", "obs regions")
def readiness_status(spark, sf):
    rows = _ledger(spark, sf).groupBy("region_id", "metric_family").agg(F.count(F.lit(1)).alias("n_objects")).withColumn("n_expected", F.lit(3))
    return contract.readiness(rows, regions(spark))


@query("select r_name as region_id, c.n as customers_n_customers, round(c.bal, 9) as customers_balance, s.n as suppliers_n_suppliers from region left join (select n_regionkey as k, count(*) as n, cast(sum(cast(round(c_acctbal * 100) as bigint)) as double) / 100 as bal from customer join nation on c_nationkey = n_nationkey group by all) c on c.k = r_regionkey left join (select n_regionkey as k, count(*) as n from supplier join nation on s_nationkey = n_nationkey group by all) s on s.k = r_regionkey", "")
def evidence_join(spark, sf):
    nation = F.broadcast(table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region_id")))
    c = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("region_id").agg(F.count(F.lit(1)).alias("n_customers"), (F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).cast("double") / 100).alias("balance"))
    s = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("region_id").agg(F.count(F.lit(1)).alias("n_suppliers"))
    return contract.evidence_rows(table(spark, sf, "region").select(F.col("r_name").alias("region_id")), customers=c, suppliers=s)


@query("select status, count(*) as n from (select case when f.k is null then 'missing' when o.o_custkey % 5 <> f.s then 'size_mismatch' else 'ok' end as status from orders o left join (select l_orderkey as k, max(l_suppkey % 5) as s from lineitem where l_orderkey % 3 <> 0 group by all) f on f.k = o.o_orderkey) group by all", "")
def manifest_left_anti(spark, sf):
    m = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), (F.col("o_custkey") % 5).alias("size"))
    f = table(spark, sf, "lineitem").filter("l_orderkey % 3 <> 0").groupBy(F.col("l_orderkey").alias("path")).agg(F.max(F.col("l_suppkey") % 5).alias("size"))
    return contract.manifest_check(m, f).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""select '{"lat_idx":' || lat_idx || ',"lon_idx":' || lon_idx || ',"n":' || count(*) || '}' as metadata_json from obs group by lat_idx, lon_idx""")
def json_metadata(spark, sf):
    return observations(spark, sf).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")).select(contract.canonical_json("n", *CELL).alias("metadata_json"))


@query("select event_type, count(*) as n, count(*) filter (props like '%\"a\"%' or json_valid(props)) as n_valid from events group by all", "")
def event_json_validity(spark, sf):
    return summaries.json_validity(table(spark, sf, "events"), "event_type", "props")


@query("select string_agg(dataset_id, '+' order by dataset_id) as dataset_key, lat_idx, lon_idx, count(*) as n from (select lat_idx, lon_idx, dataset_id from obs group by all) group by lat_idx, lon_idx")
def dataset_keys(spark, sf):
    o = observations(spark, sf).groupBy(*CELL).agg(F.collect_list("dataset_id").alias("ids"), F.countDistinct("dataset_id").alias("n"))
    return o.select(scalars.dataset_key(F.col("ids")).alias("dataset_key"), *CELL, "n")


@query("select cast(o_orderkey as bigint) as o_orderkey, o_orderpriority, cast(o_custkey as bigint) as o_custkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 1000 order by o_orderpriority, o_totalprice desc, o_custkey, o_orderdate, o_orderkey limit 25", "")
def review_priority_topn(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F' and o_totalprice > 1000")
    order = [F.col("o_orderpriority"), F.desc("o_totalprice"), F.col("o_custkey"), F.col("o_orderdate"), F.col("o_orderkey")]
    return summaries.first_rows(o, order, 25).select("o_orderkey", "o_orderpriority", "o_custkey", "o_totalprice")


@query("select role, turn, count(*) as n, count(distinct conv_id) as n_conversations from conversations group by all", "")
def nested_explode(spark, sf):
    nested = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("turns"))
    flat = nested.select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.*")
    return flat.groupBy("role", "turn").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conv_id").alias("n_conversations"))


# --- grids, regridding, tokens -------------------------------------------------------------------


@query("select count(*) as n, cast(sum(value) as bigint) as total from placed where lat between -10 and 10 and lon between 105 and 130", "placed")
def bbox_filter(spark, sf):
    o = placed(observations(spark, sf))
    return o.filter(grid.in_box(F.col("lat"), F.col("lon"), 105, -10, 130, 10)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("select coalesce((select arg_min(r.region_id, r.ord) from regions r where p.lat between r.south and r.north and p.lon between r.west and r.east), 'other') as region_id, count(*) as n from placed p group by all", "placed regions")
def region_assign_first(spark, sf):
    return grid.first_region(placed(observations(spark, sf)), [r[0:1] + r[2:] for r in REGIONS]).groupBy("region_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"select lat_idx, round(max({AREA}), 6) as area_km2 from obs group by all")
def cell_area(spark, sf):
    area = grid.cell_area_km2(15.0 - 5 * F.col("lat_idx"), 20.0 - 5 * F.col("lat_idx"), F.lit(0.0), F.lit(5.0))
    return observations(spark, sf).select("lat_idx").distinct().select("lat_idx", F.round(area, 6).alias("area_km2"))


@query("select lat_idx, lat, lat - 2.5 as low, lat + 2.5 as high from (select distinct lat_idx, 17.5::double - 5 * lat_idx as lat from obs)")
def coord_edges(spark, sf):
    axis = observations(spark, sf).select("lat_idx").distinct().withColumn("lat", 17.5 - 5 * F.col("lat_idx"))
    return grid.axis_edges(axis, "lat_idx", "lat")


@query("select cast(i // 12 as int) as lat_idx, cast(i % 12 as int) as lon_idx, 10.0::double - (i // 12) * 2.5::double as lat, 100.0::double + (i % 12) * 2.5::double as lon from range(96) as t(i)", "")
def comparison_lattice(spark, sf):
    return grid.lattice(spark, 100.0, -10.0, 130.0, 10.0, 2.5)


_BOX = "select s_suppkey as id, cast(s_suppkey % 37 as double) * 0.5 as west, cast(s_suppkey % 23 as double) * 0.5 as south, cast(s_suppkey % 37 as double) * 0.5 + 0.75 as east, cast(s_suppkey % 23 as double) * 0.5 + 0.75 as north from supplier"


@query(f"select a.id as left_id, b.id as right_id from ({_BOX}) a join ({_BOX}) b on a.west <= b.east and a.east >= b.west and a.south <= b.north and a.north >= b.south", "")
def grid_hash_join(spark, sf):
    b = _boxes(spark, sf)
    return grid.grid_hash_join(b, b, 1.0)


def _boxes(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("id"), ((k % 37).cast("double") * 0.5).alias("west"), ((k % 23).cast("double") * 0.5).alias("south"), ((k % 37).cast("double") * 0.5 + 0.75).alias("east"), ((k % 23).cast("double") * 0.5 + 0.75).alias("north"))


@query(f"select cast(lat_idx // 2 as int) as lat_idx, cast(lon_idx // 2 as int) as lon_idx, round(cast(sum(value) as double) / count(value), 9) as value, count(value) as n_source from ({_CELLSUM}) group by all")
def regrid_coarsen(spark, sf):
    return regrid.coarsen(cell_sums(spark, sf), 2)


def _axes(spark):
    """Cells of width 5 at 0 to 40, and of width 8 at 0 to 40."""
    make = lambda n, width: spark.range(n).select(F.col("id").cast("int").alias("idx"), (F.col("id") * width).cast("double").alias("low"), ((F.col("id") + 1) * width).cast("double").alias("high"), (F.col("id") * width + width / 2).cast("double").alias("at"))
    return make(8, 5), make(5, 8)


_SRC, _DST = "(select i, i * 5.0::double as s0, i * 5.0::double + 5 as s1, i * 5.0::double + 2.5 as s from range(8) as t(i))", "(select j, j * 8.0::double as t0, j * 8.0::double + 8 as t1, j * 8.0::double + 4 as t from range(5) as u(j))"
_OVER = f"(select i, j, least(s1, t1) - greatest(s0, t0) as w from {_SRC} join {_DST} on s0 < t1 and t0 < s1)"
_LIN = f"(select i, j, 1 - abs(s - t) / 5 as w from {_SRC} join {_DST} on abs(s - t) < 5 where t between 2.5 and 37.5)"


@query(f"select cast(a.j as int) as lat_idx, cast(b.j as int) as lon_idx, round(sum(value * a.w * b.w) / sum(a.w * b.w), 9) as value from ({_CELLSUM}) c join {_OVER} a on a.i = c.lat_idx join {_OVER} b on b.i = c.lon_idx group by all")
def regrid_average(spark, sf):
    s, t = _axes(spark)
    w = regrid.overlap_weights(s, t)
    return regrid.regrid(cell_sums(spark, sf), w, w)


@query(f"select cast(a.j as int) as lat_idx, cast(b.j as int) as lon_idx, round(sum(value * (a.w * b.w)) / sum(a.w * b.w), 9) as value from ({_CELLSUM}) c join {_LIN} a on a.i = c.lat_idx join {_LIN} b on b.i = c.lon_idx group by all")
def regrid_bilinear(spark, sf):
    s, t = _axes(spark)
    w = regrid.linear_weights(s, t)
    return regrid.regrid(cell_sums(spark, sf), w, w)


_NEAR = f"(select j, arg_min(i, abs(s - t) * 100 + i) as i from {_SRC} cross join {_DST} group by j)"


@query(f"select cast(a.j as int) as lat_idx, cast(b.j as int) as lon_idx, cast(value as double) as value from ({_CELLSUM}) c join {_NEAR} a on a.i = c.lat_idx join {_NEAR} b on b.i = c.lon_idx")
def regrid_nearest(spark, sf):
    s, t = _axes(spark)
    w = regrid.nearest_weights(s, t)
    return regrid.regrid(cell_sums(spark, sf), w, w)


@query(f"select dataset_id, lat_idx, lon_idx, class_id from (select *, row_number() over (partition by dataset_id, lat_idx, lon_idx order by w desc, class_id) as r from (select dataset_id, cast(a.j as int) as lat_idx, cast(b.j as int) as lon_idx, class_id, round(sum(a.w * b.w), 9) as w from votes c join {_OVER} a on a.i = c.lat_idx join {_OVER} b on b.i = c.lon_idx group by all)) where r = 1", "votes")
def regrid_mode(spark, sf):
    s, t = _axes(spark)
    w = regrid.overlap_weights(s, t)
    return regrid.regrid_mode(votes(spark, sf), w, w, ("dataset_id",))


@query(f"select dataset_id, lat_idx, lon_idx, class_id, round(w / sum(w) over (partition by dataset_id, lat_idx, lon_idx), 9) as fraction from (select dataset_id, cast(a.j as int) as lat_idx, cast(b.j as int) as lon_idx, class_id, sum(a.w * b.w) as w from votes c join {_OVER} a on a.i = c.lat_idx join {_OVER} b on b.i = c.lon_idx group by all)", "votes")
def regrid_class_fractions(spark, sf):
    s, t = _axes(spark)
    w = regrid.overlap_weights(s, t)
    return regrid.class_fractions(votes(spark, sf), w, w, ("dataset_id",))


@query("select count(*) as n from obs where lat_idx % 3 = 0 and lon_idx % 3 = 0")
def stride_sample(spark, sf):
    return regrid.stride(observations(spark, sf), 3).agg(F.count(F.lit(1)).alias("n"))


@query("select (min(bin) + 0.5::double) / 1000 as quantile from (select bin, sum(n) over (order by bin) as cum, sum(n) over () as total from (select least(cast(floor(cast(value as double) / 100 * 1000) as int), 999) as bin, count(*) as n from obs where value is not null group by all)) where cum >= 0.9 * total")
def histogram_quantile(spark, sf):
    return regrid.histogram_quantile(observations(spark, sf).withColumn("value", F.col("value").cast("double") / 100), 0.9)


@query("select cast(year(ts) as int) as year, count(*) as n, count(distinct make_date(cast(year(ts) as int), 1, 1) + cast((dayofyear(ts) - 1) // 4 * 4 as int)) as n_bands from obs group by all")
def four_day_axis(spark, sf):
    band = F.floor((F.dayofyear("ts") - 1) / 4)
    return observations(spark, sf).groupBy(F.year("ts").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(scalars.four_day_axis(F.year("ts"), band)).alias("n_bands"))


@query("select cast(make_date(cast(year(ts) as int), 1, 1) + cast((dayofyear(ts) - 1) // 8 * 8 as int) as date) as bucket, count(*) as n from obs group by all")
def eight_day_bucket(spark, sf):
    return observations(spark, sf).groupBy(scalars.eight_day_bucket(F.col("ts")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("select month, count(*) as n, min(first) as first_token from (select case when substr(name, 9, 2) between '01' and '12' then make_date(cast(substr(name, 5, 4) as int), cast(substr(name, 9, 2) as int), 1) end as month, cast(substr(name, 5, 6) as bigint) as first from (select 'fwet' || strftime(o_orderdate, '%Y%m') || '.nc' as name from orders)) group by all", "")
def filename_tokens(spark, sf):
    name = F.concat(F.lit("fwet"), F.date_format("o_orderdate", "yyyyMM"), F.lit(".nc"))
    o = table(spark, sf, "orders").select(scalars.year_month_token(name).alias("month"), scalars.first_integer_token(name).alias("first"))
    return o.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first_token"))


@query("select dataset_id, count(value) as n, cast(min(value) as double) as low, cast(max(value) as double) as high from obs where value is null or value <> 0 group by all")
def sentinel_profile(spark, sf):
    o = observations(spark, sf).withColumn("value", scalars.sentinel_to_null(F.col("value"), 0))
    return o.groupBy("dataset_id").agg(F.count("value").alias("n"), F.min("value").cast("double").alias("low"), F.max("value").cast("double").alias("high"))


@query("select label, count(*) as n, cast(min(len(embedding)) as int) as dims from embeddings group by all", "")
def vector_profile(spark, sf):
    return summaries.vector_lengths(table(spark, sf, "embeddings"), "label")


# --- summaries, files, imagery, tiles -------------------------------------------------------------


@query("select dataset_id, count(*) as n_cells, count(value) as n_values, round(cast(sum(value) as double) / count(value), 9) as mean_value, round(sqrt(cast(count(value) * sum(value * value) - sum(value) * sum(value) as double) / cast(count(value) * count(value) as double)), 9) as std_value, min(value) as min_value, max(value) as max_value, cast(sum(value) as bigint) as total from obs group by all")
def surface_statistics(spark, sf):
    return summaries.surface_statistics(observations(spark, sf), ["dataset_id"])


@query(f"select region_id, count(*) as n_cells, round(avg(entropy), 9) as mean_entropy, round(max(entropy), 9) as max_entropy, round(cast(sum(agreement_count) as double) / count(*), 9) as mean_agreement, count(*) filter (agreement_count = 1) as n_agree_1, count(*) filter (agreement_count = 2) as n_agree_2, count(*) filter (agreement_count = 3) as n_agree_3 from (select lat_idx, lon_idx, case max(n) when 3 then 0 when 2 then (-(2.0::double/3) * log2(2.0::double/3) - (1.0::double/3) * log2(1.0::double/3)) / log2(3) else 1 end as entropy, max(n) as agreement_count from (select lat_idx, lon_idx, class_id, count(*) as n from votes group by all) group by lat_idx, lon_idx having sum(n) = 3) e join regions r on 17.5 - 5 * e.lat_idx between r.south and r.north and 102.5 + 5 * e.lon_idx between r.west and r.east group by all", "votes regions")
def classification_summary(spark, sf):
    e = grid.all_regions(placed(agreement.vote_entropy3(votes(spark, sf))), regions(spark))
    return summaries.classification_summary(e, ["region_id"])


@query(f"select region_id, count(*) as n_cells, round(avg(agreement_ratio), 9) as mean_agreement, round(cast(count(*) filter (robust_increase) as double) / count(*), 9) as share_robust_increase, round(cast(count(*) filter (robust_decrease) as double) / count(*), 9) as share_robust_decrease, round(cast(count(*) filter (disputed) as double) / count(*), 9) as share_disputed from ({_AGREE}) a join regions r on 17.5 - 5 * a.lat_idx between r.south and r.north and 102.5 + 5 * a.lon_idx between r.west and r.east group by all", "tests regions")
def agreement_summary(spark, sf):
    a = grid.all_regions(placed(trends.trend_agreement(_trends(spark, sf), 3)), regions(spark))
    return summaries.agreement_summary(a, ["region_id"])


@query("select class_id, round(cast(sum(n) as double) / count(n), 9) as mean_fraction, max(n) as max_fraction, count(*) filter (n > 0) as n_positive, round(cast(count(*) filter (n > 0) as double) / count(n), 9) as positive_share from fracs group by all", "fracs")
def class_profile(spark, sf):
    return summaries.class_profile(fractions(spark, sf).drop("fraction"), "n")


@query("select lat_idx, lon_idx, cast(arg_max(class_id, s * 100 - class_id) as int) as class_id from (select lat_idx, lon_idx, class_id, sum(n) as s from fracs group by all) group by all", "fracs")
def vote_classification(spark, sf):
    return summaries.vote_classification(fractions(spark, sf).drop("fraction"), "n")


@query("select dataset_id, '{' || string_agg('\"' || class_id || '\":' || cast(share as varchar), ',' order by class_id) || '}' as shares from (select dataset_id, class_id, round(cast(count(*) as double) / sum(count(*)) over (partition by dataset_id), 4) as share from obs group by dataset_id, class_id) group by all")
def vote_shares(spark, sf):
    return summaries.vote_shares(observations(spark, sf), ["dataset_id"]).select("dataset_id", F.to_json("shares").alias("shares"))


@query("select dataset_id, lat_idx, lon_idx, round(greatest(0::double, least(1::double, sum(fraction))), 9) as value from fracs where class_id in (2, 3, 4, 5, 6, 7) group by all", "fracs")
def wetland_fraction(spark, sf):
    return summaries.wetland_fraction(fractions(spark, sf), [2, 3, 4, 5, 6, 7])


@query("select dataset_id, lat_idx, lon_idx, class_id, round(cast(n as double) / sum(n) over (partition by dataset_id, lat_idx, lon_idx), 9) as fraction from fracs", "fracs")
def area_to_fractions(spark, sf):
    f = fractions(spark, sf).select("dataset_id", *CELL, "class_id", F.col("n").alias("ha"))
    return summaries.dominant_shares(f, keys=("dataset_id", *CELL)).drop("ha")


@query("select role as dataset_id, case when turn % 2 = 0 then 'even' else 'odd' end as status, count(*) as n, count(*) filter (conv_id % 10 = 0) as n_priority from conversations group by all", "")
def nested_failures_explode(spark, sf):
    c = table(spark, sf, "conversations")
    runs = c.groupBy(F.col("conv_id").alias("run_id")).agg(F.collect_list(F.struct(F.col("role").alias("dataset_id"), F.when(F.col("turn") % 2 == 0, "even").otherwise("odd").alias("status"))).alias("results"))
    return summaries.failure_counts(runs, c.filter("conv_id % 10 = 0").select(F.col("conv_id").alias("run_id")))


_CAND = "select s_suppkey as candidate_id, cast(s_suppkey % 40 as double) - 20 as lat, 100 + cast(s_suppkey % 41 as double) as lon from supplier"


@query(f"select candidate_id, round(cast(sum(value) as double) / count(value), 9) as score, count(value) as n_cells from ({_CAND}) c join (select 17.5::double - 5 * lat_idx as lat, 102.5::double + 5 * lon_idx as lon, value from ({_CELLSUM})) g on abs(g.lat - c.lat) <= 4 and abs(g.lon - c.lon) <= 4 group by all")
def refined_candidates(spark, sf):
    k = F.col("s_suppkey")
    cand = table(spark, sf, "supplier").select(k.alias("candidate_id"), ((k % 40).cast("double") - 20).alias("lat"), (100 + (k % 41).cast("double")).alias("lon"))
    return summaries.refined_scores(cand, placed(cell_sums(spark, sf)), 4.0)


@query("select cast(floor((least(lat, 20 - 1e-5) + 20) / 10) as int) as lat_idx, cast(floor((least(lon, 132.5 - 1e-5) - 100) / 10) as int) as lon_idx, round(sum(value * cos(radians(lat))) / sum(case when value is not null then cos(radians(lat)) end), 9) as value, count(value) as n_source from placed where lat between -20 and 20 and lon between 100 and 132.5 group by all", "placed")
def cos_weighted_bins(spark, sf):
    return grid.cos_weighted_bins(placed(observations(spark, sf)), 100.0, -20.0, 10.0, east=132.5, north=20.0)


@query("select o.dataset_id, round(sum(coalesce(m.f, 0)), 6) as mask_total, count(*) as n from surf o left join (select distinct lat_idx, lon_idx, 0.5::double as f from surf where dataset_id = 'a' and v > 0.5) m on o.lat_idx = m.lat_idx and o.lon_idx = m.lon_idx group by all", "surf")
def mask_fraction(spark, sf):
    s = surfaces(spark, sf)
    mask = s.filter("dataset_id = 'a' and value > 0.5").select(*CELL, F.lit(0.5).alias("mask_fraction"))
    return grid.mask_fraction(s, mask).groupBy("dataset_id").agg(F.round(F.sum("mask_fraction"), 6).alias("mask_total"), F.count(F.lit(1)).alias("n"))


@query("select o_orderpriority as \"group\", cast(o_orderkey as varchar) as name, priority, valid_count from (select *, row_number() over (partition by o_orderpriority order by priority, valid_count desc, cast(o_orderkey as varchar)) as r from (select o_orderpriority, o_orderkey, case o_orderstatus when 'F' then 0 else 1 end as priority, o_custkey % 97 as valid_count from orders)) where r = 1", "")
def best_raster(spark, sf):
    r = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("group"), F.col("o_orderkey").cast("string").alias("name"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("priority"), (F.col("o_custkey") % 97).alias("valid_count"))
    return files.best_raster(r)


@query("select l_orderkey % 100 as k, l_linenumber as line, max(l_suppkey) as supplier from (select *, row_number() over (partition by l_orderkey % 100, l_linenumber order by l_suppkey desc, l_orderkey) as r from lineitem) where r = 1 group by all", "")
def deduplicated(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 100).alias("k"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supplier"), (-F.col("l_suppkey")).alias("o"), "l_orderkey")
    return files.deduplicated(li, ["k", "line"], ["o", "l_orderkey"]).select("k", "line", "supplier")


@query("select event_type, quantile_cont(cast(event_id % 1000 as double), 0.5) filter (user_id & 5 = 0) as value, count(*) filter (user_id & 5 = 0) as n_clear from events group by all", "")
def clear_median(spark, sf):
    e = table(spark, sf, "events").select("event_type", (F.col("event_id") % 1000).alias("value"), F.col("user_id").alias("qa"))
    return imagery.clear_median(e, ["event_type"], "value", "qa", 0, 2)


@query("""listed as (select c_mktsegment as g, c_custkey, c_custkey % 100 as s, row_number() over (partition by c_mktsegment order by c_custkey) - 1 as pos from customer),
gone(g, pos, n, b, batch) as (select g, pos, 1, s, 0 from listed where pos = 0 union all
    select l.g, l.pos, case when r.n >= 90 or r.b + l.s > 4000 then 1 else r.n + 1 end, case when r.n >= 90 or r.b + l.s > 4000 then l.s else r.b + l.s end, case when r.n >= 90 or r.b + l.s > 4000 then r.batch + 1 else r.batch end
    from gone r join listed l on l.g = r.g and l.pos = r.pos + 1)
select g as c_mktsegment, cast(batch as int) as batch, count(*) as n from gone group by all""", "regions", recursive=True)
def size_batches(spark, sf):
    c = table(spark, sf, "customer").select("c_mktsegment", "c_custkey", (F.col("c_custkey") % 100).alias("size"))
    return imagery.size_batches(c, "c_mktsegment", "c_custkey", "size", 4000, 90).groupBy("c_mktsegment", "batch").agg(F.count(F.lit(1)).alias("n"))


@query("select case when contains(m, '32 mb') or contains(m, '10000') or contains(m, 'request too large') then 'download_limit_exceeded' else 'download_failed' end as status, count(*) as n from (select lower('Error ' || o_orderkey || case o_custkey % 4 when 0 then ': Request too large' when 1 then ': more than 32 MB' when 2 then ': user memory limit' else '' end) as m from orders) group by all", "")
def status_by_text(spark, sf):
    k = F.col("o_custkey") % 4
    tail = F.when(k == 0, ": Request too large").when(k == 1, ": more than 32 MB").when(k == 2, ": user memory limit").otherwise("")
    o = table(spark, sf, "orders").select(imagery.failure_status(F.concat(F.lit("Error "), F.col("o_orderkey").cast("string"), tail)).alias("status"))
    return o.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("select lat_idx, lon_idx, class_id, count(*) as weighted, cast(sum(count(*)) over (partition by lat_idx, lon_idx) as bigint) as coverage from obs group by lat_idx, lon_idx, class_id")
def band_partials(spark, sf):
    o = observations(spark, sf).withColumnsRenamed({"lat_idx": "y", "lon_idx": "x"}).withColumn("band", F.lit(0))
    return tiles.band_partials(o, ["band"], [F.col("y"), F.col("x")]).drop("band")


#: The transverse Mercator by Snyder's series, which is not the one that the operator sums.
_UTM = """with pts as (select lat_idx, lon_idx, 17.5::double - 5 * lat_idx as lat, 102.5::double + 5 * lon_idx as lon from obs group by all),
ell as (select *, cast(least(floor((lon + 180) / 6) + 1, 60) as int) as z, 6378137.0::double as a, 0.0066943799901413165::double as e, 0.006739496742276434::double as ep, radians(lat) as p from pts),
ser as (select *, a / sqrt(1 - e * sin(p) * sin(p)) as n, tan(p) * tan(p) as t, ep * cos(p) * cos(p) as c, cos(p) * radians(lon - (z * 6 - 183)) as l,
    a * ((1 - e / 4 - 3 * e * e / 64 - 5 * e * e * e / 256) * p - (3 * e / 8 + 3 * e * e / 32 + 45 * e * e * e / 1024) * sin(2 * p) + (15 * e * e / 256 + 45 * e * e * e / 1024) * sin(4 * p) - 35 * e * e * e / 3072 * sin(6 * p)) as m from ell),
xy as (select *, 500000 + 0.9996 * n * (l + (1 - t + c) * pow(l, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * pow(l, 5) / 120) as x,
    case when lat < 0 then 10000000 else 0 end + 0.9996 * (m + n * tan(p) * (l * l / 2 + (5 - t + 9 * c + 4 * c * c) * pow(l, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * pow(l, 6) / 720)) as y from ser)
select lat_idx, lon_idx, lat, lon, lpad(cast(z as varchar), 2, '0') || substr('CDEFGHJKLMNPQRSTUVWX', cast(floor((lat + 80) / 8) as int) + 1, 1) || substr(case z % 3 when 1 then 'ABCDEFGH' when 2 then 'JKLMNPQR' else 'STUVWXYZ' end, cast(floor(x / 100000) as int), 1) || substr('ABCDEFGHJKLMNPQRSTUV', cast((floor(y / 100000) + case when z % 2 = 0 then 5 else 0 end) % 20 as int) + 1, 1) as tile_code from xy"""


@query(_UTM.replace("with pts as", "select * from (with pts as", 1) + ")")
def utm_tile_codes(spark, sf):
    cells = placed(observations(spark, sf)).select(*CELL, "lat", "lon").distinct()
    return cells.withColumn("tile_code", tiling.tile_code(F.col("lat"), F.col("lon")))


# --- streaming -----------------------------------------------------------------------------------


@query("select cast(time_bucket(interval '4 days', ts, timestamp '1970-01-01') as timestamp) as window_start, event_type, count(*) as n_events, cast(sum(cast(round(value * 100) as bigint)) as bigint) as total from events group by all", "")
def streaming_four_day(spark, sf):
    schema = table(spark, sf, "events").schema
    # a stream reads folders: the table's file or folder by a pattern
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    made = running.windowed(stream, "4 days", "event_type", "cents", "3650 days")
    store.shared_folder(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    name = f"streamed_{uuid.uuid4().hex}"
    done = running.drained(made, name, "complete", f"{folder}/{name}")
    return done.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
