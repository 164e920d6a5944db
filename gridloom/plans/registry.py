"""The registry of queries: the same over the driver's tables in Spark and, where SQL can say it, in SQL.

A query is registered with ``@query(sql)``; tables that its SQL uses are named
and become common table expressions. Doubles are rounded to nine places on
both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars
from ..operators import agreement, series, summaries, trends
from ..sources.driver_tables import OBS_SQL, REGIONS, observations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
CELL = ["lat_idx", "lon_idx"]
AREA = "(6371.0088 * 6371.0088 * (sin(radians(20.0 - 5 * lat_idx)) - sin(radians(15.0 - 5 * lat_idx))) * radians(5.0))"
_REGION_VALUES = ", ".join(f"('{r[0]}', {r[1]}, {r[2]}, {r[3]}, {r[4]}, {r[5]})" for r in REGIONS)
#: Two-sided p-values of Kendall's S without ties, for the lengths of annual series.
_EXACT = ", ".join(f"({n}, {s}, {trends.kendall_p(n, s, [])!r}::double)" for n in range(4, 17) for s in range(n * (n - 1) // 2 % 2, n * (n - 1) // 2 + 1, 2))
#: The complementary error function by its series, and its argument for tied series.
ERFC = "(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 80), lambda i: case when i % 2 = 0 then 1 else -1 end * pow({x}, 2 * i + 1) / (gamma(i + 1) * (2 * i + 1)))))"
_Z = "(abs(s.kendall_s) / sqrt(2 * (st.n * (st.n - 1) * (2 * st.n + 5) - t.tt) / 18.0::double))"
CTES = {
    "obs": OBS_SQL,
    "surf": "select dataset_id, lat_idx, lon_idx, cast(sum(value) as double) / count(value) / 100 as v, cast(sum(value) as bigint) as s, count(value) as n from obs group by all",
    "annual": "select dataset_id, lat_idx, lon_idx, year(ts) as year, cast(sum(value) as double) / count(value) as v from obs group by all",
    "votes": "select dataset_id, lat_idx, lon_idx, class_id from (select *, row_number() over (partition by dataset_id, lat_idx, lon_idx order by n desc, class_id) as r from (select dataset_id, lat_idx, lon_idx, class_id, count(*) as n from obs group by all)) where r = 1",
    "fracs": "select dataset_id, lat_idx, lon_idx, class_id, cast(count(*) as double) / sum(count(*)) over (partition by dataset_id, lat_idx, lon_idx) as fraction, count(*) as n from obs group by dataset_id, lat_idx, lon_idx, class_id",
    "regions": f"select * from (values {_REGION_VALUES}) as t(region_id, ord, west, south, east, north)",
    "placed": "select o.*, 17.5 - 5 * lat_idx as lat, 102.5 + 5 * lon_idx as lon from obs o",
    "monthly": "select dataset_id, region_id, cast(date_trunc('month', ts) as date) as month, sum(value) as s, count(value) as c from placed p join regions r on p.lat between r.south and r.north and p.lon between r.west and r.east group by all",
    "pairs": "select a.dataset_id, a.lat_idx, a.lon_idx, a.r as i, b.r as j, a.v as x, b.v as y from ranked a join ranked b on a.dataset_id = b.dataset_id and a.lat_idx = b.lat_idx and a.lon_idx = b.lon_idx and a.r < b.r",
    "ranked": "select *, row_number() over (partition by dataset_id, lat_idx, lon_idx order by year) as r from annual where v is not null",
    "crit": f"select * from (values {_EXACT}) as t(n, s, p)",
    "tied": "select dataset_id, lat_idx, lon_idx, cast(sum(t * (t - 1) * (2 * t + 5)) as bigint) as tt, max(t) as most from (select dataset_id, lat_idx, lon_idx, v, count(*) as t from ranked group by all) group by all",
    "tests": f"""select *, cast(case when p_value < 0.05 and status = 'computed' then sign(sens_slope) else 0 end as int) as trend_direction, p_value < 0.05 and status = 'computed' as significant from (
        select st.dataset_id, st.lat_idx, st.lon_idx, case when st.steps >= 5 then 'computed' else 'insufficient_observations' end as status, case when st.steps >= 5 and st.n >= 4 then s.sens_slope end as sens_slope,
            case when st.steps < 5 then null when st.n < 4 or t.most = st.n then 1.0::double when s.n_ties = 0 then c.p else {ERFC.format(x=_Z)} end as p_value
        from (select dataset_id, lat_idx, lon_idx, count(*) as steps, count(v) as n from annual group by all) st
        left join sen s on s.dataset_id = st.dataset_id and s.lat_idx = st.lat_idx and s.lon_idx = st.lon_idx
        left join tied t on t.dataset_id = st.dataset_id and t.lat_idx = st.lat_idx and t.lon_idx = st.lon_idx
        left join crit c on c.n = st.n and c.s = abs(s.kendall_s))""",
    "sen": "select dataset_id, lat_idx, lon_idx, count(distinct i) + 1 as n_obs, cast(sum(sign(y - x)) as bigint) as kendall_s, count(*) filter (x = y) as n_ties, median((y - x) / (j - i)) as sens_slope from pairs group by all",
}
_NEEDS = {"surf": ["obs"], "annual": ["obs"], "votes": ["obs"], "fracs": ["obs"], "placed": ["obs"], "monthly": ["placed", "regions"], "ranked": ["annual"], "pairs": ["ranked"], "sen": ["pairs"], "tied": ["ranked"], "tests": ["annual", "sen", "tied", "crit"]}


def _with(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        out += [x for x in [*_with(_NEEDS.get(n, [])), n] if x not in out]
    return out


def query(sql: str | None = None, uses: str = "obs", recursive: bool = False):
    def put(f):
        def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.round(c.name, 9).alias(c.name) if isinstance(c.dataType, T.DoubleType) else F.col(c.name) for c in df.schema.fields])

        QUERIES[f.__name__] = rounded
        if sql:
            ctes = ", ".join(f"{n} as ({CTES[n]})" for n in _with(uses.split()))
            head = f"with {'recursive ' if recursive else ''}{ctes}" if ctes else ""
            ORACLES[f.__name__] = f"{head}{', ' if ctes and recursive else ' '}{sql}" if ctes else sql
        return f

    return put


def surfaces(spark, sf) -> DataFrame:
    """One value a dataset and cell: means over all time, as fractions."""
    o = observations(spark, sf)
    return o.groupBy("dataset_id", *CELL).agg((scalars.mean(o, "value") / 100).alias("value"))


def annual(spark, sf) -> DataFrame:
    return series.by_year(observations(spark, sf))


def votes(spark, sf) -> DataFrame:
    return agreement.temporal_mode(observations(spark, sf)).withColumnRenamed("mode_class", "class_id")


def fractions(spark, sf) -> DataFrame:
    return summaries.class_shares(observations(spark, sf))


def placed(df: DataFrame) -> DataFrame:
    return df.withColumns({"lat": 17.5 - 5 * F.col("lat_idx"), "lon": 102.5 + 5 * F.col("lon_idx")})
