"""Queries on predictions, distances and run comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions import geo as G
from trailmark.operators import accuracy as A
from trailmark.operators import profiles as P
from trailmark.plans.fixtures import add_view, geo_pred, geo_scored, geo_truth, sql_with, table
from trailmark.plans.registry import query

ACC_SQL = ", ".join(
    f"coalesce(round(cast(count(case when km<={t} then 1 end) as double)/nullif({{base}},0),4),0.0) as acc_{t}km"
    for t in (1, 25, 200, 750, 2500)
)


def summary_sql(base: str, by: str) -> str:
    return f"""select {by}, count(*) as n_total, count(km) as n_parsed, count(*)-count(km) as n_no_pred,
 round(cast(count(km) as double)/count(*),4) as parse_rate, {ACC_SQL.format(base=base)},
 round(cast(sum(n_tool_calls) as double)/count(*),3) as avg_n_tool_calls from geo_scored group by {by}"""


@query("accuracy_summary", sql_with(summary_sql("count(*)", "run, segment"), "geo_scored"))
def accuracy_summary(spark, sf):
    return A.accuracy_summary(geo_scored(spark, sf), ["run", "segment"])


@query("accuracy_of_parsed", sql_with(summary_sql("count(km)", "run"), "geo_scored"))
def accuracy_of_parsed(spark, sf):
    return A.accuracy_summary(geo_scored(spark, sf), ["run"], denominator="parsed")


def two_runs(spark, sf):
    scored = geo_scored(spark, sf).select("id", "run", "km")
    return scored.where("run = 0").drop("run"), scored.where("run = 1").drop("run")


PASS = ", ".join(f"coalesce(a.km<={t},false) as pass_a_{t}, coalesce(b.km<={t},false) as pass_b_{t}" for t in (25, 200, 750, 2500))
add_view(
    "compared",
    f"""select a.id, a.km as km_a, b.km as km_b, b.km-a.km as km_delta, {PASS}
 from (select * from geo_scored where run=0) a join (select * from geo_scored where run=1) b on a.id=b.id""",
    "geo_scored",
)
TAGS = ", ".join(
    f"case when not pass_a_{t} and pass_b_{t} then '↑@{t}km' when pass_a_{t} and not pass_b_{t} then '↓@{t}km' end"
    for t in (25, 200, 750, 2500)
)


@query(
    "compare_runs",
    sql_with(
        f"""select id, round(km_a,6) as km_a, round(km_b,6) as km_b, round(km_delta,6)+0.0 as km_delta,
 {", ".join(f"pass_{s}_{t}" for t in (25, 200, 750, 2500) for s in "ab")},
 coalesce(nullif(concat_ws(' | ', {TAGS}),''),'—') as change_summary from compared""",
        "compared",
    ),
)
def compare_runs(spark, sf):
    out = A.compare_runs(*two_runs(spark, sf))
    return out.withColumns({c: F.round(c, 6) + 0.0 for c in ("km_a", "km_b", "km_delta")})


@query(
    "common_accuracy",
    sql_with(
        "select n_common, threshold, acc_a, acc_b, round(acc_b-acc_a,6) as delta from ("
        + " union all ".join(
            f"select count(*) as n_common, {t} as threshold, round(cast(count(case when pass_a_{t} then 1 end) as double)/count(*),6) as acc_a,"
            f" round(cast(count(case when pass_b_{t} then 1 end) as double)/count(*),6) as acc_b from compared"
            for t in (25, 200, 750, 2500)
        )
        + ")",
        "compared",
    ),
)
def common_accuracy(spark, sf):
    return A.common_accuracy(A.compare_runs(*two_runs(spark, sf)))


@query(
    "change_counts",
    sql_with(
        " union all ".join(
            f"select 'improved_{t}' as category, count(*) as n from compared where not pass_a_{t} and pass_b_{t}"
            f" union all select 'regressed_{t}', count(*) from compared where pass_a_{t} and not pass_b_{t}"
            for t in (25, 200, 750, 2500)
        )
        + " union all select 'no_prediction_a', count(*) from compared where km_a is null"
        " union all select 'no_prediction_b', count(*) from compared where km_b is null",
        "compared",
    ),
)
def change_counts(spark, sf):
    return A.change_counts(A.compare_runs(*two_runs(spark, sf)))


DIFFICULTY = "case when km is null then 'unknown' when km<=25 then 'easy' when km<=200 then 'medium' else 'hard' end"


@query("difficulty_bucket", sql_with(f"select id, run, {DIFFICULTY} as difficulty from geo_scored", "geo_scored"))
def difficulty_bucket(spark, sf):
    return geo_scored(spark, sf).select("id", "run", G.difficulty(F.col("km")).alias("difficulty"))


@query(
    "difficulty_distribution",
    sql_with(f"select {DIFFICULTY} as difficulty, count(*) as n from geo_scored group by 1", "geo_scored"),
)
def difficulty_distribution(spark, sf):
    return A.value_counts(difficulty_bucket(spark, sf), "difficulty")


SCORE_SQL = """case when km is null then null when km<=1 then 1.0 when km<=25 then 1.0+(km-1)/24*(0.8-1.0)
 when km<=200 then 0.8+(km-25)/175*(0.6-0.8) when km<=750 then 0.6+(km-200)/550*(0.4-0.6)
 when km<=2500 then 0.4+(km-750)/1750*(0.2-0.4) else 0.0 end"""


@query(
    "haversine_distance",
    sql_with("select id, run, round(km,6) as km from geo_scored", "geo_scored"),
)
def haversine_distance(spark, sf):
    return geo_scored(spark, sf).select("id", "run", F.round("km", 6).alias("km"))


@query(
    "distance_score",
    sql_with(f"select id, run, round(cast({SCORE_SQL} as double),6) as score from geo_scored", "geo_scored"),
)
def distance_score(spark, sf):
    return geo_scored(spark, sf).select("id", "run", F.round(G.distance_score(F.col("km")), 6).alias("score"))


@query(
    "truth_prediction_join",
    sql_with(
        "select g.id, p.run, g.segment, round(g.latitude,6) as latitude, round(p.pred_lat,6) as pred_lat"
        " from geo_truth g join geo_pred p on g.id=p.id",
        "geo_pred",
    ),
)
def truth_prediction_join(spark, sf):
    return (
        geo_truth(spark, sf)
        .join(geo_pred(spark, sf), "id")
        .select("id", "run", "segment", F.round("latitude", 6).alias("latitude"), F.round("pred_lat", 6).alias("pred_lat"))
    )


@query(
    "describe_numeric",
    sql_with(
        " union all ".join(
            f"select '{c}' as \"column\", count({c}) as n, round(avg({c}),6) as mean, round(stddev_samp({c}),6) as std,"
            f" round(cast(min({c}) as double),6) as min, round(cast(max({c}) as double),6) as max, round(cast(quantile_cont({c},0.25) as double),6) as p25,"
            f" round(cast(quantile_cont({c},0.5) as double),6) as p50, round(cast(quantile_cont({c},0.75) as double),6) as p75 from geo_scored"
            for c in ("km", "n_tool_calls")
        ),
        "geo_scored",
    ),
)
def describe_numeric(spark, sf):
    out = P.describe(geo_scored(spark, sf), ["km", "n_tool_calls"])
    return out.select("column", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max", "p25", "p50", "p75")])


@query(
    "length_profile",
    """select count(n_chars) as n, count(*)-count(n_chars) as n_failed, min(n_chars) as min_length, max(n_chars) as max_length,
 round(avg(n_chars),6) as mean_length, count(case when n_chars>4096 then 1 end) as n_over,
 round(cast(count(case when n_chars>4096 then 1 end) as double)/count(n_chars),6) as over_share,
 """
    + ", ".join(f"round(cast(quantile_cont(n_chars,{p / 100}) as double),6) as p{p}" for p in (50, 75, 90, 95, 99))
    + " from documents",
)
def length_profile(spark, sf):
    out = P.length_profile(table(spark, sf, "documents").select("n_chars"), "n_chars", 4096)
    return out.select(
        "n", "n_failed", "min_length", "max_length", "n_over",
        *[F.round(c, 6).alias(c) for c in ("mean_length", "over_share", "p50", "p75", "p90", "p95", "p99")],
    )


@query(
    "dedupe_last_per_id",
    sql_with(
        """select id, run, round(km,6) as km from (select *, row_number() over(partition by id order by run desc) as rn
 from geo_scored) where rn=1""",
        "geo_scored",
    ),
)
def dedupe_last_per_id(spark, sf):
    rows = geo_scored(spark, sf).select("id", "run", F.round("km", 6).alias("km"))
    return A.dedupe_last(rows, "id", [F.col("run").desc()])


@query(
    "scaling_curve",
    sql_with(
        f"""select step, cast(step/20 as int) as train_images, acc_1km, acc_25km, acc_200km, acc_750km, acc_2500km from (
 select cast(200*(1+id%31) as int) as step, {ACC_SQL.format(base="count(*)")} from geo_scored group by 1) where step between 200 and 5600""",
        "geo_scored",
    ),
)
def scaling_curve(spark, sf):
    runs = geo_scored(spark, sf).withColumn("step", (200 * (1 + F.col("id") % 31)).cast("int"))
    return A.scaling_curve(spark, A.accuracy_summary(runs, ["step"], call_columns=()))


@query(
    "attach_with_defaults",
    sql_with(
        """select g.id, coalesce(p.km,0.0) as km, coalesce(p.n_tool_calls,0) as n_tool_calls from geo_truth g
 left join (select id, round(km,6) as km, n_tool_calls from geo_scored where run=1 and km<=200) p on g.id=p.id""",
        "geo_scored",
    ),
)
def attach_with_defaults(spark, sf):
    attributes = geo_scored(spark, sf).where((F.col("run") == 1) & (F.col("km") <= 200))
    attributes = attributes.select("id", F.round("km", 6).alias("km"), "n_tool_calls")
    return A.attach(geo_truth(spark, sf).select("id"), attributes, "id", {"km": 0.0, "n_tool_calls": 0})


@query(
    "normalize_coordinates",
    sql_with(
        """select id, round(lat,6) as lat, round(lon,6) as lon, inside from (select id,
 case when inside then latitude+dlat*180.0/(6378245.0*(1-0.00669342162296594)/(curve*sqrt(curve))*pi()) else latitude end as lat,
 case when inside then longitude+dlon*180.0/(6378245.0/sqrt(curve)*cos(latitude/180.0*pi())*pi()) else longitude end as lon, inside from (
 select *, 1-0.00669342162296594*pow(sin(latitude/180.0*pi()),2) as curve,
 longitude between 72.004 and 137.8347 and latitude between 0.8293 and 55.8271 as inside,
 -100.0+2.0*x+3.0*y+0.2*y*y+0.1*x*y+0.2*sqrt(abs(x))+(20.0*sin(6.0*x*pi())+20.0*sin(2.0*x*pi()))*2.0/3.0
 +(20.0*sin(y*pi())+40.0*sin(y/3.0*pi()))*2.0/3.0+(160.0*sin(y/12.0*pi())+320.0*sin(y*pi()/30.0))*2.0/3.0 as dlat,
 300.0+x+2.0*y+0.1*x*x+0.1*x*y+0.1*sqrt(abs(x))+(20.0*sin(6.0*x*pi())+20.0*sin(2.0*x*pi()))*2.0/3.0
 +(20.0*sin(x*pi())+40.0*sin(x/3.0*pi()))*2.0/3.0+(150.0*sin(x/12.0*pi())+300.0*sin(x/30.0*pi()))*2.0/3.0 as dlon
 from (select *, longitude-105.0 as x, latitude-35.0 as y from geo_truth)))""",
        "geo_truth",
    ),
)
def normalize_coordinates(spark, sf):
    moved = geo_truth(spark, sf).withColumn("p", G.wgs84_to_gcj02(F.col("latitude"), F.col("longitude")))
    inside = F.col("longitude").between(72.004, 137.8347) & F.col("latitude").between(0.8293, 55.8271)
    return moved.select("id", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"), inside.alias("inside"))


@query(
    "dms_to_decimal",
    sql_with(
        """select id, round(case when latitude<0 then -1 else 1 end*(floor(abs(latitude))+cast(id%60 as double)/60+cast(id%3600 as double)/3600),6)+0.0
 as decimal_degrees from geo_truth""",
        "geo_truth",
    ),
)
def dms_to_decimal(spark, sf):
    degrees = F.floor(F.abs("latitude"))
    ref = F.when(F.col("latitude") < 0, "S").otherwise("N")
    value = G.dms_to_decimal(degrees, F.col("id") % 60, F.col("id") % 3600, ref)
    return geo_truth(spark, sf).select("id", (F.round(value, 6) + 0.0).alias("decimal_degrees"))
