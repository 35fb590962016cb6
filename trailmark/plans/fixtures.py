"""Domain tables derived from the provided ones, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.functions.geo import haversine_km


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geo_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"),
        (((key * 7919) % 9000).cast("double") / 100.0 - 45.0).alias("latitude"),
        (((key * 104729) % 24000).cast("double") / 100.0 - 120.0).alias("longitude"),
        F.col("c_mktsegment").alias("segment"),
        F.when(key % 50 != 0, F.col("c_nationkey")).alias("nationkey"),
    )


OFFSETS = [(0.001, 0.001), (0.1, 0.1), (1.0, 1.0), (4.0, 3.0), (-15.0, 10.0), (-40.0, 60.0)]


def geo_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of predictions per id, from about 0.15 km to beyond 2500 km off; every 11th is missing."""
    rows = geo_truth(spark, sf_dir).withColumn("run", F.explode(F.array(F.lit(0), F.lit(1))))
    k = ((F.col("id") * 7 + F.col("run") * 5) % 6).cast("int")
    missing = (F.col("id") + F.col("run")) % 11 == 0
    d_lat = F.array(*[F.lit(a) for a, _ in OFFSETS])[k]
    d_lon = F.array(*[F.lit(b) for _, b in OFFSETS])[k]
    return rows.select(
        "id",
        "run",
        F.when(~missing, F.col("latitude") + d_lat).alias("pred_lat"),
        F.when(~missing, F.col("longitude") + d_lon).alias("pred_lon"),
        ((F.col("id") * 3 + F.col("run")) % 6).cast("int").alias("n_tool_calls"),
    )


def geo_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth joined with predictions on id, with the distance in kilometres."""
    return (
        geo_truth(spark, sf_dir)
        .join(geo_pred(spark, sf_dir), "id")
        .withColumn("km", haversine_km(F.col("pred_lat"), F.col("pred_lon"), F.col("latitude"), F.col("longitude")))
    )


def rollout(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit("|"), F.substr(F.col("ts").cast("string"), F.lit(1), F.lit(10))).alias("uid"),
        event.alias("sample_id"),
        F.col("event_type").alias("data_source"),
        F.col("value").alias("score"),
        (1 + event % 37).cast("int").alias("n_tokens"),
        "ts",
        (event % 5).cast("int").alias("pred"),
        F.floor(event / 512).cast("int").alias("step"),
    )


def token(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Named before it is numbered, so that later windows per sequence find the rows in place.
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sample_id"),
        "l_linenumber",
        "l_suppkey",
        "l_quantity",
        (-(F.col("l_discount") + 0.01)).alias("old_logp"),
        (-(F.col("l_tax") + 0.012)).alias("rollout_logp"),
        F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("mask"),
        (F.col("l_extendedprice") / 100000.0).alias("reward"),
        (F.col("l_quantity") / 50.0).alias("value_est"),
        (F.col("l_orderkey") % 100).alias("uid"),
        F.col("l_partkey").alias("token_id"),
        (-(F.col("l_quantity") / 500.0 + 0.01)).alias("ref_logp"),
        F.exp(-2.0 * (F.col("l_discount") + 0.01)).alias("sum_pi_squared"),
    )
    order = W.partitionBy("sample_id").orderBy("l_linenumber", "token_id", "l_suppkey", "l_quantity")
    return rows.withColumn("t", F.row_number().over(order)).drop("l_linenumber", "l_suppkey", "l_quantity")


def message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation messages with calls, matching responses, useful tags and answers built in."""
    conv, turn, text, role = F.col("conv_id"), F.col("turn"), F.col("text"), F.col("role")
    phase = (conv + turn) % 3

    def num(column):
        return column.cast("string")

    box = F.concat_ws(
        ", ", num((conv * 37) % 400), num((conv * 53) % 400), num(500 + (conv * 71) % 500), num(500 + (conv * 91) % 500)
    )
    image_call = F.concat(
        F.lit("<think>"), text,
        F.lit(' [1] [3]</think><useful>[1, 2]</useful><tool_call>{"name": "image_search_tool", "arguments": {"bbox_2d": ['),
        box, F.lit("]}}</tool_call>"),
    )
    text_call = F.concat(
        F.lit("<think>"), text,
        F.lit('</think><tool_call>{"name": "text_search_tool", "arguments": {"query": "landmark '),
        num(conv % 9), F.lit(" city "), num(turn % 4), F.lit('"}}</tool_call>'),
    )
    answer = F.concat(
        F.lit("<think>"), text, F.lit(" [1]</think><useful>[1]</useful><answer>Country, City, "),
        num((conv * 7) % 80), F.lit(".5, "), num((conv * 13) % 170), F.lit(".25</answer>"),
    )
    image_response = F.concat(
        F.lit("<tool_response>\nImage search results for region [0, 0, 9, 9]:\n\n[1] Title "), num(conv),
        F.lit("\n    Source: a.example.com\n    Link: https://a.example.com/"), num(conv),
        F.lit("\n[2] Other\n    Source: flickr.com\n    Link: https://flickr.com/"), num(turn),
        F.lit("\n</tool_response>"),
    )
    web_response = F.concat(
        F.lit("<tool_response>\nWeb search results for: q"), num(conv),
        F.lit(
            "\n\n[1] T1\nURL: https://b.example.org/1\nbody one\n\n[2] T2\nURL: https://c.example.org/2\nbody two"
            "\n</tool_response>"
        ),
    )
    content = (
        F.when((role == "assistant") & (phase == 0), image_call)
        .when((role == "assistant") & (phase == 1), text_call)
        .when(role == "assistant", answer)
        .when((role == "user") & (turn > 0) & (phase == 1), image_response)
        .when((role == "user") & (turn > 0) & (phase == 2), web_response)
        .otherwise(text)
    )
    return table(spark, sf_dir, "conversations").select(
        "conv_id", turn.alias("msg_idx"), "role", content.alias("content")
    )


# The same tables for the SQL side. Each entry may use the ones before it.
SQL_VIEWS = {
    "geo_truth": """
select c_custkey as id, cast((c_custkey*7919)%9000 as double)/100.0-45.0 as latitude,
 cast((c_custkey*104729)%24000 as double)/100.0-120.0 as longitude,
 c_mktsegment as segment, case when c_custkey%50=0 then null else c_nationkey end as nationkey from customer""",
    "geo_pred": """
select g.id, r.run, case when (g.id+r.run)%11=0 then null else g.latitude+o.dlat end as pred_lat,
 case when (g.id+r.run)%11=0 then null else g.longitude+o.dlon end as pred_lon,
 cast((g.id*3+r.run)%6 as int) as n_tool_calls
 from geo_truth g cross join (select 0 as run union all select 1 as run) r
 join (select 0 as k, 0.001 as dlat, 0.001 as dlon union all select 1,0.1,0.1 union all select 2,1.0,1.0
 union all select 3,4.0,3.0 union all select 4,-15.0,10.0 union all select 5,-40.0,60.0) o on o.k=(g.id*7+r.run*5)%6""",
    "geo_scored": """
select * exclude (chord), 2*6371.0*asin(sqrt(case when chord>1 then 1.0 else chord end)) as km from (
 select g.*, p.run, p.pred_lat, p.pred_lon, p.n_tool_calls, pow(sin(radians(latitude-pred_lat)/2),2)
 + cos(radians(pred_lat))*cos(radians(latitude))*pow(sin(radians(longitude-pred_lon)/2),2) as chord
 from geo_truth g join geo_pred p on g.id=p.id)""",
    "rollout": """
select concat(cast(user_id as string),'|',substr(cast(ts as string),1,10)) as uid, event_id as sample_id,
 event_type as data_source, value as score, cast(1+event_id%37 as int) as n_tokens, ts,
 cast(event_id%5 as int) as pred, cast(floor(event_id/512) as int) as step from events""",
    "token": """
select l_orderkey as sample_id,
 cast(row_number() over(partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_quantity) as int) as t,
 -(l_discount+0.01) as old_logp, -(l_tax+0.012) as rollout_logp, case when l_returnflag='N' then 0 else 1 end as mask,
 l_extendedprice/100000.0 as reward, l_quantity/50.0 as value_est, l_orderkey%100 as uid, l_partkey as token_id,
 -(l_quantity/500.0+0.01) as ref_logp, exp(-2.0*(l_discount+0.01)) as sum_pi_squared
 from lineitem""",
    "message": """
select conv_id, turn as msg_idx, role, case
 when role='assistant' and (conv_id+turn)%3=0 then concat('<think>',text,' [1] [3]</think><useful>[1, 2]</useful><tool_call>{"name": "image_search_tool", "arguments": {"bbox_2d": [',cast((conv_id*37)%400 as string),', ',cast((conv_id*53)%400 as string),', ',cast(500+(conv_id*71)%500 as string),', ',cast(500+(conv_id*91)%500 as string),']}}</tool_call>')
 when role='assistant' and (conv_id+turn)%3=1 then concat('<think>',text,'</think><tool_call>{"name": "text_search_tool", "arguments": {"query": "','landmark ',cast(conv_id%9 as string),' city ',cast(turn%4 as string),'"}}</tool_call>')
 when role='assistant' then concat('<think>',text,' [1]</think><useful>[1]</useful><answer>Country, City, ',cast((conv_id*7)%80 as string),'.5, ',cast((conv_id*13)%170 as string),'.25</answer>')
 when role='user' and turn>0 and (conv_id+turn)%3=1 then concat('<tool_response>',chr(10),'Image search results for region [0, 0, 9, 9]:',chr(10),chr(10),'[1] Title ',cast(conv_id as string),chr(10),'    Source: a.example.com',chr(10),'    Link: https://a.example.com/',cast(conv_id as string),chr(10),'[2] Other',chr(10),'    Source: flickr.com',chr(10),'    Link: https://flickr.com/',cast(turn as string),chr(10),'</tool_response>')
 when role='user' and turn>0 and (conv_id+turn)%3=2 then concat('<tool_response>',chr(10),'Web search results for: q',cast(conv_id as string),chr(10),chr(10),'[1] T1',chr(10),'URL: https://b.example.org/1',chr(10),'body one',chr(10),chr(10),'[2] T2',chr(10),'URL: https://c.example.org/2',chr(10),'body two',chr(10),'</tool_response>')
 else text end as content from conversations""",
}

DEPENDS = {"geo_pred": ["geo_truth"], "geo_scored": ["geo_truth", "geo_pred"]}


def add_view(name: str, sql: str, *needs: str) -> None:
    SQL_VIEWS[name] = sql
    DEPENDS[name] = list(needs)


def sql_with(body: str, *views: str) -> str:
    """``body`` preceded by the named views and those they need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in DEPENDS.get(name, []):
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        visit(view)
    if not ordered:
        return body
    return "with " + ",\n".join(f"{v} as ({SQL_VIEWS[v].strip()})" for v in ordered) + "\n" + body
