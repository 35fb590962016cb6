"""Queries on sources, sinks, caches and user-defined functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark import registry as L
from trailmark.functions import constants as K
from trailmark.functions import text as X
from trailmark.operators import builders as D
from trailmark.operators import evaluation as V
from trailmark.operators import extraction as E
from trailmark.operators import joins as J
from trailmark.operators import sampling as H
from trailmark.plans.building import metadata, trajectories
from trailmark.plans.conversation import labeled
from trailmark.plans.fixtures import geo_truth, message, rollout, sql_with, table
from trailmark.plans.registry import query
from trailmark.session import scratch_path
from trailmark.sources import readers as R
from trailmark.sources import writers as Wr


@query(
    "image_metadata_scan",
    sql_with("select image_id, round(latitude,6) as lat, round(longitude,6) as lon, country, nullif(city,'') as city, neighbourhood from metadata", "metadata"),
)
def image_metadata_scan(spark, sf):
    path = scratch_path(spark, "metadata")
    rows = metadata(spark, sf).select(
        F.col("image_id").alias("IMG_ID"), F.col("latitude").alias("LAT"), F.col("longitude").alias("LON"), "country", "region", "city", "neighbourhood", "continent", "path"
    )
    rows.write.option("header", True).csv(path)
    out = R.read_image_metadata(spark, path)
    return out.select(F.col("IMG_ID").alias("image_id"), F.round("LAT", 6).alias("lat"), F.round("LON", 6).alias("lon"), "country", "city", "neighbourhood")


@query("positional_scan", sql_with("select cast(id as string) as id, round(longitude,6) as longitude, round(latitude,6) as latitude from geo_truth", "geo_truth"))
def positional_scan(spark, sf):
    path = scratch_path(spark, "benchmark")
    filler = [F.lit("x").alias(f"f{i}") for i in range(2, 12)]
    geo_truth(spark, sf).select(F.lit(0).alias("no"), F.col("id"), *filler, "longitude", "latitude").write.option("sep", "\t").csv(path)
    out = R.read_positional_tsv(spark, path)
    return out.select("id", F.round("longitude", 6).alias("longitude"), F.round("latitude", 6).alias("latitude"))


def trajectory_lines(spark, sf):
    return trajectories(spark, sf).withColumn("id", F.col("id").cast("string")).drop("part")


SCAN_SQL = sql_with("select cast(t.id as string) as id, km, masked, n_tool_calls, m.n as n_messages from traj t join (select id, count(*) as n from traj_message group by 1) m on m.id=t.id", "traj", "traj_message")


@query("tolerant_json_scan", SCAN_SQL)
def tolerant_json_scan(spark, sf):
    path = scratch_path(spark, "trajectories")
    good = trajectory_lines(spark, sf).select(F.to_json(F.struct("*")).alias("value"))
    # A broken line and a blank one for every good line.
    broken = good.select(F.explode(F.array(F.col("value"), F.left("value", F.lit(40)), F.lit(""))).alias("value"))
    broken.write.text(path)
    out = R.read_trajectories(spark, path)
    return out.select("id", "km", "masked", "n_tool_calls", F.size("messages").cast("bigint").alias("n_messages"))


@query("strict_json_scan", SCAN_SQL)
def strict_json_scan(spark, sf):
    path = scratch_path(spark, "trajectories")
    trajectory_lines(spark, sf).write.json(path)
    out = R.read_trajectories(spark, path, mode="fail")
    return out.select("id", "km", "masked", "n_tool_calls", F.size("messages").cast("bigint").alias("n_messages"))


@query("united_files", "select n_nationkey as k, n_name as name, cast(null as string) as only_json from nation union all select r_regionkey, r_name, 'yes' from region")
def united_files(spark, sf):
    root = scratch_path(spark, "samples")
    table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).write.parquet(f"{root}/a.parquet")
    table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"), F.lit("yes").alias("only_json")).write.json(f"{root}/b.json")
    out = R.read_samples(spark, [f"{root}/a.parquet", f"{root}/b.json"])
    return out.select(F.col("k").cast("int").alias("k"), "name", "only_json")


@query("part_labels", "select c_custkey as id, cast(c_custkey%4 as string) as part from customer")
def part_labels(spark, sf):
    root = scratch_path(spark, "parts")
    table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 4).alias("p")).write.partitionBy("p").csv(root)
    rows = spark.read.schema("id bigint").csv(f"{root}/p=*")
    return R.with_part_label(rows, r"/p=(\w+)/").select("id", "part")


@query("normalized_columns", sql_with("select image_id as id, round(latitude,6) as latitude, round(longitude,6) as longitude from metadata", "metadata"))
def normalized_columns(spark, sf):
    rows = metadata(spark, sf).select(F.col("image_id").alias("IMG_ID"), F.round("latitude", 6).alias("LAT"), F.round("longitude", 6).alias("LON"))
    return R.normalize_columns(rows)


@query(
    "sample_sink",
    sql_with(
        """select version, case when cast(cast('0x'||left(md5('3|'||id),8) as bigint) as double)/4294967296.0<0.2 then 'test' else 'train' end as split, count(*) as n, count(distinct '/img/'||image_id) as n_images
 from metadata, (select unnest(['l0','l2']) as version) group by 1,2""",
        "metadata",
    ),
)
def sample_sink(spark, sf):
    path = scratch_path(spark, "sft")
    rows = D.expand_granularity(H.split_prob(metadata(spark, sf), 0.2, 3, "id"), ["l0", "l2"])
    samples = rows.select(
        "version", "split", D.build_chat("Locate.", F.lit("Where?"), F.col("answer")).alias("messages"),
        F.array(F.struct(F.concat(F.lit("/img/"), "image_id").alias("image"))).alias("images"),
    )
    Wr.write_samples(samples, path)
    back = spark.read.parquet(path)
    return back.groupBy("version", "split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("images")[0].image).alias("n_images"))


@query("rollout_dump", sql_with("select step, sample_id as input, data_source as output, round(score,6) as score, n_tokens as extra from rollout", "rollout"))
def rollout_dump(spark, sf):
    path = scratch_path(spark, "dump")
    rows = rollout(spark, sf).select(
        F.col("sample_id").cast("string").alias("input"), F.col("data_source").alias("output"), F.lit("t").alias("gts"), "score", "step",
        F.col("n_tokens").alias("extra"), F.when(F.col("pred") > 0, 1).alias("partial"),
    )
    Wr.write_rollout_dump(rows, path, extras=["extra", "partial"])
    back = spark.read.json(path)
    if "partial" in back.columns:
        raise AssertionError("an incomplete extra column was written")
    return back.select("step", F.col("input").cast("bigint").alias("input"), "output", F.round("score", 6).alias("score"), F.col("extra").cast("int").alias("extra"))


@query(
    "merged_caches",
    sql_with(
        "select conv_id, call_idx, result_pos, 'image' as part from image_labeled union all select conv_id, call_idx, result_pos, 'text' from text_labeled", "image_labeled", "text_labeled"
    ),
)
def merged_caches(spark, sf):
    parts = [labeled(spark, sf, t).withColumn("part", F.lit(p)) for t, p in ((K.IMAGE_SEARCH, "image"), (K.TEXT_SEARCH, "text"))]
    return H.union_parts(parts).select("conv_id", "call_idx", "result_pos", "part")


@query(
    "metric_log",
    sql_with(
        """select step, 'score/mean' as metric, round(avg(score),6) as value from rollout group by 1 union all select step, 'score/max', max(score) from rollout group by 1
 union all select step, 'tokens', cast(sum(n_tokens) as double) from rollout group by 1""",
        "rollout",
    ),
)
def metric_log(spark, sf):
    path = scratch_path(spark, "metrics")
    nested = rollout(spark, sf).groupBy("step").agg(
        F.struct(F.round(F.avg("score"), 6).alias("mean"), F.max("score").alias("max")).alias("score"), F.sum("n_tokens").alias("tokens")
    )
    Wr.write_metric_log(nested, path)
    return spark.read.schema("step int, metric string, value double").json(path)


UPSERT = """select key, value, created from (select *, row_number() over(partition by key order by created desc, new desc, value desc) as r from (
 select sha256(lower(trim(query))) as key, cast(msg_idx as int) as value, conv_id%7 as created, 0 as new from named_call where name='text_search_tool' union all
 select sha256(lower(trim(query))), cast(msg_idx+100 as int), conv_id%5, 1 from named_call where name='text_search_tool')) where r=1"""


@query("cache_upsert", sql_with(f"select key, value, created from ({UPSERT})", "named_call"))
def cache_upsert(spark, sf):
    calls = E.tool_calls(message(spark, sf)).where(F.col("name") == K.TEXT_SEARCH)
    asked = calls.select(F.try_variant_get(F.try_parse_json("arguments"), "$.query", "string").alias("query"), "conv_id", "msg_idx")
    upper = F.concat(F.lit("  "), F.upper("query"))
    cache = asked.select(X.cache_key_query(F.col("query")).alias("key"), F.col("msg_idx").cast("int").alias("value"), (F.col("conv_id") % 7).alias("created"))
    updates = asked.select(X.cache_key_query(upper).alias("key"), (F.col("msg_idx") + 100).cast("int").alias("value"), (F.col("conv_id") % 5).alias("created"))
    return Wr.upsert_latest(cache, updates, "key", "created", [F.col("value").desc()]).select("key", "value", "created")


@query(
    "box_cache_keys",
    sql_with("select conv_id, msg_idx, sha256('img/'||conv_id||'|'||printf('%.1f,%.1f,%.1f,%.1f',bbox[1],bbox[2],bbox[3],bbox[4])) as key from named_call where name='image_search_tool'", "named_call"),
)
def box_cache_keys(spark, sf):
    calls = E.tool_calls(message(spark, sf)).where(F.col("name") == K.IMAGE_SEARCH)
    box = F.try_variant_get(F.try_parse_json("arguments"), "$.bbox_2d", "array<double>")
    path = F.concat(F.lit("img/"), F.col("conv_id").cast("string"))
    return calls.select("conv_id", "msg_idx", X.cache_key_box(path, box).alias("key"))


def image_files(spark, sf):
    """One file per nation; those of region 2 do not start like a picture."""
    root = scratch_path(spark, "images")
    body = F.when(F.col("n_regionkey") == 2, "broken").otherwise(F.concat(F.lit("IMG "), "n_name"))
    table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), body.alias("value")).repartition("k").write.partitionBy("k").text(root)
    return root


@query("image_listing", "select n_nationkey as k, length(case when n_regionkey=2 then 'broken' else 'IMG '||n_name end)+1 as length from nation")
def image_listing(spark, sf):
    files = R.list_images(spark, image_files(spark, sf), "*.txt")
    return files.select(F.regexp_extract("path", r"/k=(\d+)/", 1).cast("int").alias("k"), "length")


@query("corrupt_image_filter", "select n_nationkey as k, n_name from nation where n_regionkey<>2")
def corrupt_image_filter(spark, sf):
    files = R.list_images(spark, image_files(spark, sf), "*.txt", content=True)
    bad = J.check_images(files, lambda content: content.startswith(b"IMG"))
    bad_keys = bad.select(F.regexp_extract("path", r"/k=(\d+)/", 1).cast("int").alias("k"))
    return J.drop_bad(table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_name"), bad_keys, "k")


@query("registered_reward", "select doc_id, cast(length(text) as double) as score, cast(case when lang='en' then 2 else 1 end as double) as bonus from documents")
def registered_reward(spark, sf):
    def measure(source, solution, truth, extra, weight):
        return {"score": len(solution), "bonus": weight if truth == "en" else 1}

    L.register_reward("measure", measure, fields=["score", "bonus"], weight=2)
    out = L.apply_reward(table(spark, sf, "documents"), "measure", "source", "text", "lang")
    return out.select("doc_id", "reward.score", "reward.bonus")


@query("registered_batch_reward", "select doc_id, cast(case when source<>lang then 1 else 0 end as double) as score from documents")
def registered_batch_reward(spark, sf):
    L.register_reward("differs", lambda sources, solutions, truths, extras: [float(a != b) for a, b in zip(sources, truths)], batched=True)
    return L.apply_reward(table(spark, sf, "documents"), "differs", "source", "text", "lang").select("doc_id", "reward.score")


@query("registered_advantage", sql_with("select sample_id, round(score-avg(score) over(partition by uid),6)+0.0 as advantage from rollout", "rollout"))
def registered_advantage(spark, sf):
    from trailmark.operators.groups import attach_stats

    def centred(df):
        return attach_stats(df, ["uid"], {"m": F.avg("score")}, "sample_id").withColumn("advantage", F.col("score") - F.col("m"))

    L.ADVANTAGES.pop("centred", None)
    L.register_advantage("centred", centred)
    return L.compute_advantage(rollout(spark, sf), "centred").select("sample_id", (F.round("advantage", 6) + 0.0).alias("advantage"))


@query("registered_generator", "select doc_id, n_chars from documents union all select -doc_id-1, n_chars from documents where len([x for x in regexp_split_to_array(text,'\\s+') if x<>''])<=150")
def registered_generator(spark, sf):
    L.register_generator("mirror", lambda df: df.withColumn("doc_id", -F.col("doc_id") - 1))
    docs = table(spark, sf, "documents")
    return D.append_generated(docs, L.generate(docs, "mirror"), 150, text="text").select("doc_id", "n_chars")


@query("tool_call_function", sql_with("select conv_id, msg_idx, call_no, name, cast(json_extract(raw, '$.arguments') as varchar) as arguments from named_call", "named_call"))
def tool_call_function(spark, sf):
    L.register_sql(spark)
    message(spark, sf).where("role = 'assistant'").createOrReplaceTempView("assistant_message")
    return spark.sql("select conv_id, msg_idx, inline(calls) from (select conv_id, msg_idx, tool_calls(content) as calls from assistant_message)")


@query("search_result_function", sql_with("select conv_id, call_idx, result_pos as pos, result_title as title, result_source as source, result_link as link from image_result where result_pos>=0", "image_result"))
def search_result_function(spark, sf):
    L.register_sql(spark)
    E.pair_calls(message(spark, sf), K.IMAGE_SEARCH).createOrReplaceTempView("image_pair")
    return spark.sql("select conv_id, call_idx, inline(results) from (select conv_id, call_idx, search_results(response) as results from image_pair)")


@query(
    "majority_aggregate",
    sql_with(
        """select uid, arg_min(value, ord) as value from (select uid, value, (1000000-n)*1000000000+first as ord from (select uid, pred, count(*) as n, min(sample_id) as first, arg_min(score, sample_id) as value from rollout group by 1,2)) group by 1""",
        "rollout",
    ),
)
def majority_aggregate(spark, sf):
    votes = rollout(spark, sf).groupBy("uid", "pred").agg(F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("first"), F.min_by("score", "sample_id").alias("value"))
    return votes.groupBy("uid").agg(L.majority(F.col("n"), F.col("first"), F.col("value")).alias("value"))


@query(
    "bootstrap_aggregate",
    sql_with(
        """select uid, round(sum(score*hits)/1000,6) as best_of_4 from (
 select uid, score, count(u) as hits from (select uid, score, cast(sum(c) over(partition by uid order by score) as double) as upto, c, cast(sum(c) over(partition by uid) as double) as n from (select uid, score, count(*) as c from rollout group by 1,2))
 left join (select cast('0x'||substr(md5('42|'||i),1,13) as bigint)/power(16,13) as u from range(1000) t(i)) on u<power(upto/n,4) and u>=power((upto-c)/n,4) group by uid, score) group by 1""",
        "rollout",
    ),
)
def bootstrap_aggregate(spark, sf):
    ladder = V.value_ladder(rollout(spark, sf).select("uid", F.col("score").alias("value")), ["uid"])
    best = L.bootstrap_best(F.col("value"), F.col("c"), F.col("upto"), F.col("n"), F.lit(4))
    return ladder.groupBy("uid").agg(F.round(best, 6).alias("best_of_4"))
