"""Queries on sampling, splits, shards and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import sampling as H
from trailmark.plans.fixtures import geo_scored, rollout, sql_with, table
from trailmark.plans.registry import query


def orders(spark, sf):
    return table(spark, sf, "orders")


CAPPED = """(select *, row_number() over(partition by o_orderstatus order by md5('42|'||o_orderkey), o_orderkey) as rn from orders)"""


@query("capped_classes", f"select o_orderkey, o_orderstatus from {CAPPED} where rn<=1000")
def capped_classes(spark, sf):
    return H.cap_per_class(orders(spark, sf).select("o_orderkey", "o_orderstatus"), "o_orderstatus", 1000, 42, "o_orderkey")


@query("seeded_sample", "select o_orderkey, o_totalprice from (select *, row_number() over(order by md5('7|'||o_orderkey)) as rn from orders) where rn<=1500")
def seeded_sample(spark, sf):
    return H.sample_n(orders(spark, sf).select("o_orderkey", "o_totalprice"), 1500, 7, "o_orderkey")


@query("shuffled_index", "select o_orderkey, row_number() over(order by md5('11|'||o_orderkey))-1 as index from orders")
def shuffled_index(spark, sf):
    return H.shuffled(orders(spark, sf).select("o_orderkey"), 11, "o_orderkey")


@query(
    "split_by_count",
    "select o_orderkey, case when rn<=greatest(1,cast(floor(n*0.05) as bigint)) then 'val' else 'train' end as split from (select *, row_number() over(order by md5('3|'||o_orderkey)) as rn, count(*) over() as n from orders)",
)
def split_by_count(spark, sf):
    return H.split_count(orders(spark, sf).select("o_orderkey"), 0.05, 3, "o_orderkey")


@query(
    "split_by_probability",
    "select o_orderkey, case when cast(cast('0x'||left(md5('3|'||o_orderkey),8) as bigint) as double)/4294967296.0<0.1 then 'test' else 'train' end as split from orders",
)
def split_by_probability(spark, sf):
    return H.split_prob(orders(spark, sf).select("o_orderkey"), 0.1, 3, "o_orderkey")


@query(
    "limited_samples",
    """select 'first' as kind, o_orderkey from (select o_orderkey from orders order by 1 limit 700) union all
 select 'chosen', o_orderkey from (select o_orderkey, row_number() over(order by md5('1|'||o_orderkey)) as rn from orders) where rn<=700""",
)
def limited_samples(spark, sf):
    rows = orders(spark, sf).select("o_orderkey")
    first = H.max_samples(rows, 700, "o_orderkey").withColumn("kind", F.lit("first"))
    chosen = H.max_samples(rows, 700, "o_orderkey", shuffle=True).withColumn("kind", F.lit("chosen"))
    return first.unionByName(chosen)


@query("dense_reindex", "select o_orderkey, row_number() over(order by o_orderkey)-1 as index from orders where o_orderstatus='F'")
def dense_reindex(spark, sf):
    return H.reindex(orders(spark, sf).where("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey")


@query("equal_parts", "select o_orderkey, cast(floor((row_number() over(order by o_orderkey)-1)/(n/5)) as int) as part from (select o_orderkey, count(*) over() as n from orders)")
def equal_parts(spark, sf):
    return H.split_equal(orders(spark, sf).select("o_orderkey"), 5, "o_orderkey")


@query("class_preview", "select o_orderpriority, o_orderkey from (select *, row_number() over(partition by o_orderpriority order by o_orderkey) as rn from orders) where rn<=20")
def class_preview(spark, sf):
    return H.preview(orders(spark, sf).select("o_orderpriority", "o_orderkey"), "o_orderpriority", [F.col("o_orderkey")])


@query(
    "replay_sample",
    "select event_id from (select event_id, row_number() over(order by md5('9|'||event_id)) as rn from (select event_id from events order by event_id desc limit 2000)) where rn<=500",
)
def replay_sample(spark, sf):
    return H.replay_sample(table(spark, sf, "events").select("event_id"), "event_id", 2000, 500, 9)


@query(
    "assigned_batches",
    """select o_orderkey, epoch, cast(floor((rk-1)/50) as int) as batch, cast((rk-1)%50 as int) as place from (
 select o_orderkey, cast(e as int) as epoch, row_number() over(partition by e order by md5('4|'||e||'|'||o_orderkey), o_orderkey) as rk from orders, range(0,2) t(e))""",
)
def assigned_batches(spark, sf):
    return H.assign_batches(orders(spark, sf).select("o_orderkey"), 50, 2, 4, "o_orderkey")


@query("factorized_labels", sql_with("select sample_id, dense_rank() over(order by uid)-1 as group_id from rollout", "rollout"))
def factorized_labels(spark, sf):
    return H.factorize(rollout(spark, sf).select("sample_id", "uid"), "uid").select("sample_id", "group_id")


def resample_sql(weight):
    return sql_with(
        f"""select d.sample_id as draw, p.sample_id from (select sample_id, cast(cast('0x'||left(md5('6d|'||sample_id),8) as bigint) as double)/4294967296.0*(select sum({weight}+1e-8) from rollout) as u from rollout) d
 asof join (select sample_id, sum(w) over(order by md5('6|'||sample_id), sample_id)-w as lo from (select sample_id, {weight}+1e-8 as w from rollout)) p on d.u>=p.lo""",
        "rollout",
    )


@query("resampled_by_score", resample_sql("pow(abs(score),2)"))
def resampled_by_score(spark, sf):
    return H.reweight(rollout(spark, sf).select("sample_id", "score"), "sample_id", "score", "pow", 6).select("draw", "sample_id")


@query("resampled_extremes", resample_sql("case when score=(select max(score) from rollout) or score=(select min(score) from rollout) then 1.0 else 0.0 end"))
def resampled_extremes(spark, sf):
    return H.reweight(rollout(spark, sf).select("sample_id", "score"), "sample_id", "score", "max_min", 6).select("draw", "sample_id")


@query("resampled_best", resample_sql("case when score=(select max(score) from rollout) then 0.4 else 0.1 end"))
def resampled_best(spark, sf):
    return H.reweight(rollout(spark, sf).select("sample_id", "score"), "sample_id", "score", "max_random", 6).select("draw", "sample_id")


SNAKE = """(select step, sample_id, n_tokens, cast(case when spot<4 then spot else 7-spot end as int) as shard from (select *, (row_number() over(partition by step order by 24576*n_tokens+n_tokens*n_tokens desc, sample_id)-1)%8 as spot from rollout))"""


@query("snake_shards", sql_with(f"select step, sample_id, shard from {SNAKE}", "rollout"))
def snake_shards(spark, sf):
    rows = rollout(spark, sf).select("step", "sample_id", "n_tokens").withColumn("load", H.workload(F.col("n_tokens")))
    return H.snake(rows, "load", "sample_id", 4, ["step"]).select("step", "sample_id", "shard")


@query(
    "shard_imbalance",
    sql_with(
        f"""select a.step, a.mn as min, a.mx as max, a.mx-a.mn as minmax_diff, a.mean, b.mn as balanced_min, b.mx as balanced_max from
 (select step, cast(min(s) as bigint) as mn, cast(max(s) as bigint) as mx, round(cast(sum(s) as double)/4,6) as mean from (select step, sl, sum(n_tokens) as s from (select step, n_tokens, floor((row_number() over(partition by step order by sample_id)-1)/floor(count(*) over(partition by step)/4)) as sl from rollout) group by 1,2) group by 1) a
 join (select step, cast(min(s) as bigint) as mn, cast(max(s) as bigint) as mx from (select step, shard, sum(n_tokens) as s from {SNAKE} group by 1,2) group by 1) b on a.step=b.step""",
        "rollout",
    ),
)
def shard_imbalance(spark, sf):
    rows = rollout(spark, sf).select("step", "sample_id", "n_tokens").withColumn("load", H.workload(F.col("n_tokens")))
    out = H.imbalance(H.snake(rows, "load", "sample_id", 4, ["step"]), "step", "sample_id", "n_tokens", 4)
    return out.withColumn("mean", F.round("mean", 6))


BALANCED = "select step, sample_id, n_tokens, cast(case when spot<8 then spot else 15-spot end as int) as shard from (select *, (row_number() over(partition by step order by 24576*n_tokens+n_tokens*n_tokens desc, sample_id)-1)%16 as spot from rollout)"


@query("balanced_shards", sql_with(BALANCED, "rollout"))
def balanced_shards(spark, sf):
    rows = rollout(spark, sf).select("step", "sample_id", "n_tokens")
    return H.balance(rows, "step", "sample_id", "n_tokens", 8)


@query(
    "balanced_shards_greedy",
    sql_with(f"select step, shard, cast(count(*) as bigint) as n, cast(sum(24576*n_tokens+n_tokens*n_tokens) as bigint) as load from ({BALANCED}) group by 1,2", "rollout"),
)
def balanced_shards_greedy(spark, sf):
    rows = rollout(spark, sf).select("step", "sample_id", "n_tokens")
    placed = H.balance(rows, "step", "sample_id", "n_tokens", 8)
    return placed.groupBy("step", "shard").agg(F.count(F.lit(1)).alias("n"), F.sum(H.workload(F.col("n_tokens"))).alias("load"))


@query(
    "balanced_groups",
    sql_with(
        """select step, sample_id, n_tokens, uid, cast(case when spot<4 then spot else 7-spot end as int) as shard from (select step, sample_id, n_tokens, sample_id%64 as uid from rollout)
 join (select *, (row_number() over(partition by step order by load desc, uid)-1)%8 as spot from (select step, sample_id%64 as uid, sum(24576*n_tokens+n_tokens*n_tokens) as load from rollout group by 1,2)) using (step, uid)""",
        "rollout",
    ),
)
def balanced_groups(spark, sf):
    # Shards need as many prompts each, so the prompts are numbered into a multiple of four per step.
    rows = rollout(spark, sf).select("step", "sample_id", "n_tokens").withColumn("uid", F.col("sample_id") % 64)
    return H.balance_groups(rows, "step", "uid", "n_tokens", 4)


# The laws of the result: every row placed, no micro-batch above the budget, numbers without gaps, and few of them.
@query(
    "token_budget_batches",
    sql_with(
        """select step, cast(count(*) as bigint) as rows, cast(sum(n_tokens) as bigint) as tokens, cast(0 as bigint) as above_budget, true as numbered, true as few,
 cast(sum(sample_id) as bigint) as ids from rollout group by 1""",
        "rollout",
    ),
)
def token_budget_batches(spark, sf):
    rows = rollout(spark, sf).select("step", "sample_id", "n_tokens")
    placed = H.microbatches(rows, "step", "sample_id", "n_tokens", 512)
    bins = placed.groupBy("step", "micro").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens"), F.sum("sample_id").alias("ids"))
    least = F.ceil(F.sum("tokens") / 512)
    return bins.groupBy("step").agg(
        F.sum("n").alias("rows"), F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") > 512).alias("above_budget"),
        ((F.min("micro") == 0) & (F.max("micro") == F.count(F.lit(1)) - 1)).alias("numbered"),
        (F.count(F.lit(1)) <= F.ceil(least * 1.3)).alias("few"), F.sum("ids").alias("ids"),
    )


@query("united_parts", "select n_name as name, n_regionkey as k from nation union all select r_name, r_regionkey from region union all select s_name, null from supplier")
def united_parts(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("k"))
    region = table(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("k"))
    return H.union_parts([nation, region, table(spark, sf, "supplier").select(F.col("s_name").alias("name"))])


@query("united_columns", "select o_orderkey, o_custkey, o_totalprice, o_orderstatus from orders")
def united_columns(spark, sf):
    left = orders(spark, sf).select("o_orderkey", "o_custkey", "o_totalprice")
    return H.union_columns(left, orders(spark, sf).select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")


@query("processed_ids_dropped", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag='R')")
def processed_ids_dropped(spark, sf):
    from trailmark.operators.joins import resume_filter

    done = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "R", "seen").alias("response"))
    return resume_filter(orders(spark, sf).select("o_orderkey"), done, "o_orderkey")


@query("bad_images_dropped", "select doc_id from documents where doc_id not in (select doc_id from labels where toxic=1)")
def bad_images_dropped(spark, sf):
    from trailmark.operators.joins import drop_bad

    bad = table(spark, sf, "labels").where("toxic = 1")
    return drop_bad(table(spark, sf, "documents").select("doc_id"), bad, "doc_id")


@query("restricted_images", "select doc_id from documents where doc_id in (select doc_id from labels)")
def restricted_images(spark, sf):
    from trailmark.operators.joins import restrict_to

    return restrict_to(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("curriculum_weights", sql_with("select id, round(case when km is null then 1.0 else 0.5*1.0+0.5*km/1000 end,6) as weight from geo_scored where run=0", "geo_scored"))
def curriculum_weights(spark, sf):
    runs = geo_scored(spark, sf).where("run = 0")
    results = runs.select("id", (F.col("km") / 1000).alias("result"))
    out = H.update_curriculum(runs.select("id", F.lit(1.0).alias("weight")), results, lambda w, r: w * 0.5 + r * 0.5, "id")
    return out.withColumn("weight", F.round("weight", 6))
