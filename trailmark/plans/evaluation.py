"""Queries on offline scores, validation metrics and step metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import advantages as G
from trailmark.operators import evaluation as V
from trailmark.plans.fixtures import rollout, sql_with, table, token
from trailmark.plans.registry import query


@query("offline_score", sql_with("select data_source, round(avg(s),6) as score from (select data_source, uid, avg(score) as s from rollout group by 1,2) group by 1", "rollout"))
def offline_score(spark, sf):
    return V.offline_score(rollout(spark, sf), row="uid").withColumn("score", F.round("score", 6))


LADDER = """with ranked as (select data_source, uid, score*0.7310585786 as value, count(*) over(partition by data_source, uid) as n, row_number() over(partition by data_source, uid order by score) as i from rollout),
 sized as (select *, unnest(case when n>1 then list_append([x for x in [2,4,8,16,32,64,128,256,512] if x<n], n) else [] end) as k from ranked),
 drawn as (select data_source, uid, k, sum(value*(pow(i/n,k)-pow((i-1)/n,k))) as bm, sum(value*value*(pow(i/n,k)-pow((i-1)/n,k))) as bq,
 sum(value*(pow((n-i+1)/n,k)-pow((n-i)/n,k))) as wm, sum(value*value*(pow((n-i+1)/n,k)-pow((n-i)/n,k))) as wq from (select data_source, uid, value, cast(n as double) as n, cast(i as double) as i, k from sized) group by 1,2,3)"""


def ladder_sql(body):
    return sql_with("", "rollout").rstrip() + ",\n" + LADDER[5:] + "\n" + body


def scores(spark, sf):
    # Scores have two decimals; with ten more, rounded results have no ties.
    return rollout(spark, sf).select("data_source", "uid", (F.col("score") * 0.7310585786).alias("score"), "pred", "sample_id")


@query(
    "exact_extremes",
    ladder_sql("select data_source, uid, k, round(bm,7) as best_mean, round(sqrt(greatest(bq-bm*bm,0)),7)+0.0 as best_std, round(wm,7) as worst_mean, round(sqrt(greatest(wq-wm*wm,0)),7)+0.0 as worst_std from drawn"),
)
def exact_extremes(spark, sf):
    out = V.extremes(V.value_ladder(V.melt(scores(spark, sf), ["score"], ["data_source", "uid"])))
    return out.select("data_source", "uid", "k", *[(F.round(c, 7) + 0.0).alias(c) for c in ("best_mean", "best_std", "worst_mean", "worst_std")])


def uniform_sql(*keys):
    return f"cast('0x'||substr(md5(concat_ws('|',{','.join(keys)})),1,13) as bigint)/power(16,13)"


@query(
    "bootstrap_extremes",
    sql_with("", "rollout").rstrip()
    + f""",
 ladder as (select *, sum(c) over(partition by data_source, uid order by value) as upto, sum(c) over(partition by data_source, uid) as n from (select data_source, uid, score*0.7310585786 as value, count(*) as c from rollout group by 1,2,3)),
 sized as (select data_source, uid, n, unnest(list_append([x for x in [2,4,8,16,32,64,128,256,512] if x<n], n)) as k from (select distinct data_source, uid, n from ladder where n>1)),
 ranked as (select data_source, uid, n, k, side, least(floor(n*power({uniform_sql("'42'||side", 'data_source', 'uid', "'score'", 'k', 'draw')}, 1.0/k))+1, n) as r from (
  select data_source, uid, n, k, draw, s.side from sized, (select unnest(range(1,1001)) as draw) d, (select unnest(['best','worst']) as side) s)),
 met as (select w.data_source, w.uid, k, side, value from (select * exclude(r), case when side='best' then r else n+1-r end as r from ranked) w join ladder l on l.data_source=w.data_source and l.uid=w.uid and r>upto-c and r<=upto)
select data_source, uid, 'score' as variable, cast(k as bigint) as k, side, round(avg(value),6) as mean, round(sqrt(greatest(avg(value*value)-avg(value)*avg(value),0)),5) as std from met group by 1,2,4,5""",
)
def bootstrap_extremes(spark, sf):
    drawn = V.bootstrap_extremes(V.value_ladder(V.melt(scores(spark, sf), ["score"], ["data_source", "uid"])))
    return drawn.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 5) + 0.0})


@query(
    "validation_metrics",
    ladder_sql(
        """select data_source, 'score' as variable, metric, round(avg(v),7)+0.0 as value from (
 select data_source, 'mean@'||count(*) as metric, avg(score*0.7310585786) as v from rollout group by data_source, uid
 union all select data_source, 'std@'||count(*), stddev_pop(score*0.7310585786) from rollout group by data_source, uid having count(*)>1
 union all select data_source, 'best@'||k||'/mean', bm from drawn union all select data_source, 'best@'||k||'/std', sqrt(greatest(bq-bm*bm,0)) from drawn
 union all select data_source, 'worst@'||k||'/mean', wm from drawn union all select data_source, 'worst@'||k||'/std', sqrt(greatest(wq-wm*wm,0)) from drawn) group by 1,2,3"""
    ),
)
def validation_metrics(spark, sf):
    out = V.validation_metrics(scores(spark, sf), ["score"])
    return out.withColumn("value", F.round("value", 7) + 0.0)


def level_sql(level):
    """One level of the tree of predictions; there are at most eight predictions, and few draws."""
    u = uniform_sql("'42'", "data_source", "uid", "'score'", "k", "draw", f"'{level}'", "j", "'0'")
    mass = "cast(factorial(cast(x as int)) as double)/(factorial(cast(m as int))*factorial(cast(x-m as int)))*power(p,m)*power(1-p,x-m)"
    return f"""node{level} as (select data_source, uid, (r-1)&{(1 << level) - 1} as j, sum(c) as total, sum(case when ((r-1)>>{level})&1=0 then c else 0 end) as hits from vote group by all),
 chance{level} as (select *, least(hits,total-hits)/cast(total as double) as p, {u} as u from draw{level} join node{level} using (data_source, uid, j)),
 count{level} as (select *, len(list_filter(range(x), lambda i: list_sum(list_transform(range(i+1), lambda m: {mass}))<=u)) as y from chance{level}),
 split{level} as (select data_source, uid, k, draw, j, x, case when hits=0 then 0 when hits=total then x when 2*hits>total then x-y else y end as y from count{level}),
 draw{level + 1} as (select data_source, uid, k, draw, j, y as x from split{level} where y>0 union all select data_source, uid, k, draw, j+{1 << level}, x-y from split{level} where x>y)"""


@query(
    "validation_with_majority",
    ladder_sql("").rstrip()
    + f""",
 vote as (select *, row_number() over(partition by data_source, uid order by floor(log2(c)) desc, md5(cast(pred as varchar)), pred) as r from (
  select data_source, uid, pred, count(*) as c, avg(score*0.7310585786) as m, avg(score*0.7310585786*score*0.7310585786) as q from rollout group by 1,2,3)),
 draw0 as (select data_source, uid, k, unnest(range(1,1001)) as draw, cast(0 as bigint) as j, cast(k as bigint) as x from (select data_source, uid, unnest(list_append([x for x in [2,4,8,16,32,64,128,256,512] if x<n], n)) as k
  from (select data_source, uid, count(*) as n from rollout group by 1,2) where n>1)),
 {level_sql(0)},
 {level_sql(1)},
 {level_sql(2)},
 tied as (select data_source, uid, k, draw, x, avg(m) as m, avg(q) as q from draw3 d join (select data_source, uid, r-1 as j, m, q from vote) using (data_source, uid, j) group by 1,2,3,4,5),
 won as (select data_source, uid, k, draw, arg_max(m,x) as m, arg_max(q,x) as q from tied group by 1,2,3,4),
 maj as (select data_source, uid, k, avg(m) as mm, sqrt(greatest(avg(q)-avg(m)*avg(m),0)) as ms from won group by 1,2,3)
select data_source, 'score' as variable, metric, round(avg(v),5)+0.0 as value from (
 select data_source, 'mean@'||count(*) as metric, avg(score*0.7310585786) as v from rollout group by data_source, uid
 union all select data_source, 'std@'||count(*), stddev_pop(score*0.7310585786) from rollout group by data_source, uid having count(*)>1
 union all select data_source, 'best@'||k||'/mean', bm from drawn union all select data_source, 'best@'||k||'/std', sqrt(greatest(bq-bm*bm,0)) from drawn
 union all select data_source, 'worst@'||k||'/mean', wm from drawn union all select data_source, 'worst@'||k||'/std', sqrt(greatest(wq-wm*wm,0)) from drawn
 union all select data_source, 'maj@'||k||'/mean', mm from maj union all select data_source, 'maj@'||k||'/std', ms from maj) group by 1,2,3""",
)
def validation_with_majority(spark, sf):
    out = V.validation_metrics(scores(spark, sf), ["score"], pred="pred")
    return out.withColumn("value", F.round("value", 5) + 0.0)


@query(
    "majority_value",
    sql_with(
        """select uid, pred, value, n from (select *, row_number() over(partition by uid order by n desc, first) as r from (
 select uid, pred, count(*) as n, min(sample_id) as first, arg_min(score, sample_id) as value from rollout group by 1,2)) where r=1""",
        "rollout",
    ),
)
def majority_value(spark, sf):
    return V.majority_value(rollout(spark, sf), ["uid"], "pred", "score", "sample_id")


def validation_rows(spark, sf):
    # As for ``scores``: more decimals, so that rounded results have no ties.
    rows = rollout(spark, sf).select("data_source", "uid", (F.col("score") * 0.7310585786).alias("acc"), "sample_id", "n_tokens")
    return rows.withColumn("acc_25km", F.when(F.col("n_tokens") > 20, 0.7310585786).otherwise(0.0))


MERGED = """with long as (select data_source, uid, 'acc' as variable, score*0.7310585786 as x from rollout union all select data_source, uid, 'acc', score*0.7310585786/2 from rollout
 union all select data_source, uid, 'acc_25km', case when n_tokens>20 then 0.7310585786 else 0.0 end from rollout),
 held as (select *, count(*) over(partition by data_source, uid, variable) as n, row_number() over(partition by data_source, uid, variable order by x) as i from long where x is not null),
 steps as (select data_source, uid, variable, x, cast(n as double) as n, cast(i as double) as i, unnest(case when n>1 then list_append([q for q in [2,4,8,16,32,64,128,256,512] if q<n], n) else [] end) as k from held),
 ends as (select data_source, uid, variable, k, sum(x*(pow(i/n,k)-pow((i-1)/n,k))) as bm, sum(x*x*(pow(i/n,k)-pow((i-1)/n,k))) as bq,
 sum(x*(pow((n-i+1)/n,k)-pow((n-i)/n,k))) as wm, sum(x*x*(pow((n-i+1)/n,k)-pow((n-i)/n,k))) as wq from steps group by 1,2,3,4),
 merged as (select data_source, variable, metric, round(avg(v),7)+0.0 as v from (
 select data_source, variable, 'mean@'||count(x) as metric, avg(x) as v from long group by data_source, uid, variable having count(x)>0
 union all select data_source, variable, 'std@'||count(x), stddev_pop(x) from long group by data_source, uid, variable having count(x)>1
 union all select data_source, variable, 'best@'||k||'/mean', bm from ends union all select data_source, variable, 'best@'||k||'/std', sqrt(greatest(bq-bm*bm,0)) from ends
 union all select data_source, variable, 'worst@'||k||'/mean', wm from ends union all select data_source, variable, 'worst@'||k||'/std', sqrt(greatest(wq-wm*wm,0)) from ends) group by 1,2,3)
"""


def merged_sql(body):
    return sql_with("", "rollout").rstrip() + ",\n" + MERGED[5:] + body


@query("merged_validation", merged_sql("select data_source, variable, metric, v as value from merged"))
def merged_validation(spark, sf):
    # The second run has no kilometre accuracy.
    second = validation_rows(spark, sf).drop("acc_25km").withColumn("acc", F.col("acc") / 2)
    out = V.merge_validation(validation_rows(spark, sf), second, ["acc", "acc_25km"])
    return out.withColumn("value", F.round("value", 7) + 0.0)


@query(
    "routed_metrics",
    merged_sql(
        """select case when contains(metric,'@'||mx) and (variable='acc' and (starts_with(metric,'mean') or starts_with(metric,'best')) or variable='acc_25km' and starts_with(metric,'mean')) then 'val-core' else 'val-aux' end||'/'||data_source||'/'||variable||'/'||metric as name, v as value
 from (select *, max(cast(regexp_extract(metric,'@(\\d+)',1) as int)) over(partition by data_source, variable) as mx from merged)"""
    ),
)
def routed_metrics(spark, sf):
    out = V.route_metrics(merged_validation(spark, sf))
    return out.withColumn("value", F.round("value", 7) + 0.0)


def sequences(spark, sf):
    """Sequence rows; a response of a multiple of 37 tokens counts as aborted."""
    rows = rollout(spark, sf)
    return rows.select(
        "sample_id", "score", (F.col("score") * 0.5).alias("reward"), F.when(F.col("n_tokens") == 37, 0).otherwise(F.col("n_tokens")).alias("response_length"),
        (10 + F.col("sample_id") % 91).cast("int").alias("prompt_length"), "step",
    )


SEQ = "(select sample_id, score, score*0.5 as reward, case when n_tokens=37 then 0 else n_tokens end as l, cast(10+sample_id%91 as int) as p, step from rollout)"


def three_sql(name, value, source):
    return [f"select '{name}/{w}' as metric, {f}({value}) as value from {source}" for w, f in (("mean", "avg"), ("max", "max"), ("min", "min"))]


TOK = "(select *, sum(reward*mask) over(partition by sample_id order by t rows between current row and unbounded following) as returns from token)"


@query(
    "batch_metrics",
    sql_with(
        "select metric, round(cast(value as double),5)+0.0 as value from ("
        + " union all ".join(
            three_sql("critic/score", "case when l>0 then score end", SEQ)
            + three_sql("critic/rewards", "case when l>0 then reward end", SEQ)
            + three_sql("response_length", "l", SEQ)
            + three_sql("response_length_non_aborted", "case when l>0 then l end", SEQ)
            + three_sql("prompt_length", "p", SEQ)
            + [
                f"select 'response_length/clip_ratio', avg(case when l=36 then 1.0 else 0.0 end) from {SEQ}",
                f"select 'response_length_non_aborted/clip_ratio', avg(case when l=36 then 1.0 else 0.0 end) from {SEQ} where l>0",
                f"select 'response/aborted_ratio', avg(case when l=0 then 1.0 else 0.0 end) from {SEQ}",
                f"select 'prompt_length/clip_ratio', avg(case when p=100 then 1.0 else 0.0 end) from {SEQ}",
            ]
            + three_sql("critic/advantages", "returns-0.5", f"{TOK} where mask<>0")
            + three_sql("critic/returns", "returns", f"{TOK} where mask<>0")
            + three_sql("critic/values", "value_est", f"{TOK} where mask<>0")
            + [f"select 'critic/vf_explained_var', 1.0-var_samp(returns-value_est)/(var_samp(returns)+1e-5) from {TOK} where mask<>0"]
        )
        + ")",
        "rollout", "token",
    ),
)
def batch_metrics(spark, sf):
    tok = G.remax(token(spark, sf).withColumn("baseline", F.lit(0.5)), "baseline")
    out = V.batch_metrics(sequences(spark, sf), tok, max_response=36, max_prompt=100)
    return out.withColumn("value", F.round("value", 5) + 0.0)


def step_tokens(spark, sf):
    return sequences(spark, sf).groupBy("step").agg(F.sum("prompt_length").alias("prompt_tokens"), F.sum("response_length").alias("response_tokens"))


@query(
    "timing_per_token",
    sql_with(
        f"""select step, stage, cast(n as double)/100 as timing_s, round(cast(n as double)/100*1000/case when stage='gen' then r when stage in ('ref','adv','values') then p+r end,6) as timing_per_token_ms from (select *, coalesce(known, data_source) as stage from (
 select step, data_source, count(*) as n from rollout group by 1,2) join (select step, sum(p) as p, sum(l) as r from {SEQ} group by 1) using (step)
 left join (select 'click' as data_source, 'gen' as known union all select 'view','ref' union all select 'purchase','adv' union all select 'error','step' union all select 'signup','values') using (data_source))""",
        "rollout",
    ),
)
def timing_per_token(spark, sf):
    stages = {"click": "gen", "view": "ref", "purchase": "adv", "error": "step", "signup": "values"}
    stage = F.create_map(*[F.lit(x) for pair in stages.items() for x in pair])
    timings = (
        rollout(spark, sf).groupBy("step", "data_source").agg((F.count(F.lit(1)).cast("double") / 100).alias("seconds"))
        .withColumn("stage", F.coalesce(F.try_element_at(stage, F.col("data_source")), "data_source")).drop("data_source")
    )
    out = V.timing_metrics(timings, step_tokens(spark, sf))
    return out.withColumn("timing_per_token_ms", F.round("timing_per_token_ms", 6))


@query(
    "step_throughput",
    sql_with(f"select step, cast(t as bigint) as tokens, s as seconds, round(t/(s*8),6) as throughput from (select step, sum(p+l) as t, cast(count(*) as double)/10 as s from {SEQ} group by 1)", "rollout"),
)
def step_throughput(spark, sf):
    steps = sequences(spark, sf).groupBy("step").agg(
        F.sum(F.col("prompt_length") + F.col("response_length")).alias("tokens"), (F.count(F.lit(1)).cast("double") / 10).alias("seconds")
    )
    return V.throughput(steps, 8).withColumn("throughput", F.round("throughput", 6))


@query(
    "reduced_metrics",
    sql_with(
        """select metric, kind, round(case kind when 'sum' then sum(a) when 'mean' then avg(a) when 'min' then min(lo) else max(hi) end,5) as value from (
 select data_source as metric, k.kind, floor(sample_id/4) as place, avg(score) as a, min(score) as lo, max(score) as hi from (select *, 'all' as d from rollout) r, (select unnest(['sum','mean','min','max']) as kind) k group by 1,2,3) group by 1,2""".replace("data_source as metric", "'score' as metric"),
        "rollout",
    ),
)
def reduced_metrics(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ("sum", "mean", "min", "max")])
    rows = rollout(spark, sf).select(
        F.lit("score").alias("metric"), F.explode(kinds).alias("kind"), (F.col("sample_id") % 4).alias("replica"),
        F.floor(F.col("sample_id") / 4).alias("place"), F.col("score").alias("value"),
    )
    return V.reduce_metrics(rows).withColumn("value", F.round("value", 5))


NAMES = {
    "perf/throughput": ("avg(score)", "avg"), "perf/total_num_tokens": ("sum(n_tokens)", "sum"), "perf/time_per_step": ("count(*)/10.0", "sum"),
    "timing_s/gen": ("count(*)/20.0", "sum"), "timing_s/step": ("count(*)/12.0", "sum"), "global_seqlen/max": ("max(n_tokens)", "max"),
    "global_seqlen/min": ("min(n_tokens)", "min"), "global_seqlen/minmax_diff": ("avg(n_tokens)", "min"), "critic/score/mean": ("avg(score)", "avg"),
    "training/global_step": ("max(step)", "last"), "actor/entropy": ("avg(score*2)", "avg"), "reward/total": ("sum(score)", "sum"),
    "timing_s/agent_loop/tool_calls/min": ("min(score)", "min"), "fully_async/count/current_param_version": ("max(step)*2", "last"),
}


def step_metrics(spark, sf):
    """Metrics per step in long form."""
    values = {
        "perf/throughput": F.avg("score"), "perf/total_num_tokens": F.sum("n_tokens"), "perf/time_per_step": F.count(F.lit(1)) / 10,
        "timing_s/gen": F.count(F.lit(1)) / 20, "timing_s/step": F.count(F.lit(1)) / 12, "global_seqlen/max": F.max("n_tokens"),
        "global_seqlen/min": F.min("n_tokens"), "global_seqlen/minmax_diff": F.avg("n_tokens"), "critic/score/mean": F.avg("score"),
        "training/global_step": F.max("step"), "actor/entropy": F.avg(F.col("score") * 2), "reward/total": F.sum("score"),
        "timing_s/agent_loop/tool_calls/min": F.min("score"), "fully_async/count/current_param_version": F.max("step") * 2,
    }
    wide = rollout(spark, sf).groupBy("step").agg(*[v.cast("double").alias(f"m{i}") for i, v in enumerate(values.values())])
    lines = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"m{i}").alias("value")) for i, n in enumerate(values)])
    return wide.select("step", F.inline(lines))


STEP_SQL = "(" + " union all ".join(f"select step, '{n}' as metric, cast({e} as double) as value from rollout group by 1" for n, (e, _) in NAMES.items()) + ")"
KIND_SQL = "case metric " + " ".join(f"when '{n}' then '{k}'" for n, (_, k) in NAMES.items()) + " end"
AGG_SQL = f"""(select metric, case {KIND_SQL.replace('case metric', 'case metric')} when 'sum' then sum(value) when 'avg' then avg(value) when 'max' then max(value) when 'min' then min(value) else arg_max(value, step) end as value from {STEP_SQL} group by 1)"""


@query(
    "aggregated_steps",
    sql_with(
        f"""select metric, round(case metric when 'perf/throughput' then (select a.value/(b.value*8) from agg a, agg b where a.metric='perf/total_num_tokens' and b.metric='perf/time_per_step')
 when 'global_seqlen/minmax_diff' then (select a.value-b.value from agg a, agg b where a.metric='global_seqlen/max' and b.metric='global_seqlen/min') else value end,7) as value from agg
 union all select 'trainer/idle_ratio', round((select a.value/b.value from agg a, agg b where a.metric='timing_s/gen' and b.metric='timing_s/step'),7)""",
        "rollout",
    ).replace("\nselect metric, round(case", f",\n agg as {AGG_SQL[:-1]})\nselect metric, round(case", 1),
)
def aggregated_steps(spark, sf):
    out = V.aggregate_steps(step_metrics(spark, sf), devices=8)
    return out.withColumn("value", F.round("value", 7))


@query(
    "rollout_status",
    """select round(avg(value),6) as time_avg, max(value) as time_max, min(value) as time_min, count(*) filter (where k%5<>0) as total_partial_num, round(avg(case when k%5<>0 then 1.0 else 0.0 end),6) as partial_ratio,
 max(k%5) as max_partial_span, count(distinct user_id%17) as param_version_diversity, round(quantile_cont(value,0.5),6) as time_tp50, round(quantile_cont(value,0.95),6) as time_tp95, round(quantile_cont(value,0.99),6) as time_tp99
 from (select *, cast(json_extract(props,'$.k') as bigint) as k from events)""",
)
def rollout_status(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = table(spark, sf, "events").select(
        F.col("value").alias("processing_time"), (F.col("user_id") % 17).alias("param_version"), k.alias("param_version_start"), (k + k % 5).alias("param_version_end")
    )
    out = V.rollout_status(rows)
    rounded = {c: F.round(c, 6) for c in ("time_avg", "partial_ratio", "time_tp50", "time_tp95", "time_tp99")}
    return out.withColumns(rounded)


@query("flat_metrics", sql_with(f"select step, metric, round(value,5) as value from {STEP_SQL}", "rollout"))
def flat_metrics(spark, sf):
    return step_metrics(spark, sf).withColumn("value", F.round("value", 5))
