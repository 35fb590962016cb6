"""Queries on search caches and tool calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions import constants as K
from trailmark.operators import extraction as E
from trailmark.operators import search as S
from trailmark.plans.conversation import labeled
from trailmark.plans.fixtures import add_view, message, sql_with, table
from trailmark.plans.registry import query


def image_calls(spark, sf):
    """Image searches of an episode; every tenth conversation sends a box of three numbers."""
    calls = E.tool_calls(message(spark, sf)).where(F.col("name") == K.IMAGE_SEARCH)
    box = F.try_variant_get(F.try_parse_json("arguments"), "$.bbox_2d", "array<double>")
    shift = ((F.col("conv_id") * 29 + F.col("msg_idx") * 31) % 300).cast("double")
    moved = F.array(box[0] + shift, box[1], box[2], box[3])
    return calls.select(
        "conv_id", "msg_idx", F.when(F.col("conv_id") % 10 == 0, F.slice(moved, 1, 3)).otherwise(moved).alias("bbox")
    )


add_view(
    "image_query",
    """select conv_id, msg_idx, case when conv_id%10=0 then null else [bbox[1]+(conv_id*29+msg_idx*31)%300, bbox[2], bbox[3], bbox[4]] end as bbox
 from named_call where name='image_search_tool'""",
    "named_call",
)
add_view(
    "cursor_pair",
    """select q.conv_id, q.msg_idx, q.bbox is not null as valid, q.cursor, p.call_idx, q.bbox, p.bbox as cached from (
 select *, case when bbox is not null then sum(case when bbox is not null then 1 else 0 end) over(partition by conv_id order by msg_idx)-1 end as cursor from image_query) q
 left join (select conv_id, count(*) as n from image_pair group by 1) s on s.conv_id=q.conv_id
 left join image_pair p on p.conv_id=q.conv_id and p.call_idx=q.cursor%s.n""",
    "image_query", "image_pair",
)
add_view(
    "image_reward",
    """select *, coalesce(iou>=0.5,false) as cache_hit, case when not valid then -0.05 when iou>=0.5 then iou*0.2 else 0.0 end as reward from (
 select *, case when bbox is null or cached is null then null when inter>0 then inter/(a+b-inter) else 0.0 end as iou from (select *,
 greatest(0,least(bbox[3],cached[3])-greatest(bbox[1],cached[1]))*greatest(0,least(bbox[4],cached[4])-greatest(bbox[2],cached[2])) as inter,
 (bbox[3]-bbox[1])*(bbox[4]-bbox[2]) as a, (cached[3]-cached[1])*(cached[4]-cached[2]) as b from cursor_pair))""",
    "cursor_pair",
)


def rewarded_calls(spark, sf):
    pairs = E.pair_calls(message(spark, sf), K.IMAGE_SEARCH).select("conv_id", "call_idx", "bbox")
    joined = S.cursor_join(image_calls(spark, sf), pairs, "conv_id", "conv_id", "msg_idx", S.G.box_valid(F.col("bbox")))
    return S.search_reward(joined)


@query("cursor_join", sql_with("select conv_id, msg_idx, valid, cast(cursor as bigint) as cursor, call_idx from cursor_pair", "cursor_pair"))
def cursor_join(spark, sf):
    return rewarded_calls(spark, sf).select("conv_id", "msg_idx", "valid", "cursor", "call_idx")


@query("box_overlap_join", sql_with("select conv_id, msg_idx, call_idx, round(iou,6) as iou from image_reward where cache_hit", "image_reward"))
def box_overlap_join(spark, sf):
    pairs = E.pair_calls(message(spark, sf), K.IMAGE_SEARCH).select("conv_id", "call_idx", "bbox")
    hits = S.iou_join(image_calls(spark, sf), pairs, "conv_id", "conv_id", "msg_idx")
    return hits.select("conv_id", "msg_idx", "call_idx", F.round("iou", 6).alias("iou"))


@query("search_reward", sql_with("select conv_id, msg_idx, round(iou,6) as iou, cache_hit, round(cast(reward as double),6) as reward from image_reward", "image_reward"))
def search_reward(spark, sf):
    return rewarded_calls(spark, sf).select("conv_id", "msg_idx", F.round("iou", 6).alias("iou"), "cache_hit", F.round("reward", 6).alias("reward"))


def text_asked(spark, sf):
    calls = E.tool_calls(message(spark, sf)).where(F.col("name") == K.TEXT_SEARCH)
    asked = F.concat(F.lit("Landmark "), (F.col("conv_id") % 9).cast("string"), F.lit("  city "), ((F.col("msg_idx") + 1) % 4).cast("string"))
    return calls.select("conv_id", "msg_idx", asked.alias("query"))


def text_cached(spark, sf):
    pairs = E.pair_calls(message(spark, sf), K.TEXT_SEARCH)
    return pairs.select("conv_id", "call_idx", F.array_join("queries", " | ").alias("query"))


add_view(
    "text_asked",
    """select conv_id, msg_idx, 'Landmark '||(conv_id%9)||'  city '||((msg_idx+1)%4) as query, ['landmark', cast(conv_id%9 as string), 'city', cast((msg_idx+1)%4 as string)] as words
 from named_call where name='text_search_tool'""",
    "named_call",
)
add_view(
    "text_scored",
    """select q.conv_id, q.msg_idx, q.query, p.call_idx, case when p.call_idx is not null then 1.0 end*cast(len(list_intersect(list_distinct(q.words), list_distinct(string_split(lower(p.query),' ')))) as double)
 /len(list_distinct(list_concat(q.words, string_split(lower(p.query),' ')))) as score from text_asked q left join text_pair p on p.conv_id=q.conv_id""",
    "text_asked", "text_pair",
)


@query(
    "jaccard_best_match",
    sql_with(
        """select conv_id, msg_idx, query, call_idx, round(score,6) as score from (select *, row_number() over(partition by conv_id, msg_idx order by score desc, call_idx) as rn from text_scored) where rn=1""",
        "text_scored",
    ),
)
def jaccard_best_match(spark, sf):
    out = S.jaccard_best(text_asked(spark, sf), text_cached(spark, sf), "conv_id")
    return out.select("conv_id", "msg_idx", "query", "call_idx", F.round("score", 6).alias("score"))


@query(
    "jaccard_with_memory",
    "with recursive "
    + sql_with(
        """select conv_id, msg_idx, call_idx, round(score,6) as score from walk where k>0""",
        "text_scored",
    )[5:].replace(
        "\nselect conv_id, msg_idx, call_idx, round(score,6) as score from walk",
        """,
 ordered as (select *, dense_rank() over(partition by conv_id order by msg_idx) as k from text_scored),
 walk as (select conv_id, cast(0 as bigint) as k, cast(-1 as bigint) as msg_idx, cast(-1 as int) as call_idx, cast(0 as double) as score, cast([] as int[]) as used from text_scored group by 1
 union all select conv_id, k, msg_idx, call_idx, adj, list_append(used, call_idx) from (
 select o.conv_id, o.k, o.msg_idx, o.call_idx, w.used, o.score-case when list_contains(w.used,o.call_idx) then 0.5 else 0 end as adj,
 row_number() over(partition by o.conv_id order by o.score-case when list_contains(w.used,o.call_idx) then 0.5 else 0 end desc, o.call_idx) as rn
 from walk w join ordered o on o.conv_id=w.conv_id and o.k=w.k+1) where rn=1)
select conv_id, msg_idx, call_idx, round(score,6) as score from walk""",
    ),
)
def jaccard_with_memory(spark, sf):
    asked = text_asked(spark, sf).withColumn("episode", F.col("conv_id"))
    out = S.jaccard_best_with_memory(asked, text_cached(spark, sf), "conv_id", "episode", "msg_idx")
    return out.select("conv_id", "msg_idx", "call_idx", F.round("score", 6).alias("score"))


@query(
    "jaccard_of_documents",
    """select doc_id, round(case when len(a)=0 and len(b)=0 then 1.0 when len(a)=0 or len(b)=0 then 0.0 else cast(len(list_intersect(a,b)) as double)/len(list_distinct(list_concat(a,b))) end,6) as overlap
 from (select doc_id, list_distinct([x for x in regexp_split_to_array(lower(text),'\\s+') if x<>'']) as a, list_distinct([x for x in regexp_split_to_array(lower(lang||' '||source||' the of la'),'\\s+') if x<>'']) as b from documents)""",
)
def jaccard_of_documents(spark, sf):
    a = S.token_set(F.col("text"))
    b = S.token_set(F.concat("lang", F.lit(" "), "source", F.lit(" the of la")))
    return table(spark, sf, "documents").select("doc_id", F.round(S.jaccard(a, b), 6).alias("overlap"))


@query(
    "prefer_useful_results",
    sql_with(
        """select conv_id, call_idx, result_pos, is_geo_useful, copy from (select *, row_number() over(partition by conv_id, call_idx, result_pos order by is_geo_useful desc, copy) as rn from (
 select conv_id, call_idx, result_pos, is_geo_useful and result_pos%2=c.copy as is_geo_useful, c.copy from image_labeled, (select 0 as copy union all select 1) c)) where rn=1""",
        "image_labeled",
    ),
)
def prefer_useful_results(spark, sf):
    copies = labeled(spark, sf, K.IMAGE_SEARCH).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    copies = copies.withColumn("is_geo_useful", F.col("is_geo_useful") & (F.col("result_pos") % 2 == F.col("copy")))
    out = S.dedupe_prefer_useful(copies, ["conv_id", "call_idx", "result_pos"], ties=["copy"])
    return out.select("conv_id", "call_idx", "result_pos", "is_geo_useful", "copy")


@query(
    "nested_cache",
    sql_with(
        """select conv_id, call_idx, cast(count(*) filter (where is_geo_useful) as int) as n_pos, cast(count(*) filter (where not is_geo_useful) as int) as n_neg,
 string_agg(result_title, '|' order by is_geo_useful desc, result_pos) as titles from image_labeled group by 1,2""",
        "image_labeled",
    ),
)
def nested_cache(spark, sf):
    nested = S.nest_cache(labeled(spark, sf, K.IMAGE_SEARCH), "conv_id", ["result_title", "result_link", "result_source"])
    return nested.select(
        "conv_id", "call_idx", F.size("pos_results").alias("n_pos"), F.size("neg_results").alias("n_neg"),
        F.array_join(F.transform("all_results", lambda r: r.result_title), "|").alias("titles"),
    )


MIX = """select conv_id, call_idx, result_pos, is_geo_useful, cast(row_number() over(partition by conv_id, call_idx order by md5('7b|'||conv_id||'|'||call_idx||'|'||result_pos), result_pos) as int) as shown_pos
 from (select *, row_number() over(partition by conv_id, call_idx, is_geo_useful order by md5('7a|'||conv_id||'|'||call_idx||'|'||result_pos), result_pos) as rk,
 least(sum(case when is_geo_useful then 1 else 0 end) over(partition by conv_id, call_idx), 1, 2) as np from {v})
 where case when is_geo_useful then rk<=np else rk<=2-np end"""
add_view("image_mixed", MIX.format(v="image_labeled"), "image_labeled")


@query("mixed_result_page", sql_with("select * from image_mixed", "image_mixed"))
def mixed_result_page(spark, sf):
    out = S.negmix(labeled(spark, sf, K.IMAGE_SEARCH), "conv_id", n_pos=1, max_results=2, seed=7)
    return out.select("conv_id", "call_idx", "result_pos", "is_geo_useful", "shown_pos")


@query(
    "plain_text_page",
    sql_with(
        """select conv_id, call_idx, result_pos, cast(row_number() over(partition by conv_id, call_idx order by result_pos) as int) as shown_pos,
 round(cast(0.1+0.05*count(*) over(partition by conv_id, call_idx) as double),6) as reward from text_labeled where is_geo_useful""",
        "text_labeled",
    ),
)
def plain_text_page(spark, sf):
    out = S.plain_page(labeled(spark, sf, K.TEXT_SEARCH), "conv_id", K.TEXT_SEARCH, 10, 0.1, 0.05)
    return out.select("conv_id", "call_idx", "result_pos", "shown_pos", F.round("reward", 6).alias("reward"))


@query(
    "plain_image_page",
    sql_with(
        """select conv_id, call_idx, result_pos, cast(row_number() over(partition by conv_id, call_idx order by is_geo_useful desc, result_pos) as int) as shown_pos, cast(0.1 as double) as reward from image_labeled""",
        "image_labeled",
    ),
)
def plain_image_page(spark, sf):
    out = S.plain_page(labeled(spark, sf, K.IMAGE_SEARCH), "conv_id", K.IMAGE_SEARCH, 10, 0.1, 0.05)
    return out.select("conv_id", "call_idx", "result_pos", "shown_pos", "reward")


def judged_calls(spark, sf):
    """Shown useful positions of each image call beside the indices the model marked next."""
    shown = S.negmix(labeled(spark, sf, K.IMAGE_SEARCH), "conv_id", n_pos=1, max_results=2, seed=7)
    truth = shown.groupBy("conv_id", "call_idx", "call_msg_idx").agg(
        F.array_sort(F.collect_set(F.when(F.col("is_geo_useful"), F.col("shown_pos")))).alias("truth"),
        F.count(F.lit(1)).cast("int").alias("n"),
    )
    marked = E.useful_tags(message(spark, sf)).where(F.col("tool") == K.IMAGE_SEARCH)
    return truth.join(marked.select("conv_id", "call_msg_idx", F.col("indices").alias("pred")), ["conv_id", "call_msg_idx"])


add_view(
    "judged",
    """select t.conv_id, t.call_idx, t.n, t.truth, cast(u.indices as int[]) as pred from (
 select m.conv_id, m.call_idx, p.call_msg_idx, cast(count(*) as int) as n, coalesce(list(m.shown_pos) filter (where m.is_geo_useful),[]) as truth from image_mixed m
 join image_pair p on p.conv_id=m.conv_id and p.call_idx=m.call_idx group by 1,2,3) t
 join useful_tag u on u.conv_id=t.conv_id and u.call_msg_idx=t.call_msg_idx and u.tool='image_search_tool'""",
    "image_mixed", "useful_tag",
)
add_view(
    "confused",
    """select *, cast(len(list_intersect(pred,truth)) as int) as tp, cast(len([x for x in pred if not list_contains(truth,x)]) as int) as fp,
 cast(len([x for x in truth if not list_contains(pred,x)]) as int) as fn, cast(len([x for x in range(1,n+1) if not list_contains(pred,x) and not list_contains(truth,x)]) as int) as tn from judged""",
    "judged",
)
MCC = """case when len(pred)=0 and len(truth)=0 then 1.0 when (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)=0 then 0.0
 else (tp*tn-fp*fn)/sqrt(cast((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn) as double)) end"""


@query("index_confusion", sql_with("select conv_id, call_idx, tp, fp, fn, tn from confused", "confused"))
def index_confusion(spark, sf):
    counts = S.confusion(F.col("pred"), F.col("truth"), F.col("n"))
    return judged_calls(spark, sf).select("conv_id", "call_idx", *[v.alias(k) for k, v in counts.items()])


@query("discrimination_score", sql_with(f"select conv_id, call_idx, round(cast({MCC} as double),6) as mcc, round(cast({MCC} as double)*0.3,6) as reward from confused", "confused"))
def discrimination_score(spark, sf):
    score = S.mcc(F.col("pred"), F.col("truth"), F.col("n"))
    return judged_calls(spark, sf).select(
        "conv_id", "call_idx", F.round(score, 6).alias("mcc"), F.round(score * K.MCC_COEFF, 6).alias("reward")
    )


@query(
    "excluded_domains",
    sql_with(
        "select conv_id, call_idx, result_pos from image_result where not contains(lower(case when result_source='' then result_link else result_source end),'flickr.com')",
        "image_result",
    ),
)
def excluded_domains(spark, sf):
    results = E.parse_results(E.pair_calls(message(spark, sf), K.IMAGE_SEARCH), K.IMAGE_SEARCH)
    kept = S.exclude_domains(results, ["Flickr.com"], F.col("result_source"), F.col("result_link"))
    return kept.select("conv_id", "call_idx", "result_pos")


@query("excluded_page_domains", "select page_id from pages where not (contains(lower(url),'example.net') or contains(lower(url),'/fr/'))")
def excluded_page_domains(spark, sf):
    return S.exclude_domains(table(spark, sf, "pages"), ["example.net", "/FR/"], F.lit(""), F.col("url")).select("page_id")


@query(
    "call_budget",
    sql_with(
        """select conv_id, msg_idx, name, used, used<=case name when 'image_search_tool' then 1 else 2 end as allowed from (
 select *, cast(row_number() over(partition by conv_id, name order by msg_idx, call_no) as int) as used from named_call)""",
        "named_call",
    ),
)
def call_budget(spark, sf):
    limits = {K.IMAGE_SEARCH: 1, K.TEXT_SEARCH: 2}
    out = S.call_budget(E.tool_calls(message(spark, sf)), "conv_id", ["msg_idx", "call_no"], limits)
    return out.select("conv_id", "msg_idx", "name", "used", "allowed")


def call_metas(spark, sf):
    """Reward records of image searches, text searches and the judgements that follow image searches."""
    none = F.lit(None)
    image = rewarded_calls(spark, sf).select(
        "conv_id", F.lit(K.IMAGE_SEARCH).alias("tool_name"), "reward", "iou", "cache_hit", none.cast("double").alias("mcc_score"), F.lit(1).alias("n_pos")
    )
    best = S.jaccard_best(text_asked(spark, sf), text_cached(spark, sf), "conv_id")
    text = best.select(
        "conv_id", F.lit(K.TEXT_SEARCH).alias("tool_name"), F.lit(0.1).alias("reward"), none.cast("double").alias("iou"),
        F.coalesce(F.col("score") > 0.5, F.lit(False)).alias("cache_hit"), none.cast("double").alias("mcc_score"), F.lit(2).alias("n_pos"),
    )
    score = S.mcc(F.col("pred"), F.col("truth"), F.col("n"))
    judged = judged_calls(spark, sf).select(
        "conv_id", F.lit("f1_image_search_tool").alias("tool_name"), (score * K.MCC_COEFF).alias("reward"), none.cast("double").alias("iou"),
        none.cast("boolean").alias("cache_hit"), score.alias("mcc_score"), F.lit(0).alias("n_pos"),
    )
    return image.unionByName(text).unionByName(judged)


add_view(
    "call_meta",
    f"""select conv_id, 'image_search_tool' as tool_name, cast(reward as double) as reward, iou, cache_hit, cast(null as double) as mcc_score, 1 as n_pos from image_reward
 union all select conv_id, 'text_search_tool', 0.1, null, coalesce(max(score)>0.5,false), null, 2 from text_scored group by conv_id, msg_idx
 union all select conv_id, 'f1_image_search_tool', cast({MCC} as double)*0.3, null, null, cast({MCC} as double), 0 from confused""",
    "image_reward", "text_scored", "confused",
)


@query(
    "tool_statistics",
    sql_with(
        """select tool_name, count(*) as call_count, round(avg(reward),6)+0.0 as reward_mean, round(avg(iou),6) as crop_iou_mean,
 round(avg(case when iou>=0.5 then 1.0 when iou is not null then 0.0 end),6) as crop_iou_hit_rate, round(avg(case when cache_hit then 1.0 when cache_hit is not null then 0.0 end),6) as cache_hit_rate,
 round(avg(mcc_score),6)+0.0 as discrimination_mean from call_meta group by 1""",
        "call_meta",
    ),
)
def tool_statistics(spark, sf):
    out = S.tool_stats(call_metas(spark, sf))
    return out.select("tool_name", "call_count", *[(F.round(c, 6) + 0.0).alias(c) for c in out.columns[2:]])


@query(
    "tool_total_reward",
    sql_with(
        "select count(*) as n_samples, round(avg(total),6)+0.0 as total_reward_mean from (select c.conv_id, coalesce(sum(reward),0) as total from (select distinct conv_id from conversations where conv_id%7<>0) c left join call_meta m on m.conv_id=c.conv_id group by 1)",
        "call_meta",
    ),
)
def tool_total_reward(spark, sf):
    # Rewards of one conversation: as many as it has calls. One conversation in seven has no list.
    lists = call_metas(spark, sf).groupBy("conv_id").agg(F.collect_list("reward").alias("tool_rewards"))
    empty = F.array().cast("array<double>")
    samples = message(spark, sf).select("conv_id").distinct().join(lists, "conv_id", "left")
    listed = samples.withColumn("tool_rewards", F.when(F.col("conv_id") % 7 != 0, F.coalesce("tool_rewards", empty)))
    return S.total_tool_reward(listed).withColumn("total_reward_mean", F.round("total_reward_mean", 6) + 0.0)


@query(
    "sample_tool_rollup",
    sql_with(
        """select c.conv_id, coalesce(a,0) as img_search_calls, coalesce(round(b,4),0.0)+0.0 as img_search_reward, cast(coalesce(d,0) as bigint) as img_search_n_pos, coalesce(e,0) as img_search_cache_hits,
 coalesce(round(f,4),0.0) as img_search_iou_max, coalesce(round(g,4),0.0) as img_search_iou_mean, coalesce(h,0) as txt_search_calls, coalesce(round(i,4),0.0) as txt_search_reward,
 cast(coalesce(j,0) as bigint) as txt_search_n_pos, coalesce(k,0) as txt_search_cache_hits, cast(0 as bigint) as zoom_calls, cast(0 as bigint) as zoom_bad_bbox
 from (select distinct conv_id from conversations) c left join (select conv_id, count(*) filter (where t='i') as a, sum(reward) filter (where t='i') as b, sum(n_pos) filter (where t='i') as d,
 count(*) filter (where t='i' and cache_hit) as e, max(iou) as f, avg(iou) as g, count(*) filter (where t='t') as h, sum(reward) filter (where t='t') as i,
 sum(n_pos) filter (where t='t') as j, count(*) filter (where t='t' and cache_hit) as k from (select *, left(tool_name,1) as t from call_meta) group by 1) r on r.conv_id=c.conv_id""",
        "call_meta",
    ),
)
def sample_tool_rollup(spark, sf):
    samples = message(spark, sf).select("conv_id").distinct()
    out = S.sample_tool_rollup(samples, call_metas(spark, sf), "conv_id")
    return out.withColumn("img_search_reward", F.col("img_search_reward") + 0.0)


@query(
    "cache_profile",
    sql_with(
        """select (select count(distinct conv_id) from image_labeled) as n_images, (select count(*) from image_labeled where is_geo_useful) as n_useful,
 (select round(avg(m),6) from (select max(call_idx) as m from image_labeled group by conv_id)) as mean_last_call,
 (select round(cast(count(*) as double)/count(distinct conv_id||'|'||call_idx),6) from image_labeled) as mean_results_per_call""",
        "image_labeled",
    ),
)
def cache_profile(spark, sf):
    out = S.cache_profile(labeled(spark, sf, K.IMAGE_SEARCH), "conv_id")
    return out.select("n_images", "n_useful", F.round("mean_last_call", 6).alias("mean_last_call"), F.round("mean_results_per_call", 6).alias("mean_results_per_call"))


@query(
    "flattened_sections",
    """select page_id, array_to_string(list_concat(s[1:5], s[1:2], s[1:2]),' ') as results, cast(len(list_concat(s[1:5], s[1:2], s[1:2])) as int) as n
 from (select page_id, string_split(url,'/') as s from pages)""",
)
def flattened_sections(spark, sf):
    parts = F.split("url", "/")
    rows = table(spark, sf, "pages").select("page_id", parts.alias("organic"), parts.alias("sights"), parts.alias("tweets"))
    out = S.flatten_sections(rows, {"organic": 5, "sights": 2, "tweets": 2})
    return out.select("page_id", F.array_join("results", " ").alias("results"), F.size("results").alias("n"))
