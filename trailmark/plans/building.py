"""Queries on filters, projections and dataset builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions import constants as K
from trailmark.functions import geo as G
from trailmark.functions import text as X
from trailmark.operators import builders as D
from trailmark.operators import extraction as E
from trailmark.operators import filters as B
from trailmark.operators.accuracy import value_counts
from trailmark.plans.conversation import CUE, STRIP, TAILS
from trailmark.plans.fixtures import add_view, geo_scored, geo_truth, message, sql_with, table
from trailmark.plans.registry import query

SYSTEM, USER = "Locate the picture.", "<image>\nWhere is this?"


def metadata(spark, sf):
    """Image metadata with place names, some of them missing or written-out nulls."""
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("id")
    image = F.concat(F.lpad((key % 97).cast("string"), 2, "0"), F.lit("_"), F.lpad((key % 89).cast("string"), 2, "0"), F.lit("_"), key.cast("string"), F.lit(".jpg"))
    return (
        geo_truth(spark, sf)
        .join(nation, F.col("nationkey") == F.col("n_nationkey"), "left")
        .select(
            "id", "latitude", "longitude", F.col("n_name").alias("country"), F.col("r_name").alias("region"),
            F.when(key % 7 == 0, "none").when(key % 11 == 0, "").otherwise(F.concat(F.lit("City "), (key % 31).cast("string"))).alias("city"),
            F.when(key % 5 != 0, F.concat(F.lit("Block "), (key % 13).cast("string"))).alias("neighbourhood"),
            F.col("r_name").alias("continent"), image.alias("image_id"), F.concat(F.lit("/data/raw/"), image).alias("path"),
        )
    )


add_view(
    "metadata",
    """select id, latitude, longitude, n_name as country, r_name as region, case when id%7=0 then 'none' when id%11=0 then '' else 'City '||(id%31) end as city,
 case when id%5<>0 then 'Block '||(id%13) end as neighbourhood, r_name as continent, lpad(cast(id%97 as string),2,'0')||'_'||lpad(cast(id%89 as string),2,'0')||'_'||id||'.jpg' as image_id,
 '/data/raw/'||lpad(cast(id%97 as string),2,'0')||'_'||lpad(cast(id%89 as string),2,'0')||'_'||id||'.jpg' as path
 from geo_truth left join (nation join region on n_regionkey=r_regionkey) on nationkey=n_nationkey""",
    "geo_truth",
)


def traj_message(spark, sf):
    """Messages of trajectories: with a system turn, nudges, failed tools and zoom pictures mixed in."""
    conv, turn, role, c = F.col("conv_id"), F.col("msg_idx"), F.col("role"), F.col("content")
    failed = "<tool_response>\nImage search failed: all API keys exhausted\n</tool_response>"
    out = message(spark, sf)
    out = out.withColumn("content", F.when(conv % 3 == 1, F.replace(c, F.lit("<think>"), F.lit("<think>This is the famous City. "))).otherwise(c))
    out = out.withColumn("content", F.when((conv % 6 == 1) & (role == "user") & c.startswith("<tool_response>"), failed).otherwise(c))
    out = out.withColumn("content", F.when(conv % 2 == 1, F.regexp_replace(c, "<useful>[^<]*</useful>", "")).otherwise(c))
    nudged = (role == "user") & (turn > 0) & ((conv + turn) % 3 == 0) & (conv % 4 == 0)
    out = out.withColumn("content", F.when(nudged, K.NUDGE_PREFIX + ".").otherwise(c))
    zoomed = (role == "user") & (turn > 0) & (conv % 5 == 0) & c.startswith("<tool_response>")
    out = out.withColumn("content", F.when(zoomed, F.concat(F.lit("<image>\nimage_id: 1\n"), c)).otherwise(c))
    body = out.select(conv.alias("id"), (turn + 1).cast("int").alias("pos"), "role", "content")
    system = out.select(conv.alias("id"), F.lit(0).alias("pos"), F.lit("system").alias("role"), F.lit("sys").alias("content")).distinct()
    return body.unionByName(system)


add_view(
    "traj_message",
    f"""select conv_id as id, cast(msg_idx+1 as int) as pos, role, case when role='user' and msg_idx>0 and conv_id%5=0 and starts_with(content,'<tool_response>') then '<image>'||chr(10)||'image_id: 1'||chr(10)||content else content end as content from (
 select conv_id, msg_idx, role, case when role='user' and msg_idx>0 and (conv_id+msg_idx)%3=0 and conv_id%4=0 then '{K.NUDGE_PREFIX}.' else content end as content from (
 select conv_id, msg_idx, role, case when conv_id%2=1 then regexp_replace(content,'<useful>[^<]*</useful>','','g') else content end as content from (
 select conv_id, msg_idx, role, case when conv_id%6=1 and role='user' and starts_with(content,'<tool_response>') then '<tool_response>'||chr(10)||'Image search failed: all API keys exhausted'||chr(10)||'</tool_response>' else content end as content from (
 select conv_id, msg_idx, role, case when conv_id%3=1 then replace(content,'<think>','<think>This is the famous City. ') else content end as content from message))))
 union all select distinct conv_id, 0, 'system', 'sys' from message""",
    "message",
)


def trajectories(spark, sf):
    """One row per trajectory with messages, images and annotations in arrays."""
    key = F.col("id")
    messages = traj_message(spark, sf).groupBy("id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "role", "content"))),
            lambda m: F.struct(m.role.alias("role"), m.content.alias("content")),
        ).alias("messages")
    )
    notes = E.useful_tags(message(spark, sf)).groupBy(F.col("conv_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct((F.col("call_msg_idx") + 1).cast("int").alias("turn"), "tool", "indices"))).alias("useful_results")
    )
    picture = [F.concat(F.lit("/data/img/"), key.cast("string"), F.lit(f"_{i}.jpg")) for i in (0, 1)]
    return messages.join(notes, "id", "left").select(
        "id",
        (key % 3).cast("int").alias("part"),
        F.when(key % 9 == 0, 1.0).when(key % 11 != 0, 0.0).alias("masked"),
        F.when(key % 5 == 0, 0.5).when(key % 13 != 0, ((key * 37) % 500).cast("double") / 2).alias("km"),
        F.when(key % 4 != 0, (key % 6).cast("int")).otherwise(0).alias("n_tool_calls"),
        (key % 2).cast("int").alias("n_crop_calls"),
        F.lit(0).alias("n_search_calls"),
        F.lit(None).cast("int").alias("n_tavily_calls"),
        (key % 7).cast("int").alias("n_nudges"),
        "messages",
        F.coalesce("useful_results", F.array().cast("array<struct<turn:int,tool:string,indices:array<int>>>")).alias("useful_results"),
        F.when(key % 17 == 0, F.array().cast("array<string>")).otherwise(F.array(*picture)).alias("images"),
    )


add_view(
    "traj",
    """select id, cast(id%3 as int) as part, cast(case when id%9=0 then 1.0 when id%11<>0 then 0.0 end as double) as masked,
 case when id%5=0 then 0.5 when id%13<>0 then cast((id*37)%500 as double)/2 end as km, cast(case when id%4<>0 then id%6 else 0 end as int) as n_tool_calls,
 cast(id%2 as int) as n_crop_calls, cast(id%7 as int) as n_nudges, id%17<>0 as has_image from (select distinct conv_id as id from conversations)""",
)


@query("required_fields", sql_with("select id from metadata where latitude is not null and country is not null and neighbourhood is not null", "metadata"))
def required_fields(spark, sf):
    return B.require(metadata(spark, sf), ["latitude", "country", "neighbourhood"]).select("id")


@query("sentinel_filter", sql_with("select id from metadata where lower(trim(city)) not in ('','none','null','nan')", "metadata"))
def sentinel_filter(spark, sf):
    return B.drop_sentinels(metadata(spark, sf), "city").select("id")


@query("complete_places", sql_with("select id from metadata where country<>'' and region<>'' and city<>'' and neighbourhood<>''", "metadata"))
def complete_places(spark, sf):
    return B.complete_places(metadata(spark, sf), ["l2", "l4"]).select("id")


@query("quality_filter", sql_with("select id from traj where coalesce(masked,1)=0 and km<=200 and n_tool_calls>=1 and n_nudges<=5", "traj"))
def quality_filter(spark, sf):
    return trajectories(spark, sf).where(B.quality()).select("id")


@query(
    "failure_markers",
    sql_with(
        """select id, bool_or(contains(content,'Image search failed') or contains(content,'all API keys exhausted')) as sft, bool_or(contains(content,'COS upload') or contains(content,'Image search failed')) as rl,
 bool_or(contains(lower(content),'search failed')) as fallback, bool_or(contains(lower(content),'api keys exhausted')) as notool from traj_message group by 1""",
        "traj_message",
    ),
)
def failure_markers(spark, sf):
    return trajectories(spark, sf).select("id", *[B.has_marker(F.col("messages"), p).alias(p) for p in K.FAILURE_MARKERS])


add_view(
    "traj_call",
    """select id, pos, json_extract_string(raw,'$.name') as name, cast(json_extract(raw,'$.arguments.bbox_2d') as double[]) as bbox from (
 select id, pos, unnest(regexp_extract_all(content,'<tool_call>(.*?)</tool_call>',1,'s')) as raw from traj_message where role='assistant') where json_valid(raw)""",
    "traj_message",
)


@query(
    "full_image_search",
    sql_with(
        " select t.id, "
        + ", ".join(f"coalesce(bool_or(c.name='image_search_tool' and c.bbox[1]<={m} and c.bbox[2]<={m} and c.bbox[3]>={1000 - m} and c.bbox[4]>={1000 - m}),false) as margin_{m}" for m in (5, 200, 350, 450))
        + " from traj t left join traj_call c on c.id=t.id group by 1",
        "traj", "traj_call",
    ),
)
def full_image_search(spark, sf):
    # The boxes of the tables never cover the whole image, so wider margins are shown beside the usual one.
    wide = [B.has_full_image_search(F.col("messages"), m).alias(f"margin_{m}") for m in (5, 200, 350, 450)]
    return trajectories(spark, sf).select("id", *wide)


@query("masked_without_tools", sql_with("select id from traj where not (coalesce(masked,0)<>0 and coalesce(nullif(n_tool_calls,0), n_crop_calls)=0)", "traj"))
def masked_without_tools(spark, sf):
    return trajectories(spark, sf).where(~B.masked_without_tools()).select("id")


add_view(
    "coverage",
    """select t.id, coalesce(c.n,0)=0 or coalesce(u.n,0)>=coalesce(c.n,0) as covered from traj t left join (select id, count(*) as n from traj_call where name in ('image_search_tool','text_search_tool') group by 1) c on c.id=t.id
 left join (select conv_id, count(*) as n from useful_tag group by 1) u on u.conv_id=t.id""",
    "traj", "traj_call", "useful_tag",
)


@query("full_coverage", sql_with("select id, covered from coverage", "coverage"))
def full_coverage(spark, sf):
    return trajectories(spark, sf).select("id", B.full_coverage(F.col("messages"), F.col("useful_results")).alias("covered"))


@query("difficulty_subset", sql_with("select id, run from geo_scored where km<=25 or km is null", "geo_scored"))
def difficulty_subset(spark, sf):
    return B.keep_difficulty(geo_scored(spark, sf), ["easy", "unknown"]).select("id", "run")


@query("relative_paths", sql_with("select id, case when starts_with(path,'/data/') then substr(path,7) else path end as relative, path as unchanged from metadata", "metadata"))
def relative_paths(spark, sf):
    path = F.col("path")
    return metadata(spark, sf).select("id", G.relative_path(path, "/data/").alias("relative"), G.relative_path(path, "/dat").alias("unchanged"))


@query(
    "ground_truth_text",
    sql_with("select id, printf('%.4f, %.4f, %s, %s', latitude, longitude, coalesce(country,'Unknown'), coalesce(city,'Unknown')) as truth from metadata", "metadata"),
)
def ground_truth_text(spark, sf):
    truth = G.ground_truth_text(F.col("latitude"), F.col("longitude"), G.default_place(F.col("country")), G.default_place(F.col("city")))
    return metadata(spark, sf).select("id", truth.alias("truth"))


@query("default_places", sql_with("select id, coalesce(country,'Unknown') as country, coalesce(neighbourhood,'Unknown') as neighbourhood from metadata", "metadata"))
def default_places(spark, sf):
    return metadata(spark, sf).select("id", G.default_place(F.col("country")).alias("country"), G.default_place(F.col("neighbourhood")).alias("neighbourhood"))


@query("sharded_paths", sql_with("select id, '/img/'||split_part(image_id,'_',1)||'/'||split_part(image_id,'_',2)||'/'||image_id as path from metadata", "metadata"))
def sharded_paths(spark, sf):
    return metadata(spark, sf).select("id", G.sharded_path(F.col("image_id"), "/img/").alias("path"))


LEVELS_SQL = " union all ".join(
    f"select id, '{v}' as version, '<answer>'||{''.join(f'''trim(coalesce({c},''))||', '||''' for c in fields)}printf('%.4f, %.4f',latitude,longitude)||'</answer>' as answer from metadata"
    for v, fields in D.LEVEL_FIELDS.items()
)


@query("granularity_answers", sql_with(LEVELS_SQL, "metadata"))
def granularity_answers(spark, sf):
    return D.expand_granularity(metadata(spark, sf), list(D.LEVEL_FIELDS)).select("id", "version", "answer")


POOL = ["Where is it?", "Name the place.", "Which city is this?"]
PICK_SQL = "['Where is it?','Name the place.','Which city is this?'][1+cast(cast('0x'||left(md5('5|'||id),8) as bigint)%3 as int)]"


@query("question_pick", sql_with(f"select id, {PICK_SQL} as question from metadata", "metadata"))
def question_pick(spark, sf):
    return metadata(spark, sf).select("id", D.pick_from_pool(POOL, 5, "id").alias("question"))


@query(
    "chat_samples",
    sql_with(f"select id, '<image>'||chr(10)||'{SYSTEM}'||chr(10)||chr(10)||{PICK_SQL} as prompt, '<answer>'||printf('%.4f, %.4f',latitude,longitude)||'</answer>' as answer from metadata", "metadata"),
)
def chat_samples(spark, sf):
    rows = D.expand_granularity(metadata(spark, sf), ["l0"])
    chat = D.build_chat(SYSTEM, D.pick_from_pool(POOL, 5, "id"), F.col("answer"))
    return rows.select("id", chat[0].content.alias("prompt"), chat[1].content.alias("answer"))


@query("overlong_filter", "select doc_id from documents where len([x for x in regexp_split_to_array(text,'\\s+') if x<>''])<=200")
def overlong_filter(spark, sf):
    return B.filter_overlong(table(spark, sf, "documents"), 200, text="text").select("doc_id")


@query(
    "fitted_sequences",
    """select doc_id, array_to_string(list_concat(case when len(w)>5 then w[1:5] else w end, list_value('-','-','-','-','-')[1:greatest(0,5-len(w))]),' ') as right_cut,
 array_to_string(list_concat(case when len(w)>5 then w[-5:] else w end, list_value('-','-','-','-','-')[1:greatest(0,5-len(w))]),' ') as left_cut from (select doc_id, string_split(source||' '||lang||' '||text,' ') as w from documents)""",
)
def fitted_sequences(spark, sf):
    words = F.split(F.concat_ws(" ", "source", "lang", "text"), " ", -1)
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(B.fit_length(words, 5, "right", "-"), " ").alias("right_cut"), F.array_join(B.fit_length(words, 5, "left", "-"), " ").alias("left_cut")
    )


@query(
    "clipped_text",
    """select doc_id, md5(case when length(text)>100 then left(text,100)||'...(truncated)' else text end) as left_side,
 md5(case when length(text)>100 then '(truncated)...'||right(text,100) else text end) as right_side,
 md5(case when length(text)>100 then left(text,50)||'...(truncated)...'||right(text,50) else text end) as both_ends from documents""",
)
def clipped_text(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(X.clip_text(text, 100, "left")).alias("left_side"), F.md5(X.clip_text(text, 100, "right")).alias("right_side"),
        F.md5(X.clip_text(text, 100)).alias("both_ends"),
    )


@query(
    "browse_page",
    """select l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate from lineitem where l_quantity between 10 and 40 and contains(lower(concat_ws(' ', l_returnflag, l_linestatus)),'a f')
 order by l_extendedprice desc nulls last, l_orderkey, l_linenumber, l_partkey limit 50 offset 50""",
)
def browse_page(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_returnflag", "l_linestatus")
    page = B.browse(rows, "l_quantity", 10, 40, "A F", "l_extendedprice", ascending=False, page=2, size=50)
    return page.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")


def regions(spark, sf):
    """Zoom regions per order: one per line, with a label and a gain."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.array_sort(
            F.collect_list(F.struct(F.col("l_linenumber").alias("no"), (F.col("l_discount") - 0.05).alias("gain"), F.col("l_returnflag").alias("label")))
        ).alias("verified_regions")
    )
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 100).alias("pred_km"), (F.col("o_orderstatus") == "F").alias("has_useful_region")).join(lines, "id", "left")


REGION_SQL = """(select o_orderkey as id, o_totalprice/100 as pred_km, o_orderstatus='F' as has_useful_region, n, gains, positive from orders left join
 (select l_orderkey, count(*) as n, count(l_discount) as gains, count(*) filter (where l_discount-0.05>0) as positive from lineitem group by 1) on l_orderkey=o_orderkey)"""


@query("region_filter", f"select id from {REGION_SQL} where n>0 and has_useful_region and positive>0 and pred_km<=2000")
def region_filter(spark, sf):
    return B.filter_regions(regions(spark, sf), 2000).select("id")


@query(
    "region_statistics",
    f"""select count(*) as n_total, count(case when n>0 then 1 end) as n_with_regions, count(case when has_useful_region then 1 end) as n_useful, cast(coalesce(sum(gains),0) as bigint) as n_gains,
 cast(coalesce(sum(positive),0) as bigint) as n_positive, round(avg(pred_km),6) as mean_pred_km, round(avg(case when pred_km<25 then 1.0 else 0.0 end),6) as share_within_25 from {REGION_SQL}""",
)
def region_statistics(spark, sf):
    out = B.region_stats(regions(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_pred_km", "share_within_25")})


def boxes(spark, sf):
    """Crop boxes from order lines: also tiny, flat, reversed and out-of-range ones."""
    x, y = F.col("l_partkey") % 1000, F.col("l_suppkey") * 7 % 1000
    w, h = F.col("l_quantity") * 8 - 20, F.col("l_linenumber") * 30 - 25
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        F.array(x.cast("double"), y.cast("double"), (x + w).cast("double"), (y + h).cast("double")).alias("bbox"),
        (200 + F.col("l_orderkey") % 1800).cast("int").alias("width"), (150 + F.col("l_orderkey") % 1200).cast("int").alias("height"),
    )


BBOX_SQL = """with b as (select *, l_partkey%1000 as x, (l_suppkey*7)%1000 as y, l_quantity*8-20 as bw, l_linenumber*30-25 as bh, 200+l_orderkey%1800 as w, 150+l_orderkey%1200 as h from lineitem),
 c as (select *, cast(x*w/1000.0 as double) as l, cast(y*h/1000.0 as double) as t, least(w,cast((x+bw)*w/1000.0 as double)) as r, least(h,cast((y+bh)*h/1000.0 as double)) as bt,
 least(x,y,x+bw,y+bh)>=0 and greatest(x,y,x+bw,y+bh)<=1000 as u from b),
 d as (select *, r-l as wide, bt-t as tall, u and r>l and bt>t and greatest(r-l,bt-t)<=100*least(r-l,bt-t) as ok from c),
 e as (select *, (tall<28 or wide<28) as small, case when ok then wide*(28.0/least(tall,wide)) end as gw0, case when ok then tall*(28.0/least(tall,wide)) end as gh0 from d),
 f as (select *, case when gw0>w then w else gw0 end as gw1, case when gw0>w then gh0*(w/gw0) else gh0 end as gh1 from e),
 g as (select *, case when gh1>h then h else gh1 end as gh, case when gh1>h then gw1*(h/gh1) else gw1 end as gw from f),
 i as (select *, case when greatest((l+r)/2-gw/2,0)+gw>w then w-gw else greatest((l+r)/2-gw/2,0) end as x0, case when greatest((t+bt)/2-gh/2,0)+gh>h then h-gh else greatest((t+bt)/2-gh/2,0) end as y0 from g),
 j as (select *, case when small then floor(x0) else l end as x1, case when small then floor(y0) else t end as y1, case when small then ceil(x0+gw) else r end as x2, case when small then ceil(y0+gh) else bt end as y2 from i),
 k as (select *, coalesce(ok and x2>x1 and y2>y1 and greatest(x2-x1,y2-y1)<=100*least(x2-x1,y2-y1) and floor(y2)-floor(y1)>=28 and floor(x2)-floor(x1)>=28,false) as box_ok from j)
 select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, box_ok, case when box_ok then round(x1,4) end as x1, case when box_ok then round(y1,4) end as y1, case when box_ok then round(x2,4) end as x2, case when box_ok then round(y2,4) end as y2 from k"""


@query("bbox_geometry", BBOX_SQL)
def bbox_geometry(spark, sf):
    out = B.bbox_geometry(boxes(spark, sf), "bbox", "width", "height")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "box_ok", *[F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(
    "resize_targets",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, cast(case when rh*rw>2097152 then floor(h/sqrt(h*w/2097152.0)/28)*28 when rh*rw<65536 then ceil(h*sqrt(65536.0/(h*w))/28)*28 else rh end as int) as out_height,
 cast(case when rh*rw>2097152 then floor(w/sqrt(h*w/2097152.0)/28)*28 when rh*rw<65536 then ceil(w*sqrt(65536.0/(h*w))/28)*28 else rw end as int) as out_width from (
 select *, greatest(28,round_even(h/28.0,0)*28) as rh, greatest(28,round_even(w/28.0,0)*28) as rw from (
 select *, cast(30+l_partkey%3000 as double) as h, cast(30+(l_suppkey*37)%2500 as double) as w from lineitem))""",
)
def resize_targets(spark, sf):
    height, width = (30 + F.col("l_partkey") % 3000).cast("double"), (30 + F.col("l_suppkey") * 37 % 2500).cast("double")
    rows = table(spark, sf, "lineitem").withColumn("s", B.resize_target(height, width))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.col("s.height").alias("out_height"), F.col("s.width").alias("out_width"))


# The SQL side of the trajectory rewrite walks the messages with windows.
add_view(
    "turned",
    f"""select *, max(case when role='assistant' then pos end) over (partition by id order by pos rows between unbounded preceding and 1 preceding) as before,
 max(pos) over (partition by id) as last_pos, role='user' and starts_with(content,'{K.NUDGE_PREFIX}') as nudge from traj_message""",
    "traj_message",
)
add_view(
    "walked",
    """select t.*, t.role='assistant' and exists(select 1 from turned n where n.id=t.id and n.nudge and n.pos<t.pos and n.pos>coalesce(t.before,-1)) as skip from turned t""",
    "turned",
)
add_view(
    "tagged_turn",
    """select w.*, (select max(u.pos) from walked u where u.id=w.id and u.role='user' and not u.nudge and u.pos<>1 and u.pos<w.pos and u.pos>coalesce(w.before,-1)) as resp_pos from walked w""",
    "walked",
)
add_view(
    "rewritten",
    f"""select id, pos, role, before, last_pos, case when role='system' then '{SYSTEM}' when role='user' and pos=1 then '{USER.replace(chr(10), "'||chr(10)||'")}'
 when role='user' then regexp_replace(content,'<image>\\s*\\nimage_id:\\s*\\d+','<image>','g')
 when pos=last_pos or tag is null or contains(content,'<useful>') then regexp_replace(content,'\\s+$','')
 else regexp_replace(regexp_replace(content,'\\s+$',''),'</think>','</think>'||chr(10)||' <useful>'||tag||'</useful>') end as content,
 case when role='user' and pos=1 then 0 when role='user' then cast(nullif(regexp_extract(content,'<image>\\s*\\nimage_id:\\s*(\\d+)',1),'') as int) end as image_no
 from (select t.*, (select u.indices from walked r, useful_tag u where r.id=t.id and r.pos=t.resp_pos and u.conv_id=t.id
 and u.tool=case when contains(r.content,'Image search results') then 'image_search_tool' when contains(r.content,'Web search results') then 'text_search_tool' end
 and u.call_msg_idx+1=(select max(a.pos) from walked a where a.id=t.id and a.role='assistant' and not a.skip and a.pos<t.resp_pos)) as tag
 from tagged_turn t where not nudge and not skip)""",
    "tagged_turn", "useful_tag",
)
add_view(
    "sft_row",
    """select r.id, count(*) as n, string_agg(r.role||':'||r.content, chr(10) order by pos) as body, arg_max(r.role,pos) as last_role, arg_max(r.content,pos) as last_content,
 max(last_pos)=max(pos) as ends_kept, count(image_no) as n_images, coalesce(max(image_no),0) as max_image, cast(sum((length(r.content)-length(replace(r.content,'<image>','')))/7) as int) as n_tokens from rewritten r group by 1""",
    "rewritten",
)


def turned(spark, sf):
    return trajectories(spark, sf).withColumn("turns", D._with_turns(D._indexed(F.col("messages"))))


@query("nudge_removal", sql_with("select id, count(*) as n_messages, md5(string_agg(role||':'||content, chr(10) order by pos)) as digest from walked where not nudge and not skip group by 1", "walked"))
def nudge_removal(spark, sf):
    rows = trajectories(spark, sf).select("id", D.drop_nudges(F.col("messages")).alias("m"))
    text = F.array_join(F.transform("m", lambda m: F.concat(m.role, F.lit(":"), m.content)), "\n")
    return rows.select("id", F.size("m").cast("bigint").alias("n_messages"), F.md5(text).alias("digest"))


@query("useful_injection", sql_with("select id, md5(body) as digest from sft_row", "sft_row"))
def useful_injection(spark, sf):
    rows = turned(spark, sf).select("id", D.rewrite_messages(F.col("turns"), F.col("useful_results"), SYSTEM, USER).alias("m"))
    return rows.select("id", F.md5(F.array_join(F.transform("m", lambda m: F.concat(m.role, F.lit(":"), m.content)), "\n")).alias("digest"))


@query("shape_validation", sql_with("select id, n between 3 and 12 and last_role='assistant' and contains(last_content,'<answer>') as valid from sft_row", "sft_row"))
def shape_validation(spark, sf):
    rows = turned(spark, sf).select("id", D.rewrite_messages(F.col("turns"), F.col("useful_results"), SYSTEM, USER).alias("m"))
    return rows.select("id", D.valid_shape(F.col("m")).alias("valid"))


@query(
    "media_alignment",
    sql_with("select s.id, s.n_tokens=case when t.has_image then 2 else 0 end as aligned from sft_row s join traj t on t.id=s.id where t.has_image", "sft_row", "traj"),
)
def media_alignment(spark, sf):
    rows = turned(spark, sf).select("id", F.transform("images", lambda p: F.struct(p.alias("image"))).alias("images"), D.rewrite_messages(F.col("turns"), F.col("useful_results"), SYSTEM, USER).alias("m"))
    # The listing holds every picture of the trajectories that have any.
    listing = trajectories(spark, sf).select(F.explode("images").alias("path"))
    kept = D.drop_missing_media(rows.where(F.size("images") > 0), listing, "id")
    return kept.select("id", D.aligned_media(F.col("m"), F.col("images")).alias("aligned"))


@query(
    "sft_samples",
    sql_with(
        """select s.id, md5(body) as digest, cast(n_images as int) as n_images, km, n_tool_calls from sft_row s join traj t on t.id=s.id where (n_images=0 or t.has_image) and n between 3 and 12 and last_role='assistant'
 and contains(last_content,'<answer>') and n_tokens=n_images and max_image<2
 and (not ends_kept or (regexp_matches(last_content,'<answer>(.*?)</answer>','s') and not starts_with(lower(trim(regexp_extract(last_content,'<answer>(.*?)</answer>',1,'s'))),'none')))""",
        "sft_row", "traj",
    ),
)
def sft_samples(spark, sf):
    rows = D.build_sft(trajectories(spark, sf), SYSTEM, USER, "/data")
    text = F.array_join(F.transform("messages", lambda m: F.concat(m.role, F.lit(":"), m.content)), "\n")
    return rows.select("id", F.md5(text).alias("digest"), F.size("images").alias("n_images"), "km", "n_tool_calls")


# What the sample builders read from a trajectory: first reasoning, first call, last answer.
add_view(
    "traj_parts",
    r"""select t.id, trim(regexp_extract(arg_min(content,pos) filter (where role='assistant' and regexp_matches(content,'<think>(.*?)</think>','s') and regexp_matches(content,'<tool_call>\s*(\{.*?\})\s*</tool_call>','s')),'<think>(.*?)</think>',1,'s')) as call_think,
 trim(regexp_extract(arg_min(content,pos) filter (where role='assistant' and regexp_matches(content,'<think>(.*?)</think>','s')),'<think>(.*?)</think>',1,'s')) as first_think,
 trim(regexp_extract(arg_min(content,pos) filter (where role='assistant' and regexp_matches(content,'<think>(.*?)</think>','s') and regexp_matches(content,'<tool_call>\s*(\{.*?\})\s*</tool_call>','s')),'<tool_call>\s*(\{.*?\})\s*</tool_call>',1,'s')) as call,
 arg_max(content,pos) filter (where role='assistant' and regexp_matches(content,'<answer>(.*?)</answer>','s')) as last,
 bool_or(contains(lower(content),'search failed')) as failed, bool_or(role='user' and contains(lower(content),'search results')) as succeeded from traj_message t group by 1""",
    "traj_message",
)
FALLBACK_TAIL, FALLBACK_CUE = K.FALLBACK_TAIL_PATTERN.replace("'", "''"), K.FALLBACK_CUE_PATTERN.replace("'", "''")
NAMED = "regexp_matches({0},'(?i)(^|[^\\p{{L}}\\p{{N}}_])City($|[^\\p{{L}}\\p{{N}}_])')"


@query(
    "fallback_samples",
    sql_with(
        rf"""select id, cast(5 as int) as n_messages, answer, md5('<think>'||chr(10)||opening||chr(10)||'</think>'||chr(10)||'<tool_call>'||call||'</tool_call>') as call_digest,
 md5('<think>'||chr(10)||case when not {NAMED.format('cut')} then 'The scene shows '||trim(string_split(answer,',')[2])||' in '||trim(string_split(answer,',')[1])||'.'
  when contains(lower(bare),'no tool') or contains(lower(bare),'without') then bare else bare||' The scene settles it.' end||chr(10)||'</think>'||chr(10)||chr(10)||'<answer>'||answer||'</answer>') as answer_digest from (
 select *, {STRIP.format("regexp_replace(cut,'(?s)<useful>.*?</useful>','','g')")} as bare, regexp_replace(regexp_replace({STRIP.format("regexp_replace(call_think,'(?s)<useful>.*?</useful>','','g')")},'(?is){FALLBACK_TAIL}',''),'[ .]+$','')||'.' as opening from (
 select *, case when regexp_matches(last_think,'(?i){FALLBACK_CUE}') then regexp_replace(regexp_extract(last_think,'(?is)^(.*?){FALLBACK_CUE}',1),'[ .\n]+$','')||'.' else last_think end as cut from (
 select p.id, trim(regexp_extract(last,'<answer>(.*?)</answer>',1,'s')) as answer, call_think, call, coalesce({STRIP.format("regexp_extract(last,'<think>(.*?)</think>',1,'s')")},'') as last_think from traj_parts p join traj t on t.id=p.id
 where coalesce(masked,1)=0 and km<=200 and n_tool_calls>=1 and failed and not succeeded and call_think is not null and last is not null and t.has_image and {NAMED.format('call_think')})))""",
        "traj_parts", "traj",
    ),
)
def fallback_samples(spark, sf):
    rows = D.build_fallback(trajectories(spark, sf), SYSTEM, USER, " The scene settles it.", "The scene shows %s in %s.", "No result.")
    return rows.select(
        "id", F.size("messages").alias("n_messages"), X.first_match(F.element_at("messages", -1).content, X.ANSWER).alias("answer"),
        F.md5(F.col("messages")[2].content).alias("call_digest"), F.md5(F.col("messages")[4].content).alias("answer_digest"),
    )


TEMPLATES = ["This looks like {city} in {country}.", "The style of {region} points to {city}."]
TEMPLATES_BARE = ["Somewhere in {country}, {continent}.", "The features fit {region}."]


def template_sql(names):
    clean = "replace(replace(replace(replace({0},'{{city}}',trim(coalesce(city,''))),'{{country}}',trim(country)),'{{region}}',coalesce(nullif(trim(region),''),country)),'{{continent}}',coalesce(nullif(trim(continent),''),'the world'))"
    pool = "[" + ",".join(f"'{n}'" for n in names) + "]"
    return clean.format(f"{pool}[1+cast(cast('0x'||left(md5('3|'||id),8) as bigint)%2 as int)]")


@query(
    "templated_samples",
    sql_with(
        f"""select id, '<think>'||chr(10)||case when lower(trim(city)) not in ('','none','nan','null') then {template_sql(TEMPLATES)} else {template_sql(TEMPLATES_BARE)} end||chr(10)||'</think>'||chr(10)||chr(10)
 ||'<answer>'||trim(country)||', '||coalesce(nullif(trim(city),''),trim(country))||', '||printf('%.4f, %.4f',latitude,longitude)||'</answer>' as reply from metadata where country is not null""",
        "metadata",
    ),
)
def templated_samples(spark, sf):
    rows = D.build_notool_templated(metadata(spark, sf), SYSTEM, USER, TEMPLATES, TEMPLATES_BARE, 3)
    return rows.select("id", F.col("messages")[2].content.alias("reply"))


@query(
    "real_reasoning_samples",
    sql_with(
        rf"""select id, km, has_api_error, answer, md5('<think>'||chr(10)||{STRIP.format(f"case when list_bool_or([contains(lower(right(cut,200)),w) for w in [{TAILS}]]) then cut else cut||' The scene settles it.' end")}||chr(10)||'</think>'||chr(10)||chr(10)||'<answer>'||answer||'</answer>') as digest from (
 select *, case when regexp_matches(first_think,'(?i){CUE}') then regexp_replace(regexp_extract(first_think,'(?is)^(.*?){CUE.replace("|^)", "|^)", 1)}',1),'[ .]+$','')||'.' else first_think end as cut from (
 select p.id, km, failed as has_api_error, first_think, trim(regexp_extract(last,'<answer>(.*?)</answer>',1,'s')) as answer from traj_parts p join traj t on t.id=p.id
 where coalesce(masked,1)=0 and km<1 and t.has_image and first_think<>'' and last is not null and regexp_matches(first_think,'(?i)this is the famous') and {NAMED.format('first_think')}))""",
        "traj_parts", "traj",
    ),
)
def real_reasoning_samples(spark, sf):
    rows = D.build_notool_real(trajectories(spark, sf), SYSTEM, USER, " The scene settles it.")
    return rows.select("id", "km", "has_api_error", X.first_match(F.col("messages")[2].content, X.ANSWER).alias("answer"), F.md5(F.col("messages")[2].content).alias("digest"))


RL_JOIN = """(select m.*, t.km, t.part, t.id is null or not t.has_image as no_traj, coalesce(masked,0)<>0 and coalesce(nullif(n_tool_calls,0), n_crop_calls)=0 as no_tools, v.covered
 from metadata m left join traj t on t.id=m.id left join coverage v on v.id=m.id)"""


@query(
    "skip_counters",
    sql_with(f"select case when no_traj then 'no_trajectory' when no_tools then 'masked_no_tools' when not covered then 'no_full_coverage' else 'kept' end as reason, count(*) as n from {RL_JOIN} group by 1", "metadata", "traj", "coverage"),
)
def skip_counters(spark, sf):
    return D.skip_counts(D.tag_skips(metadata(spark, sf), trajectories(spark, sf), True))


@query(
    "rl_samples",
    sql_with(
        f"""select cast(id as string) as img_id, cast(part as string) as part, printf('%.4f, %.4f, %s, %s', latitude, longitude, coalesce(country,'Unknown'), coalesce(city,'Unknown')) as truth,
 case when km is null then 'unknown' when km<=25 then 'easy' when km<=200 then 'medium' else 'hard' end as difficulty, 'img/'||id||'_0.jpg' as image, row_number() over(order by md5('42|'||id), id)-1 as index
 from {RL_JOIN} where not no_traj and not no_tools and covered""",
        "metadata", "traj", "coverage",
    ),
)
def rl_samples(spark, sf):
    rows = D.build_rl(metadata(spark, sf), trajectories(spark, sf), SYSTEM, USER, require_full_coverage=True, drop_full_image=True, root="/data")
    info = "extra_info."
    return rows.select(
        F.col(info + "img_id").alias("img_id"), F.col(info + "part").alias("part"), F.col("reward_model.ground_truth").alias("truth"), F.col(info + "difficulty").alias("difficulty"),
        F.col("extra_info.tools_kwargs")[K.ZOOM].create_kwargs.image.alias("image"), F.col(info + "index").alias("index"),
    )


@query(
    "validation_samples",
    sql_with(
        """select cast(m.id as string) as img_id, t.km, printf('%.4f, %.4f, %s, %s', latitude, longitude, coalesce(country,'Unknown'), coalesce(city,'Unknown')) as truth, row_number() over(order by md5('42|'||m.id), m.id)-1 as index
 from metadata m join traj t on t.id=m.id where t.has_image""",
        "metadata", "traj",
    ),
)
def validation_samples(spark, sf):
    # Every trajectory was logged twice, the first time without a distance; the later one counts.
    logged = trajectories(spark, sf).withColumn("line", F.explode(F.array(F.lit(0), F.lit(1))))
    logged = logged.withColumn("km", F.when(F.col("line") == 1, F.col("km")))
    rows = D.build_val(metadata(spark, sf), logged.drop("part"), [F.col("line").desc()], SYSTEM, USER, "val")
    return rows.select(F.col("extra_info.img_id").alias("img_id"), F.col("extra_info.km").alias("km"), F.col("reward_model.ground_truth").alias("truth"), F.col("extra_info.index").alias("index"))


@query("exploded_responses", "select doc_id, cast(i-1 as int) as response_no, w[i] as response from (select doc_id, w, unnest(generate_series(1,len(w))) as i from (select doc_id, string_split(text,'. ') as w from documents))")
def exploded_responses(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.split("text", r"\. ", -1).alias("responses"))
    return D.explode_responses(rows)


def repeated(spark, sf, **how):
    return D.repeat_rows(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")), "k", **how)


@query(
    "repeated_rows",
    """select k, cast(r as int) as repeat_no, mode, row_number() over(partition by mode order by case when mode='interleave' then k else r end, case when mode='interleave' then r else k end) as place from (
 select s_suppkey as k, r, mode from supplier, range(0,3) t(r), (select 'interleave' as mode union all select 'stack'))""",
)
def repeated_rows(spark, sf):
    from trailmark.operators.ordering import BUCKETS, running

    out = None
    for mode in ("interleave", "stack"):
        rows = repeated(spark, sf, n=3, mode=mode).withColumn("mode", F.lit(mode)).withColumn("bucket", F.col("repeat_key.a") % BUCKETS)
        # The first part of the key is small here, so it is its own bucket.
        placed = running(rows.withColumn("bucket", F.col("repeat_key.a")), ["mode"], "bucket", [F.col("repeat_key.b")], {"place": F.lit(1)})
        out = placed if out is None else out.unionByName(placed)
    return out.select("k", "repeat_no", "mode", "place")


@query("repeated_by_count", "select s_suppkey as k, cast(r as int) as repeat_no from supplier, range(0,4) t(r) where r<s_suppkey%4")
def repeated_by_count(spark, sf):
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 4).alias("times"))
    return D.repeat_rows(rows, "k", counts="times").select("k", "repeat_no")


@query(
    "padded_rows",
    """select place, o_orderkey, is_pad from (select row_number() over(order by o_orderkey) as place, o_orderkey, false as is_pad from orders)
 union all select n+place, o_orderkey, true from (select row_number() over(order by o_orderkey) as place, o_orderkey, count(*) over() as n from orders) where place<=(7-n%7)%7""",
)
def padded_rows(spark, sf):
    from trailmark.operators.ordering import ranked_by_value

    rows = ranked_by_value(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", name="place")
    return D.pad_to_divisor(rows, "place", 7)


@query("unpadded_rows", "select row_number() over(order by o_orderkey) as place, o_orderkey from orders")
def unpadded_rows(spark, sf):
    return D.unpad(padded_rows(spark, sf))


@query(
    "unfolded_chunks",
    "select vec_id, label, cast(c as int) as chunk_no, round(list_sum(embedding[c*16+1:c*16+16]),4)+0.0 as total from embeddings, range(0,4) t(c)",
)
def unfolded_chunks(spark, sf):
    rows = D.unfold_chunks(table(spark, sf, "embeddings"), 4, ["embedding"])
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select("vec_id", "label", "chunk_no", (F.round(total, 4) + 0.0).alias("total"))


@query("preference_rows", "select p_partkey, 1 as label, p_name as response from part union all select p_partkey, 0, p_type from part")
def preference_rows(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("chosen"), F.col("p_type").alias("rejected"))
    return D.preference_rows(rows)


@query("appended_batch", "select doc_id, n_chars from documents union all select doc_id+1000000, n_chars from documents where len([x for x in regexp_split_to_array(text,'\\s+') if x<>''])<=100")
def appended_batch(spark, sf):
    docs = table(spark, sf, "documents")
    out = D.append_generated(docs, docs.withColumn("doc_id", F.col("doc_id") + 1000000), 100, text="text")
    return out.select("doc_id", "n_chars")


@query("batch_projection", "select o_orderkey as order_id, o_custkey as customer from (select *, row_number() over(order by o_orderkey) as k from orders) where k between 101 and 200")
def batch_projection(spark, sf):
    from trailmark.operators.sampling import rank_slice

    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").drop("o_orderstatus")
    return rank_slice(rows, "o_orderkey", 101, 200).withColumnsRenamed({"o_orderkey": "order_id", "o_custkey": "customer"})


@query("difficulty_of_samples", sql_with("select case when km is null then 'unknown' when km<=25 then 'easy' when km<=200 then 'medium' else 'hard' end as difficulty, count(*) as n from traj group by 1", "traj"))
def difficulty_of_samples(spark, sf):
    return value_counts(trajectories(spark, sf).select(G.difficulty(F.col("km")).alias("difficulty")), "difficulty")
