"""Queries that extract tables from agent messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions import constants as K
from trailmark.functions import geo as G
from trailmark.functions import text as X
from trailmark.operators import extraction as E
from trailmark.plans.fixtures import add_view, message, sql_with, table
from trailmark.plans.registry import query

add_view(
    "raw_call",
    """select conv_id, msg_idx, cast(i-1 as int) as call_no, raws[i] as raw from (
 select conv_id, msg_idx, raws, unnest(generate_series(1, len(raws))) as i from (
 select conv_id, msg_idx, regexp_extract_all(content,'<tool_call>(.*?)</tool_call>',1,'s') as raws from message where role='assistant'))
 where json_valid(raws[i])""",
    "message",
)
add_view(
    "named_call",
    """select conv_id, msg_idx, call_no, json_extract_string(raw,'$.name') as name, raw,
 cast(json_extract(raw,'$.arguments.bbox_2d') as double[]) as bbox, json_extract_string(raw,'$.arguments.query') as query from raw_call""",
    "raw_call",
)
for short, tool, mark in (("image", K.IMAGE_SEARCH, K.IMAGE_RESPONSE_MARK), ("text", K.TEXT_SEARCH, K.TEXT_RESPONSE_MARK)):
    payload = "c.bbox" if short == "image" else "c.query"
    add_view(
        f"{short}_pair",
        f"""select r.conv_id, cast(row_number() over(partition by r.conv_id order by r.resp_msg_idx)-1 as int) as call_idx,
 r.call_msg_idx, r.resp_msg_idx, {payload}, m.content as response from (
 select conv_id, call_msg_idx, min(resp) as resp_msg_idx from (
 select m.conv_id, m.msg_idx as resp, max(c.msg_idx) as call_msg_idx from message m join named_call c
 on c.conv_id=m.conv_id and c.msg_idx<m.msg_idx and c.name='{tool}' where m.role='user' and contains(m.content,'{mark}') group by 1,2)
 group by 1,2) r join named_call c on c.conv_id=r.conv_id and c.msg_idx=r.call_msg_idx and c.name='{tool}'
 join message m on m.conv_id=r.conv_id and m.msg_idx=r.resp_msg_idx""",
        "named_call",
    )
IMG_RE = r"\[(\d+)\]\s*(.*?)\n\s*Source:\s*(.*?)\n\s*Link:\s*(https?://\S+)"
add_view(
    "image_result",
    f"""select conv_id, call_idx, call_msg_idx, cast(pos[i] as int) as result_pos, trim(title[i]) as result_title, trim(link[i]) as result_link,
 trim(src[i]) as result_source from (select *, unnest(generate_series(1,len(pos))) as i from (select *,
 regexp_extract_all(response,'{IMG_RE}',1,'s') as pos, regexp_extract_all(response,'{IMG_RE}',2,'s') as title,
 regexp_extract_all(response,'{IMG_RE}',3,'s') as src, regexp_extract_all(response,'{IMG_RE}',4,'s') as link from image_pair))
 union all select conv_id, call_idx, call_msg_idx, -1, '', '', '' from image_pair where not regexp_matches(response,'{IMG_RE}','s')""",
    "image_pair",
)
# Without look-ahead the SQL side splits the response at result heads instead.
add_view(
    "text_result",
    r"""select conv_id, call_idx, call_msg_idx, result_pos, result_title, result_url, result_content from (select conv_id, call_idx, call_msg_idx,
 cast(regexp_extract(piece,'^\[(\d+)\]',1) as int) as result_pos,
 trim(regexp_extract(piece,'^\[\d+\]\s*(.*?)\nURL:',1,'s')) as result_title,
 regexp_extract(piece,'\nURL:\s*(https?://\S+)',1) as result_url,
 regexp_replace(regexp_extract(piece,'\nURL:\s*https?://\S+\n?(.*)$',1,'s'),'^\s+|\s+$','','g') as result_content,
 row_number() over(partition by conv_id, call_idx, regexp_extract(piece,'^\[(\d+)\]',1) order by i) as rn
 from (select conv_id, call_idx, call_msg_idx, i, pieces[i] as piece from (select *, unnest(generate_series(1,len(pieces))) as i from (
 select *, string_split(regexp_replace(response,'\n(\[\d+\])',chr(1)||'\1','g'),chr(1)) as pieces from text_pair)))
 where regexp_matches(piece,'^\[\d+\].*\nURL:\s*https?://','s')) where rn=1""",
    "text_pair",
)
add_view(
    "useful_tag",
    r"""select t.conv_id, t.turn_no, t.msg_idx, t.call_msg_idx, c.name as tool, indices from (
 select conv_id, msg_idx, cast(row_number() over w as int) as turn_no, lag(msg_idx) over w as call_msg_idx,
 regexp_extract(content,'<useful>\s*(\[.*?\])\s*</useful>',1,'s') as indices from message where role='assistant'
 window w as (partition by conv_id order by msg_idx)) t
 join named_call c on c.conv_id=t.conv_id and c.msg_idx=t.call_msg_idx and c.name in ('image_search_tool','text_search_tool')
 where indices<>''""",
    "named_call",
)
for short, tool in (("image", K.IMAGE_SEARCH), ("text", K.TEXT_SEARCH)):
    extra = "result_link, result_source" if short == "image" else "result_url, result_content"
    add_view(
        f"{short}_labeled",
        f"""select r.conv_id, r.call_idx, r.call_msg_idx, r.result_pos, r.result_title, {extra}, coalesce(a.turn_no,-1) as call_turn,
 coalesce(cast(a.indices as int[]),cast([] as int[])) as useful_indices,
 r.result_pos>=0 and list_contains(coalesce(cast(a.indices as int[]),cast([] as int[])), r.result_pos) as is_geo_useful
 from {short}_result r left join (select *, row_number() over(partition by conv_id order by turn_no, msg_idx)-1 as call_idx
 from useful_tag where tool='{tool}') a on a.conv_id=r.conv_id and a.call_idx=r.call_idx""",
        f"{short}_result", "useful_tag",
    )


@query("tool_call_table", sql_with("select conv_id, msg_idx, call_no, name, cast(json_extract(raw, '$.arguments') as varchar) as arguments from named_call", "named_call"))
def tool_call_table(spark, sf):
    return E.tool_calls(message(spark, sf))


@query(
    "tool_call_repair",
    sql_with(
        r"""select conv_id, msg_idx, case when conv_id%3=2 and name='text_search_tool' then 'text_search_tool'
 when conv_id%3=2 then 'image_zoom_in_tool' else name end as name,
 case when bbox is not null then cast(len(bbox) as int) end as n_box, query from named_call""",
        "named_call",
    ),
)
def tool_call_repair(spark, sf):
    # A third of the conversations lose the closing tag, a third lose name and arguments.
    body, conv = F.col("content"), F.col("conv_id")
    bare = F.regexp_replace(
        body, r'\{"name": "[a-z_]+", "arguments": (\{[^}]*\})\}', "$1"
    )
    opened = F.regexp_replace(body, "</tool_call>", " and more <text>")
    broken = F.when(conv % 3 == 1, opened).when(conv % 3 == 2, bare).otherwise(body)
    calls = E.tool_calls(message(spark, sf).withColumn("content", broken), repair=True)
    args = F.try_parse_json("arguments")
    return calls.select(
        "conv_id", "msg_idx", "name",
        F.size(F.try_variant_get(args, "$.bbox_2d", "array<double>")).alias("n_box"),
        F.try_variant_get(args, "$.query", "string").alias("query"),
    )


@query(
    "image_call_pairs",
    sql_with("select conv_id, call_idx, call_msg_idx, resp_msg_idx, bbox[1] as x1, bbox[2] as y1, bbox[3] as x2, bbox[4] as y2 from image_pair", "image_pair"),
)
def image_call_pairs(spark, sf):
    pairs = E.pair_calls(message(spark, sf), K.IMAGE_SEARCH)
    corners = {c: F.col("bbox")[i] for i, c in enumerate(("x1", "y1", "x2", "y2"))}
    return pairs.select("conv_id", "call_idx", "call_msg_idx", "resp_msg_idx", *[v.alias(c) for c, v in corners.items()])


@query("text_call_pairs", sql_with("select conv_id, call_idx, call_msg_idx, resp_msg_idx, query from text_pair", "text_pair"))
def text_call_pairs(spark, sf):
    pairs = E.pair_calls(message(spark, sf), K.TEXT_SEARCH)
    return pairs.select("conv_id", "call_idx", "call_msg_idx", "resp_msg_idx", F.array_join("queries", " | ").alias("query"))


def image_results(spark, sf):
    return E.parse_results(E.pair_calls(message(spark, sf), K.IMAGE_SEARCH), K.IMAGE_SEARCH)


def text_results(spark, sf):
    return E.parse_results(E.pair_calls(message(spark, sf), K.TEXT_SEARCH), K.TEXT_SEARCH)


@query("image_result_table", sql_with("select conv_id, call_idx, result_pos, result_title, result_link, result_source from image_result", "image_result"))
def image_result_table(spark, sf):
    return image_results(spark, sf).select("conv_id", "call_idx", "result_pos", "result_title", "result_link", "result_source")


@query("text_result_table", sql_with("select conv_id, call_idx, result_pos, result_title, result_url, result_content from text_result", "text_result"))
def text_result_table(spark, sf):
    return text_results(spark, sf).select("conv_id", "call_idx", "result_pos", "result_title", "result_url", "result_content")


@query(
    "calls_without_results",
    sql_with(
        f"""select conv_id, call_idx, -1 as result_pos from text_pair where not regexp_matches(response, '\\[(\\d+)\\]\\s*(.*?)\\nURL:\\s*https?://','s')
 or conv_id%2=0""",
        "text_pair",
    ),
)
def calls_without_results(spark, sf):
    # Half of the responses are emptied so that calls without a result occur.
    emptied = F.when(F.col("conv_id") % 2 == 0, "Web search results for: q\n\nnothing").otherwise(F.col("response"))
    pairs = E.pair_calls(message(spark, sf), K.TEXT_SEARCH).withColumn("response", emptied)
    return E.parse_results(pairs, K.TEXT_SEARCH).where("result_pos = -1").select("conv_id", "call_idx", "result_pos")


@query("useful_tag_table", sql_with("select conv_id, turn_no, msg_idx, call_msg_idx, tool, replace(indices,' ','') as indices from useful_tag", "useful_tag"))
def useful_tag_table(spark, sf):
    tags = E.useful_tags(message(spark, sf))
    return tags.withColumn("indices", F.concat(F.lit("["), F.array_join(F.col("indices").cast("array<string>"), ","), F.lit("]")))


def labeled(spark, sf, tool):
    results = image_results(spark, sf) if tool == K.IMAGE_SEARCH else text_results(spark, sf)
    return E.label_results(results, E.useful_tags(message(spark, sf)), tool)


@query(
    "labeled_image_results",
    sql_with("select conv_id, call_idx, result_pos, cast(len(useful_indices) as int) as n_useful, call_turn, is_geo_useful from image_labeled", "image_labeled"),
)
def labeled_image_results(spark, sf):
    return labeled(spark, sf, K.IMAGE_SEARCH).select("conv_id", "call_idx", "result_pos", "n_useful", "call_turn", "is_geo_useful")


@query(
    "labeled_text_results",
    sql_with("select conv_id, call_idx, result_pos, cast(len(useful_indices) as int) as n_useful, call_turn, is_geo_useful from text_labeled", "text_labeled"),
)
def labeled_text_results(spark, sf):
    return labeled(spark, sf, K.TEXT_SEARCH).select("conv_id", "call_idx", "result_pos", "n_useful", "call_turn", "is_geo_useful")


NEXT_THINK = """select c.conv_id, c.name as tool, c.call_msg_idx, r.resp_msg_idx, c.query,
 coalesce((select arg_min(regexp_replace(regexp_extract(m.content,'<think>(.*?)</think>',1,'s'),'^\\s+|\\s+$','','g'), m.msg_idx)
 from message m where m.conv_id=c.conv_id and m.role='assistant' and m.msg_idx>r.resp_msg_idx),'') as next_think,
 (select m.content from message m where m.conv_id=c.conv_id and m.msg_idx=r.resp_msg_idx) as response
 from (select conv_id, name, msg_idx as call_msg_idx, coalesce(query,'') as query,
 coalesce(lead(msg_idx) over(partition by conv_id order by msg_idx),1000000) as next_call from named_call
 where name in ('image_search_tool','text_search_tool')) c
 join lateral (select min(m.msg_idx) as resp_msg_idx from message m where m.conv_id=c.conv_id and m.role='user'
 and m.msg_idx>c.call_msg_idx and m.msg_idx<c.next_call and contains(m.content,
 case when c.name='image_search_tool' then 'Image search results' else 'Web search results' end)) r on true
 where r.resp_msg_idx is not null"""
add_view("next_think", NEXT_THINK, "named_call")


@query("calls_with_next_think", sql_with("select conv_id, tool, call_msg_idx, resp_msg_idx, query, next_think from next_think", "next_think"))
def calls_with_next_think(spark, sf):
    return E.calls_with_next_think(message(spark, sf)).select(
        "conv_id", "tool", "call_msg_idx", "resp_msg_idx", "query", "next_think"
    )


PHRASES = ", ".join("'" + p + "'" for p in K.NO_RESULT_PHRASES)
REFS = f"""case when next_think='' then null when list_bool_or([contains(lower(next_think),p) for p in [{PHRASES}]]) then cast([] as int[])
 else nullif(list_sort(list_distinct([x for x in cast(regexp_extract_all(next_think,'\\[(\\d+)\\]',1) as int[]) if x>=1 and x<=n_results])),cast([] as int[])) end"""
add_view(
    "think_ref",
    f"""select *, {REFS} as refs from (select *, cast(len(regexp_extract_all(response,'\\[(\\d+)\\]',1)) - case when tool='image_search_tool' then 0 else 0 end as int) as n_results from next_think)""",
    "next_think",
)


@query("think_references", sql_with("select conv_id, call_msg_idx, tool, array_to_string(refs,',') as refs from think_ref", "think_ref"))
def think_references(spark, sf):
    calls = E.calls_with_next_think(message(spark, sf))
    refs = X.think_refs(F.col("next_think"), F.col("n_results"))
    return calls.select("conv_id", "call_msg_idx", "tool", F.array_join(refs.cast("array<string>"), ",").alias("refs"))


PRED = r"""case when n>=2 and lat is not null and lon is not null and not (lat=0 and lon=0) then {c} end"""


@query(
    "predicted_coordinates",
    sql_with(
        f"""select conv_id, msg_idx, {PRED.format(c='lat')} as lat, {PRED.format(c='lon')} as lon from (select conv_id, msg_idx, len(f) as n,
 try_cast(trim(f[-2]) as double) as lat, try_cast(trim(f[-1]) as double) as lon from (select conv_id, msg_idx,
 string_split(regexp_extract_all(content,'<answer>(.*?)</answer>',1,'s')[-1],',') as f from message where role='assistant'))""",
        "message",
    ),
)
def predicted_coordinates(spark, sf):
    rows = message(spark, sf).where("role = 'assistant'").withColumn("p", G.parse_pred(F.col("content")))
    return rows.select("conv_id", "msg_idx", "p.lat", "p.lon")


@query(
    "reward_coordinates",
    sql_with(
        r"""select conv_id, msg_idx, p[-1].lat as lat, p[-1].lon as lon from (select conv_id, msg_idx,
 [x for x in [{'lat': cast(regexp_extract(h,'([-+]?\d+(?:\.\d+)?)\s*,\s*([-+]?\d+(?:\.\d+)?)',1) as double), 'lon': cast(regexp_extract(h,'([-+]?\d+(?:\.\d+)?)\s*,\s*([-+]?\d+(?:\.\d+)?)',2) as double)}
 for h in regexp_extract_all(scope,'[(\[]?\s*([-+]?\d+(?:\.\d+)?)\s*,\s*([-+]?\d+(?:\.\d+)?)\s*[)\]]?',0)] if x.lat between -90 and 90 and x.lon between -180 and 180] as p
 from (select conv_id, msg_idx, case when regexp_matches(content,'<answer>(.*?)</answer>','s') then regexp_extract(content,'<answer>(.*?)</answer>',1,'s') else content end as scope from message))""",
        "message",
    ),
)
def reward_coordinates(spark, sf):
    rows = message(spark, sf).withColumn("p", G.parse_coords(F.col("content")))
    return rows.select("conv_id", "msg_idx", "p.lat", "p.lon")


@query(
    "output_rounds",
    sql_with(
        r"""select conv_id, msg_idx, cast(i-1 as int) as round_no, md5(p) as round_md5 from (select conv_id, msg_idx, unnest(generate_series(1,len(ps))) as i, unnest(ps) as p from (
 select conv_id, msg_idx, [x for x in [regexp_replace(y,'^\s+|\s+$','','g') for y in string_split(replace(content,'<tool_call>',chr(1)||'<tool_call>'),chr(1))] if x<>''] as ps
 from message where contains(content,'<tool_call>')))""",
        "message",
    ),
)
def output_rounds(spark, sf):
    return E.split_rounds(message(spark, sf)).select("conv_id", "msg_idx", "round_no", F.md5("round").alias("round_md5"))


@query(
    "zoom_boxes",
    sql_with("select conv_id, msg_idx, bbox[1] as x1, bbox[4] as y2, '' as label from named_call where name='image_search_tool'", "named_call"),
)
def zoom_boxes(spark, sf):
    # The image calls of the fixture are renamed to zoom calls.
    renamed = F.replace(F.col("content"), F.lit('"image_search_tool"'), F.lit('"image_zoom_in_tool"'))
    boxes = E.zoom_bboxes(message(spark, sf).withColumn("content", renamed))
    return boxes.select("conv_id", "msg_idx", F.col("bbox")[0].alias("x1"), F.col("bbox")[3].alias("y2"), "label")


@query(
    "city_mentions",
    sql_with(
        r"""select conv_id, msg_idx, regexp_matches(content,'(?i)\bcity\b') as city, regexp_matches(content,'(?i)\btitle\b') as title from message""",
        "message",
    ),
)
def city_mentions(spark, sf):
    rows = message(spark, sf)
    return rows.select(
        "conv_id", "msg_idx", X.mentions(F.col("content"), F.lit("City")).alias("city"),
        X.mentions(F.col("content"), F.lit("title")).alias("title"),
    )


CONFIDENT = K.CONFIDENCE_PATTERN.replace("'", "''")


@query("confidence_phrases", f"select doc_id, cast(len(regexp_extract_all(text||' '||case when doc_id%3=0 then 'This is the famous place, I recognize it' else '' end,'(?i){CONFIDENT}')) as int) as n from documents")
def confidence_phrases(spark, sf):
    tail = F.when(F.col("doc_id") % 3 == 0, "This is the famous place, I recognize it").otherwise("")
    text = F.concat("text", F.lit(" "), tail)
    return table(spark, sf, "documents").select("doc_id", X.confidence_count(text).alias("n"))


CUE = K.TOOL_INTENT_PATTERN.replace("'", "''")
CLOSING = " The scene alone settles the place."
LAST_CLOSING = " No search result was of use; the scene alone settles the place."
TAILS = ", ".join("'" + w + "'" for w in K.CONFIDENT_TAIL_WORDS)
STRIP = r"regexp_replace({0},'^\s+|\s+$','','g')"


@query(
    "truncate_reasoning",
    f"""select doc_id, cast(length(out) as int) as n, md5(out) as digest from (select doc_id, {STRIP.format(f"case when list_bool_or([contains(lower(right(cut,200)),w) for w in [{TAILS}]]) then cut else cut||'{CLOSING}' end")} as out
 from (select doc_id, case when regexp_matches(t,'(?i){CUE}') then regexp_replace(regexp_extract(t,'(?is)^(.*?){CUE.replace("|^)", "|^)", 1)}',1),'[ .]+$','')||'.' else t end as cut
 from (select doc_id, text||case when doc_id%2=0 then '. Let me search for it now. Later' else '' end as t from documents)))""",
)
def truncate_reasoning(spark, sf):
    tail = F.when(F.col("doc_id") % 2 == 0, ". Let me search for it now. Later").otherwise("")
    cut = X.truncate_think(F.concat("text", tail), CLOSING)
    return table(spark, sf, "documents").select("doc_id", F.length(cut).alias("n"), F.md5(cut).alias("digest"))


@query(
    "trim_closing_reasoning",
    f"""select doc_id, case when regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])the($|[^\\p{{L}}\\p{{N}}_])') then
 md5(case when contains(lower(cut),'no tool') or contains(lower(cut),'without') then cut
 else cut||'{LAST_CLOSING}' end) end as digest from (
 select doc_id, text, {STRIP.format("regexp_replace(text,'[ .\\n]+$','')||'.'")} as cut from documents)""",
)
def trim_closing_reasoning(spark, sf):
    text = F.concat("text", F.lit("\nLet me check this. More"))
    return table(spark, sf, "documents").select("doc_id", F.md5(X.trim_closing(text, F.lit("the"), LAST_CLOSING)).alias("digest"))


@query(
    "normalized_queries",
    sql_with(
        """select conv_id, msg_idx, query||' | '||name as joined, query as single from named_call where name='text_search_tool'""",
        "named_call",
    ),
)
def normalized_queries(spark, sf):
    calls = E.tool_calls(message(spark, sf)).where(F.col("name") == K.TEXT_SEARCH)
    single = F.try_variant_get(F.try_parse_json("arguments"), "$.query", "string")
    listed = F.to_json(F.array(single, F.col("name")))
    return calls.select("conv_id", "msg_idx", X.norm_query(listed).alias("joined"), X.norm_query(single).alias("single"))


@query(
    "image_placeholders",
    """select conv_id, turn as msg_idx, cast(case when turn%2=0 then conv_id%5 end as int) as image_id,
 md5(case when turn%2=0 then '<image>'||' '||text else text end) as digest from conversations""",
)
def image_placeholders(spark, sf):
    raw = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<image>\nimage_id: "), (F.col("conv_id") % 5).cast("string"), F.lit(" "), "text")).otherwise(F.col("text"))
    rows = table(spark, sf, "conversations").withColumn("raw", raw)
    return rows.select(
        "conv_id", F.col("turn").alias("msg_idx"), X.image_id(F.col("raw")).alias("image_id"),
        F.md5(X.strip_image_ids(F.col("raw"))).alias("digest"),
    )


def media_messages(spark, sf):
    marked = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<image>"), "text", F.lit("<video>"))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("msg_idx"), "role", marked.alias("content"))


@query(
    "media_segments",
    """select conv_id, msg_idx, cast(row_number() over(partition by conv_id, msg_idx order by k)-1 as int) as seg_no, kind,
 cast(case when kind<>'text' then sum(case when kind<>'text' then 1 else 0 end) over(partition by conv_id, kind order by msg_idx, k)-1 end as int) as media_offset from (
 select conv_id, turn as msg_idx, 0 as k, 'image' as kind from conversations where turn%2=0
 union all select conv_id, turn, 1, 'text' from conversations where text<>''
 union all select conv_id, turn, 2, 'video' from conversations where turn%2=0)""",
)
def media_segments(spark, sf):
    return E.segment_media(media_messages(spark, sf)).select("conv_id", "msg_idx", "seg_no", "kind", "media_offset")


@query(
    "media_count_check",
    "select conv_id, count(case when turn%2=0 then 1 end) as n_placeholders, count(case when turn%2=0 then 1 end) as n_media from conversations group by 1",
)
def media_count_check(spark, sf):
    media = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.when(F.col("turn") % 2 == 0, 1)).alias("n_media"))
    return E.check_media_counts(E.segment_media(media_messages(spark, sf)), media)


@query(
    "rendered_image_results",
    sql_with(
        """select conv_id, call_idx, string_agg('['||result_pos||'] '||result_title||chr(10)||'    Source: '||result_source||chr(10)||'    Link: '||result_link, chr(10) order by result_pos) as text
 from image_result where result_pos>=0 group by 1,2""",
        "image_result",
    ),
)
def rendered_image_results(spark, sf):
    return E.render_results(image_results(spark, sf), "image")


@query(
    "rendered_web_results",
    sql_with(
        """select conv_id, call_idx, string_agg('['||result_pos||'] '||result_title||chr(10)||'URL: '||result_url||chr(10)||result_content||chr(10), chr(10) order by result_pos) as text
 from text_result where result_pos>=0 group by 1,2""",
        "text_result",
    ),
)
def rendered_web_results(spark, sf):
    return E.render_results(text_results(spark, sf), "web")


@query(
    "rendered_text_results",
    sql_with(
        """select conv_id, call_idx, string_agg('['||shown||'] '||result_title||chr(10)||'    URL: '||result_url||chr(10)||'    '||result_content, chr(10) order by shown) as text
 from (select *, row_number() over (partition by conv_id, call_idx order by -result_pos) as shown from text_result where result_pos>=0) group by 1,2""",
        "text_result",
    ),
)
def rendered_text_results(spark, sf):
    # Shown from last to first: the numbers follow the page, not the stored positions.
    results = text_results(spark, sf).withColumn("shown_at", -F.col("result_pos"))
    return E.render_results(results, "text", "shown_at", content_chars=None)


@query(
    "rendered_passages",
    sql_with(
        """select conv_id, call_idx, string_agg('Doc '||result_pos||' (Title: '||result_title||')'||chr(10)||result_content, chr(10)||chr(10) order by result_pos) as text
 from text_result where result_pos>=0 group by 1,2""",
        "text_result",
    ),
)
def rendered_passages(spark, sf):
    return E.render_results(text_results(spark, sf), "passage")


@query(
    "linearized_conversations",
    sql_with(
        r"""select conv_id, md5(string_agg(case when role='assistant' then 'Assistant: '||regexp_replace(regexp_replace(content,'<tool_call>.*?</tool_call>','','gs'),'^\s+|\s+$','','g')
 else 'User: '||content end, chr(10) order by msg_idx) filter (where role<>'system')) as digest, max(content) filter (where role='system') as system from message group by 1""",
        "message",
    ),
)
def linearized_conversations(spark, sf):
    out = E.linearize(message(spark, sf))
    return out.select("conv_id", F.md5("text").alias("digest"), "system")


@query(
    "turn_flags",
    sql_with(
        r"""select conv_id, msg_idx, turn_no, has_answer, has_call, not has_call and not has_answer and contains(content,'</think>') and turn_no<3 as truncated,
 has_call and turn_no=3 as turn_limit from (select m.*, cast(row_number() over(partition by conv_id order by msg_idx) as int) as turn_no,
 regexp_matches(content,'<answer>(.*?)</answer>','s') as has_answer,
 exists(select 1 from raw_call c where c.conv_id=m.conv_id and c.msg_idx=m.msg_idx) as has_call from message m where role='assistant')""",
        "raw_call",
    ),
)
def turn_flags(spark, sf):
    return E.turn_flags(message(spark, sf), 3)


@query(
    "content_normalization",
    sql_with("select conv_id, msg_idx, md5(role||' '||content) as spaced, md5(role||chr(10)||content) as lined, md5(content) as plain from message", "message"),
)
def content_normalization(spark, sf):
    part = F.struct(F.lit("text").alias("type"), F.col("content").alias("text"))
    parts = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("role").alias("text")), part))
    rows = message(spark, sf).withColumn("parts", parts)
    return rows.select(
        "conv_id", "msg_idx", F.md5(X.content_text(F.col("parts"))).alias("spaced"),
        F.md5(X.content_text(F.col("parts"), "\n")).alias("lined"), F.md5(X.content_text(F.col("content"))).alias("plain"),
    )


@query(
    "first_image_path",
    "select page_id, case page_id%3 when 2 then '' else url end as path from pages",
)
def first_image_path(spark, sf):
    url = F.col("url")
    images = (
        F.when(F.col("page_id") % 3 == 0, F.to_json(F.array(url)))
        .when(F.col("page_id") % 3 == 1, F.to_json(F.array(F.struct(url.alias("image_url")))))
        .otherwise("[]")
    )
    return table(spark, sf, "pages").select("page_id", X.first_image(images).alias("path"))


def existing_annotations(spark, sf):
    # Only the text searches are annotated so far.
    tags = E.useful_tags(message(spark, sf)).where(F.col("tool") == K.TEXT_SEARCH)
    return tags.select("conv_id", "tool", "call_msg_idx", "indices")


EXISTING = "(select conv_id, tool, call_msg_idx, indices from useful_tag where tool='text_search_tool')"


def labeler_for(spark, sf):
    truth = table(spark, sf, "conversations").select("conv_id").distinct().select(
        "conv_id", F.lit("Nowhere").alias("country"), F.concat(F.lit("Title "), F.col("conv_id").cast("string")).alias("city")
    )

    def label(calls):
        page = F.inline(
            F.transform(X.image_results(F.col("response")), lambda r: F.struct(r.pos.alias("result_pos"), F.concat(r.title, F.lit(" "), r.source).alias("evidence")))
        )
        rows = calls.where(F.col("tool") == K.IMAGE_SEARCH).select("conv_id", "tool", "call_msg_idx", page)
        return E.rule_labeler(rows, truth)

    return label


@query(
    "rule_labels",
    sql_with(
        "select conv_id, tool, call_msg_idx, '1' as labeled from next_think where tool='image_search_tool'", "next_think"
    ),
)
def rule_labels(spark, sf):
    out = labeler_for(spark, sf)(E.calls_with_next_think(message(spark, sf)))
    return out.withColumn("labeled", F.array_join(F.col("labeled").cast("array<string>"), ","))


@query(
    "backfilled_labels",
    sql_with(
        f"""select conv_id, tool, call_msg_idx, replace(replace(replace(indices,' ',''),'[',''),']','') as indices, 'existing' as method from {EXISTING}
 union all select t.conv_id, t.tool, t.call_msg_idx, case when n_results=0 then '' when refs is not null then array_to_string(refs,',')
 when t.tool='image_search_tool' then '1' else '' end, case when n_results=0 then 'empty_results' when refs is null then 'labeler' when len(refs)=0 then 'think_empty' else 'think' end
 from think_ref t left join {EXISTING} e on e.conv_id=t.conv_id and e.tool=t.tool and e.call_msg_idx=t.call_msg_idx where e.conv_id is null""",
        "think_ref", "useful_tag",
    ),
)
def backfilled_labels(spark, sf):
    out = E.backfill_labels(message(spark, sf), existing_annotations(spark, sf), labeler_for(spark, sf))
    return out.withColumn("indices", F.array_join(F.col("indices").cast("array<string>"), ","))


@query(
    "backfill_plan",
    sql_with(
        f"""select cast(c.conv_id%3 as int) as part, count(*) as n_entries, count(case when need>0 then 1 end) as n_need,
 cast(coalesce(sum(n_think),0) as bigint) as n_think, cast(coalesce(sum(need-n_think),0) as bigint) as n_labeler
 from (select distinct conv_id from conversations) c left join (select t.conv_id, count(*) as need, count(refs) as n_think from think_ref t left join {EXISTING} e
 on e.conv_id=t.conv_id and e.tool=t.tool and e.call_msg_idx=t.call_msg_idx where e.conv_id is null group by 1) n on n.conv_id=c.conv_id group by 1""",
        "think_ref", "useful_tag",
    ),
)
def backfill_plan(spark, sf):
    return E.backfill_plan(message(spark, sf), existing_annotations(spark, sf), (F.col("conv_id") % 3).cast("int"))


@query(
    "label_coverage",
    sql_with(
        """select count(*) as n, count(case when k>0 then 1 end) as n_labeled, round(avg(case when k>0 then 1.0 else 0.0 end),6) as coverage from (
 select m.conv_id, (select count(*) from useful_tag u where u.conv_id=m.conv_id) as k from (select distinct conv_id from message) m)""",
        "useful_tag",
    ),
)
def label_coverage(spark, sf):
    counts = E.useful_tags(message(spark, sf)).groupBy("conv_id").agg(F.count(F.lit(1)).alias("k"))
    rows = message(spark, sf).select("conv_id").distinct().join(counts, "conv_id", "left")
    labeled_row = F.coalesce(F.col("k") > 0, F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(labeled_row, 1)).alias("n_labeled"),
        F.round(F.avg(labeled_row.cast("double")), 6).alias("coverage"),
    )
