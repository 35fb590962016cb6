"""Queries on answer scores and composed rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions import answers as A
from trailmark.functions import constants as K
from trailmark.functions import geo as G
from trailmark.operators import rewards as R
from trailmark.plans.fixtures import add_view, message, rollout, sql_with, table, token
from trailmark.plans.registry import query
from trailmark.plans.search import call_metas


def replies(spark, sf):
    """Assistant messages beside a truth a few kilometres to a continent away; some truths are text."""
    conv, turn = F.col("conv_id"), F.col("msg_idx")
    lat = (conv * 7 % 80).cast("double") + 0.5 + (turn % 5) * 0.4
    lon = (conv * 13 % 170).cast("double") + 0.25
    truth = F.when(conv % 12 == 5, "somewhere").otherwise(F.concat(lat.cast("string"), F.lit(", "), lon.cast("string"), F.lit(", Country, City")))
    return message(spark, sf).where("role = 'assistant'").withColumn("truth", truth)


add_view(
    "reply",
    """select conv_id, msg_idx, content, case when conv_id%12=5 then null else cast((conv_id*7)%80 as double)+0.5+(msg_idx%5)*0.4 end as g_lat, cast((conv_id*13)%170 as double)+0.25 as g_lon,
 case when contains(content,'<answer>') then cast((conv_id*7)%80 as double)+0.5 end as p_lat, cast((conv_id*13)%170 as double)+0.25 as p_lon,
 case when regexp_matches(content,'<think>.*</think>.*<answer>.*</answer>','s') then case when regexp_matches(content,'<useful>\\s*\\[.*?\\]\\s*</useful>','s') then 1.0 else 0.8 end else 0.0 end as fmt
 from message where role='assistant'""",
    "message",
)
# Calls hold a box of four numbers, whose last pair in range the reward parser also reads.
add_view(
    "scored_reply",
    r"""select *, case when g_lat is null then 0.0 when km is null then 0.0 when km<=1 then 1.0 when km<=25 then 1.0-(km-1)/24*0.2 when km<=200 then 0.8-(km-25)/175*0.2 when km<=750 then 0.6-(km-200)/550*0.2 when km<=2500 then 0.4-(km-750)/1750*0.2 else 0.0 end as acc from (
 select *, 2*6371.0*asin(sqrt(case when h>1 then 1.0 else h end)) as km from (select *, pow(sin(radians(g_lat-q_lat)/2),2)+cos(radians(q_lat))*cos(radians(g_lat))*pow(sin(radians(g_lon-q_lon)/2),2) as h from (
 select r.*, p[-1].lat as q_lat, p[-1].lon as q_lon from reply r join (select conv_id, msg_idx, [x for x in [{'lat': cast(regexp_extract(h,'([-+]?\d+(?:\.\d+)?)\s*,\s*([-+]?\d+(?:\.\d+)?)',1) as double), 'lon': cast(regexp_extract(h,'([-+]?\d+(?:\.\d+)?)\s*,\s*([-+]?\d+(?:\.\d+)?)',2) as double)}
 for h in regexp_extract_all(case when contains(content,'<answer>') then regexp_extract(content,'<answer>(.*?)</answer>',1,'s') else content end,'[(\[]?\s*([-+]?\d+(?:\.\d+)?)\s*,\s*([-+]?\d+(?:\.\d+)?)\s*[)\]]?',0)] if x.lat between -90 and 90 and x.lon between -180 and 180] as p from reply) using (conv_id, msg_idx))))""",
    "reply",
)
FLAGS_SQL = ", ".join(f"cast(coalesce(km<={t},false) as int) as acc_{t}km" for t in K.KM_THRESHOLDS)


def geo_scored_replies(spark, sf):
    return R.geo_score(replies(spark, sf), "content", "truth")


@query(
    "geo_reward",
    sql_with(f"select conv_id, msg_idx, round(cast(acc as double),6) as acc, cast(fmt as double) as format, case when g_lat is not null then round(km,3) end as km, {FLAGS_SQL} from scored_reply", "scored_reply"),
)
def geo_reward(spark, sf):
    out = geo_scored_replies(spark, sf)
    return out.select("conv_id", "msg_idx", F.round("acc", 6).alias("acc"), "format", "km", *[f"acc_{t}km" for t in K.KM_THRESHOLDS])


@query("format_score", sql_with("select conv_id, msg_idx, cast(fmt as double) as format from reply", "reply"))
def format_score(spark, sf):
    return replies(spark, sf).select("conv_id", "msg_idx", G.format_score(F.col("content")).alias("format"))


@query("blended_score", sql_with("select conv_id, msg_idx, round(cast(0.9*acc+0.1*fmt as double),6) as score from scored_reply", "scored_reply"))
def blended_score(spark, sf):
    score = R.blended_score(F.col("acc"), F.col("format"))
    return geo_scored_replies(spark, sf).select("conv_id", "msg_idx", F.round(score, 6).alias("score"))


def samples(spark, sf):
    """One sample per conversation: its last reply."""
    scored = geo_scored_replies(spark, sf)
    return scored.groupBy("conv_id").agg(F.max_by("acc", "msg_idx").alias("acc"), F.max_by("format", "msg_idx").alias("format"))


COMPOSED = """(select s.conv_id, acc, fmt, coalesce(greatest(-0.5,least(1.0,t)),0.0) as tool from (select conv_id, arg_max(acc,msg_idx) as acc, arg_max(fmt,msg_idx) as fmt from scored_reply group by 1) s
 left join (select conv_id, sum(reward) as t from call_meta group by 1) c on c.conv_id=s.conv_id)"""


@query(
    "composite_reward",
    sql_with(f"select conv_id, round(cast(tool as double),6)+0.0 as tool, round(cast(0.6*acc+0.1*fmt+0.3*tool as double),6)+0.0 as final_reward, round(cast(0.6*acc+0.3*tool as double),6)+0.0 as compat_reward from {COMPOSED}", "scored_reply", "call_meta"),
)
def composite_reward(spark, sf):
    rows, calls = samples(spark, sf), call_metas(spark, sf)
    out = R.composite_reward(rows, calls, "conv_id")
    compat = R.composite_reward(rows, calls, "conv_id", compat=True).select("conv_id", F.col("final_reward").alias("compat_reward"))
    joined = out.join(compat, "conv_id")
    return joined.select("conv_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("tool", "final_reward", "compat_reward")])


@query(
    "placed_rewards",
    sql_with(
        """select k.sample_id, k.t, round(case when k.t=e.n then case when h.has then 0.6*0.5+0.1*e.fmt else 0.25 end else 0.0 end+coalesce(0.3*u.s,0.0),6)+0.0 as placed_reward from token k
 join (select sample_id, max(t) as n, 0.8 as fmt from token group by 1) e on e.sample_id=k.sample_id
 left join (select distinct sample_id, true as has from token where value_est>=0.9) h on h.sample_id=k.sample_id
 left join (select sample_id, t, greatest(-0.5,least(1.0,value_est*2-0.9)) as s from token where value_est>=0.9) u on u.sample_id=k.sample_id and u.t=k.t""",
        "token",
    ),
)
def placed_rewards(spark, sf):
    tok = token(spark, sf)
    rows = tok.select("sample_id").distinct().select("sample_id", F.lit(0.5).alias("acc"), F.lit(0.8).alias("format"), F.lit(0.25).alias("final_reward"))
    turns = tok.where("value_est >= 0.9").select("sample_id", "t", (F.col("value_est") * 2 - 0.9).alias("tool_sum"))
    out = R.place_rewards(tok, rows, turns)
    return out.select("sample_id", "t", (F.round("placed_reward", 6) + 0.0).alias("placed_reward"))


def answers(spark, sf):
    """Solutions over the documents: with an answer block, two of them, many tags, or none."""
    doc = F.col("doc_id")
    block = F.concat(F.lit("<answer> The "), "source", F.lit(". </answer>"))
    text = (
        F.when(doc % 5 == 0, F.col("text"))
        .when(doc % 5 == 1, F.concat("text", F.lit("<answer>x</answer>"), block))
        .when(doc % 5 == 2, F.concat("text", F.repeat(F.lit("<answer>"), 12), F.lit("</answer>"), block))
        .when(doc % 5 == 3, F.concat("text", F.lit("<answer>wrong</answer>")))
        .otherwise(F.concat("text", block))
    )
    return table(spark, sf, "documents").select("doc_id", "source", text.alias("solution"))


@query("qa_exact_match", "select doc_id, cast(case doc_id%5 when 0 then 0 when 1 then 1 when 2 then 0.25 when 3 then 0 else 1 end as double) as score from documents")
def qa_exact_match(spark, sf):
    golden = F.array(F.lit("nothing"), F.concat(F.upper("source"), F.lit("!")))
    return answers(spark, sf).select("doc_id", A.qa_exact(F.col("solution"), golden).alias("score"))


@query("qa_substring_match", "select doc_id, cast(case doc_id%5 when 0 then 0 when 3 then 0.1 else 1 end as double) as score from documents")
def qa_substring_match(spark, sf):
    golden = F.array(F.substr("source", F.lit(1), F.lit(3)))
    score = A.qa_contains(F.col("solution"), golden, format_score=0.1)
    return answers(spark, sf).select("doc_id", score.alias("score"))


@query(
    "normalized_answers",
    r"""select doc_id, md5(trim(regexp_replace(regexp_replace(translate(lower(text),'!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~',''),'(^|[^\p{L}\p{N}_])(a|an|the)(($|[^\p{L}\p{N}_])(a|an|the))*($|[^\p{L}\p{N}_])',' ','g'),'\s+',' ','g'))) as digest from documents""",
)
def normalized_answers(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(A.normalize_answer(F.col("text"))).alias("digest"))


NUMBERED = "right(text||' so 12, then #### '||case when doc_id%3=0 then '1,234' when doc_id%3=1 then cast(doc_id%7 as string) else '.' end||' end',300)"


@query(
    "numeric_answers",
    rf"""select doc_id, cast(case when strict='1234' then 1 else 0 end as double) as score, strict, flexible from (select doc_id,
 replace(regexp_extract_all({NUMBERED},'#### (\-?[0-9\.\,]+)',1)[-1],',','') as strict, [x for x in regexp_extract_all({NUMBERED},'(\-?[0-9\.\,]+)',1) if x not in ('','.')][-1] as flexible from documents)""",
)
def numeric_answers(spark, sf):
    doc = F.col("doc_id")
    number = F.when(doc % 3 == 0, "1,234").when(doc % 3 == 1, (doc % 7).cast("string")).otherwise(".")
    text = F.concat("text", F.lit(" so 12, then #### "), number, F.lit(" end"))
    return table(spark, sf, "documents").select(
        "doc_id", A.number_score(text, F.lit("1234")).alias("score"), A.final_number(text).alias("strict"), A.final_number(text, "flexible").alias("flexible")
    )


def math_sql(text):
    out = f"string_split({text},'=')[-1]"
    for before, after in K.MATH_SUBSTITUTIONS + [(r, "") for r in K.MATH_REMOVED]:
        parts = "||chr(10)||".join("'" + p.replace("'", "''") + "'" for p in before.split("\n"))
        out = f"replace({out},{parts},'{after}')"
    for pattern, new in [
        (r"(.*?)(\$)(.*?)(\$)(.*)", r"$\3$"), (r"(\\text\{)(.*?)(\})", r"\2"), (r"(\\textbf\{)(.*?)(\})", r"\2"),
        (r"(\\overline\{)(.*?)(\})", r"\2"), (r"(\\boxed\{)(.*)(\})", r"\2"), (r"(frac)([^{])(.)", r"frac{\2}{\3}"), (r"(sqrt)([^{])", r"sqrt{\2}"),
    ]:
        out = f"regexp_replace({out},'{pattern}','{new}','g')"
    return f"replace({out},'$','')"


FORMS = ["x = 3 units", "$\\\\frac12$ cm", "12,345 dollars", "\\\\boxed{7} points", "\\\\text{an apple}"]
FORM_SQL = "[" + ", ".join("'" + f.replace("\\\\", "\\") + "'" for f in FORMS) + "][1+doc_id%5]"
PREDICTED = math_sql(f"regexp_extract_all(right(text||chr(10)||'Answer: 1'||chr(10)||'answer : '||{FORM_SQL}||chr(10)||'done',300),'(?i)Answer\\s*:\\s*([^\\n]+)',1)[-1]")


@query(
    "math_answer_line",
    f"""select doc_id, prediction, cast(case when prediction=truth then 1 else -1 end as double) as score from (select doc_id, trim(case when regexp_full_match(replace(p,',',''),'\\d+') then replace(p,',','') else p end) as prediction,
 ['3','\\frac{{1}}{{2}}','12345','8','apple'][1+doc_id%5] as truth from (select doc_id, {PREDICTED} as p from documents))""",
)
def math_answer_line(spark, sf):
    slot = (F.col("doc_id") % 5 + 1).cast("int")
    form = F.element_at(F.array(*[F.lit(f.replace("\\\\", "\\")) for f in FORMS]), slot)
    truth = F.element_at(F.array(*[F.lit(t) for t in ("3", "\\frac{1}{2}", "12345", "8", "apple")]), slot)
    text = F.concat("text", F.lit("\nAnswer: 1\nanswer : "), form, F.lit("\ndone"))
    return table(spark, sf, "documents").select("doc_id", A.math_line_prediction(text).alias("prediction"), A.math_line_score(text, truth).alias("score"))


BOXES = [
    ("\\boxed{\\dfrac{1}{2}}", "0.5"), ("\\boxed{\\frac12}", "1/2"), ("\\boxed{x=\\left( 3,4 \\right)}", "(3,4)"), ("\\boxed{\\sqrt3}", "\\sqrt{3}"),
    ("\\boxed{5 \\text{ cm}}", "5"), ("\\boxed{\\frac{a}{b}}", "\\frac{b}{a}"), ("\\boxed{unclosed", "unclosed"), ("no box", "no box"), ("\\boxed 7$ and", "7"),
]
BOX_SCORES = [1, 1, 1, 1, 1, 0, 0, 0, 1]


def boxed(spark, sf):
    slot = (F.col("doc_id") % len(BOXES) + 1).cast("int")
    form = F.element_at(F.array(*[F.lit(b) for b, _ in BOXES]), slot)
    # Text between dollar signs would end a spaced box early, so the text comes first.
    plain = F.regexp_replace("text", r"[\\$]", "")
    return table(spark, sf, "documents").select(
        "doc_id", F.concat(plain, F.lit(" "), form).alias("solution"), F.element_at(F.array(*[F.lit(t) for _, t in BOXES]), slot).alias("truth")
    )


@query("math_boxed_answer", f"select doc_id, cast({BOX_SCORES}[1+doc_id%9] as double) as score from documents")
def math_boxed_answer(spark, sf):
    return boxed(spark, sf).select("doc_id", A.math_boxed_score(F.col("solution"), F.col("truth")).alias("score"))


@query("math_strict_box", "select doc_id, cast(case when doc_id%9 in (0,1,2,3,4,5) and false then 1 else -1 end as double) as score, cast(case when doc_id%9 in (0,1,2,3,4,5) then 1 else -1 end as double) as own from documents")
def math_strict_box(spark, sf):
    inner = F.element_at(F.array(*[F.lit(b.replace("\\boxed{", "", 1)[:-1]) for b, _ in BOXES]), (F.col("doc_id") % len(BOXES) + 1).cast("int"))
    return boxed(spark, sf).select(
        "doc_id", A.strict_box_score(F.col("solution"), F.lit("never")).alias("score"), A.strict_box_score(F.col("solution"), inner).alias("own")
    )


@query(
    "dispatched_scores",
    "select doc_id, cast(case doc_id%4 when 0 then case when doc_id%3=0 then 1 else 0 end when 1 then 1 when 2 then -1 else 0 end as double) as score from documents",
)
def dispatched_scores(spark, sf):
    doc = F.col("doc_id")
    sources = F.array(F.lit("openai/gsm8k"), F.lit("lighteval/MATH"), F.lit("aime2024"), F.lit("searchR1_nq"))
    number = F.when(doc % 3 == 0, "#### 1,234").otherwise("#### 5")
    text = F.concat(F.regexp_replace("text", r"[\\$]", ""), F.lit(" \\boxed{1234} "), number)
    rows = table(spark, sf, "documents").select("doc_id", sources[(doc % 4).cast("int")].alias("data_source"), text.alias("solution"))
    return rows.select("doc_id", A.dispatch_score(F.col("data_source"), F.col("solution"), F.lit("1234")).alias("score"))


@query("overlong_penalty", sql_with("select sample_id, round(least(-(n_tokens-(32-12))/12.0*0.5,0.0),6)+0.0 as penalty from rollout", "rollout"))
def overlong_penalty(spark, sf):
    penalty = R.overlong_penalty(F.col("n_tokens"), 32, 12, 0.5)
    return rollout(spark, sf).select("sample_id", (F.round(penalty, 6) + 0.0).alias("penalty"))
