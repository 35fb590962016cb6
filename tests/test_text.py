"""Parsers on hand-made edge rows."""

import random

import pytest
from pyspark.sql import functions as F

from trailmark.functions import answers as A
from trailmark.functions import constants as K
from trailmark.functions import geo as G
from trailmark.functions import text as X
from trailmark.operators import builders as D
from trailmark.operators import extraction as E
from trailmark.operators import filters as B


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "text,expected",
    [
        ("<answer>A, B, 1.5, 2.5</answer>", (1.5, 2.5)),
        ("<answer>A, B, 1, 2</answer> then <answer>C, D, 3, 4</answer>", (3.0, 4.0)),
        ("<answer>A, B, 0.0, 0</answer>", None),
        ("<answer>None, None</answer>", None),
        ("<answer>5</answer>", None),
        ("no answer 1, 2", None),
        ("<answer>A, B, 95.0, 200.0</answer>", (95.0, 200.0)),
    ],
)
def test_parse_pred(spark, text, expected):
    got = one(spark, G.parse_pred, text)
    assert (got and tuple(got)) == expected


@pytest.mark.parametrize(
    "text,expected",
    [
        ("<answer>A, B, 1.5, 2.5</answer><answer>C, D, 3, 4</answer>", (1.5, 2.5)),
        ("\\boxed{10.0, 20.0, X, Y}", (10.0, 20.0)),
        ("it is at lat: 95.5, lon = 200", (95.5, 200.0)),
        ("Latitude=-3.5; Longitude=4", (-3.5, 4.0)),
        ("pairs (91, 0) and (10, 20)", (10.0, 20.0)),
        ("(91, 0)", None),
        ("nothing", None),
        ("<answer>none</answer> 1.0, 2.0", None),
    ],
)
def test_parse_coords(spark, text, expected):
    got = one(spark, G.parse_coords, text)
    assert (got and tuple(got)) == expected


def test_distance_score_knots(spark):
    rows = spark.createDataFrame([(k,) for k in (0.5, 1.0, 25.0, 200.0, 750.0, 2500.0, 2500.1)], "km double")
    got = [r.s for r in rows.select(G.distance_score(F.col("km")).alias("s")).collect()]
    assert got == pytest.approx([1.0, 1.0, 0.8, 0.6, 0.4, 0.2, 0.0])
    assert one(spark, G.distance_score, None, "double") is None


def test_haversine_is_null_without_a_prediction_and_finite_at_the_antipode(spark):
    row = spark.range(1).select(
        G.haversine_km(F.lit(None).cast("double"), F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("a"),
        G.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("b"),
    ).first()
    assert row.a is None
    assert row.b == pytest.approx(6371.0 * 3.141592653589793)


@pytest.mark.parametrize(
    "text,score",
    [
        ("<think>a</think><answer>b</answer>", 0.8),
        ("<think>a\n</think>\n<useful>[1,\n2]</useful>\n<answer>b</answer> tail", 1.0),
        (" <think>a</think><answer>b</answer>", 0.0),
        ("<answer>b</answer>", 0.0),
    ],
)
def test_format_score(spark, text, score):
    assert one(spark, G.format_score, text) == score


def test_content_text(spark):
    parts = '[{"type": "text", "text": "a"}, {"type": "image"}, "b"]'
    assert one(spark, X.content_text, parts) == "a  b"
    assert one(spark, lambda c: X.content_text(c, "\n"), parts) == "a\n\nb"
    assert one(spark, X.content_text, "[1] a result, not a list") == "[1] a result, not a list"
    assert one(spark, X.content_text, None) == ""


def test_web_results_keep_the_first_of_a_position_and_the_last_of_a_query(spark):
    text = (
        "Web search results for: q1\n\n[2] B\nURL: https://b/1\nold\nWeb search results for: q2\n\n[1] A\nURL: https://a/1\nx y\n\n[2] C\nURL: https://c/1\nz"
        "\nWeb search results for: q1\n\n[2] D\nURL: https://d/1\nnew\n"
    )
    got = [(r.pos, r.title, r.url, r.content) for r in one(spark, X.web_results, text)]
    assert got == [(1, "A", "https://a/1", "x y"), (2, "D", "https://d/1", "new")]
    assert one(spark, X.web_results, "Web search results for: q\n\nnothing") == []
    bare = one(spark, X.web_results, "[1] T\nURL: http://t/\nbody")
    assert [(r.pos, r.title) for r in bare] == [(1, "T")]


def test_think_references(spark):
    refs = lambda text, n: spark.createDataFrame([(text, n)], "t string, n int").select(X.think_refs(F.col("t"), F.col("n")).alias("r")).first().r
    assert refs("see [3] and [1], [3], [9]", 5) == [1, 3]
    assert refs("None of [1] helps", 5) == []
    assert refs("no numbers", 5) is None
    assert refs("", 5) is None
    assert refs("[0] [7]", 5) is None


def test_mentions_are_whole_words_and_literal(spark):
    rows = spark.createDataFrame(
        [("in Paris, France", "paris"), ("Parisian", "Paris"), ("x a.b y", "a.b"), ("x azb y", "a.b"), ("à Évora", "évora"), (None, "x")], "t string, w string"
    )
    assert [r.m for r in rows.select(X.mentions(F.col("t"), F.col("w")).alias("m")).collect()] == [True, False, True, False, True, False]


def test_useful_indices(spark):
    assert one(spark, X.useful_indices, "a <useful> [1, 3] </useful>") == [1, 3]
    assert one(spark, X.useful_indices, "<useful>[i, j]</useful>") == []
    assert one(spark, X.useful_indices, "none") is None


def test_truncate_think(spark):
    closed = lambda text: X.truncate_think(text, " Sure.")
    assert one(spark, closed, "It is old. Let me search for it.") == "It is old. Sure."
    assert one(spark, closed, "I am confident it is here") == "I am confident it is here"
    assert one(spark, closed, "Known directly<tool_call>{}") == "Known directly"
    long = "I am confident" + " and so on" * 40
    assert one(spark, closed, long) == long + " Sure."
    assert one(spark, lambda text: X.truncate_think(text, " Sure.", None), long) == long


def test_clip_and_count(spark):
    assert one(spark, lambda c: X.clip_text(c, 4, "left"), "abcdef") == "abcd...(truncated)"
    assert one(spark, lambda c: X.clip_text(c, 4, "right"), "abcdef") == "(truncated)...cdef"
    assert one(spark, lambda c: X.clip_text(c, 4), "abcdef") == "ab...(truncated)...ef"
    assert one(spark, lambda c: X.clip_text(c, 6), "abcdef") == "abcdef"
    assert one(spark, lambda c: X.count_of(c, "<image>"), "<image>a<image>") == 2


def messages(spark, rows):
    return spark.createDataFrame([(0, i, role, content) for i, (role, content) in enumerate(rows)], "conv_id bigint, msg_idx bigint, role string, content string")


IMG = '<tool_call>{"name": "image_search_tool", "arguments": {"bbox_2d": [%d, 0, 10, 10]}}</tool_call>'
TXT = '<tool_call>{"name": "text_search_tool", "arguments": {"query": %s}}</tool_call>'


def test_pairing_replaces_a_pending_call_and_uses_the_first_response(spark):
    rows = messages(
        spark,
        [
            ("assistant", IMG % 1), ("assistant", IMG % 2), ("user", "Image search results A"), ("user", "Image search results B"),
            ("assistant", '<tool_call>{"name": "image_search_tool", "arguments": {"bbox_2d": [1, 2, 3]}}</tool_call>' + IMG % 4 + IMG % 5),
            ("user", "Web search results"), ("user", "Image search results C"), ("assistant", IMG % 6),
        ],
    )
    got = [(r.call_idx, r.call_msg_idx, r.resp_msg_idx, r.bbox[0]) for r in E.pair_calls(rows, K.IMAGE_SEARCH).orderBy("call_idx").collect()]
    assert got == [(0, 1, 2, 2.0), (1, 4, 6, 4.0)]


def test_text_calls_of_a_message_are_pooled(spark):
    rows = messages(spark, [("assistant", TXT % '"a "' + TXT % '["b", "", "c"]' + "<tool_call>broken</tool_call>"), ("user", "Web search results for: a")])
    assert E.pair_calls(rows, K.TEXT_SEARCH).first().queries == ["a", "b", "c"]


def test_next_think_over_both_tools(spark):
    rows = messages(
        spark,
        [
            ("assistant", IMG % 1), ("assistant", TXT % '"q"'), ("user", "Image search results late"), ("user", "Web search results for: q"),
            ("user", "Web search results again"), ("assistant", "<think> so </think>" + IMG % 2), ("user", "Image search results"),
        ],
    )
    got = [(r.tool, r.call_idx, r.call_msg_idx, r.resp_msg_idx, r.next_think) for r in E.calls_with_next_think(rows).orderBy("call_msg_idx").collect()]
    assert got == [(K.TEXT_SEARCH, 0, 1, 3, "so"), (K.IMAGE_SEARCH, 1, 5, 6, "")]


def test_call_repair(spark):
    rows = messages(
        spark,
        [
            ("assistant", '<tool_call>{"bbox_2d": [1, 2, 3, 4]}</tool_call>'), ("assistant", '<tool_call>{"name": "text_search_tool", "query": "q"}</tool_call>'),
            ("assistant", '<tool_call>{"name": "a", "arguments": {"x": {"y": 1}}} rest'), ("assistant", "<tool_call>{broken"), ("user", IMG % 1),
        ],
    )
    got = [(r.msg_idx, r.name, r.arguments) for r in E.tool_calls(rows, repair=True).orderBy("msg_idx").collect()]
    assert got == [(0, K.ZOOM, '{"bbox_2d":[1,2,3,4]}'), (1, K.TEXT_SEARCH, '{"query":"q"}'), (2, "a", '{"x":{"y":1}}')]


def trajectory(spark, rows, useful=(), images=("a.jpg", "b.jpg")):
    return spark.createDataFrame(
        [("t", 0.0, 1.0, 1, 0, [tuple(r) for r in rows], [tuple(u) for u in useful], list(images))],
        "id string, masked double, km double, n_tool_calls int, n_nudges int, messages array<struct<role:string,content:string>>, "
        "useful_results array<struct<turn:int,tool:string,indices:array<int>>>, images array<string>",
    )


NUDGE = K.NUDGE_PREFIX + ". Go on."
TALK = [
    ("system", "old"), ("user", "old"), ("assistant", "<think>look</think>" + IMG % 0), ("user", "Image search results for\n[1] x"),
    ("assistant", "<think>hm</think> more  "), ("user", NUDGE), ("assistant", "skipped"), ("user", "<image>\nimage_id: 1 zoom"),
    ("assistant", "<think>x</think><answer>A, B, 1, 2</answer>"),
]


def test_sft_rewrite(spark):
    traj = trajectory(spark, TALK, [(2, K.IMAGE_SEARCH, [9]), (2, K.IMAGE_SEARCH, [1, 3])])
    row = D.build_sft(traj, "SYS", "<image>USER").first()
    assert [m.role for m in row.messages] == ["system", "user", "assistant", "user", "assistant", "user", "assistant"]
    assert row.messages[0].content == "SYS"
    assert row.messages[4].content == "<think>hm</think>\n <useful>[1, 3]</useful> more"
    assert row.messages[5].content == "<image> zoom"
    assert [i.image for i in row.images] == ["a.jpg", "b.jpg"]


def test_sft_drops_unusable_trajectories(spark):
    declined = TALK[:-1] + [("assistant", "<answer> None, None</answer>")]
    assert D.build_sft(trajectory(spark, declined), "S", "<image>U").count() == 0
    assert D.build_sft(trajectory(spark, TALK, images=["a.jpg"]), "S", "<image>U").count() == 0
    assert D.build_sft(trajectory(spark, TALK[:5]), "S", "<image>U").count() == 0
    assert D.build_sft(trajectory(spark, TALK), "S", "no placeholder").count() == 0
    assert D.build_sft(trajectory(spark, TALK + [("user", NUDGE), ("assistant", "y")]), "S", "<image>U").count() == 1


def test_full_image_search(spark):
    whole = '<tool_call>{"name": "image_search_tool", "arguments": {"bbox_2d": [0, 5, 995, 1000]}}</tool_call>'
    hit = lambda text: trajectory(spark, [("assistant", text)]).select(B.has_full_image_search(F.col("messages")).alias("r")).first().r
    assert hit(whole) is True
    assert hit(IMG % 1) is False
    assert hit('<tool_call>{"name": "image_search_tool", "arguments": {"bbox_2d": [0, 0]}}</tool_call>') is False


@pytest.mark.parametrize(
    "given,expected",
    [
        ("\\frac12", "\\frac{1}{2}"), ("\\frac1{72}", "\\frac{1}{72}"), ("0.5", "\\frac{1}{2}"), (".5", "\\frac{1}{2}"), ("3/4", "\\frac{3}{4}"), ("a/b", "a/b"),
        ("x = 7", "7"), ("abc = 7", "abc=7"), ("\\sqrt3 + 1", "\\sqrt{3}+1"), ("12 \\text{ cm}", "12"), ("\\left(1, 2\\right)", "(1,2)"),
        ("90^\\circ", "90"), ("50\\%", "50"), ("\\tfrac{1}{2}", "\\frac{1}{2}"), ("", ""), ("\\frac1", "\\frac1"),
    ],
)
def test_clean_latex(spark, given, expected):
    assert one(spark, A.clean_latex, given) == expected


def test_boxed_text():
    assert A.boxed_text("a \\boxed{x} b \\boxed{\\frac{1}{2}} c") == "\\frac{1}{2}"
    assert A.boxed_text("\\boxed 5$ rest") == "5"
    assert A.boxed_text("\\boxed{open") is None
    assert A.boxed_text("\\fbox{y}") is None
    assert A.boxed_text("none") is None
    assert A.strict_boxed_text("\\boxed{a{b}}") == "a{b}"


def test_boxed_in_the_jvm(spark):
    draw = random.Random(5)
    parts = ["\\boxed", "\\boxed{", "\\boxed ", "{", "}", "}", "$", "é", "\\", "x", "\\box"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(12))) for _ in range(3000)] + [None, "", "\\boxed{}", "\\boxed{a{b}}}", "\\boxed{a{b}", "😀\\boxed{😀{é}}"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", A.boxed(F.col("t")).alias("loose"), A.boxed(F.col("t"), strict=True).alias("strict"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    found = rows.collect()
    assert sum(r.loose is not None for r in found) > 300 and sum(r.strict is not None for r in found) > 100
    for r in found:
        assert (r.loose, r.strict) == (A.boxed_text(r.t), A.strict_boxed_text(r.t))


def test_scores_without_python(spark):
    source, text, truth = F.col("source"), F.col("text"), F.lit("1234")
    rows = [("lighteval/MATH", "a \\boxed{1234} #### 5", 1.0), ("lighteval/MATH", "\\boxed{12", 0.0), ("lighteval/MATH", None, 0.0), ("openai/gsm8k", "#### 1,234", 1.0)]
    scored = spark.createDataFrame(rows, "source string, text string, want double").select("want", A.dispatch_score(source, text, truth).alias("got"))
    assert "Python" not in scored._jdf.queryExecution().executedPlan().toString()
    assert all(r.want == r.got for r in scored.collect())


@pytest.mark.parametrize(
    "given,expected",
    [("The  Cat's, hat!", "cats hat"), ("an apple a day", "apple day"), ("Theory", "theory"), ("", "")],
)
def test_normalize_answer(spark, given, expected):
    assert one(spark, A.normalize_answer, given) == expected


def test_dispatch_rejects_an_unknown_source(spark):
    rows = spark.createDataFrame([("other", "a", "b")], "s string, a string, t string")
    with pytest.raises(Exception, match="no scorer for data source other"):
        rows.select(A.dispatch_score(F.col("s"), F.col("a"), F.col("t"))).collect()


def test_fit_length(spark):
    fit = lambda n, side: one(spark, lambda c: B.fit_length(c, n, side), [1, 2, 3], "array<int>")
    assert fit(2, "right") == [1, 2]
    assert fit(2, "left") == [2, 3]
    assert fit(5, "right") == [1, 2, 3, 0, 0]
    with pytest.raises(Exception, match="sequence longer than 2"):
        fit(2, "error")
