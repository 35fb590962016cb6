"""Tables extracted from agent messages: calls, responses, results, labels, evidence.

Message tables have ``conv_id, msg_idx, role, content``. Windows run per conversation, which is
bounded by the turn limit of an episode; work that can be done inside one message is done there,
without exploding and regrouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.functions import constants as K
from trailmark.functions import text as X

def in_order():
    """Messages of one conversation in order."""
    return W.partitionBy("conv_id").orderBy("msg_idx")


def tool_calls(messages: DataFrame, repair: bool = False) -> DataFrame:
    """One row per call in assistant messages: position, name, arguments (JSON text).

    With ``repair`` a missing name or arguments object is inferred from the other keys, and one
    unclosed call is accepted when the message has no readable closed one.
    """
    assistant = messages.where(F.col("role") == "assistant")
    if not repair:
        rows = assistant.select("conv_id", "msg_idx", F.posexplode(X.raw_calls(F.col("content"))).alias("call_no", "raw"))
        parsed = rows.withColumn("call", X.json_value(F.col("raw"))).where("call is not null")
        return parsed.select(
            "conv_id",
            "msg_idx",
            "call_no",
            X.call_field(F.col("call"), "$.name").alias("name"),
            X.call_field(F.col("call"), "$.arguments").alias("arguments"),
        )
    content = F.col("content")
    strict = F.filter(
        F.transform(F.regexp_extract_all(content, F.lit(X.STRICT_CALL), F.lit(1)), X.json_value),
        lambda v: v.isNotNull(),
    )
    # Candidates for an unclosed call: every prefix of the open tail that ends at a brace.
    tail = F.regexp_extract(content, X.OPEN_CALL, 1)
    pieces = F.split(tail, "(?<=\\})", -1)
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(pieces)),
        lambda n: F.split(F.array_join(F.slice(pieces, F.lit(1), n), ""), "<")[0],
    )
    opened = F.filter(F.transform(prefixes, X.json_value), lambda v: v.isNotNull())
    chosen = F.when(F.size(strict) > 0, strict).otherwise(F.slice(opened, 1, 1))
    rows = assistant.select("conv_id", "msg_idx", F.posexplode(chosen).alias("call_no", "call"))
    call = F.col("call")
    box, query = X.call_field(call, "$.bbox_2d"), X.call_field(call, "$.query")
    given_name, given_args = X.call_field(call, "$.name"), X.call_field(call, "$.arguments")
    name = F.coalesce(given_name, F.when(box.isNotNull(), K.ZOOM).when(query.isNotNull(), K.TEXT_SEARCH))
    box_args = F.concat(F.lit('{"bbox_2d":'), box, F.lit("}"))
    query_args = F.to_json(F.struct(query.alias("query")))
    inferred = F.when(name.isin(K.ZOOM, K.IMAGE_SEARCH) & box.isNotNull(), box_args).when(
        name.isin(K.TEXT_SEARCH, "search_web") & query.isNotNull(), query_args
    )
    arguments = F.when(given_name.isNull() & inferred.isNotNull(), inferred).otherwise(F.coalesce(given_args, inferred))
    return rows.select("conv_id", "msg_idx", "call_no", name.alias("name"), arguments.alias("arguments"))


def _image_box(content: Column) -> Column:
    """Box of the first image search in a message that has four numbers; null without one."""
    boxes = F.transform(
        F.filter(X.parsed_calls(content), lambda c: X.call_field(c, "$.name") == K.IMAGE_SEARCH),
        lambda c: X.call_field(c, "$.arguments.bbox_2d", "array<double>"),
    )
    return F.try_element_at(F.filter(boxes, lambda b: F.size(b) == 4), F.lit(1))


def _text_queries(content: Column) -> Column:
    """Queries of all text searches in a message, pooled; null without one."""
    pooled = F.flatten(
        F.transform(F.filter(X.parsed_calls(content), lambda c: X.call_field(c, "$.name") == K.TEXT_SEARCH), X.query_list)
    )
    return F.when(F.size(pooled) > 0, pooled)


def pair_calls(messages: DataFrame, tool: str) -> DataFrame:
    """Each search call with the first matching response; a newer call replaces a pending one.

    Only calls and matching responses are kept, so a response belongs to a call exactly when the
    row before it is that call.
    """
    payload, mark = {
        K.IMAGE_SEARCH: (_image_box, K.IMAGE_RESPONSE_MARK),
        K.TEXT_SEARCH: (_text_queries, K.TEXT_RESPONSE_MARK),
    }[tool]
    kind = {K.IMAGE_SEARCH: "bbox", K.TEXT_SEARCH: "queries"}[tool]
    assistant, content = F.col("role") == "assistant", F.col("content")
    events = (
        messages.select(
            "conv_id",
            "msg_idx",
            F.when(assistant, payload(content)).alias(kind),
            F.when((F.col("role") == "user") & content.contains(mark), content).alias("response"),
        )
        .where(F.col(kind).isNotNull() | F.col("response").isNotNull())
    )
    return (
        events.withColumns(
            {kind: F.lag(kind).over(in_order()), "call_msg_idx": F.lag("msg_idx").over(in_order()), "resp_msg_idx": F.col("msg_idx")}
        )
        .where(F.col("response").isNotNull() & F.col(kind).isNotNull())
        .withColumn("call_idx", F.row_number().over(in_order()) - 1)
        .select("conv_id", "call_idx", "call_msg_idx", "resp_msg_idx", kind, "response")
    )


def parse_results(pairs: DataFrame, tool: str, keep_empty_calls: bool = True) -> DataFrame:
    """One row per search result; a call without a readable result gives one row at position -1."""
    parse = {K.IMAGE_SEARCH: X.image_results, K.TEXT_SEARCH: X.web_results}[tool]
    fields = {K.IMAGE_SEARCH: ["title", "link", "source"], K.TEXT_SEARCH: ["title", "url", "content"]}[tool]
    explode = F.explode_outer if keep_empty_calls else F.explode
    rows = pairs.withColumn("r", explode(parse(F.col("response")))).drop("response")
    return rows.select(
        *[c for c in rows.columns if c != "r"],
        F.coalesce(F.col("r.pos"), F.lit(-1)).alias("result_pos"),
        *[F.coalesce(F.col(f"r.{f}"), F.lit("")).alias(f"result_{f}") for f in fields],
    )


def useful_tags(messages: DataFrame) -> DataFrame:
    """Self-reported useful indices, attributed to every search of the assistant turn before.

    ``turn_no`` counts assistant turns from one; ``msg_idx`` is the absolute message index.
    """
    names = F.filter(
        F.transform(X.parsed_calls(F.col("content")), lambda c: X.call_field(c, "$.name")),
        lambda n: n.isin(K.IMAGE_SEARCH, K.TEXT_SEARCH),
    )
    turns = messages.where(F.col("role") == "assistant").select(
        "conv_id", "msg_idx", names.alias("tools"), X.useful_indices(F.col("content")).alias("indices")
    )
    return (
        turns.withColumns(
            {
                "turn_no": F.row_number().over(in_order()),
                "call_msg_idx": F.lag("msg_idx").over(in_order()),
                "tools": F.lag("tools").over(in_order()),
            }
        )
        .where("indices is not null")
        .select("conv_id", "turn_no", "msg_idx", "call_msg_idx", F.explode("tools").alias("tool"), "indices")
    )


def label_results(results: DataFrame, annotations: DataFrame, tool: str) -> DataFrame:
    """Usefulness of results: the k-th call of a tool takes the k-th annotation of that tool."""
    order = W.partitionBy("conv_id").orderBy("turn_no", "msg_idx")
    labels = (
        annotations.where(F.col("tool") == tool)
        .withColumn("call_idx", F.row_number().over(order) - 1)
        .select("conv_id", "call_idx", F.col("turn_no").alias("call_turn"), F.col("indices").alias("useful_indices"))
    )
    joined = results.join(labels, ["conv_id", "call_idx"], "left")
    empty = F.array().cast("array<int>")
    return (
        joined.withColumn("useful_indices", F.coalesce("useful_indices", empty))
        .withColumn("call_turn", F.coalesce("call_turn", F.lit(-1)))
        .withColumn("n_useful", F.size("useful_indices"))
        .withColumn(
            "is_geo_useful", (F.col("result_pos") >= 0) & F.array_contains("useful_indices", F.col("result_pos"))
        )
    )


def calls_with_next_think(messages: DataFrame) -> DataFrame:
    """Answered search calls of both tools with their results and the reasoning that follows.

    At most one call is pending; a new call replaces it. The reasoning is that of the first
    assistant message after the response, empty when there is none.
    """
    content = F.col("content")
    assistant = F.col("role") == "assistant"
    first_search = F.try_element_at(
        F.filter(
            X.parsed_calls(content), lambda c: X.call_field(c, "$.name").isin(K.IMAGE_SEARCH, K.TEXT_SEARCH)
        ),
        F.lit(1),
    )
    query = F.coalesce(
        F.array_join(X.call_field(F.col("call"), "$.arguments.query", "array<string>"), " | "),
        X.call_field(F.col("call"), "$.arguments.query"),
    )
    rows = (
        messages.withColumn("call", F.when(assistant, first_search))
        .withColumn("call_tool", X.call_field(F.col("call"), "$.name"))
        .withColumn("call_query", F.when(F.col("call_tool") == K.TEXT_SEARCH, query))
        .drop("call")
    )
    so_far = in_order().rowsBetween(W.unboundedPreceding, W.currentRow)
    after = in_order().rowsBetween(1, W.unboundedFollowing)
    is_call = F.col("call_tool").isNotNull()
    think = F.when(assistant, F.coalesce(X.strip(X.first_match(content, X.THINK)), F.lit("")))
    tracked = rows.withColumns(
        {
            "call_no": F.sum(is_call.cast("int")).over(so_far),
            "tool": F.last("call_tool", ignorenulls=True).over(so_far),
            "call_msg_idx": F.last(F.when(is_call, F.col("msg_idx")), ignorenulls=True).over(so_far),
            "query": F.last(F.when(is_call, F.coalesce("call_query", F.lit(""))), ignorenulls=True).over(so_far),
            "image_calls": F.sum((F.col("call_tool") == K.IMAGE_SEARCH).cast("int")).over(so_far),
            "text_calls": F.sum((F.col("call_tool") == K.TEXT_SEARCH).cast("int")).over(so_far),
            "next_think": F.coalesce(F.first(think, ignorenulls=True).over(after), F.lit("")),
        }
    )
    answers = (F.col("role") == "user") & F.when(
        F.col("tool") == K.IMAGE_SEARCH, content.contains(K.IMAGE_RESPONSE_MARK)
    ).when(F.col("tool") == K.TEXT_SEARCH, content.contains(K.TEXT_RESPONSE_MARK)).otherwise(False)
    first_answer = W.partitionBy("conv_id", "call_no").orderBy("msg_idx")
    header = X.strip(F.regexp_extract(content, r"Web search results for:\s*(.+?)(?:\n|$)", 1))
    n_results = F.when(F.col("tool") == K.IMAGE_SEARCH, F.size(X.image_results(content))).otherwise(
        F.regexp_count(content, F.lit(r"\[\d+\]"))
    )
    return (
        tracked.where(answers)
        .withColumn("__rn", F.row_number().over(first_answer))
        .where("__rn = 1")
        .select(
            "conv_id",
            "tool",
            (F.when(F.col("tool") == K.IMAGE_SEARCH, F.col("image_calls")).otherwise(F.col("text_calls")) - 1)
            .cast("int")
            .alias("call_idx"),
            "call_msg_idx",
            F.col("msg_idx").alias("resp_msg_idx"),
            F.when((F.col("tool") == K.TEXT_SEARCH) & (F.col("query") == ""), header)
            .otherwise(F.col("query"))
            .alias("query"),
            n_results.alias("n_results"),
            F.col("content").alias("response"),
            "next_think",
        )
    )


def zoom_bboxes(messages: DataFrame) -> DataFrame:
    """Zoom boxes with their labels, one row per call with four numbers."""
    calls = F.filter(X.parsed_calls(F.col("content")), lambda c: X.call_field(c, "$.name") == K.ZOOM)
    found = F.filter(
        F.transform(
            calls,
            lambda c: F.struct(
                X.call_field(c, "$.arguments.bbox_2d", "array<double>").alias("bbox"),
                F.coalesce(X.strip(X.call_field(c, "$.arguments.label")), F.lit("")).alias("label"),
            ),
        ),
        lambda z: F.coalesce((F.size(z.bbox) == 4) & F.forall(z.bbox, lambda v: v.isNotNull()), F.lit(False)),
    )
    return messages.where(F.col("role") == "assistant").select("conv_id", "msg_idx", F.inline(found))


def split_rounds(messages: DataFrame) -> DataFrame:
    return messages.select("conv_id", "msg_idx", F.posexplode(X.rounds(F.col("content"))).alias("round_no", "round"))


def segment_media(messages: DataFrame) -> DataFrame:
    """Ordered typed segments with the media offset of each placeholder within its conversation."""
    rows = messages.select(
        "conv_id", "msg_idx", F.posexplode(X.segments(F.col("content"))).alias("seg_no", "segment")
    ).withColumn(
        "kind", F.when(F.col("segment") == "<image>", "image").when(F.col("segment") == "<video>", "video").otherwise("text")
    )
    order = W.partitionBy("conv_id").orderBy("msg_idx", "seg_no").rowsBetween(W.unboundedPreceding, -1)
    offset = {
        k: F.coalesce(F.sum((F.col("kind") == k).cast("int")).over(order), F.lit(0)) for k in ("image", "video")
    }
    return rows.withColumn(
        "media_offset",
        F.when(F.col("kind") == "image", offset["image"]).when(F.col("kind") == "video", offset["video"]).cast("int"),
    )


def check_media_counts(segments: DataFrame, media: DataFrame) -> DataFrame:
    """Placeholders per conversation beside the media it has; a difference is an error."""
    counted = segments.groupBy("conv_id").agg(F.count(F.when(F.col("kind") == "image", 1)).alias("n_placeholders"))
    joined = counted.join(media.select("conv_id", "n_media"), "conv_id")
    same = F.col("n_placeholders") == F.col("n_media")
    return joined.withColumn(
        "n_media",
        F.when(same, F.col("n_media")).otherwise(
            F.raise_error(F.concat(F.lit("media count differs in conversation "), F.col("conv_id").cast("string")))
        ),
    )


def render_results(results: DataFrame, style: str, order: str = "result_pos", content_chars: int | None = 400) -> DataFrame:
    """Results of each call as prompt text, in the order of the column ``order``.

    ``image``: title, source, link lines; ``web``: title, URL, content; ``text``: the same indented,
    numbered 1, 2, ... as shown, with the content cut at ``content_chars`` characters (None: whole);
    ``passage``: ``Doc n`` blocks.
    """
    content = lambda r: F.left(r.content, F.lit(content_chars)) if content_chars else r.content
    line = {
        "image": lambda r, i: F.concat(
            F.lit("["), r.pos.cast("string"), F.lit("] "), r.title, F.lit("\n    Source: "), r.source,
            F.lit("\n    Link: "), r.link,
        ),
        "web": lambda r, i: F.concat(
            F.lit("["), r.pos.cast("string"), F.lit("] "), r.title, F.lit("\nURL: "), r.url, F.lit("\n"), r.content, F.lit("\n")
        ),
        "text": lambda r, i: F.concat(
            F.lit("["), (i + 1).cast("string"), F.lit("] "), r.title,
            F.when(r.url != "", F.concat(F.lit("\n    URL: "), r.url)).otherwise(""),
            F.when(r.content != "", F.concat(F.lit("\n    "), content(r))).otherwise(""),
        ),
        "passage": lambda r, i: F.concat(
            F.lit("Doc "), r.pos.cast("string"), F.lit(" (Title: "), r.title, F.lit(")\n"), r.content
        ),
    }[style]
    fields = {"image": ["title", "source", "link"], "web": ["title", "url", "content"], "text": ["title", "url", "content"], "passage": ["title", "content"]}
    item = F.struct(F.col(order).alias("at"), F.col("result_pos").alias("pos"), *[F.col(f"result_{f}").alias(f) for f in fields[style]])
    # One page of a search call: bounded by the page size of the search tool.
    pages = results.where("result_pos >= 0").groupBy("conv_id", "call_idx").agg(F.array_sort(F.collect_list(item)).alias("page"))
    sep = "\n\n" if style == "passage" else "\n"
    return pages.select("conv_id", "call_idx", F.array_join(F.transform("page", line), sep).alias("text"))


def linearize(messages: DataFrame) -> DataFrame:
    """One text per conversation with role tags; calls are stripped and the system text is lifted out."""
    content = F.col("content")
    body = F.when(
        F.col("role") == "assistant",
        F.concat(F.lit("Assistant: "), X.strip(F.regexp_replace(content, X.TOOL_CALL, ""))),
    ).otherwise(F.concat(F.lit("User: "), content))
    lines = F.array_sort(
        F.collect_list(F.when(F.col("role") != "system", F.struct("msg_idx", body.alias("line"))))
    )
    return messages.groupBy("conv_id").agg(
        F.array_join(F.transform(lines, lambda m: m.line), "\n").alias("text"),
        F.max_by("content", F.when(F.col("role") == "system", F.col("msg_idx"))).alias("system"),
    )


def turn_flags(messages: DataFrame, max_turns: int) -> DataFrame:
    """Truncated reasoning (closed think, no answer, no call) and turn-limit flags per assistant turn."""
    content = F.col("content")
    turns = messages.where(F.col("role") == "assistant").withColumn("turn_no", F.row_number().over(in_order()))
    has_call = F.size(X.parsed_calls(content)) > 0
    has_answer = X.has(content, X.ANSWER)
    return turns.select(
        "conv_id",
        "msg_idx",
        "turn_no",
        has_answer.alias("has_answer"),
        has_call.alias("has_call"),
        (~has_call & ~has_answer & (X.strip(content) != "") & content.contains("</think>") & (F.col("turn_no") < max_turns)).alias(
            "truncated"
        ),
        (has_call & (F.col("turn_no") == max_turns)).alias("turn_limit"),
    )


def backfill_labels(messages: DataFrame, existing: DataFrame, labeler) -> DataFrame:
    """Labels for answered calls that have none, by reasoning text first, else by the labeler.

    ``labeler`` maps the call table to a table with ``conv_id, call_msg_idx, tool, labeled`` (an
    index array); existing annotations are kept as they are.
    """
    calls = calls_with_next_think(messages)
    missing = calls.join(existing.select("conv_id", "tool", "call_msg_idx"), ["conv_id", "tool", "call_msg_idx"], "left_anti")
    refs = X.think_refs(F.col("next_think"), F.col("n_results"))
    judged = missing.withColumn("refs", refs).join(
        labeler(missing).select("conv_id", "tool", "call_msg_idx", "labeled"), ["conv_id", "tool", "call_msg_idx"], "left"
    )
    empty = F.array().cast("array<int>")
    new = judged.select(
        "conv_id",
        "tool",
        "call_msg_idx",
        F.when(F.col("n_results") == 0, empty)
        .otherwise(F.coalesce(F.col("refs"), F.col("labeled"), empty))
        .alias("indices"),
        F.when(F.col("n_results") == 0, "empty_results")
        .when(F.col("refs").isNull(), "labeler")
        .when(F.size("refs") == 0, "think_empty")
        .otherwise("think")
        .alias("method"),
    )
    kept = existing.select("conv_id", "tool", "call_msg_idx", "indices", F.lit("existing").alias("method"))
    return kept.unionByName(new)


def backfill_plan(messages: DataFrame, existing: DataFrame, part: Column) -> DataFrame:
    """Dry run per part: conversations, those in need, calls answered by reasoning and by the labeler."""
    calls = calls_with_next_think(messages)
    missing = calls.join(existing.select("conv_id", "tool", "call_msg_idx"), ["conv_id", "tool", "call_msg_idx"], "left_anti")
    by_think = X.think_refs(F.col("next_think"), F.col("n_results")).isNotNull()
    needs = missing.groupBy("conv_id").agg(
        F.count(F.when(by_think, 1)).alias("n_think"), F.count(F.when(~by_think, 1)).alias("n_labeler")
    )
    entries = messages.select("conv_id").distinct().withColumn("part", part)
    return (
        entries.join(needs, "conv_id", "left")
        .groupBy("part")
        .agg(
            F.count(F.lit(1)).alias("n_entries"),
            F.count("n_think").alias("n_need"),
            F.coalesce(F.sum("n_think"), F.lit(0)).alias("n_think"),
            F.coalesce(F.sum("n_labeler"), F.lit(0)).alias("n_labeler"),
        )
    )


def rule_labeler(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Usefulness by rule: a result counts when its title or source names the true city or country.

    ``results`` has ``conv_id, tool, call_msg_idx, result_pos, evidence``; ``truth`` has
    ``conv_id, country, city``.
    """
    joined = results.join(truth, "conv_id")
    hit = X.mentions(F.col("evidence"), F.col("city")) | X.mentions(F.col("evidence"), F.col("country"))
    # The indices of one result page: bounded by the page size of the search tool.
    return joined.groupBy("conv_id", "tool", "call_msg_idx").agg(
        F.array_sort(F.collect_set(F.when(hit & (F.col("result_pos") >= 1), F.col("result_pos")))).alias("labeled")
    )
