"""Text and JSON column expressions for agent messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.functions import constants as K
from trailmark.functions.core import let

TOOL_CALL = "(?s)<tool_call>(.*?)</tool_call>"
STRICT_CALL = r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"
OPEN_CALL = r"(?s)<tool_call>\s*(\{.*)"
THINK = "(?s)<think>(.*?)</think>"
ANSWER = "(?s)<answer>(.*?)</answer>"
USEFUL = r"(?s)<useful>\s*(\[.*?\])\s*</useful>"
IMAGE_RESULT = r"(?s)\[(\d+)\]\s*(.*?)\n\s*Source:\s*(.*?)\n\s*Link:\s*(https?://\S+)"
WEB_BLOCK = r"(?s)Web search results for:\s*(.*?)\n+(.*?)(?=\nWeb search results for:|\z)"
WEB_RESULT = r"(?s)\[(\d+)\]\s*(.*?)\nURL:\s*(https?://\S+)\n?(.*?)(?=\n\[\d+\]|\z)"


def strip(text: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def json_value(raw: Column) -> Column:
    """Parsed JSON object or list; null for anything else, text after the value included."""
    return F.when(has(raw, r"(?s)\A\s*(\{.*\}|\[.*\])\s*\z"), F.try_parse_json(raw))


def content_text(content: Column, sep: str = " ") -> Column:
    """Message content as text: plain text stays, a JSON list of parts is joined with ``sep``."""
    parts = F.try_variant_get(json_value(content), "$", "array<variant>")
    texts = F.transform(
        parts,
        lambda p: F.coalesce(
            F.try_variant_get(p, "$.text", "string"),
            F.when(F.schema_of_variant(p).startswith("OBJECT"), F.lit("")),
            F.try_variant_get(p, "$", "string"),
            F.lit(""),
        ),
    )
    is_list = has(content, r'(?s)\A\s*\[\s*(\{|"|\])')
    return F.coalesce(F.when(is_list, F.array_join(texts, sep)), content, F.lit(""))


def first_image(images: Column) -> Column:
    """First entry of a JSON list of images, given as paths or as objects with a path field."""
    head = F.try_variant_get(json_value(images), "$[0]", "variant")
    return F.coalesce(
        F.nullif(F.try_variant_get(head, "$.image_url", "string"), F.lit("")),
        F.try_variant_get(head, "$.path", "string"),
        F.when(F.schema_of_variant(head) == "STRING", F.try_variant_get(head, "$", "string")),
        F.lit(""),
    )


def raw_calls(content: Column) -> Column:
    """Array of the JSON bodies between call tags."""
    return F.regexp_extract_all(content, F.lit(TOOL_CALL), F.lit(1))


def call_field(call: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(call, path, kind)


def parsed_calls(content: Column) -> Column:
    """Array of parsed calls (variants); bodies that are not JSON are dropped."""
    return F.filter(F.transform(raw_calls(content), json_value), lambda v: v.isNotNull())


def query_list(call: Column) -> Column:
    """The query argument as a list of non-empty texts."""
    as_list = call_field(call, "$.arguments.query", "array<string>")
    single = call_field(call, "$.arguments.query", "string")
    return F.coalesce(
        F.filter(as_list, lambda q: q != ""),
        F.when(strip(single) != "", F.array(strip(single))),
        F.array().cast("array<string>"),
    )


def norm_query(raw: Column, sep: str = " | ") -> Column:
    """A query given as text or as a JSON list of texts, joined into one text."""
    as_list = F.try_variant_get(json_value(raw), "$", "array<string>")
    listed = F.when(F.ltrim(raw).startswith("["), F.array_join(F.filter(as_list, lambda q: q != ""), sep))
    return F.coalesce(listed, strip(raw))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group; null (not empty text) without a match."""
    return F.when(has(text, pattern), F.regexp_extract(text, pattern, group))


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def image_results(text: Column) -> Column:
    """Array of (pos, title, source, link) from an image-search response."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(IMAGE_RESULT), F.lit(0)),
        lambda hit: F.struct(
            F.regexp_extract(hit, IMAGE_RESULT, 1).cast("int").alias("pos"),
            strip(F.regexp_extract(hit, IMAGE_RESULT, 2)).alias("title"),
            strip(F.regexp_extract(hit, IMAGE_RESULT, 3)).alias("source"),
            strip(F.regexp_extract(hit, IMAGE_RESULT, 4)).alias("link"),
        ),
    )


def _web_block_results(block: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(block, F.lit(WEB_RESULT), F.lit(0)),
        lambda hit: F.struct(
            F.regexp_extract(hit, WEB_RESULT, 1).cast("int").alias("pos"),
            strip(F.regexp_extract(hit, WEB_RESULT, 2)).alias("title"),
            strip(F.regexp_extract(hit, WEB_RESULT, 3)).alias("url"),
            strip(F.regexp_extract(hit, WEB_RESULT, 4)).alias("content"),
        ),
    )


def web_results(text: Column) -> Column:
    """Array of (pos, title, url, content) from a web-search response, sorted by position.

    A response holds one block per query. A repeated query keeps its last block, a repeated
    position keeps its first result.
    """
    blocks = F.transform(
        F.regexp_extract_all(text, F.lit(WEB_BLOCK), F.lit(0)),
        lambda b: F.struct(
            strip(F.regexp_extract(b, WEB_BLOCK, 1)).alias("key"), F.regexp_extract(b, WEB_BLOCK, 2).alias("body")
        ),
    )

    def bodies(found: Column) -> Column:
        keys = F.array_distinct(F.transform(found, lambda b: b.key))
        return F.transform(keys, lambda k: F.element_at(F.filter(found, lambda b: b.key == k), F.lit(-1)).body)

    def first_per_position(found: Column) -> Column:
        positions = F.array_sort(F.array_distinct(F.transform(found, lambda r: r.pos)))
        return F.transform(positions, lambda p: F.element_at(F.filter(found, lambda r: r.pos == p), F.lit(1)))

    texts = F.when(text.contains(K.QUERY_HEADER), let(blocks, bodies)).otherwise(F.array(text))
    return let(F.flatten(F.transform(texts, _web_block_results)), first_per_position)


def useful_indices(text: Column) -> Column:
    """Indices of the first useful tag; an unreadable list is empty, no tag is null."""
    raw = F.regexp_extract(text, USEFUL, 1)
    parsed = F.try_variant_get(json_value(raw), "$", "array<int>")
    return F.when(has(text, USEFUL), F.coalesce(parsed, F.array().cast("array<int>")))


def think_refs(think: Column, n_results: Column) -> Column:
    """Result numbers a reasoning text refers to: [] when it rejects all, null when it says nothing."""
    phrases = F.array(*[F.lit(p) for p in K.NO_RESULT_PHRASES])
    rejects = let(F.lower(think), lambda low: F.exists(phrases, lambda p: low.contains(p)))
    refs = F.transform(
        F.regexp_extract_all(think, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda d: d.try_cast("int")
    )
    valid = F.array_sort(F.array_distinct(F.filter(refs, lambda r: (r >= 1) & (r <= n_results))))
    empty = F.array().cast("array<int>")
    return (
        F.when(F.coalesce(think, F.lit("")) == "", F.lit(None).cast("array<int>"))
        .when(rejects, empty)
        .otherwise(let(valid, lambda v: F.when(F.size(v) > 0, v)))
    )


def mentions(text: Column, word: Column) -> Column:
    """Whole-word, case-insensitive mention of a literal word taken from the row."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pattern = F.concat(F.lit(r"(?iuU)\b"), quoted, F.lit(r"\b"))
    return F.coalesce(F.rlike(text, pattern), F.lit(False))


def confidence_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("(?i)" + K.CONFIDENCE_PATTERN))


def _cut_at(text: Column, pattern: str, trim_class: str) -> Column:
    """Text before the first match, right-trimmed of ``trim_class`` and closed with a full stop."""
    def close(parts: Column) -> Column:
        closed = F.concat(F.regexp_replace(parts[0], rf"{trim_class}+\z", ""), F.lit("."))
        return F.when(F.size(parts) > 1, closed).otherwise(parts[0])

    return let(F.split(text, "(?i)" + pattern, 2), close)


def drop_call_blocks(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<tool_call>.*?(?:</tool_call>|\z)", "")


def truncate_think(think: Column, closing: str, within: int | None = 200) -> Column:
    """Reasoning without call blocks, cut at the first announced tool use, closed with ``closing``.

    A closing word in the last ``within`` characters (None: anywhere) makes a closing sentence needless.
    """
    words = F.array(*[F.lit(w) for w in K.CONFIDENT_TAIL_WORDS])

    def close(cut: Column) -> Column:
        end = F.right(cut, F.lit(within)) if within else cut
        closed = let(F.lower(end), lambda tail: F.exists(words, lambda w: tail.contains(w)))
        return strip(F.when(closed, cut).otherwise(F.concat(cut, F.lit(closing))))

    return let(_cut_at(drop_call_blocks(think), K.TOOL_INTENT_PATTERN, "[ .]"), close)


def trim_closing(think: Column, city: Column, closing: str) -> Column:
    """Closing reasoning cut at the first announced tool use; null when the city is not mentioned."""
    def close(bare: Column) -> Column:
        closed = F.lower(bare).contains("no tool") | F.lower(bare).contains("without")
        return F.when(closed, bare).otherwise(F.concat(bare, F.lit(closing)))

    def finish(cut: Column) -> Column:
        bare = strip(drop_call_blocks(strip(F.regexp_replace(cut, "(?s)<useful>.*?</useful>", ""))))
        return F.when(mentions(cut, city), let(bare, close))

    return let(_cut_at(think, K.FALLBACK_CUE_PATTERN, r"[ .\n]"), finish)


def strip_image_ids(text: Column) -> Column:
    return F.regexp_replace(text, r"<image>\s*\nimage_id:\s*\d+", "<image>")


def image_id(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"<image>\s*\nimage_id:\s*(\d+)", 1), F.lit("")).try_cast("int")


def count_of(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal text."""
    return F.size(F.split(text, rf"\Q{needle}\E", -1)) - 1


def clip_text(text: Column, limit: int, side: str = "middle") -> Column:
    half = limit // 2
    clipped = {
        "left": F.concat(F.left(text, F.lit(limit)), F.lit("...(truncated)")),
        "right": F.concat(F.lit("(truncated)..."), F.right(text, F.lit(limit))),
        "middle": F.concat(
            F.left(text, F.lit(half)), F.lit("...(truncated)..."), F.right(text, F.lit(half))
        ),
    }[side]
    return F.when(F.length(text) > limit, clipped).otherwise(text)


def rounds(text: Column) -> Column:
    """Output text split into rounds that start at a call; empty without any call."""
    fixed = F.replace(
        F.replace(text, F.lit("</tool_call>user"), F.lit("</tool_call>\nuser")),
        F.lit("</tool_response>assistant"),
        F.lit("</tool_response>\nassistant"),
    )
    pieces = F.transform(F.split(fixed, "(?=<tool_call>)", -1), strip)
    return F.when(fixed.contains("<tool_call>"), F.filter(pieces, lambda p: p != "")).otherwise(
        F.array().cast("array<string>")
    )


def segments(text: Column) -> Column:
    """Ordered non-empty segments of a text cut around media placeholders."""
    return F.filter(F.split(text, "(?<=<image>|<video>)|(?=<image>|<video>)", -1), lambda s: s != "")


def cache_key_query(query: Column) -> Column:
    return F.sha2(F.lower(strip(query)), 256)


def cache_key_box(path: Column, box: Column) -> Column:
    shown = F.array_join(F.transform(box, lambda v: F.format_string("%.1f", v)), ",")
    return F.sha2(F.concat(path, F.lit("|"), shown), 256)
