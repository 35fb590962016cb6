"""Dataset builders: training, reinforcement and validation samples from trajectories.

A trajectory is one row with its messages in an array, bounded by the turn limit, so the rewrites
work inside the row and need no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import constants as K
from trailmark.functions import geo as G
from trailmark.functions import text as X
from trailmark.functions.core import let
from trailmark.operators import filters as B
from trailmark.operators.accuracy import dedupe_last
from trailmark.operators.ordering import ranked_by_hash, seed_hash


def say(role: str, content: Column | str) -> Column:
    body = F.lit(content) if isinstance(content, str) else content
    return F.struct(F.lit(role).alias("role"), body.alias("content"))


def pick_from_pool(pool: Sequence[str], seed: int, *keys: str) -> Column:
    """Seeded choice from a fixed pool."""
    slot = F.pmod(F.conv(F.substr(seed_hash(seed, *keys), F.lit(1), F.lit(8)), 16, 10).cast("bigint"), F.lit(len(pool)))
    return F.element_at(F.array(*[F.lit(p) for p in pool]), (slot + 1).cast("int"))


def build_chat(system: Column | str, question: Column, answer: Column) -> Column:
    """One question turn with an image placeholder, and its answer."""
    prompt = F.lit(system) if isinstance(system, str) else system
    return F.array(
        say("user", F.concat(F.lit("<image>\n"), prompt, F.lit("\n\n"), question)), say("assistant", answer)
    )


# Place names printed by each answer level, before latitude and longitude.
LEVEL_FIELDS = {
    "l0": [],
    "l2": ["country", "city"],
    "l3": ["country", "region", "city"],
    "l4": ["country", "region", "city", "neighbourhood"],
    "v1": ["country", "city"],
    "v2": ["country", "city", "neighbourhood"],
}


def level_answer(level: str, lat: str = "latitude", lon: str = "longitude") -> Column:
    names = [X.strip(F.coalesce(F.col(c), F.lit(""))) for c in LEVEL_FIELDS[level]]
    body = F.concat_ws(", ", *names, G.fixed4(F.col(lat)), G.fixed4(F.col(lon)))
    return F.concat(F.lit("<answer>"), body, F.lit("</answer>"))


def expand_granularity(df: DataFrame, levels: Sequence[str], lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """One row per asked answer level."""
    if "all" in levels:
        levels = ["l0", "l2", "l3", "l4"]
    rows = F.array(*[F.struct(F.lit(v).alias("version"), level_answer(v, lat, lon).alias("answer")) for v in levels])
    return df.select("*", F.inline(rows))


def _nudge(message: Column) -> Column:
    return (message.role == "user") & X.strip(message.content).startswith(K.NUDGE_PREFIX)


def _indexed(messages: Column) -> Column:
    return F.transform(
        messages,
        lambda m, i: F.struct(
            i.alias("i"), m.role.alias("role"), F.coalesce(m.content, F.lit("")).alias("content"), _nudge(m).alias("nudge")
        ),
    )


def _with_turns(indexed: Column) -> Column:
    """Adds to each message the assistant turn before it and whether a nudge came since."""
    def extend(every: Column, m: Column) -> Column:
        assistants = F.filter(every, lambda x: (x.role == "assistant") & (x.i < m.i))
        before = F.coalesce(F.array_max(F.transform(assistants, lambda x: x.i)), F.lit(-1))
        nudged = let(before, lambda b: F.exists(every, lambda x: x.nudge & (x.i < m.i) & (x.i > b)))
        return m.withField("before", before).withField("skip", (m.role == "assistant") & nudged)

    return let(indexed, lambda every: F.transform(every, lambda m: extend(every, m)))


def drop_nudges(messages: Column) -> Column:
    """Messages without nudges and without the assistant turn that answers one."""
    turns = _with_turns(_indexed(messages))
    kept = F.filter(turns, lambda m: ~m.nudge & ~m.skip)
    return F.transform(kept, lambda m: F.struct(m.role.alias("role"), m.content.alias("content")))


def _useful_tag(indices: Column) -> Column:
    return F.concat(F.lit(" <useful>["), F.array_join(indices.cast("array<string>"), ", "), F.lit("]</useful>"))


def insert_useful(content: Column, tag: Column) -> Column:
    """The tag after the first closed reasoning block, else at the end."""
    at = F.instr(content, "</think>")
    cut = at + len("</think>") - 1
    placed = F.concat(F.left(content, cut), F.lit("\n"), tag, F.substr(content, cut + 1))
    return F.when(at > 0, placed).otherwise(F.concat(content, F.lit("\n"), tag))


def inject_useful(turns: Column, useful_results: Column, message: Column) -> Column:
    """Content of an assistant message with the annotated useful indices of the search before it."""
    seen = F.filter(
        turns, lambda x: (x.role == "user") & ~x.nudge & (x.i != 1) & (x.i < message.i) & (x.i > message.before)
    )
    response = F.try_element_at(seen, F.lit(-1))
    tool = F.when(response.content.contains(K.IMAGE_RESPONSE_MARK), K.IMAGE_SEARCH).when(
        response.content.contains(K.TEXT_RESPONSE_MARK), K.TEXT_SEARCH
    )
    caller = F.array_max(
        F.transform(F.filter(turns, lambda x: (x.role == "assistant") & ~x.skip & (x.i < response.i)), lambda x: x.i)
    )
    noted = F.try_element_at(
        F.filter(F.coalesce(useful_results, F.array()), lambda u: (u.tool == tool) & (u.turn == caller)), F.lit(-1)
    )
    body = X.rstrip(message.content)
    return F.when(noted.isNotNull() & ~body.contains("<useful>"), insert_useful(body, _useful_tag(noted.indices))).otherwise(body)


def valid_answer(content: Column) -> Column:
    """Has an answer block that does not decline to answer."""
    return X.has(content, X.ANSWER) & ~F.lower(X.strip(F.regexp_extract(content, X.ANSWER, 1))).startswith("none")


def valid_shape(messages: Column) -> Column:
    """3 to 12 messages, the last one an assistant turn with an answer."""
    last = F.try_element_at(messages, F.lit(-1))
    return F.coalesce(
        F.size(messages).between(3, 12) & (last.role == "assistant") & last.content.contains("<answer>"), F.lit(False)
    )


def image_tokens(messages: Column) -> Column:
    return F.aggregate(messages, F.lit(0), lambda n, m: n + X.count_of(m.content, "<image>"))


def aligned_media(messages: Column, images: Column) -> Column:
    """As many placeholders as images."""
    return image_tokens(messages) == F.size(images)


def drop_missing_media(df: DataFrame, existing: DataFrame, key: str, images: str = "images") -> DataFrame:
    """Rows whose images all exist, by a semi-join against a listing with a ``path`` column."""
    used = df.select(key, F.explode(F.transform(images, lambda i: i.image)).alias("path"))
    broken = used.join(existing.select("path"), "path", "left_anti").select(key).distinct()
    return df.join(broken, key, "left_anti")


def rewrite_messages(turns: Column, useful_results: Column, system: str, user: str) -> Column:
    """System and first user message replaced, nudges dropped, placeholders cleaned, tags injected."""
    final = F.size(turns) - 1

    def rewrite(m: Column) -> Column:
        content = (
            F.when(m.role == "system", F.lit(system))
            .when((m.role == "user") & (m.i == 1), F.lit(user))
            .when(m.role == "user", X.strip_image_ids(m.content))
            .when(m.i == final, X.rstrip(m.content))
            .otherwise(inject_useful(turns, useful_results, m))
        )
        return F.struct(m.role.alias("role"), content.alias("content"))

    known = F.filter(turns, lambda m: m.role.isin("system", "user", "assistant") & ~m.nudge & ~m.skip)
    return F.transform(known, rewrite)


def build_sft(traj: DataFrame, system: str, user: str, root: str = "") -> DataFrame:
    """Supervised samples from trajectories; rows that do not give a usable sample are dropped."""
    def sample(turns: Column) -> Column:
        last = F.try_element_at(turns, F.lit(-1))
        answered = F.when((last.role == "assistant") & ~last.skip, valid_answer(last.content)).otherwise(True)
        shown = F.filter(turns, lambda m: (m.role == "user") & ~m.nudge)
        ids = F.filter(
            F.transform(shown, lambda m: F.when(m.i == 1, F.lit(0)).otherwise(X.image_id(m.content))), lambda i: i.isNotNull()
        )
        picked = F.transform(ids, lambda i: F.try_element_at(F.col("images"), i + 1))
        written = rewrite_messages(turns, F.col("useful_results"), system, user)
        return F.when(answered, F.struct(written.alias("messages"), picked.alias("picked")))

    def usable(s: Column) -> Column:
        return s.isNotNull() & valid_shape(s.messages) & F.forall(s.picked, lambda p: p.isNotNull()) & aligned_media(s.messages, s.picked)

    # A generator is computed once for a row; a filter would copy the whole rewrite into every condition.
    samples = F.filter(F.array(let(_with_turns(_indexed(F.col("messages"))), sample)), usable)
    rows = traj.where(F.size("messages") > 0).select("id", "km", "n_tool_calls", F.explode(samples).alias("s"))
    images = F.transform("s.picked", lambda p: F.struct(G.relative_path(p, root).alias("image")))
    return rows.select("id", "s.messages", images.alias("images"), "km", "n_tool_calls")


def _answer_fields(answer: Column) -> Column:
    return F.transform(F.split(answer, ",", -1), X.strip)


def _named_city(fields: Column) -> Column:
    city = F.try_element_at(fields, F.lit(2))
    named = (F.size(fields) >= 4) & (F.length(city) >= 2) & ~F.lower(city).isin("none", "unknown", "null")
    return F.when(named, city)


def _final_answer(messages: Column) -> Column:
    """Last assistant message with an answer block."""
    return F.try_element_at(
        F.filter(messages, lambda m: (m.role == "assistant") & X.has(m.content, X.ANSWER)), F.lit(-1)
    ).content


def build_fallback(traj: DataFrame, system: str, user: str, last_words: str, stand_in: str, tool_error: str) -> DataFrame:
    """Samples from trajectories whose tool calls all failed but whose answer was right.

    ``last_words`` end the last reasoning; ``stand_in`` replaces one that does not name the city (it takes
    city and country as ``%s``); ``tool_error`` is the text of the tool's answer.
    """
    messages = F.col("messages")

    def succeeded(m: Column) -> Column:
        low = F.lower(m.content)
        failed = (
            low.contains("search failed") | low.contains("api keys exhausted")
            | m.content.contains(K.FALLBACK_EXACT_MARKER) | low.contains("tool call error")
        )
        return (m.role == "user") & ~failed & (low.contains("search results") | low.contains("zoomed in on the image"))

    first = F.try_element_at(
        F.filter(messages, lambda m: (m.role == "assistant") & X.has(m.content, X.THINK) & X.has(m.content, X.STRICT_CALL)), F.lit(1)
    ).content
    closing = _final_answer(messages)
    staged = (
        traj.where((F.coalesce("masked", F.lit(1.0)) == 0) & (F.col("km") <= 200) & (F.coalesce("n_tool_calls", F.lit(0)) >= 1))
        .where(B.has_marker(messages, "fallback") & ~F.exists(messages, lambda m: F.coalesce(succeeded(m), F.lit(False))))
        .select(
            "id",
            X.strip(X.first_match(first, X.THINK)).alias("first_think"),
            X.strip(X.first_match(first, X.STRICT_CALL)).alias("call"),
            X.strip(X.first_match(closing, X.ANSWER)).alias("answer"),
            F.coalesce(X.strip(X.first_match(closing, X.THINK)), F.lit("")).alias("last_think"),
            F.try_element_at("images", F.lit(1)).alias("image"),
        )
        .withColumn("fields", _answer_fields(F.col("answer")))
        .withColumn("city", _named_city(F.col("fields")))
        .where(X.json_value(F.col("call")).isNotNull() & F.col("city").isNotNull() & (F.coalesce("image", F.lit("")) != ""))
        .where(X.mentions(F.col("first_think"), F.col("city")))
    )
    opening = X.strip(F.regexp_replace("first_think", "(?s)<useful>.*?</useful>", ""))
    opening = F.concat(
        F.regexp_replace(F.regexp_replace(opening, "(?is)" + K.FALLBACK_TAIL_PATTERN, ""), r"[ .]+\z", ""), F.lit(".")
    )
    ending = F.coalesce(
        X.trim_closing(F.col("last_think"), F.col("city"), last_words),
        F.format_string(stand_in, F.col("city"), F.col("fields")[0]),
    )
    return staged.select(
        "id",
        F.array(
            say("system", system),
            say("user", user),
            say("assistant", F.concat(F.lit("<think>\n"), opening, F.lit("\n</think>\n<tool_call>"), F.col("call"), F.lit("</tool_call>"))),
            say("user", tool_error),
            say("assistant", F.concat(F.lit("<think>\n"), ending, F.lit("\n</think>\n\n<answer>"), F.col("answer"), F.lit("</answer>"))),
        ).alias("messages"),
        F.array(F.struct(F.col("image").alias("image"))).alias("images"),
    )


def build_notool_templated(
    meta: DataFrame, system: str, user: str, templates: Sequence[str], templates_without_city: Sequence[str], seed: int
) -> DataFrame:
    """Samples without tools whose reasoning comes from a template.

    Templates use ``{city} {country} {region} {continent}``.
    """
    clean = {c: X.strip(F.coalesce(F.col(c), F.lit(""))) for c in ("city", "country", "region", "continent")}
    country = clean["country"]
    region = F.coalesce(F.nullif(clean["region"], F.lit("")), country)
    continent = F.coalesce(F.nullif(clean["continent"], F.lit("")), F.lit("the world"))
    has_city = ~F.lower(clean["city"]).isin("", "none", "nan", "null")
    think = F.when(has_city, pick_from_pool(templates, seed, "id")).otherwise(pick_from_pool(templates_without_city, seed, "id"))
    for name, value in {"city": clean["city"], "country": country, "region": region, "continent": continent}.items():
        think = F.replace(think, F.lit("{" + name + "}"), value)
    place = F.coalesce(F.nullif(clean["city"], F.lit("")), country)
    shown = F.coalesce(F.nullif(country, F.lit("")), F.lit("Unknown"))
    answer = F.concat_ws(", ", shown, place, G.fixed4(F.col("latitude")), G.fixed4(F.col("longitude")))
    body = F.concat(F.lit("<think>\n"), think, F.lit("\n</think>\n\n<answer>"), answer, F.lit("</answer>"))
    rows = B.drop_sentinels(B.require(meta, ["latitude", "longitude", "country", "path"]), "country")
    return rows.select(
        "id",
        F.array(say("system", system), say("user", user), say("assistant", body)).alias("messages"),
        F.array(F.struct(X.strip(F.col("path")).alias("image"))).alias("images"),
    )


def build_notool_real(traj: DataFrame, system: str, user: str, closing: str) -> DataFrame:
    """Samples without tools from confident reasoning of very close predictions."""
    messages = F.col("messages")
    first = F.try_element_at(F.filter(messages, lambda m: (m.role == "assistant") & X.has(m.content, X.THINK)), F.lit(1)).content
    staged = (
        traj.where((F.coalesce("masked", F.lit(1.0)) == 0) & (F.col("km") < 1))
        .select(
            "id",
            "km",
            X.strip(X.first_match(first, X.THINK)).alias("think"),
            X.strip(X.first_match(_final_answer(messages), X.ANSWER)).alias("answer"),
            F.try_element_at("images", F.lit(1)).alias("image"),
            B.has_marker(messages, "notool").alias("has_api_error"),
        )
        .where((F.col("think") != "") & (F.col("answer") != "") & (X.confidence_count(F.col("think")) >= 1))
        .withColumn("city", _named_city(_answer_fields(F.col("answer"))))
        .where(F.col("city").isNotNull() & X.mentions(F.col("think"), F.col("city")))
        .withColumn("think", X.truncate_think(F.col("think"), closing))
        .where(~X.has(F.col("think"), "(?i)" + K.TOOL_MENTION_PATTERN) & (F.coalesce("image", F.lit("")) != ""))
    )
    body = F.concat(F.lit("<think>\n"), F.col("think"), F.lit("\n</think>\n\n<answer>"), F.col("answer"), F.lit("</answer>"))
    return staged.select(
        "id",
        F.array(say("system", system), say("user", user), say("assistant", body)).alias("messages"),
        F.array(F.struct(F.col("image").alias("image"))).alias("images"),
        "km",
        "has_api_error",
    )


SKIP_REASONS = ["no_trajectory", "masked_no_tools", "no_full_coverage"]


def tag_skips(meta: DataFrame, traj: DataFrame, require_full_coverage: bool = False) -> DataFrame:
    """Metadata left-joined with trajectories, with the reason why a row is skipped (null to keep)."""
    joined = B.require(meta, ["latitude", "longitude"]).join(traj, "id", "left")
    reason = F.when(F.coalesce(F.try_element_at("images", F.lit(1)), F.lit("")) == "", SKIP_REASONS[0]).when(
        B.masked_without_tools(), SKIP_REASONS[1]
    )
    if require_full_coverage:
        covered = B.full_coverage(F.col("messages"), F.col("useful_results"))
        reason = reason.when(~covered, SKIP_REASONS[2])
    return joined.withColumn("skip_reason", reason)


def skip_counts(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy(F.coalesce("skip_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _rl_row(system: str, user: str, root: str, source: str, split: str, ability: str, agent: str) -> list[Column]:
    image = G.relative_path(F.try_element_at("images", F.lit(1)), root)
    truth = G.ground_truth_text(
        F.col("latitude"), F.col("longitude"), G.default_place(F.col("country")), G.default_place(F.col("city"))
    )
    kwargs = F.create_map(
        *[
            x
            for tool in (K.ZOOM, K.IMAGE_SEARCH, K.TEXT_SEARCH)
            for x in (F.lit(tool), F.struct(F.struct(image.alias("image")).alias("create_kwargs")))
        ]
    )
    return [
        F.lit(source).alias("data_source"),
        F.array(say("system", system), say("user", user)).alias("prompt"),
        F.array(F.struct(image.alias("image_url"))).alias("images"),
        F.lit(ability).alias("ability"),
        F.struct(truth.alias("ground_truth"), F.lit("rule").alias("style")).alias("reward_model"),
        F.lit(agent).alias("agent_name"),
        F.struct(
            truth.alias("answer"),
            F.lit(None).cast("bigint").alias("index"),
            F.col("id").cast("string").alias("img_id"),
            F.col("part").cast("string").alias("part"),
            G.difficulty(F.col("km")).alias("difficulty"),
            F.col("km").alias("km"),
            F.lit(True).alias("need_tools_kwargs"),
            F.lit(split).alias("split"),
            kwargs.alias("tools_kwargs"),
            F.col("useful_results").alias("useful_results"),
        ).alias("extra_info"),
    ]


def build_rl(
    meta: DataFrame,
    traj: DataFrame,
    system: str,
    user: str,
    require_full_coverage: bool = False,
    drop_failed: bool = False,
    drop_full_image: bool = False,
    root: str = "",
    difficulties: Sequence[str] | None = None,
    seed: int = 42,
    source: str = "training",
    ability: str = "location",
    agent: str = "tools",
) -> DataFrame:
    """Reinforcement samples: metadata joined with trajectories, filtered, nested and re-indexed."""
    messages = F.col("messages")
    if drop_failed:
        traj = traj.where(~B.has_marker(messages, "rl"))
    if drop_full_image:
        traj = traj.where(~B.has_full_image_search(messages))
    kept = tag_skips(meta, traj, require_full_coverage).where("skip_reason is null")
    if difficulties:
        kept = B.keep_difficulty(kept, difficulties)
    rows = kept.select("id", *_rl_row(system, user, root, source, "train", ability, agent))
    indexed = ranked_by_hash(rows, seed, "id")
    return indexed.withColumn("extra_info", F.col("extra_info").withField("index", F.col("rank") - 1)).drop("rank", "id")


def build_val(
    truth: DataFrame, traj: DataFrame, order: Sequence[Column], system: str, user: str, part: str, seed: int = 42, ability: str = "location", agent: str = "tools"
) -> DataFrame:
    """Validation samples: ground truth joined with the latest trajectory of each id."""
    latest = dedupe_last(traj, "id", order)
    rows = truth.join(latest, "id").where(F.coalesce(F.try_element_at("images", F.lit(1)), F.lit("")) != "")
    rows = rows.withColumn("part", F.lit(part)).select("id", *_rl_row(system, user, "", part, "val", ability, agent))
    indexed = ranked_by_hash(rows, seed, "id")
    return indexed.withColumn("extra_info", F.col("extra_info").withField("index", F.col("rank") - 1)).drop("rank", "id")


def explode_responses(df: DataFrame, responses: str = "responses") -> DataFrame:
    return df.select(*[c for c in df.columns if c != responses], F.posexplode(responses).alias("response_no", "response"))


def repeat_rows(df: DataFrame, order: str, n: int | None = None, mode: str = "interleave", counts: str | None = None) -> DataFrame:
    """Rows repeated n times (copies together or one whole copy after the other) or by a count column.

    ``repeat_key`` is a struct that sorts the rows into the repeated order.
    """
    if counts is not None:
        times, mode = F.col(counts).cast("int"), "interleave"
    else:
        times = F.lit(n)
    copies = F.when(times >= 1, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))
    out = df.withColumn("repeat_no", F.explode(copies))
    first, second = (order, "repeat_no") if mode == "interleave" else ("repeat_no", order)
    return out.withColumn("repeat_key", F.struct(F.col(first).alias("a"), F.col(second).alias("b")))


def pad_to_divisor(df: DataFrame, rank: str, k: int) -> DataFrame:
    """Rows plus recycled leading rows so that the count is a multiple of k; ``is_pad`` marks them.

    ``rank`` is a dense 1-based rank. The recycled rows are found by rank, at most k - 1 of them,
    and wrap around when the table is shorter than that.
    """
    n = F.coalesce(df.agg(F.max(rank)).scalar(), F.lit(0))
    pads = df.withColumn("__n", n).withColumn("__need", F.pmod(-F.col("__n"), F.lit(k)))
    pads = pads.where(F.col(rank) <= F.col("__need"))
    slots = F.sequence(F.col("__n") + F.col(rank), F.col("__n") + F.col("__need"), F.col("__n"))
    pads = pads.withColumn("__slot", F.explode(slots)).withColumn(rank, F.col("__slot").cast(df.schema[rank].dataType))
    pads = pads.drop("__n", "__need", "__slot").withColumn("is_pad", F.lit(True))
    return df.withColumn("is_pad", F.lit(False)).unionByName(pads)


def unpad(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_pad")).drop("is_pad")


def unfold_chunks(df: DataFrame, n: int, columns: Sequence[str]) -> DataFrame:
    """Array columns cut into n equal chunks, one row each; other columns repeat."""
    out = df.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.withColumns(
        {
            c: F.slice(F.col(c), (F.col("chunk_no") * F.floor(F.size(c) / n) + 1).cast("int"), F.floor(F.size(c) / n).cast("int"))
            for c in columns
        }
    )


def preference_rows(df: DataFrame) -> DataFrame:
    """Two labelled rows per (prompt, chosen, rejected)."""
    sides = F.array(
        F.struct(F.lit(1).alias("label"), F.col("chosen").alias("response")),
        F.struct(F.lit(0).alias("label"), F.col("rejected").alias("response")),
    )
    return df.select(*[c for c in df.columns if c not in ("chosen", "rejected")], F.inline(sides))


def append_generated(df: DataFrame, generated: DataFrame, max_length: int, text: str = "prompt") -> DataFrame:
    return df.unionByName(B.filter_overlong(generated, max_length, text=text), allowMissingColumns=True)
