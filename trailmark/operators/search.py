"""Search-result caches: nesting, result pages, matching of new calls to cached ones, rewards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.functions import constants as K
from trailmark.functions import geo as G
from trailmark.functions.core import let
from trailmark.operators.groups import attach_lookup
from trailmark.operators.ordering import join_null_safe, ordinal_bucket, ranked, running, seed_hash
from trailmark.session import scratch_path


def dedupe_prefer_useful(df: DataFrame, keys: Sequence[str], useful: str = "is_geo_useful", ties: Sequence[str] = ()) -> DataFrame:
    """One row per key, a useful one when there is any. The rank limit drops duplicates before the shuffle."""
    order = W.partitionBy(*keys).orderBy(F.col(useful).desc(), *ties)
    return df.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def nest_cache(df: DataFrame, image: str, fields: Sequence[str]) -> DataFrame:
    """Useful and other results of each cached call as arrays in position order (one page per call)."""
    item = F.struct("result_pos", *fields)
    useful = F.col("is_geo_useful")

    def page(condition: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(condition, item)))

    nested = df.groupBy(image, "call_idx").agg(page(useful).alias("pos_results"), page(~useful).alias("neg_results"))
    return nested.withColumn("all_results", F.concat("pos_results", "neg_results"))


def negmix(df: DataFrame, image: str, n_pos: int, max_results: int, seed: int) -> DataFrame:
    """Mixed result page: sampled useful results filled up with other results of the same call, shuffled.

    Adds ``shown_pos`` (1-based position on the page); a page is bounded by ``max_results``.
    """
    keys = [image, "call_idx"]
    pick = seed_hash(f"{seed}a", image, "call_idx", "result_pos")
    place = seed_hash(f"{seed}b", image, "call_idx", "result_pos")
    per_kind = W.partitionBy(*keys, "is_geo_useful").orderBy(pick, "result_pos")
    per_call = W.partitionBy(*keys)
    # A page never shows more of a kind than it holds; the rank limit drops the rest before the shuffle.
    first = df.withColumn("__rank", F.row_number().over(per_kind)).where(F.col("__rank") <= max_results)
    useful = F.count(F.when(F.col("is_geo_useful"), 1)).over(per_call)
    staged = first.withColumn("__pos", F.least(useful, F.lit(n_pos)))
    keep = F.when(F.col("is_geo_useful"), F.col("__rank") <= F.col("__pos")).otherwise(
        F.col("__rank") <= max_results - F.col("__pos")
    )
    shown = W.partitionBy(*keys).orderBy(place, "result_pos")
    return staged.where(keep).withColumn("shown_pos", F.row_number().over(shown)).drop("__rank", "__pos")


def plain_page(df: DataFrame, image: str, tool: str, max_results: int, base: float, per_pos: float) -> DataFrame:
    """Page without mixing. Text: useful results only, up to the maximum, with a reward per result.
    Image: all results, useful first, with the base reward."""
    keys = [image, "call_idx"]
    if tool == K.TEXT_SEARCH:
        order = W.partitionBy(*keys).orderBy("result_pos")
        page = df.where("is_geo_useful").withColumn("shown_pos", F.row_number().over(order)).where(F.col("shown_pos") <= max_results)
        return page.withColumn("reward", base + per_pos * F.count(F.lit(1)).over(W.partitionBy(*keys)))
    order = W.partitionBy(*keys).orderBy(F.col("is_geo_useful").desc(), "result_pos")
    return df.withColumns({"shown_pos": F.row_number().over(order), "reward": F.lit(base)})


def cursor_join(
    queries: DataFrame, cache: DataFrame, image: str, episode: str, order: str, valid: Column, copy_rows: int = 100_000
) -> DataFrame:
    """The k-th valid query of an episode beside cached call k mod n of its image; left join.

    Each query meets exactly one cached call, never all of its image. An image with q queries and n calls has about q / n
    queries for each call, so a call is copied once for every ``copy_rows`` of them and the queries are dealt over
    the copies: an image that holds a third of all queries spreads even if one call is cached for it.
    """
    asked = queries.groupBy(image).agg(F.count(F.lit(1)).alias("__q"))
    held = cache.groupBy(image).agg(F.count(F.lit(1)).alias("__n"))
    copies = F.ceil(F.coalesce("__q", F.lit(0)) / (F.col("__n") * F.lit(copy_rows)))
    sizes = join_null_safe(held, asked, [image], "left").select(image, "__n", F.greatest(copies, F.lit(1)).cast("int").alias("__copies"))
    slots = ranked(cache, [F.col("call_idx")], ordinal_bucket("call_idx"), [image], "__slot").withColumn("__slot", (F.col("__slot") - 1).cast("int"))
    copied = attach_lookup(slots, sizes.drop("__n"), image, "call_idx").withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    counted = running(
        queries.withColumns({"valid": valid, "__bucket": ordinal_bucket(order)}),
        [episode], "__bucket", [F.col(order)], {"cursor": F.col("valid").cast("int")},
    ).drop("__bucket")
    row = F.struct(*queries.columns)
    placed = (
        attach_lookup(counted, sizes, image, row)
        .withColumn("cursor", F.when(F.col("valid"), F.col("cursor") - 1))
        .withColumn("__slot", F.pmod(F.col("cursor"), F.col("__n")).cast("int"))
        .withColumn("__copy", F.pmod(F.xxhash64(row), F.col("__copies")).cast("int"))
    )
    calls = copied.drop("__copies").withColumnsRenamed({"bbox": "cached_bbox"})
    return placed.join(calls, [image, "__slot", "__copy"], "left").drop("__slot", "__n", "__copy", "__copies")


def search_reward(joined: DataFrame, threshold: float = 0.5, coeff: float = K.IOU_COEFF) -> DataFrame:
    """Overlap, hit flag and reward of each image search after :func:`cursor_join`."""
    iou = G.box_iou(F.col("bbox"), F.col("cached_bbox"))
    return (
        joined.withColumn("iou", F.when(F.col("valid"), iou))
        .withColumn("cache_hit", F.coalesce(F.col("iou") >= threshold, F.lit(False)))
        .withColumn(
            "reward",
            F.when(~F.col("valid"), K.INVALID_BBOX_REWARD).when(F.col("cache_hit"), F.col("iou") * coeff).otherwise(0.0),
        )
    )


def iou_join(queries: DataFrame, cache: DataFrame, image: str, episode: str, order: str, threshold: float = 0.5) -> DataFrame:
    """Queries whose box overlaps their cached call enough."""
    joined = cursor_join(queries, cache, image, episode, order, G.box_valid(F.col("bbox")))
    return search_reward(joined, threshold).where("cache_hit")


def token_set(text: Column) -> Column:
    """Sorted distinct lower-case words."""
    words = F.filter(F.split(F.lower(text), r"(?U)\s+", -1), lambda w: w != "")
    return F.array_sort(F.array_distinct(words))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two word sets: 1 when both are empty, 0 when one is."""
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
        .when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
    )


def cached_words(cache: DataFrame, image: str, most_calls: int, distinct: bool) -> DataFrame:
    """One row per image: its cached calls, or the first of each word set, as an array of at most ``most_calls``.

    An image with more is an error. Ranks are limited before the shuffle, so not even then is a larger array built.
    """
    sets = cache.select(image, "call_idx", token_set(F.col("query")).alias("words"))
    if distinct:
        sets = sets.groupBy(image, "words").agg(F.min("call_idx").alias("call_idx"))
    first = sets.withColumn("__rank", F.row_number().over(W.partitionBy(image).orderBy("call_idx"))).where(F.col("__rank") <= most_calls + 1)
    listed = first.groupBy(image).agg(F.array_sort(F.collect_list(F.struct("call_idx", "words"))).alias("calls"))
    error = F.raise_error(F.concat(F.lit(f"more than {most_calls} calls are cached for "), F.coalesce(F.col(image).cast("string"), F.lit("null"))))
    return listed.withColumn("calls", F.when(F.size("calls") <= most_calls, F.col("calls")).otherwise(error))


def call_scores(calls: Column, words: Column) -> Column:
    """Score of every call of an array; equal scores fall to the first call."""
    return F.transform(calls, lambda c: F.struct(jaccard(words, c.words).alias("score"), (-c.call_idx).alias("neg")))


def jaccard_best(queries: DataFrame, cache: DataFrame, image: str, most_calls: int = 256) -> DataFrame:
    """Cached call with the most similar query per query; the earliest call wins ties.

    The calls of an image are a bounded array, so each query is scored in its own row: no pairs are made, and a word
    that all queries share costs nothing. An image with more than ``most_calls`` different calls is an
    error. A query that shares no word with any call takes the first call with score 0; one whose image has no
    cached call keeps a null call.
    """
    met = attach_lookup(queries, cached_words(cache, image, most_calls, True), image, F.struct(*queries.columns))
    best = let(token_set(F.col("query")), lambda words: F.array_max(call_scores(F.col("calls"), words)))
    return met.withColumn("__best", best).select(
        *queries.columns, (-F.col("__best.neg")).alias("call_idx"), F.col("__best.score").alias("score")
    )


def jaccard_best_with_memory(
    queries: DataFrame, cache: DataFrame, image: str, episode: str, order: str, penalty: float = 0.5,
    most_calls: int = 256, most_queries: int = 64,
) -> DataFrame:
    """As :func:`jaccard_best`, with a penalty for calls the episode has used already.

    Round k chooses for the k-th query of all episodes at once, beside a table of the calls that each episode has
    used; its choices are written and make the table of the next round. An episode with more than ``most_queries``
    queries about an image is an error, which bounds the rounds and the used calls.
    """
    spark = queries.sparkSession
    met = attach_lookup(queries, cached_words(cache, image, most_calls, False), image, F.struct(*queries.columns))
    error = F.raise_error(F.lit(f"an episode has more than {most_queries} queries")).cast("int")
    scored = (
        met.withColumn("__scores", let(token_set(F.col("query")), lambda words: call_scores(F.col("calls"), words)))
        .select(F.col(episode).alias("__e"), F.col(image).alias("__i"), F.col(order).alias("__o"), "__scores")
        .withColumn("__k", F.row_number().over(W.partitionBy("__e", "__i").orderBy("__o")))
        .where(F.col("__k") <= most_queries + 1)
        .withColumn("__k", F.when(F.col("__k") <= most_queries, F.col("__k")).otherwise(error))
    )
    folder = scratch_path(spark, "asked")
    scored.write.partitionBy("__k").parquet(folder)
    asked = spark.read.schema(scored.schema).parquet(folder)
    rounds, used = [], None
    for k in range(1, (asked.agg(F.max("__k")).first()[0] or 0) + 1):
        now = asked.where(F.col("__k") == k)
        if used is None:
            now = now.withColumn("__used", F.array().cast("array<int>"))
        else:
            now = join_null_safe(now, used, ["__e", "__i"])
        again = F.transform("__scores", lambda s: F.struct((s.score - F.when(F.array_contains("__used", -s.neg), penalty).otherwise(0.0)).alias("score"), s.neg.alias("neg")))
        best = now.withColumn("__best", F.array_max(again)).withColumn("__call", -F.col("__best.neg"))
        path = scratch_path(spark, f"round-{k}")
        chosen = best.select("__e", "__i", "__o", "__call", F.col("__best.score").alias("__score"), F.when(F.col("__call").isNull(), F.col("__used")).otherwise(F.concat("__used", F.array("__call"))).alias("__used"))
        chosen.write.parquet(path)
        rounds.append(path)
        used = spark.read.schema(chosen.schema).parquet(path).select("__e", "__i", "__used")
    names = {"__e": episode, "__i": image, "__o": order, "__call": "call_idx", "__score": "score"}
    out = [F.col(a).alias(b) for a, b in names.items() if not (a == "__i" and image == episode)]
    if not rounds:
        return scored.select(*[F.col(a) for a in ("__e", "__i", "__o")], F.lit(None).cast("int").alias("__call"), F.lit(None).cast("double").alias("__score")).limit(0).select(*out)
    return spark.read.schema(chosen.schema).parquet(*rounds).select(*out)


def confusion(pred: Column, truth: Column, n: Column) -> dict[str, Column]:
    """tp, fp, fn, tn of two index arrays over 1..n."""
    everything = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return {
        "tp": F.size(F.array_intersect(pred, truth)),
        "fp": F.size(F.array_except(pred, truth)),
        "fn": F.size(F.array_except(truth, pred)),
        "tn": F.size(F.array_except(F.array_except(everything, pred), truth)),
    }


def mcc(pred: Column, truth: Column, n: Column) -> Column:
    """Matthews correlation of two index sets: 1 when both are empty, 0 for a zero denominator."""
    c = {k: v.cast("double") for k, v in confusion(pred, truth, n).items()}
    product = (c["tp"] + c["fp"]) * (c["tp"] + c["fn"]) * (c["tn"] + c["fp"]) * (c["tn"] + c["fn"])
    return (
        F.when((F.size(pred) == 0) & (F.size(truth) == 0), 1.0)
        .when(product == 0, 0.0)
        .otherwise((c["tp"] * c["tn"] - c["fp"] * c["fn"]) / F.sqrt(product))
    )


def exclude_domains(df: DataFrame, domains: Sequence[str], source: Column, link: Column) -> DataFrame:
    """Drop results whose source (or link, without a source) contains one of the domains."""
    where = F.lower(F.coalesce(F.nullif(source, F.lit("")), link, F.lit("")))
    names = F.array(*[F.lit(d.lower()) for d in domains])
    listed = let(where, lambda w: F.exists(names, lambda d: w.contains(d)))
    return df.where(~listed)


def call_budget(calls: DataFrame, episode: str, order: Sequence[str], limits: dict[str, int] = K.CALL_LIMITS) -> DataFrame:
    """Running number of each tool's calls in an episode and whether the budget still allows it."""
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    numbered = ranked(calls, [F.col(c) for c in order], ordinal_bucket(order[0]), [episode, "name"], "used")
    return numbered.withColumn("used", F.col("used").cast("int")).withColumn(
        "allowed", F.coalesce(F.col("used") <= F.try_element_at(limit, F.col("name")), F.lit(True))
    )


def tool_stats(calls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Calls, mean reward, box overlap, cache-hit rate and mean discrimination per tool."""
    return calls.groupBy(*by, "tool_name").agg(
        F.count(F.lit(1)).alias("call_count"),
        F.avg("reward").alias("reward_mean"),
        F.avg("iou").alias("crop_iou_mean"),
        F.avg((F.col("iou") >= 0.5).cast("double")).alias("crop_iou_hit_rate"),
        F.avg(F.col("cache_hit").cast("double")).alias("cache_hit_rate"),
        F.avg("mcc_score").alias("discrimination_mean"),
    )


def total_tool_reward(df: DataFrame, rewards: str = "tool_rewards") -> DataFrame:
    """``tool/total_reward/mean``: mean over the samples of their summed tool rewards.

    A sample with an empty list counts as 0; one without a list does not count, and null rewards in a list are nothing.
    """
    total = F.aggregate(F.filter(F.col(rewards), lambda r: r.isNotNull()), F.lit(0.0), lambda a, r: a + r.cast("double"))
    return df.agg(F.count(rewards).alias("n_samples"), F.avg(total).alias("total_reward_mean"))


def sample_tool_rollup(samples: DataFrame, calls: DataFrame, key: str) -> DataFrame:
    """Per-sample tool counters with every key filled, zero where a tool was not used."""
    image, text, zoom = (F.col("tool_name") == t for t in (K.IMAGE_SEARCH, K.TEXT_SEARCH, K.ZOOM))

    def count(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    def total(condition: Column, value: str) -> Column:
        return F.sum(F.when(condition, F.col(value)))

    rolled = calls.groupBy(key).agg(
        count(image).alias("img_search_calls"),
        F.round(total(image, "reward"), 4).alias("img_search_reward"),
        total(image, "n_pos").alias("img_search_n_pos"),
        count(image & F.col("cache_hit")).alias("img_search_cache_hits"),
        F.round(F.max(F.when(image, F.col("iou"))), 4).alias("img_search_iou_max"),
        F.round(F.avg(F.when(image, F.col("iou"))), 4).alias("img_search_iou_mean"),
        count(text).alias("txt_search_calls"),
        F.round(total(text, "reward"), 4).alias("txt_search_reward"),
        total(text, "n_pos").alias("txt_search_n_pos"),
        count(text & F.col("cache_hit")).alias("txt_search_cache_hits"),
        count(zoom).alias("zoom_calls"),
        count(zoom & (F.col("reward") < 0)).alias("zoom_bad_bbox"),
    )
    filled = samples.select(key).join(rolled, key, "left")
    return filled.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in rolled.columns if c != key})


def cache_profile(cache: DataFrame, image: str) -> DataFrame:
    """Images, useful results, mean highest call index per image, mean results per call."""
    per_call = cache.groupBy(image, "call_idx").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_geo_useful"), 1)).alias("u")
    )
    per_image = per_call.groupBy(image).agg(
        F.max("call_idx").alias("last"), F.sum("n").alias("n"), F.sum("u").alias("u"), F.count(F.lit(1)).alias("calls")
    )
    return per_image.agg(
        F.count(F.lit(1)).alias("n_images"),
        F.sum("u").alias("n_useful"),
        F.avg("last").alias("mean_last_call"),
        (F.sum("n") / F.sum("calls")).alias("mean_results_per_call"),
    )


def flatten_sections(df: DataFrame, sections: dict[str, int], out: str = "results") -> DataFrame:
    """First entries of each section array, concatenated in section order."""
    return df.withColumn(out, F.concat(*[F.slice(F.coalesce(F.col(c), F.array()), 1, n) for c, n in sections.items()]))
