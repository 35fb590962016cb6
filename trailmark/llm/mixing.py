"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.llm.common import attach, packed, word_count, written

FAN_IN = 256
NEAR = 1e-9
WEIGHTS = (5, 2, 1)


def source_targets(counts: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """sid, source, n, source_size, target of each source of (source, n, source_size).

    Sources in code point order, null last, take the weights in turn. They share ``share`` of all sizes
    by weight; a source stops at ``most`` times its size and the excess is shared anew, which ends
    at min(most * size, level * weight) for one level. In the order of size over weight, the level is
    that of the first source which stays below its stop. One row per source; no row of a document.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1
    ranked = counts.withColumn("sid", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int"))
    )
    ranked = ranked.withColumn("stop", F.col("source_size") * F.lit(float(most)))
    ordered = W.orderBy(F.col("stop") / F.col("weight"), "sid")
    before, everything = ordered.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", left / heavy).withColumn("place", F.row_number().over(ordered))
    fits = F.when(F.col("level") <= F.col("stop") / F.col("weight"), F.struct("place", "level"))
    level = F.min(fits).over(everything)["level"]
    target = F.least(F.col("stop"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return levels.select("sid", "source", "n", "source_size", target.alias("target"))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) with 53 random bits, decided by the keys."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))


def _let(value: Column, use) -> Column:
    """Evaluates ``value`` once for an expression that mentions it several times."""
    return F.transform(F.array(value), use)[0]


def _pivot(seed: int):
    """Merges one item into the open one: mass moves, in words, until one of the two is integral.

    Raising one by d words lowers the other by d words, with odds that leave every expectation as it
    was, so the words taken from the pair never change.
    """

    def step(state: Column, item: Column) -> Column:
        open_, done = state["open"], state["done"]
        up = F.least(open_["size"] * (1 - open_["pi"]), item["size"] * item["pi"])
        down = F.least(open_["size"] * open_["pi"], item["size"] * (1 - item["pi"]))
        draw = uniform(seed, open_["id"], item["id"], open_["size"], item["size"])

        def moved(t: Column) -> Column:
            shift = F.when(draw * (t["up"] + t["down"]) < t["down"], t["up"]).otherwise(-t["down"])
            return _let(F.struct((open_["pi"] + shift / open_["size"]).alias("a"), (item["pi"] - shift / item["size"]).alias("b")), settle)

        def settle(p: Column) -> Column:
            whole = lambda x: (x < NEAR) | (x > 1 - NEAR)
            first, second = as_done(open_, p["a"]), as_done(item, p["b"])
            return (
                F.when(whole(p["a"]) & whole(p["b"]), state_of(nothing(), F.concat(done, F.array(first, second))))
                .when(whole(p["a"]), state_of(as_open(item, p["b"]), F.concat(done, F.array(first))))
                .otherwise(state_of(as_open(open_, p["a"]), F.concat(done, F.array(second))))
            )

        pair = F.struct(up.alias("up"), down.alias("down"))
        return F.when(open_["size"] == 0, state_of(as_open(item, item["pi"]), done)).otherwise(_let(pair, moved))

    return step


def nothing() -> Column:
    return F.struct(F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("pi"))


def as_open(item: Column, pi: Column) -> Column:
    return F.struct(item["id"].alias("id"), item["size"].alias("size"), pi.alias("pi"))


def as_done(item: Column, pi: Column) -> Column:
    return F.struct(item["id"].alias("id"), item["size"].alias("size"), F.round(pi).cast("int").alias("copy"))


def state_of(open_: Column, done: Column) -> Column:
    return F.struct(open_.alias("open"), done.alias("done"))


def rounded(items: DataFrame, keys: Sequence[str], n: str, seed: int) -> DataFrame:
    """keys, id, size, copy (0 or 1) of items with a fraction ``pi`` strictly between 0 and 1.

    A reduction tree: each node takes about ``FAN_IN`` items of one group, settles all but one of
    them, and hands that one up. ``n`` is the number of items of the group, so the depth is
    the logarithm of the largest group. Each level is written before the next reads it. The words
    of a group's copies differ from the sum of size * pi by less than the size of the last open item.
    A node goes from large items to small ones, so that its open item is small in most cases.
    """
    keys = list(keys)
    most = items.agg(F.max(n)).first()[0] or 0
    settled, level = [], 0
    while True:
        nodes = F.ceil(F.col(n) / F.lit(FAN_IN)).cast("long")
        node = F.pmod(F.xxhash64(F.lit(seed + level), "id", "size"), nodes)
        empty = F.array().cast("array<struct<id:bigint,size:bigint,copy:int>>")
        folded = F.aggregate(
            F.sort_array(F.collect_list(F.struct("size", "id", "pi")), asc=False), state_of(nothing(), empty), _pivot(seed + level)
        )
        grouped = items.withColumn("__node", node).groupBy(*keys, n, "__node").agg(folded.alias("state"))
        grouped = written(grouped, "rounding")
        settled.append(grouped.select(*keys, F.inline("state.done")))
        items = grouped.where("state.open.size > 0").select(
            *keys, F.ceil(F.col(n) / F.lit(FAN_IN)).cast("long").alias(n), "state.open.*"
        )
        most, level = math.ceil(most / FAN_IN), level + 1
        if most <= 1:
            break
    last = (uniform(seed - 1, F.col("id"), F.col("size")) < F.col("pi")).cast("int")
    settled.append(items.select(*keys, "id", "size", last.alias("copy")))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


def mixed(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row of (doc_id, text, source).

    A source's documents all expect target / source_size copies. The whole part is given to each; the
    fractions are rounded together, so that the words taken stay within one document of the target.
    Draws depend on ids, sizes and ``seed`` alone: reruns agree. A null or empty text has size 0
    and takes nothing; a null source is a source; repeated rows are rounded one by one.
    """
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count("text").alias("size")), "sizes")
    has = F.when(F.col("size") > 0, 1)
    counts = sized.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count(has).alias("n_items"), F.coalesce(F.sum("size"), F.lit(0)).alias("source_size")
    )
    targets = source_targets(counts, weights, share, most)
    lookup = written(targets.join(counts.select(F.struct("source").alias("__s"), "n_items"), F.struct("source") == F.col("__s")).drop("__s"), "targets")
    total = lookup.agg(F.sum("n")).first()[0] or 0
    met = attach(sized, lookup, "source", "n", total, F.struct("doc_id", "size"))
    copies = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    met = met.withColumn("expected", copies)
    # Within rounding of a whole number, nothing is left to round.
    base = F.floor(F.col("expected") + F.lit(NEAR)).cast("int")
    met = written(met.withColumn("base", base).withColumn("pi", F.greatest(F.col("expected") - base, F.lit(0.0))), "expected")
    keys = ["sid", "source", "source_size", "target", "base"]
    split = F.col("pi") > F.lit(NEAR)
    items = met.where(split).select(*keys, "n_items", F.col("doc_id").alias("id"), "size", "pi")
    parts = rounded(items, keys, "n_items", seed).withColumnRenamed("id", "doc_id")
    rest = met.where(~split).select(*keys, "doc_id", "size", F.lit(0).alias("copy"))
    out = parts.unionByName(rest).withColumn("copies", F.col("base") + F.col("copy"))
    return out.select(
        "doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), "copies",
        (F.col("size") * F.col("copies")).cast("long").alias("taken"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: every row as often as it is taken, with all its columns."""
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count("text").alias("size"))
    taken = mixed(docs, **options).groupBy(F.struct("doc_id", "source", "size").alias("key"))
    # Rows that share id, source and size stay apart: each takes one of the counts in turn.
    counts = taken.agg(F.sort_array(F.collect_list("copies"), asc=False).alias("counts"))
    turn = W.partitionBy("key").orderBy(F.md5(F.coalesce("row.text", F.lit(""))))
    ranked = packed(docs, key=key).join(counts, "key").withColumn("copies", F.col("counts")[F.row_number().over(turn) - 1])
    return ranked.where(F.col("copies") > 0).select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")
