"""Seeded sampling, splits, batches, shards and set unions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.functions import constants as K
from trailmark.operators.groups import attach_lookup
from trailmark.operators.ordering import (
    BUCKETS,
    at_ranks,
    hash_bucket,
    hash_cutoff,
    join_null_safe,
    ordinal_bucket,
    ranked,
    ranked_by_hash,
    ranked_by_value,
    ranked_with_ties,
    running,
    seed_hash,
    unit_interval,
    value_cutoff,
    with_value_bucket,
)
from trailmark.session import checkpoint_root, written


def row_count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """Seeded sample of n rows (all rows when there are fewer); ``key`` must be unique.

    The n-th smallest digest is found first, so the rows themselves are only filtered.
    """
    cutoff = hash_cutoff(df, seed, key, n).select("cutoff").scalar()
    return df.where(F.coalesce(seed_hash(seed, key) <= cutoff, F.lit(True)))


def cap_per_class(df: DataFrame, column: str, n: int, seed: int, key: str) -> DataFrame:
    """At most n rows per class, seeded; classes at or below n keep all rows."""
    cutoffs = hash_cutoff(df, seed, key, n, [column])
    # At most one class per n rows is above the cap, so n copies of the cut-offs are no more than the rows.
    joined = attach_lookup(df, cutoffs, column, key, rows="__rows")
    return joined.where(F.col("cutoff").isNull() | (seed_hash(seed, key) <= F.col("cutoff"))).drop("cutoff")


def split_count(df: DataFrame, ratio: float, seed: int, key: str) -> DataFrame:
    """Adds ``split``: exactly max(1, int(n * ratio)) rows are ``val``, the others ``train``."""
    n_val = F.greatest(F.lit(1), F.floor(row_count(df) * ratio)).cast("bigint")
    cutoff = hash_cutoff(df, seed, key, n_val).select("cutoff").scalar()
    return df.withColumn("split", F.when(seed_hash(seed, key) <= cutoff, "val").otherwise("train"))


def split_prob(df: DataFrame, ratio: float, seed: int, key: str) -> DataFrame:
    """Adds ``split``: each row is ``test`` with the given probability, seeded."""
    return df.withColumn("split", F.when(unit_interval(seed_hash(seed, key), 8) < ratio, "test").otherwise("train"))


def max_samples(df: DataFrame, n: int, key: str, shuffle: bool = False, seed: int = 1) -> DataFrame:
    """A seeded choice of n rows, or the first n rows in key order."""
    if shuffle:
        return sample_n(df, n, seed, key)
    return rank_slice(df, key, 1, n)


def rank_slice(df: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """The rows numbered ``first`` to ``last`` in the order of a unique numeric key.

    The keys at both ends are found first, so the rows themselves are only filtered.
    """
    kept = df
    upper = value_cutoff(df, key, last).scalar()
    kept = kept.where(F.coalesce(F.col(key) <= upper, F.lit(True)))
    if first > 1:  # with fewer rows than that, none is left
        lower = value_cutoff(df, key, first - 1).scalar()
        kept = kept.where(F.coalesce(F.col(key) > lower, F.lit(False)))
    return kept


def reindex(df: DataFrame, key: str, name: str = "index") -> DataFrame:
    """Dense index from zero in the order of a unique numeric key."""
    return ranked_by_value(df, key, name=name).withColumn(name, F.col(name) - 1)


def split_equal(df: DataFrame, k: int, key: str) -> DataFrame:
    """Adds ``part``: k contiguous parts of equal size; a count that k does not divide is an error."""
    size = row_count(df)
    checked = F.when(size % k == 0, F.floor(size / k)).otherwise(
        F.raise_error(F.concat(F.lit("cannot split into equal parts: "), size.cast("string")))
    )
    return ranked_by_value(df, key).withColumn("part", F.floor((F.col("rank") - 1) / checked).cast("int")).drop("rank")


def preview(df: DataFrame, group: str, order: Sequence[Column], n: int = 20) -> DataFrame:
    """First n rows per group; the rank limit cuts a hot group before the shuffle."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def replay_sample(df: DataFrame, order: str, capacity: int, n: int, seed: int) -> DataFrame:
    """Seeded sample of n rows from the newest ``capacity`` rows; a shorter pool is an error."""
    size = row_count(df)
    oldest = value_cutoff(df, order, capacity, ascending=False).scalar()
    pool = df.where(F.coalesce(F.col(order) >= oldest, F.lit(True)))
    enough = F.when(F.least(size, F.lit(capacity)) >= n, F.lit(True)).otherwise(
        F.raise_error(F.lit("not enough rows in the pool")).cast("boolean")
    )
    return sample_n(pool.where(enough), n, seed, order)


def assign_batches(df: DataFrame, size: int, epochs: int, seed: int, key: str) -> DataFrame:
    """Every epoch shuffles the rows anew and cuts them into batches; a ragged last batch is an error."""
    total = row_count(df)
    checked = F.when(total % size == 0, F.lit(size)).otherwise(F.raise_error(F.lit("rows do not fill the last batch")))
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    digest = seed_hash(seed, "epoch", key)
    out = ranked(rows, [digest, F.col(key)], hash_bucket(digest), ["epoch"])
    return out.withColumn("batch", F.floor((F.col("rank") - 1) / checked).cast("int")).withColumn(
        "place", ((F.col("rank") - 1) % size).cast("int")
    ).drop("rank")


def factorize(df: DataFrame, column: str, name: str = "group_id") -> DataFrame:
    """Dense ids 0..G-1 for labels of any sortable type, in label order.

    Distinct labels are range-sorted and checkpointed; their place is the partition's offset plus
    the place inside it.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
    labels = df.select(column).distinct().orderBy(column).checkpoint()
    placed = labels.withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    # One row per partition of the sort.
    offsets = F.broadcast(sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off")))
    ids = (
        placed.withColumn("__part", part)
        .join(offsets, "__part")
        .select(column, (F.col("__off") + F.col("__at").bitwiseAND(F.lit(2**33 - 1))).alias(name))
    )
    rest = [c for c in df.columns if c != column] or [column]
    return attach_lookup(df.withColumn("__spread", F.xxhash64(*rest)), ids, column, "__spread").drop("__spread")


def reweight(df: DataFrame, key: str, score: str, method: str, seed: int, power: float = 2.0, share: int = 1024) -> DataFrame:
    """As many draws as rows, with replacement, by a weight of the score; adds ``draw`` (the draw's key).

    Each row owns an interval of the total weight. Rows lie in ``BUCKETS`` of equally many, whatever their weights. The
    draws of a bucket are counted, and a bucket that gets more than a ``share``-th of them is copied that many times and
    its draws dealt over the copies; so neither rows of tiny weight nor draws of a heavy row share one task, and the
    copies are no more than ``1 + share / BUCKETS`` times the rows. A draw takes the last interval that starts at or before it;
    of rows too light to move the sum of weights, that start together, the last in digest order.
    """
    value = F.col(score)
    top, bottom = df.agg(F.max(score)).scalar(), df.agg(F.min(score)).scalar()
    weight = {
        "pow": lambda: F.pow(F.abs(value), F.lit(power)),
        "max_min": lambda: F.when((value == top) | (value == bottom), 1.0).otherwise(0.0),
        "max_random": lambda: F.when(value == top, 0.4).otherwise(0.1),
    }[method]() + 1e-8
    digest = seed_hash(seed, key)
    placed = running(
        df.withColumn("__w", weight).withColumn("__bucket", hash_bucket(digest)),
        [], "__bucket", [digest, F.col(key)], {"__lo": F.col("__w")}, before=True,
    )
    total = df.agg(F.sum(weight)).scalar()
    # One row for each bucket, at most BUCKETS: its interval, copied to each equal slice of the weight that it reaches into.
    # A slice has as many draws as any other, so the buckets of a slice that a draw is held against are two on average.
    slice_no = lambda pos: F.least(F.floor(pos / total * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    order = W.orderBy("__bucket")
    sums = df.groupBy(hash_bucket(digest).alias("__bucket")).agg(F.sum(weight).alias("__w"))
    ends = sums.withColumn("__end", F.sum("__w").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    spans = ends.select(
        "__bucket", F.coalesce(F.lag("__end").over(order), F.lit(0.0)).alias("__from"),
        F.when(F.lead("__end").over(order).isNotNull(), F.col("__end")).otherwise(F.lit(float("inf"))).alias("__to"), "__end",
    )
    reach = F.sequence(slice_no(F.col("__from")), F.when(F.col("__to") == float("inf"), F.lit(BUCKETS - 1)).otherwise(slice_no(F.col("__end"))))
    spans = F.broadcast(spans.select("__bucket", "__from", "__to", F.explode(reach).alias("__slice")))
    drawn = df.select(F.col(key).alias("draw")).withColumn("__pos", unit_interval(seed_hash(f"{seed}d", "draw"), 8) * total)
    drawn = drawn.withColumn("__slice", slice_no(F.col("__pos"))).join(spans, "__slice")
    drawn = drawn.where((F.col("__from") <= F.col("__pos")) & (F.col("__pos") < F.col("__to"))).select("draw", "__pos", "__bucket")
    hits = drawn.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    copies = F.greatest(F.lit(1), F.ceil(F.col("__n") * share / df.agg(F.count(F.lit(1))).scalar())).cast("int")
    copies = F.broadcast(hits.select("__bucket", copies.alias("__copies")))
    columns = df.columns
    # A bucket without draws is needed by none.
    owners = placed.join(copies, "__bucket").select(
        "__bucket", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)).alias("__copy"), F.col("__lo").alias("__pos"), F.lit(0).alias("__kind"),
        F.struct(*columns).alias("__row"), F.lit(None).cast(df.schema[key].dataType).alias("draw"), F.struct(digest, F.col(key)).alias("__tie"),
    )
    draws = drawn.join(copies, "__bucket").select(
        "__bucket", F.pmod(F.xxhash64("draw"), F.col("__copies")).cast("int").alias("__copy"), "__pos", F.lit(1).alias("__kind"),
        F.lit(None).cast(owners.schema["__row"].dataType).alias("__row"), "draw", F.lit(None).cast(owners.schema["__tie"].dataType).alias("__tie"),
    )
    order = W.partitionBy("__bucket", "__copy").orderBy("__pos", "__kind", "__tie")
    before = F.last("__row", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    backwards = W.partitionBy("__bucket", "__copy").orderBy(F.desc("__pos"), F.desc("__kind"), F.desc("__tie"))
    after = F.last("__row", ignorenulls=True).over(backwards.rowsBetween(W.unboundedPreceding, W.currentRow))
    # Sums of weights differ in their last digits, so a position may lie just before the first interval of its bucket.
    met = owners.unionByName(draws).withColumn("__row", F.coalesce(before, after))
    return met.where("__kind = 1").select("draw", *[F.col("__row")[c].alias(c) for c in columns])


def workload(length: Column) -> Column:
    size = length.cast("bigint")
    return size * K.WORKLOAD_LINEAR + size * size


def snake(df: DataFrame, load: str, key: str, k: int | str, group: Sequence[str] = ()) -> DataFrame:
    """Shards by rank of the load, there and back again: needs no sequential pass over the rows.

    ``k`` is a number or the name of a column that holds it.
    """
    shards = F.col(k) if isinstance(k, str) else F.lit(k)
    out = ranked_with_ties(df, load, key, group, "__rank")
    spot = F.pmod(F.col("__rank") - 1, 2 * shards)
    return out.withColumn("shard", F.when(spot < shards, spot).otherwise(2 * shards - 1 - spot).cast("int")).drop("__rank")


def _divides(df: DataFrame, batch: str, k: int) -> Column:
    """True where the batch has a multiple of k rows, an error elsewhere."""
    sizes = df.groupBy(batch).agg(F.count(F.lit(1)).alias("n"))
    odd = sizes.where(F.col("n") % k != 0).agg(F.min(F.concat_ws(" ", F.col("n").cast("string"), F.lit(f"rows do not divide into {k} equal shards")))).scalar()
    return F.when(odd.isNull(), True).otherwise(F.raise_error(odd))


def balance(df: DataFrame, batch: str, key: str, length: str, k: int, equal: bool = False) -> DataFrame:
    """Adds ``shard`` per batch so that workloads are balanced, by rank at every size.

    Shards differ by one row at most. With ``equal`` a batch that k does not divide is an error.
    """
    placed = snake(df.withColumn("__load", workload(F.col(length))), "__load", key, k, [batch]).drop("__load")
    return placed.where(_divides(df, batch, k)) if equal else placed


def balance_groups(df: DataFrame, batch: str, uid: str, length: str, k: int) -> DataFrame:
    """Shards that keep the rows of a prompt together, with as many prompts each."""
    loads = df.groupBy(batch, uid).agg(F.sum(workload(F.col(length))).alias("__load"))
    shards = snake(loads, "__load", uid, k, [batch]).where(_divides(loads, batch, k)).drop("__load")
    # A prompt may have many rows, so they meet its shard spread by all their columns.
    pair = F.struct(batch, uid)
    return attach_lookup(df.withColumn("__pair", pair), shards.select(pair.alias("__pair"), "shard"), "__pair", F.struct(*df.columns)).drop("__pair")


SIZE_CLASSES = 128
SMALL_SHARE = 4
PATTERNS = "array<struct<class int, low bigint, high bigint, first_bin bigint, times bigint>>"


def packing(counts: pd.Series) -> pd.Series:
    """Bins for long sequences, from how many there are of each size class (at most ``SIZE_CLASSES`` numbers a batch).

    The longest class that is left opens a bin, and shorter ones fill it; the same bin is made as often as the counts
    allow. An entry says that ranks ``low`` to ``high`` of a class go, ``times`` to a bin, into the bins from ``first_bin``.
    """

    def plan(given: Sequence[dict]) -> list[dict]:
        left = {int(c["class"]): int(c["n"]) for c in given}
        taken, out, bins = dict.fromkeys(left, 0), [], 0
        while any(left.values()):
            free, pattern = SIZE_CLASSES, {}
            for size in sorted((c for c in left if left[c]), reverse=True):
                if times := min(left[size], free // size):
                    pattern[size] = times
                    free -= times * size
            copies = min(left[c] // t for c, t in pattern.items())
            for c, t in pattern.items():
                out.append({"class": c, "low": taken[c], "high": taken[c] + copies * t, "first_bin": bins, "times": t})
                taken[c] += copies * t
                left[c] -= copies * t
            bins += copies
        return out

    return counts.map(plan)


def packed(df: DataFrame, batch: str, key: str, tokens: str, budget: int) -> DataFrame:
    """Adds ``__bin``: bins of at most ``budget`` tokens per batch, with long sequences beside short ones.

    Sequences of more than a quarter of the budget are packed by size class, rounded up to a ``SIZE_CLASSES``-th: two that
    would fill a bin to the last token may stay apart. The others are laid end to end
    over what is left of those bins, and over new ones behind them; a sequence that crosses the end of a
    bin goes with three others into a bin of its own, so there is one such bin for four others at most.
    """
    names = {"b": batch, "key": key, "tokens": tokens}
    digest = F.md5(F.col(key).cast("string"))
    rows = df.select(F.struct(*df.columns).alias("row"), digest.alias("digest"), *[F.col(c).alias(n) for n, c in names.items()])
    order, bucket = [F.col("digest"), F.col("key")], hash_bucket(F.col("digest"))
    small = F.col("tokens") * SMALL_SHARE <= budget
    long = rows.where(~small).withColumn("class", F.ceil(F.col("tokens") * SIZE_CLASSES / budget).cast("int"))
    counts = long.groupBy("b", "class").agg(F.count(F.lit(1)).alias("n"))
    entries = counts.groupBy("b").agg(F.collect_list(F.struct("class", "n")).alias("counts")).select("b", F.pandas_udf(packing, PATTERNS)("counts").alias("plan"))
    entries = entries.select("b", F.inline("plan")).groupBy(F.struct("b", "class").alias("at")).agg(F.collect_list(F.struct("low", "high", "first_bin", "times")).alias("plan"))
    ranks = ranked(long, order, bucket, ["b", "class"], "rank").withColumn("at", F.struct("b", "class"))
    place = F.col("rank") - 1
    entry = F.filter("plan", lambda p: (p.low <= place) & (place < p.high))[0]
    met = attach_lookup(ranks, entries, "at", "key").withColumn("e", entry)
    placed = met.select("b", "tokens", "row", (F.col("e.first_bin") + F.floor((place - F.col("e.low")) / F.col("e.times"))).alias("bin"))
    placed = written(placed, "long")
    bins = placed.groupBy("b", "bin").agg((F.lit(budget).cast("bigint") - F.sum("tokens")).alias("c"))
    room = bins.groupBy("b").agg(F.count(F.lit(1)).alias("bins"), F.sum("c").alias("n"))
    line = running(bins.withColumn("part", ordinal_bucket("bin")), ["b"], "part", [F.col("bin")], {"upto": F.col("c")})
    ladder = join_null_safe(line.withColumnRenamed("bin", "value"), room.select("b", "n"), ["b"])

    laid = running(rows.where(small).withColumn("part", bucket), ["b"], "part", order, {"end": F.col("tokens")})
    laid = attach_lookup(laid, room, "b", "key").na.fill(0, ["bins", "n"]).withColumn("start", F.col("end") - F.col("tokens"))
    laid = written(laid.withColumn("r", F.col("start") + 1), "short")
    inside = at_ranks(ladder.select("b", "value", "c", "upto", "n"), laid.where("r <= n"), ["b"], extra=["upto"])
    inside = inside.withColumnRenamed("value", "bin").withColumn("crosses", F.col("end") > F.col("upto")).drop("upto")
    stretch = F.floor((F.col("start") - F.col("n")) / budget)
    behind = laid.where("r > n").withColumns({"bin": F.col("bins") + stretch, "crosses": F.col("end") - F.col("n") > (stretch + 1) * budget})
    both = written(inside.unionByName(behind), "laid")
    crossing = ranked(both.where("crosses"), order, bucket, ["b"], "rank")
    parts = [
        placed.select("row", "bin"),
        both.where(~F.col("crosses")).select("row", "bin"),
        # Numbers below zero are bins of their own.
        crossing.select("row", (-1 - F.floor((F.col("rank") - 1) / SMALL_SHARE)).alias("bin")),
    ]
    return reduce(lambda x, y: x.unionByName(y), parts).select("row.*", F.col("bin").cast("bigint").alias("__bin"))


def microbatches(df: DataFrame, batch: str, key: str, length: str, budget: int) -> DataFrame:
    """Adds ``micro``: micro-batches within the token budget, the light ones at both ends.

    See :func:`packed`: their number is near total tokens over budget where the lengths allow it. A sequence longer than
    the budget is an error.
    """
    tokens = F.col(length).cast("long")
    fits = F.when(tokens <= budget, tokens).otherwise(F.raise_error(F.lit("a sequence is longer than the token budget")).cast("bigint"))
    laid = written(packed(df.withColumn("__tokens", fits), batch, key, "__tokens", budget), "packed")
    bins = laid.groupBy(batch, "__bin").agg(F.sum(workload(F.col("__tokens"))).alias("__load"))
    heavy = running(with_value_bucket(bins, "__load", ascending=False), [batch], "__bucket", [F.col("__load").desc(), F.col("__bin")], {"__rank": F.lit(1)})
    counts = bins.groupBy(batch).agg(F.count(F.lit(1)).alias("__n"))
    rank, middle = F.col("__rank") - 1, F.floor((F.col("__n") + 1) / 2)
    # The heaviest goes to the middle, the next ones right and left of it in turn.
    place = F.when(rank % 2 == 1, middle + F.floor(rank / 2)).otherwise(middle - 1 - F.floor(rank / 2))
    places = join_null_safe(heavy, counts, [batch]).select(batch, "__bin", place.cast("int").alias("micro"))
    return join_null_safe(laid, places, [batch, "__bin"]).drop("__bin", "__tokens")


def imbalance(df: DataFrame, batch: str, key: str, length: str, k: int) -> DataFrame:
    """Token sums of contiguous slices against those of the assigned ``shard``, per batch."""
    sizes = df.groupBy(batch).agg(F.floor(F.count(F.lit(1)) / k).alias("__size"))
    placed = attach_lookup(ranked_by_value(df, key, [batch], "__rank"), sizes, batch, key)
    sliced = placed.withColumn("__slice", F.floor((F.col("__rank") - 1) / F.col("__size")))
    before = sliced.groupBy(batch, "__slice").agg(F.sum(length).alias("s")).groupBy(batch).agg(
        F.min("s").alias("min"), F.max("s").alias("max"), (F.max("s") - F.min("s")).alias("minmax_diff"), (F.sum("s") / k).alias("mean")
    )
    after = df.groupBy(batch, "shard").agg(F.sum(length).alias("s")).groupBy(batch).agg(
        F.min("s").alias("balanced_min"), F.max("s").alias("balanced_max")
    )
    return before.join(after, batch)


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def union_columns(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Columns of both sides joined on the row key; a column on both sides must agree, else an error."""
    shared = [c for c in b.columns if c in a.columns and c != key]
    joined = a.join(b.withColumnsRenamed({c: f"__b_{c}" for c in shared}), key)

    def agreed(c: str) -> Column:
        return F.when(F.col(c).eqNullSafe(F.col(f"__b_{c}")), F.col(c)).otherwise(
            F.raise_error(F.lit(f"column {c} differs between the two sides")).cast(a.schema[c].dataType)
        )

    return joined.withColumns({c: agreed(c) for c in shared}).drop(*[f"__b_{c}" for c in shared])


def update_curriculum(df: DataFrame, results: DataFrame, fn: Callable[[Column, Column], Column], key: str, weight: str = "weight") -> DataFrame:
    """New weights from batch results: ``fn(old weight, result)`` where there is a result."""
    joined = df.join(results.select(key, "result"), key, "left")
    return joined.withColumn(
        weight, F.when(F.col("result").isNull(), F.col(weight)).otherwise(fn(F.col(weight), F.col("result")))
    ).drop("result")


def shuffled(df: DataFrame, seed: int, key: str, name: str = "index") -> DataFrame:
    """Dense index of a seeded shuffle."""
    return ranked_by_hash(df, seed, key, name=name).withColumn(name, F.col(name) - 1)
