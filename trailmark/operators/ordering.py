"""Exact ranks and cut-offs without putting a whole group into one task.

A rank over a table, or within a group that may hold a third of it, is computed in two levels:
rows are cut into ordered buckets, ranked inside their bucket, and shifted by the number of rows in
the buckets before it. The bucket counts are the only thing gathered, and there are at most
``BUCKETS`` of them per group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 4096
QUANTILES = 256
# A group with at least 1/HOT_SHARE of all rows is hot, so there are at most HOT_SHARE of them.
HOT_SHARE = 1000
# ``split_hot`` counts groups by ``PLACES`` hashes; a hot place has ``HOT_ROWS`` rows at least.
PLACES, HOT_ROWS = 65536, 10_000
# Partitions that small groups are shuffled into.
LEAST_TASKS, TASK_ROWS = 8, 20_000


def seed_hash(seed: int | str, *keys: Column | str) -> Column:
    """Seeded pseudo-random order key: the same in every engine that has md5."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def unit_interval(digest: Column, digits: int = 13) -> Column:
    """A number in [0, 1) from the first hex digits of a digest, four bits each: 52 bits unless given."""
    return F.conv(F.substr(digest, F.lit(1), F.lit(digits)), 16, 10).cast("double") / float(16**digits)


def hash_bucket(digest: Column) -> Column:
    """Bucket that follows the order of a hex digest: its first three digits."""
    return F.conv(F.substr(digest, F.lit(1), F.lit(3)), 16, 10).cast("int")


def with_value_bucket(df: DataFrame, value: str, name: str = "__bucket", ascending: bool = True) -> DataFrame:
    """Bucket that follows the order of a numeric column, even when its values cluster.

    The bounds grow with the number of shuffle partitions (``QUANTILES`` at least), and are fixed in the
    plan as literals, so every use of the bucket sees the same ones. Rows with a null value come first.
    """
    from pyspark.ml.feature import Bucketizer

    n = max(QUANTILES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    probs = [i / n for i in range(1, n)]
    numeric = df.select(F.col(value).cast("double").alias("v"))
    bounds = sorted(set(numeric.approxQuantile("v", probs, min(0.001, 0.25 / n))))
    inf = float("inf")
    cut = Bucketizer(splits=[-inf, *bounds, inf], inputCol="__v", outputCol="__cut", handleInvalid="keep")
    placed = cut.transform(df.withColumn("__v", F.col(value).cast("double"))) if bounds else df.withColumn("__cut", F.lit(0.0))
    order = F.col("__cut").cast("int") if ascending else -F.col("__cut").cast("int")
    return placed.withColumn(name, F.when(F.col(value).isNull(), F.lit(-(2**30))).otherwise(order)).drop("__v", "__cut")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key matches a null key; the key columns of the left side are kept."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def running(
    df: DataFrame,
    group: Sequence[str],
    bucket: str,
    order: Sequence[Column],
    measures: dict[str, Column],
    before: bool = False,
) -> DataFrame:
    """Running sums within each group in the order (bucket, order), up to each row or, with ``before``, ahead of it.

    ``bucket`` must follow ``order``. Rows are shuffled once, on group and bucket, so a hot group
    spreads over its buckets.
    """
    # The group as one struct: it is never null, so equal keys meet in a plain join, and the join
    # finds the rows where the window has put them.
    grouped = df.withColumn("__group", F.struct(*group) if group else F.lit(0))
    keys = ["__group", bucket]
    local = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else W.currentRow)
    inside = grouped.withColumns({f"__in_{m}": F.coalesce(F.sum(c).over(local), F.lit(0)) if before else F.sum(c).over(local) for m, c in measures.items()})
    totals = grouped.groupBy(*keys).agg(*[F.sum(c).alias(f"__sum_{m}") for m, c in measures.items()])
    earlier = W.partitionBy("__group").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, *[F.coalesce(F.sum(f"__sum_{m}").over(earlier), F.lit(0)).alias(f"__off_{m}") for m in measures]
    )
    if not group:
        # One row per bucket: at most BUCKETS rows.
        offsets = F.broadcast(offsets)
    out = inside.join(offsets, keys)
    out = out.withColumns({m: F.col(f"__in_{m}") + F.col(f"__off_{m}") for m in measures})
    return out.drop("__group", *[f"__in_{m}" for m in measures], *[f"__off_{m}" for m in measures])


def ordinal_bucket(ordinal: Column | str, size: int = 1000) -> Column:
    """Bucket that follows a non-negative integer: consecutive runs of ``size`` values."""
    column = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    return F.floor(column / size)


def ranked(
    df: DataFrame,
    order: Sequence[Column],
    bucket: Column,
    group: Sequence[str] = (),
    name: str = "rank",
) -> DataFrame:
    """Exact 1-based row number within each group (or the table); ``order`` must be total."""
    placed = df.withColumn("__bucket", bucket)
    return running(placed, list(group), "__bucket", order, {name: F.lit(1)}).drop("__bucket")


def ranked_by_hash(df: DataFrame, seed: int | str, key: str, group: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Row number in a seeded shuffle of a unique key."""
    digest = seed_hash(seed, key)
    return ranked(df, [digest, F.col(key)], hash_bucket(digest), group, name)


def ranked_by_value(df: DataFrame, key: str, group: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Row number in the order of a unique numeric key."""
    placed = with_value_bucket(df, key)
    return running(placed, list(group), "__bucket", [F.col(key)], {name: F.lit(1)}).drop("__bucket")


def hash_cutoff(df: DataFrame, seed: int | str, key: str, n: int | Column, group: Sequence[str] = ()) -> DataFrame:
    """Per group, the digest of the n-th row of a seeded shuffle, for groups with more than n rows, and their ``__rows``.

    Reads only the key columns: one count per bucket, then a rank inside the single bucket that
    holds the n-th row. Filtering by the cut-off needs no shuffle of the rows themselves.
    """
    group = list(group)
    limit = F.lit(n) if isinstance(n, int) else n
    keyed = df.select(*group, seed_hash(seed, key).alias("__digest"), F.col(key).alias("__key")).withColumn(
        "__bucket", hash_bucket(F.col("__digest"))
    )
    counts = keyed.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    by_bucket = W.partitionBy(*group).orderBy("__bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = (
        counts.withColumns({"__upto": F.sum("__n").over(by_bucket), "__rows": F.sum("__n").over(W.partitionBy(*group))})
        .withColumn("__before", F.col("__upto") - F.col("__n"))
        .where((F.col("__before") < limit) & (F.col("__upto") >= limit))
        .select(*group, "__bucket", "__before", "__rows")
    )
    inside = W.partitionBy(*group, "__bucket").orderBy("__digest", "__key")
    return (
        join_null_safe(keyed, edge if group else F.broadcast(edge), [*group, "__bucket"])
        .withColumn("__rank", F.row_number().over(inside) + F.col("__before"))
        .where(F.col("__rank") == limit)
        .select(*group, F.col("__digest").alias("cutoff"), "__rows")
    )


def value_cutoff(df: DataFrame, key: str, n: int, ascending: bool = True) -> DataFrame:
    """One row with the n-th key in the order of a unique numeric key (``cutoff``); none if there are fewer rows.

    As :func:`hash_cutoff`: keys are counted by bucket, and only the bucket that holds the n-th is ranked.
    """
    keyed = with_value_bucket(df.select(F.col(key).alias("__key")), "__key", ascending=ascending)
    counts = keyed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
    edge = counts.withColumn("__upto", upto).withColumn("__before", F.col("__upto") - F.col("__n"))
    edge = edge.where((F.col("__before") < n) & (F.col("__upto") >= n)).select("__bucket", "__before")
    order = F.col("__key") if ascending else F.col("__key").desc()
    inside = keyed.join(F.broadcast(edge), "__bucket")
    placed = inside.withColumn("__rank", F.row_number().over(W.partitionBy("__bucket").orderBy(order)) + F.col("__before"))
    return placed.where(F.col("__rank") == n).select(F.col("__key").alias("cutoff"))


def at_ranks(ladder: DataFrame, wanted: DataFrame, group: Sequence[str], rank: str = "r", pieces: int = 1024, extra: Sequence[str] = ()) -> DataFrame:
    """``wanted`` (group, rank, ...) with the value that the rank has in a ladder (group, value, c, upto, n).

    A value owns the ranks from above ``upto - c`` to ``upto``. The ranks of a group are cut into ``pieces`` buckets,
    and an interval goes to each bucket that it reaches into, so a ladder grows by ``pieces`` rows at most. Within a
    bucket, ranks and interval ends are put in order, and a rank takes the first value that ends at or after it.
    """
    side = F.struct(*group).alias("__g")
    width = F.greatest(F.ceil(F.col("n") / pieces), F.lit(1))
    bucket = F.floor((F.col(rank) - 1) / width)
    reach = F.sequence(F.floor((F.col("upto") - F.col("c")) / width), F.floor((F.col("upto") - 1) / width))
    ends = ladder.where("c > 0").select(side, F.explode(reach).alias("__b"), F.col("upto").alias("__at"), F.lit(1).alias("__end"), F.struct("value", *extra).alias("__value"))
    sizes = ladder.select(side, "n").distinct()
    named = wanted.withColumn("__row", F.struct(*wanted.columns)).withColumn("__g", F.struct(*group))
    if "n" not in wanted.columns:
        named = named.join(sizes, "__g")
    asked = named.select("__g", bucket.alias("__b"), F.col(rank).alias("__at"), F.lit(0).alias("__end"), "__row")
    both = asked.unionByName(ends, allowMissingColumns=True)
    # Backwards, as a frame that starts at the first row of its order is summed up in one pass.
    ahead = W.partitionBy("__g", "__b").orderBy(F.desc("__at"), F.desc("__end")).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("__value", F.last("__value", ignorenulls=True).over(ahead)).where(F.col("__end") == 0)
    return found.select("__row.*", "__value.*")


def split_hot(df: DataFrame, group: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups that fit a task, each group in one partition, and those of the others, None if there are none.

    A job of counts while planning finds the places of hot groups, ``HOT_SHARE`` at most, so that a table without any is
    planned without them. A small group in the place of a hot one goes with it. Partitions number one for every
    ``TASK_ROWS`` rows, but ``LEAST_TASKS`` at least and at most as many as the session shuffles into: the rows grow
    after this shuffle, by melting or by draw sizes, so adaptive execution must not merge it by its bytes.
    """
    place = F.pmod(F.xxhash64(*group), F.lit(PLACES))
    counts = df.groupBy(place.alias("__place")).agg(F.count(F.lit(1)).alias("__n"))
    large = F.collect_list(F.when(F.col("__n") >= HOT_ROWS, F.struct("__place", "__n")))
    total, large = counts.agg(F.coalesce(F.sum("__n"), F.lit(0)), large).first()
    hot = [at for at, n in large if n * HOT_SHARE >= total]
    n = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(LEAST_TASKS, total // TASK_ROWS))
    if not hot:
        return df.repartition(n, *group), None
    return df.where(~place.isin(hot)).repartition(n, *group), df.where(place.isin(hot))


def value_ladder(long: DataFrame, group: Sequence[str] = ("data_source", "uid", "variable")) -> DataFrame:
    """Distinct values of each group with their count, the count up to them and the group size.

    A group lies in one partition unless it is hot: the values of a hot one are cumulated over value buckets.
    """
    small, hot = split_hot(long, group)
    return small_ladder(small, group) if hot is None else small_ladder(small, group).unionByName(spread_ladder(hot, group))


def small_ladder(long: DataFrame, group: Sequence[str]) -> DataFrame:
    """:func:`value_ladder` of rows whose groups lie in one partition each, as :func:`split_hot` has them: nothing is shuffled."""
    # Rows are sorted by a hash of the group, which tells most groups apart by its first eight bytes.
    keyed = long.where("value is not null").withColumn("__hash", F.xxhash64(*group))
    counted = keyed.groupBy("__hash", *group, "value").agg(F.count(F.lit(1)).alias("c"))
    inside = W.partitionBy("__hash", *group).orderBy("value")
    upto = F.sum("c").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))
    n = F.sum("c").over(inside.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return counted.withColumns({"upto": upto, "n": n}).drop("__hash")


def spread_ladder(long: DataFrame, group: Sequence[str]) -> DataFrame:
    """:func:`value_ladder` for groups that may hold most rows: values are counted first and cumulated over value buckets."""
    return counted_ladder(long.where("value is not null").groupBy(*group, "value").agg(F.count(F.lit(1)).alias("c")), group)


def counted_ladder(counted: DataFrame, group: Sequence[str]) -> DataFrame:
    """A ladder from distinct values (group, value, c) with their counts."""
    upto = running(with_value_bucket(counted, "value"), group, "__bucket", [F.col("value")], {"upto": F.col("c")})
    sizes = counted.groupBy(*group).agg(F.sum("c").alias("n"))
    return join_null_safe(upto.drop("__bucket"), sizes, group)


def ladder_percentiles(ladder: DataFrame, group: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact percentiles (linear interpolation) of every group of a ladder, one column for each."""

    def below(position: Column) -> Column:
        return F.min(F.when(F.col("upto") > position, F.col("value")))

    ends = []
    for i, p in enumerate(probs):
        spot = (F.col("n") - 1) * F.lit(float(p))
        ends += [below(F.floor(spot)).alias(f"lo{i}"), below(F.ceil(spot)).alias(f"hi{i}"), F.max(spot - F.floor(spot)).alias(f"f{i}")]
    at = [(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"f{i}")).alias(f"p{p * 100:g}") for i, p in enumerate(probs)]
    return ladder.groupBy(*group).agg(*ends).select(*group, *at)


def ranked_with_ties(df: DataFrame, value: str, key: str, group: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Row number within each group in the order of ``value`` from large to small, nulls last, then of a unique numeric key.

    Values are counted first and ranked among each other; the rows of one value are ranked by key, in buckets of the
    key. So neither a value nor a null that holds a third of the rows meets in one task.
    """
    group = list(group)
    given = df.withColumn("__value", F.struct(*group, F.col(value).alias("__v")))
    counted = given.groupBy("__value").agg(F.count(F.lit(1)).alias("__c")).withColumn("__load", F.col("__value.__v"))
    named = counted.select("*", *[F.col("__value")[g].alias(g) for g in group])
    placed = with_value_bucket(named.na.drop(subset=["__load"]), "__load", ascending=False)
    placed = placed.unionByName(named.where("__load is null").withColumn("__bucket", F.lit(2**30)))
    upto = running(placed, group, "__bucket", [F.col("__load").desc()], {"__upto": F.col("__c")})
    before = upto.select("__value", (F.col("__upto") - F.col("__c")).alias("__before"))
    rows = with_value_bucket(given, key)
    at = ["__value", "__bucket"]
    earlier = W.partitionBy("__value").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy(*at).agg(F.count(F.lit(1)).alias("__c")).withColumn("__sum", F.coalesce(F.sum("__c").over(earlier), F.lit(0)))
    offsets = sizes.join(before, "__value").select(*at, (F.col("__sum") + F.col("__before")).alias("__before"))
    inside = rows.withColumn("__in", F.row_number().over(W.partitionBy(*at).orderBy(key)))
    return inside.join(offsets, at).withColumn(name, F.col("__in") + F.col("__before")).drop("__value", "__bucket", "__in", "__before")
