"""Statistics of groups attached to their rows without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.operators.ordering import HOT_SHARE, join_null_safe

SALTS = 4096


def attach_stats(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column], spread: str) -> DataFrame:
    """Adds per-group aggregates to every row.

    The aggregates are combined on the map side first. Hot groups come from a broadcast of at most
    ``HOT_SHARE`` rows, and their rows are then spread by ``spread`` (a row id) instead of meeting
    in one partition; all other groups are joined by shuffle.
    """
    keys = list(keys)
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[c.alias(n) for n, c in aggs.items()])
    total = df.agg(F.count(F.lit(1))).scalar()
    # Both sides keep the same aggregates, so their shuffle is computed once and reused.
    is_hot = F.col("__n") * HOT_SHARE >= total
    hot = stats.where(is_hot).drop("__n")
    hot = hot.withColumnsRenamed({n: f"__hot_{n}" for n in aggs}).withColumn("__hot", F.lit(True))
    marked = join_null_safe(df, F.broadcast(hot), keys, "left")
    salted = marked.withColumn(
        "__salt", F.when(F.col("__hot"), 1 + F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    )
    cold = stats.where(~is_hot).drop("__n").withColumn("__salt", F.lit(0))
    joined = join_null_safe(salted, cold, [*keys, "__salt"], "left")
    out = joined.withColumns(
        {n: F.when(F.col("__hot"), F.col(f"__hot_{n}")).otherwise(F.col(n)) for n in aggs}
    )
    return out.drop("__salt", "__hot", *[f"__hot_{n}" for n in aggs])


def attach_lookup(df: DataFrame, lookup: DataFrame, key: str, spread: str | Column, rows: str | None = None) -> DataFrame:
    """Left join with a table of one row per key; a null key matches a null key.

    The rows per key are counted first. The lookup rows of hot keys, at most ``HOT_SHARE``, are broadcast
    and the rows of those keys spread by ``spread`` (what tells rows apart); all other keys meet by shuffle.
    If the caller knows it, ``rows`` is the lookup's column with the rows per key, and nothing is counted.
    """
    names = [c for c in lookup.columns if c not in (key, rows)]
    as_key = F.struct(F.col(key).alias("k"))
    sides = lookup.select(as_key.alias("__key"), F.struct(*names).alias("__side"), *([F.col(rows).alias("__n")] if rows else []))
    if rows:
        total = lookup.agg(F.sum(rows)).scalar()
        is_hot = F.col("__n") * HOT_SHARE >= total
        hot, cold = sides.where(is_hot).drop("__n"), sides.where(~is_hot).drop("__n")
    else:
        counts = df.groupBy(as_key.alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
        total = df.agg(F.count(F.lit(1))).scalar()
        hot_keys = F.broadcast(counts.where(F.col("__n") * HOT_SHARE >= total).select("__key"))
        hot, cold = sides.join(hot_keys, "__key"), sides.join(hot_keys, "__key", "left_anti")
    hot = hot.withColumnRenamed("__side", "__hot")
    cold = cold.select(F.struct("__key", F.lit(0).alias("s")).alias("__at_key"), F.col("__side").alias("__cold"))
    marked = df.withColumn("__key", as_key).join(F.broadcast(hot), "__key", "left")
    salt = F.when(F.col("__hot").isNotNull(), 1 + F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    met = marked.withColumn("__at_key", F.struct("__key", salt.alias("s"))).join(cold, "__at_key", "left")
    side = F.coalesce("__hot", "__cold")
    return met.withColumns({n: side[n] for n in names}).drop("__key", "__at_key", "__hot", "__cold")
