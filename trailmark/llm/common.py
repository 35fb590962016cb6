"""Small helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
# A key with at least 1/HOT_SHARE of the rows is hot, so at most HOT_SHARE keys are.
HOT_SHARE = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared scratch folder, which cuts the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """Each row as the struct ``row`` beside new columns, whose names then clash with none of its own."""
    return df.select(*[c.alias(n) for n, c in columns.items()], F.struct("*").alias("row"))


def whole(text: str | Column) -> Column:
    """The text, or the empty string where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: str | Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def words(text: str | Column) -> Column:
    """All words of a text; an empty array for none."""
    return F.regexp_extract_all(whole(text), F.lit(WORD), F.lit(0))


def attach(
    rows: DataFrame, lookup: DataFrame, key: str, weight: str, total: int, spread: Column, n_keys: int | None = None
) -> DataFrame:
    """Left join with a lookup of one row per key, in which no hot key gathers its rows in one task.

    ``weight`` is the lookup's column with the number of rows of the key and ``total`` their sum.
    Hot keys number ``HOT_SHARE`` at most and are broadcast; their rows are then dealt by ``spread``.
    All other keys meet by shuffle. A null key matches a null key. If ``n_keys``, the number of keys where
    the caller knows it, is no more than that either, the whole lookup is broadcast and no row moves.
    """
    names = [c for c in lookup.columns if c not in (key, weight)]
    if n_keys is not None and n_keys <= HOT_SHARE:
        side = lookup.select(F.struct(key).alias("__k"), F.struct(*names).alias("__side"))
        met = rows.withColumn("__k", F.struct(key)).join(F.broadcast(side), "__k", "left")
        return met.withColumns({n: F.col("__side")[n] for n in names}).drop("__k", "__side")
    hot_rows = lookup.where(F.col(weight) * HOT_SHARE >= F.lit(total))
    hot = hot_rows.select(F.struct(key).alias("__k"), F.struct(*names).alias("__hot"))
    cold = lookup.where(F.col(weight) * HOT_SHARE < F.lit(total)).select(
        F.struct(F.struct(key).alias("k"), F.lit(0).cast("long").alias("s")).alias("__at"), F.struct(*names).alias("__cold")
    )
    marked = rows.withColumn("__k", F.struct(key)).join(F.broadcast(hot), "__k", "left")
    salt = F.when(F.col("__hot").isNotNull(), F.xxhash64(spread).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long"))
    met = marked.withColumn("__at", F.struct(F.col("__k").alias("k"), salt.alias("s"))).join(cold, "__at", "left")
    picked = {n: F.coalesce(F.col("__hot"), F.col("__cold"))[n] for n in names}
    return met.withColumns(picked).drop("__k", "__at", "__hot", "__cold")
