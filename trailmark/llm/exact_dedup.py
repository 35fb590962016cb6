"""Exact duplicates: groups by a 128-bit content hash, checked byte by byte."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import attach, packed, whole, written


def normalised(text: str | Column) -> Column:
    """Each run of ASCII white space as one space. Single spaces are left alone, which is cheaper."""
    return F.regexp_replace(whole(text), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def exact_duplicates(docs: DataFrame, fingerprint: Callable[[Column], Column] = F.md5) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of (doc_id, text).

    Rows meet by the 128-bit ``fingerprint`` of their normalised text. The bytes inside a group are
    compared through the group's least and greatest text, which combine on the map side, so a group
    of any size needs no task of its own; a group with different bytes is cut by the texts themselves.
    Of equal texts the smallest doc_id stays. A null text counts as empty. A null doc_id comes after
    all others and stays only in a group without any other id. Rows that repeat an id and its text
    are one record: all or none of them are kept. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", normalised("text").alias("norm")).select(
        "doc_id", "norm", fingerprint(F.col("norm")).alias("print"), F.sha2("norm", 256).alias("text_sha256")
    )
    groups = written(
        rows.groupBy("print")
        .agg(
            F.count(F.lit(1)).alias("group_size"),
            F.min("doc_id").alias("keep_id"),
            F.min("text_sha256").alias("text_sha256"),
            F.min("norm").alias("least"),
            F.max("norm").alias("greatest"),
        )
        .select("print", "group_size", "keep_id", "text_sha256", (F.col("least") == F.col("greatest")).alias("same")),
        "copy-groups",
    )
    lookup = groups.where("same").select("text_sha256", "group_size", "keep_id")
    clashes = groups.where(~F.col("same")).select("print")
    if not clashes.isEmpty():
        cut = rows.join(clashes, "print", "left_semi").groupBy("norm", "text_sha256")
        exact = cut.agg(F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("keep_id"))
        lookup = written(lookup.unionByName(exact.drop("norm")), "copy-groups-cut")
    total = lookup.agg(F.sum("group_size")).first()[0] or 0
    counted = lookup.withColumn("__n", F.col("group_size"))
    met = attach(rows.select("doc_id", "text_sha256"), counted, "text_sha256", "__n", total, F.col("doc_id"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return met.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns; a record repeated under one id stays once."""
    kept = exact_duplicates(docs).where("kept").select(F.struct("doc_id").alias("id")).distinct()
    return packed(docs, id=F.struct("doc_id")).join(kept, "id", "left_semi").dropDuplicates(["id"]).select("row.*")
