"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import packed, words

# A mask ignores the positions marked 0. Any 13 aligned words with at most two substitutions hold a
# placement of this one in which all words that it looks at agree (tested exhaustively).
MASKS = ("11010011",)
WINDOW = 13
NEEDED = 11
BROADCAST_SEEDS = 1_000_000
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 128


def word_hashes(text: str | Column) -> Column:
    return F.transform(words(F.lower(F.col(text) if isinstance(text, str) else text)), lambda w: F.xxhash64(w))


def with_seeds(df: DataFrame, hashes: str, masks: Sequence[str], at: str) -> DataFrame:
    """One row per placement of a mask inside the words, with its position ``at`` and hash ``seed``."""
    placed = df.select("*", F.posexplode(F.transform(F.col(hashes), lambda _: F.lit(0).cast("byte"))).alias(at, "__0")).drop("__0")
    seeds = []
    for number, mask in enumerate(masks):
        cared = [F.get(F.col(hashes), F.col(at) + i) for i, c in enumerate(mask) if c == "1"]
        inside = F.col(at) + (len(mask) - 1) < F.size(hashes)
        seeds.append(F.when(inside, F.xxhash64(F.lit(number), *cared)))
    if len(seeds) == 1:
        return placed.withColumn("seed", seeds[0]).where(F.col("seed").isNotNull())
    return placed.withColumn("seed", F.explode(F.array(*seeds))).where(F.col("seed").isNotNull())


def _agrees(window: int, needed: int) -> Column:
    """Whether some window of the item has enough words equal to the document's aligned ones."""
    equal = F.transform(
        F.col("item_words"), lambda w, i: F.get(F.col("near"), i - F.col("lead")).eqNullSafe(w).cast("int")
    )
    starts = F.sequence(F.lit(0), F.size("item_words") - window)
    enough = lambda e: F.exists(starts, lambda s: F.aggregate(F.slice(e, s + 1, window), F.lit(0), lambda a, x: a + x) >= needed)
    return F.transform(F.array(equal), enough)[0]


def may_broadcast(items: DataFrame, masks: Sequence[str], broadcast_seeds: int) -> bool:
    """Whether the seeds, each beside all words of its item, are few and take at most BROADCAST_BYTES."""
    n = sum(F.greatest(F.size("item_words") - (len(m) - 1), F.lit(0)).cast("double") for m in masks)
    seeds, size = items.agg(F.sum(n), F.sum(n * (F.size("item_words") * 8 + ROW_BYTES))).first()
    return (seeds or 0) <= broadcast_seeds and (size or 0) <= BROADCAST_BYTES


def overlaps(
    docs: DataFrame, benchmark: DataFrame, masks: Sequence[str] = MASKS, window: int = WINDOW, needed: int = NEEDED,
    broadcast_seeds: int = BROADCAST_SEEDS, whole_from: int | None = None,
) -> DataFrame:
    """row_key, item_id, diagonal of every alignment in which a document overlaps a benchmark item.

    An alignment counts if at least ``needed`` of ``window`` consecutive words of the item equal the
    words of the document at the same distance: substitutions are tolerated, insertions end a window.
    Candidates are equal hashes of a mask's words in both; each is verified once per alignment.
    The benchmark's seeds are broadcast with their items' words only if they are at most ``broadcast_seeds`` and
    BROADCAST_BYTES, which long items exceed by the square of their length; beyond that
    both sides are shuffled by seed, and the words are fetched for the hits alone.
    Words are case-insensitive. Items shorter than the window match nothing by seeds; with ``whole_from``, those of so
    many words or more count where all of their words follow each other in a document.
    """
    every = benchmark.select("item_id", word_hashes("text").alias("item_words"))
    items = every.where(F.size("item_words") >= window)
    item_seeds = with_seeds(items, "item_words", masks, "item_at").select("item_id", "item_at", "seed", "item_words")
    keyed = docs.select(row_key().alias("row_key"), word_hashes("text").alias("hashes"))
    placed = with_seeds(keyed, "hashes", masks, "at")
    lead = F.greatest(F.lit(0), F.col("item_at") - F.col("at"))
    first = F.greatest(F.lit(0), F.col("at") - F.col("item_at"))
    around = F.slice("hashes", first + 1, F.size("item_words"))
    diagonal = (F.col("at") - F.col("item_at")).alias("diagonal")
    if may_broadcast(items, masks, broadcast_seeds):
        hits = placed.join(F.broadcast(item_seeds), "seed").select(
            "row_key", "item_id", diagonal, lead.alias("lead"), around.alias("near"), "item_words"
        )
        hits = hits.distinct()
    else:
        narrow = placed.select("row_key", "at", "seed").join(item_seeds.drop("item_words"), "seed")
        narrow = narrow.select("row_key", "item_id", diagonal, lead.alias("lead"), first.alias("first")).distinct()
        hits = narrow.join(items, "item_id").join(keyed.dropDuplicates(["row_key"]), "row_key").select(
            "row_key", "item_id", "diagonal", "lead", F.slice("hashes", F.col("first") + 1, F.size("item_words")).alias("near"), "item_words"
        )
    found = hits.where(_agrees(window, needed)).select("row_key", "item_id", "diagonal")
    if whole_from:
        short = every.where((F.size("item_words") < window) & (F.size("item_words") >= whole_from))
        found = found.unionByName(whole_items(keyed, short, whole_from, broadcast_seeds))
    return found.distinct()


def whole_items(keyed: DataFrame, items: DataFrame, first: int, broadcast_seeds: int) -> DataFrame:
    """row_key, item_id, diagonal of every place at which a document holds all words of an item in turn.

    The first words of an item are its seed, and the others are compared at the hits. Without items no document is read.
    """
    seeds = with_seeds(items, "item_words", ("1" * first,), "item_at").where("item_at = 0").select("item_id", "seed", "item_words")
    if seeds.isEmpty():
        return keyed.limit(0).select("row_key", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("diagonal"))
    side = F.broadcast(seeds) if may_broadcast(items, ("1" * first,), broadcast_seeds) else seeds
    met = with_seeds(keyed, "hashes", ("1" * first,), "at").join(side, "seed")
    same = F.slice("hashes", F.col("at") + 1, F.size("item_words")) == F.col("item_words")
    return met.where(same).select("row_key", "item_id", F.col("at").alias("diagonal"))


def row_key() -> Column:
    """Key of a row by its id and text, so that rows which share an id are judged one by one."""
    return F.xxhash64(F.lit(7), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text"))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, contaminated, n_items (overlapped) of every row of (doc_id, text).

    A null or empty text, and one shorter than a mask, overlaps nothing; so does an empty benchmark.
    """
    found = overlaps(docs, benchmark, **options).groupBy("row_key").agg(F.countDistinct("item_id").alias("n_items"))
    rows = docs.select("doc_id", row_key().alias("row_key")).join(found, "row_key", "left")
    n_items = F.coalesce("n_items", F.lit(0).cast("long"))
    return rows.select("doc_id", (n_items > 0).alias("contaminated"), n_items.alias("n_items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows that overlap no benchmark item, with all their columns."""
    found = overlaps(docs, benchmark, **options).select("row_key").distinct()
    return packed(docs, row_key=row_key()).join(found, "row_key", "left_anti").select("row.*")
