"""Words grouped by spelling: a rare word belongs to a more frequent one that differs by a single edit."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.bidirectional import Words
from trailmark.llm.common import attach, written
from trailmark.llm.slices import SLICE_BYTES, sliced, text_bytes
from trailmark.llm.tokens import LOWER, word_hashes
from trailmark.llm.windows import spread

LEAST_SHARDS = 64
SHARD_ROWS = 40_000
# Words of one half from which its questions are spread over several shards.
HOT_WORDS = 100_000

LEAD = 0xC3  # UTF-8 lead byte of U+00C0 to U+00FF
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True

# (ids of the rows, lower-cased bytes, first byte, end and row of each word) -> numbers of changed words and what they become.
Edit = Callable[[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, list[str]]]


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end, code points and row of every maximal run of A-Z, a-z and U+00C0 to U+00FF."""
    lead = data == LEAD
    letter = ASCII_LETTER[data] | lead
    letter[1:] |= lead[:-1]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:] = letter[:-1] & ~cut[1:-1]
    after[:-1] = letter[1:] & ~cut[1:-1]
    first, end = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    leads = np.concatenate([[0], np.cumsum(lead)])
    return first, end, end - first - (leads[end] - leads[first]), np.searchsorted(offsets, first, side="right") - 1


def count_slice(ids: pa.Array, texts: pa.Array, least_length: int, edit: Edit | None) -> pa.RecordBatch:
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    first, end, points, row = letter_runs(data, offsets)
    long = points >= least_length
    first, end, row = first[long], end[long], row[long]
    changed, instead = edit(ids, data, first, end, row) if edit else (np.empty(0, np.int64), [])
    same = np.ones(len(first), bool)
    same[changed] = False
    first, end = first[same], end[same]
    _, at, n = np.unique(word_hashes(data, first, end), return_index=True, return_counts=True)
    size = (end - first)[at]
    held = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int64()).buffers()[1]
    words = pa.LargeStringArray.from_buffers(len(at), held, pa.py_buffer(data[spread(first[at], size)].tobytes()))
    more = [w for w in instead if len(w) >= least_length]
    listed = pa.concat_arrays([words.cast(pa.string()), pa.array(more, pa.string())])
    return pa.RecordBatch.from_arrays([listed, pa.array(np.concatenate([n, np.ones(len(more), np.int64)]))], ["word", "n"])


def count_words(docs: DataFrame, least_length: int, least_count: int, edit: Edit | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """word and n: the lower-cased words of all texts that are long and frequent enough. Only A-Z is lower-cased.

    ``edit`` may replace words before they are counted. Counts are combined in the task, before the shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=slice_bytes):
            yield count_slice(batch["doc_id"], batch["text"], least_length, edit)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def match_shard(table: pa.Table) -> pa.Table:
    """For every asked word of a shard, the words near it that share the half of the shard's side."""
    table = table.combine_chunks().take(pc.sort_indices(table, sort_keys=[("word", "ascending")]))
    words = table["word"].to_pylist()
    new = [i == 0 or words[i - 1] != w for i, w in enumerate(words)]
    place = np.flatnonzero(new)
    asked = np.maximum.reduceat(table["asked"].to_numpy(zero_copy_only=False), place)
    n = table["n"].to_numpy()[place]
    words = [words[i] for i in place]
    backwards = table["side"][0].as_py() == 1
    oriented = [w[::-1] for w in words] if backwards else words
    points = np.frombuffer("".join(oriented).encode("utf-32-le"), np.uint32).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    questions = np.flatnonzero(asked)
    half = size[questions] // 2
    query, near = Words(points, np.concatenate([[0], np.cumsum(size)])).one_edit(questions, size[questions] - half if backwards else half)
    if backwards:  # what shares the first half too is found there
        other = [not words[v].startswith(words[questions[q]][: half[q]]) for q, v in zip(query, near)]
        query, near = query[other], near[other]
    order = np.lexsort([near, -n[near], query])
    best = order[np.diff(query[order], prepend=-1) != 0]
    form = np.full(len(questions), -1)
    form[query[best]] = near[best]
    has = form >= 0
    columns = [
        pa.array([words[q] for q in questions], pa.string()), pa.array(n[questions]),
        pa.array(np.bincount(query, minlength=len(questions))), pa.array(n[form], mask=~has),
        pa.array([words[f] if f >= 0 else None for f in form], pa.string()),
    ]
    return pa.table(columns, ["word", "n", "n_near", "form_n", "form"])


def near_words(vocabulary: DataFrame, shard_rows: int = SHARD_ROWS, hot: int = HOT_WORDS) -> DataFrame:
    """word, n, n_near, form and form_n: how many words are one edit away, and the most frequent of them.

    Of two such words, both start with the first half of either, or end with its second half. A word is indexed under
    each half that a word of its own length, one less or one more can ask for, and asks under its own two. The halves of
    a shard share one index. A half of more than ``hot`` words is indexed in several shards, which share its questions.
    """
    m = F.char_length("word")
    lengths = F.array_distinct(F.array(*[F.expr(f"(char_length(word) + {d}) div 2").cast("int") for d in (-1, 0, 1)]))
    second = F.array_distinct(F.array(*[F.expr(f"char_length(word) + {d} - (char_length(word) + {d}) div 2").cast("int") for d in (-1, 0, 1)]))
    own = F.expr("char_length(word) div 2").cast("int")
    fronts = F.transform(lengths, lambda a: F.struct(F.lit(0).alias("side"), F.concat(F.lit("^"), F.substring("word", 1, a)).alias("half"), (a == own).alias("asked")))
    backs = F.transform(second, lambda b: F.struct(F.lit(1).alias("side"), F.concat(F.lit("$"), F.substring("word", m - b + 1, b)).alias("half"), (b == m - own).alias("asked")))
    rows = vocabulary.select("word", "n", F.explode(F.concat(fronts, backs)).alias("h")).select("word", "n", "h.*")
    halves = rows.groupBy("half").agg(F.count(F.lit(1)).alias("held"))
    crowded = written(halves.where(F.col("held") > hot).withColumn("copies", F.ceil(F.col("held") / hot).cast("int")), "crowded")
    total = vocabulary.count() * 4
    placed = attach(rows, crowded, "half", "held", total, F.col("word"), crowded.count())
    copies = F.coalesce("copies", F.lit(1))
    mine = F.pmod(F.xxhash64("word"), copies)
    parts = max(LEAST_SHARDS, math.ceil(total / shard_rows))
    dealt = placed.withColumn("mine", mine).withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("half", "copy"), F.lit(parts)) * 2 + F.col("side"))
    sent = dealt.select("shard", "side", "word", "n", (F.col("asked") & (F.col("mine") == F.col("copy"))).alias("asked"))
    answers = sent.groupBy("shard").applyInArrow(match_shard, "word string, n bigint, n_near bigint, form_n bigint, form string")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("m"), "form"))).alias("best")
    found = answers.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.m")).alias("form_n"))


def followed(forms: DataFrame) -> DataFrame:
    """word and root: the end of the chain of forms from each word of (word, form). Chains halve in every round."""
    paths = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        used = paths.groupBy("root").agg(F.count(F.lit(1)).alias("uses"))
        onward = used.join(paths.select(F.col("word").alias("root"), F.col("root").alias("next")), "root")
        onward = written(onward, "onward")
        if onward.isEmpty():
            return paths
        moved = attach(paths, onward, "root", "uses", paths.count(), F.col("word"))
        paths = written(moved.select("word", F.coalesce("next", "root").alias("root")), "paths")


def variants(
    docs: DataFrame, least_length: int = 5, least_count: int = 3, times: float = 2, edit: Edit | None = None, **options
) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of all texts of (doc_id, text).

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with ``least_length`` code points (2 at least) that occur
    ``least_count`` times or more; A-Z is lower-cased. Near words differ by one code point inserted, deleted or
    replaced. The form of a word is its most frequent near word (of equals the first in code-point order) if that has
    ``times`` its count; ``times`` must be above 1, so that chains end. The root is the last of the chain of forms, or the word.

    A null or empty text has no words; a null id is an id like any other; rows that repeat count each time; no rows, or no such
    words, give no rows. Other columns are ignored. A very long word is one key like any other.
    """
    if least_length < 2 or times <= 1:
        raise ValueError("words need two halves, and forms must be more frequent")
    vocabulary = written(count_words(docs, least_length, least_count, edit), "vocabulary")
    near = near_words(vocabulary, **options)
    enough = F.col("form_n") >= F.lit(times) * F.col("n")
    chosen = near.withColumns({"form": F.when(enough, F.col("form")), "form_n": F.when(enough, F.col("form_n"))})
    chosen = written(chosen, "near")
    roots = followed(chosen.where(F.col("form").isNotNull()))
    out = chosen.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
