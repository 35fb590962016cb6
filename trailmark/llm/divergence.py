"""Quality rules: counts over a document, and its divergence from the characters and common words of its language."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.llm.common import whole, words, written
from trailmark.llm.periodic import recurring
from trailmark.llm.slices import SLICE_BYTES, sliced, text_bytes
from trailmark.llm.tokens import LOWER, WHITE, mix, word_bounds, word_hashes

BITMAP = 32768  # bits of bitmap_construct_agg
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = b"#*$%&|<>"
POINTS = b".,;:!?'\"()-"
WHITE_SPACE, LOWER_CASE, UPPER_CASE, DIGIT, POINT, OTHER_ASCII, SHORT, LONG, INSIDE = range(9)
CLASSES = INSIDE


def _classes() -> np.ndarray:
    """Class of the code point that starts with a byte; bytes inside a code point have none."""
    out = np.full(256, OTHER_ASCII, np.uint8)
    out[WHITE], out[97:123], out[65:91], out[48:58], out[list(POINTS)] = WHITE_SPACE, LOWER_CASE, UPPER_CASE, DIGIT, POINT
    out[0x80:0xC0], out[0xC0:0xE0], out[0xE0:] = INSIDE, SHORT, LONG
    return out


CLASS = _classes()
SYMBOL = np.isin(np.arange(256), list(SYMBOLS))

DDL = (
    "doc_id bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, char_distance bigint, word_distance bigint, kept boolean"
)


@dataclass(frozen=True)
class Rules:
    """Parameters of the rules.

    ``least_sample``: labelled good documents that a language needs.
    ``common``: words in the histogram. ``quantile``: share of the good documents that a limit spares, and ``slack`` widens it.
    ``least_chars``, ``least_words``: shorter documents are not judged by their characters, or words.
    ``least_class``: good documents of a power of two of words from which it has limits of its own.
    """

    fewest_words: int = 50
    repeat_percent: int = 50
    least_sample: int = 50
    common: int = 100
    quantile: float = 0.99
    slack: float = 1.1
    least_chars: int = 200
    least_words: int = 100
    least_class: int = 100
    most_languages: int = 1000


@dataclass(frozen=True)
class References:
    """Histograms of each language, and limits by language and power of two of words (-1: any)."""

    languages: list[str] = field(default_factory=list)
    classes: np.ndarray = field(default_factory=lambda: np.empty((0, CLASSES)))
    common: list[list[str]] = field(default_factory=list)
    shares: np.ndarray = field(default_factory=lambda: np.empty((0, 1)))
    limits: dict[tuple[str, int], tuple[int, int]] = field(default_factory=dict)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the rows, in ten-thousandths: the root of the divergence with base 2."""
    middle = (p + q) / 2

    def part(x):
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(middle > 0, middle, 1)), 0).sum(axis=1)

    return np.rint(np.sqrt(np.maximum((part(p) + part(q)) / 2, 0)) * 10_000).astype(np.int64)


def measure(batch: pa.RecordBatch, rules: Rules, refs: References, tables) -> pa.RecordBatch:
    data, rows = text_bytes(batch["text"])
    n = len(rows) - 1
    starts, ends, offsets = word_bounds(data, rows)
    n_words = np.diff(offsets)
    of_byte = np.repeat(np.arange(n), np.diff(rows))
    held = np.bincount(of_byte * 9 + CLASS[data], minlength=9 * n).reshape(n, 9)[:, :CLASSES]
    word_chars = held.sum(axis=1) - held[:, WHITE_SPACE]
    n_symbols = np.bincount(of_byte[SYMBOL[data]], minlength=n)
    raw = data.tobytes()
    n_dup_lines = np.zeros(n, np.int64)
    for i in range(n):
        lines = [line for line in raw[rows[i] : rows[i + 1]].split(b"\n") if line.strip()]
        n_dup_lines[i] = len(lines) - len(set(lines))
    first, end = recurring(word_hashes(data, starts, ends), offsets, 3)
    repeated = np.bincount(np.searchsorted(offsets, first, side="right") - 1, weights=end - first, minlength=n).astype(np.int64)
    failed = (n_words < rules.fewest_words) | (100 * repeated > rules.repeat_percent * n_words)

    place = {name: i for i, name in enumerate(refs.languages)}
    names = batch["lang"].to_pylist()
    of_lang = np.array([place.get(name, -1) for name in names], np.int64)
    known = of_lang >= 0
    n_chars = held.sum(axis=1)
    by_chars = known & (n_chars >= max(1, rules.least_chars))
    by_words = known & (n_words >= max(1, rules.least_words))
    chars, common = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if by_chars.any():
        chars[by_chars] = distance(held[by_chars] / n_chars[by_chars, None], refs.classes[of_lang[by_chars]])
    if by_words.any():
        keys, bins = tables
        of_word = np.repeat(np.arange(n), n_words)
        asked = word_hashes(LOWER[data], starts, ends) ^ mix((of_lang[of_word] + 1).astype(np.uint64))
        near = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        width = refs.shares.shape[1]
        which = np.where(keys[near] == asked, bins[near], width - 1)
        counts = np.bincount(of_word * width + which, minlength=n * width).reshape(n, width)
        common[by_words] = distance(counts[by_words] / n_words[by_words, None], refs.shares[of_lang[by_words]])
    power = np.floor(np.log2(np.maximum(n_words, 1))).astype(int)
    kept = ~failed
    for i in np.flatnonzero(known & kept):
        limits = refs.limits.get((names[i], int(power[i])), refs.limits.get((names[i], -1)))
        if limits:
            kept[i] = not (by_chars[i] and chars[i] > limits[0]) and not (by_words[i] and common[i] > limits[1])
    return pa.RecordBatch.from_arrays(
        [
            batch["doc_id"], batch["lang"], *(pa.array(c, pa.int64()) for c in (n_words, word_chars, n_symbols, n_dup_lines, repeated)),
            pa.array(failed), pa.array(chars, mask=~by_chars), pa.array(common, mask=~by_words), pa.array(kept),
        ],
        [c.split()[0] for c in DDL.split(", ")],
    )


def measured(docs: DataFrame, rules: Rules, refs: References, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = [(w, i, b) for i, ws in enumerate(refs.common) for b, w in enumerate(ws)]
        ends = np.cumsum([len(w.encode()) for w, _, _ in listed], dtype=np.int64)
        data = np.frombuffer("".join(w for w, _, _ in listed).encode(), np.uint8)
        keys = word_hashes(data, np.concatenate([[0], ends[:-1]]) if len(ends) else ends, ends)
        keys ^= mix(np.array([i + 1 for _, i, _ in listed], np.uint64))
        order = np.argsort(keys)
        tables = keys[order], np.array([b for _, _, b in listed], np.int64)[order]
        for batch in sliced(batches, most=slice_bytes):
            yield measure(batch, rules, refs, tables)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return texts.mapInArrow(judge, DDL)


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang and text of all documents of a known language that are labelled good.

    A bit for the hash of each good id, among 16 to 32 bits an id, is broadcast, so that few other texts are shuffled.
    """
    good = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0)).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    size = max(BITMAP, 1 << (16 * good.count()).bit_length())
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    place = {"__map": F.floor(bit / BITMAP), "__at": bit % BITMAP}
    maps = good.withColumns(place).groupBy("__map").agg(F.bitmap_construct_agg("__at").alias("__bits"))
    held = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where("lang is not null and doc_id is not null")
    likely = texts.withColumns(place).join(F.broadcast(maps), "__map").where(F.bit_get(held, (F.col("__at") % 8).cast("int")) == 1)
    # Not broadcast, however few ids, so that the cost is in proportion to the input; the texts need no order. A semi join
    # would be moved before the filter.
    return likely.select("doc_id", "lang", "text").join(good.hint("shuffle_hash"), "doc_id")


def references(docs: DataFrame, labels: DataFrame, rules: Rules) -> References:
    good = written(trusted(docs, labels), "trusted")
    enough = good.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= rules.least_sample)
    languages = sorted(r.lang for r in enough.collect())
    if len(languages) > rules.most_languages:
        raise ValueError(f"{len(languages)} languages are more than {rules.most_languages}")
    if not languages:
        return References()
    good = good.where(F.col("lang").isin(languages))
    lowered = F.translate(whole("text"), UPPER, LOWERED)
    counted = good.select("lang", F.explode(words(lowered)).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    counted = written(counted, "trusted-words")
    totals = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    # Ranked alone, so that each task sends the first words of a language only.
    order = W.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rules.common)
    common, shares = [[] for _ in languages], np.zeros((len(languages), rules.common + 1))
    for r in top.orderBy("lang", "rank").collect():
        at = languages.index(r.lang)
        shares[at, len(common[at])] = r.n / totals[r.lang]
        common[at].append(r.word)
    for at, ws in enumerate(common):
        shares[at, -1] = 1 - shares[at, : len(ws)].sum()
    text = whole("text")
    patterns = [r"[\x20\x09-\x0D]", "[a-z]", "[A-Z]", "[0-9]", r"[.,;:!?'\x22()\-]", None, r"[\x{80}-\x{7FF}]", r"[\x{800}-\x{10FFFF}]"]
    sums = {f"c{i}": F.sum(F.regexp_count(text, F.lit(p))) for i, p in enumerate(patterns) if p}
    classes = np.zeros((len(languages), CLASSES))
    for r in good.groupBy("lang").agg(F.sum(F.char_length(text)).alias("total"), *[c.alias(k) for k, c in sums.items()]).collect():
        held = [0 if p is None else r[f"c{i}"] for i, p in enumerate(patterns)]
        held[OTHER_ASCII] = r.total - sum(held)
        classes[languages.index(r.lang)] = np.array(held) / max(1, r.total)
    refs = References(languages, classes, common, shares)
    judged = written(measured(good, rules, refs).where(~F.col("base_failed")), "trusted-distances")
    power = F.floor(F.log2("n_words")).cast("int")
    found = judged.withColumn("power", F.explode(F.array(power, F.lit(-1)))).groupBy("lang", "power")
    # The distances are whole numbers up to 10,000, which bounds the state of the percentiles.
    at = found.agg(
        F.count(F.lit(1)).alias("n"), *[F.expr(f"percentile_disc({rules.quantile}) within group (order by {c})").alias(c) for c in ("char_distance", "word_distance")]
    )
    limits = {}
    for r in at.where((F.col("n") >= rules.least_class) | (F.col("power") == -1)).collect():
        widened = [10_000 if v is None else math.floor(v * rules.slack) for v in (r.char_distance, r.word_distance)]
        limits[r.lang, r.power] = tuple(widened)
    return References(languages, classes, common, shares, limits)


def judged(docs: DataFrame, labels: DataFrame, rules: Rules | None = None, **options) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance and kept
    of every row of (doc_id, text, lang), given (doc_id, quality, toxic).

    A document fails the base rule if it has too few words, or too many lie in windows of three words that recur in it. Of the
    others, those go whose histogram of character classes or of common words is further from that of their language
    than nearly all good documents of about its length. Distances are in ten-thousandths; null where the document is too
    short to be judged, or its language has no reference (null, or too few good documents): then the base rule alone decides.

    A null or empty text has no words and fails; a null id stays null; repeated rows give a row each; no rows give none, and
    no labels leave the base rule alone. Other columns are ignored. Documents are judged where they are read; a task holds
    ``slice_bytes`` of text, or one document if that is longer. The references come from all documents labelled good: their texts
    are shuffled once, by id, and kept as a table. Sent to the tasks are ``most_languages`` times
    ``common`` words at most.
    """
    rules = rules or Rules()
    return measured(docs, rules, references(docs, labels, rules), **options)
