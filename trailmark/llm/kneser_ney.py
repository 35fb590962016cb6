"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.llm.common import attach, packed, written
from trailmark.llm.text_blocks import ASKED, Blocks, answered, answers, asked, asking_order, judged_rows, questions, text_blocks
from trailmark.llm.word_model import WORD_SCORES, judge_words, word_counts

ORDER = 4
BINS = 1000
TAIL = 0.99
TRAINING_FOLDS = 4
PIECE, UNIQUE_AT = 1 << 20, 1 << 22
BITMAP_BYTES, ID_BYTES, BROADCAST_BYTES = 4096, 16, 32 << 20
LIMITS = ("centre", "mean_least", "mean_limit", "spread_least", "spread_limit")
# So many documents held out can tell a 99 percent quantile from their extreme.
LEAST_HELD = 100


@dataclass(frozen=True)
class Alphabet:
    """Symbols of a model, 0 for the beginning of a text: ``size`` of them, or 16 bits if ``units``. A gram of ORDER symbols is a number."""

    size: int
    units: bool

    def symbols(self, text: str) -> np.ndarray:
        if self.units:
            return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.int64)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return CLASS_OF[np.minimum(points, 0x250)].astype(np.int64)

    def suffix(self, gram: Column, n: int) -> Column:
        """The last ``n`` symbols."""
        if not self.units:
            return gram % F.lit(self.size**n)
        return gram.bitwiseAND(F.lit((1 << 16 * n) - 1)) if n < ORDER else gram

    def context(self, gram: Column) -> Column:
        """All symbols but the last."""
        return F.shiftrightunsigned(gram, 16) if self.units else F.floor(gram / F.lit(self.size))


def _classes() -> np.ndarray:
    """Class of each code point below 0x250, and of all others in one; 0 marks the beginning of a text."""
    table = np.full(0x251, 39, np.int32)
    table[[9, 10, 11, 12, 13, 32, 0xA0]] = 1
    table[97:123] = np.arange(2, 28)
    table[65:91] = 28
    table[48:58] = 29
    for number, characters in enumerate([".", ",", "!?", "'\"-`", "()[]{};:", "#$%&*+/<=>@\\^_|~"], 30):
        table[[ord(c) for c in characters]] = number
    table[0xA1:0xC0] = 35
    table[0xC0:0xDF] = 37
    table[0xDF:0x250] = 36
    table[0x250] = 38
    return table


# UNITS, by which documents are judged, tells all characters of all scripts apart: code units of UTF-16, two for a character
# beyond the basic plane. CLASSES folds them into few, for models of small texts.
N_CLASSES = 40
CLASS_OF = _classes()
CLASSES, UNITS = Alphabet(N_CLASSES, False), Alphabet(1 << 16, True)
# Grams are dealt by their product with an odd number, which can be undone.
MIX = 0x9E3779B97F4A7C15
UNMIX = pow(MIX, -1, 1 << 64)


def grams(text: str, alphabet: Alphabet = CLASSES) -> Iterator[np.ndarray]:
    """Numbers of the grams that end at each symbol of a text, a piece at a time."""
    tail, base = np.zeros(ORDER - 1, np.int64), np.int64(alphabet.size)
    for a in range(0, len(text), PIECE):
        held = np.concatenate([tail, alphabet.symbols(text[a : a + PIECE])])
        pairs = held[:-1] * base + held[1:]
        tail = held[-(ORDER - 1) :]
        yield pairs[:-2] * (base * base) + pairs[2:]


def distinct_grams(texts: Iterable[str | None], train: Iterable[bool], alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of some texts in order, and how often the texts to train on have them."""
    sums = np.empty(0, np.int64), np.empty(0, np.int64)
    held: list[tuple[np.ndarray, bool]] = []
    size = 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        known, counts = sums
        for trained in (False, True):
            some = [g for g, t in held if t == trained]
            found, n = np.unique(np.concatenate(some), return_counts=True) if some else sums_of_none
            both, at = np.unique(np.concatenate([known, found]), return_inverse=True)
            known, counts = both, np.bincount(at, np.concatenate([counts, n * trained]), len(both)).astype(np.int64)
        return known, counts

    sums_of_none = sums
    for text, trained in zip(texts, train, strict=True):
        for g in grams(text or "", alphabet):
            held.append((g, bool(trained)))
            size += len(g)
            if size >= UNIQUE_AT:
                sums, held, size = summed(), [], 0
    return summed()


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of one task under CLASSES, with their counts in the texts to train on; 0 where only others have them."""
    texts, train = [], []
    for batch in batches:
        texts += batch["text"].to_pylist()
        train += batch["train"].to_pylist()
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in distinct_grams(texts, train, CLASSES)], names=["gram", "count"])


def discounts(counts: DataFrame) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more, from the numbers of grams with counts 1 to 4."""
    row = counts.agg(*[F.count(F.when(F.col("count") == i, 1)) for i in (1, 2, 3, 4)]).first()
    n = [max(1, v) for v in row]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.0), i + 1.0) for i in range(3)]


def discount_of(count: Column, d: list[float]) -> Column:
    return F.when(count == 1, d[0]).when(count == 2, d[1]).otherwise(d[2])


def levels(counts: DataFrame, alphabet: Alphabet = CLASSES) -> list[tuple[DataFrame, DataFrame]]:
    """For orders 1 to ORDER: (gram, p) of the grams seen, and (context, weight) of lower orders after it.

    Lower orders count in how many grams a gram continues another symbol. Everything is
    joined by gram or context; the order below always has the suffix of a gram seen.
    """
    tables = [counts]
    for order in range(ORDER - 1, 0, -1):
        tables.append(tables[-1].groupBy(alphabet.suffix(F.col("gram"), order).alias("gram")).agg(F.count(F.lit(1)).alias("count")))
    out: list[tuple[DataFrame, DataFrame]] = []
    for order, table in enumerate(tables[::-1], 1):
        d = discounts(table)
        seen = table.withColumn("context", alphabet.context(F.col("gram")))
        taken = discount_of(F.col("count"), d)
        contexts = seen.groupBy("context").agg(F.sum("count").alias("total"), F.sum(taken).alias("held"))
        contexts = contexts.withColumn("weight", F.col("held") / F.col("total"))
        joined = seen.join(contexts, "context").withColumn("own", F.greatest(F.col("count") - taken, F.lit(0.0)) / F.col("total"))
        if order == 1:
            scored = joined.withColumn("p", F.col("own") + F.col("weight") / F.lit(float(alphabet.size)))
        else:
            lower = out[-1][0].withColumnRenamed("gram", "suffix").withColumnRenamed("p", "below")
            scored = joined.withColumn("suffix", alphabet.suffix(F.col("gram"), order - 1)).join(lower, "suffix")
            scored = scored.withColumn("p", F.col("own") + F.col("weight") * F.col("below"))
        out.append((written(scored.select("gram", "p"), f"order-{order}"), written(contexts.select("context", "weight"), f"backoff-{order}")))
    return out


def gram_scores(grams_met: DataFrame, model: list[tuple[DataFrame, DataFrame]], alphabet: Alphabet = CLASSES) -> DataFrame:
    """(gram, logp) of every gram met in the corpus, seen in training or not."""
    out = grams_met.select("gram")
    for order, (scored, contexts) in enumerate(model, 1):
        part = alphabet.suffix(F.col("gram"), order)
        mine = scored.select(F.col("gram").alias("g"), F.col("p").alias(f"p{order}"))
        out = out.join(mine, part == F.col("g"), "left").drop("g")
        back = contexts.select(F.col("context").alias("c"), F.col("weight").alias(f"w{order}"))
        out = out.join(back, alphabet.context(part) == F.col("c"), "left").drop("c")
    p: Column = F.lit(1.0 / alphabet.size)
    for order in range(1, ORDER + 1):
        p = F.coalesce(F.col(f"p{order}"), F.coalesce(F.col(f"w{order}"), F.lit(1.0)) * p)
    return out.select("gram", F.log(p).alias("logp"))


def mixed(numbers: np.ndarray, by: int = MIX) -> np.ndarray:
    return (numbers.view(np.uint64) * np.uint64(by)).view(np.int64)


def block_grams(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    found, trained = distinct_grams((t.as_py() for t in rows["text"]), rows["train"].to_pylist(), UNITS)
    return mixed(found), trained


def gram_answers(blocks: Blocks) -> DataFrame:
    """block, part, held: to each block the log probabilities of its distinct grams, all counts and scores being sharded tables."""
    parts = blocks.parts
    wanted = written(asked(blocks, block_grams), "gram-questions")

    def total(group: pa.Table) -> pa.Table:
        hashes, (counts,), _ = questions(group, 1)
        found, at = np.unique(hashes, return_inverse=True)
        return pa.table({"gram": mixed(found, UNMIX), "count": np.bincount(at, counts, len(found)).astype(np.int64)})

    met = written(wanted.groupBy("part").applyInArrow(total, "gram long, count long"), "grams")
    scores = gram_scores(met, levels(met.where(F.col("count") > 0), UNITS), UNITS)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = mixed(batch["gram"].to_numpy())
            part = (hashes.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(hashes), batch["logp"]], names=["part", "hash", "logp"])

    def answer(group: pa.Table, known: pa.Table) -> pa.Table:
        hashes, _, ends = questions(group, 1)
        names = known["hash"].to_numpy()
        order = np.argsort(names)
        return answers(group, ends, known["logp"].to_numpy()[order[np.searchsorted(names, hashes, sorter=order)]])

    scored = scores.mapInArrow(dealt, "part int, hash long, logp double")
    return wanted.groupBy("part").cogroup(scored.groupBy("part")).applyInArrow(answer, ASKED)


def judge_grams(rows: pa.Table, group: pa.Table, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """n and nll of the rows of a block, given its answers: characters, and minus the log probability of the text."""
    texts = lambda: (t.as_py() or "" for t in rows["text"])
    found, _ = distinct_grams(texts(), [False] * len(rows), UNITS)
    (logp,) = answered(group, asking_order(mixed(found), parts)[0], np.float64)
    nll = [-sum(float(logp[np.searchsorted(found, g)].sum()) for g in grams(text, UNITS)) for text in texts()]
    return np.fromiter(map(len, texts()), np.int64, len(rows)), np.array(nll, np.float64)


def scores(blocks: Blocks) -> DataFrame:
    """key, doc_id, lang, n, nll, n_words, word_nll, worst of every row of the blocks.

    A block asks the shards of the models once for each of its distinct grams and words, and meets the answers in one
    task. So a hot word or gram has one entry per block, and no text meets a model.
    """
    parts = blocks.parts

    def judge(rows: pa.Table, groups: list[pa.Table]) -> list[np.ndarray]:
        return [*judge_grams(rows, groups[0], parts), *judge_words(rows, groups[1], parts)]

    return judged_rows(blocks, [gram_answers(blocks), word_counts(blocks)], judge, f"n long, nll double, {WORD_SCORES}")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id, fold of the documents labelled good and not toxic by every label they have."""
    judged = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    good = judged.agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    fold = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(TRAINING_FOLDS))
    return good.where((F.col("q") == 1) & (F.col("t") == 0)).select("doc_id", fold.alias("fold"))


def with_training(docs: DataFrame, trusted: DataFrame, *keep: Column) -> DataFrame:
    """text, train and ``keep`` of every row: whether its document is one to train on.

    Texts move only if they must. The ids are sent as bitmaps of 32768 ids where that is smaller, and
    broadcast if they are at most BROADCAST_BYTES; beyond that both sides are shuffled.
    """
    ids = trusted.where(F.col("fold") > 0).select("doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(F.lit(0), *keep).alias("keep"))
    bucket, bit = F.bitmap_bucket_number("doc_id"), F.bitmap_bit_position("doc_id")
    bitmaps = written(ids.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bitmap")), "trusted-bitmaps")
    n_ids, n_bitmaps = ids.count(), bitmaps.count()
    if n_bitmaps * BITMAP_BYTES <= n_ids * ID_BYTES:
        side = F.broadcast(bitmaps) if n_bitmaps * BITMAP_BYTES <= BROADCAST_BYTES else bitmaps
        held = rows.withColumn("bucket", bucket).join(side, "bucket", "left")
        byte = F.conv(F.hex(F.substr("bitmap", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        train = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (bit % 8 + 1).cast("int"))) > 0
        return held.select("text", F.coalesce(train, F.lit(False)).alias("train"), "keep.*").drop("col1")
    marked = ids.withColumn("train", F.lit(True))
    side = F.broadcast(marked) if n_ids * ID_BYTES <= BROADCAST_BYTES else marked
    return rows.join(side, "doc_id", "left").select("text", F.coalesce("train", F.lit(False)).alias("train"), "keep.*").drop("col1")


def quantiles(values: DataFrame, value: str, keys: list[str], weight: Column) -> DataFrame:
    """keys, middle and tail quantiles of a weighted value, exact to 1/BINS, without a group in one task."""
    counts = values.groupBy(*keys, F.floor(F.col(value) * BINS).alias("bin")).agg(F.sum(weight).alias("n"))
    ordered = W.partitionBy(*keys).orderBy("bin")
    ranked = counts.withColumn("upto", F.sum("n").over(ordered.rowsBetween(W.unboundedPreceding, 0)))
    ranked = ranked.withColumn("all", F.sum("n").over(W.partitionBy(*keys)))
    # A lower limit is the lower edge of its bin, so that no document of the bin is below it.
    at = lambda q, edge=1: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin") + edge)) / F.lit(float(BINS))
    return ranked.groupBy(*keys).agg(at(1 - TAIL, 0).alias("head"), at(0.5).alias("middle"), at(TAIL).alias("tail"))


def thresholds(scored: DataFrame, trusted: DataFrame) -> DataFrame:
    """lang, overall, held and limits from trusted documents that the model was not trained on.

    A limit is the quantile TAIL, or 1 - TAIL, of the documents held out. The quantile of few documents is itself
    uncertain, so it is widened by its distance from the median, times LEAST_HELD / held where that is below 1;
    that of the worst word is not.
    Quantiles of the mean weigh a document by its length, so that chance in short ones does not widen them. The row
    with a null language and ``overall`` is that of all languages together.
    """
    held = scored.join(trusted.where(F.col("fold") == 0), "doc_id").where(F.col("n") > 0)
    held = written(held.select("lang", "n", "worst", (F.col("nll") / F.col("n")).alias("mean")), "held-out")
    each = F.array(F.struct("lang", F.lit(False).alias("overall")), F.struct(F.lit(None).cast("string").alias("lang"), F.lit(True).alias("overall")))
    key = held.withColumn("key", F.explode(each))
    wider = F.least(F.lit(1.0), F.lit(float(LEAST_HELD)) / F.col("held"))
    beyond = lambda q: F.col(q) + wider * (F.col(q) - F.col("middle"))
    held_of = written(key.groupBy("key").agg(F.count(F.lit(1)).alias("held")), "held-counts")
    mean = quantiles(key, "mean", ["key"], F.col("n")).join(held_of, "key").select(
        "key", "held", F.col("middle").alias("centre"), beyond("head").alias("mean_least"), beyond("tail").alias("mean_limit")
    )
    worst = quantiles(key, "worst", ["key"], F.lit(1)).select("key", F.col("head").alias("worst_least"))
    counted_keys = written(mean.join(worst, "key"), "means")
    total = counted_keys.agg(F.sum("held")).first()[0] or 0
    away = attach(key.drop("worst"), counted_keys, "key", "held", total, F.struct("n", "mean"))
    away = away.withColumn("away", (F.col("mean") - F.col("centre")) * F.sqrt("n"))
    spread = quantiles(away, "away", ["key"], F.lit(1)).join(held_of.select("key", "held"), "key").select(
        "key", beyond("head").alias("spread_least"), beyond("tail").alias("spread_limit")
    )
    return written(counted_keys.join(spread, "key").select("key.lang", "key.overall", "held", *LIMITS, "worst_least"), "thresholds")


def by_language(langs: DataFrame, limits: DataFrame) -> DataFrame:
    """The limits of each language (lang, w): its own if enough documents of it are held out.

    With fewer than LEAST_HELD, a 99 percent quantile cannot be told from the extreme of a handful. Then the widths
    of all languages together are laid around the language's own centre, widened by 1 / held for the
    uncertainty of that centre, and the wider of these, its own and the overall limits holds. A language
    without any has the overall limits.
    """
    own = limits.where(~F.col("overall")).select(F.struct("lang").alias("k"), "held", *LIMITS, "worst_least")
    names = (*LIMITS, "worst_least")
    overall = dict(zip(names, limits.where("overall").select(*names).first() or (None,) * len(names), strict=True))
    found = langs.withColumn("k", F.struct("lang")).join(own, "k", "left").drop("k")
    enough = F.coalesce(F.col("held") >= LEAST_HELD, F.lit(False))
    everyone = lambda c: F.lit(overall[c]).cast("double")
    width = 1 + 1 / F.col("held")
    few = {"centre": F.col("centre"), "worst_least": F.least("worst_least", everyone("worst_least")) * width}
    for c in ("mean_least", "mean_limit"):
        pick = F.least if c == "mean_least" else F.greatest
        few[c] = pick(F.col(c), everyone(c), F.col("centre") + width * (everyone(c) - everyone("centre")))
    few |= {"spread_least": F.least("spread_least", everyone("spread_least")) * width, "spread_limit": F.greatest("spread_limit", everyone("spread_limit")) * width}
    few = {c: F.coalesce(few[c], everyone(c)) if c == "centre" else F.when(F.col("held") > 0, few[c]).otherwise(everyone(c)) for c in names}
    return found.select("lang", "w", *[F.when(enough, F.col(c)).otherwise(few[c]).alias(c) for c in names])


def text_key() -> Column:
    """Key of a row by all that it is judged by, so that rows which share an id are judged one by one."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "lang", "text")]
    return F.xxhash64(*parts, *[F.col(c).isNull() for c in ("doc_id", "lang")])


def verdicts(docs: DataFrame, labels: DataFrame, stored: bool = False) -> DataFrame:
    """doc_id, lang, key, n, mean, limits and kept of every row.

    Texts move once, as compressed blocks. ``stored`` documents are a plain scan of files, whose blocks need no table
    as long as the trusted ids can be sent to the scan.
    """
    trusted = written(trusted_ids(labels), "trusted")
    ids = F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), F.col("lang").cast("string").alias("lang")
    # Ids of this many bytes or less are broadcast, whatever their form.
    stays = stored and trusted.count() * ID_BYTES <= BROADCAST_BYTES
    scored = written(scores(text_blocks(with_training(docs, trusted, *ids), keep=not stays)), "perplexities")
    by_word = scored.select("doc_id", "lang", "worst", F.col("n_words").alias("n"), F.col("word_nll").alias("nll"))
    langs = written(scored.groupBy("lang").agg(F.count(F.lit(1)).alias("w")), "languages")
    limits = by_language(langs, thresholds(scored, trusted)).drop("worst_least")
    word_limits = by_language(langs, thresholds(by_word, trusted)).select(
        F.struct("lang").alias("k"), "worst_least", *[F.col(c).alias(f"word_{c}") for c in LIMITS]
    )
    limits = limits.withColumn("k", F.struct("lang")).join(word_limits, "k", "left").drop("k")
    return with_verdict(scored, written(limits, "limits"))


def with_verdict(scored: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds the limits of the language, mean and kept to rows with lang and scores."""
    n_langs, total = limits.count(), limits.agg(F.sum("w")).first()[0] or 0
    found = attach(scored, limits, "lang", "w", total, F.struct("key", "nll"), n_langs)

    def beyond(nll: str, n: str, prefix: str) -> tuple[Column, Column, Column]:
        mean = F.when(F.col(n) > 0, F.col(nll) / F.col(n)).otherwise(F.lit(0.0))
        away = (mean - F.col(f"{prefix}centre")) * F.sqrt(n)
        strange = (mean > F.col(f"{prefix}mean_limit")) & (away > F.col(f"{prefix}spread_limit"))
        repeated = (mean < F.col(f"{prefix}mean_least")) & (away < F.col(f"{prefix}spread_least"))
        return mean, strange & (F.col(n) > 0), repeated & (F.col(n) > 0)

    mean, strange, repeated = beyond("nll", "n", "")
    _, unknown, _ = beyond("word_nll", "n_words", "word_")
    shunned = (F.col("worst") < F.col("worst_least")) & (F.col("worst") < 0)
    rejected = [F.coalesce(c, F.lit(False)) for c in (strange, repeated, unknown, shunned)]
    found = found.withColumns({"mean": mean, "strange": rejected[0], "repeated": rejected[1], "unknown": rejected[2], "shunned": rejected[3]})
    return found.withColumn("kept", ~(F.col("strange") | F.col("repeated") | F.col("unknown") | F.col("shunned")))


def judged(docs: DataFrame, labels: DataFrame, stored: bool = False) -> DataFrame:
    """doc_id, lang, n_chars, perplexity (per character), least, limit, kept of every row.

    Trained on three of four folds of the documents that ``labels`` trusts; the fourth sets the limits.
    A document is rejected if its mean is beyond its language's limits, and also further from the
    centre than chance lets a text of its length be, so short clean texts stay. Too low a perplexity
    comes from repetition. It is rejected as well if its words are less known than trusted ones (whole words,
    in any script), or if one word of it is common in the corpus and shunned by trusted text. A null or empty text has perplexity 1 and stays; without trusted documents
    all rows stay; a null language is one. Equal rows are judged alike.
    """
    return verdicts(docs, labels, stored).select(
        "doc_id", "lang", F.col("n").alias("n_chars"), F.exp("mean").alias("perplexity"),
        F.exp("mean_least").alias("least"), F.exp("mean_limit").alias("limit"), "kept",
    )


def drop_rejected(docs: DataFrame, labels: DataFrame, stored: bool = False) -> DataFrame:
    """The rows that stay, with all their columns. Texts stay where they are read while the keys of the rejected rows are at most BROADCAST_BYTES."""
    rejected = written(verdicts(docs, labels, stored).where(~F.col("kept")).select("key").distinct(), "rejected")
    side = F.broadcast(rejected) if rejected.count() * ID_BYTES <= BROADCAST_BYTES else rejected
    return packed(docs, key=text_key()).join(side, "key", "left_anti").select("row.*")
