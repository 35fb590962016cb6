"""Offline scores, validation metrics, batch metrics and step-metric aggregation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from trailmark.functions import constants as K
from trailmark.operators.ordering import BUCKETS, at_ranks, hash_bucket, ranked, small_ladder, split_hot, spread_ladder, value_ladder
from trailmark.operators.profiles import percentile_row
from trailmark.session import written

GROUP = ["data_source", "uid", "variable"]


def offline_score(df: DataFrame, source: str = "data_source", row: str = "prompt_id", score: str = "score") -> DataFrame:
    """Mean of the responses of each row, then mean of the rows of each source."""
    return df.groupBy(source, row).agg(F.avg(score).alias("s")).groupBy(source).agg(F.avg("s").alias("score"))


def melt(df: DataFrame, variables: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Long form: one row per sample and variable."""
    lines = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables])
    return df.select(*keys, F.inline(lines))


def draw_sizes(n: Column) -> Column:
    """2, 4, 8, ... below n, then n; empty for n <= 1."""
    powers = F.array(*[F.lit(2**i).cast("bigint") for i in range(1, 41)])
    # As many as n - 1 has binary digits after the first; a slice of a fixed array costs less a row than a filter.
    below = F.slice(powers, F.lit(1), F.length(F.bin(n - 1)) - 1)
    return F.when(n > 1, F.concat(below, F.array(n.cast("bigint")))).otherwise(F.array().cast("array<bigint>"))


def extremes(ladder: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Exact mean and deviation of the best and worst of k draws with replacement, for each draw size."""
    rows = ladder.where("n > 1").withColumn("k", F.explode(draw_sizes(F.col("n"))))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    top, under = F.col("upto") / n, (F.col("upto") - F.col("c")) / n
    p_best = F.pow(top, k) - F.pow(under, k)
    p_worst = F.pow(1 - under, k) - F.pow(1 - top, k)
    value = F.col("value")

    def moments(p: Column, name: str) -> list[Column]:
        return [F.sum(p * value).alias(f"{name}_mean"), F.sum(p * value * value).alias(f"{name}_sq")]

    out = rows.groupBy(*group, "k").agg(*moments(p_best, "best"), *moments(p_worst, "worst"))

    def spread(name: str) -> Column:
        variance = F.col(f"{name}_sq") - F.col(f"{name}_mean") * F.col(f"{name}_mean")
        return F.sqrt(F.when(variance > 0, variance).otherwise(0.0))

    return out.select(
        *group, "k", "best_mean", spread("best").alias("best_std"), "worst_mean", spread("worst").alias("worst_std")
    )


def uniforms(head: bytes, ends: list[bytes]) -> np.ndarray:
    """Numbers in [0, 1) from the md5 of ``head`` and each end, as ``ordering.unit_interval`` has them: any engine draws the same."""
    digests = b"".join([md5(head + end).digest()[:8] for end in ends])
    return (np.frombuffer(digests, ">u8") >> np.uint64(12)).astype(np.float64) / 16.0**13


def tasks(df: DataFrame) -> int:
    """Partitions for rows that are few bytes and much work, which adaptive execution would put into one task."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def extreme_ranks(seed: int, draws: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """g, side, r, w: how often rank r is the best or worst of k of n, of each row with ``g.n``, ``g.k`` and ``keys``."""
    ends = [b"|%d" % d for d in range(1, draws + 1)]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, sides, ranks, counts = [], [], [], []
            sizes = zip(*(batch["g"].field(c).to_pylist() for c in ("n", "k")), batch["keys"].to_pylist(), strict=True)
            for row, (n, k, keys) in enumerate(sizes):
                for side in ("best", "worst"):
                    u = uniforms(f"{seed}{side}|{keys}".encode(), ends)
                    largest = np.minimum(np.floor(n * u ** (1.0 / k)).astype(np.int64) + 1, n)
                    r, w = np.unique(largest if side == "best" else n + 1 - largest, return_counts=True)
                    source += [row] * len(r)
                    sides += [side] * len(r)
                    ranks.append(r)
                    counts.append(w)
            given = batch["g"].take(pa.array(source, pa.int32()))
            columns = [given, pa.array(sides, pa.string()), *(pa.array(np.concatenate(c or [[]]).astype(np.int64)) for c in (ranks, counts))]
            yield pa.RecordBatch.from_arrays(columns, names=["g", "side", "r", "w"])

    return draw


def bootstrap_extremes(ladder: DataFrame, seed: int = 42, draws: int = 1000, group: Sequence[str] = GROUP) -> DataFrame:
    """Seeded bootstrap of the best and worst of k draws: the rank of the extreme is drawn directly.

    The largest of k uniform ranks has distribution (r/n)^k, so one uniform per draw gives it; the
    value is then looked up by rank.
    """
    groups = ladder.select(*group, "n").distinct().withColumn("k", F.explode(draw_sizes(F.col("n"))))
    # A row here stands for thousands of draws, so the rows are dealt out first, however few bytes they have. The draws of
    # a group and size are counted by rank where they are made.
    keys = F.concat_ws("|", *[F.col(c).cast("string") for c in (*group, "k")]).alias("keys")
    dealt = groups.repartition(tasks(ladder), *group, "n", "k").select(F.struct(*group, "n", "k").alias("g"), keys)
    shape = StructType([dealt.schema["g"]]).add("side", "string").add("r", "long").add("w", "long")
    wanted = dealt.mapInArrow(extreme_ranks(seed, draws), shape).select("g.*", "side", "r", "w")
    met = at_ranks(ladder, wanted, group)
    w, v = F.col("w"), F.col("value")
    out = met.groupBy(*group, "k", "side").agg(
        (F.sum(w * v) / F.sum(w)).alias("mean"), (F.sum(w * v * v) / F.sum(w)).alias("sq")
    )
    variance = F.col("sq") - F.col("mean") * F.col("mean")
    return out.withColumn("std", F.sqrt(F.when(variance > 0, variance).otherwise(0.0))).drop("sq")


def majority_value(df: DataFrame, group: Sequence[str], pred: str, value: str, order: str) -> DataFrame:
    """Value of the first sample with the most frequent prediction; the first seen wins ties."""
    votes = df.groupBy(*group, pred).agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.min_by(value, order).alias("value")
    )
    best = F.max_by(F.struct(F.col(pred).alias("pred"), "value", "n"), F.struct("n", (-F.col("first")).alias("f")))
    return votes.groupBy(*group).agg(best.alias("b")).select(*group, "b.*")


# Trials of one inversion, so that no probability underflows; draws in one array; leaves merged in one task.
TRIALS, DRAWS_PER_ROW, MERGED_BITS = 512, 1000, 8


def binomial(trials: np.ndarray, hits: int, total: int, drawn: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
    """Successes among each of ``trials`` of chance ``hits / total``, by inverting the distribution at uniforms.

    Trials are taken up to ``TRIALS`` at a time, each time with a uniform of its own (``drawn`` of the places asked and the
    number of the part). The rarer outcome is the one that is counted.
    """
    if hits == 0 or hits == total:
        return trials * (hits == total)
    rare = min(hits, total - hits) / total
    found = np.zeros_like(trials)
    for part in range(-(-int(trials.max(initial=0)) // TRIALS)):
        at = np.flatnonzero(trials > part * TRIALS)
        size = np.minimum(trials[at] - part * TRIALS, TRIALS)
        u = drawn(at, part)
        counted = np.zeros_like(size)
        for t in np.unique(size):
            m = np.arange(t)
            mass = np.cumprod(np.concatenate([[(1 - rare) ** float(t)], (t - m[:-1]) / (m[:-1] + 1) * (rare / (1 - rare))]))
            same = size == t
            counted[same] = np.searchsorted(np.cumsum(mass), u[same], side="right")
        found[at] += size - counted if 2 * hits > total else counted
    return found


def halves(level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The draws ``xs`` of a node of the tree split between its two halves; a half without draws ends."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, j, xs = [], [], []
            prefixes, firsts, nodes, lefts, totals = (batch[c].to_pylist() for c in ("keys", "first", "j", "left", "total"))
            for row, trials in enumerate(batch["xs"]):
                x = trials.values.to_numpy()
                head, tail = f"{prefixes[row]}|".encode(), f"|{level}|{nodes[row]}|".encode()

                def drawn(at: np.ndarray, part: int, first=firsts[row], head=head, tail=tail) -> np.ndarray:
                    return uniforms(head, [b"%d%b%d" % (d, tail, part) for d in (at + first).tolist()])

                left = binomial(x, lefts[row], totals[row], drawn)
                for half, node in ((left, nodes[row]), (x - left, nodes[row] + (1 << level))):
                    if half.any():
                        source.append(row)
                        j.append(node)
                        xs.append(half)
            kept = batch.select(["__g", "k", "first", "keys"]).take(pa.array(source, pa.int32()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(j, pa.int64()), lists(xs, np.int32)], names=[*kept.schema.names, "j", "xs"])

    return split


def lists(rows: list[np.ndarray], kind: type) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows or [[]]).astype(kind)))


def multinomial_draws(votes: DataFrame, seed: int, draws: int) -> DataFrame:
    """__g, k, first, j, xs: how often prediction number j is drawn among k draws, in each of the draws from ``first`` on.

    ``votes`` has a row for each prediction of a group ``__g`` with its number ``j`` (from 0) and count ``c``; ``keys`` of a
    group begin its digests. The predictions are the leaves of a binary tree, whose level b splits them by bit b of their
    number. The draws of a node are split between its halves by a binomial with the share of the votes on the left. Each
    level is one join with the nodes, in which up to ``DRAWS_PER_ROW`` draws are one row.
    """
    depth = depth_of(votes)
    n = tasks(votes)
    sizes = votes.groupBy("__g").agg(F.sum("c").alias("n"), F.first("keys").alias("keys"))
    sizes = sizes.where("n > 1").withColumn("k", F.explode(draw_sizes(F.col("n"))))
    firsts = F.explode(F.sequence(F.lit(1), F.lit(draws), F.lit(DRAWS_PER_ROW))).alias("first")
    keys = F.concat_ws("|", F.lit(str(seed)), F.col("keys"), F.col("k").cast("string")).alias("keys")
    rows = sizes.select("__g", "k", firsts, keys, F.lit(0).cast("bigint").alias("j"))
    start = F.array_repeat(F.col("k").cast("int"), F.least(F.lit(DRAWS_PER_ROW), F.lit(draws + 1) - F.col("first")).cast("int"))
    shape = StructType([rows.schema[c] for c in ("__g", "k", "first", "keys", "j")]).add("xs", ArrayType(IntegerType()))
    for level in range(depth):
        right = F.shiftright("j", level).bitwiseAND(F.lit(1).cast("bigint"))
        nodes = votes.groupBy("__g", F.col("j").bitwiseAND(F.lit((1 << level) - 1).cast("bigint")).alias("j")).agg(
            F.sum(F.when(right == 0, F.col("c")).otherwise(0)).alias("left"), F.sum("c").alias("total")
        )
        met = rows.repartition(n, "__g", "j").join(nodes.repartition(n, "__g", "j"), ["__g", "j"])
        if level == 0:
            met = met.withColumn("xs", start)
        rows = met.select("__g", "k", "first", "keys", "j", "xs", "left", "total").mapInArrow(halves(level), shape)
    return (rows if depth else rows.withColumn("xs", start)).drop("keys")


def depth_of(votes: DataFrame) -> int:
    """Levels of the tree over the predictions of the group that has most."""
    return int(votes.agg(F.max("j")).first()[0] or 0).bit_length()


def winners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of equal ``key``, which follow each other, as one: per draw the greatest ``xs``, and the sums of its ``ms`` and
    ``qs`` over the ``ties`` that have it. One value in ``ties``, ``ms`` or ``qs`` stands for all draws."""
    key, held = None, None

    def row() -> pa.RecordBatch:
        kinds = (np.int32, np.int32, np.float64, np.float64)
        return pa.RecordBatch.from_arrays([key, *(lists([a], t) for a, t in zip(held, kinds, strict=True))], names=["key", "xs", "ties", "ms", "qs"])

    for batch in batches:
        done = []
        for i in range(batch.num_rows):
            x, *given = (batch[c][i].values.to_numpy() for c in ("xs", "ties", "ms", "qs"))
            this = batch["key"].slice(i, 1)
            if key is None or not this.equals(key):
                if key is not None:
                    done.append(row())
                key, held = this, [x, *(np.broadcast_to(g, len(x)) for g in given)]
                continue
            more, same = x > held[0], x == held[0]
            held = [np.maximum(x, held[0]), *(np.where(more, g, np.where(same, h + g, h)) for g, h in zip(given, held[1:], strict=True))]
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
    if key is not None:
        yield row()


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The values of the winners, ties averaged, summed over the draws of a row that have one."""
    for batch in batches:
        m, q, n = [], [], []
        for i in range(batch.num_rows):
            ties, *sums = (batch[c][i].values.to_numpy() for c in ("ties", "ms", "qs"))
            has = ties > 0
            for total, values in zip((m, q), sums, strict=True):
                total.append(float((values[has] / ties[has]).sum()))
            n.append(int(has.sum()))
        yield pa.RecordBatch.from_arrays([batch["key"], pa.array(m, pa.float64()), pa.array(q, pa.float64()), pa.array(n, pa.int64())], names=["key", "m", "q", "n"])


@lru_cache(maxsize=256)
def draw_ends(first: int, count: int, level: int, node: int, part: int) -> list[bytes]:
    """What follows the keys of a group in the digests of ``count`` draws from ``first`` on, at one node of the tree."""
    return [b"%d|%d|%d|%d" % (d, level, node, part) for d in range(first, first + count)]


def leaves(c: np.ndarray, k: int, head: bytes, first: int, count: int) -> dict[int, np.ndarray]:
    """:func:`multinomial_draws` of one group with counts ``c``: how often each prediction that is drawn at all comes in each draw."""
    xs = {0: np.full(count, k, np.int64)}
    for level in range((len(c) - 1).bit_length()):
        below = {}
        for node, x in xs.items():

            def drawn(at: np.ndarray, part: int, level=level, node=node) -> np.ndarray:
                ends = draw_ends(first, count, level, node, part)
                return uniforms(head, ends if len(at) == count else [ends[i] for i in at.tolist()])

            left = binomial(x, int(c[node :: 2 << level].sum()), int(c[node :: 1 << level].sum()), drawn)
            below |= {j: half for j, half in ((node, left), (node + (1 << level), x - left)) if half.any()}
        xs = below
    return xs


def whole_groups(seed: int, draws: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """__g, k, m, q, n of groups that are one row each: what :func:`summed` gives, without a draw that leaves its task."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, sums = [], {name: [] for name in "kmqn"}
            for row, (keys, sizes, *votes) in enumerate(zip(*(batch[x].to_pylist() for x in ("keys", "sizes", "c", "m", "q")), strict=True)):
                c, has = np.array(votes[0], np.int64), np.array([m is not None for m in votes[1]])
                values = [np.array([v or 0.0 for v in column], np.float64) for column in votes[1:]]
                for k in sizes:
                    head, found, n = f"{seed}|{keys}|{k}|".encode(), [0.0, 0.0], 0
                    for first in range(1, draws + 1, DRAWS_PER_ROW):
                        drawn = leaves(c, k, head, first, min(DRAWS_PER_ROW, draws + 1 - first))
                        j, xs = list(drawn), np.stack(list(drawn.values()))
                        won = xs == xs.max(axis=0)
                        ties = (won & has[j, None]).sum(axis=0)
                        for i, value in enumerate(values):
                            found[i] += float((np.where(won, value[j, None], 0.0).sum(axis=0)[ties > 0] / ties[ties > 0]).sum())
                        n += int((ties > 0).sum())
                    source.append(row)
                    for name, x in zip("kmqn", (k, *found, n), strict=True):
                        sums[name].append(x)
            kinds = (pa.int64(), pa.float64(), pa.float64(), pa.int64())
            columns = [batch["__g"].take(pa.array(source, pa.int32())), *(pa.array(sums[x], t) for x, t in zip("kmqn", kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=["__g", *"kmqn"])

    return draw


def majority_draws(df: DataFrame, group: Sequence[str], pred: str, value: str, seed: int = 42, draws: int = 1000) -> DataFrame:
    """Mean and deviation of the majority value of k draws with replacement.

    Only the counts of each prediction decide the vote, so they are drawn (multinomial) instead of
    samples; tied predictions are equally likely to come first, and the first value within the
    winner is any of its values. A group is reduced to its distinct predictions beforehand, the frequent ones first.
    A group of ``2 ** MERGED_BITS`` predictions at most is drawn as a whole, and only its sums leave the task; the samples of a
    group of no more than so many are shuffled once. The draws of other groups are spread.
    """
    group, most = list(group), 1 << MERGED_BITS
    n = tasks(df)

    def voted(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*group, pred).agg(
            F.count(F.lit(1)).alias("c"), F.avg(value).alias("m"), F.avg(F.col(value) * F.col(value)).alias("q")
        )

    digest = F.md5(F.coalesce(F.col(pred).cast("string"), F.lit("")))
    halving = -F.floor(F.log2("c"))
    keys = F.concat_ws("|", *[F.col(c).cast("string") for c in group]).alias("keys")

    def whole(votes: DataFrame) -> DataFrame:
        """The sums of groups whose votes meet in one partition."""
        ordered = F.sort_array(F.collect_list(F.struct(halving.alias("halving"), digest.alias("digest"), F.col(pred).alias("pred"), "c", "m", "q")))
        groups = votes.groupBy(*group).agg(F.sum("c").alias("n"), ordered.alias("votes")).where("n > 1")
        given = groups.select(F.struct(*group).alias("__g"), keys, draw_sizes(F.col("n")).alias("sizes"), "votes.c", "votes.m", "votes.q")
        shape = StructType([given.schema["__g"]]).add("k", "long").add("m", "double").add("q", "double").add("n", "long")
        return given.mapInArrow(whole_groups(seed, draws), shape)

    # Few places have more samples than a group that is drawn as a whole has predictions.
    placed = df.withColumn("__place", F.xxhash64(*group))
    full = written(placed.groupBy("__place").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most).select("__place"), "full-places")
    if full.isEmpty():
        sums = whole(voted(df.repartition(n, *group)))
    else:
        few = placed.join(full, "__place", "left_anti").drop("__place")
        votes = written(voted(placed.join(full, "__place", "left_semi").drop("__place")), "many-votes")
        sizes = votes.groupBy(F.xxhash64(*group).alias("__place")).agg(F.count(F.lit(1)).alias("__n"))
        many = written(sizes.where(F.col("__n") > most).select("__place"), "many-predictions")
        spread = votes.withColumn("__place", F.xxhash64(*group))
        sums = whole(voted(few.repartition(n, *group))).unionByName(whole(spread.join(many, "__place", "left_anti").repartition(n, *group)))
        if not many.isEmpty():
            rows = spread.join(many, "__place", "left_semi").drop("__place")
            rows = ranked(rows, [digest, F.col(pred)], halving * BUCKETS + hash_bucket(digest), group, "r")
            rows = rows.select(F.struct(*group).alias("__g"), keys, (F.col("r") - 1).cast("bigint").alias("j"), "c", "m", "q")
            sums = sums.unionByName(spread_draws(written(rows, "votes"), seed, draws))
    out = sums.select("__g", "k", F.try_divide("m", "n").alias("maj_mean"), F.try_divide("q", "n").alias("sq"))
    variance = F.col("sq") - F.col("maj_mean") * F.col("maj_mean")
    return out.select("__g.*", "k", "maj_mean", F.sqrt(F.when(variance > 0, variance).otherwise(0.0)).alias("maj_std"))


def spread_draws(votes: DataFrame, seed: int, draws: int) -> DataFrame:
    """__g, k, m, q, n: the sums of the values of the winners, found up the tree, ``2 ** MERGED_BITS`` predictions or subtrees at a time."""
    n = tasks(votes)
    drawn = multinomial_draws(votes, seed, draws).repartition(n, "__g", "j")
    named = drawn.join(votes.select("__g", "j", "m", "q").repartition(n, "__g", "j"), ["__g", "j"])
    # A prediction without a value counts as a vote only.
    alone = {"ties": F.col("m").isNotNull().cast("int"), "ms": F.coalesce("m", F.lit(0.0)), "qs": F.coalesce("q", F.lit(0.0))}
    best = named.select(F.struct("__g", "k", "first", "j").alias("key"), "xs", *[F.array(c).alias(name) for name, c in alone.items()])
    for bits in range(max(0, depth_of(votes) - MERGED_BITS), -MERGED_BITS, -MERGED_BITS):
        above = F.col("key.j").bitwiseAND(F.lit((1 << max(0, bits)) - 1).cast("bigint")).alias("j")
        moved = best.select(F.struct("key.__g", "key.k", "key.first", above).alias("key"), "xs", "ties", "ms", "qs")
        best = moved.repartition(n, "key").sortWithinPartitions("key").mapInArrow(winners, moved.schema)
        if bits <= 0:
            break
    shape = StructType([best.schema["key"]]).add("m", "double").add("q", "double").add("n", "long")
    return best.mapInArrow(summed, shape).groupBy("key.__g", "key.k").agg(*[F.sum(c).alias(c) for c in ("m", "q", "n")])


def validation_metrics(df: DataFrame, variables: Sequence[str], source: str = "data_source", uid: str = "uid", pred: str | None = None, seed: int = 42) -> DataFrame:
    """mean@N, std@N, best@n, worst@n (and maj@n with ``pred``) per prompt, averaged over prompts.

    Returns ``data_source, variable, metric, value``.
    """
    named = df.withColumnsRenamed({source: "data_source", uid: "uid"})
    prompt = ["data_source", "uid"]
    # Samples are shuffled once, before they are melted, and both the plain and the drawn statistics are made where they lie.
    small, hot = split_hot(named.select(*prompt, *variables), prompt)
    parts = [(melt(small, variables, prompt), small_ladder)]
    if hot is not None:
        parts.append((melt(hot, variables, prompt), spread_ladder))
    plain = reduce(DataFrame.unionByName, [plain_statistics(long) for long, _ in parts])
    drawn = reduce(DataFrame.unionByName, [extremes(ladder(long, GROUP)) for long, ladder in parts])

    def averaged(stats: DataFrame, size: str, names: dict[str, str]) -> DataFrame:
        """Means over the prompts with the same size, which has a metric of its own for each statistic."""
        means = stats.groupBy("data_source", "variable", size).agg(*[F.avg(c).alias(c) for c in names])
        entries = []
        for c, name in names.items():
            side, _, stat = name.partition("/")
            metric = F.concat(F.lit(f"{side}@"), F.col(size).cast("string"), F.lit(f"/{stat}" if stat else ""))
            entries.append(F.struct(F.when(F.lit(name != "std") | (F.col(size) > 1), metric).alias("metric"), F.col(c).alias("value")))
        return means.select("data_source", "variable", F.inline(F.filter(F.array(*entries), lambda e: e.metric.isNotNull())))

    sides = {f"{side}_{stat}": f"{side}/{stat}" for side in ("best", "worst") for stat in ("mean", "std")}
    every = averaged(plain, "n", {"mean": "mean", "std": "std"}).unionByName(averaged(drawn, "k", sides))
    if pred:
        votes = majority_draws(melt(named, variables, [*prompt, pred]), GROUP, pred, "value", seed)
        every = every.unionByName(averaged(votes, "k", {f"maj_{stat}": f"maj/{stat}" for stat in ("mean", "std")}))
    return every


def plain_statistics(long: DataFrame) -> DataFrame:
    """Count, mean and deviation of the values of each group that has one."""
    stats = [F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")]
    return long.groupBy(*GROUP).agg(*stats).where("n > 0")


def merge_validation(a: DataFrame, b: DataFrame, variables: Sequence[str], **kwargs) -> DataFrame:
    """Metrics over two result sets; a variable that one side lacks is null there."""
    merged = a.unionByName(b, allowMissingColumns=True)
    return validation_metrics(merged, variables, **kwargs)


def route_metrics(metrics: DataFrame) -> DataFrame:
    """Names metrics as core (accuracy or reward at the largest N, kilometre accuracies) or auxiliary."""
    by_source = W.partitionBy("data_source")
    by_variable = W.partitionBy("data_source", "variable")
    size = F.regexp_extract("metric", r"@(\d+)", 1).cast("int")
    metric, variable = F.col("metric"), F.col("variable")
    # Metric rows: a handful per source and variable.
    staged = metrics.withColumns(
        {
            "__core": F.when(F.max(F.when(variable == "acc", 1)).over(by_source) == 1, "acc").otherwise("reward"),
            "__max": F.max(size).over(by_variable),
        }
    )
    at_max = metric.contains(F.concat(F.lit("@"), F.col("__max").cast("string")))
    leading = metric.startswith("mean") | metric.startswith("maj") | metric.startswith("best")
    km = variable.isin([f"acc_{t}km" for t in K.KM_THRESHOLDS])
    section = F.when((variable == F.col("__core")) & leading & at_max, "val-core").when(km & metric.startswith("mean") & at_max, "val-core")
    section = section.otherwise("val-aux")
    return staged.select(F.concat_ws("/", section, "data_source", "variable", "metric").alias("name"), "value")


def batch_metrics(seq: DataFrame, tok: DataFrame, max_response: int, max_prompt: int) -> DataFrame:
    """Score, reward, advantage, return, value and length statistics of a batch; one row per metric.

    ``seq``: score, reward, prompt_length, response_length. ``tok``: advantage, returns, value_est,
    mask. Scores and rewards leave out aborted (empty) responses.
    """
    length, alive = F.col("response_length"), F.col("response_length") > 0
    entries: list[tuple[str, Column]] = []

    def three(name: str, value: Column) -> None:
        entries.extend([(f"{name}/mean", F.avg(value)), (f"{name}/max", F.max(value)), (f"{name}/min", F.min(value))])

    three("critic/score", F.when(alive, F.col("score")))
    three("critic/rewards", F.when(alive, F.col("reward")))
    three("response_length", length)
    entries.append(("response_length/clip_ratio", F.avg((length == max_response).cast("double"))))
    three("response_length_non_aborted", F.when(alive, length))
    entries.append(("response_length_non_aborted/clip_ratio", F.avg(F.when(alive, (length == max_response).cast("double")))))
    entries.append(("response/aborted_ratio", F.avg((~alive).cast("double"))))
    three("prompt_length", F.col("prompt_length"))
    entries.append(("prompt_length/clip_ratio", F.avg((F.col("prompt_length") == max_prompt).cast("double"))))
    from_seq = _entries(seq, entries)
    entries = []
    valid = F.col("mask") != 0
    for name, column in (("critic/advantages", "advantage"), ("critic/returns", "returns"), ("critic/values", "value_est")):
        three(name, F.when(valid, F.col(column)))
    returns, error = F.when(valid, F.col("returns")), F.when(valid, F.col("returns") - F.col("value_est"))
    entries.append(("critic/vf_explained_var", 1.0 - F.var_samp(error) / (F.var_samp(returns) + 1e-5)))
    return from_seq.unionByName(_entries(tok, entries))


def _entries(df: DataFrame, entries: Sequence[tuple[str, Column]]) -> DataFrame:
    """One aggregation over the table, turned into (metric, value) rows."""
    wide = df.agg(*[c.cast("double").alias(f"m{i}") for i, (_, c) in enumerate(entries)])
    lines = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"m{i}").alias("value")) for i, (name, _) in enumerate(entries)])
    return wide.select(F.inline(lines))


def timing_metrics(timings: DataFrame, tokens: DataFrame) -> DataFrame:
    """Seconds per stage and milliseconds per token; generation counts response tokens only.

    ``timings``: step, stage, seconds. ``tokens``: step, prompt_tokens, response_tokens.
    """
    response, every = F.col("response_tokens"), F.col("response_tokens") + F.col("prompt_tokens")
    counted = F.when(F.col("stage") == "gen", response).when(
        F.col("stage").isin("ref", "values", "adv", "update_critic", "update_actor"), every
    )
    return timings.join(tokens, "step").select(
        "step", "stage", F.col("seconds").alias("timing_s"), F.try_divide(F.col("seconds") * 1000, counted).alias("timing_per_token_ms")
    )


def throughput(steps: DataFrame, devices: int) -> DataFrame:
    """Tokens per second and device of each step (columns tokens, seconds)."""
    return steps.withColumn("throughput", F.try_divide(F.col("tokens"), F.col("seconds") * devices))


def reduce_metrics(df: DataFrame) -> DataFrame:
    """Metrics of several replicas in two stages.

    ``metric, kind, replica, place, value``: sum and mean average the replicas at each place first;
    min and max take all values. Replicas with different numbers of values are an error.
    """
    value = F.col("value")
    placed = df.groupBy("metric", "kind", "place").agg(
        F.avg(value).alias("avg"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("n")
    )
    kind = F.col("kind")
    out = placed.groupBy("metric", "kind").agg(
        F.sum("avg").alias("total"), F.avg("avg").alias("mean"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.min("n").alias("fewest"), F.max("n").alias("most"),
    )
    reduced = (
        F.when(F.col("fewest") != F.col("most"), F.raise_error(F.concat(F.lit("replicas differ in length: "), F.col("metric"))).cast("double"))
        .when(kind == "sum", F.col("total")).when(kind == "mean", F.col("mean")).when(kind == "min", F.col("lo")).when(kind == "max", F.col("hi"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown kind "), kind)).cast("double"))
    )
    return out.select("metric", "kind", reduced.alias("value"))


def aggregation_kind(name: Column) -> Column:
    """How a metric is combined over steps: an explicit rule, else by words in its name."""
    low = F.lower(name)

    def words(*items: str) -> Column:
        hit = low.contains(items[0])
        for item in items[1:]:
            hit = hit | low.contains(item)
        return hit

    out = F.when(F.lit(False), "avg")
    for kind, names in K.EXPLICIT_RULES.items():
        out = out.when(name.isin(names), kind)
    return (
        out.when(words("timing_s/"), "sum")
        .when(words("mean", "avg", "average"), "avg")
        .when(words("max", "maximum"), "max")
        .when(words("min", "minimum"), "min")
        .when(words("sum", "total"), "sum")
        .otherwise("avg")
    )


def combine_steps(df: DataFrame, by: Sequence[str | Column] = (), order: str = "step") -> DataFrame:
    """Metrics (``step, metric, value``) combined over steps by the routing rule."""
    kind = aggregation_kind(F.col("metric"))
    value = F.col("value")
    every = df.groupBy(*by, "metric").agg(
        F.sum(value).alias("s"), F.avg(value).alias("a"), F.max(value).alias("hi"), F.min(value).alias("lo"), F.max_by(value, F.col(order)).alias("last")
    )
    routed = (
        F.when(kind == "sum", F.col("s")).when(kind == "max", F.col("hi")).when(kind == "min", F.col("lo")).when(kind == "last", F.col("last")).otherwise(F.col("a"))
    )
    kept = [c for c in every.columns if c not in ("s", "a", "hi", "lo", "last", "metric")]
    return every.select(*kept, "metric", routed.alias("value"))


def aggregate_steps(df: DataFrame, devices: int, by: Sequence[str] = ()) -> DataFrame:
    """:func:`combine_steps` plus the derived throughput, idle ratio and length difference."""
    combined = combine_steps(df, by)
    # One row per metric name and group here: a few hundred.
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))

    def of(name: str) -> Column:
        return F.max(F.when(F.col("metric") == name, F.col("value"))).over(group)

    staged = combined.withColumns(
        {
            "__tokens": of("perf/total_num_tokens"), "__time": of("perf/time_per_step"), "__gen": of("timing_s/gen"),
            "__step": of("timing_s/step"), "__hi": of("global_seqlen/max"), "__lo": of("global_seqlen/min"),
        }
    )
    rate = F.try_divide(F.col("__tokens"), F.col("__time") * devices)
    metric = F.col("metric")
    fixed = staged.withColumn(
        "value",
        F.when((metric == "perf/throughput") & rate.isNotNull(), rate)
        .when(metric == "global_seqlen/minmax_diff", F.col("__hi") - F.col("__lo"))
        .otherwise(F.col("value")),
    )
    idle = (
        staged.where((metric == "timing_s/gen") & F.col("__step").isNotNull())
        .withColumn("metric", F.lit("trainer/idle_ratio"))
        .withColumn("value", F.try_divide(F.col("__gen"), F.col("__step")))
    )
    columns = [*by, "metric", "value"]
    return fixed.select(*columns).unionByName(idle.select(*columns))


def rollout_status(df: DataFrame) -> DataFrame:
    """Processing-time percentiles, partial samples, longest version span and version diversity.

    ``processing_time, param_version, param_version_start, param_version_end``.
    """
    span = F.abs(F.col("param_version_end") - F.col("param_version_start"))
    base = df.agg(
        F.avg("processing_time").alias("time_avg"), F.max("processing_time").alias("time_max"), F.min("processing_time").alias("time_min"),
        F.count(F.when(span != 0, 1)).alias("total_partial_num"), F.avg((span != 0).cast("double")).alias("partial_ratio"), F.max(span).alias("max_partial_span"),
    )
    # Versions are counted distinct first, so the count is of a short list.
    versions = df.groupBy("param_version").agg(F.lit(1).alias("one")).agg(F.count(F.lit(1))).scalar()
    points = percentile_row(df, "processing_time", [0.5, 0.95, 0.99]).select(F.struct("*")).scalar()
    out = base.withColumn("param_version_diversity", versions).withColumn("__p", points)
    return out.withColumns({f"time_tp{p}": F.col(f"__p.p{p}") for p in (50, 95, 99)}).drop("__p")

