"""User-defined rewards, advantages and generators, and functions for SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions import text as X
from trailmark.operators import advantages

# A reward returns a number, or a dict whose keys are given when it is registered.
RewardFn = Callable[..., object]


@dataclass
class Reward:
    fn: RewardFn
    batched: bool = False
    fields: list[str] = field(default_factory=lambda: ["score"])


REWARDS: dict[str, Reward] = {}
ADVANTAGES: dict[str, Callable[..., DataFrame]] = {}
GENERATORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_reward(name: str, fn: RewardFn, batched: bool = False, fields: list[str] | None = None, **kwargs) -> None:
    """``fn(data_source, solution, truth, extra)`` per row, or on lists of them with ``batched``.

    Keyword arguments are bound now. ``fields`` names the keys of a returned dict.
    """
    bound = partial(fn, **kwargs) if kwargs else fn
    REWARDS[name] = Reward(bound, batched, fields or ["score"])


def apply_reward(df: DataFrame, name: str, source: str, solution: str, truth: str, extra: str | None = None, out: str = "reward") -> DataFrame:
    """Adds a struct of the reward's fields; the function runs in Arrow batches."""
    reward = REWARDS[name]
    fields = reward.fields

    def as_row(result: object) -> list[float]:
        values = result if isinstance(result, dict) else {fields[0]: result}
        return [float(values[f]) if values.get(f) is not None else float("nan") for f in fields]

    @F.pandas_udf(", ".join(f"`{f}` double" for f in fields))
    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for sources, solutions, truths, extras in batches:
            if reward.batched:
                results = reward.fn(sources.tolist(), solutions.tolist(), truths.tolist(), extras.tolist())
            else:
                results = [reward.fn(*row) for row in zip(sources, solutions, truths, extras)]
            yield pd.DataFrame([as_row(r) for r in results], columns=fields)

    extra_col = F.col(extra) if extra else F.lit(None).cast("string")
    return df.withColumn(out, score(F.col(source), F.col(solution), F.col(truth), extra_col))


def register_advantage(name: str, fn: Callable[..., DataFrame] | None = None):
    """Registers an estimator ``df -> df``; the same name with another function is an error."""
    def add(estimator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in ADVANTAGES and ADVANTAGES[name] is not estimator:
            raise ValueError(f"advantage {name} is already registered with another function")
        ADVANTAGES[name] = estimator
        return estimator

    return add(fn) if fn is not None else add


def compute_advantage(df: DataFrame, name: str, **kwargs) -> DataFrame:
    if name not in ADVANTAGES:
        raise ValueError(f"unknown advantage {name!r}; known: {sorted(ADVANTAGES)}")
    return ADVANTAGES[name](df, **kwargs)


for _name, _fn in {
    "grpo": advantages.grpo,
    "grpo_vectorized": partial(advantages.grpo, floor=True),
    "grpo_passk": advantages.grpo_passk,
    "rloo": advantages.rloo,
    "rloo_vectorized": partial(advantages.rloo, singleton="zero"),
    "opo": advantages.opo,
    "gpg": advantages.gpg,
    "reinforce_plus_plus_baseline": advantages.rfpp_baseline,
    "reinforce_plus_plus": advantages.rfpp,
    "remax": advantages.remax,
    "gae": advantages.gae,
    "optimal_token_baseline": advantages.optimal_token_baseline,
    "tir_optimal_token_baseline": partial(advantages.optimal_token_baseline, compact=True),
}.items():
    register_advantage(_name, _fn)


def register_generator(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """A generator maps a batch of rows to new rows."""
    GENERATORS[name] = fn


def generate(df: DataFrame, name: str) -> DataFrame:
    return GENERATORS[name](df)


# SQL functions over JVM expressions: they are inlined where they are used, so no row goes to Python and nothing is shuffled.
# Arrays of structs become rows by ``select inline(calls) from (select tool_calls(text) as calls from ...)``.
SQL_FUNCTIONS = {
    "tool_calls": """(text string) returns array<struct<call_no int, name string, arguments string>>
        comment 'calls of a message text; bodies that are not JSON objects are dropped'
        return transform(
         filter(
          transform(
           regexp_extract_all(text, r'(?s)<tool_call>(.*?)</tool_call>', 1),
           (raw, i) -> struct(i as call_no, case when raw rlike r'(?s)\\A\\s*\\{.*\\}\\s*\\z' then try_parse_json(raw) end as call)),
          c -> startswith(schema_of_variant(c.call), 'OBJECT')),
         c -> struct(c.call_no as call_no, try_variant_get(c.call, '$.name', 'string') as name, try_variant_get(c.call, '$.arguments', 'string') as arguments))""",
    "search_results": f"""(text string) returns array<struct<pos int, title string, source string, link string>>
        comment 'results of an image-search response text'
        return transform(
         regexp_extract_all(text, r'{X.IMAGE_RESULT}', 0),
         hit -> struct(
          cast(regexp_extract(hit, r'{X.IMAGE_RESULT}', 1) as int) as pos,
          regexp_replace(regexp_extract(hit, r'{X.IMAGE_RESULT}', 2), r'(?U)\\A\\s+|\\s+\\z', '') as title,
          regexp_replace(regexp_extract(hit, r'{X.IMAGE_RESULT}', 3), r'(?U)\\A\\s+|\\s+\\z', '') as source,
          regexp_extract(hit, r'{X.IMAGE_RESULT}', 4) as link))""",
    # How many of the draws of bootstrap_best have their best among the first ``upto`` of n ranked samples.
    "bootstrap_hits": """(upto bigint, n bigint, size bigint) returns bigint
        comment 'number of seeded draws of size samples out of n whose best has rank upto or less'
        return {hits}""",
}

DRAWS = 1000


def uniforms(seed: int, draws: int) -> list[float]:
    """The uniforms of the draws in order, from md5 as in the SQL expressions."""
    return sorted(int(hashlib.md5(f"{seed}|{i}".encode()).hexdigest()[:13], 16) / 16**13 for i in range(draws))


def bootstrap_hits(upto: Column, n: Column, size: Column, seed: int = 42, draws: int = DRAWS) -> Column:
    """Number of draws whose best of ``size`` has rank ``upto`` or less of n.

    The best rank is floor(n * u ** (1 / size)) + 1, so these are the uniforms below (upto / n) ** size; they are
    constants in order, and their number is found by halving.
    """
    held = F.lit(uniforms(seed, draws))
    below = F.pow(upto / n, size)
    steps = F.lit([1 << b for b in range(draws.bit_length() - 1, -1, -1)])

    def step(found: Column, more: Column) -> Column:
        at = found + more
        return F.when((at <= draws) & (F.get(held, F.least(at, F.lit(draws)) - 1) < below), at).otherwise(found)

    return F.aggregate(steps, F.lit(0), step).cast("bigint")


def bootstrap_best(value: Column, count: Column, upto: Column, n: Column, size: Column, seed: int = 42, draws: int = DRAWS) -> Column:
    """Aggregate: seeded bootstrap mean of the best of ``size`` draws, over the distinct values of a group.

    ``count`` is how often a value occurs, ``upto`` the samples up to it and ``n`` all samples (see
    ``evaluation.value_ladder``). It is a sum, so it is combined before the shuffle, and no group gathers in one call.
    """
    hits = bootstrap_hits(upto, n, size, seed, draws) - bootstrap_hits(upto - count, n, size, seed, draws)
    return F.sum(value * hits) / draws


def majority(n: Column, first: Column, value: Column) -> Column:
    """Aggregate over votes (one row per prediction): value of the most frequent one, of equals the first seen."""
    return F.max_by(value, F.struct(n, -first))


def register_sql(spark: SparkSession) -> None:
    """Names for SQL users, as temporary functions. In SQL, a majority is ``max_by(value, struct(n, -first))`` and the
    bootstrap mean ``sum(value * (bootstrap_hits(upto, n, k) - bootstrap_hits(upto - c, n, k))) / 1000``."""
    held = "array(" + ", ".join(f"{u!r}D" for u in uniforms(42, DRAWS)) + ")"
    steps = ", ".join(str(1 << b) for b in range(DRAWS.bit_length() - 1, -1, -1))
    hits = (
        f"cast(aggregate(array({steps}), 0, (found, more) -> case when found + more <= {DRAWS} "
        f"and get({held}, least(found + more, {DRAWS}) - 1) < power(upto / n, size) then found + more else found end) as bigint)"
    )
    for name, text in SQL_FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}{text.replace('{hits}', hits)}")
