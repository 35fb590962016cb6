"""Semi- and anti-joins against lists of ids, and the distributed decode check."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resume_filter(df: DataFrame, done: DataFrame, key: str, response: str = "response") -> DataFrame:
    """Rows not processed yet; an id counts as done only when one of its records has a response."""
    finished = done.where(F.coalesce(F.col(response) != "", F.lit(False))).select(key)
    return df.join(finished, key, "left_anti")


def drop_bad(df: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    return df.join(bad.select(key), key, "left_anti")


def restrict_to(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key), key, "left_semi")


def check_images(files: DataFrame, decodes: Callable[[bytes], bool]) -> DataFrame:
    """Paths whose content does not decode. ``files`` has ``path`` and ``content``; each task checks
    its own files batch by batch."""
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = [bool(decodes(bytes(c))) if c is not None else False for c in batch["content"]]
            yield batch.loc[[not o for o in ok], ["path"]]

    return files.select("path", "content").mapInPandas(check, "path string")
