"""Helpers for building expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body mentions it.

    Without it a nested expression is copied at every mention, and inside a lambda it is computed
    again for every element.
    """
    return F.transform(F.array(value), body)[0]
