"""Column expressions that the operators are made of."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def everything(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def all_different(columns: Iterable[tuple[str, str]]) -> Column:
    """The injectivity predicate: the columns of each pair differ."""
    return everything(F.col(a) != F.col(b) for a, b in columns)


def no_repeat(columns: list[str]) -> Column:
    """Whether a tuple holds no value twice."""
    return F.size(F.array_distinct(F.array(*columns))) == len(columns)


def falling_factorial(n: Column, k: int) -> Column:
    """n (n - 1) ... (n - k + 1): ordered choices of k out of n."""
    return reduce(lambda a, i: a * (n - i), range(1, k), n)


def covers(nlf: Column, demands: dict[str, int]) -> Column:
    """Whether a map label -> count holds at least these counts."""
    return everything(F.coalesce(nlf[label], F.lit(0)) >= k for label, k in sorted(demands.items()))


def intersection(arrays: list[Column]) -> Column:
    return reduce(F.array_intersect, arrays)
