"""Equi-joins of tuples, set operations, and the multiway extension step."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import intersection
from .stats import adjacency


def hash_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on one key or several; key columns come once."""
    return left.join(right, keys)


def common_neighbours(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs(a, b): v next to both."""
    one, two = edges.select(F.col("src").alias("a"), F.col("dst").alias("v")), edges.select(F.col("src").alias("b"), F.col("dst").alias("v"))
    return pairs.join(one, "a").join(two, ["b", "v"], "left_semi").select("a", "b", "v")


def intersect_all(sets: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, a.columns, "left_semi"), sets).distinct()


def sorted_union(sets: list[DataFrame], by: str) -> DataFrame:
    return reduce(DataFrame.union, sets).distinct().orderBy(by)


def overlap(one: DataFrame, two: DataFrame) -> bool:
    """Whether two tables of one column share a value."""
    return bool(one.join(two, one.columns, "left_semi").head(1))


def difference(one: DataFrame, two: DataFrame) -> DataFrame:
    return one.join(two, one.columns, "left_anti")


def extend(partial: DataFrame, relations: list[tuple[str, DataFrame]], new: str) -> DataFrame:
    """partial with column ``new``: values that every relation (bound column, table with it and ``new``) allows."""
    (bound, first), *rest = relations
    out = partial.join(first, bound)
    for column, relation in rest:
        out = out.join(relation, [column, new], "left_semi")
    return out


def intersect_positions(one: Column, two: Column) -> Column:
    """The values that two arrays of distinct values share, with their places (from 0) in both: an array of (value, first, second)."""
    place = lambda array, x: (F.array_position(array, x) - 1).cast("int")
    return F.transform(F.array_intersect(one, two), lambda x: F.struct(x.alias("value"), place(one, x).alias("first"), place(two, x).alias("second")))


def extend_by_arrays(partial: DataFrame, relations: list[tuple[str, DataFrame]], new: str) -> DataFrame:
    """The same from intersections of neighbour arrays, block by block of ids: no intermediate row that a later relation would drop."""
    out = partial
    for i, (column, relation) in enumerate(relations):
        near = adjacency(relation, column, new).withColumnRenamed("neighbours", f"_near{i}").withColumnRenamed("block", "_block")
        out = out.join(near, [column, "_block"] if i else [column])
    near = [f"_near{i}" for i in range(len(relations))]
    return out.withColumn(new, F.explode(intersection([F.col(c) for c in near]))).drop(*near, "_block")
