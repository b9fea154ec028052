"""Cardinality estimates: homomorphisms of a spanning tree, and means for planning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Pattern, PropertyGraph, column
from .match import oriented, total
from .relations import Catalog, scan_all


def spanning_tree(pattern: Pattern, part: Sequence[int]) -> list[tuple[int, int]]:
    """(parent, child) in depth-first order from the first vertex of the part, which must be connected."""
    out, seen = [], {part[0]}

    def walk(u: int) -> None:
        for v in sorted(pattern.neighbours[u] & set(part)):
            if v not in seen:
                seen.add(v)
                out.append((u, v))
                walk(v)

    walk(part[0])
    return out


def tree_homomorphisms(pattern: Pattern, relations: Catalog, part: Sequence[int]) -> DataFrame:
    """One row with n: exact for trees, otherwise an upper bound.

    Bottom-up, a vertex's candidates carry the number of ways to fill the
    subtree below them, and a parent multiplies the sums of its children.
    """
    tree = spanning_tree(pattern, part)
    ways: dict[int, DataFrame] = {}
    for parent, child in reversed(tree):
        relation = oriented(relations, parent, child)
        below = relation.withColumn("_w", F.lit(1).cast("decimal(38,0)")) if child not in ways else relation.join(ways.pop(child).withColumnRenamed("mult", "_w"), column(child))
        sums = below.groupBy(column(parent)).agg(F.sum("_w").alias("_s"))
        if parent in ways:
            ways[parent] = ways[parent].join(sums, column(parent)).select(column(parent), (F.col("mult") * F.col("_s")).cast("decimal(38,0)").alias("mult"))
        else:
            ways[parent] = sums.withColumnRenamed("_s", "mult")
    return total(ways[part[0]])


def estimate(graph: PropertyGraph, pattern: Pattern) -> DataFrame:
    return tree_homomorphisms(pattern, scan_all(graph, pattern), range(len(pattern)))


def by_means(pattern: Pattern, vertices: dict[int, int], edges: dict[tuple[int, int], int]):
    """estimate(part) from counts of candidates and candidate edges only, with mean degrees along a spanning tree."""

    def of(part: Sequence[int]) -> float:
        rows = float(vertices[part[0]])
        for parent, child in spanning_tree(pattern, part):
            rows *= edges[min(parent, child), max(parent, child)] / max(1, vertices[parent])
        return rows

    return of
