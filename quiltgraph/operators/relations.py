"""Scans, filters, semi-joins and the candidate space of a pattern.

A relation (u, v) of a pattern is a DataFrame with columns u<u> and u<v>, named
by the pattern's vertices; a catalog maps pairs u < v to relations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import everything
from ..model import Pattern, PropertyGraph, column
from ..plans.patterns import core_numbers, degeneracy_order
from ..scratch import stored, unstored

Catalog = dict[tuple[int, int], DataFrame]
#: Semi-joins on top of each other before a relation is written.
DEPTH = 3


def scan(graph: PropertyGraph, pattern: Pattern, u: int, v: int) -> DataFrame:
    return graph.relation(pattern.labels[u], pattern.labels[v], column(u), column(v))


def scan_all(graph: PropertyGraph, pattern: Pattern, given: Catalog | None = None) -> Catalog:
    """The relation of each pattern edge; one that is given, for instance a view's candidate edges, replaces the scan."""
    given = {(min(k), max(k)): df for k, df in (given or {}).items()}
    return {e: given.get(e) if e in given else scan(graph, pattern, *e) for e in pattern.edges}


def restricted(relation: DataFrame, u: str, first: DataFrame, v: str, second: DataFrame) -> DataFrame:
    """The relation between two candidate sets, tables whose first column holds ids."""
    one, two = first.select(F.col(first.columns[0]).alias(u)), second.select(F.col(second.columns[0]).alias(v))
    return relation.join(one, u, "left_semi").join(two, v, "left_semi")


def candidates_by_neighbours(graph: PropertyGraph, label: str, demands: dict[str, int], name: str = "id") -> DataFrame:
    """Vertices of a label with at least so many neighbours of each label; sound for injective matches only.

    One pass over the edges of that label, with conditional counts in place of maps.
    """
    own = graph.edges.where((F.col("src_label") == label) & F.col("dst_label").isin(sorted(demands)))
    wanted = sorted(demands.items())
    counts = own.groupBy(F.col("src").alias(name)).agg(*[F.count(F.when(F.col("dst_label") == l, 1)).alias(f"n{i}") for i, (l, _) in enumerate(wanted)])
    return counts.where(everything(F.col(f"n{i}") >= k for i, (_, k) in enumerate(wanted))).select(name)


def neighbour_filter(graph: PropertyGraph, pattern: Pattern, relations: Catalog, skip: frozenset[int] = frozenset()) -> Catalog:
    """Keeps, of one relation of each vertex, the candidates with enough neighbours; semi-joins spread it.

    Vertices that need one neighbour of each label at most gain nothing beyond
    the semi-joins and are left alone, as are those in ``skip``.
    """
    out = dict(relations)
    for u in range(len(pattern)):
        demands = pattern.demands(u)
        if u in skip or max(demands.values(), default=0) < 2:
            continue
        e = next(e for e in pattern.edges if u in e)
        out[e] = out[e].join(candidates_by_neighbours(graph, pattern.labels[u], demands, column(u)), column(u), "left_semi")
    return out


def project(relation: DataFrame, u: int) -> DataFrame:
    """The distinct values of a vertex's column."""
    return relation.select(column(u)).distinct()


def semi_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """The columns stay in their order."""
    return left.join(right.select(on), on, "left_semi").select(*left.columns)


def semi_join_count(left: DataFrame, right: DataFrame, on: str) -> tuple[DataFrame, int]:
    """Also the number of distinct keys on the right."""
    return semi_join(left, right, on), right.select(on).distinct().count()


def schedule(pattern: Pattern, top_down_first: bool = False) -> list[tuple[tuple[int, int], tuple[int, int], int]]:
    """Semi-joins (reduced edge, by edge, at vertex) of a full reducer.

    Along the degeneracy order: trees bottom-up, then every core vertex sweeps
    its edges forward and back, then all of it top-down; answers go the other
    way round.  Exact for trees, a sound pruning for cycles.
    """
    near, core = pattern.neighbours, core_numbers(pattern.neighbours)
    order = degeneracy_order(near)
    place = {v: i for i, v in enumerate(order)}
    edge = lambda a, b: (min(a, b), max(a, b))
    up, down, star = [], [], []
    for v in order:
        later = sorted(w for w in near[v] if place[w] > place[v])
        earlier = sorted(w for w in near[v] if place[w] < place[v])
        if core[v] < 2 and later:
            up += [(edge(v, later[0]), edge(v, c), v) for c in earlier]
            down += [(edge(v, c), edge(v, later[0]), v) for c in earlier]
        else:
            around = [edge(v, w) for w in sorted(near[v], key=place.get)]
            star += [(b, a, v) for a, b in zip(around, around[1:])] + [(a, b, v) for a, b in zip(around, around[1:])][::-1]
    down.reverse()
    return down + star[::-1] + up + star if top_down_first else up + star + star[::-1] + down


def reduce_fully(pattern: Pattern, relations: Catalog, top_down_first: bool = False, seeds: set[tuple[int, int]] | None = None) -> Catalog:
    """The relations after the schedule, written now and then so that plans don't grow.

    With ``seeds``, edges that a view has reduced already, the first sweep starts at those.
    """
    out = {e: stored(df) for e, df in relations.items()}
    depth, made = dict.fromkeys(out, 0), list(out.values())
    steps = schedule(pattern, top_down_first)
    if seeds:
        known = set(seeds)
        ahead = []
        while grown := [(e, by) for e in pattern.edges if e not in known for by in sorted(known) if set(e) & set(by)]:
            e, by = grown[0]
            ahead.append((e, by, min(set(e) & set(by))))
            known.add(e)
        steps = ahead + steps
    for e, by, v in steps:
        out[e] = semi_join(out[e], out[by], column(v))
        depth[e] = max(depth[e], depth[by]) + 1
        if depth[e] > DEPTH:
            out[e], depth[e] = stored(out[e]), 0
            made.append(out[e])
    out = {e: stored(df) if depth[e] else df for e, df in out.items()}
    for df in made:
        if all(df is not kept for kept in out.values()):
            unstored(df)
    return out


def candidates(pattern: Pattern, relations: Catalog) -> dict[int, DataFrame]:
    """The candidate set of each vertex: what all its relations agree on."""
    return {u: reduce(lambda a, b: a.join(b, column(u), "left_semi"), [project(df, u) for e, df in sorted(relations.items()) if u in e]) for u in range(len(pattern))}


def prune_by_neighbours(graph: PropertyGraph, pattern: Pattern, vertices: dict[int, DataFrame], v: int, u: int) -> DataFrame:
    """Candidates of v that are next to a candidate of u."""
    return vertices[v].join(scan(graph, pattern, u, v).join(vertices[u], column(u), "left_semi").select(column(v)), column(v), "left_semi")


def eliminate(graph: PropertyGraph, pattern: Pattern, vertices: dict[int, DataFrame], sizes: dict[int, int]) -> dict[int, DataFrame]:
    """One round of pruning, each vertex by all its neighbours, smallest candidate set first."""
    out = dict(vertices)
    for v in sorted(out, key=lambda v: (sizes[v], v)):
        for u in sorted(pattern.neighbours[v]):
            out[v] = prune_by_neighbours(graph, pattern, out, v, u)
    return out


def link(pattern: Pattern, relations: Catalog, vertices: dict[int, DataFrame]) -> Catalog:
    """The candidate edges between candidate sets."""
    return {(u, v): df.join(vertices[u], column(u), "left_semi").join(vertices[v], column(v), "left_semi") for (u, v), df in relations.items()}


def candidate_space(graph: PropertyGraph, pattern: Pattern, injective: bool = True, reduced: bool = True) -> Catalog:
    """Relations of all pattern edges after the neighbour filter and the full reducer."""
    relations = scan_all(graph, pattern)
    if injective:
        relations = neighbour_filter(graph, pattern, relations)
    return reduce_fully(pattern, relations) if reduced else relations


def ecand(relations: Catalog) -> DataFrame:
    """A catalog as one table qu, qv, du, dv."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(u).alias("qu"), F.lit(v).alias("qv"), F.col(column(u)).alias("du"), F.col(column(v)).alias("dv")) for (u, v), df in sorted(relations.items())])


def vcand(pattern: Pattern, relations: Catalog) -> DataFrame:
    """Candidate sets as one table qv, v."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(u).alias("qv"), F.col(column(u)).alias("v")) for u, df in sorted(candidates(pattern, relations).items())])


def merge(one: Catalog, two: Catalog) -> Catalog:
    """The union of two candidate spaces."""
    return {e: one[e].unionByName(two[e]).distinct() for e in one}


def cascade(pattern: Pattern, relations: Catalog) -> Catalog:
    """Arc consistency: every candidate keeps a partner along every edge, by rounds until no row goes."""
    out = {e: stored(df) for e, df in relations.items()}
    counts = {e: df.count() for e, df in out.items()}
    while True:
        vertices = candidates(pattern, out)
        step = {e: stored(df) for e, df in link(pattern, out, vertices).items()}
        now = {e: df.count() for e, df in step.items()}
        for df in out.values():
            unstored(df)
        out = step
        if now == counts:
            return out
        counts = now
