"""Keeping a view up to date under batches of edge changes.

Insertions enumerate the whole matches of the view's pattern that use a new
edge and project them onto the stored parts and key pairs.  Deletions take
away what uses a deleted edge and restore completeness.  Answers over the view
equal those over a rebuilt one; its tables may hold fewer rows than a rebuild.
What was done since the view was built is counted in its stats.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Pattern, PropertyGraph, column
from ..operators.match import execute, plan
from ..operators.relations import scan_all
from ..plans.partition import MOST_ROWS
from ..scratch import passing, stored
from . import store
from .build import MOST_LINKS, SLACK, _build, complete, tables
from .store import View, q


def delta_relation(graph: PropertyGraph, pattern: Pattern, u: int, v: int, delta: DataFrame) -> DataFrame:
    """The labelled changes that can stand for a pattern edge, in either direction; ends must be vertices."""
    both = delta.select("src", "dst").union(delta.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    of = lambda x, end: graph.vertices.where(F.col("label") == pattern.labels[x]).select(F.col("id").alias(end))
    return both.join(of(u, "src"), "src", "left_semi").join(of(v, "dst"), "dst", "left_semi").select(F.col("src").alias(column(u)), F.col("dst").alias(column(v)))


def new_matches(graph: PropertyGraph, pattern: Pattern, delta: DataFrame) -> DataFrame:
    """Matches in the graph, which holds the delta already, that use at least one edge of it."""
    relations = scan_all(graph, pattern)
    found = []
    for u, v in pattern.edges:
        order = [u, v]
        while len(order) < len(pattern):
            order.append(max((w for w in range(len(pattern)) if w not in order and pattern.neighbours[w] & set(order)), key=lambda w: (len(pattern.neighbours[w] & set(order)), -w)))
        seeded = relations | {(u, v): delta_relation(graph, pattern, u, v, delta)}
        found.append(execute(pattern, seeded, plan(pattern, order, True, False), factorize=False).select(*[column(x) for x in range(len(pattern))]))
    return reduce(DataFrame.union, found).distinct()


def insert(view: View, graph: PropertyGraph, delta: DataFrame) -> tuple[View, dict]:
    """The view after edges delta(src, dst), which graph has already; and what was done.

    An empty view is built anew, and so is one whose parts grow beyond all bounds.
    """
    with passing(view.spark):
        return _insert(view, graph, delta)


def _insert(view: View, graph: PropertyGraph, delta: DataFrame) -> tuple[View, dict]:
    pattern, version = view.pattern, view.version + 1
    if view.status != store.BUILT:
        return _build(graph, pattern, view.path, "tree", MOST_ROWS, MOST_LINKS, False, None, None, version), {"rebuilt": True, "new_matches": None}
    new = stored(new_matches(graph, pattern, delta))
    n = new.count()
    if not n:
        return view, {"rebuilt": False, "new_matches": 0}
    project = lambda of: new.select(*[F.col(column(u)).alias(q(u)) for u in of]).distinct()
    rows = {i: stored(view.rows(i).unionByName(project(part)).distinct()) for i, part in enumerate(view.parts)}
    counts = [rows[i].count() for i in range(len(view.parts))]
    if max(counts) > MOST_ROWS * SLACK:
        return _build(graph, pattern, view.path, "tree", MOST_ROWS, MOST_LINKS, False, None, None, version), {"rebuilt": True, "new_matches": n}
    pairs = {(i, j): view.pairs(i, j).unionByName(project([*view.ports(i, j), *view.ports(j, i)])).distinct() for (i, j), whole in view.linked.items() if whole}
    old = view.relations()
    relations = {(u, v): old[u, v].unionByName(new.select(column(u), column(v))).distinct() for u, v in pattern.edges}
    return _next(view, version, rows, pairs, relations, counts, inserts=1, new_matches=n), {"rebuilt": False, "new_matches": n}


def delete(view: View, delta: DataFrame) -> tuple[View, dict]:
    """The view without the edges delta(src, dst); needs no graph."""
    with passing(view.spark):
        return _delete(view, delta)


def _delete(view: View, delta: DataFrame) -> tuple[View, dict]:
    if view.status != store.BUILT:
        return view, {"emptied": True}
    pattern, version = view.pattern, view.version + 1
    both = stored(delta.select("src", "dst").union(delta.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    gone = lambda a, b: both.select(F.col("src").alias(a), F.col("dst").alias(b))
    rows = {i: view.rows(i) for i in range(len(view.parts))}
    pairs = {(i, j): view.pairs(i, j) for (i, j), whole in view.linked.items() if whole}
    at = {v: i for i, part in enumerate(view.parts) for v in part}
    for u, v in pattern.edges:
        i, j = at[u], at[v]
        if i == j:
            rows[i] = rows[i].join(gone(q(u), q(v)), [q(u), q(v)], "left_anti")
        elif (min(i, j), max(i, j)) in pairs:
            k = min(i, j), max(i, j)
            pairs[k] = pairs[k].join(gone(q(u), q(v)), [q(u), q(v)], "left_anti")
    # each is read for the candidate edges and for the candidates of both ends
    relations = {(u, v): stored(df.join(gone(column(u), column(v)), [column(u), column(v)], "left_anti")) for (u, v), df in view.relations().items()}
    pairs = {k: stored(df) for k, df in pairs.items()}
    rows, pairs, counts = complete(pattern, view.parts, rows, pairs)
    if 0 in counts.values():
        return store.save(View(view.spark, view.path, pattern, [], [], [], store.NO_ANSWER, version)), {"emptied": True}
    counts = [counts[i] for i in range(len(view.parts))]
    lost = sum(view.stats.get("rows", counts)) - sum(counts)
    return _next(view, version, rows, pairs, relations, counts, deletes=1, lost_rows=lost), {"emptied": False, "lost_rows": lost}


def _next(view: View, version: int, rows, pairs, relations, counts: list[int], **done: int) -> View:
    """The next version on disk; what was done is added to what the versions before it count."""
    total = dict(view.stats.get("maintenance", {}))
    for name, n in done.items():
        total[name] = total.get(name, 0) + n
    store.write_version(view.spark, view.path, version, tables(view.pattern, rows, pairs, relations))
    return store.save(View(view.spark, view.path, view.pattern, view.parts, view.links, view.partial, store.BUILT, version, {"rows": counts, "maintenance": total}))
