"""Matching a pattern: a join pipeline in vertex order, with factorized counting.

After each step only live columns are needed: those of vertices with an edge
to, or the label of, a vertex that is still to come.  A row stands for
``mult`` matches; when columns die, rows that agree on the live ones are
summed.  Vertices with equal label and neighbours that nothing else needs are
counted as ordered choices from one candidate list instead of being joined.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.columns import all_different, falling_factorial
from ..model import MatchResult, Pattern, PropertyGraph, column
from ..plans import order as orders
from ..plans.patterns import equivalence_classes
from . import joins
from .relations import Catalog, neighbour_filter, reduce_fully, scan, scan_all

ISO, HOMO = "iso", "homo"
#: Live columns up to which rows are summed in the middle of a plan.
SUM_UP_TO = 2
#: The most that Spark's own limit takes.
MOST_ROWS = (1 << 31) - 1


@dataclass(frozen=True)
class Step:
    """Brings in vertex u: joined over ``parents``, unlike ``rivals``; then ``live`` columns are needed.

    choose > 1: u stands for that many equivalent vertices.
    """

    u: int
    parents: tuple[int, ...]
    rivals: tuple[int, ...]
    live: tuple[int, ...]
    choose: int = 1


def needed(pattern: Pattern, done: Sequence[int], injective: bool) -> tuple[int, ...]:
    """The matched vertices that a later vertex is next to or, in injective matching, shares the label of."""
    rest = [v for v in range(len(pattern)) if v not in done]
    return tuple(u for u in done if any(pattern.has(u, w) or (injective and pattern.same_label(u, w)) for w in rest))


def plan(pattern: Pattern, order: Sequence[int], injective: bool, factorize: bool, fans: Mapping[tuple[int, int], float] | None = None) -> list[Step]:
    """Steps in vertex order; with fans, a vertex is joined over the earlier neighbour that has the fewest such neighbours."""
    groups = {v: g for g in equivalence_classes(pattern) for v in g} if factorize else {}
    steps, done = [], []
    for u in order:
        if u in done:
            continue
        parents = tuple(v for v in done if pattern.has(u, v))
        if fans:
            parents = tuple(sorted(parents, key=lambda p: (fans[p, u], p)))  # noqa: B023
        rivals = tuple(v for v in done if injective and pattern.same_label(u, v))
        group = groups.get(u, [u])
        rest = [v for v in range(len(pattern)) if v not in done and v not in group]
        whole = len(group) > 1 and done and not set(group) & set(done) and pattern.neighbours[u] <= set(done)
        if whole and not any(injective and pattern.same_label(u, w) for w in rest):
            done += group
            steps.append(Step(u, parents, rivals, needed(pattern, done, injective), len(group)))
        else:
            done.append(u)
            steps.append(Step(u, parents, rivals, needed(pattern, done, injective)))
    return steps


def oriented(relations: Catalog, a: int, b: int) -> DataFrame:
    return relations[min(a, b), max(a, b)].select(column(a), column(b))


def summed(partial: DataFrame, live: Sequence[int]) -> DataFrame:
    """Rows that agree on the live columns become one; counts are decimals, which don't overflow."""
    return partial.groupBy(*map(column, live)).agg(F.sum("mult").alias("mult"))


def execute(pattern: Pattern, relations: Catalog, steps: Sequence[Step], start: DataFrame | None = None, strategy: str = "join", factorize: bool = True, injective: bool = True, watch: dict[int, Observation] | None = None) -> DataFrame:
    """u columns of the live vertices and, if factorized, mult.  The first step may be given as a table.

    watch gets an observation for each vertex that is joined: the rows there are
    then, counted by the job that computes them anyway.
    """
    partial = None
    extend = {"join": joins.extend, "intersect": joins.extend_by_arrays}[strategy]
    bound: list[int] = []
    i = 0
    if start is not None:
        partial, bound, i = start, [steps[0].u], 1
    elif len(steps) == 1:
        raise ValueError("a pattern of one vertex needs its candidates as start")
    else:
        a, b = steps[0].u, steps[1].u
        if steps[1].choose == 1:
            partial, bound, i = oriented(relations, a, b), [a, b], 2
            if injective and pattern.same_label(a, b):
                partial = partial.where(F.col(column(a)) != F.col(column(b)))
            live = steps[1].live
        else:
            partial, bound, i = oriented(relations, a, b).select(column(a)).distinct(), [a], 1
            live = steps[0].live
    if factorize:
        partial = partial.withColumn("mult", F.lit(1).cast("decimal(38,0)"))
        if start is None:
            partial, bound = _shrink(partial, bound, live)
    for step in steps[i:]:
        over = [(column(p), oriented(relations, p, step.u)) for p in step.parents]
        if step.choose > 1:
            partial = _choose(partial, bound, step, over, extend, injective)
        else:
            partial = extend(partial, over, column(step.u))
            partial = partial.where(all_different((column(step.u), column(r)) for r in step.rivals))
            bound = [*bound, step.u]
        if watch is not None:
            watch[step.u] = Observation(f"u{step.u}-{uuid.uuid4().hex}")
            partial = partial.observe(watch[step.u], F.count(F.lit(1)).alias("rows"))
        if factorize:
            partial, bound = _shrink(partial, bound, step.live)
    return partial


def _shrink(partial: DataFrame, bound: list[int], live: Sequence[int]) -> tuple[DataFrame, list[int]]:
    if len(live) == len(bound):
        return partial, bound
    if live and len(live) > SUM_UP_TO:
        return partial.select(*map(column, live), "mult"), list(live)
    return (summed(partial, live) if live else partial.agg(F.sum("mult").alias("mult"))), list(live)


def _choose(partial: DataFrame, bound: Sequence[int], step: Step, over, extend, injective: bool) -> DataFrame:
    """Counts the candidates of each row and multiplies by the ordered choices among them.

    All that the candidates depend on are the parents and the rivals, so they
    are counted once for each combination of those.
    """
    keys = [column(v) for v in bound if v in step.parents or v in step.rivals]
    found = extend(partial.select(*keys).distinct(), over, column(step.u)).where(all_different((column(step.u), column(r)) for r in step.rivals))
    counted = found.groupBy(*keys).agg(F.count("*").cast("decimal(38,0)").alias("_n"))
    n = F.col("_n")
    ways = falling_factorial(n, step.choose) if injective else n
    if not injective:
        for _ in range(step.choose - 1):
            ways = ways * n
    return partial.join(counted, keys).withColumn("mult", (F.col("mult") * ways).cast("decimal(38,0)")).where("mult > 0").drop("_n")


def prepared(graph: PropertyGraph, pattern: Pattern, injective: bool, reduce: str, given: Catalog | None = None, skip: frozenset[int] = frozenset()) -> Catalog:
    """Relations for matching; reduce is "none", "neighbours" or "full"."""
    relations = scan_all(graph, pattern, given)
    if injective and reduce != "none":
        relations = neighbour_filter(graph, pattern, relations, skip)
    if reduce == "full":
        relations = reduce_fully(pattern, relations, top_down_first=True, seeds=set(given or ()) or None)
    return relations


class Sizes(Sequence):
    """The number of vertices of each pattern vertex's label, counted once something asks for it."""

    def __init__(self, graph: PropertyGraph, pattern: Pattern):
        self.graph, self.pattern, self.counts = graph, pattern, None

    def __len__(self) -> int:
        return len(self.pattern)

    def __getitem__(self, u: int) -> int:
        if self.counts is None:
            self.counts = self.graph.label_counts(self.pattern.labels)
        return self.counts[self.pattern.labels[u]]


def chosen_order(graph: PropertyGraph, pattern: Pattern, order: str | Sequence[int] | None) -> list[int]:
    """A given order, or one of a named strategy ("best": of all but cost), whose ties candidates break; by cost if none is named."""
    return _chosen(graph, pattern, order)[0]


def _chosen(graph: PropertyGraph, pattern: Pattern, order: str | Sequence[int] | None) -> tuple[list[int], Mapping[tuple[int, int], float] | None]:
    """The order, and the fans it was chosen by.

    Labels of few vertices have many neighbours each, so the order by cost
    weighs relations; two vertices need no statistics.
    """
    if order is not None and not isinstance(order, str):
        if not orders.valid(pattern, order):
            raise ValueError("every vertex but the first needs an earlier neighbour")
        return list(order), None
    if order not in (None, "cost"):
        return orders.best(pattern, Sizes(graph, pattern), None if order == "best" else order), None
    if len(pattern) == 2:
        return [0, 1], None
    pair = lambda e: (pattern.labels[e[0]], pattern.labels[e[1]])
    vertices, counts = graph.statistics(map(pair, pattern.edges))
    sizes, edges = [vertices[label] for label in pattern.labels], {e: counts[pair(e)] for e in pattern.edges}
    return orders.together(pattern, orders.cost(pattern, sizes, edges)), orders.fans(sizes, edges)


def planned(graph: PropertyGraph, pattern: Pattern, order: str | Sequence[int] | None, injective: bool, factorize: bool) -> list[Step]:
    chosen, fans = _chosen(graph, pattern, order)
    return plan(pattern, chosen, injective, factorize, fans)


def single(graph: PropertyGraph, pattern: Pattern) -> DataFrame:
    return graph.vertices.where(F.col("label") == pattern.labels[0]).select(F.col("id").alias(column(0)))


def matches(graph: PropertyGraph, pattern: Pattern, semantics: str = ISO, order=None, strategy: str = "join", reduce: str = "none", limit: int | None = None) -> DataFrame:
    """One row for each match: u0 ... u{n-1}."""
    injective = semantics == ISO
    if len(pattern) == 1:
        out = single(graph, pattern)
    else:
        steps = planned(graph, pattern, order, injective, False)
        out = execute(pattern, prepared(graph, pattern, injective, reduce), steps, strategy=strategy, factorize=False, injective=injective)
    out = out.select(*[column(u) for u in range(len(pattern))])
    return out.limit(min(limit, MOST_ROWS)) if limit is not None else out


def count(graph: PropertyGraph, pattern: Pattern, semantics: str = ISO, order=None, strategy: str = "join", reduce: str = "none", limit: int | None = None, watch: dict[int, Observation] | None = None) -> DataFrame:
    """One row with n: the number of matches, or least(number, limit)."""
    injective = semantics == ISO
    if len(pattern) == 1:
        out = single(graph, pattern).agg(F.count("*").alias("mult"))
    else:
        steps = planned(graph, pattern, order, injective, True)
        out = execute(pattern, prepared(graph, pattern, injective, reduce), steps, strategy=strategy, injective=injective, watch=watch)
    return total(out, limit)


def total(factorized: DataFrame, limit: int | None = None) -> DataFrame:
    n = F.coalesce(F.sum("mult"), F.lit(0).cast("decimal(38,0)"))
    if limit is not None:
        n = F.least(n, F.lit(limit).cast("decimal(38,0)"))
    return factorized.agg(n.cast("long").alias("n"))


def timed(df: DataFrame, seconds: float | None) -> tuple[list, bool, float]:
    """The collected rows, whether time ran out before, and the time it took; running jobs are cancelled."""
    began = time.time()
    if seconds is None:
        return df.collect(), False, time.time() - began
    spark, tag, done, late = df.sparkSession, f"quiltgraph-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        if not done.wait(seconds):
            late.set()
            while not done.is_set():  # also jobs that start only now
                spark.interruptTag(tag)
                done.wait(0.2)

    watcher = threading.Thread(target=watch, daemon=True)
    spark.addTag(tag)
    watcher.start()
    rows: list = []
    try:
        rows = df.collect()
    except Exception:
        if not late.is_set():
            raise
    finally:
        done.set()
        spark.removeTag(tag)
    return ([], True, time.time() - began) if late.is_set() else (rows, False, time.time() - began)


def match(graph: PropertyGraph, pattern: Pattern, semantics: str = ISO, limit: int | None = None, timeout: float | None = None, **options) -> MatchResult:
    """Counts now; rows are there to be read lazily.  stats: embeddings a second, and the rows after each joined vertex."""
    watch: dict[int, Observation] = {}
    rows, late, seconds = timed(count(graph, pattern, semantics, limit=limit, watch=watch, **options), timeout)
    n = None if late else rows[0]["n"]
    stats = {} if late or seconds <= 0 else {"embeddings_per_second": n / seconds, "rows_after": {u: _observed(o) for u, o in watch.items()}}
    return MatchResult(n, matches(graph, pattern, semantics, limit=limit, **options), late, seconds, stats)


def _observed(rows: Observation) -> int:
    """A branch without rows may have been cut from the plan, and nothing was observed then."""
    try:
        return rows.get["rows"]
    except Py4JJavaError:
        return 0


def valid_rows(graph: PropertyGraph, pattern: Pattern, rows: DataFrame, semantics: str = ISO) -> DataFrame:
    """The rows u0 ... u{n-1} that are matches: every pattern edge is an edge between those labels, and no vertex comes twice."""
    for u, v in pattern.edges:
        rows = rows.join(scan(graph, pattern, u, v), [column(u), column(v)], "left_semi")
    if len(pattern) == 1:
        rows = rows.join(single(graph, pattern), column(0), "left_semi")
    if semantics == ISO:
        rows = rows.where(all_different((column(u), column(v)) for u in range(len(pattern)) for v in range(u) if pattern.same_label(u, v)))
    return rows.select(*[column(u) for u in range(len(pattern))])
