"""Building a view: candidate space, partition, rows of parts, links, completeness."""

from __future__ import annotations

import threading
import uuid
import warnings
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import all_different, everything
from ..model import Pattern, PropertyGraph, column
from ..operators.estimate import by_means
from ..operators.match import oriented
from ..operators.relations import Catalog, candidate_space, candidates, ecand, vcand
from ..plans.partition import MOST_ROWS, PARTITIONERS, adjacent, merged, part_order, ports
from ..scratch import passing, stored, unstored
from . import store
from .store import View, q

#: Key pairs of a link up to which they are stored.
MOST_LINKS = 100_000_000
#: Times the planned size that a part's rows may be before the build gives up.
SLACK = 100


def part_rows(pattern: Pattern, part: list[int], relations: Catalog) -> DataFrame:
    """The embeddings of one part: candidates extended along its edges, all different where labels are equal."""
    order = part_order(pattern, part)
    if len(part) == 1:
        u = part[0]
        own = [r.select(column(u)).distinct() for e, r in sorted(relations.items()) if u in e]
        return reduce(lambda x, y: x.join(y, column(u), "left_semi"), own).select(F.col(column(u)).alias(q(u)))
    a, b = order[:2]
    out = oriented(relations, a, b)
    done = [a, b]
    if pattern.same_label(a, b):
        out = out.where(F.col(column(a)) != F.col(column(b)))
    for u in order[2:]:
        near = [w for w in done if pattern.has(u, w)]
        out = out.join(oriented(relations, near[0], u), column(near[0]))
        for w in near[1:]:
            out = out.join(oriented(relations, w, u), [column(w), column(u)], "left_semi")
        out = out.where(all_different((column(u), column(w)) for w in done if pattern.same_label(u, w)))
        done.append(u)
    return out.select(*[F.col(column(u)).alias(q(u)) for u in part])


def link_pairs(pattern: Pattern, relations: Catalog, one: DataFrame, a: list[int], two: DataFrame, b: list[int]) -> DataFrame:
    """Distinct pairs of port keys of two parts that satisfy every pattern edge between them."""
    pa, pb = ports(pattern, a, b), ports(pattern, b, a)
    out = one.select(*[F.col(q(u)).alias(column(u)) for u in pa]).distinct()
    bound = set(pa)
    for u in pa:
        for v in sorted(pattern.neighbours[u] & set(pb)):
            relation = oriented(relations, u, v)
            out = out.join(relation, [column(u), column(v)], "left_semi") if v in bound else out.join(relation, column(u))
            bound.add(v)
    out = out.where(all_different((column(u), column(v)) for u in pa for v in pb if pattern.same_label(u, v)))
    keys = two.select(*[F.col(q(v)).alias(column(v)) for v in pb]).distinct()
    out = out.join(keys, [column(v) for v in pb], "left_semi")
    return out.select(*[F.col(column(u)).alias(q(u)) for u in [*pa, *pb]]).distinct()


def complete(pattern: Pattern, parts: list[list[int]], rows: dict[int, DataFrame], pairs: dict[tuple[int, int], DataFrame]) -> tuple[dict, dict, dict[int, int]]:
    """The greatest fixpoint: a row stays if every linked part has a linked row that stays and shares no vertex with it.

    A link whose pairs aren't stored lets everything through.
    """
    rows = {i: stored(df) for i, df in rows.items()}
    counts = {i: df.count() for i, df in rows.items()}
    while True:
        step = dict(rows)
        for i, j in pairs:
            for a, b in ((i, j), (j, i)):
                step[a] = _with_partner(pattern, parts, step, pairs[i, j], a, b)
        step = {i: stored(df) for i, df in step.items()}
        now = {i: df.count() for i, df in step.items()}
        for df in rows.values():
            unstored(df)
        rows = step
        if now == counts or 0 in now.values():
            break
        counts = now
    pairs = {(i, j): df.join(_keys(rows[i], ports(pattern, parts[i], parts[j])), [q(u) for u in ports(pattern, parts[i], parts[j])], "left_semi").join(_keys(rows[j], ports(pattern, parts[j], parts[i])), [q(u) for u in ports(pattern, parts[j], parts[i])], "left_semi") for (i, j), df in pairs.items()}
    return rows, pairs, now


def _keys(rows: DataFrame, of: list[int]) -> DataFrame:
    return rows.select(*[q(u) for u in of]).distinct()


def _with_partner(pattern: Pattern, parts: list[list[int]], rows: dict[int, DataFrame], pairs: DataFrame, a: int, b: int) -> DataFrame:
    pa, pb = ports(pattern, parts[a], parts[b]), ports(pattern, parts[b], parts[a])
    rivals = [(u, v) for u in parts[a] for v in parts[b] if pattern.same_label(u, v) and not (u in pa and v in pb)]
    far = sorted({v for _, v in rivals})
    # only what can collide needs the other part's whole rows
    partners = pairs.join(rows[b].select(*[q(v) for v in sorted({*pb, *far})]).distinct(), [q(v) for v in pb])
    partners = partners.select(*[F.col(q(x)).alias(f"p{x}") for x in sorted({*pa, *far})]).distinct()
    same = everything(F.col(q(u)) == F.col(f"p{u}") for u in pa)
    return rows[a].join(partners, same & all_different((q(u), f"p{v}") for u, v in rivals), "left_semi")


def build(graph: PropertyGraph, pattern: Pattern, path: str, partitioner: str = "tree", most_rows: int = MOST_ROWS, most_links: int = MOST_LINKS, merge: bool = False, timeout: float | None = None, parts: list[list[int]] | None = None) -> View:
    """Materializes a view of the pattern below path.

    Its status is built, no_answer (an empty view, stored as such), oversized
    or timeout; only the first two are written.  Parts that are given must be
    connected and cover the pattern.
    """
    spark = graph.vertices.sparkSession
    if timeout is None:
        with passing(spark):
            return _build(graph, pattern, path, partitioner, most_rows, most_links, merge, parts)
    tag, late = f"quiltgraph-{uuid.uuid4().hex}", threading.Event()

    def stop():
        late.set()
        spark.interruptTag(tag)

    timer = threading.Timer(timeout, stop)
    spark.addTag(tag)
    timer.start()
    try:
        with passing(spark):
            return _build(graph, pattern, path, partitioner, most_rows, most_links, merge, parts, late)
    except Exception:
        if not late.is_set():
            raise
        return View(spark, path, pattern, [], [], [], store.TIMEOUT, 0)
    finally:
        timer.cancel()
        spark.removeTag(tag)


class Late(Exception):
    pass


def _build(graph, pattern, path, partitioner, most_rows, most_links, merge, parts, late: threading.Event | None = None, version: int = 1) -> View:
    spark = graph.vertices.sparkSession

    def check() -> None:
        if late is not None and late.is_set():
            raise Late

    relations = {e: stored(df) for e, df in candidate_space(graph, pattern).items()}
    check()
    edges = {e: df.count() for e, df in relations.items()}
    vertices = {u: df.count() for u, df in candidates(pattern, relations).items()}
    if 0 in edges.values():
        return store.save(View(spark, path, pattern, [], [], [], store.NO_ANSWER, version))
    estimate = by_means(pattern, vertices, edges)
    notes: list[str] = []
    if parts is None:
        with warnings.catch_warnings(record=True) as found:
            warnings.simplefilter("always")
            parts = PARTITIONERS[partitioner](pattern, estimate, most_rows)
        notes = [str(w.message) for w in found]
        if merge:
            parts = merged(pattern, parts, estimate, most_rows)
    rows: dict[int, DataFrame] = {}
    for i, part in enumerate(parts):
        check()
        rows[i] = stored(part_rows(pattern, part, relations))
        if rows[i].limit(most_rows * SLACK + 1).count() > most_rows * SLACK:
            return View(spark, path, pattern, parts, [], [], store.OVERSIZED, version)
    links = [(i, j) for i in range(len(parts)) for j in range(i + 1, len(parts)) if adjacent(pattern, set(parts[i]), set(parts[j]))]
    pairs, partial = {}, []
    for i, j in links:
        check()
        df = stored(link_pairs(pattern, relations, rows[i], parts[i], rows[j], parts[j]))
        if df.limit(most_links + 1).count() > most_links:
            partial.append((i, j))
        else:
            pairs[i, j] = df
    check()
    rows, pairs, counts = complete(pattern, parts, rows, pairs)
    if 0 in counts.values():
        return store.save(View(spark, path, pattern, [], [], [], store.NO_ANSWER, version))
    view = View(spark, path, pattern, parts, links, partial, store.BUILT, version, {"rows": [counts[i] for i in range(len(parts))], "notes": notes})
    store.write_version(spark, path, version, tables(pattern, rows, pairs, relations))
    return store.save(view)


def tables(pattern: Pattern, rows: dict[int, DataFrame], pairs: dict[tuple[int, int], DataFrame], relations: Catalog) -> dict[str, DataFrame]:
    out = {f"sn_{i}": df for i, df in rows.items()} | {f"se_{i}_{j}": df for (i, j), df in pairs.items()}
    return out | {"ecand": ecand(relations), "vcand": vcand(pattern, relations)}
