"""Answering a query with views: a join pipeline over nodes instead of vertices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import all_different
from ..model import MatchResult, Pattern, PropertyGraph, column
from ..operators import match as direct
from ..operators.match import oriented
from ..operators.relations import Catalog, neighbour_filter, reduce_fully, scan_all
from ..plans.order import fans
from ..plans.rewrite import COVERAGE, Costs, Edge, Link, Node, Rewriting, cost_order, edge, node_order, rewrite
from . import store
from .store import View, q


def node_rows(graph: PropertyGraph, query: Pattern, node: Node, views: Sequence[View], relations: Catalog) -> DataFrame:
    """The rows of a node with its patch edges enforced."""
    if node.view is None:
        u = node.vertices[0]
        e = next(e for e in query.edges if u in e)
        return relations[e].select(column(u)).distinct()
    rows = views[node.view].rows(node.part)
    out = rows.select(*[F.col(q(a)).alias(column(b)) for a, b in sorted(node.image.items())])
    for a, b in node.patches:
        out = out.join(relations[a, b], [column(a), column(b)], "left_semi")
    return out


def link_rows(view: View, one: Node, two: Node) -> tuple[DataFrame, list[str], list[str]]:
    """Key pairs under the query's names, and the key columns on each side."""
    pa, pb = view.ports(one.part, two.part), view.ports(two.part, one.part)
    image = one.image | two.image
    pairs = view.pairs(one.part, two.part).select(*[F.col(q(v)).alias(column(image[v])) for v in [*pa, *pb]])
    return pairs, [column(image[v]) for v in pa], [column(image[v]) for v in pb]


def method(r: Rewriting, k: int, done: Sequence[int]) -> str:
    """link: along a stored link that covers enough; columns: over relations into the part's rows; vertex."""
    links = [x for x in r.links if (x.a == k and x.b in done) or (x.b == k and x.a in done)]
    if links and max(x.coverage for x in links) >= COVERAGE:
        return "link"
    if _crossing(r, k, done):
        return "vertex" if r.nodes[k].view is None else "columns"
    return "link"


def _crossing(r: Rewriting, k: int, done: Sequence[int]) -> list[tuple[int, int]]:
    """Relation edges (matched vertex, new vertex) between earlier nodes and this one."""
    own, before = set(r.nodes[k].vertices), {v for d in done for v in r.nodes[d].vertices}
    return [(a, b) if a in before else (b, a) for a, b in r.edges if (a in before and b in own) or (b in before and a in own)]


def pipeline(graph: PropertyGraph, r: Rewriting, views: Sequence[View], relations: Catalog, order: Sequence[int], factorize: bool, fan: Mapping[Edge, float] | None = None) -> DataFrame:
    """Of equal links, and of relations, the one with the least fan is followed first, where fans are given."""
    query = r.query
    known_fan = fan or {}
    bound: list[int] = list(r.nodes[order[0]].vertices)
    partial = node_rows(graph, query, r.nodes[order[0]], views, relations)
    if factorize:
        partial = partial.withColumn("mult", F.lit(1).cast("decimal(38,0)"))
    matched = list(bound)
    if factorize:
        partial, bound = direct._shrink(partial, bound, direct.needed(query, matched, True))
    for at, k in enumerate(order[1:], 1):
        done, node = order[:at], r.nodes[k]
        least = lambda x: min((known_fan.get((a, b) if b in node.vertices else (b, a), 0.0) for a, b in x.covered), default=0.0)  # noqa: B023, E731
        links = sorted((x for x in r.links if (x.a == k and x.b in done) or (x.b == k and x.a in done)), key=lambda x: (-x.coverage, least(x)))
        crossing = sorted(_crossing(r, k, done), key=lambda e: known_fan.get(e, 0.0))
        how = method(r, k, done)
        rows = None if how == "vertex" else node_rows(graph, query, node, views, relations)
        if how == "link":
            first, links = links[0], links[1:]
            partial, known = _follow(partial, r, first, k, views)
            # stored pairs are of stored rows only, so a part that is all ports brings nothing more
            if node.patches or set(rows.columns) != set(known):
                partial = partial.join(rows, known)
        else:
            (a, b), crossing = crossing[0], crossing[1:]
            partial = partial.join(oriented(relations, a, b), column(a))
            if rows is not None:
                partial = partial.join(rows, column(b))
        for x in links:
            pairs, mine, theirs = link_rows(views[node.view], r.nodes[x.a], r.nodes[x.b])
            partial = partial.join(pairs, [*mine, *theirs], "left_semi")
        for a, b in crossing:
            partial = partial.join(oriented(relations, a, b), [column(a), column(b)], "left_semi")
        partial = partial.where(all_different((column(u), column(w)) for u in node.vertices for w in bound if query.same_label(u, w)))
        bound, matched = [*bound, *node.vertices], [*matched, *node.vertices]
        if factorize:
            partial, bound = direct._shrink(partial, bound, direct.needed(query, matched, True))
    return partial


def _follow(partial: DataFrame, r: Rewriting, link: Link, k: int, views: Sequence[View]) -> tuple[DataFrame, list[str]]:
    pairs, mine, theirs = link_rows(views[r.nodes[k].view], r.nodes[link.a], r.nodes[link.b])
    known, new = (theirs, mine) if link.a == k else (mine, theirs)
    return partial.join(pairs, known), new


def given(query: Pattern, r: Rewriting, views: Sequence[View]) -> Catalog:
    """Candidate edges of the views in use, under the query's names and in its direction."""
    out: Catalog = {}
    for number in r.used:
        image = {u: v for n in r.nodes if n.view == number for u, v in n.image.items()}
        for (u, v), df in views[number].relations().items():
            if u in image and v in image:
                a, b = image[u], image[v]
                out[min(a, b), max(a, b)] = df.select(F.col(column(u)).alias("_a"), F.col(column(v)).alias("_b")).select(F.col("_a").alias(column(a)), F.col("_b").alias(column(b)))
    return out


def prepared(graph: PropertyGraph, query: Pattern, views: Sequence[View], reduce: str) -> tuple[Rewriting, Catalog]:
    usable = [v for v in views if v.status in (store.BUILT, store.NO_ANSWER)]
    r = rewrite(query, usable)
    if r.empty:
        return r, {}
    covered = given(query, r, usable)
    relations = scan_all(graph, query, covered)
    if reduce != "none":
        relations = neighbour_filter(graph, query, relations, frozenset(v for n in r.nodes for v in n.enclosed))
    if reduce == "full":
        relations = reduce_fully(query, relations, top_down_first=True, seeds=set(covered) or None)
    return r, relations


def costs(graph: PropertyGraph, r: Rewriting, views: Sequence[View]) -> Costs:
    """Views tell of their candidates and candidate edges, the graph of the other edges and vertices."""
    sizes: dict[int, float] = {}
    fan: dict[Edge, float] = {}
    chance: dict[Edge, float] = {}

    def told(vertices: Mapping[int, float], edges: Mapping[Edge, float]) -> None:
        fan.update(fans(vertices, edges))
        chance.update({(u, v): min(1.0, n / max(1.0, float(vertices[u]) * float(vertices[v]))) for (u, v), n in edges.items()})

    for number in r.used:
        image = {u: v for n in r.nodes if n.view == number for u, v in n.image.items()}
        vertices, edges = views[number].counts()
        own = {image[u]: float(n) for u, n in vertices.items() if u in image}
        told(own, {edge(image[u], image[v]): float(n) for (u, v), n in edges.items() if u in image and v in image})
        sizes |= own
    rest = [e for e in r.query.edges if e not in chance]
    pair = lambda e: (r.query.labels[e[0]], r.query.labels[e[1]])
    if rest:
        labelled, counts = graph.statistics(map(pair, rest))
        alone = {u: float(labelled[r.query.labels[u]]) for e in rest for u in e}
        told(alone, {e: counts[pair(e)] for e in rest})
        sizes = alone | sizes
    rows = [sizes[n.vertices[0]] if n.view is None else float(views[n.view].stats.get("rows", {n.part: 0})[n.part]) for n in r.nodes]
    share = {v: rows[k] / max(1.0, sizes[v]) if n.view is not None else 1.0 for k, n in enumerate(r.nodes) for v in n.vertices}
    return Costs(rows, fan, chance, share)


def _order(graph: PropertyGraph, r: Rewriting, views: Sequence[View], strategy: str | None) -> tuple[list[int], Mapping[Edge, float] | None]:
    """By a strategy for vertices, whose ties rows break, or by cost, then with the fans it was chosen by."""
    if strategy is None:
        known = costs(graph, r, views)
        return cost_order(r, known), known.fan
    alone = direct.Sizes(graph, r.query)
    return node_order(r, [float(alone[n.vertices[0]]) if n.view is None else float(views[n.view].stats.get("rows", {n.part: 0})[n.part]) for n in r.nodes], strategy), None


def count(graph: PropertyGraph, query: Pattern, views: Sequence[View], limit: int | None = None, reduce: str = "none", order: str | None = None) -> DataFrame:
    """One row with n, the same as without views."""
    views = [v for v in views if v.status in (store.BUILT, store.NO_ANSWER)]
    r, relations = prepared(graph, query, views, reduce)
    if r.empty:
        return graph.vertices.sparkSession.createDataFrame([(0,)], "n long")
    if not r.used:
        return direct.count(graph, query, limit=limit, reduce=reduce)
    nodes, fan = _order(graph, r, views, order)
    return direct.total(pipeline(graph, r, views, relations, nodes, True, fan), limit)


def matches(graph: PropertyGraph, query: Pattern, views: Sequence[View], limit: int | None = None, reduce: str = "none", order: str | None = None) -> DataFrame:
    views = [v for v in views if v.status in (store.BUILT, store.NO_ANSWER)]
    r, relations = prepared(graph, query, views, reduce)
    columns = [column(u) for u in range(len(query))]
    if r.empty:
        return graph.vertices.sparkSession.createDataFrame([], ", ".join(f"{c} long" for c in columns))
    if not r.used:
        return direct.matches(graph, query, limit=limit, reduce=reduce)
    nodes, fan = _order(graph, r, views, order)
    out = pipeline(graph, r, views, relations, nodes, False, fan).select(*columns)
    return out.limit(min(limit, direct.MOST_ROWS)) if limit is not None else out


def answer(graph: PropertyGraph, query: Pattern, views: Sequence[View], limit: int | None = None, timeout: float | None = None, reduce: str = "none", order: str | None = None) -> MatchResult:
    rows, late, seconds = direct.timed(count(graph, query, views, limit, reduce, order), timeout)
    n = None if late else rows[0]["n"]
    return MatchResult(n, matches(graph, query, views, limit, reduce, order), late, seconds, {} if late or not seconds else {"embeddings_per_second": n / seconds})


def explain(graph: PropertyGraph, query: Pattern, views: Sequence[View], order: str | None = None) -> dict:
    """The rewriting: nodes in order, how each is reached, live columns, patch edges, views in use."""
    views = [v for v in views if v.status in (store.BUILT, store.NO_ANSWER)]
    r = rewrite(query, views)
    if r.empty:
        return {"empty": True, "views": r.used, "unsure": r.unsure}
    nodes, _ = _order(graph, r, views, order)
    steps, matched = [], []
    for at, k in enumerate(nodes):
        node = r.nodes[k]
        matched += node.vertices
        steps.append({"vertices": node.vertices, "view": node.view, "method": "start" if not at else method(r, k, nodes[:at]), "live": list(direct.needed(query, matched, True)), "patches": node.patches})
    return {"empty": False, "views": r.used, "unsure": r.unsure, "steps": steps, "links": [{"covered": x.covered, "patches": x.patches} for x in r.links], "edges": r.edges}
