"""Patterns, graphs and results."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_VERTICES = 32


class PatternError(ValueError):
    pass


@dataclass(frozen=True)
class Pattern:
    """A small connected graph: vertex i has labels[i]; edges are pairs (u, v) with u < v.

    Repeated edges and either direction are accepted and normalised; self-loops,
    unknown vertices, unconnected patterns and more than 32 vertices are refused.
    """

    labels: tuple[str, ...]
    edges: tuple[tuple[int, int], ...]

    def __init__(self, labels: Iterable, edges: Iterable[tuple[int, int]]):
        object.__setattr__(self, "labels", tuple(map(str, labels)))
        object.__setattr__(self, "edges", tuple(sorted({(min(e), max(e)) for e in edges})))
        if not 1 <= len(self.labels) <= MOST_VERTICES:
            raise PatternError(f"a pattern has 1 to {MOST_VERTICES} vertices, not {len(self.labels)}")
        for u, v in self.edges:
            if u == v or u < 0 or v >= len(self.labels):
                raise PatternError(f"no such edge: {u}-{v}")
        if len(self.reach({0})) < len(self.labels):
            raise PatternError("the pattern is not connected")

    @cached_property
    def neighbours(self) -> tuple[frozenset[int], ...]:
        out: list[set[int]] = [set() for _ in self.labels]
        for u, v in self.edges:
            out[u].add(v)
            out[v].add(u)
        return tuple(map(frozenset, out))

    def __len__(self) -> int:
        return len(self.labels)

    def reach(self, start: set[int], within: set[int] | None = None) -> set[int]:
        """The vertices connected to start, walking only inside ``within``."""
        found, todo = set(start), list(start)
        while todo:
            for v in self.neighbours[todo.pop()]:
                if v not in found and (within is None or v in within):
                    found.add(v)
                    todo.append(v)
        return found

    def has(self, u: int, v: int) -> bool:
        return v in self.neighbours[u]

    def same_label(self, u: int, v: int) -> bool:
        return u != v and self.labels[u] == self.labels[v]

    def demands(self, u: int) -> dict[str, int]:
        """How many neighbours of each label u has."""
        out: dict[str, int] = {}
        for v in self.neighbours[u]:
            out[self.labels[v]] = out.get(self.labels[v], 0) + 1
        return out

    def induced(self, vertices: list[int]) -> tuple[list[str], list[tuple[int, int]]]:
        place = {v: i for i, v in enumerate(vertices)}
        return [self.labels[v] for v in vertices], [(place[u], place[v]) for u, v in self.edges if u in place and v in place]

    @classmethod
    def parse(cls, text: str) -> Pattern:
        """From the text format: lines ``t nV nE``, ``v id label degree``, ``e src dst``."""
        from .sources.text import parse_graph

        labels, edges = parse_graph(text)
        return cls([labels[i] for i in range(len(labels))], edges)

    def text(self) -> str:
        lines = [f"t {len(self)} {len(self.edges)}"]
        lines += [f"v {i} {label} {len(self.neighbours[i])}" for i, label in enumerate(self.labels)]
        return "\n".join([*lines, *(f"e {u} {v}" for u, v in self.edges)]) + "\n"


def column(u: int) -> str:
    """The column of pattern vertex u."""
    return f"u{u}"


@dataclass
class PropertyGraph:
    """vertices(id, label) and edges(src, dst, src_label, dst_label), every edge in both directions, once, no loops."""

    vertices: DataFrame
    edges: DataFrame
    #: Where edges is a union whose branches each have labels of known beginnings: (src, dst, branch).
    branches: tuple[tuple[str, str, DataFrame], ...] = ()
    #: For each branch a table with about as many rows, whose count is cheap.
    sources: tuple[DataFrame, ...] = ()

    def relation(self, a: str, b: str, ca: str = "src", cb: str = "dst") -> DataFrame:
        """Edges from label a to label b; the filter reaches the scan, or picks its partitions."""
        fitting = [df for x, y, df in self.branches if a.startswith(x) and b.startswith(y)]
        source = reduce(DataFrame.union, fitting) if fitting else self.edges.where(F.lit(not self.branches))
        chosen = source.where((F.col("src_label") == a) & (F.col("dst_label") == b))
        return chosen.select(F.col("src").alias(ca), F.col("dst").alias(cb))

    def label_counts(self, labels: Iterable[str]) -> dict[str, int]:
        """Vertices of each of these labels; one row a label reaches the driver."""
        names = sorted(set(labels))
        rows = self.vertices.where(F.col("label").isin(names)).groupBy("label").count().collect()
        return dict.fromkeys(names, 0) | {r["label"]: r["count"] for r in rows}

    def pair_counts(self, pairs: Iterable[tuple[str, str]]) -> dict[tuple[str, str], int]:
        """Directed edges of each label pair."""
        pairs = sorted(set(pairs))
        if not pairs:
            return {}
        wanted = F.struct("src_label", "dst_label").isin([F.struct(F.lit(a).alias("src_label"), F.lit(b).alias("dst_label")) for a, b in pairs])
        rows = self.edges.where(wanted).groupBy("src_label", "dst_label").count().collect()
        return dict.fromkeys(pairs, 0) | {(r["src_label"], r["dst_label"]): r["count"] for r in rows}

    def statistics(self, pairs: Iterable[tuple[str, str]]) -> tuple[dict[str, int], dict[tuple[str, str], float]]:
        """Vertices of each label that occurs, and edges of each label pair: counted, or where branches have sources, estimated.

        The estimate is a source's rows times the shares that the labels have of the branch's vertices.
        """
        pairs = sorted(set(pairs))
        labels = sorted({x for p in pairs for x in p})
        if not self.sources:
            return self.label_counts(labels), self.pair_counts(pairs)
        fitting = {(a, b): [(x, y, t) for (x, y, _), t in zip(self.branches, self.sources) if a.startswith(x) and b.startswith(y)] for a, b in pairs}
        kinds = sorted({k for found in fitting.values() for x, y, _ in found for k in (x, y)})
        held, distinct = F.col("label"), list({id(t): t for found in fitting.values() for *_, t in found}.values())
        counted = [F.count(F.when(held == l, 1)) for l in labels] + [F.count(F.when(held.startswith(k), 1)) for k in kinds]
        # all of it in one job
        jobs = [self.vertices.agg(F.array(*counted).alias("n"))] + [t.agg(F.array(F.count("*")).alias("n")) for t in distinct]
        found = {r["i"]: r["n"] for r in reduce(DataFrame.union, [df.select(F.lit(i).alias("i"), "n") for i, df in enumerate(jobs)]).collect()}
        alone, whole = dict(zip(labels, found[0])), dict(zip(kinds, found[0][len(labels) :]))
        rows = {id(t): found[i + 1][0] for i, t in enumerate(distinct)}
        share = lambda label, kind: alone[label] / max(1, whole[kind])
        return alone, {(a, b): sum(rows[id(t)] * share(a, x) * share(b, y) for x, y, t in found) for (a, b), found in fitting.items()}

    @classmethod
    def undirected(cls, vertices: DataFrame, edges: DataFrame) -> PropertyGraph:
        """From vertices(id, label) and edges(src, dst) that hold each edge in any direction, any number of times.

        Loops and edges with an unknown end are left out.
        """
        both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        both = both.where("src <> dst").distinct()
        label = lambda end: vertices.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
        return cls(vertices.select("id", "label"), both.join(label("src"), "src").join(label("dst"), "dst").select("src", "dst", "src_label", "dst_label"))


@dataclass
class MatchResult:
    """count is exact, or least(total, limit); None if only rows were asked for or time ran out first."""

    count: int | None
    rows: DataFrame | None = None
    timed_out: bool = False
    seconds: float = 0.0
    stats: dict = field(default_factory=dict)
