"""The engine: one object to load graphs, match patterns and use views."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .model import MatchResult, Pattern, PropertyGraph
from .operators import match as direct
from .operators.estimate import estimate
from .plans.order import STRATEGIES, best
from .sources import commerce, layout, text
from .views import answer, build, maintain, store
from .views.store import View


@dataclass
class Engine:
    """order: a strategy's name or None; strategy: join or intersect; reduce: none, neighbours or full; semantics: iso or homo."""

    spark: SparkSession
    order: str | None = None
    strategy: str = "join"
    reduce: str = "none"
    semantics: str = "iso"
    limit: int | None = None
    timeout: float | None = None

    def load_text(self, path: str) -> PropertyGraph:
        return text.read_graph(self.spark, path)

    def load_parquet(self, path: str) -> PropertyGraph:
        return layout.read(self.spark, path)

    def from_tables(self, vertices: DataFrame, edges: DataFrame) -> PropertyGraph:
        return PropertyGraph.undirected(vertices, edges)

    def commerce_graph(self, sf_dir: str) -> PropertyGraph:
        return commerce.graph(self.spark, sf_dir)

    def match(self, graph: PropertyGraph, pattern: Pattern, views: Sequence[View] = (), limit: int | None = None, timeout: float | None = None, semantics: str | None = None) -> MatchResult:
        """Views serve injective matching only; with homomorphisms they are left aside."""
        semantics = semantics or self.semantics
        limit, timeout = limit if limit is not None else self.limit, timeout if timeout is not None else self.timeout
        if views and semantics == direct.ISO:
            return answer.answer(graph, pattern, views, limit, timeout, self.reduce, self.order if self.order in STRATEGIES else None)
        return direct.match(graph, pattern, semantics, limit, timeout, order=self.order, strategy=self.strategy, reduce=self.reduce)

    def explain(self, graph: PropertyGraph, pattern: Pattern, views: Sequence[View] = ()) -> dict:
        if views:
            return answer.explain(graph, pattern, views)
        order = direct.chosen_order(graph, pattern, self.order)
        steps = direct.planned(graph, pattern, self.order, self.semantics == direct.ISO, True)
        return {"order": order, "steps": [vars(s) for s in steps], "best": best(pattern, direct.Sizes(graph, pattern))}

    def materialize(self, graph: PropertyGraph, pattern: Pattern, path: str, partitioner: str = "tree", timeout: float | None = None, **options) -> View:
        return build.build(graph, pattern, path, partitioner, timeout=timeout, **options)

    def views(self, folder: str) -> list[View]:
        return store.load_all(self.spark, folder)

    def insert_edges(self, view: View, graph: PropertyGraph, delta: DataFrame) -> tuple[View, dict]:
        """graph must hold the new edges already."""
        return maintain.insert(view, graph, delta)

    def delete_edges(self, view: View, delta: DataFrame) -> tuple[View, dict]:
        return maintain.delete(view, delta)

    def estimate(self, graph: PropertyGraph, pattern: Pattern) -> int:
        return estimate(graph, pattern).first()[0]
