"""A stream of edge changes that keeps a graph and its views up to date.

Each micro-batch holds rows op ('+' or '-'), src, dst.  Of several changes of
one edge in a batch the last by ``seq`` counts, if there is such a column.
Batches are applied once: the number of the last one is stored with the graph.
A batch is stored as it is beside the graph, which is written anew only after
some number of batches.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import PropertyGraph
from ..operators.stats import delete_edges, insert_edges
from ..scratch import exists, read_text, remove, write_text
from ..sources import layout
from ..views import maintain, store


class LiveGraph:
    """A graph below path, as a whole and the net changes of the batches since, and the views below views.

    state.json says what counts: the folder g<graph>, the folders d<batch> in
    ``deltas``, and the last batch.  What it doesn't name is left of a lost
    attempt or about to be taken away.
    """

    def __init__(self, spark: SparkSession, path: str, views: str, most_deltas: int = 16):
        self.spark, self.path, self.views, self.most_deltas = spark, path, views, most_deltas

    def start(self, graph: PropertyGraph) -> None:
        layout.write(graph, f"{self.path}/g0")
        self._keep({"graph": 0, "deltas": [], "batch": -1})

    def state(self) -> dict:
        return json.loads(read_text(self.spark, f"{self.path}/state.json"))

    def _keep(self, state: dict) -> None:
        write_text(self.spark, f"{self.path}/state.json", json.dumps(state))

    def graph(self) -> PropertyGraph:
        return self._graph(self.state())

    def _graph(self, state: dict) -> PropertyGraph:
        base = layout.read(self.spark, f"{self.path}/g{state['graph']}")
        if not state["deltas"]:
            return base
        parts = [self.spark.read.parquet(f"{self.path}/d{n}").withColumn("seq", F.lit(n)) for n in state["deltas"]]
        net = latest(reduce(DataFrame.union, parts))
        return changed(base, net)

    def apply(self, changes: DataFrame, batch: int) -> None:
        state = self.state()
        if batch <= state["batch"]:
            return
        self._clear(f"d{batch}")
        latest(changes).write.parquet(f"{self.path}/d{batch}")
        net = self.spark.read.parquet(f"{self.path}/d{batch}")
        now = {"graph": state["graph"], "deltas": [*state["deltas"], batch], "batch": batch}
        if len(now["deltas"]) > self.most_deltas:
            self._clear(f"g{batch + 1}")
            layout.write(self._graph(now), f"{self.path}/g{batch + 1}")
            now = {"graph": batch + 1, "deltas": [], "batch": batch}
        graph = self._graph(now)
        gone, new = net.where("op = '-'").select("src", "dst"), net.where("op = '+'").select("src", "dst")
        for name in store.store_names(self.spark, self.views):
            view, _ = maintain.delete(store.load(self.spark, f"{self.views}/{name}"), gone)
            maintain.insert(view, graph, new)
        self._keep(now)
        if now["graph"] != state["graph"]:
            for old in [f"g{state['graph']}", *(f"d{n}" for n in [*state["deltas"], batch])]:
                self._clear(old)

    def _clear(self, name: str) -> None:
        if exists(self.spark, f"{self.path}/{name}"):
            remove(self.spark, f"{self.path}/{name}")

    def follow(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(lambda df, batch: self.apply(df, batch)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def changed(graph: PropertyGraph, net: DataFrame) -> PropertyGraph:
    """The graph after the net changes(op, src, dst)."""
    pick = lambda op: net.where(F.col("op") == op).select("src", "dst")
    return insert_edges(delete_edges(graph, pick("-")), pick("+"))


def latest(changes: DataFrame) -> DataFrame:
    """The change that counts for each undirected edge."""
    rows = changes.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst")).where("a <> b")
    by = F.col("seq").desc() if "seq" in changes.columns else F.col("op").desc()
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("a", "b").orderBy(by))).where("_n = 1").select("op", F.col("a").alias("src"), F.col("b").alias("dst"))
