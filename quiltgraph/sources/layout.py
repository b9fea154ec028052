"""A graph as Parquet."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model import PropertyGraph

#: Label pairs up to which each has a folder of its own; more would make too many small files.
MOST_FOLDERS = 2000


def write(graph: PropertyGraph, path: str) -> None:
    """vertices and edges; edges lie in a folder for each label pair, or sorted by it, so that scans by label skip the rest."""
    graph.vertices.repartitionByRange("label", "id").sortWithinPartitions("label", "id").write.parquet(f"{path}/vertices")
    pairs = graph.edges.select("src_label", "dst_label").distinct().limit(MOST_FOLDERS + 1).count()
    edges = graph.edges.repartitionByRange("src_label", "dst_label", "src").sortWithinPartitions("src_label", "dst_label", "src", "dst")
    if pairs <= MOST_FOLDERS:
        edges.write.partitionBy("src_label", "dst_label").parquet(f"{path}/edges")
    else:
        edges.write.parquet(f"{path}/edges")


def read(spark: SparkSession, path: str) -> PropertyGraph:
    columns = lambda df, names: df.select(*[F.col(c).cast(t) for c, t in names])
    edges = spark.read.parquet(f"{path}/edges")
    return PropertyGraph(
        columns(spark.read.parquet(f"{path}/vertices"), [("id", "long"), ("label", "string")]),
        columns(edges, [("src", "long"), ("dst", "long"), ("src_label", "string"), ("dst_label", "string")]),
    )
