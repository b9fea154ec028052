"""Text formats of graphs.

``t nV nE`` / ``v id label degree`` / ``e src dst`` is the format with a
header; without meta there is neither header nor degree, and edges carry a
label that is dropped.  Fields are separated by anything but letters, digits
and the characters that labels may hold.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Pattern, PropertyGraph
from ..scratch import stored

FIELD = re.compile(r"[^\s,;]+")


def parse_graph(text: str) -> tuple[dict[int, str], list[tuple[int, int]]]:
    """Labels by id and edges of a small graph; the declared sizes and degrees are checked."""
    labels: dict[int, str] = {}
    degrees: dict[int, int] = {}
    edges: list[tuple[int, int]] = []
    sizes = None
    for line in text.splitlines():
        f = FIELD.findall(line)
        if not f:
            continue
        if f[0] == "t":
            sizes = int(f[1]), int(f[2])
        elif f[0] == "v":
            labels[int(f[1])] = f[2]
            if len(f) > 3:
                degrees[int(f[1])] = int(f[3])
        elif f[0] == "e":
            edges.append((int(f[1]), int(f[2])))
    if sizes and sizes != (len(labels), len(edges)):
        raise ValueError(f"the header says {sizes}, the file has {(len(labels), len(edges))}")
    if sorted(labels) != list(range(len(labels))):
        raise ValueError("vertex ids are not 0 to n - 1")
    found = dict.fromkeys(labels, 0)
    for e in {(min(e), max(e)) for e in edges if e[0] != e[1]}:
        for v in e:
            found[v] += 1
    wrong = [v for v, d in degrees.items() if found[v] != d]
    if wrong:
        raise ValueError(f"declared degrees differ at {wrong[:5]}")
    return labels, edges


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), r"[\s,;]+").alias("f"))


def read_graph(spark: SparkSession, path: str) -> PropertyGraph:
    """A graph of any size from the format with or without meta; loops go and repeated edges count once."""
    f = _fields(spark, path)
    vertices = f.where("f[0] = 'v'").select(F.expr("cast(f[1] as bigint)").alias("id"), F.expr("f[2]").alias("label")).dropDuplicates(["id"])
    edges = f.where("f[0] = 'e'").selectExpr("cast(f[1] as bigint) as src", "cast(f[2] as bigint) as dst")
    return PropertyGraph.undirected(vertices, edges)


def wrong_degrees(spark: SparkSession, path: str) -> DataFrame:
    """id, declared, found of vertices whose declared degree differs."""
    graph = read_graph(spark, path)
    declared = _fields(spark, path).where("f[0] = 'v' and size(f) > 3").selectExpr("cast(f[1] as bigint) as id", "cast(f[3] as bigint) as declared")
    found = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("found"))
    return declared.join(found, "id", "left").select("id", "declared", F.coalesce("found", F.lit(0)).alias("found")).where("declared <> found")


def from_tuples(spark: SparkSession, vertices: list[tuple[int, str]], edges: list[tuple[int, int]]) -> PropertyGraph:
    v = spark.createDataFrame([(int(i), str(label)) for i, label in vertices], "id long, label string")
    return PropertyGraph.undirected(v, spark.createDataFrame([(int(a), int(b)) for a, b in edges], "src long, dst long"))


def to_tuples(graph: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """vertices(id, label) and edges(src, dst) with src < dst."""
    return graph.vertices.select("id", "label"), graph.edges.where("src < dst").select("src", "dst")


def write_graph(graph: PropertyGraph, path: str) -> None:
    """The format with meta as a folder of text files; only the header is computed ahead."""
    v, e = to_tuples(graph)
    degree = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    spark = v.sparkSession
    head = spark.createDataFrame([(f"t {v.count()} {e.count()}",)], "value string")
    lines = v.join(degree, "id", "left").select(F.concat_ws(" ", F.lit("v"), "id", "label", F.coalesce("degree", F.lit(0))).alias("value"))
    head.union(lines).union(e.select(F.concat_ws(" ", F.lit("e"), "src", "dst").alias("value"))).write.text(path)


def write_gr(graph: PropertyGraph, path: str) -> None:
    """Treewidth contest format: header ``p tw nV nE``, then 1-based edges; ids must be 0 to n - 1."""
    v, e = to_tuples(graph)
    head = v.sparkSession.createDataFrame([(f"p tw {v.count()} {e.count()}",)], "value string")
    head.union(e.select(F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1).alias("value"))).write.text(path)


def dot(pattern: Pattern) -> str:
    lines = [f'  {i} [label="{i}: {label}"];' for i, label in enumerate(pattern.labels)]
    return "\n".join(["graph {", *lines, *(f"  {u} -- {v};" for u, v in pattern.edges), "}"]) + "\n"


def parse_answers(text: str) -> dict[str, int]:
    """Golden answers, ``name:count`` a line."""
    return {name.strip(): int(n) for name, n in (line.rsplit(":", 1) for line in text.splitlines() if ":" in line)}


def parse_mapping(text: str) -> dict[int, int]:
    """``query_vertex view_vertex`` a line."""
    return {int(a): int(b) for a, b in (FIELD.findall(line)[:2] for line in text.splitlines() if line.strip())}


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of a plain edge list; lines that start with # or % are comments."""
    f = spark.read.text(path).where(~F.col("value").rlike(r"^\s*([#%]|$)")).select(F.split(F.trim("value"), r"[\s,;]+").alias("f"))
    return f.selectExpr("cast(f[0] as bigint) as src", "cast(f[1] as bigint) as dst")


def write_edge_list(edges: DataFrame, path: str) -> None:
    """src and dst, a blank between them, in a folder of text files."""
    edges.select(F.concat_ws(" ", "src", "dst").alias("value")).write.text(path)


def renumbered(graph: PropertyGraph, by: str = "degree") -> tuple[PropertyGraph, DataFrame]:
    """The graph with ids 0 to n - 1, by rising degree or by label, then by the old id; and the table old, id.

    Ids are dealt in ranges of the order: each range is numbered by itself,
    from the number of vertices in the ranges before it.
    """
    degree = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    keys = {"degree": ["degree", "id"], "label": ["label", "id"]}[by]
    rows = graph.vertices.join(degree, "id", "left").select("id", "label", F.coalesce("degree", F.lit(0)).alias("degree"))
    placed = stored(rows.repartitionByRange(*keys).withColumn("range", F.spark_partition_id()))
    sizes = placed.groupBy("range").agg(F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.broadcast(sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")))
    own = F.row_number().over(Window.partitionBy("range").orderBy(*keys))
    table = stored(placed.withColumn("own", own).join(ahead, "range").select(F.col("id").alias("old"), (F.col("ahead") + F.col("own") - 1).alias("id"), "label"))
    end = lambda x: table.select(F.col("old").alias(x), F.col("id").alias(f"new_{x}"))
    edges = graph.edges.join(end("src"), "src").join(end("dst"), "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "src_label", "dst_label")
    return PropertyGraph(table.select("id", "label"), edges), table.select("old", "id")
