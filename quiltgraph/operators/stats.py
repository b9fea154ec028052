"""Statistics and indexes of a graph, its changes, and analytics on the whole graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Pattern, PropertyGraph
from ..scratch import stored, unstored


def vertices_by_label(graph: PropertyGraph, label: str) -> DataFrame:
    return graph.vertices.where(F.col("label") == label)


def label_frequency(graph: PropertyGraph) -> DataFrame:
    return graph.vertices.groupBy("label").agg(F.count("*").alias("n"))


def degrees(graph: PropertyGraph) -> DataFrame:
    """id, label, degree; vertices without an edge have 0."""
    found = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return graph.vertices.join(found, "id", "left").select("id", "label", F.coalesce("degree", F.lit(0)).alias("degree"))


def max_degree(graph: PropertyGraph) -> DataFrame:
    return graph.edges.groupBy("src").agg(F.count("*").alias("degree")).agg(F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"))


def label_pairs(graph: PropertyGraph) -> DataFrame:
    """Directed edges of each label pair."""
    return graph.edges.groupBy("src_label", "dst_label").agg(F.count("*").alias("n"))


def relation_report(graph: PropertyGraph, pattern: Pattern) -> DataFrame:
    """u, v, n: the cardinality of the relation of each pattern edge."""
    counts = graph.pair_counts((pattern.labels[u], pattern.labels[v]) for u, v in pattern.edges)
    rows = [(u, v, counts[pattern.labels[u], pattern.labels[v]]) for u, v in pattern.edges]
    return graph.vertices.sparkSession.createDataFrame(rows, "u int, v int, n long")


def nlf_rows(graph: PropertyGraph) -> DataFrame:
    """id, neighbour_label, n."""
    return graph.edges.groupBy(F.col("src").alias("id"), F.col("dst_label").alias("neighbour_label")).agg(F.count("*").alias("n"))


def nlf(graph: PropertyGraph) -> DataFrame:
    """id and a map from neighbour label to count; as many entries as labels at most."""
    return nlf_rows(graph).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("neighbour_label", "n"))).alias("nlf"))


#: Ids of one block of an adjacency: an array holds at most 2 ** BLOCK_BITS of them.
BLOCK_BITS = 16


def adjacency(edges: DataFrame, by: str = "src", of: str = "dst") -> DataFrame:
    """by, block and neighbours: the sorted array of its ``of`` within one block of ids, so that no array is as long as a hub has neighbours."""
    return edges.groupBy(by, F.shiftright(of, BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_list(of)).alias("neighbours"))


def metadata(graph: PropertyGraph) -> DataFrame:
    """One row: vertices, edges, labels, the largest label frequency and degree, and bytes of ids."""
    v = label_frequency(graph).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("vertices"), F.count("*").alias("labels"), F.coalesce(F.max("n"), F.lit(0)).alias("max_label_frequency"))
    e = graph.edges.groupBy("src").agg(F.count("*").alias("d")).agg((F.coalesce(F.sum("d"), F.lit(0)) / 2).cast("long").alias("edges"), F.coalesce(F.max("d"), F.lit(0)).alias("max_degree"))
    # both tables are one row
    return v.join(F.broadcast(e), F.lit(True)).withColumn("memory_bytes", F.col("vertices") * 8 + F.col("edges") * 2 * 16)


def edges_exist(graph: PropertyGraph, pairs: DataFrame) -> DataFrame:
    """The rows of pairs(src, dst) that are edges."""
    return pairs.join(graph.edges.select("src", "dst"), ["src", "dst"], "left_semi")


def insert_edges(graph: PropertyGraph, delta: DataFrame) -> PropertyGraph:
    """The graph with the edges delta(src, dst) too; ends must be known, what exists stays once."""
    return PropertyGraph(graph.vertices, graph.edges.unionByName(PropertyGraph.undirected(graph.vertices, delta).edges).distinct())


def delete_edges(graph: PropertyGraph, delta: DataFrame) -> PropertyGraph:
    both = delta.select("src", "dst").union(delta.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return PropertyGraph(graph.vertices, graph.edges.join(both, ["src", "dst"], "left_anti"))


def _oriented(edges: DataFrame) -> DataFrame:
    """Stored: each edge once, from the end of lower degree (then id), so that no vertex keeps many edges out."""
    d = edges.groupBy("src").agg(F.count("*").alias("d"))
    both = edges.select("src", "dst").join(d.withColumnRenamed("d", "ds"), "src").join(d.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst")
    return stored(both.where("ds < dd or (ds = dd and src < dst)").select("src", "dst"))


def triangles(edges: DataFrame) -> DataFrame:
    """a, b, c: every triangle once."""
    return _triangles(_oriented(edges))


def _triangles(out: DataFrame) -> DataFrame:
    one, two, three = out.select(F.col("src").alias("a"), F.col("dst").alias("b")), out.select(F.col("src").alias("b"), F.col("dst").alias("c")), out.select(F.col("src").alias("a"), F.col("dst").alias("c"))
    return one.join(two, "b").join(three, ["a", "c"]).select("a", "b", "c")


def _sides(triangles: DataFrame, *keep: str) -> DataFrame:
    """src < dst of the three edges of each triangle, with its columns to keep."""
    ends = F.explode(F.array(*[F.struct(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst")) for x, y in (("a", "b"), ("b", "c"), ("a", "c"))]))
    return triangles.select(*keep, ends.alias("e")).select(*keep, "e.src", "e.dst")


def triangle_support(edges: DataFrame) -> DataFrame:
    """src < dst and the number of triangles on each edge that has some."""
    return _sides(triangles(edges)).groupBy("src", "dst").agg(F.count("*").alias("triangles"))


def four_cliques(edges: DataFrame) -> DataFrame:
    """a, b, c, d: every 4-clique once."""
    out = _oriented(edges)
    # the fourth vertex comes after the triangle in the orientation of all three
    to = lambda x: out.select(F.col("src").alias(x), F.col("dst").alias("d"))
    return _triangles(out).join(to("c"), "c").join(to("a"), ["a", "d"], "left_semi").join(to("b"), ["b", "d"], "left_semi").select("a", "b", "c", "d")


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """The edges(src, dst) of the k-core, in both directions: vertices of fewer than k are taken away until none is left.

    A round takes from the degrees what the vertices lose that go in it, so
    only their edges are shuffled.
    """
    left = stored(edges.select("src", "dst"))
    degree = stored(left.groupBy("src").agg(F.count("*").alias("d")))
    while True:
        weak = stored(degree.where(F.col("d") < k).select("src"))
        if weak.isEmpty():
            unstored(weak)
            break
        lost = left.join(weak, "src", "left_semi").groupBy(F.col("dst").alias("src")).agg(F.count("*").alias("lost"))
        step = stored(degree.where(F.col("d") >= k).join(lost, "src", "left").select("src", (F.col("d") - F.coalesce("lost", F.lit(0))).alias("d")))
        unstored(degree)
        unstored(weak)
        degree = step
    stay = degree.select("src")
    return left.join(stay, "src", "left_semi").join(stay.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst")


def k_truss(edges: DataFrame, k: int) -> DataFrame:
    """src < dst of the edges that keep at least k triangles among themselves.

    Triangles are found once.  A round takes away those on a weak edge, and
    from the support of their other edges.
    """
    three = stored(triangles(edges))
    support = stored(_sides(three).groupBy("src", "dst").agg(F.count("*").alias("n")))
    while True:
        weak = stored(support.where(F.col("n") < k).select("src", "dst"))
        if weak.isEmpty():
            for table in (weak, three):
                unstored(table)
            return support.select("src", "dst") if k > 0 else edges.where("src < dst").select("src", "dst")
        gone = stored(_sides(three, "a", "b", "c").join(weak, ["src", "dst"], "left_semi").select("a", "b", "c").distinct())
        lost = _sides(gone).groupBy("src", "dst").agg(F.count("*").alias("lost"))
        step = stored(support.where(F.col("n") >= k).join(lost, ["src", "dst"], "left").select("src", "dst", (F.col("n") - F.coalesce("lost", F.lit(0))).alias("n")))
        rest = stored(three.join(gone, ["a", "b", "c"], "left_anti"))
        for table in (support, weak, gone, three):
            unstored(table)
        support, three = step, rest
