"""A view on disk.

A folder holds meta.json and one folder of Parquet tables for each version; a
version counts once meta.json names it, so a lost job leaves the old one.

sn_<i>: the rows of part i, a column q<v> for each of its vertices.
se_<i>_<j>: distinct pairs of port keys of two linked parts.
ecand (qu, qv, du, dv) and vcand (qv, v): the candidate space.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Pattern, column
from ..plans.partition import ports
from ..scratch import children, exists, read_text, remove, write_text

BUILT, NO_ANSWER, TIMEOUT, OVERSIZED = "built", "no_answer", "timeout", "oversized"


def q(v: int) -> str:
    return f"q{v}"


@dataclass
class View:
    """A stored view: its meta data at once, its tables lazily."""

    spark: SparkSession
    path: str
    pattern: Pattern
    parts: list[list[int]]
    links: list[tuple[int, int]]
    partial: list[tuple[int, int]]  # linked parts whose pairs were too many to store
    status: str
    version: int
    stats: dict = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.version}/{name}")

    def rows(self, i: int) -> DataFrame:
        return self.table(f"sn_{i}")

    def pairs(self, i: int, j: int) -> DataFrame:
        return self.table(f"se_{min(i, j)}_{max(i, j)}")

    def ports(self, i: int, j: int) -> list[int]:
        return ports(self.pattern, self.parts[i], self.parts[j])

    def relations(self) -> dict[tuple[int, int], DataFrame]:
        """The candidate edges of each pattern edge, as a catalog."""
        all_edges = self.table("ecand")
        return {(u, v): all_edges.where((F.col("qu") == u) & (F.col("qv") == v)).select(F.col("du").alias(column(u)), F.col("dv").alias(column(v))) for u, v in self.pattern.edges}

    def counts(self) -> tuple[dict[int, int], dict[tuple[int, int], int]]:
        """Candidates of each vertex and candidate edges of each pattern edge; a row each reaches the driver."""
        vertices = self.table("vcand").groupBy(F.lit(-1).alias("u"), F.col("qv").alias("v")).count()
        rows = self.table("ecand").groupBy(F.col("qu").alias("u"), F.col("qv").alias("v")).count().union(vertices).collect()
        found = {(r["u"], r["v"]): r["count"] for r in rows}
        return {v: found.get((-1, v), 0) for v in range(len(self.pattern))}, {e: found.get(e, 0) for e in self.pattern.edges}

    @cached_property
    def linked(self) -> dict[tuple[int, int], bool]:
        """Pairs of adjacent parts, and whether their key pairs are stored."""
        return {p: p not in self.partial for p in self.links}


def write_version(spark: SparkSession, path: str, version: int, tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if name == "ecand":
            writer = writer.partitionBy("qu", "qv")
        elif name == "vcand":
            writer = writer.partitionBy("qv")
        writer.parquet(f"{path}/v{version}/{name}")


def save(view: View) -> View:
    """Makes the version count, and takes older ones away."""
    meta = {"labels": view.pattern.labels, "edges": view.pattern.edges, "parts": view.parts, "links": view.links, "partial": view.partial, "status": view.status, "version": view.version, "stats": view.stats}
    write_text(view.spark, f"{view.path}/meta.json", json.dumps(meta))
    for name in children(view.spark, view.path):
        if name.startswith("v") and name[1:].isdigit() and int(name[1:]) < view.version:
            remove(view.spark, f"{view.path}/{name}")
    return view


def load(spark: SparkSession, path: str) -> View:
    m = json.loads(read_text(spark, f"{path}/meta.json"))
    pairs = lambda x: [tuple(p) for p in x]
    return View(spark, path, Pattern(m["labels"], pairs(m["edges"])), m["parts"], pairs(m["links"]), pairs(m["partial"]), m["status"], m["version"], m["stats"])


def store_names(spark: SparkSession, folder: str) -> list[str]:
    """The views below a folder, in the order of their names; those without meta.json don't count."""
    return [n for n in children(spark, folder) if exists(spark, f"{folder}/{n}/meta.json")]


def load_all(spark: SparkSession, folder: str) -> list[View]:
    return [load(spark, f"{folder}/{n}") for n in store_names(spark, folder)]


def memory(view: View) -> dict[str, int]:
    """Bytes of ids in each table, from row counts."""
    if view.status != BUILT:
        return {}
    out = {f"sn_{i}": view.rows(i).count() * 8 * len(part) for i, part in enumerate(view.parts)}
    out |= {f"se_{i}_{j}": view.pairs(i, j).count() * 8 * (len(view.ports(i, j)) + len(view.ports(j, i))) for (i, j), whole in view.linked.items() if whole}
    return out | {"ecand": view.table("ecand").count() * 16, "vcand": view.table("vcand").count() * 8}


def link_report(view: View) -> DataFrame:
    """For each stored link between parts i and j: its key pairs, the distinct keys on either side, and the most partners that one key has."""
    found = []
    for (i, j), whole in sorted(view.linked.items()):
        if not whole:
            continue
        pairs, mine, theirs = view.pairs(i, j), [q(v) for v in view.ports(i, j)], [q(v) for v in view.ports(j, i)]
        side = lambda keys, x: pairs.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum("n").alias("pairs"), F.count("*").alias(f"keys_{x}"), F.max("n").alias(f"most_{x}"))  # noqa: B023, E731
        one, two = side(mine, "i"), side(theirs, "j").drop("pairs")
        # both are one row
        found.append(one.join(F.broadcast(two), F.lit(True)).select(F.lit(i).alias("i"), F.lit(j).alias("j"), "pairs", "keys_i", "keys_j", "most_i", "most_j"))
    if not found:
        return view.spark.createDataFrame([], "i int, j int, pairs long, keys_i long, keys_j long, most_i long, most_j long")
    return reduce(DataFrame.union, found)
