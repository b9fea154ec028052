"""Largest inner products by few stable projections and a kd-tree.

With M the largest norm, x -> (x, sqrt(M^2 - |x|^2)) and q -> (q, 0) turn the
largest inner product into the least distance.  Gaussian (2-stable)
projections to DIMENSIONS numbers follow: a point at distance d lies at a
projected distance whose square over d^2 is chi-square distributed.  Once the
next projected neighbours are so far that a point as near as the k-th best
found would lie nearer with probability SURE, the search stops.

A kd-tree over a bounded sample's projections deals all vectors into cells.
Each query first searches the cells nearest to it, which bounds its k-th
distance, and then every further cell that the stopping test doesn't rule
out; within a cell the leaves are visited from the nearest on.  Vectors are
copied once for each block of queries that asks their cell, and not at all
where none does.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, get, sent, session, stored

DIMENSIONS, SURE, SEED = 12, 0.95, 11
#: Vectors the tree is built from, at most; vectors a cell should hold; vectors and queries searched together, at most about; vectors of a leaf.
SAMPLE, CELL, PART, QUERIES, LEAF = 20_000, 2048, 8192, 4096, 128
#: Cells that a query searches to bound its k-th distance.
FIRST = 2


def chi_square_quantile(freedom: int, p: float) -> float:
    """For an even number of degrees of freedom, by bisection of the closed form."""
    half = freedom // 2

    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, half):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


class Tree:
    """Splits of the projected space: node i has children 2i+1 and 2i+2; the last level are cells."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, self.axis, self.at = depth, np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        groups = {0: points}
        for i in range((1 << depth) - 1):
            p = groups.pop(i)
            if len(p):
                self.axis[i] = int((p.max(0) - p.min(0)).argmax())
                self.at[i] = float(np.median(p[:, self.axis[i]]))
            left = p[:, self.axis[i]] <= self.at[i]
            groups[2 * i + 1], groups[2 * i + 2] = p[left], p[~left]

    def cell(self, points: np.ndarray) -> np.ndarray:
        i = np.zeros(len(points), np.int64)
        rows = np.arange(len(points))
        for _ in range(self.depth):
            i = 2 * i + 1 + (points[rows, self.axis[i]] > self.at[i])
        return i - ((1 << self.depth) - 1)

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point to each cell's box, which the splits bound."""
        low = np.full((1, points.shape[1]), -np.inf)
        high = -low
        for level in range(self.depth):
            first = (1 << level) - 1
            axis, at = self.axis[first : 2 * first + 1], self.at[first : 2 * first + 1]
            low, high = np.repeat(low, 2, 0), np.repeat(high, 2, 0)
            n = np.arange(len(axis))
            high[2 * n, axis] = np.minimum(high[2 * n, axis], at)
            low[2 * n + 1, axis] = np.maximum(low[2 * n + 1, axis], at)
        out = np.zeros((len(points), len(low)))
        for d in range(points.shape[1]):
            x = points[:, d : d + 1]
            gap = np.maximum(0, np.maximum(low[None, :, d] - x, x - high[None, :, d]))
            out += gap * gap
        return out


def leaves(points: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The rows in kd-tree leaves, split at the median of the widest axis."""
    if len(rows) <= LEAF:
        return [rows]
    p = points[rows]
    axis = int((p.max(0) - p.min(0)).argmax())
    order = np.argsort(p[:, axis], kind="stable")
    half = len(rows) // 2
    return leaves(points, rows[order[:half]]) + leaves(points, rows[order[half:]])


class Frame:
    """What every task needs to know: norm, projection, tree, k."""

    def __init__(self, largest: float, size: int, k: int):
        self.largest, self.k = largest, k
        self.matrix = np.random.default_rng(SEED).standard_normal((size + 1, DIMENSIONS))
        self.reach = chi_square_quantile(DIMENSIONS, SURE)
        self.tree: Tree | None = None

    def data(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.largest**2 - (x * x).sum(1)))
        return x @ self.matrix[:-1] + rest[:, None] * self.matrix[-1]

    def query(self, q: np.ndarray) -> np.ndarray:
        return q @ self.matrix[:-1]

    def radius(self, q: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Squared projected distance beyond which the test stops, given the k-th best product."""
        d = (q * q).sum(1) + self.largest**2 - 2 * kth
        return np.where(np.isfinite(kth), np.maximum(d, 0) * self.reach * (1 + 1e-9) + 1e-12, np.inf)

    def search(self, ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, kth: np.ndarray) -> tuple[list, list, list]:
        """The best k of x for every query, among products of at least kth; a query's own row is none."""
        points, asked = self.data(x), self.query(q)
        parts = leaves(points, np.lexsort((ids,)))
        boxes = [(points[r].min(0), points[r].max(0)) for r in parts]
        near = np.stack([(np.maximum(0, np.maximum(lo - asked, asked - hi)) ** 2).sum(1) for lo, hi in boxes], 1)
        best: list[list[tuple[float, int]]] = [[] for _ in qids]
        bound = kth.copy()
        limit = self.radius(q, bound)
        worst, long = np.full(len(qids), np.iinfo(np.int64).max), np.sqrt((q * q).sum(1))
        # step s takes each query to its s-th nearest leaf; queries at the same leaf go together
        order = np.argsort(near, axis=1, kind="stable")
        for step in range(len(parts)):
            leaf = order[:, step]
            alive = near[np.arange(len(qids)), leaf] <= limit
            if not alive.any():
                break
            for number in np.unique(leaf[alive]):
                some, rows = np.flatnonzero(alive & (leaf == number)), parts[number]
                # products of whole matrices are rounded differently from place to place: what they leave is summed pair by pair
                slack = 1e-12 * x.shape[1] * long[some] * self.largest
                good = (q[some] @ x[rows].T >= (bound[some] - slack)[:, None]) & (ids[rows][None, :] != qids[some][:, None])
                for at in np.flatnonzero(good.any(1)):
                    i, hit = some[at], rows[good[at]]
                    products = (x[hit] * q[i]).sum(1)
                    true = (products > bound[i]) | ((products == bound[i]) & (ids[hit] < worst[i]))
                    if not true.any():
                        continue
                    found = sorted([*best[i], *zip((-products[true]).tolist(), ids[hit[true]].tolist())])[: self.k]
                    best[i] = found
                    if len(found) == self.k:
                        bound[i], worst[i] = -found[-1][0], found[-1][1]
                        limit[i] = self.radius(q[i : i + 1], bound[i : i + 1])[0]
        out: tuple[list, list, list] = ([], [], [])
        for i, found in zip(qids.tolist(), best):
            for minus, v in found:
                out[0].append(i)
                out[1].append(v)
                out[2].append(-minus)
        return out


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """vec_id and v of rows that take part: an id, and finite numbers that aren't all 0."""
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    return rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each row whose id is divisible by ``every``.

    Candidates are all other ids whose vectors have the query's length; each
    length that occurs is searched by itself.  Vectors that are null, zero or
    hold null or non-finite components take no part, nor do rows without an
    id.  Ties go to the smaller id.  Of a query id that is repeated the least
    vector (the shortest, then by its numbers) is searched with; as a candidate
    an id counts once for each different vector it has.  Repeated rows count
    once, other columns are ignored, and an empty table has no rows.
    """
    session(vectors)
    rows = usable(vectors, id, vector).withColumn("size", F.size("v"))
    sizes = sorted((r["size"], r["n"]) for r in rows.groupBy("size").agg(F.count("*").alias("n")).collect())
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min(F.struct("size", "v")).alias("least")).select("vec_id", "least.*")
    found = [_searched(rows.where(F.col("size") == size), queries.where(F.col("size") == size), size, n, k) for size, n in sizes]
    return reduce(DataFrame.union, found)


def _searched(rows: DataFrame, queries: DataFrame, size: int, n: int, k: int) -> DataFrame:
    """The result of nearest() for rows(vec_id, v) of one length, about n of them, and queries(vec_id, v)."""
    rows = stored(rows.select("vec_id", "v").dropDuplicates())
    largest = rows.agg(F.max(F.expr("aggregate(v, 0D, (s, x) -> s + x * x)"))).first()[0]
    frame = Frame(math.sqrt(largest), size, k)
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()])
    depth = max(0, min(math.ceil(math.log2(max(1, n / CELL))), int(math.log2(max(1, len(sample) / 8)))))
    frame.tree = Tree(frame.data(sample), depth)
    held = sent(rows.sparkSession, frame)

    def placed():
        f = get(held)
        return lambda c: [f.tree.cell(f.data(np.array(c["v"]).reshape(-1, size))).astype(np.int32).tolist()]

    cells = stored(arrow_map(rows, placed, "cell int", ("vec_id", "v")))
    asked = stored(queries.select("vec_id", "v"))
    # there are at most SAMPLE / 8 cells, so tables of cells are small
    parts = F.broadcast(cells.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))

    def routed(kth: DataFrame | None) -> DataFrame:
        """The queries with the cells they are to search."""
        source = asked.withColumn("kth", F.lit(-math.inf)) if kth is None else asked.join(kth, "vec_id", "left").withColumn("kth", F.coalesce("kth", F.lit(-math.inf)))
        rest = kth is not None

        def make():
            f = get(held)

            def step(c):
                q, bound = np.array(c["v"]).reshape(-1, size), np.array(c["kth"], float)
                p = f.query(q)
                d = f.tree.distances(p)
                order = np.argsort(d, axis=1, kind="stable")
                if not rest:
                    return [[o[:FIRST].tolist() for o in order]]
                limit = f.radius(q, bound)
                return [[[int(cell) for cell in o[FIRST:] if row[cell] <= most] for o, row, most in zip(order, d, limit)]]

            return step

        return stored(arrow_map(source, make, "cells array<int>", ("vec_id", "v", "kth")))

    def found(asking: DataFrame) -> DataFrame:
        """Products found in the cells that asking(vec_id, v, kth, cells) names: a cell of many vectors is dealt into parts, and its queries into blocks."""

        def group(left: pa.Table, right: pa.Table) -> pa.Table:
            a, b, c = [], [], []
            if left.num_rows and right.num_rows:
                matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                a, b, c = get(held).search(left.column("vec_id").to_numpy(), matrix(left), right.column("vec_id").to_numpy(), matrix(right), right.column("kth").to_numpy())
            return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

        each = asking.withColumn("cell", F.explode("cells")).drop("cells")
        load = F.broadcast(each.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks")).join(parts, "cell"))
        keys = ["cell", "part", "block"]
        one = cells.join(load, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        two = each.join(load, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return one.select(*keys, "vec_id", "v").groupBy(*keys).cogroup(two.select(*keys, "vec_id", "v", "kth").groupBy(*keys)).applyInArrow(group, "query_id bigint, vec_id bigint, score double")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = stored(found(routed(None)))
    ranked = first.withColumn("rank", F.row_number().over(best))
    kth = stored(ranked.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth")))
    out = first.union(found(routed(kth))).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
