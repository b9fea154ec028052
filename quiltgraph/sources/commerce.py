"""The graph of the commerce tables, in DataFrames and in SQL.

Vertex ids are kind * 100000000 + key.  A row of an edge table links both ends
once; only what comes from order lines can repeat and is made distinct.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Pattern, PropertyGraph

KIND = 100_000_000
REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER = range(6)


def _id(kind: int, key: str):
    return (F.lit(kind * KIND) + F.col(key).cast("long")).alias("id")


def graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lines, orders, parts = t("lineitem"), t("orders"), t("part")
    order_label, part_label = F.concat(F.lit("order:"), "o_orderstatus"), F.concat(F.lit("part:"), "p_type")
    customer_label = F.concat(F.lit("cust:"), "c_mktsegment")
    vertices = [
        t("region").select(_id(REGION, "r_regionkey"), F.lit("region").alias("label")),
        t("nation").select(_id(NATION, "n_nationkey"), F.lit("nation").alias("label")),
        t("customer").select(_id(CUSTOMER, "c_custkey"), customer_label.alias("label")),
        t("supplier").select(_id(SUPPLIER, "s_suppkey"), F.lit("supplier").alias("label")),
        parts.select(_id(PART, "p_partkey"), part_label.alias("label")),
        orders.select(_id(ORDER, "o_orderkey"), order_label.alias("label")),
    ]

    def edge(df: DataFrame, a: tuple, b: tuple) -> DataFrame:
        return df.select(_id(*a[:2]).alias("src"), _id(*b[:2]).alias("dst"), a[2].alias("src_label"), b[2].alias("dst_label"))

    region, nation, supplier = F.lit("region"), F.lit("nation"), F.lit("supplier")
    of_order = lines.select("l_orderkey", "l_partkey", "l_suppkey")
    customers = t("customer")
    once = [
        edge(t("nation"), (NATION, "n_nationkey", nation), (REGION, "n_regionkey", region)),
        edge(customers, (CUSTOMER, "c_custkey", customer_label), (NATION, "c_nationkey", nation)),
        edge(t("supplier"), (SUPPLIER, "s_suppkey", supplier), (NATION, "s_nationkey", nation)),
        edge(orders.join(customers, orders["o_custkey"] == customers["c_custkey"]), (ORDER, "o_orderkey", order_label), (CUSTOMER, "o_custkey", customer_label)),
    ]
    joined_orders = lambda df: df.join(orders, df["l_orderkey"] == orders["o_orderkey"])
    joined_parts = lambda df: df.join(parts, df["l_partkey"] == parts["p_partkey"])
    # distinct comes last: a filter on labels passes it and leaves little to be made distinct
    several = [
        edge(joined_parts(joined_orders(of_order)), (ORDER, "l_orderkey", order_label), (PART, "l_partkey", part_label)).distinct(),
        edge(joined_orders(of_order), (ORDER, "l_orderkey", order_label), (SUPPLIER, "l_suppkey", supplier)).distinct(),
        edge(joined_parts(of_order), (PART, "l_partkey", part_label), (SUPPLIER, "l_suppkey", supplier)).distinct(),
    ]
    union = lambda tables: reduce(DataFrame.union, tables)
    kinds = [("nation", "region"), ("cust:", "nation"), ("supplier", "nation"), ("order:", "cust:"), ("order:", "part:"), ("order:", "supplier"), ("part:", "supplier")]
    forward = [*once, *several]
    back = [e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("dst_label").alias("src_label"), F.col("src_label").alias("dst_label")) for e in forward]
    branches = [(x, y, e) for (x, y), e in zip(kinds, forward)] + [(y, x, e) for (x, y), e in zip(kinds, back)]
    sources = (t("nation"), customers, t("supplier"), orders, lines, lines, lines)
    return PropertyGraph(union(vertices), union([*forward, *back]), tuple(branches), (*sources, *sources))


#: The same graph as common table expressions v(id, label) and e(src, dst).
SQL = f"""v(id, label) AS (
  SELECT {REGION * KIND} + CAST(r_regionkey AS BIGINT), 'region' FROM region
  UNION ALL SELECT {NATION * KIND} + CAST(n_nationkey AS BIGINT), 'nation' FROM nation
  UNION ALL SELECT {CUSTOMER * KIND} + c_custkey, 'cust:' || c_mktsegment FROM customer
  UNION ALL SELECT {SUPPLIER * KIND} + s_suppkey, 'supplier' FROM supplier
  UNION ALL SELECT {PART * KIND} + p_partkey, 'part:' || p_type FROM part
  UNION ALL SELECT {ORDER * KIND} + o_orderkey, 'order:' || o_orderstatus FROM orders),
half(src, dst) AS (
  SELECT {NATION * KIND} + CAST(n_nationkey AS BIGINT), {REGION * KIND} + CAST(n_regionkey AS BIGINT) FROM nation
  UNION SELECT {CUSTOMER * KIND} + c_custkey, {NATION * KIND} + CAST(c_nationkey AS BIGINT) FROM customer
  UNION SELECT {SUPPLIER * KIND} + s_suppkey, {NATION * KIND} + CAST(s_nationkey AS BIGINT) FROM supplier
  UNION SELECT {ORDER * KIND} + o_orderkey, {CUSTOMER * KIND} + o_custkey FROM orders
  UNION SELECT {ORDER * KIND} + l_orderkey, {PART * KIND} + l_partkey FROM lineitem
  UNION SELECT {ORDER * KIND} + l_orderkey, {SUPPLIER * KIND} + l_suppkey FROM lineitem
  UNION SELECT {PART * KIND} + l_partkey, {SUPPLIER * KIND} + l_suppkey FROM lineitem),
e(src, dst, src_label, dst_label) AS MATERIALIZED (
  SELECT h.src, h.dst, a.label, b.label FROM (SELECT src, dst FROM half UNION ALL SELECT dst, src FROM half) h
  JOIN v a ON a.id = h.src JOIN v b ON b.id = h.dst)"""

O, P, S, C, M, N, R = "order:F", "part:ECONOMY", "supplier", "cust:BUILDING", "cust:MACHINERY", "nation", "region"


def _pattern(labels: list[str], edges: str) -> Pattern:
    return Pattern(labels, [(int(e[0]), int(e[1])) for e in edges.split()])


PATTERNS = {
    "p01": _pattern([O, C], "01"),
    "p02": _pattern([N, S, P], "01 12"),
    "p03": _pattern([C, O, O], "01 02"),
    "p04": _pattern([O, P, S], "01 02 12"),
    "p05": _pattern([C, O, S, N], "01 12 23 30"),
    "p06": _pattern([O, P, S, O], "01 02 12 31 32"),
    "p07": _pattern([O, P, S, C], "01 02 12 03"),
    "p08": _pattern([O, P, S, C, N], "01 02 12 03 34 24"),
    "p09": _pattern([R, N, C, M], "01 12 13"),
    "p10": _pattern([C, O, O, O], "01 02 03"),
    "p11": _pattern([O, P, P, S], "01 02 03 13 23"),
    "p12": _pattern([R, C], "01"),
}
