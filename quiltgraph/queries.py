"""The queries of the driver contract for graph operators, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import covers, no_repeat
from .model import Pattern, PropertyGraph, column
from .operators import estimate, joins, match, relations, stats
from .plans import sqlgen
from .scratch import folder, stored
from .sources import commerce, layout, text
from .sources.commerce import M, N, O, P, PATTERNS, R, S, C
from .views import answer, build, maintain, store

Query = Callable[[SparkSession, str], DataFrame]
PATH_OPS = Pattern([O, P, S], [(0, 1), (1, 2)])
EDGE_OP = Pattern([O, P], [(0, 1)])
PATH_SNC = Pattern([S, N, C], [(0, 1), (1, 2)])

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def with_graph(sql: str) -> str:
    """More common table expressions may lead the text, after a comma."""
    return f"WITH {commerce.SQL}{'' if sql.startswith(',') else ' '}{sql}"


def query(sql: str | None):
    """Registers a function of (graph) or (graph, spark, sf_dir) under its name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            graph = commerce.graph(spark, sf_dir)
            return f(graph) if f.__code__.co_argcount == 1 else f(graph, spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = with_graph(sql)
        return f

    return add


# scans, sources, sinks


@query(f"SELECT src, dst FROM e WHERE src_label = '{O}' AND dst_label = '{S}'")
def scan_label_pair(g):
    return g.relation(O, S)


@query("SELECT src, dst, src_label, dst_label FROM e")
def source_parquet_layout(g, spark, sf_dir):
    """Written in a folder for each label pair and read again."""
    path = folder(spark)
    layout.write(g, path)
    return layout.read(spark, path).edges


@query("SELECT src, dst, src_label, dst_label FROM e")
def source_text_round_trip(g, spark, sf_dir):
    path = folder(spark)
    text.write_graph(PropertyGraph(g.vertices.withColumn("label", F.translate("label", " ", "_")), g.edges), path)
    return text.read_graph(spark, path).edges


@query("SELECT src, dst FROM e WHERE src < dst")
def graph_to_tuples(g):
    return text.to_tuples(g)[1]


# statistics


@query("SELECT id FROM v WHERE label = 'nation'")
def graph_vertices_by_label(g):
    return stats.vertices_by_label(g, "nation").select("id")


@query("SELECT label, count(*) AS n FROM v GROUP BY label")
def graph_label_frequency(g):
    return stats.label_frequency(g)


@query("SELECT id, label, CAST(coalesce(d, 0) AS BIGINT) AS degree FROM v LEFT JOIN (SELECT src, count(*) AS d FROM e GROUP BY src) x ON x.src = v.id")
def graph_degree(g):
    return stats.degrees(g)


@query("SELECT id, degree FROM (SELECT src AS id, count(*) AS degree FROM e GROUP BY src) ORDER BY degree DESC, id LIMIT 20")
def graph_degree_top(g):
    return stats.degrees(g).select("id", "degree").orderBy(F.desc("degree"), "id").limit(20)


@query("SELECT max(d) AS max_degree FROM (SELECT count(*) AS d FROM e GROUP BY src)")
def graph_max_degree(g):
    return stats.max_degree(g)


@query("SELECT src_label, dst_label, count(*) AS n FROM e GROUP BY ALL")
def graph_label_pair_counts(g):
    return stats.label_pairs(g)


@query("SELECT src AS id, dst_label AS neighbour_label, count(*) AS n FROM e GROUP BY ALL")
def graph_nlf(g):
    return stats.nlf(g).select("id", F.explode("nlf").alias("neighbour_label", "n"))


@query(f"SELECT src, CAST(dst // {1 << stats.BLOCK_BITS} AS BIGINT) AS block, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbours FROM e GROUP BY src, dst // {1 << stats.BLOCK_BITS}")
def graph_adjacency(g):
    return stats.adjacency(g.edges).select("src", "block", F.array_join("neighbours", ",").alias("neighbours"))


@query(
    "SELECT CAST((SELECT count(*) FROM v) AS BIGINT) AS vertices, CAST((SELECT count(DISTINCT label) FROM v) AS BIGINT) AS labels, "
    "CAST((SELECT max(n) FROM (SELECT count(*) AS n FROM v GROUP BY label)) AS BIGINT) AS max_label_frequency, "
    "CAST((SELECT count(*) FROM half) AS BIGINT) AS edges, CAST((SELECT max(d) FROM (SELECT count(*) AS d FROM e GROUP BY src)) AS BIGINT) AS max_degree, "
    "CAST((SELECT count(*) FROM v) * 8 + (SELECT count(*) FROM half) * 32 AS BIGINT) AS memory_bytes"
)
def graph_metadata(g):
    return stats.metadata(g)


_PAIRS = f"SELECT {commerce.ORDER * commerce.KIND} + o_orderkey AS src, {commerce.CUSTOMER * commerce.KIND} + o_custkey + o_orderkey % 2 AS dst FROM orders"


def _probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.selectExpr(f"{commerce.ORDER * commerce.KIND} + o_orderkey as src", f"{commerce.CUSTOMER * commerce.KIND} + o_custkey + o_orderkey % 2 as dst")


@query(f"SELECT p.src, p.dst FROM ({_PAIRS}) p WHERE EXISTS (SELECT 1 FROM e WHERE e.src = p.src AND e.dst = p.dst)")
def graph_edge_exists(g, spark, sf_dir):
    return stats.edges_exist(g, _probe(spark, sf_dir))


@query(f"SELECT src_label, dst_label, count(*) AS n FROM (SELECT * FROM e UNION (SELECT p.src, p.dst, a.label, b.label FROM (SELECT src, dst FROM ({_PAIRS}) UNION SELECT dst, src FROM ({_PAIRS})) p JOIN v a ON a.id = p.src JOIN v b ON b.id = p.dst)) GROUP BY ALL")
def graph_insert_edges(g, spark, sf_dir):
    return stats.label_pairs(stats.insert_edges(g, _probe(spark, sf_dir)))


@query(f"SELECT src_label, dst_label, count(*) AS n FROM e WHERE (src, dst) NOT IN (SELECT src, dst FROM ({_PAIRS})) AND (dst, src) NOT IN (SELECT src, dst FROM ({_PAIRS})) GROUP BY ALL")
def graph_delete_edges(g, spark, sf_dir):
    return stats.label_pairs(stats.delete_edges(g, _probe(spark, sf_dir)))


#: Step by step, so that no planner starts from the hubs.
_TRIANGLES = (
    ", up AS MATERIALIZED (SELECT src, dst FROM e WHERE src < dst), wedge AS MATERIALIZED (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM up x JOIN up y ON y.src = x.dst), "
    "tri AS MATERIALIZED (SELECT a, b, c FROM wedge JOIN up z ON z.src = a AND z.dst = c) "
)


@query(_TRIANGLES + "SELECT src, dst, count(*) AS triangles FROM (SELECT a AS src, b AS dst FROM tri UNION ALL SELECT b, c FROM tri UNION ALL SELECT a, c FROM tri) GROUP BY ALL")
def graph_triangle_support(g):
    return stats.triangle_support(g.edges)


@query(
    _TRIANGLES.rstrip() + ", quad AS MATERIALIZED (SELECT a, b, c, p.dst AS d FROM tri JOIN up p ON p.src = c) "
    "SELECT CAST(count(*) AS BIGINT) AS n FROM quad JOIN up q ON q.src = a AND q.dst = d JOIN up r ON r.src = b AND r.dst = d"
)
def graph_four_cliques(g):
    return stats.four_cliques(g.edges).agg(F.count("*").alias("n"))


def _peeled(rounds: int, first: str, step: str, last: str) -> str:
    """Rounds of peeling written out; those after the last that changes something do no harm."""
    tables = [first.format("c0")] + [step.format(old=f"c{i}", new=f"c{i + 1}") for i in range(rounds)]
    return ", " + ", ".join(tables) + f" SELECT {last} FROM c{rounds}"


_CORE = "{new} AS MATERIALIZED (SELECT src, dst FROM {old} WHERE src IN (SELECT src FROM {old} GROUP BY src HAVING count(*) >= 12) AND dst IN (SELECT src FROM {old} GROUP BY src HAVING count(*) >= 12))"


@query(_peeled(12, "{} AS MATERIALIZED (SELECT src, dst FROM e)", _CORE, "src, dst"))
def graph_k_core(g):
    """The 12-core."""
    return stats.k_core(g.edges, 12)


_TRUSS = (
    "{new} AS MATERIALIZED (WITH good AS MATERIALIZED (SELECT src, dst FROM (SELECT a AS src, b AS dst FROM {old} UNION ALL SELECT b, c FROM {old} UNION ALL SELECT a, c FROM {old}) GROUP BY ALL HAVING count(*) >= 2) "
    "SELECT a, b, c FROM {old} SEMI JOIN good x ON x.src = a AND x.dst = b SEMI JOIN good y ON y.src = b AND y.dst = c SEMI JOIN good z ON z.src = a AND z.dst = c)"
)


@query(_TRIANGLES.rstrip() + _peeled(24, "{} AS MATERIALIZED (SELECT a, b, c FROM tri)", _TRUSS, "DISTINCT unnest([a, b, a]) AS src, unnest([b, c, c]) AS dst"))
def graph_k_truss(g):
    """Edges that keep 2 triangles."""
    return stats.k_truss(g.edges, 2)


# filters, semi-joins, sets

_OP, _PS, _OS, _OC = "op", "ps", "os", "oc"
#: Relations, materialized so that the planner knows their sizes.
_RELATIONS = ", " + ", ".join(f"{name} AS MATERIALIZED (SELECT src, dst FROM e WHERE src_label = '{a}' AND dst_label = '{b}')" for name, a, b in ((_OP, O, P), (_PS, P, S), (_OS, O, S), (_OC, O, C))) + " "


@query(f"{_RELATIONS} SELECT src AS u0, dst AS u1 FROM {_OP} WHERE src IN (SELECT src FROM {_OS}) AND dst IN (SELECT src FROM {_PS})")
def scan_candidates(g):
    """A relation between two candidate sets."""
    orders, parts = g.relation(O, S, "u0", "x").select("u0"), g.relation(P, S, "u1", "x").select("u1")
    return relations.restricted(g.relation(O, P, "u0", "u1"), "u0", orders, "u1", parts)


_DEMAND = f"SELECT src FROM e WHERE src_label = '{O}' GROUP BY src HAVING count(CASE WHEN dst_label = '{P}' THEN 1 END) >= 2 AND count(CASE WHEN dst_label = '{S}' THEN 1 END) >= 1"


@query(f"SELECT src AS id FROM ({_DEMAND})")
def nlf_candidates(g):
    return relations.candidates_by_neighbours(g, O, {P: 2, S: 1})


@query(f"{_RELATIONS} SELECT src AS u0, dst AS u1 FROM {_OP} WHERE src IN ({_DEMAND})")
def nlf_filtered_relation(g):
    return relations.neighbour_filter(g, PATTERNS["p11"], relations.scan_all(g, PATTERNS["p11"]))[0, 1]


@query(f"{_RELATIONS} SELECT DISTINCT dst AS u1 FROM {_OP}")
def project_candidates(g):
    return relations.project(relations.scan(g, PATTERNS["p04"], 0, 1), 1)


@query(f"{_RELATIONS} SELECT src AS u0, dst AS u1 FROM {_OP} WHERE dst IN (SELECT src FROM {_PS})")
def semi_join(g):
    p = PATTERNS["p04"]
    return relations.semi_join(relations.scan(g, p, 0, 1), relations.scan(g, p, 1, 2), column(1))


@query(f"{_RELATIONS} SELECT src AS u0, dst AS u1 FROM {_OP} WHERE src NOT IN (SELECT src FROM {_OC})")
def anti_join(g):
    """Relation edges of orders whose customer isn't of that label."""
    left, right = g.relation(O, P, "u0", "u1"), g.relation(O, C, "u0", "x")
    return left.join(right, "u0", "left_anti").select("u0", "u1")


@query(f"{_RELATIONS} SELECT CAST(count(DISTINCT src) AS BIGINT) AS keys, CAST((SELECT count(*) FROM {_OP} WHERE dst IN (SELECT src FROM {_PS})) AS BIGINT) AS rows FROM {_PS}")
def semi_join_count(g, spark, sf_dir):
    """How many keys the right side has, and the rows that stay."""
    p = PATTERNS["p04"]
    left, keys = relations.semi_join_count(relations.scan(g, p, 0, 1), relations.scan(g, p, 1, 2), column(1))
    return left.agg(F.lit(keys).cast("long").alias("keys"), F.count("*").alias("rows"))


@query(f"SELECT n.src AS u0, n.dst AS u1 FROM (SELECT src, dst FROM e WHERE src_label = '{N}' AND dst_label = '{S}') n WHERE n.dst IN (SELECT dst FROM e WHERE src_label = '{P}' AND dst_label = '{S}')")
def full_reducer_path(g):
    p = PATTERNS["p02"]
    return relations.reduce_fully(p, relations.scan_all(g, p))[0, 1]


@query(f"SELECT src AS u1, dst AS u2 FROM (SELECT src, dst FROM e WHERE src_label = '{N}' AND dst_label = '{C}') WHERE src IN (SELECT src FROM e WHERE src_label = '{N}' AND dst_label = '{R}') AND src IN (SELECT src FROM e WHERE src_label = '{N}' AND dst_label = '{M}')")
def full_reducer_star(g):
    p = PATTERNS["p09"]
    return relations.reduce_fully(p, relations.scan_all(g, p), top_down_first=True)[1, 2]


_NSP = f"SELECT n.src AS u0, n.dst AS u1, s.dst AS u2 FROM (SELECT src, dst FROM e WHERE src_label = '{N}' AND dst_label = '{S}') n JOIN (SELECT src, dst FROM e WHERE src_label = '{S}' AND dst_label = '{P}') s ON s.src = n.dst"


@query(f"SELECT DISTINCT * FROM (SELECT 0 AS qu, 1 AS qv, u0 AS du, u1 AS dv FROM ({_NSP}) UNION ALL SELECT 1, 2, u1, u2 FROM ({_NSP}))")
def candidate_space_edges(g):
    return relations.ecand(relations.candidate_space(g, PATTERNS["p02"]))


@query(f"SELECT DISTINCT * FROM (SELECT 0 AS qv, u0 AS v FROM ({_NSP}) UNION ALL SELECT 1, u1 FROM ({_NSP}) UNION ALL SELECT 2, u2 FROM ({_NSP}))")
def candidate_space_vertices(g):
    return relations.vcand(PATTERNS["p02"], relations.candidate_space(g, PATTERNS["p02"]))


@query(f"SELECT DISTINCT * FROM (SELECT 0 AS qu, 1 AS qv, u0 AS du, u1 AS dv FROM ({_NSP}) UNION ALL SELECT 1, 2, u1, u2 FROM ({_NSP}))")
def candidate_cascade(g):
    """Arc consistency without a schedule."""
    return relations.ecand(relations.cascade(PATTERNS["p02"], relations.scan_all(g, PATTERNS["p02"])))


_OPS = f"SELECT a.src AS u0, a.dst AS u1, b.dst AS u2 FROM {_OP} a JOIN {_PS} b ON b.src = a.dst"


@query(f"{_RELATIONS} {_OPS}")
def hash_join_1key(g):
    return joins.hash_join(g.relation(O, P, "u0", "u1"), g.relation(P, S, "u1", "u2"), ["u1"]).select("u0", "u1", "u2")


@query(f"{_RELATIONS}, x AS MATERIALIZED ({_OPS}), c AS MATERIALIZED (SELECT o.src, o.dst AS sup, k.dst FROM {_OS} o JOIN {_OC} k ON k.src = o.src) SELECT x.u0, x.u1, x.u2, c.dst AS u3 FROM x JOIN c ON c.src = x.u0 AND c.sup = x.u2")
def hash_join_2key(g):
    left = joins.hash_join(g.relation(O, P, "u0", "u1"), g.relation(P, S, "u1", "u2"), ["u1"])
    right = joins.hash_join(g.relation(O, S, "u0", "u2"), g.relation(O, C, "u0", "u3"), ["u0"])
    return joins.hash_join(left, right, ["u0", "u2"]).select("u0", "u1", "u2", "u3")


@query(f"{_RELATIONS} SELECT x.src AS a, x.dst AS b, p.dst AS v FROM {_PS} x JOIN e p ON p.src = x.src JOIN e q ON q.src = x.dst AND q.dst = p.dst")
def common_neighbours(g):
    return joins.common_neighbours(g.edges.select("src", "dst"), g.relation(P, S, "a", "b"))


@query(f"{_RELATIONS} SELECT src AS id FROM {_OP} INTERSECT SELECT src FROM {_OS}")
def set_intersection(g):
    return joins.intersect_all([g.relation(O, P, "id", "x").select("id"), g.relation(O, S, "id", "x").select("id")])


@query(f"{_RELATIONS} SELECT src AS id FROM {_OP} UNION SELECT src FROM {_PS} ORDER BY id")
def sorted_union(g):
    return joins.sorted_union([g.relation(O, P, "id", "x").select("id"), g.relation(P, S, "id", "x").select("id")], "id")


@query(f"{_RELATIONS} SELECT src AS id FROM {_OP} EXCEPT SELECT src FROM {_OC}")
def set_difference(g):
    return joins.difference(g.relation(O, P, "id", "x").select("id"), g.relation(O, C, "id", "x").select("id")).distinct()


@query(f"{_RELATIONS} SELECT EXISTS (SELECT 1 FROM {_OP} WHERE dst IN (SELECT src FROM {_PS})) AS parts_meet, EXISTS (SELECT 1 FROM {_OP} WHERE src IN (SELECT dst FROM {_PS})) AS others_meet")
def sets_overlap(g, spark, sf_dir):
    op, ps = g.relation(O, P), g.relation(P, S)
    ids = lambda df, end: df.select(F.col(end).alias("id"))
    return spark.createDataFrame([(joins.overlap(ids(op, "dst"), ids(ps, "src")), joins.overlap(ids(op, "src"), ids(ps, "dst")))], "parts_meet boolean, others_meet boolean")


_PLACED = f"SELECT src, dst, CAST(dst // {1 << stats.BLOCK_BITS} AS BIGINT) AS block, CAST(row_number() OVER (PARTITION BY src, dst // {1 << stats.BLOCK_BITS} ORDER BY dst) - 1 AS INTEGER) AS place FROM e"


@query(f"{_RELATIONS}, placed AS MATERIALIZED ({_PLACED}) SELECT x.src AS a, x.dst AS b, p.dst AS v, p.place AS first, q.place AS second FROM {_PS} x JOIN placed p ON p.src = x.src JOIN placed q ON q.src = x.dst AND q.dst = p.dst")
def intersect_positions(g):
    """Shared neighbours of linked parts and suppliers, with their places in both sorted arrays of a block."""
    near = stats.adjacency(g.edges)
    side = lambda end, name: near.select(F.col("src").alias(end), "block", F.col("neighbours").alias(name))
    both = g.relation(P, S, "a", "b").join(side("a", "one"), "a").join(side("b", "two"), ["b", "block"])
    return both.select("a", "b", F.explode(joins.intersect_positions(F.col("one"), F.col("two"))).alias("x")).select("a", "b", F.col("x.value").alias("v"), "x.first", "x.second")


@query(f"SELECT src AS id FROM e GROUP BY src HAVING count(CASE WHEN dst_label = '{P}' THEN 1 END) >= 2 AND count(CASE WHEN dst_label = '{S}' THEN 1 END) >= 1")
def nlf_predicate(g):
    """The predicate on maps of neighbour labels, over vertices of any label."""
    return stats.nlf(g).where(covers(F.col("nlf"), {P: 2, S: 1})).select("id")


_ROUND = (
    f", ns AS MATERIALIZED (SELECT src, dst FROM e WHERE src_label = '{N}' AND dst_label = '{S}'), sp AS MATERIALIZED (SELECT src, dst FROM e WHERE src_label = '{S}' AND dst_label = '{P}'), "
    "n0 AS (SELECT DISTINCT src AS v FROM ns), s0 AS (SELECT DISTINCT dst AS v FROM ns WHERE src IN (SELECT v FROM n0) AND dst IN (SELECT src FROM sp)), "
    "p0 AS (SELECT DISTINCT dst AS v FROM sp WHERE src IN (SELECT v FROM s0)) "
)


@query(f"{_ROUND} SELECT 0 AS qv, v FROM n0 UNION ALL SELECT 1, v FROM s0 UNION ALL SELECT 2, v FROM p0")
def candidates_one_round(g):
    """One round of pruning, from all vertices of each label: nations, then suppliers, then parts."""
    p = PATTERNS["p02"]
    start = {u: stats.vertices_by_label(g, label).select(F.col("id").alias(column(u))) for u, label in enumerate(p.labels)}
    found = relations.eliminate(g, p, start, {0: 0, 1: 1, 2: 2})
    return found[0].select(F.lit(0).alias("qv"), F.col("u0").alias("v")).union(found[1].select(F.lit(1), "u1")).union(found[2].select(F.lit(2), "u2"))


@query(f"SELECT 0 AS qu, 1 AS qv, src AS du, dst AS dv FROM e WHERE src_label = '{N}' AND dst_label = '{S}' AND dst % 3 <> 0 UNION ALL SELECT 1, 2, src, dst FROM e WHERE src_label = '{S}' AND dst_label = '{P}' AND src % 3 <> 0")
def candidate_space_union(g):
    """Of two candidate spaces that overlap."""
    p = PATTERNS["p02"]
    space = relations.scan_all(g, p)
    some = lambda keep: {e: df.where(F.pmod(F.col("u1"), F.lit(3)).isin(keep)) for e, df in space.items()}
    return relations.ecand(relations.merge(some([1]), some([1, 2])))


@query(" UNION ALL ".join(f"SELECT {u} AS u, {v} AS v, CAST(count(*) AS BIGINT) AS n FROM e WHERE src_label = '{PATTERNS['p08'].labels[u]}' AND dst_label = '{PATTERNS['p08'].labels[v]}'" for u, v in PATTERNS["p08"].edges))
def relation_report_p08(g):
    return stats.relation_report(g, PATTERNS["p08"])


@query(sqlgen.rows_sql(PATTERNS["p04"]))
def multiway_extend(g):
    """The cyclic step by joins and semi-joins."""
    return joins.extend(g.relation(O, P, "u0", "u1"), [("u0", g.relation(O, S, "u0", "u2")), ("u1", g.relation(P, S, "u1", "u2"))], "u2").select("u0", "u1", "u2")


@query(sqlgen.rows_sql(PATTERNS["p04"]))
def multiway_intersect(g):
    """The same step by intersections of neighbour arrays."""
    return match.matches(g, PATTERNS["p04"], strategy="intersect")


# matching


def _counted(name: str, sql: str, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return match.count(commerce.graph(spark, sf_dir), PATTERNS[options.get("pattern", name[-3:])], **{k: v for k, v in options.items() if k != "pattern"})

    QUERIES[name] = run
    SQL[name] = with_graph(sql)


for _name, _pattern in PATTERNS.items():
    _star = {"p03": (C, O, 2), "p10": (C, O, 3)}.get(_name)
    _counted(f"match_{_name}", sqlgen.star_sql(*_star) if _star else sqlgen.count_sql(_pattern))
_counted("match_homomorphism_p06", sqlgen.count_sql(PATTERNS["p06"], "homo"), semantics="homo")
_counted("match_homomorphism_p10", sqlgen.star_sql(C, O, 3, "homo"), semantics="homo")
_counted("match_limit", sqlgen.count_sql(PATTERNS["p02"], limit=1000), pattern="p02", limit=1000)
_counted("match_reduced_p08", sqlgen.count_sql(PATTERNS["p08"]), reduce="full")
_counted("match_neighbour_filter_p11", sqlgen.count_sql(PATTERNS["p11"]), reduce="neighbours")
for _order in ("cost", "dependency", "ri", "degree", "ports", "nucleus", "best"):
    _counted(f"match_order_{_order}_p08", sqlgen.count_sql(PATTERNS["p08"]), pattern="p08", order=_order)
_counted("match_intersect_p05", sqlgen.count_sql(PATTERNS["p05"]), strategy="intersect")


@query(sqlgen.rows_sql(PATTERNS["p04"]))
def match_rows_p04(g):
    return match.matches(g, PATTERNS["p04"])


@query(sqlgen.rows_sql(PATTERNS["p06"]))
def match_rows_p06(g):
    """Checked as well: no row holds a vertex twice."""
    return match.matches(g, PATTERNS["p06"]).where(no_repeat(["u0", "u1", "u2", "u3"]))


@query(sqlgen.rows_sql(PATTERNS["p04"]))
def match_check_p04(g):
    """Paths of three vertices, of which those stay that are matches."""
    paths = joins.hash_join(g.relation(O, P, "u0", "u1"), g.relation(P, S, "u1", "u2"), ["u1"])
    return match.valid_rows(g, PATTERNS["p04"], paths)


@query(sqlgen.count_sql(PATTERNS["p09"], "homo"))
def estimate_tree_p09(g):
    return estimate.estimate(g, PATTERNS["p09"])


@query(sqlgen.star_sql(C, O, 2, "homo"))
def estimate_tree_p03(g):
    return estimate.estimate(g, PATTERNS["p03"])


# views


def _local(g: PropertyGraph, *patterns: Pattern) -> PropertyGraph:
    """The graph of the label pairs that the patterns name, each stored once and in one direction, since a view reads it many times.

    Its edges have labels that no file holds, so a filter on labels leaves one table.
    """
    pairs = sorted({tuple(sorted((p.labels[u], p.labels[v]))) for p in patterns for u, v in p.edges})
    edges = []
    for a, b in pairs:
        own = stored(g.relation(a, b))
        edges.append(own.select("src", "dst", F.lit(a).alias("src_label"), F.lit(b).alias("dst_label")))
        if a != b:
            edges.append(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(b).alias("src_label"), F.lit(a).alias("dst_label")))
    return PropertyGraph(g.vertices, reduce(DataFrame.union, edges))


def _view(g: PropertyGraph, spark: SparkSession, pattern: Pattern, **options) -> store.View:
    return store.load(spark, build.build(g, pattern, folder(spark), **options).path)


def _answered(name: str, query_name: str, patterns: list[Pattern]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = commerce.graph(spark, sf_dir)
        return answer.count(g, PATTERNS[query_name], [_view(g, spark, p) for p in patterns])

    QUERIES[name] = run
    SQL[name] = with_graph(sqlgen.count_sql(PATTERNS[query_name]))


_answered("view_answer_p08_using_p04", "p08", [PATTERNS["p04"]])
_answered("view_answer_p07_using_p04", "p07", [PATTERNS["p04"]])
_answered("view_answer_patch_edge", "p04", [PATH_OPS])
_answered("view_answer_two_views", "p08", [EDGE_OP, PATH_SNC])
_answered("view_answer_overlapping", "p08", [PATTERNS["p04"], PATTERNS["p05"]])
_answered("view_answer_empty", "p12", [PATTERNS["p12"]])
_answered("view_answer_unused", "p09", [PATTERNS["p04"]])

_P04 = ", {}, m AS MATERIALIZED ({}) ".format(*sqlgen.rows_select(PATTERNS["p04"]))


@query(f"{_P04} SELECT DISTINCT u0 AS q0, u1 AS q1 FROM m")
def view_supernode_p04(g, spark, sf_dir):
    return _view(g, spark, PATTERNS["p04"], parts=[[0, 1], [2]]).rows(0).select("q0", "q1")


@query(f"{_P04} SELECT DISTINCT u0 AS q0, u1 AS q1, u2 AS q2 FROM m")
def view_superedge_p04(g, spark, sf_dir):
    return _view(g, spark, PATTERNS["p04"], parts=[[0, 1], [2]]).pairs(0, 1).select("q0", "q1", "q2")


@query(
    f"{_P04} SELECT 'sn_0' AS name, CAST(16 * count(DISTINCT (u0, u1)) AS BIGINT) AS bytes FROM m UNION ALL SELECT 'sn_1', CAST(8 * count(DISTINCT u2) AS BIGINT) FROM m "
    "UNION ALL SELECT 'se_0_1', CAST(24 * count(DISTINCT (u0, u1, u2)) AS BIGINT) FROM m"
)
def view_stats(g, spark, sf_dir):
    """Bytes of the parts and links of the view of p04."""
    held = store.memory(_view(g, spark, PATTERNS["p04"], parts=[[0, 1], [2]]))
    return spark.createDataFrame(sorted((n, b) for n, b in held.items() if n.startswith("s")), "name string, bytes long")


@query(
    f"{_P04} SELECT 0 AS i, 1 AS j, CAST(count(*) AS BIGINT) AS pairs, CAST(count(DISTINCT (u0, u1)) AS BIGINT) AS keys_i, CAST(count(DISTINCT u2) AS BIGINT) AS keys_j, "
    "CAST((SELECT max(n) FROM (SELECT count(*) AS n FROM m GROUP BY u0, u1)) AS BIGINT) AS most_i, CAST((SELECT max(n) FROM (SELECT count(*) AS n FROM m GROUP BY u2)) AS BIGINT) AS most_j FROM m"
)
def view_links_p04(g, spark, sf_dir):
    return store.link_report(_view(g, spark, PATTERNS["p04"], parts=[[0, 1], [2]]))


def _without(condition: str) -> str:
    """The graph's SQL over order lines that fulfil a condition."""
    return commerce.SQL.replace("FROM lineitem", f"FROM lineitem WHERE {condition}")


_HELD = "l_orderkey % 97 = 0"


def _delta(spark: SparkSession, sf_dir: str, g: PropertyGraph) -> tuple[PropertyGraph, DataFrame]:
    """The graph without what only held-out order lines give, and those edges."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ids = lambda kind, key: (F.lit(kind * commerce.KIND) + F.col(key)).alias("x")
    ends = (("l_orderkey", commerce.ORDER, "l_partkey", commerce.PART), ("l_orderkey", commerce.ORDER, "l_suppkey", commerce.SUPPLIER), ("l_partkey", commerce.PART, "l_suppkey", commerce.SUPPLIER))
    edges = lambda rows: [rows.select(ids(ka, a).alias("src"), ids(kb, b).alias("dst")).distinct() for a, ka, b, kb in ends]
    # the lines of an order are held out together, so only edges between parts and suppliers may be left by other lines
    held, stay = edges(lines.where(_HELD)), edges(lines.where(f"not ({_HELD})"))[2]
    gone = stored(held[0].union(held[1]).union(held[2].join(stay, ["src", "dst"], "left_anti")))
    return stats.delete_edges(g, gone), gone


@query(sqlgen.count_sql(PATTERNS["p08"]))
def view_after_insert(g, spark, sf_dir):
    """p08 over a view of p04 that was built without some edges and then told of them."""
    full = _local(g, PATTERNS["p04"], PATTERNS["p08"])
    small, delta = _delta(spark, sf_dir, full)
    view, _ = maintain.insert(_view(small, spark, PATTERNS["p04"]), full, delta)
    return answer.count(full, PATTERNS["p08"], [view])


QUERIES["view_after_delete"] = lambda spark, sf_dir: _after_delete(spark, sf_dir)
SQL["view_after_delete"] = f"WITH {_without(f'NOT ({_HELD})')}{sqlgen.count_sql(PATTERNS['p08'])}"


def _after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = _local(commerce.graph(spark, sf_dir), PATTERNS["p04"], PATTERNS["p08"])
    small, delta = _delta(spark, sf_dir, full)
    view, _ = maintain.delete(_view(full, spark, PATTERNS["p04"]), delta)
    return answer.count(small, PATTERNS["p08"], [view])


def entry(spark: SparkSession) -> DataFrame:
    return match.matches(commerce.graph(spark, "/root/testdata/sf0.001"), PATTERNS["p04"])
