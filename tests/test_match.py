import random

import pytest
from brute import matches, random_graph, random_pattern

from quiltgraph.model import Pattern
from quiltgraph.operators import estimate, match, relations, stats
from quiltgraph.sources import commerce, layout, text

G8 = (list("01201210"), [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5), (5, 6), (6, 7), (1, 7)])
CASES = [
    ("0000", "01 02 03 12 13 23", "000", "01 12 02", 24, 24),
    ("0000", "01 02 03 12 13 23", "0000", "01 12 23 30", 24, None),
    ("0111", "01 02 03", "011", "01 02", 6, 9),
    ("0101", "01 12 23 30", "010", "01 12", 4, None),
    ("0101", "01 12 23 30", "0101", "01 12 23 30", 4, None),
    (*G8, "012", "01 12 02", 2, None),
    (*G8, "010", "01 12", 2, None),
    (*G8, "0121", "01 12 02 23", 1, None),
    (*G8, "012012", "01 12 02 23 34 45 35", 1, None),
    (*G8, "09", "01", 0, 0),
    ("00", "01", "000", "01 12", 0, None),
    ("00", "01", "00", "01", 2, 2),
    ("001", "01", "0", "", 2, 2),
]
pairs = lambda e: [(int(x[0]), int(x[1])) for x in e.split()] if isinstance(e, str) else e


@pytest.mark.parametrize("case", CASES, ids=range(len(CASES)))
def test_micro_graphs(spark, case):
    labels, edges, pl, pe, iso, homo = case
    g = text.from_tuples(spark, list(enumerate(labels)), pairs(edges))
    p = Pattern(pl, pairs(pe))
    assert match.count(g, p).first()["n"] == iso
    rows = {tuple(r) for r in match.matches(g, p).collect()}
    assert rows == matches(list(labels), pairs(edges), p)
    if homo is not None:
        assert match.count(g, p, "homo").first()["n"] == homo


@pytest.mark.parametrize("seed", range(6))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    labels, edges = random_graph(rng, 9, 2, 0.45)
    g = text.from_tuples(spark, list(enumerate(labels)), edges)
    p = random_pattern(rng, rng.randint(3, 5), 2)
    want = matches(labels, edges, p)
    name = list(match.orders.STRATEGIES)[seed % 5]
    assert match.count(g, p).first()["n"] == len(want)
    assert match.count(g, p, order=name, reduce=["none", "neighbours", "full"][seed % 3]).first()["n"] == len(want)
    assert {tuple(r) for r in match.matches(g, p, strategy="intersect", order="best").collect()} == want
    homo = matches(labels, edges, p, False)
    assert match.count(g, p, "homo").first()["n"] == len(homo) >= len(want)
    assert estimate.estimate(g, p).first()["n"] >= len(homo)


EXPECTED = {"p01": (120, 120), "p02": (339, 339), "p03": (382, 502), "p04": (1427, 1427), "p05": (7, 7), "p06": (6064, 7491), "p07": (345, 345), "p08": (6, 6), "p09": (36, 36), "p10": (1122, 2388), "p11": (1292, 2719), "p12": (0, 0)}


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("shop"))
    layout.write(commerce.graph(spark, "/root/testdata/sf0.001"), path)
    return layout.read(spark, path)


def test_catalogue(shop):
    assert {k: match.count(shop, p).first()["n"] for k, p in commerce.PATTERNS.items()} == {k: v[0] for k, v in EXPECTED.items()}
    assert {k: match.count(shop, p, "homo").first()["n"] for k, p in commerce.PATTERNS.items()} == {k: v[1] for k, v in EXPECTED.items()}


def test_limit_and_timeout(shop):
    p = commerce.PATTERNS["p06"]
    assert match.match(shop, p, limit=100).count == 100
    assert match.matches(shop, p, limit=7).count() == 7
    late = match.match(shop, p, timeout=0.01)
    assert late.timed_out and late.count is None
    assert match.match(shop, p, timeout=300).count == 6064


def test_pushed_to_the_partitions(shop):
    plan = shop.relation("region", "nation")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "src_label" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_reducer_is_exact_on_trees(spark):
    rng = random.Random(5)
    labels, edges = random_graph(rng, 10, 3, 0.3)
    g = text.from_tuples(spark, list(enumerate(labels)), edges)
    p = Pattern("abca", [(0, 1), (1, 2), (2, 3)])
    got = relations.reduce_fully(p, relations.scan_all(g, p))
    homo = matches(labels, edges, p, False)
    for (u, v), df in got.items():
        assert {tuple(r) for r in df.collect()} == {(f[u], f[v]) for f in homo}


def test_formats(spark, tmp_path):
    g = text.from_tuples(spark, list(enumerate(G8[0])), [*G8[1], (1, 0), (3, 3)])
    text.write_graph(g, f"{tmp_path}/t")
    again = text.read_graph(spark, f"{tmp_path}/t")
    assert sorted(again.edges.collect()) == sorted(g.edges.collect()) and again.edges.count() == 20
    assert text.wrong_degrees(spark, f"{tmp_path}/t").count() == 0
    text.write_gr(g, f"{tmp_path}/gr")
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/gr").collect()]
    assert "p tw 8 10" in lines and "1 2" in lines
    (tmp_path / "plain").write_text("e 0 1 7\nv 0 a\nv 1 b\ne 1 0 7\n")
    assert text.read_graph(spark, f"{tmp_path}/plain").edges.count() == 2
    (tmp_path / "list").write_text("# head\n1 2\n2\t3\n")
    assert text.read_edge_list(spark, f"{tmp_path}/list").count() == 2


def test_graph_analytics(spark):
    edges = [(a, b) for b in range(5) for a in range(b)] + [(4, 5), (5, 6)]
    g = text.from_tuples(spark, [(i, "x") for i in range(7)], edges)
    assert stats.triangles(g.edges).count() == 10 and stats.four_cliques(g.edges).count() == 5
    assert {r["triangles"] for r in stats.triangle_support(g.edges).collect()} == {3}
    assert stats.k_core(g.edges, 3).count() == 20 and stats.k_truss(g.edges, 3).count() == 10
    assert stats.k_core(g.edges, 9).count() == 0
    assert stats.max_degree(g).first()[0] == 5


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_core_and_truss_against_plain_peeling(spark, k):
    rng = random.Random(40 + k)
    edges = {(a, b) for b in range(14) for a in range(b) if rng.random() < 0.4}
    g = text.from_tuples(spark, [(i, "x") for i in range(14)], sorted(edges))

    def peeled(rest, weak):
        while gone := {e for e in rest if weak(e, rest)}:
            rest = rest - gone
        return rest

    degree = lambda v, rest: sum(v in e for e in rest)
    near = lambda v, rest: {a + b - v for a, b in rest if v in (a, b)}
    core = peeled(edges, lambda e, rest: min(degree(e[0], rest), degree(e[1], rest)) < k + 2)
    assert {tuple(r) for r in stats.k_core(g.edges, k + 2).where("src < dst").collect()} == core
    truss = peeled(edges, lambda e, rest: len(near(e[0], rest) & near(e[1], rest)) < k)
    assert {tuple(r) for r in stats.k_truss(g.edges, k).collect()} == truss


def test_rows_after_each_step_and_checked_rows(spark):
    rng = random.Random(6)
    labels, edges = random_graph(rng, 10, 2, 0.5)
    g = text.from_tuples(spark, list(enumerate(labels)), edges)
    p = Pattern("aba", [(0, 1), (1, 2)])
    want = matches(labels, edges, p)
    result = match.match(g, p, order=[0, 1, 2])
    assert result.count == len(want) and set(result.stats["rows_after"]) <= {0, 1, 2}
    every = spark.createDataFrame([(a, b, c) for a in range(10) for b in range(10) for c in range(10)], "u0 long, u1 long, u2 long")
    assert {tuple(r) for r in match.valid_rows(g, p, every).collect()} == want
    assert {tuple(r) for r in match.valid_rows(g, p, every, "homo").collect()} == matches(labels, edges, p, False)
    assert match.match(g, Pattern("aza", [(0, 1), (1, 2)])).count == 0  # nothing is left to observe


def test_ordered_choices(spark):
    from math import perm

    from pyspark.sql import functions as F

    from quiltgraph.functions.columns import falling_factorial

    rows = spark.range(8).select("id", *[falling_factorial(F.col("id"), k).alias(f"k{k}") for k in (1, 2, 3)]).collect()
    assert all(r[f"k{k}"] == perm(r["id"], k) for r in rows for k in (1, 2, 3))


def test_ties_are_broken_by_candidates(spark):
    g = text.from_tuples(spark, list(enumerate("aaaab")), [(0, 4), (1, 4), (2, 4), (3, 4)])
    assert match.chosen_order(g, Pattern("ab", [(0, 1)]), "dependency") == [1, 0]
    path = Pattern("aba", [(0, 1), (1, 2)])
    sizes = match.Sizes(g, path)
    assert match.orders._least(range(3), lambda v: -len(path.neighbours[v]), sizes) == 1 and sizes.counts is None  # no tie, nothing counted


def test_order_by_cost_starts_at_the_smallest_relation(spark):
    labels = "h" + "a" * 6 + "b" * 3
    g = text.from_tuples(spark, list(enumerate(labels)), [*((0, v) for v in range(1, 10)), (1, 7), (2, 8)])
    p = Pattern("hab", [(0, 1), (0, 2), (1, 2)])
    assert g.statistics([("h", "a"), ("a", "b"), ("h", "b")]) == ({"h": 1, "a": 6, "b": 3}, {("h", "a"): 6, ("a", "b"): 2, ("h", "b"): 3})
    assert match.chosen_order(g, p, None) == [2, 1, 0] and match.count(g, p).first()["n"] == 2
    shop = commerce.graph(spark, "/root/testdata/sf0.001")
    pairs = [(commerce.O, commerce.P), (commerce.N, commerce.C), (commerce.N, commerce.R)]
    vertices, edges = shop.statistics(pairs)
    assert vertices == shop.label_counts({x for p in pairs for x in p})
    assert all(0.5 < edges[p] / n < 2 for p, n in shop.pair_counts(pairs).items())


def test_hubs_are_held_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(stats, "BLOCK_BITS", 1)
    rng = random.Random(8)
    labels, edges = random_graph(rng, 12, 2, 0.6)
    g = text.from_tuples(spark, list(enumerate(labels)), edges)
    assert max(len(r["neighbours"]) for r in stats.adjacency(g.edges).collect()) <= 2
    p = Pattern("aba", [(0, 1), (1, 2), (0, 2)])
    assert {tuple(r) for r in match.matches(g, p, strategy="intersect").collect()} == matches(labels, edges, p)


def test_renumbered(spark, tmp_path):
    labels, edges = list(zip((50, 7, 30, 9), "baab")), [(50, 7), (7, 30), (7, 9)]
    g = text.from_tuples(spark, labels, edges)
    for by, order in (("degree", [9, 30, 50, 7]), ("label", [7, 30, 9, 50])):
        new, table = text.renumbered(g, by)
        place = {r["old"]: r["id"] for r in table.collect()}
        assert place == {v: i for i, v in enumerate(order)}
        assert {tuple(r) for r in new.edges.collect()} == {(place[r["src"]], place[r["dst"]], r["src_label"], r["dst_label"]) for r in g.edges.collect()}
    text.write_edge_list(new.edges, f"{tmp_path}/el")
    assert sorted(map(tuple, text.read_edge_list(spark, f"{tmp_path}/el").collect())) == sorted((r["src"], r["dst"]) for r in new.edges.collect())
