import random

import pytest
from brute import random_pattern

from quiltgraph.model import Pattern, PatternError
from quiltgraph.plans import order, partition, patterns, rewrite
from quiltgraph.sources import commerce, text

K4 = Pattern("aaaa", [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)])
KITE = Pattern("aaaaa", [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4)])


def test_refused_patterns():
    for labels, edges in (("ab", []), ("a" * 33, [(i, i + 1) for i in range(32)]), ("a", [(0, 0)]), ("ab", [(0, 2)])):
        with pytest.raises(PatternError):
            Pattern(labels, edges)


def test_text_round_trip_and_checks():
    assert Pattern.parse(KITE.text()) == KITE
    with pytest.raises(ValueError, match="degrees"):
        text.parse_graph("t 2 1\nv 0 a 2\nv 1 a 1\ne 0 1\n")
    with pytest.raises(ValueError, match="header"):
        text.parse_graph("t 3 1\nv 0 a 1\nv 1 a 1\ne 0 1\n")
    assert text.parse_answers("q1:5\nq2:0\n") == {"q1": 5, "q2": 0}
    assert text.parse_mapping("0 3\n1 2\n") == {0: 3, 1: 2}
    assert "0 -- 1" in text.dot(K4)


def test_cores_and_bridges():
    assert patterns.core_numbers(KITE.neighbours) == [2, 2, 2, 1, 1]
    assert patterns.two_core_size(KITE.neighbours) == 3
    assert sorted(patterns.degeneracy_order(K4.neighbours)) == [0, 1, 2, 3]
    assert patterns.bridge_components(KITE) == [[0, 1, 2], [3], [4]]


def test_nuclei():
    assert set(patterns.nucleus_numbers(K4.neighbours, 1).values()) == {3}
    assert set(patterns.nucleus_numbers(K4.neighbours, 2).values()) == {2}
    assert set(patterns.nucleus_numbers(K4.neighbours, 3).values()) == {1}
    (root,) = patterns.nuclei(KITE.neighbours, 1)
    assert root.vertices == frozenset(range(5)) and [c.vertices for c in root.children] == [frozenset({0, 1, 2})]
    assert patterns.density_tree(KITE.neighbours)[0].children[0].density == 1.0


def test_equivalence_and_embeddings():
    star = Pattern("abbb", [(0, 1), (0, 2), (0, 3)])
    assert patterns.equivalence_classes(star) == [[1, 2, 3]]
    assert len(list(patterns.embeddings(Pattern("abb", [(0, 1), (0, 2)]), star))) == 6
    assert patterns.first_embedding(K4, KITE) is None
    with pytest.raises(patterns.SearchEnded):
        patterns.first_embedding(Pattern("abb", [(0, 1), (0, 2)]), star, most_states=1)


def test_outline_of_nuclei():
    assert patterns.outline(patterns.density_tree(KITE.neighbours)) == "k=1 density=0.50 [0, 1, 2, 3, 4]\n  k=2 density=1.00 [0, 1, 2]\n"


def test_searches_that_end_early_say_so(monkeypatch):
    from types import SimpleNamespace

    from quiltgraph.plans import rewrite

    ring = Pattern("a" * 8, [(i, (i + 1) % 8) for i in range(8)])
    with pytest.warns(UserWarning, match="ended after 5 tries"):
        partition._search(ring, list(range(8)), len, 5)

    def ended(*_):
        raise patterns.SearchEnded

    monkeypatch.setattr(rewrite, "first_embedding", ended)
    r = rewrite.rewrite(ring, [SimpleNamespace(pattern=K4, parts=[[0, 1, 2, 3]], linked={})])
    assert r.unsure == [0] and r.used == []


@pytest.mark.parametrize("seed", range(40))
def test_orders_and_partitions(seed):
    rng = random.Random(seed)
    p = random_pattern(rng, rng.randint(2, 8), 2)
    sizes = [rng.randint(1, 9) for _ in range(len(p))]
    for name in [*order.STRATEGIES, None]:
        assert order.valid(p, order.best(p, sizes, name))
    estimate = lambda part: 3.0 ** len(part)
    for how in partition.PARTITIONERS.values():
        for limit in (1e6, 10):
            parts = how(p, estimate, limit)
            assert sorted(v for part in parts for v in part) == list(range(len(p)))
            assert all(partition.connected(p, set(part)) for part in parts)
    assert partition.is_tree(p, partition.tree(p, estimate))
    assert len(partition.merged(p, partition.tree(p, estimate), estimate)) <= len(partition.tree(p, estimate))


class Fake:
    def __init__(self, pattern, parts):
        self.pattern, self.parts = pattern, parts
        self.linked = {(i, j): True for j in range(len(parts)) for i in range(j) if partition.adjacent(pattern, set(parts[i]), set(parts[j]))}


@pytest.mark.parametrize("seed", range(40))
def test_rewriting_accounts_for_every_edge(seed):
    rng = random.Random(seed)
    query = random_pattern(rng, rng.randint(3, 8), 2)
    views = []
    for _ in range(3):
        inside = query.reach({rng.randrange(len(query))})
        some = sorted(rng.sample(sorted(inside), rng.randint(2, len(query))))
        labels, edges = query.induced(some)
        edges = [e for e in edges if rng.random() < 0.8]
        try:
            view = Pattern(labels, edges)
        except PatternError:
            continue
        views.append(Fake(view, partition.tree(view, lambda part: 3.0 ** len(part))))
    r = rewrite.rewrite(query, views)
    assert sorted(v for n in r.nodes for v in n.vertices) == list(range(len(query)))
    assert sorted(rewrite.node_order(r, [0] * len(r.nodes))) == list(range(len(r.nodes)))


def test_nodes_go_in_the_order_of_fewest_rows():
    """Customers and suppliers of a nation, both reached before the orders, are their product; counts of the size of 60 times sf0.1."""
    p08 = commerce.PATTERNS["p08"]
    view = Fake(commerce.PATTERNS["p04"], [[0], [1], [2]])
    r = rewrite.rewrite(p08, [view])
    many = {0: 1.6e6, 1: 2e5, 2: 6e4, 3: 1.8e5, 4: 25}
    edges = {(0, 1): 2e6, (0, 2): 2e6, (1, 2): 2e6, (0, 3): 6e5, (3, 4): 1.8e5, (2, 4): 6e4}
    fan = {e: n / many[e[0]] for (u, v), n in edges.items() for e in ((u, v), (v, u))}
    rows = [many[n.vertices[0]] for n in r.nodes]
    costs = rewrite.Costs(rows, fan, {(u, v): n / many[u] / many[v] for (u, v), n in edges.items()}, dict.fromkeys(many, 1.0))
    place = lambda order: [r.nodes[k].vertices[0] for k in order].index
    by_edges, by_cost = place(rewrite.node_order(r, rows)), place(rewrite.cost_order(r, costs))
    assert max(by_edges(2), by_edges(3)) < by_edges(0) and max(by_cost(2), by_cost(3)) > by_cost(0)
