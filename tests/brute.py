"""Plain versions of graph operators, by trying everything."""

from __future__ import annotations

import random
from itertools import permutations, product


def matches(labels, edges, pattern, injective=True):
    have = {(a, b) for e in edges for a, b in (e, e[::-1])}
    n = len(pattern)
    picks = permutations(range(len(labels)), n) if injective else product(range(len(labels)), repeat=n)
    return {f for f in picks if all(labels[f[u]] == pattern.labels[u] for u in range(n)) and all((f[u], f[v]) in have for u, v in pattern.edges)}


def random_graph(rng: random.Random, n: int, kinds: int, p: float):
    labels = [rng.choice("abc"[:kinds]) for _ in range(n)]
    return labels, [(a, b) for a in range(n) for b in range(a) if rng.random() < p]


def random_pattern(rng: random.Random, n: int, kinds: int):
    from quiltgraph.model import Pattern

    labels = [rng.choice("abc"[:kinds]) for _ in range(n)]
    edges = {(rng.randrange(v), v) for v in range(1, n)}
    edges |= {(a, b) for b in range(n) for a in range(b) if rng.random() < 0.3}
    return Pattern(labels, edges)
