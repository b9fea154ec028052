import json
import random

import pytest
from brute import matches, random_graph, random_pattern

from quiltgraph import cli, queries, scratch
from quiltgraph.engine import Engine
from quiltgraph.model import Pattern, PatternError
from quiltgraph.operators import match
from quiltgraph.operators.stats import delete_edges, insert_edges
from quiltgraph.sources import commerce, layout, text
from quiltgraph.streaming.edges import LiveGraph
from quiltgraph.views import answer, build, maintain, store


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("shop"))
    layout.write(commerce.graph(spark, "/root/testdata/sf0.001"), path)
    return layout.read(spark, path)


def ask(graph, query, views):
    return answer.count(graph, query, views).first()["n"]


def test_cases_on_the_commerce_graph(spark, shop, tmp_path):
    p = commerce.PATTERNS
    view = lambda name, pattern, **k: store.load(spark, build.build(shop, pattern, f"{tmp_path}/{name}", **k).path)
    p04 = view("p04", p["p04"])
    assert [ask(shop, p[q], [p04]) for q in ("p08", "p07", "p04", "p09")] == [6, 345, 1427, 36]
    path = view("path", Pattern([commerce.O, commerce.P, commerce.S], [(0, 1), (1, 2)]))
    assert ask(shop, p["p04"], [path]) == 1427  # a patch edge
    edge = view("edge", Pattern([commerce.O, commerce.P], [(0, 1)]))
    snc = view("snc", Pattern([commerce.S, commerce.N, commerce.C], [(0, 1), (1, 2)]))
    assert ask(shop, p["p08"], [edge, snc]) == 6 and answer.explain(shop, p["p08"], [edge, snc])["views"] == [0, 1]
    for name in ("dependency", "ri", "degree", "ports", "nucleus"):
        assert answer.count(shop, p["p08"], [edge, snc], order=name).first()["n"] == 6
    empty = view("p12", p["p12"])
    assert empty.status == store.NO_ANSWER and ask(shop, p["p12"], [empty]) == 0
    unlinked = view("unlinked", p["p04"], parts=[[0, 1], [2]], most_links=1)
    assert unlinked.partial and ask(shop, p["p08"], [unlinked]) == 6
    assert build.build(shop, p["p04"], f"{tmp_path}/big", most_rows=0).status == store.OVERSIZED
    assert build.build(shop, p["p08"], f"{tmp_path}/late", timeout=0.05).status == store.TIMEOUT
    assert sum(store.memory(p04).values()) > 0
    assert len(store.load_all(spark, str(tmp_path))) == 6


@pytest.mark.parametrize("seed", range(3))
def test_random_views_and_changes(spark, tmp_path, seed):
    rng = random.Random(100 + seed)
    while True:
        labels, edges = random_graph(rng, 9, 2, 0.5)
        query = random_pattern(rng, rng.randint(3, 5), 2)
        some = sorted(rng.sample(range(len(query)), rng.randint(2, len(query))))
        names, inner = query.induced(some)
        inner = [e for e in inner if rng.random() < 0.85]
        try:
            pattern = Pattern(names, inner)
        except PatternError:
            continue
        if matches(labels, edges, query):
            break
    g = text.from_tuples(spark, list(enumerate(labels)), edges)
    view = build.build(g, pattern, f"{tmp_path}/v", partitioner=rng.choice(["tree", "levels"]))
    want = matches(labels, edges, query)
    assert ask(g, query, [view]) == len(want)
    assert {tuple(r) for r in answer.matches(g, query, [view], reduce="full").collect()} == want
    gone = rng.sample(edges, 3)
    delta = spark.createDataFrame(gone, "src long, dst long")
    small = delete_edges(g, delta)
    view, _ = maintain.delete(view, delta)
    assert ask(small, query, [view]) == len(matches(labels, [e for e in edges if e not in gone], query))
    view, _ = maintain.insert(view, insert_edges(small, delta), delta)
    assert ask(g, query, [view]) == len(want)
    held = {tuple(f[u] for u in range(len(pattern))) for f in matches(labels, edges, pattern)}
    if view.status == store.BUILT:
        for i, part in enumerate(view.parts):
            assert {tuple(r) for r in view.rows(i).select(*[store.q(u) for u in part]).collect()} >= {tuple(f[u] for u in part) for f in held}


def test_insert_into_an_empty_view(spark, tmp_path):
    labels = list(enumerate("aab"))
    g = text.from_tuples(spark, labels, [(0, 1)])
    p = Pattern("aab", [(0, 1), (1, 2)])
    view = build.build(g, p, f"{tmp_path}/v")
    assert view.status == store.NO_ANSWER
    delta = spark.createDataFrame([(2, 1)], "src long, dst long")
    full = insert_edges(g, delta)
    view, done = maintain.insert(view, full, delta)
    assert done["rebuilt"] and ask(full, p, [view]) == 1


def test_stream_keeps_answers(spark, tmp_path):
    rng = random.Random(3)
    labels, edges = random_graph(rng, 9, 2, 0.5)
    p = Pattern("aba", [(0, 1), (1, 2)])
    live = LiveGraph(spark, f"{tmp_path}/live", f"{tmp_path}/views")
    live.start(text.from_tuples(spark, list(enumerate(labels)), edges[3:]))
    build.build(live.graph(), p, f"{tmp_path}/views/one")
    changes = [("+", *e) for e in edges[:3]] + [("-", *edges[5])]
    spark.createDataFrame(changes, "op string, src long, dst long").write.parquet(f"{tmp_path}/changes")
    stream = spark.readStream.schema("op string, src long, dst long").parquet(f"{tmp_path}/changes")
    live.follow(stream, f"{tmp_path}/ck").awaitTermination()
    now = [e for e in edges if e != edges[5]]
    want = len(matches(labels, now, p))
    assert match.count(live.graph(), p).first()["n"] == want
    assert ask(live.graph(), p, store.load_all(spark, f"{tmp_path}/views")) == want
    before = live.state()
    live.apply(spark.createDataFrame(changes, "op string, src long, dst long"), 0)  # a batch comes once
    assert live.state() == before


def test_stream_writes_the_graph_anew_now_and_then(spark, tmp_path):
    labels, edges = list(enumerate("abab")), [(0, 1), (1, 2)]
    live = LiveGraph(spark, f"{tmp_path}/live", f"{tmp_path}/views", most_deltas=2)
    live.start(text.from_tuples(spark, labels, edges))
    of = lambda *rows: spark.createDataFrame(rows, "op string, src long, dst long")
    now, folders = set(edges), []
    for n, (op, a, b) in enumerate([("+", 2, 3), ("-", 0, 1), ("+", 0, 3), ("+", 1, 0), ("-", 2, 3)]):
        live.apply(of((op, a, b)), n)
        e = (min(a, b), max(a, b))
        now = now | {e} if op == "+" else now - {e}
        assert {tuple(r) for r in text.to_tuples(live.graph())[1].collect()} == now
        folders.append(sorted(x for x in scratch.children(spark, f"{tmp_path}/live") if x[0] in "gd"))
    assert folders == [["d0", "g0"], ["d0", "d1", "g0"], ["g3"], ["d3", "g3"], ["d3", "d4", "g3"]]


def test_a_write_that_is_lost_leaves_the_old_state(spark, tmp_path, monkeypatch):
    g = text.from_tuples(spark, list(enumerate("ab")), [(0, 1)])
    view = build.build(g, Pattern("ab", [(0, 1)]), f"{tmp_path}/v")
    scratch.write_text(spark, f"{tmp_path}/v/meta.json.0123", "{")  # what a lost writer leaves beside it

    class Lost(Exception):
        pass

    def lost(*_):
        raise Lost

    with monkeypatch.context() as m:
        m.setattr(scratch, "_rename", lost)
        with pytest.raises(Lost):
            scratch.write_text(spark, f"{tmp_path}/v/meta.json", "{")
    assert store.load(spark, view.path).rows(0).count() == 1
    assert store.store_names(spark, str(tmp_path)) == ["v"]


def test_counters_add_up(spark, tmp_path):
    labels = list(enumerate("ababab"))
    edges = [(0, 1), (2, 3)]
    g = text.from_tuples(spark, labels, edges)
    view = build.build(g, Pattern("ab", [(0, 1)]), f"{tmp_path}/v")
    before = set(scratch.children(spark, scratch.folder(spark).rsplit("/", 1)[0]))
    for more in ([(0, 3)], [(4, 5), (4, 1)]):
        g = insert_edges(g, spark.createDataFrame(more, "src long, dst long"))
        view, _ = maintain.insert(view, g, spark.createDataFrame(more, "src long, dst long"))
    view, done = maintain.delete(store.load(spark, view.path), spark.createDataFrame([(4, 1), (4, 5)], "src long, dst long"))
    assert view.stats["maintenance"] == {"inserts": 2, "new_matches": 3, "deletes": 1, "lost_rows": done["lost_rows"]}
    assert set(scratch.children(spark, scratch.folder(spark).rsplit("/", 1)[0])) <= before  # nothing stays in the scratch folder


def test_cli(spark, tmp_path, capsys):
    rng = random.Random(4)
    labels, edges = random_graph(rng, 9, 2, 0.5)
    text.write_graph(text.from_tuples(spark, list(enumerate(labels)), edges), f"{tmp_path}/g")
    p = Pattern("aba", [(0, 1), (1, 2)])
    for d in ("q", "p"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "one.graph").write_text(p.text())
    want = len(matches(labels, edges, p))
    (tmp_path / "answers").write_text(f"one:{want}\n")
    assert cli.main(["materialize", "--data", f"{tmp_path}/g", "--view", f"{tmp_path}/p/one.graph", "--views", f"{tmp_path}/views"]) == 0
    assert cli.main(["answer", "--data", f"{tmp_path}/g", "--query", f"{tmp_path}/q/one.graph", "--views", f"{tmp_path}/views"]) == 0
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert out[0]["status"] == "built" and out[1]["count"] == want
    test = ["test", "--data", f"{tmp_path}/g", "--queries", f"{tmp_path}/q", "--patterns", f"{tmp_path}/p", "--answers", f"{tmp_path}/answers", "--views", f"{tmp_path}/tested", "--timeout", "60"]
    assert cli.main(test) == 0


def test_engine(spark, shop):
    engine = Engine(spark)
    assert engine.match(shop, commerce.PATTERNS["p05"]).count == 7
    assert engine.explain(shop, commerce.PATTERNS["p10"])["steps"][1]["choose"] == 3
    assert engine.estimate(shop, commerce.PATTERNS["p09"]) == 36


def test_a_stored_graph_holds_what_the_patterns_name(spark):
    """A relation reads one table of it, with some edges taken away as well."""
    whole = commerce.graph(spark, "/root/testdata/sf0.001")
    some = queries._local(whole, commerce.PATTERNS["p04"])
    named = {(commerce.O, commerce.P), (commerce.O, commerce.S), (commerce.P, commerce.S)}
    assert {tuple(r) for r in some.edges.select("src_label", "dst_label").distinct().collect()} == named | {(b, a) for a, b in named}
    for a, b in named:
        for x, y in ((a, b), (b, a)):
            assert {tuple(r) for r in some.relation(x, y).collect()} == {tuple(r) for r in whole.relation(x, y).collect()}
    gone = spark.createDataFrame([tuple(some.relation(commerce.O, commerce.P).first())], "src long, dst long")
    left = delete_edges(some, gone).relation(commerce.O, commerce.P)
    assert left.count() == whole.relation(commerce.O, commerce.P).count() - 1
    assert len({f.rsplit("/", 1)[0] for f in left.inputFiles()}) == 1
