"""Line dedup, similarity join, nearest neighbours, mixing, and the pipeline."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from quiltgraph.llm import jaccard, lines, links, mixing, nearest, quality, queries
from quiltgraph.llm.common import remainder

SF = "/root/testdata/sf0.001"


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


# lines


def plain_removals(rows, rule=lines.Rule()):
    first, seen = {}, []
    for i, text in sorted(rows):
        for k, line in enumerate((text or "").split("\n")):
            w = tuple(line.encode().lower().split())
            if len(w) >= rule.words or sum(len(x.decode()) for x in w) >= rule.chars:
                first.setdefault(w, (i, k))
                seen.append((i, k, w))
    long = sorted((p, w) for w, p in first.items() if len(w) >= rule.near)
    near = {w for x, (_, w) in enumerate(long) for _, v in long[:x] if lines.one_edit(list(v), list(w))}
    out = defaultdict(list)
    for i, k, w in seen:
        if w in near or first[w] != (i, k):
            out[i].append(k)
    return dict(out)


def test_lines_against_all_pairs(spark):
    rng = random.Random(3)
    base = [words(rng, rng.randint(3, 30)) for _ in range(12)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(4):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(w) + 1)
                what = rng.randrange(3)
                if what == 0:
                    w.insert(at, rng.choice(["new", w[at % len(w)]]))
                elif at < len(w) and len(w) > 1:
                    w[at : at + 1] = [] if what == 1 else [rng.choice(["other", "OTHER", "x"])]
            text.append(rng.choice([" ", "  "]).join(w))
        rows.append((i, "\n".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [int(x) for x in r["removed"].split(",")] for r in lines.report(df).collect() if r["removed"]}
    assert got == plain_removals(rows)
    for r in lines.dedup(df).collect():
        want = [line for k, line in enumerate(dict(rows)[r["doc_id"]].split("\n")) if k not in r["removed"]]
        assert r["text"] == "\n".join(want)


def test_lines_of_scripts_without_spaces_and_of_other_rules(spark):
    long = "日本語" * 20
    rows = [(0, f"{long}\nkurz"), (1, f"kurz\n{long}"), (2, "a b c\nd e f g"), (3, "d e f h\na b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rule in (lines.Rule(), lines.Rule(words=3, chars=4, near=4)):
        got = {r["doc_id"]: [int(x) for x in r["removed"].split(",")] for r in lines.report(df, rule=rule).collect() if r["removed"]}
        assert got == plain_removals(rows, rule)


def test_lines_of_odd_tables(odd_docs, no_docs):
    out = lines.report(odd_docs).collect()
    assert len(out) == 10 and [r["n_removed"] for r in out if r["doc_id"] in (4, 5)] == [0, 1, 1]
    assert [r["removed"] for r in out if r["doc_id"] is None] == ["0"]
    assert lines.report(no_docs).collect() == []
    assert set(lines.dedup(odd_docs).columns) == {*odd_docs.columns, "removed"}


def test_edit_distance():
    assert lines.one_edit([1, 2, 3], [1, 3]) and lines.one_edit([1, 2, 3], [1, 9, 3]) and lines.one_edit([], [1]) and lines.one_edit([1], [1])
    assert not lines.one_edit([1, 2, 3], [3, 2, 1]) and not lines.one_edit([1, 2], [2, 1]) and not lines.one_edit([1, 2, 3], [1])


# similarity join


def plain_classes(rows, measure):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + measure.width]) for k in range(len(w) - measure.width + 1)} if len(w) >= measure.width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= measure.percent * (len(sets[a]) + len(sets[b]) - shared):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80), (1, 50)])
def test_classes_against_all_pairs(spark, width, percent):
    rng = random.Random(width)
    base = [words(rng, rng.choice([2, 8, 30, 120, 400])) for _ in range(6)]
    rows = [(0, ""), (1, None), (2, "a"), (3, "a"), (4, "A b")]
    for i in range(5, 120):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(max(2, len(w) // 20))):
            w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    measure = jaccard.Measure(width, percent)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(df, measure).collect()}
    assert got == plain_classes(rows, measure)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for percent in (80, 90):
        measure = jaccard.Measure(3, percent)
        for n in (10, 11, 57, 300, 2000):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            k = measure.differences(len(a)) // 2
            b = np.unique(np.concatenate([a[: len(a) - k], rng.integers(0, 2**63, k, dtype=np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= percent * (len(a) + len(b) - shared) and k:
                assert np.intersect1d(measure.signatures(a)[0], measure.signatures(b)[0]).size


def test_every_layout_covers_its_differences():
    for k in range(1, 400):
        n1, n2, k2 = jaccard.shape(k)
        # spread over n1 partitions, k differences leave one with at most k2, and n2 - k2 of its cells are free of them
        assert k // n1 <= k2 < n2 and k2 >= 1


def test_pairs_of_a_group_of_near_copies_grow_in_proportion(spark, monkeypatch):
    counts, similar = [], jaccard.similar

    def counted(pairs, *rest):
        counts[-1] += pairs.count()
        return similar(pairs, *rest)

    monkeypatch.setattr(jaccard, "similar", counted)
    measure = jaccard.Measure(3, 90)
    for size in (150, 600):
        rng = random.Random(size)
        base = words(rng, 60)
        rows = []
        for i in range(size):
            w = list(base)
            for at in rng.sample(range(60), 2):
                w[at] = f"x{rng.randrange(40)}"
            rows.append((i, " ".join(w)))
        counts.append(0)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), measure).collect()}
        assert got == plain_classes(rows, measure)
    assert counts[1] <= 6 * max(counts[0], 150) and counts[1] <= 3 * 600


def test_every_link_is_followed_once(spark, monkeypatch):
    given, found, similar, components = [], [], jaccard.similar, jaccard.components

    def counted(*args):
        out = similar(*args)
        found.append(out.count())
        return out

    def followed(links):
        given.append(links.count())
        return components(links)

    monkeypatch.setattr(jaccard, "similar", counted)
    monkeypatch.setattr(jaccard, "components", followed)
    measure, rng = jaccard.Measure(3, 90), random.Random(4)
    base, rows = words(rng, 60), []
    for i in range(300):
        w = list(base)
        for at in rng.sample(range(60), 2):
            w[at] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), measure).collect()}
    assert got == plain_classes(rows, measure)
    assert len([n for n in found if n]) > 1 and sum(given) <= sum(found)


def test_long_sets_that_only_resemble_each_other_form_few_pairs(spark, monkeypatch):
    counts, made, similar, sets_of = [0], [0], jaccard.similar, jaccard.sets_of

    def counted(pairs, *rest):
        counts[0] += pairs.count()
        return similar(pairs, *rest)

    def making(*args):
        out = sets_of(*args)
        made[0] += out.count()
        return out

    monkeypatch.setattr(jaccard, "similar", counted)
    monkeypatch.setattr(jaccard, "sets_of", making)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(3000)]
    rows = []
    for i in range(30):
        w = list(base)
        for at in range(0, 3000, 50):
            if rng.random() < 0.17:
                w[at : at + 50] = [f"n{i}_{at}_{j}" for j in range(50)]
        rows.append((i, " ".join(w)))
    rows.append((30, " ".join(base[:1500] + ["new"] + base[1501:])))
    rows.append((31, " ".join(base[:2500] + ["other"] + base[2501:])))
    measure = jaccard.Measure()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), measure).collect()}
    assert got == plain_classes(rows, measure) and got[31][1] == got[30][1]
    assert counts[0] <= 100 and made[0] <= 2 * counts[0]  # of 496 pairs


def test_some_shared_signature_begins_an_allowed_chain():
    rng, measure = np.random.default_rng(3), jaccard.Measure()
    for n, several in ((40, 20), (300, 20), (3000, 5)):
        for _ in range(several):
            same = rng.integers(0, 2**63, n, dtype=np.uint64)
            gone = n * 10 // 90  # of either: just similar enough
            a, b = (np.unique(np.concatenate([same, rng.integers(0, 2**63, gone, dtype=np.uint64)])) for _ in "ab")
            assert 100 * n >= 80 * (len(a) + len(b) - n)
            (names_a, parts_a), (names_b, parts_b), at, begun, allowed = measure.signatures(a), measure.signatures(b), 0, 0, False
            assert measure.layout(len(a)) == measure.layout(len(b))
            for _, n1, n2, k2 in measure.layout(len(a)):
                each = len(list(combinations(range(n2), k2)))
                hit = np.flatnonzero(names_a[at : at + n1 * each] == names_b[at : at + n1 * each]) // each
                x, y = (jaccard.chains(p[begun : begun + n1], hit) for p in (parts_a, parts_b))
                bits = np.bitwise_count(x ^ y).sum(1)
                allowed |= bool((bits * 180 * n1 <= (len(a) + len(b)) * 20 * min(jaccard.CHAIN, n1)).any())
                at, begun = at + n1 * each, begun + n1
            assert allowed


def test_classes_of_odd_tables(odd_docs, no_docs):
    out = jaccard.classes(odd_docs).collect()
    assert len(out) == 10 and {r["component_id"] for r in out if r["doc_id"] in (4, 5, None)} == {4}
    assert all(r["component_id"] == r["doc_id"] and r["n_shingles"] == 0 for r in out if r["doc_id"] in (1, 2, 3))
    assert jaccard.classes(no_docs).collect() == []
    kept = jaccard.one_of_each(odd_docs)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8] and kept.columns == odd_docs.columns


def test_components(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in links.components(df).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# nearest neighbours


def test_recall_against_brute_force(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = sorted((r["vec_id"], r["embedding"]) for r in vectors.collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = defaultdict(list)
    for r in nearest.nearest(vectors).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        s = np.einsum("d,xd->x", x[q == ids][0], x)
        best = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        hits += len({ids[i] for i in best} & {v for v, _ in got[q]})
        total += 20
        assert len(got[q]) == 20 and [v for _, v in got[q]] == sorted((v for _, v in got[q]), reverse=True)
        assert all(score == pytest.approx(float(s[ids == v][0]), abs=1e-12) for v, score in got[q])
    assert hits / total >= 0.9


def test_nearest_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [3.0, 4.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    out = sorted(tuple(r) for r in nearest.nearest(df, k=3).collect())
    assert out == [(0, 1, 20, 3.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (20, 1, 3, 8.0), (20, 2, 0, 3.0), (20, 3, 1, 3.0)]
    assert nearest.nearest(df.where("false")).collect() == []


def plain_nearest(rows, k, every):
    """(query, rank, id, product) over distinct vectors of the query's length; a repeated query id asks with its least one."""
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = set()
    for q in {i for i, _ in rows if i % every == 0}:
        asked = min((len(v), v) for i, v in rows if i == q)[1]
        found = sorted((-float(np.dot(asked, v)), i) for i, v in rows if i != q and len(v) == len(asked))[:k]
        out |= {(q, rank + 1, i, -minus) for rank, (minus, i) in enumerate(found)}
    return out


def test_repeated_ids_and_other_lengths(spark):
    rng = random.Random(9)
    rows = [(i % 60, [float(rng.randint(-3, 3)) for _ in range(4 if i % 7 else 3)]) for i in range(150)]
    rows += [(20, [1.0, 2.0, 3.0, 4.0]), (20, [1.0, 2.0, 3.0, 4.0]), (40, [5.0]), (7, [2.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, query_id string, rank int")
    got = [tuple(r) for r in nearest.nearest(df, k=5).collect()]
    assert sorted(got) == sorted(plain_nearest(rows, 5, 20))


def test_chi_square():
    assert nearest.chi_square_quantile(2, 0.95) == pytest.approx(5.991, abs=1e-3) and nearest.chi_square_quantile(12, 0.95) == pytest.approx(21.026, abs=1e-3)


# mixing


def plain_targets(sizes):
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in sizes if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / free for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix_meets_targets(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(words(rng, rng.randint(0, 40))), rng.choice(["a"] * 12 + ["b", "c", "d", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    by = {i: (len(t.split()), s) for i, t, s in rows}
    sizes, taken, target = Counter(), Counter(), {}
    for r in out:
        size, source = by[r["doc_id"]]
        assert r["size"] == size and r["taken"] in (0, size, 2 * size, 3 * size)
        sizes[source] += size
        taken[source] += r["taken"]
        target[source] = r["target"]
    want = plain_targets(sizes)
    assert all(target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 120 for s in sizes)
    assert abs(sum(taken.values()) - sum(sizes.values())) <= 20  # half of the longest document
    assert Counter(r["doc_id"] for r in mixing.repeated(df).collect()) == Counter({r["doc_id"]: r["copies"] for r in out if r["copies"]})


def plain_copies(rows):
    """Copies of (id, size, source, place) by serving a plain sorted queue."""
    sizes = Counter()
    for _, n, s, _ in rows:
        sizes[s] += n
    target, queue = plain_targets(sizes), []
    for s in sizes:
        upto = 0
        for turn in range(3):
            for i, n, _, place in sorted((r for r in rows if r[2] == s), key=lambda r: r[3]):
                if n:
                    queue.append(((upto + n / 2) / target[s], s is None, s or "", place, i, n))
                upto += n
    copies, used = Counter({i: 1 for i, n, _, _ in rows if not n}), 0
    for *_, i, n in sorted(queue):
        if used + n / 2 > sum(sizes.values()):
            break
        copies[i] += 1
        used += n
    return copies


@pytest.mark.parametrize("uneven", [False, True])
def test_copies_against_a_plain_queue(spark, uneven):
    from pyspark.sql import functions as F

    rng = random.Random(11)
    rows = [(i, " ".join(words(rng, rng.randint(0, 60))), rng.choice(["a"] * 20 + ["b", "b", "c", None])) for i in range(900)]
    if uneven:  # one document outweighs the rest of its source
        rows = [(i, " ".join(["w"] * 10), "a") for i in range(10)] + [(10, " ".join(["w"] * 1000), "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    place = {r["doc_id"]: r["p"] for r in df.select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id", "text").alias("p")).collect()}
    want = plain_copies([(i, len(t.split()), s, place[i]) for i, t, s in rows])
    assert {r["doc_id"]: r["copies"] for r in mixing.mix(df).collect()} == {i: want[i] for i, _, _ in rows}
    assert not uneven or want[10] == 1


def test_mix_of_odd_tables(odd_docs, no_docs):
    out = mixing.mix(odd_docs).collect()
    assert len(out) == 10 and all(r["size"] == r["taken"] == 0 for r in out if r["doc_id"] in (1, 2, 3))
    assert mixing.mix(no_docs).collect() == []
    assert mixing.repeated(odd_docs).columns == odd_docs.columns


# pipeline


def plain_repeated(rows):
    """How often each (doc_id, text) is taken, by a plain queue; rows are (doc_id, text, source, place)."""
    sized = [(n, len((t or "").encode().split()), s, place) for n, (_, t, s, place) in enumerate(rows)]
    taken = plain_copies(sized)
    out = Counter()
    for n, (i, t, _, _) in enumerate(rows):
        out[i, t] += taken[n]
    return +out


def test_stages_against_plain_versions(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    good = corpus_pipeline.good_quality(spark, docs, SF).collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(quality.sampled(docs, labels, "quality", remainder("doc_id", 5) != 0))
    # the size difference of every text, piece by piece, with the dictionaries alone
    compress = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False).compress for d in (model.good, model.bad)]

    def plain_score(text):
        raw = (text or "").encode()
        good, bad = (sum(len(c(raw[at : at + quality.PIECE])) for at in range(0, len(raw), quality.PIECE)) for c in compress)
        return 1 / (1 + np.exp(-(model.slope * (bad - good) / (len(raw) + quality.SHRINK) + model.offset)))

    assert {r["doc_id"] for r in good} == {i for i, r in rows.items() if plain_score(r["text"]) >= corpus_pipeline.LEAST_SCORE}
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] in rows}
    kept = {r["doc_id"] for r in good}
    assert np.mean([i in kept for i, y in known.items() if y == 1]) > 0.97
    lean = {r["doc_id"]: r for r in corpus_pipeline.line_dedup(spark, docs, SF).collect()}
    gone = plain_removals([(i, r["text"]) for i, r in rows.items()])
    for i, r in rows.items():
        text = "\n".join(line for k, line in enumerate(r["text"].split("\n")) if k not in gone.get(i, []))
        assert (i in lean) == (i not in gone or bool(text.split())) and (i not in lean or (lean[i]["text"], lean[i]["n_chars"]) == (text, len(text)))
    classes = plain_classes([(i, r["text"]) for i, r in rows.items()], jaccard.Measure())
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == {c for _, c in classes.values()}
    place = {r["doc_id"]: r["p"] for r in docs.select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id", "text").alias("p")).collect()}
    want = plain_repeated([(i, r["text"], r["source"], place[i]) for i, r in rows.items()])
    assert Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.mixture(spark, docs, SF).collect()) == want
    library = Tokenizer.from_file(queries.word_bpe())
    library.no_truncation()
    library.no_padding()
    for r in corpus_pipeline.token_ids(spark, docs, SF).collect():
        ids = library.encode(rows[r["doc_id"]]["text"], add_special_tokens=False).ids
        assert (r["source"], r["n_tokens"], r["ids"]) == (rows[r["doc_id"]]["source"], len(ids), ids)
    assert [f(spark, docs, SF).columns for _, f in corpus_pipeline.STAGES[:-1]] == [list(corpus_pipeline.COLUMNS)] * 4


def test_stages_of_odd_tables(spark, odd_docs):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    from pyspark.sql import functions as F

    odd = odd_docs.union(odd_docs.where("doc_id is null")).union(odd_docs.where("doc_id = 6").selectExpr("doc_id + 10", "text", "lang", "source", "n_chars", "kinds", "score", "ids", "size"))
    rows = sorted(odd.collect(), key=repr)
    ids = lambda df: sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in df.collect())
    # the classifier looks at the text only: equal texts go or stay together, null and empty ones too
    kept = corpus_pipeline.good_quality(spark, odd, SF)
    assert kept.columns == list(corpus_pipeline.COLUMNS) and set(ids(kept)) <= {-1, *range(1, 9), 16}
    counts = Counter(ids(kept))
    assert (counts[4], counts[5], counts[-1]) in ((1, 2, 2), (0, 0, 0)) and counts[6] == counts[16] and counts[1] == counts[2]
    # of equal lines the first stays, null ids come last; what never had words stays
    lean = corpus_pipeline.line_dedup(spark, odd, SF)
    assert ids(lean) == [1, 2, 3, 4, 6, 7, 8] and all((r["text"] or "") == next(x["text"] or "" for x in rows if x["doc_id"] == r["doc_id"]) for r in lean.collect())
    # one of each group, of repeated ids one row, and all without an id
    one = corpus_pipeline.near_duplicates(spark, odd, SF)
    assert ids(one) == [-1, -1, 1, 2, 3, 4, 6, 7, 8]
    # the mix takes what a plain queue takes, null sources as one of their own
    place = [r["p"] for r in odd.select("doc_id", "text", "source", F.xxhash64(F.lit(mixing.SEED), "doc_id", "text").alias("p"), *[c for c in odd.columns[3:] if c != "source"]).collect()]
    plain = [(r["doc_id"], r["text"], r["source"], p) for r, p in zip(odd.collect(), place)]
    mixed = corpus_pipeline.mixture(spark, odd, SF)
    assert Counter((r["doc_id"], r["text"]) for r in mixed.collect()) == plain_repeated(plain) and mixed.columns == list(corpus_pipeline.COLUMNS)
    # every row is encoded
    encoded = corpus_pipeline.token_ids(spark, odd, SF)
    assert ids(encoded) == ids(odd) and encoded.columns == ["doc_id", "source", "n_tokens", "ids"]
    assert all(r["n_tokens"] == len(r["ids"]) and (r["n_tokens"] > 0) == (r["doc_id"] not in (1, 2, 3)) for r in encoded.collect())


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids"] and out.count() > 100


def test_pipeline_of_an_empty_table(spark, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF).collect() == []
