"""Similarity join of documents on word n-grams, by PartEnum signatures.

Sets whose sizes fall into one band, or neighbouring bands, and whose Jaccard
similarity reaches the threshold differ in at most k elements.  The domain of
shingles is hashed into n1 partitions of n2 cells each.  Some partition holds
at most k2 = (k + 1) / n1 - 1 of the differences, so at least n2 - k2 of its
cells hold none: every subset of n2 - k2 cells, with its band and place, is a
signature, and similar sets share one in a partition that differs in at most
k2.  Subsets of several cells name more elements than a single cell would, so
sets that merely resemble each other seldom share one.

Equal sets are one node from the start.  Nodes of a group, that is of one
signature, take turns by a hash: in every round those whose turn has come are
held against the ones that come later, unless both are in one component
already.  The first partition's signatures go first, so that sets that share
many are mostly joined by one.  Before a pair is formed, parity sketches must
allow it, of the signature's partition and of the chain of partitions that it
begins: of their bits no more can differ than elements do.  Of partitions in a
ring, with d differences in all, one begins chains that hold at most d * l / n1
of them, for every length l: it follows the partition up to which the sum of
differences less d / n1 is largest.  So no link is lost, and sets that only
resemble each other seldom pass, however long they are.  Pairs that are formed
are decided on the whole sets, and only theirs are made.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, bit_filter, dropped, mixed, passes, shingles, signed, stored, word_hashes
from .links import components

#: Nodes whose signatures a task remembers to have given.
SEEN = 500_000
#: Partitions of a chain, and 64-bit words of its sketch.
CHAIN, SKETCH = 16, 4
#: Most cells of a partition and differences it may hold, and the signatures of a set for each of k + 2, but at least FEW.
CELLS, HELD, RATE, FEW = 6, 2, 1.5, 12
#: Shares in which signatures are counted one after another, which bounds what is shuffled at once.
SLICES = 2
#: Nodes of a group that meet in their turn in the first round, how this grows from round to round, and nodes that a task holds against them.
TURN, GROWTH, PART = 2, 8, 4096


def shape(k: int) -> tuple[int, int, int]:
    """n1, n2 and k2 for sets that differ in at most k elements: of those with few enough signatures, the one whose signatures name most."""
    most = max(FEW, RATE * (k + 2))
    found = []
    for k2 in range(1, min(k, HELD) + 1):
        n1 = -(-(k + 1) // (k2 + 1))
        found += [((n2 - k2) / (n1 * n2), -n1 * comb(n2, k2), n1, n2, k2) for n2 in range(k2 + 1, CELLS + 1) if n1 * comb(n2, k2) <= most]
    return max(found)[2:]


@dataclass(frozen=True)
class Measure:
    """Shingles of ``width`` words; sets link when 100 * intersection >= percent * union."""

    width: int = 5
    percent: int = 80

    def bands(self, size: int) -> list[tuple[int, int]]:
        """(number, largest size) of the band of a set of this size and of the next band."""
        number, low = 0, 1
        while True:
            high = max(low, 100 * low // self.percent)
            if size <= high:
                after = high + 1
                return [(number, high), (number + 1, max(after, 100 * after // self.percent))]
            number, low = number + 1, high + 1

    def differences(self, largest: int) -> int:
        """The most elements in which two similar sets of up to ``largest`` can differ."""
        return 2 * largest * (100 - self.percent) // (100 + self.percent)

    def layout(self, size: int) -> list[tuple[int, int, int, int]]:
        """Band, n1, n2 and k2 for each of the two bands; none where only equal sets are similar, since those are one node."""
        return [(number, *shape(k)) for number, largest in self.bands(size) if (k := self.differences(largest))]

    def signatures(self, shingled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All signatures, partition by partition, and the parity sketch of every partition, in the order of layout()."""
        names, parts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for number, n1, n2, k2 in self.layout(len(shingled)):
            seed = mixed(np.array([number + 1], np.uint64))
            m = mixed(shingled ^ seed)
            cell = ((m >> np.uint64(32)) * np.uint64(n1 * n2) >> np.uint64(32)).astype(np.int64)
            m = mixed(m)
            low = np.bincount(cell, (m & np.uint64(0xFFFFFFFF)).astype(np.float64), n1 * n2).astype(np.uint64)
            high = np.bincount(cell, (m >> np.uint64(32)).astype(np.float64), n1 * n2).astype(np.uint64)
            cells = mixed(mixed(low + (high << np.uint64(20)) * np.uint64(0x9E3779B97F4A7C15)) ^ mixed(seed + np.arange(n1 * n2, dtype=np.uint64))).reshape(n1, n2)
            # a subset is named by the sum of its cells' names: that of the whole partition less the cells left out
            out = np.stack([cells.sum(1, dtype=np.uint64) - cells[:, list(left)].sum(1, dtype=np.uint64) for left in combinations(range(n2), k2)], 1)
            kind = mixed(np.uint64(0x5EED) + np.arange(out.shape[1], dtype=np.uint64))
            names.append(mixed(out ^ kind[None, :]).ravel())
            odd = np.bincount(cell // n2 * 64 + (m >> np.uint64(58)).astype(np.int64), minlength=n1 * 64) & 1
            parts.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
        return np.concatenate(names), np.concatenate(parts)


def lowered(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def node_of(shingled: np.ndarray) -> np.ndarray:
    """A 64-bit name of a set, from all its elements and their number."""
    return mixed(shingled.sum(dtype=np.uint64) + mixed(np.bitwise_xor.reduce(mixed(shingled + np.uint64(7)))[None] + np.uint64(len(shingled))))


def chains(parts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row for each start: the parity sketch of the chain that begins there, of up to CHAIN of the partitions in a ring."""
    steps = np.arange(-(-min(CHAIN, len(parts)) // SKETCH) * SKETCH)
    each = parts[(starts[:, None] + steps) % len(parts)]
    each[:, steps >= len(parts)] = 0
    return np.bitwise_xor.reduce(each.reshape(len(starts), len(steps) // SKETCH, SKETCH), 1)


def signed_sets(docs: DataFrame, measure: Measure) -> DataFrame:
    """doc_id, n_shingles, node and, where a task meets the node first, signatures and sketches; node is null for an empty set.

    The lowest bit of a signature says whether it is of the set's own band.
    """

    def make():
        seen: set[int] = set()

        def step(c):
            out: tuple[list, ...] = ([], [], [], [])
            for t in c["text"]:
                s = shingles(word_hashes(lowered(t)), measure.width)
                node = int(signed(node_of(s))[0]) if len(s) else None
                cells = parts = None
                if node is not None and node not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                    cells, parts = measure.signatures(s)
                    own = measure.bands(len(s))[0][0]
                    own = sum(n1 * comb(n2, k2) for number, n1, n2, k2 in measure.layout(len(s)) if number == own)
                    cells = signed(cells) & -2
                    cells[:own] |= 1
                for o, v in zip(out, (len(s), node, cells, parts)):
                    o.append(v)
            return list(out)

        return step

    return arrow_map(docs, make, "n_shingles long, node long, signatures array<long>, parts array<long>", ("doc_id",))


def groups_of(first: DataFrame, measure: Measure) -> DataFrame:
    """Signatures that several nodes have, of the own band of one at least: signature, node, n, n1, own, lead, part and s0, ...

    n is the set's size and n1 the number of the band's partitions; own says
    whether the band is the set's own, lead whether the partition is the band's
    first; part and s0, ... are the sketches of the partition and of its chain.
    """
    own = first.where("signatures is not null").select("node", "n_shingles", "signatures", "parts")
    several = []
    for part in range(SLICES):
        # a partial sum meets hot signatures before the shuffle
        each = own.select(F.explode(F.filter("signatures", lambda s: F.pmod(F.shiftright(s, 1), F.lit(SLICES)) == part)).alias("s"))  # noqa: B023
        count = each.groupBy(F.col("s").bitwiseAND(F.lit(-2)).alias("signature")).agg(F.count("*").alias("n"), F.max(F.col("s").bitwiseAND(F.lit(1))).alias("own"))
        several.append(stored(count.where("n > 1 and own = 1").select("signature")))
    held = bit_filter(reduce(DataFrame.union, several))
    for table in several:
        dropped(table)

    def make():
        bits = held.value

        def step(c):
            out: tuple[list, ...] = ([], [], [], [], [], [], [], [])
            for node, size, names, parts in zip(c["node"], c["n_shingles"], c["signatures"], c["parts"]):
                names, parts, at, begun = np.array(names, np.int64), np.array(parts, np.int64), 0, 0
                hits = passes(bits, names & -2)
                for _, n1, n2, k2 in measure.layout(size) if hits.any() else ():
                    each = comb(n2, k2)
                    hit = np.flatnonzero(hits[at : at + n1 * each])
                    here, ring = names[at + hit], parts[begun : begun + n1]
                    at, begun, starts = at + n1 * each, begun + n1, hit // each
                    many = len(hit)
                    for o, v in zip(out, (here & -2, np.full(many, node), np.full(many, size, np.int32), np.full(many, n1, np.int32), (here & 1) == 1, starts == 0, ring[starts], chains(ring, starts))):
                        o.append(v)
            if not out[0]:
                return None
            *narrow, wide = [np.concatenate(o) for o in out]
            return [*narrow, *np.ascontiguousarray(wide.T)]

        return step

    words = "".join(f", s{i} long" for i in range(SKETCH))
    return arrow_map(own, make, f"signature long, node long, n int, n1 int, own boolean, lead boolean, part long{words}").dropDuplicates(["signature", "node"])


def sets_of(docs: DataFrame, measure: Measure, wanted: DataFrame) -> DataFrame:
    """node and its shingles, of the nodes in wanted(node, doc_id), where a task meets them first.

    A filter over one document of each node spares other texts the hashing;
    the join settles what it lets through.
    """
    held = bit_filter(wanted.select(F.xxhash64("doc_id").alias("hash")))

    def make():
        bits, seen = held.value, set()

        def step(c):
            nodes, sets = [], []
            for at in np.flatnonzero(passes(bits, np.array(c["hash"], np.int64))):
                s = shingles(word_hashes(lowered(c.part.column("text")[at].as_py())), measure.width)
                node = int(signed(node_of(s))[0]) if len(s) else None
                if node is not None and node not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                    nodes.append(node)
                    sets.append(signed(s))
            return [nodes, sets]

        return step

    found = arrow_map(docs.withColumn("hash", F.xxhash64("doc_id")).select("text", "hash"), make, "node long, shingles array<long>")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def similar(pairs: DataFrame, sets: DataFrame, measure: Measure) -> DataFrame:
    """The rows of pairs(a, b) whose sets reach the similarity, decided on the whole sets."""
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("first")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("second"))
    both = pairs.join(left, "a").join(right, "b")
    shared = both.select("a", "b", (F.size("first") + F.size("second")).alias("all"), F.size(F.array_intersect("first", "second")).alias("shared"))
    return shared.where(F.col("shared") * 100 >= (F.col("all") - F.col("shared")) * measure.percent).select("a", "b")


def plausible(measure: Measure) -> Column:
    """Whether the columns of a and b that members have allow the similarity.

    Sets that reach it differ in at most (100 - percent) / (100 + percent) of
    their joint size, and in some shared signature's partition, and the chain
    that it begins, in at most the partitions' share of that; their sketches
    differ in no more bits.
    """
    differing = lambda c: F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}")))
    bits = reduce(lambda x, y: x + y, [differing(f"s{i}") for i in range(SKETCH)])
    sizes = F.least("a_n", "b_n") * F.lit(100) >= F.greatest("a_n", "b_n") * F.lit(measure.percent)
    most = (F.col("a_n") + F.col("b_n")).cast("long") * (100 - measure.percent)
    share = F.col("a_n1").cast("long") * (100 + measure.percent)
    return sizes & (F.col("a_own") | F.col("b_own")) & (differing("part") * share <= most) & (bits * share <= most * F.least(F.lit(CHAIN), "a_n1"))


def turns(groups: DataFrame) -> DataFrame:
    """groups with turn and parts, for signatures of several nodes only: the turn is spread evenly over 0 to the group's size, by a hash of the node."""
    sizes = groups.groupBy("signature").agg(F.count("*").alias("size")).where("size > 1")
    share = F.shiftrightunsigned(F.xxhash64("node"), 11) / float(1 << 53)
    out = groups.join(sizes, "signature").withColumn("turn", (share * F.col("size")).cast("float"))
    return out.withColumn("parts", F.ceil(F.col("size") / PART).cast("int")).drop("size")


def formed(rest: DataFrame, low: float, high: float, measure: Measure) -> DataFrame:
    """The plausible pairs(a, b) of nodes whose turn is from low up to high with those of a later turn, in different components.

    A group of many nodes is dealt into parts, and the nodes whose turn it is are held against each part.
    """
    told = ["n", "n1", "own", "part", *(f"s{i}" for i in range(SKETCH)), "turn", "component"]
    side = lambda df, x: df.select("signature", "deal", F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in told])
    heads = rest.where((F.col("turn") >= low) & (F.col("turn") < high)).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    others = rest.where(F.col("turn") >= low).withColumn("deal", F.pmod(F.xxhash64(F.lit("deal"), "node"), F.col("parts")).cast("int"))
    both = side(heads, "a").join(side(others, "b"), ["signature", "deal"])
    later = (F.col("a_turn") < F.col("b_turn")) | ((F.col("a_turn") == F.col("b_turn")) & (F.col("a") < F.col("b")))
    return both.where(later & (F.col("a_component") != F.col("b_component")) & plausible(measure)).select("a", "b").distinct()


def merged(joined: DataFrame | None, found: DataFrame) -> DataFrame:
    """Stored: node and component of every node of joined(node, component) and of the links found(a, b).

    Only the new links are followed, between the components that they join.
    """
    if joined is None:
        return components(found)
    of = lambda x: joined.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    named = found.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    names = components(named)
    # names of components are nodes: of those that joined has, or new ones
    renamed = names.select(F.col("node").alias("component"), F.col("component").alias("new"))
    old = joined.join(renamed, "component", "left").select("node", F.coalesce("new", "component").alias("component"))
    out = stored(old.union(names.join(joined.select("node"), "node", "left_anti").select("node", "component")))
    dropped(names)
    return out


def linked(members: DataFrame, docs: DataFrame, nodes: DataFrame, measure: Measure) -> DataFrame:
    """node and component of every node in a verified link, over members(signature, node, n, n1, own, lead, part, s0, ..., turn, parts) and nodes(node, doc_id).

    Two nodes of a group meet in the round of the one whose turn is earlier, so
    every pair that the sketches allow is decided, but for those that are in
    one component by then.  A group is left when all of its nodes are in one
    component, or each has had its turn.  The set of a node is made when a pair
    needs it first.
    """
    joined, sets = None, []
    for lead in (True, False):
        rest, low, high = members.where(F.col("lead") == lead), 0.0, float(TURN)
        own: list[DataFrame] = []
        while True:
            named = rest.withColumn("component", F.col("node")) if joined is None else rest.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
            named = stored(named)
            open_ = named.groupBy("signature").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("turn").alias("last"))
            open_ = stored(open_.where((F.col("x") != F.col("y")) & (F.col("last") >= low)).select("signature"))
            for table in own:
                dropped(table)
            if open_.isEmpty():
                for table in (named, open_):
                    dropped(table)
                break
            here = stored(named.join(open_, "signature", "left_semi"))
            for table in (named, open_):
                dropped(table)
            pairs = stored(formed(here, low, high, measure))
            if not pairs.isEmpty():
                asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
                for table in sets:
                    asked = asked.join(table.select("node"), "node", "left_anti")
                asked = stored(asked.join(nodes, "node"))
                if not asked.isEmpty():
                    sets.append(stored(sets_of(docs, measure, asked)))
                found = stored(similar(pairs, reduce(DataFrame.union, sets), measure))
                if not found.isEmpty():
                    was, joined = joined, merged(joined, found)
                    dropped(was)
                for table in (asked, found):
                    dropped(table)
            dropped(pairs)
            rest, own = here.drop("component"), [here]
            low, high = high, high * GROWTH
    for table in sets:
        dropped(table)
    return joined if joined is not None else members.select("node", F.col("node").alias("component")).where("false")


def classes(docs: DataFrame, measure: Measure = Measure(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id.

    component_id is the least doc_id among the documents reachable by links of
    similar sets, itself included.  A null, empty or wordless text has an empty
    set and is its own component; repeated rows share a component; rows with a
    null id take part and never name a component that holds other ids.  Other
    columns are ignored.
    """
    docs = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    first = stored(signed_sets(docs, measure))
    rows = stored(first.select("doc_id", "n_shingles", "node"))
    found = stored(groups_of(first, measure))
    dropped(first)
    members = stored(turns(found))
    dropped(found)
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    joined = linked(members, docs, nodes, measure)
    alone = rows.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    whole = stored(rows.where("node is not null").join(joined, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("node")))
    names = stored(whole.groupBy("node").agg(F.min("doc_id").alias("component_id")))
    for table in (members, joined):
        dropped(table)
    return whole.join(names, "node").select("doc_id", "n_shingles", "component_id").union(alone)


def one_of_each(docs: DataFrame, measure: Measure = Measure(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose id is the least of its component.

    Of several rows with that id the one with the least text stays, nulls
    first; rows with a null id all stay.
    """
    kept = classes(docs, measure, id, text).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_id")).distinct()
    first = Window.partitionBy(id).orderBy(text)
    rows = docs.where(F.col(id).isNotNull()).join(kept, F.col(id) == F.col("_id"), "left_semi")
    return rows.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth").union(docs.where(F.col(id).isNull()))
