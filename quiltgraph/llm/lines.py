"""Line dedup by a deletion-neighbourhood join.

Lines are compared as sequences of words with A-Z in lower case.  A line goes
if an earlier one, by document id and line number, is equal to it or, for
lines of enough words, at most one word away (replaced, added or left out).
Lines of few words and few characters stay; Rule says how many are few.

Equal lines meet by hash.  For the others, a line and its neighbour share the
half that the edit is not in, so only lines of which another line has a half
can have one.  Those emit their deletion neighbourhood, the line itself and
the line without each of its words, as hashed keys; equal keys name the
earliest line as partner, and the edit distance is verified.

Hashes of word runs are differences of running polynomial sums modulo 2^64
over 64-bit word hashes, so a batch of texts takes a few array operations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bit_filter, dropped, mixed, passes, signed, stored, word_hashes

BASE, OTHER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: A place is id * WIDE + line number.
WIDE = 10**10
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Rule:
    """A line may go if it has ``words`` words, or ``chars`` characters in them as in scripts without spaces; for a near line if it has ``near`` words."""

    words: int = 5
    chars: int = 40
    near: int = 10

    def takes(self, words: list[bytes]) -> bool:
        return len(words) >= self.words or len(b"".join(words).decode("utf-8", "surrogatepass")) >= self.chars


class Runs:
    """hash(i, j) of the words i..j-1 of one array of word hashes, for arrays i and j."""

    def __init__(self, words: np.ndarray, base: int):
        n = len(words)
        power = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, np.uint64(b))]))
        self.inverse = power(pow(base, -1, 1 << 64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power(base)[:n], dtype=np.uint64)])
        self.one = np.uint64(pow(base, -1, 1 << 64))

    def hash(self, i, j) -> np.ndarray:
        return mixed((self.sums[j] - self.sums[i]) * self.inverse[i])

    def without(self, i, j, k) -> np.ndarray:
        """The same of the words i..j-1 but for k."""
        return mixed((self.sums[k] - self.sums[i] + (self.sums[j] - self.sums[k + 1]) * self.one) * self.inverse[i])


class Lines:
    """The lines of a batch of texts that may go: text number, line number, and their words in one array."""

    def __init__(self, texts: list[str | None], rule: Rule):
        self.text: list[int] = []
        self.number: list[int] = []
        sizes, words = [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            for k, line in enumerate(t.encode("utf-8", "surrogatepass").lower().split(b"\n")):
                w = line.split()
                if rule.takes(w):
                    self.text.append(i)
                    self.number.append(k)
                    sizes.append(len(w))
                    words += w
        self.size = np.array(sizes, np.int64)
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.words = word_hashes(words)
        self.runs, other = Runs(self.words, BASE), Runs(self.words, OTHER)
        self.h1, self.h2 = signed(self.runs.hash(self.start, self.end)), signed(other.hash(self.start, self.end))

    def halves(self) -> np.ndarray:
        """Four keys a line: both halves as a line of its size is cut, and as one a word shorter is."""
        out = []
        for less in (0, 1):
            size = self.size - less
            cut = size // 2
            for side, (i, j) in enumerate(((self.start, self.start + cut), (self.end - (size - cut), self.end))):
                out.append(mixed(self.runs.hash(i, j) + (size * 2 + side).astype(np.uint64) * np.uint64(OTHER)))
        return signed(np.stack(out, 1))


def occurrences(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, rid, number, h1, h2, halves of every line that may go, for docs(doc_id, rid, text)."""

    def make():
        def step(c):
            lines = Lines(c["text"], rule)
            if not lines.text:
                return None
            halves = [h if n >= rule.near else None for h, n in zip(list(lines.halves()), lines.size)]
            return [[c["doc_id"][i] for i in lines.text], [c["rid"][i] for i in lines.text], lines.number, lines.h1, lines.h2, halves]

        return step

    return arrow_map(docs, make, "doc_id long, rid long, number int, h1 long, h2 long, halves array<long>")


def words_of(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """h1, h2 and the word hashes of the lines in wanted(h1, h2), where a task meets them first, and maybe of others."""
    held = bit_filter(wanted.select("h1"))

    def make():
        seen, bits = set(), held.value

        def step(c):
            lines = Lines(c["text"], rule)
            a, b, words = [], [], []
            for i in np.flatnonzero(passes(bits, lines.h1) & (lines.size >= rule.near)):
                both = int(lines.h1[i]), int(lines.h2[i])
                if both not in seen:
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(both)
                    a.append(both[0])
                    b.append(both[1])
                    words.append(signed(lines.words[lines.start[i] : lines.end[i]]))
            return [a, b, words]

        return step

    return arrow_map(docs.select("text"), make, "h1 long, h2 long, words array<long>")


def variants(lines: DataFrame) -> DataFrame:
    """key, gone, size of the deletion neighbourhood of each line(place, words); gone is -1 for the line itself."""

    def make():
        def step(c):
            keys, gone, sizes, places = [], [], [], []
            for place, words in zip(c["place"], c["words"]):
                w = np.array(words, np.int64).view(np.uint64)
                n = len(w)
                runs, k = Runs(w, BASE), np.arange(n)
                zero = np.zeros(n, np.int64)
                keys.append(runs.hash(zero[:1], zero[:1] + n))
                keys.append(runs.without(zero, zero + n, k))
                gone.append(np.arange(-1, n))
                sizes.append(np.full(n + 1, n))
                places += [place] * (n + 1)
            if not places:
                return None
            return [signed(np.concatenate(keys)), np.concatenate(gone).astype(np.int32), np.concatenate(sizes).astype(np.int32), places]

        return step

    return arrow_map(lines.select(F.col("place").cast("string").alias("place"), "words"), make, "key long, gone int, size int, place string").withColumn("place", F.col("place").cast("decimal(30,0)"))


def one_edit(a: list[int], b: list[int]) -> bool:
    """Whether two word sequences are at most one word apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def near(docs: DataFrame, found: DataFrame, first: DataFrame, rule: Rule) -> DataFrame:
    """place of every distinct line whose first occurrence has an earlier line one word away."""
    halves = found.where("halves is not null").select("h1", "h2", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("least"), F.max("h1").alias("most")).where("least < most").select("half")
    wanted = stored(halves.join(shared, "half", "left_semi").select("h1", "h2").distinct().join(first, ["h1", "h2"]).select("h1", "h2", "place"))
    lines = stored(words_of(docs, wanted, rule).join(wanted, ["h1", "h2"]).select("place", "words").dropDuplicates(["place"]))
    keys = stored(variants(lines))
    whole = F.col("gone") < 0
    # a whole line and one without a word: one is the other plus a word
    plus = stored(keys.groupBy("key").agg(F.min(F.when(whole, F.col("place"))).alias("longest"), F.min(F.when(~whole, F.col("place"))).alias("shortened")).where("longest is not null and shortened is not null"))
    # both without the word at the same place: one word replaced
    same = stored(keys.where(~whole).groupBy("key", "gone", "size").agg(F.min("place").alias("partner"), F.max("place").alias("most")).where("partner < most").drop("most"))
    one = keys.join(plus, "key").select("place", F.when(whole, F.col("shortened")).otherwise(F.col("longest")).alias("partner"))
    two = keys.where(~whole).join(same, ["key", "gone", "size"]).select("place", "partner")
    pairs = stored(one.union(two).where("partner < place").distinct())
    other = lines.select(F.col("place").alias("partner"), F.col("words").alias("others"))
    both = pairs.join(lines, "place").join(other, "partner").select(F.col("place").cast("string").alias("place"), "words", "others")

    def make():
        return lambda c: [[one_edit(a, b) for a, b in zip(c["words"], c["others"])]]

    out = stored(arrow_map(both, make, "near boolean", ("place",)).where("near").select(F.col("place").cast("decimal(30,0)").alias("place")).distinct())
    for table in (wanted, lines, keys, plus, same, pairs):
        dropped(table)
    return out


def removals(docs: DataFrame, id: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """doc_id, rid and the sorted numbers (from 0) of the lines that go, for documents that lose some.

    rid is xxhash64 of the text, so that rows which share an id but not the
    text are told apart; lines at one place of rows with the same id don't
    remove each other.  Of equal lines the first by place stays, so ties don't
    occur.  Null ids come last.  Null texts have no lines, empty ones a line
    without words, which stays; very long texts are read whole; other columns
    are ignored.
    """
    own = docs.select(F.col(id).alias("doc_id"), F.xxhash64(F.col(text)).alias("rid"), F.col(text).alias("text"))
    found = stored(occurrences(own, rule).withColumn("place", (F.coalesce("doc_id", F.lit(LAST)).cast("decimal(19,0)") * F.lit(WIDE).cast("decimal(11,0)") + F.col("number").cast("decimal(10,0)")).cast("decimal(30,0)")))
    first = stored(found.groupBy("h1", "h2").agg(F.min("place").alias("place")))
    close = near(own, found, first, rule)
    kept = stored(first.join(close.withColumn("near", F.lit(True)), "place", "left").select("h1", "h2", F.col("place").alias("first"), F.coalesce("near", F.lit(False)).alias("near")))
    gone = found.select("doc_id", "rid", "number", "h1", "h2", "place").join(kept, ["h1", "h2"]).where("near or place <> first")
    out = stored(gone.groupBy("doc_id", "rid").agg(F.sort_array(F.collect_set("number")).alias("removed")))
    for table in (found, first, close, kept):
        dropped(table)
    return out


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """Every row of docs, its text without the lines that go, and removed array<int>.

    Lines that stay, and the line breaks between them, are as they were; a
    text all of whose lines go is empty; null stays null.  A column named
    removed is replaced.
    """
    gone = removals(docs, id, text, rule).select(F.col("doc_id").alias("_id"), F.col("rid").alias("_rid"), F.col("removed").alias("_removed"))
    base = docs.drop("removed").withColumn("_rid0", F.xxhash64(F.col(text)))
    joined = base.join(gone, F.col(id).eqNullSafe(F.col("_id")) & (F.col("_rid0") == F.col("_rid")), "left")
    stay = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda l, i: ~F.array_contains(F.col("_removed"), i)), "\n")
    out = joined.withColumn(text, F.when(F.col("_removed").isNull(), F.col(text)).otherwise(stay))
    return out.withColumn("removed", F.coalesce("_removed", F.array().cast("array<int>"))).drop("_id", "_rid", "_rid0", "_removed")


def report(docs: DataFrame, id: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines, n_removed and the removed numbers joined by commas."""
    gone = removals(docs, id, text, rule).select(F.col("doc_id").alias("_id"), F.col("rid").alias("_rid"), "removed")
    own = docs.select(F.col(id).alias("doc_id"), F.xxhash64(F.col(text)).alias("rid"), F.when(F.col(text).isNull(), 0).otherwise(F.size(F.split(F.col(text), "\n"))).cast("long").alias("n_lines"))
    joined = own.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("rid") == F.col("_rid")), "left")
    return joined.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"))
