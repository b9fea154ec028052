"""Language-model scores from class-based bigrams.

p(word | before) = p(class | class before) * p(word | class).  Exchange
clustering assigns words to classes in two steps.  The first deals items: the
most frequent words are items of their own, and all other words fall into
items by their ending.  The second takes every further word met LEAST times or
more, however many there are, and moves it by its own neighbours to the class
that raises the likelihood most; words are moved side by side, each against
the classes of the first step.  Only rarer and unseen words keep the class of
their ending.  Word counts, neighbours and class statistics come from the whole
training corpus; only tables bounded by the number of items or of frequent
words reach the driver.

A word's count is needed for its emission probability, and its class for the
transitions.  Those of the FREQUENT most frequent words are sent to every task;
those of all other words are joined by hash, where no key is hot since the
frequent words are out.

Texts are split into words twice: to count them, and to write them as numbers,
which all later passes read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bit_filter, dropped, get, passes, sent, signed, stored

#: Words that are items, items of endings, classes, and rounds of exchange.
WORDS, ENDINGS, CLASSES, ROUNDS = 1024, 1024, 64, 6
#: Fewest times that a word is met to be given a class of its own.
LEAST = 5
#: Words whose counts and classes every task holds.
FREQUENT = 1 << 17
#: Words of a task's tables before they are emptied.
HELD = 250_000
#: Tokens whose pairs are counted at once.
STRIDE = 1 << 20
#: The end of a text as a word; no word holds a line break.
END = b"\n"


def word_hash():
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest


def ending(word: bytes) -> int:
    """The item of a word by its last three bytes, from 0 to ENDINGS - 1."""
    return int.from_bytes(word[-3:], "little") * 2654435761 % (1 << 32) * ENDINGS >> 32


def tokens(text: str | None) -> list[bytes]:
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def counted(docs: DataFrame) -> DataFrame:
    """hash, ending, count of every distinct token of docs(text)."""

    def make():
        digest, held = word_hash(), Counter()

        def out():
            words = list(held)
            rows = [signed(np.fromiter(map(digest, words), np.uint64, len(words))), list(map(ending, words)), list(held.values())]
            held.clear()
            return rows

        def step(c):
            if c is None:
                return out() if held else None
            for t in c["text"]:
                held.update(tokens(t))
            return out() if len(held) > HELD else None

        return step

    rows = arrow_map(docs.select("text"), make, "hash long, ending int, count long", flush=True)
    return rows.groupBy("hash").agg(F.min("ending").alias("ending"), F.sum("count").alias("count"))


class Codes(dict):
    """word -> its number among the frequent words, or after these a number in the tail met so far."""

    def __init__(self, frequent: np.ndarray):
        super().__init__()
        self.digest = word_hash()
        self.place = {h: i for i, h in enumerate(frequent.tolist())}
        self.first = len(frequent)
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.hashes: list[int] = []
        self.endings: list[int] = []

    def __missing__(self, word: bytes) -> int:
        h = self.digest(word)
        h -= (h >> 63) << 64
        code = self.place.get(h)
        if code is None:
            code = self.first + len(self.hashes)
            self.hashes.append(h)
            self.endings.append(ending(word))
        self[word] = code
        return code


@dataclass
class Vocabulary:
    """Frequent words by falling count: hashes, counts and their items; sums over the corpus."""

    hashes: np.ndarray
    counts: np.ndarray
    items: np.ndarray
    total: int
    distinct: int


def vocabulary(counts: DataFrame) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("count"), "hash").limit(FREQUENT).toArrow()
    number = np.arange(top.num_rows)
    ends = top.column("ending").to_numpy().astype(np.int64)
    return Vocabulary(top.column("hash").to_numpy(), top.column("count").to_numpy(), np.where(number < WORDS, number, WORDS + ends), int(total), int(distinct))


def encoded(columns: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Stored: the columns but for text, with codes and tail.

    codes holds a 32-bit number for each token, a frequent word's place in the
    vocabulary or -1 - the ending of another word; tail holds those words' hashes.
    """
    held = sent(columns.sparkSession, vocab.hashes)

    def make():
        codes = Codes(get(held))

        def step(c):
            out: tuple[list, list] = ([], [])
            for t in c["text"]:
                words = tokens(t)
                code = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
                at = np.flatnonzero(code >= codes.first)
                rare = (code[at] - codes.first).tolist()
                code[at] = [-1 - codes.endings[i] for i in rare]
                out[0].append(code.astype(np.int32).tobytes())
                out[1].append(np.array([codes.hashes[i] for i in rare], np.int64).tobytes())
                if len(codes) > HELD:
                    codes.empty()
            return list(out)

        return step

    return stored(arrow_map(columns, make, "codes binary, tail binary", tuple(c for c in columns.columns if c != "text")))


class Slice:
    """Some encoded texts as one array of codes, with the place before and after each token in a circle through its text."""

    def __init__(self, codes: list[bytes], tail: list[bytes]):
        sizes = np.array([len(x) // 4 for x in codes])
        self.codes = np.frombuffer(b"".join(codes), np.int32).astype(np.int64)
        self.tail = np.frombuffer(b"".join(tail), np.int64)
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        self.before = np.arange(-1, len(self.codes) - 1)
        self.before[self.start] = self.end - 1
        self.after = np.arange(1, len(self.codes) + 1)
        self.after[self.end - 1] = self.start

    def look(self, frequent: np.ndarray, ending: np.ndarray) -> np.ndarray:
        """For each token what frequent has for its word, or ending for its ending."""
        return np.concatenate([frequent, ending[::-1]])[self.codes]


def pair_counts(texts: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """How often item b follows item a in encoded texts; before a text's first word stands an end."""
    size = WORDS + ENDINGS
    held = sent(texts.sparkSession, vocab.items)

    def make():
        items, endings = get(held), WORDS + np.arange(ENDINGS)
        waiting: list[np.ndarray] = []
        total = np.zeros(size * size, np.int32)
        state = {"n": 0}

        def add():
            if waiting:
                total[:] += np.bincount(np.concatenate(waiting), minlength=size * size).astype(np.int32)
                waiting.clear()
                state["n"] = 0

        def step(c):
            if c is None:
                add()
                some = np.flatnonzero(total)
                return [some, total[some].astype(np.int64)]
            s = Slice(c["codes"], c["tail"])
            item = s.look(items, endings)
            waiting.append(item[s.before] * size + item)
            state["n"] += len(item)
            if state["n"] > STRIDE:
                add()
            return None

        return step

    rows = arrow_map(texts.select("codes", "tail"), make, "pair long, count long", flush=True).groupBy("pair").agg(F.sum("count").alias("count")).toArrow()
    out = np.zeros(size * size)
    out[rows.column("pair").to_numpy()] = rows.column("count").to_numpy()
    return out.reshape(size, size)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def gains(table: np.ndarray, r: np.ndarray, c: np.ndarray, own: float) -> np.ndarray:
    """What each class adds to the likelihood by taking an item that is out of the table.

    r and c count the classes after and before the item, own the item after itself.
    """
    after, before = np.flatnonzero(r), np.flatnonzero(c)
    part = table[:, after]
    rows = (xlogx(part + r[after]) - xlogx(part)).sum(1)
    part = table[before]
    columns = (xlogx(part + c[before, None]) - xlogx(part)).sum(0)
    d = table.diagonal()
    gain = rows + columns - (xlogx(d + r) - xlogx(d)) - (xlogx(d + c) - xlogx(d)) + xlogx(d + r + c + own) - xlogx(d)
    # margins of a class, with what it exchanges with the item that is out of the table
    out, into = table.sum(1) + c, table.sum(0) + r
    return gain - (xlogx(out + r.sum() + own) - xlogx(out) + xlogx(into + c.sum() + own) - xlogx(into))


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each item: every item in turn moves to the class that raises the bigram likelihood most.

    Items start dealt out by falling frequency; unseen ones stay where they start.
    """
    weight = pairs.sum(1) + pairs.sum(0)
    order = np.argsort(-weight, kind="stable")
    group = np.empty(len(pairs), np.int64)
    group[order] = np.arange(len(pairs)) % classes
    one = np.zeros((len(pairs), classes))
    one[np.arange(len(pairs)), group] = 1
    forward, backward = pairs @ one, pairs.T @ one  # item -> class, class -> item
    table = one.T @ forward
    for _ in range(rounds):
        moved = 0
        for w in order:
            if not weight[w]:
                continue
            old, own = group[w], pairs[w, w]
            r, c = forward[w].copy(), backward[w].copy()
            r[old] -= own
            c[old] -= own
            table[old] -= r
            table[:, old] -= c
            table[old, old] -= own
            gain = gains(table, r, c, own)
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = int(old)
            table[new] += r
            table[:, new] += c
            table[new, new] += own
            if new != old:
                moved += 1
                group[w] = new
                forward[:, old] -= pairs[:, w]
                forward[:, new] += pairs[:, w]
                backward[:, old] -= pairs[w]
                backward[:, new] += pairs[w]
        if not moved:
            break
    return group


#: Numbers of a word's neighbours: classes before it, classes after it, itself after itself.
SLOTS = 2 * CLASSES + 1


def neighbours(texts: DataFrame, vocab: Vocabulary, group: np.ndarray, wanted: DataFrame) -> DataFrame:
    """hash, seen of the words in wanted(hash) but for the items, and maybe of others; several rows a word.

    seen holds 64-bit numbers, count * SLOTS + slot, where classes are those of the items.
    """
    held, bits = sent(texts.sparkSession, (vocab.hashes, vocab.items, group)), bit_filter(wanted)

    def make():
        hashes, items, classes = get(held)
        frequent, endings, first = classes[items], classes[WORDS:], len(hashes)
        common = passes(bits.value, hashes) & (np.arange(first) >= WORDS)
        total = np.zeros(first * SLOTS, np.int32)
        waiting: list[np.ndarray] = []
        tail: list[tuple[np.ndarray, np.ndarray]] = []
        state = {"n": 0}

        def rows(names, slots, times):
            """Of numbers sorted by name, a row for each name."""
            seen = times.astype(np.uint64) * np.uint64(SLOTS) + slots.astype(np.uint64)
            start = np.flatnonzero(np.concatenate([np.ones(min(1, len(names)), bool), names[1:] != names[:-1]]))
            end = np.append(start[1:], len(names))
            return [names[start].tolist(), [seen[i:j].tobytes() for i, j in zip(start.tolist(), end.tolist())]]

        def emptied():
            if waiting:
                keys, times = np.unique(np.concatenate(waiting), return_counts=True)
                total[keys] += times.astype(np.int32)
                waiting.clear()
            state["n"] = 0
            if not tail:
                return None
            names, slots = (np.concatenate(x) for x in zip(*tail))
            tail.clear()
            order = np.lexsort((slots, names))
            names, slots = names[order], slots[order]
            start = np.flatnonzero(np.concatenate([np.ones(min(1, len(names)), bool), (names[1:] != names[:-1]) | (slots[1:] != slots[:-1])]))
            return rows(names[start], slots[start], np.diff(np.append(start, len(names))))

        def step(c):
            if c is None:
                out, some = emptied() or [[], []], np.flatnonzero(total)
                return [a + b for a, b in zip(out, rows(hashes[some // SLOTS], some % SLOTS, total[some]))]
            s = Slice(c["codes"], c["tail"])
            g = s.look(frequent, endings)
            code, rare = s.codes, np.flatnonzero(s.codes < 0)
            name = code.copy()
            name[rare] = s.tail
            # where a word follows itself, that is one number of its own; a place is taken for a rare word's name only with the code
            same = (name[s.before] == name) & (code[s.before] == code)
            left, right = np.where(same, SLOTS - 1, g[s.before]), CLASSES + g[s.after]
            goes_on = same[s.after]
            usual = np.flatnonzero(code >= 0)
            usual = usual[common[code[usual]]]
            waiting.append(code[usual] * SLOTS + left[usual])
            usual = usual[~goes_on[usual]]
            waiting.append(code[usual] * SLOTS + right[usual])
            rare = rare[passes(bits.value, s.tail)]
            tail.append((name[rare], left[rare]))
            rare = rare[~goes_on[rare]]
            tail.append((name[rare], right[rare]))
            state["n"] += len(code)
            return emptied() if state["n"] > STRIDE else None

        return step

    return arrow_map(texts.select("codes", "tail"), make, "hash long, seen binary", flush=True)


def assigned(seen: DataFrame, group: np.ndarray, table: np.ndarray) -> DataFrame:
    """hash, class of each word of seen(hash, ending, seen): by exchange from the class of its ending."""
    held = sent(seen.sparkSession, (group, table))

    def make():
        classes, whole = get(held)
        k = len(whole)

        def chosen(end, parts):
            numbers = np.frombuffer(b"".join(parts), np.uint64)
            counts = np.bincount((numbers % np.uint64(SLOTS)).astype(np.int64), numbers // np.uint64(SLOTS), SLOTS)
            c, r, own, old = counts[:k], counts[CLASSES : CLASSES + k], counts[-1], int(classes[WORDS + end])
            rest = whole.copy()
            rest[old] -= r
            rest[:, old] -= c
            rest[old, old] -= own
            gain = gains(rest, r, c, own)
            new = int(gain.argmax())
            return new if gain[new] > gain[old] + 1e-9 else old

        return lambda c: [list(map(chosen, c["ending"], c["seen"]))]

    return arrow_map(seen, make, "class int", ("hash",))


@dataclass
class Model:
    vocab: Vocabulary
    group: np.ndarray  # class of an item
    common: np.ndarray  # class of a frequent word
    moves: np.ndarray  # log10 p(class | class before), [before, class]
    room: np.ndarray  # log10 of a class's tokens plus half its words and half an unseen one


def assign(texts: DataFrame, counts: DataFrame, vocab: Vocabulary, group: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """counts with class, null for words that go by their ending; counts is dropped."""
    spark = texts.sparkSession
    one = np.eye(int(group.max()) + 1)[group]
    wanted = counts.where(F.col("count") >= LEAST)
    seen = neighbours(texts, vocab, group, wanted.select("hash")).groupBy("hash").agg(F.collect_list("seen").alias("seen"))
    moved = assigned(seen.join(wanted.select("hash", "ending"), "hash"), group, one.T @ pairs @ one)
    items = spark.createDataFrame([(int(h), int(g)) for h, g in zip(vocab.hashes[:WORDS], group)], "hash long, class int")
    out = stored(counts.join(moved.union(items), "hash", "left"))
    dropped(counts)
    return out


def classed(texts: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Stored: the columns of encoded texts but for codes and tail, with classes, a byte for each token, n_tokens, n_known, and logs, the sum of log10(count + 0.5)."""
    spark = texts.sparkSession
    keep = tuple(c for c in texts.columns if c not in ("codes", "tail"))
    held = sent(spark, (model.vocab.counts, model.common, model.group[WORDS:]))

    def usual():
        frequent, common, endings = get(held)
        logs = np.log10(frequent + 0.5)

        def step(c):
            s = Slice(c["codes"], c["tail"])
            g = s.look(common, endings).astype(np.uint8)
            here = s.look(logs, np.zeros(ENDINGS))
            known = np.concatenate([[0], np.cumsum(s.codes >= 0)])
            ends = list(zip(s.start.tolist(), s.end.tolist()))
            rare = np.flatnonzero(s.codes < 0)
            cut = np.searchsorted(rare, s.start), np.searchsorted(rare, s.end)
            at = [(rare[i:j] - start).astype(np.int32) for i, j, start in zip(*cut, s.start.tolist())]
            tail = [s.tail[i:j] for i, j in zip(*cut)]
            return [[j - i for i, j in ends], (known[s.end] - known[s.start]).tolist(), np.add.reduceat(here, s.start).tolist(), [g[i:j].tobytes() for i, j in ends], tail, at]

        return step

    parts = stored(arrow_map(texts, usual, "n_tokens long, common long, logs double, classes binary, tail array<long>, at array<int>", keep).withColumn("row", F.monotonically_increasing_id()))
    tail = parts.select("row", F.explode(F.arrays_zip("tail", "at")).alias("t")).select("row", F.col("t.tail").alias("hash"), F.col("t.at").alias("at"))
    found = tail.join(counts.select("hash", "count", "class"), "hash", "left")
    change = F.when(F.col("class").isNotNull(), F.col("at").cast("long") * 256 + F.col("class"))
    sums = found.groupBy("row").agg(F.sum(F.log10(F.coalesce("count", F.lit(0)) + 0.5)).alias("rest"), F.count("count").alias("met"), F.collect_list(change).alias("changes"))

    def joined():
        def changed(classes: bytes, changes: list[int] | None) -> bytes:
            if not changes:
                return classes
            g, new = np.frombuffer(classes, np.uint8).copy(), np.array(changes, np.int64)
            g[new >> 8] = new & 255
            return g.tobytes()

        return lambda c: [list(map(changed, c["was"], c["changes"]))]

    whole = parts.drop("tail", "at").withColumnRenamed("classes", "was").join(sums, "row", "left")
    whole = whole.withColumn("n_known", F.col("common") + F.coalesce("met", F.lit(0))).withColumn("logs", F.col("logs") + F.coalesce("rest", F.lit(0.0)))
    out = stored(arrow_map(whole.select(*keep, "n_tokens", "n_known", "logs", "was", "changes"), joined, "classes binary", (*keep, "n_tokens", "n_known", "logs")))
    dropped(parts)
    return out


def circles(classes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the classes of some texts: the class before each token, its own, and where each text starts."""
    sizes = np.array([len(x) for x in classes])
    g = np.frombuffer(b"".join(classes), np.uint8).astype(np.int64)
    end = np.cumsum(sizes)
    before = np.concatenate([g[-1:], g[:-1]])
    before[end - sizes] = g[end - 1]
    return before, g, end - sizes


def transitions(texts: DataFrame, k: int) -> np.ndarray:
    """How often each of k classes follows a class, in classed texts."""

    def make():
        total = np.zeros(k * k, np.int64)

        def step(c):
            if c is None:
                some = np.flatnonzero(total)
                return [some, total[some]]
            before, g, _ = circles(c["classes"])
            total[:] += np.bincount(before * k + g, minlength=k * k)
            return None

        return step

    rows = arrow_map(texts.select("classes"), make, "pair long, count long", flush=True).groupBy("pair").agg(F.sum("count").alias("count")).toArrow()
    out = np.zeros(k * k)
    out[rows.column("pair").to_numpy()] = rows.column("count").to_numpy()
    return out.reshape(k, k)


def clustered(texts: DataFrame, vocab: Vocabulary, counts: DataFrame) -> tuple[Model, DataFrame]:
    """The model without its transitions, and counts with class, of encoded training texts."""
    pairs = pair_counts(texts, vocab)
    group = exchange(pairs)
    classes = int(group.max()) + 1
    counts = assign(texts, counts, vocab, group, pairs)
    top = counts.orderBy(F.desc("count"), "hash").limit(FREQUENT).select("class").toArrow().column("class").fill_null(-1).to_numpy()
    common = np.where(top < 0, group[vocab.items], top).astype(np.int64)
    tokens_in, words_in = np.zeros(classes), np.zeros(classes)
    own = F.coalesce("class", -1 - F.col("ending"))
    for r in counts.groupBy(own.alias("own")).agg(F.sum("count").alias("tokens"), F.count("*").alias("words")).collect():
        g = r["own"] if r["own"] >= 0 else group[WORDS - 1 - r["own"]]
        tokens_in[g] += r["tokens"]
        words_in[g] += r["words"]
    return Model(vocab, group, common, np.zeros((classes, classes)), np.log10(tokens_in + 0.5 * (words_in + 1))), counts


def learned(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the stored counts(hash, ending, count, class) and the classed texts of docs(train, text, ...), learned where train is true."""
    counts = stored(counted(docs.where("train")))
    vocab = vocabulary(counts)
    texts = encoded(docs, vocab)
    if vocab.total:
        model, counts = clustered(texts.where("train"), vocab, counts)
    else:
        model, counts = Model(vocab, np.zeros(WORDS + ENDINGS, np.int64), np.zeros(0, np.int64), np.zeros((1, 1)), np.log10([0.5])), counts.withColumn("class", F.lit(None).cast("int"))
    whole = classed(texts, model, counts)
    dropped(texts)
    if vocab.total:
        k = len(model.room)
        table = transitions(whole.where("train"), k)
        alone = table.sum(0) + 1
        alone /= alone.sum()
        model.moves = np.log10((table + k * alone[None, :]) / (table.sum(1, keepdims=True) + k))
    return model, counts, whole


def fit(docs: DataFrame, text: str = "text") -> tuple[Model, DataFrame]:
    """The model and the stored counts(hash, ending, count, class) of docs; without docs every probability is 1."""
    model, counts, whole = learned(docs.select(F.lit(True).alias("train"), F.col(text).alias("text")))
    dropped(whole)
    return model, counts


def scored(whole: DataFrame, model: Model, keep: tuple[str, ...]) -> DataFrame:
    """The scores of classed texts, with the columns to keep."""
    held = sent(whole.sparkSession, (model.moves, model.room))

    def make():
        moves, room = get(held)

        def step(c):
            before, g, start = circles(c["classes"])
            return [np.add.reduceat(moves[before, g] - room[g], start).tolist()]

        return step

    both = arrow_map(whole, make, "chain double", (*keep, "n_tokens", "n_known", "logs"))
    base = float(np.log10(model.vocab.total + 0.5 * (model.vocab.distinct + 1)))
    out = both.select(*keep, "n_tokens", "n_known", F.lit(model.vocab.total).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * base).alias("base_score"), (F.col("logs") + F.col("chain")).alias("score"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def score(docs: DataFrame, model: Model, counts: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Scores are log10 probabilities of the whole text with its end; base_score
    is that of words alone, each with half a count more.  A null text is empty
    and has one token, its end; very long texts are scored whole.  Null ids are
    kept, other columns are ignored; repeated rows are scored each.
    """
    texts = encoded(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), model.vocab)
    whole = classed(texts, model, counts)
    dropped(texts)
    return scored(whole, model, ("doc_id",))


def fit_and_score(docs: DataFrame, train, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows of score() and train, of all docs under the model of those where the condition train holds (null: it doesn't)."""
    columns = docs.select(F.col(id).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text"))
    model, _, whole = learned(columns)
    return scored(whole, model, ("doc_id", "train"))
