"""Language identification: sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams inside words, the
word's boundary counted as a character; term frequency is a gram's share of
the text, so a text's logits are the mean over its grams.  Training is
follow-the-regularised-leader with elastic-net penalties; a temperature fitted
to held-back rows calibrates the softmax.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, get, sent

#: Hash buckets, longest gram, and what a share is multiplied with.
BUCKETS, LONGEST, SCALE = 1 << 16, 3, 10.0
#: Documents of each language that the classifier is fitted on, at most: those least by the hash of their id.
SAMPLE = 600
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 0.1, 0.02, 0.1, 4
#: Characters held as numbers at once; longer texts are summed over blocks.
BLOCK = 1 << 20
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages, with idf and scale in it
    bias: np.ndarray
    temperature: float


class Grams:
    """Texts to the buckets of their grams."""

    def __init__(self):
        # of every code point, whether it is a letter
        self.letter = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)

    def codes(self, text: str) -> np.ndarray:
        """Lower-case letters, with every run of other characters as one 0, and a 0 at both ends."""
        raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        out = np.zeros(len(raw) + 2, np.uint32)
        out[1:-1] = np.where(self.letter[raw], raw, 0)
        stay = np.ones(len(out), bool)
        stay[1:] = (out[1:] != 0) | (out[:-1] != 0)
        return out[stay]

    def buckets(self, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length, the places where a gram ends and its bucket."""
        out = []
        h = codes * np.uint32(2654435761) + np.uint32(1)
        word = codes != 0
        for n in range(1, LONGEST + 1):
            if n == 1:
                valid, value = word, h
            else:
                value = value[:-1] * np.uint32(0x85EBCA6B) ^ h[n - 1 :]
                inner = np.ones(max(0, len(codes) - n + 1), bool)
                for k in range(1, n - 1):
                    inner &= word[k : len(codes) - n + 1 + k]
                if n == 2:
                    inner = word[:-1] | word[1:]
                valid = inner
            at = np.flatnonzero(valid)
            v = value[at] * np.uint32(0xC2B2AE35)
            v ^= v >> np.uint32(15)
            out.append((at + n - 1, (v + np.uint32(n) * np.uint32(0x27D4EB2F)) % np.uint32(BUCKETS)))
        return out

    def counted(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The distinct buckets of a text and their shares, summed over blocks."""
        total = np.zeros(BUCKETS)
        for codes in self.blocks(text):
            for _, b in self.buckets(codes):
                total += np.bincount(b, minlength=BUCKETS)
        some = np.flatnonzero(total)
        return some, total[some] / max(1.0, total.sum())

    def blocks(self, text: str):
        """Blocks cut at white space where there is any."""
        at = 0
        while at < len(text):
            end = at + BLOCK
            if end < len(text):
                cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
                end = cut if cut > at else end
            yield self.codes(text[at:end])
            at = end

    def sums(self, texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text the sum of its grams' weights and their number."""
        out, number = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts))
        held: list[np.ndarray] = []
        owner: list[int] = []
        size = 0

        def flush():
            codes = np.concatenate(held)
            starts = np.cumsum([0] + [len(x) for x in held[:-1]])
            rows = np.array(owner)
            for ends, b in self.buckets(codes):
                if not len(b):
                    continue
                w = weights[b]
                first = np.searchsorted(ends, starts)
                last = np.append(first[1:], len(ends))
                some = np.flatnonzero(last > first)
                out_part = np.add.reduceat(w, first[some], axis=0)
                np.add.at(out, rows[some], out_part)
                np.add.at(number, rows[some], (last - first)[some])
            held.clear()
            owner.clear()

        for i, t in enumerate(texts):
            for codes in self.blocks(t):
                held.append(codes)
                owner.append(i)
                size += len(codes)
                if size >= BLOCK // 4:
                    flush()
                    size = 0
        if held:
            flush()
        return out, number


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str]) -> Model:
    """rows: buckets, shares and language number of each text; every fifth row sets the temperature."""
    seen = np.zeros(BUCKETS)
    for some, _, _ in rows:
        seen[some] += 1
    idf = SCALE * (np.log((1 + len(rows)) / (1 + seen)) + 1)
    k = len(languages)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    own = [r for i, r in enumerate(rows) if i % 5] or rows
    held_back = rows[::5]

    def weights(at):
        # the bias, at BUCKETS, goes unpenalised
        l1, l2 = np.where(at == BUCKETS, 0.0, L1)[:, None], np.where(at == BUCKETS, 0.0, L2)[:, None]
        zz = z[at]
        return np.where(np.abs(zz) > l1, -(zz - np.sign(zz) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + l2), 0.0)

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(own)):
            some, share, y = own[i]
            at, x = np.append(some, BUCKETS), np.append(share * idf[some], 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    bias, w = w[BUCKETS], w[:BUCKETS] * idf[:, None]
    logits = np.array([share @ w[some] + bias for some, share, _ in held_back])
    y = np.array([r[2] for r in held_back])
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 241))
    # the targets keep one row's worth of doubt, so that faultless rows don't drive the temperature to 0
    doubt = 1 / (len(y) + 2)
    target = np.full((len(y), k), doubt / k)
    target[np.arange(len(y)), y] += 1 - doubt
    loss = [-(target * np.log(softmax(logits / t) + 1e-300)).sum(axis=1).mean() for t in grid]
    return Model(languages, w.astype(np.float32), bias, float(grid[int(np.argmin(loss))]))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` documents of each language; without any, a model that knows none.

    Rows with a null id, language or text are left out; of ids that are
    repeated every row counts.
    """
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    # the row numbers are limited within each input partition before they are shuffled
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "id"))
    least = usable.where(F.col(id).isNotNull()).select(F.col(lang).alias("lang"), F.col(id).alias("id"), F.xxhash64(id).alias("hash")).withColumn("nth", nth).where(F.col("nth") <= sample)
    ids = sorted({r["id"] for r in least.select("id").collect()})
    if not ids:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    chosen = docs.sparkSession.createDataFrame([(i,) for i in ids], "id long").dropDuplicates()

    def make():
        grams = Grams()

        def step(c):
            both = [grams.counted(t) for t in c["text"]]
            return [[b[0].tolist() for b in both], [b[1].tolist() for b in both]]

        return step

    columns = usable.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).join(F.broadcast(chosen), "id")
    found = arrow_map(columns, make, "buckets array<int>, shares array<double>", ("id", "lang")).toArrow().to_pydict()
    order = sorted(range(len(found["id"])), key=lambda i: (found["id"][i], found["lang"][i], len(found["buckets"][i])))
    languages = sorted(set(found["lang"]))
    rows = [(np.array(found["buckets"][i], np.int64), np.array(found["shares"][i]), languages.index(found["lang"][i])) for i in order if found["buckets"][i]]
    if not rows:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    return train(rows, languages)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred string and score double, one row for each row of docs.

    A null text, one without a letter, or any text under a model that knows no
    language gets ``und`` with score 0.  A letter is what Unicode calls one, in
    any plane.  Very long texts are read whole, in blocks; repeated rows and null
    ids are kept.  Ties go to the first language by code point.
    """
    held = sent(docs.sparkSession, model)

    def make():
        m, grams = get(held), Grams()

        def step(c):
            texts = [t or "" for t in c[text]]
            if not m.languages:
                return [[UNKNOWN] * len(texts), [0.0] * len(texts)]
            sums, number = grams.sums(texts, m.weights)
            p = softmax((sums / np.maximum(number, 1)[:, None] + m.bias) / m.temperature)
            best = p.argmax(axis=1)
            some = number > 0
            return [[m.languages[b] if s else UNKNOWN for b, s in zip(best, some)], np.where(some, p.max(axis=1), 0.0).tolist()]

        return step

    return arrow_map(docs.select(*dict.fromkeys((*keep, text))), make, "lang_pred string, score double", keep)
