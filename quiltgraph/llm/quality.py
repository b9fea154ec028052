"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled text.  A
text is cut into pieces, so that a dictionary matters as much late in a long
text as in a short one, and every piece is compressed with each dictionary.
The difference of the summed sizes over the text's length goes through a
logistic curve that was fitted to differences of texts the dictionaries had
not seen.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, dropped, get, sent, stored

#: Bytes of a piece, of a dictionary, and the compression level.
PIECE, DICTIONARY, LEVEL = 2048, 65536, 3
#: Labelled documents of each class that the classifier is fitted on, at most: those least by the hash of their id.
SAMPLE = 3000
#: Pieces of each class and half that a dictionary is built from, at most, of those documents: the ones least by a hash.  It bounds what
#: the driver holds (20 MB), since texts may have any length.
PIECES = 2500
#: Fewest pieces that a dictionary is trained on, and bytes of text for each byte of it.
LEAST_PIECES, RATIO = 64, 8
#: Bytes added to a length, so that few bytes show little.
SHRINK = 64


@dataclass
class Model:
    """good, bad: dictionaries or None; score = sigmoid(slope * difference + offset)."""

    good: bytes | None
    bad: bytes | None
    slope: float
    offset: float


def dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary of 1/RATIO of the text's size, at most DICTIONARY bytes.

    Fewer than LEAST_PIECES pieces, or texts in which the trainer finds no
    repeated parts, give none: then the end of the text itself is the
    dictionary, as zstandard's raw content.
    """
    import zstandard

    size = min(DICTIONARY, sum(map(len, pieces)) // RATIO)
    if len(pieces) >= LEAST_PIECES:
        try:
            return zstandard.train_dictionary(size, pieces).as_bytes()
        except zstandard.ZstdError as e:
            warnings.warn(f"no dictionary could be trained on {len(pieces)} pieces, raw content is used: {e}", stacklevel=2)
    return (b"\n".join(pieces))[-DICTIONARY:] or b"\n" * 8


class Sizer:
    """difference(text) of the sizes under two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        self.both = []
        for raw in (good, bad):
            held = zstandard.ZstdCompressionDict(raw)
            held.precompute_compress(level=LEVEL)
            self.both.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def difference(self, text: str | None) -> float:
        """Bytes the good dictionary saves over the bad one, for each byte of text; 0 of an empty text."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        good, bad = self.both
        saved = 0
        for at in range(0, len(raw), PIECE):
            piece = raw[at : at + PIECE]
            saved += len(bad(piece)) - len(good(piece))
        return saved / (len(raw) + SHRINK)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with a weak ridge on the slope of the standardised difference."""
    mean, spread = x.mean(), x.std() or 1.0
    z = np.stack([(x - mean) / spread, np.ones_like(x)], 1)
    w, ridge = np.zeros(2), np.array([1e-2, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


def fit(labelled: DataFrame, text: str = "text", label: str = "label", id: str = "doc_id", pieces: int = PIECES) -> Model:
    """A model from labelled documents, and of their text at most ``pieces`` pieces of each label and half.

    The difference of every document goes into the logistic curve, over its
    whole text.  Rows with a null label are left out; repeated rows count as
    often as they occur; those with a null id are in one half.  Without rows of both labels the score
    is a constant, the share of label 1 after adding one row of each.
    """
    columns = labelled.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    chosen = stored(columns.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), F.col("id")), F.lit(2)).cast("int")))
    counts = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
    if not counts.get(0) or not counts.get(1):
        dropped(chosen)
        zero, one = counts.get(0, 0), counts.get(1, 0)
        return Model(None, None, 0.0, float(np.log((one + 1) / (zero + 1))))

    def cut():
        def step(c):
            out = ([], [], [], [])
            for i, t, y, f in zip(c["id"], c["text"], c["label"], c["fold"]):
                raw = (t or "").encode("utf-8", "surrogatepass")
                for at in range(0, len(raw), PIECE):
                    for o, v in zip(out, (y, f, f"{i}/{at}", raw[at : at + PIECE])):
                        o.append(v)
            return list(out)

        return step

    cuts = arrow_map(chosen, cut, "label int, fold int, place string, piece binary")
    parts = {}
    for y in (0, 1):
        for f in (0, 1):
            rows = cuts.filter((F.col("label") == y) & (F.col("fold") == f)).orderBy(F.xxhash64("place"), "place").limit(pieces).select("piece").collect()
            parts[y, f] = [bytes(r["piece"]) for r in rows]
    halves = {f: tuple(dictionary(parts[y, f]) for y in (1, 0)) for f in (0, 1)}

    def unseen():
        sizers = {f: Sizer(*halves[1 - f]) for f in (0, 1)}
        return lambda c: [[sizers[f].difference(t) for t, f in zip(c["text"], c["fold"])]]

    rows = arrow_map(chosen, unseen, "difference double", ("label",)).collect()
    dropped(chosen)
    slope, offset = logistic(np.array([r["difference"] for r in rows]), np.array([float(r["label"]) for r in rows]))
    return Model(dictionary(parts[1, 0] + parts[1, 1]), dictionary(parts[0, 0] + parts[0, 1]), slope, offset)


def sampled(docs: DataFrame, labels: DataFrame, label: str, train, id: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """id, text and label of at most ``sample`` documents of each label among those where ``train`` holds.

    The chosen ids are a bounded table, so documents are read without a shuffle.
    """
    known = labels.select(F.col(id), F.col(label).cast("int").alias("label")).where(F.col(id).isNotNull() & F.col("label").isin(0, 1)).where(train).dropDuplicates()
    picks = [known.where(F.col("label") == y).orderBy(F.xxhash64(id), id).limit(sample) for y in (0, 1)]
    ids = docs.sparkSession.createDataFrame([tuple(r) for p in picks for r in p.collect()], "doc_id long, label int").withColumnRenamed("doc_id", id)
    return docs.select(id, "text").join(F.broadcast(ids), id)


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and score double in [0, 1], one row for each row of docs.

    Null and empty texts score as a difference of 0, very long ones as a whole;
    equal texts get equal scores and repeated rows stay; a null id is kept; kept columns named score
    are replaced; other columns are ignored.
    """
    held = sent(docs.sparkSession, model)

    def make():
        m = get(held)
        sizer = Sizer(m.good, m.bad) if m.good is not None else None

        def step(c):
            x = np.array([sizer.difference(t) if sizer else 0.0 for t in c[text]])
            return [(1 / (1 + np.exp(-np.clip(m.slope * x + m.offset, -40, 40)))).tolist()]

        return step

    return arrow_map(docs.select(*dict.fromkeys((*keep, text))), make, "score double", keep)
