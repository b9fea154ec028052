"""What the operators share: reading, scratch tables, Arrow maps, hashing.

``[\\x20\\x09-\\x0D]`` is exactly what ``bytes.split()`` splits at, and
``bytes.lower()`` changes A-Z only, so words are taken from UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import stored, unstored as dropped  # noqa: F401

#: Rows of one Arrow batch that a Python step sees at once.
SLICE_ROWS = 256
#: Rows and bytes of one Arrow batch between the JVM and Python.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": "16777216"}

_PA = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session(df: DataFrame) -> SparkSession:
    """The DataFrame's session, with Arrow batches bounded in rows and bytes."""
    spark = df.sparkSession
    for key, value in BATCH.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def sent(spark: SparkSession, value):
    """A broadcast of value, whatever its class: get(sent) gives it back on an executor, which needs no copy of this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def get(held):
    """What sent() sent, once a task."""
    from pyspark import cloudpickle

    return cloudpickle.loads(held.value)


#: Bits of a filter over hashes for each of them, and the least and most bits; beyond the most (64 MB) it lets more through.
FILTER_RATE, FILTER_LEAST, FILTER_MOST = 16, 1 << 20, 1 << 29
#: Bits of one row of Spark's bitmaps.
BITMAP = 8 * 4096


def bit_filter(hashes: DataFrame):
    """A broadcast array of bits over the one column of 64-bit hashes, sized by their number, a power of 2 between fixed bounds.

    Each hash sets two bits, by its low and its high half.
    """
    name, count = hashes.columns[0], hashes.count()
    size = min(FILTER_MOST, max(FILTER_LEAST, 1 << (FILTER_RATE * count - 1).bit_length())) if count else FILTER_LEAST
    low, high = F.col(name).bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned(name, 32).bitwiseAND(F.lit(size - 1))
    bit = hashes.select(F.explode(F.array(low + 1, high + 1)).alias("bit"))
    rows = bit.groupBy(F.expr("bitmap_bucket_number(bit)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits")).toLocalIterator()
    out = np.zeros(size // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[(r["bucket"] - 1) * BITMAP // 8 :][: len(part)] = part
    return hashes.sparkSession.sparkContext.broadcast(out)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (signed or unsigned) have both their bits set."""
    h = hashes.astype(np.int64).view(np.uint64)
    last = np.uint64(8 * len(bits) - 1)
    is_set = lambda at: (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    out = is_set(h & last)
    some = np.flatnonzero(out)
    out[some] = is_set(h[some] >> np.uint64(32) & last)
    return out


def remainder(column: str, divisor: int):
    """crc32 of the id as text, modulo divisor."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def fields(ddl: str) -> list[tuple[str, str]]:
    return [tuple(part.split()) for part in ddl.split(", ")]


def arrow_map(df: DataFrame, make: Callable[[], Callable], out: str, keep: tuple[str, ...] = (), flush: bool = False) -> DataFrame:
    """Maps df in Arrow slices of at most SLICE_ROWS rows.

    make() runs once a task and gives step(columns: dict of name -> list) ->
    list of result columns, in the order of ``out`` ("name type, ...").  Columns
    in ``keep`` go through unchanged, but for those whose names ``out`` has.
    With ``flush``, step(None) is called at the end of a task for its last rows,
    and rows of a slice need not match those of its result.
    """
    session(df)
    own = fields(out)
    names = [name for name, _ in own]
    keep = tuple(c for c in keep if c not in names)
    types = [_PA[kind] for _, kind in own]
    kinds = dict(df.dtypes)
    ddl = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{n}` {'bigint' if k == 'long' else k.replace('long', 'bigint')}" for n, k in own])

    class Columns(dict):
        """The columns of a slice, as lists once they are asked for."""

        def __init__(self, part: pa.RecordBatch):
            self.part = part

        def __missing__(self, name: str) -> list:
            self[name] = self.part.column(name).to_pylist()
            return self[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()

        def made(result, kept):
            arrays = kept + [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(result, types)]
            return pa.RecordBatch.from_arrays(arrays, names=list(keep) + names)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                result = step(Columns(part))
                if result is not None:
                    yield made(result, [part.column(c) for c in keep])
        if flush:
            result = step(None)
            if result is not None:
                yield made(result, [])

    return df.mapInArrow(run, ddl)


MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes; a table of known words would cost more than hashing anew."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct hashes of runs of ``width`` words; a shorter sequence counts as one run."""
    if not len(hashes):
        return hashes
    width_here = min(width, len(hashes))
    n = len(hashes) - width_here + 1
    out = np.full(n, np.uint64(0x9E3779B97F4A7C15) + np.uint64(width_here))
    for k in range(width_here):
        out = mixed(out ^ hashes[k : k + n]) + np.uint64(k + 1)
    return np.unique(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)
