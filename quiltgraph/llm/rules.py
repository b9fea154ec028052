"""Quality rules: repetition counts, and a log-likelihood ratio of hashed n-grams.

Words and pairs of neighbouring words fall into buckets.  One multinomial over
the buckets is counted on trusted documents, one on the whole corpus; the mean
log ratio of a text's grams, so normalised for length, is held against a fixed
threshold.  All of it is SQL expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import WHITE

#: Buckets of hashed grams.
BUCKETS = 1 << 14
#: Trusted documents that the target multinomial is counted on, at most: those least by the hash of their id.
TRUSTED = 20_000
#: Log ratios are held in units of 1/UNIT, as integers, so that sums don't depend on their order.
UNIT = 10_000
#: Least mean log ratio of a kept document, from labelled bad and trusted rows: the training rows of sf0.1 leave room up to -0.03, but ratios of good rows spread wider on the small table sf0.01.
THRESHOLD = -0.065
#: Fewest words, and the largest share in percent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50


def _words(docs: DataFrame, id: str, text: str) -> DataFrame:
    bare = F.btrim(F.col(text), F.lit(WHITE))
    words = F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))
    return docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), words.alias("words"))


def ratios(docs: DataFrame, trusted: DataFrame, text: str = "text", id: str = "doc_id", bound: int = TRUSTED) -> list[int]:
    """The log ratio of each bucket, in 1/UNIT: trusted target over raw corpus, both with one added to every bucket.

    ``trusted`` holds ids in a column named like ``id``; at most ``bound`` of
    them are used, so they are a bounded table.  Every row of docs counts for the corpus.  Without trusted
    documents all ratios are 0.
    """
    ids = trusted.select(F.col(id).alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    words = _words(docs, id, text).join(F.broadcast(ids.withColumn("trusted", F.lit(1))), "doc_id", "left").selectExpr("trusted", "words as a", "slice(words, 2, size(words)) as b")
    pairs = words.selectExpr("trusted", "inline(arrays_zip(a, b))")
    grams = pairs.selectExpr("trusted", f"explode(if(b is null, array(pmod(xxhash64(a), {BUCKETS})), array(pmod(xxhash64(a), {BUCKETS}), pmod(xxhash64(xxhash64(a), xxhash64(b)), {BUCKETS})))) as bucket")
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("target")).collect()
    raw, target = [1] * BUCKETS, [1] * BUCKETS
    for row in counts:
        raw[row["bucket"]] += row["raw"]
        target[row["bucket"]] += row["target"]
    if sum(target) == BUCKETS:
        return [0] * BUCKETS
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [round(UNIT * (math.log(t) - math.log(r) + shift)) for t, r in zip(target, raw)]


def score(docs: DataFrame, ratio: list[int], text: str = "text", id: str = "doc_id", threshold: float = THRESHOLD, spare: int = 0) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    llr is the mean log ratio of the text's grams, 0 without any.  A null text
    counts as empty and fails; very long texts are counted whole; repeated rows
    and null ids are kept; other columns are ignored.  ``spare`` gives up that
    many more bits of a window's hash in the fast way of finding equal ones;
    the result is the same.
    """
    table = F.split(F.lit(",".join(map(str, ratio))), ",").cast("array<int>")
    first = _words(docs, id, text).withColumn("ratio", table)
    hashed = first.selectExpr(
        "doc_id", "ratio", "cast(size(words) as bigint) as n_words", "cast(length(array_join(words, '')) as bigint) as word_chars",
        "cast(size(split(text, '[#*$%&|<>]')) - 1 as bigint) as n_symbols",
        "filter(split(text, '\\n'), l -> l rlike '[^ \\t-\\r]') as lines",
        "transform(words, w -> xxhash64(w)) as h",
    )
    windows = hashed.selectExpr(
        "doc_id", "n_words", "word_chars", "n_symbols", "cast(size(lines) - size(array_distinct(lines)) as bigint) as n_dup_lines",
        "if(n_words < 3, cast(array() as array<bigint>), transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64(h[i], h[i + 1], h[i + 2]))) as w3",
        f"if(n_words = 0, 0D, aggregate(sequence(0, cast(n_words as int) - 1), 0L, (s, i) -> s + ratio[cast(pmod(h[i], {BUCKETS}) as int)]) / cast({UNIT} as double)) as words_sum",
        f"if(n_words < 2, 0D, aggregate(sequence(0, cast(n_words as int) - 2), 0L, (s, i) -> s + ratio[cast(pmod(xxhash64(h[i], h[i + 1]), {BUCKETS}) as int)]) / cast({UNIT} as double)) as pairs_sum",
    )
    # a window's place is packed below the high bits of its hash, so that sorting numbers brings equal windows together;
    # where unequal ones agree in the high bits, they are sorted by the whole hash
    packed = "sort_array(transform(w3, (x, i) -> shiftleft(x, bits) | cast(i as bigint)))"
    alike = lambda a, b: f"(shiftrightunsigned({a}, bits) = shiftrightunsigned({b}, bits) and w3[cast({a} & low as int)] = w3[cast({b} & low as int)])"
    width = f"least(62, length(bin(n_words)) + {int(spare)})"
    placed = windows.selectExpr("*", f"{width} as bits", f"shiftleft(1L, {width}) - 1 as low").selectExpr(
        "*", f"if(size(array_distinct(w3)) = size(w3), cast(array() as array<bigint>), {packed}) as sorted"
    )
    clash = "exists(sequence(1, size(sorted) - 1), k -> shiftrightunsigned(sorted[k], bits) = shiftrightunsigned(sorted[k - 1], bits) and w3[cast(sorted[k] & low as int)] <> w3[cast(sorted[k - 1] & low as int)])"
    placed = placed.selectExpr(
        "*", f"if(size(sorted) > 1 and {clash}, sort_array(transform(w3, (x, i) -> struct(x as h, cast(i as bigint) as i))), cast(array() as array<struct<h: bigint, i: bigint>>)) as whole"
    )
    found = placed.selectExpr(
        "*",
        "case when size(whole) > 0 then sort_array(transform(filter(sequence(0, size(whole) - 1), "
        "k -> (k > 0 and whole[k].h = whole[k - 1].h) or (k < size(whole) - 1 and whole[k].h = whole[k + 1].h)), k -> whole[k].i)) "
        "when size(sorted) = 0 then sorted else sort_array(transform(filter(sequence(0, size(sorted) - 1), "
        f"k -> (k > 0 and {alike('sorted[k]', 'sorted[k - 1]')}) or (k < size(sorted) - 1 and {alike('sorted[k]', 'sorted[k + 1]')})), k -> sorted[k] & low)) end as starts",
    )
    counted = found.selectExpr(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "words_sum", "pairs_sum",
        "aggregate(zip_with(starts, slice(starts, 2, size(starts)), (a, b) -> least(3L, coalesce(b - a, 3L))), 0L, (s, x) -> s + x) as n_repeat_words",
    )
    judged = counted.selectExpr(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed",
        "(words_sum + pairs_sum) / greatest(1L, 2 * n_words - 1) as llr",
    )
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
