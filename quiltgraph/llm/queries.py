"""The queries opN_<name>: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, brown, jaccard, langid, lines, mixing, nearest, pii, quality, rules
from .common import remainder, table


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The key of the query's pseudonyms; users of the operator bring their own.
KEY = b"quiltgraph example key"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Learned from labelled rows whose crc32 remainder by 5 is not 0."""
    return quality.fit(quality.sampled(docs, labels, "quality", remainder("doc_id", 5) != 0))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(remainder("doc_id", 3) != 1))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), jaccard.Measure(width=3, percent=90))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = brown.fit_and_score(docs, remainder("doc_id", 5) != 1)
    return out.select("doc_id", (remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return rules.score(docs, rules.ratios(docs, trusted))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), word_bpe())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_pii": op1_pii, "op2_quality": op2_quality, "op3_langid": op3_langid, "op4_lines": op4_lines, "op5_jaccard": op5_jaccard, "op6_nearest": op6_nearest, "op7_mixing": op7_mixing, "op8_brown": op8_brown, "op9_rules": op9_rules, "op10_bpe": op10_bpe}


#: Words with A-Z in lower case, as lists.
_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

_LINES_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS number FROM documents),
worded AS (SELECT doc_id, number, {_WORDS.format("line")} AS w FROM lines),
occurrence AS (SELECT doc_id, number, w FROM worded WHERE len(w) >= 5 OR length(array_to_string(w, '')) >= 40),
line AS (SELECT w, min((doc_id, number)) AS place FROM occurrence GROUP BY w),
variant AS (
  SELECT place, len(w) AS size, -1 AS gone, w AS rest FROM line WHERE len(w) >= 10
  UNION ALL SELECT place, len(w), i, list_concat(w[1 : i - 1], w[i + 1 :]) FROM (SELECT place, w, unnest(range(1, len(w) + 1)) AS i FROM line WHERE len(w) >= 10)),
keyed AS (SELECT place, size, gone, md5(array_to_string(rest, ' ')) AS key FROM variant),
near AS (
  SELECT a.place FROM keyed a JOIN keyed b ON a.key = b.key AND b.gone < 0 AND a.gone >= 0 WHERE b.place < a.place
  UNION SELECT b.place FROM keyed a JOIN keyed b ON a.key = b.key AND b.gone < 0 AND a.gone >= 0 WHERE a.place < b.place
  UNION SELECT a.place FROM keyed a JOIN (SELECT key, size, gone, min(place) AS place FROM keyed WHERE gone >= 0 GROUP BY ALL) b
    ON a.key = b.key AND a.size = b.size AND a.gone = b.gone WHERE b.place < a.place),
removed AS (
  SELECT o.doc_id, o.number FROM occurrence o JOIN line l ON o.w = l.w WHERE l.place <> (o.doc_id, o.number) OR l.place IN (SELECT place FROM near))
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, coalesce(r.numbers, '') AS removed
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) AS numbers FROM removed GROUP BY doc_id) r ON r.doc_id = d.doc_id"""

_CLASSES_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 2], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
sym AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN sym l ON l.a = r.b)
SELECT r.a AS doc_id, CAST(coalesce(max(s.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM reach r LEFT JOIN size s ON s.doc_id = r.a GROUP BY r.a"""


def oracle_sql() -> dict[str, str]:
    """The other operators are models, seeded or approximate, or beyond SQL; tests hold them against plain versions."""
    return {"op4_lines": _LINES_SQL, "op5_jaccard": _CLASSES_SQL}
