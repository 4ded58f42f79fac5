"""The registered queries of the training-data operators, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.llm import bpe, entities, lookalike, neighbours, packing, quota, scanrepair, sentences, termcounts
from chronolex.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(table(spark, d, "wiki_vectors")).select(F.col("key").alias("vec_id"), F.col("neighbour").alias("neighbour_id"))


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return entities.resolve(table(spark, d, "name_forms"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return entities.linked_pairs(_entities(spark, d)).toDF("form_a", "form_b")


def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    return _entities(spark, d).toDF("form_id", "entity")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return termcounts.mark_terms(table(spark, d, "speeches")).where("mark is not null").select("term", "mark")


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    return termcounts.mark_terms(table(spark, d, "speeches")).select("term", "occurrences", "records", "mark")


def p3_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return termcounts.ngram_counts(table(spark, d, "speeches"), "speech_id", "speech", max_n=2).where("n = 2").select("term", "occurrences", "records")


def p3_trigrams(spark: SparkSession, d: str) -> DataFrame:
    return termcounts.ngram_counts(table(spark, d, "speeches"), "speech_id", "speech", max_n=3).where("n = 3").select("term", "occurrences", "records")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    digital = table(spark, d, "speeches").where(~F.col("origin").eqNullSafe("archive"))
    return sentences.split_sentences(digital).select(F.col("key").alias("row_id"), "sent_end")


def _quota(spark: SparkSession, d: str) -> quota.Quota:
    return quota.labelled_quota(table(spark, d, "opus_vs_haiku"), table(spark, d, "sample_targets"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _quota(spark, d).unfilled()


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return _quota(spark, d).sample()


def p5_strata(spark: SparkSession, d: str) -> DataFrame:
    return _quota(spark, d).report.select("decade", "haiku", "targeted", "available", "wanted")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return _quota(spark, d).report


def _scans(spark: SparkSession, d: str) -> DataFrame:
    speeches = table(spark, d, "speeches")
    scanned = speeches.where("origin = 'archive'").select(F.struct(F.lit("speeches").alias("source_table"), F.col("row_id").alias("rec_key")).alias("rec"), F.col("speech").alias("t"))
    labelled = table(spark, d, "opus_vs_haiku").select(F.struct(F.lit("opus_vs_haiku").alias("source_table"), F.col("eval_id").alias("rec_key")).alias("rec"), F.col("sentence").alias("t"))
    reliable = speeches.where(~F.col("origin").eqNullSafe("archive")).select(F.col("speech").alias("t"))
    return scanrepair.repair_scans(scanned.unionByName(labelled), reliable, "rec", "t")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scanrepair.findings(_scans(spark, d)).select("key.source_table", "key.rec_key", "kind", "item")


def p6_text(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).select("key.source_table", "key.rec_key", "text")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.divided(packing.pack(table(spark, d, "documents"))).select(F.col("key").alias("doc_id"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents")).withColumnRenamed("key", "doc_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(packing.pack(table(spark, d, "documents")))


#: Wanted shares of the series of volumes.
SERIES_SHARES = {"S1": 0.3, "S2": 0.2, "S3": 0.2, "S4": 0.2, "S5": 0.1}


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", F.substring("source", 1, 2).alias("source"))
    return packing.mixture(packing.pack(docs, window_containers=16, shares=SERIES_SHARES), SERIES_SHARES)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_pairs(table(spark, d, "documents")).toDF("doc_a", "doc_b")


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_membership(table(spark, d, "documents")).toDF("doc_id", "class_id", "texts")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_entities, p3_found, p3_terms, p3_bigrams, p3_trigrams, p4_found, p5_found, p5_sample, p5_strata, p5_report, p6_found, p6_text, p7_ids, p8_found, p8_containers, p8_report, p8_mixture, p9_found, p9_classes)}

_TERMS = """
WITH rec AS (SELECT speech_id, min(speech) AS speech FROM speeches WHERE speech_id IS NOT NULL AND speech IS NOT NULL GROUP BY speech_id),
tok AS (SELECT speech_id, unnest(regexp_extract_all(lower(speech), '[a-z]+')) AS term FROM rec),
cnt AS (SELECT term, count(*)::BIGINT AS occurrences, count(DISTINCT speech_id)::BIGINT AS records FROM tok GROUP BY term),
marked AS (SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records * 5 > (SELECT count(*) FROM rec) THEN 'common' END AS mark FROM cnt)
"""

_STRATA = """
WITH rec AS (SELECT id, min({'decade': ((year // 10) * 10)::INTEGER, 'haiku': haiku}) AS s FROM opus_vs_haiku
  WHERE id IS NOT NULL AND year IS NOT NULL AND haiku IN ('negative_liberty', 'positive_liberty', 'ambiguous', 'other') GROUP BY id),
cnt AS (SELECT s.decade AS decade, s.haiku AS haiku, count(*) AS n FROM rec GROUP BY ALL),
u AS (SELECT count(*) // 10 AS n FROM rec)"""

ORACLES = {
    "p3_found": _TERMS + "SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p3_terms": _TERMS + "SELECT term, occurrences, records, mark FROM marked",
    "p3_bigrams": """
WITH rec AS (SELECT speech_id, min(speech) AS speech FROM speeches WHERE speech_id IS NOT NULL AND speech IS NOT NULL GROUP BY speech_id),
arr AS (SELECT speech_id, regexp_extract_all(lower(speech), '[a-z]+') AS w FROM rec),
big AS (SELECT speech_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM arr WHERE len(w) > 1)
SELECT term, count(*)::BIGINT AS occurrences, count(DISTINCT speech_id)::BIGINT AS records FROM big GROUP BY term""",
    "p3_trigrams": """
WITH rec AS (SELECT speech_id, min(speech) AS speech FROM speeches WHERE speech_id IS NOT NULL AND speech IS NOT NULL GROUP BY speech_id),
arr AS (SELECT speech_id, regexp_extract_all(lower(speech), '[a-z]+') AS w FROM rec),
tri AS (SELECT speech_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS term FROM arr WHERE len(w) > 2)
SELECT term, count(*)::BIGINT AS occurrences, count(DISTINCT speech_id)::BIGINT AS records FROM tri GROUP BY term""",
    "p5_found": _STRATA + """
SELECT t.decade, t.haiku FROM sample_targets t CROSS JOIN u LEFT JOIN cnt USING (decade, haiku)
WHERE coalesce(cnt.n, 0) < greatest(t.min_rows, t.share_pm * u.n // 1000)""",
    "p5_strata": _STRATA + """
SELECT coalesce(t.decade, cnt.decade) AS decade, coalesce(t.haiku, cnt.haiku) AS haiku, t.haiku IS NOT NULL AS targeted, coalesce(cnt.n, 0)::BIGINT AS available,
  coalesce(greatest(t.min_rows, t.share_pm * u.n // 1000), 0)::BIGINT AS wanted FROM sample_targets t FULL JOIN cnt ON t.decade = cnt.decade AND t.haiku = cnt.haiku CROSS JOIN u""",
}
