"""Whole analyses: each composes operators from files to named results, written as JSON.

``python -m chronolex.analyses NAME --data-dir DIR --output DIR`` runs one; see ``ANALYSES``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.functions import vectors as V
from chronolex.operators import corpus, labels, stats, temporal
from chronolex.sources import readers


def _labelled(spark: SparkSession, data_dir: str) -> DataFrame:
    rows = readers.read_sentence_json(spark, f"{data_dir}/sentences_*s.json")
    llm = F.col("methods")["llm"]
    return rows.withColumn("haiku", F.coalesce(F.get_json_object(llm, "$.label"), llm))


def label_trends(spark: SparkSession, data_dir: str, min_denominator: int = 30) -> dict[str, DataFrame]:
    """Labels of sentence files by decade, their intervals and the four trend tests."""
    counts = labels.counts_by_decade(_labelled(spark, data_dir))
    return {"by_decade": counts, "shares": labels.shares(counts, 1), "trend_tests": labels.weighted_trends(labels.trend_points(counts, min_denominator))}


def manifest(spark: SparkSession, data_dir: str) -> dict[str, DataFrame]:
    """Checks of sentence files against their index, labels and years that are missing."""
    rows = _labelled(spark, data_dir)
    index = spark.read.option("multiLine", True).option("pathGlobFilter", "index.json").schema("total_sentences long").json(data_dir).first()
    counts = rows.select(F.explode(F.map_keys("methods")).alias("method")).groupBy("method").agg(F.count("*").alias("n"))
    by_label = rows.groupBy(labels.normalise(F.col("haiku")).alias("label")).agg(F.count("*").alias("n"))
    return {"checks": labels.manifest(rows, index.total_sentences if index else None), "method_counts": counts, "label_counts": by_label, "missing_years": corpus.missing_ranges(rows)}


def annotation_sample(spark: SparkSession, data_dir: str, per_bucket: int = 10, seed: str = "42") -> dict[str, DataFrame]:
    """A stratified sample of sentence files as a sheet for annotators."""
    rows = _labelled(spark, data_dir).withColumn("eval_id", F.col("id"))
    keys = labels.stratified_sample(rows, per_bucket, seed).select("eval_id").distinct()
    return {"sheet": readers.annotation_rows(rows.join(keys, "eval_id", "left_semi").withColumn("llm_label", labels.normalise(F.col("haiku"))))}


def speeches(spark: SparkSession, data_dir: str) -> dict[str, DataFrame]:
    """Speech files: yearly frequency, collocates, first contexts and sentences."""
    raw = readers.read_speech_csv(spark, f"{data_dir}/*.csv")
    s = corpus.speeches(raw.select(F.xxhash64("date", "speaker", "text").alias("row_id"), F.col("date").alias("speech_date"), F.col("speaker").alias("display_as"), "party", F.col("text").alias("speech")))
    return {"frequency": corpus.yearly_frequency(s), "collocates": corpus.top_collocates(corpus.collocate_counts(s)), "contexts": corpus.first_contexts(s, corpus.TARGETS[0]), "sentences": corpus.sentence_records(s)}


def prints(spark: SparkSession, data_dir: str, normalise: bool = True) -> dict[str, DataFrame]:
    """Binned early prints: contexts, their collocates with domains, and sizes of bins."""
    docs = readers.read_binned(spark, data_dir)
    found = corpus.kwic(docs, "tcp_id", "text")
    n = corpus.kwic_collocates(found, normalise).orderBy(F.desc("n"), "word").limit(100)
    return {"contexts": found, "collocates": corpus.tag_domains(n.withColumnRenamed("word", "collocate"), corpus.lexicon(spark)), "bins": docs.groupBy("bin").agg(F.count("*").alias("docs"), F.sum("word_count").alias("words"))}


def spaces(spark: SparkSession, data_dir: str, agency: list[str], constraint: list[str], words: list[str], period: int = 1900) -> dict[str, DataFrame]:
    """Saved vectors: trajectories, expanded axis with trends and change-points, permutation test, neighbours."""
    v = readers.read_saved_vectors(spark, data_dir)
    axis = temporal.expanded_axes(v, {"": (agency, constraint)}, period).select("axis")
    y = temporal.project(v, axis, words).select(F.col("word").alias("series"), F.col("period").alias("x"), F.col("projection").alias("y"))
    t = stats.trend(y)
    near = temporal.knn(v, words, 10, with_vectors=True)
    return {
        "trajectory": temporal.trajectory(temporal.pick(v, words)), "projection": y, "trend": t.withColumn("p", stats.two_sided_p(F.col("z"))), "change_points": stats.change_point(y), "permutation": stats.permutation_trend(y),
        "against_controls": stats.against_controls(t, "series", words[0]), "turnover": temporal.turnover(near), "coherence": temporal.coherence(near), "norms": v.groupBy("period").agg(F.avg(V.norm(F.col("vec"))).alias("mean_norm")),
    }


ANALYSES = {"label-trends": label_trends, "manifest": manifest, "sample": annotation_sample, "speeches": speeches, "prints": prints, "spaces": spaces}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="chronolex.analyses")
    p.add_argument("name", choices=ANALYSES)
    p.add_argument("--data-dir", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--min-denominator", type=int, default=30)
    p.add_argument("--per-bucket", type=int, default=10)
    p.add_argument("--seed", default="42")
    for pole in ("agency", "constraint", "words"):
        p.add_argument(f"--{pole}", nargs="*", default=[])
    a = p.parse_args(argv)
    own = {"label-trends": {"min_denominator": a.min_denominator}, "sample": {"per_bucket": a.per_bucket, "seed": a.seed}, "spaces": {"agency": a.agency, "constraint": a.constraint, "words": a.words}}
    spark = SparkSession.builder.getOrCreate()
    for name, df in ANALYSES[a.name](spark, a.data_dir, **own.get(a.name, {})).items():
        readers.write_result(df, f"{a.output}/{name}")


if __name__ == "__main__":
    main()
