"""Readers for speeches, debates, contexts, vectors and dumps; sinks for records and results."""

from __future__ import annotations

import csv
import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolex.functions import text as X

SPEECH_CSV = T.StructType([T.StructField(n, T.StringType()) for n in ("speech_date", "date", "speech", "text", "display_as", "speaker", "party", "mnis_id")])
SENTENCE_JSON = "id string, sentence string, word string, year int, date string, speaker string, party string, methods map<string,string>"


def read_speech_csv(spark: SparkSession, path: str) -> DataFrame:
    """Speeches of a CSV file with a header; columns outside the allow-list are dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    have = [f.name for f in SPEECH_CSV if f.name in df.columns]
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have], F.lit(None).cast("string"))
    date, body = pick("speech_date", "date"), pick("speech", "text")
    return df.select(date.alias("date"), X.year_of(date).alias("year"), pick("display_as", "speaker").alias("speaker"), pick("party").alias("party"), body.alias("text")).where(F.length("text") > 10)


def element_text(xml: Column, path: str) -> Column:
    """All text below a path, joined by single blanks."""
    return X.strip(F.regexp_replace(F.array_join(F.xpath(xml, F.lit(f"{path}//text()")), " "), r"\s+", " "))


def shallow_text(xml: Column, path: str) -> Column:
    """Text of a path and of its children, not of theirs."""
    return X.strip(F.regexp_replace(F.array_join(F.xpath(xml, F.lit(f"{path}/text()|{path}/*/text()")), " "), r"\s+", " "))


def year_of_volume(name: Column) -> Column:
    """Year of a volume named S<series>V<number>, interpolated over the years of its series."""
    # First and last year and number of volumes of each series.
    spans = {"1": (1803, 1820, 41), "2": (1820, 1830, 25), "3": (1830, 1891, 356), "4": (1892, 1908, 199), "5": (1909, 1981, 1000)}
    series = F.regexp_extract(name, r"^S(\d)V(\d{4})", 1)
    volume = F.nullif(F.regexp_extract(name, r"^S(\d)V(\d{4})", 2), F.lit("")).cast("int")
    out = F.lit(None).cast("int")
    for s, (a, b, top) in spans.items():
        out = F.when(series == s, (F.lit(a) + F.floor(F.least(volume / top, F.lit(1.0)) * (b - a))).cast("int")).otherwise(out)
    return out


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path).select(F.col("value").alias("xml"), F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+?)(?:\.\w+)?$", 1).alias("stem"))


def read_archive_xml(spark: SparkSession, path: str, least: int = 20, before: int | None = 1920) -> DataFrame:
    """Paragraphs of archive volumes: speaker and text of every <p>; short ones are dropped.

    Volumes whose name gives no year, or one from ``before`` on (other sources cover
    those), are dropped; None keeps them.  A volume is read whole, one task a file.
    """
    files = _whole_files(spark, path)
    p = files.select("stem", F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<p(?:\s[^>]*)?>.*?</p>"), F.lit(0))).alias("p"))
    said = element_text(F.col("p"), "/p/membercontribution")
    body = F.when(said != "", said).otherwise(element_text(F.col("p"), "/p"))
    rows = p.select("stem", X.clean_speaker(element_text(F.col("p"), "/p/member")).alias("speaker"), body.alias("text"))
    return rows.where(F.length("text") >= least).select(F.col("stem").alias("source_file"), year_of_volume(F.col("stem")).alias("year"), "speaker", "text").where("year is not null" if before is None else f"year < {before}")


def read_debates_xml(spark: SparkSession, path: str) -> DataFrame:
    """Speeches of daily debate files named by date; files without a date are dropped."""
    files = _whole_files(spark, path).withColumn("date", F.regexp_extract("stem", r"\d{4}-\d{2}-\d{2}", 0)).where("date != ''")
    s = files.select("date", F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<speech[\s>].*?</speech>"), F.lit(0))).alias("s"))
    attr = lambda a: F.element_at(F.xpath(F.col("s"), F.lit(f"/speech/@{a}")), 1)
    have = F.size(F.xpath(F.col("s"), F.lit("/speech/@speakername"))) > 0
    return s.select("date", X.year_of(F.col("date")).alias("year"), F.when(F.size(F.xpath(F.col("s"), F.lit("/speech/@person_id"))) > 0, attr("person_id")).alias("person_id"), X.clean_speaker(F.when(have, attr("speakername"))).alias("speaker"), shallow_text(F.col("s"), "/speech/p").alias("text"))


def read_sentence_json(spark: SparkSession, path: str) -> DataFrame:
    """Sentence records of JSON arrays; method names are kept open."""
    return spark.read.schema(SENTENCE_JSON).option("multiLine", True).json(path)


PRINT = "tcp_id string, year int, title string, text string, word_count long"
CONTEXTS = "year int, title string, context_count int, contexts array<struct<left_context:string,right_context:string,full_context:string>>"


def read_binned(spark: SparkSession, folder: str, schema: str = PRINT, prefix: str = "eebo", bin_label: str = "*") -> DataFrame:
    """Records of ``prefix_<bin>.json`` with their ``bin``; a bin without a file has no rows."""
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", f"{prefix}_{bin_label}.json").json(folder)
    return rows.withColumn("bin", F.regexp_extract(F.col("_metadata.file_name"), rf"^{prefix}_(.+)\.json$", 1))


def read_contexts(spark: SparkSession, folder: str, bin_label: str = "*") -> DataFrame:
    """``(bin, year, title, left_context, right_context, full_context)`` of context bundles, one row a context."""
    bundles = read_binned(spark, folder, CONTEXTS, "freedom_contexts", bin_label)
    return bundles.select("bin", "year", "title", F.explode("contexts").alias("c")).select("bin", "year", "title", "c.*")


def read_saved_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``(period, word, vec)`` of saved matrices ``<period>-w.npy`` with words in ``<period>-vocab.json``.

    Pickled vocabularies are refused: they can run code.  A period that lacks one of its
    two files is skipped.  A matrix is one task, its rows leave in batches.
    """
    named = lambda end: spark.read.format("binaryFile").option("pathGlobFilter", f"*-{end}").load(folder).select(F.regexp_extract("path", rf"(\d+)-{end}$", 1).cast("int").alias("period"), "content")

    def rows(batches):
        for pdf in batches:
            for period, content in pdf.itertuples(index=False, name=None):
                m = np.load(io.BytesIO(content), allow_pickle=False)
                for a in range(0, len(m), 10_000):
                    part = m[a : a + 10_000].astype(np.float32)
                    yield pd.DataFrame({"period": period, "i": np.arange(a, a + len(part)), "vec": list(part)})

    words = named("vocab.json").select("period", F.posexplode(F.from_json(F.col("content").cast("string"), "array<string>")).alias("i", "word"))
    return named("w.npy").mapInPandas(rows, "period int, i int, vec array<float>").join(words, ["period", "i"]).select("period", "word", "vec")


def read_glove(spark: SparkSession, path: str, limit: int = 50_000) -> DataFrame:
    """The first words of a text file of vectors; malformed lines are skipped."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("i")).where(F.size(F.split("value", " ")) >= 10)
    parts = F.split("value", " ")
    return lines.orderBy("i").limit(limit).select(parts[0].alias("word"), F.transform(F.slice(parts, 2, 100_000), lambda x: x.cast("float")).alias("vec"))


def read_ngrams(spark: SparkSession, path: str, first_year: int) -> DataFrame:
    """``(series, year, value)`` of saved answers of an n-gram service: arrays of ``{ngram, timeseries}``, the first of each file."""
    rows = spark.read.schema("ngram string, timeseries array<double>").option("multiLine", True).json(path).withColumn("f", F.col("_metadata.file_path"))
    one = rows.where("timeseries is not null").groupBy("f").agg(F.first(F.struct("ngram", "timeseries")).alias("x"))
    return one.select(F.col("x.ngram").alias("series"), F.posexplode("x.timeseries").alias("i", "value")).select("series", (F.col("i") + first_year).alias("year"), "value")


def read_trends(spark: SparkSession, path: str) -> DataFrame:
    """``(series, at, value)`` of saved search interest: CSV with a date and a column for each term."""
    wide = spark.read.option("header", True).csv(path)
    at, *terms = [c for c in wide.columns if c.lower() != "ispartial"]
    return wide.unpivot([at], terms, "series", "value").select("series", F.col(at).alias("at"), F.col("value").try_cast("double").alias("value")).where("value is not null")


def read_batch_results(spark: SparkSession, path: str) -> DataFrame:
    """``(custom_id, label, rationale)`` of a finished batch as JSON lines; what did not succeed is labelled 'error'."""
    kind = "custom_id string, result struct<type:string,label:string,rationale:string>"
    r = spark.read.schema(kind).json(path)
    good = F.col("result.type").eqNullSafe("succeeded")
    return r.select("custom_id", F.when(good, F.coalesce("result.label", F.lit("error"))).otherwise("error").alias("label"), F.when(good, F.col("result.rationale")).otherwise(F.col("result.type")).alias("rationale"))


def read_respellings(path: str) -> dict[str, str]:
    """A table of respellings (old, new; CSV on the driver) for ``text.normalise_spelling``."""
    with open(path, encoding="utf-8", newline="") as f:
        return {old.strip().lower(): new.strip() for old, new, *_ in csv.reader(f) if old.strip()}


def read_wiki_dump(spark: SparkSession, path: str, least: int = 5) -> DataFrame:
    """Token lines of a wiki dump (plain or compressed XML)."""
    body = spark.read.format("xml").option("rowTag", "text").schema("_VALUE string").load(path)
    line = F.explode(F.split(X.strip_markup(F.lower("_VALUE")), "\n"))
    return body.select(line.alias("l")).select(X.words(F.col("l")).alias("tokens")).where(F.size("tokens") >= least)


def sentence_index(sentences: DataFrame) -> DataFrame:
    """One row ``index``: totals, counts by decade and sorted facets, as JSON."""
    files = sentences.groupBy("decade").agg(F.count("*").alias("count"), F.collect_set("party").alias("p"), F.collect_set("year").alias("y"))
    every = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c))))
    return files.agg(F.to_json(F.struct(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_sentences"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("decade").cast("string"), "count")))).alias("files"),
        F.struct(F.sort_array(F.collect_list("decade")).alias("decades"), every("p").alias("parties"), every("y").alias("years")).alias("facets"),
    )).alias("index"))


def write_by_decade(sentences: DataFrame, path: str) -> None:
    """One folder of JSON lines a decade, and a folder ``_index`` that holds their index."""
    sentences.write.partitionBy("decade").mode("overwrite").json(path)
    sentence_index(sentences).coalesce(1).write.mode("overwrite").text(f"{path}/_index")


def write_result(result: DataFrame, path: str) -> None:
    """A small result as one file of JSON lines."""
    result.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def annotation_rows(rows: DataFrame, label: str = "llm_label") -> DataFrame:
    """The columns of an annotation sheet: missing values as '', columns for annotators left blank."""
    # The columns of the sheet in order.
    blank = ["annotator_1", "annotator_2", "adjudicated_label", "notes"]
    have = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    kept = rows.where("year is not null")
    named = [have(c).alias(c) for c in ("date", "word", "speaker", "party", "sentence")]
    return kept.select(have("id").alias("id"), X.decade_of(F.col("year")).alias("decade"), "year", *named, have(label).alias("llm_label"), *[F.lit("").alias(c) for c in blank])


def write_annotations(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).mode("overwrite").csv(path)


def write_vectors(vectors: DataFrame, counts: DataFrame, path: str, most: int = 50_000) -> None:
    """``vectors(period, word, vec)`` of the most frequent words of ``counts(word, n)``, by period."""
    top = counts.orderBy(F.desc("n"), "word").limit(most).select("word")
    vectors.join(top, "word", "left_semi").write.partitionBy("period").mode("overwrite").parquet(path)


def write_labels(current: DataFrame, path: str, form: str = "csv") -> None:
    """Labels as ``id, label, timestamp, notes``: CSV with doubled quotes, or JSON lines."""
    rows = current.select("id", "label", F.col("labelled_at").alias("timestamp"), "notes")
    w = rows.coalesce(1).write.mode("overwrite")
    w.option("header", True).option("quote", '"').option("escape", '"').csv(path) if form == "csv" else w.json(path)


def import_labels(current: DataFrame, imported: DataFrame) -> DataFrame:
    """Labels of both, by id; the later timestamp wins, the imported one among equals."""
    both = current.select("id", "label", "labelled_at", "notes", F.lit(0).alias("new")).unionByName(imported.select("id", "label", "labelled_at", "notes", F.lit(1).alias("new")))
    return both.groupBy("id").agg(F.max_by(F.struct("label", "labelled_at", "notes"), F.struct("labelled_at", "new")).alias("x")).select("id", "x.*")


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").text(path)
