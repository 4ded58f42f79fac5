"""Speeches to dated sentence records, frequencies, contexts, collocates and domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.functions import text as X

TARGETS = ("freedom", "liberty")
# The English list of the Snowball project as Spark's StopWordsRemover ships it, words of three plain letters or more.
STOPWORDS = tuple(
    (
        "myself our ours ourselves you your yours yourself yourselves him his himself she her hers herself its itself they them their theirs themselves what which who whom this "
        "that these those are was were been being have has had having does did doing the and but because until while for with about against between into through during before "
        "after above below from down out off over under again further then once here there when where why how all any both each few more most other some such nor not only own same "
        "than too very can will just don should now cannot could ought would "
    ).split()
)
# The default profile of domains, in order of precedence.
LEXICON = {
    "government": "committee house member minister bill clause vote governor motion amendment", "commerce": "trade toll rate tariff canal dock ferry wharf market fund",
    "law": "statute court charter ordinance law judge juror tribunal magistrate", "property": "land estate lease mortgage tenant freehold enclosure dowry",
    "welfare": "poor hospital school almshouse pension women orphan widow", "defence": "militia garrison dockyard peace regiment seamen barrack",
    "faith": "religious bishop tithe parish conscience", "rights": "liberty freedom franchise consent conscience charter privilege",
}
AGENCY = ("consent", "franchise", "freedom", "vote", "conscience", "self", "privilege", "opinion", "voluntary")
CONSTRAINT = ("duty", "tax", "toll", "excise", "tariff", "quarantine", "blockade", "compulsory", "arbitrary")


def speeches(df: DataFrame) -> DataFrame:
    """``(speech_id, date, year, decade, speaker, party, text)`` with usable text and year."""
    year = X.year_of(F.col("speech_date"))
    return (
        df.select(F.col("row_id").alias("speech_id"), F.col("speech_date").alias("date"), year.alias("year"), X.clean_speaker(F.col("display_as")).alias("speaker"), F.col("party"), F.col("speech").alias("text"))
        .where((F.length("text") > 10) & F.col("year").isNotNull())
        .withColumn("decade", X.decade_of(F.col("year")))
    )


def yearly_frequency(df: DataFrame, targets=TARGETS, least: int = 10) -> DataFrame:
    """Speeches a year, and how many hold each target, as counts and per thousand."""
    a, b = targets
    g = df.groupBy("year").agg(F.count("*").alias("total"), F.sum(X.has_word(F.col("text"), a).cast("long")).alias("first_count"), F.sum(X.has_word(F.col("text"), b).cast("long")).alias("second_count"))
    rate = lambda c: F.round(F.col(c) / F.col("total") * 1000, 4)
    return g.where(F.col("total") >= least).select("year", "total", "first_count", "second_count", rate("first_count").alias("first_rate"), rate("second_count").alias("second_rate"))


def sentence_records(df: DataFrame, targets=TARGETS, shortest: int = 15, longest: int = 500) -> DataFrame:
    """Sentences that hold a target; the first target wins where both do.

    Speeches without a target are dropped before they are split.
    """
    a, b = targets
    t = F.col("text")
    found = df.where(X.has_word(t, a) | X.has_word(t, b)).select("*", F.posexplode(X.sentences(t)).alias("idx", "raw"))
    s = X.strip(F.col("raw"))
    kept = found.withColumn("sentence", s).where(F.length("sentence").between(shortest, longest) & (X.has_word(F.col("sentence"), a) | X.has_word(F.col("sentence"), b)))
    return kept.select("speech_id", "idx", X.stable_id(F.col("date"), F.col("speaker"), F.col("idx")).alias("id"), "sentence", F.when(X.has_word(F.col("sentence"), a), a).otherwise(b).alias("word"), "year", "decade", "date", "speaker", "party")


def pole_score(sentence: Column, agency=AGENCY, constraint=CONSTRAINT) -> tuple[Column, Column, Column]:
    """Counts of agency and constraint words, and their balance in [-1, 1] (0 without any)."""
    w = X.words(sentence)
    up, down = F.size(F.filter(w, lambda x: x.isin(*agency))), F.size(F.filter(w, lambda x: x.isin(*constraint)))
    return up, down, F.when(up + down == 0, 0.0).otherwise(F.round((up - down) / (up + down), 4))


def frequency_context(sentences: DataFrame, yearly: DataFrame, rising: float = 12.0) -> DataFrame:
    """Each sentence with the rate of its word in its year; years without a rate are unknown."""
    joined = sentences.join(yearly.select("year", "first_rate", "second_rate"), "year", "left")
    rate = F.when(F.col("word") == TARGETS[0], F.col("first_rate")).otherwise(F.col("second_rate"))
    return joined.select("speech_id", "idx", "word", F.coalesce(rate, F.lit(0.0)).alias("rate"), F.when(rate.isNull(), "unknown").when(rate > rising, "rising").otherwise("falling").alias("trend"))


def first_contexts(df: DataFrame, word: str, per_decade: int = 5, least: int = 20, most: int = 300) -> DataFrame:
    """The first sentences of each decade that hold ``word``, one a speech."""
    found = F.filter(F.regexp_extract_all("text", F.lit(rf"(?i)[^.]*\b{word}\b[^.]*\."), F.lit(0)), lambda s: (F.length(X.strip(s)) > least) & (F.length(X.strip(s)) < most))
    one = df.where(X.has_word(F.col("text"), word)).select("decade", "speech_id", X.strip(F.get(found, F.lit(0))).alias("context")).where("context is not null")
    n = F.row_number().over(Window.partitionBy("decade").orderBy("speech_id"))
    return one.withColumn("n", n).where(F.col("n") <= per_decade).select("decade", "speech_id", "context")


def collocate_counts(df: DataFrame, targets=TARGETS, window: int = 10, stopwords=STOPWORDS) -> DataFrame:
    """``(word, decade, collocate, n)``: words near each target; overlapping windows count twice."""
    toks = df.where(X.has_word(F.col("text"), targets[0]) | X.has_word(F.col("text"), targets[1])).select("decade", X.words(F.col("text")).alias("w"))
    hit = toks.select("decade", "w", F.explode(F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: F.element_at("w", i).isin(*targets))).alias("at")).where(F.size("w") > 0)
    low = F.greatest(F.col("at") - window, F.lit(1))
    near = F.concat(F.slice("w", low, F.col("at") - low), F.slice("w", F.col("at") + 1, window))
    pairs = hit.select("decade", F.element_at("w", F.col("at")).alias("word"), F.explode(near).alias("collocate"))
    return pairs.where((F.length("collocate") > 2) & ~F.col("collocate").isin(*stopwords) & (F.col("collocate") != F.col("word"))).groupBy("word", "decade", "collocate").agg(F.count("*").alias("n"))


def top_collocates(counts: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent collocates of each word and decade; ties by spelling."""
    n = F.row_number().over(Window.partitionBy("word", "decade").orderBy(F.desc("n"), "collocate"))
    return counts.withColumn("place", n).where(F.col("place") <= k)


def lexicon(spark, domains: dict[str, str] = LEXICON) -> DataFrame:
    """``(word, domain, domain_rank)``; about a hundred rows, given by the caller."""
    rows = [(w, d, i) for i, (d, ws) in enumerate(domains.items()) for w in ws.split()]
    return spark.createDataFrame(rows, "word string, domain string, domain_rank int")


def tag_domains(words: DataFrame, lex: DataFrame, column: str = "collocate") -> DataFrame:
    """A row for each domain of each word; words of no domain are 'untagged'."""
    return words.join(lex, words[column] == lex["word"], "left").select(*[words[c] for c in words.columns], F.coalesce("domain", F.lit("untagged")).alias("domain"), F.coalesce("domain_rank", F.lit(99)).alias("domain_rank"))


def domain_words(lex: DataFrame, domain: str) -> DataFrame:
    return lex.where(F.col("domain") == domain).select("word")


def sentence_domains(sentences: DataFrame, lex: DataFrame, top: int = 2) -> DataFrame:
    """``(speech_id, idx, domains MAP<domain, count>, top)`` of sentences with a word of any domain."""
    words = sentences.select("speech_id", "idx", F.explode(X.words(F.col("sentence"))).alias("t"))
    n = words.join(lex, words.t == F.col("word")).groupBy("speech_id", "idx", "domain").agg(F.count("*").alias("n"))
    g = n.groupBy("speech_id", "idx").agg(F.collect_list(F.struct("domain", "n")).alias("d"))  # at most one entry a domain
    first = F.slice(F.transform(F.array_sort(F.transform("d", lambda x: F.struct((-x["n"]).alias("m"), x["domain"].alias("domain")))), lambda x: x["domain"]), 1, top)
    return g.select("speech_id", "idx", F.map_from_entries("d").alias("domains"), first.alias("top"))


def kwic_collocates(contexts: DataFrame, normalise: bool = False, stopwords=STOPWORDS) -> DataFrame:
    """``(word, n)``: words of both sides of contexts, without short and empty ones; early spelling may be made modern first."""
    both = F.concat_ws(" ", "left_context", "right_context")
    words = contexts.select(F.explode(X.words(X.normalise_spelling(both) if normalise else both)).alias("word"))
    return words.where((F.length("word") > 2) & ~F.col("word").isin(*stopwords)).groupBy("word").agg(F.count("*").alias("n"))


def kwic(df: DataFrame, key: str, text: str, words=TARGETS, span: int = 10) -> DataFrame:
    """``(key, position, match, left_context, right_context)`` for tokens that begin with a target word."""
    pattern = rf"^(?i)({'|'.join(words)})\b"
    toks = df.where(F.lower(text).rlike("|".join(words))).select(F.col(key).alias("key"), X.blank_tokens(F.col(text)).alias("w")).where(F.size("w") > 0)
    at = toks.select("key", "w", F.posexplode("w").alias("position", "match")).where(F.col("match").rlike(pattern))
    low = F.greatest(F.col("position") - span, F.lit(0))
    return at.select("key", "position", "match", F.array_join(F.slice("w", low + 1, F.col("position") - low), " ").alias("left_context"), F.array_join(F.slice("w", F.col("position") + 2, span), " ").alias("right_context"))


def missing_ranges(years: DataFrame, column: str = "year") -> DataFrame:
    """Runs of years without a row between the first and the last."""
    have = years.select(F.col(column).alias("y")).where("y is not null").distinct()
    ends = have.agg(F.min("y").alias("a"), F.max("y").alias("b"))
    every = ends.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("y"))
    gaps = every.join(have, "y", "left_anti").withColumn("run", F.col("y") - F.row_number().over(Window.orderBy("y")))
    return gaps.groupBy("run").agg(F.min("y").alias("first_year"), F.max("y").alias("last_year"), F.count("*").alias("years")).drop("run")


def vocabulary(df: DataFrame, text: str, k: int) -> DataFrame:
    """The k most frequent words; ties by spelling."""
    counts = df.select(F.explode(X.words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(k)
