"""The registered queries of the core operators, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.functions import text as X
from chronolex.functions import vectors as V
from chronolex.operators import corpus, labels, series, stats, temporal
from chronolex.runtime import table
from chronolex.streaming import labels as live

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- corpus

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_SPEECHES = r"""
sp AS (SELECT * FROM (SELECT row_id AS speech_id, speech_date AS date, CASE WHEN regexp_matches(speech_date, '^[0-9]{4}') THEN CAST(substr(speech_date, 1, 4) AS INTEGER) END AS year,
  coalesce(nullif(trim(regexp_replace(regexp_replace(display_as, '\s*\([^)]*\)\s*$', ''), '[,;.]+\s*$', ''), E' \t\n'), ''), 'Unknown') AS speaker, party, speech AS text FROM speeches)
  WHERE length(text) > 10 AND year IS NOT NULL),
spd AS (SELECT *, (year // 10 * 10)::INTEGER AS decade, coalesce(contains(lower(text), 'freedom'), false) AS a, coalesce(contains(lower(text), 'liberty'), false) AS b FROM sp)
"""
_YEARLY = """
yearly AS (SELECT year, count(*)::BIGINT AS total, sum(a::INT)::BIGINT AS first_count, sum(b::INT)::BIGINT AS second_count FROM spd GROUP BY year HAVING count(*) >= 10),
freq AS (SELECT *, round(first_count / total * 1000, 4) AS first_rate, round(second_count / total * 1000, 4) AS second_rate FROM yearly)
"""
_SENT = r"""
raw AS (SELECT *, unnest(regexp_extract_all(text, '[^.!?;]+[.!?;]?')) AS r, generate_subscripts(regexp_extract_all(text, '[^.!?;]+[.!?;]?'), 1)::INTEGER - 1 AS idx FROM spd WHERE a OR b),
st AS (SELECT *, regexp_replace(r, '^\s+|\s+$', '', 'g') AS sentence FROM raw),
sent AS (SELECT speech_id, idx, date || '-' || substr(md5(concat_ws('-', date, speaker, idx)), 1, 6) || '-' || CASE WHEN idx < 1000 THEN lpad(idx::VARCHAR, 3, '0') ELSE idx::VARCHAR END AS id,
  sentence, CASE WHEN contains(lower(sentence), 'freedom') THEN 'freedom' ELSE 'liberty' END AS word, year, decade, date, speaker, party FROM st
  WHERE length(sentence) BETWEEN 15 AND 500 AND (contains(lower(sentence), 'freedom') OR contains(lower(sentence), 'liberty')))
"""
_list = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"
_POLE = f"""
toks AS (SELECT speech_id, idx, word, decade, party, unnest(regexp_extract_all(lower(sentence), '[a-z]+')) AS t FROM sent),
pole AS (SELECT speech_id, idx, word, decade, party, sum((t IN {_list(corpus.AGENCY)})::INT)::INTEGER AS agency, sum((t IN {_list(corpus.CONSTRAINT)})::INT)::INTEGER AS "constraint" FROM toks GROUP BY ALL),
score AS (SELECT *, CASE WHEN agency + "constraint" = 0 THEN 0.0::DOUBLE ELSE round((agency - "constraint") / (agency + "constraint"), 4) END AS score FROM pole)
"""
_W = f"WITH {_SPEECHES}"


def _speeches(spark: SparkSession, d: str) -> DataFrame:
    return corpus.speeches(table(spark, d, "speeches"))


@query(f"{_W}, {_YEARLY} SELECT year, total, first_count, second_count, first_rate, second_rate FROM freq")
def yearly_term_frequency(spark, d):
    return corpus.yearly_frequency(_speeches(spark, d))


@query(f"{_W}, {_SENT} SELECT * FROM sent")
def sentence_extract(spark, d):
    return corpus.sentence_records(_speeches(spark, d))


def _scores(spark, d) -> DataFrame:
    s = corpus.sentence_records(_speeches(spark, d))
    up, down, score = corpus.pole_score(F.col("sentence"))
    return s.select("speech_id", "idx", "word", "decade", "party", up.alias("agency"), down.alias("constraint"), score.alias("score"))


@query(f"{_W}, {_SENT}, {_POLE} SELECT speech_id, idx, agency, \"constraint\", score FROM score")
def sentence_pole_score(spark, d):
    return _scores(spark, d).select("speech_id", "idx", "agency", "constraint", "score")


@query(f"{_W}, {_YEARLY}, {_SENT}, j AS (SELECT s.*, CASE WHEN word = 'freedom' THEN first_rate ELSE second_rate END AS rt FROM sent s LEFT JOIN freq USING (year)) SELECT speech_id, idx, word, coalesce(rt, 0.0::DOUBLE) AS rate, CASE WHEN rt IS NULL THEN 'unknown' WHEN rt > 12 THEN 'rising' ELSE 'falling' END AS trend FROM j")
def sentence_freq_context(spark, d):
    sp = _speeches(spark, d)
    return corpus.frequency_context(corpus.sentence_records(sp), corpus.yearly_frequency(sp))


@query(rf"""{_W}, c AS (SELECT decade, speech_id, list_filter(list_transform(regexp_extract_all(text, '(?i)[^.]*\bfreedom\b[^.]*\.'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) > 20 AND length(s) < 300)[1] AS context FROM spd WHERE a),
n AS (SELECT *, row_number() OVER (PARTITION BY decade ORDER BY speech_id) AS n FROM c WHERE context IS NOT NULL) SELECT decade, speech_id, context FROM n WHERE n <= 5""")
def first_contexts_per_decade(spark, d):
    return corpus.first_contexts(_speeches(spark, d), "freedom")


_COLL = f"""
tk AS (SELECT speech_id, decade, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM (SELECT speech_id, decade, regexp_extract_all(lower(text), '[a-z]+') AS w FROM spd WHERE a OR b)),
co AS (SELECT x.t AS word, x.decade, y.t AS collocate, count(*)::BIGINT AS n FROM tk x JOIN tk y ON x.speech_id = y.speech_id AND x.p <> y.p AND abs(x.p - y.p) <= 10
  WHERE x.t IN ('freedom', 'liberty') AND length(y.t) > 2 AND y.t NOT IN {_list(corpus.STOPWORDS)} AND y.t <> x.t GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word, decade ORDER BY n DESC, collocate)::INTEGER AS place FROM co) WHERE place <= 20)
"""


@query(f"{_W}, {_COLL} SELECT * FROM top")
def collocates_window_topk(spark, d):
    return corpus.top_collocates(corpus.collocate_counts(_speeches(spark, d)))


_LEX = "lex AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{dom}', {i})" for i, (dom, ws) in enumerate(corpus.LEXICON.items()) for w in ws.split()) + ") v(w, domain, domain_rank))"


@query(f"""{_W}, {_COLL}, {_LEX}, tagged AS (SELECT word, decade, n, coalesce(domain, 'untagged') AS domain FROM top LEFT JOIN lex ON collocate = w)
SELECT word, domain, count(*)::BIGINT AS words, sum(n)::BIGINT AS occurrences, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM top t WHERE t.word = tagged.word), 4) AS pct FROM tagged GROUP BY word, domain""")
def collocate_domains(spark, d):
    top = corpus.top_collocates(corpus.collocate_counts(_speeches(spark, d)))
    tagged = corpus.tag_domains(top, corpus.lexicon(spark))
    sizes = top.groupBy("word").agg(F.count("*").alias("all_words"))
    g = tagged.groupBy("word", "domain").agg(F.count("*").alias("words"), F.sum("n").alias("occurrences"))
    return g.join(sizes, "word").select("word", "domain", "words", "occurrences", F.round(F.col("words") * 100.0 / F.col("all_words"), 4).alias("pct"))


@query(f"{_W}, {_COLL}, {_LEX}, p AS (SELECT word, decade, collocate, coalesce(arg_min(domain, domain_rank), 'untagged') AS domain FROM top LEFT JOIN lex ON collocate = w GROUP BY ALL) SELECT word, domain, count(*)::BIGINT AS words FROM p GROUP BY ALL")
def primary_domain_hist(spark, d):
    tagged = corpus.tag_domains(corpus.top_collocates(corpus.collocate_counts(_speeches(spark, d))), corpus.lexicon(spark))
    return tagged.groupBy("word", "decade", "collocate").agg(F.min_by("domain", "domain_rank").alias("domain")).groupBy("word", "domain").agg(F.count("*").alias("words"))


@query(f"""{_W}, {_SENT}, {_LEX}, tt AS (SELECT decade, unnest(regexp_extract_all(lower(sentence), '[a-z]+')) AS t FROM sent), n AS (SELECT decade, count(*) AS s FROM sent GROUP BY ALL)
SELECT decade, domain, count(*)::BIGINT AS hits, round(count(*) / any_value(s), 6) AS per_sentence FROM tt JOIN lex ON t = w JOIN n USING (decade) GROUP BY ALL""")
def domain_per_decade(spark, d):
    s = corpus.sentence_records(_speeches(spark, d))
    words = s.select("decade", F.explode(X.words(F.col("sentence"))).alias("t"))
    g = words.join(corpus.lexicon(spark), words.t == F.col("word")).groupBy("decade", "domain").agg(F.count("*").alias("hits"))
    return g.join(s.groupBy("decade").agg(F.count("*").alias("s")), "decade").select("decade", "domain", "hits", F.round(F.col("hits") / F.col("s"), 6).alias("per_sentence"))


@query(f"{_W}, {_SENT} SELECT coalesce(decade, -1) AS decade, coalesce(word, 'all') AS word, count(*)::BIGINT AS sentences, count(DISTINCT coalesce(party, 'Unknown'))::BIGINT AS parties, min(year) AS first_year, max(year) AS last_year FROM sent GROUP BY ROLLUP (sent.decade, sent.word)")
def sentence_facets(spark, d):
    s = corpus.sentence_records(_speeches(spark, d))
    g = s.rollup("decade", "word").agg(F.count("*").alias("sentences"), F.countDistinct(F.coalesce("party", F.lit("Unknown"))).alias("parties"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return g.withColumns({"decade": F.coalesce("decade", F.lit(-1)), "word": F.coalesce("word", F.lit("all"))})


@query(f"{_W}, {_SENT}, {_POLE} SELECT (floor(greatest(-0.3, least(0.3, score)) / 0.02 + 0.5) * 0.02 * 1000)::INTEGER AS bin_thousandths, count(*)::BIGINT AS sentences FROM score GROUP BY ALL")
def score_histogram(spark, d):
    s = _scores(spark, d)
    x = F.greatest(F.lit(-0.3), F.least(F.lit(0.3), F.col("score")))
    return s.groupBy(F.round(F.floor(x / 0.02 + 0.5) * 0.02 * 1000).cast("int").alias("bin_thousandths")).agg(F.count("*").alias("sentences"))


@query(f"{_W}, {_SENT}, {_POLE} SELECT decade, word, count(*)::BIGINT AS sentences, round(avg(score), 6) AS mean_score FROM score GROUP BY ALL")
def score_by_decade(spark, d):
    return _scores(spark, d).groupBy("decade", "word").agg(F.count("*").alias("sentences"), F.round(F.avg("score"), 6).alias("mean_score"))


_PARTY = "CASE WHEN starts_with(lower(trim(party)), 'civic') THEN 'Civic' WHEN starts_with(lower(trim(party)), 'harbour') THEN 'Harbour' WHEN starts_with(lower(trim(party)), 'crown') THEN 'Crown' END"


@query(f"{_W}, p AS (SELECT {_PARTY} AS bloc, a, b FROM spd) SELECT bloc, count(*)::BIGINT AS speeches, round(sum(a::INT) / count(*) * 100, 4) AS first_pct, round(sum(b::INT) / count(*) * 100, 4) AS second_pct FROM p WHERE bloc IS NOT NULL GROUP BY ALL")
def party_mentions(spark, d):
    name = F.lower(F.trim("party"))
    bloc = F.when(name.startswith("civic"), "Civic").when(name.startswith("harbour"), "Harbour").when(name.startswith("crown"), "Crown")
    s = _speeches(spark, d).select(bloc.alias("bloc"), "text").where("bloc is not null")
    pct = lambda w: F.round(F.count_if(X.has_word(F.col("text"), w)) / F.count("*") * 100, 4)
    return s.groupBy("bloc").agg(F.count("*").alias("speeches"), pct("freedom").alias("first_pct"), pct("liberty").alias("second_pct"))


@query(f"""{_W}, {_SENT}, h AS (SELECT DISTINCT year AS y FROM sent WHERE word = 'liberty'), e AS (SELECT unnest(range(min(y), max(y) + 1))::INTEGER AS y FROM h), g AS (SELECT y, y - row_number() OVER (ORDER BY y) AS run FROM e WHERE y NOT IN (SELECT y FROM h))
SELECT min(y) AS first_year, max(y) AS last_year, count(*)::BIGINT AS years FROM g GROUP BY run""")
def missing_year_ranges(spark, d):
    return corpus.missing_ranges(corpus.sentence_records(_speeches(spark, d)).where("word = 'liberty'"))


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents WHERE regexp_matches(lower(text), 'freedom|liberty')),
p AS (SELECT doc_id, w, unnest(w) AS match, generate_subscripts(w, 1)::INTEGER - 1 AS position FROM t)
SELECT doc_id, position, match, array_to_string(w[greatest(position - 10, 0) + 1 : position], ' ') AS left_context, array_to_string(w[position + 2 : position + 11], ' ') AS right_context FROM p WHERE regexp_matches(match, '^(?i)(freedom|liberty)\b')""")
def kwic_contexts(spark, d):
    return corpus.kwic(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


@query("WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) SELECT word, count(*)::BIGINT AS n FROM t GROUP BY ALL ORDER BY n DESC, word LIMIT 200")
def vocab_topk(spark, d):
    return corpus.vocabulary(table(spark, d, "documents"), "text", 200)


@query()
def normalize_spelling(spark, d):
    return table(spark, d, "documents").where("tcp_id is not null and text is not null").select("doc_id", X.normalise_spelling(F.col("text")).alias("text"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\[\[(?:[^|\]]*\|)?([^\]]+)\]\]', '\1', 'g'), '<[^>]+>', ' ', 'g'), '\{\{[^}]*\}\}', ' ', 'g') AS text FROM documents WHERE text IS NOT NULL")
def strip_markup(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.strip_markup(F.col("text")).alias("text"))


@query(r"""WITH b AS (SELECT CASE WHEN year < 1600 THEN '1500-1599' WHEN year < 1700 THEN '1600-1699' ELSE '1700-' END AS bin, word_count, text FROM documents WHERE year IS NOT NULL)
SELECT bin, count(*)::BIGINT AS docs, sum((coalesce(regexp_matches(lower(text), 'freedom|liberty'), false))::INT)::BIGINT AS docs_with_match, coalesce(sum(word_count), 0)::BIGINT AS total_words FROM b GROUP BY ALL""")
def period_bins(spark, d):
    y = F.col("year")
    b = table(spark, d, "documents").where("year is not null").select(F.when(y < 1600, "1500-1599").when(y < 1700, "1600-1699").otherwise("1700-").alias("bin"), "word_count", F.coalesce(F.lower("text").rlike("freedom|liberty"), F.lit(False)).alias("m"))
    return b.groupBy("bin").agg(F.count("*").alias("docs"), F.count_if("m").alias("docs_with_match"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("total_words"))


# ---------------------------------------------------------------- labels

_NORM = "CASE WHEN {0} IS NULL THEN 'missing' WHEN {0} IN " + _list(labels.LABELS) + " THEN {0} ELSE 'error' END"
_COUNTS = f"""
lab AS (SELECT (year // 10 * 10)::INTEGER AS decade, {_NORM.format("haiku")} AS l FROM opus_vs_haiku WHERE year IS NOT NULL),
lc AS (SELECT decade, count(*)::BIGINT AS total, {", ".join(f"count(*) FILTER (l = '{k}')::BIGINT AS {k}" for k in (*labels.LABELS, "missing", "error"))} FROM lab GROUP BY decade),
lcc AS (SELECT *, positive_liberty + negative_liberty AS pos_neg, positive_liberty + negative_liberty + ambiguous AS pos_neg_amb FROM lc)
"""
_SHARES = """
sh0 AS (SELECT decade, pos_neg AS n, positive_liberty::DOUBLE AS x, pos_neg::DOUBLE AS m FROM lcc WHERE pos_neg >= 5),
sh1 AS (SELECT decade, n, x / m AS p, m, 1 + 3.8416 / m AS d FROM sh0),
sh AS (SELECT decade, n, round(p, 6) AS share, round(least(greatest((p + 3.8416 / (2 * m)) / d - 1.96 * sqrt(p * (1 - p) / m + 3.8416 / (4 * m * m)) / d, 0), 1), 6) AS lower, round(least(greatest((p + 3.8416 / (2 * m)) / d + 1.96 * sqrt(p * (1 - p) / m + 3.8416 / (4 * m * m)) / d, 0), 1), 6) AS upper FROM sh1)
"""
_TREND = """
c AS (SELECT avg(decade) AS c FROM sh), q AS (SELECT (decade - c) / 100 AS x, share AS y, n::DOUBLE AS w, decade, share, n FROM sh, c),
s AS (SELECT count(*)::BIGINT AS k, sum(w) AS sw, sum(w*x) AS swx, sum(w*y) AS swy, sum(w*x*x) - sum(w*x)*sum(w*x)/sum(w) AS sxx, sum(w*x*y) - sum(w*x)*sum(w*y)/sum(w) AS sxy, sum(w*y*y) - sum(w*y)*sum(w*y)/sum(w) AS syy,
  arg_min(share, decade) AS pa, arg_min(n, decade) AS na, arg_max(share, decade) AS pb, arg_max(n, decade) AS nb FROM q),
tr AS (SELECT k AS points, round(sxy / sxx, 6) AS slope, round((swy - sxy / sxx * swx) / sw, 6) AS intercept, round(sqrt((syy - sxy*sxy/sxx) / (k - 2) / sxx), 6) AS std_error, round(sxy / sxx / sqrt((syy - sxy*sxy/sxx) / (k - 2) / sxx), 4) AS z,
  round(pb - pa, 6) AS end_change, round((pb - pa) / nullif(sqrt(pa*(1-pa)/na + pb*(1-pb)/nb), 0), 4) AS end_z FROM s WHERE k >= 3)
"""


def _counts(spark, d):
    return labels.counts_by_decade(table(spark, d, "opus_vs_haiku"))


@query(f"WITH {_COUNTS} SELECT * FROM lcc")
def label_counts_by_decade(spark, d):
    return _counts(spark, d)


@query(f"WITH {_COUNTS}, {_SHARES} SELECT * FROM sh")
def label_wilson(spark, d):
    return labels.shares(_counts(spark, d))


@query(f"WITH {_COUNTS}, {_SHARES}, {_TREND} SELECT * FROM tr")
def label_weighted_trend(spark, d):
    return labels.weighted_trend(labels.shares(_counts(spark, d)))


@query()
def label_trend_pvalue(spark, d):
    return labels.weighted_trend(labels.shares(_counts(spark, d))).select("slope", "z", stats.two_sided_p(F.col("z")).alias("p"))


@query(f"WITH k AS (SELECT unnest(['positive_liberty', 'negative_liberty', 'ambiguous', 'other', 'missing', 'error']) AS l), n AS (SELECT {_NORM.format('haiku')} AS predicted, {_NORM.format('opus')} AS truth, count(*)::BIGINT AS n FROM opus_vs_haiku GROUP BY ALL) SELECT x.l AS predicted, y.l AS truth, coalesce(n, 0)::BIGINT AS n FROM k x CROSS JOIN k y LEFT JOIN n ON x.l = predicted AND y.l = truth")
def confusion_matrix(spark, d):
    return labels.confusion(table(spark, d, "opus_vs_haiku"), "haiku", "opus")


@query("SELECT count(*)::BIGINT AS total, count(*) FILTER (haiku = opus)::BIGINT AS agree, round(count(*) FILTER (haiku = opus) / count(*) * 100, 4) AS agree_pct, count(*) FILTER (haiku = 'ambiguous')::BIGINT AS ambiguous, count(*) FILTER (agree)::BIGINT AS flagged FROM opus_vs_haiku")
def label_agreement(spark, d):
    t = table(spark, d, "opus_vs_haiku")
    same = F.count_if(F.col("haiku") == F.col("opus"))
    return t.agg(F.count("*").alias("total"), same.alias("agree"), F.round(same / F.count("*") * 100, 4).alias("agree_pct"), F.count_if(F.col("haiku") == "ambiguous").alias("ambiguous"), F.count_if("agree").alias("flagged"))


_CUR = """
cur AS (SELECT annotator, id, arg_max(label_, o) AS label, arg_max(labelled_at, o) AS labelled_at, arg_max(notes_, o) AS notes FROM (SELECT *, {'v': label} AS label_, {'v': notes} AS notes_, {'t': labelled_at, 'i': log_id} AS o FROM label_log) GROUP BY ALL),
now AS (SELECT annotator, id, label.v AS label, labelled_at, notes.v AS notes FROM cur)
"""
_MAJ = f"maj AS (SELECT id, arg_max(label, {{'v': votes, 'l': label}}) AS label, max(votes) AS votes FROM (SELECT id, label, count(*)::BIGINT AS votes FROM now WHERE label IN {_list(labels.LABELS)} GROUP BY ALL) GROUP BY id)"


@query(f"WITH {_CUR} SELECT * FROM now")
def labels_last_write_wins(spark, d):
    return labels.current_labels(table(spark, d, "label_log"))


@query(f"WITH {_CUR} SELECT id, count(*)::BIGINT AS annotators, string_agg(annotator || '=' || coalesce(label, ''), ',' ORDER BY annotator) AS by_annotator FROM now GROUP BY id")
def labels_pivot(spark, d):
    cur = labels.current_labels(table(spark, d, "label_log"))
    entry = F.struct("annotator", F.concat("annotator", F.lit("="), F.coalesce("label", F.lit(""))).alias("e"))
    return cur.groupBy("id").agg(F.count("*").alias("annotators"), F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["e"]), ",").alias("by_annotator"))


@query("SELECT annotator, count(*)::BIGINT AS entries, count(DISTINCT id)::BIGINT AS items, count(label)::BIGINT AS labelled FROM label_log GROUP BY ALL")
def label_users(spark, d):
    return table(spark, d, "label_log").groupBy("annotator").agg(F.count("*").alias("entries"), F.countDistinct("id").alias("items"), F.count("label").alias("labelled"))


@query(f"WITH {_CUR}, {_MAJ} SELECT * FROM maj")
def label_majority(spark, d):
    return labels.majority(labels.current_labels(table(spark, d, "label_log")))


def _one_row(spark, d):
    t = table(spark, d, "opus_vs_haiku").groupBy("id").agg(F.min_by(F.struct("haiku", "opus"), "eval_id").alias("x")).select("id", "x.*")
    return t.join(labels.majority(labels.current_labels(table(spark, d, "label_log"))).select("id", F.col("label").alias("people")), "id", "left")


_ONE = "one AS (SELECT e.id, haiku, opus, maj.label AS people FROM (SELECT id, arg_min(h, eval_id).v AS haiku, arg_min(o, eval_id).v AS opus FROM (SELECT *, {'v': haiku} AS h, {'v': opus} AS o FROM opus_vs_haiku) GROUP BY id) e LEFT JOIN maj USING (id))"
_DIR = "CASE {0} WHEN 'positive_liberty' THEN 'agency' WHEN 'negative_liberty' THEN 'constraint' END"


@query(f"""WITH {_CUR}, {_MAJ}, {_ONE}, l AS (SELECT id, 'haiku' AS m, {_DIR.format('haiku')} AS dir FROM one UNION ALL SELECT id, 'opus', {_DIR.format('opus')} FROM one UNION ALL SELECT id, 'people', {_DIR.format('people')} FROM one)
SELECT a.m AS method_a, b.m AS method_b, count(*)::BIGINT AS both, round(avg((a.dir = b.dir)::INT) * 100, 4) AS agree_pct FROM l a JOIN l b ON a.id = b.id AND a.m < b.m AND a.dir IS NOT NULL AND b.dir IS NOT NULL GROUP BY ALL""")
def method_agreement_matrix(spark, d):
    one = _one_row(spark, d)
    long = one.select("id", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), labels.direction(F.col(m)).alias("dir")) for m in ("haiku", "opus", "people")])).alias("x")).select("id", "x.*").where("dir is not null")
    a, b = long.alias("a"), long.alias("b")
    return a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.m") < F.col("b.m"))).groupBy(F.col("a.m").alias("method_a"), F.col("b.m").alias("method_b")).agg(F.count("*").alias("both"), F.round(F.avg((F.col("a.dir") == F.col("b.dir")).cast("int")) * 100, 4).alias("agree_pct"))


@query(f"WITH {_CUR}, {_MAJ}, {_ONE} SELECT count(*)::BIGINT AS total, count(*) FILTER (haiku IS DISTINCT FROM opus)::BIGINT AS changed, count(*) FILTER (haiku IS DISTINCT FROM people AND opus = people)::BIGINT AS moved_to_truth, count(*) FILTER (haiku = people AND opus IS DISTINCT FROM people)::BIGINT AS regressed FROM one WHERE people IS NOT NULL")
def label_migration(spark, d):
    one = _one_row(spark, d).where("people is not null")
    h, o, t = F.col("haiku"), F.col("opus"), F.col("people")
    return one.agg(F.count("*").alias("total"), F.count_if(~h.eqNullSafe(o)).alias("changed"), F.count_if(~h.eqNullSafe(t) & (o == t)).alias("moved_to_truth"), F.count_if((h == t) & ~o.eqNullSafe(t)).alias("regressed"))


@query(f"""WITH m AS (SELECT coalesce((year // 10 * 10)::INTEGER, -1) AS decade, unnest([{{'k': 'haiku', 'l': haiku}}, {{'k': 'opus', 'l': opus}}]) AS x FROM opus_vs_haiku)
SELECT coalesce(decade, 0) AS decade, x.k AS method, coalesce(x.l, 'missing') AS label, count(*)::BIGINT AS n FROM m GROUP BY GROUPING SETS ((m.decade, x.k, coalesce(x.l, 'missing')), (x.k, coalesce(x.l, 'missing')))""")
def manifest_method_counts(spark, d):
    t = table(spark, d, "opus_vs_haiku")
    m = t.select(F.coalesce(X.decade_of(F.col("year")), F.lit(-1)).alias("decade"), F.explode(F.create_map(F.lit("haiku"), "haiku", F.lit("opus"), "opus")).alias("method", "label")).withColumn("label", F.coalesce("label", F.lit("missing")))
    return m.groupingSets([["decade", "method", "label"], ["method", "label"]], "decade", "method", "label").agg(F.count("*").alias("n")).withColumn("decade", F.coalesce("decade", F.lit(0)))


@query("SELECT count(*)::BIGINT AS total, count(DISTINCT id)::BIGINT AS records, count(haiku)::BIGINT AS with_haiku, count(opus)::BIGINT AS with_opus, min(year) AS first_year, max(year) AS last_year, (count(haiku) = count(*)) AS haiku_complete FROM opus_vs_haiku")
def manifest_checks(spark, d):
    return table(spark, d, "opus_vs_haiku").agg(F.count("*").alias("total"), F.countDistinct("id").alias("records"), F.count("haiku").alias("with_haiku"), F.count("opus").alias("with_opus"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), (F.count("haiku") == F.count("*")).alias("haiku_complete"))


@query(f"WITH s AS (SELECT eval_id, id, year, (year // 10 * 10)::INTEGER AS decade, {_NORM.format('haiku')} AS label FROM opus_vs_haiku WHERE year IS NOT NULL) SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY decade, label ORDER BY md5(eval_id::VARCHAR || '42'), eval_id) AS n FROM s) WHERE n <= 3")
def stratified_sample(spark, d):
    return labels.stratified_sample(table(spark, d, "opus_vs_haiku"), 3, "42")


@query("SELECT eval_id, id, year, haiku FROM opus_vs_haiku WHERE haiku = 'negative_liberty' AND contains(lower(sentence), 'public') ORDER BY year NULLS FIRST, eval_id LIMIT 25 OFFSET 25")
def browse_page(spark, d):
    t = table(spark, d, "opus_vs_haiku").where((F.col("haiku") == "negative_liberty") & F.lower("sentence").contains("public"))
    return t.select("eval_id", "id", "year", "haiku").orderBy(F.asc_nulls_first("year"), "eval_id").offset(25).limit(25)


@query(r"SELECT row_id, CASE WHEN h = '' THEN '' ELSE '(' || h || ')' END AS header FROM (SELECT row_id, concat_ws(', ', CASE WHEN regexp_matches(speech_date, '^[0-9]{4}') THEN CAST(substr(speech_date, 1, 4) AS INTEGER) END, nullif(regexp_replace(speaker, '^\s+|\s+$', '', 'g'), ''), nullif(regexp_replace(party, '^\s+|\s+$', '', 'g'), '')) AS h FROM speeches)")
def prompt_headers(spark, d):
    return table(spark, d, "speeches").select("row_id", X.prompt_header(X.year_of(F.col("speech_date")), F.col("speaker"), F.col("party")).alias("header"))


@query("WITH e AS (SELECT user_id, event_type, date_trunc('hour', ts) AS start FROM events) SELECT start, event_type, count(*)::BIGINT AS n FROM e GROUP BY ALL")
def event_windows(spark, d):
    return live.windowed_counts(table(spark, d, "events"))


# ---------------------------------------------------------------- vectors over time

PAIRS = [("w1", "w2"), ("w1", "w3"), ("w2", "w3"), ("w4", "w5"), ("w1", "w45"), ("w2", "w50")]
ASKED = [f"w{i}" for i in range(1, 7)]
CLUSTERS = {"personal": ["w7", "w8", "w9"], "legal": ["w10", "w11", "w12", "w48"]}
POLE_A, POLE_B = ["w13", "w14", "w15", "w16"], ["w17", "w18", "w19", "w16"]
_VEC = "vec AS (SELECT (1900 + 10 * label)::INTEGER AS period, 'w' || row_number() OVER (PARTITION BY label ORDER BY vec_id) AS word, embedding::DOUBLE[] AS vec FROM embeddings)"
_COS = "CASE WHEN list_dot_product({0}, {0}) * list_dot_product({1}, {1}) = 0 THEN 0.0 ELSE list_dot_product({0}, {1}) / sqrt(list_dot_product({0}, {0})) / sqrt(list_dot_product({1}, {1})) END"
_KNN = f"""
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period, query ORDER BY similarity DESC, word)::INTEGER AS place FROM
  (SELECT v.period, q.word AS query, v.word, round({_COS.format('v.vec', 'q.vec')}, 9) AS similarity, v.vec FROM vec v JOIN vec q ON v.period = q.period AND v.word <> q.word WHERE q.word IN {_list(ASKED)})) WHERE place <= 10)
"""


def _vec(spark, d):
    return temporal.words_by_period(table(spark, d, "embeddings"))


def _knn(spark, d, **options):
    return temporal.knn(_vec(spark, d), ASKED, 10, **options)


_PT = f"WITH {_VEC}, p AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PAIRS) + f") x(a, b)), t AS (SELECT a, b, l.period, {_COS.format('l.vec', 'r.vec')} AS sim FROM p JOIN vec l ON a = l.word JOIN vec r ON b = r.word AND l.period = r.period)"


@query(f"{_PT} SELECT a, b, period, round(sim, 6) AS similarity FROM t")
def pair_similarity_trajectory(spark, d):
    return temporal.pair_trajectory(_vec(spark, d), PAIRS).withColumn("similarity", F.round("similarity", 6))


@query(f"{_PT}, g AS (SELECT a, b, CASE WHEN count(*) > 1 THEN round(arg_max(sim, period) - arg_min(sim, period), 6) END AS divergence FROM t GROUP BY a, b) SELECT *, row_number() OVER (ORDER BY coalesce(divergence, 0), a, b)::INTEGER AS place FROM g")
def pair_divergence_rank(spark, d):
    return temporal.divergence(temporal.pair_trajectory(_vec(spark, d), PAIRS))


@query(f"WITH {_VEC}, o AS (SELECT word, period, vec, lag(vec) OVER w AS was, lag(period) OVER w AS from_period, first_value(vec) OVER w AS begin_ FROM vec WHERE word IN {_list([*ASKED, 'w45', 'w50'])} WINDOW w AS (PARTITION BY word ORDER BY period)) SELECT word, period, from_period, round(1 - ({_COS.format('vec', 'was')}), 6) AS step, round(1 - ({_COS.format('vec', 'begin_')}), 6) AS since_first FROM o WHERE was IS NOT NULL")
def word_drift_trajectory(spark, d):
    return temporal.drift(_vec(spark, d), [*ASKED, "w45", "w50"])


@query(f"WITH {_VEC}, {_KNN} SELECT period, query, word, similarity, place FROM nn")
def knn_topk(spark, d):
    return _knn(spark, d).select("period", "query", "word", "similarity", "place")


@query(f"""WITH {_VEC}, {_KNN}, s AS (SELECT query, period, list_sort(list(word)) AS now FROM nn GROUP BY ALL), l AS (SELECT *, lag(now) OVER (PARTITION BY query ORDER BY period) AS was FROM s)
SELECT query, period, array_to_string(list_sort(list_filter(now, lambda x: NOT list_contains(was, x))), ' ') AS entered, array_to_string(list_sort(list_filter(was, lambda x: NOT list_contains(now, x))), ' ') AS exited,
  len(list_intersect(now, was))::INTEGER AS stayed, round(len(list_intersect(now, was)) / greatest(len(list_distinct(now || was)), 1), 6) AS jaccard FROM l WHERE was IS NOT NULL""")
def neighbor_turnover(spark, d):
    return temporal.turnover(_knn(spark, d))


@query(f"""WITH {_VEC}, {_KNN}, x AS (SELECT query, period, unnest(vec) AS v, generate_subscripts(vec, 1) AS i FROM nn), m AS (SELECT query, period, i, avg(v) AS v FROM x GROUP BY ALL), c AS (SELECT query, period, list(v ORDER BY i) AS vec FROM m GROUP BY ALL),
l AS (SELECT *, lag(vec) OVER (PARTITION BY query ORDER BY period) AS was FROM c) SELECT query, period, round(1 - ({_COS.format('vec', 'was')}), 6) AS displacement FROM l WHERE was IS NOT NULL""")
def centroid_displacement(spark, d):
    return temporal.displacement(_knn(spark, d, with_vectors=True))


@query(f"WITH {_VEC}, {_KNN} SELECT a.query, a.period, round(avg({_COS.format('a.vec', 'b.vec')}), 6) AS coherence FROM nn a JOIN nn b ON a.query = b.query AND a.period = b.period AND a.place < b.place GROUP BY ALL")
def neighborhood_coherence(spark, d):
    return temporal.coherence(_knn(spark, d, with_vectors=True))


@query(f"WITH {_VEC}, {_KNN} SELECT query, word AS term, count(*)::BIGINT AS periods, min(place) AS best_place, round(avg(similarity), 6) AS mean_similarity FROM nn WHERE word IN ('w20', 'w21', 'w22', 'w23', 'w24', 'w25', 'w26', 'w27', 'w28', 'w29') GROUP BY ALL")
def terms_in_topk_neighbors(spark, d):
    return _terms(_knn(spark, d))


def _terms(neighbours):
    terms = [f"w{i}" for i in range(20, 30)]
    return neighbours.where(F.col("word").isin(terms)).groupBy("query", F.col("word").alias("term")).agg(F.count("*").alias("periods"), F.min("place").alias("best_place"), F.round(F.avg("similarity"), 6).alias("mean_similarity"))


# The same searches for every row whose id is divisible by ASKED_EVERY, against all rows of its period.

ASKED_EVERY = 20
#: Neighbours in a neighbourhood; knn_topk_whole lists 10.
NEIGHBOURHOOD = 50


def _asked(spark, d):
    return temporal.keyed_words(table(spark, d, "embeddings")).where(F.col("vec_id") % ASKED_EVERY == 0).drop("vec_id")


def _asked_knn(spark, d, k, **options):
    return temporal.nearest(_vec(spark, d), _asked(spark, d), k, **options)


def _asked_words_knn(spark, d, k, **options):
    """The words of the asked rows in all their periods, so that consecutive periods can be compared."""
    v = _vec(spark, d)
    return temporal.nearest(v, v.join(_asked(spark, d).select("word").distinct(), "word", "left_semi"), k, **options)


@query()
def knn_topk_whole(spark, d):
    return _asked_knn(spark, d, 10).select("period", "query", "word", "similarity", "place")


@query()
def neighbor_turnover_whole(spark, d):
    return temporal.turnover(_asked_words_knn(spark, d, NEIGHBOURHOOD))


@query()
def centroid_displacement_whole(spark, d):
    return temporal.displacement(_asked_words_knn(spark, d, NEIGHBOURHOOD, with_vectors=True))


@query()
def neighborhood_coherence_whole(spark, d):
    return temporal.coherence(_asked_knn(spark, d, NEIGHBOURHOOD, with_vectors=True))


@query()
def terms_in_topk_neighbors_whole(spark, d):
    return _terms(_asked_knn(spark, d, NEIGHBOURHOOD))


_CLUSTER = f"""WITH {_VEC}, m AS (SELECT * FROM (VALUES {", ".join(f"('{c}', '{w}')" for c, ws in CLUSTERS.items() for w in ws)}) x(cluster, member)), t AS (SELECT period, vec AS tv FROM vec WHERE word = 'w1'),
dd AS (SELECT period, cluster, 1 - ({_COS.format('vec', 'tv')}) AS d FROM vec JOIN m ON word = member JOIN t USING (period)),
cd AS (SELECT period, cluster, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, count(*)::BIGINT AS members FROM dd GROUP BY GROUPING SETS ((period, cluster), (period))),
tl0 AS (SELECT period, coalesce(max(mean) FILTER (cluster = 'personal'), 1) AS a, coalesce(max(mean) FILTER (cluster = 'legal'), 1) AS b FROM cd WHERE cluster IS NOT NULL GROUP BY period),
tl AS (SELECT period, round(b - a, 6) AS tilt, round(CASE WHEN a > 0 THEN b / a END, 6) AS ratio, CASE WHEN b < a THEN 'legal' ELSE 'personal' END AS closer FROM tl0)"""


def _clusters(spark, d):
    return temporal.cluster_distances(_vec(spark, d), "w1", CLUSTERS)


def _tilt(spark, d):
    return temporal.tilt(_clusters(spark, d), "personal", "legal")


@query(f"{_CLUSTER} SELECT * FROM cd")
def cluster_distance(spark, d):
    return _clusters(spark, d)


@query(f"{_CLUSTER} SELECT * FROM tl")
def cluster_tilt(spark, d):
    return _tilt(spark, d)


@query(f"{_CLUSTER}, l AS (SELECT *, lag(closer) OVER (ORDER BY period) AS was FROM tl) SELECT min(period) AS crossover, arg_min(closer, period) AS to_cluster FROM l WHERE was IS NOT NULL AND was <> closer")
def cluster_crossover(spark, d):
    return temporal.crossover(_tilt(spark, d))


@query(f"{_CLUSTER}, r AS (SELECT tilt, row_number() OVER (ORDER BY period) AS i, row_number() OVER (ORDER BY period DESC) AS j FROM tl) SELECT round(avg(tilt) FILTER (i <= 3), 6) AS early, round(avg(tilt) FILTER (j <= 3), 6) AS late, round(avg(tilt) FILTER (j <= 3) - avg(tilt) FILTER (i <= 3), 6) AS change FROM r")
def early_late_means(spark, d):
    return temporal.early_late(_tilt(spark, d), "tilt")


PROJECTED = ["w1", "w2", "w3", "w20", "w21", "w22", "w23"]
_both = [w for w in [*POLE_A, *POLE_B] if (w in POLE_A) != (w in POLE_B)]
_AXIS = f"""WITH {_VEC}, pe AS (SELECT word IN {_list(POLE_A)} AS up, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM vec WHERE word IN {_list(_both)}), pm AS (SELECT up, i, avg(x) AS m FROM pe GROUP BY ALL),
df AS (SELECT i, sum(CASE WHEN up THEN m ELSE -m END) AS d FROM pm GROUP BY i), ax0 AS (SELECT list(d ORDER BY i) AS a FROM df), ax AS (SELECT list_transform(a, lambda x: x / sqrt(list_dot_product(a, a))) AS axis FROM ax0),
pr AS (SELECT word AS series, period AS x, list_dot_product(vec, axis) AS y FROM vec, ax WHERE word IN {_list(PROJECTED)}),
tr AS (SELECT series, count(*)::BIGINT AS n, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy, avg(y) AS m FROM pr GROUP BY series),
tt AS (SELECT series, n, round(sxy / sxx * 100, 6) AS slope, round(m, 6) AS mean, round(CASE WHEN syy = 0 THEN 0 ELSE 1 - greatest(syy - sxy*sxy/sxx, 0) / syy END, 6) AS r2, round(sqrt(greatest(syy - sxy*sxy/sxx, 0) / nullif(n - 2, 0) / sxx) * 100, 6) AS std_error,
  round(CASE WHEN greatest(syy - sxy*sxy/sxx, 0) = 0 THEN 0 ELSE sxy / sxx / sqrt(greatest(syy - sxy*sxy/sxx, 0) / nullif(n - 2, 0) / sxx) END, 4) AS z FROM tr WHERE n >= 3 AND sxx > 0)"""


def _projection(spark, d):
    v = _vec(spark, d)
    return temporal.project(v, temporal.axis(v, POLE_A, POLE_B), PROJECTED).select(F.col("word").alias("series"), F.col("period").alias("x"), F.col("projection").alias("y"))


@query(f"{_AXIS} SELECT series, x, round(y, 6) AS y FROM pr")
def semaxis_projection(spark, d):
    return _projection(spark, d).withColumn("y", F.round("y", 6))


@query(f"{_AXIS} SELECT * FROM tt")
def semaxis_trend(spark, d):
    return stats.trend(_projection(spark, d))


@query(f"{_AXIS}, c AS (SELECT avg(slope) AS m, stddev_pop(slope) AS s, count(*)::BIGINT AS controls FROM tt WHERE series <> 'w1') SELECT slope, round(m, 6) AS control_mean, round(s, 6) AS control_std, controls, round((slope - m) / s, 4) AS z, abs((slope - m) / s) > 2 AS beyond_two, abs((slope - m) / s) > 1 AS beyond_one FROM tt, c WHERE series = 'w1'")
def zscore_vs_controls(spark, d):
    return stats.against_controls(stats.trend(_projection(spark, d)), "series", "w1")


_RSS = "greatest(coalesce(regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / nullif(regr_sxx(y, x), 0), 0), 0)"


@query(f"""{_AXIS}, p AS (SELECT series, x, y, row_number() OVER (PARTITION BY series ORDER BY x) AS i, count(*) OVER (PARTITION BY series) AS n FROM pr), o AS (SELECT series, any_value(n) AS n, any_value(n) * ln({_RSS} / any_value(n) + 1e-10) + 2 * ln(any_value(n)) AS b1 FROM p WHERE n >= 6 GROUP BY series),
sp AS (SELECT series, x AS split FROM p WHERE n >= 6 AND i > 3 AND i <= n - 3), tw AS (SELECT p.series, split, p.x < split AS l, {_RSS.replace('y, x', 'p.y, p.x')} AS r, any_value(n) AS n FROM p JOIN sp ON p.series = sp.series GROUP BY ALL),
b AS (SELECT series, split, any_value(n) * ln(sum(r) / any_value(n) + 1e-10) + 4 * ln(any_value(n)) AS b2 FROM tw GROUP BY ALL), be AS (SELECT series, arg_min(split, {{'b': b2, 's': split}}) AS split, min(b2) AS b2 FROM b GROUP BY series)
SELECT o.series, CASE WHEN round(b1 - b2, 6) > 0 THEN split ELSE 0 END AS change_at, CASE WHEN round(b1 - b2, 6) > 0 THEN round(b1 - b2, 6) ELSE 0 END AS bic_gain FROM o LEFT JOIN be ON o.series = be.series""")
def changepoint_bic(spark, d):
    return stats.change_point(_projection(spark, d)).withColumn("change_at", F.coalesce("change_at", F.lit(0)))


@query(f"{_PT}, o AS (SELECT period, max(sim) FILTER (a = 'w1' AND b = 'w2') AS first, max(sim) FILTER (a = 'w4' AND b = 'w5') AS second FROM t GROUP BY period) SELECT period, round(first, 6) AS first, round(second, 6) AS second, round(second - first, 6) AS difference FROM o WHERE first IS NOT NULL AND second IS NOT NULL")
def cross_corpus_overlap(spark, d):
    t = temporal.pair_trajectory(_vec(spark, d), PAIRS)
    one = t.where("a = 'w1' and b = 'w2'").select("period", F.col("similarity").alias("first"))
    two = t.where("a = 'w4' and b = 'w5'").select("period", F.col("similarity").alias("second"))
    return one.join(two, "period").select("period", F.round("first", 6).alias("first"), F.round("second", 6).alias("second"), F.round(F.col("second") - F.col("first"), 6).alias("difference"))


@query(f"{_PT}, u AS (SELECT period, 1 AS source, sim FROM t WHERE a = 'w1' AND b = 'w45' UNION ALL SELECT period, 2, sim FROM t WHERE a = 'w2' AND b = 'w50') SELECT period, max(source) AS source, round(arg_max(sim, source), 6) AS similarity FROM u GROUP BY period")
def combined_timeline(spark, d):
    t = temporal.pair_trajectory(_vec(spark, d), PAIRS)
    u = t.where("a = 'w1' and b = 'w45'").select("period", F.lit(1).alias("source"), "similarity").unionByName(t.where("a = 'w2' and b = 'w50'").select("period", F.lit(2).alias("source"), "similarity"))
    return u.groupBy("period").agg(F.max("source").alias("source"), F.round(F.max_by("similarity", "source"), 6).alias("similarity"))


# The same projections on the axis of expanded poles.

REFERENCE_PERIOD, EXPANSION_K = 1900, 10


def _expanded_projection(spark, d):
    v = _vec(spark, d)
    ax = temporal.expanded_axes(v, {"": (POLE_A, POLE_B)}, REFERENCE_PERIOD, EXPANSION_K).select("axis")
    return temporal.project(v, ax, PROJECTED).select(F.col("word").alias("series"), F.col("period").alias("x"), F.col("projection").alias("y"))


@query()
def semaxis_projection_expanded(spark, d):
    return _expanded_projection(spark, d).withColumn("y", F.round("y", 6))


@query()
def semaxis_trend_expanded(spark, d):
    return stats.trend(_expanded_projection(spark, d))


@query()
def zscore_vs_controls_expanded(spark, d):
    return stats.against_controls(stats.trend(_expanded_projection(spark, d)), "series", "w1", digits=8)


@query()
def changepoint_bic_expanded(spark, d):
    return stats.change_point(_expanded_projection(spark, d)).withColumn("change_at", F.coalesce("change_at", F.lit(0)))


@query()
def permutation_trend(spark, d):
    return stats.permutation_trend(_expanded_projection(spark, d)).withColumn("slope", F.round("slope", 9))


@query()
def bootstrap_cluster(spark, d):
    v = _vec(spark, d)
    t = v.where("word = 'w1'").select("period", F.col("vec").alias("tv"))
    members = temporal.pick(v, [w for ws in CLUSTERS.values() for w in ws]).join(t, "period")
    boot = stats.bootstrap_mean(members.select(F.col("period").alias("series"), V.cosine_distance(F.col("vec"), F.col("tv")).alias("y")))
    return boot.select("series", *[F.round(c, 6).alias(c) for c in ("mean", "lower", "upper", "std")])


@query()
def bootstrap_pair(spark, d):
    v = _vec(spark, d)
    near = temporal.knn(v, sorted({w for p in PAIRS for w in p}), 10).groupBy("period", F.col("query").alias("word")).agg(F.stddev_pop(1 - F.col("similarity")).alias("spread"), F.count("*").alias("near"))
    one = v.join(near, ["period", "word"], "left").select("period", "word", "vec", F.coalesce("spread", F.lit(0.0)).alias("spread"), F.coalesce("near", F.lit(0)).alias("near"))
    side = lambda x: one.select("period", *[F.col(c).alias(n) for c, n in (("word", x), ("vec", f"v{x}"), ("spread", f"spread_{x}"), ("near", f"near_{x}"))])
    pairs = spark.createDataFrame(PAIRS, "a string, b string").join(side("a"), "a").join(side("b"), ["period", "b"])
    return stats.perturbed_similarity(pairs.select(F.concat_ws(" ", "a", "b", "period").alias("series"), F.col("va").alias("a"), F.col("vb").alias("b"), "spread_a", "spread_b", "near_a", "near_b"))


@query()
def seed_sensitivity(spark, d):
    v = _vec(spark, d)
    trials = {f"{i}-{j}": (POLE_A[:i] + POLE_A[i + 1 :], POLE_B[:j] + POLE_B[j + 1 :]) for i in range(len(POLE_A)) for j in range(len(POLE_B))}
    axes = temporal.expanded_axes(v, trials, REFERENCE_PERIOD, EXPANSION_K)
    got = stats.seed_sensitivity(temporal.pick(v, ["w1"]).crossJoin(axes).select("trial", F.col("period").alias("x"), V.dot(F.col("vec"), F.col("axis")).alias("y")))
    return got.select("trials", "positive", *[F.round(c, 6).alias(c) for c in ("mean", "std", "lower", "upper")])


@query()
def procrustes_align(spark, d):
    return stats.procrustes_by_period(_vec(spark, d), 64)


#: One task alone trains on so much text; larger collections are trained on by as many tasks as there are cores, if each has as much.
CHARACTERS_A_TRAINER = 8_000_000


@query()
def word2vec_train(spark, d):
    from pyspark.ml.feature import Word2Vec

    texts = table(spark, d, "documents").where("text is not null")
    characters = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    trainers = max(1, min(spark.sparkContext.defaultParallelism, -(-characters // CHARACTERS_A_TRAINER)))
    docs = texts.select(X.words(F.col("text")).alias("words")).where(F.size("words") > 1)
    return Word2Vec(vectorSize=300, windowSize=5, minCount=100, maxIter=1, seed=7, numPartitions=trainers, inputCol="words", outputCol="v").fit(docs).getVectors().select("word", "vector")


# ---------------------------------------------------------------- yearly series

_YS = "WITH ys AS (SELECT o_orderpriority AS series, year(o_orderdate)::INTEGER AS year, round(avg(o_totalprice), 2) AS value FROM orders GROUP BY ALL)"
_YOY = f"{_YS}, yo0 AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY year) AS was FROM ys), yo AS (SELECT series, year, value, round(CASE WHEN was > 0 THEN (value - was) / was * 100 END, 4) AS change_pct FROM yo0)"


def _series(spark, d):
    return series.yearly(table(spark, d, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice")


@query(f"{_YOY} SELECT * FROM yo")
def series_yearly_avg_yoy(spark, d):
    return series.year_over_year(_series(spark, d))


@query(f"{_YOY} SELECT * FROM yo WHERE change_pct IS NOT NULL ORDER BY abs(change_pct) DESC, series, year LIMIT 5")
def series_top_changes(spark, d):
    return series.top_changes(series.year_over_year(_series(spark, d)), 5)


@query(f"{_YS} SELECT series, (year // 10 * 10)::INTEGER AS span, round(avg(value), 4) AS mean, count(*)::BIGINT AS years FROM ys GROUP BY ALL")
def series_decade_avg(spark, d):
    return series.by_span(_series(spark, d), 10)


@query(f"{_YS} SELECT series, ((year - 1970) // 5 * 5 + 1970)::INTEGER AS span, round(avg(value), 4) AS mean, count(*)::BIGINT AS years FROM ys GROUP BY ALL")
def series_five_year_bins(spark, d):
    return series.by_span(_series(spark, d), 5, 1970)


@query(f"{_YS}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY year) AS i, row_number() OVER (PARTITION BY series ORDER BY year DESC) AS j FROM ys) SELECT series, round(avg(value) FILTER (j <= 3) / avg(value) FILTER (i <= 3), 6) AS growth, arg_max(year, {{'v': value, 'y': -year}}) AS peak_year, max(value) AS peak FROM r GROUP BY series HAVING count(*) >= 3")
def series_growth_peak(spark, d):
    return series.growth(_series(spark, d), ends=3, least=3)


@query(f"{_YS} SELECT series, round((arg_max(value, year) - max(value) FILTER (year = 1996)) / max(value) FILTER (year = 1996) * 100, 4) AS pct, round(arg_max(value, year) / max(value) FILTER (year = 1996), 6) AS multiple FROM ys GROUP BY series HAVING max(value) FILTER (year = 1996) > 0")
def series_since_reference(spark, d):
    return series.since(_series(spark, d), 1996)


@query(f"{_YS}, l AS (SELECT *, value - lag(value) OVER w AS d2, lag(value) OVER w - lag(value, 2) OVER w AS d1, row_number() OVER (PARTITION BY series ORDER BY year DESC) AS j FROM ys WINDOW w AS (PARTITION BY series ORDER BY year)) SELECT series, CASE WHEN abs(d2) < 0.005 THEN 'PLATEAU' WHEN d1 * d2 > 0 THEN 'CONTINUING' WHEN d1 * d2 < 0 THEN 'REVERSING' ELSE 'UNCLEAR' END AS verdict FROM l WHERE j = 1 AND d1 IS NOT NULL")
def series_last_three(spark, d):
    return series.last_three(_series(spark, d))


@query(f"{_YS} SELECT year, max(value) FILTER (series = '1-URGENT') AS urgent, max(value) FILTER (series = '2-HIGH') AS high, max(value) FILTER (series = '5-LOW') AS low FROM ys WHERE series IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY year")
def series_alignment(spark, d):
    return series.aligned(_series(spark, d), ["1-URGENT", "2-HIGH", "5-LOW"]).toDF("year", "urgent", "high", "low")
