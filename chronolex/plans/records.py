"""Further registered queries on sentences, labels and their files, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolex.functions import text as X
from chronolex.operators import corpus, labels
from chronolex.plans.catalogue import _COUNTS, _CUR, _LEX, _MAJ, _NORM, _POLE, _PARTY, _SENT, _W, ORACLES, _counts, _list, _scores, _speeches, query
from chronolex.runtime import shared_dir, table
from chronolex.sources import readers


def p_sql(z: str) -> str:
    """Two-sided p of a normal z in SQL, by the same series as ``stats.two_sided_p``."""
    terms = f"list_sum(list_transform(range(0, 151), lambda n: exp((2 * n + 1) * ln(2 * abs({z}) / sqrt(2)) + lgamma(n + 1) - lgamma(2 * n + 2)) / 2))"
    return f"CASE WHEN {z} IS NULL THEN NULL WHEN abs({z}) / sqrt(2) > 6 THEN 0.0 WHEN {z} = 0 THEN 1.0 ELSE round(greatest(1 - 2 / sqrt(pi()) * exp(-{z} * {z} / 2) * {terms}, 0), 6) END"


# ---------------------------------------------------------------- trends of labels

_TRENDS = f"""WITH {_COUNTS}, tp0 AS ({" UNION ALL ".join(f"SELECT '{t}' AS test, decade, {among} AS n, {of}::DOUBLE AS k FROM lcc" for t, (of, among) in labels.TESTS.items())}),
tp AS (SELECT test, decade, n, round(k / n, 6) AS share, avg(decade) OVER (PARTITION BY test) AS c FROM tp0 WHERE n >= 5),
ts AS (SELECT test, count(*)::BIGINT AS k, sum(w) AS sw, sum(w*x) AS swx, sum(w*y) AS swy, sum(w*x*x) - sum(w*x)*sum(w*x)/sum(w) AS sxx, sum(w*x*y) - sum(w*x)*sum(w*y)/sum(w) AS sxy, sum(w*y*y) - sum(w*y)*sum(w*y)/sum(w) AS syy,
  arg_min(y, decade) AS pa, arg_min(w, decade) AS na, arg_max(y, decade) AS pb, arg_max(w, decade) AS nb FROM (SELECT test, decade, (decade - c) / 100 AS x, share AS y, n::DOUBLE AS w FROM tp) GROUP BY test HAVING count(*) >= 3),
tt AS (SELECT test, k AS points, round(sxy / sxx, 6) AS slope, round((swy - sxy / sxx * swx) / sw, 6) AS intercept, round(sqrt(greatest(syy - sxy*sxy/sxx, 0) / (k - 2) / sxx), 6) AS std_error, round(coalesce(sxy / sxx / nullif(sqrt(greatest(syy - sxy*sxy/sxx, 0) / (k - 2) / sxx), 0), 0), 4) AS z,
  round(pb - pa, 6) AS end_change, round((pb - pa) / nullif(sqrt(pa*(1-pa)/na + pb*(1-pb)/nb), 0), 4) AS end_z, pa AS first_share, pb AS last_share FROM ts)"""


@query(f"{_TRENDS} SELECT *, {p_sql('z')} AS p FROM tt")
def label_trends(spark, d):
    return labels.weighted_trends(labels.trend_points(_counts(spark, d), 5))


ORACLES["label_trend_pvalue"] = f"{_TRENDS} SELECT slope, z, {p_sql('z')} AS p FROM tt WHERE test = 'positive_share_of_positive_negative'"


@query(f"WITH {_COUNTS} SELECT decade, round(positive_liberty * 100.0::DOUBLE / pos_neg_amb, 4) AS positive_pct, round(negative_liberty * 100.0::DOUBLE / pos_neg_amb, 4) AS negative_pct, round(ambiguous * 100.0::DOUBLE / pos_neg_amb, 4) AS ambiguous_pct FROM lcc WHERE pos_neg_amb > 0")
def label_pct_by_decade(spark, d):
    pct = lambda c, a: F.round(F.col(c) * 100.0 / F.col("pos_neg_amb"), 4).alias(a)
    return _counts(spark, d).where("pos_neg_amb > 0").select("decade", pct("positive_liberty", "positive_pct"), pct("negative_liberty", "negative_pct"), pct("ambiguous", "ambiguous_pct"))


@query(f"WITH n AS (SELECT haiku AS label, count(*)::BIGINT AS n FROM opus_vs_haiku WHERE haiku IN {_list(labels.LABELS)} GROUP BY ALL) SELECT label, n, round(n * 100.0::DOUBLE / (SELECT sum(n) FROM n), 4) AS pct FROM n")
def label_distribution(spark, d):
    n = table(spark, d, "opus_vs_haiku").where(F.col("haiku").isin(*labels.LABELS)).groupBy(F.col("haiku").alias("label")).agg(F.count("*").alias("n"))
    return n.crossJoin(n.agg(F.sum("n").alias("every"))).select("label", "n", F.round(F.col("n") * 100.0 / F.col("every"), 4).alias("pct"))


@query(f"SELECT annotator, count(*)::BIGINT AS total, {', '.join(f'count(*) FILTER (label = {chr(39)}{k}{chr(39)})::BIGINT AS {k}' for k in labels.LABELS)} FROM (WITH {_CUR} SELECT * FROM now) GROUP BY ALL")
def label_stats(spark, d):
    return labels.current_labels(table(spark, d, "label_log")).groupBy("annotator").agg(F.count("*").alias("total"), *[F.count_if(F.col("label") == k).alias(k) for k in labels.LABELS])


@query(f"WITH k AS (SELECT unnest({list(labels.LABELS)}) AS l), n AS (SELECT haiku, opus, count(*)::BIGINT AS n FROM opus_vs_haiku GROUP BY ALL) SELECT x.l AS before, y.l AS after, coalesce(n, 0)::BIGINT AS n, x.l = y.l AS stable FROM k x CROSS JOIN k y LEFT JOIN n ON x.l = haiku AND y.l = opus")
def label_migration_matrix(spark, d):
    kinds = F.col("predicted").isin(*labels.LABELS) & F.col("truth").isin(*labels.LABELS)
    return labels.confusion(table(spark, d, "opus_vs_haiku"), "haiku", "opus").where(kinds).select(F.col("predicted").alias("before"), F.col("truth").alias("after"), "n", (F.col("predicted") == F.col("truth")).alias("stable"))


@query(f"""WITH e AS (SELECT {_NORM.format('haiku')} AS p, {_NORM.format('opus')} AS t FROM opus_vs_haiku), k AS (SELECT unnest({list(labels.LABELS)}) AS label)
SELECT label, count(*) FILTER (p = label)::BIGINT AS predicted, count(*) FILTER (t = label)::BIGINT AS truth, count(*) FILTER (p = label AND t = label)::BIGINT AS hits,
  round(count(*) FILTER (p = label AND t = label)::DOUBLE / nullif(count(*) FILTER (p = label), 0), 6) AS "precision", round(count(*) FILTER (p = label AND t = label)::DOUBLE / nullif(count(*) FILTER (t = label), 0), 6) AS recall FROM k CROSS JOIN e GROUP BY label""")
def eval_report(spark, d):
    cells = labels.confusion(table(spark, d, "opus_vs_haiku"), "haiku", "opus")
    side = lambda c: F.struct(F.col(c).alias("label"), F.lit(c == "predicted").alias("of_p"), F.lit(c == "truth").alias("of_t"))
    long = cells.select("n", (F.col("predicted") == F.col("truth")).alias("hit"), F.explode(F.array(side("predicted"), side("truth"))).alias("s")).select("n", "hit", "s.*").where(F.col("label").isin(*labels.LABELS))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    g = long.groupBy("label").agg(total(F.col("of_p")).alias("predicted"), total(F.col("of_t")).alias("truth"), total(F.col("of_p") & F.col("hit")).alias("hits"))
    return g.select("*", F.round(F.try_divide("hits", "predicted"), 6).alias("precision"), F.round(F.try_divide("hits", "truth"), 6).alias("recall"))


_K = ", ".join(f"count(*) FILTER ({c} = '{k}')::DOUBLE AS {c}_{k}" for c in ("haiku", "opus") for k in labels.LABELS)
_CHANCE = "(" + " + ".join(f"haiku_{k} * opus_{k}" for k in labels.LABELS) + ") / (n * n)"
_EXPECT = "(" + " + ".join(f"(haiku_{k} + opus_{k}) * (haiku_{k} + opus_{k} - 1)" for k in labels.LABELS) + ") / (2 * n * (2 * n - 1))"


@query(f"""WITH g AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (haiku = opus)::DOUBLE AS same, {_K} FROM opus_vs_haiku WHERE haiku IN {_list(labels.LABELS)} AND opus IN {_list(labels.LABELS)})
SELECT n::BIGINT AS n, round(same / n, 6) AS agreement, round((same / n - {_CHANCE}) / (1 - {_CHANCE}), 6) AS kappa, round((same / n - {_EXPECT}) / (1 - {_EXPECT}), 6) AS alpha FROM g""")
def label_kappa(spark, d):
    return labels.kappa(table(spark, d, "opus_vs_haiku"), "haiku", "opus")


@query("SELECT log_id, annotator, id, label FROM (SELECT *, lead(labelled_at) OVER (PARTITION BY annotator, id ORDER BY labelled_at, log_id) AS next FROM label_log) WHERE next IS NULL OR next - labelled_at > INTERVAL 500 MILLISECONDS")
def labels_debounced(spark, d):
    return labels.debounced(table(spark, d, "label_log"))


@query(f"""WITH {_CUR}, {_MAJ}, r AS (SELECT e.eval_id, e.id, e.year, e.haiku, maj.id IS NOT NULL AS labelled FROM opus_vs_haiku e LEFT JOIN maj USING (id) WHERE (year // 10 * 10) = 1900 AND haiku IS NOT NULL AND coalesce(haiku = opus, false) AND contains(lower(sentence), 'the'))
SELECT * FROM r ORDER BY labelled, year, eval_id LIMIT 25""")
def browse_unlabelled(spark, d):
    t = table(spark, d, "opus_vs_haiku")
    kept = t.where(labels.facets(decade=1900, agreement=True, text="the") & F.col("haiku").isNotNull())
    done = labels.majority(labels.current_labels(table(spark, d, "label_log"))).select("id", F.lit(True).alias("l"))
    return kept.join(done, "id", "left").select("eval_id", "id", "year", "haiku", F.coalesce("l", F.lit(False)).alias("labelled")).orderBy("labelled", "year", "eval_id").limit(25)


@query("SELECT eval_id, id, coalesce(sentence, '') AS sentence, coalesce(year, 0) AS year FROM opus_vs_haiku")
def eval_projection(spark, d):
    return table(spark, d, "opus_vs_haiku").select("eval_id", "id", F.coalesce("sentence", F.lit("")).alias("sentence"), F.coalesce("year", F.lit(0)).alias("year"))


@query(f"SELECT coalesce(id, '') AS id, (year // 10 * 10)::INTEGER AS decade, year, '' AS date, '' AS word, '' AS speaker, '' AS party, coalesce(sentence, '') AS sentence, {_NORM.format('haiku')} AS llm_label, '' AS annotator_1, '' AS annotator_2, '' AS adjudicated_label, '' AS notes FROM opus_vs_haiku WHERE year IS NOT NULL")
def annotation_sheet(spark, d):
    return readers.annotation_rows(table(spark, d, "opus_vs_haiku").withColumn("llm_label", labels.normalise(F.col("haiku"))))


# ---------------------------------------------------------------- batches and versions

_PLACE = "pos AS (SELECT *, 'i-' || CASE WHEN k < 1000000 THEN lpad(k::VARCHAR, 6, '0') ELSE k::VARCHAR END AS custom_id FROM (SELECT *, row_number() OVER (ORDER BY eval_id) - 1 AS k FROM opus_vs_haiku))"


@query(f"""WITH {_PLACE} SELECT eval_id, to_json({{'custom_id': custom_id, 'params': {{'model': 'small', 'max_tokens': 300, 'messages': [{{'role': 'user', 'content': CASE WHEN year IS NULL THEN '' ELSE '(' || year || ') ' END || coalesce(sentence, '')}}]}}}})::VARCHAR AS request FROM pos""")
def batch_requests(spark, d):
    rows = labels.by_position(table(spark, d, "opus_vs_haiku").select("eval_id", "year", "sentence"), ["eval_id"])
    head = F.coalesce(F.concat(F.lit("("), F.col("year").cast("string"), F.lit(") ")), F.lit(""))
    return rows.select("eval_id", labels.request(F.col("custom_id"), F.concat(head, F.coalesce("sentence", F.lit(""))), "small", 300).alias("request"))


@query(f"WITH {_PLACE}, res AS (SELECT custom_id, opus FROM pos WHERE eval_id % 3 <> 0) SELECT eval_id, CASE WHEN res.custom_id IS NULL THEN 'error' ELSE {_NORM.format('res.opus')} END AS label FROM pos LEFT JOIN res USING (custom_id)")
def batch_results(spark, d):
    rows = labels.by_position(table(spark, d, "opus_vs_haiku").select("eval_id", "opus"), ["eval_id"])
    results = rows.where("eval_id % 3 <> 0").select("custom_id", labels.normalise(F.col("opus")).alias("label"))
    return rows.select("eval_id", "custom_id").join(results, "custom_id", "left").select("eval_id", F.coalesce("label", F.lit("error")).alias("label"))


@query(f"""WITH r AS (SELECT eval_id, haiku, CASE WHEN eval_id % 5 = 0 THEN 'v2' ELSE 'v1' END AS version, opus FROM opus_vs_haiku)
SELECT eval_id, CASE WHEN opus IS NULL THEN 'error' ELSE opus END AS label, 'v2' AS version, CASE WHEN haiku IS NOT NULL AND version <> 'v2' THEN haiku END AS old_label FROM r""")
def label_versions(spark, d):
    t = table(spark, d, "opus_vs_haiku")
    version = F.when(F.col("eval_id") % 5 == 0, "v2").otherwise("v1")
    kind = "struct<label:string,rationale:string,model:string,version:string>"
    llm = F.when(F.col("haiku").isNotNull(), F.struct(F.col("haiku").alias("label"), F.lit("").alias("rationale"), F.lit("small").alias("model"), version.alias("version")))
    rows = t.select(F.col("eval_id").cast("string").alias("id"), "eval_id", llm.alias("llm"), F.lit(None).cast(kind).alias("llm_v1"))
    results = t.where("opus is not null").select(F.col("eval_id").cast("string").alias("id"), F.col("opus").alias("label"), F.lit("as asked").alias("rationale"))
    return labels.with_version(rows, results, "v2", "large").select("eval_id", "llm.label", "llm.version", F.col("llm_v1.label").alias("old_label"))


@query(f"""SELECT count(*)::BIGINT AS total, min(year) AS first_year, max(year) AS last_year, count(DISTINCT opus)::BIGINT AS parties, CASE WHEN bool_or(agree) THEN 'from_to' ELSE '' END AS stale_methods, count(*) FILTER (haiku IN {_list(labels.LABELS)})::BIGINT AS llm_labels_present,
  NOT coalesce(bool_or(agree), false) AS stale_removed FROM opus_vs_haiku""")
def manifest_stale(spark, d):
    method = lambda k, c: F.struct(F.lit(k).alias("k"), c.alias("v"))
    found = F.filter(F.array(method("llm", F.col("haiku")), method("from_to", F.when(F.col("agree"), F.lit("to")))), lambda x: x["v"].isNotNull())
    return labels.manifest(table(spark, d, "opus_vs_haiku").select("year", F.col("opus").alias("party"), F.map_from_entries(found).alias("methods"))).drop("index_matches")


# ---------------------------------------------------------------- parties, facets, domains of sentences

_BLOC = f"{_W}, {_SENT}, {_POLE}, pl AS (SELECT {_PARTY} AS bloc, score, CASE WHEN score > 0 THEN 'positive_liberty' WHEN score < 0 THEN 'negative_liberty' WHEN agency > 0 THEN 'ambiguous' ELSE 'other' END AS label FROM score)"


def _bloc_scores(spark, d):
    name = F.lower(F.trim("party"))
    bloc = F.when(name.startswith("civic"), "Civic").when(name.startswith("harbour"), "Harbour").when(name.startswith("crown"), "Crown")
    label = F.when(F.col("score") > 0, labels.LABELS[0]).when(F.col("score") < 0, labels.LABELS[1]).when(F.col("agency") > 0, labels.LABELS[2]).otherwise(labels.LABELS[3])
    return _scores(spark, d).select(bloc.alias("bloc"), "score", label.alias("label")).where("bloc is not null")


@query(f"{_BLOC} SELECT bloc, count(*)::BIGINT AS sentences, {', '.join(f'round(count(*) FILTER (label = {chr(39)}{k}{chr(39)}) * 100.0::DOUBLE / count(*), 4) AS {k}_pct' for k in labels.LABELS)} FROM pl WHERE bloc IS NOT NULL GROUP BY bloc")
def party_label_pct(spark, d):
    return _bloc_scores(spark, d).groupBy("bloc").agg(F.count("*").alias("sentences"), *[F.round(F.count_if(F.col("label") == k) * 100.0 / F.count("*"), 4).alias(f"{k}_pct") for k in labels.LABELS])


@query(f"{_BLOC} SELECT bloc, round(avg(score), 4) AS mean_score FROM pl WHERE bloc IS NOT NULL GROUP BY bloc")
def score_by_party(spark, d):
    return _bloc_scores(spark, d).groupBy("bloc").agg(F.round(F.avg("score"), 4).alias("mean_score"))


@query(f"{_W}, {_SENT} SELECT DISTINCT unnest(['decade', 'year', 'party']) AS facet, unnest([decade::VARCHAR, year::VARCHAR, coalesce(party, 'Unknown')]) AS value FROM sent")
def facet_values(spark, d):
    s = corpus.sentence_records(_speeches(spark, d))
    one = lambda k, c: F.struct(F.lit(k).alias("facet"), c.alias("value"))
    return s.select(F.explode(F.array(one("decade", F.col("decade").cast("string")), one("year", F.col("year").cast("string")), one("party", F.coalesce("party", F.lit("Unknown"))))).alias("x")).select("x.*").distinct()


_DOM = f"{_W}, {_SENT}, {_LEX}, st_ AS (SELECT speech_id, idx, unnest(regexp_extract_all(lower(sentence), '[a-z]+')) AS t FROM sent), sd AS (SELECT speech_id, idx, domain, count(*)::BIGINT AS n FROM st_ JOIN lex ON t = w GROUP BY ALL)"


@query(f"{_DOM} SELECT speech_id, idx, string_agg(domain || '=' || n, ',' ORDER BY domain) AS domains, array_to_string(list(domain ORDER BY n DESC, domain)[1:2], ',') AS top_two FROM sd GROUP BY ALL")
def sentence_domains(spark, d):
    return corpus.sentence_domains(corpus.sentence_records(_speeches(spark, d)), corpus.lexicon(spark)).select("speech_id", "idx", F.array_join(F.transform(F.array_sort(F.map_entries("domains")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("domains"), F.array_join("top", ",").alias("top_two"))


@query(f"WITH {_LEX} SELECT w AS word FROM lex WHERE domain = 'law'")
def domain_words(spark, d):
    return corpus.domain_words(corpus.lexicon(spark), "law")


@query(r"SELECT doc_id, regexp_replace(text, '(?i)\b(freedom)\b', '<mark>\1</mark>', 'g') AS text FROM documents WHERE regexp_matches(lower(text), 'freedom')")
def highlighted(spark, d):
    return table(spark, d, "documents").where(F.lower("text").contains("freedom")).select("doc_id", X.highlight(F.col("text"), "freedom").alias("text"))


@query(rf"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents WHERE regexp_matches(lower(text), 'freedom|liberty')),
p AS (SELECT w, unnest(w) AS match, generate_subscripts(w, 1)::INTEGER - 1 AS position FROM t), c AS (SELECT lower(array_to_string(w[greatest(position - 10, 0) + 1 : position], ' ') || ' ' || array_to_string(w[position + 2 : position + 11], ' ')) AS c FROM p WHERE regexp_matches(match, '^(?i)(freedom|liberty)\b')),
k AS (SELECT unnest(regexp_extract_all(c, '[a-z]+')) AS word FROM c) SELECT word, count(*)::BIGINT AS n FROM k WHERE length(word) > 2 AND word NOT IN {_list(corpus.STOPWORDS)} GROUP BY ALL ORDER BY n DESC, word LIMIT 100""")
def kwic_collocates(spark, d):
    return corpus.kwic_collocates(corpus.kwic(table(spark, d, "documents"), "doc_id", "text")).orderBy(F.desc("n"), "word").limit(100)


# ---------------------------------------------------------------- files


def _written_sentences(spark, d):
    path = shared_dir(spark)
    readers.write_by_decade(corpus.sentence_records(_speeches(spark, d)), path)
    return path


@query(f"{_W}, {_SENT} SELECT count(*)::BIGINT AS index_total, count(*)::BIGINT AS scan_total, true AS matches FROM sent")
def index_matches_scan(spark, d):
    path = _written_sentences(spark, d)
    index = spark.read.text(f"{path}/_index").select(F.get_json_object("value", "$.total_sentences").cast("long").alias("index_total"))
    scan = spark.read.json(path).agg(F.count("*").alias("scan_total"))
    return index.crossJoin(scan).select("*", (F.col("index_total") == F.col("scan_total")).alias("matches"))


@query(f"{_W}, {_SENT} SELECT speech_id, idx::BIGINT AS idx, id, sentence, word, year::BIGINT AS year, decade, date, speaker, party FROM sent")
def sentences_by_decade_files(spark, d):
    return spark.read.json(_written_sentences(spark, d)).select("speech_id", "idx", "id", "sentence", "word", "year", "decade", "date", "speaker", "party")
