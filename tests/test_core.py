import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from chronolex.functions import text as X
from chronolex.functions import vectors as V
from chronolex.operators import corpus, labels, series, stats, temporal
from chronolex.plans import catalogue, records, spaces  # noqa: F401
from chronolex.sources import readers
from chronolex.streaming import labels as live


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c")).alias("x")).first().x


def test_sentences_and_ids(spark):
    assert one(spark, X.sentences, "A b! c; d") == ["A b!", " c;", " d"]
    row = spark.createDataFrame([("1999-01-02", "A", 1234)], "d string, s string, i int").select(X.stable_id(F.col("d"), F.col("s"), F.col("i")).alias("x")).first().x
    assert row.endswith("-1234") and row.startswith("1999-01-02-")


@pytest.mark.parametrize(
    ("old", "new"),
    [("libertie", "liberty"), ("FREEDOME", "FREEDOM"), ("Freedome", "Freedom"), ("ſubiect", "subject"), ("vvhich", "which"), ("Vnto", "Unto"), ("a  b\nc", "a b\nc"), ("cookie", "cooky"), ("movie", "movie"), ("vying", "uying"), (None, None), ("", "")],
)
def test_spelling(spark, old, new):
    assert one(spark, X.normalise_spelling, old) == new


def test_markup_and_speaker(spark):
    assert one(spark, X.strip_markup, "[[a|b]] <i>c</i> {{d}} e").split() == ["b", "c", "e"]
    assert one(spark, X.clean_speaker, "Mr. A (X)") == "Mr. A" and one(spark, X.clean_speaker, " ,") == "Unknown"


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([3.0, 4.0], [4.0, 3.0])], "a array<float>, b array<float>")
    assert [r.x for r in df.select(V.cosine_similarity(F.col("a"), F.col("b")).alias("x")).collect()] == [0.0, pytest.approx(0.96)]


def label_rows(*groups):
    n, out = 0, []
    for year, label, count in groups:
        for _ in range(count):
            n += 1
            out.append((n, f"i{n}", year, "s", label, label, True))
    return out


SCHEMA = "eval_id long, id string, year int, sentence string, haiku string, opus string, agree boolean"


def test_label_shares_and_trend(spark):
    rows = label_rows((1900, "positive_liberty", 10), (1900, "negative_liberty", 90), (1910, "positive_liberty", 30), (1910, "negative_liberty", 70), (1920, "positive_liberty", 50), (1920, "negative_liberty", 50), (None, "other", 3), (1900, "junk", 1), (1900, None, 1))
    counts = labels.counts_by_decade(spark.createDataFrame(rows, SCHEMA))
    first = counts.where("decade = 1900").first()
    assert (first.pos_neg, first.error, first.missing, first.total) == (100, 1, 1, 102)
    t = labels.weighted_trend(labels.shares(counts)).first()
    assert t.slope == pytest.approx(2.0) and t.end_change == pytest.approx(0.4)
    assert labels.weighted_trend(labels.shares(counts).where("decade < 1920")).count() == 0


def test_weighted_trend_ends(spark):
    p = spark.createDataFrame([(1900, 0.1, 100), (1910, 0.2, 100), (1920, 0.3, 100), (1930, 0.4, 100)], "decade int, share double, n long")
    assert labels.weighted_trend(p).first().end_change == pytest.approx(0.3)


def test_wilson_and_p(spark):
    df = spark.createDataFrame([(0.0, 0.0), (3.0, 10.0)], "x double, n double").select(*[c.alias(a) for c, a in zip(labels.wilson(F.col("x"), F.nullif(F.col("n"), F.lit(0.0))), "pab")])
    assert [tuple(r) for r in df.collect()] == [(None, None, None), (0.3, 0.107789, 0.603227)]
    z = spark.createDataFrame([(1.96,)], "z double").select(stats.two_sided_p(F.col("z")).alias("p")).first().p
    assert z == pytest.approx(math.erfc(1.96 / math.sqrt(2)), abs=1e-6)


def test_missing_ranges(spark):
    df = spark.createDataFrame([(y,) for y in (2000, 2001, 2004, 2006, None)], "year int")
    assert sorted(tuple(r) for r in corpus.missing_ranges(df).collect()) == [(2002, 2003, 2), (2005, 2005, 1)]


def test_collocates_count_overlaps_twice(spark):
    df = spark.createDataFrame([(1, 1900, "trade freedom of freedom canal")], "speech_id int, decade int, text string")
    got = {(r.collocate, r.n) for r in corpus.collocate_counts(df).collect()}
    assert got == {("trade", 2), ("canal", 2)}


def test_current_labels(spark):
    t = dt.datetime
    rows = [(1, "i", "a", "other", t(2024, 1, 1), None), (2, "i", "a", None, t(2024, 1, 2), "n"), (3, "i", "b", "other", t(2024, 1, 1), None), (3, "i", "b", "other", t(2024, 1, 1), None)]
    df = spark.createDataFrame(rows, "log_id long, id string, annotator string, label string, labelled_at timestamp, notes string")
    assert {(r.annotator, r.label) for r in labels.current_labels(df).collect()} == {("a", None), ("b", "other")}
    assert labels.current_labels(df.where("false")).count() == 0


def test_change_point_and_permutation(spark):
    step = [("s", 1800 + 10 * i, float(i < 5) + 0.001 * (i % 2)) for i in range(12)] + [("short", i, 1.0) for i in range(6)]
    p = spark.createDataFrame(step, "series string, x int, y double")
    got = {r.series: r.change_at for r in stats.change_point(p).collect()}
    assert got["s"] == 1850 and got["short"] is None
    line = spark.createDataFrame([("l", i, float(i)) for i in range(8)], "series string, x int, y double")
    a, b = (stats.permutation_trend(line, rounds=200).first() for _ in range(2))
    assert a == b and a.p < 0.05
    ci = stats.bootstrap_mean(line, rounds=200).first()
    assert ci.lower <= ci.mean <= ci.upper


def test_series(spark):
    s = spark.createDataFrame([("a", 2000, 1.0), ("a", 2002, 2.0), ("a", 2003, 2.001), ("b", 2000, 0.0), ("b", 2001, 5.0)], "series string, year int, value double")
    assert [r.change_pct for r in series.year_over_year(s).orderBy("series", "year").collect()] == [None, 100.0, 0.05, None, None]
    assert series.last_three(s).collect() == [("a", "PLATEAU")]


def test_neighbours_bridge_gaps(spark):
    v = spark.createDataFrame([(p, w, [math.cos(a), math.sin(a)]) for p, w, a in [(1900, "x", 0.0), (1900, "y", 0.1), (1900, "z", 1.0), (1920, "x", 0.5), (1920, "z", 0.6)]], "period int, word string, vec array<float>")
    assert [(r.from_period, r.period) for r in temporal.drift(v, ["x"]).collect()] == [(1900, 1920)]
    assert temporal.turnover(temporal.knn(v, ["x"], 1)).select("entered", "exited", "stayed").collect() == [("z", "y", 0)]


@pytest.fixture(scope="module")
def spaces(tmp_path_factory, spark):
    """Three periods of 60 words as a table of embeddings, and as arrays by period and word."""
    import numpy as np

    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.standard_normal(64)], i % 3) for i in range(180)]
    d = str(tmp_path_factory.mktemp("spaces"))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d, {(1900 + 10 * p, f"w{i // 3 + 1}"): np.array(v, np.float32).astype(float) for i, v, p in rows}


def nearest_words(vectors, period, query, k):
    import numpy as np

    v = {w: x / np.linalg.norm(x) for (p, w), x in vectors.items() if p == period}
    return [w for _, w in sorted((-round(float(v[query] @ x), 9), w) for w, x in v.items() if w != query)[:k]]


def test_every_asked_row_is_searched(spark, spaces):
    d, vectors = spaces
    asked = {(1900 + 10 * (i % 3), f"w{i // 3 + 1}") for i in range(0, 180, 20)}
    got = {}
    for r in catalogue.QUERIES["knn_topk_whole"](spark, d).orderBy("place").collect():
        got.setdefault((r.period, r["query"]), []).append(r.word)
    assert got == {x: nearest_words(vectors, *x, 10) for x in asked}
    want = {(w, p) for _, w in asked for p in (1910, 1920)}
    for name in ("neighbor_turnover_whole", "centroid_displacement_whole"):
        assert {(r["query"], r.period) for r in catalogue.QUERIES[name](spark, d).collect()} == want
    assert {(r.period, r["query"]) for r in catalogue.QUERIES["neighborhood_coherence_whole"](spark, d).collect()} == asked


def test_neighbourhoods_hold_fifty(spark, spaces):
    import numpy as np

    d, vectors = spaces
    unit = {x: v / np.linalg.norm(v) for x, v in vectors.items()}
    near = {(p, w): nearest_words(vectors, p, w, 50) for p, w in vectors}
    for r in catalogue.QUERIES["neighborhood_coherence_whole"](spark, d).collect():
        m = np.array([unit[r.period, w] for w in near[r.period, r["query"]][:30]])
        assert r.coherence == pytest.approx(float((m @ m.T)[np.triu_indices(30, 1)].mean()), abs=2e-6)
    for r in catalogue.QUERIES["neighbor_turnover_whole"](spark, d).collect():
        now, was = ({*near[p, r["query"]]} for p in (r.period, r.period - 10))
        assert (r.entered.split(), r.exited.split(), r.stayed) == (sorted(now - was), sorted(was - now), len(now & was))
    for r in catalogue.QUERIES["centroid_displacement_whole"](spark, d).collect():
        a, b = (np.mean([vectors[p, w] for w in near[p, r["query"]]], axis=0) for p in (r.period, r.period - 10))
        assert r.displacement == pytest.approx(float(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b)), abs=2e-6)


def test_poles_are_expanded(spark, spaces):
    import numpy as np

    d, vectors = spaces

    def axis(agency, constraint):
        a, c = ({*p}.union(*(nearest_words(vectors, 1900, w, 10) for w in p)) for p in (agency, constraint))
        up, down = (np.mean([v for (_, w), v in vectors.items() if w in p], axis=0) for p in (a - c, c - a))
        return (up - down) / np.linalg.norm(up - down)

    A, B = catalogue.POLE_A, catalogue.POLE_B
    whole = axis(A, B)
    got = {(r.x, r.series): r.y for r in catalogue.QUERIES["semaxis_projection_expanded"](spark, d).collect()}
    assert got == {(p, w): pytest.approx(float(v @ whole), abs=2e-6) for (p, w), v in vectors.items() if w in catalogue.PROJECTED}
    periods = (1900, 1910, 1920)
    slopes = [np.polyfit(periods, [vectors[p, "w1"] @ axis([x for x in A if x != a], [x for x in B if x != b]) for p in periods], 1)[0] * 100 for a in A for b in B]
    r = catalogue.QUERIES["seed_sensitivity"](spark, d).first()
    assert r.trials == 16 and r["mean"] == pytest.approx(np.mean(slopes)) and r["std"] == pytest.approx(np.std(slopes))


def test_word2vec_returns_its_vectors(spark, tmp_path):
    texts = ["often seldom often word"] * 50 + ["often word word"] * 25
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.word: r.vector for r in catalogue.QUERIES["word2vec_train"](spark, str(tmp_path)).collect()}
    assert {w: v.size for w, v in got.items()} == {"often": 300, "word": 300} and all(v.toArray().any() for v in got.values())


def test_word2vec_trains_on_all_cores(spark, tmp_path, monkeypatch):
    from pyspark.ml import feature

    tasks, fit = [], feature.Word2Vec.fit
    monkeypatch.setattr(feature.Word2Vec, "fit", lambda self, docs: tasks.append(self.getNumPartitions()) or fit(self, docs))
    monkeypatch.setattr(catalogue, "CHARACTERS_A_TRAINER", 100, raising=False)
    spark.createDataFrame([("often seldom often word",)] * 100, "text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.word: r.vector for r in catalogue.QUERIES["word2vec_train"](spark, str(tmp_path)).collect()}
    assert tasks == [spark.sparkContext.defaultParallelism]
    assert {w: v.size for w, v in got.items()} == {"often": 300, "seldom": 300, "word": 300} and all(v.toArray().any() for v in got.values())


def test_procrustes_undoes_a_rotation(spark):
    import numpy as np

    r = np.random.default_rng(0)
    x, q = r.standard_normal((20, 3)), np.linalg.qr(r.standard_normal((3, 3)))[0]
    frame = lambda m: spark.createDataFrame([(f"w{i}", [float(t) for t in row]) for i, row in enumerate(m)], "word string, vec array<double>")
    got = {g.word: g.vec for g in stats.procrustes(frame(x), frame(x @ q), 3).collect()}
    assert np.allclose([got[f"w{i}"] for i in range(20)], x @ q)


def test_procrustes_aligns_every_period(spark, tmp_path):
    import numpy as np

    r = np.random.default_rng(0)
    x = r.standard_normal((80, 64))
    turned = [x, *(x @ np.linalg.qr(r.standard_normal((64, 64)))[0] for _ in range(2))]
    rows = [(3 * i + p, [float(t) for t in turned[p][i]], p) for i in range(80) for p in range(3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(g.period, g.word): g.vec for g in catalogue.QUERIES["procrustes_align"](spark, str(tmp_path)).collect()}
    assert len(got) == 240 and all(np.allclose(got[p, f"w{i + 1}"], x[i], atol=1e-4) for p in (1900, 1910, 1920) for i in range(80))


def test_xml_readers(spark, tmp_path):
    (tmp_path / "S3V0178P0.xml").write_text("<r><p><member>Mr. A,</member><membercontribution>twenty characters <i>at</i> least</membercontribution></p><p>short</p></r>")
    got = readers.read_archive_xml(spark, f"{tmp_path}/S3*.xml").first()
    assert (got.year, got.speaker, got.text) == (1860, "Mr. A", "twenty characters at least")
    (tmp_path / "debates2001-02-03a.xml").write_text('<r><speech person_id="p1" speakername="Mr A (X)"><p>One <i>two <b>three</b></i> four.</p><p>Five.</p></speech></r>')
    got = readers.read_debates_xml(spark, f"{tmp_path}/deb*.xml").first()
    assert (got.date, got.person_id, got.speaker) == ("2001-02-03", "p1", "Mr A") and "three" not in got.text and "Five." in got.text


def test_archive_years(spark, tmp_path):
    page = "<r><p><membercontribution>twenty characters at least</membercontribution></p></r>"
    for name in ("S5V0500P0", "S5V0020P0", "xxS3V0178P0", "S9V0001P0"):
        (tmp_path / f"{name}.xml").write_text(page)
    assert {(r.source_file, r.year) for r in readers.read_archive_xml(spark, f"{tmp_path}/*.xml").collect()} == {("S5V0020P0", 1910)}
    assert {r.year for r in readers.read_archive_xml(spark, f"{tmp_path}/*.xml", before=None).collect()} == {1910, 1945}


def test_binned_contexts_and_vectors(spark, tmp_path):
    import json

    import numpy as np

    (tmp_path / "eebo_1500-1550.json").write_text(json.dumps([{"tcp_id": "a", "year": 1510, "title": "t", "text": "x y", "word_count": 2, "junk": 1}]))
    assert [(r.tcp_id, r.bin) for r in readers.read_binned(spark, str(tmp_path)).collect()] == [("a", "1500-1550")]
    assert readers.read_binned(spark, str(tmp_path), bin_label="1600-1650").count() == 0
    (tmp_path / "freedom_contexts_b.json").write_text(json.dumps([{"year": 1510, "title": "t", "context_count": 1, "contexts": [{"left_context": "l", "right_context": "r", "full_context": "f"}]}]))
    assert [tuple(r) for r in readers.read_contexts(spark, str(tmp_path)).collect()] == [("b", 1510, "t", "l", "r", "f")]
    np.save(tmp_path / "1900-w.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    np.save(tmp_path / "1910-w.npy", np.zeros((1, 2), np.float32))
    (tmp_path / "1900-vocab.json").write_text('["a", "b", "c"]')
    got = readers.read_saved_vectors(spark, str(tmp_path))
    assert {(r.period, r.word, tuple(r.vec)) for r in got.collect()} == {(1900, "a", (0, 1)), (1900, "b", (2, 3)), (1900, "c", (4, 5))}
    readers.write_vectors(got, spark.createDataFrame([("a", 5), ("b", 9), ("c", 1)], "word string, n long"), f"{tmp_path}/out", most=2)
    assert {r.word for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"a", "b"}


def test_label_files(spark, tmp_path):
    t = dt.datetime
    kind = "id string, label string, labelled_at timestamp, notes string"
    mine = spark.createDataFrame([("a", "other", t(2024, 1, 1), 'say "no"'), ("b", "other", t(2024, 1, 3), None)], kind)
    readers.write_labels(mine, f"{tmp_path}/csv")
    text = next((tmp_path / "csv").glob("part*")).read_text()
    assert text.startswith("id,label,timestamp,notes") and '"say ""no"""' in text
    new = spark.createDataFrame([("a", "ambiguous", t(2024, 1, 1), None), ("b", "ambiguous", t(2024, 1, 2), None), ("c", "other", t(2024, 1, 1), None)], kind)
    assert {(r.id, r.label) for r in readers.import_labels(mine, new).collect()} == {("a", "ambiguous"), ("b", "other"), ("c", "other")}
    readers.write_result(mine, f"{tmp_path}/res")
    assert len(list((tmp_path / "res").glob("part*"))) == 1
    sheet = readers.annotation_rows(spark.createDataFrame([("a", 1905, None), ("b", None, "x")], "id string, year int, sentence string")).collect()
    assert len(sheet) == 1 and sheet[0].decade == 1900 and sheet[0].sentence == sheet[0].annotator_1 == ""


def test_from_sentence_files_to_trends(spark, tmp_path):
    import json

    record = lambda y, l: {"id": "x", "year": y, "party": "P", "methods": {"llm": json.dumps({"label": l})}}
    rows = [record(y, "positive_liberty") for y, n in ((1900, 10), (1910, 30), (1920, 50)) for _ in range(n)] + [record(y, "negative_liberty") for y, n in ((1900, 90), (1910, 70), (1920, 50)) for _ in range(n)]
    (tmp_path / "sentences_1900s.json").write_text(json.dumps(rows))
    sent = readers.read_sentence_json(spark, f"{tmp_path}/sentences_*s.json")
    counts = labels.counts_by_decade(sent.withColumn("haiku", F.get_json_object(F.col("methods")["llm"], "$.label")))
    got = {r.test: r for r in labels.weighted_trends(labels.trend_points(counts, 1)).collect()}
    first = got["positive_share_of_positive_negative"]
    assert set(got) == set(labels.TESTS) and first.slope == pytest.approx(2.0) and (first.first_share, first.last_share) == (0.1, 0.5)
    assert got["negative_share_of_substantive"].slope == pytest.approx(-2.0) and got["ambiguous_share_of_substantive"].z == 0
    m = labels.manifest(sent, index_total=300).first()
    assert (m.total, m.stale_methods, m.stale_removed, m.index_matches, m.llm_labels_present) == (300, "", True, True, 300)
    stale = labels.manifest(sent.withColumn("methods", F.map_concat("methods", F.create_map(F.lit("from_to"), F.lit("to"))))).first()
    assert (stale.stale_methods, stale.stale_removed, stale.index_matches) == ("from_to", False, None)


def test_analyses_from_files_to_results(spark, tmp_path):
    import json

    import numpy as np

    from chronolex import analyses

    rows = [{"id": f"{y}{i}", "year": y, "sentence": "s", "party": "P", "methods": {"llm": l, "from_to": "x"}} for y in (1900, 1910, 1920) for i, l in enumerate(["positive_liberty"] * (y - 1895) + ["negative_liberty"] * 40)]
    (tmp_path / "sentences_1900s.json").write_text(json.dumps(rows))
    (tmp_path / "index.json").write_text(json.dumps({"total_sentences": len(rows)}))
    analyses.main(["label-trends", "--data-dir", str(tmp_path), "--output", f"{tmp_path}/out", "--min-denominator", "1"])
    got = {r.test: r.slope for r in spark.read.json(f"{tmp_path}/out/trend_tests").collect()}
    assert len(got) == 4 and got["positive_share_of_positive_negative"] > 0
    check = analyses.manifest(spark, str(tmp_path))
    assert (check["checks"].first().index_matches, check["checks"].first().stale_removed) == (True, False) and check["missing_years"].count() == 2
    assert analyses.annotation_sample(spark, str(tmp_path), per_bucket=2)["sheet"].count() == 12
    (tmp_path / "s.csv").write_text("speech_date,speech,display_as,party\n" + "".join(f'19{y}-01-01,"The freedom of trade, and the liberty of the canal. Freedom again here.",A,P\n' for y in range(10, 30) for _ in range(10)))
    got = analyses.speeches(spark, str(tmp_path))
    assert got["frequency"].count() == 20 and got["sentences"].count() > 0 and got["collocates"].count() > 0
    r = np.random.default_rng(0)
    for p in range(1900, 1960, 10):
        np.save(tmp_path / f"{p}-w.npy", r.standard_normal((40, 8)).astype(np.float32))
        (tmp_path / f"{p}-vocab.json").write_text(json.dumps([f"v{i}" for i in range(40)]))
    got = analyses.spaces(spark, str(tmp_path), ["v1", "v2"], ["v3", "v4"], ["v5", "v6", "v7"])
    assert {k: df.count() for k, df in got.items() if k in ("projection", "trend", "trajectory")} == {"projection": 18, "trend": 3, "trajectory": 18}
    (tmp_path / "eebo_1.json").write_text(json.dumps([{"tcp_id": "a", "year": 1510, "title": "t", "text": "the libertie and freedom of the canall trade", "word_count": 8}]))
    assert analyses.prints(spark, str(tmp_path))["contexts"].count() == 1


def test_saved_answers_of_services(spark, tmp_path):
    import json

    (tmp_path / "n.json").write_text(json.dumps([{"ngram": "trade", "timeseries": [0.5, 0.25]}, {"ngram": "trade (All)", "timeseries": [9.0]}]))
    assert sorted(tuple(r) for r in readers.read_ngrams(spark, f"{tmp_path}/n.json", 1900).collect()) == [("trade", 1900, 0.5), ("trade", 1901, 0.25)]
    (tmp_path / "t.csv").write_text("date,trade,canal,isPartial\n2020-01-05,10,<1,False\n2020-01-12,10,4,True\n")
    got = readers.read_trends(spark, f"{tmp_path}/t.csv")
    assert sorted(tuple(r) for r in got.collect()) == [("canal", "2020-01-12", 4.0), ("trade", "2020-01-05", 10.0), ("trade", "2020-01-12", 10.0)]
    assert {r.series: r.peak_at for r in series.summary(got).collect()} == {"trade": "2020-01-05", "canal": "2020-01-12"}
    lines = [{"custom_id": "i-0", "result": {"type": "succeeded", "label": "other", "rationale": "r"}}, {"custom_id": "i-1", "result": {"type": "expired"}}, {"custom_id": "i-2", "result": {"type": "succeeded"}}]
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert {(r.custom_id, r.label) for r in readers.read_batch_results(spark, f"{tmp_path}/b.jsonl").collect()} == {("i-0", "other"), ("i-1", "error"), ("i-2", "error")}
    (tmp_path / "r.csv").write_text("Musicke,music\n,\n")
    assert one(spark, lambda c: X.normalise_spelling(c, readers.read_respellings(f"{tmp_path}/r.csv")), "MUSICKE") == "MUSIC"
    assert one(spark, lambda c: X.highlight(c, "trade"), "Free trade, trader") == "Free <mark>trade</mark>, trader"


def test_growth_needs_ten_years(spark):
    rows = [("nine", 2000 + i, 1.0) for i in range(9)] + [("zero", 2000 + i, float(i > 4)) for i in range(10)] + [("up", 2000 + i, 1.0 + (i > 4)) for i in range(10)]
    got = series.growth(spark.createDataFrame(rows, "series string, year int, value double"))
    assert {r.series: r.growth for r in got.collect()} == {"zero": float("inf"), "up": 2.0}
    assert [r.series for r in series.growth_rank(got).orderBy("place").collect()] == ["zero", "up"]


def test_perturbation_takes_each_spread(spark):
    kind = "series string, a array<double>, b array<double>, spread_a double, spread_b double, near_a int, near_b int"
    a, b = [1.0, 0.0, 0.5], [0.5, 1.0, 0.0]
    rows = [("still", a, b, 0.0, 0.0, 10, 10), ("one", a, b, 0.5, 0.0, 10, 10), ("other", a, b, 0.0, 0.5, 10, 10), ("few", a, b, 0.5, 0.5, 4, 10), ("zero", a, [0.0] * 3, 0.0, 0.0, 9, 9)]
    df = spark.createDataFrame(rows, kind)
    got = {r.series: r for r in stats.perturbed_similarity(df).collect()}
    assert got["still"].std < 1e-12 < min(got["one"].std, got["other"].std) and got["few"].lower is None and got["zero"].point == 0
    assert {r.series: r.lower for r in stats.perturbed_similarity(df.repartition(3)).collect()} == {k: r.lower for k, r in got.items()}


def test_kappa_and_facets(spark):
    p, n = "positive_liberty", "negative_liberty"
    df = spark.createDataFrame([(p, p), (p, p), (n, n), (p, n), (p, None), ("junk", p)], "haiku string, opus string")
    k = labels.kappa(df, "haiku", "opus").first()
    assert (k.n, k.agreement, k.kappa) == (4, 0.75, 0.5) and k.alpha == pytest.approx(1 - 0.25 / (1 - (5 * 4 * 2 - 5 * 4 + 3 * 2) / 56), abs=0.2)
    assert labels.kappa(df.where("false"), "haiku", "opus").first().kappa is None


def test_versions_move_once(spark):
    kind = "struct<label:string,rationale:string,model:string,version:string>"
    rows = [("a", ("x", "", "m", "v1"), None), ("b", ("x", "", "m", "v2"), None), ("c", ("y", "", "m", "v1"), ("old", "", "m", "v0")), ("d", None, None)]
    got = labels.with_version(spark.createDataFrame(rows, f"id string, llm {kind}, llm_v1 {kind}"), spark.createDataFrame([("a", "new", "r")], "id string, label string, rationale string"), "v2", "m2")
    assert {(r.id, r.llm.label, r.llm_v1.label if r.llm_v1 else None) for r in got.collect()} == {("a", "new", "x"), ("b", "error", None), ("c", "error", "old"), ("d", "error", None)}


def test_places_are_stable(spark):
    df = spark.createDataFrame([(i * 7 % 1000,) for i in range(1000)], "k long").repartition(7)
    assert {(r.k, r.custom_id) for r in labels.by_position(df, ["k"]).collect()} == {(i, f"i-{i:06d}") for i in range(1000)}


def test_written_folders_are_released(spark):
    from chronolex import runtime

    kept = list(runtime._made)
    try:
        runtime._made.clear()
        df = runtime.written(spark.range(5).toDF("x"))
        assert df.count() == 5 and len(runtime._made) == 1 and runtime.release(spark) == 1
        with pytest.raises(Exception):
            df.sparkSession.read.parquet(df.inputFiles()[0]).count()
    finally:
        runtime._made[:] = kept


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from chronolex import runtime

    sc = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="checkpoint"):
        runtime.shared_dir(SimpleNamespace(sparkContext=sc))


def test_numbering_in_ranges(spark, monkeypatch):
    df = spark.createDataFrame([(i, i % 3, [0.0]) for i in range(50)], "vec_id long, label int, embedding array<float>")
    whole = {tuple(r) for r in temporal.keyed_words(df).select("vec_id", "word").collect()}
    monkeypatch.setattr(temporal, "NUMBERED_TOGETHER", 7)
    assert {tuple(r) for r in temporal.keyed_words(df).select("vec_id", "word").collect()} == whole == {(i, f"w{i // 3 + 1}") for i in range(50)}


def test_csv_json_glove(spark, tmp_path):
    (tmp_path / "s.csv").write_text('speech_date,speech,party,extra\n2001-01-01,"long enough, yes",P,1\n,short,P,2\n')
    assert [tuple(r) for r in readers.read_speech_csv(spark, f"{tmp_path}/s.csv").collect()] == [("2001-01-01", 2001, None, "P", "long enough, yes")]
    (tmp_path / "sentences_1900s.json").write_text('[{"id": "a", "year": 1900, "methods": {"llm": "x", "from_to": "y"}}]')
    assert set(readers.read_sentence_json(spark, f"{tmp_path}/*.json").first().methods) == {"llm", "from_to"}
    (tmp_path / "g.txt").write_text("bad 1 2\nword " + " ".join(["0.5"] * 10) + "\n")
    assert [(r.word, len(r.vec)) for r in readers.read_glove(spark, f"{tmp_path}/g.txt").collect()] == [("word", 10)]


def test_stream(spark, tmp_path):
    t = dt.datetime
    df = spark.createDataFrame([(t(2024, 1, 1, 1, 5), "a"), (t(2024, 1, 1, 1, 50), "a"), (t(2024, 1, 1, 9), "b")], "ts timestamp, event_type string")
    df.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/e")
    q = live.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.event_type, r.n) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1)}


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) > 60
