"""Further registered queries on vectors over time, resampling and series, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolex.functions import vectors as V
from chronolex.operators import series, stats, temporal
from chronolex.plans import catalogue as C
from chronolex.plans.catalogue import _COS, _PT, _VEC, ASKED, ORACLES, PAIRS, POLE_A, POLE_B, PROJECTED, _list, _tilt, _vec, query
from chronolex.plans.records import p_sql
from chronolex.runtime import table

# ---------------------------------------------------------------- the searches for every twentieth row, in SQL

_KEYED = "kv AS (SELECT vec_id, (1900 + 10 * label)::INTEGER AS period, 'w' || row_number() OVER (PARTITION BY label ORDER BY vec_id) AS word FROM embeddings)"


def _nn(asked: str, k: int) -> str:
    return f"""WITH {_VEC}, {_KEYED}, qq AS ({asked}),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period, query ORDER BY similarity DESC, word)::INTEGER AS place FROM
  (SELECT v.period, q.word AS query, v.word, round({_COS.format('v.vec', 'q.vec')}, 9) AS similarity, v.vec FROM vec v JOIN vec q ON v.period = q.period AND v.word <> q.word JOIN qq ON qq.period = q.period AND qq.word = q.word)) WHERE place <= {k})"""


_ROWS = "SELECT period, word FROM kv WHERE vec_id % 20 = 0"
_WORDS = "SELECT period, word FROM kv WHERE word IN (SELECT word FROM kv WHERE vec_id % 20 = 0)"


def _after_nn(name: str) -> str:
    """The SQL of a neighbourhood query after its list of neighbours."""
    sql = ORACLES[name]
    head = f"WITH {_VEC}, {C._KNN}"
    assert sql.startswith(head)
    return sql[len(head) :]


for _name, _asked, _k in (("knn_topk", _ROWS, 10), ("neighborhood_coherence", _ROWS, 50), ("neighbor_turnover", _WORDS, 50), ("centroid_displacement", _WORDS, 50), ("terms_in_topk_neighbors", _ROWS, 50)):
    ORACLES[f"{_name}_whole"] = _nn(_asked, _k) + _after_nn(_name)
ORACLES["neighborhood_coherence_whole"] = ORACLES["neighborhood_coherence_whole"].replace("AND a.place < b.place", "AND a.place < b.place AND b.place <= 30")


# ---------------------------------------------------------------- expanded poles, in SQL

_EXPAND = f"""pv AS (SELECT word, vec FROM vec WHERE period = {C.REFERENCE_PERIOD}), seedw AS (SELECT DISTINCT seed FROM seeds),
near AS (SELECT seed, word FROM (SELECT q.word AS seed, v.word, row_number() OVER (PARTITION BY q.word ORDER BY round({_COS.format('v.vec', 'q.vec')}, 9) DESC, v.word) AS place FROM pv v JOIN pv q ON v.word <> q.word JOIN seedw ON q.word = seedw.seed WHERE list_dot_product(q.vec, q.vec) > 0) WHERE place <= {C.EXPANSION_K}),
pole AS (SELECT trial, word, min(up) AS up FROM (SELECT trial, up, seed AS word FROM seeds UNION ALL SELECT trial, up, word FROM seeds JOIN near USING (seed)) GROUP BY trial, word HAVING min(up) = max(up)),
pe AS (SELECT trial, up, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM vec JOIN pole USING (word)), pm AS (SELECT trial, up, i, avg(x) AS m FROM pe GROUP BY ALL),
df AS (SELECT trial, i, sum(CASE WHEN up = 1 THEN m ELSE -m END) AS d FROM pm GROUP BY trial, i), ax0 AS (SELECT trial, list(d ORDER BY i) AS a FROM df GROUP BY trial), ax AS (SELECT trial, list_transform(a, lambda x: x / sqrt(list_dot_product(a, a))) AS axis FROM ax0)"""


def _seeds(trials: dict) -> str:
    rows = ", ".join(f"('{t}', {up}, '{w}')" for t, poles in trials.items() for up, ws in zip((1, 0), poles) for w in ws)
    return f"seeds AS (SELECT * FROM (VALUES {rows}) s(trial, up, seed))"


_EXPANDED = f"WITH {_VEC}, {_seeds({'': (POLE_A, POLE_B)})}, {_EXPAND},\npr AS (SELECT word AS series, period AS x, list_dot_product(vec, axis) AS y FROM vec, ax WHERE word IN {_list(PROJECTED)})"
for _name in ("semaxis_projection", "semaxis_trend", "zscore_vs_controls", "changepoint_bic"):
    _rest = ORACLES[_name].partition("pr AS (")[2].partition(f"word IN {_list(PROJECTED)})")[2]
    ORACLES[f"{_name}_expanded"] = _EXPANDED + _rest
# means of six slopes of six decimals tie at the seventh: compared at eight
ORACLES["zscore_vs_controls_expanded"] = ORACLES["zscore_vs_controls_expanded"].replace("round(m, 6)", "round(m, 8)").replace("round(s, 6)", "round(s, 8)")

_TRIALS = {f"{i}-{j}": (POLE_A[:i] + POLE_A[i + 1 :], POLE_B[:j] + POLE_B[j + 1 :]) for i in range(len(POLE_A)) for j in range(len(POLE_B))}
ORACLES["seed_sensitivity"] = f"""WITH {_VEC}, {_seeds(_TRIALS)}, {_EXPAND}, sl AS (SELECT trial, regr_slope(list_dot_product(vec, axis), period) * 100 AS s FROM vec, ax WHERE word = 'w1' GROUP BY trial)
SELECT count(*)::BIGINT AS trials, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std, avg((s > 0)::INT::DOUBLE) AS positive, round(quantile_cont(s, 0.025), 6) AS lower, round(quantile_cont(s, 0.975), 6) AS upper FROM sl"""


# ---------------------------------------------------------------- resampling, in SQL

_PERM = """sh AS (SELECT series, turn, x, y, md5(concat_ws('-', series, turn, x, '42')) AS h FROM points, range(1000) t(turn)),
pa AS (SELECT series, turn, x, row_number() OVER (PARTITION BY series, turn ORDER BY x) AS i FROM sh), pb AS (SELECT series, turn, y, row_number() OVER (PARTITION BY series, turn ORDER BY h, x) AS i FROM sh),
sp AS (SELECT series, turn, regr_slope(y, x) AS s FROM pa JOIN pb USING (series, turn, i) GROUP BY ALL), so AS (SELECT series, regr_slope(y, x) AS o FROM points GROUP BY series HAVING count(*) >= 5),
perm AS (SELECT series, round(max(o), 9) AS slope, avg((round(abs(s), 9) >= round(abs(o), 9))::INT::DOUBLE) AS p FROM sp JOIN so USING (series) GROUP BY series)"""
ORACLES["permutation_trend"] = f"{_EXPANDED}, points AS (SELECT * FROM pr), {_PERM} SELECT * FROM perm"

_BOOT = """bv AS (SELECT series, y, row_number() OVER (PARTITION BY series ORDER BY y) - 1 AS i FROM vals), bn AS (SELECT series, count(*) AS n, avg(y) AS mean FROM vals GROUP BY series HAVING count(*) >= 2),
bd AS (SELECT series, mean, turn, (('0x' || substr(md5(concat_ws('-', series, turn, d, '42')), 1, 8))::BIGINT % n) AS i FROM (SELECT series, n, mean, turn, unnest(range(1, n + 1)) AS d FROM bn, range(1000) t(turn))),
bm AS (SELECT series, turn, avg(y) AS m, max(mean) AS mean FROM bd JOIN bv USING (series, i) GROUP BY series, turn),
boot AS (SELECT series, round(max(mean), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lower, round(quantile_cont(m, 0.975), 6) AS upper, round(stddev_pop(m), 6) AS std FROM bm GROUP BY series)"""
_MEMBERS = ", ".join(f"('{c}', '{w}')" for c, ws in C.CLUSTERS.items() for w in ws)
_DIST = f"WITH {_VEC}, mb AS (SELECT * FROM (VALUES {_MEMBERS}) x(cluster, member)), tg AS (SELECT period, vec AS tv FROM vec WHERE word = 'w1'), ds AS (SELECT period, cluster, 1 - ({_COS.format('vec', 'tv')}) AS y FROM vec JOIN mb ON word = member JOIN tg USING (period))"
ORACLES["bootstrap_cluster"] = f"{_DIST}, vals AS (SELECT period AS series, y FROM ds), {_BOOT} SELECT * FROM boot"


@query(f"{_DIST}, vals AS (SELECT cluster || ' ' || period AS series, y FROM ds), {_BOOT}, ci AS (SELECT split_part(series, ' ', 1) AS cluster, split_part(series, ' ', 2)::INTEGER AS period, lower, upper FROM boot) SELECT a.period, NOT (a.lower < b.upper AND b.lower < a.upper) AS significant FROM ci a JOIN ci b ON a.period = b.period AND a.cluster = 'legal' AND b.cluster = 'personal'")
def cluster_intervals_apart(spark, d):
    v = _vec(spark, d)
    t = v.where("word = 'w1'").select("period", F.col("vec").alias("tv"))
    m = spark.createDataFrame([(c, w) for c, ws in C.CLUSTERS.items() for w in ws], "cluster string, word string")
    y = temporal.pick(v, sorted({w for ws in C.CLUSTERS.values() for w in ws})).join(m, "word").join(t, "period").select(F.concat_ws(" ", "cluster", "period").alias("series"), V.cosine_distance(F.col("vec"), F.col("tv")).alias("y"))
    ci = stats.bootstrap_mean(y).select(F.split("series", " ")[0].alias("cluster"), F.split("series", " ")[1].cast("int").alias("period"), F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))
    return stats.intervals_apart(ci.where("cluster = 'legal'"), ci.where("cluster = 'personal'"), "period")


@query(f"""{C._CLUSTER}, points AS (SELECT 'gap' AS series, period AS x, -tilt AS y FROM tl), {_PERM}, ea AS (SELECT y, row_number() OVER (ORDER BY x) AS i, row_number() OVER (ORDER BY x DESC) AS j FROM points)
SELECT slope, p, (SELECT round(avg(y) FILTER (i <= 3), 6) FROM ea) AS early, (SELECT round(avg(y) FILTER (j <= 3), 6) FROM ea) AS late, (SELECT round(avg(y) FILTER (j <= 3) - avg(y) FILTER (i <= 3), 6) FROM ea) AS change FROM perm""")
def gap_permutation(spark, d):
    gap = _tilt(spark, d).select(F.lit("gap").alias("series"), F.col("period").alias("x"), (-F.col("tilt")).alias("y"))
    p = stats.permutation_trend(gap).select(F.round("slope", 9).alias("slope"), "p")
    return p.crossJoin(temporal.early_late(gap.withColumnRenamed("x", "period"), "y"))


@query(f"{C._AXIS} SELECT series, n, slope, mean AS intercept, std_error, z, {p_sql('z')} AS p FROM tt")
def semaxis_trend_p(spark, d):
    t = stats.trend(C._projection(spark, d))
    return t.select("series", "n", "slope", F.col("mean").alias("intercept"), "std_error", "z", stats.two_sided_p(F.col("z")).alias("p"))


@query(f"""{_PT}, ts AS (SELECT a || '/' || b AS series, period // 10 % 2 AS half, round(regr_sxy(sim, period) / regr_sxx(sim, period) * 100, 6) AS slope FROM t GROUP BY ALL HAVING count(*) >= 3)
SELECT x.series, x.slope AS first_slope, y.slope AS second_slope, (x.slope > 0) = (y.slope > 0) AS same_direction, round(abs(x.slope / nullif(y.slope, 0)), 4) AS ratio FROM ts x JOIN ts y ON x.series = y.series AND x.half = 0 AND y.half = 1""")
def trend_agreement(spark, d):
    t = temporal.pair_trajectory(_vec(spark, d), PAIRS).select(F.concat("a", F.lit("/"), "b").alias("series"), F.col("period").alias("x"), F.col("similarity").alias("y"))
    even = (F.col("x") / 10).cast("int") % 2
    return stats.same_direction(stats.trend(t.where(even == 0)), stats.trend(t.where(even == 1)))


# ---------------------------------------------------------------- words over time

_TRAJ = f"WITH {_VEC}, tr AS (SELECT word, period, vec, lag(vec) OVER w AS was, lag(period) OVER w AS from_period, first_value(vec) OVER w AS begin_, count(*) OVER (PARTITION BY word) AS n FROM vec WHERE word IN {_list(ASKED)} WINDOW w AS (PARTITION BY word ORDER BY period)), tc AS (SELECT word, period, from_period, CASE WHEN was IS NOT NULL THEN round(1 - ({_COS.format('vec', 'was')}), 6) END AS step, CASE WHEN was IS NULL THEN 0.0 ELSE round(1 - ({_COS.format('vec', 'begin_')}), 6) END AS since_first FROM tr WHERE n > 1)"


@query(f"{_TRAJ} SELECT word, period, coalesce(from_period, 0) AS from_period, step, since_first, arg_max(since_first, period) OVER (PARTITION BY word) AS total FROM tc")
def word_trajectory(spark, d):
    return temporal.trajectory(temporal.pick(_vec(spark, d), ASKED)).withColumn("from_period", F.coalesce("from_period", F.lit(0)))


@query(f"{_nn(f'SELECT period, word FROM vec WHERE word IN {_list(ASKED)}', 10)}, ns AS (SELECT query AS word, period, list(word) AS now FROM nn GROUP BY ALL), nl AS (SELECT *, lag(now) OVER w AS was, lag(period) OVER w AS from_period, first_value(now) OVER w AS begin_, count(*) OVER (PARTITION BY word) AS n FROM ns WINDOW w AS (PARTITION BY word ORDER BY period)), tc AS (SELECT word, period, from_period, CASE WHEN was IS NOT NULL THEN round(1 - len(list_intersect(now, was)) / len(list_distinct(now || was)), 6) END AS step, CASE WHEN was IS NULL THEN 0.0 ELSE round(1 - len(list_intersect(now, begin_)) / len(list_distinct(now || begin_)), 6) END AS since_first FROM nl WHERE n > 1) SELECT word, period, coalesce(from_period, 0) AS from_period, step, since_first, arg_max(since_first, period) OVER (PARTITION BY word) AS total FROM tc")
def word_trajectory_neighbours(spark, d):
    return temporal.trajectory(C._knn(spark, d), "neighbor").withColumn("from_period", F.coalesce("from_period", F.lit(0)))


@query(f"{_TRAJ}, tot AS (SELECT word, arg_max(since_first, period) AS total FROM tc GROUP BY word) SELECT word, total, row_number() OVER (ORDER BY total DESC, word)::INTEGER || '/' || (SELECT count(*) FROM tot) AS place, round((SELECT count(*) FROM tot o WHERE o.total < tot.total)::DOUBLE / nullif((SELECT count(*) FROM tot) - 1, 0), 6) AS share_less FROM tot")
def displacement_rank(spark, d):
    return temporal.rank_of(temporal.trajectory(temporal.pick(_vec(spark, d), ASKED)).groupBy("word").agg(F.max("total").alias("total")))


_TAGS = {"near": [f"w{i}" for i in range(1, 31)], "middle": [f"w{i}" for i in range(20, 61)], "far": [f"w{i}" for i in range(55, 121)]}
_TAG_ROWS = ", ".join(f"('{w}', '{t}')" for t, ws in _TAGS.items() for w in ws)


@query(f"WITH {_VEC}, {C._KNN}, lx AS (SELECT * FROM (VALUES {_TAG_ROWS}) l(w, domain)), s AS (SELECT query, period, list(word) AS now FROM nn GROUP BY ALL), l AS (SELECT *, lag(now) OVER (PARTITION BY query ORDER BY period) AS was FROM s), ch AS (SELECT query, period, 'entered' AS change, unnest(list_filter(now, lambda x: NOT list_contains(was, x))) AS word FROM l WHERE was IS NOT NULL UNION ALL SELECT query, period, 'exited', unnest(list_filter(was, lambda x: NOT list_contains(now, x))) FROM l WHERE was IS NOT NULL) SELECT query, period, change, coalesce(domain, 'untagged') AS domain, count(*)::BIGINT AS words FROM ch LEFT JOIN lx ON word = w GROUP BY ALL")
def neighbor_domain_turnover(spark, d):
    lex = spark.createDataFrame([(w, t, i) for i, (t, ws) in enumerate(_TAGS.items()) for w in ws], "word string, domain string, domain_rank int")
    return temporal.domain_turnover(temporal.turnover(C._knn(spark, d)), lex)


@query(f"WITH {_VEC} SELECT period, count(*)::BIGINT AS words, count(*) FILTER (word = 'w1') > 0 AS has_first, count(*) FILTER (word = 'w55') > 0 AS has_second FROM vec GROUP BY period")
def vocabulary_by_period(spark, d):
    return _vec(spark, d).groupBy("period").agg(F.count("*").alias("words"), (F.count_if(F.col("word") == "w1") > 0).alias("has_first"), (F.count_if(F.col("word") == "w55") > 0).alias("has_second"))


@query(f"WITH {_VEC} SELECT word FROM vec WHERE period = 1900 INTERSECT SELECT word FROM vec WHERE period = 1990")
def words_in_both_ends(spark, d):
    v = _vec(spark, d)
    return v.where("period = 1900").select("word").join(v.where("period = 1990"), "word", "left_semi")


_CHART = ["w2", "w3", "w4", "w5", "w45", "w50"]


@query(f"WITH {_VEC}, c AS (SELECT v.period, v.word, round({_COS.format('v.vec', 't.vec')}, 6) AS s FROM vec v JOIN vec t ON v.period = t.period AND t.word = 'w1'), p AS (SELECT DISTINCT period FROM vec) SELECT period, {', '.join(f'max(s) FILTER (word = {chr(39)}{w}{chr(39)}) AS {w}' for w in _CHART)} FROM p LEFT JOIN c USING (period) GROUP BY period")
def control_chart(spark, d):
    v = _vec(spark, d)
    t = v.where("word = 'w1'").select("period", F.col("vec").alias("tv"))
    s = temporal.pick(v, _CHART).join(t, "period").select("period", "word", F.round(V.cosine_similarity(F.col("vec"), F.col("tv")), 6).alias("s"))
    return v.select("period").distinct().join(s.groupBy("period").pivot("word", _CHART).agg(F.max("s")), "period", "left")


# ---------------------------------------------------------------- series

_DY = "WITH ys AS (SELECT source AS series, year, round(avg(n_chars), 2) AS value FROM documents WHERE source IS NOT NULL AND year IS NOT NULL AND n_chars IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY year) AS i, row_number() OVER (PARTITION BY series ORDER BY year DESC) AS j FROM ys), g AS (SELECT series, CASE WHEN avg(value) FILTER (i <= 5) = 0 THEN 'inf'::DOUBLE ELSE round(avg(value) FILTER (j <= 5) / avg(value) FILTER (i <= 5), 6) END AS growth, arg_max(year, {'v': value, 'y': -year}) AS peak_year, max(value) AS peak FROM r GROUP BY series HAVING count(*) >= 10)"


def _sizes(spark, d):
    rows = table(spark, d, "documents").where("source is not null and year is not null and n_chars is not null")
    return rows.groupBy(F.col("source").alias("series"), "year").agg(F.round(F.avg("n_chars"), 2).alias("value"))


@query(f"{_DY} SELECT * FROM g")
def series_growth_ends(spark, d):
    return series.growth(_sizes(spark, d))


@query(f"{_DY} SELECT series, growth, row_number() OVER (ORDER BY growth DESC, series)::INTEGER AS place FROM g")
def series_growth_rank(spark, d):
    return series.growth_rank(series.growth(_sizes(spark, d)))


@query("SELECT o_orderpriority AS series, round(avg(o_totalprice), 2) AS mean, max(o_totalprice) AS most, arg_min(o_orderkey, {'v': -o_totalprice, 'k': o_orderkey}) AS peak_at, min(o_totalprice) AS least FROM orders GROUP BY ALL")
def series_summary(spark, d):
    return series.summary(table(spark, d, "orders").select(F.col("o_orderpriority").alias("series"), F.col("o_orderkey").alias("at"), F.col("o_totalprice").alias("value")))
