"""Words over time on per-period vectors ``(period, word, vec)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.functions import vectors as V


def words_by_period(embeddings: DataFrame) -> DataFrame:
    """Labelled vectors as periods of ten years and words w1, w2, ... by key."""
    return keyed_words(embeddings).drop("vec_id")


#: Keys of a label that are numbered together.
NUMBERED_TOGETHER = 1_000_000


def keyed_words(embeddings: DataFrame) -> DataFrame:
    """``words_by_period`` with the key of each vector.

    Keys are numbered in ranges of ``NUMBERED_TOGETHER``, and each range begins where the
    count of those before it ends, so no task sorts the whole of a label.  Keys of one
    range need no counts.
    """
    part = F.floor(F.col("vec_id") / NUMBERED_TOGETHER)
    first, last = embeddings.agg(F.min(part), F.max(part)).first()
    if first == last:
        return _named(embeddings, F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    sizes = embeddings.select("label", part.alias("part")).groupBy("label", "part").agg(F.count("*").alias("n"))
    begins = sizes.select("label", "part", (F.sum("n").over(Window.partitionBy("label").orderBy("part")) - F.col("n")).alias("begin"))
    rows = embeddings.withColumn("part", part).join(F.broadcast(begins), ["label", "part"])  # one row a label and million keys
    return _named(rows, F.col("begin") + F.row_number().over(Window.partitionBy("label", "part").orderBy("vec_id")))


def _named(rows: DataFrame, n: Column) -> DataFrame:
    return rows.select("vec_id", (F.lit(1900) + 10 * F.col("label")).cast("int").alias("period"), F.concat(F.lit("w"), n.cast("string")).alias("word"), F.col("embedding").alias("vec"))


def pick(vectors: DataFrame, words: list[str]) -> DataFrame:
    return vectors.where(F.col("word").isin(words))


def pair_trajectory(vectors: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Similarity of word pairs in each period that has both."""
    p = vectors.sparkSession.createDataFrame(pairs, "a string, b string")
    names = sorted({w for x in pairs for w in x})
    some = pick(vectors, names)
    left, right = some.alias("l"), some.alias("r")
    j = p.join(left, F.col("a") == F.col("l.word")).join(right, (F.col("b") == F.col("r.word")) & (F.col("l.period") == F.col("r.period")))
    return j.select("a", "b", F.col("l.period").alias("period"), V.cosine_similarity(F.col("l.vec"), F.col("r.vec")).alias("similarity"))


def divergence(trajectory: DataFrame) -> DataFrame:
    """Last less first similarity of each pair, ranked from the most diverging; null below two periods."""
    g = trajectory.groupBy("a", "b").agg((F.max_by("similarity", "period") - F.min_by("similarity", "period")).alias("d"), F.count("*").alias("n"))
    g = g.select("a", "b", F.when(F.col("n") > 1, F.round("d", 6)).alias("divergence"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.coalesce("divergence", F.lit(0.0)), "a", "b")))


def drift(vectors: DataFrame, words: list[str]) -> DataFrame:
    """Distance of a word to its last available period, and to its first."""
    w = Window.partitionBy("word").orderBy("period")
    rows = pick(vectors, words).select("word", "period", "vec", F.lag("vec").over(w).alias("before"), F.lag("period").over(w).alias("from_period"), F.first("vec").over(w).alias("begin"))
    return rows.where("before is not null").select("word", "period", "from_period", F.round(V.cosine_distance(F.col("vec"), F.col("before")), 6).alias("step"), F.round(V.cosine_distance(F.col("vec"), F.col("begin")), 6).alias("since_first"))


def trajectory(rows: DataFrame, metric: str = "cosine") -> DataFrame:
    """Change of each word to its last available period, since its first (0 there), and in all; words of one period are left out.

    ``cosine`` takes vectors ``(period, word, vec)``; ``neighbor`` takes neighbour lists
    ``(period, query, word)`` and measures 1 less their Jaccard share.
    """
    if metric == "cosine":
        w, value = Window.partitionBy("word").orderBy("period"), "vec"
        change = lambda a, b: V.cosine_distance(a, b)
    elif metric == "neighbor":
        rows = rows.groupBy(F.col("query").alias("q"), "period").agg(F.collect_set("word").alias("near")).select(F.col("q").alias("word"), "period", "near")
        w, value = Window.partitionBy("word").orderBy("period"), "near"
        change = lambda a, b: 1 - F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    else:
        raise ValueError(f"unknown metric: {metric}")
    every = Window.partitionBy("word")
    now, was, begin = F.col(value), F.col("was"), F.col("begin")
    r = rows.select("word", "period", value, F.lag(value).over(w).alias("was"), F.lag("period").over(w).alias("from_period"), F.first(value).over(w).alias("begin"), F.count("*").over(every).alias("n")).where("n > 1")
    r = r.select("word", "period", "from_period", F.when(was.isNotNull(), F.round(change(now, was), 6)).alias("step"), F.when(was.isNull(), 0.0).otherwise(F.round(change(now, begin), 6)).alias("since_first"))
    return r.withColumn("total", F.max_by("since_first", "period").over(every))


def rank_of(totals: DataFrame) -> DataFrame:
    """Place of each word as 'r/n' from the most displaced, and the share of the others that are less displaced."""
    n = F.count("*").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc("total"), "word"))
    less = F.rank().over(Window.orderBy("total")) - 1
    return totals.select("word", "total", F.concat(place.cast("string"), F.lit("/"), n.cast("string")).alias("place"), F.round(F.try_divide(less.cast("double"), n - 1), 6).alias("share_less"))


def domain_turnover(turned: DataFrame, lex: DataFrame) -> DataFrame:
    """``(query, period, change, domain, words)``: domains of the neighbours that came and went; a word counts in each of its domains."""
    side = lambda c: F.struct(F.lit(c).alias("change"), F.filter(F.split(c, " "), lambda x: x != "").alias("ws"))
    long = turned.select("query", "period", F.explode(F.array(side("entered"), side("exited"))).alias("s")).select("query", "period", "s.change", F.explode("s.ws").alias("w"))
    return long.join(lex, F.col("w") == lex["word"], "left").groupBy("query", "period", "change", F.coalesce("domain", F.lit("untagged")).alias("domain")).agg(F.count("*").alias("words"))


def knn(vectors: DataFrame, words: list[str], k: int, *, with_vectors: bool = False) -> DataFrame:
    """The k nearest words of each query word in each period; a zero vector has none."""
    return nearest(vectors, pick(vectors, words), k, with_vectors=with_vectors)


#: Parts in which the words of a period meet the words asked for.
BLOCKS = 16


def nearest(vectors: DataFrame, asked: DataFrame, k: int, *, with_vectors: bool = False) -> DataFrame:
    """``(period, query, word, similarity, place)``: ``knn`` of the rows ``asked(period, word, vec)``; on demand with ``vec``.

    A period is not one join key: its words are spread over ``BLOCKS`` parts, and the rows
    asked go to each.  The best of each part are kept before anything is gathered by query,
    and vectors are fetched for those that remain.
    """
    part = F.pmod(F.xxhash64("word"), F.lit(BLOCKS))
    q = asked.select("period", F.col("word").alias("query"), F.col("vec").alias("qv")).where(V.norm(F.col("qv")) > 0).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long"))))
    sim = vectors.withColumn("part", part).join(q, ["period", "part"]).where("word != query").select("period", "query", "word", F.round(V.cosine_similarity(F.col("vec"), F.col("qv")), 9).alias("similarity"))
    n = F.row_number().over(Window.partitionBy("period", "query").orderBy(F.desc("similarity"), "word"))
    best = sim.withColumn("place", n).where(F.col("place") <= k)
    if not with_vectors:
        return best
    return best.join(vectors.select("period", "word", "vec"), ["period", "word"]).select("period", "query", "word", "similarity", "vec", "place")


def turnover(neighbours: DataFrame) -> DataFrame:
    """Neighbours that came, went and stayed since the previous period, and the Jaccard share."""
    sets = neighbours.groupBy("query", "period").agg(F.sort_array(F.collect_set("word")).alias("now"))
    w = Window.partitionBy("query").orderBy("period")
    j = sets.withColumn("was", F.lag("now").over(w)).where("was is not null")
    both, either = F.size(F.array_intersect("now", "was")), F.size(F.array_union("now", "was"))
    return j.select("query", "period", F.array_join(F.sort_array(F.array_except("now", "was")), " ").alias("entered"), F.array_join(F.sort_array(F.array_except("was", "now")), " ").alias("exited"), both.alias("stayed"), F.round(both / F.greatest(either, F.lit(1)), 6).alias("jaccard"))


def centroids(neighbours: DataFrame) -> DataFrame:
    """Mean of the neighbours' vectors; at most k vectors are gathered for a query and period."""
    lists = neighbours.groupBy("query", "period").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "vec"))), lambda x: x["vec"]).alias("vs"))
    return lists.select("query", "period", V.mean_vector(F.col("vs")).alias("centroid"))


def displacement(neighbours: DataFrame) -> DataFrame:
    """Distance between the neighbourhood centroids of consecutive periods."""
    w = Window.partitionBy("query").orderBy("period")
    j = centroids(neighbours).withColumn("was", F.lag("centroid").over(w)).where("was is not null")
    return j.select("query", "period", F.round(V.cosine_distance(F.col("centroid"), F.col("was")), 6).alias("displacement"))


def coherence(neighbours: DataFrame, most: int = 30) -> DataFrame:
    """Mean similarity among the first neighbours of a query; null below two."""
    n = neighbours.where(F.col("place") <= most).select("query", "period", "place", "vec")
    a, b = n.alias("a"), n.alias("b")
    pairs = a.join(b, (F.col("a.query") == F.col("b.query")) & (F.col("a.period") == F.col("b.period")) & (F.col("a.place") < F.col("b.place")))
    return pairs.groupBy(F.col("a.query").alias("query"), F.col("a.period").alias("period")).agg(F.round(F.avg(V.cosine_similarity(F.col("a.vec"), F.col("b.vec"))), 6).alias("coherence"))


def cluster_distances(vectors: DataFrame, word: str, clusters: dict[str, list[str]]) -> DataFrame:
    """Mean and spread of the distances of a word to the members of each cluster, and over all (cluster null)."""
    m = vectors.sparkSession.createDataFrame([(c, w) for c, ws in clusters.items() for w in ws], "cluster string, member string")
    some = pick(vectors, [word, *{w for ws in clusters.values() for w in ws}])
    t = some.where(F.col("word") == word).select("period", F.col("vec").alias("tv"))
    d = some.join(m, F.col("word") == F.col("member")).join(t, "period").select("period", "cluster", V.cosine_distance(F.col("vec"), F.col("tv")).alias("d"))
    return d.rollup("period", "cluster").agg(F.round(F.avg("d"), 6).alias("mean"), F.round(F.stddev_pop("d"), 6).alias("std"), F.count("*").alias("members")).where("period is not null")


def tilt(distances: DataFrame, near: str, far: str) -> DataFrame:
    """Mean distance to ``far`` less that to ``near``; a missing mean counts as 1."""
    g = distances.where("cluster is not null").groupBy("period").agg(F.max(F.when(F.col("cluster") == near, F.col("mean"))).alias("a"), F.max(F.when(F.col("cluster") == far, F.col("mean"))).alias("b"))
    a, b = F.coalesce("a", F.lit(1.0)), F.coalesce("b", F.lit(1.0))
    return g.select("period", F.round(b - a, 6).alias("tilt"), F.round(F.when(a > 0, b / a), 6).alias("ratio"), F.when(b < a, far).otherwise(near).alias("closer"))


def crossover(tilts: DataFrame) -> DataFrame:
    """The first period whose nearer cluster is not that of the period before."""
    was = F.lag("closer").over(Window.orderBy("period"))
    return tilts.select("period", "closer", was.alias("was")).where("was is not null and was != closer").agg(F.min("period").alias("crossover"), F.min_by("closer", "period").alias("to_cluster"))


def early_late(series: DataFrame, value: str) -> DataFrame:
    """Means of the first and the last three periods and their difference."""
    r = series.select("period", value, F.row_number().over(Window.orderBy("period")).alias("i"), F.row_number().over(Window.orderBy(F.desc("period"))).alias("j"))
    early, late = F.avg(F.when(F.col("i") <= 3, F.col(value))), F.avg(F.when(F.col("j") <= 3, F.col(value)))
    return r.agg(F.round(early, 6).alias("early"), F.round(late, 6).alias("late"), F.round(late - early, 6).alias("change"))


def axis(vectors: DataFrame, agency: list[str], constraint: list[str]) -> DataFrame:
    """One row ``axis``: the unit vector from the mean of one pole to the mean of the other, over all periods."""
    pole = F.when(F.col("word").isin(agency), 1).otherwise(0)
    rows = pick(vectors, [w for w in [*agency, *constraint] if (w in agency) != (w in constraint)]).withColumn("pole", pole)
    return _axes(rows.withColumn("trial", F.lit(""))).select("axis")


def _axes(rows: DataFrame) -> DataFrame:
    """``(trial, axis)`` of rows ``(trial, pole, vec)``; pole is 1 or 0."""
    parts = rows.select("trial", "pole", F.posexplode("vec").alias("i", "x")).groupBy("trial", "pole", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    d = parts.groupBy("trial", "i").agg(F.sum(F.when(F.col("pole") == 1, F.col("m")).otherwise(-F.col("m"))).alias("d"), F.count("*").alias("poles")).where("poles = 2")
    whole = d.groupBy("trial").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "d"))), lambda x: x["d"]).alias("a"))
    n = V.norm(F.col("a"))
    return whole.where(n > 0).select("trial", F.transform("a", lambda x: x / n).alias("axis"))


def expanded_poles(vectors: DataFrame, trials: dict[str, tuple[list[str], list[str]]], period: int, k: int = 10) -> DataFrame:
    """``(trial, pole, word)``: the seeds of each trial's two poles and their k nearest words in a period, without words of both."""
    rows = [(t, pole, w) for t, (agency, constraint) in trials.items() for pole, ws in ((1, agency), (0, constraint)) for w in ws]
    seeds = vectors.sparkSession.createDataFrame(rows, "trial string, pole int, seed string")
    near = knn(vectors.where(F.col("period") == period), sorted({w for _, _, w in rows}), k).select(F.col("query").alias("seed"), "word")
    words = seeds.select("trial", "pole", F.col("seed").alias("word")).unionByName(seeds.join(near, "seed").select("trial", "pole", "word"))
    return words.groupBy("trial", "word").agg(F.min("pole").alias("pole"), F.max("pole").alias("most")).where("pole = most").select("trial", "pole", "word")


def expanded_axes(vectors: DataFrame, trials: dict[str, tuple[list[str], list[str]]], period: int, k: int = 10) -> DataFrame:
    """``(trial, axis)``: as ``axis``, of poles that are expanded in each trial."""
    return _axes(vectors.join(expanded_poles(vectors, trials, period, k), "word"))


def project(vectors: DataFrame, axis_row: DataFrame, words: list[str]) -> DataFrame:
    """Plain dot product of words with the axis; magnitude counts."""
    return pick(vectors, words).crossJoin(F.broadcast(axis_row)).select("word", "period", V.dot(F.col("vec"), F.col("axis")).alias("projection"))  # broadcasts one row
