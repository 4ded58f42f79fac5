"""Labels of models and people: counts, intervals, trends, agreement, samples, the label log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.functions import text as X
from chronolex.operators import stats
from chronolex.runtime import written

LABELS = ("positive_liberty", "negative_liberty", "ambiguous", "other")


def normalise(c: Column) -> Column:
    """One of the labels, 'missing' for null, else 'error'."""
    return F.when(c.isNull(), "missing").when(c.isin(*LABELS), c).otherwise("error")


def counts_by_decade(df: DataFrame, label: str = "haiku") -> DataFrame:
    rows = df.where("year is not null").select(X.decade_of(F.col("year")).alias("decade"), normalise(F.col(label)).alias("l"))
    kinds = (*LABELS, "missing", "error")
    got = rows.groupBy("decade").agg(F.count("*").alias("total"), *[F.count_if(F.col("l") == k).alias(k) for k in kinds])
    pn = F.col(LABELS[0]) + F.col(LABELS[1])
    return got.withColumn("pos_neg", pn).withColumn("pos_neg_amb", pn + F.col("ambiguous"))


def wilson(x: Column, n: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """Share and Wilson interval, clamped to [0, 1], 6 decimals; null for n = 0."""
    p = x / n
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    safe = lambda c: F.when(n > 0, F.round(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)), 6))
    return F.when(n > 0, F.round(p, 6)), safe(mid - half), safe(mid + half)


def shares(counts: DataFrame, least: int = 5, of: str = LABELS[0], among: str = "pos_neg") -> DataFrame:
    """Share of one label among several by decade, with its interval; by default positive among positive and negative."""
    n = F.nullif(F.col(among), F.lit(0)).cast("double")
    p, lo, hi = wilson(F.col(of).cast("double"), n)
    return counts.where(F.col(among) >= least).select("decade", F.col(among).alias("n"), p.alias("share"), lo.alias("lower"), hi.alias("upper"))


#: The shares whose trends are tested: what is counted, and among what.
TESTS = {
    "positive_share_of_positive_negative": (LABELS[0], "pos_neg"), "positive_share_of_substantive": (LABELS[0], "pos_neg_amb"),
    "negative_share_of_substantive": (LABELS[1], "pos_neg_amb"), "ambiguous_share_of_substantive": (LABELS[2], "pos_neg_amb"),
}


def trend_points(counts: DataFrame, least: int = 30) -> DataFrame:
    """``(test, decade, share, n)`` of all tested shares; decades with fewer than ``least`` are left out."""
    one = lambda t, of, among: F.struct(F.lit(t).alias("test"), F.col(among).alias("n"), F.round(F.try_divide(F.col(of).cast("double"), F.col(among)), 6).alias("share"))
    long = counts.select("decade", F.explode(F.array(*[one(t, *x) for t, x in TESTS.items()])).alias("x")).select("x.test", "decade", "x.share", "x.n")
    return long.where((F.col("n") >= least) & (F.col("n") > 0))


def weighted_trends(points: DataFrame) -> DataFrame:
    """Weighted least squares of share on decade (per century, centred on the plain mean decade), by test.

    One row each: points, slope, intercept, standard error, z and its p, the shares at the
    ends, and their change with its binomial z.  No row below three points.
    """
    stat = points.where("n > 0").withColumn("c", F.avg("decade").over(Window.partitionBy("test")))
    x, y, w = (F.col("decade") - F.col("c")) / 100, F.col("share"), F.col("n").cast("double")
    s = stat.groupBy("test").agg(
        F.count("*").alias("k"), F.sum(w).alias("sw"), F.sum(w * x).alias("swx"), F.sum(w * y).alias("swy"), F.sum(w * x * x).alias("swxx"), F.sum(w * x * y).alias("swxy"), F.sum(w * y * y).alias("swyy"),
        F.min_by(F.struct("share", "n"), "decade").alias("a"), F.max_by(F.struct("share", "n"), "decade").alias("b"),
    )
    sxx = F.col("swxx") - F.col("swx") * F.col("swx") / F.col("sw")
    sxy = F.col("swxy") - F.col("swx") * F.col("swy") / F.col("sw")
    syy = F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw")
    slope = sxy / sxx
    se = F.sqrt(F.greatest(syy - sxy * sxy / sxx, F.lit(0.0)) / (F.col("k") - 2) / sxx)
    change = F.col("b.share") - F.col("a.share")
    noise = F.sqrt(F.col("a.share") * (1 - F.col("a.share")) / F.col("a.n") + F.col("b.share") * (1 - F.col("b.share")) / F.col("b.n"))
    z = F.round(F.coalesce(F.try_divide(slope, se), F.lit(0.0)), 4)
    return s.where("k >= 3").select(
        "test", F.col("k").alias("points"), F.round(slope, 6).alias("slope"), F.round((F.col("swy") - slope * F.col("swx")) / F.col("sw"), 6).alias("intercept"), F.round(se, 6).alias("std_error"), z.alias("z"),
        F.round(change, 6).alias("end_change"), F.round(F.try_divide(change, noise), 4).alias("end_z"), stats.two_sided_p(z).alias("p"), F.col("a.share").alias("first_share"), F.col("b.share").alias("last_share"),
    )


def weighted_trend(points: DataFrame) -> DataFrame:
    """``weighted_trends`` of one series of points, without its p and its ends."""
    return weighted_trends(points.withColumn("test", F.lit(""))).drop("test", "p", "first_share", "last_share")


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: items that both labelled, raw agreement, Cohen's kappa and Krippendorff's nominal alpha.

    Kappa is null where chance agreement is certain; alpha counts the labels of both together.
    """
    both = df.where(F.col(a).isin(*LABELS) & F.col(b).isin(*LABELS))
    g = both.agg(F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("same"), *[F.count_if(F.col(c) == k).alias(f"{c}_{k}") for c in (a, b) for k in LABELS])
    n = F.col("n").cast("double")
    seen = F.try_divide(F.col("same"), n)
    chance = sum((F.try_divide(F.col(f"{a}_{k}") * F.col(f"{b}_{k}"), n * n) for k in LABELS), F.lit(0.0))
    pairs = sum(((F.col(f"{a}_{k}") + F.col(f"{b}_{k}")) * (F.col(f"{a}_{k}") + F.col(f"{b}_{k}") - 1) for k in LABELS), F.lit(0))
    expected = F.try_divide(pairs.cast("double"), 2 * n * (2 * n - 1))
    return g.select("n", F.round(seen, 6).alias("agreement"), F.round(F.try_divide(seen - chance, 1 - chance), 6).alias("kappa"), F.round(F.try_divide(seen - expected, 1 - expected), 6).alias("alpha"))


def with_version(rows: DataFrame, results: DataFrame, version: str, model: str) -> DataFrame:
    """``rows(id, llm, llm_v1)`` labelled anew by ``results(id, label, rationale)``; items without a result are errors.

    ``llm`` and ``llm_v1`` are structs (label, rationale, model, version).  An old label moves
    to ``llm_v1`` once: not where that is set, nor where it is of this version already.
    """
    res = results.groupBy("id").agg(F.min(F.struct("label", "rationale")).alias("r"))
    old = F.when(F.col("llm").isNotNull() & F.col("llm_v1").isNull() & ~F.col("llm.version").eqNullSafe(version), F.col("llm")).otherwise(F.col("llm_v1"))
    new = F.struct(F.coalesce("r.label", F.lit("error")).alias("label"), F.coalesce("r.rationale", F.lit("missing")).alias("rationale"), F.lit(model).alias("model"), F.lit(version).alias("version"))
    others = [c for c in rows.columns if c not in ("llm", "llm_v1")]
    return rows.join(res, "id", "left").select(*others, new.alias("llm"), old.alias("llm_v1"))


def by_position(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with the name ``i-000000`` of their place in a stable order, by which batch results are matched.

    Places come from counts of key ranges and numbering inside a range, so no task sorts all rows.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    ranged = written(ranged)
    first = ranged.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    begin = first.select("part", "first", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("begin"))  # one row a partition
    place = F.col("at") - F.col("first") + F.col("begin")
    return ranged.join(F.broadcast(begin), "part").withColumn("custom_id", F.concat(F.lit("i-"), F.when(place < 1_000_000, F.lpad(place.cast("string"), 6, "0")).otherwise(place.cast("string")))).drop("part", "at", "first", "begin")


def request(custom_id: Column, content: Column, model: str, max_tokens: int) -> Column:
    """One request of a batch as JSON; sending it is left to the caller."""
    message = F.struct(F.lit("user").alias("role"), content.alias("content"))
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.struct(F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"), F.array(message).alias("messages")).alias("params")))


def debounced(log: DataFrame, pause: str = "500 milliseconds") -> DataFrame:
    """Entries that no other of the same annotator and item follows within a pause."""
    after = F.lead("labelled_at").over(Window.partitionBy("annotator", "id").orderBy("labelled_at", "log_id"))
    return log.withColumn("after", after).where(F.col("after").isNull() | (F.col("after") - F.col("labelled_at") > F.expr(f"interval {pause}"))).select("log_id", "annotator", "id", "label")


def facets(decade: int | None = None, party: str | None = None, word: str | None = None, label: str | None = None, agreement: bool | None = None, text: str | None = None) -> Column:
    """A condition on sentence rows that holds where every facet given holds."""
    c = F.lit(True)
    if decade is not None:
        c &= X.decade_of(F.col("year")) == decade
    for name, value in (("party", party), ("word", word), ("haiku", label)):
        if value is not None:
            c &= F.col(name) == value
    if agreement is not None:
        c &= F.coalesce(F.col("haiku") == F.col("opus"), F.lit(False)) == agreement
    if text is not None:
        c &= F.coalesce(F.lower("sentence").contains(text.lower()), F.lit(False))
    return c


def manifest(records: DataFrame, index_total: int | None = None, stale: tuple[str, ...] = ("from_to",)) -> DataFrame:
    """One row of checks of sentence records ``(year, party, methods MAP)``.

    ``stale_methods`` names the stale keys that are still present; ``index_matches`` is null
    without an index.
    """
    kept = F.map_keys(F.coalesce("methods", F.create_map().cast("map<string,string>")))
    label = F.get_json_object(F.col("methods")["llm"], "$.label")
    got = records.agg(
        F.count("*").alias("total"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.countDistinct("party").alias("parties"),
        F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.array_intersect(kept, F.array(*map(F.lit, stale))))))), ",").alias("stale_methods"),
        F.count_if(F.coalesce(label, F.when(F.col("methods")["llm"].isin(*LABELS), F.col("methods")["llm"])).isin(*LABELS)).alias("llm_labels_present"),
    )
    return got.withColumn("stale_removed", F.col("stale_methods") == "").withColumn("index_matches", F.lit(index_total).cast("long") == F.col("total"))


def confusion(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Counts of (predicted, truth), filled with zeros over all labels."""
    kinds = df.sparkSession.createDataFrame([(k,) for k in (*LABELS, "missing", "error")], "l string").coalesce(1)
    cells = kinds.select(F.col("l").alias("predicted")).crossJoin(kinds.select(F.col("l").alias("truth")))
    got = df.groupBy(normalise(F.col(predicted)).alias("predicted"), normalise(F.col(truth)).alias("truth")).agg(F.count("*").alias("n"))
    return cells.join(got, ["predicted", "truth"], "left").select("predicted", "truth", F.coalesce("n", F.lit(0)).alias("n"))


def current_labels(log: DataFrame) -> DataFrame:
    """The last label of each annotator for each item; later log rows win ties of time."""
    last = F.max_by(F.struct("label", "labelled_at", "notes"), F.struct("labelled_at", "log_id"))
    return log.groupBy("annotator", "id").agg(last.alias("x")).select("annotator", "id", "x.label", "x.labelled_at", "x.notes")


def majority(current: DataFrame) -> DataFrame:
    """The label that most annotators gave an item; ties by spelling."""
    n = current.where(F.col("label").isin(*LABELS)).groupBy("id", "label").agg(F.count("*").alias("votes"))
    return n.groupBy("id").agg(F.max_by("label", F.struct(F.col("votes"), F.col("label"))).alias("label"), F.max("votes").alias("votes"))


def stratified_sample(df: DataFrame, per_bucket: int, seed: str) -> DataFrame:
    """At most ``per_bucket`` rows of each decade and label, in the order of a seeded digest."""
    rows = df.where("year is not null").select("eval_id", "id", "year", X.decade_of(F.col("year")).alias("decade"), normalise(F.col("haiku")).alias("label"))
    h = F.md5(F.concat(F.col("eval_id").cast("string"), F.lit(seed)))
    n = F.row_number().over(Window.partitionBy("decade", "label").orderBy(h, "eval_id"))
    return rows.withColumn("n", n).where(F.col("n") <= per_bucket).drop("n")


def direction(label: Column) -> Column:
    """'agency', 'constraint' or null: which way a label points."""
    return F.when(label == LABELS[0], "agency").when(label == LABELS[1], "constraint")
