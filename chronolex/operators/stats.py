"""Trends, change-points and resampling on short series ``(series, x, y)``."""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def two_sided_p(z: Column, terms: int = 150) -> Column:
    """Two-sided p of a normal z, six decimals; null for null.

    The engine has no error function: it is summed by the series of positive terms
    exp(-x^2) (2x)^(2n+1) n! / (2n+1)!, which is exact to rounding for x up to 6; beyond
    that p is 0.
    """
    x = F.abs(z) / math.sqrt(2)
    step = lambda s, n: F.struct((s["t"] * 2 * x * x / (2 * n + 1)).alias("t"), (s["sum"] + s["t"] * 2 * x * x / (2 * n + 1)).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct(x.alias("t"), x.alias("sum")), step, lambda s: s["sum"])
    p = 1 - total * F.exp(-x * x) * (2 / math.sqrt(math.pi))
    return F.when(x > 6, 0.0).when(z.isNotNull(), F.round(F.greatest(p, F.lit(0.0)), 6))


def trend(points: DataFrame, key: str = "series", least: int = 3) -> DataFrame:
    """Least squares of y on x per century: slope, r2, standard error, z.  No row below ``least`` points.

    ``mean`` is also the intercept where x is centred on its mean.
    """
    s = points.groupBy(key).agg(F.count("*").alias("n"), F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"), F.regr_syy("y", "x").alias("syy"), F.avg("y").alias("mean"))
    slope = F.col("sxy") / F.col("sxx")
    rss = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    se = F.sqrt(F.try_divide(rss, F.col("n") - 2) / F.col("sxx"))
    return s.where((F.col("n") >= least) & (F.col("sxx") > 0)).select(
        key, "n", F.round(slope * 100, 6).alias("slope"), F.round("mean", 6).alias("mean"), F.round(F.when(F.col("syy") == 0, 0.0).otherwise(1 - F.try_divide(rss, F.col("syy"))), 6).alias("r2"),
        F.round(se * 100, 6).alias("std_error"), F.round(F.when(se == 0, 0.0).otherwise(F.try_divide(slope, se)), 4).alias("z"),
    )


def against_controls(trends: DataFrame, key: str, target: str, digits: int = 6) -> DataFrame:
    """The target's slope against the distribution of the others'."""
    c = trends.where(F.col(key) != target).agg(F.avg("slope").alias("m"), F.stddev_pop("slope").alias("s"), F.count("*").alias("controls"))
    t = trends.where(F.col(key) == target).select("slope")
    z = F.try_divide(F.col("slope") - F.col("m"), F.col("s"))
    return t.crossJoin(c).select("slope", F.round("m", digits).alias("control_mean"), F.round("s", digits).alias("control_std"), "controls", F.round(z, 4).alias("z"), (F.abs(z) > 2).alias("beyond_two"), (F.abs(z) > 1).alias("beyond_one"))


def change_point(points: DataFrame, key: str = "series") -> DataFrame:
    """The split into two lines that lowers the BIC most, if any does; needs six points.

    The left part has three points at least, the right one four.
    """
    n = F.count("*").over(Window.partitionBy(key))
    p = points.select(key, "x", "y", F.row_number().over(Window.partitionBy(key).orderBy("x")).alias("i"), n.alias("n")).where("n >= 6")
    rss = lambda c=None: F.greatest(F.coalesce(F.regr_syy("y", "x") - F.try_divide(F.regr_sxy("y", "x") * F.regr_sxy("y", "x"), F.regr_sxx("y", "x")), F.lit(0.0)), F.lit(0.0))
    one = p.groupBy(key).agg(rss().alias("r"), F.max("n").alias("n")).select(key, "n", (F.col("n") * F.ln(F.col("r") / F.col("n") + 1e-10) + 2 * F.ln("n")).alias("bic1"))
    splits = p.select(key, "n", "i", F.col("x").alias("split")).where("i > 3 and i <= n - 3")
    parts = p.alias("p").join(splits.alias("s"), F.col(f"p.{key}") == F.col(f"s.{key}")).select(F.col(f"p.{key}").alias(key), "s.split", "p.n", "p.x", "p.y", (F.col("p.x") < F.col("s.split")).alias("left"))
    two = parts.groupBy(key, "split", "left").agg(rss().alias("r"), F.max("n").alias("n")).groupBy(key, "split").agg(F.sum("r").alias("r"), F.max("n").alias("n"))
    best = two.select(key, "split", (F.col("n") * F.ln(F.col("r") / F.col("n") + 1e-10) + 4 * F.ln("n")).alias("bic2")).groupBy(key).agg(F.min_by("split", F.struct("bic2", "split")).alias("split"), F.min("bic2").alias("bic2"))
    gain = F.round(F.col("bic1") - F.col("bic2"), 6)
    return one.join(best, key, "left").select(key, F.when(gain > 0, F.col("split")).alias("change_at"), F.when(gain > 0, gain).otherwise(0.0).alias("bic_gain"))


def permutation_trend(points: DataFrame, key: str = "series", rounds: int = 1000, seed: int = 42) -> DataFrame:
    """Share of random orders whose slope is as steep as the observed one; needs five points.

    Orders are drawn by a seeded hash, so the result does not depend on partitions.
    """
    p = points.select(key, "x", "y")
    times = p.sparkSession.range(rounds).select(F.col("id").alias("turn"))
    shuffled = p.crossJoin(times).select(key, "turn", "x", "y", F.md5(F.concat_ws("-", F.col(key).cast("string"), F.col("turn").cast("string"), F.col("x").cast("string"), F.lit(str(seed)))).alias("h"))
    w = Window.partitionBy(key, "turn")
    a = shuffled.select(key, "turn", "x", F.row_number().over(w.orderBy("x")).alias("i"))
    b = shuffled.select(key, "turn", "y", F.row_number().over(w.orderBy("h", "x")).alias("i"))
    slopes = a.join(b, [key, "turn", "i"]).groupBy(key, "turn").agg(F.regr_slope("y", "x").alias("s"))
    seen = p.groupBy(key).agg(F.regr_slope("y", "x").alias("o"), F.count("*").alias("n")).where("n >= 5")
    # slopes are compared as rounded, so that an order equal to the observed one counts whatever the order of its sums
    steep = F.round(F.abs("s"), 9) >= F.round(F.abs("o"), 9)
    return slopes.join(seen, key).groupBy(key).agg(F.max("o").alias("slope"), F.avg(steep.cast("double")).alias("p"))


def bootstrap_mean(values: DataFrame, key: str = "series", value: str = "y", rounds: int = 1000, seed: int = 42) -> DataFrame:
    """Mean of a group with its 95 % bootstrap interval and deviation; needs two values."""
    v = values.select(key, value, (F.row_number().over(Window.partitionBy(key).orderBy(value)) - 1).alias("i"))
    sizes = v.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).where("n >= 2")
    draws = sizes.crossJoin(values.sparkSession.range(rounds).select(F.col("id").alias("turn"))).select(key, "n", "mean", "turn", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("d"))
    picked = draws.withColumn("i", F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.col("turn").cast("string"), F.col("d").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long"), F.col("n")))
    means = picked.join(v, [key, "i"]).groupBy(key, "turn").agg(F.avg(value).alias("m"), F.max("mean").alias("mean"))
    return means.groupBy(key).agg(F.max("mean").alias("mean"), F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.stddev_pop("m").alias("std")).select(key, "mean", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"), "std")


def perturbed_similarity(pairs: DataFrame, rounds: int = 1000, seed: int = 42, least: int = 5) -> DataFrame:
    """Similarity of vector pairs under noise: point, 95 % interval and deviation of each.

    Rows are (series, a, b, spread_a, spread_b, near_a, near_b): each vector is moved by a
    tenth of the spread of its own neighbours' distances.  With fewer than ``least``
    neighbours on either side there is no interval.  Random streams are seeded by series,
    so partitions do not matter.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                a, b = np.asarray(r.a, float), np.asarray(r.b, float)
                norms = np.linalg.norm(a) * np.linalg.norm(b)
                point = float(a @ b / norms) if norms else 0.0
                if min(r.near_a, r.near_b) < least:
                    out.append((str(r.series), point, None, None, None))
                    continue
                g = np.random.default_rng([seed, crc32(str(r.series).encode())])
                x, y = (v + g.normal(0, 0.1 * s, (rounds, len(v))) for v, s in ((a, r.spread_a), (b, r.spread_b)))
                n = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
                s = np.divide((x * y).sum(1), n, out=np.zeros(rounds), where=n > 0)
                out.append((str(r.series), point, *map(float, np.percentile(s, [2.5, 97.5])), float(s.std())))
            yield pd.DataFrame(out, columns=["series", "point", "lower", "upper", "std"])

    return pairs.mapInPandas(run, "series string, point double, lower double, upper double, std double")


def intervals_apart(a: DataFrame, b: DataFrame, key: str = "series") -> DataFrame:
    """Whether the intervals (lower, upper) of two frames are apart; touching ones are."""
    x, y = a.alias("a"), b.alias("b")
    overlap = (F.col("a.lower") < F.col("b.upper")) & (F.col("b.lower") < F.col("a.upper"))
    return x.join(y, key).select(key, (~overlap).alias("significant"))


def same_direction(first: DataFrame, second: DataFrame, key: str = "series") -> DataFrame:
    """Slopes of the same series in two collections, whether their signs agree, and their ratio."""
    a, b = first.select(key, F.col("slope").alias("first_slope")), second.select(key, F.col("slope").alias("second_slope"))
    ratio = F.round(F.abs(F.try_divide(F.col("first_slope"), F.col("second_slope"))), 4)
    return a.join(b, key).select(key, "first_slope", "second_slope", ((F.col("first_slope") > 0) == (F.col("second_slope") > 0)).alias("same_direction"), ratio.alias("ratio"))


def seed_sensitivity(projections: DataFrame) -> DataFrame:
    """Slopes over all ways to drop one seed from each pole: rows (trial, x, y) to mean, spread and signs."""
    s = projections.groupBy("trial").agg((F.regr_slope("y", "x") * 100).alias("s"))
    return s.agg(F.count("*").alias("trials"), F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), F.avg((F.col("s") > 0).cast("double")).alias("positive"), F.percentile("s", 0.025).alias("lower"), F.percentile("s", 0.975).alias("upper"))


def procrustes(source: DataFrame, target: DataFrame, dim: int) -> DataFrame:
    """``source(word, vec)`` rotated onto ``target(word, vec)`` by the words they share.

    The cross product of the two spaces is summed on the executors; the driver holds only
    a dim x dim matrix.  No centring, no scaling.
    """
    both = source.join(target.withColumnRenamed("vec", "other"), "word").select("vec", "other")

    def cross(batches):
        total = np.zeros((dim, dim))
        for pdf in batches:
            if len(pdf):
                total += np.stack(pdf["vec"]).astype(float).T @ np.stack(pdf["other"]).astype(float)
        yield pd.DataFrame({"m": [total.ravel().tolist()]})

    parts = both.mapInPandas(cross, "m array<double>").select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    u, _, vt = np.linalg.svd(np.array([r.x for r in parts]).reshape(dim, dim)) if parts else (np.eye(dim), None, np.eye(dim))
    turn = u @ vt

    def apply(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(vec=list(np.stack(pdf["vec"]).astype(float) @ turn))

    return source.select("word", "vec").mapInPandas(apply, "word string, vec array<double>")


def procrustes_by_period(vectors: DataFrame, dim: int) -> DataFrame:
    """``vectors(period, word, vec)`` with every period rotated onto the first by the words they share.

    The driver holds a dim x dim matrix a period; a period that shares no word stays as it is.
    """
    first = vectors.agg(F.min("period").alias("begin"))
    target = vectors.join(F.broadcast(first), F.col("period") == F.col("begin")).select("word", F.col("vec").alias("other"))
    both = vectors.join(target, "word").select("period", "vec", "other")

    def cross(batches):
        for pdf in batches:
            for period, g in pdf.groupby("period"):
                yield pd.DataFrame({"period": [period], "m": [(np.stack(g["vec"]).astype(float).T @ np.stack(g["other"]).astype(float)).ravel().tolist()]})

    parts = both.mapInPandas(cross, "period int, m array<double>").select("period", F.posexplode("m").alias("i", "x")).groupBy("period", "i").agg(F.sum("x").alias("x"))
    sums: dict = {}
    for r in parts.collect():
        sums.setdefault(r.period, np.zeros(dim * dim))[r.i] = r.x
    turns = {}
    for period, m in sums.items():
        u, _, vt = np.linalg.svd(m.reshape(dim, dim))
        turns[period] = u @ vt

    def apply(batches):
        for pdf in batches:
            for period, g in pdf.groupby("period"):
                yield g.assign(vec=list(np.stack(g["vec"]).astype(float) @ turns.get(period, np.eye(dim))))

    return vectors.select("period", "word", "vec").mapInPandas(apply, "period int, word string, vec array<double>")
