"""A sample that meets target proportions by category, with minimum rows (problem 5).

Method: swap repair.  Records are grouped by category signature.  A random start takes
every signature's floor and fills the sample at random; then units are exchanged
between signatures, each exchange lowering the sum of deviations from the targets,
until none does.  Only the counts of signatures are exchanged: they are all the driver
sees, one line per signature.  The chosen counts are materialised at random: a record
is drawn by a seeded hash, and the hash that admits the wanted number is found from a
histogram, so no stratum is sorted or gathered in one task.

Defined results: records without a usable signature are left out; several rows of one
record count once (the least signature, if they differ); strata with fewer usable
records than they want are filled as far as possible and reported.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABELS = ("negative_liberty", "positive_liberty", "ambiguous", "other")
#: Signatures (combinations of categories) that the driver may hold; more is an error.
MOST_SIGNATURES = 1_000_000


def swap_repair(available: np.ndarray, wanted: np.ndarray, floor: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Records to take from each signature: ``size`` in all, as near to ``wanted`` as can be.

    Starts from a random sample that satisfies the floors, then moves as many units as
    useful from the signature most above its target to the one most below.
    """
    size = int(min(size, available.sum()))
    take = np.minimum(floor, available)
    if take.sum() > size:  # the floors alone are more than the sample: they are kept
        size = int(take.sum())
    spare = available - take
    if spare.sum():
        take = take + np.random.default_rng(seed).multivariate_hypergeometric(spare, size - take.sum(), method="marginals")
    least = np.minimum(floor, available)
    while True:
        over = np.minimum(take - wanted, take - least)  # may be given away
        under = np.minimum(wanted - take, available - take)  # may be added
        i, j = int(np.argmax(over)), int(np.argmax(under))
        n = int(min(over[i], under[j]))
        if n <= 0:
            break
        take[i] -= n
        take[j] += n
    return take


class Quota:
    """The strata, their counts and the sample.  ``found`` and ``sample`` are DataFrames."""

    def __init__(self, rows: DataFrame, targets: DataFrame, key: str, categories: list[str], *, share: str = "share_pm", share_of: int = 1000, floor: str = "min_rows", fraction: int = 10, seed: int = 5):
        spark = rows.sparkSession
        self.categories, self.key, self.seed = categories, key, seed
        usable = rows.where(F.expr(" and ".join(f"`{c}` is not null" for c in [key, *categories])))
        self.usable = usable.groupBy(key).agg(F.min(F.struct(*categories)).alias("s")).select(key, "s.*")
        counts = self.usable.groupBy(*categories).agg(F.count("*").alias("n"))
        table = counts.join(targets.select(*categories, share, floor).groupBy(*categories).agg(F.sum(share).alias("p"), F.max(floor).alias("m")), categories, "full_outer").select(*categories, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("m", F.lit(0)).alias("m"), F.col("p").isNotNull().alias("targeted"))
        got = table.orderBy(*categories).limit(MOST_SIGNATURES + 1).collect()
        if len(got) > MOST_SIGNATURES:
            raise ValueError(f"more than {MOST_SIGNATURES} combinations of {categories}")
        n = np.array([r.n for r in got], np.int64)
        size = int(n.sum()) // fraction
        floors = np.array([r.m for r in got], np.int64)
        wanted = np.maximum(floors, np.array([r.p for r in got], np.int64) * size // share_of) * np.array([r.targeted for r in got], np.int64)
        take = swap_repair(n, wanted, floors, size, seed) if len(got) else n
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields[: len(categories)])
        self.report = spark.createDataFrame([(*r[: len(categories)], bool(r.targeted), int(a), int(w), int(t)) for r, a, w, t in zip(got, n, wanted, take)], f"{kinds}, targeted boolean, available long, wanted long, taken long")

    def unfilled(self) -> DataFrame:
        """The targeted strata with fewer usable records than they want."""
        return self.report.where("targeted and available < wanted").select(*self.categories)

    def sample(self) -> DataFrame:
        """``(key, categories...)`` of the drawn records."""
        drawn = F.xxhash64(self.key, F.lit(self.seed))
        rows = self.usable.withColumn("h", drawn).withColumn("bin", F.shiftrightunsigned("h", 52))
        steps = Window.partitionBy(*self.categories).orderBy("bin")
        bins = rows.groupBy(*self.categories, "bin").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(steps))
        rest: Column = F.col("taken") - (F.col("upto") - F.col("c"))
        cut = bins.join(self.report.select(*self.categories, "taken"), self.categories).where(rest > 0).select(*self.categories, "bin", F.least("c", rest).alias("k"), "c")
        kept = rows.join(cut, [*self.categories, "bin"])
        inside = kept.where("k = c").select(self.key, *self.categories)
        # only the bin in which the count is reached needs an order: a 4096th of its stratum
        edge = kept.where("k < c").withColumn("i", F.row_number().over(Window.partitionBy(*self.categories, "bin").orderBy("h", self.key))).where("i <= k").select(self.key, *self.categories)
        return inside.unionByName(edge)


def labelled_quota(rows: DataFrame, targets: DataFrame, **options) -> Quota:
    """The quota by decade and label of labelled sentences."""
    with_decade = rows.where(F.col("haiku").isin(*LABELS)).select("id", (F.floor(F.col("year") / 10) * 10).cast("int").alias("decade"), "haiku")
    return Quota(with_decade, targets, "id", ["decade", "haiku"], **options)


