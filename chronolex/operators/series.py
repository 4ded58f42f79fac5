"""Yearly series ``(series, year, value)``: averages, changes, growth, peaks, alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def yearly(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("series"), F.year(at).alias("year")).agg(F.round(F.avg(value), 2).alias("value"))


def year_over_year(s: DataFrame) -> DataFrame:
    """Change in percent against the last available year before, where that is above 0."""
    before = F.lag("value").over(Window.partitionBy("series").orderBy("year"))
    return s.withColumn("before", before).select("series", "year", "value", F.round(F.when(F.col("before") > 0, (F.col("value") - F.col("before")) / F.col("before") * 100), 4).alias("change_pct"))


def top_changes(yoy: DataFrame, k: int) -> DataFrame:
    """The k largest changes over all series by size."""
    return yoy.where("change_pct is not null").orderBy(F.desc(F.abs("change_pct")), "series", "year").limit(k)


def by_span(s: DataFrame, years: int, start: int = 0) -> DataFrame:
    """Means by half-open spans of years."""
    begin = (F.floor((F.col("year") - start) / years) * years + start).cast("int")
    return s.groupBy("series", begin.alias("span")).agg(F.round(F.avg("value"), 4).alias("mean"), F.count("*").alias("years"))


def summary(s: DataFrame, at: str = "at") -> DataFrame:
    """Mean, greatest value with its first date, and least value of each series."""
    return s.groupBy("series").agg(F.round(F.avg("value"), 2).alias("mean"), F.max("value").alias("most"), F.min_by(F.col(at), F.struct(-F.col("value"), F.col(at))).alias("peak_at"), F.min("value").alias("least"))


def growth(s: DataFrame, ends: int = 5, least: int = 10) -> DataFrame:
    """Mean of the last years over that of the first, and peak year (the first of equals).

    Series shorter than ``least`` years have no row; from a mean of 0 growth is infinite.
    """
    w = Window.partitionBy("series")
    r = s.withColumn("i", F.row_number().over(w.orderBy("year"))).withColumn("j", F.row_number().over(w.orderBy(F.desc("year"))))
    early, late = F.avg(F.when(F.col("i") <= ends, F.col("value"))), F.avg(F.when(F.col("j") <= ends, F.col("value")))
    g = r.groupBy("series").agg(F.count("*").alias("n"), early.alias("a"), late.alias("b"), F.max_by("year", F.struct(F.col("value"), -F.col("year"))).alias("peak_year"), F.max("value").alias("peak"))
    return g.where(F.col("n") >= least).select("series", F.when(F.col("a") == 0, float("inf")).otherwise(F.round(F.try_divide(F.col("b"), F.col("a")), 6)).alias("growth"), "peak_year", "peak")


def growth_rank(grown: DataFrame) -> DataFrame:
    """Series from the most grown to the least; ties by name."""
    return grown.select("series", "growth", F.row_number().over(Window.orderBy(F.desc("growth"), "series")).alias("place"))


def since(s: DataFrame, reference: int) -> DataFrame:
    """The latest value against that of a reference year, as percent and as multiple."""
    g = s.groupBy("series").agg(F.max(F.when(F.col("year") == reference, F.col("value"))).alias("ref"), F.max_by("value", "year").alias("last"))
    return g.where("ref > 0").select("series", F.round((F.col("last") - F.col("ref")) / F.col("ref") * 100, 4).alias("pct"), F.round(F.col("last") / F.col("ref"), 6).alias("multiple"))


def last_three(s: DataFrame, flat: float = 0.005) -> DataFrame:
    """Whether the last steps of a series go on, turn or level off."""
    w = Window.partitionBy("series").orderBy("year")
    r = s.select("series", "year", (F.col("value") - F.lag("value").over(w)).alias("d2"), (F.lag("value").over(w) - F.lag("value", 2).over(w)).alias("d1"), F.row_number().over(Window.partitionBy("series").orderBy(F.desc("year"))).alias("j"))
    verdict = F.when(F.abs("d2") < flat, "PLATEAU").when(F.col("d1") * F.col("d2") > 0, "CONTINUING").when(F.col("d1") * F.col("d2") < 0, "REVERSING").otherwise("UNCLEAR")
    return r.where("j = 1 and d1 is not null").select("series", verdict.alias("verdict"))


def aligned(s: DataFrame, names: list[str]) -> DataFrame:
    """One row a year with a column for each series, null where it has no value."""
    return s.where(F.col("series").isin(names)).groupBy("year").pivot("series", names).agg(F.max("value"))
