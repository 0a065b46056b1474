"""Ranking and describing scores (t, time, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions.calendar import doy365, rarity_label


def top_n(scores: DataFrame, n: int = 100) -> DataFrame:
    return scores.orderBy(F.desc("score"), "t").limit(n)


def top_by_time(scores: DataFrame, n: int) -> DataFrame:
    """The first n in time."""
    return scores.orderBy("time").limit(n)


def with_time(scores: DataFrame, steps: DataFrame) -> DataFrame:
    return scores.join(steps.select("t", "time"), "t")


def _group_stats(scores: DataFrame, key: Column) -> DataFrame:
    return scores.join(scores.groupBy(key.alias("g")).agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std")), key == F.col("g"))


def relative(scores: DataFrame, by: str = "month", n: int = 100) -> DataFrame:
    """The n highest |score - mean| / std within each calendar month, or day of year; at most 366 groups, combined map-side."""
    key = F.month("time") if by == "month" else F.dayofyear("time")
    rows = _group_stats(scores, key).withColumn("relative_score", F.abs((F.col("score") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0))))
    return rows.orderBy(F.desc_nulls_last("relative_score"), "t").limit(n).select("t", "time", "score", F.col("g").cast("int").alias(by), "mean", "std", "relative_score")


def zscore_monthly(scores: DataFrame) -> DataFrame:
    """Signed z-score within the month; 0 where the month has no spread."""
    rows = _group_stats(scores, F.month("time"))
    return rows.select("t", "time", "score", F.coalesce((F.col("score") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0)), F.lit(0.0)).alias("z"))


def minmax(scores: DataFrame) -> DataFrame:
    ends = scores.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    return scores.join(F.broadcast(ends)).withColumn("norm", (F.col("score") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-12))).drop("_lo", "_hi")  # one row


def summary(scores: DataFrame) -> DataFrame:
    """n, mean and quartiles, with linear interpolation."""
    p = F.percentile("score", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.95)]))
    return scores.agg(F.count("*").alias("n"), F.avg("score").alias("mean"), p.alias("p")).select("n", "mean", *[F.col("p")[i].alias(f"p{x}") for i, x in enumerate((25, 50, 75, 95))])


def histogram(scores: DataFrame, bins: int = 100) -> DataFrame:
    """(bin, n) of equal widths from 0; the highest score is in the last bin."""
    ends = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    at = F.floor((F.col("score") - F.col("lo")) / F.greatest((F.col("hi") - F.col("lo")) / bins, F.lit(1e-300)))
    return scores.join(F.broadcast(ends)).groupBy(F.least(at, F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))  # one row


def ecdf(scores: DataFrame, rare: float = 0.90, extreme: float = 0.99) -> DataFrame:
    """(.., percentile, label): the share of scores not over each.

    Counts of distinct scores are summed by buckets of the range, then within
    them, so no task orders all scores.
    """
    counts = scores.groupBy("score").agg(F.count("*").alias("c"))
    ends = counts.agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.sum("c").alias("total"))
    bucket = F.least(F.floor(1024 * (F.col("score") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300))), F.lit(1023))
    placed = counts.join(F.broadcast(ends)).withColumn("bucket", bucket)  # one row
    below = placed.groupBy("bucket").agg(F.sum("c").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("bucket", "before")  # 1024 rows at most
    up_to = F.sum("c").over(Window.partitionBy("bucket").orderBy("score")) + F.col("before")
    shares = placed.join(F.broadcast(below), "bucket").select("score", (up_to / F.col("total")).alias("percentile"))
    return scores.join(shares, "score").withColumn("label", rarity_label(F.col("percentile"), rare, extreme))


def event_anomaly(field: DataFrame, t: int, clim: DataFrame) -> DataFrame:
    """(cell, anomaly) of one step against a climatology (doy, cell, mean)."""
    return field.where(F.col("t") == t).withColumn("doy", doy365("time")).join(clim, ["doy", "cell"]).select("cell", (F.col("value") - F.col("mean")).alias("anomaly"))


def storm_rank(scores: DataFrame, storms: DataFrame, length: int = 5) -> DataFrame:
    """Of each storm start (t): the most score of its ``length`` starts, the percentage of all scores below, and its rank."""
    peak = storms.select("t", F.explode(F.sequence(F.col("t"), F.col("t") + length - 1)).alias("u")).join(scores.select(F.col("t").alias("u"), "score"), "u").groupBy("t").agg(F.max("score").alias("storm_score"))
    levels = scores.groupBy("score").agg(F.count("*").alias("c"))
    return _compare(peak, levels)


def _compare(peak: DataFrame, levels: DataFrame) -> DataFrame:
    """How many scores are below and above each peak: one ordered union over peaks and levels, by 1024 buckets of the range."""
    ends = levels.agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.sum("c").alias("total"))
    rows = levels.select(F.lit(None).cast("long").alias("t"), "score", "c").unionByName(peak.select("t", F.col("storm_score").alias("score"), F.lit(0).cast("long").alias("c")))
    bucket = F.least(F.floor(1024 * (F.col("score") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300))), F.lit(1023))
    placed = rows.join(F.broadcast(ends)).withColumn("bucket", bucket)  # one row
    before = placed.groupBy("bucket").agg(F.sum("c").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("bucket", "before")  # 1024 rows at most
    by = Window.partitionBy("bucket").orderBy("score")
    up_to = F.sum("c").over(by.rangeBetween(Window.unboundedPreceding, 0))
    same = F.sum("c").over(Window.partitionBy("bucket", "score"))
    told = placed.join(F.broadcast(before), "bucket").withColumn("up_to", up_to + F.col("before")).withColumn("same", same).where("t is not null")
    return told.select("t", F.col("score").alias("storm_score"), (100 * (F.col("up_to") - F.col("same")) / F.col("total")).alias("percentile"), (1 + F.col("total") - F.col("up_to")).alias("rank"))


def storm_summary(ranked: DataFrame) -> DataFrame:
    return ranked.agg(F.median("percentile").alias("median"), F.avg("percentile").alias("mean"))


def month_histogram(rows: DataFrame) -> DataFrame:
    """(month, n) for all twelve months."""
    months = rows.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return months.join(rows.groupBy(F.month("time").alias("month")).agg(F.count("*").alias("n")), "month", "left").select("month", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def year_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.year("time").alias("year")).agg(F.count("*").alias("n"))


def bench_means(lines: DataFrame) -> DataFrame:
    """Mean value by name and device, read out of labels such as ``name[device]``."""
    part = lambda k: F.regexp_extract("label", r"^(\w+)\[(\w+)\]$", k)
    return lines.groupBy(part(1).alias("name"), part(2).alias("device")).agg(F.avg("value").alias("mean"))
