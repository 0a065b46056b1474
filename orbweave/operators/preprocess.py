"""Cleaning and standardising of long fields (t, time, cell, lat, lon, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions.calendar import doy365, is_leap_day, month_day


def slice_time(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows from day ``start`` to day ``end``, both inclusive."""
    return df.where((F.col("time") >= F.to_timestamp_ntz(F.lit(start + " 00:00:00"))) & (F.col("time") < F.to_timestamp_ntz(F.lit(end + " 00:00:00")) + F.expr("interval 1 day")))


def crop_space(df: DataFrame, lat: tuple[float, float] | None = None, lon: tuple[float, float] | None = None) -> DataFrame:
    """Cells within the bounds, inclusive, in either order; None leaves an axis alone."""
    for name, bounds in (("lat", lat), ("lon", lon)):
        if bounds is not None:
            df = df.where(F.col(name).between(min(bounds), max(bounds)))
    return df


def head_steps(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("t") < n)


def first_level(df: DataFrame, level: str = "level") -> DataFrame:
    """The first level of a field, without its column."""
    if level not in df.columns:
        return df
    least = df.agg(F.min(level).alias("_first"))
    return df.join(F.broadcast(least), F.col(level) == F.col("_first")).drop(level, "_first")  # one row


def dense_steps(df: DataFrame) -> DataFrame:
    """t anew as the 0-based place of each distinct time. The window sees the time axis alone, one row a step."""
    axis = df.select("time").distinct().withColumn("_t", F.row_number().over(Window.orderBy("time")) - 1)
    return df.drop("t").join(axis, "time").withColumn("t", F.col("_t").cast("long")).drop("_t")


def remove_leap_days(df: DataFrame) -> DataFrame:
    """Without 29 February; t is made dense again."""
    return dense_steps(df.where(~is_leap_day("time")))


def _minus_group_mean(df: DataFrame, *keys) -> DataFrame:
    return df.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy(*keys)))


def deseasonalize(df: DataFrame) -> DataFrame:
    """Each cell's mean by day of a 365-day year subtracted. Leap days, if still there, count with 1 March."""
    return _minus_group_mean(df, "cell", doy365("time"))


def climatology(df: DataFrame) -> DataFrame:
    """(doy, cell, mean)."""
    return df.groupBy(doy365("time").alias("doy"), "cell").agg(F.avg("value").alias("mean"))


def remove_daily_climatology(df: DataFrame) -> DataFrame:
    """Each cell's mean by calendar day of year (1 to 366) subtracted."""
    return _minus_group_mean(df, "cell", F.dayofyear("time"))


def anomaly_by_month_day(df: DataFrame) -> DataFrame:
    """Leap days removed, each cell's mean by month and day subtracted."""
    return _minus_group_mean(remove_leap_days(df), "cell", month_day("time"))


def coslat_weight(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.col("value") * F.sqrt(F.cos(F.radians("lat"))))


def standardize(df: DataFrame) -> DataFrame:
    """(value - mean) / max(sample deviation, 1e-12) of each cell."""
    w = Window.partitionBy("cell")
    return df.withColumn("value", (F.col("value") - F.avg("value").over(w)) / F.greatest(F.stddev_samp("value").over(w), F.lit(1e-12)))


def detrend(df: DataFrame) -> DataFrame:
    """Each cell's least-squares line over t subtracted."""
    w = Window.partitionBy("cell")
    t = F.col("t").cast("double")
    return df.withColumn("value", F.col("value") - (F.regr_intercept(F.col("value"), t).over(w) + F.regr_slope(F.col("value"), t).over(w) * t))


def mean_centre(df: DataFrame, by: DataFrame | None = None) -> DataFrame:
    """The scalar mean of ``by`` (else of df) subtracted."""
    mean = (by if by is not None else df).agg(F.avg("value").alias("_mean"))
    return df.join(F.broadcast(mean)).withColumn("value", F.col("value") - F.col("_mean")).drop("_mean")  # one row


def unit_scale(df: DataFrame, factor: float = 1.0, constant: float = 0.0) -> DataFrame:
    return df.withColumn("value", F.col("value") / factor - constant)


def drop_nan_cells(df: DataFrame) -> DataFrame:
    """Without cells that are null or NaN at any time."""
    bad = df.where(F.col("value").isNull() | F.isnan("value")).select("cell").distinct()
    return df.join(bad, "cell", "left_anti")


def column_centre(df: DataFrame) -> DataFrame:
    return _minus_group_mean(df, "cell")


def preprocess(df: DataFrame, leap: bool = True, seasonal: bool = True, coslat: bool = True, standard: bool = False, trend: bool = False) -> DataFrame:
    """The optional steps in their fixed order."""
    for wanted, step in ((leap, remove_leap_days), (trend, detrend), (seasonal, deseasonalize), (coslat, coslat_weight), (standard, standardize)):
        df = step(df) if wanted else df
    return df


def to_vectors(df: DataFrame) -> DataFrame:
    """One row a step: (t, time, x), cells in order of lat, lon."""
    rows = df.groupBy("t", "time").agg(F.array_sort(F.collect_list(F.struct("lat", "lon", "cell", "value"))).alias("c"))
    return rows.select("t", "time", F.transform("c", lambda c: c["value"]).alias("x"))
