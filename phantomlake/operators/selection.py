"""Which slices a control uses: central ones, saved ranges, ranges by table position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 10


def central_slices(ordered: DataFrame, n: int = SLICES) -> DataFrame:
    """The n central slices of each series (all of a shorter one), and which is the middle one."""
    w = Window.partitionBy("series_uid")
    rows = ordered.withColumn("n_slices", F.count("*").over(w))
    start = F.greatest(F.floor((F.col("n_slices") - n) / 2), F.lit(0))
    rows = rows.withColumn("middle", F.col("slice_idx") == F.floor(F.col("n_slices") / 2))
    return rows.filter((F.col("slice_idx") >= start) & (F.col("slice_idx") < start + n))


def default_slices(n_slices: Column) -> dict[str, Column]:
    """1-based defaults: ten slices around the middle for the spectrum, the middle one for HU."""
    first = F.greatest(F.lit(1), F.floor((n_slices - SLICES) / 2) + 1)
    return {"nps_first": first.cast("int"), "nps_last": F.least(first + SLICES - 1, n_slices).cast("int"), "hu": F.floor((n_slices + 1) / 2).cast("int")}


def around(current: Column, n_slices: Column) -> dict[str, Column]:
    """1-based range of ten slices around one, cut to the series."""
    return {"first": F.greatest(F.lit(1), current - 4).cast("int"), "last": F.least(n_slices, current + 5).cast("int")}


def slice_range(first: Column, last: Column, n_slices: Column) -> Column:
    """STRUCT<first, last, error>: 0-based bounds cut to the series and put in order; null where none is given and
    the series is long enough for the default."""
    cut = lambda x: F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0)), n_slices - 1))
    error = F.when(n_slices <= 0, "série vide").when((first.isNull() | last.isNull()) & (n_slices < SLICES), "moins de 10 coupes")
    low, high = F.least(cut(first), cut(last)), F.greatest(cut(first), cut(last))
    return F.struct(F.when(error.isNull(), low).cast("int").alias("first"), F.when(error.isNull(), high).cast("int").alias("last"), error.alias("error"))


def saved_slices(saved: Column, saved_length: Column, n_slices: Column) -> Column:
    """A saved 0-based slice where it applies: same series length, or none recorded (then cut to the series)."""
    return F.when(saved.isNotNull() & (saved_length.isNull() | (saved_length == n_slices)), F.least(F.greatest(saved, F.lit(0)), n_slices - 1)).cast("int")


def slices_by_location(ordered: DataFrame, start_mm: Column, end_mm: Column, around_centre: int = 20) -> DataFrame:
    """Per series the first and last slice inside a range in mm (either order); without any, the central ones."""
    low, high = F.least(start_mm, end_mm), F.greatest(start_mm, end_mm)
    inside = F.col("slice_location").between(low, high)
    found = ordered.groupBy("series_uid").agg(F.min(F.when(inside, F.col("slice_idx"))).alias("a"), F.max(F.when(inside, F.col("slice_idx"))).alias("b"), F.count("*").alias("n"))
    middle = F.floor(F.col("n") / 2)
    half = around_centre // 2
    return found.select(
        "series_uid",
        F.coalesce("a", F.greatest(F.lit(0), middle - half)).cast("int").alias("first"),
        F.coalesce("b", F.least(F.col("n") - 1, middle + half - 1)).cast("int").alias("last"),
        F.col("a").isNotNull().alias("found"),
    )
