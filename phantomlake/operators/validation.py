"""Comparison of measured spectra and values with published ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Published limits in percent.
MAX_FREQUENCY_ERROR, MAX_NOISE_ERROR, MAX_RMS, MAX_PEAK_ERROR = 2.0, 1.0, 3.0, 5.0
MIN_FREQUENCY = 0.05


def parse_results(files: DataFrame, key: str, labels: dict[str, str]) -> DataFrame:
    """One row per file with the named values of its "label :value" lines."""
    lines = files.select(key, F.explode(F.split("text", "\n")).alias("line"))
    pairs = lines.select(key, F.trim(F.regexp_extract("line", r"^([^:]*):", 1)).alias("label"), F.trim(F.regexp_extract("line", r":(.*)$", 1)).try_cast("double").alias("value"))
    return pairs.groupBy(key).agg(*(F.max(F.when(F.col("label") == label, F.col("value"))).alias(name) for label, name in labels.items()))


def spectrum_compare(measured: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Rings of both spectra side by side; same_axis: whether their frequencies agree within 1e-6."""
    other = reference.select(*keys, "ring", F.col("freq").alias("ref_freq"), F.col("power").alias("ref_power"))
    return measured.join(other, [*keys, "ring"]).withColumn("same_axis", F.abs(F.col("freq") - F.col("ref_freq")) <= 1e-6)


def read_spectra(spark: SparkSession, path: str) -> DataFrame:
    """Published spectra from CSV files: frequency, raw and fit."""
    return spark.read.schema("frequency double, raw double, fit double").option("header", True).csv(path)


def parse_spectra(files: DataFrame, key: str) -> DataFrame:
    """key, ring, freq, power, fit of the text of such files: a header, then three columns."""
    lines = files.select(key, F.posexplode(F.filter(F.slice(F.split("text", "\r?\n"), F.lit(2), F.size(F.split("text", "\r?\n"))), lambda x: F.trim(x) != "")).alias("ring", "line"))
    value = lambda k: F.trim(F.get(F.split("line", ","), k)).try_cast("double")
    return lines.select(key, "ring", value(0).alias("freq"), value(1).alias("power"), value(2).alias("fit"))


def metrics(compared: DataFrame, keys: list[str]) -> DataFrame:
    """RMS difference above the lowest frequencies in percent of the reference peak, the error of the peak, and where it is."""
    diff = F.when(F.col("freq") > MIN_FREQUENCY, (F.col("power") - F.col("ref_power")) ** 2)
    return compared.groupBy(*keys).agg(
        (F.sqrt(F.avg(diff)) / F.max("ref_power") * 100).alias("rms_percent"),
        relative_error(F.max("power"), F.max("ref_power")).alias("peak_percent"),
        F.max_by("freq", "power").alias("peak_freq"),
    )


def relative_error(measured: Column, reference: Column) -> Column:
    """The deviation in percent of the reference; of a reference of 0, 0 if it is met and infinite if not."""
    none = F.when(measured != 0, F.lit(float("inf"))).when(measured == 0, 0.0)
    return F.when(reference == 0, none).otherwise(F.abs(measured - reference) / F.abs(reference) * 100)


def value_errors(measured: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Errors in percent of mean frequency and noise, from tables with `mean_freq` and `noise`."""
    other = reference.select(*keys, F.col("mean_freq").alias("_f"), F.col("noise").alias("_n"))
    return measured.join(other, keys).select(*keys, relative_error(F.col("mean_freq"), F.col("_f")).alias("frequency_percent"), relative_error(F.col("noise"), F.col("_n")).alias("noise_percent"))


def passed(frequency_percent: Column, noise_percent: Column) -> Column:
    """Whether the values of a series are within both limits."""
    return (frequency_percent <= MAX_FREQUENCY_ERROR) & (noise_percent <= MAX_NOISE_ERROR)


def spectrum_passed(rms_percent: Column, peak_percent: Column) -> Column:
    """Whether the spectrum of a series is within both limits."""
    return (rms_percent <= MAX_RMS) & (peak_percent <= MAX_PEAK_ERROR)
