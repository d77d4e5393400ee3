"""Scanners: recognition, references in force, frozen ROI geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phantomlake.operators.lineage import meet


def recognised(slices: DataFrame, devices: DataFrame) -> DataFrame:
    """Slices with their scanner, by device_id; an empty id never matches, unknown scanners keep null."""
    known = devices.filter(F.col("device_id") != "")
    return slices.join(known, "device_id", "left")


def unknown_scanners(slices: DataFrame, devices: DataFrame) -> DataFrame:
    """Slices whose scanner is not in the list, those without identity among them."""
    return slices.join(devices.filter(F.col("device_id") != "").select("device_id"), "device_id", "left_anti")


def geometry_fits(rows: Column, columns: Column, px: Column, g_rows: Column, g_columns: Column, g_px: Column) -> Column:
    """Whether a frozen geometry holds for an image: same matrix, pixel size less than 0.5 % away; never one without a
    positive pixel size of its own."""
    near = F.when(g_px > 0, F.abs(px - g_px) / g_px < 0.005)
    return F.coalesce((rows == g_rows) & (columns == g_columns) & near, F.lit(False))


def geometry_in_force(images: DataFrame, own: Column, frozen: DataFrame | None, key: str = "series_id") -> DataFrame:
    """Adds `geometry`, what the regions of an image are laid by, and `mismatch`.

    `images` has the key, n_rows, n_cols and px; `frozen` (key, geometry) the geometry frozen for the image's scanner, if it
    has one. Where that holds for the image's format it is used as it is, so that sizes and offsets stay those of the first
    control whatever diameter was detected; else the image's `own` one, and `mismatch` tells that there was a frozen one.
    """
    if frozen is None:
        return images.withColumns({"geometry": own, "mismatch": F.lit(False)})
    rows = meet(images, frozen.select(key, F.col("geometry").alias("_g")), key, "left")
    fits = geometry_fits(F.col("n_rows"), F.col("n_cols"), F.col("px"), F.col("_g.rows"), F.col("_g.columns"), F.col("_g.pixel_size_mm"))
    return rows.withColumns({"geometry": F.when(fits, F.col("_g")).otherwise(own), "mismatch": F.col("_g").isNotNull() & ~fits}).drop("_g")


def frozen_of(headers: DataFrame, scanners: DataFrame, key: str = "series_id") -> DataFrame:
    """key, geometry: the frozen geometry of each series' scanner, for those that have one."""
    known = scanners.filter("geometry is not null and device_id <> ''").select("device_id", "geometry")
    return headers.select(key, "device_id").join(known, "device_id").select(key, "geometry")


def freeze_geometry(runs: DataFrame) -> DataFrame:
    """Per device the geometry of its first control with a detected phantom, and the day it was frozen."""
    order = F.struct("run_date", "recorded_at", "event_id")
    first = runs.filter("hu_detected").groupBy("device_id").agg(F.min_by(F.struct("geometry", "run_date", "recorded_at"), order).alias("f"))
    return first.select("device_id", F.col("f.geometry").alias("geometry"), F.coalesce("f.run_date", F.to_date("f.recorded_at")).alias("frozen_date"))


def with_references(runs: DataFrame, references: DataFrame) -> DataFrame:
    """Runs with the references of their device as columns of their own, so that later changes never reach them."""
    refs = references.select("device_id", F.col("noise").alias("ref_noise"), F.col("nps_freq").alias("ref_nps_freq"))
    return runs.drop("ref_noise", "ref_nps_freq").join(refs, "device_id", "left")


def set_references(devices: DataFrame, chosen: DataFrame) -> DataFrame:
    """Before and after: noise always comes from the chosen control, the frequency only where it was measured, and the
    geometry of its regions is frozen with them where it has one."""
    new = chosen.select("device_id", F.col("noise").alias("new_noise"), F.col("nps_freq").alias("new_nps"), F.col("geometry").alias("new_geometry"))
    rows = devices.join(new, "device_id")
    return rows.select(
        "device_id", F.col("ref_noise").alias("noise_before"), F.col("new_noise").alias("noise_after"), F.col("ref_nps_freq").alias("nps_before"), F.coalesce("new_nps", "ref_nps_freq").alias("nps_after"),
        F.col("geometry").alias("geometry_before"), F.coalesce("new_geometry", "geometry").alias("geometry_after"),
    )
