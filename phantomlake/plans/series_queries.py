"""Queries over whole series: from image rows to controls, and their analysis anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from phantomlake.operators import devices, rois, series
from phantomlake.plans.image_queries import N, rounded
from phantomlake.plans.registry import query
from phantomlake.sources.views import image_rows, view

C = F.col


def slices_of(spark, d):
    """Twelve neighbouring suppliers are the slices of one series."""
    rows = view(spark, d, "phantoms")
    return rows.select(F.floor(C("slice_id") / 12).alias("series_id"), (C("slice_id") % 12).cast("int").alias("slice_idx"), "slice_id", "px", C("diameter_px").alias("reconstruction_diameter"))


def images_of(spark, d):
    """The source of image rows: it makes those of the slices it is asked for."""
    return lambda slices: image_rows(spark, d, slices)


def scanners_of(spark):
    """Scanner 0 has a geometry frozen for these images, scanner 1 one for another matrix, scanner 3 one that was stored
    without a pixel size; the others have none."""
    rows = spark.range(4).filter("id <> 2").select(F.concat(F.lit("dev-"), C("id")).alias("device_id"), C("id"))
    sizes = {"central_radius": 12, "peripheral_radius": 7, "peripheral_distance": 18, "nps_roi_size": 24, "nps_cardinal_distance": 14, "nps_diagonal_offset": 11}
    size = F.when(C("id") == 1, 512).otherwise(N).cast("int")
    head = {"pixel_size_mm": F.when(C("id") == 3, 0.0).otherwise(1.004), "rows": size, "columns": size, "phantom_diameter_px": F.lit(70.0)}
    geometry = F.struct(*(v.alias(k) for k, v in (head | {k: F.lit(v) for k, v in sizes.items()} | {"frozen_date": F.lit("2025-01-15")}).items()))
    return rows.select("device_id", geometry.alias("geometry"))


def frozen_of(spark, d):
    return devices.frozen_of(headers_of(spark, d), scanners_of(spark))


def spectra_of(spark, d):
    return series.nps_of_series(images_of(spark, d), slices_of(spark, d), N, N, frozen=frozen_of(spark, d))


def as_text(rows):
    """The geometry as JSON text, for results in columns of plain types."""
    return rows.withColumn("geometry", F.to_json("geometry"))


@query("frozen_rois", f"""select slice_id, cast(i as int) as roi_idx, cast(center_col + case i when 0 then -o when 1 then o when 2 then -o when 3 then o when 6 then -c when 7 then c else 0 end as int) as x,
  cast(center_row + case i when 0 then -o when 1 then o when 2 then o when 3 then -o when 4 then -c when 5 then c else 0 end as int) as y, cast(side as int) as side, dev = 0 as frozen, dev in (1, 3) as mismatch
  from (select *, case when dev = 0 then 11 else cast(floor(diameter_px / 2 * 0.367) as int) end as o, case when dev = 0 then 14 else cast(floor(diameter_px / 2 * 0.455) as int) end as c, case when dev = 0 then 24 else least(greatest(cast(round_even(diameter_px * 0.15 / 8, 0) as int) * 8, 32), 128) end as side
    from (select *, slice_id // 12 % 5 as dev from {{phantoms}})), range(8) t(i)""")
def frozen_rois(spark, d):
    """Squares around known centres by the geometry in force: that of scanner 0 where the detected diameter says otherwise."""
    images = view(spark, d, "phantoms").withColumns({"series_id": F.floor(C("slice_id") / 12), "n_rows": F.lit(N), "n_cols": F.lit(N)})
    own = rois.geometry_struct(C("diameter_px"), C("px"), C("n_rows"), C("n_cols"))
    placed = rois.nps_rois(devices.geometry_in_force(images, own, frozen_of(spark, d)), rois.sizes_of("geometry"))
    return placed.select("slice_id", "roi_idx", "x", "y", "side", (C("geometry.frozen_date") != "").alias("frozen"), "mismatch")


@query("nps_ranges", """select series_id, n as n_slices, case when n >= 10 then (n - 10) // 2 end as first, case when n >= 10 then (n - 10) // 2 + 9 end as last, case when n < 10 then 'l''analyse du SPB demande au moins 10 coupes, la série n''en contient que ' || n end as error
  from (select cast(slice_id // 12 as bigint) as series_id, cast(count(*) as int) as n from {phantoms} group by 1)""")
def nps_ranges(spark, d):
    return series.nps_ranges(slices_of(spark, d))


@query("nps_series")
def nps_series(spark, d):
    """The whole analysis of every series from its image rows, by the geometry in force."""
    rows = as_text(spectra_of(spark, d).series).withColumn("skipped", F.array_join(C("skipped").cast("array<string>"), ","))
    return rounded(rows, "diameter_px", "noise", "mean_freq")


@query("nps_fit")
def nps_fit(spark, d):
    """The rings of every series with their fit of degree 11."""
    return rounded(spectra_of(spark, d).rings, "freq", "power", "fit")


@query("roi_file_spectrum")
def roi_file_spectrum(spark, d):
    """From ROI files to spectra: every series has its own squares, of 24 or 32 pixels, in a file of its own."""
    slices = slices_of(spark, d)
    side = F.when(C("series_id") % 2 == 0, 24).otherwise(32)
    corner = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct((20 + i * 8).alias("X"), (24 + i * 4).alias("Y"), side.alias("side_square")))
    files = slices.select("series_id").distinct().select("series_id", F.to_json(F.struct(F.lit("NPS").alias("type_of_file"), corner.alias("ROI"))).alias("json"))
    found = series.nps_of_series(images_of(spark, d), slices, N, N, frozen=frozen_of(spark, d), positions=rois.read_nps_rois(files, "json"))
    rows = as_text(found.series).withColumn("skipped", F.array_join(C("skipped").cast("array<string>"), ","))
    return rounded(rows, "diameter_px", "noise", "mean_freq")


def headers_of(spark, d):
    """Every third series has no date in its images, every sixth none typed by hand either."""
    k = C("series_id")
    rows = slices_of(spark, d).select("series_id").distinct()
    return rows.select(
        "series_id", F.concat(F.lit("dev-"), k % 5).alias("device_id"), F.concat(F.lit("1.2."), k).alias("series_uid"), F.when(k % 3 > 0, F.lit("20260315")).otherwise("").alias("acquisition_date"), F.when(k % 6 == 0, F.lit("2026-03-20")).alias("manual_date"),
        (100 + k % 3 * 20).cast("double").alias("kvp"), F.lit(200.0).alias("mas"), F.lit(5.0).alias("slice_thickness"), F.lit("B30f").alias("kernel"), F.when(k % 2 == 0, F.lit("annuel")).alias("control_type"), (k % 4 == 1).alias("artifacts_present"),
        F.lit("anneau").alias("artifacts_description"), F.concat(F.lit("/archive/"), k).alias("folder"), F.concat(F.lit("../archive/"), k).alias("folder_rel"), F.lit("1.0").alias("software_version"), F.lit("2026-04-01T08:00:00").alias("recorded_at"),
    )


def references_of(spark):
    return spark.range(4).select(F.concat(F.lit("dev-"), C("id")).alias("device_id"), (11 + C("id") * 2).cast("double").alias("noise"), F.when(C("id") != 2, 0.2).alias("nps_freq"))


@query("measured_controls")
def measured_controls(spark, d):
    """Controls as they are recorded: measurements by the geometry in force, joined with scanner, references and date."""
    hu = series.hu_of_series(images_of(spark, d), slices_of(spark, d), frozen_of(spark, d), N, N)
    rows = series.controls(hu, spectra_of(spark, d).series, headers_of(spark, d), references_of(spark))
    return rounded(as_text(rows), "water_ct", "uniformity", "noise", "nps_freq")


def recorded_of(spark, d):
    """Controls of every series: one as it was, one with slices beyond its end, one of a series that is gone, and one whose
    images were moved."""
    runs = slices_of(spark, d).select("series_id").distinct().withColumn("k", F.explode(F.array(*map(F.lit, range(4)))))
    gone = F.when(C("k") == 2, C("series_id") + 1_000_000).otherwise(C("series_id")).alias("series_id")
    return runs.select(
        (C("series_id") * 4 + C("k")).alias("run_id"), F.concat(F.lit("dev-"), C("series_id") % 5).alias("device_id"), gone, F.when(C("k") == 0, 3).otherwise(40).alias("hu_slice"), F.lit(1).alias("nps_start"), F.when(C("k") == 0, 6).otherwise(30).alias("nps_end"),
        (C("k") == 1).alias("artifacts_present"), F.concat(F.when(C("k") == 3, "/old/").otherwise("/archive/"), C("series_id")).alias("folder"), F.lit("2026-03-15").alias("run_date"), F.lit("annuel").alias("control_type"), F.lit("A").alias("performed_by"), F.lit("B").alias("validated_by"),
    )


@query("reanalyse")
def reanalyse(spark, d):
    """Recorded controls measured again, on their own slices of the folder that holds them and by the geometry in force, and
    judged by the references in force."""
    slices = slices_of(spark, d).withColumn("folder", F.concat(F.lit("/archive/"), C("series_id")))
    moved = spark.createDataFrame([("/old", "/elsewhere", 1), ("/old", "/archive", 2)], "old string, new string, seq long")
    rows = series.reanalysed(recorded_of(spark, d), slices, images_of(spark, d), references_of(spark), N, N, scanners_of(spark), moved)
    return rounded(as_text(rows), "water_ct", "uniformity", "noise", "nps_freq")
