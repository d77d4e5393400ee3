"""The analysis of whole series: slices, phantom, regions, spectrum and HU results, and the controls recorded from them.

`slices` has series_id, slice_idx (from 0), slice_id and px; optional columns are `first` and `last` (a slice range,
inclusive, cut to the series), `hu_slice`, `reconstruction_diameter`, `center_row` and `center_col` (given centres),
`roi_size` (the side of the spectrum's squares), and `n_rows` and `n_cols` where series differ in their matrix.
Only the slices that a step uses reach it. Slices of a series that cannot be analysed give one row with its reason.

`frozen` (series_id, geometry) holds the geometry that was frozen for a series' scanner: where it fits the image's format
regions are laid by it, and only the centre comes from the image. `positions` (series_id, roi_idx, x, y, side) are squares
given from outside, as ROI files hold them; the size of a series' first one is that of all, and no geometry is told of them.

`image_rows` is a table or a source that makes or decodes rows of the slices it is asked for (pixels.Images).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phantomlake.functions import rules as R
from phantomlake.functions import scalars as S
from phantomlake.operators import archive, devices, nps, phantom, pixels, rois
from phantomlake.operators.lineage import cut, meet
from phantomlake.operators.selection import SLICES

#: Why a series cannot be analysed.
EMPTY_RANGE = "la plage de coupes du SPB ne contient aucune coupe"
TOO_FEW = "l'analyse du SPB demande au moins {n} coupes, la série n'en contient que "
NO_ROI = "aucune ROI du SPB n'est entièrement dans l'image"


#: A geometry of regions as it is stored with a control and frozen for its scanner; the names are those of the file format.
GEOMETRY = "struct<pixel_size_mm: double, rows: int, columns: int, phantom_diameter_px: double, central_radius: int, peripheral_radius: int, peripheral_distance: int, nps_roi_size: int, nps_cardinal_distance: int, nps_diagonal_offset: int, frozen_date: string>"


def column(df: DataFrame, name: str, kind: str = "double") -> Column:
    """The column if the table has it, else null."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def nps_ranges(slices: DataFrame, n: int = SLICES) -> DataFrame:
    """Per series n_slices, first and last slice of the spectrum and an error: the given range cut to the series, else
    the n central slices."""
    rows = slices.groupBy("series_id").agg(F.count("*").cast("int").alias("n_slices"), F.max(column(slices, "first", "int")).alias("a"), F.max(column(slices, "last", "int")).alias("b"))
    given = F.col("a").isNotNull() & F.col("b").isNotNull()
    start = F.floor((F.col("n_slices") - n) / 2).cast("int")
    first, last = F.when(given, F.greatest("a", F.lit(0))).otherwise(start), F.when(given, F.least("b", F.col("n_slices") - 1)).otherwise(start + n - 1)
    error = F.when(given & (first > last), EMPTY_RANGE).when(~given & (F.col("n_slices") < n), F.concat(F.lit(TOO_FEW.format(n=n)), F.col("n_slices").cast("string")))
    return rows.select("series_id", "n_slices", F.when(error.isNull(), first).alias("first"), F.when(error.isNull(), last).alias("last"), error.alias("error"))


def placed_phantoms(image_rows: pixels.Images, chosen: DataFrame, frozen: DataFrame | None = None, n_rows: int | None = None, n_cols: int | None = None) -> DataFrame:
    """series_id, slice_id, px, center_row and center_col (whole pixels), diameter_px, detected, geometry, mismatch of one slice per series."""
    hints = chosen.select("slice_id", "px", *(column(chosen, x).alias(x) for x in ("reconstruction_diameter", "center_row", "center_col"))).dropDuplicates(["slice_id"])
    found = phantom.detect_phantom(pixels.of_slices(image_rows, hints), hints)
    matrix = (F.coalesce(column(chosen, x, "int"), F.lit(n).cast("int")).alias(x) for x, n in (("n_rows", n_rows), ("n_cols", n_cols)))
    keep = chosen.select("series_id", "slice_id", "px", *matrix, *(column(chosen, x).alias(f"given_{x}") for x in ("center_row", "center_col")))
    whole = lambda x: F.bround(F.coalesce(f"given_{x}", x), 0).cast("int").alias(x)
    rows = meet(keep, found, "slice_id").select("series_id", "slice_id", "px", "n_rows", "n_cols", whole("center_row"), whole("center_col"), (2 * F.col("radius")).alias("diameter_px"), (F.col("n_points") > 0).alias("detected"))
    own = rois.geometry_struct(F.col("diameter_px"), F.col("px"), F.col("n_rows"), F.col("n_cols"))
    return devices.geometry_in_force(rows, own, frozen)


def squares_of(phantoms: DataFrame, used: DataFrame, positions: DataFrame | None) -> DataFrame:
    """series_id, roi_idx, x, y, side, given: eight squares around each centre, or those given for the series."""
    sizes = used.groupBy("series_id").agg(F.max(column(used, "roi_size", "int")).alias("_side"))
    laid = meet(rois.nps_rois(phantoms, rois.sizes_of("geometry")), sizes, "series_id").select("series_id", "roi_idx", "x", "y", F.coalesce("_side", "side").alias("side"), F.lit(False).alias("given"))
    if positions is None:
        return laid
    first = positions.groupBy("series_id").agg(F.min_by("side", "roi_idx").alias("side"))
    given = meet(meet(positions.select("series_id", "roi_idx", "x", "y"), first, "series_id"), phantoms.select("series_id"), "series_id", "left_semi")
    kinds = [f.dataType for f in laid.schema]
    given = given.withColumn("given", F.lit(True)).select(*(F.col(c).cast(t).alias(c) for c, t in zip(laid.columns, kinds, strict=True)))
    return meet(laid, first.select("series_id"), "series_id", "left_anti").unionByName(given)


class SeriesSpectra(NamedTuple):
    """What the analysis of the noise power spectrum gives: one row a series, its rings with their fit, its warnings."""

    series: DataFrame
    rings: DataFrame
    warnings: DataFrame


def nps_of_series(image_rows: pixels.Images, slices: DataFrame, n_rows: int | None, n_cols: int | None, n: int = SLICES, frozen: DataFrame | None = None, positions: DataFrame | None = None) -> SeriesSpectra:
    """The whole analysis: slice range, phantom on the middle slice, geometry in force, placement of the eight squares (or
    those given), clipping, noise, detrending, spectrum, rings, mean frequency, fit and warnings."""
    ranges = nps_ranges(slices, n)
    used = meet(slices, ranges.filter("error is null").select("series_id", F.col("first").alias("_a"), F.col("last").alias("_b")), "series_id").filter("slice_idx between _a and _b")
    middle = used.filter(F.col("slice_idx") == F.col("_a") + F.floor((F.col("_b") - F.col("_a") + 1) / 2))
    phantoms = cut(placed_phantoms(image_rows, middle, frozen, n_rows, n_cols))
    squares = meet(squares_of(phantoms, used, positions), phantoms.select("series_id", "n_rows", "n_cols"), "series_id")
    skipped = F.array_sort(F.collect_set(F.when(~rois.inside(F.col("x"), F.col("y"), F.col("side"), F.col("n_rows"), F.col("n_cols")), F.col("roi_idx"))))
    placement = squares.groupBy("series_id").agg(F.max("side").alias("roi_size"), skipped.alias("skipped"), F.bool_or("given").alias("given"))
    # a slice may serve several analyses, so a square is told by series and square
    each = meet(used.select("series_id", "slice_idx", "slice_id"), squares, "series_id").withColumn("of", F.struct("series_id", "slice_idx", "roi_idx"))
    # tiles and rings are read several times, the images once
    tiles = cut(rois.roi_tiles(pixels.of_slices(image_rows, used), each.select("slice_id", F.col("of").alias("roi_idx"), "x", "y", "side", "n_rows", "n_cols"), F.col("n_rows"), F.col("n_cols")).select("roi_idx.*", "z"))
    stats = nps.tile_stats(tiles).drop("z")
    spectrum = meet(nps.mean_spectrum_fft(tiles, 1.0), phantoms.select("series_id", "px"), "series_id").withColumn("power", F.col("power") * F.col("px") ** 2)
    rings = cut(nps.radial_of(spectrum))
    warnings = nps.roi_warnings(stats)
    found = phantoms.select("series_id", "center_row", "center_col", "diameter_px", "detected", "geometry", "mismatch")
    row = ranges
    for part in (found, placement, nps.noise(stats), nps.mean_frequency(rings), warnings.groupBy("series_id").agg(F.count("*").alias("n_warnings"))):
        row = meet(row, part, "series_id", "left")
    error = F.coalesce("error", F.when(F.col("n_tiles").isNull(), F.lit(NO_ROI)))
    given = F.coalesce("given", F.lit(False))
    told = {"geometry": F.when(~given, F.col("geometry")), "mismatch": F.coalesce("mismatch", F.lit(False)) & ~given}
    return SeriesSpectra(row.withColumns({"error": error, "n_tiles": F.coalesce("n_tiles", F.lit(0)), "n_warnings": F.coalesce("n_warnings", F.lit(0))} | told).drop("given"), nps.fitted(rings), warnings)


def hu_of_series(image_rows: pixels.Images, slices: DataFrame, frozen: DataFrame | None = None, n_rows: int | None = None, n_cols: int | None = None) -> DataFrame:
    """Per series the water CT number and uniformity of its HU slice (given as hu_slice and cut to the series, else the
    middle one), with the phantom found there and the geometry of its regions: the frozen one where it fits."""
    w = Window.partitionBy("series_id")
    rows = slices.withColumn("_n", F.count("*").over(w)).withColumn("_hu", F.coalesce(F.max(column(slices, "hu_slice", "int")).over(w), F.floor((F.col("_n") + 1) / 2).cast("int") - 1))
    chosen = rows.filter(F.col("slice_idx") == F.least(F.greatest("_hu", F.lit(0)), F.col("_n") - 1))
    phantoms = cut(placed_phantoms(image_rows, chosen, frozen, n_rows, n_cols))
    circles = rois.hu_rois(phantoms, rois.sizes_of("geometry")).select("series_id", "slice_id", "roi_idx", "name", "cx", "cy", "radius")
    # the same slice may serve several analyses: statistics are keyed by the series
    stats = rois.roi_stats(pixels.of_slices(image_rows, phantoms), circles.withColumn("roi_idx", F.struct("series_id", "roi_idx"))).select("roi_idx.*", "mean_hu", "std_hu").withColumnRenamed("series_id", "slice_id")
    results = rois.water_results(stats).withColumnRenamed("slice_id", "series_id")
    told = chosen.select("series_id", F.col("slice_idx").cast("int").alias("hu_slice"), F.col("_n").cast("int").alias("n_slices"))
    return meet(meet(phantoms.select("series_id", "detected", "geometry", "mismatch"), told, "series_id"), results, "series_id", "left")


#: What a recorded control has besides its measurements, with what stands for an absent value (fixed: the empty text or 0).
GIVEN = {
    "series_uid": "string", "control_type": "string", "performed_by": "string", "validated_by": "string", "kernel": "string", "artifacts_description": "string", "folder": "string", "folder_rel": "string",
    "notes": "string", "software_version": "string", "pdf_path": "string", "corrective_action": "string", "corrective_action_date": "string", "kvp": "double", "mas": "double", "slice_thickness": "double",
}


def controls(hu: DataFrame, spectra: DataFrame, headers: DataFrame, references: DataFrame) -> DataFrame:
    """One control per series with all that is recorded of it: measurements, slices, geometry, the references of its
    scanner frozen in it, and its date: that of the images, else the one typed by hand, never the day of the analysis.

    `headers` has series_id, device_id, acquisition_date and manual_date, and any of GIVEN, `artifacts_present`,
    `recorded_at` (else now) and `event_id` (else series_id); `references` device_id, noise and nps_freq.
    """
    image_date = S.blank_to_null(S.dicom_date_to_iso(F.col("acquisition_date")))
    typed = S.blank_to_null(F.coalesce("manual_date", F.lit("")))
    empty = {"string": F.lit(""), "double": F.lit(0.0)}
    head = headers.withColumns({c: F.coalesce(column(headers, c, t), empty[t]) for c, t in GIVEN.items()})
    absent = F.col("artifacts_present").isNull() | ~F.col("artifacts_present")
    head = head.withColumn("artifacts_present", column(headers, "artifacts_present", "boolean"))
    head = head.withColumns({
        "run_date": F.coalesce(image_date, typed, F.lit("")), "run_date_manual": image_date.isNull() & typed.isNotNull(), "artifacts_description": F.when(absent, "").otherwise(F.col("artifacts_description")),
        "recorded_at": F.coalesce(column(headers, "recorded_at", "string"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")), "event_id": F.coalesce(column(headers, "event_id", "long"), F.col("series_id").cast("long")),
    })
    refs = references.select("device_id", F.col("noise").alias("ref_noise"), F.col("nps_freq").alias("ref_nps_freq"))
    measured = F.col("error").isNull()
    rows = meet(head, hu.withColumnRenamed("detected", "hu_detected"), "series_id")
    rows = meet(rows, spectra.select("series_id", "error", "noise", "mean_freq", "first", "last", F.col("detected").alias("nps_detected")), "series_id", "left").join(refs, "device_id", "left")
    rows = rows.withColumn("run_id", S.run_key(F.col("series_uid"), F.col("run_date"), F.col("series_id"), F.col("device_id")))
    return rows.select(
        *head.columns, "run_id", "water_ct", "uniformity", F.when(measured, F.col("noise")).alias("noise"), F.when(measured, F.col("mean_freq")).alias("nps_freq"), "ref_noise", "ref_nps_freq",
        "hu_slice", "n_slices", F.when(measured, F.col("first")).alias("nps_start"), F.when(measured, F.col("last")).alias("nps_end"), "geometry", "mismatch", "hu_detected", F.coalesce("nps_detected", F.lit(False)).alias("nps_detected"),
    )


#: Why the images of a recorded control are missing.
NO_FOLDER, OTHER_SERIES = "no folder", "other series"


def located(runs: DataFrame, slices: DataFrame, relocations: DataFrame, base: str = "") -> DataFrame:
    """Runs with `folder`, the first candidate folder that holds their series (null without one), `stored_folder` and
    `missing`: whether no candidate is there at all, or those that are hold other series. `slices` has folder and series_id."""
    held = slices.select("folder", F.col("series_id").alias("series_uid")).distinct()
    relocations = F.broadcast(relocations)  # a store keeps a few of them
    wanted = runs.withColumn("series_uid", F.col("series_id"))
    found = archive.resolve_folder(wanted, relocations, held, base).select("run_id", F.col("folder").alias("_found"))
    known = held.select(archive.normalised(F.col("folder")).alias("folder")).distinct()
    there = meet(archive.candidate_folders(wanted, relocations, base), known, "folder", "left_semi").select("run_id").distinct().withColumn("_there", F.lit(True))
    rows = meet(meet(runs.withColumnRenamed("folder", "stored_folder"), found, "run_id", "left"), there, "run_id", "left")
    reason = F.when(F.col("_found").isNull(), F.when(F.col("_there"), OTHER_SERIES).otherwise(NO_FOLDER))
    return rows.withColumns({"folder": F.col("_found"), "missing": reason}).drop("_found", "_there")


def reanalysed(runs: DataFrame, slices: DataFrame, image_rows: pixels.Images, references: DataFrame, n_rows: int | None, n_cols: int | None, frozen: DataFrame | None = None, relocations: DataFrame | None = None, base: str = "") -> DataFrame:
    """Recorded controls measured again on the slices they used, judged by the references in force now.

    `runs` has run_id, device_id, series_id, hu_slice, nps_start, nps_end, artifacts_present; its date (run_date), control_type,
    performed_by and validated_by come through where it has them. `frozen` has device_id and geometry. Where `slices` has a
    folder, each control is measured on the first of its candidate folders (folder, folder_rel, relocations, see `located`)
    that holds its series, and only there. `missing` tells why there are no images; `clamped`: the control used a slice
    that the series no longer has, so its slices were brought into the series.
    """
    if "folder" in slices.columns:
        spark = runs.sparkSession
        moved = spark.createDataFrame([], "old string, new string, seq long") if relocations is None else relocations
        known, place = located(runs, slices, moved, base), ["folder", "series_id"]
    else:
        known, place = runs.withColumn("missing", F.lit(None).cast("string")), ["series_id"]
    known = meet(known, slices.groupBy(*place).agg(F.count("*").cast("int").alias("n")), place, "left")
    last = F.greatest(F.coalesce("hu_slice", F.lit(0)), F.coalesce("nps_end", F.lit(0)))
    known = cut(known.withColumns({"missing": F.when(F.col("n").isNull(), F.coalesce("missing", F.lit(OTHER_SERIES))), "clamped": F.coalesce(last >= F.col("n"), F.lit(False))}))
    into = lambda x: F.least(F.greatest(F.col(x), F.lit(0)), F.col("n") - 1)
    both = F.col("nps_start").isNotNull() & F.col("nps_end").isNotNull()
    there = known.filter("missing is null")
    wanted = there.select("run_id", *place, F.when(F.col("hu_slice").isNotNull(), into("hu_slice")).alias("hu_slice"), *(F.when(both, f(into("nps_start"), into("nps_end"))).alias(x) for x, f in (("first", F.least), ("last", F.greatest))))
    # each control is an analysis of its own
    own = meet(slices.drop("hu_slice", "first", "last"), wanted, place).drop("series_id", "folder").withColumnRenamed("run_id", "series_id")
    held = None if frozen is None else devices.frozen_of(there.select(F.col("run_id").alias("series_id"), "device_id"), frozen)
    hu = hu_of_series(image_rows, own, held, n_rows, n_cols).select(F.col("series_id").alias("run_id"), "detected", "water_ct", "uniformity", "geometry", "mismatch")
    spectra = nps_of_series(image_rows, own, n_rows, n_cols, frozen=held).series.select(F.col("series_id").alias("run_id"), "noise", F.col("mean_freq").alias("nps_freq"), "error")
    refs = references.select("device_id", F.col("noise").alias("ref_noise"), F.col("nps_freq").alias("ref_nps_freq"))
    kept = [c for c in ("run_date", "control_type", "performed_by", "validated_by", "folder", "stored_folder") if c in known.columns]
    rows = known.select("run_id", "device_id", "missing", "clamped", "artifacts_present", *kept)
    rows = meet(meet(rows, hu, "run_id", "left"), spectra, "run_id", "left").join(refs, "device_id", "left")
    return rows.withColumns(R.statuses())
