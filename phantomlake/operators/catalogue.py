"""The catalogue of slices: what is an image, what is rejected and why, which series and format to take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Files that are never images.
SKIP_SUFFIXES = (".txt", ".pdf", ".xml", ".json", ".png", ".jpg", ".jpeg", ".csv", ".zip", ".html", ".bak", ".ini", ".db", ".log", ".tmp")
SKIP_NAMES = ("dicomdir", "thumbs.db", "desktop.ini")
CT_IMAGE, ENHANCED_CT_IMAGE = "1.2.840.10008.5.1.4.1.1.2", "1.2.840.10008.5.1.4.1.1.2.1"
MIN_AXIAL_COSINE = 0.9


def is_candidate(path: Column) -> Column:
    """False for hidden files, known names and known suffixes."""
    name = F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))
    suffix = F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)
    return ~(name.startswith(".") | name.isin(*SKIP_NAMES) | suffix.isin(*SKIP_SUFFIXES))


def slice_class(modality: Column, sop: Column, image_type: Column, rx: Column, ry: Column, cx: Column, cy: Column, lossy: Column, single_plane: Column) -> Column:
    """STRUCT<kind, reason> of the first rule that fails: kind skipped (expected) or error, ok without one."""
    mode, sop = F.upper(F.trim(F.coalesce(modality, F.lit("")))), F.coalesce(sop, F.lit(""))
    values = F.transform(F.split(F.coalesce(image_type, F.lit("")), r"\\"), lambda v: F.upper(F.trim(v)))
    made = lambda kind, reason: F.struct(F.lit(kind).alias("kind"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    return (
        F.when((mode != "") & (mode != "CT"), made("skipped", F.concat(F.lit("modalité "), mode, F.lit(" : ce n'est pas une image de tomodensitométrie"))))
        .when(sop == ENHANCED_CT_IMAGE, made("error", "format Enhanced CT (plusieurs coupes par fichier) non pris en charge : exportez la série au format CT classique"))
        .when((sop != "") & (sop != CT_IMAGE), made("skipped", "objet DICOM qui n'est pas une coupe TDM (rapport de dose, capture d'écran…)"))
        .when(F.array_contains(values, "LOCALIZER"), made("skipped", "topogramme (image de repérage)"))
        .when(F.abs(rx * cy - ry * cx) < MIN_AXIAL_COSINE, made("skipped", "coupe non axiale (reconstruction coronale, sagittale ou oblique)"))
        .when(F.trim(F.coalesce(lossy, F.lit(""))) == "01", made("error", "image compressée avec perte : la décision ANSM exige des images non compressées ou décompressées sans perte"))
        .when(~F.coalesce(single_plane, F.lit(True)), made("error", "image à plusieurs plans"))
        .otherwise(made("ok", ""))
    )


def series_inventory(slices: DataFrame) -> DataFrame:
    """Per folder and series: slices, and number and description of the first file."""
    first = lambda c: F.min_by(c, "file_path")
    return slices.groupBy("folder_id", "series_uid").agg(F.count("*").alias("n_slices"), first("series_number").alias("series_number"), first("description").alias("description"))


def series_label(number: Column, description: Column, n: Column) -> Column:
    return F.concat(F.lit("Série "), number.cast("string"), F.lit(" — "), description, F.lit(" — "), n.cast("string"), F.lit(" coupe(s)"))


FORMAT = ("n_rows", "px4")


def majority_format(slices: DataFrame) -> DataFrame:
    """Per series the format most slices have; on a tie the one that comes first in file order."""
    sized = slices.withColumn("px4", F.round("px", 4)).groupBy("series_uid", *FORMAT).agg(F.count("*").alias("n"), F.min("file_path").alias("first_file"))
    best = F.min_by(F.struct(*FORMAT, "n"), F.struct((-F.col("n")).alias("n"), "first_file")).alias("f")
    return sized.groupBy("series_uid").agg(best).select("series_uid", F.col("f.n_rows").alias("n_rows"), F.col("f.px4").alias("px"), F.col("f.n").alias("n"))


def format_filter(slices: DataFrame) -> DataFrame:
    """All slices with `accepted`: whether they have their series' majority format."""
    best = majority_format(slices).select("series_uid", F.col("n_rows").alias("best_rows"), F.col("px").alias("best_px"))
    fits = (F.col("n_rows") == F.col("best_rows")) & (F.round("px", 4) == F.col("best_px"))
    return slices.join(best, "series_uid").withColumn("accepted", fits).drop("best_rows", "best_px")


def slice_order(slices: DataFrame) -> DataFrame:
    """slice_idx from 0 by location, instance number and file."""
    w = Window.partitionBy("series_uid").orderBy("slice_location", "instance_number", "file_path")
    return slices.withColumn("slice_idx", F.row_number().over(w) - 1)


def pick_series(inventory: DataFrame, requested: Column | None = None) -> DataFrame:
    """Per folder the requested series if it is there, else the largest, then the lowest number."""
    asked = F.coalesce(F.col("series_uid") == requested, F.lit(False)) if requested is not None else F.lit(False)
    w = Window.partitionBy("folder_id").orderBy(asked.desc(), F.desc("n_slices"), "series_number", "series_uid")
    return inventory.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


def reject_summary(rejects: DataFrame, top: int = 4) -> DataFrame:
    """Per kind the most frequent reasons; ties by first file."""
    counted = rejects.groupBy("kind", "reason").agg(F.count("*").alias("n"), F.min("file_path").alias("first_file"))
    w = Window.partitionBy("kind").orderBy(F.desc("n"), "first_file")
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def modulation(slices: DataFrame) -> DataFrame:
    """Per series the range of kV and mA, zeros ignored, and how it is shown."""

    def shown(x: str) -> Column:
        low, high = (F.format_string("%.0f", F.bround(F.col(f"{x}_{e}"), 0)) for e in ("min", "max"))
        many = F.col("n") > 1
        same = F.when(many, F.concat(low, F.lit(" (toutes coupes)"))).otherwise(low)
        return F.when(F.col(f"{x}_min").isNull(), "—").when(F.col(f"{x}_min") == F.col(f"{x}_max"), same).otherwise(F.concat(low, F.lit("-"), high, F.lit(" (modulation)")))

    known = {x: F.nullif(F.col(x), F.lit(0.0)) for x in ("kvp", "tube_current")}
    ranges = [f(v).alias(f"{x}_{n}") for x, v in known.items() for n, f in (("min", F.min), ("max", F.max))]
    rows = slices.groupBy("series_uid").agg(F.count("*").alias("n"), *ranges)
    return rows.select("series_uid", "kvp_min", "kvp_max", "tube_current_min", "tube_current_max", shown("kvp").alias("kvp_text"), shown("tube_current").alias("ma_text"))
