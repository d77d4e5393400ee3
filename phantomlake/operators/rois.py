"""Regions of interest: sizes, places, pixel statistics, tiles and their exchange format."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phantomlake.operators.pixels import with_slices

#: Fixed values of the sizing rules.
CENTRAL, PERIPHERAL, MIN_RADIUS = 0.4, 0.1, 6  # 6 = ceil(sqrt(100 / pi))
NPS_SHARE, NPS_STEP, NPS_MIN, NPS_MAX = 0.15, 8, 32, 128
CARDINAL, DIAGONAL, GAP_MM = 0.455, 0.367, 12.5
HU_NAMES = ("centre", "haut", "droite", "bas", "gauche")
HU_PLACES = ((0, 0), (-1, 0), (0, 1), (1, 0), (0, -1))  # (row, column) in peripheral distances
NPS_NAMES = ("haut-gauche", "bas-droite", "bas-gauche", "haut-droite", "haut", "bas", "gauche", "droite")
NPS_PLACES = ((-1, -1), (1, 1), (1, -1), (-1, 1), (-1, 0), (1, 0), (0, -1), (0, 1))  # the first four diagonal


def roi_geometry(diameter: Column, px: Column, gap_mm: float = GAP_MM) -> dict[str, Column]:
    """Sizes and offsets in pixels from the inner diameter; null where the pixel size is not positive."""
    whole = lambda x: F.when(px > 0, x.cast("int"))
    central, peripheral = (diameter * CENTRAL / 2).cast("int"), F.greatest((diameter * PERIPHERAL / 2).cast("int"), F.lit(MIN_RADIUS))
    side = F.bround(diameter * NPS_SHARE / NPS_STEP, 0) * NPS_STEP
    return {
        "central_radius": whole(central),
        "peripheral_radius": whole(peripheral),
        "peripheral_distance": whole(F.bround(diameter / 2 - F.lit(gap_mm) / px - peripheral, 0)),
        "nps_roi_size": whole(F.least(F.greatest(side, F.lit(NPS_MIN)), F.lit(NPS_MAX))),
        "nps_cardinal_distance": whole(diameter / 2 * CARDINAL),
        "nps_diagonal_offset": whole(diameter / 2 * DIAGONAL),
    }


def geometry_struct(diameter: Column, px: Column, n_rows: Column, n_cols: Column) -> Column:
    """The geometry of a detected diameter as it is stored: image format, diameter, sizes and offsets; not frozen."""
    head = {"pixel_size_mm": px.cast("double"), "rows": n_rows.cast("int"), "columns": n_cols.cast("int"), "phantom_diameter_px": diameter.cast("double")}
    return F.struct(*(v.alias(k) for k, v in (head | roi_geometry(diameter, px) | {"frozen_date": F.lit("")}).items()))


def sizes_of(geometry: str) -> dict[str, Column]:
    """Sizes and offsets of a geometry column, as hu_rois and nps_rois take them."""
    return {k: F.col(f"{geometry}.{k}") for k in ("central_radius", "peripheral_radius", "peripheral_distance", "nps_roi_size", "nps_cardinal_distance", "nps_diagonal_offset")}


def hu_rois(phantoms: DataFrame, g: dict[str, Column]) -> DataFrame:
    """Five circles per phantom: the centre and four around it."""
    each = [
        F.struct(
            F.lit(k).alias("roi_idx"), F.lit(name).alias("name"), (F.col("center_col") + g["peripheral_distance"] * c).cast("int").alias("cx"),
            (F.col("center_row") + g["peripheral_distance"] * r).cast("int").alias("cy"), (g["central_radius"] if k == 0 else g["peripheral_radius"]).cast("int").alias("radius"),
        )
        for k, (name, (r, c)) in enumerate(zip(HU_NAMES, HU_PLACES, strict=True))
    ]
    return phantoms.withColumn("roi", F.explode(F.array(*each))).select("*", "roi.*").drop("roi")


def nps_rois(phantoms: DataFrame, g: dict[str, Column]) -> DataFrame:
    """Eight squares per phantom, four diagonal then four cardinal, by their centres."""
    each = []
    for k, (name, (r, c)) in enumerate(zip(NPS_NAMES, NPS_PLACES, strict=True)):
        step = g["nps_diagonal_offset"] if k < 4 else g["nps_cardinal_distance"]
        each.append(F.struct(F.lit(k).alias("roi_idx"), F.lit(name).alias("name"), (F.col("center_col") + step * c).cast("int").alias("x"), (F.col("center_row") + step * r).cast("int").alias("y"), g["nps_roi_size"].cast("int").alias("side")))
    return phantoms.withColumn("roi", F.explode(F.array(*each))).select("*", "roi.*").drop("roi")


def _on_rows(image_rows: DataFrame, rois: DataFrame, crosses: Callable[[Column], Column], made: Callable[[Column], Column]) -> DataFrame:
    """One row for each image row and region that crosses it: slice_id, row_idx and the fields of `made`.

    Regions meet pixels by slice alone, all of a slice in one array (a slice has a few regions for each analysis it serves).
    So pixels that are stored bucketed by slice (see pixels.write_slice_rows) are joined and grouped where they lie.
    """
    held = rois.groupBy("slice_id").agg(F.collect_list(F.struct(*(c for c in rois.columns if c != "slice_id"))).alias("_rois"))
    return with_slices(image_rows.select("slice_id", "row_idx", "hu"), held).select("slice_id", "row_idx", F.inline(F.transform(F.filter("_rois", crosses), made)))


def circle_parts(image_rows: DataFrame, rois: DataFrame) -> DataFrame:
    """The pixels of each circle, one array per image row it crosses; pixels stay in arrays."""
    dy = lambda r: F.col("row_idx") - r["cy"]

    def made(r: Column) -> Column:
        w = F.floor(F.sqrt((r["radius"] * r["radius"] - dy(r) * dy(r)).cast("double"))).cast("int")
        first, last = F.greatest(r["cx"] - w, F.lit(0)), F.least(r["cx"] + w, F.size("hu") - 1)
        return F.struct(r["roi_idx"].alias("roi_idx"), r["name"].alias("name"), F.slice("hu", first + 1, F.greatest(last - first + 1, F.lit(0))).alias("part"))

    rows = _on_rows(image_rows, rois.select("slice_id", "roi_idx", "name", "cx", "cy", "radius"), lambda r: F.abs(dy(r)) <= r["radius"], made)
    return rows.select("slice_id", "roi_idx", "name", "row_idx", "part")


def roi_stats(image_rows: DataFrame, rois: DataFrame) -> DataFrame:
    """n, mean, population standard deviation, minimum and maximum of each circle, from sums of its rows."""
    parts = circle_parts(image_rows, rois)
    total = lambda f: F.aggregate("part", F.lit(0.0), lambda a, v: a + f(v))
    sums = parts.select("slice_id", "roi_idx", "name", F.size("part").alias("n"), total(lambda v: v).alias("s"), total(lambda v: v * v).alias("q"), F.array_min("part").alias("lo"), F.array_max("part").alias("hi"))
    out = sums.groupBy("slice_id", "roi_idx", "name").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("min_hu"), F.max("hi").alias("max_hu"))
    mean = F.col("s") / F.col("n")
    return out.select("slice_id", "roi_idx", "name", "n", mean.alias("mean_hu"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std_hu"), "min_hu", "max_hu")


def water_results(stats: DataFrame) -> DataFrame:
    """Per slice the water CT number, the uniformity and the spread of the central ROI."""
    centre = F.max(F.when(F.col("roi_idx") == 0, F.col("mean_hu")))
    rows = stats.groupBy("slice_id").agg(centre.alias("water_ct"), F.max(F.when(F.col("roi_idx") == 0, F.col("std_hu"))).alias("central_std"), F.collect_list(F.when(F.col("roi_idx") > 0, F.col("mean_hu"))).alias("around"))
    away = F.transform("around", lambda m: F.abs(m - F.col("water_ct")))
    return rows.select("slice_id", "water_ct", F.array_max(away).alias("uniformity"), "central_std")


def uniformity_detail(stats: DataFrame) -> DataFrame:
    """Signed deviation of each peripheral ROI from the central one, of slices that have a central one."""
    centre = F.max(F.when(F.col("roi_idx") == 0, F.col("mean_hu"))).alias("centre")
    around = F.collect_list(F.when(F.col("roi_idx") > 0, F.struct("name", "mean_hu"))).alias("around")
    rows = stats.groupBy("slice_id").agg(F.bool_or(F.col("roi_idx") == 0).alias("there"), centre, around).filter("there")
    return rows.select("slice_id", "centre", F.inline("around")).select("slice_id", "name", (F.col("mean_hu") - F.col("centre")).alias("deviation"))


def inside(x: Column, y: Column, side: Column, rows: Column, columns: Column) -> Column:
    """Whether a square by its centre lies wholly in the image."""
    half = F.floor(side / 2)
    return (x - half >= 0) & (y - half >= 0) & (x - half + side <= columns) & (y - half + side <= rows)


def skipped_rois(rois: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the sorted distinct indices of squares that leave the image."""
    out = F.when(~inside(F.col("x"), F.col("y"), F.col("side"), F.col("n_rows"), F.col("n_rows")), F.col("roi_idx"))
    return rois.groupBy(*keys).agg(F.array_sort(F.collect_set(out)).alias("skipped"))


def roi_tiles(image_rows: DataFrame, rois: DataFrame, n_rows: int | Column, n_cols: int | Column | None = None) -> DataFrame:
    """slice_id, roi_idx, side, z: the row-major pixels of each square inside the image. Squares may differ in size."""
    corner = lambda r, c: (r[c] - F.floor(r["side"] / 2)).cast("int")
    whole = rois.filter(inside(F.col("x"), F.col("y"), F.col("side"), F.lit(n_rows), F.lit(n_rows if n_cols is None else n_cols)))
    crosses = lambda r: (F.col("row_idx") >= corner(r, "y")) & (F.col("row_idx") < corner(r, "y") + r["side"])
    made = lambda r: F.struct(r["roi_idx"].alias("roi_idx"), r["side"].alias("side"), F.slice("hu", corner(r, "x") + 1, r["side"]).alias("part"))
    parts = _on_rows(image_rows, whole.select("slice_id", "roi_idx", "x", "y", "side"), crosses, made)
    ordered = F.array_sort(F.collect_list(F.struct("row_idx", "part")))
    return parts.groupBy("slice_id", "roi_idx", "side").agg(F.flatten(F.transform(ordered, lambda r: r["part"])).alias("z"))


def roi_table(hu: DataFrame, nps: DataFrame, n_rows: int) -> DataFrame:
    """Both kinds of ROI in one table with sizes in pixels and mm, and a mark for squares that leave the image."""
    a = hu.select("slice_id", F.lit("hu").alias("kind"), "roi_idx", "name", F.col("cx").alias("x"), F.col("cy").alias("y"), (2 * F.col("radius")).cast("int").alias("size_px"), (2 * F.col("radius") * F.col("px")).alias("size_mm"), F.lit(False).alias("skipped"))
    out = ~inside(F.col("x"), F.col("y"), F.col("side"), F.lit(n_rows), F.lit(n_rows))
    b = nps.select("slice_id", F.lit("nps").alias("kind"), "roi_idx", "name", "x", "y", F.col("side").alias("size_px"), (F.col("side") * F.col("px")).alias("size_mm"), out.alias("skipped"))
    return a.unionByName(b)


#: Fixed values of ROI files.
NPS_COMMENT = "NPS - ROI's position given in pixel (top-left corner), section in mm"
HU_COMMENT = "HU - ROI's position given in pixel (circular ROIs), slice in mm"
CLOCK_NAMES = ("Centre", "12h", "3h", "6h", "9h")
NPS_SCHEMA = "ROI array<struct<X:double,Y:double,side_square:double>>"


def read_nps_rois(files: DataFrame, json_col: str) -> DataFrame:
    """Squares of ROI files, whose top-left corners become centres."""
    roi = files.withColumn("j", F.from_json(json_col, NPS_SCHEMA)).select(*[c for c in files.columns if c != json_col], F.posexplode("j.ROI").alias("roi_idx", "r"))
    side = F.col("r.side_square").cast("int")
    half = F.floor(side / 2)
    return roi.select(*[c for c in files.columns if c != json_col], "roi_idx", (F.col("r.X").cast("int") + half).cast("int").alias("x"), (F.col("r.Y").cast("int") + half).cast("int").alias("y"), side.alias("side"))


def _file_head(kind: str) -> list[Column]:
    number = lambda x, name: F.col(x).cast("double").alias(name)
    text = lambda x: F.coalesce(F.col(x), F.lit("")).alias(x)
    return [F.lit(kind).alias("type_of_file"), text("phantom"), text("measurement_date"), number("dfov", "DFOV"), number("px", "pixel_size"), number("width", "width_in_pixel")]


def write_nps_rois(rois: DataFrame, headers: DataFrame, key: str) -> DataFrame:
    """One ROI file per key: centres become top-left corners, in order of roi_idx. `headers` has phantom,
    measurement_date, dfov, px, width, phantom_diameter (mm), slice_start_mm and slice_end_mm of each key."""
    half = F.floor(F.col("side") / 2)
    each = F.struct("roi_idx", (F.col("x") - half).cast("double").alias("X"), (F.col("y") - half).cast("double").alias("Y"), F.col("side").cast("double").alias("side_square"))
    ordered = F.transform(F.array_sort(F.collect_list(each)), lambda r: F.struct(r["X"].alias("X"), r["Y"].alias("Y"), r["side_square"].alias("side_square")))
    made = rois.groupBy(key).agg(ordered.alias("ROI")).join(headers, key)
    section = F.struct(F.col("slice_start_mm").cast("double").alias("start"), F.col("slice_end_mm").cast("double").alias("stop")).alias("section")
    return made.select(key, F.to_json(F.struct(*_file_head("NPS"), F.col("phantom_diameter").cast("double").alias("phantom_diameter"), F.lit(NPS_COMMENT).alias("commentaire"), section, "ROI")).alias("json"))


def write_hu_rois(rois: DataFrame, headers: DataFrame, key: str) -> DataFrame:
    """One ROI file per key with its five circles and the position of its slice; `headers` as above, with slice_mm."""
    name = F.element_at(F.array(*map(F.lit, CLOCK_NAMES)), F.col("roi_idx") + 1)
    each = F.struct("roi_idx", name.alias("name"), *(F.col(x).cast("double").alias(y) for x, y in (("cx", "X"), ("cy", "Y"), ("radius", "radius"))))
    ordered = F.transform(F.array_sort(F.collect_list(each)), lambda r: F.struct(r["name"].alias("name"), r["X"].alias("X"), r["Y"].alias("Y"), r["radius"].alias("radius")))
    made = rois.groupBy(key).agg(ordered.alias("ROI")).join(headers, key)
    return made.select(key, F.to_json(F.struct(*_file_head("HU"), F.lit(HU_COMMENT).alias("commentaire"), F.col("slice_mm").cast("double").alias("slice_position_mm"), "ROI")).alias("json"))
