"""The noise power spectrum: detrending, two-dimensional and radial spectra, mean frequency, warnings.

Small tiles are transformed in expressions; tiles of real size (32 to 128 pixels) in an Arrow kernel with NumPy's
FFT that sums the spectra of a batch per series before they leave Python.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phantomlake.functions.scalars import format_fr, ring_count_of
from phantomlake.operators.lineage import meet

FIT_DEGREE = 11


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _basis(side: int) -> list[np.ndarray]:
    """1, u, v, u² - m, v² - m, uv on the grid: orthogonal, so that a fit is six sums."""
    u = np.arange(side) - (side - 1) / 2
    x, y = np.tile(u, side), np.repeat(u, side)
    m = (side * side - 1) / 12
    return [np.ones(side * side), x, y, x * x - m, y * y - m, x * y]


def detrended(z: Column, side: int) -> Column:
    """The tile without its least-squares quadratic surface."""
    bases = [F.array(*map(F.lit, b.tolist())) for b in _basis(side)]
    norms = [float((b * b).sum()) for b in _basis(side)]
    fit = lambda t: F.array(*(_sum(F.zip_with(t, b, lambda v, w: v * w)) / n for b, n in zip(bases, norms, strict=True)))

    def less(t: Column, k: Column) -> Column:
        surface = lambda i: sum((F.element_at(k, j + 1) * F.element_at(b, i + 1) for j, b in enumerate(bases)), F.lit(0.0))
        return F.transform(t, lambda v, i: v - surface(i))

    return bound(z, lambda t: bound(fit(t), lambda k: less(t, k)))


def _total(factors: list[float], values: list[Column]) -> Column:
    """The sum of values times factors, without work for factors of 0, 1 and -1."""
    out = F.lit(0.0)
    for k, v in zip(factors, values, strict=True):
        if k:
            out = out + v if k == 1 else out - v if k == -1 else out + v * k
    return out


def power(z: Column, side: int, px: Column) -> Column:
    """abs(DFT)² px² / side² of a tile, zero frequency at side // 2, row-major; for small sides. Rows are transformed first,
    then columns, at the frequencies from 0 to side // 2 of a row; the others mirror them."""
    half = side // 2
    wave = lambda f, k: [float(round(f(2 * math.pi * (k * i % side) / side), 15)) if k * i * 4 % side == 0 else f(2 * math.pi * (k * i % side) / side) for i in range(side)]
    cos, sin = ([wave(f, k) for k in range(side)] for f in (math.cos, math.sin))
    steps = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    parts = lambda x, first, n: [F.element_at(x, first + i + 1) for i in range(n)]

    def row(x: Column) -> Column:
        v = parts(x, 0, side)
        return F.array(*(_total(w[k], v) for k in range(half + 1) for w in (cos, sin)))

    def column(x: Column) -> Column:
        v = parts(x, 0, 2 * side)  # cosine sums of all rows, then sine sums
        return F.array(*(_total(w, v) for k in range(side) for w in (cos[k] + [-s for s in sin[k]], sin[k] + cos[k])))

    cells = [((y + side - half) % side, (x + side - half) % side) for y in range(side) for x in range(side)]
    at = F.array(*(F.lit(2 * (x * side + y) if x <= half else 2 * ((side - x) * side + (side - y) % side)) for y, x in cells))
    rows = lambda t: F.transform(F.transform(steps(side), lambda y: F.slice(t, y * side + 1, side)), row)
    pick = lambda r, at: F.transform(r, lambda x: F.element_at(x, at))
    turned = lambda r: F.transform(steps(half + 1), lambda k: F.concat(pick(r, 2 * k + 1), pick(r, 2 * k + 2)))
    square = lambda f, i: F.element_at(f, i) * F.element_at(f, i)
    powers = lambda f: F.transform(at, lambda i: (square(f, i + 1) + square(f, i + 2)) * px * px / float(side * side))
    return bound(z, lambda t: bound(rows(t), lambda r: bound(F.flatten(F.transform(turned(r), column)), powers)))


def tile_stats(tiles: DataFrame) -> DataFrame:
    """Adds mean_hu and std_hu (population) of each tile z."""
    n = F.size("z")
    spread = lambda m: F.struct(m.alias("mean"), F.sqrt(_sum(F.transform("z", lambda v: (v - m) * (v - m))) / n).alias("std"))
    rows = tiles.withColumn("_s", bound(_sum(F.col("z")) / n, spread))
    return rows.withColumns({"mean_hu": F.col("_s.mean"), "std_hu": F.col("_s.std")}).drop("_s")


def noise(stats: DataFrame) -> DataFrame:
    """Per series the mean of its tiles' standard deviations, and how many there are."""
    return stats.groupBy("series_id").agg(F.avg("std_hu").alias("noise"), F.count("*").alias("n_tiles"))


def mean_spectrum(spectra: DataFrame) -> DataFrame:
    """series_id, cell, power: the average over the tiles of each series."""
    return spectra.select("series_id", F.posexplode("power").alias("cell", "p")).groupBy("series_id", "cell").agg(F.avg("p").alias("power"))


def mean_spectrum_fft(tiles: DataFrame, px: float) -> DataFrame:
    """series_id, side, n_tiles, power (array): detrended tiles of any size by FFT, averaged per series."""
    out = pa.schema([("series_id", pa.int64()), ("side", pa.int32()), ("n", pa.int64()), ("power", pa.list_(pa.float64()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sums: dict[tuple[int, int], list] = {}
            for series, z in zip(part.column("series_id").to_pylist(), part.column("z"), strict=True):
                v = np.asarray(z.values, dtype=float)
                side = math.isqrt(len(v))
                for b in _basis(side):
                    v = v - b * ((v * b).sum() / (b * b).sum())
                p = np.abs(np.fft.fftshift(np.fft.fft2(v.reshape(side, side)))) ** 2 * px * px / (side * side)
                known = sums.setdefault((series, side), [0, np.zeros(side * side)])
                known[0] += 1
                known[1] += p.ravel()
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sums], pa.int64()), pa.array([s for _, s in sums], pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([p for _, p in sums.values()], pa.list_(pa.float64()))], schema=out)

    partial = tiles.select("series_id", "z").mapInArrow(run, "series_id long, side int, n long, power array<double>")
    # every cell of a series counts the same tiles, so the kernel runs once and nothing is joined
    cells = partial.select("series_id", "side", "n", F.posexplode("power").alias("cell", "p")).groupBy("series_id", "side", "cell").agg(F.sum("n").alias("n_tiles"), F.sum("p").alias("p"))
    return cells.select("series_id", "side", "n_tiles", "cell", (F.col("p") / F.col("n_tiles")).alias("power"))


def radial_of(spectrum: DataFrame) -> DataFrame:
    """series_id, ring, freq, power of spectra (series_id, side, px, cell, power): the mean over the cells of each ring
    (lower edge of its distance); 0 for an empty ring."""
    side = F.col("side")
    half, rings = F.floor(side / 2), ring_count_of(side)
    dy, dx = F.floor(F.col("cell") / side) - half, F.col("cell") % side - half
    ring = F.floor(F.sqrt((dx * dx + dy * dy).cast("double"))).cast("int")
    means = spectrum.withColumn("ring", ring).filter(F.col("ring") < rings).groupBy("series_id", "ring").agg(F.avg("power").alias("power"))
    axis = spectrum.select("series_id", "side", "px").distinct().select("*", F.explode(F.sequence(F.lit(0), rings - 1)).alias("ring"))
    return meet(axis, means, ["series_id", "ring"], "left").select("series_id", "ring", (F.col("ring") / (side * F.col("px"))).alias("freq"), F.coalesce("power", F.lit(0.0)).alias("power"))


def radial(spectrum: DataFrame, side: int, px: float) -> DataFrame:
    """The rings of spectra that all have one size and pixel."""
    return radial_of(spectrum.withColumns({"side": F.lit(side), "px": F.lit(px)}))


def mean_frequency(rings: DataFrame) -> DataFrame:
    """Per series the centroid of the radial spectrum by trapezoids; 0 where the total is not positive."""
    w = Window.partitionBy("series_id").orderBy("ring")
    f, p, f0, p0 = F.col("freq"), F.col("power"), F.lag("freq").over(w), F.lag("power").over(w)
    steps = rings.select("series_id", ((f * p + f0 * p0) / 2 * (f - f0)).alias("moment"), ((p + p0) / 2 * (f - f0)).alias("mass"))
    mass = F.sum("mass")
    return steps.groupBy("series_id").agg(F.when(mass > 0, F.sum("moment") / mass).otherwise(0.0).alias("mean_freq"))


def fitted(rings: DataFrame, degree: int = FIT_DEGREE) -> DataFrame:
    """Adds `fit`: a polynomial through each series' rings, floored at 0; the raw values where it cannot be had."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ring")
        fit = rows["power"].to_numpy()
        if len(rows) > degree:
            try:
                fit = np.maximum(np.polyval(np.polyfit(rows["freq"], rows["power"], degree), rows["freq"]), 0.0)
            except np.linalg.LinAlgError:
                pass
        return rows.assign(fit=fit)

    return rings.select("series_id", "ring", "freq", "power").groupBy("series_id").applyInPandas(run, "series_id long, ring int, freq double, power double, fit double")


def roi_warnings(stats: DataFrame) -> DataFrame:
    """Tiles that stand out of their series: mean over 3 sigma and 2 HU away, or spread over twice the median."""
    w = Window.partitionBy("series_id")
    rows = stats.withColumns({"all_mean": F.avg("mean_hu").over(w), "all_std": F.stddev_pop("mean_hu").over(w)})
    # the exact median comes from an aggregate of its own: it has no window form
    medians = stats.groupBy("series_id").agg(F.median("std_hu").alias("median_std"))
    rows = meet(rows, medians, "series_id")
    away = F.abs(F.col("mean_hu") - F.col("all_mean"))
    odd_mean = F.when((F.col("all_std") > 0) & (away / F.col("all_std") > 3) & (away > 2), F.concat(F.lit("moyenne atypique ("), format_fr(F.col("mean_hu"), 1), F.lit(" UH pour "), format_fr(F.col("all_mean"), 1), F.lit(" UH attendu)")))
    odd_std = F.when((F.col("median_std") > 0) & (F.col("std_hu") > 2 * F.col("median_std")), F.concat(F.lit("écart-type élevé ("), format_fr(F.col("std_hu"), 1), F.lit(" UH pour "), format_fr(F.col("median_std"), 1), F.lit(" UH en médiane)")))
    text = F.concat_ws(" ; ", odd_mean, odd_std)
    place = F.concat(F.lit("ROI "), (F.col("roi_idx") + 1).cast("string"), F.lit(", coupe "), (F.col("slice_idx") + 1).cast("string"), F.lit(" : "))
    return rows.withColumn("text", text).filter("text <> ''").select("series_id", "slice_idx", "roi_idx", F.concat(place, "text").alias("message"))


def first_warnings(warnings: DataFrame, n: int = 5) -> DataFrame:
    """Per series the first n warnings, and how many there are beyond them."""
    w = Window.partitionBy("series_id")
    rows = warnings.withColumn("rank", F.row_number().over(w.orderBy("slice_idx", "roi_idx"))).withColumn("more", F.greatest(F.count("*").over(w) - n, F.lit(0)))
    return rows.filter(F.col("rank") <= n)


def analysis(tiles: DataFrame, side: int, px: float) -> DataFrame:
    """Per series: mean frequency, noise, tiles used, whether they come from fewer than ten slices."""
    stats = tile_stats(tiles)
    freq = mean_frequency(radial(mean_spectrum_fft(tiles, px).select("series_id", "cell", "power"), side, px))
    slices = tiles.groupBy("series_id").agg(F.countDistinct("slice_idx").alias("n_slices"))
    return meet(meet(freq, noise(stats), "series_id"), slices, "series_id").withColumn("few_slices", F.col("n_slices") < 10)
