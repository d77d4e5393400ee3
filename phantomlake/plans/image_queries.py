"""Queries over pixels: ROI geometry and statistics, phantom detection, noise power spectra, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from phantomlake.functions import rules as R
from phantomlake.operators import nps, phantom, rois, validation
from phantomlake.plans.registry import query
from phantomlake.sources.views import image_rows, view

C = F.col
SIDE, PX, N = 8, 0.5, 96


def rounded(df, *columns, n: int = 6):
    return df.withColumns({c: F.round(c, n) for c in columns})


_GEO = """(select *, cast(trunc(diameter_px * 0.4 / 2) as int) as central_radius, greatest(cast(trunc(diameter_px * 0.1 / 2) as int), 6) as peripheral_radius,
   cast(least(greatest(round_even(diameter_px * 0.15 / 8, 0) * 8, 32), 128) as int) as nps_roi_size, cast(trunc(diameter_px / 2 * 0.455) as int) as nps_cardinal_distance, cast(trunc(diameter_px / 2 * 0.367) as int) as nps_diagonal_offset,
   cast(round_even(diameter_px / 2 - 12.5 / px - greatest(cast(trunc(diameter_px * 0.1 / 2) as int), 6), 0) as int) as peripheral_distance from {%s})"""
GEO_FORMATS, GEO = _GEO % "formats", _GEO % "phantoms"
GEO_COLUMNS = ("central_radius", "peripheral_radius", "peripheral_distance", "nps_roi_size", "nps_cardinal_distance", "nps_diagonal_offset")


@query("roi_geometry", f"select fmt_id, {', '.join(GEO_COLUMNS)} from {GEO_FORMATS}")
def roi_geometry(spark, d):
    g = rois.roi_geometry(C("diameter_px"), C("px"))
    return view(spark, d, "formats").select("fmt_id", *(g[x].alias(x) for x in GEO_COLUMNS))


HU_SQL = f"""(select slice_id, px, i as roi_idx, ['centre', 'haut', 'droite', 'bas', 'gauche'][i + 1] as name, cast(center_col + case i when 2 then 1 when 4 then -1 else 0 end * peripheral_distance as int) as cx,
   cast(center_row + case i when 1 then -1 when 3 then 1 else 0 end * peripheral_distance as int) as cy, case i when 0 then central_radius else peripheral_radius end as radius from {GEO}, (select cast(range as int) as i from range(5)))"""
NPS_SQL = f"""(select *, i as roi_idx, ['haut-gauche', 'bas-droite', 'bas-gauche', 'haut-droite', 'haut', 'bas', 'gauche', 'droite'][i + 1] as name, nps_roi_size as side,
   cast(center_col + [-1, 1, -1, 1, 0, 0, -1, 1][i + 1] * case when i < 4 then nps_diagonal_offset else nps_cardinal_distance end as int) as x,
   cast(center_row + [-1, 1, 1, -1, -1, 1, 0, 0][i + 1] * case when i < 4 then nps_diagonal_offset else nps_cardinal_distance end as int) as y from %s, (select cast(range as int) as i from range(8)))"""


def hu_rois_of(spark, d):
    return rois.hu_rois(view(spark, d, "phantoms"), rois.roi_geometry(C("diameter_px"), C("px")))


@query("hu_rois", f"select slice_id, roi_idx, name, cx, cy, radius from {HU_SQL}")
def hu_rois(spark, d):
    return hu_rois_of(spark, d).select("slice_id", "roi_idx", "name", "cx", "cy", "radius")


def nps_rois_of(spark, d, name: str):
    return rois.nps_rois(view(spark, d, name), rois.roi_geometry(C("diameter_px"), C("px")))


@query("nps_rois", f"select fmt_id, roi_idx, name, x, y, side from {NPS_SQL % GEO_FORMATS}")
def nps_rois(spark, d):
    return nps_rois_of(spark, d, "formats").select("fmt_id", "roi_idx", "name", "x", "y", "side")


_OUT = "not (x - side // 2 >= 0 and y - side // 2 >= 0 and x - side // 2 + side <= n_rows and y - side // 2 + side <= n_rows)"


@query("skipped_rois", f"select fmt_id, coalesce(string_agg(cast(roi_idx as varchar), ',' order by roi_idx) filter ({_OUT}), '') as skipped from {NPS_SQL % GEO_FORMATS} group by 1")
def skipped_rois(spark, d):
    return rois.skipped_rois(nps_rois_of(spark, d, "formats"), ["fmt_id"]).withColumn("skipped", F.array_join(C("skipped").cast("array<string>"), ","))


@query("roi_table", f"""select slice_id, 'hu' as kind, roi_idx, name, cx as x, cy as y, cast(2 * radius as int) as size_px, 2 * radius * px as size_mm, false as skipped from {HU_SQL}
  union all select slice_id, 'nps', roi_idx, name, x, y, side, side * px, not (x - side // 2 >= 0 and y - side // 2 >= 0 and x - side // 2 + side <= 96 and y - side // 2 + side <= 96) from {NPS_SQL % GEO}""")
def roi_table(spark, d):
    return rois.roi_table(hu_rois_of(spark, d), nps_rois_of(spark, d, "phantoms"), N)


STATS_SQL = f"""(select slice_id, roi_idx, name, count(*) as n, avg(hu) as mean_hu, stddev_pop(hu) as std_hu, min(hu) as min_hu, max(hu) as max_hu
  from {HU_SQL} join {{pixels}} using (slice_id) where (row_idx - cy) * (row_idx - cy) + (col_idx - cx) * (col_idx - cx) <= radius * radius group by 1, 2, 3)"""


def stats_of(spark, d):
    return rois.roi_stats(image_rows(spark, d), hu_rois_of(spark, d))


@query("roi_stats", f"select slice_id, roi_idx, name, n, round(mean_hu, 6) as mean_hu, round(std_hu, 6) as std_hu, min_hu, max_hu from {STATS_SQL}")
def roi_stats(spark, d):
    return rounded(stats_of(spark, d), "mean_hu", "std_hu")


@query("roi_pixels", f"select slice_id, roi_idx, name, row_idx, count(*) as n, sum(hu) as total from {HU_SQL} join {{pixels}} using (slice_id) where (row_idx - cy) * (row_idx - cy) + (col_idx - cx) * (col_idx - cx) <= radius * radius group by 1, 2, 3, 4")
def roi_pixels(spark, d):
    parts = rois.circle_parts(image_rows(spark, d), hu_rois_of(spark, d))
    return parts.select("slice_id", "roi_idx", "name", "row_idx", F.size("part").cast("long").alias("n"), F.aggregate("part", F.lit(0.0), lambda a, v: a + v).alias("total"))


WATER_SQL = f"(select slice_id, max(mean_hu) filter (roi_idx = 0) as water_ct, max(abs(mean_hu - c)) filter (roi_idx > 0) as uniformity, max(std_hu) filter (roi_idx = 0) as central_std from (select *, max(mean_hu) filter (roi_idx = 0) over (partition by slice_id) as c from {STATS_SQL}) group by 1)"


@query("water_ct", f"select slice_id, round(water_ct, 6) as water_ct from {WATER_SQL}")
def water_ct(spark, d):
    return rounded(rois.water_results(stats_of(spark, d)).select("slice_id", "water_ct"), "water_ct")


@query("uniformity", f"select slice_id, round(uniformity, 6) as uniformity from {WATER_SQL}")
def uniformity(spark, d):
    return rounded(rois.water_results(stats_of(spark, d)).select("slice_id", "uniformity"), "uniformity")


@query("uniformity_detail", f"select slice_id, name, round(mean_hu - c, 6) as deviation from (select *, max(mean_hu) filter (roi_idx = 0) over (partition by slice_id) as c from {STATS_SQL}) where roi_idx > 0")
def uniformity_detail(spark, d):
    return rounded(rois.uniformity_detail(stats_of(spark, d)), "deviation")


@query("water_phantom", f"select slice_id, round(water_ct, 6) as water_ct, round(uniformity, 6) as uniformity, round(central_std, 6) as central_std, case when abs(water_ct) <= 7 then 'ok' when abs(abs(water_ct) - 25) <= 1e-9 then 'nc_or_ncg' when abs(water_ct) < 25 then 'nc' else 'ncg' end as ct_status, case when abs(uniformity) <= 7 then 'ok' else 'nc' end as uniformity_status from {WATER_SQL}")
def water_phantom(spark, d):
    rows = rois.water_results(stats_of(spark, d))
    rows = rows.withColumns({"ct_status": R.water_ct_status(C("water_ct")), "uniformity_status": R.uniformity_status(C("uniformity"))})
    return rounded(rows, "water_ct", "uniformity", "central_std")


@query("roi_tiles", f"select slice_id, roi_idx, count(*) as n, round(avg(hu), 6) as mean_hu, sum(hu * (row_idx * 96 + col_idx)) as weighted from {NPS_SQL % GEO} join {{pixels}} using (slice_id) where row_idx between y - side // 2 and y - side // 2 + side - 1 and col_idx between x - side // 2 and x - side // 2 + side - 1 and {_OUT.replace('n_rows', '96')} = false group by 1, 2".replace("not (x - side", "not (x - side"))
def roi_tiles(spark, d):
    """Each tile told by its size, mean and position-weighted sum."""
    # each square takes its corner along
    corner = F.struct("roi_idx", (C("x") - F.floor(C("side") / 2)).alias("x0"), (C("y") - F.floor(C("side") / 2)).alias("y0"))
    placed = nps_rois_of(spark, d, "phantoms").select("slice_id", corner.alias("roi_idx"), "x", "y", "side")
    tiles = rois.roi_tiles(image_rows(spark, d), placed, N)
    cells = tiles.select("slice_id", "roi_idx.*", "side", F.posexplode("z").alias("i", "hu"))
    at = (C("y0") + F.floor(C("i") / C("side"))) * N + C("x0") + C("i") % C("side")
    return cells.groupBy("slice_id", "roi_idx").agg(F.count("*").alias("n"), F.round(F.avg("hu"), 6).alias("mean_hu"), F.sum(C("hu") * at).alias("weighted"))


# -- spectra on 8 x 8 tiles ------------------------------------------------------------------------------------

def tiles_of(spark, d):
    z = F.transform("embedding", lambda v: v.cast("double") * 100.0)
    return view(spark, d, "tiles").select("vec_id", C("series_id").cast("long").alias("series_id"), F.floor(C("k") / 8).cast("int").alias("slice_idx"), (C("k") % 8).cast("int").alias("roi_idx"), z.alias("z"))


_CELLS = "(select vec_id, cast(series_id as bigint) as series_id, k, i, i // 8 as r, i % 8 as c, (i % 8) - 3.5 as u, (i // 8) - 3.5 as v, cast(embedding[i + 1] as double) * 100.0 as z from {tiles}, (select cast(range as int) as i from range(64)))"
_RESID = f"""(select t.*, z - b0 - b1 * u - b2 * v - b3 * (u * u - 5.25) - b4 * (v * v - 5.25) - b5 * u * v as d from {_CELLS} t join (
  select vec_id, avg(z) as b0, sum(z * u) / sum(u * u) as b1, sum(z * v) / sum(v * v) as b2, sum(z * (u * u - 5.25)) / sum((u * u - 5.25) * (u * u - 5.25)) as b3, sum(z * (v * v - 5.25)) / sum((v * v - 5.25) * (v * v - 5.25)) as b4, sum(z * u * v) / sum(u * v * u * v) as b5 from {_CELLS} group by 1) using (vec_id))"""
_POWER = f"""(select vec_id, series_id, cell, (re * re + im * im) * 0.25 / 64 as power from (
  select vec_id, series_id, cell, sum(d * cos(2 * pi() * (((cell // 8 + 4) * r + (cell % 8 + 4) * c) % 8) / 8)) as re, sum(d * sin(2 * pi() * (((cell // 8 + 4) * r + (cell % 8 + 4) * c) % 8) / 8)) as im
  from {_RESID}, (select cast(range as int) as cell from range(64)) group by 1, 2, 3))"""
_MEAN = f"(select series_id, cell, avg(power) as power from {_POWER} group by 1, 2)"
_RINGS = f"""(select s.series_id, cast(r.ring as int) as ring, r.ring / (8 * 0.5) as freq, coalesce(p.power, 0) as power from (select distinct series_id from {_MEAN}) s, (select range as ring from range(6)) r
  left join (select series_id, floor(sqrt((cell // 8 - 4) * (cell // 8 - 4) + (cell % 8 - 4) * (cell % 8 - 4))) as ring, avg(power) as power from {_MEAN} group by 1, 2) p on p.series_id = s.series_id and p.ring = r.ring)"""
_FREQ = f"(select series_id, case when sum(mass) > 0 then sum(moment) / sum(mass) else 0 end as mean_freq from (select series_id, (freq * power + lag(freq * power) over w) / 2 * (freq - lag(freq) over w) as moment, (power + lag(power) over w) / 2 * (freq - lag(freq) over w) as mass from {_RINGS} window w as (partition by series_id order by ring)) group by 1)"
_STATS = f"(select vec_id, series_id, k // 8 as slice_idx, k % 8 as roi_idx, avg(z) as mean_hu, stddev_pop(z) as std_hu from {_CELLS} group by 1, 2, 3, 4)"


@query("detrend", f"select vec_id, i, round(d, 6) as residual from {_RESID}")
def detrend(spark, d):
    return tiles_of(spark, d).select("vec_id", F.posexplode(nps.detrended(C("z"), SIDE)).alias("i", "r")).select("vec_id", "i", F.round("r", 6).alias("residual"))


def spectra_of(spark, d):
    return tiles_of(spark, d).select("vec_id", "series_id", nps.power(nps.detrended(C("z"), SIDE), SIDE, F.lit(PX)).alias("power"))


@query("nps2d", f"select vec_id, cell, round(power, 6) as power from {_POWER}")
def nps2d(spark, d):
    return spectra_of(spark, d).select("vec_id", F.posexplode("power").alias("cell", "p")).select("vec_id", "cell", F.round("p", 6).alias("power"))


def mean_of(spark, d):
    return nps.mean_spectrum_fft(tiles_of(spark, d), PX).select("series_id", "cell", "power")


@query("nps2d_mean", f"select series_id, cell, round(power, 6) as power from {_MEAN}")
def nps2d_mean(spark, d):
    return rounded(mean_of(spark, d), "power")


@query("nps2d_native", f"select series_id, cell, round(power, 6) as power from {_MEAN}")
def nps2d_native(spark, d):
    """The same average from the transform in expressions, for small tiles."""
    return rounded(nps.mean_spectrum(spectra_of(spark, d)), "power")


def rings_of(spark, d):
    return nps.radial(mean_of(spark, d), SIDE, PX)


@query("nps_radial", f"select series_id, ring, freq, round(power, 6) as power from {_RINGS}")
def nps_radial(spark, d):
    return rounded(rings_of(spark, d), "power")


@query("mean_frequency", f"select series_id, round(mean_freq, 6) as mean_freq from {_FREQ}")
def mean_frequency(spark, d):
    return rounded(nps.mean_frequency(rings_of(spark, d)), "mean_freq")


@query("noise", f"select series_id, round(avg(std_hu), 6) as noise, count(*) as n_tiles from {_STATS} group by 1")
def noise(spark, d):
    return rounded(nps.noise(nps.tile_stats(tiles_of(spark, d))), "noise")


def warnings_of(spark, d):
    """Some tiles are made louder or brighter, so that there is something to warn of."""
    k = F.when(C("vec_id") % 41 == 0, 3.0).otherwise(1.0)
    shift = F.when(C("vec_id") % 37 == 0, 200.0).otherwise(0.0)
    return nps.roi_warnings(nps.tile_stats(tiles_of(spark, d).withColumn("z", F.transform("z", lambda v: v * k + shift))))


_ODD = f"""(select series_id, slice_idx, roi_idx, 'ROI ' || (roi_idx + 1) || ', coupe ' || (slice_idx + 1) || ' : ' || concat_ws(' ; ',
   case when sm > 0 and abs(mean_hu - am) / sm > 3 and abs(mean_hu - am) > 2 then 'moyenne atypique (' || replace(printf('%.1f', round_even(mean_hu, 1)), '.', ',') || ' UH pour ' || replace(printf('%.1f', round_even(am, 1)), '.', ',') || ' UH attendu)' end,
   case when ms > 0 and std_hu > 2 * ms then 'écart-type élevé (' || replace(printf('%.1f', round_even(std_hu, 1)), '.', ',') || ' UH pour ' || replace(printf('%.1f', round_even(ms, 1)), '.', ',') || ' UH en médiane)' end) as message
  from (select *, avg(mean_hu) over (partition by series_id) as am, stddev_pop(mean_hu) over (partition by series_id) as sm, median(std_hu) over (partition by series_id) as ms from (
   select series_id, k // 8 as slice_idx, k % 8 as roi_idx, avg(z) as mean_hu, stddev_pop(z) as std_hu from (select * exclude (z), z * case when vec_id % 41 = 0 then 3 else 1 end + case when vec_id % 37 = 0 then 200 else 0 end as z from {_CELLS}) group by 1, 2, 3))
  where (sm > 0 and abs(mean_hu - am) / sm > 3 and abs(mean_hu - am) > 2) or (ms > 0 and std_hu > 2 * ms))"""


@query("roi_warnings", f"select series_id, slice_idx, roi_idx, message from {_ODD}")
def roi_warnings(spark, d):
    return warnings_of(spark, d)


@query("warnings_top", f"select series_id, slice_idx, roi_idx, cast(rank as int) as rank, greatest(n - 2, 0) as more from (select *, row_number() over (partition by series_id order by slice_idx, roi_idx) as rank, count(*) over (partition by series_id) as n from {_ODD}) where rank <= 2")
def warnings_top(spark, d):
    return nps.first_warnings(warnings_of(spark, d), 2).select("series_id", "slice_idx", "roi_idx", "rank", "more")


@query("nps_analysis", f"""select series_id, round(mean_freq, 6) as mean_freq, round(noise, 6) as noise, n_tiles, n_slices, n_slices < 10 as few_slices from {_FREQ}
  join (select series_id, avg(std_hu) as noise, count(*) as n_tiles, count(distinct slice_idx) as n_slices from {_STATS} group by 1) using (series_id)""")
def nps_analysis(spark, d):
    return rounded(nps.analysis(tiles_of(spark, d), SIDE, PX), "mean_freq", "noise")


def halves(spark, d):
    """Two spectra of each series: from its even tiles, and from its odd ones as reference."""
    parts = [tiles_of(spark, d).filter(C("vec_id") % 2 == k) for k in (0, 1)]
    return tuple(nps.radial(nps.mean_spectrum_fft(x, PX).select("series_id", "cell", "power"), SIDE, PX) for x in parts)


def _half(k: int) -> str:
    return _RINGS.replace(_MEAN, f"(select series_id, cell, avg(power) as power from {_POWER} where vec_id % 2 = {k} group by 1, 2)")


_COMPARED = f"(select a.series_id, a.ring, a.freq, a.power, b.freq as ref_freq, b.power as ref_power, abs(a.freq - b.freq) <= 1e-6 as same_axis from {_half(0)} a join {_half(1)} b on a.series_id = b.series_id and a.ring = b.ring)"


@query("spectrum_compare", f"select series_id, ring, freq, round(power, 6) as power, ref_freq, round(ref_power, 6) as ref_power, same_axis from {_COMPARED}")
def spectrum_compare(spark, d):
    return rounded(validation.spectrum_compare(*halves(spark, d), ["series_id"]), "power", "ref_power")


def _values(k: int) -> str:
    return f"(select series_id, mean_freq, noise from {_FREQ.replace(_RINGS, _half(k))} join (select series_id, avg(std_hu) as noise from {_STATS} where vec_id % 2 = {k} group by 1) using (series_id))"


def _error(a: str, b: str) -> str:
    return f"case when {b} = 0 then case when {a} <> 0 then cast('inf' as double) else 0 end else abs({a} - {b}) / abs({b}) * 100 end"


@query("validation", f"""select series_id, round(frequency_percent, 6) as frequency_percent, round(noise_percent, 6) as noise_percent, round(rms_percent, 6) as rms_percent, round(peak_percent, 6) as peak_percent, peak_freq,
  frequency_percent <= 2.0 and noise_percent <= 1.0 as passed, rms_percent <= 3.0 and peak_percent <= 5.0 as spectrum_passed
  from (select series_id, sqrt(avg((power - ref_power) * (power - ref_power)) filter (freq > 0.05)) / max(ref_power) * 100 as rms_percent, {_error("max(power)", "max(ref_power)")} as peak_percent, arg_max(freq, power) as peak_freq from {_COMPARED} group by 1)
  join (select a.series_id, {_error("a.mean_freq", "b.mean_freq")} as frequency_percent, {_error("a.noise", "b.noise")} as noise_percent from {_values(0)} a join {_values(1)} b on a.series_id = b.series_id) using (series_id)""")
def validate(spark, d):
    """Even tiles of each series against its odd ones."""
    even, odd = halves(spark, d)
    values = [nps.mean_frequency(r).join(nps.noise(nps.tile_stats(tiles_of(spark, d).filter(C("vec_id") % 2 == k))), "series_id") for k, r in enumerate((even, odd))]
    rows = validation.metrics(validation.spectrum_compare(even, odd, ["series_id"]), ["series_id"]).join(validation.value_errors(*values, ["series_id"]), "series_id")
    rows = rows.withColumns({"passed": validation.passed(C("frequency_percent"), C("noise_percent")), "spectrum_passed": validation.spectrum_passed(C("rms_percent"), C("peak_percent"))})
    return rounded(rows, "frequency_percent", "noise_percent", "rms_percent", "peak_percent")


# -- detection -------------------------------------------------------------------------------------------------

@query("water_component", """with recursive runs as (select slice_id, row_idx, min(col_idx) as a, max(col_idx) as b from (select *, col_idx - row_number() over (partition by slice_id, row_idx order by col_idx) as g from {pixels} where abs(hu) < 100) group by slice_id, row_idx, g),
  n as (select *, row_idx * 1048576 + a as id from runs),
  e as (select x.slice_id, x.id as x, y.id as y from n x join n y on x.slice_id = y.slice_id and y.row_idx = x.row_idx + 1 and x.a <= y.b and x.b >= y.a),
  u as (select slice_id, x, y from e union select slice_id, y, x from e),
  r as (select slice_id, id, id as label from n union select u.slice_id, u.y, r.label from r join u on u.slice_id = r.slice_id and u.x = r.id where r.label < u.y),
  l as (select slice_id, id, min(label) as label from r group by 1, 2),
  s as (select slice_id, label, sum(b - a + 1) as n, sum((b - a + 1) * row_idx) as rr, sum((b - a + 1) * (a + b) / 2.0) as cc from n join l using (slice_id, id) group by 1, 2)
  select slice_id, cast(n as bigint) as n, round(rr / n, 6) as center_row, round(cc / n, 6) as center_col from (select *, row_number() over (partition by slice_id order by n desc, label) as rk from s) where rk = 1""")
def water_component(spark, d):
    return rounded(phantom.water_component(image_rows(spark, d)), "center_row", "center_col")


def wall_points(spark, d):
    """Pixels of the wall that touch water to their left: a ragged half circle."""
    rows = image_rows(spark, d).select("slice_id", "row_idx", "hu", F.explode(F.sequence(F.lit(1), F.size("hu") - 1)).alias("at"))
    left, here = F.element_at("hu", C("at")), F.element_at("hu", C("at") + 1)
    return rows.filter((here == 120) & (left < 100) & (left > -100)).select("slice_id", C("row_idx").cast("double").alias("row"), C("at").cast("double").alias("col"))


_WALL = "(select p.slice_id, cast(p.row_idx as double) as row, cast(p.col_idx as double) as col from {pixels} p join {pixels} q on p.slice_id = q.slice_id and p.row_idx = q.row_idx and q.col_idx = p.col_idx - 1 where p.hu = 120 and abs(q.hu) < 100)"
_CIRCLE = f"""(select slice_id, b as center_row, a as center_col, sqrt((sq - 2 * a * sx - 2 * b * sy) / n + a * a + b * b) as radius from (select *, (xq * yy - yq * xy) / (xx * yy - xy * xy) / 2 as a, (yq * xx - xq * xy) / (xx * yy - xy * xy) / 2 as b from (
  select *, sxx - sx * sx / n as xx, sxy - sx * sy / n as xy, syy - sy * sy / n as yy, sxq - sx * sq / n as xq, syq - sy * sq / n as yq from (
  select slice_id, count(*) as n, sum(col) as sx, sum(row) as sy, sum(col * col) as sxx, sum(col * row) as sxy, sum(row * row) as syy, sum(col * (col * col + row * row)) as sxq, sum(row * (col * col + row * row)) as syq, sum(col * col + row * row) as sq from {_WALL} group by 1))))"""


@query("circle_fit", f"select slice_id, round(center_row, 6) as center_row, round(center_col, 6) as center_col, round(radius, 6) as radius from {_CIRCLE}")
def circle_fit(spark, d):
    return rounded(phantom.circle_fit(wall_points(spark, d), ["slice_id"]), "center_row", "center_col", "radius")


@query("circle_round", f"""select slice_id, count(*) as n, count(*) filter (residual <= greatest(2.0, 3 * m)) as n_stay, round(max(residual), 6) as worst from (select *, median(residual) over (partition by slice_id) as m from (
  select w.slice_id, abs(sqrt((row - center_row) * (row - center_row) + (col - center_col) * (col - center_col)) - radius) as residual from {_WALL} w join {_CIRCLE} c using (slice_id))) group by 1""")
def circle_round(spark, d):
    rows = phantom.circle_round(wall_points(spark, d), ["slice_id"])
    return rows.groupBy("slice_id").agg(F.count("*").alias("n"), F.count_if("stays").alias("n_stay"), F.round(F.max("residual"), 6).alias("worst"))


@query("ray_edges")
def ray_edges(spark, d):
    centres = view(spark, d, "phantoms").select("slice_id", C("center_row").cast("double").alias("center_row"), C("center_col").cast("double").alias("center_col"))
    return rounded(phantom.ray_edges(image_rows(spark, d), centres), "row", "col")


@query("robust_circle")
def robust_circle(spark, d):
    return rounded(phantom.robust_circle(wall_points(spark, d).withColumn("ray", C("row"))), "center_row", "center_col", "radius")


@query("detect_phantom")
def detect_phantom(spark, d):
    return rounded(phantom.detect_phantom(image_rows(spark, d)), "center_row", "center_col", "radius")
