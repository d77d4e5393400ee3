"""Queries of the column expressions: header values, texts, criteria."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phantomlake.functions import rules as R
from phantomlake.functions import scalars as S
from phantomlake.plans.registry import query
from phantomlake.sources.views import view

C = F.col
KEY = ("l_orderkey", "l_linenumber", "l_partkey")
K = "l_orderkey, l_linenumber, l_partkey"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "raw_headers")


@query("hu_rescale", "select vec_id, cast(i as int) as i, cast(floor(embedding[i + 1] * 100) as double) * (1 + vec_id % 3) - 1024.0 as hu from {embeddings}, range(64) t(i)")
def hu_rescale(spark, d):
    stored = F.transform("embedding", lambda x: F.floor(x * 100).cast("double"))
    return view(spark, d, "embeddings").select("vec_id", F.posexplode(S.hu_rescale(stored, (1 + C("vec_id") % 3).cast("double"), F.lit(-1024.0))).alias("i", "hu"))


@query("scan_date", f"""select {K}, coalesce(case when regexp_matches(trim(study_date), '^[0-9]{{{{8}}}}') then substr(trim(study_date), 1, 8) end,
  case when regexp_matches(trim(series_date), '^[0-9]{{{{8}}}}') then substr(trim(series_date), 1, 8) end,
  case when regexp_matches(trim(acquisition_date), '^[0-9]{{{{8}}}}') then substr(trim(acquisition_date), 1, 8) end, '') as scan_date from {{raw_headers}}""")
def scan_date(spark, d):
    return raw(spark, d).select(*KEY, S.scan_date(C("study_date"), C("series_date"), C("acquisition_date")).alias("scan_date"))


@query("dates", f"""select {K}, coalesce(strftime(try_strptime(case when regexp_matches(substr(trim(series_date), 1, 8), '^[0-9]{{{{8}}}}$') then substr(trim(series_date), 1, 8) end, '%Y%m%d'), '%Y-%m-%d'), '') as iso,
  case when regexp_matches(iso_date, '^[0-9]{{{{4}}}}-[0-9]{{{{2}}}}-[0-9]{{{{2}}}}$') then strftime(cast(iso_date as date), '%d/%m/%Y') else iso_date end as fr,
  case when regexp_matches(iso_date, '^[0-9]{{{{4}}}}-[0-9]{{{{2}}}}-[0-9]{{{{2}}}}$') then strftime(cast(iso_date as date), '%d/%m/%Y') else 'date inconnue' end as run_fr from {{raw_headers}}""".replace("as fr,", """as fr, case when l_linenumber = 1 then '' when regexp_matches(iso_date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then strftime(cast(substr(iso_date, 1, 10) as date), '%d/%m/%Y') else iso_date || 'T10:00:00' end as timed_fr,"""))
def dates(spark, d):
    timed = F.when(C("l_linenumber") > 1, F.concat("iso_date", F.lit("T10:00:00")))
    return raw(spark, d).select(*KEY, S.dicom_date_to_iso(C("series_date")).alias("iso"), S.iso_to_fr(C("iso_date")).alias("fr"), S.iso_to_fr(timed).alias("timed_fr"), S.run_date_fr(C("iso_date")).alias("run_fr"))


@query("datetime_fr", f"""select {K}, case when length(study_date) >= 8 then substr(study_date, 7, 2) || '/' || substr(study_date, 5, 2) || '/' || substr(study_date, 1, 4) else 'date inconnue' end ||
  case when length(study_time) >= 4 then ' ' || substr(study_time, 1, 2) || ':' || substr(study_time, 3, 2) || ':' || case when length(study_time) >= 6 then substr(study_time, 5, 2) else '00' end else '' end as shown from {{raw_headers}}""")
def datetime_fr(spark, d):
    return raw(spark, d).select(*KEY, S.datetime_fr(C("study_date"), C("study_time")).alias("shown"))


@query("multivalue", f"""select {K}, coalesce(array_to_string([upper(trim(x)) for x in string_split(image_type, chr(92))], '/'), '') as image_type,
  array_to_string([trim(x) for x in string_split(kernel, chr(92))], '/') as kernel from {{raw_headers}}""")
def multivalue(spark, d):
    return raw(spark, d).select(*KEY, S.multivalue(C("image_type"), upper=True).alias("image_type"), S.multivalue(C("kernel")).alias("kernel"))


@query("ctdi_phantom", f"select {K}, case when contains(lower(ctdi_meaning), 'head') then 'tête 16 cm' when contains(lower(ctdi_meaning), 'body') then 'corps 32 cm' else ctdi_meaning end as phantom from {{raw_headers}}")
def ctdi_phantom(spark, d):
    return raw(spark, d).select(*KEY, S.ctdi_phantom(C("ctdi_meaning")).alias("phantom"))


@query("slice_location", f"select {K}, coalesce(try_cast(slice_location_text as double), position_z, 0.0) as location from {{raw_headers}}")
def slice_location(spark, d):
    return raw(spark, d).select(*KEY, S.slice_location(C("slice_location_text"), C("position_z")).alias("location"))


@query("pixel_spacing", f"""select {K}, reason is null as ok, reason, case when reason is null then spacing_row end as px from (select *, case
  when spacing_row is null or spacing_col is null then 'taille de pixel absente (champ DICOM PixelSpacing)'
  when not (spacing_row > 0 and spacing_col > 0) then 'taille de pixel invalide (PixelSpacing = ' || regexp_replace(cast(spacing_row as varchar), '\\.0$', '') || ' × ' || regexp_replace(cast(spacing_col as varchar), '\\.0$', '') || ' mm)'
  when abs(spacing_row - spacing_col) > 0.001 * greatest(spacing_row, spacing_col) then 'pixels non carrés (' || regexp_replace(cast(spacing_row as varchar), '\\.0$', '') || ' × ' || regexp_replace(cast(spacing_col as varchar), '\\.0$', '') || ' mm) non pris en charge' end as reason from {{raw_headers}})""")
def pixel_spacing(spark, d):
    checked = raw(spark, d).withColumn("s", S.pixel_spacing(C("spacing_row"), C("spacing_col")))
    return checked.select(*KEY, "s.ok", "s.reason", F.when(C("s.ok"), C("spacing_row")).alias("px"))


@query("collimation", f"""select {K}, case when single_width > 0 and total_width > 0 then cast(cast(round_even(total_width / single_width, 0) as int) as varchar) || ' × ' || replace(regexp_replace(cast(single_width as varchar), '\\.0$', ''), '.', ',') || ' mm'
  when single_width > 0 then replace(regexp_replace(cast(single_width as varchar), '\\.0$', ''), '.', ',') || ' mm'
  when total_width > 0 then replace(regexp_replace(cast(total_width as varchar), '\\.0$', ''), '.', ',') || ' mm' else '' end as collimation from {{raw_headers}}""")
def collimation(spark, d):
    return raw(spark, d).select(*KEY, S.collimation(C("single_width"), C("total_width")).alias("collimation"))


@query("acq_mode", f"""select {K}, case when starts_with(upper(acquisition_type), 'SPIRAL') or (acquisition_type = '' and pitch > 0) then 'hélicoïdal' || case when pitch > 0 then ' (pitch ' || replace(printf('%.3f', round_even(pitch, 3)), '.', ',') || ')' else '' end
  when starts_with(upper(acquisition_type), 'SEQUENCE') then 'axial (séquentiel)' else acquisition_type end as mode from {{raw_headers}}""")
def acq_mode(spark, d):
    return raw(spark, d).select(*KEY, S.acquisition_mode(C("acquisition_type"), C("pitch")).alias("mode"))


_ROTATION = "case when revolution_time > 0 then revolution_time when exposure_time > 0 then exposure_time / 1000.0 else 0.0 end"


@query("tube_load", f"""select {K}, cast(rotation as double) as rotation, cast(case when exposure > 0 then exposure when tube_current > 0 and rotation > 0 then tube_current * rotation else 0.0 end as double) as mas
  from (select *, {_ROTATION} as rotation from {{raw_headers}})""")
def tube_load(spark, d):
    r = S.rotation_time(C("revolution_time"), C("exposure_time"))
    return raw(spark, d).select(*KEY, r.alias("rotation"), S.tube_load(C("exposure"), C("tube_current"), r).alias("mas"))


@query("acq_display", f"""select {K}, case when exposure_time <= 0 or (rotation > 0 and abs(exposure_time / 1000.0 - rotation) < 0.005) then '' else replace(printf('%.2f', round_even(exposure_time / 1000.0, 2)), '.', ',') || ' s' end as exposure_text,
  case when pitch > 0 then replace(printf('%.3f', round_even(pitch, 3)), '.', ',') when starts_with(upper(acquisition_type), 'SEQUENCE') then 'acquisition séquentielle' else '—' end as pitch_text,
  case when ctdi_vol > 0 then replace(printf('%.2f', round_even(ctdi_vol, 2)), '.', ',') || ' mGy' || case when contains(lower(ctdi_meaning), 'head') then ' (tête 16 cm)' when contains(lower(ctdi_meaning), 'body') then ' (corps 32 cm)' when ctdi_meaning <> '' then ' (' || ctdi_meaning || ')' else '' end else '—' end as ctdi_text
  from (select *, {_ROTATION} as rotation from {{raw_headers}})""")
def acq_display(spark, d):
    r = S.rotation_time(C("revolution_time"), C("exposure_time"))
    return raw(spark, d).select(*KEY, S.exposure_time_text(C("exposure_time"), r).alias("exposure_text"), S.pitch_text(C("pitch"), C("acquisition_type")).alias("pitch_text"), S.ctdi_text(C("ctdi_vol"), S.ctdi_phantom(C("ctdi_meaning"))).alias("ctdi_text"))


_IDENTITY = ("manufacturer", "model_name", "station_name", "serial_number")
DEVICE_ID_SQL = "concat_ws('_', " + ", ".join(f"nullif(replace(lower(trim({x})), ' ', '-'), '')" for x in _IDENTITY) + ")"


@query("device_id", f"select s_suppkey, {DEVICE_ID_SQL} as device_id from {{devices}}")
def device_id(spark, d):
    return view(spark, d, "devices").select("s_suppkey", S.device_id(*(C(x) for x in _IDENTITY)).alias("device_id"))


@query("format_fr", """select event_id, replace(printf('%.2f', round_even(value, 2)), '.', ',') as two, replace(printf('%+.1f', round_even(-1 - value, 1)), '.', ',') as signed, printf('%.0f', round_even(value, 0)) as whole from {events}""")
def format_fr(spark, d):
    v = C("value")
    return view(spark, d, "events").select("event_id", S.format_fr(v, 2).alias("two"), S.format_fr(-1 - v, 1, sign=True).alias("signed"), S.format_fr(v, 0).alias("whole"))


@query("parse_fr", "select event_id, try_cast(replace(trim(text), ',', '.') as double) as parsed from (select event_id, case when event_id % 5 = 0 then event_type when event_id % 3 = 0 then ' ' || cast(event_id as varchar) || ',25 ' else cast(event_id as varchar) || '.5' end as text from {events})")
def parse_fr(spark, d):
    i = C("event_id").cast("string")
    text = F.when(C("event_id") % 5 == 0, C("event_type")).when(C("event_id") % 3 == 0, F.concat(F.lit(" "), i, F.lit(",25 "))).otherwise(F.concat(i, F.lit(".5")))
    return view(spark, d, "events").select("event_id", S.parse_fr(text).alias("parsed"))


@query("display_name", """select s_suppkey, coalesce(nullif(concat_ws(' - ', nullif(hospital_name, ''), nullif(coalesce(nullif(device_name, ''), concat_ws(' ', nullif(manufacturer, ''), nullif(model_name, ''))), ''), case when inventory_number <> '' then 'N°inv. ' || inventory_number end), ''), 'Installation sans nom') as name from {devices}""")
def display_name(spark, d):
    return view(spark, d, "devices").select("s_suppkey", S.display_name(C("hospital_name"), C("device_name"), C("manufacturer"), C("model_name"), C("inventory_number")).alias("name"))


@query("run_key")
def run_key(spark, d):
    uid = F.when(C("event_id") % 4 == 0, F.lit("")).otherwise(C("run_id"))
    return view(spark, d, "qc_runs").select("event_id", S.run_key(uid, C("run_date"), C("device_id"), C("event_id"), C("water_ct")).alias("run_key"))


@query("manual_ids")
def manual_ids(spark, d):
    """Scanners without any identity get an id of their own; all others keep theirs."""
    known = S.device_id(C("manufacturer"), C("model_name"), C("station_name"), C("serial_number"))
    return view(spark, d, "devices").select("s_suppkey", F.coalesce(S.blank_to_null(known), S.manual_id(C("s_suppkey"))).alias("device_id"))


@query("freq_axes_2d", "select fmt_id, cast(side as int) as side, cast(k as int) as k, round((k - side // 2) / (side * px), 6) as freq from (select fmt_id, px, side, unnest(range(side)) as k from (select fmt_id, px, 32 + 8 * (fmt_id % 13) as side from {formats}))")
def freq_axes_2d(spark, d):
    """Both axes of a square spectrum are alike."""
    sides = view(spark, d, "formats").select("fmt_id", "px", (32 + 8 * (C("fmt_id") % 13)).cast("int").alias("side"))
    return sides.select("fmt_id", "side", F.posexplode(S.frequency_axis(C("side"), C("px"))).alias("k", "f")).select("fmt_id", "side", "k", F.round("f", 6).alias("freq"))


@query("focal_text", f"""select {K}, case when list_contains([try_cast(x as double) is null for x in string_split(focal_spots, '/')], true) then coalesce(nullif(focal_spots, ''), '—')
  else array_to_string([replace(regexp_replace(cast(cast(x as double) as varchar), '\\.0$', ''), '.', ',') for x in string_split(focal_spots, '/')], ' / ') || ' mm' end as focal from (select *, focal_spots as f from {{raw_headers}})""".replace("cast(cast(x as double) as varchar)", "cast(try_cast(x as double) as varchar)"))
def focal_text(spark, d):
    return raw(spark, d).select(*KEY, S.focal_text(C("focal_spots")).alias("focal"))


def _file_part(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[<>:\"/\\\\|?*\[\]]', '', 'g'), '^\s+|\s+$', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')"


@query("report_filename", f"""select p_partkey, case when {_file_part("regexp_replace(kind, '[()]', '', 'g')")} = '' then 'CQI' else 'CQI-' || {_file_part("regexp_replace(kind, '[()]', '', 'g')")} end || '_' || coalesce(nullif({_file_part("p_name")}, ''), 'Unknown') || '_' || coalesce(nullif({_file_part("inv")}, ''), 'NoInv') || '_' || case when p_size % 3 = 0 then 'date-inconnue' else '2026-03-15' end || '.pdf' as file_name
  from (select *, case when p_size % 2 = 0 then ' semestriel (per-opératoire)' else '' end as kind, case when p_size % 5 = 0 then ' /: ' else '-' || p_brand || ' *?' end as inv from {{part}})""")
def report_filename(spark, d):
    kind = F.when(C("p_size") % 2 == 0, " semestriel (per-opératoire)").otherwise("")
    inventory = F.when(C("p_size") % 5 == 0, " /: ").otherwise(F.concat(F.lit("-"), C("p_brand"), F.lit(" *?")))
    date = F.when(C("p_size") % 3 == 0, "n/a").otherwise("2026-03-15")
    return view(spark, d, "part").select("p_partkey", S.report_filename(C("p_name"), inventory, date, kind).alias("file_name"))


@query("slice_text", f"""select {K}, case when l_linenumber = 3 then 'z = ' || {{{{z}}}} || ' mm' else cast(small_int + 1 as varchar) || case when l_linenumber = 2 then '' else ' / 24' end || ' (z = ' || {{{{z}}}} || ' mm)' end as hu_text,
  case when l_linenumber = 3 then {{{{n}}}} else cast(small_int + 1 as varchar) || ' à ' || cast(small_int + small_int + 1 as varchar) || ' (' || {{{{n}}}} || ')' end as nps_text from {{raw_headers}}""".replace(
    "{{z}}", "replace(printf('%+.1f', round_even(coalesce(position_z, -22.5), 1)), '.', ',')").replace("{{n}}", "cast(small_int as varchar) || ' coupe' || case when small_int > 1 then 's' else '' end || ', z = ' || replace(printf('%+.1f', round_even(coalesce(position_z, -22.5), 1)), '.', ',') || ' à ' || replace(printf('%+.1f', round_even(coalesce(position_z, -22.5) + 45, 1)), '.', ',') || ' mm'"))
def slice_text(spark, d):
    z = F.coalesce("position_z", F.lit(-22.5))
    index = F.when(C("l_linenumber") != 3, C("small_int"))
    total = F.when(C("l_linenumber") != 2, 24)
    return raw(spark, d).select(*KEY, S.hu_slice_text(index, total, z).alias("hu_text"), S.nps_slice_text(index, index + C("small_int"), C("small_int"), z, z + 45).alias("nps_text"))


@query("window_level", "select vec_id, cast(i as int) as i, cast(trunc((least(greatest(cast(embedding[i + 1] as double) * 100, -40.0), 40.0) + 40.0) / 80.0 * 255) as int) as grey from {embeddings}, range(64) t(i)")
def window_level(spark, d):
    hu = F.transform("embedding", lambda x: x.cast("double") * 100)
    return view(spark, d, "embeddings").select("vec_id", F.posexplode(S.window_level(hu, 80.0, 0.0)).alias("i", "grey"))


@query("freq_axis", "select fmt_id, cast(k as int) as ring, round(k / (side * px), 6) as freq from (select fmt_id, px, side, unnest(range(cast(trunc(side // 2 * 1.375) as int) + 1)) as k from (select fmt_id, px, 32 + 8 * (fmt_id % 13) as side from {formats}))")
def freq_axis(spark, d):
    sides = view(spark, d, "formats").select("fmt_id", "px", (32 + 8 * (C("fmt_id") % 13)).cast("int").alias("side"))
    last = (F.floor(C("side") / 2) * F.lit(1.375)).cast("int")
    return sides.select("fmt_id", "side", "px", F.explode(F.sequence(F.lit(0), last)).alias("ring")).select("fmt_id", "ring", F.round(C("ring") / (C("side") * C("px")), 6).alias("freq"))


@query("water_ct_status", "select event_id, case when abs(water_ct) <= 7 then 'ok' when abs(abs(water_ct) - 25) <= 1e-9 then 'nc_or_ncg' when abs(water_ct) < 25 then 'nc' else 'ncg' end as status from {qc_runs}")
def water_ct_status(spark, d):
    return view(spark, d, "qc_runs").select("event_id", R.water_ct_status(C("water_ct")).alias("status"))


@query("uniformity_status", "select event_id, case when abs(uniformity) <= 7 then 'ok' else 'nc' end as status from {qc_runs}")
def uniformity_status(spark, d):
    return view(spark, d, "qc_runs").select("event_id", R.uniformity_status(C("uniformity")).alias("status"))


_CT = "case when abs(water_ct) <= 7 then 'ok' when abs(abs(water_ct) - 25) <= 1e-9 then 'nc_or_ncg' when abs(water_ct) < 25 then 'nc' else 'ncg' end"
_UNI = "case when abs(uniformity) <= 7 then 'ok' else 'nc' end"
_NOISE = "case when noise is null or ref_noise is null then 'pending' when noise - ref_noise between least(-0.2, -0.1 * ref_noise) - 1e-9 and greatest(0.2, 0.1 * ref_noise) + 1e-9 then 'ok' else 'nc' end"
_NPS = "case when nps_freq is null or ref_nps_freq is null or ref_nps_freq = 0 then 'pending' when nps_freq between 0.9 * ref_nps_freq - 1e-9 and 1.1 * ref_nps_freq + 1e-9 then 'ok' else 'nc' end"
_ART = "case when artifacts_present is null then 'pending' when artifacts_present then 'nc' else 'ok' end"
VERDICT_SQL = f"""(select *, case when list_contains(s, 'ncg') then 'ncg' when list_contains(s, 'nc_or_ncg') then 'nc_or_ncg' when list_contains(s, 'nc') then 'nc'
   when len(list_filter(s, lambda x: x <> 'pending')) = 0 then 'pending' when len(list_filter(s, lambda x: x <> 'pending')) = 5 then 'ok' else 'incomplete' end as overall
  from (select *, [water_ct_status, uniformity_status, noise_status, nps_freq_status, artifacts_status] as s
    from (select *, {_CT} as water_ct_status, {_UNI} as uniformity_status, {_NOISE} as noise_status, {_NPS} as nps_freq_status, {_ART} as artifacts_status from {{qc_runs}})))"""
STATUS_COLUMNS = ("water_ct_status", "uniformity_status", "noise_status", "nps_freq_status", "artifacts_status", "overall")


def judged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recorded controls with the status of each test and the verdict."""
    return view(spark, sf_dir, "qc_runs").withColumns(R.statuses())


@query("noise_status", f"select event_id, {_NOISE} as status from {{qc_runs}}")
def noise_status(spark, d):
    return view(spark, d, "qc_runs").select("event_id", R.noise_status(C("noise"), C("ref_noise")).alias("status"))


@query("nps_status", f"select event_id, {_NPS} as status from {{qc_runs}}")
def nps_status(spark, d):
    return view(spark, d, "qc_runs").select("event_id", R.nps_status(C("nps_freq"), C("ref_nps_freq")).alias("status"))


@query("verdict", f"select event_id, device_id, {', '.join(STATUS_COLUMNS)} from {VERDICT_SQL}")
def verdict(spark, d):
    return judged_runs(spark, d).select("event_id", "device_id", *STATUS_COLUMNS)


@query("verdict_counts", f"select device_id, overall, count(*) as n from {VERDICT_SQL} group by 1, 2")
def verdict_counts(spark, d):
    return judged_runs(spark, d).groupBy("device_id", "overall").agg(F.count("*").alias("n"))


def _words(words: dict[str, str], column: str) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v.replace(chr(39), chr(39) * 2)}'" for k, v in words.items()) + " else '' end"


@query("status_labels", f"select event_id, {_words(R.LABELS, 'overall')} as label, {_words(R.SHORT, 'overall')} as short, {_words(R.ACTIONS, 'overall')} as action, {_words(R.VERDICTS, 'overall')} as wording from {VERDICT_SQL}")
def status_labels(spark, d):
    o = C("overall")
    return judged_runs(spark, d).select("event_id", *(R.worded(o, words).alias(n) for n, words in (("label", R.LABELS), ("short", R.SHORT), ("action", R.ACTIONS), ("wording", R.VERDICTS))))


def _reason(test: str) -> str:
    text = R.REASONS[test].replace("'", "''")
    if test == "noise":
        text = f"case when noise is null then '{R.NOISE_NOT_MEASURED}' else '{text}' end"
    elif test == "nps_freq":
        text = f"case when nps_freq is null then '{R.NPS_NOT_MEASURED}' else '{text}' end"
    else:
        text = f"'{text}'"
    return f"case when {test}_status = 'pending' then {text} end"


@query("pending_reasons", f"select event_id, array_to_string(list_filter([{', '.join(_reason(x) for x in R.TESTS)}], lambda x: x is not null), ' ; ') as reasons from {VERDICT_SQL}")
def pending_reasons(spark, d):
    status = {x: C(f"{x}_status") for x in R.TESTS}
    return judged_runs(spark, d).select("event_id", F.array_join(R.pending_reasons(status, C("noise"), C("nps_freq")), " ; ").alias("reasons"))


BANDS_SQL = """(select device_id, event_id, metric,
   case metric when 'water_ct' then -7.0 when 'uniformity' then 0.0 when 'noise' then ref_noise + least(-0.2, -0.1 * ref_noise) else case when ref_nps_freq <> 0 then 0.9 * ref_nps_freq end end as low,
   case metric when 'water_ct' then 7.0 when 'uniformity' then 7.0 when 'noise' then ref_noise + greatest(0.2, 0.1 * ref_noise) else case when ref_nps_freq <> 0 then 1.1 * ref_nps_freq end end as high,
   case metric when 'noise' then ref_noise when 'nps_freq' then case when ref_nps_freq <> 0 then ref_nps_freq end end as reference
  from {qc_runs}, (values ('water_ct'), ('uniformity'), ('noise'), ('nps_freq')) m(metric))"""


@query("tolerance_band", f"select event_id, metric, round(low, 6) as low, round(high, 6) as high, round(reference, 6) as reference from {BANDS_SQL}")
def tolerance_band(spark, d):
    metrics = F.explode(F.array(*map(F.lit, ("water_ct", "uniformity", "noise", "nps_freq")))).alias("metric")
    rows = view(spark, d, "qc_runs").select("event_id", "ref_noise", "ref_nps_freq", metrics).withColumn("b", R.tolerance_band(C("metric"), C("ref_noise"), C("ref_nps_freq")))
    return rows.select("event_id", "metric", *(F.round(C(f"b.{x}"), 6).alias(x) for x in ("low", "high", "reference")))


_TEST_SQL = {
    "water_ct": ("water_ct", "null", "-7.0", "7.0"), "uniformity": ("uniformity", "null", "null", "7.0"),
    "noise": ("noise", "ref_noise", "ref_noise + least(-0.2, -0.1 * ref_noise)", "ref_noise + greatest(0.2, 0.1 * ref_noise)"),
    "nps_freq": ("nps_freq", "ref_nps_freq", "0.9 * ref_nps_freq", "1.1 * ref_nps_freq"),
    "artifacts": ("cast(artifacts_present as int)", "null", "null", "0.0"),
}


@query("test_summary", " union all ".join(f"select event_id, '{t}' as test, round(cast({v} as double), 6) as measured, round(cast({r} as double), 6) as reference, round(cast({lo} as double), 6) as low, round(cast({hi} as double), 6) as high, {t}_status as status from {VERDICT_SQL}" for t, (v, r, lo, hi) in _TEST_SQL.items()))
def test_summary(spark, d):
    """Five rows per control: measured, reference, bounds of the criterion, status."""
    n_low, n_high = R.noise_bounds(C("ref_noise"))
    f_low, f_high = R.nps_bounds(C("ref_nps_freq"))
    none = F.lit(None).cast("double")
    rows = {
        "water_ct": (C("water_ct"), none, F.lit(-7.0), F.lit(7.0)),
        "uniformity": (C("uniformity"), none, none, F.lit(7.0)),
        "noise": (C("noise"), C("ref_noise"), C("ref_noise") + n_low, C("ref_noise") + n_high),
        "nps_freq": (C("nps_freq"), C("ref_nps_freq"), f_low, f_high),
        "artifacts": (C("artifacts_present").cast("int").cast("double"), none, none, F.lit(0.0)),
    }
    names = ("measured", "reference", "low", "high")
    each = [F.struct(F.lit(t).alias("test"), *(F.round(x, 6).alias(n) for n, x in zip(names, v, strict=True)), C(f"{t}_status").alias("status")) for t, v in rows.items()]
    return judged_runs(spark, d).select("event_id", F.explode(F.array(*each)).alias("t")).select("event_id", "t.*")


CLASS_SQL = """case
  when trim(modality) <> '' and upper(trim(modality)) <> 'CT' then 'skipped|modalité ' || upper(trim(modality)) || ' : ce n''est pas une image de tomodensitométrie'
  when sop_class = '1.2.840.10008.5.1.4.1.1.2.1' then 'error|format Enhanced CT (plusieurs coupes par fichier) non pris en charge : exportez la série au format CT classique'
  when sop_class <> '' and sop_class <> '1.2.840.10008.5.1.4.1.1.2' then 'skipped|objet DICOM qui n''est pas une coupe TDM (rapport de dose, capture d''écran…)'
  when contains(upper(image_type), 'LOCALIZER') then 'skipped|topogramme (image de repérage)'
  when abs(orient_rx * orient_cy) < 0.9 then 'skipped|coupe non axiale (reconstruction coronale, sagittale ou oblique)'
  when trim(lossy) = '01' then 'error|image compressée avec perte : la décision ANSM exige des images non compressées ou décompressées sans perte'
  when not single_plane then 'error|image à plusieurs plans' end"""


@query("ct_slice_class", f"select {K}, split_part(c, '|', 1) as kind, split_part(c, '|', 2) as reason from (select *, coalesce({CLASS_SQL}, 'ok|') as c from {{raw_headers}})")
def ct_slice_class(spark, d):
    from phantomlake.operators.catalogue import slice_class

    found = slice_class(C("modality"), C("sop_class"), C("image_type"), C("orient_rx"), F.lit(0.0), F.lit(0.0), C("orient_cy"), C("lossy"), C("single_plane"))
    return raw(spark, d).withColumn("c", found).select(*KEY, "c.kind", "c.reason")


@query("deviations", "select event_id, round(noise - ref_noise, 6) as noise_hu, round(case when ref_noise <> 0 then (noise - ref_noise) / ref_noise * 100 end, 6) as noise_percent, round(case when ref_nps_freq <> 0 then (nps_freq - ref_nps_freq) / ref_nps_freq * 100 end, 6) as nps_percent from {qc_runs}")
def deviations(spark, d):
    share = lambda v, r: F.round(F.when(C(r) != 0, (C(v) - C(r)) / C(r) * 100), 6)
    return view(spark, d, "qc_runs").select("event_id", F.round(C("noise") - C("ref_noise"), 6).alias("noise_hu"), share("noise", "ref_noise").alias("noise_percent"), share("nps_freq", "ref_nps_freq").alias("nps_percent"))


@query("control_warnings", """select event_id, array_to_string(list_filter([case when not hu_detected then 'fantôme non détecté sur la coupe UH' end, case when nps_freq is not null and not nps_detected then 'fantôme non détecté sur la coupe médiane de la plage SPB' end,
  case when n_slices < 10 then 'Seulement ' || cast(n_slices as varchar) || ' coupe(s) utilisée(s).' end], lambda x: x is not null), ' ; ') as warnings from {qc_runs}""")
def control_warnings(spark, d):
    texts = F.array(
        F.when(~C("hu_detected"), "fantôme non détecté sur la coupe UH"),
        F.when(C("nps_freq").isNotNull() & ~C("nps_detected"), "fantôme non détecté sur la coupe médiane de la plage SPB"),
        F.when(C("n_slices") < 10, F.concat(F.lit("Seulement "), C("n_slices").cast("string"), F.lit(" coupe(s) utilisée(s)."))),
    )
    return view(spark, d, "qc_runs").select("event_id", F.array_join(F.filter(texts, lambda x: x.isNotNull()), " ; ").alias("warnings"))
