"""Queries over the history of recorded controls."""

from __future__ import annotations

from pyspark.sql import functions as F

from phantomlake.functions import rules as R
from phantomlake.functions import scalars as S
from phantomlake.operators import devices, history
from phantomlake.plans.registry import query
from phantomlake.plans.scalar_queries import BANDS_SQL, VERDICT_SQL, judged_runs
from phantomlake.sources.views import view

C = F.col

UPSERT_SQL = """(select * exclude (corrective_action, corrective_action_date, rk, n, a, ad), coalesce(a, '') as corrective_action, coalesce(ad, '') as corrective_action_date, n > 1 as replaced from (
  select *, row_number() over (partition by device_id, run_id order by event_id) as rk, count(*) over (partition by device_id, run_id) as n,
    last_value(case when corrective_action <> '' or corrective_action_date <> '' then corrective_action end ignore nulls) over w as a,
    last_value(case when corrective_action <> '' or corrective_action_date <> '' then corrective_action_date end ignore nulls) over w as ad
  from {qc_runs} window w as (partition by device_id, run_id order by event_id rows between unbounded preceding and current row)) where rk = n)"""


@query("run_upsert", f"select event_id, device_id, run_id, corrective_action, corrective_action_date, replaced from {UPSERT_SQL}")
def run_upsert(spark, d):
    return history.upsert(view(spark, d, "qc_runs")).select("event_id", "device_id", "run_id", "corrective_action", "corrective_action_date", "replaced")


@query("recent_runs", f"select device_id, event_id, cast(rk as int) as rank, overall from (select *, row_number() over (partition by device_id order by run_date desc, recorded_at desc, event_id desc) as rk from {VERDICT_SQL}) where rk <= 10")
def recent_runs(spark, d):
    return history.recent(judged_runs(spark, d)).select("device_id", "event_id", "rank", "overall")


@query("last_control_type", "select device_id, coalesce(arg_max(control_type, (run_date, recorded_at, event_id)) filter (control_type <> ''), 'trimestriel') as control_type from {qc_runs} group by 1")
def last_control_type(spark, d):
    return history.last_control_type(view(spark, d, "qc_runs"))


@query("history_summary", f"select device_id, count(*) as n, count(*) filter (overall in ('nc', 'ncg', 'nc_or_ncg')) as n_bad, strftime(min(run_date), '%m/%Y') as since, max(run_date) as last_date from {VERDICT_SQL} group by 1")
def history_summary(spark, d):
    return history.summary(judged_runs(spark, d))


@query("trend_points", " union all ".join(f"select device_id, event_id, run_date, '{m}' as metric, {m} as value, {m}_status as status from {VERDICT_SQL} where {m} is not null and run_date is not null" for m in history.METRICS))
def trend_points(spark, d):
    return history.trend_points(view(spark, d, "qc_runs"))


_SOME = {"nps_freq": "(case when event_id % 4 = 0 and length(device_id) % 2 = 1 then nps_freq end)"}


@query("trend_bands", f"""select b.device_id, b.metric, low, high, reference, case when metric = 'water_ct' then cast(-25.0 as double) end as line_low, case when metric = 'water_ct' then cast(25.0 as double) end as line_high, cast(a - pad as date) as from_date, cast(z + pad as date) as to_date
  from (select device_id, event_id, metric, low, high, reference from {BANDS_SQL}) b join (select device_id, max(event_id) as event_id from {{qc_runs}} group by 1) using (device_id, event_id)
  left join (select *, cast(case when z - a < 180 then greatest(45, (180 - (z - a)) // 2) else (z - a) // 20 end as int) as pad from (select device_id, metric, min(run_date) as a, max(run_date) as z from (
    {" union all ".join(f"select device_id, run_date, '{m}' as metric from {{qc_runs}} where run_date is not null and {_SOME.get(m, m)} is not null" for m in history.METRICS)}) group by 1, 2)) s using (device_id, metric)""")
def trend_bands(spark, d):
    """The references in force are those of the device's last recorded control. Frequencies count for some devices only,
    and for those on some days."""
    runs = view(spark, d, "qc_runs").withColumn("nps_freq", F.when((C("event_id") % 4 == 0) & (F.length("device_id") % 2 == 1), C("nps_freq")))
    last = runs.groupBy("device_id").agg(F.max_by(F.struct("ref_noise", "ref_nps_freq"), "event_id").alias("r")).select("device_id", "r.*")
    return history.trend_bands(runs, last)


def _csv(english: bool) -> str:
    sep = "," if english else ";"
    number = lambda x, n: f"coalesce({'' if english else 'replace('}printf('%.{n}f', round_even(cast(cast({x} as varchar) as decimal(38, 20)), {n})){'' if english else chr(44) + chr(39) + '.' + chr(39) + ',' + chr(39) + ',' + chr(39) + ')'}, '')"
    quoted = lambda x: f"case when regexp_matches({x}, '[{sep}\"]') then '\"' || replace({x}, '\"', '\"\"') || '\"' else {x} end"
    short = "case overall " + " ".join(f"when '{k}' then '{v}'" for k, v in R.SHORT.items()) + " end"
    cells = ["coalesce(cast(run_date as varchar), '')", number("kvp", 0), number("mas", 0), number("water_ct", 1), number("uniformity", 1), number("noise", 2), number("ref_noise", 2), number("nps_freq", 3), number("ref_nps_freq", 3), "coalesce(cast(cast(artifacts_present as int) as varchar), '')", short, "corrective_action_date", "corrective_action", "notes", "coalesce(pdf_path, '')"]
    return f"select event_id, concat_ws('{sep}', {', '.join(map(quoted, cells))}) as line from {VERDICT_SQL}"


@query("history_csv_fr", _csv(False))
def history_csv_fr(spark, d):
    return history.csv_lines(judged_runs(spark, d)).select("event_id", "line")


@query("history_csv_en", _csv(True))
def history_csv_en(spark, d):
    return history.csv_lines(judged_runs(spark, d), english=True).select("event_id", "line")


_LATEST = "select device_id, arg_max(noise, event_id) filter (noise is not null) as noise, arg_max(nps_freq, event_id) filter (nps_freq is not null and event_id % 2 = 0) as nps_freq from {qc_runs} group by 1"


def latest_values(spark, d):
    """What each device measured last, as references in force."""
    runs = view(spark, d, "qc_runs")
    freq = F.when(C("nps_freq").isNotNull() & (C("event_id") % 2 == 0), C("event_id"))
    return runs.groupBy("device_id").agg(F.max_by("noise", F.when(C("noise").isNotNull(), C("event_id"))).alias("noise"), F.max_by("nps_freq", freq).alias("nps_freq"))


@query("freeze_refs", f"select event_id, r.noise as ref_noise, r.nps_freq as ref_nps_freq from {{qc_runs}} q left join ({_LATEST}) r on q.device_id = r.device_id and r.noise > 5")
def freeze_refs(spark, d):
    return devices.with_references(view(spark, d, "qc_runs"), latest_values(spark, d).filter("noise > 5")).select("event_id", "ref_noise", "ref_nps_freq")


@query("freeze_geometry", "select device_id, arg_min(hu_slice, (run_date, recorded_at, event_id)) as geometry, cast(min(run_date) as date) as frozen_date from {qc_runs} where hu_detected group by 1")
def freeze_geometry(spark, d):
    """The slice number stands for the geometry of a control."""
    return devices.freeze_geometry(view(spark, d, "qc_runs").withColumn("geometry", C("hu_slice")))


@query("reference_eligible", "select device_id, event_id from {qc_runs} where noise is not null and nps_freq is not null and hu_detected and nps_detected and run_date is not null")
def reference_eligible(spark, d):
    return history.reference_eligible(view(spark, d, "qc_runs")).select("device_id", "event_id")


@query("set_references", """select device_id, b.ref_noise as noise_before, c.noise as noise_after, b.ref_nps_freq as nps_before, coalesce(c.nps_freq, b.ref_nps_freq) as nps_after, b.geometry as geometry_before, coalesce(c.geometry, b.geometry) as geometry_after
  from (select device_id, ref_noise, ref_nps_freq, 'r' || hu_slice as geometry from (select *, row_number() over (partition by device_id order by event_id) as rk from {qc_runs}) where rk = 1) b
  join (select device_id, noise, case when event_id % 3 <> 0 then nps_freq end as nps_freq, case when event_id % 2 = 0 then 'r' || hu_slice end as geometry from (select *, row_number() over (partition by device_id order by event_id desc) as rk from {qc_runs} where noise is not null) where rk = 1) c using (device_id)""")
def set_references(spark, d):
    """The references of a device's first control give way to its last measured one, which has no frequency every third
    time and no geometry every second. The text of a slice number stands for a geometry."""
    runs = view(spark, d, "qc_runs").withColumn("geometry", F.concat(F.lit("r"), C("hu_slice")))
    old = runs.groupBy("device_id").agg(F.min_by(F.struct("ref_noise", "ref_nps_freq", "geometry"), "event_id").alias("r")).select("device_id", "r.*")
    freq, own = F.when(C("event_id") % 3 != 0, C("nps_freq")).alias("nps_freq"), F.when(C("event_id") % 2 == 0, C("geometry")).alias("geometry")
    new = runs.filter("noise is not null").groupBy("device_id").agg(F.max_by(F.struct("noise", freq, own), "event_id").alias("n")).select("device_id", "n.*")
    return devices.set_references(old, new)


@query("corrective_actions", "select device_id, event_id, run_date, corrective_action_date, corrective_action from {qc_runs} where corrective_action <> '' or corrective_action_date <> ''")
def corrective_actions(spark, d):
    return history.corrective_actions(view(spark, d, "qc_runs"))


def _fr(x: str, n: int) -> str:
    return f"replace(printf('%.{n}f', round_even(cast(cast({x} as varchar) as decimal(38, 20)), {n})), '.', ',')"


#: Equipment of every scanner dev-k, header values of the images of control k, as both sides of register_extract read them.
_EQUIPMENT = """select 'dev-' || s_suppkey as device_id, manufacturer, model_name, serial_number, hospital_name, inventory_number,
  case when s_suppkey % 3 = 0 then '' else 'Salle ' || s_suppkey % 9 end as hospital_location, case when s_suppkey % 4 = 3 then null else '0' || (1 + s_suppkey % 9) || '/2019' end as commissioning_date,
  case when s_suppkey % 2 = 0 then 'Brand' else '' end as phantom_brand, case when s_suppkey % 3 = 0 then '' else 'Model ' || s_suppkey % 3 end as phantom_model, case when s_suppkey % 5 < 2 then '' else 'P' || s_suppkey end as phantom_serial,
  case when s_suppkey % 7 = 0 then null else 'Crâne ' || s_suppkey % 7 end as clinical_protocol_origin, case when s_suppkey % 6 = 0 then '' else 'niveau ' || s_suppkey % 6 end as reconstruction_algorithm from {devices}"""
_IMAGES = """select h.series_uid as event_id, h.series_uid, description, h.kvp, h.tube_current, h.tube_current / 2 as mas, cast(0.5 as double) as rotation_time, px, n_rows, slice_location as z,
  acquisition_type, pitch, single_width, total_width, focal_spots, r.kernel, case when h.series_uid % 4 = 0 then cast(0.0 as double) else cast(0.5 + h.series_uid % 5 as double) end as slice_thickness, ctdi_vol, ctdi_meaning,
  case when h.series_uid % 3 = 0 then null else cast(h.series_uid % 11 as int) end as nps_start, case when h.series_uid % 3 = 0 then null else cast(h.series_uid % 11 + h.series_uid % 2 * 9 as int) end as nps_end, slice_location - 20 as z_first, slice_location + 25 as z_last,
  case when h.series_uid % 5 = 0 then '' else '/archive/' || h.series_uid end as folder
  from {headers} h join {raw_headers} r on r.l_orderkey = h.series_uid and r.l_linenumber = 1 where instance_number = 1"""
_NUMBER = "replace(regexp_replace(cast({} as varchar), '\\.0$', ''), '.', ',')"


def _register_sql() -> str:
    given = lambda x: f"coalesce(nullif(trim({x}), ''), 'Non renseigné')"
    shown = lambda x: f"coalesce(nullif(trim({x}), ''), '—')"
    signed = lambda x: f"case when round_even({x}, 1) >= 0 then '+' else '' end || {_fr(x, 1)}"
    mode = f"case when starts_with(upper(acquisition_type), 'SPIRAL') or (acquisition_type = '' and pitch > 0) then 'hélicoïdal' || case when pitch > 0 then ' (pitch ' || {_fr('pitch', 3)} || ')' else '' end when starts_with(upper(acquisition_type), 'SEQUENCE') then 'axial (séquentiel)' else acquisition_type end"
    single, total = _NUMBER.format("single_width"), _NUMBER.format("total_width")
    collimation = f"case when single_width > 0 and total_width > 0 then cast(cast(round_even(total_width / single_width, 0) as int) as varchar) || ' × ' || {single} || ' mm' when single_width > 0 then {single} || ' mm' when total_width > 0 then {total} || ' mm' else '' end"
    spots = f"case when focal_spots is null then '—' when list_contains([try_cast(x as double) is null for x in string_split(focal_spots, '/')], true) then coalesce(nullif(focal_spots, ''), '—') else array_to_string([{_NUMBER.format('try_cast(x as double)')} for x in string_split(focal_spots, '/')], ' / ') || ' mm' end"
    meaning = "case when contains(lower(ctdi_meaning), 'head') then 'tête 16 cm' when contains(lower(ctdi_meaning), 'body') then 'corps 32 cm' else ctdi_meaning end"
    maker = "concat_ws(' ', nullif(phantom_brand, ''), nullif(phantom_model, ''))"
    phantom = f"case when coalesce(phantom_serial, '') = '' then {maker} when {maker} = '' then 'n° série ' || phantom_serial else {maker} || ' (n° série ' || phantom_serial || ')' end"
    return f"""select event_id, q.device_id, case when run_date is null then 'date inconnue' else strftime(run_date, '%d/%m/%Y') end as day, coalesce(nullif(control_type, ''), 'trimestriel') as control_type,
  {", ".join(f"{given(x)} as {x}" for x in ("hospital_name", "hospital_location", "serial_number", "inventory_number", "commissioning_date", "clinical_protocol_origin", "reconstruction_algorithm", "folder"))},
  {shown("manufacturer")} as manufacturer, {shown("model_name")} as model_name, coalesce(nullif({phantom}, ''), 'Non renseigné') as phantom, {shown("description")} as protocol,
  case when h.kvp > 0 then printf('%.0f', h.kvp) else '—' end as kvp_text, case when tube_current > 0 then printf('%.0f', tube_current) else '—' end as ma_text, case when h.mas > 0 then {_fr("h.mas", 0)} else '—' end as mas_text,
  case when rotation_time > 0 then {_fr("rotation_time", 2)} || ' s' else '—' end as rotation_text, {shown(mode)} as mode, {shown(collimation)} as collimation, {spots} as focal_text, {shown("array_to_string([trim(x) for x in string_split(kernel, chr(92))], '/')")} as kernel,
  case when slice_thickness > 0 then {_fr("slice_thickness", 1)} || ' mm' else '—' end as thickness_text, case when px > 0 then {_fr("px", 3)} || ' mm' else '—' end as pixel_text, case when n_rows > 0 then n_rows || ' × ' || n_rows else '—' end as matrix_text, case when n_rows > 0 then printf('%.0f', n_rows * px) || ' mm' else '—' end as fov_text,
  case when ctdi_vol > 0 then {_fr("ctdi_vol", 2)} || ' mGy' || coalesce(' (fantôme ' || nullif({meaning}, '') || ')', '') else '—' end as ctdi_text,
  case when z is null then '—' else (hu_slice + 1) || case when n_slices > 0 then ' / ' || n_slices else '' end || ' (z = ' || {signed("z")} || ' mm) — nombre CT, uniformité' end as hu_slice_text,
  case when nps_start is null then 'SPB non calculé' else (nps_start + 1) || ' à ' || (nps_end + 1) || ' (' || (nps_end - nps_start + 1) || ' coupe' || case when nps_end > nps_start then 's' else '' end || ', z = ' || {signed("z_first")} || ' à ' || {signed("z_last")} || ' mm) — bruit, SPB' end as nps_slice_text,
  coalesce(cast(series_uid as varchar), '—') as series_uid, overall
  from (select * exclude (kvp, mas) from {VERDICT_SQL}) q left join ({_EQUIPMENT}) e on e.device_id = q.device_id left join ({_IMAGES}) h using (event_id)"""


@query("register_extract", _register_sql())
def register_extract(spark, d):
    """Supplier k stands for the scanner dev-k, order k for the images of control k; others have neither."""
    known = {x: view(spark, d, x) for x in ("devices", "headers", "raw_headers")}
    images = spark.sql(_IMAGES, **{x: known[x] for x in ("headers", "raw_headers")})
    texts = {"mode": S.acquisition_mode(C("acquisition_type"), C("pitch")), "collimation": S.collimation(C("single_width"), C("total_width")), "kernel": S.multivalue(C("kernel")), "ctdi_phantom": S.ctdi_phantom(C("ctdi_meaning"))}
    return history.register_extract(judged_runs(spark, d), spark.sql(_EQUIPMENT, devices=known["devices"]), images.withColumns(texts))


@query("record_controls", f"""select device_id, run_id, run_date, noise, ref_noise, ref_nps_freq, corrective_action, replaced from (select u.* exclude (ref_noise, ref_nps_freq), r.noise as ref_noise, r.nps_freq as ref_nps_freq from {UPSERT_SQL} u left join ({_LATEST}) r using (device_id))""")
def record_controls(spark, d):
    """New controls with the references in force, upserted into the history."""
    runs = devices.with_references(view(spark, d, "qc_runs"), latest_values(spark, d))
    return history.upsert(runs).select("device_id", "run_id", "run_date", "noise", "ref_noise", "ref_nps_freq", "corrective_action", "replaced")
