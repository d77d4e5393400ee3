"""Queries over the slice catalogue and over archive paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phantomlake.functions import scalars as S
from phantomlake.operators import archive, catalogue, devices, pixels, selection
from phantomlake.plans.registry import query
from phantomlake.plans.scalar_queries import CLASS_SQL, DEVICE_ID_SQL
from phantomlake.sources.views import dealt, view

C = F.col


@query("candidate_files", r"""select page_id, not (starts_with(name, '.') or name in ('dicomdir', 'thumbs.db', 'desktop.ini') or regexp_extract(name, '[^.](\.[^.]+)$', 1) in ('.txt', '.pdf', '.xml', '.json', '.png', '.jpg', '.jpeg', '.csv', '.zip', '.html', '.bak', '.ini', '.db', '.log', '.tmp')) as candidate
  from (select page_id, lower(regexp_extract(url, '([^/\\]*)$', 1)) as name from {pages})""")
def candidate_files(spark, d):
    return view(spark, d, "pages").select("page_id", catalogue.is_candidate(C("url")).alias("candidate"))


_WITH_HEADER = ("lineitem", "orders", "pages", "documents")
_TABLES = ("region", "nation", "customer", "supplier", "part", "events", "embeddings", "benchmark", "labels", "conversations", *_WITH_HEADER)


@query("folder_scan", " union all ".join(f"select '{t}' as name, true as candidate, '{'ok' if t in _WITH_HEADER else 'error'}' as kind, '{'' if t in _WITH_HEADER else pixels.UNREADABLE}' as reason, {'n' if t in _WITH_HEADER else 'cast(null as bigint)'} as n_rows from (select count(*) as n from {{{t}}})" for t in _TABLES))
def folder_scan(spark, d):
    """The files of the folder that holds the tables: candidates by their names alone, then those with a header (here: rows
    that can be counted without reading a column), all others as unreadable."""
    files = pixels.scan_files(spark, d)
    rows = [view(spark, d, t).select(pixels.plain_path(C("_metadata.file_path")).alias("path")) for t in _WITH_HEADER]
    headers = reduce(DataFrame.unionByName, rows).groupBy("path").agg(F.count("*").alias("n_rows"))
    report = pixels.scan_report(files, headers, F.struct(F.lit("ok").alias("kind"), F.lit("").alias("reason"))).join(headers, "path", "left")
    name = F.regexp_extract("path", r"/([a-z]+)\.parquet(/[^/]*)?$", 1)
    return report.groupBy(name.alias("name")).agg(F.lit(True).alias("candidate"), F.max("kind").alias("kind"), F.max("reason").alias("reason"), F.sum("n_rows").alias("n_rows"))


def classified(spark, d):
    found = catalogue.slice_class(C("modality"), C("sop_class"), C("image_type"), C("orient_rx"), F.lit(0.0), F.lit(0.0), C("orient_cy"), C("lossy"), C("single_plane"))
    rows = view(spark, d, "raw_headers").withColumn("c", found).withColumn("s", S.pixel_spacing(C("spacing_row"), C("spacing_col")))
    bad_px = (C("c.kind") == "ok") & ~C("s.ok")
    rows = rows.withColumn("kind", F.when(bad_px, "error").otherwise(C("c.kind"))).withColumn("reason", F.when(bad_px, C("s.reason")).otherwise(C("c.reason")))
    path = F.concat_ws("/", C("l_orderkey").cast("string"), C("l_linenumber").cast("string"), C("l_partkey").cast("string"))
    return rows.withColumn("file_path", path)


_CLASSIFIED = f"""(select *, l_orderkey || '/' || l_linenumber || '/' || l_partkey as file_path, split_part(c, '|', 1) as kind, split_part(c, '|', 2) as reason from (select *, coalesce({CLASS_SQL},
  case when spacing_row is null or spacing_col is null then 'error|taille de pixel absente (champ DICOM PixelSpacing)'
  when not (spacing_row > 0 and spacing_col > 0) then 'error|taille de pixel invalide (PixelSpacing = ' || regexp_replace(cast(spacing_row as varchar), '\\.0$', '') || ' × ' || regexp_replace(cast(spacing_col as varchar), '\\.0$', '') || ' mm)'
  when abs(spacing_row - spacing_col) > 0.001 * greatest(spacing_row, spacing_col) then 'error|pixels non carrés (' || regexp_replace(cast(spacing_row as varchar), '\\.0$', '') || ' × ' || regexp_replace(cast(spacing_col as varchar), '\\.0$', '') || ' mm) non pris en charge' end, 'ok|') as c from {{raw_headers}}))"""


@query("slice_scan", f"select file_path, kind, reason from {_CLASSIFIED}")
def slice_scan(spark, d):
    """Every file with its fate: accepted, skipped as expected, or a problem, and why."""
    return classified(spark, d).select("file_path", "kind", "reason")


@query("reject_summary", f"""select kind, reason, n, cast(rank as int) as rank from (select kind, reason, n, row_number() over (partition by kind order by n desc, first_file) as rank
  from (select kind, reason, count(*) as n, min(file_path) as first_file from {_CLASSIFIED} where kind <> 'ok' group by 1, 2)) where rank <= 4""")
def reject_summary(spark, d):
    return catalogue.reject_summary(classified(spark, d).filter("kind <> 'ok'")).select("kind", "reason", "n", "rank")


_INVENTORY = """(select folder_id, series_uid, count(*) as n_slices, arg_min(series_number, file_path) as series_number, arg_min(description, file_path) as description from {headers} group by 1, 2)"""


@query("series_inventory", f"select *, 'Série ' || series_number || ' — ' || description || ' — ' || n_slices || ' coupe(s)' as label from {_INVENTORY}")
def series_inventory(spark, d):
    rows = catalogue.series_inventory(view(spark, d, "headers"))
    return rows.withColumn("label", catalogue.series_label(C("series_number"), C("description"), C("n_slices")))


_MAJORITY = """(select series_uid, n_rows, px4 as px, n from (select *, row_number() over (partition by series_uid order by n desc, f) as rk from
   (select series_uid, n_rows, round(px, 4) as px4, count(*) as n, min(file_path) as f from {headers} group by 1, 2, 3)) where rk = 1)"""


@query("majority_format", f"select * from {_MAJORITY}")
def majority_format(spark, d):
    return catalogue.majority_format(view(spark, d, "headers"))


@query("format_filter", f"select h.file_path, h.n_rows = m.n_rows and round(h.px, 4) = m.px as accepted from {{headers}} h join {_MAJORITY} m using (series_uid)")
def format_filter(spark, d):
    return catalogue.format_filter(view(spark, d, "headers")).select("file_path", "accepted")


_ORDERED = "(select *, cast(row_number() over (partition by series_uid order by slice_location, instance_number, file_path) - 1 as int) as slice_idx, count(*) over (partition by series_uid) as n_slices from {headers})"


@query("slice_order", f"select file_path, series_uid, slice_idx from {_ORDERED}")
def slice_order(spark, d):
    return catalogue.slice_order(view(spark, d, "headers")).select("file_path", "series_uid", "slice_idx")


@query("pick_series", f"select folder_id, series_uid, n_slices from (select *, row_number() over (partition by folder_id order by series_uid % 50 = 0 desc, n_slices desc, series_number, series_uid) as rk from {_INVENTORY}) where rk = 1")
def pick_series(spark, d):
    inventory = catalogue.series_inventory(view(spark, d, "headers"))
    inventory = dealt(inventory, "folder_id", view(spark, d, "orders").count())
    asked = F.when(C("series_uid") % 50 == 0, C("series_uid"))
    return catalogue.pick_series(inventory, asked).select("folder_id", "series_uid", "n_slices")


def _number_text(x: str) -> str:
    return f"case when {x}_min is null then '—' when {x}_min = {x}_max then printf('%.0f', round_even({x}_min, 0)) || case when n > 1 then ' (toutes coupes)' else '' end else printf('%.0f', round_even({x}_min, 0)) || '-' || printf('%.0f', round_even({x}_max, 0)) || ' (modulation)' end"


@query("modulation", f"""select series_uid, kvp_min, kvp_max, tube_current_min, tube_current_max, {_number_text("kvp")} as kvp_text, {_number_text("tube_current")} as ma_text
  from (select series_uid, count(*) as n, min(nullif(kvp, 0)) as kvp_min, max(nullif(kvp, 0)) as kvp_max, min(nullif(tube_current, 0)) as tube_current_min, max(nullif(tube_current, 0)) as tube_current_max from {{headers}} group by 1)""")
def modulation(spark, d):
    return catalogue.modulation(view(spark, d, "headers"))


def ordered(spark, d):
    return catalogue.slice_order(view(spark, d, "headers"))


@query("central_slices", f"select file_path, slice_idx, slice_idx = n_slices // 2 as middle from {_ORDERED} where slice_idx >= greatest((n_slices - 4) // 2, 0) and slice_idx < greatest((n_slices - 4) // 2, 0) + 4")
def central_slices(spark, d):
    """Series here have up to 7 slices, so the 4 central ones are taken."""
    return selection.central_slices(ordered(spark, d), 4).select("file_path", "slice_idx", "middle")


@query("default_slices", """select event_id, cast(f as int) as nps_first, cast(least(f + 9, n_slices) as int) as nps_last, cast((n_slices + 1) // 2 as int) as hu, cast(greatest(1, hu_slice + 1 - 4) as int) as around_first, cast(least(n_slices, hu_slice + 1 + 5) as int) as around_last
  from (select *, greatest(1, floor((n_slices - 10) / 2.0) + 1) as f from {qc_runs})""")
def default_slices(spark, d):
    n = C("n_slices")
    near = selection.around(C("hu_slice") + 1, n)
    return view(spark, d, "qc_runs").select("event_id", *(x.alias(k) for k, x in selection.default_slices(n).items()), near["first"].alias("around_first"), near["last"].alias("around_last"))


@query("slice_range", """select event_id, case when error is null then cast(least(a, b) as int) end as first, case when error is null then cast(greatest(a, b) as int) end as last, error from (
  select event_id, case when f is null then null else least(greatest(f, 0), n_slices - 1) end as a, case when l is null then null else least(greatest(l, 0), n_slices - 1) end as b,
   case when n_slices <= 0 then 'série vide' when (f is null or l is null) and n_slices < 10 then 'moins de 10 coupes' end as error
  from (select *, case when event_id % 7 = 0 then null else hu_slice + 5 - event_id % 11 end as f, case when event_id % 7 = 0 then null else hu_slice - 5 + event_id % 13 end as l from {qc_runs}))""")
def slice_range(spark, d):
    given = lambda x: F.when(C("event_id") % 7 != 0, x)
    r = selection.slice_range(given(C("hu_slice") + 5 - C("event_id") % 11), given(C("hu_slice") - 5 + C("event_id") % 13), C("n_slices"))
    return view(spark, d, "qc_runs").select("event_id", r.alias("r")).select("event_id", "r.*")


@query("saved_slices", "select event_id, case when l is null or l = n_slices then cast(least(greatest(hu_slice, 0), n_slices - 1) as int) end as slice_idx from (select *, case when event_id % 3 = 0 then null when event_id % 3 = 1 then n_slices else n_slices + 1 end as l from {qc_runs})")
def saved_slices(spark, d):
    length = F.when(C("event_id") % 3 == 1, C("n_slices")).when(C("event_id") % 3 == 2, C("n_slices") + 1)
    return view(spark, d, "qc_runs").select("event_id", selection.saved_slices(C("hu_slice"), length, C("n_slices")).alias("slice_idx"))


@query("slices_by_location", f"""select series_uid, cast(coalesce(a, greatest(0, n // 2 - 10)) as int) as first, cast(coalesce(b, least(n - 1, n // 2 + 9)) as int) as last, a is not null as found
  from (select series_uid, min(slice_idx) filter (slice_location between 20 and 60) as a, max(slice_idx) filter (slice_location between 20 and 60) as b, count(*) as n from {_ORDERED} group by 1)""")
def slices_by_location(spark, d):
    return selection.slices_by_location(ordered(spark, d), F.lit(60.0), F.lit(20.0))


_DEVICE_IDS = f"(select s_suppkey, {DEVICE_ID_SQL} as device_id, s_acctbal from {{devices}})"
_IDENTITY = ("manufacturer", "model_name", "station_name", "serial_number")


def devices_with_id(spark, d):
    return view(spark, d, "devices").withColumn("device_id", S.device_id(*(C(x) for x in _IDENTITY)))


def slices_with_id(spark, d):
    ids = devices_with_id(spark, d).select(C("s_suppkey").alias("suppkey"), "device_id")
    return view(spark, d, "headers").join(ids, "suppkey").select("file_path", "device_id", "suppkey")


_KNOWN = f"(select * from {_DEVICE_IDS} where device_id <> '' and s_acctbal > 0)"


@query("recognise_device", f"select s.file_path, s.device_id, k.s_suppkey from (select h.file_path, i.device_id from {{headers}} h join {_DEVICE_IDS} i on h.suppkey = i.s_suppkey) s left join {_KNOWN} k using (device_id)")
def recognise_device(spark, d):
    known = devices_with_id(spark, d).filter("s_acctbal > 0").select("device_id", "s_suppkey")
    return devices.recognised(slices_with_id(spark, d).select("file_path", "device_id"), known)


@query("unknown_scanner", f"select s.file_path, s.device_id from (select h.file_path, i.device_id from {{headers}} h join {_DEVICE_IDS} i on h.suppkey = i.s_suppkey) s where not exists (select 1 from {_KNOWN} k where k.device_id = s.device_id)")
def unknown_scanner(spark, d):
    known = devices_with_id(spark, d).filter("s_acctbal > 0")
    return devices.unknown_scanners(slices_with_id(spark, d).select("file_path", "device_id"), known)


@query("geometry_match", """select file_path, n_rows = 512 and g > 0 and abs(px * 402 - g) / case when g > 0 then g end < 0.005 as fits
  from (select *, cast(case series_uid % 4 when 0 then 200.0 when 1 then 200.5 when 2 then 0.0 else 201.0 end as double) as g from {headers})""")
def geometry_match(spark, d):
    """Sizes of 200.5 and 201 fit one of 201; 200 is exactly 0.5 % away and does not, nor does a stored size of 0."""
    k = C("series_uid") % 4
    g_px = F.when(k == 0, 200.0).when(k == 1, 200.5).when(k == 2, 0.0).otherwise(201.0)
    fits = devices.geometry_fits(C("n_rows"), C("n_rows"), C("px") * 402, F.lit(512), F.lit(512), g_px)
    return view(spark, d, "headers").select("file_path", fits.alias("fits"))


@query("geometry_lookup", """select h.file_path, coalesce(g.device_px, h.px) as geometry_px, g.device_px is null as recomputed, g.device_px is null and h.suppkey % 3 <> 0 as mismatch
  from {headers} h left join (select s_suppkey, case when s_suppkey % 2 = 0 then 0.5 else 0.25 end as device_px from {supplier} where s_suppkey % 3 <> 0) g on h.suppkey = g.s_suppkey and h.n_rows = 512 and abs(h.px - g.device_px) / g.device_px < 0.005""")
def geometry_lookup(spark, d):
    """The frozen geometry where it fits the image, else one of its own; a mismatch is marked."""
    frozen = view(spark, d, "supplier").filter("s_suppkey % 3 <> 0").select("s_suppkey", F.when(C("s_suppkey") % 2 == 0, 0.5).otherwise(0.25).alias("device_px"))
    on = (C("suppkey") == C("s_suppkey")) & devices.geometry_fits(C("n_rows"), C("n_rows"), C("px"), F.lit(512), F.lit(512), C("device_px"))
    rows = view(spark, d, "headers").join(frozen, on, "left")
    none = C("device_px").isNull()
    return rows.select("file_path", F.coalesce("device_px", "px").alias("geometry_px"), none.alias("recomputed"), (none & (C("suppkey") % 3 != 0)).alias("mismatch"))


@query("relative_path", r"""select page_id, array_to_string(list_concat([ '..' for i in range(len(b) - common)], p[common + 1 :]), '/') as rel from (
  select page_id, p, b, case when p[1] <> b[1] then 0 when len(p) < 2 or p[2] <> b[2] then 1 when len(p) < 3 or p[3] <> b[3] then 2 else 3 end as common from (
  select page_id, string_split(path, '/') as p, ['', string_split(path, '/')[2], 'en'] as b from {paths}))""")
def relative_path(spark, d):
    host = F.element_at(F.split("path", "/"), 2)
    return view(spark, d, "paths").select("page_id", archive.relative_path(C("path"), F.concat(F.lit("/"), host, F.lit("/en"))).alias("rel"))


@query("apply_relocation", "select page_id, '/arch' || substr(path, length('/' || string_split(path, '/')[2]) + 1) as moved, case when path = '/www' or starts_with(path, '/www/') then '/x' || substr(path, 5) end as other from {paths}")
def apply_relocation(spark, d):
    first = F.concat(F.lit("/"), F.element_at(F.split("path", "/"), 2))
    return view(spark, d, "paths").select("page_id", archive.apply_relocation(C("path"), first, F.lit("/arch")).alias("moved"), archive.apply_relocation(C("path"), F.lit("/www"), F.lit("/x")).alias("other"))


@query("relocation_between", """select page_id, case when page_id % 5 = 0 then null else '/' || h end as old, case when page_id % 5 = 0 then null when page_id % 3 = 0 then '/arch/old/' || h else '/arch' end as new from (
  select page_id, case when page_id % 3 = 0 then '' else string_split(path, '/')[2] end as h from {paths})""".replace("else '/' || h end as old", "when page_id % 3 = 0 then '/' else '/' || h end as old").replace("then '/arch/old/' || h", "then '/arch/old'"))
def relocation_between(spark, d):
    """Two paths that differ in their first component, or by a prefix put before all of it, or not at all."""
    p = C("path")
    rest = F.substr(p, F.length(F.element_at(F.split(p, "/"), 2)) + 2)
    moved = F.when(C("page_id") % 5 == 0, p).when(C("page_id") % 3 == 0, F.concat(F.lit("/arch/old"), p)).otherwise(F.concat(F.lit("/arch"), rest))
    return view(spark, d, "paths").select("page_id", archive.relocation_between(p, moved).alias("r")).select("page_id", "r.old", "r.new")


@query("resolve_folder", """select page_id as run_id, case page_id % 4 when 0 then path when 1 then '/b' || path else '/a' || path end as folder, cast(case page_id % 4 when 0 then 0 when 1 then 2 else 1 end as bigint) as via
  from {paths} where page_id % 4 <> 3""")
def resolve_folder(spark, d):
    """Three relocations of every first folder are known; the catalogue holds some of what they lead to."""
    paths = view(spark, d, "paths")
    runs = paths.select(C("page_id").alias("run_id"), C("page_id").alias("series_uid"), C("path").alias("folder"))
    firsts = paths.select(F.concat(F.lit("/"), F.element_at(F.split("path", "/"), 2)).alias("old")).distinct()
    steps = F.explode(F.array(F.struct(F.lit("/a").alias("to"), F.lit(1).alias("seq")), F.struct(F.lit("/b").alias("to"), F.lit(2).alias("seq")), F.struct(F.lit("/c").alias("to"), F.lit(3).alias("seq")))).alias("s")
    moved = firsts.select("old", steps).select("old", F.concat("s.to", "old").alias("new"), "s.seq")
    holds = [(0, ""), (0, "/b"), (1, "/b"), (1, "/a"), (2, "/a")]
    catalogue_ = None
    for rest, prefix in holds:
        part = paths.filter(C("page_id") % 4 == rest).select(C("page_id").alias("series_uid"), F.concat(F.lit(prefix), "path").alias("folder"))
        catalogue_ = part if catalogue_ is None else catalogue_.unionByName(part)
    return archive.resolve_folder(runs, moved, catalogue_)


@query("find_series", "select series_uid, min(folder_id) as folder_id from {headers} group by 1")
def find_series(spark, d):
    return archive.find_series(view(spark, d, "headers").select("series_uid", "folder_id"))
