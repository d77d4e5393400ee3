"""Queries over stored documents, merges and interchange formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from phantomlake.operators import documents, rois, store, validation
from phantomlake.plans.registry import query
from phantomlake.plans.scalar_queries import VERDICT_SQL, judged_runs
from phantomlake.sources.views import view

C = F.col


@query("quarantine_scan", """select user_id, count(*) as n, count(*) filter (bad) as n_bad, cast(sum(k) as bigint) as total from (select user_id, not json_valid(doc) as bad, case when json_valid(doc) then cast(json_extract(doc, '$.k') as bigint) end as k
  from (select user_id, case when event_id % 7 = 0 then left(props, length(props) - 1) else props end as doc from {events})) group by 1""")
def quarantine_scan(spark, d):
    """Every seventh document is cut short; it is counted and never hides the others."""
    doc = F.when(C("event_id") % 7 == 0, F.expr("left(props, length(props) - 1)")).otherwise(C("props"))
    rows = store.quarantine(view(spark, d, "events").select("user_id", doc.alias("doc")), "doc", "k bigint", "k")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"), F.sum("parsed.k").alias("total"))


@query("extra_keys", "select event_id, case when event_id % 2 = 0 then 'v' || event_id end as extra_v, case when event_id % 3 = 0 then 'true' end as extra_w from {events}")
def extra_keys(spark, d):
    more = F.concat(F.regexp_replace("props", r"\}$", ""), F.when(C("event_id") % 2 == 0, F.concat(F.lit(', "v": "v'), C("event_id"), F.lit('"'))).otherwise(""), F.when(C("event_id") % 3 == 0, F.lit(', "w": true')).otherwise(""), F.lit("}"))
    found = view(spark, d, "events").select("event_id", store.extra_keys(more, ["k"]).alias("x"))
    return found.select("event_id", F.col("x")["v"].alias("extra_v"), F.col("x")["w"].alias("extra_w"))


@query("device_documents", f"select device_id, count(*) as n_runs, count(*) filter (overall = 'ok') as n_ok, arg_min(run_id, (run_date, recorded_at, event_id)) as first_run from {VERDICT_SQL} group by 1")
def device_documents(spark, d):
    """Nested into documents and flat again."""
    runs = judged_runs(spark, d)
    flat = store.flat_runs(store.device_documents(runs.select("device_id").distinct(), runs))
    return flat.groupBy("device_id").agg(F.count("event_id").alias("n_runs"), F.count_if(C("overall") == "ok").alias("n_ok"), F.min_by("run_id", F.struct("run_date", "recorded_at", "event_id")).alias("first_run"))


@query("run_store_layout", "select device_id, event_id, cast(row_number() over (partition by device_id order by run_date, recorded_at, event_id) - 1 as int) as position from {qc_runs}")
def run_store_layout(spark, d):
    return store.run_layout(view(spark, d, "qc_runs")).select("device_id", "event_id", "position")


def snapshots(spark, d):
    return tuple(view(spark, d, x) for x in ("base", "mine", "theirs"))


_SIDES = """(select coalesce(m.k, t.k) as k, m.k is not null as im, t.k is not null as it, b.k is not null as ib, m.f1 as m1, m.f2 as m2, t.f1 as t1, t.f2 as t2, b.f1 as b1, b.f2 as b2
  from {mine} m full join {theirs} t on m.k = t.k left join {base} b on b.k = coalesce(m.k, t.k))"""
_STAYS = "((im and it) or (it and not im and not ib) or (im and not it and (not ib or m1 is distinct from b1 or m2 is distinct from b2)))"


@query("three_way_fields", f"select k, case when im and (not it or not ib or m1 is distinct from b1) then m1 else t1 end as f1, case when im and (not it or not ib or m2 is distinct from b2) then m2 else t2 end as f2 from {_SIDES} where {_STAYS}")
def three_way_fields(spark, d):
    return store.three_way_fields(*snapshots(spark, d), ["k"], ["f1", "f2"])


@query("three_way_keys", f"select k, case when u then 'mine' else 'theirs' end as side, case when u then m1 else t1 end as f1, case when u then m2 else t2 end as f2 from (select *, im and (not it or not ib or m1 is distinct from b1 or m2 is distinct from b2) as u from {_SIDES} where {_STAYS})")
def three_way_keys(spark, d):
    return store.three_way_rows(*snapshots(spark, d), ["k"], ["f1", "f2"])


@query("delete_runs", "select event_id from {qc_runs} where (device_id, run_id) not in (select device_id, run_id from {qc_runs} where event_id % 13 = 0)")
def delete_runs(spark, d):
    runs = view(spark, d, "qc_runs")
    return store.without(runs, runs.filter("event_id % 13 = 0"), ["device_id", "run_id"]).select("event_id")


@query("orphan_runs", "select event_id, device_id from {qc_runs} where device_id not in (select 'dev-' || c_custkey from {customer} where c_custkey % 2 = 0)")
def orphan_runs(spark, d):
    devices = view(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("dev-"), C("c_custkey")).alias("device_id"))
    return store.orphans(view(spark, d, "qc_runs"), devices).select("event_id", "device_id")


@query("relocation_keep", "select owner, old, new, seq from (select *, row_number() over (partition by owner order by seq desc) as rk from (select user_id as owner, event_type as old, event_id % 8 as new, max(event_id) as seq from {events} group by 1, 2, 3)) where rk <= 20")
def relocation_keep(spark, d):
    pairs = view(spark, d, "events").select(C("user_id").alias("owner"), C("event_type").alias("old"), (C("event_id") % 8).alias("new"), C("event_id").alias("seq"))
    return store.keep_relocations(pairs)


@query("relocation_merge", """with b as (select k as old, f1 as new from {base}), m as (select k as old, f1 as new from {mine}), t as (select k as old, f1 as new from {theirs}),
  kept as (select * from t where not exists (select 1 from b where b.old = t.old and b.new = t.new and not exists (select 1 from m where m.old = b.old and m.new = b.new)))
  select old, new, 0 as place from kept union all select old, new, 1 from m where not exists (select 1 from kept where kept.old = m.old and kept.new = m.new)""")
def relocation_merge(spark, d):
    pairs = [x.select(C("k").alias("old"), C("f1").alias("new")) for x in snapshots(spark, d)]
    return store.merge_relocations(*pairs)


@query("roi_json_in", "select fmt_id, cast(i as int) as roi_idx, cast(center_col + i * 3 + (32 + 8 * (fmt_id % 5)) // 2 as int) as x, cast(center_row - i + (32 + 8 * (fmt_id % 5)) // 2 as int) as y, cast(32 + 8 * (fmt_id % 5) as int) as side from {formats}, range(4) t(i)")
def roi_json_in(spark, d):
    """ROI files hold top-left corners; they are read as centres."""
    rows = view(spark, d, "formats")
    corner = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct((C("center_col") + i * 3).alias("X"), (C("center_row") - i).alias("Y"), (32 + 8 * (C("fmt_id") % 5)).cast("int").alias("side_square")))
    text = F.to_json(F.struct(F.lit("roi").alias("type_of_file"), corner.alias("ROI")))
    return rois.read_nps_rois(rows.select("fmt_id", text.alias("json")), "json")


#: How a file of regions begins: kind, phantom and key stand for themselves.
_HEAD = """'{{"type_of_file":"KIND","phantom":"PHANTOM ' || KEY || '","measurement_date":"20260315","DFOV":' || cast(dfov as varchar) || ',"pixel_size":' || cast(px as varchar) || ',"width_in_pixel":' || cast(cast(width as double) as varchar)"""


def _nps_file() -> str:
    roi = """'{{"X":' || cast(cast(center_col + i * 4 - side // 2 as double) as varchar) || ',"Y":' || cast(cast(center_row - i - side // 2 as double) as varchar) || ',"side_square":' || cast(cast(side as double) as varchar) || '}}'"""
    head = _HEAD.replace("KIND", "NPS").replace("PHANTOM", "Water").replace("KEY", "fmt_id")
    tail = """ || ',"phantom_diameter":' || cast(diameter_px * px as varchar) || ',"commentaire":"NPS - ROI''s position given in pixel (top-left corner), section in mm","section":{{"start":' || cast(start_mm as varchar) || ',"stop":' || cast(start_mm + 22.5 as varchar) || '}},"ROI":[' || string_agg(""" + roi + """, ',' order by i) || ']}}' as json"""
    return f"select fmt_id, {head}{tail} from (select *, n_rows * px as dfov, n_rows as width, 32 + 8 * (fmt_id % 5) as side, cast(fmt_id % 40 as double) / 4 - 5 as start_mm from {{formats}}), range(4) t(i) group by fmt_id, px, dfov, width, diameter_px, start_mm"


@query("roi_json_out", _nps_file())
def roi_json_out(spark, d):
    """Centres become top-left corners; the file says what it was measured on."""
    formats = view(spark, d, "formats")
    rows = formats.withColumn("side", (32 + 8 * (C("fmt_id") % 5)).cast("int")).withColumn("roi_idx", F.explode(F.sequence(F.lit(0), F.lit(3))))
    placed = rows.select("fmt_id", "roi_idx", (C("center_col") + C("roi_idx") * 4).alias("x"), (C("center_row") - C("roi_idx")).alias("y"), "side")
    start = (C("fmt_id") % 40).cast("double") / 4 - 5
    headers = formats.select("fmt_id", F.concat(F.lit("Water "), C("fmt_id")).alias("phantom"), F.lit("20260315").alias("measurement_date"), (C("n_rows") * C("px")).alias("dfov"), "px", C("n_rows").alias("width"), (C("diameter_px") * C("px")).alias("phantom_diameter"), start.alias("slice_start_mm"), (start + 22.5).alias("slice_end_mm"))
    return rois.write_nps_rois(placed, headers, "fmt_id")


def _hu_file() -> str:
    roi = """'{{"name":"' || name || '","X":' || cast(cast(x as double) as varchar) || ',"Y":' || cast(cast(y as double) as varchar) || ',"radius":' || cast(cast(r as double) as varchar) || '}}'"""
    head = _HEAD.replace("KIND", "HU").replace("PHANTOM", "Phantom").replace("KEY", "slice_id")
    tail = """ || ',"commentaire":"HU - ROI''s position given in pixel (circular ROIs), slice in mm","slice_position_mm":' || cast(cast(slice_id as double) * 2.5 as varchar) || ',"ROI":[' || string_agg(""" + roi + """, ',' order by i) || ']}}' as json"""
    return f"""select slice_id, {head}{tail} from (
  select slice_id, px, 96 * px as dfov, 96 as width, i, ['Centre', '12h', '3h', '6h', '9h'][i + 1] as name, center_col + case i when 2 then 20 when 4 then -20 else 0 end as x, center_row + case i when 1 then -20 when 3 then 20 else 0 end as y, case i when 0 then 13 else 6 end as r from {{phantoms}}, range(5) t(i)) group by slice_id, px, dfov, width"""


@query("hu_roi_json_out", _hu_file())
def hu_roi_json_out(spark, d):
    g = {"central_radius": F.lit(13), "peripheral_radius": F.lit(6), "peripheral_distance": F.lit(20)}
    phantoms = view(spark, d, "phantoms")
    headers = phantoms.select("slice_id", F.concat(F.lit("Phantom "), C("slice_id")).alias("phantom"), F.lit("20260315").alias("measurement_date"), (96 * C("px")).alias("dfov"), "px", F.lit(96).alias("width"), (C("slice_id").cast("double") * 2.5).alias("slice_mm"))
    return rois.write_hu_rois(rois.hu_rois(phantoms, g).drop("px"), headers, "slice_id")


@query("ref_spectrum_parse", "select p_partkey, cast(i as int) as ring, i / 30.0 as freq, round(p_retailprice / (i + 1), 4) as power, round(p_size / 7.0, 4) as fit from {part}, range(3) t(i)")
def ref_spectrum_parse(spark, d):
    """Spectrum files are CSV: a header, then frequency, raw and fitted power."""
    line = lambda i: F.concat_ws(",", F.lit(i / 30).cast("string"), F.round(C("p_retailprice") / (i + 1), 4).cast("string"), F.round(C("p_size") / 7.0, 4).cast("string"))
    text = F.concat_ws("\n", F.lit("Frequency,NPS_1D_raw,NPS_1D_fit"), *(line(i) for i in range(3)), F.lit(""))
    return validation.parse_spectra(view(spark, d, "part").select("p_partkey", text.alias("text")), "p_partkey")


#: Which controls each side has of scanner k, and what is in them: run 0 changed, run 1 removed, runs 2 and 3 added.
_RUN_SQL = """select *, ib and r < 2 as rb, im and (r = 0 or (r = 1 and k % 4 <> 1) or (r = 2 and k % 4 = 2)) as rm, it and (r = 0 or (r = 1 and k % 6 <> 1) or (r = 3 and k % 6 = 2)) as rt,
  case when r = 2 or (r = 0 and k % 4 = 0) then 'm' else 'b' end as vm, case when r = 3 or (r = 0 and k % 6 = 0) then 't' else 'b' end as vt"""


def _merge_sql() -> str:
    theirs = "(select * from {theirs} where k % 19 <> 0)"
    sides = _SIDES.replace("{theirs}", theirs)
    stays = "((im and it) or (it and not im and not ib) or (im and not it and (not ib or m1 is distinct from b1 or m2 is distinct from b2 or k % 4 < 3)))"
    return f"""with d as (select *, case when im and (not it or not ib or m1 is distinct from b1) then m1 else t1 end as f1, case when im and (not it or not ib or m2 is distinct from b2) then m2 else t2 end as f2 from {sides} where {stays}),
  r as (select k, string_agg('r' || r || ':' || case when rm and (not rt or not rb or vm <> 'b') then vm else vt end, ',' order by -r) as runs
    from ({_RUN_SQL} from d, range(4) t(r)) where (rm and rt) or (rt and not rm and not rb) or (rm and not rt and (not rb or vm <> 'b')) group by k)
  select 'dev-' || k as device_id, false as kept, f1 as name, f2 as segment, case when it and k % 3 = 0 then '[1,{{{{"y":null}}}}]' end as foreign_x, coalesce(runs, '') as runs, case when it and k % 5 = 0 then 2 else 0 end as n_unread from d left join r using (k)
  union all select null, true, null, null, null, '{{{{broken ' || k, 0 from {{theirs}} where k % 19 = 0"""


@query("document_merge", _merge_sql())
def document_merge(spark, d):
    """Documents on three sides with scanners, fields and controls added, changed and removed on two of them; some of theirs
    have a key of a newer writer, unreadable controls, or are broken as a whole."""
    run = lambda r, value: F.struct(F.concat(F.lit("r"), F.lit(r)).alias("run_id"), F.lit(f"2026-01-0{9 - r}").alias("run_date"), value.alias("v"))
    k = C("k")

    def docs(side, runs, more):
        listed = F.transform(F.filter(F.array(*(F.when(there, run(r, v)) for r, there, v in runs)), lambda x: x.isNotNull()), lambda x: F.to_json(x))
        text = F.concat(F.to_json(F.struct(F.concat(F.lit("dev-"), k).alias("device_id"), C("f1").alias("name"), C("f2").alias("segment"))), F.lit(""))
        body = F.concat(F.expr("left({0}, length({0}) - 1)".format("head")), more, F.lit(',"runs":['), F.array_join(F.concat(listed, extra(side)), ","), F.lit("]}"))
        return view(spark, d, side).withColumn("head", text).withColumn("doc", body)

    def extra(side):
        return F.when((k % 5 == 0) & F.lit(side == "theirs"), F.array(F.lit("17"), F.lit('{"run_id":"x"}'))).otherwise(F.array().cast("array<string>"))

    yes, b, none = F.lit(True), F.lit("b"), F.lit("")
    base = docs("base", [(0, yes, b), (1, yes, b)], none)
    mine = docs("mine", [(0, yes, F.when(k % 4 == 0, "m").otherwise("b")), (1, k % 4 != 1, b), (2, k % 4 == 2, F.lit("m"))], none)
    theirs = docs("theirs", [(0, yes, F.when(k % 6 == 0, "t").otherwise("b")), (1, k % 6 != 1, b), (3, k % 6 == 2, F.lit("t"))], F.when(k % 3 == 0, ',"x":[1,{"y":null}]').otherwise(""))
    theirs = theirs.withColumn("doc", F.when(k % 19 == 0, F.concat(F.lit("{broken "), k)).otherwise(C("doc")))
    out = documents.merged(base, mine, theirs, ["device_id", "name", "segment"])
    read = documents.parsed(out.select("doc", "kept"))
    field = lambda x: F.get_json_object("doc", f"$.{x}")
    runs = F.array_join(F.transform("runs", lambda r: F.concat(r["run_id"], F.lit(":"), F.get_json_object(r["text"], "$.v"))), ",")
    return read.select("device_id", "kept", field("name").alias("name"), field("segment").alias("segment"), field("x").alias("foreign_x"), F.when(C("kept"), C("doc")).otherwise(runs).alias("runs"), F.coalesce(F.size("bad_runs"), F.lit(0)).alias("n_unread"))


@query("nested_quarantine", """select 'dev-' || user_id as device_id, cast(count(*) filter (event_id % 11 <> 0) as int) as n_runs, cast(count(*) filter (event_id % 11 = 0) as int) as n_bad,
  case when count(*) filter (event_id % 11 = 0) > 0 then 'dev-' || user_id || ' : ' || count(*) filter (event_id % 11 = 0) || case when count(*) filter (event_id % 11 = 0) > 1 then ' contrôles illisibles' else ' contrôle illisible' end end as message
  from {events} where user_id % 7 <> 0 group by user_id union all select null, 0, 0, 'installation n° ' || user_id || ' illisible' from {events} where user_id % 7 = 0 group by user_id""")
def nested_quarantine(spark, d):
    """Scanners with all their controls in one document: every eleventh control has no date or is no object, every seventh
    scanner's list is no list. Neither hides the others."""
    event = F.to_json(F.struct(C("event_id").cast("string").alias("run_id"), F.when(C("event_id") % 11 != 0, F.lit("2026-01-01")).alias("run_date")))
    each = F.when(C("event_id") % 22 == 0, F.lit("[1]")).otherwise(event)
    listed = view(spark, d, "events").groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list(each), ","), F.lit("]")).alias("list"))
    runs = F.when(C("user_id") % 7 == 0, F.lit('{"a":1}')).otherwise(C("list"))
    docs = listed.select("user_id", F.concat(F.lit('{"device_id":"dev-'), "user_id", F.lit('","runs":'), runs, F.lit("}")).alias("doc"))
    read = documents.parsed(docs).withColumn("device_id", F.when(~C("bad"), C("device_id")))
    messages = documents.load_warnings(read.withColumn("device_id", C("user_id")), F.concat(F.lit("dev-"), C("user_id")), C("user_id")).select(C("device_id").alias("user_id"), "message")
    return read.join(messages, "user_id", "left").select("device_id", F.when(C("bad"), 0).otherwise(F.size("runs")).alias("n_runs"), F.when(C("bad"), 0).otherwise(F.size("bad_runs")).alias("n_bad"), "message")


@query("ref_results_parse", "select p_partkey, round(p_retailprice / 100, 6) as noise, round(p_size / 100.0, 6) as freq from {part}")
def ref_results_parse(spark, d):
    """Result files hold lines "label :value"."""
    text = F.concat(F.lit("Noise :"), F.round(C("p_retailprice") / 100, 6).cast("string"), F.lit("\nMean frequency :"), F.round(C("p_size") / 100, 6).cast("string"), F.lit("\n"))
    return validation.parse_results(view(spark, d, "part").select("p_partkey", text.alias("text")), "p_partkey", {"Noise": "noise", "Mean frequency": "freq"})
