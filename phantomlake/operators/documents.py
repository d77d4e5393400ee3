"""Stored documents: one JSON object for each scanner, its controls nested in `runs`. Reading never loses what it cannot
read, and the merge of two sides never loses what it does not know.

Values are compared as canonical JSON (object keys in order), so their layout does not matter. A document that is no JSON
object, has no device_id or a `runs` that is no list is unreadable as a whole; a control that is no object, or has no
date (`run_date`, a text), is unreadable alone and hides neither its scanner nor the other controls. A control without
run_id has that of its series, else one of its date and content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phantomlake.operators.store import guard_version

SCHEMA_VERSION = 2


def _text(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "string")


def parsed(docs: DataFrame, json_col: str = "doc") -> DataFrame:
    """The documents with device_id, `fields` (all keys but runs, as JSON text), `runs` (array of run_id, run_date,
    recorded_at and text; the last one of an id), `bad_runs` (JSON text) and `bad` (the whole document is unreadable)."""
    whole = docs.withColumn("_o", F.from_json(json_col, "map<string,variant>"))
    listed = whole.withColumns({
        "device_id": F.try_variant_get(F.element_at("_o", F.lit("device_id")), "$", "string"),
        "_r": F.element_at("_o", F.lit("runs")),
    })
    entries = F.try_variant_get("_r", "$", "array<variant>")
    none = F.col("_r").isNull() | F.is_variant_null("_r")
    bad = F.col("_o").isNull() | F.col("device_id").isNull() | (~none & entries.isNull())
    listed = listed.withColumns({"bad": F.coalesce(bad, F.lit(True)), "_runs": F.when(~none, F.transform(entries, _entry))})
    empty = F.array().cast("array<struct<run_id:string,run_date:string,recorded_at:string,text:string,ok:boolean>>")
    runs = F.coalesce("_runs", empty)
    good = F.filter(runs, lambda r: r["ok"])
    # the last one of an id counts, as where a file is read into a table by id
    last = F.filter(good, lambda r, i: ~F.exists(F.slice(good, i + 2, F.size(good)), lambda later: later["run_id"] == r["run_id"]))
    return listed.withColumns({
        "fields": F.transform_values(F.map_filter("_o", lambda k, _: k != "runs"), lambda _, v: F.coalesce(F.to_json(v), F.lit("null"))),
        "runs": F.transform(last, lambda r: r.dropFields("ok")), "bad_runs": F.transform(F.filter(runs, lambda r: ~r["ok"]), lambda r: r["text"]),
    }).drop("_o", "_r", "_runs")


def _entry(v: Column) -> Column:
    """One control of a list: its id, date, recording and text, and whether it can be read."""
    text, date = F.coalesce(F.to_json(v), F.lit("null")), _text(v, "run_date")
    dated = F.schema_of_variant(F.try_variant_get(v, "$.run_date", "variant")) == "STRING"
    ok = F.try_variant_get(v, "$", "map<string,variant>").isNotNull() & date.isNotNull() & dated
    named = [F.nullif(_text(v, k), F.lit("")) for k in ("run_id", "series_uid")]
    run_id = F.coalesce(*named, F.concat(date, F.lit("-"), F.substring(F.sha2(text, 256), 1, 8)))
    return F.struct(run_id.alias("run_id"), date.alias("run_date"), F.coalesce(_text(v, "recorded_at"), F.lit("")).alias("recorded_at"), text.alias("text"), F.coalesce(ok, F.lit(False)).alias("ok"))


def load_warnings(read: DataFrame, name: Column, number: Column) -> DataFrame:
    """One message for each unreadable document, and for each scanner with unreadable controls; `read` comes from parsed."""
    n = F.size("bad_runs")
    some = F.concat(name, F.lit(" : "), n.cast("string"), F.when(n > 1, " contrôles illisibles").otherwise(" contrôle illisible"))
    message = F.when(F.col("bad"), F.concat(F.lit("installation n° "), number.cast("string"), F.lit(" illisible"))).when(n > 0, some)
    return read.withColumn("message", message).filter("message is not null").select("device_id", "message")


def _one_each(docs: DataFrame, side: str) -> DataFrame:
    """One document for each device_id: fields, runs as a map by id, unreadable runs."""
    read = parsed(docs.select("doc")).filter("not bad")
    columns = {"fields": F.col("fields"), "runs": F.map_from_entries(F.transform("runs", lambda r: F.struct(r["run_id"], r))), "bad_runs": F.col("bad_runs")}
    rows = read.select("device_id", *(v.alias(k) for k, v in columns.items()))
    # two documents of one scanner: the one with the greatest text, the same for any order of rows
    entries = F.struct(F.to_json("fields").alias("k"), F.to_json("runs").alias("r"))
    return rows.groupBy("device_id").agg(F.max_by(F.struct(*columns), entries).alias(side))


def merged(base: DataFrame, mine: DataFrame, theirs: DataFrame, known: list[str], version_col: str | None = None) -> DataFrame:
    """The documents to write: device_id, doc and `kept`, one for each scanner and one for each unreadable text of theirs.

    `theirs` (doc) is what is stored now, `mine` what this session holds, `base` what it last saw. Scanners, their fields and
    their controls are merged one by one: what was changed here wins, all else comes from theirs. What one side removed
    stays removed, unless this session changed it meanwhile. Fields that are not `known` come from theirs. Controls are
    whole; they are ordered by date and recording, unreadable ones stay behind them. Documents of a newer version
    (`version_col` of theirs) are refused.
    """
    if version_col:
        guard_version(theirs, version_col, SCHEMA_VERSION)
    unread = parsed(theirs.select("doc")).filter("bad").select("device_id", "doc", F.lit(True).alias("kept"))
    rows = None
    for side, docs in (("base", base), ("mine", mine), ("theirs", theirs)):
        one = _one_each(docs, side)
        rows = one if rows is None else rows.join(one, "device_id", "full_outer")
    own = F.map_filter("mine.fields", lambda k, _: k.isin(*known))
    before = F.map_filter("base.fields", lambda k, _: k.isin(*known))
    no_runs = F.create_map().cast("map<string,struct<run_id:string,run_date:string,recorded_at:string,text:string>>")
    rows = rows.withColumns({"own": own, "before": before, **{f"{s}_runs": F.coalesce(f"{s}.runs", no_runs) for s in ("base", "mine", "theirs")}})
    value = lambda m, k: F.element_at(m, k)
    differs = lambda k, v: F.col("base").isNull() | ~v.eqNullSafe(value("before", k))
    changed = F.map_filter("own", differs)
    run = lambda side, k: value(f"{side}_runs", k)["text"]
    run_changed = lambda k: ~run("mine", k).eqNullSafe(run("base", k))
    all_mine, all_theirs = F.map_keys("mine_runs"), F.map_keys("theirs_runs")
    touched = (F.size(changed) > 0) | F.exists(F.array_union(all_mine, F.map_keys("base_runs")), run_changed) | F.exists(F.map_keys("before"), lambda k: ~F.map_contains_key("own", k))
    in_mine, in_theirs, in_base = (F.col(s).isNotNull() for s in ("mine", "theirs", "base"))
    rows = rows.filter((in_mine & in_theirs) | (in_theirs & ~in_base) | (in_mine & ~in_theirs & (~in_base | F.coalesce(touched, F.lit(True)))))
    both = F.map_concat(F.map_filter("theirs.fields", lambda k, _: ~F.map_contains_key(changed, k)), changed)
    fields = F.when(in_mine & in_theirs, both).when(in_theirs, F.col("theirs.fields")).otherwise(F.col("own"))
    held, based = lambda side, k: F.map_contains_key(f"{side}_runs", k), lambda k: F.map_contains_key("base_runs", k)
    from_theirs = F.transform(F.filter(all_theirs, lambda k: held("mine", k) | ~based(k)), lambda k: F.when(held("mine", k) & run_changed(k), value("mine_runs", k)).otherwise(value("theirs_runs", k)))
    from_mine = F.transform(F.filter(all_mine, lambda k: ~held("theirs", k) & run_changed(k)), lambda k: value("mine_runs", k))
    runs = F.array_sort(F.transform(F.concat(from_theirs, from_mine), lambda r: F.struct(r["run_date"], r["recorded_at"], r["run_id"], r["text"].alias("text"))))
    texts = F.concat(F.transform(runs, lambda r: r["text"]), F.when(in_theirs, F.col("theirs.bad_runs")).otherwise(F.col("mine.bad_runs")))
    listed = F.create_map(F.lit("runs"), F.parse_json(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))))
    doc = F.to_json(F.map_concat(F.transform_values(fields, lambda _, v: F.parse_json(v)), listed))
    return rows.select("device_id", doc.alias("doc"), F.lit(False).alias("kept")).unionByName(unread)
