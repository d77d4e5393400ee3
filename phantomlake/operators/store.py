"""The store of scanners and controls: documents, quarantine, merges, relocations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from phantomlake.operators import history, ledger


def quarantine(documents: DataFrame, json_col: str, schema: str, required: str) -> DataFrame:
    """Parsed documents with `bad`: text that is no such JSON, or lacks the required field. Nothing is dropped."""
    parsed = documents.withColumn("parsed", F.from_json(json_col, schema))
    # from_json turns broken text into a row of nulls, so a missing required field tells both cases
    return parsed.withColumn("bad", F.col("parsed").isNull() | F.col(f"parsed.{required}").isNull())


def extra_keys(json: Column, known: list[str]) -> Column:
    """The keys of a JSON object that the schema does not know, with their values as text."""
    return F.map_filter(F.from_json(json, "map<string,string>"), lambda k, _: ~k.isin(*known))


def guard_version(documents: DataFrame, version_col: str, supported: int) -> None:
    """Raises where a newer writer has been at work; call it before writing."""
    newest = documents.agg(F.max(version_col)).first()[0]
    if newest is not None and newest > supported:
        raise ValueError(f"the store has version {newest}, this library writes {supported}")


def device_documents(devices: DataFrame, runs: DataFrame) -> DataFrame:
    """One document per device with its runs nested, in order of date and recording."""
    each = F.struct("run_date", "recorded_at", "event_id", "run_id", "overall")
    nested = runs.groupBy("device_id").agg(F.array_sort(F.collect_list(each)).alias("runs"))
    return devices.join(nested, "device_id", "left")


def flat_runs(documents: DataFrame) -> DataFrame:
    """Documents back to one row per run; a device without runs keeps one row of nulls."""
    return documents.select("device_id", F.explode_outer("runs").alias("r")).select("device_id", "r.*")


def run_layout(runs: DataFrame) -> DataFrame:
    """The place of each run in its device's file."""
    return runs.withColumn("position", F.row_number().over(Window.partitionBy("device_id").orderBy("run_date", "recorded_at", "event_id")) - 1)


_KEYS = ["device_id", "run_id"]
_MARKS = "deleted boolean, deleted_version long"


def _stored(schema: StructType) -> StructType:
    return StructType([f for f in schema.fields if f.name not in ("deleted", "deleted_version")] + StructType.fromDDL(_MARKS).fields)


def read_runs(spark: SparkSession, path: str, schema: StructType, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
    """The stored runs (of some buckets, as of a version that is kept): one row per device and run, deleted ones left out."""
    rows = ledger.read(spark, path, ledger.manifest(spark, path, version), "runs", _stored(schema), buckets)
    return rows.filter(~F.coalesce("deleted", F.lit(False))).select(*schema.names)


def folded(theirs: DataFrame, base: DataFrame, batch: DataFrame, base_version: int, version: int) -> DataFrame:
    """The runs of the store (`theirs`) after a batch of somebody who last saw `base`.

    A run of the batch meets the stored one as the upsert does, by event_id and with its corrective action. A row of the
    batch with `deleted` removes its run, even one changed elsewhere meanwhile, and stays as a mark. A run that is marked
    as removed comes back only through a row that is new to whoever brings it (its event_id is greater than in `base`) and
    either later than the removal or brought by one who had not seen it. So batches may be repeated.
    """
    live, dead = theirs.filter(~F.coalesce("deleted", F.lit(False))), theirs.filter("deleted")
    payload = [c for c in theirs.columns if c not in ("deleted", "deleted_version")]
    fresh = history.latest(batch.filter(~F.col("deleted")).select(*payload))
    candidates = history.latest(live.select(*payload).unionByName(fresh))
    marks = dead.select(*_KEYS, F.col("event_id").alias("_d"), F.col("deleted_version").alias("_v"))
    gone = batch.filter("deleted").groupBy(*_KEYS).agg(F.max("event_id").alias("_x"))
    news, seen = fresh.select(*_KEYS, F.col("event_id").alias("_u")), base.select(*_KEYS, F.col("event_id").alias("_b"))
    rows = candidates.select(*_KEYS, F.struct(*payload).alias("r")).join(marks, _KEYS, "full_outer").join(gone, _KEYS, "full_outer").join(news, _KEYS, "left").join(seen, _KEYS, "left")
    x, u, b = F.col("_x"), F.col("_u"), F.col("_b")
    removed = x.isNotNull() & (b.isNull() | (x > b)) & (u.isNull() | (x >= u))
    back = (b.isNull() | (u > b)) & ((F.col("_v") > base_version) | (u > F.col("_d")))
    stays_dead = F.col("_v").isNotNull() & ~F.coalesce(back, F.lit(False))
    unknown = F.col("r").isNull() & F.col("_v").isNull()  # a removal of what the store never had stays as a mark, too
    mark = F.coalesce(removed, F.lit(False)) | stays_dead | unknown
    event = F.when(F.coalesce(removed, F.lit(False)) | unknown, F.greatest(x, F.col("r.event_id"), F.col("_d"))).otherwise(F.col("_d"))
    since = F.when(F.coalesce(removed, F.lit(False)) | unknown, F.lit(version)).otherwise(F.col("_v"))
    kept = [F.when(~mark, F.col(f"r.{c}")).alias(c) for c in payload if c not in (*_KEYS, "event_id")]
    return rows.select(*_KEYS, F.when(mark, event).otherwise(F.col("r.event_id")).alias("event_id"), *kept, mark.alias("deleted"), F.when(mark, since).cast("long").alias("deleted_version")).select(*payload, "deleted", "deleted_version")


def _prepared(runs: DataFrame) -> DataFrame:
    rows = runs.drop("action_event", "deleted_version").withColumn("action_event", history.action_event())
    return rows.withColumn("deleted", F.coalesce("deleted", F.lit(False)) if "deleted" in runs.columns else F.lit(False))


def _folded_runs(rows: DataFrame, path: str, found: ledger.Manifest, consumer: str | None, touched: list[int]) -> DataFrame:
    """The touched buckets of runs after the rows, for a manifest to come."""
    spark, schema = rows.sparkSession, _stored(rows.schema)
    theirs = ledger.read(spark, path, found, "runs", schema, touched)
    seen = found.consumers.get(consumer) if consumer else None
    base = theirs if seen is None else ledger.read(spark, path, ledger.manifest(spark, path, seen), "runs", schema, touched)
    return folded(theirs, base, rows, found.version if seen is None else seen, found.version + 1)


def write_runs(runs: DataFrame, path: str, buckets: int | None = None, consumer: str | None = None, attempts: int = 8) -> ledger.Manifest | None:
    """Folds runs into the store; rows with `deleted` remove theirs. Only buckets of devices that they touch are read, merged
    and written; a version counts once its manifest is there, so a failed or repeated write loses nothing and changes nothing
    twice, and of two writers at once the slower one merges again. The number of buckets is fixed by the first write.

    `consumer` names who writes: what it last saw is the common ancestor of the merge, else what is stored now.
    """
    rows = _prepared(runs)
    for _ in range(attempts):
        found = ledger.for_writing(runs.sparkSession, path, buckets)
        touched = ledger.touched_by(rows, found.buckets)
        if not touched and (not consumer or found.consumers.get(consumer) == found.version):
            return None
        merged = _folded_runs(rows, path, found, consumer, touched)
        made = {"runs": ledger.write(merged, path, "runs", found.buckets, ["device_id", "run_date", "recorded_at"])} if touched else {}
        try:
            return ledger.commit(runs.sparkSession, path, found, made, {"runs": touched}, consumer)
        except ledger.Conflict:
            continue
    raise ledger.Conflict(f"{path}: {attempts} other writers were faster")


def put_devices(scanners: DataFrame, path: str, buckets: int | None = None, attempts: int = 8) -> ledger.Manifest | None:
    """Adds or replaces scanners (device_id and their fields) in the store."""
    spark = scanners.sparkSession
    for _ in range(attempts):
        found = ledger.for_writing(spark, path, buckets)
        touched = ledger.touched_by(scanners, found.buckets)
        if not touched:
            return None
        stored = ledger.read(spark, path, found, "devices", scanners.schema, touched)
        merged = without(stored, scanners, ["device_id"]).unionByName(scanners)
        try:
            return ledger.commit(spark, path, found, {"devices": ledger.write(merged, path, "devices", found.buckets, ["device_id"])}, {"devices": touched})
        except ledger.Conflict:
            continue
    raise ledger.Conflict(f"{path}: {attempts} other writers were faster")


def read_devices(spark: SparkSession, path: str, schema: StructType, buckets: list[int] | None = None) -> DataFrame:
    return ledger.read(spark, path, ledger.manifest(spark, path), "devices", schema, buckets)


def after_recording(scanners: DataFrame, runs: DataFrame) -> DataFrame:
    """Scanners as new controls leave them: one without a geometry takes that of its first control with a detected phantom,
    frozen on that day; slices saved without the length of their series take it from a control that used them."""
    order = F.struct("run_date", "recorded_at", "event_id")
    day = F.coalesce(F.nullif(F.col("run_date").cast("string"), F.lit("")), F.substring(F.col("recorded_at").cast("string"), 1, 10))
    detected = F.col("hu_detected") & F.coalesce("nps_detected", F.col("nps_freq").isNull()) & F.col("geometry").isNotNull()
    frozen = F.when(detected, F.col("geometry").withField("frozen_date", F.coalesce(F.nullif(F.col("geometry.frozen_date"), F.lit("")), day)))
    first = runs.groupBy("device_id").agg(F.min_by(frozen, F.when(detected, order)).alias("_g"))
    saved = scanners.filter("slices_series_length is null and hu_slice is not null").select("device_id", "hu_slice", "nps_start", "nps_end")
    same = (F.col("s.device_id") == F.col("r.device_id")) & (F.col("s.hu_slice") == F.col("r.hu_slice")) & F.col("s.nps_start").eqNullSafe(F.col("r.nps_start")) & F.col("s.nps_end").eqNullSafe(F.col("r.nps_end"))
    lengths = saved.alias("s").join(runs.alias("r"), same).groupBy("s.device_id").agg(F.min_by("r.n_slices", F.struct("r.run_date", "r.recorded_at", "r.event_id")).alias("_n"))
    rows = scanners.join(first, "device_id", "left").join(lengths, "device_id", "left")
    return rows.withColumns({"geometry": F.coalesce("geometry", "_g"), "slices_series_length": F.coalesce("slices_series_length", "_n")}).select(*scanners.columns)


def record(runs: DataFrame, path: str, device_schema: StructType, consumer: str | None = None, attempts: int = 8) -> ledger.Manifest | None:
    """Records controls as one transaction: runs are upserted, and their scanners take a frozen geometry and the length of
    saved slices from them (see after_recording); readers see all of it or nothing. Controls of scanners that the store does
    not know are an error, and nothing is recorded."""
    spark, rows = runs.sparkSession, _prepared(runs)
    for _ in range(attempts):
        found = ledger.for_writing(spark, path)
        touched = ledger.touched_by(rows, found.buckets)
        if not touched:
            return None
        scanners = ledger.read(spark, path, found, "devices", device_schema, touched)
        strangers = orphans(rows, scanners).select("device_id").distinct().limit(5).collect()
        if strangers:
            raise LookupError(f"unknown scanners: {', '.join(sorted(str(r[0]) for r in strangers))}")
        made = {
            "runs": ledger.write(_folded_runs(rows, path, found, consumer, touched), path, "runs", found.buckets, ["device_id", "run_date", "recorded_at"]),
            "devices": ledger.write(after_recording(scanners, rows.filter("not deleted")), path, "devices", found.buckets, ["device_id"]),
        }
        try:
            return ledger.commit(spark, path, found, made, {"runs": touched, "devices": touched}, consumer)
        except ledger.Conflict:
            continue
    raise ledger.Conflict(f"{path}: {attempts} other writers were faster")


tidy = ledger.tidy


def _sides(base: DataFrame, mine: DataFrame, theirs: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Full outer join of three snapshots: presence flags in_base, in_mine, in_theirs and fields <side>_<field>."""
    out = None
    for side, df in (("base", base), ("mine", mine), ("theirs", theirs)):
        part = df.select(*keys, F.lit(True).alias(f"in_{side}"), *(F.col(f).alias(f"{side}_{f}") for f in fields))
        out = part if out is None else out.join(part, keys, "full_outer")
    return out.withColumns({f"in_{s}": F.coalesce(f"in_{s}", F.lit(False)) for s in ("base", "mine", "theirs")})


def _changed_here(fields: list[str]) -> Column:
    """Whether my row differs from the base (or has none)."""
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"mine_{f}").eqNullSafe(F.col(f"base_{f}"))
    return ~F.col("in_base") | ~same


def _stays(fields: list[str]) -> Column:
    """Which keys the merged table has: on both sides; added on one; or gone there but changed here."""
    mine, theirs, base = F.col("in_mine"), F.col("in_theirs"), F.col("in_base")
    return (mine & theirs) | (theirs & ~mine & ~base) | (mine & ~theirs & _changed_here(fields))


def three_way_fields(base: DataFrame, mine: DataFrame, theirs: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Merge key by key and field by field: my value where I changed it, else theirs. A key removed here stays
    removed even if it changed there; a key removed there stays only if it changed here."""
    rows = _sides(base, mine, theirs, keys, fields).filter(_stays(fields))

    def merged(f: str) -> Column:
        changed = ~F.col("in_base") | ~F.col(f"mine_{f}").eqNullSafe(F.col(f"base_{f}"))
        return F.when(F.col("in_mine") & (~F.col("in_theirs") | changed), F.col(f"mine_{f}")).otherwise(F.col(f"theirs_{f}")).alias(f)

    return rows.select(*keys, *map(merged, fields))


def three_way_rows(base: DataFrame, mine: DataFrame, theirs: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The same merge with whole rows: mine if anything in it changed, else theirs; `side` tells which."""
    rows = _sides(base, mine, theirs, keys, fields).filter(_stays(fields))
    use_mine = F.col("in_mine") & (~F.col("in_theirs") | _changed_here(fields))
    return rows.select(*keys, F.when(use_mine, "mine").otherwise("theirs").alias("side"), *(F.when(use_mine, F.col(f"mine_{f}")).otherwise(F.col(f"theirs_{f}")).alias(f) for f in fields))


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among the removed ones."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def orphans(runs: DataFrame, devices: DataFrame) -> DataFrame:
    """Runs of devices that do not exist."""
    return runs.join(devices.select("device_id"), "device_id", "left_anti")


def keep_relocations(pairs: DataFrame, keep: int = 20) -> DataFrame:
    """Per owner the latest `keep` (old, new) pairs; adding a pair again moves it to the end."""
    last = pairs.groupBy("owner", "old", "new").agg(F.max("seq").alias("seq"))
    w = Window.partitionBy("owner").orderBy(F.desc("seq"))
    return last.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep).drop("rank")


def merge_relocations(base: DataFrame, mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Pairs of theirs unless removed here, then mine that are not among them; (old, new, place, seq)."""
    pair = ["old", "new"]
    removed = base.join(mine.select(*pair), pair, "left_anti").select(*pair)
    kept = theirs.join(removed, pair, "left_anti").withColumn("place", F.lit(0))
    added = mine.join(kept.select(*pair), pair, "left_anti").withColumn("place", F.lit(1))
    return kept.unionByName(added)
