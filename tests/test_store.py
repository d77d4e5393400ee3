"""The store: buckets under manifests, merges of several writers, removals, recording as one transaction."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from phantomlake.operators import history, ledger, series, store
from phantomlake.sources.views import view
from phantomlake.streaming import runs as live

SF = "/root/testdata/sf0.001"


@pytest.fixture
def given_runs(spark):
    return view(spark, SF, "qc_runs")


def schema_of(runs):
    return runs.drop("deleted").withColumn("action_event", F.lit(1).cast("long")).schema


def as_rows(df):
    return sorted(map(str, df.select(sorted(set(df.columns) - {"action_event"})).collect()))


def stored(spark, path, runs, **more):
    return as_rows(store.read_runs(spark, path, schema_of(runs), **more))


def test_writing_one_device_leaves_the_others(spark, tmp_path, given_runs):
    """A write that dies half way, before or in its manifest, loses nothing, and only touched buckets are written."""
    path = str(tmp_path / "store")
    device = given_runs.groupBy("device_id").count().orderBy("device_id").first()["device_id"]
    first = store.write_runs(given_runs.filter(F.col("device_id") != device), path, buckets=8)
    (tmp_path / "store" / "data" / "runs-dead" / "bucket=0").mkdir(parents=True)
    second = store.write_runs(given_runs.filter(F.col("device_id") == device), path)
    want = as_rows(history.upsert(given_runs).drop("replaced"))
    assert stored(spark, path, given_runs) == want
    assert (first.version, second.version) == (0, 1) and len([b for b, x in second.tables["runs"].items() if first.tables["runs"].get(b) != x]) == 1
    assert store.write_runs(given_runs.limit(0), path) is None
    unfinished = tmp_path / "store" / "manifest" / "000000000002.json"
    unfinished.write_text('{"version": 2, ')
    assert stored(spark, path, given_runs) == want
    stale, ledger.STALE_S = ledger.STALE_S, -1.0
    try:
        assert store.write_runs(given_runs, path).version == 3
    finally:
        ledger.STALE_S = stale
    assert stored(spark, path, given_runs) == want
    gone = store.tidy(spark, path, grace_s=0)
    assert any("runs-dead" in x for x in gone) and any(x.endswith("manifest/000000000002.json") for x in gone)
    assert stored(spark, path, given_runs) == want and store.tidy(spark, path, grace_s=0) == []


def test_the_first_write_fixes_the_buckets(spark, tmp_path, given_runs):
    path = str(tmp_path / "store")
    store.write_runs(given_runs, path, buckets=64)
    with pytest.raises(ValueError, match="64 buckets, not 32"):
        store.write_runs(given_runs.limit(200), path, buckets=32)
    store.write_runs(given_runs.limit(200), path)
    assert stored(spark, path, given_runs) == as_rows(history.upsert(given_runs).drop("replaced"))
    some = store.read_runs(spark, path, schema_of(given_runs), buckets=[1, 2, 3]).count()
    assert some == given_runs.filter(ledger.bucket_of(64).isin(1, 2, 3)).select("device_id", "run_id").distinct().count()


def test_newer_stores_are_not_written(spark, tmp_path, given_runs):
    path = str(tmp_path / "store")
    store.write_runs(given_runs, path, buckets=4)
    newest = tmp_path / "store" / "manifest" / "000000000000.json"
    text = newest.read_text()
    crc = newest.with_name(f".{newest.name}.crc")
    crc.unlink(missing_ok=True)
    newest.write_text(json.dumps(json.loads(text) | {"schema_version": ledger.SCHEMA_VERSION + 1}))
    for write in (lambda: store.write_runs(given_runs, path), lambda: store.record(given_runs, path, schema_of(given_runs)), lambda: store.put_devices(given_runs.select("device_id").distinct(), path)):
        with pytest.raises(ValueError, match="this library writes"):
            write()
    assert len(list((tmp_path / "store" / "data").iterdir())) == 1


def test_two_writers_at_once(spark, tmp_path, given_runs):
    path, errors = str(tmp_path / "store"), []
    store.write_runs(given_runs.filter("event_id % 3 = 0"), path, buckets=2)

    def work(rest):
        try:
            for part in range(3):
                store.write_runs(given_runs.filter(f"event_id % 9 = {rest + 3 * part}"), path)
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    assert not errors and stored(spark, path, given_runs) == as_rows(history.upsert(given_runs).drop("replaced"))
    assert ledger.manifest(spark, path).version == 6


def test_a_taken_version_is_a_conflict(spark, tmp_path, given_runs):
    path = str(tmp_path / "store")
    store.write_runs(given_runs, path, buckets=2)
    found = ledger.for_writing(spark, path)
    ledger.commit(spark, path, found, {}, {})
    with pytest.raises(ledger.Conflict):
        ledger.commit(spark, path, found, {}, {})


def test_a_thousand_versions_take_one_manifest(spark, tmp_path, given_runs, monkeypatch):
    path = str(tmp_path / "store")
    store.write_runs(given_runs, path, buckets=4)
    now = ledger.for_writing(spark, path)
    for _ in range(1000):
        now = ledger.commit(spark, path, now, {}, {})
    read, plain = [], ledger._Store.read
    monkeypatch.setattr(ledger._Store, "names", lambda *a: pytest.fail("a folder was listed"))
    monkeypatch.setattr(ledger._Store, "read", lambda self, name: read.append(name) or plain(self, name))
    assert ledger.manifest(spark, path).version == 1000 and read == ["manifest/latest", "manifest/000000001000.json"]
    monkeypatch.undo()
    assert len(store.tidy(spark, path, keep=2, grace_s=0)) == 999
    assert stored(spark, path, given_runs) == as_rows(history.upsert(given_runs).drop("replaced"))


RUN = "device_id string, run_id string, event_id long, run_date string, recorded_at string, noise double, corrective_action string, corrective_action_date string"


def run(device, k, event, noise, deleted=False):
    return (device, f"r{k}", event, "2026-01-01", "2026-01-02", noise, "", "", deleted)


@pytest.fixture
def sides(spark):
    """The common ancestor, and what one side and the other make of it."""
    table = lambda rows: spark.createDataFrame(rows, f"{RUN}, deleted boolean")
    base = [run("d", k, k, float(k)) for k in range(12)]
    # there: 0 and 1 removed, 2 and 3 changed, 20 added; here: 1 and 3 changed, 2 and 4 removed, 5 and 21 as they are and added
    there = [run("d", 0, 100, None, True), run("d", 1, 101, None, True), run("d", 2, 102, 2.5), run("d", 3, 103, 3.5), run("d", 20, 104, 20.0)]
    here = [run("d", 1, 50, 1.75), run("d", 3, 110, 3.75), run("d", 2, 51, None, True), run("d", 4, 52, None, True), run("d", 5, 5, 5.0), run("d", 21, 111, 21.0)]
    return table(base), table(there), table(here)


def applied(base, changes):
    kept = base.join(changes, ["device_id", "run_id"], "left_anti")
    return kept.unionByName(changes.filter("not deleted")).drop("deleted")


def test_a_three_way_fold_equals_the_batch_merge(spark, tmp_path, sides):
    """Removed there and changed here, the other way round, batches repeated, and a new checkpoint."""
    base, there, here = sides
    path = str(tmp_path / "store")
    store.write_runs(base, path, buckets=4, consumer="here")
    store.write_runs(there, path)
    fields = [c for c in base.columns if c not in ("device_id", "run_id", "deleted")]
    merged = store.three_way_rows(base.drop("deleted"), applied(base, here), applied(base, there), ["device_id", "run_id"], fields).drop("side")
    want = as_rows(merged)
    assert {r.run_id for r in merged.collect()} == {f"r{k}" for k in (1, 3, *range(5, 12), 20, 21)}
    here.coalesce(1).write.parquet(str(tmp_path / "in"))
    for checkpoint in ("a", "a", "b"):
        stream = spark.readStream.schema(here.schema).parquet(str(tmp_path / "in"))
        live.follow(stream, path, str(tmp_path / checkpoint), consumer="here", tidy_every=1).awaitTermination(120)
        assert stored(spark, path, base) == want
    store.write_runs(here, path, consumer="here")
    store.write_runs(base, path)  # an old copy that comes late brings nothing back
    assert stored(spark, path, base) == want
    store.write_runs(spark.createDataFrame([run("d", 0, 200, 0.5)], here.schema), path)  # a new control after the removal does
    assert "r0" in {r.run_id for r in store.read_runs(spark, path, schema_of(base)).collect()}


def test_removals_reach_a_consumer_that_was_away(spark, tmp_path, sides):
    """Rows that a consumer has not changed since it last looked stay removed."""
    base, there, _ = sides
    path = str(tmp_path / "store")
    store.write_runs(base, path, buckets=4, consumer="here")
    store.write_runs(there, path)
    store.tidy(spark, path, grace_s=0)  # keeps what the consumer last saw
    store.write_runs(base, path, consumer="here")
    assert stored(spark, path, base) == as_rows(applied(base, there))


DEVICE = f"device_id string, geometry {series.GEOMETRY}, hu_slice int, nps_start int, nps_end int, slices_series_length int"


def geometry(size, day=""):
    return (0.5, 512, 512, 400.0, 80, 20, 155, size, 91, 73, day)


def test_recording_is_one_transaction(spark, tmp_path):
    """The first control with a detected phantom freezes the geometry, saved slices get their length, and runs are upserted."""
    path = str(tmp_path / "store")
    scanners = spark.createDataFrame([("new", None, 3, 1, 6, None), ("old", geometry(48, "2020-01-01"), 3, 1, 6, None), ("idle", None, 3, 1, 6, None)], DEVICE)
    more = f"{RUN}, geometry {series.GEOMETRY}, hu_detected boolean, nps_detected boolean, nps_freq double, hu_slice int, nps_start int, nps_end int, n_slices int"
    made = lambda device, k, day, g, found, *slices: (device, f"r{k}", k, day, f"{day or '2026-05-05'}T10:00:00", 5.0, "", "", g, found, found, 0.3, *slices)
    runs = spark.createDataFrame([made("new", 1, "2026-02-01", geometry(64), True, 3, 1, 6, 12), made("new", 0, "2026-01-01", geometry(32), False, 3, 1, 7, 11), made("old", 2, "2026-01-01", geometry(64), True, 4, 1, 6, 12)], more)
    store.put_devices(scanners, path, buckets=4)
    before = ledger.manifest(spark, path)
    with pytest.raises(LookupError, match="stranger"):
        store.record(runs.unionByName(spark.createDataFrame([made("stranger", 9, "2026-01-01", None, True, 1, 1, 1, 1)], more)), path, scanners.schema)
    assert ledger.manifest(spark, path) == before
    store.record(runs, path, scanners.schema)
    after = ledger.manifest(spark, path)
    assert after.version == before.version + 1 and set(after.tables) == {"devices", "runs"}
    got = {r.device_id: r for r in store.read_devices(spark, path, scanners.schema).collect()}
    assert (got["new"].geometry.nps_roi_size, got["new"].geometry.frozen_date, got["new"].slices_series_length) == (64, "2026-02-01", 12)
    assert (got["old"].geometry.nps_roi_size, got["old"].geometry.frozen_date, got["old"].slices_series_length) == (48, "2020-01-01", None)
    assert (got["idle"].geometry, got["idle"].slices_series_length) == (None, None)
    store.record(spark.createDataFrame([made("new", 5, "", geometry(128), True, 3, 1, 6, 20)], more), path, scanners.schema)
    again = {r.device_id: r for r in store.read_devices(spark, path, scanners.schema).collect()}
    assert again["new"] == got["new"] and store.read_runs(spark, path, schema_of(runs)).count() == 4
    undated = spark.createDataFrame([made("idle", 7, "", geometry(96), True, 9, 9, 9, 9)], more)
    store.record(undated, path, scanners.schema)
    assert {r.device_id: r for r in store.read_devices(spark, path, scanners.schema).collect()}["idle"].geometry.frozen_date == "2026-05-05"
