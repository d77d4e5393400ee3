"""Boundary values of the criteria, merges and the synthetic phantom."""

import datetime as dt
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from phantomlake.functions import rules as R
from phantomlake.functions import scalars as S
from phantomlake.operators import archive, devices, history, nps, phantom, rois, store


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("v", "status"), [(7.0, "ok"), (-7.1, "nc"), (24.999, "nc"), (25.0, "nc_or_ncg"), (-25.0, "nc_or_ncg"), (25.001, "ncg"), (None, "pending")])
def test_water_ct(spark, v, status):
    assert value(spark, R.water_ct_status(F.lit(v).cast("double"))) == status


@pytest.mark.parametrize(("v", "status"), [(7.0, "ok"), (7.5, "nc")])
def test_uniformity(spark, v, status):
    assert value(spark, R.uniformity_status(F.lit(v))) == status


@pytest.mark.parametrize(("v", "ref", "status"), [(3.74, 3.4, "ok"), (3.75, 3.4, "nc"), (1.2, 1.0, "ok"), (0.1, 0.0, "ok"), (3.4, None, "pending")])
def test_noise(spark, v, ref, status):
    assert value(spark, R.noise_status(F.lit(v), F.lit(ref).cast("double"))) == status


@pytest.mark.parametrize(("v", "ref", "status"), [(0.341, 0.31, "ok"), (0.342, 0.31, "nc"), (0.3, 0.0, "pending"), (0.3, None, "pending"), (None, 0.3, "pending")])
def test_nps(spark, v, ref, status):
    assert value(spark, R.nps_status(F.lit(v).cast("double"), F.lit(ref).cast("double"))) == status


@pytest.mark.parametrize(("each", "overall"), [(["ok"] * 5, "ok"), (["ok"] * 4 + ["pending"], "incomplete"), (["pending"] * 5, "pending"), (["nc", "nc_or_ncg", "ok", "ok", "ok"], "nc_or_ncg"), (["ncg", "nc_or_ncg", "nc", "ok", "pending"], "ncg")])
def test_overall(spark, each, overall):
    assert value(spark, R.overall_status(*map(F.lit, each))) == overall


@pytest.mark.parametrize(("x", "n", "text"), [(1.25, 1, "1,2"), (2.5, 0, "2"), (-0.5, 1, "-0,5"), (None, 2, None)])
def test_format(spark, x, n, text):
    assert value(spark, S.format_fr(F.lit(x).cast("double"), n)) == text


@pytest.mark.parametrize(("old", "new", "pair"), [("/data/2026/S1", "/archive/2026/S1", ("/data", "/archive")), ("/data/2026/S1", "/archive/old/2026/S1", ("/data", "/archive/old")), ("/a/x", "/b/y", ("/a/x", "/b/y")), ("/a", "/a", None), ("", "/a", None)])
def test_relocation(spark, old, new, pair):
    found = value(spark, archive.relocation_between(F.lit(old), F.lit(new)))
    assert (tuple(found) if found else None) == pair


def test_relocation_needs_whole_components(spark):
    assert value(spark, archive.apply_relocation(F.lit("/data/x"), F.lit("/dat"), F.lit("/arch"))) is None
    assert value(spark, archive.apply_relocation(F.lit("/data/x"), F.lit("/data"), F.lit("/arch"))) == "/arch/x"


def test_three_way(spark):
    """Keys: 1 everywhere, 2 new here, 3 new there, 4 removed here but changed there, 5 removed there and unchanged
    here, 6 removed there but changed here."""
    df = lambda rows: spark.createDataFrame(rows, "k long, f string, g string")
    base = df([(1, "a", "b"), (4, "a", "b"), (5, "a", "b"), (6, "a", "b")])
    mine = df([(1, "A", "b"), (2, "n", "n"), (5, "a", "b"), (6, "A", "b")])
    theirs = df([(1, "t", "T"), (3, "m", "m"), (4, "t", "t")])
    got = store.three_way_fields(base, mine, theirs, ["k"], ["f", "g"]).collect()
    assert sorted(map(tuple, got)) == [(1, "A", "T"), (2, "n", "n"), (3, "m", "m"), (6, "A", "b")]
    whole = store.three_way_rows(base, mine, theirs, ["k"], ["f", "g"]).collect()
    assert sorted(map(tuple, whole)) == [(1, "mine", "A", "b"), (2, "mine", "n", "n"), (3, "theirs", "m", "m"), (6, "mine", "A", "b")]


def test_upsert_inherits_both_action_fields(spark):
    rows = [(1, "d", "r", "fix", "2026-01-01"), (2, "d", "r", "", ""), (3, "e", "r", "", "2026-01-02")]
    got = history.upsert(spark.createDataFrame(rows, "event_id long, device_id string, run_id string, corrective_action string, corrective_action_date string"))
    assert sorted((r.event_id, r.corrective_action, r.corrective_action_date, r.replaced) for r in got.collect()) == [(2, "fix", "2026-01-01", True), (3, "", "2026-01-02", False)]


def test_csv_file(spark, tmp_path):
    run = spark.sql("select 'd' as device_id, date'2026-03-15' as run_date, timestamp'2026-03-15 10:00:00' as recorded_at, 1L as event_id, 1.25D as water_ct, 2.0D as uniformity, null as noise, null as nps_freq, false as artifacts_present, 3.4D as ref_noise, 0.31D as ref_nps_freq, 120D as kvp, 200D as mas, '' as corrective_action, '' as corrective_action_date, 'a;b<c' as notes, null as pdf_path")
    run = run.withColumns({x: F.col(x).cast("double") for x in ("noise", "nps_freq")}).withColumns(R.statuses())
    history.write_csv(run, str(tmp_path / "out"))
    data = next((tmp_path / "out").rglob("*.txt")).read_bytes()
    assert data.startswith(b"\xef\xbb\xbfdate;kV;mAs;") and data.endswith(b"\r\n")
    assert data.decode("utf-8-sig").split("\r\n")[1] == '2026-03-15;120;200;1,2;2,0;;3,40;;0,310;0;Incomplet;;;"a;b<c";'


def test_spectrum_keeps_energy(spark):
    """The cells of a spectrum add up to px² times the energy of the tile, in both transforms."""
    z = np.random.default_rng(3).normal(0, 10, 64)
    tile = spark.createDataFrame([(1, z.tolist())], "series_id long, z array<double>")
    power = tile.select(nps.power(F.col("z"), 8, F.lit(0.5)).alias("p")).first()["p"]
    want = np.abs(np.fft.fftshift(np.fft.fft2(z.reshape(8, 8)))) ** 2 * 0.25 / 64
    assert np.allclose(power, want.ravel()) and np.isclose(sum(power), 0.25 * (z * z).sum())
    native = tile.select(nps.power(nps.detrended(F.col("z"), 8), 8, F.lit(0.5)).alias("p")).first()["p"]
    kernel = [r["power"] for r in nps.mean_spectrum_fft(tile, 0.5).orderBy("cell").collect()]
    assert np.allclose(native, kernel)


def test_white_noise_level(spark):
    """The published limits: 300 tiles, the mean within 1 %, each ring within 8 %."""
    rng = np.random.default_rng(1)
    tiles = spark.createDataFrame([(1, rng.normal(0, 10, 64 * 64).tolist()) for _ in range(300)], "series_id long, z array<double>")
    rings = nps.radial(nps.mean_spectrum_fft(tiles, 0.5).select("series_id", "cell", "power"), 64, 0.5).collect()
    assert len(rings) == 45
    level = np.array([r.power for r in rings if r.ring >= 4]) / 25
    assert abs(level.mean() - 1) < 0.01 and abs(level - 1).max() < 0.08
    fit = nps.fitted(spark.createDataFrame(rings)).toPandas().sort_values("ring")
    want = np.maximum(np.polyval(np.polyfit(fit["freq"], fit["power"], 11), fit["freq"]), 0)
    assert np.allclose(fit["fit"], want) and not np.allclose(fit["fit"], fit["power"])


@pytest.mark.parametrize(("row", "col", "noise", "bubble", "table"), [(256, 256, 25, 0, False), (266, 249, 25, 8, False), (270, 240, 40, 8, True)])
def test_detects_synthetic_phantom(spark, row, col, noise, bubble, table):
    """The published cases and tolerance: 512 px, radius 200, off centre, with an air bubble at 12 o'clock and a table."""
    n, radius, rng = 512, 200, np.random.default_rng(0)
    y, x = np.mgrid[:n, :n]
    r = np.hypot(y - row, x - col)
    hu = np.where(r <= radius + 8, 120.0, -1000.0)
    hu[r <= radius] = rng.normal(0, noise, int((r <= radius).sum()))
    hu[(np.hypot(y - (row - radius + bubble), x - col) <= bubble) & (r <= radius) & (bubble > 0)] = -1000.0
    if table:
        hu[500:510] = rng.normal(20, 10, (10, n))
    rows = spark.createDataFrame([(1, k, hu[k].tolist()) for k in range(n)], "slice_id long, row_idx int, hu array<double>")
    found = phantom.detect_phantom(rows).first()
    assert abs(found.center_row - row) <= 0.5 and abs(found.center_col - col) <= 0.5 and abs(found.radius - radius) <= 0.5 and found.n_points >= 60
    start = spark.createDataFrame([(1, 300.0, 200.0)], "slice_id long, center_row double, center_col double")
    again = phantom.detect_phantom(rows, start).first()
    assert abs(again.center_row - found.center_row) < 0.1 and abs(again.radius - found.radius) < 0.1


def test_fallback_geometry(spark):
    """Without water the centre is half the rows and columns, the radius from the reconstruction diameter if there is one."""
    empty = spark.createDataFrame([(i, k, [-1000.0] * 40) for i in (1, 2, 3) for k in range(32)], "slice_id long, row_idx int, hu array<double>")
    hints = spark.createDataFrame([(1, 250.0, 0.5), (2, 0.0, 0.5)], "slice_id long, reconstruction_diameter double, px double")
    got = {r.slice_id: tuple(r)[1:] for r in phantom.detect_phantom(empty, hints).collect()}
    assert got == {1: (16.0, 20.0, 250.0, 0), 2: (16.0, 20.0, 12.8, 0), 3: (16.0, 20.0, 12.8, 0)}
    assert {r.slice_id: tuple(r)[1:] for r in phantom.detect_phantom(empty).collect()}[1] == (16.0, 20.0, 12.8, 0)


def test_robust_circle_drops_outliers():
    angle = np.arange(72) * 2 * np.pi / 72
    row, col = 50 + 20 * np.sin(angle), 60 + 20 * np.cos(angle)
    row[15:21] += 9
    got = phantom.robust(row, col)
    assert np.allclose(got[:3], (50, 60, 20), atol=0.05) and got[3] == 66
    assert phantom.robust(row[:2], col[:2]) is None and phantom.robust(np.arange(9.0), np.arange(9.0)) is None


def test_equal_components_go_to_the_first(spark):
    assert phantom.largest(np.array([0, 2]), np.array([3, 0]), np.array([4, 1])) == (2, 0.0, 3.5)
    u = np.array([(0, 0, 0), (0, 4, 4), (1, 0, 4), (2, 2, 2), (4, 0, 5)])
    assert phantom.largest(*u.T) == (8, 7 / 8, 2.0)


@pytest.mark.parametrize(("d", "px", "side"), [(404.0, 0.469, 64), (438.0, 0.469, 64), (870.0, 0.234, 128), (174.0, 1.172, 32), (2000.0, 0.1, 128)])
def test_nps_side(spark, d, px, side):
    assert value(spark, rois.roi_geometry(F.lit(d), F.lit(px))["nps_roi_size"]) == side


def test_geometry(spark):
    g = {k: value(spark, v) for k, v in rois.roi_geometry(F.lit(400.0), F.lit(0.5)).items()}
    assert (g["central_radius"], g["peripheral_radius"], g["peripheral_distance"]) == (80, 20, 155)
    assert value(spark, rois.roi_geometry(F.lit(400.0), F.lit(0.0))["central_radius"]) is None


@pytest.fixture
def given_runs(spark):
    from phantomlake.sources.views import view

    return view(spark, "/root/testdata/sf0.001", "qc_runs")


def as_rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_streaming_equals_batch(spark, tmp_path, given_runs):
    """Values, not only keys, whatever order the files come in; a new checkpoint on the store changes nothing."""
    from phantomlake.streaming import runs as live

    given_runs.repartition(3).write.parquet(str(tmp_path / "in"))
    path, schema = str(tmp_path / "store"), given_runs.withColumn("action_event", F.lit(1).cast("long")).schema
    want = as_rows(history.upsert(given_runs).drop("replaced"))
    for checkpoint in ("a", "b"):
        stream = spark.readStream.schema(given_runs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        live.follow(stream, path, str(tmp_path / checkpoint), buckets=4).awaitTermination(120)
        assert as_rows(store.read_runs(spark, path, schema).drop("action_event")) == want
    store.tidy(spark, path)
    assert as_rows(store.read_runs(spark, path, schema).drop("action_event")) == want
    judged = live.judged(spark.readStream.schema(given_runs.schema).parquet(str(tmp_path / "in")), given_runs.select("device_id").distinct())
    judged.writeStream.format("memory").queryName("judged").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("judged").filter("known").count() == given_runs.count()
    batch = {r.event_id: r.overall for r in given_runs.withColumns(R.statuses()).collect()}
    assert {r.event_id: r.overall for r in spark.table("judged").collect()} == batch


@pytest.mark.parametrize(("px", "g_px", "rows", "fits"), [(201.0, 200.0, 512, False), (200.99, 200.0, 512, True), (199.0, 200.0, 512, False), (0.0, 0.0, 512, False), (0.5, 0.0, 512, False), (0.5, -1.0, 512, False), (0.5, None, 512, False), (0.5, 0.5, 1024, False), (0.5, 0.5, 512, True)])
def test_geometry_fits_strictly_below_the_limit(spark, px, g_px, rows, fits):
    lit = F.lit
    assert value(spark, devices.geometry_fits(lit(512), lit(512), lit(px), lit(rows), lit(512), lit(g_px).cast("double"))) is fits


def test_trend_ranges_come_from_the_points_of_each_metric(spark):
    """One day of noise gets 90 days on both sides, a metric without points none; long spans 5 % in whole days."""
    schema = "device_id string, event_id long, run_date date, water_ct double, uniformity double, noise double, nps_freq double"
    day = dt.date.fromisoformat
    runs = spark.createDataFrame([("a", 1, day("2025-01-01"), 1.0, 2.0, None, None), ("a", 2, day("2025-06-01"), 1.0, None, 5.0, None), ("a", 3, day("2025-07-30"), 1.0, None, None, None), ("a", 4, None, None, None, 3.0, 0.2)], schema)
    refs = spark.createDataFrame([("a", 5.0, 0.3)], "device_id string, ref_noise double, ref_nps_freq double")
    got = {r.metric: (str(r.from_date), str(r.to_date)) for r in history.trend_bands(runs, refs).collect()}
    assert got == {"water_ct": ("2024-12-22", "2025-08-09"), "uniformity": ("2024-10-03", "2025-04-01"), "noise": ("2025-03-03", "2025-08-30"), "nps_freq": ("None", "None")}


def test_run_keys(spark):
    """The series names a control, else its date and content: the same in any order and partitioning, 8 hexadecimal digits."""
    rows = spark.createDataFrame([("1.2.3", "2026-01-02", 1.5), ("", "2026-01-02", 1.5), (None, "2026-01-02", 1.5), ("", "2026-01-02", 2.5), ("", None, 1.5)], "uid string, day string, value double")
    keyed = lambda df: sorted((str(r.uid), str(r.day), r.value, r.k) for r in df.select("*", S.run_key(F.col("uid"), F.col("day"), F.col("day"), F.col("value")).alias("k")).collect())
    got = keyed(rows)
    assert got == keyed(rows.orderBy(F.desc("value")).repartition(5))
    keys = {x[:3]: x[3] for x in got}
    assert keys["1.2.3", "2026-01-02", 1.5] == "1.2.3" and keys["", "2026-01-02", 1.5] == keys["None", "2026-01-02", 1.5] != keys["", "2026-01-02", 2.5]
    assert re.fullmatch("2026-01-02-[0-9a-f]{8}", keys["", "2026-01-02", 1.5]) and re.fullmatch("date-[0-9a-f]{8}", keys["", "None", 1.5])
    manual = [r[0] for r in rows.select(S.manual_id(F.col("uid"), F.col("value"))).collect()]
    assert all(re.fullmatch("manual-[0-9a-f]{8}", x) for x in manual) and len(set(manual)) == 4
