"""Whole series against plain renderings of each step."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from phantomlake.operators import archive, devices, phantom, pixels, rois, series, validation

N, SIDE, PX = 96, 32, 0.5


def image(row, col, radius, seed, noise=12.0):
    y, x = np.mgrid[:N, :N]
    r = np.hypot(y - row, x - col)
    return np.where(r <= radius, np.random.default_rng(seed).normal(3, noise, (N, N)), np.where(r <= radius + 4, 120.0, -1000.0))


@pytest.fixture(scope="module")
def images():
    """Series 1 has 14 slices, series 2 only 4, series 3 no phantom."""
    out = {100 + k: image(46 + k % 2, 49, 42, k) for k in range(14)} | {200 + k: image(48, 48, 40, 50 + k) for k in range(4)}
    return out | {300 + k: np.full((N, N), -1000.0) + np.random.default_rng(k).normal(0, 1, (N, N)) for k in range(10)}


@pytest.fixture(scope="module")
def tables(spark, images):
    rows = spark.createDataFrame([(i, k, x[k].tolist()) for i, x in images.items() for k in range(N)], "slice_id long, row_idx int, hu array<double>")
    return rows.cache(), spark.createDataFrame([(i // 100, i % 100, i, PX, 48.0) for i in images], "series_id long, slice_idx int, slice_id long, px double, reconstruction_diameter double")


def brute(images, first, last, of=100, frozen=None, squares=None):
    """Mean frequency, noise, squares and roi size of the slices of one series, step by step in NumPy; by a frozen (side,
    cardinal distance, diagonal offset), or on squares (side, [(row, column) of centres])."""
    row, col, radius, _ = phantom.found_in(images[of + first + (last - first + 1) // 2], None, 48.0)
    row, col, d = round(row), round(col), 2 * radius
    side = int(min(max(round(d * 0.15 / 8) * 8, 32), 128))
    near, far = int(d / 2 * 0.455), int(d / 2 * 0.367)
    if frozen:
        side, near, far = frozen
    places = [(-far, -far), (far, far), (far, -far), (-far, far), (-near, 0), (near, 0), (0, -near), (0, near)]
    if squares:
        side, places, row, col = squares[0], squares[1], 0, 0
    stds, total = [], 0
    u = np.arange(side) - (side - 1) / 2
    x, y = np.tile(u, side), np.repeat(u, side)
    basis = np.column_stack([np.ones(side * side), x, y, x * x, y * y, x * y])
    for k in range(first, last + 1):
        for dr, dc in places:
            a, b = row + dr - side // 2, col + dc - side // 2
            if a < 0 or b < 0 or a + side > N or b + side > N:
                continue
            z = images[of + k][a : a + side, b : b + side].ravel()
            stds.append(z.std())
            z = z - basis @ np.linalg.lstsq(basis, z, rcond=None)[0]
            total = total + np.abs(np.fft.fftshift(np.fft.fft2(z.reshape(side, side)))) ** 2 * PX * PX / (side * side)
    mean = total / len(stds)
    yy, xx = np.mgrid[:side, :side] - side // 2
    ring = np.floor(np.hypot(yy, xx)).astype(int)
    power = np.array([mean[ring == k].mean() if (ring == k).any() else 0 for k in range(int(side // 2 * 1.375) + 1)])
    freq = np.arange(len(power)) / (side * PX)
    return np.trapezoid(freq * power, freq) / np.trapezoid(power, freq), np.mean(stds), len(stds), side, freq, power


def test_nps_of_series(spark, tables, images):
    rows, slices = tables
    found = series.nps_of_series(rows, slices, N, N)
    got = {r.series_id: r for r in found.series.collect()}
    mean, noise, n, side, freq, power = brute(images, 2, 11)
    r = got[1]
    assert (r.n_slices, r.first, r.last, r.n_tiles, r.roi_size, r.detected, r.error) == (14, 2, 11, n, side, True, None)
    assert np.isclose(r.mean_freq, mean) and np.isclose(r.noise, noise)
    rings = found.rings.filter("series_id = 1").toPandas().sort_values("ring")
    assert np.allclose(rings["power"], power) and np.allclose(rings["freq"], freq)
    assert np.allclose(rings["fit"], np.maximum(np.polyval(np.polyfit(freq, power, 11), freq), 0))
    assert got[2].error.startswith("l'analyse du SPB demande au moins 10 coupes") and got[2].mean_freq is None
    assert not got[3].detected and got[3].diameter_px == 96.0


def test_given_ranges_and_squares_outside(spark, tables, images):
    rows, slices = tables
    given = slices.filter("series_id = 1").withColumns({"first": F.lit(-3), "last": F.lit(4)})
    r = series.nps_of_series(rows, given, N, N).series.first()
    mean, noise, n, *_ = brute(images, 0, 4)
    assert (r.first, r.last, r.n_tiles) == (0, 4, n) and np.isclose(r.mean_freq, mean) and np.isclose(r.noise, noise)
    empty = series.nps_of_series(rows, slices.filter("series_id = 1").withColumns({"first": F.lit(20), "last": F.lit(30)}), N, N).series.first()
    assert empty.error == series.EMPTY_RANGE
    corner = slices.filter("series_id = 1").withColumns({"center_row": F.lit(5.0), "center_col": F.lit(5.0)})
    r = series.nps_of_series(rows, corner, N, N).series.first()
    assert len(r.skipped) == 8 - r.n_tiles // 10 and 0 in r.skipped


def test_controls_and_reanalysis(spark, tables, images):
    rows, slices = tables
    headers = spark.createDataFrame([(1, "a", "20260315", ""), (2, "b", "", "2026-03-20"), (3, "", "", None)], "series_id long, device_id string, acquisition_date string, manual_date string")
    refs = spark.createDataFrame([("a", 12.0, 0.3)], "device_id string, noise double, nps_freq double")
    spectra = series.nps_of_series(rows, slices, N, N).series
    got = {r.series_id: r for r in series.controls(series.hu_of_series(rows, slices), spectra, headers, refs).collect()}
    assert [(got[k].run_date, got[k].run_date_manual) for k in (1, 2, 3)] == [("2026-03-15", False), ("2026-03-20", True), ("", False)]
    assert (got[1].ref_noise, got[1].nps_start, got[1].nps_end, got[1].hu_slice, got[1].n_slices) == (12.0, 2, 11, 6, 14) and got[2].noise is None and got[2].ref_noise is None
    row, col, radius, _ = phantom.found_in(images[106], None, None)
    y, x = np.mgrid[:N, :N]
    centre = images[106][(y - round(row)) ** 2 + (x - round(col)) ** 2 <= int(radius * 2 * 0.4 / 2) ** 2]
    assert np.isclose(got[1].water_ct, centre.mean()) and got[1].geometry.central_radius == int(radius * 2 * 0.4 / 2)
    runs = spark.createDataFrame([(10, "a", 1, 6, 2, 11, False), (11, "a", 1, 40, 9, 30, False), (12, "b", 9, 1, 1, 5, None), (13, "b", 1, None, None, None, None)], "run_id long, device_id string, series_id long, hu_slice int, nps_start int, nps_end int, artifacts_present boolean")
    again = {r.run_id: r for r in series.reanalysed(runs, slices, rows, refs, N, N).collect()}
    assert [(again[k].missing, again[k].clamped) for k in (10, 11, 12, 13)] == [(None, False), (None, True), (series.OTHER_SERIES, False), (None, False)]
    assert np.isclose(again[10].water_ct, got[1].water_ct) and np.isclose(again[10].nps_freq, got[1].nps_freq) and np.isclose(again[13].noise, got[1].noise)
    mean, noise, *_ = brute(images, 9, 13)
    assert np.isclose(again[11].nps_freq, mean) and np.isclose(again[11].noise, noise)
    assert again[12].overall == "pending" and again[12].water_ct is None and again[10].noise_status == "ok" and again[13].noise_status == "pending"


@pytest.mark.parametrize(("f", "n", "rms", "peak", "ok"), [(2.0, 1.0, 3.0, 5.0, (True, True)), (2.001, 1.0, 3.0, 5.0, (False, True)), (2.0, 1.001, 3.0, 5.0, (False, True)), (0.0, 0.0, 3.001, 0.0, (True, False)), (0.0, 0.0, 0.0, 5.001, (True, False))])
def test_validation_limits(spark, f, n, rms, peak, ok):
    lit = F.lit
    assert tuple(spark.range(1).select(validation.passed(lit(f), lit(n)), validation.spectrum_passed(lit(rms), lit(peak))).first()) == ok


def test_relative_errors(spark):
    cases = spark.createDataFrame([(1.0, 2.0), (0.0, 0.0), (3.0, 0.0), (-1.0, -2.0), (None, 1.0)], "m double, r double")
    assert [r[0] for r in cases.select(validation.relative_error(F.col("m"), F.col("r"))).collect()] == [50.0, 0.0, float("inf"), 50.0, None]


def test_spectrum_files(spark, tmp_path):
    text = "Frequency,NPS_1D_raw,NPS_1D_fit\n0,1.03258821895299e-27,0.264748633154983\n0.0333333333333333,33.6793598916736,33.308275353648\n"
    (tmp_path / "NPS1D.csv").write_text(text)
    want = [(0.0, 1.03258821895299e-27, 0.264748633154983), (0.0333333333333333, 33.6793598916736, 33.308275353648)]
    assert sorted(map(tuple, validation.read_spectra(spark, str(tmp_path)).collect())) == want
    parsed = validation.parse_spectra(spark.createDataFrame([(1, text)], "f int, text string"), "f").orderBy("ring").collect()
    assert [(r.freq, r.power, r.fit) for r in parsed] == want


def stored(side=24, near=19, far=15, px=PX, rows=N, day="2025-01-15"):
    return (px, rows, N, 80.0, 14, 7, 20, side, near, far, day)


FROZEN = f"device_id string, geometry {series.GEOMETRY}"


def test_frozen_geometry_in_the_spectrum(spark, tables, images):
    """Sizes and offsets stay those of the first control where the detected diameter says otherwise; another matrix or a
    stored size of 0 is a mismatch, and then they are computed."""
    rows, slices = tables
    headers = spark.createDataFrame([(1, "a"), (3, "b")], "series_id long, device_id string")
    for kept, mismatch in ((stored(), False), (stored(px=PX * 1.004), False), (stored(px=PX * 1.006), True), (stored(rows=512), True), (stored(px=0.0), True)):
        scanners = spark.createDataFrame([("a", kept), ("b", None), ("", kept)], FROZEN)
        frozen = devices.frozen_of(headers, scanners)
        r = series.nps_of_series(rows, slices.filter("series_id = 1"), N, N, frozen=frozen).series.first()
        mean, noise, n, side, *_ = brute(images, 2, 11, frozen=None if mismatch else (24, 19, 15))
        assert (r.roi_size, r.n_tiles, r.mismatch, r.geometry.frozen_date) == (side, n, mismatch, "" if mismatch else "2025-01-15")
        assert np.isclose(r.mean_freq, mean) and np.isclose(r.noise, noise)


def test_frozen_geometry_over_drifting_phantoms(spark):
    """Detection drifts by 3 px from one control to the next, and sizes stay."""
    pictures = {k * 100 + i: image(48, 48, 38 + 3 * k, 900 + i) for k in (1, 2) for i in range(10)}
    rows = spark.createDataFrame([(i, k, x[k].tolist()) for i, x in pictures.items() for k in range(N)], "slice_id long, row_idx int, hu array<double>")
    slices = spark.createDataFrame([(i // 100, i % 100, i, PX, 48.0) for i in pictures], "series_id long, slice_idx int, slice_id long, px double, reconstruction_diameter double")
    headers = spark.createDataFrame([(k, "a", "20260315", "", f"1.{k}") for k in (1, 2)], "series_id long, device_id string, acquisition_date string, manual_date string, series_uid string")
    refs = spark.createDataFrame([("a", 12.0, 0.3)], "device_id string, noise double, nps_freq double")
    free = {r.series_id: r for r in series.hu_of_series(rows, slices, None, N, N).collect()}
    assert free[2].geometry.phantom_diameter_px - free[1].geometry.phantom_diameter_px > 5 and free[1].geometry.peripheral_distance != free[2].geometry.peripheral_distance
    first = spark.createDataFrame([("a", free[1].geometry)], FROZEN)
    frozen = devices.frozen_of(headers, first)
    hu = series.hu_of_series(rows, slices, frozen, N, N)
    found = {r.series_id: r for r in series.controls(hu, series.nps_of_series(rows, slices, N, N, frozen=frozen).series, headers, refs).collect()}
    assert found[1].geometry == found[2].geometry == free[1].geometry and not found[2].mismatch
    y, x = np.mgrid[:N, :N]
    row, col, *_ = phantom.found_in(pictures[204], None, None)
    inner = pictures[204][(y - round(row)) ** 2 + (x - round(col)) ** 2 <= free[1].geometry.central_radius ** 2]
    assert np.isclose(found[2].water_ct, inner.mean())


def test_controls_have_all_their_columns(spark, tables):
    rows, slices = tables
    headers = spark.createDataFrame([(1, "a", "20260315", "", "1.2.3", 120.0, True, "anneau", "/x/1", "../1", "note", "2026-04-01T08:00:00", "annuel"), (2, "a", "", "", "", None, None, "text without artefacts", None, None, None, None, None)], "series_id long, device_id string, acquisition_date string, manual_date string, series_uid string, kvp double, artifacts_present boolean, artifacts_description string, folder string, folder_rel string, notes string, recorded_at string, control_type string")
    refs = spark.createDataFrame([("a", 12.0, 0.3)], "device_id string, noise double, nps_freq double")
    got = {r.series_id: r for r in series.controls(series.hu_of_series(rows, slices, None, N, N), series.nps_of_series(rows, slices, N, N).series, headers, refs).collect()}
    a, b = got[1], got[2]
    assert (a.run_id, a.kvp, a.mas, a.artifacts_description, a.folder, a.folder_rel, a.notes, a.recorded_at, a.control_type, a.performed_by, a.pdf_path) == ("1.2.3", 120.0, 0.0, "anneau", "/x/1", "../1", "note", "2026-04-01T08:00:00", "annuel", "", "")
    assert re.fullmatch("-[0-9a-f]{8}", b.run_id) and (b.kvp, b.artifacts_description, b.folder, b.artifacts_present, b.nps_start, b.noise) == (0.0, "", "", None, None, None)
    assert abs(dt.datetime.fromisoformat(b.recorded_at) - dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)) < dt.timedelta(days=1)


def test_spectra_of_roi_files(spark, tables, images):
    """From files to spectra in one analysis: squares of 32 px in one series and of 64 px in another; a size for the
    squares of a third; the geometry is not told of given squares."""
    rows, slices = tables
    used = slices.filter("series_id <> 3").unionByName(slices.filter("series_id = 1").withColumn("series_id", F.lit(7).cast("long")))
    used = used.withColumns({"first": F.lit(0), "last": F.lit(3), "roi_size": F.when(F.col("series_id") == 7, 16)})
    corners = {1: (32, [(20, 22), (30, 41), (-4, 60)]), 2: (64, [(16, 16), (20, 12)])}
    text = lambda side, at: '{"type_of_file":"NPS","ROI":[' + ",".join(f'{{"X":{c},"Y":{r},"side_square":{side}}}' for r, c in at) + "]}"
    files = spark.createDataFrame([(k, text(*v)) for k, v in corners.items()], "series_id long, json string")
    found = series.nps_of_series(rows, used, N, N, positions=rois.read_nps_rois(files, "json"))
    got = {r.series_id: r for r in found.series.collect()}
    for k, (side, at) in corners.items():
        mean, noise, n, _, freq, power = brute(images, 0, 3, of=100 * k, squares=(side, [(r + side // 2, c + side // 2) for r, c in at]))
        assert (got[k].roi_size, got[k].n_tiles, got[k].geometry, got[k].skipped) == (side, n, None, [2] if k == 1 else [])
        assert np.isclose(got[k].mean_freq, mean) and np.isclose(got[k].noise, noise)
        rings = found.rings.filter(f"series_id = {k}").toPandas().sort_values("ring")
        assert np.allclose(rings["power"], power) and np.allclose(rings["freq"], freq)
    row, col, radius, _ = phantom.found_in(images[102], None, 48.0)
    mean, *_ = brute(images, 0, 3, frozen=(16, int(radius * 0.455), int(radius * 0.367)))
    assert got[7].roi_size == 16 and np.isclose(got[7].mean_freq, mean)


def test_reanalysis_of_the_folder_that_holds_the_series(spark, tables, images):
    """The same series lies in two folders, with other slices in one; candidates are the stored path, the path beside the
    store, and relocations, most recent first."""
    rows, slices = tables
    one = slices.filter("series_id = 1")
    held = one.withColumn("folder", F.lit("/new/a")).unionByName(one.filter("slice_idx < 12").withColumn("folder", F.lit("/db/images/a"))).unionByName(slices.filter("series_id = 2").withColumn("folder", F.lit("/old/c")))
    runs = [(1, 1, "/new/./a", ""), (2, 1, "/lost/a", "../images/a"), (3, 1, "/old/a", ""), (4, 1, "/old/c", ""), (5, 1, "/lost/b", ""), (6, 1, "", "")]
    runs = spark.createDataFrame([(r, "a", s, 6, 2, 11, False, f, rel, "2026-01-01", "annuel", "P", "V") for r, s, f, rel in runs], "run_id long, device_id string, series_id long, hu_slice int, nps_start int, nps_end int, artifacts_present boolean, folder string, folder_rel string, run_date string, control_type string, performed_by string, validated_by string")
    moves = spark.createDataFrame([("/old", "/new", 1), ("/old", "/db/images", 2), ("/old", "/nowhere", 3)], "old string, new string, seq long")
    refs = spark.createDataFrame([("a", 12.0, 0.3)], "device_id string, noise double, nps_freq double")
    scanners = spark.createDataFrame([("a", stored())], FROZEN)
    got = {r.run_id: r for r in series.reanalysed(runs, held, rows, refs, N, N, scanners, moves, "/db/store").collect()}
    assert [(got[k].folder, got[k].missing) for k in range(1, 7)] == [("/new/a", None), ("/db/images/a", None), ("/db/images/a", None), (None, series.OTHER_SERIES), (None, series.NO_FOLDER), (None, series.NO_FOLDER)]
    mean, noise, *_ = brute(images, 2, 11, frozen=(24, 19, 15))
    for k in (1, 2, 3):
        assert np.isclose(got[k].nps_freq, mean) and np.isclose(got[k].noise, noise) and not got[k].mismatch and not got[k].clamped
        assert (got[k].run_date, got[k].control_type, got[k].performed_by, got[k].validated_by, got[k].noise_status) == ("2026-01-01", "annuel", "P", "V", "ok")
    assert got[4].overall == "incomplete" and got[4].water_ct is None


@pytest.mark.parametrize(("path", "want"), [("/a/./b//c/", "/a/b/c"), ("/a/../b", "/b"), ("/../b", "/b"), ("a\\b\\..\\c", "a/c"), ("../../a", "../../a"), ("a/../../b", "../b"), ("/", "/")])
def test_normalised_paths(spark, path, want):
    assert spark.range(1).select(archive.normalised(F.lit(path))).first()[0] == want


def exchanges_over(plan, scan):
    """Exchanges that stand above a scan in a plan's text, which shows a node's inputs below it, further to the right."""
    above, found = [], []
    for line in plan.splitlines():
        node = line.lstrip(" :+-")
        depth = len(line) - len(node)
        above = [(d, n) for d, n in above if d < depth]
        if scan in node:
            found += [n for _, n in above if n.startswith("Exchange")]
        above.append((depth, node))
    assert any(scan in line for line in plan.splitlines())
    return found


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def bucketed(spark, tables, tmp_path_factory):
    rows, slices = tables
    path = tmp_path_factory.mktemp("pixels")
    spark.sql("drop table if exists slice_rows_test")
    pixels.write_slice_rows(rows, "slice_rows_test", 4, str(path / "t"))
    slices.write.parquet(str(path / "slices"))
    yield spark.table("slice_rows_test"), spark.read.parquet(str(path / "slices"))
    spark.sql("drop table if exists slice_rows_test")


def test_bucketed_pixels_are_not_dealt_again(spark, bucketed, tables, images):
    """No exchange stands above the scan of the pixels, whether regions are broadcast or joined, and results are the same.
    The water component deals its runs, a few for each image row, instead of pixels."""
    rows, slices = bucketed
    squares = slices.select("slice_id", F.lit(0).alias("roi_idx"), F.lit(48).alias("x"), F.lit(47).alias("y"), F.lit(32).alias("side"))
    circles = slices.select("slice_id", F.lit(0).alias("roi_idx"), F.lit("c").alias("name"), F.lit(48).alias("cx"), F.lit(47).alias("cy"), F.lit(9).alias("radius"))
    centres = slices.select("slice_id", F.lit(48.0).alias("center_row"), F.lit(48.0).alias("center_col"))
    made = {
        "tiles": lambda r: rois.roi_tiles(r, squares, N), "stats": lambda r: rois.water_results(rois.roi_stats(r, circles)), "component": phantom.water_component,
        "edges": lambda r: phantom.ray_edges(r, centres), "found": lambda r: phantom.detect_phantom(r, centres),
    }
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in ("-1", "100000"):  # the pixels are larger than that, what they are joined with is smaller
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            for name, f in made.items():
                plan = plan_of(f(rows))
                assert exchanges_over(plan, "FileScan parquet spark_catalog.default.slice_rows_test") == [] or name == "component", plan
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    rounded = lambda df: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())
    for name, f in made.items():
        assert rounded(f(rows)) == rounded(f(tables[0])), name
    z = {r.slice_id: r.z for r in rois.roi_tiles(rows, squares, N).collect()}
    assert np.allclose(z[105], images[105][31:63, 32:64].ravel())
    got = series.nps_of_series(rows, slices, N, N).series.filter("series_id = 1").first()
    assert np.isclose(got.mean_freq, brute(images, 2, 11)[0])


def test_scans_of_folders_read_no_content(spark, tmp_path):
    for name in ("a/1.dcm", "a/b/IM2", "a/notes.TXT", "a/DICOMDIR", "a/.hidden", "a/b/3.jpg", "a/b/broken"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 10)
    files = pixels.scan_files(spark, str(tmp_path))
    assert "content" not in re.search(r"ReadSchema: (.*)", plan_of(files)).group(1)
    assert {r.path.removeprefix(str(tmp_path)): r.candidate for r in files.collect()} == {"/a/1.dcm": True, "/a/b/IM2": True, "/a/notes.TXT": False, "/a/DICOMDIR": False, "/a/b/3.jpg": False, "/a/b/broken": True}
    headers = spark.createDataFrame([(f"{tmp_path}/a/1.dcm", "CT"), (f"{tmp_path}/a/b/IM2", "MR"), ("/elsewhere", "CT")], "path string, modality string")
    reason = F.when(F.col("modality") == "MR", F.struct(F.lit("skipped").alias("kind"), F.lit("MR").alias("reason"))).otherwise(F.struct(F.lit("ok").alias("kind"), F.lit("").alias("reason")))
    got = {r.path.removeprefix(str(tmp_path)): (r.folder.removeprefix(str(tmp_path)), r.kind, r.reason) for r in pixels.scan_report(files, headers, reason).collect()}
    assert got == {"/a/1.dcm": ("/a", "ok", ""), "/a/b/IM2": ("/a/b", "skipped", "MR"), "/a/b/broken": ("/a/b", "error", pixels.UNREADABLE)}
