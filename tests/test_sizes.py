"""What tables much larger than these would break: pixels in a broadcast, tasks that grow with the table, slow transforms."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_series import exchanges_over, plan_of

from phantomlake.operators import nps, phantom, series
from phantomlake.plans import QUERIES
from phantomlake.sources import views

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_tables
@pytest.mark.parametrize("name", ["roi_stats", "roi_pixels", "roi_tiles", "water_ct", "uniformity", "uniformity_detail", "water_phantom", "ray_edges", "detect_phantom"])
def test_pixels_are_neither_broadcast_nor_dealt(spark, name):
    """Nothing but their slice ids is dealt, though the estimated size of the images is below the limit for broadcasts."""
    plan = plan_of(QUERIES[name](spark, SF))
    assert "BroadcastExchange" not in plan and exchanges_over(plan, " AS hu#") == [], plan


@needs_tables
def test_wall_points_are_neither_broadcast_nor_made_again(spark):
    """Circle and median come to the points where these lie, from one making of the images, in tasks that grow in number with the
    table; the estimated size of the points is below the limit for broadcasts."""
    plan = plan_of(QUERIES["circle_round"](spark, SF))
    assert "BroadcastExchange" not in plan and "Join" not in plan and exchanges_over(plan, " AS hu#") == [], plan
    assert plan.count(" AS hu#") == 1 and plan.count("Sort [") == 1, plan


def test_a_round_keeps_what_comes_with_the_points(spark):
    """Columns named like the sums stay, groups without a circle keep their points without a residual, points of no group go."""
    ring = [("a", k, 9.0, 50 + 20 * float(np.sin(k)), 60 + 20 * float(np.cos(k))) for k in range(30)] + [("a", 30, 9.0, 50.0, 90.0)]
    line = [("b", k, 9.0, float(k), float(k)) for k in range(3)]
    points = spark.createDataFrame([*ring, *line, (None, 0, 9.0, 1.0, 2.0)], "g string, sx int, n double, row double, col double")
    got = phantom.circle_round(points, ["g"])
    assert got.columns == ["g", "sx", "n", "row", "col", "center_row", "center_col", "radius", "residual", "stays"]
    rows = {(r.g, r.sx): r for r in got.collect()}
    assert set(rows) == {("a", k) for k in range(31)} | {("b", k) for k in range(3)} and {r.n for r in rows.values()} == {9.0}
    assert [k for k in range(31) if not rows["a", k].stays] == [30] and rows["a", 30].residual > 8
    assert {(rows["b", k].radius, rows["b", k].residual, rows["b", k].stays) for k in range(3)} == {(None, None, None)}


@needs_tables
@pytest.mark.parametrize("name", ["nps_series", "nps_fit", "roi_file_spectrum", "measured_controls", "reanalyse"])
def test_series_are_not_broadcast(spark, monkeypatch, name):
    """Only scanners, their references and moved folders may be: there are no more of them in more series."""
    plans, cut = [], series.cut
    monkeypatch.setattr(series, "cut", lambda df: plans.append(plan_of(df)) or cut(df))
    plans.append(plan_of(QUERIES[name](spark, SF)))
    lines = [line.lstrip(" :+-") for plan in plans for line in plan.splitlines()]
    broadcast = ["\n".join(lines[k : k + 4]) for k, line in enumerate(lines) if line.startswith("BroadcastExchange")]
    assert [x for x in broadcast if "Range (0, 4" not in x and "Scan ExistingRDD[old#" not in x] == []


@needs_tables
def test_images_are_made_of_the_slices_asked_for(spark, monkeypatch):
    few = views.view(spark, SF, "phantoms").filter("slice_id % 12 = 5").select("slice_id")
    rows = views.image_rows(spark, SF, few.union(few))
    whole = views.image_rows(spark, SF).join(few, "slice_id", "left_semi")
    assert few.count() > 0 and sorted(map(tuple, rows.collect())) == sorted(map(tuple, whole.collect()))
    plan = plan_of(rows)
    assert "BroadcastExchange" not in plan and exchanges_over(plan, " AS hu#") == [], plan
    # the join picks slices before their rows are made, and tasks grow in number with the table
    assert plan.index(" AS hu#") < plan.index("Generate explode") < plan.index("ShuffledHashJoin"), plan
    monkeypatch.setattr(views, "SLICES_A_TASK", 1)
    assert views.image_rows(spark, SF, few).rdd.getNumPartitions() == views.view(spark, SF, "supplier").count() > 4


@needs_tables
@pytest.mark.parametrize("name", ["slice_order", "central_slices", "slices_by_location", "pick_series"])
def test_tasks_over_slices_do_not_grow_with_the_table(spark, monkeypatch, name):
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(QUERIES[name](spark, SF))
    monkeypatch.setattr(views, "ROWS_A_TASK", 100)
    of = "orders" if name == "pick_series" else "lineitem"
    got = QUERIES[name](spark, SF)
    assert got.rdd.getNumPartitions() == -(-views.view(spark, SF, of).count() // 100)
    assert rows(got) == want


@needs_tables
@pytest.mark.parametrize("name", ["slice_order", "central_slices", "slices_by_location", "pick_series", "majority_format", "modulation", "scan_date"])
def test_series_of_slices_are_not_broadcast(spark, name):
    """Orders, one a series, are joined where slices lie, though the estimated size of their file is below the limit for broadcasts."""
    plan = plan_of(QUERIES[name](spark, SF))
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan, plan


@needs_tables
@pytest.mark.parametrize("name", ["slice_order", "central_slices", "slices_by_location", "pick_series"])
def test_tasks_over_slices_are_not_merged(spark, monkeypatch, name):
    """As many tasks as the session has are enough for these rows, but adaptive execution would merge them."""
    of = "orders" if name == "pick_series" else "lineitem"
    monkeypatch.setattr(views, "ROWS_A_TASK", -(-views.view(spark, SF, of).count() // 2))
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() == views.shuffle_tasks(spark) > 2


@pytest.mark.parametrize("side", [5, 6, 8])
def test_power_in_expressions(spark, side):
    z = np.random.default_rng(side).normal(0, 30, (3, side * side))
    tiles = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(z)], "k int, z array<double>")
    got = np.array([r.p for r in tiles.select("k", nps.power(F.col("z"), side, F.lit(0.5)).alias("p")).orderBy("k").collect()])
    want = np.abs(np.fft.fftshift(np.fft.fft2(z.reshape(-1, side, side)), axes=(1, 2))) ** 2 * 0.25 / side**2
    assert np.allclose(got, want.reshape(3, -1), rtol=1e-12, atol=1e-10)


def test_power_takes_no_square_of_the_cells(spark):
    """8,000 tiles in a second or two; more than 30 s of four cores where every cell sums over all pixels."""
    z = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (F.col("id") * 7919 + i * 104729) % 41 - 20.0)
    power = spark.range(0, 8000, 1, 4).select(nps.power(z, 8, F.lit(0.5)).alias("p"))
    power.limit(1).collect()
    began = time.time()
    power.agg(F.sum(F.element_at("p", 1))).collect()
    assert time.time() - began < 15
