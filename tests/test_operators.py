"""Operators on small fixtures: ends, ties, nulls and published numbers."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilth.functions import agronomy, spectral
from tilth.functions.agronomy import haversine
from tilth.operators import evaluation, graph, kernels, matching, series
from tilth.sources import files


def one(df):
    return df.first()[0]


def test_indices_guard_zero_and_null(spark):
    df = spark.createDataFrame([(0.5, 0.1), (0.0, 0.0), (None, 0.1)], "nir double, red double")
    got = [r[0] for r in df.select(spectral.ndvi(F.col("nir"), F.col("red"))).collect()]
    assert got[0] == pytest.approx(0.4 / 0.6) and got[1:] == [None, None]
    with pytest.raises(ValueError):
        spectral.scaled(F.col("nir"), 1.0, 1.0)


def test_best_in_bin_keeps_empty_bins(spark):
    d = dt.date
    rows = [(1, d(2024, 1, 1), 0.5, 40, 1), (1, d(2024, 1, 2), 0.4, 10, 2), (1, d(2024, 1, 3), None, 0, 3), (1, d(2024, 1, 12), 0.7, 5, 4)]
    obs = spark.createDataFrame(rows, "p int, day date, v double, cloud int, id int")
    got = {r.bin: (r.id, r.missing) for r in series.best_in_bin(obs, ["p"], "day", 5, "2024-01-01", "v", "cloud", "id").collect()}
    assert got == {0: (2, False), 1: (None, True), 2: (4, False)}


def test_runs_and_gaps(spark):
    df = spark.createDataFrame([(1, k, f) for k, f in enumerate([True, True, False, None, True])], "p int, k int, f boolean")
    got = sorted((r.run_start, r.run_end, r.run_length) for r in series.runs(df, ["p"], "k", F.col("f")).collect())
    assert got == [(0, 1, 2), (4, 4, 1)]
    days = spark.createDataFrame([(1, dt.date(2024, 1, k)) for k in (1, 2, 30)], "p int, day date")
    assert [r.gap_days for r in series.gaps(days, ["p"], "day", 25).collect()] == [28]


def test_interval_union_joins_touching(spark):
    d = dt.date
    df = spark.createDataFrame([(1, d(2024, 1, 1), d(2024, 1, 5)), (1, d(2024, 1, 5), d(2024, 1, 7)), (1, d(2024, 1, 9), d(2024, 1, 10))], "p int, a date, b date")
    assert sorted((r.a.day, r.b.day) for r in series.merged_intervals(df, ["p"], "a", "b").collect()) == [(1, 7), (9, 10)]


def test_nearest_and_banded(spark):
    left = spark.createDataFrame([(1, 1, 10), (2, 1, 50)], "id int, p int, at int")
    right = spark.createDataFrame([(1, 7, 9), (1, 12, 11), (1, 20, 14)], "p int, v int, when int")
    assert {(r.id, r["when"]) for r in matching.banded(left, right, ["p"], "at", "when", 3).collect()} == {(1, 9), (1, 11)}
    got = {r.id: r.near_v for r in matching.nearest(left, right, ["p"], "at", "when", 3, "id", ["v"], "v").collect()}
    assert got == {1: 7, 2: None}


def test_haversine_neighbours(spark):
    pts = spark.createDataFrame([(1, 20.0, 75.0), (2, 20.1, 75.1), (3, 25.0, 75.0)], "id int, lat double, lon double")
    assert [(r.a, r.b) for r in matching.neighbours(pts, "id", "lat", "lon", 40.0, agronomy.haversine).collect()] == [(1, 2)]


def test_components_of_a_chain(spark):
    nodes = spark.range(12).select(F.col("id").alias("node"))
    edges = spark.createDataFrame([(k, k + 1) for k in range(9)], "a long, b long")
    got = {r.node: r.component for r in graph.components(nodes, edges).collect()}
    assert got == {**{k: 0 for k in range(10)}, 10: 10, 11: 11}


def test_kappa_and_empty_class(spark):
    counts = spark.createDataFrame([("a", "a", 20), ("a", "b", 5), ("b", "a", 10), ("b", "b", 15)], "reference string, predicted string, n long")
    k = evaluation.kappa(counts).first()
    assert (round(k.po, 6), round(k.pe, 6), round(k.kappa, 6)) == (0.7, 0.5, 0.4)
    same = spark.createDataFrame([("a", "a", 5)], "reference string, predicted string, n long")
    assert evaluation.kappa(same).first().kappa == 1.0
    only = spark.createDataFrame([("a", "b", 5)], "reference string, predicted string, n long")
    assert {r.label: r.f1 for r in evaluation.per_class(only).collect()} == {"a": 0.0, "b": 0.0}


def test_stratified_area_published_example(spark):
    """A published worked example of stratified area estimation: map strata, reference counts, areas in hectares."""
    counts = {"deforestation": (66, 0, 5, 4), "forest gain": (0, 55, 8, 12), "stable forest": (1, 0, 153, 11), "stable non-forest": (2, 1, 9, 313)}
    names = list(counts)
    rows = [(s, names[k]) for s, row in counts.items() for k, n in enumerate(row) for _ in range(n)]
    areas = [(s, px * 0.09) for s, px in zip(names, (200_000, 150_000, 3_200_000, 6_450_000))]
    got = {r.label: (round(r.area), round(r.half_width)) for r in evaluation.stratified_area(spark.createDataFrame(rows, "stratum string, ref string"), spark.createDataFrame(areas, "stratum string, area double"), "ref").collect()}
    want = {"deforestation": (21158, 6158), "forest gain": (11686, 3756), "stable forest": (285770, 15510), "stable non-forest": (581386, 16282)}
    for label, (area, half) in want.items():
        assert abs(got[label][0] - area) <= 2 and abs(got[label][1] - half) <= 2


def test_calibration_edges(spark):
    df = spark.createDataFrame([(0.1, True), (1.0, True), (0.3, False), (None, True)], "c double, ok boolean")
    assert {r.bin for r in evaluation.calibration(df, "c", F.col("ok")).collect()} == {1, 3, 9}
    assert {r.bin for r in evaluation.calibration(df, "c", F.col("ok"), closed_right=True).collect()} == {0, 2, 9}


def test_whittaker_reproduces_lines_and_fills():
    x = np.arange(12.0)
    y = 2 * x + 1
    w = np.ones(12)
    w[4] = 0
    assert np.allclose(kernels.whittaker(np.where(w > 0, y, np.nan), w), y)
    assert (kernels.whittaker(np.full(5, np.nan), np.zeros(5)) == 0).all()
    assert np.isnan(kernels.upper_envelope(np.array([1.0, 2, np.nan]), np.array([1.0, 1, 0]))).all()


@pytest.mark.parametrize("order", [1, 2, 3])
def test_banded_solve_is_the_dense_one(order):
    rng = np.random.default_rng(order)
    for n in (order + 2, order + 3, 40):
        y, w = rng.random(n), (rng.random(n) < 0.8).astype(float) + 1e-3
        d = np.diff(np.eye(n), order, axis=0)
        want = np.linalg.solve(np.diag(w) + 5.0 * d.T @ d, w * y)
        assert np.allclose(kernels.whittaker(y, w, 5.0, order), want)
    assert (kernels.whittaker(np.array([np.nan, 4.0, np.nan, np.nan, np.nan]), np.array([0, 1.0, 0, 0, 0])) == 4).all()


def test_cycles_of_one_and_two_seasons():
    hump = 0.12 + 0.6 * np.sin(np.linspace(0, np.pi, 14)) ** 2
    flat = np.full(8, 0.12)
    assert len(kernels.find_cycles(np.concatenate([flat, hump, flat]))) == 1
    assert len(kernels.find_cycles(np.concatenate([flat, hump, flat, hump, flat]))) == 2
    assert kernels.find_cycles(np.full(60, 0.15)) == []


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n,\n2, \n")
    status, rows = files.strict_csv(spark, str(tmp_path / "a.csv"), ["id"])
    assert status == "available" and rows.count() == 2
    assert files.strict_csv(spark, str(tmp_path / "a.csv"), ["other"]) == ("invalid", None)
    (tmp_path / "c.csv").write_text("# note\nid\n1\n")
    assert files.commented_csv(spark, str(tmp_path / "c.csv")).count() == 1
    names = {"crop": ["crop", "crop_name"], "id": ["field_id", "id"]}
    for k, text in enumerate(('{"features": [{"properties": {"crop": " ", "crop_name": "soy", "id": 1}}]}', '{"farms": [{"crop": "soy", "field_id": 1}]}', '[{"crop": "soy", "id": 1}]')):
        (tmp_path / f"{k}.json").write_text(text)
        assert [tuple(r) for r in files.flexible_json(spark, str(tmp_path / f"{k}.json"), names).collect()] == [("soy", "1")]
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 1)], "k int, v string, at int")
    assert sorted((r.k, r.v) for r in files.upserted(old, new, ["k"], "at").collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_units_and_bands(spark):
    df = spark.createDataFrame([(10.0, "q/ha"), (1.0, "bags")], "v double, u string")
    assert [r[0] for r in df.select(agronomy.tonnes_per_hectare(F.col("v"), F.col("u"))).collect()] == [1.0, None]
    assert [r[0] for r in spark.createDataFrame([(70.0,), (50.0,), (30.0,), (29.9,), (None,)], "i double").select(agronomy.risk_band(F.col("i"))).collect()] == ["LOW", "MEDIUM", "HIGH", "VERY_HIGH", None]
    low, high = agronomy.wilson(F.lit(0.0), F.lit(0.0))
    assert spark.range(1).select(low, high).first() == (None, None)


def test_accuracy_by_class_published_example(spark):
    names = ["deforestation", "forest_gain", "stable_forest", "stable_nonforest"]
    counts = [[66, 0, 5, 4], [0, 55, 8, 12], [1, 0, 153, 11], [2, 1, 9, 313]]
    rows = [(names[i], names[j]) for i in range(4) for j in range(4) for _ in range(counts[i][j])]
    sample = spark.createDataFrame(rows, "m string, r string").withColumn("stratum", F.col("m"))
    areas = spark.createDataFrame(list(zip(names, [18_000.0, 13_500.0, 288_000.0, 580_500.0], [1e12] * 4)), "stratum string, area double, units double")
    got = {r.label: r for r in evaluation.accuracy_by_class(sample, areas, "m", "r", "stratum", "area", "units").collect()}
    want = {"deforestation": (0.88, 0.75, 0.07), "forest_gain": (0.73, 0.85, 0.10), "stable_forest": (0.93, 0.93, 0.04), "stable_nonforest": (0.96, 0.96, 0.02)}
    for name, (ua, pa, ua_half) in want.items():
        r = got[name]
        assert r.users_accuracy == pytest.approx(ua, abs=0.006) and r.producers_accuracy == pytest.approx(pa, abs=0.006)
        assert 1.96 * r.ua_se == pytest.approx(ua_half, abs=0.01) and r.pa_se > 0


def test_accuracy_of_thin_strata_has_no_error(spark):
    sample = spark.createDataFrame([("a", "a", "s"), ("a", "b", "t"), ("b", "b", "t")], "m string, r string, stratum string")
    areas = spark.createDataFrame([("s", 1.0, 100.0), ("t", 3.0, 100.0)], "stratum string, area double, units double")
    got = {r.label: r for r in evaluation.accuracy_by_class(sample, areas, "m", "r", "stratum", "area", "units").collect()}
    assert got["a"].ua_se is None and got["a"].users_accuracy == pytest.approx(0.25 / (0.25 + 0.375))


@pytest.mark.parametrize("parts", [2, 256])
def test_cumulative_share_is_cume_dist(spark, parts):
    from pyspark.sql import Window

    rows = [(float(k % 37), k) for k in range(500)] + [(5.0, k) for k in range(300)] + [(None, 9)]
    df = spark.createDataFrame(rows, "v double, k int")
    got = evaluation.cumulative_share(df, "v", "share", parts)
    want = df.where("v IS NOT NULL").withColumn("share", F.cume_dist().over(Window.orderBy("v")))
    assert got.columns == ["v", "k", "share"]
    shown = lambda df: sorted((r.v, r.k, round(r.share, 12)) for r in df.collect())
    assert shown(got) == shown(want)
    assert evaluation.cumulative_share(df.where("false"), "v", "share").count() == 0


def test_boxes_overlap_once(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 3.0, 3.0), (2, 10.0, 10.0, 11.0, 11.0)], "id int, x0 double, y0 double, x1 double, y1 double")
    b = spark.createDataFrame([(7, 1.0, 1.0, 4.0, 4.0), (8, 3.0, 0.0, 5.0, 1.0), (9, -1.0, -1.0, 0.5, 0.5)], a.schema)
    got = {(r.a, r.b): (r.shared, r.iou) for r in matching.overlapping_boxes(a, b, 1.0).collect()}
    assert got == {(1, 7): (4.0, pytest.approx(4 / 14)), (1, 9): (0.25, pytest.approx(0.25 / 11))}


def test_neighbours_are_all_near_pairs(spark):
    import random

    rnd = random.Random(4)
    points = [(k, rnd.uniform(-70, 70), rnd.uniform(-30, 30)) for k in range(150)] + [(1000 + k, 69.9 + rnd.uniform(0, 0.5), rnd.uniform(0, 2)) for k in range(40)]
    df = spark.createDataFrame(points, "id int, lat double, lon double")
    got = {(r.a, r.b) for r in matching.neighbours(df, "id", "lat", "lon", 40.0, agronomy.haversine).collect()}

    def km(p, q):
        a, b, c, d = map(np.radians, (p[1], p[2], q[1], q[2]))
        return 2 * 6371 * np.arcsin(np.sqrt(np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2))

    want = {(p[0], q[0]) for p in points for q in points if p[0] < q[0] and km(p, q) <= 40}
    assert len(want) > 20 and got == want


def test_upsert_of_equal_times_takes_the_new_row(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "c", 5), (2, "d", None), (3, "e", 1)], "k int, v string, at int")
    assert sorted((r.k, r.v) for r in files.upserted(old, new, ["k"], "at").collect()) == [(1, "c"), (2, "d"), (3, "e")]


def test_equal_places_and_boxes_are_met_once(spark):
    """Copies of a place or a box are one row to the join by cells, and every pair of theirs in the result."""
    points = spark.createDataFrame([(k, 18.0, 74.0) for k in range(60)] + [(100 + k, 18.1, 74.0) for k in range(40)] + [(500, 40.0, 74.0)], "id long, lat double, lon double")
    places, members = matching.spots(points, "id", "lat", "lon")
    assert {r.id for r in places.collect()} == {0, 100, 500} and members.count() == 101
    got = [(r.a, r.b) for r in matching.neighbours(points, "id", "lat", "lon", 40.0, haversine).collect()]
    assert len(got) == len(set(got)) == 100 * 99 // 2 and all(a < b for a, b in got)
    boxes = spark.createDataFrame([(k, 0.0, 0.0, 1.0, 1.0) for k in range(7)] + [(9, 0.0, 0.0, 2.0, 1.0)], "id long, x0 double, y0 double, x1 double, y1 double")
    one, own = matching.equal_boxes(boxes)
    assert {(r.id, r.n) for r in one.collect()} == {(0, 7), (9, 1)} and {(r.id, r.box) for r in own.collect()} == {(k, 0) for k in range(7)} | {(9, 9)}


def test_like_rows_of_keys_are_one_unit(spark):
    """Keys with the same rows share a unit, each row of a repeated key counts, and nulls are values."""
    df = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", 2, 5), ("c", 1, 5), ("d", 1, 5), ("d", 2, 5), ("e", None, 5), ("f", None, 5), ("g", 1, 5), ("g", 1, 5)], "k string, x int, y int")
    units, members = matching.alike(df, ["k"], ["x", "y"])
    assert {r.k: (r.unit.k, r.n) for r in members.collect()} == {"a": ("a", 1), "b": ("a", 1), "c": ("c", 2), "d": ("c", 2), "e": ("e", 1), "f": ("e", 1), "g": ("g", 2)}
    assert sorted((r.unit.k, str(r.x)) for r in units.collect()) == [("a", "1"), ("c", "1"), ("c", "2"), ("e", "None"), ("g", "1"), ("g", "1")]
