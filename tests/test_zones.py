"""Zones by recursive division: uniform fields, two sowings, two cuttings, bare pixels, and brute force on made days."""

import random
from collections import Counter, defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tilth.operators import zones

SCHEMA = "field_id string, pixel_id string, day date, sensor string, orbit string, ndvi double, rvi double"
DAY = date(2024, 6, 10)


def optical(field, pixel, values):
    return [(field, pixel, DAY + timedelta(days=d), "s2", None, float(v), None) for d, v in values]


def pixel(field, name, sown, cut):
    days = range(0, 200, 10)
    return optical(field, name, [(d, 0.12 if d < sown else 0.16 if d >= cut else min(0.78, 0.2 + 0.03 * (d - sown))) for d in days])


def held(out):
    by = defaultdict(list)
    for r in out.collect():
        by[r.field_id].append(r)
    return by


@pytest.fixture(scope="module")
def looks(spark):
    rows = [x for k in range(16) for x in optical("uniform", f"p{k}", [(0, 0.2), (20, 0.55), (40, 0.7)])]
    rows += [x for k in range(14) for x in pixel("sown", f"a{k}", 20, 190)] + [x for k in range(16) for x in pixel("sown", f"b{k}", 80, 195)]
    rows += [x for k in range(14) for x in pixel("cut", f"e{k}", 20, 107)] + [x for k in range(14) for x in pixel("cut", f"l{k}", 20, 150)] + [x for k in range(3) for x in pixel("cut", f"s{k}", 20, 500)]
    rows += [x for k in range(14) for x in pixel("standing", f"e{k}", 20, 107)] + [x for k in range(20) for x in pixel("standing", f"s{k}", 20, 500)]
    rows += [x for k in range(8) for x in optical("bare", f"b{k}", [(d, 0.12) for d in range(0, 120, 10)])] + [x for k in range(3) for x in optical("bare", f"t{k}", [(d, 0.7) for d in range(0, 120, 10)])]
    rows += [("dark", "p0", DAY, "s2", None, None, None)]
    radar = [(0, 0.2), (12, 0.22), (24, 0.21), (36, 0.35), (48, 0.4)]
    rows += [("radar", "p0", DAY + timedelta(days=d), "s1", "up", None, v) for d, v in radar] + optical("radar", "p0", [(0, 0.1), (50, 0.5), (60, 0.6)])
    rows += [("radar", "p1", DAY + timedelta(days=d), "s1", "up", None, v) for d, v in radar] + optical("radar", "p1", [(0, 0.1), (100, 0.5), (110, 0.6)])
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_sowing_zones(looks):
    by = held(zones.sowing_zones(looks))
    assert {r.zone_id for r in by["uniform"]} == {"z1"} and by["uniform"][0].reason == "boundary" and by["uniform"][0].greenup == DAY + timedelta(days=20)
    split = {r.pixel_id[0]: (r.zone_id, r.pixels, r.reason) for r in by["sown"]}
    assert split == {"a": ("z1", 14, "sowing"), "b": ("z2", 16, "sowing")}
    assert {r.kind for r in by["bare"]} == {"non_crop"} and {r.pixels for r in by["bare"]} == {11}
    assert [(r.zone_id, r.greenup) for r in by["dark"]] == [("z1", None)]


def test_radar_leads_where_optical_lags(looks):
    got = {r.pixel_id: r.greenup for r in zones.greenups(looks.where("field_id = 'radar'")).collect()}
    assert got == {"p0": DAY + timedelta(days=50), "p1": DAY + timedelta(days=36)}


def test_harvest_zones(looks):
    by = held(zones.harvest_zones(looks, zones.sowing_zones(looks)))
    parts = {name: Counter((r.pixel_id[0], r.part) for r in by[name]) for name in ("cut", "standing", "sown")}
    assert parts["cut"] == {("e", 1): 14, ("l", 2): 14, ("s", 1): 3} and {r.reason for r in by["cut"]} == {"harvest"}
    assert parts["standing"] == {("s", 1): 20, ("e", 2): 14}
    assert {r.part for r in by["sown"]} == {1} and "bare" not in by


def brute(days, size, how):
    days = sorted(days)
    best = None
    for i in range(1, len(days)):
        gap, left, right = days[i] - days[i - 1], i, len(days) - i
        if gap >= how.least_gap and min(left, right) >= how.least_pixels and min(left, right) / size >= how.least_share and (best is None or gap > best[0]):
            best = gap, i
    return [days] if best is None else brute(days[: best[1]], size, how) + brute(days[best[1] :], size, how)


def test_division_is_the_recursion(spark):
    rnd, how = random.Random(9), zones.Zoning(least_pixels=2, least_share=0.05, least_gap=7)
    made = {f"g{k}": [rnd.choice([0, 30, 37, 60, 90, 200]) + rnd.randrange(8) for _ in range(rnd.randint(1, 60))] for k in range(25)}
    rows = [(g, DAY + timedelta(days=d), n, len(days) + 3) for g, days in made.items() for d, n in Counter(days).items()]
    got = defaultdict(dict)
    for r in zones.split_by_gaps(spark.createDataFrame(rows, "group string, day date, n int, size int"), how).collect():
        got[r.group][(r.day - DAY).days] = r.part
    for g, days in made.items():
        want = {d: k for k, part in enumerate(brute(days, len(days) + 3, how)) for d in part}
        assert got[g] == want
    assert max(p for g in got.values() for p in g.values()) >= 3


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    out = zones.sowing_zones(none)
    assert out.count() == 0 and zones.harvest_zones(none, out).count() == 0
