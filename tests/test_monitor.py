"""The season as it runs, on made fields: loops beside the folds, and each rule's branches."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilth.operators import monitor

P = monitor.Prior()
DAY = "field_id string, d int, tmean double, par double, et0 double, rain double, irrigated boolean, sown int, ndvi double, ndmi double, rvi double, coarse double"


def walked(days, prior=P):
    """The recurrence, a day at a time."""
    cover, water, biomass, unsure, out = 0.05, 0.55, 0.0, 0.40, []
    hold = lambda x, a=0.0, b=1.0: max(a, min(b, x))
    for _, d, tmean, par, et0, rain, wet, sown, ndvi, ndmi, rvi, coarse in days:
        tmean, par, et0, rain = (given if x is None else x for x, given in zip((tmean, par, et0, rain), (prior.best_temp, 8.0, 4.0, 0.0)))
        growing = sown is not None and d >= sown
        if tmean <= prior.base_temp or tmean >= prior.top_temp:
            heat = 0.05
        elif tmean <= prior.best_temp:
            heat = max(0.05, (tmean - prior.base_temp) / (prior.best_temp - prior.base_temp))
        else:
            heat = max(0.05, (prior.top_temp - tmean) / (prior.top_temp - prior.best_temp))
        heat, moist, gain = (heat if growing else 0.0), hold(water, 0.15), 0.0
        if growing:
            gain = prior.light_use * par * hold(1.15 * cover - 0.05, 0.0, 0.95) * heat * moist * 10
            biomass += gain
            cover = min(prior.cover_max, cover + 0.018 * max(0.0, prior.cover_max - cover) * heat * moist)
        water = water - 0.025 * et0 / 5 + min(rain, 40) / 25
        water = hold(max(water, 0.75) if wet else water)
        unsure, kind = min(1.0, unsure + 0.035), "inferred"
        if ndvi is not None:
            kind, cover, unsure = "optical", 0.35 * cover + 0.65 * hold((ndvi - 0.12) / 0.72), unsure * 0.35
            water = water if ndmi is None else 0.4 * water + 0.6 * hold((ndmi + 0.15) / 0.55)
        elif rvi is not None:
            kind, cover, unsure = "radar", 0.55 * cover + 0.45 * hold((rvi - 0.12) / 0.55), unsure * 0.62
        elif coarse is not None:
            kind, cover, unsure = "coarse", 0.7 * cover + 0.3 * hold((coarse - 0.12) / 0.72), unsure * 0.8
        out.append((d, cover, water, biomass, gain, unsure, kind))
    return out


def made_days():
    rng = np.random.default_rng(4)
    maybe = lambda share, x: float(x) if rng.random() < share else None
    rows = []
    for name, sown in (("a", 5), ("b", None), ("c", 40)):
        rows += [(name, d, maybe(0.9, rng.uniform(5, 42)), maybe(0.9, 9), maybe(0.9, 5), maybe(0.3, rng.uniform(0, 60)), bool(rng.random() < 0.05), sown, maybe(0.2, rng.uniform(0, 1)), maybe(0.5, rng.uniform(-0.3, 0.6)), maybe(0.2, rng.uniform(0, 1)), maybe(0.2, rng.uniform(0, 1))) for d in range(90)]
    return rows


def test_daily_state_is_the_recurrence(spark):
    rows = made_days()
    got = monitor.daily_state(spark.createDataFrame(rows, DAY).repartition(5)).collect()
    for name in "abc":
        own = sorted((r for r in got if r.field_id == name), key=lambda r: r.d)
        want = walked([r for r in rows if r[0] == name])
        assert [(r.d, r.kind) for r in own] == [(w[0], w[-1]) for w in want]
        for r, w in zip(own, want):
            assert (r.cover, r.water, r.biomass, r.gain, r.uncertainty) == tuple(pytest.approx(x) for x in w[1:6])
    assert {w.kind for w in got} == {"optical", "radar", "coarse", "inferred"}


def test_daily_states_move_on_in_batches_of_fields(spark):
    """Seasons of unlike lengths side by side, more fields than a batch has, and no fold that copies its days at each step."""
    rows = [(f"{r[0]}{k}", *r[1:]) for k in range(monitor.FIELDS_AT_ONCE // 2) for r in made_days() if r[1] < 5 + k % 40]
    states = monitor.daily_state(spark.createDataFrame(rows, DAY).repartition(1))
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "lambdafunction" not in plan
    got = {}
    for r in states.collect():
        got.setdefault(r.field_id, []).append(r)
    assert len(got) == 3 * (monitor.FIELDS_AT_ONCE // 2)
    for name in ("a0", "b7", f"c{monitor.FIELDS_AT_ONCE // 2 - 1}"):
        own, want = sorted(got[name], key=lambda r: r.d), walked([r for r in rows if r[0] == name])
        assert [(r.d, r.kind) for r in own] == [(w[0], w[-1]) for w in want]
        assert [x for r in own for x in (r.cover, r.water, r.biomass, r.gain, r.uncertainty)] == pytest.approx([x for w in want for x in w[1:6]])


def test_irrigation_needs_a_dry_week_and_a_dry_neighbourhood(spark):
    wet = [(f, "v", d, x) for f, xs in {"dry": [0.1, 0.1, 0.3], "rained": [0.1, 0.1, 0.3], "small": [0.1, 0.1, 0.15], "late": [0.1, None, 0.3], "shared": [0.1, 0.1, 0.3]}.items() for d, x in zip((0, 4, 8), xs) if x is not None]
    wet = [(f, {"rained": "w", "shared": "u"}.get(f, a), d, x) for f, a, d, x in wet]
    rain = [("w", 4, 3.0), ("w", 7, 2.5), ("v", 3, 30.0), ("v", 8, 4.9)]
    near = [("v", 4, 0.1), ("v", 8, 0.12), ("u", 4, 0.1), ("u", 8, 0.2), ("w", 4, 0.1), ("w", 8, 0.1)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = monitor.irrigated(frame(wet, "field_id string, area string, d int, ndmi double"), frame(rain, "area string, d int, rain double"), frame(near, "area string, d int, ndmi double")).collect()
    assert {(r.field_id, r.d) for r in got} == {("dry", 8)}


def test_progress_nitrogen_and_yield(spark):
    days = [("a", d, 26.0, 9.0, 4.0, 10.0 if d % 6 == 0 else 0.0, False, 10, 0.14 + 0.7 * min(1, max(0, (d - 15) / 50)) - 0.5 * max(0, (d - 90) / 60) if d % 5 == 0 else None, 0.3 if d % 5 == 0 else None, None, None) for d in range(120)]
    states = monitor.daily_state(spark.createDataFrame(days, DAY))
    told = monitor.with_progress(states, spark.createDataFrame([("a", 10)], "field_id string, sown int")).cache()
    rows = {r.d: r for r in told.collect()}
    peak = rows[0].peak
    assert rows[0].emerged == 20 and 60 <= peak <= 95 and rows[19].tau == 0 and rows[peak].tau == pytest.approx(P.tau_peak) and rows[119].tau == 0.97
    reds = [("a", 60, x, None) for x in (0.1, 0.12, 0.14, 0.2)] + [("a", 65, None, x) for x in (1.2, 1.2, 1.4, 1.6)] + [("a", 70, 0.3, None)] * 3 + [("a", 61, 0.3, None)] * 4
    got = {r.d: r for r in monitor.nitrogen(told, spark.createDataFrame(reds, "field_id string, d int, ndre double, cire double")).collect()}
    assert set(got) == {60, 65}  # too few values on day 70, no optical look on day 61
    expected = 0.08 + 0.38 * rows[60].cover
    score = 100 * min(0.13 / expected, 1.25) / 1.25
    assert got[60].score == pytest.approx(score) and got[60].band == "low" and got[60].penalty == pytest.approx((55 - score) / 220)
    assert got[65].actual == pytest.approx(1.3 * 0.25)
    many = told.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(16)))).withColumn("field_id", F.concat("field_id", "k")).withColumn("hot", F.lit(False))
    fields = lambda n: spark.createDataFrame([(f"a{k}", "g", 1.5 if k != 2 else None, 0.2, 0.05, 7, k == 1) for k in range(1, n + 1)], "field_id string, group string, district double, uneven double, penalty double, sowing_span int, outlier boolean")
    few = {r.field_id: r for r in monitor.yield_ensemble(many, fields(3)).collect()}
    lots = {r.field_id: r for r in monitor.yield_ensemble(many, fields(16)).collect()}
    assert few["a3"].pool == "district_statistic" and few["a2"].pool == "crop_shape" and few["a2"].baseline == P.base_yield and few["a3"].ranked is None
    assert few["a3"].t_ha == pytest.approx((few["a3"].biomass + few["a3"].canopy) / 2) and few["a3"].low <= few["a3"].t_ha <= few["a3"].high
    assert lots["a3"].pool == "district_peers" and lots["a3"].ranked == pytest.approx(1.5 * (0.55 + 0.9) * lots["a3"].retention)
    assert lots["a3"].t_ha == pytest.approx(sorted((lots["a3"].biomass, lots["a3"].canopy, lots["a3"].ranked))[1])
    assert lots["a1"].high - lots["a1"].t_ha > lots["a3"].high - lots["a3"].t_ha  # an outlier's band is wider


def test_village_against_its_years(spark):
    onset = lambda y: date(y, 6, 10)
    curve = lambda v, y, shift: [(v, y, date(y, 5, 1) + timedelta(days=10 * k), 0.3 + 0.02 * k + shift) for k in range(18)]
    rows = [x for y in range(2019, 2024) for x in curve("low", y, 0.01 * (y - 2019))] + curve("low", 2024, -0.1)
    rows += [x for y in range(2019, 2024) for x in curve("fine", y, 0.01 * (y - 2019))] + curve("fine", 2024, 0.02)
    rows += [x for y in (2022, 2023) for x in curve("new", y, 0.0)] + curve("new", 2024, 0.0)
    curves = spark.createDataFrame(rows, "village string, year int, day date, value double")
    onsets = spark.createDataFrame([(v, y, onset(y)) for v in ("low", "fine", "new") for y in range(2019, 2025)], "village string, year int, onset date")
    got = monitor.village_normal(curves, onsets, 2024).collect()
    assert {r.village: r.status for r in got} == {"low": "below_normal", "fine": "near_normal", "new": "unavailable"}
    at = next(r for r in got if r.village == "low" and r.offset == 0)
    assert at.p25 < at.normal < at.p75 and at.current == pytest.approx(at.normal - 0.12, abs=1e-9) and at.longest_below > 10


def test_seasons_that_clouds_hid(spark):
    means = {"gap": (0.2, 0.6), "long": (0.5, 0.6), "none": (0.2, 0.2), "between": (0.35, 0.6), "unseen": (None, 0.2), "only": (0.6, None)}
    rows = [(p, date(2023, m, 10), x) for p, (a, b) in means.items() for m, x in ((4, a), (9, b)) if x is not None]
    got = {r.parcel_id: r.presence for r in monitor.season_inference(spark.createDataFrame(rows, "parcel_id string, day date, value double")).collect()}
    assert got == {"gap": "kharif_sown_in_gap", "long": "summer_or_long_duration_present", "none": "no_kharif", "between": "ambiguous", "unseen": "no_kharif", "only": "summer_or_long_duration_present"}


def test_declared_crops(spark):
    claims = [("fits", "soyabean "), ("short", "Cotton"), ("low", "Rice"), ("tree", "Rice"), ("fallow", "Gram"), ("odd", "Quinoa"), ("none", None)]
    cycles = [("fits", "annual", 100, 0.8), ("fits", "annual", 300, 0.8), ("short", "annual", 80, 0.9), ("low", "annual", 120, 0.5), ("tree", "perennial", 350, 0.8), ("odd", "annual", 100, 0.8), ("none", "annual", 100, 0.8)]
    got = monitor.verified(spark.createDataFrame(claims, "parcel_id string, declared string"), spark.createDataFrame(cycles, "parcel_id string, kind string, days int, peak_ndvi double"))
    rows = {r.parcel_id: (r.outcome, r.confidence, r.reason) for r in got.collect()}
    assert rows == {
        "fits": ("consistent", 0.275, None), "short": ("inconsistent", 0.0, None), "low": ("inconsistent", 0.0, None), "tree": ("indeterminate", 0.0, "perennial"),
        "fallow": ("indeterminate", 0.0, "too few cycles"), "odd": ("indeterminate", 0.0, "no reference"), "none": ("indeterminate", 0.0, "none declared"),
    }


def test_final_days_come_from_the_store(spark, tmp_path):
    schema = "k int, day date, x double"
    spark.createDataFrame([(1, date(2024, 1, d), -1.0) for d in range(1, 9)], schema).write.parquet(str(tmp_path / "stored"))
    spark.createDataFrame([(1, date(2024, 1, d), float(d)) for d in range(1, 13)], schema).write.parquet(str(tmp_path / "fresh"))
    read = lambda n: spark.read.parquet(str(tmp_path / n))
    out = monitor.continued(read("stored"), read("fresh"), "day", "2024-01-05")
    got = {r.day.day: (r.x, r.origin) for r in out.collect()}
    assert got == {d: (-1.0, "reused") if d <= 5 else (float(d), "computed") for d in range(1, 13)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedFilters: [IsNotNull(day)") == 2
