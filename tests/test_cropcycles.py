"""Crop cycles on made profiles: seasons, double crops, bare ground, orchards, gaps and hints."""

from datetime import date, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tilth.operators import cropcycles as cc
from tilth.plans.cropcycles import LOOKS, REGULAR


def season(peak=0.78, base=0.12, length=16):
    half = length // 2
    return [*np.linspace(base, peak, half), *np.linspace(peak, base, length - half)]


PROFILES = {
    "one": [0.12] * 8 + season() + [0.12] * 8,
    "two": [0.12] * 6 + season() + [0.12] * 6 + season(0.74) + [0.12] * 6,
    "bare": [0.12 + 0.012 * ((i * 7) % 5) for i in range(60)],
    "orchard": list(0.74 + 0.05 * np.sin(np.linspace(0, 6 * np.pi, 108)) + 0.012 * np.random.default_rng(3).standard_normal(108)),
    "double": [*np.linspace(0.12, 0.78, 9), *np.linspace(0.78, 0.12, 9)] * 6,
    "short": [0.12] * 6 + season(0.76, length=8) + [0.12] * 6,
    "few": [0.1, 0.9, 0.1],
}


def look_rows(name, values, missing=()):
    return [(name, date(2021, 6, 1) + timedelta(days=10 * k), float(v), float(0.8 * v), float(0.45 * v - 0.05)) for k, v in enumerate(values) if k not in missing]


SCHEMA = "parcel_id string, day date, ndvi double, evi double, ndmi double"


@pytest.fixture(scope="module")
def found(spark):
    rows = [r for name, values in PROFILES.items() for r in look_rows(name, values)]
    top = int(np.argmax(PROFILES["one"]))
    rows += look_rows("hidden", PROFILES["one"], range(top - 2, top + 3))
    out = cc.cycles(spark.createDataFrame(rows, SCHEMA)).collect()
    return {name: sorted((r for r in out if r.parcel_id == name), key=lambda r: r.number) for name in [*PROFILES, "hidden"]}


def test_seasons_are_found_apart(found):
    assert len(found["one"]) == 1 and len(found["two"]) == 2 and len(found["double"]) == 6 and len(found["short"]) == 1
    assert all(r.kind == "annual" and r.sown < r.peaked < r.harvested and r.days == (r.harvested - r.sown).days for n in ("one", "two", "double") for r in found[n])
    assert found["one"][0].peak_seen and found["one"][0].seen_share == 1


def test_bare_ground_and_few_looks_have_none(found):
    assert found["bare"] == [] and found["few"] == []


def test_an_orchard_has_a_year_each(found):
    assert len(found["orchard"]) == 3
    assert {(r.kind, r.crop_type, r.season) for r in found["orchard"]} == {("perennial", "PERENNIAL", "perennial")}
    assert [r.season_label for r in found["orchard"]] == [f"Production year {r.sown.year}" for r in found["orchard"]]


def test_a_hidden_peak_is_told(found):
    (r,) = found["hidden"]
    assert not r.peak_seen and 0 < r.seen_share < 1 and r.gap_days > 0 and r.confidence < found["one"][0].confidence


def test_gaps_are_shaped_by_what_follows(spark):
    """A long gap before a fall gets a hat; before a rise a line; short ones a line; edges go on at their slope."""
    falling = [0.30] * 5 + [None] * 9 + [0.60, 0.55, 0.48, 0.40, 0.33, 0.25]
    rising = [0.30] * 5 + [None] * 9 + [0.40, 0.45, 0.50, 0.55, 0.60, 0.65]
    bridged = [0.2] * 6 + [None] * 2 + [0.5] * 6
    edge = [None] * 2 + [0.5, 0.4, 0.3] + [0.3] * 8 + [0.3, 0.35, None, None]
    rows = []
    for name, values in {"falling": falling, "rising": rising, "bridged": bridged, "edge": edge}.items():
        rows += [(name, date(2021, 6, 1) + timedelta(days=10 * k), v, None, 0.1) for k, v in enumerate(values)]
    got = {name: [] for name, *_ in rows}
    for r in cc.regular(spark.createDataFrame(rows, SCHEMA)).orderBy("bin").collect():
        got[r.parcel_id].append(r.ndvi)
    assert max(got["falling"][5:14]) > 0.62 and got["falling"][5] > 0.30
    assert got["rising"][5:14] == pytest.approx(np.linspace(0.30, 0.40, 9))
    assert got["bridged"][6:8] == pytest.approx([0.3, 0.4])
    assert got["edge"][:2] == pytest.approx([0.7, 0.6]) and got["edge"][-2:] == pytest.approx([0.4, 0.45])


def test_evi_comes_from_ndvi_where_it_lacks(spark):
    rows = [("p", date(2021, 6, 1) + timedelta(days=10 * k), 0.5, 0.9 if k == 0 else None, 0.1) for k in range(12)]
    assert {round(r.evi, 9) for r in cc.regular(spark.createDataFrame(rows, SCHEMA)).collect()} == {round(0.85 * 0.5 + 0.02, 9)}


def test_a_hint_draws_sowing_to_it(spark):
    values = [0.3] * 20 + season(0.8, 0.3) + [0.3] * 10
    looks = spark.createDataFrame(look_rows("p", values), SCHEMA)
    arrays = cc.as_arrays(cc.regular(looks)).withColumn("hint", F.lit("2021-11-10").cast("date"))
    base = cc.passes()[0]
    row = arrays.select("off", cc.found(base).alias("plain"), cc.found(base, hint=F.col("hint")).alias("hinted"), cc.found(base, hint=F.lit("2019-01-01").cast("date")).alias("far")).first()
    hinted = date(2021, 6, 1) + timedelta(days=row.off[row.hinted[0].sow])
    assert abs((hinted - date(2021, 11, 10)).days) <= 5 and row.hinted[0].sow < row.plain[0].sow and row.far == row.plain


def test_seasons_by_days_spent(spark):
    rows = [("2023-06-10", "2023-10-01"), ("2023-11-01", "2024-03-01"), ("2024-01-10", "2024-03-10"), ("2024-03-20", "2024-05-30"), ("2023-09-01", "2023-11-30"), ("2023-10-01", "2023-10-01")]
    df = spark.createDataFrame(rows, "a string, b string").select(F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"))
    kind, label = cc.season(F.col("a"), F.col("b"))
    south, _ = cc.season(F.col("a"), F.col("b"), F.lit(11.0))
    got = [tuple(r) for r in df.select(kind, label, south).collect()]
    assert got[0] == ("kharif", "Kharif 2023", "kharif") and got[1][:2] == ("rabi", "Rabi 2023/2024") and got[2][:2] == ("rabi", "Rabi 2023/2024")
    assert got[3][:2] == ("zaid", "Zaid 2024") and got[4] == ("cross_season", "Rabi 2022/2023", "kharif") and got[5][0] == "kharif"


def test_empty_table(spark):
    assert cc.cycles(spark.createDataFrame([], SCHEMA)).count() == 0


def test_series_equals_the_sql_to_the_last_bit(spark):
    """Thresholds meet exact ties, so a sum in another order, or 1 - 0.58 for 0.42, finds other cycles."""
    noise = np.random.default_rng(5)
    rows = []
    for name in range(40):
        values = 0.4 + 0.3 * np.sin(np.arange(60) / 5.0 + name) + 0.02 * noise.integers(-5, 6, 60) / 5
        hidden = set(range(20 + name % 20, 29 + name % 20)) | {5, 6}
        rows += [(name, date(2021, 6, 1) + timedelta(days=10 * k), None if k in hidden else float(v), None if k in hidden else float(0.8 * v), None if k in hidden else float(0.45 * v - 0.05)) for k, v in enumerate(values)]
    con = duckdb.connect()
    con.sql("CREATE TABLE lk (parcel_id BIGINT, day DATE, ndvi DOUBLE, evi DOUBLE, ndmi DOUBLE)")
    con.executemany("INSERT INTO lk VALUES (?, ?, ?, ?, ?)", rows)
    columns = ("parcel_id", "bin", "seen", "ndvi", "evi", "ndmi", "v", "w")
    want = con.sql(f"WITH {REGULAR.removeprefix(LOOKS + ',')} SELECT {', '.join(columns)} FROM s").fetchall()
    got = cc.regular(spark.createDataFrame(rows, SCHEMA.replace("string", "long"))).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 40 * 60


def test_tasks_grow_with_parcels_and_share_two_orders(spark):
    """Bins a task are bounded, and a task holds its bins in two sorts, whatever the values: not in two for each step of each."""
    looks = spark.createDataFrame([r for k in range(40) for r in look_rows(f"p{k}", PROFILES["one"])], SCHEMA)
    own = cc.parcels(looks)
    bins = len(PROFILES["one"])
    assert cc.tasks(own, bins_a_task=bins) == 40 and cc.tasks(own) == spark.sparkContext.defaultParallelism
    series = cc.regular(looks, own=own, n_tasks=cc.tasks(own, bins_a_task=2 * bins))
    plan = series._jdf.queryExecution().executedPlan().toString()
    assert series.count() == 40 * bins and "REPARTITION_BY_NUM" in plan and "hashpartitioning(parcel_id" in plan and ", 20), " in plan
    assert plan.count("Sort [") == 3 and plan.count("Exchange") == 2  # looks' bins rising, the grid rising and falling


def test_looks_without_a_day_and_parcels_without_a_name(spark):
    rows = look_rows("p", PROFILES["one"]) + [("p", None, 0.3, 0.2, 0.1)] + [(None, *r[1:]) for r in look_rows("x", PROFILES["one"])]
    got = cc.regular(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.parcel_id for r in got} == {"p"} and sorted(r.bin for r in got) == list(range(len(PROFILES["one"])))


def test_candidate_peaks_need_no_sliding_frames(spark):
    """Bins that a loop over the series names, ends and flat tops included, found without a window beyond the series' own."""
    noise = np.random.default_rng(11)
    rows = [r for k in range(12) for r in look_rows(f"p{k}", np.round(0.45 + 0.3 * np.sin(np.arange(70) / (2.0 + k % 4)) + 0.05 * noise.standard_normal(70), 3))]
    rows += look_rows("flat", [0.2] * 12 + [0.7] * 6 + [0.2] * 12) + look_rows("brief", [0.2, 0.7, 0.2], ()) * 4
    series = cc.regular(spark.createDataFrame(rows, SCHEMA))
    arrays = cc.as_arrays(series)
    windows = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Window [")
    assert windows(arrays) == windows(series)
    n_found = 0
    for r in arrays.collect():
        for p in cc.passes():
            a, n = r[p.value], len(r[p.value])
            drop = lambda j: a[j] - min(a[max(0, j - p.reach) : j + p.reach + 1])  # noqa: B023, E731
            want = [j for j in range(p.window, n - p.window) if a[j] >= p.peak and a[j] >= max(a[j - p.window : j + p.window + 1]) - 0.005 and drop(j) >= p.prominence]
            assert r[f"peaks_{p.name}"] == want
            n_found += len(want)
    assert n_found > 100


def test_halves_of_a_step_go_to_the_even_bin(spark):
    days = [0, 5, 15, 25, 35, 45, 55, 65, 75, 120]
    looks = spark.createDataFrame([("p", date(2021, 6, 1) + timedelta(days=d), 0.5, 0.4, 0.1) for d in days], SCHEMA)
    assert sorted(r.bin for r in cc.regular(looks).where("seen").collect()) == [0, 2, 4, 6, 8, 12]
