"""A season as it runs: irrigation that no rain explains, a daily state that looks correct, nitrogen, yield, and whether a
village is below its normal; declared crops against what was seen; and days that are final taken from a stored table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Prior:
    """What is known of a crop beforehand. Those of soybean."""

    typical_days: int = 110
    max_days: int = 130
    base_temp: float = 10.0
    best_temp: float = 28.0
    top_temp: float = 38.0
    heat: float = 36.0
    lag: int = 10
    tau_peak: float = 0.58
    light_use: float = 1.6
    harvest_index: float = 0.40
    cover_max: float = 0.88
    base_yield: float = 1.2


def _within(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def irrigated(wetness: DataFrame, rain: DataFrame, near: DataFrame, days: int = 6, jump: float = 0.08, rain_days: int = 4, least_rain: float = 5.0, shared: float = 0.06) -> DataFrame:
    """field_id and d of each wetting that the rain did not bring and the neighbourhood did not share: the index rose since
    the look before (not over 6 days back), with under 5 mm of rain since four days earlier, and not as much around.

    wetness: field_id, area, d, ndmi; rain: area, d, rain; near: area, d, ndmi of the land around.
    """
    by = Window.partitionBy("field_id").orderBy("d")
    looks = wetness.withColumns({"before": F.lag("ndmi").over(by), "d0": F.lag("d").over(by)})
    looks = looks.where((F.col("d") - F.col("d0") <= days) & (F.col("ndmi") - F.col("before") >= jump))
    fell = rain.groupBy("area", "d").agg(F.sum("rain").alias("rain")).withColumn("d", F.explode(F.sequence(F.col("d"), F.col("d") + rain_days)))
    fell = fell.groupBy("area", "d").agg(F.sum("rain").alias("rain"))
    around = near.select("area", F.col("d").alias("d"), F.col("ndmi").alias("now"))
    earlier = near.select("area", F.col("d").alias("d0"), F.col("ndmi").alias("then"))
    told = looks.join(fell, ["area", "d"], "left").join(around, ["area", "d"], "left").join(earlier, ["area", "d0"], "left")
    dry = F.coalesce("rain", F.lit(0.0)) < least_rain
    alone = ~F.coalesce(F.col("now") - F.col("then") >= shared, F.lit(False))
    return told.where(dry & alone).select("field_id", "d")


def warmth(mean: Column, prior: Prior) -> Column:
    rising = (mean - prior.base_temp) / (prior.best_temp - prior.base_temp)
    falling = (prior.top_temp - mean) / (prior.top_temp - prior.best_temp)
    out = (mean <= prior.base_temp) | (mean >= prior.top_temp)
    return F.when(out, 0.05).otherwise(F.greatest(F.lit(0.05), F.when(mean <= prior.best_temp, rising).otherwise(falling)))


#: What corrected a day, and for each the prediction's share of the cover, the look's share, and what is left of uncertainty.
KINDS = ("inferred", "optical", "radar", "coarse")
_OWN, _SEEN, _LEFT = np.array([1.0, 0.35, 0.55, 0.70]), np.array([0.0, 0.65, 0.45, 0.30]), np.array([1.0, 0.35, 0.62, 0.80])
FIELDS_AT_ONCE = 512


def moved_on(day: dict[str, np.ndarray], prior: Prior) -> dict[str, np.ndarray]:
    """cover, water, biomass, gain and uncertainty, a row a field and a column a day: one step a day for all fields at once.
    day: matrices as daily_state() names them. NaN is the largest value, as it is in Spark."""
    least, greatest = np.fmin, np.maximum
    within = lambda x, low=0.0, high=1.0: greatest(low, least(high, x))
    n, size = day["d"].shape
    out = {c: np.zeros((n, size)) for c in ("cover", "water", "biomass", "gain", "uncertainty")}
    cover, water, biomass, unsure = np.full(n, 0.05), np.full(n, 0.55), np.zeros(n), np.full(n, 0.40)
    for k in range(size):
        light, heat, loss, fall, irrigated, target, wet, kind = (day[c][:, k] for c in ("light", "heat", "loss", "fall", "irrigated", "target", "wet", "kind"))
        growing, moist = ~np.isnan(heat), within(water, 0.15)
        gain = np.where(growing, light * within(1.15 * cover - 0.05, 0.0, 0.95) * heat * moist * 10.0, 0.0)
        cover = np.where(growing, least(prior.cover_max, cover + 0.018 * greatest(0.0, prior.cover_max - cover) * heat * moist), cover)
        water = water - loss + fall
        water = within(np.where(irrigated, greatest(water, 0.75), water))
        cover = np.where(kind > 0, _OWN[kind] * cover + _SEEN[kind] * target, cover)
        water = np.where(np.isnan(wet), water, 0.40 * water + 0.60 * wet)
        biomass, unsure = biomass + gain, least(1.0, unsure + 0.035) * _LEFT[kind]
        for c, x in zip(out, (cover, water, biomass, gain, unsure)):
            out[c][:, k] = x
    return out


def daily_state(days: DataFrame, prior: Prior = Prior()) -> DataFrame:
    """A row a field and day: cover, water, biomass, the day's gain, uncertainty and kind (what corrected the day: optical,
    radar, coarse, or inferred from weather alone).

    days: field_id, d, every day of the season once, with tmean, par, et0, rain, irrigated, sown (a day, or null where not
    known) and what was seen: ndvi, ndmi, rvi, coarse. Missing weather has a mild day's values. What a day brings is worked
    out a row; a field's days then meet in one array, and what hangs on the day before moves on in batches of fields.
    """
    given = {"tmean": prior.best_temp, "par": 8.0, "et0": 4.0, "rain": 0.0}
    day = days.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(x)) for c, x in given.items()})
    optical, radar, coarse = F.col("ndvi").isNotNull(), F.col("rvi").isNotNull(), F.col("coarse").isNotNull()
    of_ndvi = lambda x: _within((x - 0.12) / 0.72)
    brought = {
        "light": prior.light_use * F.col("par"),
        "heat": F.when(F.col("d") >= F.col("sown"), warmth(F.col("tmean"), prior)),  # null: not growing
        "loss": 0.025 * (F.col("et0") / 5.0),
        "fall": F.least(F.col("rain"), F.lit(40.0)) / 25.0,
        "irrigated": F.coalesce("irrigated", F.lit(False)),
        "target": F.when(optical, of_ndvi(F.col("ndvi"))).when(radar, _within((F.col("rvi") - 0.12) / 0.55)).when(coarse, of_ndvi(F.col("coarse"))),
        "wet": F.when(optical & F.col("ndmi").isNotNull(), _within((F.col("ndmi") + 0.15) / 0.55)),
        "kind": F.when(optical, 1).when(radar, 2).when(coarse, 3).otherwise(0),
    }
    day = day.select("field_id", F.struct(F.col("d").cast("int").alias("d"), *[c.alias(name) for name, c in brought.items()]).alias("day"))
    series = day.groupBy("field_id").agg(F.sort_array(F.collect_list("day")).alias("days"))
    states, given_a_day = ("cover", "water", "biomass", "gain", "uncertainty"), ("d", *brought)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, FIELDS_AT_ONCE):
                part = batch.slice(start, FIELDS_AT_ONCE)
                lengths = part.column(1).value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(lengths)), lengths)
                place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                flat = dict(zip(given_a_day, part.column(1).flatten().flatten()))
                days_ = {}
                for name, values in flat.items():
                    values = values.to_numpy(zero_copy_only=False)
                    days_[name] = np.zeros((len(lengths), lengths.max()), values.dtype)
                    days_[name][row, place] = values
                out = moved_on(days_, prior)
                columns = [part.column(0).take(pa.array(row)), flat["d"], *[pa.array(out[c][row, place]) for c in states], flat["kind"]]
                yield pa.RecordBatch.from_arrays(columns, names=["field_id", "d", *states, "kind"])

    schema = f"field_id {series.schema['field_id'].dataType.simpleString()}, d int, {', '.join(f'{c} double' for c in states)}, kind int"
    return series.mapInArrow(run, schema).withColumn("kind", F.get(F.array(*map(F.lit, KINDS)), F.col("kind")))


def with_progress(states: DataFrame, sowings: DataFrame, prior: Prior = Prior()) -> DataFrame:
    """states with emerged, peak (the day of most cover after that; null while it is the last) and tau, how far the season is:
    up to the crop's share at its peak, then on over 45 days. sowings: field_id, sown."""
    own = Window.partitionBy("field_id")
    rows = states.join(sowings.select("field_id", (F.col("sown") + prior.lag).alias("emerged")), "field_id")
    alive = F.when(F.col("d") >= F.col("emerged"), F.struct((-F.round("cover", 9)).alias("c"), "d"))
    rows = rows.withColumns({"top": F.min(alive).over(own)["d"], "last": F.max("d").over(own)})
    rows = rows.withColumn("peak", F.when(F.col("top") < F.col("last"), F.col("top")))
    d, peak = F.col("d"), F.col("peak")
    before = prior.tau_peak * F.least(F.lit(1.0), (d - F.col("emerged")) / F.greatest(F.coalesce(peak - F.col("emerged"), F.lit(prior.typical_days * prior.tau_peak)), F.lit(1)))
    after = F.least(F.lit(0.97), prior.tau_peak + (1 - prior.tau_peak) * F.least(F.lit(1.0), (d - peak) / 45.0))
    tau = F.when(d < F.col("emerged"), 0.0).when(peak.isNotNull() & (d > peak), after).otherwise(before)
    return rows.withColumn("tau", F.coalesce(tau, F.lit(0.0))).drop("top", "last")


def nitrogen(states: DataFrame, reds: DataFrame, least: int = 4) -> DataFrame:
    """A row a field and day with enough red-edge values, seen in the middle of the season: score, band, what was seen and
    what the cover lets expect, and the penalty that yield takes. states: as with_progress() has them; reds: field_id, d,
    ndre, cire, a row a pixel."""
    seen = reds.groupBy("field_id", "d").agg(F.count("ndre").alias("n"), F.count("cire").alias("m"), F.median("ndre").alias("ndre"), F.median("cire").alias("cire"))
    seen = seen.where((F.col("n") >= least) | (F.col("m") >= least))
    rows = states.where((F.col("kind") == "optical") & F.col("tau").between(0.08, 0.92)).join(seen, ["field_id", "d"])
    expected = F.greatest(0.08 + 0.38 * F.greatest(F.col("cover"), F.lit(0.0)), F.lit(0.12))
    actual = F.coalesce("ndre", _within(F.col("cire") * 0.25, 0.0, 0.6))
    rows = rows.withColumn("expected", expected).withColumn("actual", F.when(F.col("tau") < 0.15, F.greatest(actual, F.col("expected") * 0.75)).otherwise(actual))
    score = _within(100 * F.least(F.col("actual") / F.col("expected"), F.lit(1.25)) / 1.25, 0.0, 100.0)
    rows = rows.withColumn("score", score)
    penalty = F.when(F.col("score") < 55, F.greatest(F.lit(0.0), (55 - F.col("score")) / 220)).otherwise(0.0)
    return rows.select("field_id", "d", "score", F.when(F.col("score") < 50, "low").when(F.col("score") < 75, "medium").otherwise("high").alias("band"), "actual", "expected", penalty.alias("penalty"))


def shares_at_most(values: DataFrame, group: str, value: str, digits: int = 3) -> DataFrame:
    """values with peers (rows of the group) and place, the share of them at most as high, for a value rounded so that a
    group is counted by its distinct values and never gathered."""
    rounded = values.withColumn("__v", F.round(value, digits))
    counts = rounded.groupBy(group, "__v").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(group)
    told = counts.select(group, "__v", F.sum("n").over(own).alias("peers"), (F.sum("n").over(own.orderBy("__v")) / F.sum("n").over(own)).alias("place"))
    return rounded.join(told, [group, "__v"], "left").drop("__v")


def yield_ensemble(states: DataFrame, fields: DataFrame, prior: Prior = Prior(), least_peers: int = 15) -> DataFrame:
    """A row a field that has emerged: t_ha, the median of what biomass, the highest canopy and, with enough peers, the rank
    among them say, each cut by what drought, heat, unevenness and nitrogen leave; low and high, wider the less they agree
    and the less is known; and pool.

    states: as with_progress() has them, with hot (whether the day was too hot); fields: field_id, group (peers), district
    (its yield, or null), uneven, penalty (nitrogen), sowing_span (days), outlier.
    """
    own = Window.partitionBy("field_id")
    rows = states.withColumn("last", F.max("d").over(own))
    critical = F.col("tau").between(prior.tau_peak * 0.75, 0.9)
    share = lambda test: F.coalesce(F.count_if(test & critical) / F.nullif(F.count_if(critical), F.lit(0)), F.count_if(test) / F.count(F.lit(1)))
    by = rows.groupBy("field_id").agg(
        share(F.col("water") < 0.35).alias("dry"), share(F.coalesce("hot", F.lit(False))).alias("heat"),
        F.sum(F.when(F.col("d") >= F.col("emerged"), F.col("cover")).otherwise(0.0)).alias("integral"), F.max("cover").alias("top"),
        F.avg(F.when(F.col("d") > F.col("last") - 7, F.col("gain"))).alias("recent"),
        F.max_by(F.struct("biomass", "uncertainty", "tau", "emerged", "peak", "d"), "d").alias("now"),
    )
    by = by.join(fields, "field_id").where((F.col("now.tau") > 0.05) & F.col("now.emerged").isNotNull())
    by = shares_at_most(by, "group", "integral")
    keep = _within(1 - (0.40 * F.col("dry") + 0.25 * _within(F.col("heat")) + 0.20 * _within(F.col("uneven")) + F.col("penalty")), 0.35)
    rate = F.greatest(F.col("now.tau") / F.greatest(F.col("now.d") - F.col("now.emerged"), F.lit(1)), F.lit(1.0 / prior.max_days))
    by = by.withColumns({"keep": keep, "left": F.when(F.col("now.tau") < 0.98, F.bround((1 - F.col("now.tau")) / rate)).otherwise(0), "base": F.when(F.col("district") > 0, F.col("district")).otherwise(prior.base_yield)})
    enough = F.col("peers") >= least_peers
    biomass = (F.col("now.biomass") + F.col("recent") * F.col("left") * 0.85) * prior.harvest_index / 1000 * F.col("keep")
    canopy = F.col("base") * (F.col("top") / max(prior.cover_max * 0.85, 0.2)) * F.col("keep")
    ranked = F.when(enough, F.col("base") * (0.55 + 0.90 * F.col("place")) * F.col("keep"))
    by = by.withColumns({"biomass": biomass, "canopy": canopy, "ranked": ranked}).withColumns({"lowest": F.least("biomass", "canopy", "ranked"), "highest": F.greatest("biomass", "canopy", "ranked")})
    point = F.when(enough, F.col("biomass") + F.col("canopy") + F.col("ranked") - F.col("lowest") - F.col("highest")).otherwise((F.col("biomass") + F.col("canopy")) / 2)
    pool = F.when(enough, "district_peers").when(F.col("district") > 0, "district_statistic").otherwise("crop_shape")
    by = by.withColumns({"t_ha": point, "pool": pool})
    before_peak = F.col("now.peak").isNull() | (F.col("now.d") <= F.col("now.peak"))
    wide = 0.10 * (F.greatest(F.col("sowing_span"), F.lit(0)) / 14) + 0.22 * _within(F.col("now.uncertainty")) + F.when(F.col("outlier"), 0.30).otherwise(0.0)
    wide += F.when(F.col("pool") == "crop_shape", 0.12).otherwise(0.0) + F.when(before_peak, 0.10).otherwise(0.0)
    extra = (F.col("highest") - F.col("lowest")) / 2 + F.col("t_ha") * wide
    return by.select("field_id", "t_ha", F.greatest(F.lit(0.0), F.col("t_ha") - extra).alias("low"), (F.col("t_ha") + extra).alias("high"), "biomass", "canopy", "ranked", "pool", F.col("keep").alias("retention"), F.col("integral").alias("cover_integral"), F.col("base").alias("baseline"), "peers")


OFFSETS = range(-30, 151, 10)


def village_normal(curves: DataFrame, onsets: DataFrame, current: int, bin_days: int = 10, least_years: int = 3, run: int = 2) -> DataFrame:
    """A row a village and offset from the onset of its rains: the current year's value, the median and quartiles of at
    least three past years at that offset, the longest run of offsets under the lower quartile, and status.

    curves: village, year, day, value; onsets: village, year, onset. A value counts at the offsets near the middle of its
    bin; an offset's value in a year is the median of those.
    """
    x = F.datediff("day", "onset") + bin_days / 2
    placed = curves.join(onsets.where("onset IS NOT NULL"), ["village", "year"]).withColumn("x", x)
    each = placed.withColumn("offset", F.explode(F.array(*[F.lit(k) for k in OFFSETS]))).where(F.abs(F.col("x") - F.col("offset")) <= bin_days)
    by = each.groupBy("village", "year", "offset").agg(F.median("value").alias("value"))
    past = by.where(F.col("year") != current).groupBy("village", "offset").agg(F.median("value").alias("normal"), F.percentile("value", F.lit(0.25)).alias("p25"), F.percentile("value", F.lit(0.75)).alias("p75"))
    years = curves.where(F.col("year") != current).groupBy("village").agg(F.count_distinct("year").alias("years"))
    now = by.where(F.col("year") == current).select("village", "offset", F.col("value").alias("current"))
    every = years.withColumn("offset", F.explode(F.array(*[F.lit(k) for k in OFFSETS])))
    rows = every.join(past, ["village", "offset"], "left").join(now, ["village", "offset"], "left")
    below = F.coalesce(F.col("current") < F.col("p25"), F.lit(False))
    order = Window.partitionBy("village").orderBy("offset")
    rows = rows.withColumn("below", below).withColumn("island", F.row_number().over(order) - F.sum(F.col("below").cast("int")).over(order))
    rows = rows.withColumn("run", F.sum(F.col("below").cast("int")).over(Window.partitionBy("village", "island")))
    own = Window.partitionBy("village")
    longest, seen = F.max(F.when(F.col("below"), F.col("run")).otherwise(0)).over(own), F.count("current").over(own)
    status = F.when(F.col("years") < least_years, "unavailable").when(longest >= run, "below_normal").when(seen > 0, "near_normal").otherwise("unavailable")
    return rows.select("village", "offset", "current", "normal", "p25", "p75", longest.alias("longest_below"), status.alias("status"), "years")


def season_inference(series: DataFrame, low: float = 0.30, high: float = 0.45) -> DataFrame:
    """A row a parcel and year: the mean signal before, in and after the monsoon, and what it says of the season in between.
    series: parcel_id, day, value."""
    y, md = F.year("day").alias("year"), F.month("day") * 100 + F.dayofmonth("day")
    mean = lambda a, b: F.avg(F.when(md.between(a, b), F.col("value")))
    by = series.groupBy("parcel_id", y).agg(mean(401, 531).alias("pre"), mean(701, 831).alias("mid"), mean(901, 1031).alias("post"))
    pre, post = F.col("pre"), F.col("post")
    label = (
        F.when((pre < low) & (post >= high), "kharif_sown_in_gap")
        .when((pre >= high) & (post.isNull() | (post >= high)), "summer_or_long_duration_present")
        .when((pre.isNull() | (pre < low)) & (post.isNull() | (post < low)), "no_kharif")
        .otherwise("ambiguous")
    )
    return by.withColumn("presence", label)


@dataclass(frozen=True)
class Declared:
    """Tolerances of a declared crop's check."""

    days: float = 0.30
    peak: float = 0.25
    least_cycles: int = 1
    least_share: float = 0.5
    confidence: float = 0.55


# Crop, least and most days, highest expected NDVI.
CROPS = [("Rice", 100, 150, 0.90), ("Soyabean", 90, 130, 0.88), ("Cotton", 150, 210, 0.85), ("Bajra", 65, 110, 0.78), ("Wheat", 110, 150, 0.90), ("Gram", 100, 140, 0.82)]


def verified(claims: DataFrame, cycles: DataFrame, crops: Sequence[tuple] = CROPS, how: Declared = Declared()) -> DataFrame:
    """A row a claim: outcome (consistent, inconsistent or indeterminate), confidence, counts and reason. A cycle agrees
    within the crop's days, give or take, and with at least most of its expected peak. Nothing is said of crops without a
    reference, of plants that stay, or without a cycle. claims: parcel_id, declared; cycles: parcel_id, kind, days, peak_ndvi."""
    known = claims.sparkSession.createDataFrame(list(crops), "crop string, least int, most int, expected double")
    asked = claims.join(known, F.initcap(F.trim("declared")) == F.col("crop"), "left")
    fits = F.col("days").between(F.col("least") * (1 - how.days), F.col("most") * (1 + how.days))
    high = F.coalesce(F.col("peak_ndvi") >= F.col("expected") * (1 - how.peak), F.lit(True))
    met = asked.join(cycles.where("days IS NOT NULL"), "parcel_id", "left")
    any_cycle = F.col("kind").isNotNull()
    by = met.groupBy("parcel_id", "declared", "crop").agg(
        F.coalesce(F.bool_or(F.col("kind") == "perennial"), F.lit(False)).alias("stays"), F.count_if(any_cycle).alias("cycles"), F.count_if(any_cycle & fits).alias("in_days"), F.count_if(any_cycle & fits & high).alias("consistent")
    )
    share = F.try_divide("consistent", "cycles")
    able = F.col("crop").isNotNull() & ~F.col("stays") & (F.col("cycles") >= how.least_cycles)
    outcome = F.when(~able, "indeterminate").when(share >= how.least_share, "consistent").otherwise("inconsistent")
    reason = F.when(F.col("declared").isNull() | (F.trim("declared") == ""), "none declared").when(F.col("crop").isNull(), "no reference").when(F.col("stays"), "perennial").when(F.col("cycles") < how.least_cycles, "too few cycles")
    return by.select("parcel_id", "declared", outcome.alias("outcome"), F.when(outcome == "consistent", F.round(how.confidence * share, 3)).otherwise(0.0).alias("confidence"), "cycles", "in_days", "consistent", reason.alias("reason"))


def continued(stored: DataFrame, fresh: DataFrame, day: str, through: str) -> DataFrame:
    """Rows of a stored table up to a day, which are final, and freshly computed ones after it. The cut is put on both, so it
    reaches both scans and nothing up to the day is computed again. Rows keep the stored table's columns, and `origin`."""
    until = F.lit(through).cast("date")
    old = stored.where(F.col(day) <= until).withColumn("origin", F.lit("reused"))
    new = fresh.where(F.col(day) > until).select(*stored.columns).withColumn("origin", F.lit("computed"))
    return old.unionByName(new)
