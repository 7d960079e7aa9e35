"""Queries of a season as it runs. A field is a supplier, its looks are its line items of all years laid over one season of
184 days from the first of May; an area is the supplier's nation, and its rain comes from the orders of its customers."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilth.operators import cropcycles as cc
from tilth.operators import monitor
from tilth.operators.graph import written
from tilth.plans.base import WEATHER, query, table, weather
from tilth.plans.cropcycles import ADAPTIVE, ARRAYS, BASE, CHOSEN, DENSITY, DESCRIBED, LOOKS, NDVI, PERENNIAL, REGULAR, RULES, _pass, looks
from tilth.sources.shared import shared_dir

DAYS = 184


def _season_day(day):
    return F.datediff(day, F.make_date(F.year(day), F.lit(5), F.lit(1)))


def season_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field_id, area, d, echo, ndvi, ndmi, rvi, ndre, cire: a row a look."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("field_id"), F.col("s_nationkey").alias("area"))
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("field_id"), _season_day(F.col("l_shipdate").cast("date")).alias("d"), (F.col("l_linenumber") % 4 == 0).alias("echo"), ((F.col("l_discount").cast("double") - 0.05) / 5).alias("noise")
    )
    k, d = F.col("field_id"), F.col("d")
    sown = 30 + k % 20
    canopy = F.when(d < sown + 10, 0.13).when(d < sown + 100, F.least(F.lit(0.78), 0.13 + 0.011 * (d - sown - 10))).otherwise(F.greatest(F.lit(0.15), 0.78 - 0.015 * (d - sown - 100)))
    rows = line.where(F.col("d").between(0, DAYS - 1)).withColumn("green", canopy + F.col("noise")).join(supplier, "field_id")
    wet = F.when((k % 3 == 0) & (d % 30).between(3, 6), 0.12).otherwise(0.0)
    red = 0.08 + 0.36 * F.col("green") * F.when(k % 4 == 0, 0.6).otherwise(1.0)
    optical = ~F.col("echo")
    return rows.select(
        "field_id", "area", "d", "echo", F.when(optical, F.col("green")).alias("ndvi"), F.when(optical, 0.45 * F.col("green") - 0.1 + wet).alias("ndmi"), F.when(F.col("echo"), 0.2 + 0.5 * F.col("green")).alias("rvi"),
        F.when(optical, red).alias("ndre"), F.when(optical, red * 3).alias("cire"),
    )


def season_rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """area, d, rain: the mean of the years, on every ninth day."""
    w = weather(spark, sf_dir).select(F.col("cell").alias("area"), _season_day(F.col("day")).alias("d"), "rain")
    return w.where(F.col("d").between(0, DAYS - 1) & (F.col("d") % 9 == F.col("area") % 9)).groupBy("area", "d").agg(F.avg("rain").alias("rain"))


SEASON = f"""{WEATHER},
sl0 AS (SELECT l_suppkey AS k, CAST(CAST(l_shipdate AS DATE) - make_date(year(CAST(l_shipdate AS DATE)), 5, 1) AS INTEGER) AS d, l_linenumber % 4 = 0 AS echo, (CAST(l_discount AS DOUBLE) - 0.05) / 5 AS noise, 30 + l_suppkey % 20 AS sown FROM lineitem),
sl1 AS (
  SELECT k, d, echo, noise + CAST(CASE WHEN d < sown + 10 THEN 0.13 WHEN d < sown + 100 THEN least(0.78, 0.13 + 0.011 * (d - sown - 10)) ELSE greatest(0.15, 0.78 - 0.015 * (d - sown - 100)) END AS DOUBLE) AS green FROM sl0 WHERE d BETWEEN 0 AND {DAYS - 1}),
sl AS (
  SELECT k AS field_id, s_nationkey AS area, d, echo, CASE WHEN NOT echo THEN green END AS ndvi, CASE WHEN NOT echo THEN 0.45 * green - 0.1 + CASE WHEN k % 3 = 0 AND d % 30 BETWEEN 3 AND 6 THEN 0.12 ELSE 0 END END AS ndmi, CASE WHEN echo THEN 0.2 + 0.5 * green END AS rvi,
    CASE WHEN NOT echo THEN 0.08 + 0.36 * green * CASE WHEN k % 4 = 0 THEN 0.6 ELSE 1 END END AS ndre FROM sl1 JOIN supplier ON s_suppkey = k),
rn AS (
  SELECT area, d, avg(rain) AS rain FROM (SELECT cell AS area, CAST(day - make_date(year(day), 5, 1) AS INTEGER) AS d, rain FROM weather) WHERE d BETWEEN 0 AND {DAYS - 1} AND d % 9 = area % 9 GROUP BY 1, 2),
wet AS (SELECT field_id, any_value(area) AS area, d, avg(ndmi) AS ndmi FROM sl WHERE NOT echo GROUP BY 1, 3),
land AS (SELECT area, d, avg(ndmi) AS ndmi FROM sl WHERE NOT echo GROUP BY 1, 2),
jumps AS (SELECT field_id, area, d, ndmi - lag(ndmi) OVER w AS jump, lag(d) OVER w AS d0 FROM wet WINDOW w AS (PARTITION BY field_id ORDER BY d)),
irr AS (
  SELECT j.field_id, j.d FROM jumps j LEFT JOIN land a ON a.area = j.area AND a.d = j.d LEFT JOIN land b ON b.area = j.area AND b.d = j.d0
  WHERE j.d - d0 <= 6 AND jump >= 0.08 AND coalesce((SELECT sum(rain) FROM rn WHERE rn.area = j.area AND rn.d BETWEEN j.d - 4 AND j.d), 0) < 5 AND NOT coalesce(a.ndmi - b.ndmi >= 0.06, false))"""


def _irrigated(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = season_looks(spark, sf_dir).where("NOT echo")
    wet = seen.groupBy("field_id", "area", "d").agg(F.avg("ndmi").alias("ndmi"))
    return monitor.irrigated(wet, season_rain(spark, sf_dir), seen.groupBy("area", "d").agg(F.avg("ndmi").alias("ndmi")))


@query(f"WITH {SEASON} SELECT field_id, d FROM irr")
def irrigation_events(spark, sf_dir):
    """Wettings that no rain brought and the land around did not share."""
    return _irrigated(spark, sf_dir)


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = season_looks(spark, sf_dir).groupBy("field_id", "d").agg(F.avg("ndvi").alias("ndvi"), F.avg("ndmi").alias("ndmi"), F.avg("rvi").alias("rvi"))
    fields = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("field_id"), F.col("s_nationkey").alias("area"))
    every = fields.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(DAYS - 1))))
    water = _irrigated(spark, sf_dir).withColumn("irrigated", F.lit(True))
    rows = every.join(season_rain(spark, sf_dir), ["area", "d"], "left").join(water, ["field_id", "d"], "left").join(seen, ["field_id", "d"], "left")
    k, d = F.col("field_id"), F.col("d")
    given = {"tmean": 20 + (d % 23) * 0.5, "par": 7 + d % 5, "et0": 3 + d % 4, "sown": F.when(k % 11 != 0, 30 + k % 20), "coarse": F.when((k % 5 == 1) & (d % 16 == 0), 0.3)}
    return rows.withColumns(given)


P = monitor.Prior()
_COVER = "least(1, greatest(0, ({0} - 0.12) / 0.72))"
STATES = f"""{SEASON},
ob AS (SELECT field_id, d, avg(ndvi) AS ndvi, avg(ndmi) AS ndmi, avg(rvi) AS rvi FROM sl GROUP BY 1, 2),
dy0 AS (SELECT s_suppkey AS field_id, s_nationkey AS area, CAST(unnest(range(0, {DAYS})) AS INTEGER) AS d FROM supplier),
dy AS (
  SELECT y.field_id, y.area, y.d, 20 + (y.d % 23) * 0.5 AS tmean, 7 + y.d % 5 AS par, 3 + y.d % 4 AS et0, coalesce(rain, 0) AS rain, i.d IS NOT NULL AS irrigated, CASE WHEN y.field_id % 11 <> 0 THEN 30 + y.field_id % 20 END AS sown, ndvi, ndmi, rvi, CASE WHEN y.field_id % 5 = 1 AND y.d % 16 = 0 THEN 0.3 END AS coarse
  FROM dy0 y LEFT JOIN rn ON rn.area = y.area AND rn.d = y.d LEFT JOIN irr i ON i.field_id = y.field_id AND i.d = y.d LEFT JOIN ob o ON o.field_id = y.field_id AND o.d = y.d),
heat AS (
  SELECT *, coalesce(d >= sown, false) AS growing, CASE WHEN tmean <= {P.base_temp} OR tmean >= {P.top_temp} THEN 0.05 WHEN tmean <= {P.best_temp} THEN greatest(0.05, (tmean - {P.base_temp}) / {P.best_temp - P.base_temp}) ELSE greatest(0.05, ({P.top_temp} - tmean) / {P.top_temp - P.best_temp}) END AS warm FROM dy),
st AS (
  SELECT field_id, -1 AS d, CAST(0.05 AS DOUBLE) AS cover, CAST(0.55 AS DOUBLE) AS water, CAST(0 AS DOUBLE) AS biomass, CAST(0 AS DOUBLE) AS gain, CAST(0.4 AS DOUBLE) AS uncertainty, '' AS kind FROM (SELECT DISTINCT field_id FROM dy)
  UNION ALL SELECT field_id, d, CASE WHEN ndvi IS NOT NULL THEN 0.35 * cover1 + 0.65 * {_COVER.format('ndvi')} WHEN rvi IS NOT NULL THEN 0.55 * cover1 + 0.45 * least(1, greatest(0, (rvi - 0.12) / 0.55)) WHEN coarse IS NOT NULL THEN 0.7 * cover1 + 0.3 * {_COVER.format('coarse')} ELSE cover1 END,
    CASE WHEN ndvi IS NOT NULL AND ndmi IS NOT NULL THEN 0.4 * water1 + 0.6 * least(1, greatest(0, (ndmi + 0.15) / 0.55)) ELSE water1 END, biomass + gain1, gain1, uncertainty1 * CASE WHEN ndvi IS NOT NULL THEN 0.35 WHEN rvi IS NOT NULL THEN 0.62 WHEN coarse IS NOT NULL THEN 0.8 ELSE 1 END,
    CASE WHEN ndvi IS NOT NULL THEN 'optical' WHEN rvi IS NOT NULL THEN 'radar' WHEN coarse IS NOT NULL THEN 'coarse' ELSE 'inferred' END
  FROM (SELECT h.*, s.biomass, CASE WHEN growing THEN {P.light_use} * par * least(0.95, greatest(0, 1.15 * s.cover - 0.05)) * warm * least(1, greatest(0.15, s.water)) * 10 ELSE 0 END AS gain1,
      CASE WHEN growing THEN least({P.cover_max}, s.cover + 0.018 * greatest(0, {P.cover_max} - s.cover) * warm * least(1, greatest(0.15, s.water))) ELSE s.cover END AS cover1,
      least(1, greatest(0, CASE WHEN irrigated THEN greatest(0.75, s.water - 0.025 * (et0 / 5.0) + least(rain, 40) / 25.0) ELSE s.water - 0.025 * (et0 / 5.0) + least(rain, 40) / 25.0 END)) AS water1, least(1, s.uncertainty + 0.035) AS uncertainty1
    FROM st s JOIN heat h ON h.field_id = s.field_id AND h.d = s.d + 1)),
state AS (SELECT * FROM st WHERE d >= 0)"""


@query(f"WITH RECURSIVE {STATES} SELECT field_id, d, round(cover, 8) AS cover, round(water, 8) AS water, round(biomass, 5) AS biomass, round(gain, 5) AS gain, round(uncertainty, 8) AS uncertainty, kind FROM state")
def daily_state(spark, sf_dir):
    """Each field's cover, water and biomass day by day, moved on by weather and corrected by looks."""
    s = monitor.daily_state(_days(spark, sf_dir), P)
    return s.select("field_id", "d", F.round("cover", 8).alias("cover"), F.round("water", 8).alias("water"), F.round("biomass", 5).alias("biomass"), F.round("gain", 5).alias("gain"), F.round("uncertainty", 8).alias("uncertainty"), "kind")


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = monitor.daily_state(_days(spark, sf_dir), P)
    sown = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("field_id"), F.when(F.col("s_suppkey") % 11 != 0, 30 + F.col("s_suppkey") % 20).alias("sown"))
    return monitor.with_progress(states, sown, P)


PROGRESS = f"""{STATES},
pk AS (SELECT field_id, sown + {P.lag} AS emerged, arg_min(d, (-round(cover, 9), d)) FILTER (d >= sown + {P.lag}) AS top FROM state JOIN (SELECT DISTINCT field_id, sown FROM dy) USING (field_id) GROUP BY 1, 2),
pg AS (
  SELECT s.*, emerged, CASE WHEN top < {DAYS - 1} THEN top END AS peak, coalesce(CASE WHEN d < emerged THEN 0 WHEN top < {DAYS - 1} AND d > top THEN least(0.97, {P.tau_peak} + {1 - P.tau_peak} * least(1, (d - top) / 45.0))
    ELSE {P.tau_peak} * least(1, (d - emerged) / CAST(greatest(coalesce(CASE WHEN top < {DAYS - 1} THEN top - emerged END, {P.typical_days * P.tau_peak}), 1) AS DOUBLE)) END, 0) AS tau FROM state s JOIN pk USING (field_id)),
reds AS (SELECT field_id, d, count(ndre) AS n, median(ndre) AS ndre FROM sl GROUP BY 1, 2 HAVING count(ndre) >= 4),
ni0 AS (SELECT p.field_id, p.d, greatest(0.12, 0.08 + 0.38 * greatest(cover, 0)) AS expected, tau, ndre FROM pg p JOIN reds USING (field_id, d) WHERE kind = 'optical' AND tau BETWEEN 0.08 AND 0.92),
ni1 AS (SELECT *, CASE WHEN tau < 0.15 THEN greatest(ndre, expected * 0.75) ELSE ndre END AS actual FROM ni0),
ni AS (SELECT *, least(100, greatest(0, 100 * least(actual / expected, 1.25) / 1.25)) AS score FROM ni1)"""


@query(f"""WITH RECURSIVE {PROGRESS} SELECT field_id, d, round(score, 6) AS score, CASE WHEN score < 50 THEN 'low' WHEN score < 75 THEN 'medium' ELSE 'high' END AS band, round(actual, 8) AS actual, round(expected, 8) AS expected, CASE WHEN score < 55 THEN round(greatest(0, (55 - score) / 220), 8) ELSE 0 END AS penalty FROM ni""")
def nitrogen_status(spark, sf_dir):
    """Red edge against what the cover lets expect, in the middle of the season."""
    n = monitor.nitrogen(_progress(spark, sf_dir), season_looks(spark, sf_dir).where("NOT echo"))
    return n.select("field_id", "d", F.round("score", 6).alias("score"), "band", F.round("actual", 8).alias("actual"), F.round("expected", 8).alias("expected"), F.round("penalty", 8).alias("penalty"))


def _rounded(c: str):
    return F.round(c, 6).alias(c)


@query(f"""WITH RECURSIVE {PROGRESS},
pen AS (SELECT field_id, avg(CASE WHEN score < 55 THEN greatest(0, (55 - score) / 220) ELSE 0 END) AS penalty FROM ni GROUP BY 1),
une AS (SELECT field_id, CASE WHEN count(ndvi) < 4 OR avg(ndvi) <= 0.05 THEN 0 ELSE least(1, greatest(0, (stddev_pop(ndvi) / avg(ndvi) - 0.08) / 0.4)) END AS uneven FROM sl WHERE d >= {DAYS - 30} GROUP BY 1),
crit AS (SELECT *, tau BETWEEN {P.tau_peak * 0.75} AND 0.9 AS critical, 20 + (d % 23) * 0.5 + 8 > {P.heat} AS hot FROM pg),
agg AS (
  SELECT field_id, coalesce(count(*) FILTER (water < 0.35 AND critical) / CAST(nullif(count(*) FILTER (critical), 0) AS DOUBLE), count(*) FILTER (water < 0.35) / CAST(count(*) AS DOUBLE)) AS dry, coalesce(count(*) FILTER (hot AND critical) / CAST(nullif(count(*) FILTER (critical), 0) AS DOUBLE), count(*) FILTER (hot) / CAST(count(*) AS DOUBLE)) AS heat_,
    sum(CASE WHEN d >= emerged THEN cover ELSE 0 END) AS integral, max(cover) AS top, avg(CASE WHEN d > {DAYS - 1 - 7} THEN gain END) AS recent, max(CASE WHEN d = {DAYS - 1} THEN biomass END) AS biomass, max(CASE WHEN d = {DAYS - 1} THEN uncertainty END) AS unsure, max(CASE WHEN d = {DAYS - 1} THEN tau END) AS tau, any_value(emerged) AS emerged, any_value(peak) AS peak
  FROM crit GROUP BY 1),
f AS (
  SELECT a.*, field_id % 3 AS grp, CASE WHEN field_id % 4 <> 3 THEN 1.0 + (field_id % 5) / 10.0 END AS district, coalesce(uneven, 0) AS uneven, coalesce(penalty, 0) AS penalty FROM agg a LEFT JOIN pen USING (field_id) LEFT JOIN une USING (field_id) WHERE tau > 0.05 AND emerged IS NOT NULL),
r AS (
  SELECT *, count(*) OVER (PARTITION BY grp) AS peers, cume_dist() OVER (PARTITION BY grp ORDER BY round(integral, 3)) AS place, greatest(0.35, least(1, 1 - (0.4 * dry + 0.25 * least(1, heat_) + 0.2 * least(1, uneven) + penalty))) AS keep, coalesce(district, {P.base_yield}) AS base,
    CASE WHEN tau < 0.98 THEN round_even((1 - tau) / greatest(tau / greatest({DAYS - 1} - emerged, 1), {1 / P.max_days}), 0) ELSE 0 END AS left_ FROM f),
e AS (SELECT *, (biomass + recent * left_ * 0.85) * {P.harvest_index} / 1000 * keep AS y1, base * (top / {P.cover_max * 0.85}) * keep AS y2, CASE WHEN peers >= 15 THEN base * (0.55 + 0.9 * place) * keep END AS y3 FROM r),
q AS (SELECT *, CASE WHEN peers >= 15 THEN y1 + y2 + y3 - least(y1, y2, y3) - greatest(y1, y2, y3) ELSE (y1 + y2) / 2 END AS t, CASE WHEN peers >= 15 THEN 'district_peers' WHEN district > 0 THEN 'district_statistic' ELSE 'crop_shape' END AS pool FROM e),
w AS (SELECT *, (greatest(y1, y2, y3) - least(y1, y2, y3)) / 2 + t * (0.1 * ((field_id % 12) / 14.0) + 0.22 * least(1, unsure) + CASE WHEN field_id % 13 = 0 THEN 0.3 ELSE 0 END + CASE WHEN pool = 'crop_shape' THEN 0.12 ELSE 0 END + CASE WHEN peak IS NULL OR {DAYS - 1} <= peak THEN 0.1 ELSE 0 END) AS extra FROM q)
SELECT field_id, round(t, 6) AS t_ha, round(greatest(0, t - extra), 6) AS low, round(t + extra, 6) AS high, round(y1, 6) AS biomass, round(y2, 6) AS canopy, round(y3, 6) AS ranked, pool, round(keep, 6) AS retention, round(integral, 6) AS cover_integral, peers FROM w""")
def yield_ensemble(spark, sf_dir):
    """The median of what biomass, canopy and peers say of the yield, less what stress took, and how wide it is."""
    progress = written(_progress(spark, sf_dir))
    lookups = season_looks(spark, sf_dir).where("NOT echo")
    penalty = monitor.nitrogen(progress, lookups).groupBy("field_id").agg(F.avg("penalty").alias("penalty"))
    spread = (F.stddev_pop("ndvi") / F.avg("ndvi") - 0.08) / 0.40
    level = F.when((F.count("ndvi") < 4) | (F.avg("ndvi") <= 0.05), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), spread)))
    uneven = lookups.where(F.col("d") >= DAYS - 30).groupBy("field_id").agg(level.alias("uneven"))
    k = F.col("s_suppkey")
    fields = table(spark, sf_dir, "supplier").select(k.alias("field_id"), (k % 3).alias("group"), F.when(k % 4 != 3, 1.0 + (k % 5) / 10.0).alias("district"), (k % 12).alias("sowing_span"), (k % 13 == 0).alias("outlier"))
    fields = fields.join(penalty, "field_id", "left").join(uneven, "field_id", "left").na.fill(0.0, ["penalty", "uneven"])
    out = monitor.yield_ensemble(progress.withColumn("hot", 20 + (F.col("d") % 23) * 0.5 + 8 > P.heat), fields, P)
    return out.select("field_id", *map(_rounded, ("t_ha", "low", "high", "biomass", "canopy", "ranked")), "pool", _rounded("retention"), _rounded("cover_integral"), "peers")


_OFFSETS = "[" + ", ".join(map(str, monitor.OFFSETS)) + "]"
VILLAGE = f"""{LOOKS},{WEATHER},
vc AS (SELECT s_nationkey AS village, year(day) AS year, day - CAST((dayofyear(day) - 1) % 10 AS INTEGER) AS day, avg(ndvi) AS value FROM lk JOIN supplier ON s_suppkey = parcel_id WHERE ndvi IS NOT NULL GROUP BY 1, 2, 3),
vr AS (SELECT cell AS village, year(day) AS year, day, sum(rain) OVER (PARTITION BY cell, year(day) ORDER BY day) AS fallen FROM weather WHERE day >= make_date(year(day), 5, 15) AND day < make_date(year(day), 9, 1)),
vo AS (SELECT village, year, min(day) AS onset FROM vr WHERE fallen >= 75 GROUP BY 1, 2),
vx AS (SELECT village, year, value, day - onset + 5.0 AS x FROM vc JOIN vo USING (village, year)),
ve AS (SELECT village, year, off, median(value) AS value FROM vx, (SELECT unnest({_OFFSETS}) AS off) WHERE abs(x - off) <= 10 GROUP BY 1, 2, 3),
vp AS (SELECT village, off, median(value) AS normal, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75 FROM ve WHERE year <> 1997 GROUP BY 1, 2),
vy AS (SELECT village, count(DISTINCT year) AS years FROM vc WHERE year <> 1997 GROUP BY 1),
vj AS (SELECT y.village, o.off, years, normal, p25, p75, n.value AS current, coalesce(n.value < p25, false) AS below FROM vy y, (SELECT unnest({_OFFSETS}) AS off) o LEFT JOIN vp ON vp.village = y.village AND vp.off = o.off LEFT JOIN ve n ON n.village = y.village AND n.off = o.off AND n.year = 1997),
vi AS (SELECT *, row_number() OVER w - sum(below::INT) OVER w AS island FROM vj WINDOW w AS (PARTITION BY village ORDER BY off)),
vl AS (SELECT village, coalesce(max(n) FILTER (n > 0), 0) AS longest FROM (SELECT village, island, sum(below::INT) AS n FROM vi GROUP BY 1, 2) GROUP BY 1)"""


@query(f"""WITH {VILLAGE} SELECT i.village, CAST(off AS INTEGER) AS days_from_onset, round(current, 9) AS current_value, round(normal, 9) AS normal, round(p25, 9) AS p25, round(p75, 9) AS p75, CAST(longest AS BIGINT) AS longest_below,
  CASE WHEN years < 3 THEN 'unavailable' WHEN longest >= 2 THEN 'below_normal' WHEN count(current) OVER (PARTITION BY i.village) > 0 THEN 'near_normal' ELSE 'unavailable' END AS status, years FROM vi i JOIN vl l ON l.village = i.village""")
def village_normal(spark, sf_dir):
    """A village's year against the same offsets from the onset of rain in the years before."""
    day = F.col("day")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("parcel_id"), F.col("s_nationkey").alias("village"))
    binned = F.date_sub(day, ((F.dayofyear(day) - 1) % 10).cast("int"))
    curves = looks(spark, sf_dir).where("ndvi IS NOT NULL").join(supplier, "parcel_id").groupBy("village", F.year(day).alias("year"), binned.alias("day")).agg(F.avg("ndvi").alias("value"))
    rain = weather(spark, sf_dir).where((day >= F.make_date(F.year(day), F.lit(5), F.lit(15))) & (day < F.make_date(F.year(day), F.lit(9), F.lit(1))))
    fallen = F.sum("rain").over(Window.partitionBy("cell", F.year(day)).orderBy("day"))
    onsets = rain.withColumn("fallen", fallen).where("fallen >= 75").groupBy(F.col("cell").alias("village"), F.year(day).alias("year")).agg(F.min("day").alias("onset"))
    out = monitor.village_normal(curves, onsets, 1997)
    return out.select("village", F.col("offset").alias("days_from_onset"), F.round("current", 9).alias("current_value"), *[F.round(c, 9).alias(c) for c in ("normal", "p25", "p75")], "longest_below", "status", "years")


@query(f"""WITH {REGULAR}, p AS (SELECT parcel_id, v, start + off AS day, month(start + off) * 100 + day(start + off) AS md FROM s),
m AS (SELECT parcel_id, CAST(year(day) AS INTEGER) AS year, avg(CASE WHEN md BETWEEN 401 AND 531 THEN v END) AS pre, avg(CASE WHEN md BETWEEN 701 AND 831 THEN v END) AS mid, avg(CASE WHEN md BETWEEN 901 AND 1031 THEN v END) AS post FROM p GROUP BY 1, 2)
SELECT parcel_id, year, round(pre, 9) AS pre, round(mid, 9) AS mid, round(post, 9) AS post, CASE WHEN pre < 0.3 AND post >= 0.45 THEN 'kharif_sown_in_gap' WHEN pre >= 0.45 AND coalesce(post >= 0.45, true) THEN 'summer_or_long_duration_present'
  WHEN coalesce(pre < 0.3, true) AND coalesce(post < 0.3, true) AND coalesce(post < 0.45, true) THEN 'no_kharif' ELSE 'ambiguous' END AS presence FROM m""")
def season_presence(spark, sf_dir):
    """What a year's signal before and after the monsoon says of the season that clouds hid."""
    series = cc.regular(looks(spark, sf_dir), RULES).select("parcel_id", F.date_add("start", F.col("off")).alias("day"), F.col("v").alias("value"))
    out = monitor.season_inference(series)
    return out.select("parcel_id", "year", *[F.round(c, 9).alias(c) for c in ("pre", "mid", "post")], "presence")


_NAMES = [c[0] for c in monitor.CROPS] + ["Dragonfruit", ""]
_DECLARED = " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(_NAMES))
_REF = ", ".join(f"('{c}', {a}, {b}, {p})" for c, a, b, p in monitor.CROPS)


@query(f"""WITH RECURSIVE {REGULAR},{ARRAYS},{_pass(BASE)},{_pass(ADAPTIVE)},{_pass(DENSITY)},{_pass(NDVI)},{PERENNIAL},{CHOSEN},{DESCRIBED},
ref(crop, least_, most_, expected) AS (VALUES {_REF}), claim AS (SELECT s_suppkey AS parcel_id, CASE s_suppkey % {len(_NAMES)} {_DECLARED} END AS declared FROM supplier),
j AS (SELECT c.parcel_id, declared, crop, count(r.days) AS cycles, coalesce(bool_or(r.stays), false) AS stays, count(*) FILTER (days BETWEEN least_ * 0.7 AND most_ * 1.3) AS in_days, count(*) FILTER (days BETWEEN least_ * 0.7 AND most_ * 1.3 AND peak_ndvi >= expected * 0.75) AS consistent
  FROM claim c LEFT JOIN ref ON crop = declared LEFT JOIN row1 r ON r.parcel_id = c.parcel_id GROUP BY 1, 2, 3),
o AS (SELECT *, CASE WHEN crop IS NULL OR stays OR cycles < 1 THEN 'indeterminate' WHEN consistent / CAST(cycles AS DOUBLE) >= 0.5 THEN 'consistent' ELSE 'inconsistent' END AS outcome FROM j)
SELECT parcel_id, declared, outcome, CASE WHEN outcome = 'consistent' THEN round(0.55 * consistent / cycles, 3) ELSE 0 END AS confidence, cycles, in_days, consistent, CASE WHEN declared = '' THEN 'none declared' WHEN crop IS NULL THEN 'no reference' WHEN stays THEN 'perennial' WHEN cycles < 1 THEN 'too few cycles' END AS reason FROM o""")
def verify_crop(spark, sf_dir):
    """Declared crops against the cycles that were seen."""
    k = F.col("s_suppkey")
    claims = table(spark, sf_dir, "supplier").select(k.alias("parcel_id"), F.get(F.array(*map(F.lit, _NAMES)), (k % len(_NAMES)).cast("int")).alias("declared"))
    seen = cc.cycles(looks(spark, sf_dir), RULES).select("parcel_id", "kind", "days", "peak_ndvi")
    return monitor.verified(claims, seen)


def _daily_means(rows: DataFrame) -> DataFrame:
    return rows.where("ndvi IS NOT NULL").groupBy("parcel_id", "day").agg(F.round(F.avg("ndvi"), 9).alias("ndvi"), F.count(F.lit(1)).alias("looks"))


@query(f"""WITH {LOOKS} SELECT parcel_id, day, round(avg(ndvi), 9) AS ndvi, count(*) AS looks, CASE WHEN day <= DATE '1996-06-30' THEN 'reused' ELSE 'computed' END AS origin FROM lk WHERE ndvi IS NOT NULL GROUP BY 1, 2""")
def reused_days(spark, sf_dir):
    """Daily means where days up to a cut are read from the table that an earlier run stored, by month, and only later ones
    are computed from looks."""
    through = "1996-06-30"
    rows = looks(spark, sf_dir)
    place = f"{shared_dir(spark)}/final-days-{spark.sparkContext.applicationId}-{zlib.crc32(sf_dir.encode())}"
    earlier = _daily_means(rows.where(F.col("day") <= F.lit(through).cast("date"))).withColumn("month", F.date_format("day", "yyyy-MM"))
    earlier.write.mode("overwrite").partitionBy("month").parquet(place)  # the run before
    stored = spark.read.parquet(place).drop("month")
    return monitor.continued(stored, _daily_means(rows.where(F.col("day") > F.lit(through).cast("date"))), "day", through)
