"""Queries of fitted curves: crop references on a season's daily series, and a double logistic a crop cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilth.operators import cropcycles as cc
from tilth.operators import curves
from tilth.operators.graph import written
from tilth.plans.base import query
from tilth.plans.cropcycles import LOOKS, RULES, looks

#: The season's first day, its days until today, and the days near enough to a look to count.
FIRST, DAYS, NEAR = "1995-05-01", 184, 5
HOW = curves.Fitting(0, 106)
NAMES = [c.crop for c in curves.REFERENCES]


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field_id, day (from the first), z, support: a straight line between the looks of the season, supported near them."""
    seen = looks(spark, sf_dir).where("ndvi IS NOT NULL").withColumn("d", F.datediff("day", F.lit(FIRST).cast("date"))).where(F.col("d").between(-NEAR, DAYS - 1 + NEAR))
    seen = seen.groupBy(F.col("parcel_id").alias("field_id"), "d").agg(F.avg("ndvi").alias("y"))
    every = seen.select("field_id").distinct().withColumn("d", F.explode(F.sequence(F.lit(-NEAR), F.lit(DAYS - 1 + NEAR))))
    by, back = Window.partitionBy("field_id").orderBy("d"), Window.partitionBy("field_id").orderBy(F.desc("d"))
    side = F.when(F.col("y").isNotNull(), F.struct("d", "y"))
    rows = every.join(seen, ["field_id", "d"], "left").withColumns(
        {"a": F.last(side, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)), "b": F.last(side, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))}
    )
    line = F.when(F.col("a.d") == F.col("b.d"), F.col("a.y")).otherwise(F.col("a.y") + (F.col("b.y") - F.col("a.y")) * (F.col("d") - F.col("a.d")) / (F.col("b.d") - F.col("a.d")))
    near = F.coalesce(F.col("d") - F.col("a.d") <= NEAR, F.lit(False)) | F.coalesce(F.col("b.d") - F.col("d") <= NEAR, F.lit(False))
    kept = rows.where(F.col("d").between(0, DAYS - 1))
    return kept.select("field_id", "d", F.coalesce(line, "a.y", "b.y").alias("z"), near.cast("double").alias("support"))


def _fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = daily(spark, sf_dir).groupBy("field_id").agg(F.sort_array(F.collect_list(F.struct("d", "z", "support"))).alias("s"))
    return curves.fit_references(arrays.select("field_id", F.col("s.z").alias("z"), F.col("s.support").alias("support")), HOW)


_CURVES = ", ".join(f"('{c.crop}', {c.rise_at}, {c.rise}, {c.fall_at}, {c.fall}, {c.peak}, {c.base}, {str(c.stays).lower()}, {c.peak_age})" for c in curves.REFERENCES)
FITS = f"""{LOOKS},
seen AS (SELECT parcel_id AS field_id, CAST(day - DATE '{FIRST}' AS INTEGER) AS d, avg(ndvi) AS y FROM lk WHERE ndvi IS NOT NULL AND day - DATE '{FIRST}' BETWEEN {-NEAR} AND {DAYS - 1 + NEAR} GROUP BY 1, 2),
every AS (SELECT field_id, CAST(unnest(range({-NEAR}, {DAYS + NEAR})) AS INTEGER) AS d FROM (SELECT DISTINCT field_id FROM seen)),
sides AS (
  SELECT e.field_id, e.d, last_value(y IGNORE NULLS) OVER p AS y0, last_value(CASE WHEN y IS NOT NULL THEN e.d END IGNORE NULLS) OVER p AS d0, first_value(y IGNORE NULLS) OVER q AS y1, first_value(CASE WHEN y IS NOT NULL THEN e.d END IGNORE NULLS) OVER q AS d1
  FROM every e LEFT JOIN seen s ON s.field_id = e.field_id AND s.d = e.d
  WINDOW p AS (PARTITION BY e.field_id ORDER BY e.d ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY e.field_id ORDER BY e.d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
zs AS (
  SELECT field_id, d, coalesce(CASE WHEN d0 = d1 THEN y0 ELSE y0 + (y1 - y0) * (d - d0) / (d1 - d0) END, y0, y1) AS z, coalesce(d - d0 <= {NEAR}, false) OR coalesce(d1 - d <= {NEAR}, false) AS near FROM sides WHERE d BETWEEN 0 AND {DAYS - 1}),
ref(crop, rise_at, rise, fall_at, fall, peak, base, stays, peak_age) AS (VALUES {_CURVES}),
pair AS (SELECT CAST(a.s AS INTEGER) AS s, b.t FROM range({HOW.sow_from}, {HOW.sow_to + 1}, {HOW.step}) a(s), (SELECT unnest([{', '.join(f'CAST({t} AS DOUBLE)' for t in HOW.stretches)}]) AS t) b),
ages AS (SELECT crop, s, t, CAST(d AS INTEGER) AS d, CAST(base AS DOUBLE) AS base, CAST(peak AS DOUBLE) AS peak, stays, CAST(rise AS DOUBLE) AS rise, CAST(fall AS DOUBLE) AS fall, CAST(rise_at AS DOUBLE) AS rise_at, CAST(fall_at AS DOUBLE) AS fall_at, (d - s) / t AS age FROM ref, pair, range(0, {DAYS}) x(d)),
cur AS (
  SELECT crop, s, t, d, CASE WHEN age < 0 THEN base ELSE base + (peak - base) * (1 / (1 + exp(-rise * (age - rise_at))) - CASE WHEN stays THEN 0 ELSE 1 / (1 + exp(least(500, -fall * (age - fall_at)))) END) END AS r, age BETWEEN rise_at - 20 AND rise_at + 10 AS rising FROM ages),
sums AS (
  SELECT field_id, crop, s, t, count(*) AS n, avg(r) AS mr, avg(z) AS mz, covar_pop(z, r) AS cov, var_pop(r) AS var, var_pop(z) AS left_ FROM zs JOIN cur USING (d) WHERE near GROUP BY 1, 2, 3, 4),
scaled AS (SELECT *, CASE WHEN var * n > 1e-9 THEN greatest(0, cov / var) ELSE 0 END AS b FROM sums WHERE n >= {HOW.least_days}),
errors AS (SELECT *, round(sqrt(greatest(0, left_ - 2 * b * cov + b * b * var)), {HOW.digits}) AS rmse FROM scaled WHERE b BETWEEN {HOW.least_scale} AND {HOW.most_scale}),
fit AS (SELECT *, mz - b * mr AS offset_ FROM errors QUALIFY row_number() OVER (PARTITION BY field_id, crop ORDER BY rmse, s, t) = 1)"""


@query(f"""WITH {FITS},
up AS (SELECT f.field_id, f.crop, avg(near::INT) AS support FROM fit f JOIN cur c ON c.crop = f.crop AND c.s = f.s AND c.t = f.t AND rising JOIN zs ON zs.field_id = f.field_id AND zs.d = c.d GROUP BY 1, 2)
SELECT f.field_id, f.crop, DATE '{FIRST}' + s AS sowing, t AS stretch, rmse AS rmse, round(b, 6) AS scale, round(offset_, 6) AS offset_level, n AS n_days, CASE WHEN crop = 'Sugarcane' THEN 0 ELSE round(coalesce(support, 0), 8) END AS rise_support FROM fit f LEFT JOIN up USING (field_id, crop)""")
def reference_fits(spark, sf_dir):
    """Each crop's reference curve on each field's season: the sowing day and stretch that fit best, level and amplitude."""
    f = _fits(spark, sf_dir)
    sowing = F.date_add(F.lit(FIRST).cast("date"), F.col("sow").cast("int"))
    return f.select("field_id", "crop", sowing.alias("sowing"), "stretch", "rmse", F.round("scale", 6).alias("scale"), F.round("offset", 6).alias("offset_level"), "n_days", F.round("rise_support", 8).alias("rise_support"))


_CLAIM = " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(NAMES))


@query(f"""WITH {FITS}, claim AS (SELECT DISTINCT field_id, CASE field_id % {len(NAMES)} {_CLAIM} END AS claimed FROM zs),
j AS (
  SELECT c.field_id, claimed, o.rmse AS own_rmse, o.s AS own_sow, r.peak_age AS own_peak, (SELECT arg_min({{'crop': a.crop, 'rmse': a.rmse, 'peak_age': ra.peak_age}}, (a.rmse, a.crop)) FROM fit a JOIN ref ra ON ra.crop = a.crop WHERE a.field_id = c.field_id AND a.crop <> c.claimed) AS alt
  FROM claim c LEFT JOIN fit o ON o.field_id = c.field_id AND o.crop = c.claimed JOIN ref r ON r.crop = c.claimed),
k AS (SELECT *, own_rmse IS NOT NULL AND alt IS NOT NULL AS able, {DAYS - 1} - own_sow AS elapsed, least(own_peak, alt.peak_age) + 25 AS after_ FROM j)
SELECT field_id, claimed, able AND elapsed >= after_ AS checked, CASE WHEN able THEN alt.crop END AS alternative, own_rmse AS own_rmse, CASE WHEN able THEN alt.rmse END AS alternative_rmse, CASE WHEN able THEN elapsed END AS days_since_sowing, CASE WHEN able THEN after_ END AS decisive_after,
  able AND elapsed >= after_ AND alt.rmse < 0.7 * own_rmse AND own_rmse - alt.rmse > 0.015 AS disagrees, CASE WHEN own_rmse IS NULL THEN 'no fit' WHEN alt IS NULL THEN 'no alternative' WHEN elapsed < after_ THEN 'too early' END AS reason FROM k""")
def crop_check(spark, sf_dir):
    """Claimed crops against the next best reference, once the season can tell them apart."""
    fits = written(_fits(spark, sf_dir))
    claims = daily(spark, sf_dir).select("field_id").distinct().withColumn("claimed", F.get(F.array(*map(F.lit, NAMES)), (F.col("field_id") % len(NAMES)).cast("int")))
    return curves.crop_check(fits, claims, DAYS - 1)


_SHORT = max(c.peak_age for c in curves.REFERENCES if c.crop in curves.GROUPS["short_season_kharif"])
_IN = "(" + ", ".join(f"'{c}'" for c in curves.GROUPS["short_season_kharif"]) + ")"


@query(f"""WITH {FITS}, g AS (SELECT *, CASE WHEN crop IN {_IN} THEN 'short_season_kharif' ELSE 'long_season_kharif' END AS grp FROM fit),
b AS (SELECT field_id, grp, min(rmse) AS rmse, arg_min(crop, (rmse, crop)) AS curve, arg_min(s, (rmse, crop)) AS s FROM g GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY rmse, grp) AS k, lead(rmse) OVER (PARTITION BY field_id ORDER BY rmse, grp) AS next_rmse FROM b),
t AS (SELECT *, CASE WHEN {DAYS - 1} - s < {_SHORT + 25} THEN 'too_early' WHEN next_rmse IS NULL OR rmse < 0.75 * next_rmse AND next_rmse - rmse > greatest(0.008, 0.5 * rmse) THEN 'decided' ELSE 'ambiguous' END AS status FROM r WHERE k = 1)
SELECT field_id, status, CASE WHEN status = 'decided' THEN grp END AS crop_group, grp AS best_group, curve AS best_curve, rmse AS best_rmse, next_rmse AS next_rmse, {DAYS - 1} - s AS days_since_sowing,
  (SELECT string_agg(crop, ',' ORDER BY g.rmse, crop) FROM g WHERE g.field_id = t.field_id AND g.grp = t.grp AND g.rmse <= t.rmse * 1.35 + 0.005) AS candidates FROM t""")
def crop_groups(spark, sf_dir):
    """Short or long season, where crops within a group can't be told apart."""
    return curves.crop_group(_fits(spark, sf_dir), DAYS - 1)


@query()
def cycle_phenology(spark, sf_dir):
    """Crop cycles with a double logistic fitted to each; its dates are taken where they agree with those walked to."""
    return curves.refined(cc.cycles(looks(spark, sf_dir), RULES))
