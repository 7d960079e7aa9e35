"""Queries over observation series, cycles and daily weather."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilth.functions.agronomy import risk_band
from tilth.operators import evaluation, series
from tilth.plans.base import ANCHOR, CYCLES, OBS, WEATHER, cycles, observations, query, weather

DAYS = 3
GRID = f"""{OBS},
last AS (SELECT parcel_id, max((day - DATE '{ANCHOR}') // {DAYS}) AS last FROM obs GROUP BY parcel_id),
grid AS (SELECT parcel_id, CAST(unnest(range(0, last + 1)) AS INTEGER) AS bin FROM last),
ranked AS (SELECT *, CAST((day - DATE '{ANCHOR}') // {DAYS} AS INTEGER) AS bin, row_number() OVER (PARTITION BY parcel_id, (day - DATE '{ANCHOR}') // {DAYS} ORDER BY signal IS NULL, cloud ASC NULLS LAST, obs_id) AS r FROM obs),
best AS (
  SELECT g.parcel_id, g.bin, DATE '{ANCHOR}' + g.bin * {DAYS} AS bin_start, b.obs_id, b.sensor, b.cloud, b.signal, b.signal IS NULL AS missing
  FROM grid g LEFT JOIN (SELECT * FROM ranked WHERE r = 1) b ON b.parcel_id = g.parcel_id AND b.bin = g.bin)"""


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.best_in_bin(observations(spark, sf_dir), ["parcel_id"], "day", DAYS, ANCHOR, "signal", "cloud", "obs_id")


@query(f"WITH {GRID} SELECT parcel_id, bin, CAST(bin_start AS DATE) AS bin_start, obs_id, sensor, cloud, round(signal, 9) AS signal, missing FROM best")
def tumbling_grid_best(spark, sf_dir):
    return best(spark, sf_dir).withColumn("signal", F.round("signal", 9)).select("parcel_id", "bin", "bin_start", "obs_id", "sensor", "cloud", "signal", "missing")


@query(f"""WITH {GRID}, island AS (
  SELECT parcel_id, bin, row_number() OVER (PARTITION BY parcel_id ORDER BY bin) - sum(CAST(missing AS INT)) OVER (PARTITION BY parcel_id ORDER BY bin) AS i, missing FROM best)
SELECT parcel_id, min(bin) AS run_start, max(bin) AS run_end, count(*) AS run_length FROM island WHERE missing GROUP BY parcel_id, i""")
def missing_runs(spark, sf_dir):
    return series.runs(best(spark, sf_dir), ["parcel_id"], "bin", F.col("missing"))


@query(f"""WITH {GRID}, island AS (
  SELECT parcel_id, bin, row_number() OVER (PARTITION BY parcel_id ORDER BY bin) - sum(CAST(missing AS INT)) OVER (PARTITION BY parcel_id ORDER BY bin) AS i, missing FROM best),
runs AS (SELECT parcel_id, count(*) AS n FROM island WHERE missing GROUP BY parcel_id, i)
SELECT p.parcel_id, coalesce(max(n), 0) AS longest_run FROM (SELECT DISTINCT parcel_id FROM best) p LEFT JOIN runs r USING (parcel_id) GROUP BY p.parcel_id""")
def longest_missing_run(spark, sf_dir):
    grid = best(spark, sf_dir)
    longest = series.runs(grid, ["parcel_id"], "bin", F.col("missing")).groupBy("parcel_id").agg(F.max("run_length").alias("longest_run"))
    return grid.select("parcel_id").distinct().join(longest, "parcel_id", "left").na.fill(0, ["longest_run"])


@query(f"""WITH {OBS}, d AS (SELECT DISTINCT parcel_id, day FROM obs), g AS (SELECT parcel_id, lag(day) OVER (PARTITION BY parcel_id ORDER BY day) AS gap_start, day AS gap_end FROM d)
SELECT parcel_id, gap_start, gap_end, CAST(gap_end - gap_start AS INTEGER) AS gap_days FROM g WHERE gap_end - gap_start >= 3""")
def observation_gaps(spark, sf_dir):
    return series.gaps(observations(spark, sf_dir), ["parcel_id"], "day", 3)


@query(f"""WITH {GRID} SELECT parcel_id, bin,
  round(sum(signal) OVER (PARTITION BY parcel_id ORDER BY bin ROWS 2 PRECEDING), 9) AS rolling_any,
  round(CASE WHEN count(signal) OVER (PARTITION BY parcel_id ORDER BY bin ROWS 2 PRECEDING) >= 3 THEN sum(signal) OVER (PARTITION BY parcel_id ORDER BY bin ROWS 2 PRECEDING) END, 9) AS rolling_full FROM best""")
def rolling_three(spark, sf_dir):
    s = F.col("signal")
    return best(spark, sf_dir).select("parcel_id", "bin", F.round(series.rolling(s, ["parcel_id"], "bin", 3), 9).alias("rolling_any"), F.round(series.rolling(s, ["parcel_id"], "bin", 3, 3), 9).alias("rolling_full"))


_TRI_TOP = " + ".join(f"coalesce({'lag' if k < 0 else 'lead'}(signal, {abs(k)}) OVER w * {4 - abs(k)}, 0)" if k else "coalesce(signal * 4, 0)" for k in range(-3, 4))
_TRI_LOW = " + ".join(f"CASE WHEN {'lag' if k < 0 else 'lead'}(signal, {abs(k)}) OVER w IS NULL THEN 0 ELSE {4 - abs(k)} END" if k else "CASE WHEN signal IS NULL THEN 0 ELSE 4 END" for k in range(-3, 4))


@query(f"WITH {GRID} SELECT parcel_id, bin, round(({_TRI_TOP}) / nullif({_TRI_LOW}, 0), 9) AS smoothed FROM best WINDOW w AS (PARTITION BY parcel_id ORDER BY bin)")
def triangular_smoothing(spark, sf_dir):
    return best(spark, sf_dir).select("parcel_id", "bin", F.round(series.triangular(F.col("signal"), ["parcel_id"], "bin"), 9).alias("smoothed"))


_BRACKET = """SELECT *, last_value(CASE WHEN signal IS NOT NULL THEN bin END IGNORE NULLS) OVER b AS x0, first_value(CASE WHEN signal IS NOT NULL THEN bin END IGNORE NULLS) OVER a AS x1,
  last_value(signal IGNORE NULLS) OVER b AS y0, first_value(signal IGNORE NULLS) OVER a AS y1 FROM best
  WINDOW b AS (PARTITION BY parcel_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY parcel_id ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""


@query(f"WITH {GRID}, k AS ({_BRACKET}) SELECT parcel_id, bin, round(coalesce(signal, CASE WHEN x1 - x0 <= 3 THEN y0 + (y1 - y0) * (CAST(bin - x0 AS DOUBLE) / nullif(x1 - x0, 0)) END), 9) AS filled FROM k")
def short_gap_fill(spark, sf_dir):
    return best(spark, sf_dir).select("parcel_id", "bin", F.round(series.bracketed(F.col("signal"), ["parcel_id"], "bin", 3), 9).alias("filled"))


@query(f"""WITH {OBS}, d AS (SELECT parcel_id, day, avg(signal) AS s FROM obs WHERE signal IS NOT NULL GROUP BY 1, 2),
t AS (SELECT parcel_id, (s + lag(s) OVER w) / 2 * (day - lag(day) OVER w) AS p FROM d WINDOW w AS (PARTITION BY parcel_id ORDER BY day))
SELECT parcel_id, round(sum(p), 6) AS integral FROM t GROUP BY parcel_id""")
def trapezoid_integral(spark, sf_dir):
    daily = observations(spark, sf_dir).where("signal IS NOT NULL").groupBy("parcel_id", "day").agg(F.avg("signal").alias("s"))
    return series.trapezoid(daily, ["parcel_id"], "day", "s").withColumn("integral", F.round("integral", 6))


@query(f"""WITH {GRID}, k AS (SELECT parcel_id, bin, signal, max(signal) OVER (PARTITION BY parcel_id ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS around,
  greatest(signal - min(signal) OVER (PARTITION BY parcel_id ORDER BY bin ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), signal - min(signal) OVER (PARTITION BY parcel_id ORDER BY bin ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) AS peak_drop FROM best)
SELECT parcel_id, bin, round(signal, 9) AS signal, round(peak_drop, 9) AS peak_drop FROM k WHERE signal >= around - 0.005 AND signal >= 0.3 AND peak_drop >= 0.1""")
def signal_peaks(spark, sf_dir):
    found = series.peaks(best(spark, sf_dir), ["parcel_id"], "bin", "signal", 2, 0.3, 0.1)
    return found.select("parcel_id", "bin", F.round("signal", 9).alias("signal"), F.round("peak_drop", 9).alias("peak_drop"))


_MERGED = f"""{CYCLES}, f AS (SELECT parcel_id, sown, harvested, max(harvested) OVER (PARTITION BY parcel_id ORDER BY sown, harvested ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cycles),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR sown > reach THEN 1 ELSE 0 END) OVER (PARTITION BY parcel_id ORDER BY sown, harvested ROWS UNBOUNDED PRECEDING) AS island FROM f),
merged AS (SELECT parcel_id, min(sown) AS sown, max(harvested) AS harvested FROM i GROUP BY parcel_id, island)"""


@query(f"WITH {_MERGED} SELECT parcel_id, sown, harvested FROM merged")
def interval_union(spark, sf_dir):
    return series.merged_intervals(cycles(spark, sf_dir).select("parcel_id", "sown", "harvested"), ["parcel_id"], "sown", "harvested")


@query(f"""WITH {_MERGED}, s AS (SELECT parcel_id, min(sown) AS a, max(harvested) AS b, CAST(sum(harvested - sown) AS BIGINT) AS occupied FROM merged GROUP BY parcel_id)
SELECT parcel_id, occupied, round(occupied / CAST(nullif(b - a, 0) AS DOUBLE), 9) AS utilisation, round(1 - occupied / CAST(nullif(b - a, 0) AS DOUBLE), 9) AS fallow FROM s""")
def occupied_days(spark, sf_dir):
    merged = series.merged_intervals(cycles(spark, sf_dir).select("parcel_id", "sown", "harvested"), ["parcel_id"], "sown", "harvested")
    by = merged.groupBy("parcel_id").agg(F.datediff(F.max("harvested"), F.min("sown")).alias("span"), F.sum(F.datediff("harvested", "sown")).alias("occupied"))
    share = F.try_divide(F.col("occupied").cast("double"), F.col("span").cast("double"))
    return by.select("parcel_id", "occupied", F.round(share, 9).alias("utilisation"), F.round(1 - share, 9).alias("fallow"))


@query(f"""WITH {_MERGED}, n AS (SELECT parcel_id, harvested AS fallow_start, lead(sown) OVER (PARTITION BY parcel_id ORDER BY sown) AS fallow_end FROM merged)
SELECT parcel_id, fallow_start, fallow_end, CAST(fallow_end - fallow_start AS INTEGER) AS days FROM n WHERE fallow_end > fallow_start""")
def fallow_between(spark, sf_dir):
    merged = series.merged_intervals(cycles(spark, sf_dir).select("parcel_id", "sown", "harvested"), ["parcel_id"], "sown", "harvested")
    nxt = F.lead("sown").over(Window.partitionBy("parcel_id").orderBy("sown"))
    return merged.select("parcel_id", F.col("harvested").alias("fallow_start"), nxt.alias("fallow_end")).where("fallow_end > fallow_start").withColumn("days", F.datediff("fallow_end", "fallow_start"))


@query(f"""WITH {WEATHER}, c AS (SELECT cell, dayofyear(day) AS doy, avg(rain) AS normal, count(*) AS years FROM weather GROUP BY 1, 2)
SELECT w.cell, w.day, w.rain, round(c.normal, 10) AS normal, round(w.rain - c.normal, 10) AS anomaly, c.years FROM weather w JOIN c ON c.cell = w.cell AND c.doy = dayofyear(w.day)""")
def day_of_year_climatology(spark, sf_dir):
    w = weather(spark, sf_dir).withColumn("doy", F.dayofyear("day"))
    own = Window.partitionBy("cell", "doy")
    normal = F.avg("rain").over(own)
    return w.select("cell", "day", "rain", F.round(normal, 10).alias("normal"), F.round(F.col("rain") - normal, 10).alias("anomaly"), F.count(F.lit(1)).over(own).alias("years"))


@query(f"""WITH {WEATHER}, r AS (SELECT cell, day, sum(rain) OVER (PARTITION BY cell ORDER BY day ROWS 2 PRECEDING) AS r3 FROM weather WHERE month(day) IN (6, 7)),
o AS (SELECT cell, year(day) AS year, min(day) AS onset FROM r WHERE r3 >= 20 GROUP BY 1, 2)
SELECT cell, CAST(year AS INTEGER) AS year, onset, CAST(dayofyear(onset) - 160 AS INTEGER) AS late_days FROM o""")
def monsoon_onset(spark, sf_dir):
    days = weather(spark, sf_dir).where(F.month("day").isin(6, 7))
    rained = days.withColumn("r3", series.rolling(F.col("rain"), ["cell"], "day", 3))
    onset = rained.where("r3 >= 20").groupBy("cell", F.year("day").alias("year")).agg(F.min("day").alias("onset"))
    return onset.withColumn("late_days", F.dayofyear("onset") - 160)


@query(f"""WITH {WEATHER}, d AS (SELECT cell, day, rain < 5 AS dry, row_number() OVER (PARTITION BY cell ORDER BY day) - sum(CAST(rain < 5 AS INT)) OVER (PARTITION BY cell ORDER BY day) AS i FROM weather),
r AS (SELECT cell, min(day) AS spell_start, count(*) AS spell FROM d WHERE dry GROUP BY cell, i)
SELECT cell, max(spell) AS longest, count(*) AS spells FROM r GROUP BY cell""")
def dry_spells(spark, sf_dir):
    found = series.runs(weather(spark, sf_dir), ["cell"], "day", F.col("rain") < 5)
    return found.groupBy("cell").agg(F.max("run_length").alias("longest"), F.count(F.lit(1)).alias("spells"))


@query(f"""WITH {WEATHER}, m AS (SELECT cell, year(day) AS year, sum(rain) AS total FROM weather GROUP BY 1, 2),
z AS (SELECT *, avg(total) OVER w AS mean, stddev_pop(total) OVER w AS sd, count(*) OVER w AS n FROM m WINDOW w AS (PARTITION BY cell))
SELECT cell, CAST(year AS INTEGER) AS year, round(total, 7) AS total, CASE WHEN n >= 3 AND sd > 0 THEN round((total - mean) / sd, 8) END AS index FROM z""")
def standardised_rain(spark, sf_dir):
    yearly = weather(spark, sf_dir).groupBy("cell", F.year("day").alias("year")).agg(F.sum("rain").alias("total"))
    own = Window.partitionBy("cell")
    z = F.when((F.count(F.lit(1)).over(own) >= 3) & (F.stddev_pop("total").over(own) > 0), F.round(F.try_divide(F.col("total") - F.avg("total").over(own), F.stddev_pop("total").over(own)), 8))
    return yearly.select("cell", "year", F.round("total", 7).alias("total"), z.alias("index"))


@query(f"""WITH {OBS}, d AS (SELECT parcel_id, day, avg(signal) AS s, count(signal) AS n FROM obs GROUP BY 1, 2),
q AS (SELECT parcel_id, quantile_cont(s, 0.25) AS q1, quantile_cont(s, 0.75) AS q3 FROM d GROUP BY 1)
SELECT d.parcel_id, d.day, round(d.s, 9) AS signal FROM d JOIN q USING (parcel_id) WHERE d.s < q1 - 2 * greatest(q3 - q1, 0.05)""")
def low_outliers(spark, sf_dir):
    daily = observations(spark, sf_dir).groupBy("parcel_id", "day").agg(F.avg("signal").alias("s"))
    q = daily.groupBy("parcel_id").agg(F.percentile("s", F.lit(0.25)).alias("q1"), F.percentile("s", F.lit(0.75)).alias("q3"))
    return daily.join(q, "parcel_id").where(F.col("s") < F.col("q1") - 2 * F.greatest(F.col("q3") - F.col("q1"), F.lit(0.05))).select("parcel_id", "day", F.round("s", 9).alias("signal"))


@query(f"""WITH {OBS} SELECT sensor, day, count(*) AS pixels, count(signal) AS clear, round(avg(signal), 9) AS mean_signal, round(10 * log10(avg(power(10.0, signal / 10.0))), 9) AS db_mean FROM obs GROUP BY 1, 2""")
def zone_means(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("sensor", "day").agg(F.count(F.lit(1)).alias("pixels"), F.count("signal").alias("clear"), F.round(F.avg("signal"), 9).alias("mean_signal"), F.round(10 * F.log10(F.avg(F.pow(F.lit(10.0), F.col("signal") / 10))), 9).alias("db_mean"))


@query(f"""WITH {OBS}, p AS (SELECT parcel_id, day, sum(signal) AS s FROM obs GROUP BY 1, 2), c AS (SELECT parcel_id, day, sum(s) OVER (PARTITION BY parcel_id ORDER BY day) / sum(s) OVER (PARTITION BY parcel_id) AS share FROM p)
SELECT parcel_id, min(CASE WHEN share >= 0.1 THEN day END) AS p10, min(CASE WHEN share >= 0.5 THEN day END) AS p50, min(CASE WHEN share >= 0.9 THEN day END) AS p90 FROM c GROUP BY 1""")
def cumulative_quantiles(spark, sf_dir):
    daily = observations(spark, sf_dir).groupBy("parcel_id", "day").agg(F.sum("signal").alias("s"))
    share = F.sum("s").over(Window.partitionBy("parcel_id").orderBy("day")) / F.sum("s").over(Window.partitionBy("parcel_id"))
    return daily.withColumn("share", share).groupBy("parcel_id").agg(*[F.min(F.when(F.col("share") >= q, F.col("day"))).alias(f"p{round(100 * q)}") for q in (0.1, 0.5, 0.9)])


_SUMMARY = f"""{GRID}, island AS (
  SELECT parcel_id, bin, row_number() OVER (PARTITION BY parcel_id ORDER BY bin) - sum(CAST(missing AS INT)) OVER (PARTITION BY parcel_id ORDER BY bin) AS i, missing FROM best),
runs AS (SELECT parcel_id, count(*) AS n FROM island WHERE missing GROUP BY parcel_id, i),
longest AS (SELECT parcel_id, max(n) AS longest FROM runs GROUP BY parcel_id),
summary AS (SELECT b.parcel_id, count(*) AS bins, count(signal) AS observed, avg(signal) AS mean_signal, coalesce(max(l.longest), 0) AS longest FROM best b LEFT JOIN longest l USING (parcel_id) GROUP BY b.parcel_id),
scored AS (SELECT *, 100 * cume_dist() OVER (ORDER BY mean_signal) * (CASE WHEN longest > 3 THEN 0.85 ELSE 1 END) AS index FROM summary WHERE mean_signal IS NOT NULL),
banded AS (SELECT *, CASE WHEN index >= 70 THEN 'LOW' WHEN index >= 50 THEN 'MEDIUM' WHEN index >= 30 THEN 'HIGH' ELSE 'VERY_HIGH' END AS risk FROM scored)"""


@query(f"WITH {_SUMMARY} SELECT risk, count(*) AS parcels, round(avg(index), 6) AS mean_index, round(avg(mean_signal), 9) AS mean_signal, CAST(sum(bins) AS BIGINT) AS bins, CAST(sum(observed) AS BIGINT) AS observed, max(longest) AS longest FROM banded GROUP BY risk")
def portfolio_by_risk(spark, sf_dir):
    """Flagship: observations to a grid of best values, runs of missing bins, the parcel's place among all parcels, risk
    bands and their table. The rank goes by ranges of the mean, so no task holds all parcels."""
    grid = best(spark, sf_dir)
    longest = series.runs(grid, ["parcel_id"], "bin", F.col("missing")).groupBy("parcel_id").agg(F.max("run_length").alias("longest"))
    summary = grid.groupBy("parcel_id").agg(F.count(F.lit(1)).alias("bins"), F.count("signal").alias("observed"), F.avg("signal").alias("mean_signal")).join(longest, "parcel_id", "left").na.fill(0, ["longest"])
    ranked = evaluation.cumulative_share(summary.where("mean_signal IS NOT NULL"), "mean_signal", "place")
    scored = ranked.withColumn("index", 100 * F.col("place") * F.when(F.col("longest") > 3, 0.85).otherwise(1.0)).withColumn("risk", risk_band(F.col("index")))
    return scored.groupBy("risk").agg(F.count(F.lit(1)).alias("parcels"), F.round(F.avg("index"), 6).alias("mean_index"), F.round(F.avg("mean_signal"), 9).alias("mean_signal"), F.sum("bins").alias("bins"), F.sum("observed").alias("observed"), F.max("longest").alias("longest"))


@query(f"WITH {OBS} SELECT parcel_id, sensor, day, obs_id, cloud, round(signal, 9) AS signal FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id, day ORDER BY signal IS NULL, cloud NULLS LAST, obs_id) AS r FROM obs) WHERE r = 1")
def best_scene_a_day(spark, sf_dir):
    one = series.latest(observations(spark, sf_dir), ["parcel_id", "day"], F.col("signal").isNull(), F.col("cloud").asc_nulls_last(), F.col("obs_id"))
    return one.select("parcel_id", "sensor", "day", "obs_id", "cloud", F.round("signal", 9).alias("signal"))


@query(f"""WITH {OBS}, g AS (SELECT parcel_id, day, signal, row_number() OVER (PARTITION BY parcel_id ORDER BY day, obs_id) - 1 AS k, count(*) OVER (PARTITION BY parcel_id) AS n FROM obs WHERE signal IS NOT NULL)
SELECT parcel_id, CAST(least(k // greatest(n // 3, 1), 2) AS INTEGER) AS third, count(*) AS n, round(avg(signal), 9) AS mean_signal, round(max(signal), 9) AS max_signal FROM g GROUP BY 1, 2""")
def thirds(spark, sf_dir):
    own = Window.partitionBy("parcel_id")
    k = F.row_number().over(own.orderBy("day", "obs_id")) - 1
    numbered = observations(spark, sf_dir).where("signal IS NOT NULL").withColumns({"k": k, "n": F.count(F.lit(1)).over(own)})
    third = F.least(F.floor(F.col("k") / F.greatest(F.floor(F.col("n") / 3), F.lit(1))), F.lit(2)).cast("int")
    return numbered.groupBy("parcel_id", third.alias("third")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("signal"), 9).alias("mean_signal"), F.round(F.max("signal"), 9).alias("max_signal"))


@query(f"""WITH {OBS}, d AS (SELECT parcel_id, day, signal < 0.2 AS bad, lag(signal < 0.2) OVER (PARTITION BY parcel_id ORDER BY day, obs_id) AS before FROM obs WHERE signal IS NOT NULL)
SELECT parcel_id, count(*) FILTER (bad) AS bad, count(*) FILTER (bad AND before) AS confirmed FROM d GROUP BY 1""")
def persistence(spark, sf_dir):
    scored = observations(spark, sf_dir).where("signal IS NOT NULL").withColumn("bad", F.col("signal") < 0.2)
    before = F.lag("bad").over(Window.partitionBy("parcel_id").orderBy("day", "obs_id"))
    return scored.withColumn("before", before).groupBy("parcel_id").agg(F.count_if("bad").alias("bad"), F.count_if(F.col("bad") & F.col("before")).alias("confirmed"))


@query(f"""WITH {OBS} SELECT parcel_id, CAST((day - DATE '{ANCHOR}') // 10 AS INTEGER) AS period, count(signal) AS n, round(median(signal), 9) AS median_signal FROM obs GROUP BY 1, 2""")
def period_composite(spark, sf_dir):
    period = F.floor(F.datediff("day", F.lit(ANCHOR).cast("date")) / 10).cast("int")
    return observations(spark, sf_dir).groupBy("parcel_id", period.alias("period")).agg(F.count("signal").alias("n"), F.round(F.median("signal"), 9).alias("median_signal"))
