"""Queries of aggregations: portfolios, cohorts, drift, roll-ups, references, holder-level indices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tilth.functions.agronomy import risk_band
from tilth.operators import series
from tilth.plans.base import CYCLES, OBS, cycles, observations, query, table

_ASSESS = """a AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus, o_totalprice / 5000.5 AS index, o_totalprice / 10000 AS area, c_nationkey, c_mktsegment, n_name, r_name,
  CASE WHEN o_totalprice / 5000.5 >= 70 THEN 'LOW' WHEN o_totalprice / 5000.5 >= 50 THEN 'MEDIUM' WHEN o_totalprice / 5000.5 >= 30 THEN 'HIGH' ELSE 'VERY_HIGH' END AS risk
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def assessments(spark, sf_dir):
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    index = F.col("o_totalprice") / 5000.5
    return joined.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", index.alias("index"), (F.col("o_totalprice") / 10000).alias("area"), "c_nationkey", "c_mktsegment", "n_name", "r_name", risk_band(index).alias("risk"))


@query(f"WITH {_ASSESS} SELECT risk, count(*) AS n, round(avg(index), 6) AS mean_index, round(sum(area), 2) AS area FROM a WHERE r_name = 'ASIA' GROUP BY 1 ORDER BY n DESC")
def portfolio_of_region(spark, sf_dir):
    return assessments(spark, sf_dir).where("r_name = 'ASIA'").groupBy("risk").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("index"), 6).alias("mean_index"), F.round(F.sum("area"), 2).alias("area")).orderBy(F.desc("n"))


@query(f"WITH {_ASSESS} SELECT r_name, n_name, count(*) AS n, round(avg(index), 6) AS mean_index, count(*) FILTER (risk = 'LOW') AS low, count(*) FILTER (risk IN ('HIGH', 'VERY_HIGH')) AS high FROM a GROUP BY 1, 2")
def regional_breakdown(spark, sf_dir):
    return assessments(spark, sf_dir).groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("index"), 6).alias("mean_index"), F.count_if(F.col("risk") == "LOW").alias("low"), F.count_if(F.col("risk").isin("HIGH", "VERY_HIGH")).alias("high"))


@query("""WITH nested AS (SELECT l_orderkey, list({'crop': l_partkey, 'days': l_quantity, 'ok': l_returnflag <> 'R'}) AS seasons FROM lineitem GROUP BY 1), u AS (SELECT unnest(seasons) AS s FROM nested)
SELECT s.crop AS crop, count(*) AS seasons, round(avg(s.days), 6) AS mean_days, max(s.days) AS most_days FROM u WHERE s.ok GROUP BY 1""")
def crop_report(spark, sf_dir):
    """Nested seasons of an assessment, unwound."""
    nested = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("crop"), F.col("l_quantity").alias("days"), (F.col("l_returnflag") != "R").alias("ok"))).alias("seasons"))
    return nested.select(F.explode("seasons").alias("s")).where("s.ok").groupBy(F.col("s.crop").alias("crop")).agg(F.count(F.lit(1)).alias("seasons"), F.round(F.avg("s.days"), 6).alias("mean_days"), F.max("s.days").alias("most_days"))


@query(f"WITH {_ASSESS} SELECT o_orderstatus = 'P' AS affected, count(*) AS n, round(avg(index), 6) AS mean_index, count(DISTINCT o_custkey) AS farmers FROM a GROUP BY 1")
def weather_impact(spark, sf_dir):
    return assessments(spark, sf_dir).groupBy((F.col("o_orderstatus") == "P").alias("affected")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("index"), 6).alias("mean_index"), F.countDistinct("o_custkey").alias("farmers"))


@query(f"WITH {_ASSESS} SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, round(arg_max(index, (o_orderdate, o_orderkey)), 6) AS index FROM a GROUP BY 1")
def latest_per_farmer(spark, sf_dir):
    at = F.struct("o_orderdate", "o_orderkey")
    return assessments(spark, sf_dir).groupBy("o_custkey").agg(F.max_by("o_orderkey", at).alias("o_orderkey"), F.round(F.max_by("index", at), 6).alias("index"))


_COHORT = f"""{_ASSESS}, cohort AS (SELECT n_name || '|' || c_mktsegment AS cohort, count(*) AS n, count(DISTINCT o_custkey) AS farmers, avg(index) AS mean, stddev_pop(index) AS sd,
  quantile_cont(index, 0.05) AS p5, quantile_cont(index, 0.25) AS p25, quantile_cont(index, 0.5) AS p50, quantile_cont(index, 0.75) AS p75, quantile_cont(index, 0.95) AS p95 FROM a GROUP BY 1)"""
_P = (5, 25, 50, 75, 95)


def cohorts(spark, sf_dir):
    key = F.concat_ws("|", "n_name", "c_mktsegment")
    by = assessments(spark, sf_dir).groupBy(key.alias("cohort")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("farmers"), F.avg("index").alias("mean"), F.stddev_pop("index").alias("sd"), F.percentile("index", F.array(*[F.lit(p / 100) for p in _P])).alias("p"))
    return by.select("cohort", "n", "farmers", "mean", "sd", *[F.col("p")[k].alias(f"p{p}") for k, p in enumerate(_P)])


@query(f"WITH {_COHORT} SELECT cohort, n, farmers, round(mean, 6) AS mean, round(sd, 6) AS sd, {', '.join(f'round(p{p}, 6) AS p{p}' for p in _P)} FROM cohort WHERE farmers >= 10")
def agg_cohort(spark, sf_dir):
    return cohorts(spark, sf_dir).where("farmers >= 10").select("cohort", "n", "farmers", *[F.round(c, 6).alias(c) for c in ("mean", "sd", *(f"p{p}" for p in _P))])


@query(f"WITH {_COHORT} SELECT cohort, farmers, 10 - farmers AS needed FROM cohort WHERE farmers < 10 ORDER BY needed, cohort LIMIT 20")
def cohorts_short(spark, sf_dir):
    return cohorts(spark, sf_dir).where("farmers < 10").select("cohort", "farmers", (10 - F.col("farmers")).alias("needed")).orderBy("needed", "cohort").limit(20)


_STEPS = [(5, 25), (25, 50), (50, 75), (75, 95)]


@query(f"""WITH {_COHORT} SELECT o_orderkey, round(CASE WHEN index <= p5 THEN 5 WHEN index >= p95 THEN 95 {' '.join(f'WHEN index <= p{b} AND p{b} > p{a} THEN {a} + {b - a} * (index - p{a}) / nullif(p{b} - p{a}, 0)' for a, b in _STEPS)} ELSE 50 END, 4) AS percentile
FROM a JOIN cohort ON cohort = n_name || '|' || c_mktsegment WHERE farmers >= 10""")
def breakpoint_percentile(spark, sf_dir):
    """Each index on its cohort's stored percentiles, straight lines between."""
    a = assessments(spark, sf_dir).withColumn("cohort", F.concat_ws("|", "n_name", "c_mktsegment"))
    joined = a.join(cohorts(spark, sf_dir).where("farmers >= 10").drop("n"), "cohort")
    i = F.col("index")
    place = F.when(i <= F.col("p5"), 5.0).when(i >= F.col("p95"), 95.0)
    for low, high in _STEPS:
        x0, x1 = F.col(f"p{low}"), F.col(f"p{high}")
        place = place.when((i <= x1) & (x1 > x0), low + (high - low) * F.try_divide(i - x0, x1 - x0))
    return joined.select("o_orderkey", F.round(place.otherwise(50.0), 4).alias("percentile"))


_DRIFT = f"""{_ASSESS}, b AS (SELECT o_custkey, arg_max(index, (o_orderdate, o_orderkey)) AS i FROM a WHERE year(o_orderdate) < 1998 GROUP BY 1), c AS (SELECT o_custkey, arg_max(index, (o_orderdate, o_orderkey)) AS i FROM a WHERE year(o_orderdate) >= 1998 GROUP BY 1),
d AS (SELECT o_custkey, b.i AS before, c.i AS now, CASE WHEN b.i IS NULL THEN 'no_baseline' WHEN c.i IS NULL THEN 'not_rerun' ELSE 'compared' END AS outcome FROM b FULL JOIN c USING (o_custkey))"""


def drift(spark, sf_dir):
    at = F.struct("o_orderdate", "o_orderkey")
    last = lambda rows, name: rows.groupBy("o_custkey").agg(F.max_by("index", at).alias(name))
    a = assessments(spark, sf_dir)
    both = last(a.where(F.year("o_orderdate") < 1998), "before").join(last(a.where(F.year("o_orderdate") >= 1998), "now"), "o_custkey", "full_outer")
    return both.withColumn("outcome", F.when(F.col("before").isNull(), "no_baseline").when(F.col("now").isNull(), "not_rerun").otherwise("compared"))


@query(f"WITH {_DRIFT} SELECT outcome, count(*) AS n, round(avg(now - before), 6) AS mean_delta, round(median(now - before), 6) AS median_delta, round(quantile_cont(now - before, 0.1), 6) AS p10, round(quantile_cont(now - before, 0.9), 6) AS p90 FROM d GROUP BY 1")
def score_drift(spark, sf_dir):
    delta = F.col("now") - F.col("before")
    return drift(spark, sf_dir).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(delta), 6).alias("mean_delta"), F.round(F.median(delta), 6).alias("median_delta"), F.round(F.percentile(delta, F.lit(0.1)), 6).alias("p10"), F.round(F.percentile(delta, F.lit(0.9)), 6).alias("p90"))


_BAND = "CASE WHEN {i} >= 70 THEN 'LOW' WHEN {i} >= 50 THEN 'MEDIUM' WHEN {i} >= 30 THEN 'HIGH' ELSE 'VERY_HIGH' END"


@query(f"WITH {_DRIFT} SELECT {_BAND.format(i='before')} AS was, {_BAND.format(i='now')} AS became, count(*) AS n FROM d WHERE outcome = 'compared' GROUP BY 1, 2")
def migration_matrix(spark, sf_dir):
    return drift(spark, sf_dir).where("outcome = 'compared'").groupBy(risk_band(F.col("before")).alias("was"), risk_band(F.col("now")).alias("became")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_ASSESS}, w AS (SELECT *, area * CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.5 ELSE 0.35 END AS weight FROM a)
SELECT o_custkey, count(*) AS plots, round(sum(area), 3) AS area, round(coalesce(sum(weight * index) / nullif(sum(weight), 0), avg(index)), 5) AS index, CAST(least(5, 2 * (count(*) - 1)) AS BIGINT) AS portfolio_bonus, count(DISTINCT year(o_orderdate)) AS years FROM w GROUP BY 1""")
def farmer_index(spark, sf_dir):
    tenure = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.5).otherwise(0.35)
    w = assessments(spark, sf_dir).withColumn("weight", F.col("area") * tenure)
    mean = F.coalesce(F.try_divide(F.sum(F.col("weight") * F.col("index")), F.sum("weight")), F.avg("index"))
    return w.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("plots"), F.round(F.sum("area"), 3).alias("area"), F.round(mean, 5).alias("index"), F.least(F.lit(5).cast("long"), 2 * (F.count(F.lit(1)) - 1)).alias("portfolio_bonus"), F.countDistinct(F.year("o_orderdate")).alias("years"))


@query(f"WITH {CYCLES}, p AS (SELECT parcel_id, crop_id % 12 AS crop, sum(days) AS d FROM cycles GROUP BY 1, 2), s AS (SELECT parcel_id, d / sum(d) OVER (PARTITION BY parcel_id) AS share FROM p) SELECT parcel_id, count(*) AS crops, round(-sum(share * ln(share)), 6) AS shannon FROM s GROUP BY 1")
def crop_diversity(spark, sf_dir):
    p = cycles(spark, sf_dir).groupBy("parcel_id", (F.col("crop_id") % 12).alias("crop")).agg(F.sum("days").alias("d"))
    share = p.select("parcel_id", (F.col("d") / F.sum("d").over(Window.partitionBy("parcel_id"))).alias("share"))
    return share.groupBy("parcel_id").agg(F.count(F.lit(1)).alias("crops"), F.round(-F.sum(F.col("share") * F.ln("share")), 6).alias("shannon"))


@query(f"WITH {CYCLES}, g AS (SELECT crop_id % 20 AS crop, count(*) AS n, sum(area_ha) AS area, avg(days) AS mean_days FROM cycles GROUP BY 1) SELECT crop, n, round(area, 4) AS area, round(area / sum(area) OVER (), 9) AS share, round(mean_days, 6) AS mean_days FROM g")
def area_by_class(spark, sf_dir):
    g = cycles(spark, sf_dir).groupBy((F.col("crop_id") % 20).alias("crop")).agg(F.count(F.lit(1)).alias("n"), F.sum("area_ha").alias("area"), F.avg("days").alias("mean_days"))
    return g.select("crop", "n", F.round("area", 4).alias("area"), F.round(F.col("area") / F.sum("area").over(Window.partitionBy(F.lit(0))), 9).alias("share"), F.round("mean_days", 6).alias("mean_days"))


@query(f"""WITH {OBS}, d AS (SELECT CAST(day - DATE '2024-01-01' AS INTEGER) AS das, signal FROM obs WHERE signal IS NOT NULL), m AS (SELECT das, median(signal) AS mid, count(*) AS n FROM d GROUP BY 1)
SELECT das, n, round(mid, 9) AS mid, round(greatest(median(abs(d.signal - m.mid)) * 1.4826, 0.02), 9) AS spread FROM d JOIN m USING (das) GROUP BY das, n, mid HAVING n >= 5""")
def reference_curve(spark, sf_dir):
    d = observations(spark, sf_dir).where("signal IS NOT NULL").select(F.datediff("day", F.lit("2024-01-01").cast("date")).alias("das"), "signal")
    mid = d.groupBy("das").agg(F.median("signal").alias("mid"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    return d.join(mid, "das").groupBy("das", "n", "mid").agg(F.greatest(F.median(F.abs(F.col("signal") - F.col("mid"))) * 1.4826, F.lit(0.02)).alias("spread")).select("das", "n", F.round("mid", 9).alias("mid"), F.round("spread", 9).alias("spread"))


@query(f"WITH {_ASSESS}, y AS (SELECT n_name, year(o_orderdate) AS y, avg(index) AS m FROM a GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY y DESC) AS k FROM y) SELECT n_name, count(*) AS years, round(avg(m), 6) AS mean, round(CASE WHEN count(*) < 3 THEN 0.2 ELSE stddev_pop(m) / nullif(avg(m), 0) END, 6) AS cv FROM r WHERE k <= 5 GROUP BY 1")
def district_yield(spark, sf_dir):
    yearly = assessments(spark, sf_dir).groupBy("n_name", F.year("o_orderdate").alias("y")).agg(F.avg("index").alias("m"))
    recent = yearly.withColumn("k", F.row_number().over(Window.partitionBy("n_name").orderBy(F.desc("y")))).where("k <= 5")
    return recent.groupBy("n_name").agg(F.count(F.lit(1)).alias("years"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.when(F.count(F.lit(1)) < 3, 0.2).otherwise(F.try_divide(F.stddev_pop("m"), F.avg("m"))), 6).alias("cv"))


@query(f"WITH {OBS} SELECT parcel_id, count(*) AS n, count(signal) AS present, round(count(signal) / CAST(count(*) AS DOUBLE), 9) AS fraction, mode(sensor ORDER BY sensor) AS sensor, round(avg(CASE WHEN cloud >= 80 THEN 1.0 ELSE 0.0 END), 9) AS cloudy FROM obs GROUP BY 1")
def series_coverage(spark, sf_dir):
    o = observations(spark, sf_dir)
    ranked = o.groupBy("parcel_id", "sensor").count().groupBy("parcel_id").agg(F.min_by("sensor", F.struct(-F.col("count"), F.col("sensor"))).alias("sensor"))
    by = o.groupBy("parcel_id").agg(F.count(F.lit(1)).alias("n"), F.count("signal").alias("present"), F.round(F.avg(F.when(F.col("cloud") >= 80, 1.0).otherwise(0.0)), 9).alias("cloudy"))
    return by.join(ranked, "parcel_id").select("parcel_id", "n", "present", F.round(F.col("present") / F.col("n"), 9).alias("fraction"), "sensor", "cloudy")


@query(f"WITH {CYCLES}, c AS (SELECT crop_id, parcel_id % 10 AS region, count(*) AS n FROM cycles GROUP BY 1, 2) SELECT crop_id, count(*) FILTER (n >= 3) AS supported, count(*) FILTER (n BETWEEN 1 AND 2) AS thin, max(n) AS most FROM c GROUP BY 1")
def region_support(spark, sf_dir):
    c = cycles(spark, sf_dir).groupBy("crop_id", (F.col("parcel_id") % 10).alias("region")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("crop_id").agg(F.count_if(F.col("n") >= 3).alias("supported"), F.count_if(F.col("n").between(1, 2)).alias("thin"), F.max("n").alias("most"))


@query(f"WITH {OBS}, p AS (SELECT parcel_id, regr_slope(signal, cloud) AS slope, regr_intercept(signal, cloud) AS base, count(signal) AS n FROM obs GROUP BY 1) SELECT count(*) AS pairs, round(median(slope), 8) AS slope, round(median(base), 8) AS base, round(quantile_cont(slope, 0.75) - quantile_cont(slope, 0.25), 8) AS spread FROM p WHERE n >= 6")
def cross_calibration(spark, sf_dir):
    p = observations(spark, sf_dir).where("signal IS NOT NULL").groupBy("parcel_id").agg(F.regr_slope("signal", "cloud").alias("slope"), F.regr_intercept("signal", "cloud").alias("base"), F.count("signal").alias("n")).where("n >= 6")
    return p.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.median("slope"), 8).alias("slope"), F.round(F.median("base"), 8).alias("base"), F.round(F.percentile("slope", F.lit(0.75)) - F.percentile("slope", F.lit(0.25)), 8).alias("spread"))


@query(f"WITH {_ASSESS} SELECT r_name, c_mktsegment, sha256(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey)) AS content FROM a GROUP BY 1, 2")
def content_hash(spark, sf_dir):
    parts = F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("t"))))
    return assessments(spark, sf_dir).groupBy("r_name", "c_mktsegment").agg(F.sha2(F.array_join(F.transform(parts, lambda p: p["t"]), ","), 256).alias("content"))


@query("""WITH h AS (SELECT o_custkey, o_orderdate::DATE AS day, o_totalprice AS score, lag(o_totalprice) OVER w AS before, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, day, score, round(score - before, 2) AS delta, CASE WHEN before IS NULL THEN NULL WHEN score > before THEN 'up' WHEN score < before THEN 'down' ELSE 'flat' END AS trend FROM h WHERE r = 1""")
def score_trend(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    h = table(spark, sf_dir, "orders").withColumn("before", F.lag("o_totalprice").over(w))
    last = series.latest(h, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))
    now, before = F.col("o_totalprice"), F.col("before")
    return last.select("o_custkey", F.col("o_orderdate").cast("date").alias("day"), now.alias("score"), F.round(now - before, 2).alias("delta"), F.when(before.isNull(), None).when(now > before, "up").when(now < before, "down").otherwise("flat").alias("trend"))
