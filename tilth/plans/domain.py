"""Composite queries of the domain: gates, sowing, stress, yield, risk, validation, official comparisons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tilth.operators import series
from tilth.plans.base import ANCHOR, CYCLES, OBS, WEATHER, cycles, observations, query, table, weather
from tilth.plans.observed import GRID, best


@query(f"""WITH {GRID}, g AS (SELECT parcel_id, bin, missing, lag(CASE WHEN NOT missing THEN bin END) OVER w AS x, row_number() OVER w - sum(CAST(missing AS INT)) OVER w AS i FROM best WINDOW w AS (PARTITION BY parcel_id ORDER BY bin)),
r AS (SELECT parcel_id, (max(bin) - min(bin) + 2) * 3 AS days FROM g WHERE missing GROUP BY parcel_id, i),
s AS (SELECT parcel_id, avg(CASE WHEN missing THEN 0.0 ELSE 1.0 END) AS seen FROM best GROUP BY 1)
SELECT s.parcel_id, round(seen, 9) AS seen, CAST(coalesce(max(days), 0) AS INTEGER) AS blind_days, CASE WHEN coalesce(max(days), 0) >= 40 OR seen < 0.35 THEN 'insufficient' ELSE 'sufficient' END AS gate FROM s LEFT JOIN r USING (parcel_id) GROUP BY s.parcel_id, seen""")
def sufficiency_gate(spark, sf_dir):
    grid = best(spark, sf_dir)
    blind = series.runs(grid, ["parcel_id"], "bin", F.col("missing")).groupBy("parcel_id").agg(F.max((F.col("run_length") + 1) * 3).cast("int").alias("blind_days"))
    seen = grid.groupBy("parcel_id").agg(F.avg(F.when(F.col("missing"), 0.0).otherwise(1.0)).alias("seen"))
    out = seen.join(blind, "parcel_id", "left").na.fill(0, ["blind_days"])
    return out.select("parcel_id", F.round("seen", 9).alias("seen"), "blind_days", F.when((F.col("blind_days") >= 40) | (F.col("seen") < 0.35), "insufficient").otherwise("sufficient").alias("gate"))


@query("""WITH p AS (SELECT l_orderkey, l_partkey % 5 AS crop, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), s AS (SELECT l_orderkey, crop, q / sum(q) OVER (PARTITION BY l_orderkey) AS p, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY q DESC, crop) AS r FROM p),
t AS (SELECT l_orderkey, max(CASE WHEN r = 1 THEN crop END) AS crop, max(CASE WHEN r = 1 THEN p END) AS p1, coalesce(max(CASE WHEN r = 2 THEN p END), 0) AS p2, max(n) AS n FROM s GROUP BY 1)
SELECT l_orderkey, crop, round(p1, 9) AS p1, round(p1 - p2, 9) AS gap, CASE WHEN p1 < 0.4 THEN 'low confidence' WHEN p1 - p2 < 0.1 THEN 'close call' WHEN n < 2 THEN 'few classes' ELSE 'named' END AS decision FROM t""")
def abstain_gate(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_partkey") % 5).alias("crop")).agg(F.sum("l_quantity").alias("q"))
    by = p.groupBy("l_orderkey").agg(F.sum("q").alias("total"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("q")).alias("q"), "crop"))).alias("top"))
    p1, p2 = -F.col("top")[0]["q"] / F.col("total"), F.coalesce(-F.try_element_at("top", F.lit(2))["q"] / F.col("total"), F.lit(0.0))
    decision = F.when(p1 < 0.4, "low confidence").when(p1 - p2 < 0.1, "close call").when(F.col("n") < 2, "few classes").otherwise("named")
    return by.select("l_orderkey", F.col("top")[0]["crop"].alias("crop"), F.round(p1, 9).alias("p1"), F.round(p1 - p2, 9).alias("gap"), decision.alias("decision"))


_CUES = f"""{OBS}, cue AS (SELECT parcel_id, CAST(day - DATE '{ANCHOR}' AS INTEGER) AS d, CASE sensor WHEN 'signup' THEN 2.0 WHEN 'purchase' THEN 4.0 ELSE 6.0 END AS sigma FROM obs),
c AS (SELECT DISTINCT parcel_id, x FROM cue, range(0, 30) t(x)),
l AS (SELECT c.parcel_id, c.x, sum(ln(0.9 * exp(-power((c.x - d) / sigma, 2) / 2) / (sigma * sqrt(2 * pi())) + 0.1 / 30)) + ln(1 - abs(c.x - 15) / 31.0) AS lp FROM c JOIN cue USING (parcel_id) GROUP BY c.parcel_id, c.x),
m AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY parcel_id)) AS w FROM l), n AS (SELECT parcel_id, x, sum(w) OVER (PARTITION BY parcel_id ORDER BY x) / sum(w) OVER (PARTITION BY parcel_id) AS cum FROM m)"""


@query(f"""WITH {_CUES}, q AS (SELECT parcel_id, min(CASE WHEN cum >= 0.1 THEN x END) AS p10, min(CASE WHEN cum >= 0.5 THEN x END) AS p50, min(CASE WHEN cum >= 0.9 THEN x END) AS p90 FROM n GROUP BY 1)
SELECT parcel_id, CAST(p10 AS INTEGER) AS p10, CAST(p50 AS INTEGER) AS p50, CAST(p90 AS INTEGER) AS p90, CASE WHEN p90 - p10 > 12 THEN 'window' ELSE 'date' END AS status FROM q""")
def sowing_posterior(spark, sf_dir):
    """Candidate days times a triangular prior times every cue's mixture; all by explode, sums of logarithms and windows."""
    spread = F.when(F.col("sensor") == "signup", 2.0).when(F.col("sensor") == "purchase", 4.0).otherwise(6.0)
    cue = observations(spark, sf_dir).select("parcel_id", F.datediff("day", F.lit(ANCHOR).cast("date")).alias("d"), spread.alias("sigma"))
    x = F.explode(F.sequence(F.lit(0), F.lit(29))).alias("x")
    near = F.exp(-F.pow((F.col("x") - F.col("d")) / F.col("sigma"), F.lit(2.0)) / 2) / (F.col("sigma") * F.sqrt(2 * F.pi()))
    logs = cue.select("*", x).groupBy("parcel_id", "x").agg(F.sum(F.ln(0.9 * near + 0.1 / 30)).alias("s")).withColumn("lp", F.col("s") + F.ln(1 - F.abs(F.col("x") - 15) / 31.0))
    own = Window.partitionBy("parcel_id")
    cum = logs.withColumn("w", F.exp(F.col("lp") - F.max("lp").over(own))).withColumn("cum", F.sum("w").over(own.orderBy("x")) / F.sum("w").over(own))
    q = cum.groupBy("parcel_id").agg(*[F.min(F.when(F.col("cum") >= p, F.col("x"))).alias(f"p{round(100 * p)}") for p in (0.1, 0.5, 0.9)])
    return q.withColumn("status", F.when(F.col("p90") - F.col("p10") > 12, "window").otherwise("date"))


@query(f"""WITH {OBS}, s AS (SELECT parcel_id, obs_id, day, CAST(day - DATE '{ANCHOR}' AS INTEGER) AS das, signal FROM obs WHERE signal IS NOT NULL), m AS (SELECT das, median(signal) AS mid FROM s GROUP BY 1),
f AS (SELECT s.das, m.mid, greatest(median(abs(signal - mid)) * 1.4826, 0.02) AS spread FROM s JOIN m USING (das) GROUP BY 1, 2),
z AS (SELECT parcel_id, obs_id, day, (signal - mid) / spread AS z FROM s JOIN f USING (das)),
p AS (SELECT *, z < -1.2 AS bad, lag(z < -1.2) OVER (PARTITION BY parcel_id ORDER BY day, obs_id) AS before FROM z)
SELECT parcel_id, count(*) AS looks, count(*) FILTER (bad) AS bad, count(*) FILTER (bad AND before) AS confirmed, round(min(z), 5) AS worst FROM p GROUP BY 1""")
def cohort_stress(spark, sf_dir):
    s = observations(spark, sf_dir).where("signal IS NOT NULL").withColumn("das", F.datediff("day", F.lit(ANCHOR).cast("date")))
    mid = s.groupBy("das").agg(F.median("signal").alias("mid"))
    ref = s.join(mid, "das").groupBy("das", "mid").agg(F.greatest(F.median(F.abs(F.col("signal") - F.col("mid"))) * 1.4826, F.lit(0.02)).alias("spread"))
    z = s.join(ref, "das").withColumn("z", (F.col("signal") - F.col("mid")) / F.col("spread")).withColumn("bad", F.col("z") < -1.2)
    before = F.lag("bad").over(Window.partitionBy("parcel_id").orderBy("day", "obs_id"))
    return z.withColumn("before", before).groupBy("parcel_id").agg(F.count(F.lit(1)).alias("looks"), F.count_if("bad").alias("bad"), F.count_if(F.col("bad") & F.col("before")).alias("confirmed"), F.round(F.min("z"), 5).alias("worst"))


@query(f"""WITH {CYCLES}, y AS (SELECT cycle_id, crop_id, days * area_ha AS integral, days FROM cycles), p AS (SELECT crop_id, median(integral) AS mid, count(*) AS peers, stddev_pop(integral) / nullif(avg(integral), 0) AS cv FROM y GROUP BY 1)
SELECT cycle_id, CASE WHEN peers >= 8 THEN round(integral / nullif(mid, 0) * (1 - least(0.35, 0.02 * (days % 20))), 6) END AS index, CASE WHEN peers >= 8 THEN round(1.2816 * cv, 6) END AS band, peers FROM y JOIN p USING (crop_id)""")
def yield_index(spark, sf_dir):
    y = cycles(spark, sf_dir).select("cycle_id", "crop_id", (F.col("days") * F.col("area_ha")).alias("integral"), "days")
    p = y.groupBy("crop_id").agg(F.median("integral").alias("mid"), F.count(F.lit(1)).alias("peers"), F.try_divide(F.stddev_pop("integral"), F.avg("integral")).alias("cv"))
    enough = F.col("peers") >= 8
    index = F.try_divide(F.col("integral"), F.col("mid")) * (1 - F.least(F.lit(0.35), 0.02 * (F.col("days") % 20)))
    return y.join(p, "crop_id").select("cycle_id", F.when(enough, F.round(index, 6)).alias("index"), F.when(enough, F.round(1.2816 * F.col("cv"), 6)).alias("band"), "peers")


@query(f"""WITH {WEATHER}, t AS (SELECT cell, quantile_cont(rain, 0.95) AS heavy, quantile_cont(rain, 0.1) AS low FROM weather GROUP BY 1), e AS (SELECT w.cell, w.day, CASE WHEN rain >= heavy THEN 'heavy_rain' WHEN rain <= low THEN 'dry' END AS event, CASE WHEN rain >= 1.5 * heavy THEN 3 WHEN rain >= heavy THEN 2 ELSE 1 END AS severity FROM weather w JOIN t USING (cell))
SELECT cell, event, count(*) AS n, CAST(sum(severity) AS BIGINT) AS severity, min(day) AS first_day FROM e WHERE event IS NOT NULL GROUP BY 1, 2""")
def weather_events(spark, sf_dir):
    w = weather(spark, sf_dir)
    t = w.groupBy("cell").agg(F.percentile("rain", F.lit(0.95)).alias("heavy"), F.percentile("rain", F.lit(0.1)).alias("low"))
    r, h = F.col("rain"), F.col("heavy")
    e = w.join(t, "cell").select("cell", "day", F.when(r >= h, "heavy_rain").when(r <= F.col("low"), "dry").alias("event"), F.when(r >= 1.5 * h, 3).when(r >= h, 2).otherwise(1).alias("severity"))
    return e.where("event IS NOT NULL").groupBy("cell", "event").agg(F.count(F.lit(1)).alias("n"), F.sum("severity").alias("severity"), F.min("day").alias("first_day"))


@query("""WITH v AS (SELECT p_partkey, list_filter([CASE WHEN p_size > 45 THEN 'p_size:too large' END, CASE WHEN p_retailprice < 950 THEN 'p_retailprice:too low' END, CASE WHEN p_name NOT LIKE '% %' THEN 'p_name:one word' END, CASE WHEN p_type = 'PROMO' THEN 'p_type:not allowed' END], lambda x: x IS NOT NULL) AS errors FROM part), e AS (SELECT p_partkey, unnest(errors) AS error FROM v)
SELECT p_partkey, split_part(error, ':', 1) AS field, split_part(error, ':', 2) AS message FROM e""")
def record_errors(spark, sf_dir):
    rules = [("p_size", F.col("p_size") > 45, "too large"), ("p_retailprice", F.col("p_retailprice") < 950, "too low"), ("p_name", ~F.col("p_name").like("% %"), "one word"), ("p_type", F.col("p_type") == "PROMO", "not allowed")]
    errors = F.filter(F.array(*[F.when(bad, F.struct(F.lit(c).alias("field"), F.lit(m).alias("message"))) for c, bad, m in rules]), lambda e: e.isNotNull())
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(errors).alias("e")).select("p_partkey", "e.field", "e.message")


@query(f"""WITH {CYCLES}, m AS (SELECT crop_id % 12 AS crop, sum(area_ha) AS area FROM cycles GROUP BY 1), o AS (SELECT p_size % 14 AS crop, sum(p_retailprice) AS area FROM part GROUP BY 1),
s AS (SELECT crop, m.area / sum(m.area) OVER () AS mapped, o.area / sum(o.area) OVER () AS official FROM m FULL JOIN o USING (crop))
SELECT crop, round(mapped, 9) AS mapped, round(official, 9) AS official, coalesce(official, 0) >= 0.05 AS major, coalesce(abs(coalesce(mapped, 0) - coalesce(official, 0)) > 0.02, false) AS flagged FROM s""")
def official_shares(spark, sf_dir):
    every = Window.partitionBy(F.lit(0))
    m = cycles(spark, sf_dir).groupBy((F.col("crop_id") % 12).alias("crop")).agg(F.sum("area_ha").alias("m"))
    o = table(spark, sf_dir, "part").groupBy((F.col("p_size") % 14).cast("long").alias("crop")).agg(F.sum("p_retailprice").alias("o"))
    both = m.join(o, "crop", "full_outer").select("crop", (F.col("m") / F.sum("m").over(every)).alias("mapped"), (F.col("o") / F.sum("o").over(every)).alias("official"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return both.select("crop", F.round("mapped", 9).alias("mapped"), F.round("official", 9).alias("official"), (zero("official") >= 0.05).alias("major"), (F.abs(zero("mapped") - zero("official")) > 0.02).alias("flagged"))


@query(f"""WITH {CYCLES}, d AS (SELECT crop_id % 6 AS crop, sown FROM cycles), w AS (SELECT DATE '1995-01-01' + CAST(k * 180 AS INTEGER) AS week_end, k / 14.0 AS official FROM range(0, 15) t(k))
SELECT crop, round(max(abs(share - official)), 9) AS largest FROM (SELECT crop, week_end, official, avg(CASE WHEN sown <= week_end THEN 1.0 ELSE 0.0 END) AS share FROM d, w GROUP BY 1, 2, 3) GROUP BY 1""")
def sowing_progress(spark, sf_dir):
    """Share sown by each official date, counted in one pass over the dates of a row."""
    weeks = F.transform(F.sequence(F.lit(0), F.lit(14)), lambda k: F.struct(F.date_add(F.lit("1995-01-01").cast("date"), k * 180).alias("week_end"), (k / 14.0).alias("official")))
    d = cycles(spark, sf_dir).select((F.col("crop_id") % 6).alias("crop"), "sown", F.explode(weeks).alias("w"))
    share = d.groupBy("crop", "w.week_end", "w.official").agg(F.avg(F.when(F.col("sown") <= F.col("w.week_end"), 1.0).otherwise(0.0)).alias("share"))
    return share.groupBy("crop").agg(F.round(F.max(F.abs(F.col("share") - F.col("official"))), 9).alias("largest"))


@query("""WITH p AS (SELECT l_orderkey, l_partkey % 4 AS crop, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), r AS (SELECT l_orderkey, crop, q / sum(q) OVER (PARTITION BY l_orderkey) * CASE crop WHEN 0 THEN 2.0 WHEN 1 THEN 0.5 ELSE 1.0 END AS w FROM p)
SELECT l_orderkey, crop, round(w / sum(w) OVER (PARTITION BY l_orderkey), 9) AS posterior FROM r""")
def label_shift(spark, sf_dir):
    ratio = F.when(F.col("crop") == 0, 2.0).when(F.col("crop") == 1, 0.5).otherwise(1.0)
    own = Window.partitionBy("l_orderkey")
    p = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_partkey") % 4).alias("crop")).agg(F.sum("l_quantity").alias("q"))
    w = p.withColumn("w", F.col("q") / F.sum("q").over(own) * ratio)
    return w.select("l_orderkey", "crop", F.round(F.col("w") / F.sum("w").over(own), 9).alias("posterior"))


@query(f"""WITH {CYCLES}, y AS (SELECT parcel_id, year(sown) AS y, count(*) AS n, count(DISTINCT crop_id % 12) AS crops FROM cycles GROUP BY 1, 2)
SELECT parcel_id, count(*) AS years, round(avg(least(n, 3.5)), 9) AS intensity, max(crops) AS most_crops, CASE WHEN avg(n) >= 2 THEN 'multiple' WHEN avg(n) >= 1 THEN 'single' ELSE 'sparse' END AS pattern FROM y GROUP BY 1""")
def cropping_intensity(spark, sf_dir):
    y = cycles(spark, sf_dir).groupBy("parcel_id", F.year("sown").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.col("crop_id") % 12).alias("crops"))
    mean = F.avg("n")
    return y.groupBy("parcel_id").agg(F.count(F.lit(1)).alias("years"), F.round(F.avg(F.least(F.col("n").cast("double"), F.lit(3.5))), 9).alias("intensity"), F.max("crops").alias("most_crops"), F.when(mean >= 2, "multiple").when(mean >= 1, "single").otherwise("sparse").alias("pattern"))


@query(f"""WITH {CYCLES}, l AS (SELECT l_suppkey AS parcel_id, DATE '1992-01-01' + CAST(l_suppkey * 37 % 3000 AS INTEGER) AS survey FROM (SELECT DISTINCT l_suppkey FROM lineitem)),
m AS (SELECT parcel_id, cycle_id, row_number() OVER (PARTITION BY parcel_id ORDER BY CASE WHEN survey BETWEEN sown AND harvested THEN 0 ELSE least(abs(survey - sown), abs(survey - harvested)) END, sown, cycle_id) AS r, survey BETWEEN sown AND harvested AS inside FROM cycles JOIN l USING (parcel_id))
SELECT parcel_id, cycle_id, inside FROM m WHERE r = 1""")
def label_attribution(spark, sf_dir):
    """The cycle that a survey's date refers to: one around it, else the nearest."""
    c = cycles(spark, sf_dir)
    survey = F.date_add(F.lit("1992-01-01").cast("date"), (F.col("parcel_id") * 37 % 3000).cast("int"))
    inside = F.col("survey").between(F.col("sown"), F.col("harvested"))
    away = F.when(inside, 0).otherwise(F.least(F.abs(F.datediff("survey", "sown")), F.abs(F.datediff("survey", "harvested"))))
    near = c.withColumn("survey", survey).withColumns({"inside": inside, "away": away})
    best_one = near.groupBy("parcel_id").agg(F.min_by(F.struct("cycle_id", "inside"), F.struct("away", "sown", "cycle_id")).alias("b"))
    return best_one.select("parcel_id", "b.cycle_id", "b.inside")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 1000 THEN 'SCORED' WHEN o_orderpriority LIKE '5%' THEN 'NOT_FARMLAND' WHEN o_totalprice < 20000 THEN 'UNOBSERVED' WHEN o_orderstatus = 'P' THEN 'FAILED' ELSE 'PENDING' END AS state,
  'Index ' || printf('%.1f', o_totalprice / 5000.5) || ' of 100, ' || lower(o_orderpriority) AS caption FROM orders""")
def terminal_state(spark, sf_dir):
    price = F.col("o_totalprice")
    state = F.when((F.col("o_orderstatus") == "F") & (price > 1000), "SCORED").when(F.col("o_orderpriority").startswith("5"), "NOT_FARMLAND").when(price < 20000, "UNOBSERVED").when(F.col("o_orderstatus") == "P", "FAILED").otherwise("PENDING")
    return table(spark, sf_dir, "orders").select("o_orderkey", state.alias("state"), F.concat(F.lit("Index "), F.format_string("%.1f", price / 5000.5), F.lit(" of 100, "), F.lower("o_orderpriority")).alias("caption"))


@query(f"""WITH {OBS}, s AS (SELECT parcel_id, CAST(day - DATE '{ANCHOR}' AS INTEGER) AS d, avg(signal) AS v FROM obs GROUP BY 1, 2),
m AS (SELECT parcel_id, arg_max(d, (v, -d)) AS peak, max(v) AS top, min(v) AS base FROM s WHERE v IS NOT NULL GROUP BY 1)
SELECT m.parcel_id, CAST(peak AS INTEGER) AS peak_day, CAST(min(CASE WHEN d <= peak AND v >= base + 0.2 * (top - base) THEN d END) AS INTEGER) AS start_day, CAST(max(CASE WHEN d >= peak AND v >= base + 0.2 * (top - base) THEN d END) AS INTEGER) AS end_day FROM m JOIN s USING (parcel_id) GROUP BY m.parcel_id, peak, top, base""")
def season_milestones(spark, sf_dir):
    s = observations(spark, sf_dir).groupBy("parcel_id", F.datediff("day", F.lit(ANCHOR).cast("date")).alias("d")).agg(F.avg("signal").alias("v"))
    m = s.where("v IS NOT NULL").groupBy("parcel_id").agg(F.max_by("d", F.struct("v", -F.col("d"))).alias("peak_day"), F.max("v").alias("top"), F.min("v").alias("base"))
    over = F.col("v") >= F.col("base") + 0.2 * (F.col("top") - F.col("base"))
    return s.join(m, "parcel_id").groupBy("parcel_id", "peak_day").agg(F.min(F.when((F.col("d") <= F.col("peak_day")) & over, F.col("d"))).alias("start_day"), F.max(F.when((F.col("d") >= F.col("peak_day")) & over, F.col("d"))).alias("end_day"))
