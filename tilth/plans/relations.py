"""Queries of joins, set operations, sorts, samples and reshaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tilth.functions.agronomy import haversine
from tilth.operators import evaluation, matching, series
from tilth.plans.base import ANCHOR, CYCLES, OBS, WEATHER, cycles, observations, query, table, weather


@query("""SELECT o_orderkey, o_custkey, n_name AS district, r_name AS region FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def left_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    out = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    out = out.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("o_orderkey", "o_custkey", F.col("n_name").alias("district"), F.col("r_name").alias("region"))


@query("""WITH b AS (SELECT o_custkey AS k, max(o_totalprice) AS before FROM orders WHERE year(o_orderdate) < 1998 GROUP BY 1), a AS (SELECT o_custkey AS k, max(o_totalprice) AS now FROM orders WHERE year(o_orderdate) >= 1998 GROUP BY 1)
SELECT k, before, now, CASE WHEN before IS NULL THEN 'new' WHEN now IS NULL THEN 'gone' WHEN now > before THEN 'up' ELSE 'down' END AS outcome FROM b FULL JOIN a USING (k)""")
def full_outer_drift(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    best = lambda rows, name: rows.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias(name))
    both = best(o.where(F.year("o_orderdate") < 1998), "before").join(best(o.where(F.year("o_orderdate") >= 1998), "now"), "k", "full_outer")
    return both.withColumn("outcome", F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") > F.col("before"), "up").otherwise("down"))


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def semi_completed(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return table(spark, sf_dir, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def anti_completed(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return table(spark, sf_dir, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


_CELLS = f"{CYCLES}, {WEATHER}, placed AS (SELECT cycles.*, s_nationkey AS cell FROM cycles JOIN supplier ON parcel_id = s_suppkey)"


@query(f"""WITH {_CELLS} SELECT cycle_id, cell, count(*) AS wet_reports, CAST(sum(w.n) AS BIGINT) AS looks, min(w.day) AS first_day FROM placed JOIN weather w USING (cell) WHERE w.day BETWEEN sown - 5 AND harvested + 5 GROUP BY 1, 2""")
def cycle_weather_window(spark, sf_dir):
    placed = cycles(spark, sf_dir).join(table(spark, sf_dir, "supplier"), F.col("parcel_id") == F.col("s_suppkey")).select("cycle_id", F.col("s_nationkey").alias("cell"), "sown", "harvested")
    units, members = matching.alike(placed, ["cycle_id", "cell"], ["cell", "sown", "harvested"])
    hit = matching.within(units, weather(spark, sf_dir), ["cell"], F.col("day"), F.date_sub("sown", 5), F.date_add("harvested", 5), band_days=14)
    seen = hit.groupBy("unit").agg(F.count(F.lit(1)).alias("wet_reports"), F.sum("n").alias("looks"), F.min("day").alias("first_day"))
    return members.join(seen, "unit").select("cycle_id", "cell", "wet_reports", "looks", "first_day")


@query(f"""WITH {CYCLES}, s AS (SELECT y, k.name, make_date(CAST(y AS INT), m1, 1) AS a, make_date(CAST(y AS INT), m1, 1) + 122 AS b FROM range(1994, 2003) t(y), (VALUES ('kharif', 6), ('zaid', 2)) k(name, m1)),
o AS (SELECT cycle_id, name, y, CAST(greatest(0, least(harvested, b) - greatest(sown, a) + 1) AS INTEGER) AS shared FROM cycles JOIN s ON a <= harvested AND b >= sown)
SELECT cycle_id, max(shared) AS shared, count(*) AS seasons FROM o WHERE shared > 0 GROUP BY 1""")
def season_overlap(spark, sf_dir):
    """The calendar is made from its rule, two seasons a year, and met by year rather than by a nested loop."""
    years = spark.range(1994, 2003).withColumnRenamed("id", "y")
    seasons = years.select("y", F.explode(F.array(F.lit(6), F.lit(2))).alias("month")).select("y", F.make_date(F.col("y").cast("int"), "month", F.lit(1)).alias("a"))
    seasons = seasons.withColumn("b", F.date_add("a", 122)).withColumn("touch", F.explode(F.sequence(F.year("a"), F.year("b"))))
    spread = cycles(spark, sf_dir).withColumn("touch", F.explode(F.sequence(F.year("sown"), F.year("harvested"))))
    met = spread.join(seasons, "touch").where((F.col("a") <= F.col("harvested")) & (F.col("b") >= F.col("sown"))).select("cycle_id", "y", "a", matching.overlap_days(F.col("sown"), F.col("harvested"), F.col("a"), F.col("b")).alias("shared")).distinct()
    return met.where("shared > 0").groupBy("cycle_id").agg(F.max("shared").alias("shared"), F.count(F.lit(1)).alias("seasons"))


_NUM = f"{OBS}, e AS (SELECT obs_id, parcel_id, sensor, CAST(day - DATE '{ANCHOR}' AS INTEGER) AS d, signal FROM obs)"


def _numbered(spark, sf_dir):
    return observations(spark, sf_dir).select("obs_id", "parcel_id", "sensor", F.datediff("day", F.lit(ANCHOR).cast("date")).alias("d"), "signal")


@query(f"""WITH {_NUM}, p AS (SELECT a.obs_id, b.obs_id AS other, b.signal, row_number() OVER (PARTITION BY a.obs_id ORDER BY abs(a.d - b.d), b.d, b.obs_id) AS r FROM e a JOIN e b ON a.parcel_id = b.parcel_id AND abs(a.d - b.d) <= 6 WHERE a.sensor = 'click' AND b.sensor = 'purchase')
SELECT e.obs_id, p.other AS near_other, round(p.signal, 9) AS near_signal FROM e LEFT JOIN (SELECT * FROM p WHERE r = 1) p USING (obs_id) WHERE e.sensor = 'click'""")
def nearest_observation(spark, sf_dir):
    e = _numbered(spark, sf_dir)
    left = e.where("sensor = 'click'").select("obs_id", "parcel_id", F.col("d").alias("at"))
    right = e.where("sensor = 'purchase'").select("parcel_id", F.col("obs_id").alias("other"), F.col("d").alias("when"), "signal")
    found = matching.nearest(left, right, ["parcel_id"], "at", "when", 6, "obs_id", ["other", "signal"], "other")
    return found.select("obs_id", "near_other", F.round("near_signal", 9).alias("near_signal"))


@query(f"""WITH {_NUM}, p AS (SELECT a.obs_id, b.d, b.signal, row_number() OVER (PARTITION BY a.obs_id ORDER BY b.d DESC, b.obs_id DESC) AS r FROM e a JOIN e b ON a.parcel_id = b.parcel_id AND b.d < a.d AND a.d - b.d <= 6 AND a.sensor = b.sensor)
SELECT e.obs_id, CAST(e.d - p.d AS INTEGER) AS days, round(p.signal, 9) AS previous FROM e JOIN (SELECT * FROM p WHERE r = 1) p USING (obs_id)""")
def previous_look(spark, sf_dir):
    e = _numbered(spark, sf_dir)
    before = Window.partitionBy("parcel_id", "sensor").orderBy("d").rangeBetween(-6, -1)
    last = F.max(F.struct("d", "obs_id", "signal")).over(before)
    return e.withColumn("last", last).where("last IS NOT NULL").select("obs_id", (F.col("d") - F.col("last.d")).alias("days"), F.round("last.signal", 9).alias("previous"))


@query(f"""WITH {_NUM} SELECT a.obs_id AS one, b.obs_id AS two, CAST(b.d - a.d AS INTEGER) AS days, round(b.signal - a.signal, 9) AS offset FROM e a JOIN e b ON a.parcel_id = b.parcel_id AND abs(a.d - b.d) <= 1 WHERE a.sensor = 'view' AND b.sensor = 'click'""")
def sensor_pairs(spark, sf_dir):
    e = _numbered(spark, sf_dir)
    left = e.where("sensor = 'view'").select("parcel_id", F.col("obs_id").alias("one"), F.col("d").alias("d1"), F.col("signal").alias("s1"))
    right = e.where("sensor = 'click'").select("parcel_id", F.col("obs_id").alias("two"), F.col("d").alias("d2"), F.col("signal").alias("s2"))
    return matching.banded(left, right, ["parcel_id"], "d1", "d2", 1).select("one", "two", (F.col("d2") - F.col("d1")).alias("days"), F.round(F.col("s2") - F.col("s1"), 9).alias("offset"))


@query(f"""WITH {CYCLES}, c AS (SELECT row_number() OVER () AS r, cycle_id, crop_id, CAST(sown - DATE '1992-01-01' AS INTEGER) AS d, days FROM cycles),
p AS (SELECT a.r, count(*) AS peers, avg(b.days) AS mean_days FROM c a JOIN c b ON a.crop_id = b.crop_id AND abs(a.d - b.d) <= 200 AND a.r <> b.r GROUP BY 1),
w AS (SELECT crop_id, avg(days) AS crop_days FROM c GROUP BY 1)
SELECT c.cycle_id, coalesce(p.peers, 0) AS peers, round(CASE WHEN p.peers >= 3 THEN p.mean_days ELSE w.crop_days END, 6) AS reference FROM c LEFT JOIN p USING (r) JOIN w USING (crop_id)""")
def cohort_within(spark, sf_dir):
    """Cycles of the crop sown within 200 days, the cycle itself left out; the whole crop where they are under three. Sums
    go by crop and day first, so no pair of cycles is made and a window holds a crop's days, not its cycles."""
    c = cycles(spark, sf_dir).select("cycle_id", "crop_id", F.datediff("sown", F.lit("1992-01-01").cast("date")).alias("d"), "days")
    daily = c.groupBy("crop_id", "d").agg(F.count(F.lit(1)).alias("n"), F.sum("days").alias("total"))
    near, crop = Window.partitionBy("crop_id").orderBy("d").rangeBetween(-200, 200), Window.partitionBy("crop_id")
    around = daily.select("crop_id", "d", F.sum("n").over(near).alias("n"), F.sum("total").over(near).alias("total"), (F.sum("total").over(crop) / F.sum("n").over(crop)).alias("crop_days"))
    out = c.join(around, ["crop_id", "d"]).withColumn("peers", F.col("n") - 1).withColumn("mean_days", F.try_divide((F.col("total") - F.col("days")).cast("double"), F.col("peers")))
    return out.select("cycle_id", "peers", F.round(F.when(F.col("peers") >= 3, F.col("mean_days")).otherwise(F.col("crop_days")), 6).alias("reference"))


_POINTS = "pt AS (SELECT s_suppkey AS id, 18 + (s_suppkey * 37 % 400) / 100.0 AS lat, 74 + (s_suppkey * 53 % 400) / 100.0 AS lon FROM supplier)"
_KM = "2 * 6371 * asin(sqrt(least(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2), 1)))"


def _points(spark, sf_dir):
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(key.alias("id"), (18 + (key * 37 % 400) / 100.0).alias("lat"), (74 + (key * 53 % 400) / 100.0).alias("lon"))


@query(f"WITH {_POINTS} SELECT a.id AS a, b.id AS b, round({_KM}, 6) AS km FROM pt a JOIN pt b ON a.id < b.id WHERE {_KM} <= 40")
def neighbours_within(spark, sf_dir):
    return matching.neighbours(_points(spark, sf_dir), "id", "lat", "lon", 40.0, haversine).withColumn("km", F.round("km", 6))


@query("""SELECT c_custkey AS id FROM customer UNION SELECT s_suppkey FROM supplier""")
def union_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).union(table(spark, sf_dir, "supplier").select("s_suppkey")).distinct()


@query("""SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""")
def union_shards(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


@query("""SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier""")
def intersect_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("""SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'""")
def except_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).subtract(table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey"))


@query("""SELECT c_mktsegment, rank, c_custkey, c_acctbal FROM (SELECT *, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer) WHERE rank <= 20""")
def top_per_segment(spark, sf_dir):
    return evaluation.top_per_group(table(spark, sf_dir, "customer"), ["c_mktsegment"], 20, F.desc("c_acctbal"), F.col("c_custkey")).select("c_mktsegment", "rank", "c_custkey", "c_acctbal")


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40""")
def page_of_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)


@query("""WITH k AS (SELECT c_custkey, c_nationkey, c_mktsegment, sha256('seed|' || c_custkey) AS key FROM customer), q AS (SELECT c_mktsegment, CAST(ceil(count(*) * 0.2) AS BIGINT) AS quota FROM customer GROUP BY 1),
b AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY key) AS r FROM k), m AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY key) AS s FROM b WHERE r <= 20)
SELECT c_custkey, c_mktsegment, c_nationkey FROM m JOIN q USING (c_mktsegment) WHERE s <= quota""")
def sample_cap_per_block(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("key", evaluation.seeded_order("seed", "c_custkey"))
    quota = c.groupBy("c_mktsegment").agg(F.ceil(F.count(F.lit(1)) * 0.2).alias("quota"))
    capped = evaluation.top_per_group(c, ["c_mktsegment", "c_nationkey"], 20, F.col("key")).drop("rank")
    ranked = capped.withColumn("s", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("key")))
    return ranked.join(quota, "c_mktsegment").where("s <= quota").select("c_custkey", "c_mktsegment", "c_nationkey")


@query("""WITH w AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM w WHERE r = 1""")
def dedup_first(spark, sf_dir):
    return series.latest(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("""SELECT o_custkey, o_orderkey, o_orderdate::DATE AS day, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def preferred_latest(spark, sf_dir):
    tier = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return series.latest(table(spark, sf_dir, "orders"), ["o_custkey"], tier, F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderstatus")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, band, value FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS b_1, l_discount AS b_2, l_tax AS b_3 FROM lineitem) UNPIVOT (value FOR band IN (b_1, b_2, b_3))""")
def unpivot_bands(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("b_1"), F.col("l_discount").alias("b_2"), F.col("l_tax").alias("b_3"))
    return wide.unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["b_1", "b_2", "b_3"], "band", "value")


@query("""SELECT user_id, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1""")
def pivot_sensors(spark, sf_dir):
    kinds = ["view", "click", "purchase"]
    return table(spark, sf_dir, "events").where(F.col("event_type").isin(kinds)).groupBy("user_id").pivot("event_type", kinds).count().na.fill(0, kinds)


@query("""SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') ORDER BY p_name, p_partkey LIMIT 100""")
def search_names(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.contains(F.lower("p_name"), F.lit("ring"))).orderBy("p_name", "p_partkey").limit(100).select("p_partkey", "p_name")


@query("""SELECT coalesce(CASE WHEN c_acctbal > 0 THEN n_name END, 'Unknown district') AS district, count(*) AS farmers, round(sum(c_acctbal), 2) AS area FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def location_groups(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.coalesce(F.when(F.col("c_acctbal") > 0, F.col("n_name")), F.lit("Unknown district")).alias("district")).agg(F.count(F.lit(1)).alias("farmers"), F.round(F.sum("c_acctbal"), 2).alias("area"))


@query("""WITH r AS (SELECT page_id, regexp_extract(url, '://([^/:?#]+)', 1) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
SELECT page_id, host, len(title) AS title_length FROM r WHERE host <> ''""")
def page_records(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.regexp_extract("url", "://([^/:?#]+)", 1).alias("host"), F.length(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).cast("long").alias("title_length")).where("host <> ''")
