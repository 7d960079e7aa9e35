"""Queries of seasons: presence, emergence, progress, resilience, verification, estimators, daily state and reference data."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tilth.plans.base import ANCHOR, CYCLES, OBS, cycles, observations, query, table
from tilth.plans.rollups import _SERIES, _series

_D = f"CAST(day - DATE '{ANCHOR}' AS INTEGER)"


def _numbered(spark, sf_dir):
    return observations(spark, sf_dir).withColumn("d", F.datediff("day", F.lit(ANCHOR).cast("date")))


@query(f"""WITH {OBS}, v AS (SELECT parcel_id, count(signal) AS n, max(signal) AS peak, count(*) FILTER (cloud >= 80) >= 4 AS wet, count(*) FILTER (cloud <= 10) >= 4 AS hot, count(*) FILTER (sensor = 'error') >= 2 AS event FROM obs GROUP BY 1),
s AS (SELECT *, CAST(wet AS INTEGER) + CAST(hot AS INTEGER) + CAST(event AS INTEGER) AS signals FROM v)
SELECT parcel_id, signals, CASE WHEN n >= 4 THEN signals > 0 END AS tested, CASE WHEN n >= 4 THEN round(peak, 9) END AS peak, CASE WHEN n >= 4 AND signals > 0 THEN round(least(100.0, greatest(0.0, (peak - 0.30) / 0.40 * 100)), 8) END AS score FROM s""")
def resilience(spark, sf_dir):
    """Peak vigour under stress; untested without a stress signal, nothing under four looks."""
    v = observations(spark, sf_dir).groupBy("parcel_id").agg(
        F.count("signal").alias("n"),
        F.max("signal").alias("peak"),
        *[(F.count_if(test) >= k).cast("int").alias(name) for name, test, k in (("wet", F.col("cloud") >= 80, 4), ("hot", F.col("cloud") <= 10, 4), ("event", F.col("sensor") == "error", 2))],
    )
    signals, enough = F.col("wet") + F.col("hot") + F.col("event"), F.col("n") >= 4
    score = F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), (F.col("peak") - 0.30) / 0.40 * 100)), 8)
    return v.select("parcel_id", signals.alias("signals"), F.when(enough, signals > 0).alias("tested"), F.when(enough, F.round("peak", 9)).alias("peak"), F.when(enough & (signals > 0), score).alias("score"))


@query(f"""WITH {_SERIES}, w AS (SELECT *, max(CASE WHEN v < 0.35 THEN 1 ELSE 0 END) OVER (PARTITION BY parcel_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was_bare, lead(v) OVER (PARTITION BY parcel_id ORDER BY d) AS nxt FROM e)
SELECT parcel_id, min(d) AS emerged FROM w WHERE was_bare = 1 AND v >= 0.45 AND nxt >= 0.45 GROUP BY 1""")
def radar_emergence(spark, sf_dir):
    """The first of two looks in a row with a canopy, once the ground has been seen bare."""
    by = Window.partitionBy("parcel_id").orderBy("d")
    bare = F.max((F.col("v") < 0.35).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    w = _series(spark, sf_dir).withColumns({"bare": bare, "after": F.lead("v").over(by)})
    return w.where("bare = 1 AND v >= 0.45 AND after >= 0.45").groupBy("parcel_id").agg(F.min("d").alias("emerged"))


@query(f"""WITH {_SERIES}, m AS (SELECT parcel_id, count(*) AS n, max(v) AS top, min(v) AS low, stddev_pop(v) / greatest(avg(v), 0.01) AS cv, avg(CASE WHEN v > 0.35 THEN 1.0 ELSE 0.0 END) AS green FROM e GROUP BY 1)
SELECT parcel_id, round(least(35.0, top / 0.75 * 35) + least(25.0, (top - low) / 0.4 * 25) + least(20.0, cv / 0.35 * 20) + least(20.0, green * 25), 8) AS strength FROM m WHERE n >= 3""")
def cultivation_signal(spark, sf_dir):
    """Peak 35, rise 25, variation 20 and green share 20 points."""
    most = lambda points, x: F.least(F.lit(points), x)
    m = _series(spark, sf_dir).groupBy("parcel_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("v").alias("top"), F.min("v").alias("low"), (F.stddev_pop("v") / F.greatest(F.avg("v"), F.lit(0.01))).alias("cv"), F.avg(F.when(F.col("v") > 0.35, 1.0).otherwise(0.0)).alias("green")
    )
    score = most(35.0, F.col("top") / 0.75 * 35) + most(25.0, (F.col("top") - F.col("low")) / 0.4 * 25) + most(20.0, F.col("cv") / 0.35 * 20) + most(20.0, F.col("green") * 25)
    return m.where("n >= 3").select("parcel_id", F.round(score, 8).alias("strength"))


@query(f"""WITH {CYCLES}, a AS (SELECT cycle_id, sown, days, DATE '1995-03-01' AS today FROM cycles WHERE sown <= DATE '1995-03-01' AND harvested > DATE '1995-03-01')
SELECT cycle_id, round((today - sown) / CAST(days AS DOUBLE), 9) AS tau, CASE WHEN (today - sown) / CAST(days AS DOUBLE) < 0.2 THEN 'emergence' WHEN (today - sown) / CAST(days AS DOUBLE) < 0.5 THEN 'growth' WHEN (today - sown) / CAST(days AS DOUBLE) < 0.8 THEN 'peak' ELSE 'ripening' END AS stage, CAST(days - (today - sown) AS INTEGER) AS days_left FROM a""")
def season_progress(spark, sf_dir):
    """How far the cycles that stand on a day have come."""
    today = F.lit("1995-03-01").cast("date")
    gone = F.datediff(today, "sown")
    tau = gone / F.col("days").cast("double")
    stage = F.when(tau < 0.2, "emergence").when(tau < 0.5, "growth").when(tau < 0.8, "peak").otherwise("ripening")
    standing = cycles(spark, sf_dir).where((F.col("sown") <= today) & (F.col("harvested") > today))
    return standing.select("cycle_id", F.round(tau, 9).alias("tau"), stage.alias("stage"), (F.col("days") - gone).alias("days_left"))


@query(f"""WITH {OBS}, z AS (SELECT parcel_id, quantile_cont(signal, 0.75) AS p75 FROM obs GROUP BY 1), s AS (SELECT o.parcel_id, {_D} AS d, signal, cloud, (signal - p75) / nullif(p75, 0) * CASE WHEN {_D} >= 25 THEN 0.5 ELSE 1 END AS dev FROM obs o JOIN z USING (parcel_id) WHERE signal IS NOT NULL)
SELECT parcel_id, count(*) AS looks, round(avg(CASE WHEN dev < -0.3 THEN 1.0 ELSE 0.0 END), 9) AS stressed_share, CASE WHEN avg(CASE WHEN dev < -0.3 THEN cloud END) > avg(CASE WHEN dev >= -0.3 THEN cloud END) + 5 THEN 'wet' WHEN avg(CASE WHEN dev < -0.3 THEN cloud END) < avg(CASE WHEN dev >= -0.3 THEN cloud END) - 5 THEN 'dry' WHEN avg(CASE WHEN dev < -0.3 THEN cloud END) IS NOT NULL THEN 'other' ELSE 'none' END AS kind FROM s GROUP BY 1""")
def stress_points(spark, sf_dir):
    """Looks far under the zone's own upper quartile, counted half late in the season, typed by what else differs then."""
    o = _numbered(spark, sf_dir)
    z = o.groupBy("parcel_id").agg(F.percentile("signal", F.lit(0.75)).alias("p75"))
    dev = F.try_divide(F.col("signal") - F.col("p75"), F.col("p75")) * F.when(F.col("d") >= 25, 0.5).otherwise(1)
    s = o.where("signal IS NOT NULL").join(z, "parcel_id").withColumn("bad", dev < -0.3)
    bad, good = F.avg(F.when(F.col("bad"), F.col("cloud"))), F.avg(F.when(~F.col("bad"), F.col("cloud")))
    kind = F.when(bad > good + 5, "wet").when(bad < good - 5, "dry").when(bad.isNotNull(), "other").otherwise("none")
    return s.groupBy("parcel_id").agg(F.count(F.lit(1)).alias("looks"), F.round(F.avg(F.when(F.col("bad"), 1.0).otherwise(0.0)), 9).alias("stressed_share"), kind.alias("kind"))


@query("""WITH j AS (SELECT o_orderkey, o_orderstatus, o_orderdate, max(o_orderdate) OVER () AS now FROM orders)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate < now - INTERVAL 45 DAY THEN 'FAILED' ELSE CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'F' THEN 'DONE' ELSE 'QUEUED' END END AS status, CASE WHEN o_orderstatus = 'O' AND o_orderdate < now - INTERVAL 45 DAY THEN 'timed_out_reaped' END AS error FROM j""")
def reaped_jobs(spark, sf_dir):
    """Jobs that have run for too long as of the log's last time fail; the last time is one row."""
    o = table(spark, sf_dir, "orders")
    late = F.col("o_orderdate") < F.col("now") - F.expr("INTERVAL 45 DAYS")
    stuck = (F.col("o_orderstatus") == "O") & late
    status = F.when(stuck, "FAILED").when(F.col("o_orderstatus") == "O", "RUNNING").when(F.col("o_orderstatus") == "F", "DONE").otherwise("QUEUED")
    return o.crossJoin(o.agg(F.max("o_orderdate").alias("now"))).select("o_orderkey", status.alias("status"), F.when(stuck, "timed_out_reaped").alias("error"))


@query(f"""WITH {CYCLES}, peak AS (SELECT parcel_id, year(sown + CAST(days // 2 AS INTEGER)) AS year, arg_max(cycle_id, (area_ha, cycle_id)) AS cycle_id FROM cycles GROUP BY 1, 2)
SELECT cycle_id, parcel_id, CAST(year AS INTEGER) AS year, vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value FROM peak JOIN embeddings ON vec_id = parcel_id * 7 % 500 + (year - 1992)""")
def embedding_of_year(spark, sf_dir):
    """The calendar year of the cycle's peak selects the vector."""
    peak_year = F.year(F.date_add("sown", F.floor(F.col("days") / 2).cast("int")))
    peak = cycles(spark, sf_dir).groupBy("parcel_id", peak_year.alias("year")).agg(F.max_by("cycle_id", F.struct("area_ha", "cycle_id")).alias("cycle_id"))
    e = table(spark, sf_dir, "embeddings")
    joined = peak.join(e, F.col("vec_id") == F.col("parcel_id") * 7 % 500 + (F.col("year") - 1992))
    return joined.select("cycle_id", "parcel_id", "year", "vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_value"))


_REGIONS = (("coast", 18.0, 19.5, 74.0, 75.0), ("plateau", 18.0, 21.0, 75.0, 77.0), ("plain", 19.5, 22.0, 74.0, 78.0))


@query(f"""WITH p AS (SELECT s_suppkey AS id, s_nationkey AS hint, 18 + (s_suppkey * 37 % 400) / 100.0 AS lat, 74 + (s_suppkey * 53 % 400) / 100.0 AS lon FROM supplier)
SELECT id, CASE {' '.join(f"WHEN lat >= {a} AND lat < {b} AND lon >= {c} AND lon < {d} THEN '{n}'" for n, a, b, c, d in _REGIONS)} WHEN hint < 5 THEN 'plateau' ELSE 'unknown' END AS region FROM p""")
def ecoregion(spark, sf_dir):
    """The first rectangle that holds the point, else a hint, else unknown."""
    k = F.col("s_suppkey")
    p = table(spark, sf_dir, "supplier").select(k.alias("id"), F.col("s_nationkey").alias("hint"), (18 + k * 37 % 400 / 100.0).alias("lat"), (74 + k * 53 % 400 / 100.0).alias("lon"))
    name = F.lit("unknown")
    name = F.when(F.col("hint") < 5, "plateau").otherwise(name)
    for region, south, north, west, east in reversed(_REGIONS):
        name = F.when((F.col("lat") >= south) & (F.col("lat") < north) & (F.col("lon") >= west) & (F.col("lon") < east), region).otherwise(name)
    return p.select("id", name.alias("region"))


@query(f"""WITH {OBS}, m AS (SELECT parcel_id, count(signal) AS n, count(*) AS looks, max(signal) AS top, avg(signal) AS mean FROM obs GROUP BY 1)
SELECT parcel_id, CASE WHEN n < 5 OR n < 0.3 * looks THEN 'sparse record' WHEN top < 0.45 THEN 'fallow' WHEN mean > 0.6 THEN 'tree cover' ELSE 'other' END AS named FROM m WHERE parcel_id NOT IN (SELECT parcel_id FROM obs WHERE signal >= 0.70)""")
def fields_without_cycle(spark, sf_dir):
    """What to call a parcel on which no cycle stands out."""
    o = observations(spark, sf_dir)
    cycled = o.where("signal >= 0.70").select("parcel_id").distinct()
    m = o.join(cycled, "parcel_id", "left_anti").groupBy("parcel_id").agg(F.count("signal").alias("n"), F.count(F.lit(1)).alias("looks"), F.max("signal").alias("top"), F.avg("signal").alias("mean"))
    sparse = (F.col("n") < 5) | (F.col("n") < 0.3 * F.col("looks"))
    return m.select("parcel_id", F.when(sparse, "sparse record").when(F.col("top") < 0.45, "fallow").when(F.col("mean") > 0.6, "tree cover").otherwise("other").alias("named"))


@query("""WITH a AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, o_orderpriority AS version FROM orders), now AS (SELECT o_custkey, arg_max(version, (o_orderdate, o_orderkey)) AS version, max(o_orderdate) AS at_time FROM a GROUP BY 1)
SELECT a.o_custkey, arg_max(a.o_orderkey, (a.o_orderdate, a.o_orderkey)) AS baseline, count(*) AS others FROM a JOIN now USING (o_custkey) WHERE a.version <> now.version GROUP BY 1""")
def baseline_assessment(spark, sf_dir):
    """The latest assessment that used another signal version than the present one."""
    a = table(spark, sf_dir, "orders")
    at = F.struct("o_orderdate", "o_orderkey")
    now = a.groupBy("o_custkey").agg(F.max_by("o_orderpriority", at).alias("version"))
    return a.join(now, "o_custkey").where("o_orderpriority <> version").groupBy("o_custkey").agg(F.max_by("o_orderkey", at).alias("baseline"), F.count(F.lit(1)).alias("others"))


@query("""WITH k AS (SELECT s_suppkey AS id FROM supplier WHERE s_nationkey < 5), u AS (
SELECT o_custkey AS id, 'orders' AS kind, o_orderkey AS item, o_orderdate AS at_time FROM orders WHERE o_custkey IN (SELECT id FROM k) OR o_orderpriority LIKE '1%'
UNION ALL SELECT l_suppkey, 'lineitem', l_orderkey * 10 + l_linenumber, l_shipdate FROM lineitem WHERE l_suppkey IN (SELECT id FROM k)
UNION ALL SELECT user_id, 'events', event_id, ts FROM events WHERE user_id IN (SELECT id FROM k) OR regexp_matches(props, '"k": 7'))
SELECT id, kind, item FROM (SELECT *, row_number() OVER (PARTITION BY id, kind ORDER BY at_time DESC, item DESC) AS r FROM u) WHERE r <= 10""")
def correlated_records(spark, sf_dir):
    """Records of three logs that name one of the keys asked for or match a raw pattern, the ten newest of each log and key."""
    keys = table(spark, sf_dir, "supplier").where("s_nationkey < 5").select(F.col("s_suppkey").alias("id")).distinct().withColumn("asked", F.lit(True))

    def of(name: str, key: str, item: Column, at: str, pattern: Column):
        rows = table(spark, sf_dir, name).select(F.col(key).alias("id"), F.lit(name).alias("kind"), item.alias("item"), F.col(at).alias("at_time"), pattern.alias("like"))
        return rows.join(keys, "id", "left").where("asked OR like").drop("asked", "like")

    every = of("orders", "o_custkey", F.col("o_orderkey"), "o_orderdate", F.col("o_orderpriority").startswith("1"))
    every = every.unionByName(of("lineitem", "l_suppkey", F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_shipdate", F.lit(False)))
    every = every.unionByName(of("events", "user_id", F.col("event_id"), "ts", F.col("props").rlike('"k": 7')))
    newest = F.row_number().over(Window.partitionBy("id", "kind").orderBy(F.desc("at_time"), F.desc("item")))
    return every.withColumn("r", newest).where("r <= 10").select("id", "kind", "item")


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-03-31' AND l_quantity >= 20 AND l_quantity <= 30""")
def pruned_box_scan(spark, sf_dir):
    """A box of two ranges over three columns of many; both ranges reach the scan, which skips row groups by them."""
    box = F.col("l_shipdate").between(F.to_timestamp_ntz(F.lit("1995-01-01 00:00:00")), F.to_timestamp_ntz(F.lit("1995-03-31 00:00:00"))) & (F.col("l_quantity") >= 20) & (F.col("l_quantity") <= 30)
    return table(spark, sf_dir, "lineitem").where(box).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("""WITH r AS (SELECT o_custkey, o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1, 2), a AS (SELECT c_nationkey, k, sum(n) AS n FROM r JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT c_nationkey, string_agg(replace(replace(k, '.', '_'), '$', '_') || '=' || CAST(n AS BIGINT), ';' ORDER BY k) AS merged, arg_max(k, (n, k)) AS leading FROM a GROUP BY 1""")
def merged_count_maps(spark, sf_dir):
    """Count maps of holders merged by place: keys made safe, values added, the leading key picked from the map."""
    per = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    maps = per.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias("counts"))
    joined = maps.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", F.explode("counts").alias("k", "n"))
    added = joined.groupBy("c_nationkey", "k").agg(F.sum("n").alias("n"))
    merged = added.groupBy("c_nationkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("m"))
    safe = F.transform_keys("m", lambda k, n: F.regexp_replace(k, r"[.$]", "_"))
    text = F.array_join(F.transform(F.map_entries(safe), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";")
    leading = F.array_max(F.transform(F.map_entries("m"), lambda e: F.struct(e["value"], e["key"])))["key"]
    return merged.select("c_nationkey", text.alias("merged"), leading.alias("leading"))
