"""Queries of ingest, keys, fallbacks, counters, ordered samples and signal preparation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tilth.operators import evaluation, series
from tilth.plans.base import ANCHOR, CYCLES, OBS, WEATHER, cycles, observations, query, table, weather
from tilth.plans.observed import GRID, best


@query(f"""WITH {WEATHER}, s AS (SELECT cell, day, CASE WHEN cell % 3 <> 0 THEN rain END AS a, CASE WHEN day >= DATE '1998-01-01' THEN rain * 1.1 END AS b, rain * 0.9 AS c FROM weather)
SELECT cell, CASE WHEN a IS NOT NULL THEN 'first' WHEN b IS NOT NULL THEN 'second' ELSE 'third' END AS source, count(*) AS days, round(avg(coalesce(a, b, c)), 4) AS mean_rain FROM s GROUP BY 1, 2""")
def weather_fallback(spark, sf_dir):
    """Sources in order of priority, each filling only what those before lack."""
    a, b = F.when(F.col("cell") % 3 != 0, F.col("rain")), F.when(F.col("day") >= F.lit("1998-01-01").cast("date"), F.col("rain") * 1.1)
    s = weather(spark, sf_dir).select("cell", a.alias("a"), b.alias("b"), (F.col("rain") * 0.9).alias("c"))
    source = F.when(F.col("a").isNotNull(), "first").when(F.col("b").isNotNull(), "second").otherwise("third")
    return s.groupBy("cell", source.alias("source")).agg(F.count(F.lit(1)).alias("days"), F.round(F.avg(F.coalesce("a", "b", "c")), 4).alias("mean_rain"))


@query("""WITH k AS (SELECT c_custkey, coalesce(CASE WHEN c_custkey % 5 = 0 THEN 'plot-' || c_custkey // 10 END, CASE WHEN c_custkey % 3 = 0 THEN 'farm-' || c_custkey END, 'print-' || substr(sha1(c_name), 1, 10)) AS key, substr(sha1(c_name), 1, 6) AS mark FROM customer)
SELECT c_custkey, CASE WHEN count(*) OVER (PARTITION BY key) > 1 THEN key || '~' || mark ELSE key END AS plot_key FROM k""")
def stable_keys(spark, sf_dir):
    key = F.col("c_custkey")
    k = F.coalesce(F.when(key % 5 == 0, F.concat(F.lit("plot-"), F.floor(key / 10).cast("string"))), F.when(key % 3 == 0, F.concat(F.lit("farm-"), key.cast("string"))), F.concat(F.lit("print-"), F.substring(F.sha1("c_name"), 1, 10)))
    rows = table(spark, sf_dir, "customer").select("c_custkey", k.alias("k"), F.substring(F.sha1("c_name"), 1, 6).alias("mark"))
    shared = F.count(F.lit(1)).over(Window.partitionBy("k")) > 1
    return rows.select("c_custkey", F.when(shared, F.concat_ws("~", "k", "mark")).otherwise(F.col("k")).alias("plot_key"))


@query("""WITH w AS (SELECT c_custkey, c_mktsegment, ln((CAST(concat('0x', substr(sha256('pps|' || c_custkey), 1, 12)) AS BIGINT) + 1) / 281474976710657.0) / greatest(abs(c_acctbal), 1) AS key FROM customer)
SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY key DESC, c_custkey) AS r FROM w) WHERE r <= 25""")
def pps_sample(spark, sf_dir):
    """Without replacement, in proportion to size: the 25 largest log(u) / weight of each stratum."""
    u = (F.conv(F.substring(evaluation.seeded_order("pps", "c_custkey"), 1, 12), 16, 10).cast("long") + 1) / F.lit(281474976710657.0)
    rows = table(spark, sf_dir, "customer").withColumn("key", F.ln(u) / F.greatest(F.abs("c_acctbal"), F.lit(1.0)))
    return evaluation.top_per_group(rows, ["c_mktsegment"], 25, F.desc("key"), F.col("c_custkey")).select("c_custkey", "c_mktsegment")


@query("""SELECT CAST(row_number() OVER (ORDER BY sha256('order|' || s_suppkey), s_suppkey) AS INTEGER) AS n, s_suppkey, 'S' || lpad(CAST(row_number() OVER (ORDER BY sha256('order|' || s_suppkey), s_suppkey) AS VARCHAR), 4, '0') AS sample_id FROM supplier""")
def shuffled_ids(spark, sf_dir):
    """A seeded permutation of the suppliers, numbered within ranges of the hash and by the ranges' running counts."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", evaluation.seeded_order("order", "s_suppkey").alias("key"))
    return evaluation.numbered_by_hash(rows, "key", "s_suppkey", "n").select(F.col("n").cast("int").alias("n"), "s_suppkey").withColumn("sample_id", F.concat(F.lit("S"), F.lpad(F.col("n").cast("string"), 4, "0")))


@query("""SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS scored, count(*) FILTER (l_shipdate < TIMESTAMP '1995-06-01') AS skipped, count(*) FILTER (starts_with(l_returnflag, 'R')) AS failed FROM lineitem GROUP BY 1""")
def plot_counters(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("scored"), F.count_if(F.col("l_shipdate") < F.to_timestamp_ntz(F.lit("1995-06-01 00:00:00"))).alias("skipped"), F.count_if(F.startswith("l_returnflag", F.lit("R"))).alias("failed"))


@query("""SELECT o_orderstatus, count(*) AS jobs, min(o_orderdate)::DATE AS oldest, CAST(DATE '2001-12-31' - min(o_orderdate)::DATE AS INTEGER) AS oldest_days FROM orders GROUP BY 1""")
def jobs_health(spark, sf_dir):
    by = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("jobs"), F.min(F.col("o_orderdate").cast("date")).alias("oldest"))
    return by.withColumn("oldest_days", F.datediff(F.lit("2001-12-31").cast("date"), "oldest"))


@query("""WITH p AS (SELECT o_custkey, to_json({'farmer': o_custkey, 'lands': list({'id': o_orderkey, 'area': o_totalprice} ORDER BY o_orderkey)}) AS payload FROM orders GROUP BY 1), l AS (SELECT o_custkey, unnest(from_json(json_extract(payload, '$.lands'), '[{"id":"BIGINT","area":"DOUBLE"}]')) AS land FROM p)
SELECT o_custkey AS farmer, count(*) AS plots, round(sum(land.area), 2) AS area, arg_max(land.id, (land.area, -land.id)) AS largest FROM l GROUP BY 1""")
def nested_payload(spark, sf_dir):
    """A payload of nested lands as JSON text, read back, unwound, and the largest plot kept."""
    lands = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("area"))))
    payload = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.col("o_custkey").alias("farmer"), lands.alias("lands"))).alias("payload"))
    read = payload.select(F.from_json("payload", "farmer long, lands array<struct<id:long,area:double>>").alias("p")).select("p.farmer", F.explode_outer("p.lands").alias("land"))
    return read.groupBy("farmer").agg(F.count(F.lit(1)).alias("plots"), F.round(F.sum("land.area"), 2).alias("area"), F.max_by("land.id", F.struct("land.area", -F.col("land.id"))).alias("largest"))


@query(f"""WITH {OBS} SELECT obs_id, round((signal - min(signal) OVER w) / nullif(max(signal) OVER w - min(signal) OVER w, 0), 9) AS scaled FROM obs WINDOW w AS (PARTITION BY parcel_id)""")
def series_minmax(spark, sf_dir):
    w = Window.partitionBy("parcel_id")
    low, high = F.min("signal").over(w), F.max("signal").over(w)
    return observations(spark, sf_dir).select("obs_id", F.round(F.try_divide(F.col("signal") - low, high - low), 9).alias("scaled"))


@query(f"""WITH {GRID}, s AS (SELECT parcel_id, bin, signal AS opt, CASE WHEN sensor IN ('view', 'click') THEN cloud / 100.0 END AS sar, 1 - coalesce(cloud, 100) / 100.0 AS q FROM best),
r AS (SELECT parcel_id, count(*) FILTER (opt IS NOT NULL AND sar IS NOT NULL) AS n, regr_slope(opt, sar) AS a, regr_intercept(opt, sar) AS b FROM s GROUP BY 1)
SELECT s.parcel_id, bin, CAST(CASE WHEN opt IS NOT NULL AND (q >= 0.999 OR sar IS NULL OR n < 3) THEN 0 WHEN opt IS NOT NULL AND q > 0 THEN 1 WHEN sar IS NOT NULL AND n >= 3 THEN 2 WHEN opt IS NOT NULL THEN 0 ELSE 3 END AS INTEGER) AS source,
  round(CASE WHEN opt IS NOT NULL AND (q >= 0.999 OR sar IS NULL OR n < 3) THEN opt WHEN opt IS NOT NULL AND q > 0 THEN q * opt + (1 - q) * (a * sar + b) WHEN sar IS NOT NULL AND n >= 3 THEN a * sar + b ELSE opt END, 7) AS fused FROM s JOIN r USING (parcel_id)""")
def fused_signal(spark, sf_dir):
    """Optical and radar series joined by quality; radar is put on the optical scale by the parcel's own regression."""
    s = best(spark, sf_dir).select("parcel_id", "bin", F.col("signal").alias("opt"), F.when(F.col("sensor").isin("view", "click"), F.col("cloud") / 100.0).alias("sar"), (1 - F.coalesce("cloud", F.lit(100)) / 100.0).alias("q"))
    w = Window.partitionBy("parcel_id")
    r = s.withColumns({"n": F.count_if(F.col("opt").isNotNull() & F.col("sar").isNotNull()).over(w), "a": F.regr_slope("opt", "sar").over(w), "b": F.regr_intercept("opt", "sar").over(w)})
    opt, sar, q, enough, line = F.col("opt"), F.col("sar"), F.col("q"), F.col("n") >= 3, F.col("a") * F.col("sar") + F.col("b")
    alone, both, radar = opt.isNotNull() & ((q >= 0.999) | sar.isNull() | ~enough), opt.isNotNull() & (q > 0), sar.isNotNull() & enough
    source = F.when(alone, 0).when(both, 1).when(radar, 2).when(opt.isNotNull(), 0).otherwise(3)
    return r.select("parcel_id", "bin", source.alias("source"), F.round(F.when(alone, opt).when(both, q * opt + (1 - q) * line).when(radar, line).otherwise(opt), 7).alias("fused"))


@query(f"""WITH {CYCLES} SELECT cycle_id, (SELECT max(a) FROM (VALUES (make_date(year(sown) - 1, 10, 15)), (make_date(year(sown), 2, 15)), (make_date(year(sown), 6, 15)), (make_date(year(sown), 10, 15))) t(a) WHERE a <= sown) AS anchor FROM cycles""")
def season_anchor(spark, sf_dir):
    """The latest of the three yearly anchors that is not after the day."""
    y = F.year("sown")
    anchors = F.array(F.make_date(y - 1, F.lit(10), F.lit(15)), F.make_date(y, F.lit(2), F.lit(15)), F.make_date(y, F.lit(6), F.lit(15)), F.make_date(y, F.lit(10), F.lit(15)))
    return cycles(spark, sf_dir).select("cycle_id", F.array_max(F.filter(anchors, lambda a: a <= F.col("sown"))).alias("anchor"))


@query(f"""WITH {OBS}, n AS (SELECT sensor, cloud, obs_id, signal, day FROM obs WHERE day <= DATE '{ANCHOR}' + 14)
SELECT sensor, count(*) AS n, count(DISTINCT cloud) AS clouds, round(avg(signal), 9) AS mean_signal, max(day) AS last_day FROM n GROUP BY 1""")
def in_season_cut(spark, sf_dir):
    """As of a day: nothing after it is seen."""
    cut = observations(spark, sf_dir).where(F.col("day") <= F.date_add(F.lit(ANCHOR).cast("date"), 14))
    return cut.groupBy("sensor").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cloud").alias("clouds"), F.round(F.avg("signal"), 9).alias("mean_signal"), F.max("day").alias("last_day"))


@query("""SELECT p_brand, p_type, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_partkey) AS r FROM part) WHERE r = 1""")
def largest_per_class(spark, sf_dir):
    return series.latest(table(spark, sf_dir, "part"), ["p_brand", "p_type"], F.desc("p_size"), F.col("p_partkey")).select("p_brand", "p_type", "p_partkey", "p_size")


@query("""SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS path, count(*) FILTER (role = 'user') AS asked, CAST(sum(len(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1""")
def job_progress(spark, sf_dir):
    steps = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(steps, lambda s: s["role"]), ">").alias("path"), F.count_if(F.col("role") == "user").alias("asked"), F.sum(F.length("text").cast("long")).alias("chars"))


@query("""WITH b AS (SELECT c_nationkey, c_custkey % 8 AS block, count(*) AS n, count(DISTINCT c_mktsegment) AS classes FROM customer GROUP BY 1, 2) SELECT c_nationkey, count(*) AS blocks, count(*) FILTER (classes = 1) AS single_class, min(n) AS least, max(n) AS most FROM b GROUP BY 1""")
def block_audit(spark, sf_dir):
    b = table(spark, sf_dir, "customer").groupBy("c_nationkey", (F.col("c_custkey") % 8).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_mktsegment").alias("classes"))
    return b.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("classes") == 1).alias("single_class"), F.min("n").alias("least"), F.max("n").alias("most"))
