"""Queries of records on their way in and out."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from tilth.operators import records
from tilth.plans.base import CYCLES, WEATHER, cycles, query, table, weather
from tilth.plans.zoning import _LOOKS, pixel_looks
from tilth.sources.files import alive
from tilth.sources.shared import shared_dir


@query(f"""WITH {_LOOKS}, size AS (SELECT field_id, count(DISTINCT pixel_id) AS n FROM px GROUP BY 1)
SELECT field_id, day, round(avg(ndvi), 9) AS ndvi, round(avg(CASE WHEN ndvi IS NOT NULL THEN rvi END), 9) AS rvi, round(count(ndvi) / CAST(any_value(n) AS DOUBLE), 9) AS clear_share FROM px JOIN size USING (field_id) GROUP BY 1, 2""")
def field_zonal_means(spark, sf_dir):
    """A field's mean index a day over its clear pixels, and their share."""
    by = records.field_means(pixel_looks(spark, sf_dir), ["ndvi", "rvi"])
    return by.select("field_id", "day", *[F.round(c, 9).alias(c) for c in ("ndvi", "rvi", "clear_share")])


@query(f"""WITH {_LOOKS} SELECT field_id AS zone_id, day, round(avg(ndvi) FILTER (sensor = 's2'), 9) AS ndvi, round(avg(rvi) FILTER (sensor = 's1'), 9) AS rvi, CASE WHEN bool_or(sensor = 's2') THEN 'optical' ELSE 'radar' END AS kind FROM px GROUP BY 1, 2""")
def zone_observations(spark, sf_dir):
    """A zone's looks a day, optical ones before radar."""
    by = records.zone_views(pixel_looks(spark, sf_dir).withColumnRenamed("field_id", "zone_id"), ["ndvi", "rvi"])
    return by.select("zone_id", "day", F.round("ndvi", 9).alias("ndvi"), F.round("rvi", 9).alias("rvi"), "kind")


@query(f"""WITH {CYCLES}, {WEATHER}, c AS (SELECT DISTINCT cycle_id || '-' || parcel_id || '-' || sown || '-' || days AS cycle_id, s_nationkey AS cell, sown, harvested, days FROM cycles JOIN supplier ON s_suppkey = parcel_id),
d AS (SELECT cell, day, rain, 20 + (dayofyear(day) % 50) / 5.0 AS t, CAST(40 + rain AS DOUBLE) AS humidity FROM weather)
SELECT cycle_id, round(sum(rain), 8) AS rain, round(sum(rain) / greatest(any_value(days) * 3.5, 1) * 100, 8) AS rain_share, round(avg(t), 8) AS t, round(max(t + 6), 8) AS t_max, round(min(t - 7), 8) AS t_min, round(avg(humidity), 8) AS humidity FROM c LEFT JOIN d ON d.cell = c.cell AND day BETWEEN sown AND harvested GROUP BY 1""")
def cycle_statistics(spark, sf_dir):
    """Each cycle's rain against what its length expects, and its temperatures."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("parcel_id"), F.col("s_nationkey").alias("cell"))
    named = F.concat_ws("-", "cycle_id", "parcel_id", "sown", "days")  # an order's line may come twice
    grown = cycles(spark, sf_dir).join(supplier, "parcel_id").select(named.alias("cycle_id"), "cell", "sown", "harvested", "days").distinct()
    t = 20 + (F.dayofyear("day") % 50) / 5.0
    days = weather(spark, sf_dir).withColumns({"t": t, "t_max": t + 6, "t_min": t - 7, "humidity": 40 + F.col("rain"), "wind": F.lit(None).cast("double")})
    out = records.cycle_weather(grown, days)
    return out.select("cycle_id", F.round("rain", 8).alias("rain"), F.round("rain_share", 8).alias("rain_share"), *[F.round(c, 8).alias(c) for c in ("t", "t_max", "t_min", "humidity")])


@query("""WITH p AS (SELECT s_suppkey AS id, 74 + (s_suppkey * 53 % 400) / 100.0 AS lon, CASE WHEN s_suppkey % 17 = 0 THEN 45.0 ELSE 18 + (s_suppkey * 37 % 400) / 100.0 END AS lat, CASE WHEN s_suppkey % 9 = 0 THEN 0.00002 ELSE 0.001 + (s_suppkey % 5) / 4000.0 END AS w, 0.0012 + (s_suppkey % 7) / 5000.0 AS h, s_suppkey % 13 = 0 AS none, s_suppkey % 11 = 0 AS open_ FROM supplier),
q AS (SELECT *, lat + CASE WHEN open_ THEN 0.5 ELSE 0.4 END * h AS lat0, abs(w * 111320.0 * cos(radians(lat + CASE WHEN open_ THEN 0.5 ELSE 0.4 END * h))) AS wide, h * 111320.0 AS high, CASE WHEN id % 6 = 0 THEN NULL ELSE 0.2 + (id % 10) / 4.0 END AS registered FROM p),
a AS (SELECT *, CASE WHEN NOT none THEN CASE WHEN open_ THEN abs((lon * (lat + h) - lon * lat) + ((lon + w) * lat - (lon + w) * (lat + h)) + (lon * (lat) - (lon) * lat)) ELSE w * h END END AS raw FROM q),
b AS (SELECT *, CASE WHEN none THEN NULL WHEN open_ THEN abs(lon * lat - (lon + w) * lat + (lon + w) * (lat + h) - (lon + w) * lat + (lon + w) * (lat + h) - lon * (lat + h)) ELSE 2 * w * h END / 2 * 111320.0 * cos(radians(lat0)) * 110540.0 / 10000 AS area FROM a),
c AS (SELECT *, CASE WHEN none THEN NULL ELSE greatest(wide, high) / least(wide, high) END AS elong, CASE WHEN area > 0 AND registered > 0 THEN area / registered END AS ratio, CASE WHEN NOT none THEN floor(coalesce(nullif(area, 0), registered, 0) / 0.01) END AS pixels FROM b)
SELECT id, round(area, 4) AS area_ha, round(elong, 4) AS elongation, round(ratio, 4) AS area_ratio, CAST(pixels AS BIGINT) AS pixels, array_to_string(list_filter([CASE WHEN none THEN 'no_geometry' END, CASE WHEN NOT none AND (open_ OR area < 0.0001) THEN 'degenerate' END, CASE WHEN elong > 12 THEN 'suspicious_shape' END,
  CASE WHEN ratio < 0.5 OR ratio > 2 THEN 'area_mismatch_severe' END, CASE WHEN ratio >= 0.5 AND ratio < 0.8 OR ratio > 1.25 AND ratio <= 2 THEN 'area_mismatch' END, CASE WHEN pixels < 12 THEN 'tiny_parcel' END, CASE WHEN lat > 38 THEN 'out_of_india' END], lambda x: x IS NOT NULL), ',') AS flags FROM c""")
def geometry_audit(spark, sf_dir):
    """Parcels whose outline is missing, broken, too thin, too small, off its registered area or out of place."""
    k = F.col("s_suppkey")
    lon, lat = 74 + (k * 53 % 400) / 100.0, F.when(k % 17 == 0, 45.0).otherwise(18 + (k * 37 % 400) / 100.0)
    w, h = F.when(k % 9 == 0, 0.00002).otherwise(0.001 + (k % 5) / 4000.0), 0.0012 + (k % 7) / 5000.0
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    corners = [point(lon, lat), point(lon + w, lat), point(lon + w, lat + h), point(lon, lat + h)]
    ring = F.when(k % 13 == 0, F.lit(None)).when(k % 11 == 0, F.array(*corners)).otherwise(F.array(*corners, corners[0]))
    parcels = table(spark, sf_dir, "supplier").select(k.alias("id"), ring.alias("ring"), F.when(k % 6 != 0, 0.2 + (k % 10) / 4.0).alias("registered_ha"), lat.alias("lat"), lon.alias("lon"))
    out = records.audited(parcels)
    return out.select("id", F.round("area_ha", 4).alias("area_ha"), F.round("elongation", 4).alias("elongation"), F.round("area_ratio", 4).alias("area_ratio"), "pixels", "flags")


@query("""SELECT c_custkey AS field_id, CASE WHEN c_custkey % 10 = 0 THEN 'crop_unknown' WHEN c_custkey % 10 = 1 THEN 'phenology_disagrees' WHEN c_custkey % 7 = 0 THEN 'insufficient_evidence' WHEN c_mktsegment = 'FURNITURE' THEN 'intercrop'
  WHEN c_mktsegment = 'BUILDING' AND c_nationkey % 3 <> 0 AND c_nationkey % 5 <> 0 AND c_custkey % 7 <> 6 AND c_custkey % 4 <> 0 THEN 'confirmed' ELSE 'provisional' END AS status FROM customer""")
def record_status(spark, sf_dir):
    """Confirmed only where classifier, curve, season and sowing agree."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    flags = F.when(k % 10 == 0, F.array(F.lit("crop_unknown"))).when(k % 10 == 1, F.array(F.lit("phenology_disagrees_with_class"))).otherwise(F.array().cast("array<string>"))
    season = F.when(k % 7 == 0, "no_data").when(k % 7 == 6, "green_at_start").otherwise("ok")
    given = F.when(F.col("c_mktsegment") == "FURNITURE", "intercrop").when(F.col("c_mktsegment") == "BUILDING", "confirmed").otherwise("provisional")
    sowing = F.when(k % 4 == 0, "none").when(k % 4 == 1, "estimated").otherwise("provided")
    return table(spark, sf_dir, "customer").select(k.alias("field_id"), records.status(flags, season, given, n % 3 != 0, n % 5 == 0, sowing).alias("status"))


def _place(spark, sf_dir: str, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{spark.sparkContext.applicationId}-{zlib.crc32(sf_dir.encode())}"


@query("""SELECT 'field' AS part, CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 8 = 0 THEN 'Unclassified' ELSE c_mktsegment END AS crop, printf('%.4f', c_custkey % 400 / 20.0) AS area_ha, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'a "' || c_name || '", again' END AS note FROM customer
UNION ALL SELECT 'summary', CAST(count(*) AS VARCHAR), CASE WHEN c_custkey % 8 = 0 THEN 'Unclassified' ELSE c_mktsegment END, printf('%.3f', sum(c_custkey % 400 / 20.0)), NULL FROM customer GROUP BY 3""")
def csv_round_trip(spark, sf_dir):
    """Fields and their summary written as CSV and read back as text."""
    k = F.col("c_custkey")
    fields = table(spark, sf_dir, "customer").select(
        k.alias("field_id"), F.when(k % 8 != 0, F.col("c_mktsegment")).alias("crop"), (k % 400 / 20.0).alias("area_ha"), F.lit(0.5).alias("confidence"), F.lit(74.0).alias("lon"), F.lit(18.0).alias("lat"),
        F.when(k % 5 != 0, F.concat(F.lit('a "'), "c_name", F.lit('", again'))).alias("note"),
    )
    one, two = records.exported(fields, _place(spark, sf_dir, "export"))
    rows = records.imported(spark, one, ["field_id", "crop", "area_ha", "note"]).select(F.lit("field").alias("part"), F.col("field_id").alias("key"), "crop", "area_ha", "note")
    summary = records.imported(spark, two, ["crop", "field_count"]).select(F.lit("summary").alias("part"), F.col("field_count").alias("key"), "crop", "area_ha", F.lit(None).cast("string").alias("note"))
    return rows.unionByName(summary)


_BOTH = """old AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS at_day FROM orders WHERE o_orderkey % 3 <> 0),
new AS (SELECT o_orderkey AS k, -o_custkey AS c, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 - 2 AS INTEGER) AS at_day FROM orders WHERE o_orderkey % 4 <> 0)"""


def _versions(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    old = o.where(k % 3 != 0).select(k.alias("k"), F.col("o_custkey").alias("c"), day.alias("at_day"))
    return old, o.where(k % 4 != 0).select(k.alias("k"), (-F.col("o_custkey")).alias("c"), F.date_add(day, (k % 5 - 2).cast("int")).alias("at_day"))


@query(f"WITH {_BOTH} SELECT k, CASE WHEN n.k IS NOT NULL AND (o.k IS NULL OR n.at_day >= o.at_day) THEN n.c ELSE o.c END AS c, CASE WHEN n.k IS NOT NULL AND (o.k IS NULL OR n.at_day >= o.at_day) THEN n.at_day ELSE o.at_day END AS at_day FROM old o FULL JOIN new n USING (k)")
def upserted_rows(spark, sf_dir):
    """Two versions of a table with the later row of each key, the new one among equals."""
    return records.ingested(*_versions(spark, sf_dir), ["k"], "at_day")[0]


@query(f"WITH {_BOTH} SELECT count(*) FILTER (n.k IS NOT NULL AND o.k IS NULL) AS inserted, count(*) FILTER (n.k IS NOT NULL AND o.k IS NOT NULL) AS replaced, count(*) FILTER (n.k IS NULL) AS kept FROM old o FULL JOIN new n ON n.k = o.k")
def upsert_counts(spark, sf_dir):
    """How many keys an upsert inserts, replaces and keeps."""
    return records.ingested(*_versions(spark, sf_dir), ["k"], "at_day")[1]


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 6 = 0 OR o_orderdate + INTERVAL 90 DAY > TIMESTAMP '1995-06-01'")
def unexpired(spark, sf_dir):
    """Rows whose time to live has not run out on a day; those without one stay."""
    expires = F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 90 DAYS"))
    return alive(table(spark, sf_dir, "orders").withColumn("expires", expires), "expires", F.lit("1995-06-01").cast("timestamp")).select("o_orderkey", "o_custkey")
