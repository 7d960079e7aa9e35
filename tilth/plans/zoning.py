"""Queries of zones: line items as looks at a supplier's pixels, all years laid over 1995."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.operators import zones
from tilth.plans.base import query, table


def pixel_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field_id, pixel_id, day, sensor, orbit, ndvi, rvi: pixels of two sowing days in every third field, two days of cutting
    in every fourth, some trees and some bare ground."""
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("field_id"), (F.col("l_orderkey") % 40).cast("int").alias("pixel_id"), F.dayofyear(F.col("l_shipdate").cast("date")).alias("d"),
        (F.col("l_linenumber") % 4 == 0).alias("echo"), F.when(F.col("l_linenumber") % 8 == 0, "up").otherwise("down").alias("orbit"), ((F.col("l_discount").cast("double") - 0.05) / 5).alias("noise"),
    )
    field, pixel, d = F.col("field_id"), F.col("pixel_id"), F.col("d")
    sown = 120 + F.when((field % 3 == 0) & (pixel % 40 >= 18), 60).otherwise(0)
    cut = sown + 110 + F.when((field % 4 == 1) & (pixel % 2 == 0), 55).otherwise(0)
    canopy = F.when((d < sown) | (d >= cut), 0.13).otherwise(F.least(F.lit(0.78), 0.13 + 0.015 * (d - sown)))
    green = F.when(pixel % 10 == 9, 0.65).when(pixel % 10 == 8, 0.12).otherwise(canopy) + F.col("noise")
    return line.select(
        "field_id", "pixel_id", F.date_add(F.lit("1994-12-31").cast("date"), d).alias("day"), F.when(F.col("echo"), "s1").otherwise("s2").alias("sensor"),
        F.when(F.col("echo"), F.col("orbit")).alias("orbit"), F.when(~F.col("echo"), green).alias("ndvi"), F.when(F.col("echo"), 0.2 + 0.6 * green).alias("rvi"),
    )


_LOOKS = """px0 AS (
  SELECT l_suppkey AS field_id, CAST(l_orderkey % 40 AS INTEGER) AS pixel_id, dayofyear(CAST(l_shipdate AS DATE)) AS d, l_linenumber % 4 = 0 AS echo, CASE WHEN l_linenumber % 8 = 0 THEN 'up' ELSE 'down' END AS orbit, (CAST(l_discount AS DOUBLE) - 0.05) / 5 AS noise,
    120 + CASE WHEN l_suppkey % 3 = 0 AND l_orderkey % 40 >= 18 THEN 60 ELSE 0 END AS sown FROM lineitem),
px1 AS (SELECT *, sown + 110 + CASE WHEN field_id % 4 = 1 AND pixel_id % 2 = 0 THEN 55 ELSE 0 END AS cut FROM px0),
px2 AS (SELECT *, noise + CAST(CASE WHEN pixel_id % 10 = 9 THEN 0.65 WHEN pixel_id % 10 = 8 THEN 0.12 WHEN d < sown OR d >= cut THEN 0.13 ELSE least(0.78, 0.13 + 0.015 * (d - sown)) END AS DOUBLE) AS green FROM px1),
px AS (SELECT field_id, pixel_id, DATE '1994-12-31' + CAST(d AS INTEGER) AS day, CASE WHEN echo THEN 's1' ELSE 's2' END AS sensor, CASE WHEN echo THEN orbit END AS orbit, CASE WHEN NOT echo THEN green END AS ndvi, CASE WHEN echo THEN 0.2 + 0.6 * green END AS rvi FROM px2),
clear AS (SELECT * FROM px WHERE sensor = 's2'),
kind AS (
  SELECT field_id, pixel_id, CASE WHEN n >= 3 AND low > 0.45 AND mid > 0.6 OR n >= 3 AND top < 0.18 OR n >= 2 AND top < 0.35 THEN 'non_crop' ELSE 'crop' END AS kind
  FROM (SELECT DISTINCT field_id, pixel_id FROM px) LEFT JOIN (SELECT field_id, pixel_id, count(*) AS n, min(ndvi) AS low, max(ndvi) AS top, median(ndvi) AS mid FROM clear GROUP BY 1, 2) USING (field_id, pixel_id)),
opt AS (
  SELECT field_id, pixel_id, min(day) AS optical FROM (SELECT *, lag(ndvi) OVER w AS before, lead(ndvi) OVER w AS after, lead(day) OVER w AS next_day FROM clear WINDOW w AS (PARTITION BY field_id, pixel_id ORDER BY day, ndvi))
  WHERE ndvi >= 0.35 AND (before IS NULL OR before < 0.30) AND (next_day IS NULL OR next_day - day > 40 OR after >= 0.27) GROUP BY 1, 2),
echo AS (SELECT *, row_number() OVER w AS k, lead(rvi) OVER w AS after FROM px WHERE sensor = 's1' WINDOW w AS (PARTITION BY field_id, pixel_id, orbit ORDER BY day, rvi)),
rad AS (
  SELECT field_id, pixel_id, min(day) AS radar FROM (SELECT *, avg(CASE WHEN k <= 2 THEN rvi END) OVER (PARTITION BY field_id, pixel_id, orbit) AS ground FROM echo)
  WHERE k > 2 AND rvi >= ground + 0.08 AND after >= ground + 0.05 GROUP BY 1, 2),
dated AS (
  SELECT k.field_id, k.pixel_id, kind, CASE WHEN kind = 'crop' THEN CASE WHEN abs(optical - radar) <= 21 THEN optical ELSE least(optical, radar) END END AS greenup, count(*) FILTER (kind = 'crop') OVER (PARTITION BY k.field_id) AS size
  FROM kind k LEFT JOIN opt o ON o.field_id = k.field_id AND o.pixel_id = k.pixel_id LEFT JOIN rad r ON r.field_id = k.field_id AND r.pixel_id = k.pixel_id)"""


def _parts(name: str, src: str, keys: str, day: str, size: str) -> str:
    """CTEs that end in `<name>`: keys, day and part, the number of its part by day."""
    size_of = "(upto[{0}] - CASE WHEN {1} > 1 THEN upto[{1} - 1] ELSE 0 END)"
    left, right = size_of.format("i - 1", "a"), size_of.format("b", "i")
    able = f"list_filter(range(a + 1, b + 1), lambda i: days[i] - days[i - 1] >= 21 AND {left} >= 12 AND {right} >= 12 AND {left} / CAST(size AS DOUBLE) >= 0.15 AND {right} / CAST(size AS DOUBLE) >= 0.15)"
    best = "CAST(list_filter(able, lambda i: days[i] - days[i - 1] = list_max(list_transform(able, lambda j: days[j] - days[j - 1])))[1] AS INTEGER)"
    return f"""{name}_h AS (SELECT {keys}, {day} AS day, count(*) AS n, any_value({size}) AS size FROM {src} WHERE {day} IS NOT NULL GROUP BY ALL),
{name}_l AS (SELECT {keys}, any_value(size) AS size, list(day ORDER BY day) AS days, list(upto ORDER BY day) AS upto FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY {keys} ORDER BY day) AS INTEGER) AS upto FROM {name}_h) GROUP BY ALL),
{name}_r AS (
  SELECT {keys}, 1 AS a, CAST(len(days) AS INTEGER) AS b FROM {name}_l
  UNION SELECT {keys}, CASE WHEN side = 0 THEN a ELSE cut END, CASE WHEN side = 0 THEN cut - 1 ELSE b END
    FROM (SELECT *, {best} AS cut FROM (SELECT r.*, l.days, {able} AS able FROM {name}_r r JOIN {name}_l l USING ({keys}))), (SELECT unnest([0, 1]) AS side) WHERE cut IS NOT NULL),
{name}_e AS (SELECT {keys}, days, a, min(b) AS b FROM {name}_r JOIN {name}_l USING ({keys}) GROUP BY ALL),
{name} AS (SELECT {keys}, unnest(days[a:b]) AS day, CAST(dense_rank() OVER (PARTITION BY {keys} ORDER BY a) - 1 AS INTEGER) AS part FROM {name}_e)"""


ZONES = f"""{_LOOKS},{_parts('cut', 'dated', 'field_id', 'greenup', 'size')},
sizes AS (SELECT field_id, part, sum(n) AS n, min(day) AS first_day FROM cut JOIN cut_h USING (field_id, day) GROUP BY 1, 2),
big AS (SELECT field_id, arg_min(part, (-n, part)) AS part, arg_min(first_day, (-n, part)) AS first_day FROM sizes GROUP BY 1),
placed AS (
  SELECT d.field_id, d.pixel_id, coalesce(c.part, b.part, 0) AS part, coalesce(d.greenup, b.first_day) AS day FROM dated d LEFT JOIN cut c ON c.field_id = d.field_id AND c.day = d.greenup LEFT JOIN big b ON b.field_id = d.field_id WHERE kind = 'crop'),
mid AS (SELECT field_id, part, list(day ORDER BY day)[count(*) // 2 + 1] AS greenup, count(*) AS pixels FROM placed GROUP BY 1, 2),
zn AS (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY greenup NULLS LAST, pixels DESC, part) AS number, count(*) OVER (PARTITION BY field_id) AS many FROM mid),
zone AS (
  SELECT field_id, pixel_id, 'z' || number AS zone_id, 'crop' AS kind, greenup, pixels, CASE WHEN many > 1 THEN 'sowing' ELSE 'boundary' END AS reason FROM placed JOIN zn USING (field_id, part)
  UNION ALL SELECT field_id, pixel_id, 'noncrop', kind, NULL, count(*) OVER (PARTITION BY field_id), 'non_crop' FROM dated WHERE kind = 'non_crop')"""


@query(f"WITH RECURSIVE {ZONES} SELECT * FROM zone")
def sowing_zones(spark, sf_dir):
    """Pixels of a field apart by the day they turned green, at the largest gaps first."""
    return zones.sowing_zones(pixel_looks(spark, sf_dir))


@query(f"""WITH RECURSIVE {ZONES},
since AS (SELECT c.*, zone_id FROM clear c JOIN zone z ON z.field_id = c.field_id AND z.pixel_id = c.pixel_id WHERE z.kind = 'crop' AND (greenup IS NULL OR day >= greenup - 5)),
topped AS (SELECT field_id, pixel_id, count(*) AS n, max(ndvi) AS top, min(CASE WHEN ndvi = m THEN day END) AS top_day FROM (SELECT *, max(ndvi) OVER (PARTITION BY field_id, pixel_id) AS m FROM since) GROUP BY 1, 2),
crash AS (SELECT field_id, pixel_id, min(day) AS crash FROM since JOIN topped USING (field_id, pixel_id) WHERE n >= 3 AND top >= 0.35 AND day - top_day >= 10 AND (ndvi <= 0.22 OR ndvi <= top * 0.45) GROUP BY 1, 2),
zp AS (SELECT z.*, crash FROM zone z LEFT JOIN crash c ON c.field_id = z.field_id AND c.pixel_id = z.pixel_id WHERE kind = 'crop'),
{_parts('har', 'zp', 'field_id, zone_id', 'crash', 'pixels')},
part AS (
  SELECT field_id, zone_id, part, sum(n) AS n, any_value(size) AS size FROM har JOIN har_h USING (field_id, zone_id, day) GROUP BY 1, 2, 3),
able AS (SELECT * FROM part WHERE n >= 12 AND n / size >= 0.15),
still AS (SELECT field_id, zone_id, -1 AS part, count(*) AS n, any_value(pixels) AS size FROM zp WHERE crash IS NULL GROUP BY 1, 2 HAVING count(*) >= 12 AND count(*) / any_value(pixels) >= 0.15),
kept AS (SELECT *, count(*) OVER w AS many, row_number() OVER (PARTITION BY field_id, zone_id ORDER BY n DESC, CASE WHEN part >= 0 THEN part ELSE 1000000 END) AS number FROM (SELECT * FROM able UNION ALL SELECT s.* FROM still s WHERE EXISTS (SELECT 1 FROM able a WHERE a.field_id = s.field_id AND a.zone_id = s.zone_id)) WINDOW w AS (PARTITION BY field_id, zone_id)),
mine AS (SELECT zp.*, coalesce(h.part, -1) AS part FROM zp LEFT JOIN har h ON h.field_id = zp.field_id AND h.zone_id = zp.zone_id AND h.day = zp.crash)
SELECT m.field_id, m.pixel_id, m.zone_id, CAST(CASE WHEN s.field_id IS NOT NULL THEN coalesce(k.number, 1) ELSE 1 END AS INTEGER) AS part, greenup, crash, CASE WHEN s.field_id IS NOT NULL THEN 'harvest' ELSE reason END AS reason
FROM mine m LEFT JOIN (SELECT DISTINCT field_id, zone_id FROM kept WHERE many >= 2) s ON s.field_id = m.field_id AND s.zone_id = m.zone_id LEFT JOIN kept k ON k.many >= 2 AND k.field_id = m.field_id AND k.zone_id = m.zone_id AND k.part = m.part""")
def harvest_zones(spark, sf_dir):
    """Zones apart again where their pixels were cut on different days."""
    looks = pixel_looks(spark, sf_dir)
    return zones.harvest_zones(looks, zones.sowing_zones(looks))
