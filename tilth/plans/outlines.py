"""Queries of outlines: what drawn and true fields share, and records matched by id or by overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.operators import polygons, regions
from tilth.operators.graph import written
from tilth.plans.base import query, table

#: Shapes on a square from 0 to 1: an L, a diamond, a trapezium, and a square with a hole.
SHAPES = [
    [[(0, 0), (1, 0), (1, 0.4), (0.4, 0.4), (0.4, 1), (0, 1)]],
    [[(0.5, 0), (1, 0.5), (0.5, 1), (0, 0.5)]],
    [[(0, 0), (0.2, 1), (0.8, 1), (1, 0)]],
    [[(0, 0), (1, 0), (1, 1), (0, 1)], [(0.25, 0.25), (0.25, 0.75), (0.75, 0.75), (0.75, 0.25)]],
]
CELL = 150.0


def _outline(k: Column, shape: Column, x: Column, y: Column, size: Column) -> Column:
    made = F.lit(None).cast(polygons.KIND)
    for number, rings in enumerate(SHAPES):
        own = F.array(*[F.array(*[F.struct((x + size * a).cast("double").alias("x"), (y + size * b).cast("double").alias("y")) for a, b in ring]) for ring in rings])
        made = F.when(shape == number, own).otherwise(made)
    return made


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rings = _outline(k, k % 4, 100 * (k * 53 % 37), 100 * (k * 29 % 31), 90 + 10 * (k % 6))
    day = F.date_add(F.lit("2024-06-01").cast("date"), (k % 30).cast("int"))
    return table(spark, sf_dir, "supplier").select(
        k.alias("field_id"), rings.alias("rings"), (k % 5).alias("crop"), day.alias("sown"), F.date_sub(day, 8).alias("sown_p10"), F.date_add(day, 8).alias("sown_p90"),
        (1.0 + (k % 9) / 10.0).alias("yield"), (0.7 + (k % 9) / 10.0).alias("yield_p10"), (1.3 + (k % 9) / 10.0).alias("yield_p90"),
    )


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers: outlines near those of suppliers, a field's number for every fourth, none for every seventh outline."""
    c = F.col("c_custkey")
    near = c % 97 + 1
    rings = _outline(c, near * 3 % 4, 100 * (near * 53 % 37) + 7 * (c % 5), 100 * (near * 29 % 31) + 5 * (c % 7), 80 + 10 * (c % 8))
    return table(spark, sf_dir, "customer").select(
        c.alias("record_id"), F.when(c % 4 == 0, c % 150).alias("field_id"), F.when(c % 7 != 0, rings).alias("rings"), (c % 5).alias("crop"),
        F.when(c % 6 != 0, F.date_add(F.lit("2024-06-01").cast("date"), (c % 35).cast("int"))).alias("sown"), F.when(c % 8 != 0, 0.5 + (c % 13) / 10.0).alias("yield"),
    )


def _points(shape: str, x: str, y: str, size: str) -> str:
    rings = lambda shape: "[" + ", ".join("[" + ", ".join(f"{{'x': {a}, 'y': {b}}}" for a, b in ring) + "]" for ring in shape) + "]"
    return f"CASE {shape} " + " ".join(f"WHEN {k} THEN {rings([[(f'CAST({x} + {size} * {a} AS DOUBLE)', f'CAST({y} + {size} * {b} AS DOUBLE)') for a, b in ring] for ring in s])}" for k, s in enumerate(SHAPES)) + " END"


POLYGONS = f"""truth AS (SELECT s_suppkey AS id, {_points('s_suppkey % 4', '100 * (s_suppkey * 53 % 37)', '100 * (s_suppkey * 29 % 31)', '(90 + 10 * (s_suppkey % 6))')} AS rings FROM supplier),
drawn0 AS (SELECT *, c_custkey % 97 + 1 AS near FROM customer),
drawn AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN {_points('(near * 3 % 4)', '(100 * (near * 53 % 37) + 7 * (c_custkey % 5))', '(100 * (near * 29 % 31) + 5 * (c_custkey % 7))', '(80 + 10 * (c_custkey % 8))')} END AS rings FROM drawn0),
poly AS (SELECT 'a' AS side, id, rings FROM drawn WHERE rings IS NOT NULL UNION ALL SELECT 'b', id, rings FROM truth),
ring AS (SELECT side, id, unnest(rings) AS r FROM poly),
edge AS (SELECT side, id, r[k].x AS x1, r[k].y AS y1, r[k % len(r) + 1].x AS x2, r[k % len(r) + 1].y AS y2 FROM ring, range(1, 9) t(k) WHERE k <= len(r)),
box AS (SELECT side, id, min(x1) AS x0, max(x1) AS x9, min(y1) AS y0, max(y1) AS y9 FROM edge GROUP BY 1, 2),
pair AS (SELECT a.id AS a, b.id AS b, greatest(a.x0, b.x0) AS x0, least(a.x9, b.x9) AS x9 FROM box a JOIN box b ON a.side = 'a' AND b.side = 'b' AND a.x0 < b.x9 AND b.x0 < a.x9 AND a.y0 < b.y9 AND b.y0 < a.y9),
cross_ AS (
  SELECT a, b, e.x1 + ((f.x1 - e.x1) * (f.y2 - f.y1) - (f.y1 - e.y1) * (f.x2 - f.x1)) / ((e.x2 - e.x1) * (f.y2 - f.y1) - (e.y2 - e.y1) * (f.x2 - f.x1)) * (e.x2 - e.x1) AS x
  FROM pair JOIN edge e ON e.side = 'a' AND e.id = a JOIN edge f ON f.side = 'b' AND f.id = b WHERE (e.x2 - e.x1) * (f.y2 - f.y1) - (e.y2 - e.y1) * (f.x2 - f.x1) <> 0),
xs AS (SELECT a, b, x FROM cross_ UNION SELECT a, b, x1 FROM pair JOIN edge ON side = 'a' AND id = a UNION SELECT a, b, x1 FROM pair JOIN edge ON side = 'b' AND id = b UNION SELECT a, b, x0 FROM pair UNION SELECT a, b, x9 FROM pair),
slab AS (SELECT * FROM (SELECT xs.a, xs.b, x AS lo, lead(x) OVER (PARTITION BY xs.a, xs.b ORDER BY x) AS hi FROM xs JOIN pair USING (a, b) WHERE x BETWEEN x0 AND x9) WHERE hi > lo),
cut AS (
  SELECT s.a, s.b, lo, hi, side, y1 + (y2 - y1) * ((lo + hi) / 2 - x1) / (x2 - x1) AS y FROM slab s JOIN edge e ON (side = 'a' AND id = s.a OR side = 'b' AND id = s.b) AND least(x1, x2) < (lo + hi) / 2 AND greatest(x1, x2) > (lo + hi) / 2),
run AS (SELECT * FROM (SELECT a, b, lo, hi, side, y AS y1, lead(y) OVER w AS y2, row_number() OVER w AS k FROM cut WINDOW w AS (PARTITION BY a, b, lo, side ORDER BY y)) WHERE k % 2 = 1),
shared AS (SELECT p.a, p.b, sum((p.hi - p.lo) * greatest(0, least(p.y2, q.y2) - greatest(p.y1, q.y1))) AS shared FROM run p JOIN run q ON p.a = q.a AND p.b = q.b AND p.lo = q.lo AND p.side = 'a' AND q.side = 'b' GROUP BY 1, 2),
size AS (SELECT side, id, sum(sgn * abs(twice)) / 2 AS area FROM (SELECT side, id, CASE WHEN row_number() OVER (PARTITION BY side, id ORDER BY abs(twice) DESC) = 1 THEN 1 ELSE -1 END AS sgn, twice FROM (
  SELECT side, id, list_sum(list_transform(range(1, len(r) + 1), lambda k: r[k].x * r[k % len(r) + 1].y - r[k % len(r) + 1].x * r[k].y)) AS twice FROM ring)) GROUP BY 1, 2),
over AS (SELECT a, b, shared, x.area AS area_a, y.area AS area_b, shared / (x.area + y.area - shared) AS iou FROM shared JOIN size x ON x.side = 'a' AND x.id = a JOIN size y ON y.side = 'b' AND y.id = b WHERE shared > 1e-6)""".replace("over AS (SELECT a, b", "met AS (SELECT a, b")


@query(f"WITH {POLYGONS} SELECT a AS record_id, b AS field_id, round(shared, 4) AS shared, round(area_a, 4) AS record_area, round(area_b, 4) AS field_area, round(iou, 8) AS iou FROM met")
def polygon_overlaps(spark, sf_dir):
    """The exact area that each drawn outline shares with each true one; outlines may be concave or have holes."""
    left = _records(spark, sf_dir).where("rings IS NOT NULL").select(F.col("record_id").alias("id"), "rings")
    rounded = {**{c: F.round(c, 4) for c in ("shared", "area_a", "area_b")}, "iou": F.round("iou", 8)}
    met = polygons.overlaps(left, _fields(spark, sf_dir).select(F.col("field_id").alias("id"), "rings"), CELL, F.col("shared") > 1e-6, rounded)
    return met.select(F.col("a").alias("record_id"), F.col("b").alias("field_id"), "shared", F.col("area_a").alias("record_area"), F.col("area_b").alias("field_area"), "iou")


_MATCHED = f"""{POLYGONS},
rec AS (
  SELECT c_custkey AS record_id, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 150 END AS field_id, c_custkey % 7 <> 0 AS outlined, c_custkey % 5 AS crop, CASE WHEN c_custkey % 6 <> 0 THEN DATE '2024-06-01' + CAST(c_custkey % 35 AS INTEGER) END AS sown, CASE WHEN c_custkey % 8 <> 0 THEN 0.5 + (c_custkey % 13) / 10.0 END AS yield_ FROM customer),
best AS (SELECT a, b, iou FROM met QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(shared, 6) DESC, b) = 1),
m0 AS (SELECT r.*, s.s_suppkey IS NOT NULL AS known, best.b, coalesce(best.iou, 0) AS iou0 FROM rec r LEFT JOIN supplier s ON s.s_suppkey = r.field_id LEFT JOIN best ON best.a = r.record_id AND r.outlined),
m AS (
  SELECT *, CASE WHEN known THEN field_id WHEN b IS NOT NULL AND iou0 >= 0.3 THEN b END AS matched_id, CASE WHEN known THEN 'field_id' WHEN b IS NOT NULL AND iou0 >= 0.3 THEN 'spatial' ELSE 'unmatched' END AS method, CASE WHEN NOT known AND outlined THEN iou0 END AS iou FROM m0),
ours AS (SELECT s_suppkey AS k, s_suppkey % 5 AS crop, DATE '2024-06-01' + CAST(s_suppkey % 30 AS INTEGER) AS sown, 1.0 + (s_suppkey % 9) / 10.0 AS yield_ FROM supplier),
cmp AS (SELECT m.*, CAST(o.sown - m.sown AS INTEGER) AS off, o.crop AS our_crop, o.sown AS our_sown, o.yield_ AS our_yield, CASE WHEN m.yield_ > 0 THEN round(100 * (o.yield_ - m.yield_) / CAST(m.yield_ AS DOUBLE), 9) END AS percent FROM m LEFT JOIN ours o ON o.k = m.matched_id)"""


@query(f"""WITH {_MATCHED} SELECT record_id, matched_id, method, round(iou, 8) AS iou, our_crop = crop AS crop_match, off AS sowing_error_days, sown BETWEEN our_sown - 8 AND our_sown + 8 AS sowing_in_range, round(percent, 6) AS yield_error, round(yield_, 3) BETWEEN round(our_yield - 0.3, 3) AND round(our_yield + 0.3, 3) AS yield_in_range FROM cmp""")
def records_matched(spark, sf_dir):
    """Records with the field of their number, or that they overlap most, and what both say."""
    return _compared(spark, sf_dir).drop("log").withColumns({"iou": F.round("iou", 8), "yield_error": F.round("yield_error", 6)})


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, fields = _records(spark, sf_dir), _fields(spark, sf_dir)
    decimal = {c: F.col(c).cast("decimal(9,3)") for c in ("yield", "yield_p10", "yield_p90")}
    pairs = written(polygons.matched(records, fields, CELL))
    return polygons.compared(records.withColumn("yield", decimal["yield"]), fields.withColumns(decimal), pairs)


@query(f"""WITH {_MATCHED} SELECT record_id, method, unnest(list_filter([CASE WHEN method = 'unmatched' THEN 'unmatched' END, CASE WHEN our_crop <> crop THEN 'crop_mismatch' END, CASE WHEN abs(off) > 7 THEN 'sowing_error' END, CASE WHEN abs(percent) > 25 THEN 'yield_error' END], lambda x: x IS NOT NULL)) AS disagreement FROM cmp""")
def record_disagreements(spark, sf_dir):
    """What records and matched fields disagree on beyond the tolerances, a row each."""
    return _compared(spark, sf_dir).select("record_id", "method", F.explode("log").alias("disagreement"))


def region_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cells of a grid forty wide: blocks of staggered bricks, and every eleventh cell a region of its own."""
    k = F.col("c_custkey")
    row, column = F.floor(k / 40), k % 40
    brick = 1000 * F.floor(row / 3) + F.floor((column + 2 * (F.floor(row / 3) % 2)) / 5)
    return table(spark, sf_dir, "customer").select(row.alias("row"), column.alias("column"), F.when(k % 11 == 0, 1_000_000 + k).otherwise(brick).alias("region"))


@query()
def merged_fields(spark, sf_dir):
    """Regions of the grid: specks in the neighbour of the longest border, then neighbours of one kind as one field."""
    cells = region_cells(spark, sf_dir)
    own = cells.groupBy(F.col("region").alias("id")).agg((F.count(F.lit(1)) * 0.04).alias("area"))
    own = own.select("id", "area", (F.col("id") % 3).alias("kind"), ((F.col("id") % 10) / 10.0).alias("confidence"))
    found, _ = regions.fields(written(own), regions.grid_borders(cells), regions.speck_limit(0.2))
    return found
