"""Joins on ranges: intervals, nearest and as-of rows, cohorts within a band, grid-prefiltered neighbours.

Every one keeps an equality (a key, or the number of a band) beside its range, so that Spark hashes rather than nests.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(left: DataFrame, right: DataFrame, keys: Sequence[str], at: Column, low: Column, high: Column, how: str = "inner", band_days: int | None = None) -> DataFrame:
    """Rows of right whose `at` is in [low, high] of the left row of the same key. The column names must differ but for keys.

    band_days, for inner joins on dates: left rows go to every band of so many days that they touch and meet only those,
    so few keys with long histories don't meet whole.
    """
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = at.between(low, high)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    if band_days is None:
        return left.join(renamed, on, how).drop(*[f"__{k}" for k in keys])
    band = lambda day: F.floor(F.unix_date(day) / band_days)
    spread = left.withColumn("__touch", F.explode(F.sequence(band(low), band(high))))
    return spread.join(renamed.withColumn("__band", band(at)), on & (F.col("__touch") == F.col("__band")), "inner").drop("__touch", "__band", *[f"__{k}" for k in keys])


def overlap_days(start_1: Column, end_1: Column, start_2: Column, end_2: Column) -> Column:
    """Days that two intervals share, both ends counted."""
    return F.greatest(F.lit(0), F.datediff(F.least(end_1, end_2), F.greatest(start_1, start_2)) + 1)


def alike(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Keys whose rows have the same columns as one, for joins that ask a small table for many like rows: (`unit`, columns of
    each different set of rows; keys, `unit` and n, how many rows a key has). n is needed where keys repeat."""
    own = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("__rows"))
    each = own.groupBy("__rows").agg(F.min(F.struct(*keys)).alias("unit"))
    return each.select("unit", F.explode("__rows").alias("__row")).select("unit", "__row.*"), own.join(each, "__rows").select(*keys, "unit", F.size("__rows").alias("n"))


def banded(left: DataFrame, right: DataFrame, keys: Sequence[str], at_left: str, at_right: str, width: int) -> DataFrame:
    """Pairs of one key whose whole numbers differ by `width` at most. Right rows go to the bands on either side, so the
    join is by equality of key and band."""
    span = F.floor(F.col(at_right) / (width + 1))
    spread = right.withColumnsRenamed({k: f"__{k}" for k in keys}).withColumn("__band", F.explode(F.array(span - 1, span, span + 1)))
    on = F.floor(F.col(at_left) / (width + 1)) == F.col("__band")
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return left.join(spread, on).where(F.abs(F.col(at_left) - F.col(at_right)) <= width).drop("__band", *[f"__{k}" for k in keys])


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], at_left: str, at_right: str, width: int, left_id: str, take: Sequence[str], tie: str) -> DataFrame:
    """For each left row the right row nearest within `width` (earlier, then lower tie, first), or nulls."""
    pairs = banded(left, right, keys, at_left, at_right, width)
    order = F.struct(F.abs(F.col(at_left) - F.col(at_right)), F.col(at_right), F.col(tie))
    best = pairs.groupBy(F.col(left_id).alias("__left")).agg(F.min_by(F.struct(*take), order).alias("__best"))
    return left.join(best, F.col(left_id) == F.col("__left"), "left").select(*left.columns, *[F.col(f"__best.{c}").alias(f"near_{c}") for c in take])


def expanded(pairs: DataFrame, of_a: DataFrame, of_b: DataFrame, id: str, stands: str) -> DataFrame:
    """pairs (a, b, more) of rows that stand for equal ones, as pairs of all rows. of_a, of_b: `id` and `stands`, the row
    that stands for it. The last join makes most of the rows, so it keeps its many partitions though its input is small."""
    many = 4 * pairs.sparkSession.sparkContext.defaultParallelism
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    half = pairs.join(of_b.select(F.col(id).alias("__b"), F.col(stands).alias("b")), "b").select("a", F.col("__b").alias("b"), *rest)
    whole = half.repartition(many, "a").join(of_a.select(F.col(id).alias("__a"), F.col(stands).alias("a")).repartition(many, "a"), "a")
    return whole.select(F.col("__a").alias("a"), "b", *rest)


def spots(points: DataFrame, key: str, lat: str, lon: str) -> tuple[DataFrame, DataFrame]:
    """Points at one place as one: (key, the least of the place, lat, lon; key and `spot`, that least, of every point)."""
    each = points.groupBy(lat, lon).agg(F.min(key).alias("spot"))
    return each.select(F.col("spot").alias(key), lat, lon), points.join(each, [lat, lon]).select(key, "spot")


def neighbours(points: DataFrame, key: str, lat: str, lon: str, km: float, distance) -> DataFrame:
    """Pairs (a, b) with a < b no further apart than so many kilometres, met through cells of about that size: rows of
    latitude, and in each row columns wide enough for its end nearer the pole. The date line is an edge. Points at one place
    are met as one, and pairs made of them at the end."""
    places, members = spots(points, key, lat, lon)
    met = _spots_within(places, key, lat, lon, km, distance)
    own = places.select(F.col(key).alias("a"), F.col(key).alias("b"), distance(F.col(lat), F.col(lon), F.col(lat), F.col(lon)).alias("km")).where(F.col("km") <= km)
    both = expanded(met.unionByName(own).select("a", "b", "km", (F.col("a") == F.col("b")).alias("__same")), members, members, key, "spot")
    pairs = both.where(~F.col("__same") | (F.col("a") < F.col("b")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "km")


def _spots_within(points: DataFrame, key: str, lat: str, lon: str, km: float, distance) -> DataFrame:
    """neighbours() of points at different places."""
    high = km / 100.0  # a degree of latitude is over 100 km, so a row and its neighbours suffice
    row = F.floor(F.col(lat) / high)

    def column(of: Column) -> Column:
        wide = high / F.greatest(F.cos(F.radians(F.least((F.abs(of) + 2) * high, F.lit(89.0)))), F.lit(0.01))
        return F.floor(F.col(lon) / wide)

    one = points.select(F.col(key).alias("a"), F.col(lat).alias("lat_a"), F.col(lon).alias("lon_a"), row.alias("row_a"), column(row).alias("column_a"))
    two = points.withColumn("row_b", F.explode(F.array(row - 1, row, row + 1)))
    across = F.explode(F.array(*[column(F.col("row_b")) + k for k in (-1, 0, 1)]))
    two = two.select(F.col(key).alias("b"), F.col(lat).alias("lat_b"), F.col(lon).alias("lon_b"), "row_b", across.alias("column_b"))
    pairs = one.join(two, (F.col("row_a") == F.col("row_b")) & (F.col("column_a") == F.col("column_b")) & (F.col("a") < F.col("b")))
    return pairs.withColumn("km", distance(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))).where(F.col("km") <= km).select("a", "b", "km")


def overlapping_boxes(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Pairs (a, b) of boxes (id, x0, y0, x1, y1) that overlap: shared area, both areas and intersection over union. Boxes
    meet in the grid cells that they touch, and a pair counts in the cell of its shared corner alone, so no pair comes
    twice. Cells should be about as large as boxes."""

    def touched(df: DataFrame, name: str) -> DataFrame:
        span = lambda low, high: F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))
        spread = df.select(F.col("id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("x0", "y0", "x1", "y1")], F.explode(span("x0", "x1")).alias("column"), span("y0", "y1").alias("rows"))
        return spread.withColumn("row", F.explode("rows")).drop("rows")

    met = touched(left, "a").join(touched(right, "b"), ["column", "row"])
    x0, y0 = F.greatest("x0_a", "x0_b"), F.greatest("y0_a", "y0_b")
    x1, y1 = F.least("x1_a", "x1_b"), F.least("y1_a", "y1_b")
    here = (F.floor(x0 / cell) == F.col("column")) & (F.floor(y0 / cell) == F.col("row"))
    area = lambda n: (F.col(f"x1_{n}") - F.col(f"x0_{n}")) * (F.col(f"y1_{n}") - F.col(f"y0_{n}"))
    out = met.where(here & (x1 > x0) & (y1 > y0)).select("a", "b", ((x1 - x0) * (y1 - y0)).alias("shared"), area("a").alias("area_a"), area("b").alias("area_b"))
    return out.withColumn("iou", F.col("shared") / (F.col("area_a") + F.col("area_b") - F.col("shared")))


def equal_boxes(boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal boxes as one: (id, the least of them, the box and n, how many they are; id and `box`, that least, of every
    row)."""
    sides = ["x0", "y0", "x1", "y1"]
    each = boxes.groupBy(*sides).agg(F.min("id").alias("box"), F.count(F.lit(1)).alias("n"))
    return each.select(F.col("box").alias("id"), *sides, "n"), boxes.join(each, sides).select("id", "box")
