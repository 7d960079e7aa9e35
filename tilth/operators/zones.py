"""Zones of a field: pixels apart by the day they turned green, and again by the day they were cut.

A sorted list of days is divided at its largest gap, again and again, as long as both sides are large enough. That runs on
counts a day, so a field is as many rows as its days, however many pixels it has; all parts of all fields are divided in
the same round, and since a part keeps a least share of its field, rounds are few.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilth.operators.graph import written


@dataclass(frozen=True)
class Zoning:
    least_pixels: int = 12
    least_share: float = 0.15
    least_gap: int = 21
    emergence: float = 0.35
    residue: float = 0.22
    rose_by: float = 0.05
    held_days: int = 40
    held_by: float = 0.08
    agree_days: int = 21
    tree_least: float = 0.45
    tree_median: float = 0.60
    bare_most: float = 0.18
    peak_least: float = 0.35
    after_peak: int = 10
    fallen_to: float = 0.45


def _clear(looks: DataFrame) -> DataFrame:
    return looks.where(F.col("sensor").isin("s2", "landsat") & F.col("ndvi").isNotNull())


def pixel_kinds(looks: DataFrame, how: Zoning = Zoning()) -> DataFrame:
    """field_id, pixel_id and kind: non_crop if always green, always bare or never green enough, else crop."""
    every = looks.select("field_id", "pixel_id").distinct()
    ndvi = F.col("ndvi")
    seen = _clear(looks).groupBy("field_id", "pixel_id").agg(F.count(ndvi).alias("n"), F.min(ndvi).alias("low"), F.max(ndvi).alias("top"), F.median(ndvi).alias("mid"))
    trees = (F.col("n") >= 3) & (F.col("low") > how.tree_least) & (F.col("mid") > how.tree_median)
    bare = ((F.col("n") >= 3) & (F.col("top") < how.bare_most)) | ((F.col("n") >= 2) & (F.col("top") < how.emergence))
    return every.join(seen, ["field_id", "pixel_id"], "left").select("field_id", "pixel_id", F.when(trees | bare, "non_crop").otherwise("crop").alias("kind"))


def greenups(looks: DataFrame, how: Zoning = Zoning()) -> DataFrame:
    """field_id, pixel_id and greenup, the first day that green was seen to come and hold; radar counts where optical looks
    say nothing, or where both disagree and it is earlier."""
    by = Window.partitionBy("field_id", "pixel_id").orderBy("day", "sensor", "ndvi")
    clear = _clear(looks).withColumns({"before": F.lag("ndvi").over(by), "after": F.lead("ndvi").over(by), "next_day": F.lead("day").over(by)})
    rose = F.col("before").isNull() | (F.col("before") < how.emergence - how.rose_by)
    wait = F.datediff("next_day", "day")
    held = F.col("next_day").isNull() | (wait > how.held_days) | (F.col("after") >= how.emergence - how.held_by)
    optical = clear.where((F.col("ndvi") >= how.emergence) & rose & held).groupBy("field_id", "pixel_id").agg(F.min("day").alias("optical"))
    orbit = Window.partitionBy("field_id", "pixel_id", "orbit").orderBy("day", "rvi")
    echo = looks.where((F.col("sensor") == "s1") & F.col("rvi").isNotNull() & F.col("orbit").isNotNull())
    first = F.avg(F.when(F.col("k") <= 2, F.col("rvi"))).over(Window.partitionBy("field_id", "pixel_id", "orbit"))
    echo = echo.withColumns({"k": F.row_number().over(orbit), "after": F.lead("rvi").over(orbit)}).withColumn("ground", first)
    up = (F.col("k") > 2) & (F.col("rvi") >= F.col("ground") + 0.08) & (F.col("after") >= F.col("ground") + 0.05)
    radar = echo.where(up).groupBy("field_id", "pixel_id").agg(F.min("day").alias("radar"))
    both = optical.join(radar, ["field_id", "pixel_id"], "full")
    agree = F.abs(F.datediff("optical", "radar")) <= how.agree_days
    return both.select("field_id", "pixel_id", F.when(agree, F.col("optical")).otherwise(F.least("optical", "radar")).alias("greenup"))


def crashes(looks: DataFrame, pixels: DataFrame, how: Zoning = Zoning()) -> DataFrame:
    """field_id, pixel_id and crash, the first day that a canopy has fallen to residue after its own peak. pixels: with
    `since`, the day that counts as the season's first."""
    clear = _clear(looks).join(pixels.select("field_id", "pixel_id", "since"), ["field_id", "pixel_id"])
    clear = clear.where(F.col("since").isNull() | (F.col("day") >= F.date_sub("since", 5)))
    own = Window.partitionBy("field_id", "pixel_id")
    top = F.min_by(F.struct("ndvi", "day"), F.struct(-F.col("ndvi"), F.col("day"), F.col("sensor"))).over(own)
    rows = clear.withColumns({"n": F.count(F.lit(1)).over(own), "top": top}).where((F.col("n") >= 3) & (F.col("top.ndvi") >= how.peak_least))
    fallen = (F.col("ndvi") <= how.residue) | (F.col("ndvi") <= F.col("top.ndvi") * how.fallen_to)
    return rows.where(fallen & (F.datediff("day", "top.day") >= how.after_peak)).groupBy("field_id", "pixel_id").agg(F.min("day").alias("crash"))


def split_by_gaps(days: DataFrame, how: Zoning = Zoning()) -> DataFrame:
    """days with `part`, numbered from 0 by day within each group. days: group, day, n (rows of that day) and size, the
    group's size that shares are of."""
    whole = Window.partitionBy("group")
    parts = written(days.select("group", "day", "n", "size", F.min("day").over(whole).alias("from_day")))
    while True:
        own = Window.partitionBy("group", "from_day")
        by = own.orderBy("day")
        left = F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1))
        sized = parts.withColumns({"gap": F.datediff("day", F.lag("day").over(by)), "left": left, "right": F.sum("n").over(own) - left})
        large = lambda c: (F.col(c) >= how.least_pixels) & (F.col(c) / F.col("size") >= how.least_share)
        able = F.when((F.col("gap") >= how.least_gap) & large("left") & large("right"), F.struct((-F.col("gap")).alias("g"), "day"))
        cut = F.min(able).over(own)["day"]
        new = written(sized.select("group", "day", "n", "size", F.when(F.col("day") >= cut, cut).otherwise(F.col("from_day")).alias("from_day"), (F.col("day") >= cut).alias("moved")))
        parts = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return parts.select("group", "day", "n", "size", (F.dense_rank().over(whole.orderBy("from_day")) - 1).alias("part"))


def _days(pixels: DataFrame, day: str, keys: list[str], size: str) -> DataFrame:
    return pixels.where(F.col(day).isNotNull()).groupBy(F.struct(*keys).alias("group"), F.col(day).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.first(size).alias("size"))


def sowing_zones(looks: DataFrame, how: Zoning = Zoning()) -> DataFrame:
    """A row a pixel: field_id, pixel_id, zone_id (noncrop, or z1, z2, ... by greening), kind, greenup of the zone (its
    pixels' middle day), pixels of the zone and reason (sowing where the field was split, else boundary)."""
    pixels = pixel_kinds(looks, how).join(greenups(looks, how), ["field_id", "pixel_id"], "left")
    crop = Window.partitionBy("field_id")
    pixels = written(pixels.withColumn("size", F.count_if(F.col("kind") == "crop").over(crop)).withColumn("greenup", F.when(F.col("kind") == "crop", F.col("greenup"))))
    parts = split_by_gaps(_days(pixels, "greenup", ["field_id"], "size"), how).select(F.col("group.field_id").alias("field_id"), "day", "n", "part")
    # pixels without a day join the largest part, on its first day
    sizes = parts.groupBy("field_id", "part").agg(F.sum("n").alias("n"), F.min("day").alias("first"))
    largest = sizes.groupBy("field_id").agg(F.min_by(F.struct("part", "first"), F.struct(-F.col("n"), F.col("part"))).alias("big"))
    placed = pixels.where("kind = 'crop'").join(parts.select("field_id", F.col("day").alias("greenup"), "part"), ["field_id", "greenup"], "left").join(largest, "field_id", "left")
    placed = placed.select("field_id", "pixel_id", F.coalesce("part", "big.part", F.lit(0)).alias("part"), F.coalesce("greenup", "big.first").alias("day"))
    # the middle day of a part, from its counts a day
    counts = placed.groupBy("field_id", "part", "day").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("field_id", "part").orderBy("day")
    middle = counts.withColumns({"upto": F.sum("n").over(upto), "pixels": F.sum("n").over(Window.partitionBy("field_id", "part"))})
    zones = middle.groupBy("field_id", "part").agg(F.min(F.when(F.col("upto") > F.floor(F.col("pixels") / 2), F.col("day"))).alias("greenup"), F.first("pixels").alias("pixels"))
    order = Window.partitionBy("field_id").orderBy(F.col("greenup").asc_nulls_last(), F.desc("pixels"), "part")
    zones = zones.withColumns({"number": F.row_number().over(order), "many": F.count(F.lit(1)).over(Window.partitionBy("field_id"))})
    named = placed.join(zones, ["field_id", "part"]).select(
        "field_id", "pixel_id", F.concat(F.lit("z"), "number").alias("zone_id"), F.lit("crop").alias("kind"), "greenup", "pixels", F.when(F.col("many") > 1, "sowing").otherwise("boundary").alias("reason")
    )
    rest = pixels.where("kind = 'non_crop'").withColumn("pixels", F.count(F.lit(1)).over(crop))
    return named.unionByName(rest.select("field_id", "pixel_id", F.lit("noncrop").alias("zone_id"), "kind", F.lit(None).cast("date").alias("greenup"), "pixels", F.lit("non_crop").alias("reason")))


def harvest_zones(looks: DataFrame, zones: DataFrame, how: Zoning = Zoning()) -> DataFrame:
    """zones (as sowing_zones() has them) with part, 1 for the largest: a zone cut on days far enough apart, or cut in part
    while the rest still stands, is as many parts; where that gives less than two, the zone is one."""
    crop = zones.where("kind = 'crop'").withColumn("since", F.col("greenup"))
    pixels = written(crop.join(crashes(looks, crop, how), ["field_id", "pixel_id"], "left").select("field_id", "pixel_id", "zone_id", "greenup", "pixels", "reason", "crash"))
    keys = ["field_id", "zone_id"]
    parts = split_by_gaps(_days(pixels, "crash", keys, "pixels"), how).select("group.*", F.col("day").alias("crash"), "n", "size", "part")
    sizes = parts.groupBy(*keys, "part").agg(F.sum("n").alias("n"), F.first("size").alias("size"))
    standing = pixels.where("crash IS NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("pixels").alias("size")).withColumn("part", F.lit(-1))
    large = (F.col("n") >= how.least_pixels) & (F.col("n") / F.col("size") >= how.least_share)
    kept = sizes.where(large)
    kept = kept.unionByName(standing.where(large).join(kept.select(*keys).distinct(), keys, "left_semi"))
    own = Window.partitionBy(*keys)
    cut_first = F.when(F.col("part") >= 0, F.col("part")).otherwise(1 << 30)  # among equals those that were cut, by day
    kept = kept.withColumns({"many": F.count(F.lit(1)).over(own), "number": F.row_number().over(own.orderBy(F.desc("n"), cut_first))}).where("many >= 2")
    of_day = pixels.join(parts.select(*keys, "crash", "part"), [*keys, "crash"], "left").withColumn("part", F.coalesce("part", F.lit(-1)))
    split = kept.select(*keys).distinct().withColumn("split", F.lit(True))
    out = of_day.join(kept.select(*keys, "part", "number"), [*keys, "part"], "left").join(split, keys, "left")
    again = F.coalesce("split", F.lit(False))
    return out.select("field_id", "pixel_id", "zone_id", F.when(again, F.coalesce("number", F.lit(1))).otherwise(1).alias("part"), "greenup", "crash", F.when(again, "harvest").otherwise(F.col("reason")).alias("reason"))
