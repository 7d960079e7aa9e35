"""Time series of parcels: grids, gaps, runs, rolling and interval operators on long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bins(obs: DataFrame, keys: Sequence[str], day: str, days: int, anchor: str) -> DataFrame:
    """Every bin of so many days from the anchor to each key's last day, whether or not anything falls in it."""
    start = F.lit(anchor).cast("date")
    last = obs.groupBy(*keys).agg(F.max(F.floor(F.datediff(F.col(day), start) / days)).cast("int").alias("__last"))
    every = last.where("__last >= 0").select(*keys, F.explode(F.sequence(F.lit(0), F.col("__last"))).alias("bin"))
    return every.withColumn("bin_start", F.date_add(start, F.col("bin") * days))


def best_in_bin(obs: DataFrame, keys: Sequence[str], day: str, days: int, anchor: str, value: str, cloud: str, tie: str) -> DataFrame:
    """The grid with each bin's best observation: a usable value before none, then the least cloud. `missing` tells bins
    without a usable one."""
    start = F.lit(anchor).cast("date")
    order = [F.col(value).isNull(), F.col(cloud).asc_nulls_last(), F.col(tie)]
    rank = F.row_number().over(Window.partitionBy(*keys, "bin").orderBy(*order))
    best = obs.withColumn("bin", F.floor(F.datediff(F.col(day), start) / days).cast("int")).withColumn("__rank", rank).where("__rank = 1").drop("__rank", day)
    return bins(obs, keys, day, days, anchor).join(best, [*keys, "bin"], "left").withColumn("missing", F.col(value).isNull())


def runs(df: DataFrame, keys: Sequence[str], order: str, flag: Column) -> DataFrame:
    """Maximal runs of rows with the flag: first and last place in the order, and length."""
    marked = df.select(*keys, F.col(order).alias("__at"), F.coalesce(flag, F.lit(False)).alias("__flag"))
    through = Window.partitionBy(*keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.row_number().over(through) - F.sum(F.col("__flag").cast("int")).over(through)
    return marked.withColumn("__island", number).where("__flag").groupBy(*keys, "__island").agg(F.min("__at").alias("run_start"), F.max("__at").alias("run_end"), F.count(F.lit(1)).alias("run_length")).drop("__island")


def gaps(df: DataFrame, keys: Sequence[str], day: str, least_days: int) -> DataFrame:
    """Stretches between neighbouring days that are at least so long."""
    before = F.lag(day).over(Window.partitionBy(*keys).orderBy(day))
    return df.select(*keys, F.col(day)).distinct().withColumn("gap_start", before).where(F.datediff(F.col(day), "gap_start") >= least_days).select(*keys, "gap_start", F.col(day).alias("gap_end"), F.datediff(F.col(day), "gap_start").alias("gap_days"))


def rolling(value: Column, keys: Sequence[str], order: str, rows: int, least: int = 1) -> Column:
    """The sum of the last rows, null where fewer than `least` have a value."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0)
    return F.when(F.count(value).over(w) >= least, F.sum(value).over(w))


def triangular(value: Column, keys: Sequence[str], order: str, half: int = 3) -> Column:
    """The triangular weighted mean of 2 * half + 1 rows, renewed at the edges and around nulls."""
    w = Window.partitionBy(*keys).orderBy(order)
    near = [((F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w)) if k else value, float(half + 1 - abs(k))) for k in range(-half, half + 1)]
    top = sum((F.when(x.isNotNull(), x * wt).otherwise(0.0) for x, wt in near[1:]), F.when(near[0][0].isNotNull(), near[0][0] * near[0][1]).otherwise(0.0))
    bottom = sum((F.when(x.isNotNull(), wt).otherwise(0.0) for x, wt in near[1:]), F.when(near[0][0].isNotNull(), near[0][1]).otherwise(0.0))
    return F.try_divide(top, bottom)


def bracketed(value: Column, keys: Sequence[str], order: str, most: int | None = None) -> Column:
    """value, with nulls filled by the straight line between the values on either side (no further apart than `most`)."""
    back = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    at = F.col(order)
    x0, x1 = F.last(F.when(value.isNotNull(), at), True).over(back), F.first(F.when(value.isNotNull(), at), True).over(ahead)
    y0, y1 = F.last(value, True).over(back), F.first(value, True).over(ahead)
    line = y0 + (y1 - y0) * F.try_divide((at - x0).cast("double"), (x1 - x0).cast("double"))
    return F.coalesce(value, F.when(x1 - x0 <= most, line) if most is not None else line)


def trapezoid(df: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """The integral of the value over days, by key."""
    w = Window.partitionBy(*keys).orderBy(day)
    part = (F.col(value) + F.lag(value).over(w)) / 2 * F.datediff(F.col(day), F.lag(day).over(w))
    return df.withColumn("__part", part).groupBy(*keys).agg(F.sum("__part").alias("integral"))


def peaks(df: DataFrame, keys: Sequence[str], order: str, value: str, reach: int, floor: float, prominence: float, tolerance: float = 0.005) -> DataFrame:
    """Rows that no row within reach exceeds, at or over the floor, with a drop of the prominence on one side at least."""
    w = Window.partitionBy(*keys).orderBy(order)
    around = F.max(value).over(w.rowsBetween(-reach, reach))
    left, right = F.min(value).over(w.rowsBetween(-reach, 0)), F.min(value).over(w.rowsBetween(0, reach))
    drop = F.greatest(F.col(value) - left, F.col(value) - right)
    return df.withColumns({"__around": around, "peak_drop": drop}).where((F.col(value) >= F.col("__around") - tolerance) & (F.col(value) >= floor) & (F.col("peak_drop") >= prominence)).drop("__around")


def merged_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """The union of each key's intervals, those that touch joined."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    island = F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__fresh", fresh).withColumn("__island", island).groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row a key, the first in the order."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")
