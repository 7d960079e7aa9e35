"""Agreement, calibration, area estimation and sampling, as aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, reference: str, predicted: str) -> DataFrame:
    """Counts of each pair of labels that occurs."""
    return df.groupBy(F.col(reference).alias("reference"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def per_class(counts: DataFrame) -> DataFrame:
    """True positives, false ones and misses of each label, with precision, recall and F1. A label without any of the
    three has no F1; one with misses or false positives alone has 0. A null prediction is an abstention: a miss of its
    reference; the label null has the abstentions as its false positives."""
    both = counts.select(F.explode(F.array_distinct(F.array("reference", "predicted"))).alias("label"), "reference", "predicted", "n")
    is_ref, is_pred = F.col("reference").eqNullSafe(F.col("label")), F.col("predicted").eqNullSafe(F.col("label"))
    by = both.groupBy("label").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name) for c, name in ((is_ref & is_pred, "tp"), (is_pred & ~is_ref, "fp"), (is_ref & ~is_pred, "fn"))])
    f1 = F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return by.withColumns({"precision": F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), "f1": f1})


def kappa(counts: DataFrame) -> DataFrame:
    """One row: n, observed and expected agreement, Cohen's kappa and its standard error."""
    whole = counts.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))
    shares = whole.groupBy("total").agg(F.sum(F.when(F.col("reference") == F.col("predicted"), F.col("n")).otherwise(0)).alias("agree"))
    side = lambda c: whole.groupBy(F.col(c).alias("label"), "total").agg(F.sum("n").alias(c))
    expected = side("reference").join(side("predicted"), ["label", "total"]).groupBy("total").agg(F.sum(F.col("reference").cast("double") * F.col("predicted")).alias("products"))
    po, pe = F.col("agree") / F.col("total"), F.coalesce(F.col("products"), F.lit(0.0)) / (F.col("total").cast("double") * F.col("total"))
    out = shares.join(expected, "total", "left").select(F.col("total").alias("n"), po.alias("po"), pe.alias("pe"))
    k = F.when(F.col("pe") >= 1, F.when(F.col("po") == 1, 1.0)).otherwise(F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")))
    se = F.when(F.col("pe") < 1, F.sqrt(F.try_divide(F.col("po") * (1 - F.col("po")), F.col("n") * (1 - F.col("pe")) * (1 - F.col("pe")))))
    return out.withColumns({"kappa": k, "kappa_se": se})


def calibration(df: DataFrame, confidence: str, correct: Column, closed_right: bool = False) -> DataFrame:
    """Ten equal bins: n, mean confidence, accuracy and the bin's share of the calibration error. Bins are [lo, hi) with the
    last closed, or (lo, hi] with closed_right."""
    edges = [k / 10 for k in range(1, 10)]
    above = [(F.col(confidence) > e) if closed_right else (F.col(confidence) >= e) for e in edges]
    number = sum((a.cast("int") for a in above[1:]), above[0].cast("int"))
    by = df.where(F.col(confidence).isNotNull()).withColumn("bin", number).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(correct.cast("double")).alias("accuracy"))
    every = Window.partitionBy(F.lit(0))
    return by.withColumn("error_share", F.col("n") / F.sum("n").over(every) * F.abs(F.col("accuracy") - F.col("mean_confidence")))


def stratified_area(sample: DataFrame, areas: DataFrame, label: str, stratum: str = "stratum", area: str = "area", z: float = 1.96) -> DataFrame:
    """The area of each reference label from a stratified sample: share, area, standard error and interval. A stratum with
    fewer than two samples leaves the error null."""
    n = sample.groupBy(stratum).agg(F.count(F.lit(1)).alias("n_h"))
    strata = areas.join(n, stratum).withColumn("w", F.col(area) / F.sum(area).over(Window.partitionBy(F.lit(0)))).withColumn("whole", F.sum(area).over(Window.partitionBy(F.lit(0))))
    labels = sample.select(F.col(label).alias("label")).distinct()
    hits = sample.groupBy(stratum, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("hits"))
    grid = strata.crossJoin(labels).join(hits, [stratum, "label"], "left")  # a row a stratum, times a row a class
    p = F.coalesce(F.col("hits"), F.lit(0)) / F.col("n_h")
    variance = F.when(F.col("n_h") > 1, F.col("w") * F.col("w") * p * (1 - p) / (F.col("n_h") - 1))
    by = grid.groupBy("label").agg(F.sum(F.col("w") * p).alias("share"), F.first("whole").alias("whole"), F.when(F.count(variance) == F.count(F.lit(1)), F.sqrt(F.sum(variance))).alias("share_se"))
    return by.select("label", "share", "share_se", (F.col("share") * F.col("whole")).alias("area"), (z * F.col("share_se") * F.col("whole")).alias("half_width"))


def accuracy_by_class(sample: DataFrame, areas: DataFrame, mapped: str, reference: str, stratum: str, area: str, units: str) -> DataFrame:
    """A row a label: users' and producers' accuracy as combined ratio estimators over strata, with standard errors that
    count the covariance of both indicators and a finite population. A stratum of under two samples leaves the errors
    null; a label that is never mapped (or never the reference) has no users' (producers') accuracy."""
    c = sample.groupBy(F.col(stratum).alias("stratum"), F.col(mapped).alias("mapped"), F.col(reference).alias("reference")).agg(F.count(F.lit(1)).alias("k"))
    labels = c.select(F.explode(F.array("mapped", "reference")).alias("label")).distinct()
    weight = areas.select(F.col(stratum).alias("stratum"), (F.col(area) / F.sum(area).over(Window.partitionBy(F.lit(0)))).alias("w"), F.col(units).alias("units"))
    is_map, is_ref = F.col("mapped") == F.col("label"), F.col("reference") == F.col("label")
    count = lambda test: F.sum(F.when(test, F.col("k")).otherwise(0)).cast("double")
    b = c.crossJoin(labels).groupBy("label", "stratum").agg(F.sum("k").alias("n"), count(is_map & is_ref).alias("both"), count(is_map).alias("m"), count(is_ref).alias("r"))
    b = b.join(weight, "stratum")
    e = b.groupBy("label").agg(*[F.sum(F.col("w") * F.col(x) / F.col("n")).alias(f"e_{x}") for x in ("both", "m", "r")])
    v = b.join(e, "label")
    n, both = F.col("n"), F.col("both")

    def estimate(x: str) -> tuple[Column, Column]:
        ratio, own = F.try_divide(F.col("e_both"), F.col(f"e_{x}")), F.col(x)
        spread = both * (1 - both / n) + ratio * ratio * own * (1 - own / n) - 2 * ratio * (both - both * own / n)
        part = F.when(n > 1, F.col("w") * F.col("w") * (1 - n / F.col("units")) / n * spread / (n - 1))
        error = F.sqrt(F.greatest(F.try_divide(F.sum(part), F.first(F.col(f"e_{x}") * F.col(f"e_{x}"))), F.lit(0.0)))
        return F.first(ratio), F.when(F.count_if(n < 2) == 0, error)

    (ua, ua_se), (pa, pa_se) = estimate("m"), estimate("r")
    return v.groupBy("label").agg(ua.alias("users_accuracy"), ua_se.alias("ua_se"), pa.alias("producers_accuracy"), pa_se.alias("pa_se"))


def _offsets(counts: DataFrame, part: str) -> DataFrame:
    """part, rows before it, and all rows; counts has one row a part, a few hundred at most."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(F.col(part).alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(F.lit(0))).alias("__all"))


def cumulative_share(df: DataFrame, value: str, out: str, parts: int = 256) -> DataFrame:
    """df with the share of rows whose value is no greater. Rows without a value go.

    Equal values are counted first; distinct ones go to ranges between approximate quantiles, each range ranks its own,
    and ranges add up by their totals. So neither all rows nor the rows of one value meet in a task.
    """
    known = df.where(F.col(value).isNotNull())
    cuts = sorted(set(known.approxQuantile(value, [k / parts for k in range(1, parts)], 1 / (4 * parts))))
    held = known.groupBy(F.col(value).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    held = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="__value", outputCol="__part", handleInvalid="keep").transform(held) if cuts else held.withColumn("__part", F.lit(0.0))
    start = _offsets(held.groupBy("__part").agg(F.sum("__n").alias("__n")), "__part")
    through = F.sum("__n").over(Window.partitionBy("__part").orderBy("__value"))
    placed = held.withColumn("__through", through).join(start, F.col("__part") == F.col("__of"))
    placed = placed.select("__value", ((F.col("__before") + F.col("__through")) / F.col("__all")).alias(out))
    return known.join(placed, F.col(value) == F.col("__value")).drop("__value")


def numbered_by_hash(df: DataFrame, key: str, tie: str, out: str) -> DataFrame:
    """df with its rows numbered from 1 in the order of a hexadecimal hash: 256 ranges by its first two digits number
    their own and add up by their counts."""
    rows = df.withColumn("__part", F.substring(key, 1, 2))
    start = _offsets(rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")), "__part")
    own = F.row_number().over(Window.partitionBy("__part").orderBy(key, tie))
    return rows.withColumn("__own", own).join(start, F.col("__part") == F.col("__of")).withColumn(out, F.col("__before") + F.col("__own")).drop("__part", "__own", "__of", "__before", "__all")


def top_per_group(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def seeded_order(seed: str, *columns: str) -> Column:
    """A pseudorandom key that depends on the seed and the columns alone."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in columns]), 256)
