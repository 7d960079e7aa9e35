"""Samples by stratum, and blocks held out for testing.

Strata and blocks are aggregated first: a row a stratum, a row a block; the rounds run on those.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilth.operators.graph import written


def allocated(strata: DataFrame, total: int, least: int = 30) -> DataFrame:
    """stratum and samples: shares of the total by area, each stratum with at least `least` and no more than it has.

    Strata under their least or over their size are fixed there and the rest is shared anew, until nothing changes; what
    rounding leaves goes to the largest remainders. If the least alone are more than the total, each gets its least.
    strata: stratum, size, area; windows here run over one row a stratum.
    """
    every = Window.partitionBy(F.lit(0))
    over = lambda c: F.sum(c).over(every)
    rows = strata.select("stratum", F.col("size").cast("long").alias("size"), F.greatest(F.lit(0.0), F.coalesce(F.col("area").cast("double"), F.lit(0.0))).alias("area"))
    rows = rows.withColumn("floor", F.least(F.lit(least), "size")).withColumn("total", F.least(F.lit(total), over("size")))
    rows = written(rows.withColumns({"fixed": F.when((over("floor") >= F.col("total")) | (F.col("size") == 0), F.col("floor")).cast("long")}))
    while True:
        free = F.col("fixed").isNull()
        left = F.col("total") - F.coalesce(over("fixed"), F.lit(0))
        area = over(F.when(free, F.col("area")).otherwise(0.0))
        share = F.when(area > 0, left * F.col("area") / area).otherwise(left / over(free.cast("int")))
        shared = rows.withColumn("share", F.when(free, share))
        new = F.when(F.col("share") < F.col("floor"), F.col("floor")).when(F.col("share") > F.col("size"), F.col("size"))
        shared = written(shared.withColumn("now", F.when(F.col("share").isNotNull(), new).cast("long")))
        if not shared.where("now IS NOT NULL").limit(1).count():
            break
        rows = shared.withColumn("fixed", F.coalesce("fixed", "now")).drop("share", "now")
    base = F.floor("share")
    order = every.orderBy((F.col("share") - base).desc_nulls_last(), "stratum")
    able = F.when(F.col("share").isNotNull() & (base < F.col("size")), 1).otherwise(0)
    spare = F.col("total") - F.coalesce(over("fixed"), F.lit(0)) - over(F.coalesce(base, F.lit(0)))
    rounded = shared.withColumns({"base": base, "able": able, "spare": spare}).withColumn("place", F.sum("able").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    more = F.when((F.col("able") == 1) & (F.col("place") <= F.col("spare")), 1).otherwise(0)
    return rounded.select("stratum", F.coalesce(F.col("fixed"), F.col("base") + more).cast("long").alias("samples"))


def greedy_blocks(rows: DataFrame, quotas: Mapping[str, int], far: float = 150.0) -> DataFrame:
    """block, place (in the order of choice) and the classes' counts so far (got_<k>, k as in quotas): whole blocks until
    each class has its quota of eligible rows, or no block helps. Each choice is the block of the most quota filled for the
    share of the classes' rows that it takes from training, near ones before far ones; among equals the smallest block.

    rows: block, class, eligible, distance. One block comes to the driver a round, and there are no more rounds than the
    quotas' sum.
    """
    names = list(quotas)
    counted = rows.where(F.col("class").isin(names)).groupBy("block").agg(
        *[F.count_if(F.col("eligible") & (F.col("class") == c)).alias(f"gain_{k}") for k, c in enumerate(names)],
        *[F.count_if(F.col("class") == c).alias(f"loss_{k}") for k, c in enumerate(names)],
        F.min("distance").alias("distance"),
    )
    blocks = written(counted)
    pool = blocks.agg(*[F.sum(f"loss_{k}") for k in range(len(names))]).first()
    got, chosen = [0] * len(names), []
    while any(g < quotas[c] for g, c in zip(got, names)):
        fills = sum((F.least(F.col(f"gain_{k}"), F.lit(max(quotas[c] - got[k], 0))) / F.lit(quotas[c]) for k, c in enumerate(names)), F.lit(0.0))
        cost = sum((F.col(f"loss_{k}") / F.lit(max(pool[k] or 0, 1)) for k in range(len(names))), F.lit(0.0)) + 1e-3
        open_ = blocks.where(~F.col("block").isin([b for b, *_ in chosen])) if chosen else blocks
        scored = open_.withColumn("score", F.round(fills / cost / (1 + F.col("distance") / far), 12)).where("score > 0")
        best = scored.agg(F.min_by(F.struct("*"), F.struct(-F.col("score"), F.col("block"))).alias("b")).first().b
        if best is None:
            break
        got = [g + best[f"gain_{k}"] for k, g in enumerate(got)]
        chosen.append((best["block"], len(chosen) + 1, *got))
    kind = dict(blocks.dtypes)["block"]
    return rows.sparkSession.createDataFrame(chosen, f"block {kind}, place int, " + ", ".join(f"got_{k} long" for k in range(len(names))))
