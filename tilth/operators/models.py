"""Small fitted models whose sums are taken in Spark: how unlike training rows a row is, and one temperature.

What comes to the driver is as large as the square of the features, or a few numbers; rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilth.operators.graph import written

#: Values that a quantile is read from at last, and bins that values are counted in before.
FEW, BINS = 10_000, 1024


def exact_quantile(df: DataFrame, value: str, share: float) -> float | None:
    """The quantile by a straight line between neighbours in order, exactly: values are counted in bins, and the bin that
    the rank falls in is divided again until few values are left. A value that is everywhere costs no more than others."""
    held = df.select(F.col(value).cast("double").alias("x")).where(F.col("x").isNotNull())
    n, low, high = held.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if not n:
        return None

    def at_rank(rank: int) -> float:
        lo, hi, skipped = low, high, 0
        while True:
            inside = held.where((F.col("x") >= lo) & (F.col("x") <= hi))
            width = (hi - lo) / BINS
            if lo == hi or width == 0 or lo + width == lo:
                return lo if lo == hi else [r.x for r in inside.groupBy("x").count().orderBy("x").select("x").limit(FEW).collect()][0]
            number = F.least(F.floor((F.col("x") - lo) / width), F.lit(BINS - 1))
            counts = {r.b: (r.n, r.lo, r.hi) for r in inside.groupBy(number.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
            for b in sorted(counts):
                own, lo_b, hi_b = counts[b]
                if rank < skipped + own:
                    if own <= FEW:
                        values = sorted(r.x for r in inside.where(number == b).collect())
                        return values[rank - skipped]
                    lo, hi = lo_b, hi_b
                    break
                skipped += own

    at = share * (n - 1)
    below = int(np.floor(at))
    first = at_rank(below)
    return first if at == below else first + (at - below) * (at_rank(below + 1) - first)


@dataclass
class Unlikeness:
    """Means, scales, whitening directions and the score over which a row counts as unlike the training rows."""

    mean: np.ndarray
    scale: np.ndarray
    components: np.ndarray
    variance: np.ndarray
    threshold: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        u = ((x - self.mean) / self.scale) @ self.components.T / np.sqrt(self.variance)
        return (u**2).mean(axis=1)


def _rows(batch: pa.RecordBatch, size: int, rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for start in range(0, batch.num_rows, rows):
        part = batch.slice(start, rows)
        yield part, part.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def moments(df: DataFrame, features: str, size: int) -> DataFrame:
    """i, j and total: sums of products of features i <= j, with feature 0 the constant 1 (so 0, 0 counts rows). Rows
    without all features are left out."""
    usable = df.where((F.size(features) == size) & ~F.exists(features, lambda x: x.isNull() | F.isnan(x.cast("double")))).select(F.col(features).alias("x"))
    one, two = np.triu_indices(size + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            for _, x in _rows(batch, size):
                held = np.concatenate([np.ones((len(x), 1)), x], axis=1)
                total += held.T @ held
        yield pa.RecordBatch.from_arrays([pa.array(one.astype(np.int32)), pa.array(two.astype(np.int32)), pa.array(total[one, two])], names=["i", "j", "total"])

    return usable.mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))


def fit_unlikeness(df: DataFrame, features: str, size: int, kept: float = 0.95, share: float = 0.99) -> Unlikeness:
    """From training rows: standardised features, whitened along the directions that hold that share of their variance;
    the threshold is the quantile of the training rows' own scores."""
    total = np.zeros((size + 1, size + 1))
    for r in moments(df, features, size).collect():  # as many rows as pairs of features
        total[r.i, r.j] = total[r.j, r.i] = r.total
    n = total[0, 0]
    if n < 2:
        raise ValueError("too few training rows")
    mean = total[0, 1:] / n
    cov = total[1:, 1:] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 0))
    scale[scale < 1e-9] = 1.0
    variance, directions = np.linalg.eigh(cov / np.outer(scale, scale) * n / (n - 1))
    order = np.argsort(variance)[::-1]
    variance, directions = np.maximum(variance[order], 0), directions[:, order].T
    many = int(np.searchsorted(np.cumsum(variance) / variance.sum(), kept) + 1) if variance.sum() else 1
    model = Unlikeness(mean, scale, directions[:many], np.maximum(variance[:many], 1e-12))
    model.threshold = exact_quantile(written(unlikeness(df, features, size, model).select("score")), "score", share)
    return model


def unlikeness(df: DataFrame, features: str, size: int, model: Unlikeness) -> DataFrame:
    """df with score, and ood where the model has a threshold; null for rows without all features."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    whole = F.coalesce((F.size(features) == size) & ~F.exists(features, lambda x: x.isNull() | F.isnan(x.cast("double"))), F.lit(False))
    box = df.select(F.when(whole, F.col(features)).otherwise(F.array_repeat(F.lit(None).cast("double"), size)).cast("array<double>").alias("x"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _rows(batch, size):
                score = sent.value.scores(x)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(score, mask=np.isnan(score))], names=["row", "score"])

    out = box.mapInArrow(run, f"row {box.schema['row'].dataType.simpleString()}, score double").select("row.*", "score")
    return out if model.threshold is None else out.withColumn("ood", F.col("score") > model.threshold)


# ---------------------------------------------------------------- one temperature


def _logs(p: Column) -> Column:
    return F.transform(p, lambda x: F.log(F.least(F.lit(1.0), F.greatest(F.lit(1e-12), x.cast("double")))))


def _softened(logs: Column, sharpness: Column) -> Column:
    """exp of the sharpened logs, the largest being 1."""
    return F.transform(logs, lambda x: F.exp(sharpness * (x - F.array_max(logs))))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def tempered(p: Column, temperature: float) -> Column:
    """Class probabilities at a temperature: 1 leaves them, higher ones level them; their order stays."""
    soft = _softened(_logs(p), F.lit(1.0 / temperature))
    return F.transform(soft, lambda x: x / _sum(soft))


def fit_temperature(df: DataFrame, p: str, label: str, low: float = 0.05, high: float = 6.0, rounds: int = 60) -> dict[str, float]:
    """The temperature of the least mean log loss, that loss and the loss at 1. p: class probabilities; label: the true
    class's place. The loss is convex in 1 / temperature, so Newton steps on it, each one aggregate, find the least; a step
    that leaves what is known to hold the least is halved into it."""
    rows = written(df.where(F.col(p).isNotNull() & F.col(label).isNotNull()).select(_logs(F.col(p)).alias("logs"), F.col(label).cast("int").alias("y")))

    def at(sharpness: float) -> tuple[float, float, float]:
        soft = rows.select("logs", "y", _softened(F.col("logs"), F.lit(sharpness)).alias("w")).withColumn("s", _sum(F.col("w")))
        mean = _sum(F.zip_with("w", "logs", lambda w, x: w * x)) / F.col("s")
        square = _sum(F.zip_with("w", "logs", lambda w, x: w * x * x)) / F.col("s")
        own = F.get("logs", F.col("y"))
        loss = F.log("s") + sharpness * F.array_max("logs") - sharpness * own
        return tuple(soft.agg(F.avg(loss), F.avg(mean - own), F.avg(square - mean * mean)).first())

    least, most = 1 / high, 1 / low
    before, slope, curve = at(1.0)
    if before is None:
        raise ValueError("no calibration rows")
    x, loss = 1.0, before
    for _ in range(rounds):
        least, most = (x, most) if slope < 0 else (least, x)
        new = x - slope / curve if curve > 0 else (least + most) / 2
        if not least <= new <= most:
            new = (least + most) / 2
        if abs(new - x) <= 1e-12 * max(1.0, x):
            break
        x = new
        loss, slope, curve = at(x)
    return {"temperature": 1 / x, "loss": loss, "loss_before": before}
