"""Readers of loosely made files: strict CSV, commented CSV, JSON of several shapes; and the upsert of keyed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def strict_csv(spark: SparkSession, path: str, required: Sequence[str]) -> tuple[str, DataFrame | None]:
    """('available', rows) with every column as text and blank rows dropped, or ('invalid', None) where a required column is
    missing. A path that does not exist raises as any Spark read does."""
    rows = spark.read.csv(path, header=True, inferSchema=False, escape='"')
    if not set(required) <= set(rows.columns):
        return "invalid", None
    filled = [F.col(c).isNotNull() & (F.trim(c) != "") for c in rows.columns]
    any_filled = filled[0]
    for f in filled[1:]:
        any_filled = any_filled | f
    return "available", rows.where(any_filled)


def commented_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, comment="#")


def flexible_json(spark: SparkSession, path: str, names: dict[str, Sequence[str]]) -> DataFrame:
    """A row a field of a GeoJSON collection, of a {farms: []} document or of a plain list; each output column is the first
    non-blank of its names in the properties or at the top."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "features array<string>, farms array<string>").alias("d"), F.from_json("value", "array<string>").alias("items"))
    rows = raw.select(F.explode(F.coalesce("d.features", "d.farms", "items")).alias("row"))

    def first(options: Sequence[str]) -> Column:
        found = [F.get_json_object("row", f"$.{at}{name}") for name in options for at in ("properties.", "")]
        return F.coalesce(*[F.when(F.trim(x) != "", x) for x in found])

    return rows.select(*[first(options).alias(out) for out, options in names.items()])


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], updated: str) -> DataFrame:
    """Both tables' rows with the latest of each key; of rows as late as each other a new one, then the one with the
    greatest hash, so that the choice never hangs on the order of rows. A missing time is older than any."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    mark = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in both.columns])
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(updated), F.desc("__new"), F.desc(mark)))
    return both.withColumn("__rank", rank).where("__rank = 1").drop("__rank", "__new")


def alive(df: DataFrame, expires: str, now: Column | None = None) -> DataFrame:
    """Rows that have not expired; rows without an expiry stay."""
    return df.where(F.col(expires).isNull() | (F.col(expires) > (now if now is not None else F.current_timestamp())))
