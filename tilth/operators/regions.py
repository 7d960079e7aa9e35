"""Regions of a map merged into fields: a contraction of their adjacency graph in rounds.

Specks join the neighbour they share the longest border with, the smallest speck first; then neighbours of one kind
dissolve. Specks that do not touch each other do not change each other's choice, so in a round every speck that is smaller
than all specks beside it joins at once, and the outcome is that of going through them one by one. No geometry is needed:
a merged region's border is the sum of its parts'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilth.operators import graph
from tilth.operators.graph import written

PASSES = 8


def speck_limit(least_field: float = 0.2, most: float = 0.05) -> float:
    """Hectares under which a region is a speck."""
    return min(most, max(0.015, 0.25 * least_field))


def absorbed(regions: DataFrame, borders: DataFrame, limit: float, passes: int = PASSES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(regions, borders, member): the regions left, with area and confidence as merged; the borders between them; and the
    region that each one is now part of. regions: id, area, kind, confidence; borders: a, b, length, each pair once or in
    both directions with a share of the length.

    What counts as a speck, and the order, is settled at the start of each of a few passes. A region's confidence is the
    mean, by area, over itself and the specks of its own kind that it took. Specks without a neighbour stay.
    """
    both = borders.unionByName(borders.select(F.col("b").alias("a"), F.col("a").alias("b"), "length")).where("a <> b")
    edges = written(both.groupBy("a", "b").agg(F.sum("length").alias("length")))
    left = written(regions.select("id", F.col("area").cast("double").alias("area"), "kind", (F.col("confidence") * F.col("area")).alias("held"), F.col("area").cast("double").alias("of")))
    member = written(regions.select("id", F.col("id").alias("into")))
    for _ in range(passes):
        specks = written(left.where((F.col("area") > 0) & (F.col("area") < limit)).select("id", F.col("area").alias("order")))
        merged = False
        while True:
            near = edges.join(specks.select(F.col("id").alias("a"), "order"), "a")
            other = near.join(specks.select(F.col("id").alias("b"), F.col("order").alias("other")), "b", "left")
            smaller = F.coalesce(F.struct("other", "b") < F.struct("order", "a"), F.lit(False)) & F.col("other").isNotNull()
            ready = other.groupBy("a").agg(F.max(smaller).alias("waits"), F.min_by("b", F.struct(-F.round("length", 9), "b")).alias("host")).where("NOT waits")
            moves = written(ready.select(F.col("a").alias("id"), "host"))
            if not moves.limit(1).count():
                break
            merged = True
            to = lambda c: (moves.withColumnsRenamed({"id": c, "host": f"{c}_host"}), c, "left")
            moved = edges.join(*to("a")).join(*to("b")).select(F.coalesce("a_host", "a").alias("a"), F.coalesce("b_host", "b").alias("b"), "length")
            edges = written(moved.where("a <> b").groupBy("a", "b").agg(F.sum("length").alias("length")))
            taken = left.join(moves, "id").join(left.select(F.col("id").alias("host"), F.col("kind").alias("host_kind")), "host")
            same = F.col("kind").eqNullSafe(F.col("host_kind"))
            gains = taken.groupBy(F.col("host").alias("id")).agg(F.sum("area").alias("more"), F.sum(F.when(same, F.col("held")).otherwise(0.0)).alias("more_held"), F.sum(F.when(same, F.col("of")).otherwise(0.0)).alias("more_of"))
            kept = left.join(moves, "id", "left_anti").join(gains, "id", "left")
            zero = lambda c: F.coalesce(c, F.lit(0.0))
            left = written(kept.select("id", (F.col("area") + zero("more")).alias("area"), "kind", (F.col("held") + zero("more_held")).alias("held"), (F.col("of") + zero("more_of")).alias("of")))
            specks = written(specks.join(moves, "id", "left_anti"))
            member = written(member.join(moves.select(F.col("id").alias("into"), "host"), "into", "left").select("id", F.coalesce("host", "into").alias("into")))
        if not merged:
            break
    return left.select("id", "area", "kind", F.try_divide("held", "of").alias("confidence")), edges, member


def fields(regions: DataFrame, borders: DataFrame, limit: float, dissolve: bool = True) -> tuple[DataFrame, DataFrame]:
    """(fields, member). fields: field_id (the smallest id of its regions left), kind, area, confidence by area, regions
    (how many given ones it is made of) and dominant, the id of its largest region; member: id and field_id of every given
    region. Without dissolve, neighbours of one kind stay apart."""
    left, edges, member = absorbed(regions, borders, limit)
    kind = left.select("id", "kind")
    if dissolve:
        alike = edges.join(kind.withColumnsRenamed({"id": "a", "kind": "kind_a"}), "a").join(kind.withColumnsRenamed({"id": "b", "kind": "kind_b"}), "b").where(F.col("kind_a").eqNullSafe(F.col("kind_b")))
        joined = graph.components(left.select(F.col("id").alias("node")), alike.select("a", "b"))
    else:
        joined = left.select(F.col("id").alias("node"), F.col("id").alias("component"))
    placed = written(member.join(joined, F.col("into") == F.col("node")).select("id", F.col("component").alias("field_id")))
    counts = placed.groupBy("field_id").agg(F.count(F.lit(1)).alias("regions"))
    by = left.join(joined, F.col("id") == F.col("node")).groupBy(F.col("component").alias("field_id")).agg(
        F.first("kind").alias("kind"), F.sum("area").alias("area"), F.try_divide(F.sum(F.col("confidence") * F.col("area")), F.sum("area")).alias("confidence"), F.min_by("id", F.struct(-F.round("area", 9), "id")).alias("dominant")
    )
    return by.join(counts, "field_id"), placed


def grid_borders(cells: DataFrame) -> DataFrame:
    """a, b and length, the number of cell sides between two regions. cells: row, column, region."""
    down = Window.partitionBy("column").orderBy("row")
    across = Window.partitionBy("row").orderBy("column")
    next_to = lambda w, at: F.when(F.lead(at).over(w) == F.col(at) + 1, F.lead("region").over(w))
    two = cells.select(F.col("region").alias("a"), F.array(next_to(down, "row"), next_to(across, "column")).alias("near"))
    sides = two.select("a", F.explode("near").alias("b")).where("b IS NOT NULL AND a <> b")
    return sides.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("length"))
