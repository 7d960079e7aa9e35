"""Exact token counts: a histogram of encoded lengths, and what its suffix sums answer.

Documents are encoded whole and counted by length; the histogram has one row a distinct length, however many documents
there are. Sums from the longest length down give, for any context limit, the documents that exceed it, their tokens
and the tokens left after truncation. The running sums go in two steps, within bands of lengths and over bands, so that
no task holds the whole histogram.

Defined cases: null text has length 0; repeated rows each count. An empty table has an empty histogram, totals of 0 and
null quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilth.llm.byte_bpe import encode
from tilth.llm.common import unused

#: Lengths summed together before the bands are.
BAND = 1024


def lengths(df: DataFrame, ranks_file: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """df with the number of tokens of each text; a column of that name is replaced."""
    ids = unused(df, "ids")
    return encode(df.drop(out_col), ranks_file, text_col, ids).withColumn(out_col, F.size(ids).cast("long")).drop(ids)


def histogram(counted: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """length, docs: documents of each encoded length."""
    return counted.groupBy(F.col(length_col).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("docs"))


def _sums(hist: DataFrame) -> DataFrame:
    """The histogram with docs and tokens from each length up, and of all."""
    hist = hist.withColumns({"band": F.floor(F.col("length") / BAND), "tokens": F.col("length") * F.col("docs")})
    bands = hist.groupBy("band").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    above = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    bands = bands.select("band", F.coalesce(F.sum("d").over(above), zero).alias("d"), F.coalesce(F.sum("t").over(above), zero).alias("t"), F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_tokens"))
    inside = Window.partitionBy("band").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hist.join(bands, "band").select("length", "docs", (F.sum("docs").over(inside) + F.col("d")).alias("docs_from"), (F.sum("tokens").over(inside) + F.col("t")).alias("tokens_from"), "all_docs", "all_tokens")


def answers(hist: DataFrame) -> DataFrame:
    """A row a distinct length, read as a context limit: docs of that length, docs and tokens over the limit, all docs and
    tokens, tokens after truncation to the limit, and the share of documents that fit.

    Between two lengths nothing changes but by the limit itself: a limit L has the docs over it of the next shorter row
    and truncated_tokens of that row plus (L - length) for each of them.
    """
    s = _sums(hist)
    over, over_tokens = F.col("docs_from") - F.col("docs"), F.col("tokens_from") - F.col("docs") * F.col("length")
    return s.select(
        "length",
        "docs",
        over.alias("docs_over"),
        over_tokens.alias("tokens_over"),
        "all_docs",
        "all_tokens",
        (F.col("all_tokens") - over_tokens + over * F.col("length")).alias("truncated_tokens"),
        ((F.col("all_docs") - over) / F.col("all_docs")).alias("share_fitting"),
    )


def at_limits(hist: DataFrame, limits: Sequence[int]) -> DataFrame:
    """A row a context limit: docs and tokens over it, tokens kept, blocks of that size the kept tokens fill."""
    wanted = hist.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    sums = [F.sum(F.when(F.col("length") > x, value)) for x in limits for value in (F.col("docs"), F.col("docs") * F.col("length"))]
    every = hist.agg(F.sum(F.col("docs") * F.col("length")).alias("all_tokens"), F.array(*[F.coalesce(s, F.lit(0).cast("long")) for s in sums]).alias("over"))
    at = F.array_position(F.lit([int(x) for x in limits]), F.col("context_limit")).cast("int")
    joined = wanted.join(F.broadcast(every))  # one row
    docs, tokens = F.element_at("over", 2 * at - 1), F.element_at("over", 2 * at)
    all_tokens = F.coalesce("all_tokens", F.lit(0).cast("long"))
    return joined.select("context_limit", docs.alias("docs_over"), tokens.alias("tokens_over"), all_tokens.alias("all_tokens"), (all_tokens - tokens + docs * F.col("context_limit")).alias("truncated_tokens"))


def quantile(answered: DataFrame, share: float) -> Column:
    """As an aggregate over answers(): the least length that the share of documents do not exceed."""
    return F.min(F.when(F.col("share_fitting") >= share, F.col("length"))).alias(f"q{round(share * 100)}")
