"""A training-corpus pipeline: toxic documents go, one document of each near-duplicate class stays, live secrets are
masked, sources are mixed to their weights, and the result is encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the
columns of documents. Rows with nulls stay through every stage: null text is never toxic, links with nothing, holds no
secret, has no words to mix and encodes to no ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.llm import byte_bpe, mixture, ngram_jaccard, secrets, toxicity
from tilth.llm.common import cut, table, unused
from tilth.llm.queries import multilingual_ranks


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold; the model learns from labelled documents of the learning folds."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.fold() != 1)
    score = unused(docs, "score")
    return toxicity.score(docs, model, out_col=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked documents: the one with the smallest id."""
    return ngram_jaccard.firsts(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the secrets that look live masked in its text and its length renewed. Owners are counted over
    the input, for once near copies are gone a widely copied example looks like one owner's."""
    return secrets.redact(docs, corpus=table(spark, sf_dir, "documents")).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of documents that the mix takes, with each text's length renewed."""
    return mixture.repeated(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a document: number of ids, and digests of the ids and of the bytes they decode to."""
    return byte_bpe.round_trip(docs, multilingual_ranks())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixture", mix_sources),
    ("byte_bpe", encode),
]

#: A trained classifier is no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's rows written out before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
