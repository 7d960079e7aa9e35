"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tilth.llm import byte_bpe, fingerprint, langid, lexical, lm_score, media, mixture, ngram_jaccard, pii, secrets, spelling, token_counts, toxicity
from tilth.llm.common import cut, table

#: A stand-in for the secret that a deployment brings; fixed, so that the query's rows can be compared.
PSEUDONYM_KEY = "tilth-demonstration-key"
Query = Callable[[SparkSession, str], DataFrame]


def multilingual_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.report(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_texts(table(spark, sf_dir, "documents"))


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.report(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.lengths(table(spark, sf_dir, "documents").select("text"), multilingual_ranks())
    return token_counts.answers(cut(token_counts.histogram(counted)))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), multilingual_ranks())


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_next(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.classes(table(spark, sf_dir, "documents"))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_lm_score": op1_lm_score,
    "op2_secrets": op2_secrets,
    "op3_media": op3_media,
    "op4_mixture": op4_mixture,
    "op5_token_counts": op5_token_counts,
    "op6_pii": op6_pii,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_fingerprint": op8_fingerprint,
    "op9_toxicity": op9_toxicity,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_language": op11_language,
    "op12_lexical_search": op12_lexical_search,
    "op13_spelling": op13_spelling,
}
SQL: dict[str, str] = {
    "op2_secrets": secrets.SQL,
    "op10_ngram_jaccard": ngram_jaccard.SQL,
    "op12_lexical_search": lexical.SQL,
    "op13_spelling": spelling.SQL,
}
