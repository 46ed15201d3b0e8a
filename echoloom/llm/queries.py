"""The registered query of each operator, with production parameters, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoloom.llm import (bpe, decontaminate, hard_negatives, html_text, lm_score, mixing, quality_rules, simhash, sql, suffix_dedup, token_count,
                          url_filter, warc, whitening)
from echoloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: (verdict, host, path) of the URL rules
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]

#: the others go beyond SQL and are tested against brute force
ORACLES: dict[str, str] = {
    "op1_quality_rules": sql.QUALITY_RULES,
    "op3_url_filter": sql.url_filter(URL_RULES, url_filter.UNIT, url_filter.FOLLOW_PERCENT, url_filter.REST),
    "op9_warc": sql.WARC,
    "op12_mixing": sql.mixing(mixing.WEIGHTS, (mixing.SHARE.numerator, mixing.SHARE.denominator), mixing.MOST, mixing.SEED),
    "op13_hard_negatives": sql.hard_negatives(hard_negatives.POSITIVES, hard_negatives.NEGATIVES, hard_negatives.LOW, hard_negatives.HIGH),
}


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf, "documents"))


@query
def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("text_key")


@query
def op3_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge(table(spark, sf, "pages"), URL_RULES)


@query
def op4_bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(table(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query
def op5_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query
def op6_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    return lm_score.train_and_score(table(spark, sf, "documents"))


@query
def op7_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(table(spark, sf, "pages"))


@query
def op8_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf, "documents"))


@query
def op9_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(table(spark, sf, "pages"))


@query
def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_count.count(table(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


@query
def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


@query
def op12_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.plan(table(spark, sf, "documents"))


@query
def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
