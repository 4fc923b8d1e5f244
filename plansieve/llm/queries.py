"""Queries of the operators and their SQL, each over its whole table."""

from __future__ import annotations

from plansieve.llm import (
    bpe,
    decontam,
    jaccard_join,
    lm_score,
    oracle,
    pii,
    quality_classifier,
    quality_rules,
    sharding,
    token_count,
    url_filter,
)
from plansieve.llm.common import table


def op1_url_filter(spark, sf_dir):
    return url_filter.report(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op2_pii(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


def op3_lm_score(spark, sf_dir):
    return lm_score.report(table(spark, sf_dir, "documents"))


def op4_token_count(spark, sf_dir):
    return token_count.report(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark, sf_dir):
    return jaccard_join.report(table(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_byte_bpe(spark, sf_dir):
    return bpe.report(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark, sf_dir):
    return quality_rules.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_classifier(spark, sf_dir):
    return quality_classifier.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sharding(spark, sf_dir):
    return sharding.report(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_pii,
        op3_lm_score,
        op4_token_count,
        op5_jaccard_join,
        op6_decontamination,
        op7_byte_bpe,
        op8_quality_rules,
        op9_quality_classifier,
        op10_sharding,
    )
}
ORACLE_SQL: dict[str, str] = dict(oracle.SQL)
