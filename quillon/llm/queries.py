"""The registered queries opN_<name>: each operator over its whole table."""

from __future__ import annotations

from quillon.llm import (
    decontaminate, interaction, langid, mixing, pii, quality, secrets, sharding, simhash, tokencount, toxicity, urlfilter,
    variants,
)
from quillon.sources.scan import table as _table


def op1_quality_divergence(spark, sf_dir):
    return quality.judge(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark, sf_dir):
    return decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("hit_spans")


def op3_url_filter(spark, sf_dir):
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"))


def op4_mixing(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op5_pii(spark, sf_dir):
    return pii.detect(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark, sf_dir):
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"))


def op7_secrets(spark, sf_dir):
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op8_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_language_id(spark, sf_dir):
    return langid.identify(_table(spark, sf_dir, "documents"))


def op10_sharding(spark, sf_dir):
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op11_toxicity(spark, sf_dir):
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_filter_interaction(spark, sf_dir):
    return interaction.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_variant_grouping(spark, sf_dir):
    return variants.variants(_table(spark, sf_dir, "documents"))


def queries():
    return {
        f.__name__: f
        for f in (
            op1_quality_divergence, op2_decontaminate, op3_url_filter, op4_mixing, op5_pii, op6_token_counts,
            op7_secrets, op8_simhash, op9_language_id, op10_sharding, op11_toxicity,
            op12_filter_interaction, op13_variant_grouping,
        )
    }
