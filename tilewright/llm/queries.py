"""The subpackage's queries, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, html_text, jaccard_join, language, mixing, pii, quality, secret_scan, suffix_dedup, toxicity
from .common import prepared, table
from .oracles import ORACLE_SQL  # noqa: F401  read by the driver's entry


def op1_secrets(spark, sf_dir):
    return secret_scan.secrets(table(prepared(spark), sf_dir, "documents"))


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.repeated_passages(table(prepared(spark), sf_dir, "documents"))


def op3_jaccard(spark, sf_dir):
    return jaccard_join.jaccard_components(table(prepared(spark), sf_dir, "documents"))


def op4_decontamination(spark, sf_dir):
    spark = prepared(spark)
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_lines(spark, sf_dir):
    return quality.quality(table(prepared(spark), sf_dir, "documents"))


def op6_mixture(spark, sf_dir):
    return mixing.mixture(table(prepared(spark), sf_dir, "documents"))


def op7_html_text(spark, sf_dir):
    return html_text.extracted(table(prepared(spark), sf_dir, "pages"))


def op8_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(prepared(spark), sf_dir, "documents"), table(prepared(spark), sf_dir, "labels"))


def op9_language(spark, sf_dir):
    return language.language(table(prepared(spark), sf_dir, "documents"))


def op10_personal_data(spark, sf_dir):
    return pii.personal_data(table(prepared(spark), sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_suffix_dedup, op3_jaccard, op4_decontamination, op5_quality_lines, op6_mixture, op7_html_text, op8_toxicity, op9_language, op10_personal_data)}
