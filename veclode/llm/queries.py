"""The queries of the operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, chat, classifier, conversations, decontaminate, fingerprints, languages, mixing, neardup, rules, secrets, sharding, suffixes
from .sql import ORACLES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [rules.op1_quality_rules, suffixes.op2_suffix_dedup, classifier.op3_quality_classifier, decontaminate.op4_decontaminate, fingerprints.op5_fingerprint_dedup, chat.op6_chat, secrets.op7_secrets, neardup.op8_near_dedup, sharding.op9_sharding, mixing.op10_mixing, centroids.op11_centroids, languages.op12_languages, conversations.op13_conversations]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
