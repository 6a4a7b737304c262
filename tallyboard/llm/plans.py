"""Registered queries of this subpackage and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyboard.llm import (
    ans,
    byte_bpe,
    decontaminate,
    fingerprint,
    jaccard_join,
    lexical,
    line_dedup,
    nearest,
    oracles,
    prefix_trie,
    quality,
    secrets,
    substring_dedup,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup.op1,
    "op2_byte_bpe": byte_bpe.op2,
    "op3_ans_output": ans.op3,
    "op4_secret_scan": secrets.op4,
    "op5_decontaminate": decontaminate.op5,
    "op6_jaccard_join": jaccard_join.op6,
    "op7_importance_resample": quality.op7,
    "op8_toxicity": toxicity.op8,
    "op9_fingerprint": fingerprint.op9,
    "op10_substring_dedup": substring_dedup.op10,
    "op11_adaptive_scan": nearest.op11,
    "op12_prefix_trie": prefix_trie.op12,
    "op13_ranked_search": lexical.op13,
}
ORACLES: dict[str, str] = dict(oracles.ORACLES)
