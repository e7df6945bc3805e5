"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, infill, jaccard, maxent, media, packing, quality, repair, secrets, substring, topk, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": media.op1_media,
    "op2_secrets": secrets.op2_secrets,
    "op3_quality": quality.op3_quality,
    "op7_toxicity": toxicity.op7_toxicity,
    "op4_topk": topk.op4_topk,
    "op5_substring": substring.op5_substring,
    "op6_packing": packing.op6_packing,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_warc": warc.op9_warc,
    "op10_bpe": bpe.op10_bpe,
    "op11_infill": infill.op11_infill,
    "op12_repair": repair.op12_repair,
    "op13_maxent": maxent.op13_maxent,
}

ORACLE_SQL: dict[str, str] = {
    "op4_topk": topk.OP4_SQL,
    "op5_substring": substring.OP5_SQL,
    "op8_jaccard": jaccard.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
    "op11_infill": infill.OP11_SQL,
    "op12_repair": repair.OP12_SQL,
}
