"""The registered queries of this subpackage and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gradus.llm import (
    chat,
    decontaminate,
    exact_dedup,
    fill_middle,
    minmax,
    mixing,
    quality,
    secrets,
    shards,
    spelling,
    tokens,
    toxicity,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": mixing.op1_source_mix,
    "op2_token_counts": tokens.op2_token_counts,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_secrets": secrets.op4_secrets,
    "op5_chat_format": chat.op5_chat_format,
    "op6_quality": quality.op6_quality,
    "op7_warc": warc.op7_warc,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_near_dedup": minmax.op10_near_dedup,
    "op11_fill_in_middle": fill_middle.op11_fill_in_middle,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_sharding": shards.op13_sharding,
}

ORACLES: dict[str, str] = {
    "op1_source_mix": mixing.OP1_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op11_fill_in_middle": fill_middle.OP11_SQL,
}
