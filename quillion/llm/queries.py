"""Queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from quillion.llm import ann, chat, codes, decontaminate, licenses, neardup, pieces, quality, shards, toxicity, urls, warc, whitening

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_warc": warc.op2_warc,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_minhash_near_dedup": neardup.op7_minhash_near_dedup,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_learned_partitions": ann.op9_learned_partitions,
    "op10_sharding": shards.op10_sharding,
    "op11_elkan_codes": codes.op11_elkan_codes,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_url_filter": urls.op13_url_filter,
}

ORACLES = {
    "op2_warc": warc.OP2_SQL,
    "op3_benchmark_decontamination": decontaminate.OP3_SQL,
    "op8_chat_formatting": chat.OP8_SQL,
    "op10_sharding": shards.OP10_SQL,
    "op11_elkan_codes": codes.OP11_SQL,
    "op13_url_filter": urls.OP13_SQL,
}
