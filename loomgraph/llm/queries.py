"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from . import chat, decontaminate, divergence, exact_dedup, licenses, ngram_join, packing, quality, secrets, suffix_dedup, toxicity, warc, whitening


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_secret_scan": secrets.op2_secret_scan,
        "op3_packing": packing.op3_packing,
        "op4_quality": quality.op4_quality,
        "op5_license_scan": licenses.op5_license_scan,
        "op6_ngram_join": ngram_join.op6_ngram_join,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_warc": warc.op9_warc,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_whitening": whitening.op11_whitening,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_chat_format": chat.op13_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": decontaminate.OP1_SQL,
        "op6_ngram_join": ngram_join.OP6_SQL,
        "op10_exact_dedup": exact_dedup.OP10_SQL,
        "op12_source_divergence": divergence.OP12_SQL,
    }
