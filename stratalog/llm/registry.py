"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

MODULES = {
    "op1_decontaminate": "op1_decontaminate",
    "op2_sentencepiece": "op2_sentencepiece",
    "op3_suffix_dedup": "op3_suffix_dedup",
    "op4_license_scan": "op4_licenses",
    "op5_katz_score": "op5_katz",
    "op6_pii": "op6_pii",
    "op7_warc": "op7_warc",
    "op8_toxicity": "op8_toxicity",
    "op9_minhash_dedup": "op9_dartminhash",
    "op10_embedding_dedup": "op10_capfilters",
}


def queries() -> dict:
    return {name: import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
