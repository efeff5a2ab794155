"""Queries and oracle SQL of the training-data operators, for the driver's entry module."""

from __future__ import annotations

import importlib

#: query name -> module of this subpackage that defines it
MODULES = {
    "op1_ann": "ann",
    "op4_pii": "pii",
    "op7_warc": "warc",
    "op2_substring_dedup": "substring",
    "op6_simhash": "simhash",
    "op9_packing": "packing",
    "op5_byte_bpe": "bpe",
    "op3_language_id": "language",

    "op8_url_filter": "urls",
    "op10_quality": "quality",
    "op11_prefix_trie": "trie",
    "op12_structure_repair": "repair",
    "op13_bestfit_packing": "bestfit",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f".{module}", __package__), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in MODULES.items():
        if sql := getattr(importlib.import_module(f".{module}", __package__), "ORACLE_SQL", None):
            out[name] = sql
    return out
