"""Queries and SQL of this subpackage, by the names that __spark_entry__ registers."""

from __future__ import annotations

from importlib import import_module

#: Query name and the module that has its query(), and its SQL where DuckDB can express it.
MODULES = {
    "op2_packing": "packing",
    "op5_minhash_near_dedup": "minhash_dedup",
    "op6_secret_scan": "secret_scan",
    "op9_chat_formatting": "chat_format",
    "op1_sentencepiece": "sentencepiece_scan",
    "op3_token_counts": "token_counts",
    "op4_license_scan": "license_scan",
    "op7_embedding_near_dedup": "embedding_dedup",
    "op10_language_id": "language_id",
    "op8_exact_dedup": "exact_dedup",
}


def queries() -> dict:
    return {name: import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
