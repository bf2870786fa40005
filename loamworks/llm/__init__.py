"""Operations of a large-scale training-data pipeline. Nothing outside this subpackage imports it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("sharding", "mixing", "chat_format", "quality_rules", "ngram_join", "decontaminate", "token_counts", "token_ids", "html_extract", "quality_crf", "collocations", "token_alignment", "language_id")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").ORACLES.items()}
