"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, conversations, decontamination, html_extraction, lexical, line_dedup, neighbours, ngram_join, pseudonyms, quality_compression, quality_rules, secrets, sharding

MODULES = (line_dedup, ngram_join, bpe, quality_rules, decontamination, pseudonyms, secrets, quality_compression, sharding, html_extraction, conversations, neighbours, lexical)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
