"""The queries of this folder, with their DuckDB SQL."""

from __future__ import annotations

from tidemark.llm import (
    queries_audit, queries_chat, queries_filter, queries_models, queries_prints, queries_secrets,
    queries_tokens,
)

MODULES = (queries_chat, queries_models, queries_filter, queries_secrets, queries_tokens,
           queries_prints, queries_audit)

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
