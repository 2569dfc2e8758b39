"""All queries of the engine by name, and the SQL that checks them."""

from __future__ import annotations

from quillgraph.plans import document_queries, graph_queries, stream_queries, text_queries

MODULES = (text_queries, document_queries, graph_queries, stream_queries)
QUERIES: dict = {name: fn for m in MODULES for name, (fn, _) in m.ALL.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in MODULES for name, (_, sql) in m.ALL.items() if sql}
FLAGSHIP = "extract_inline_directives"
