"""All core queries and their SQL oracles, collected from the plan modules."""

from __future__ import annotations

from repoloom.plans import chunking, graph, nested, parsing, planted, rendering, retrieval, rollup, text

FLAGSHIP = "hybrid_topk"
_MODULES = (retrieval, nested, text, chunking, graph, rollup, parsing, planted, rendering)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
