"""All queries outside the subpackage for training data."""

from __future__ import annotations

from loomgraph.plans import graph_queries, hierarchy_queries, source_queries, text_queries

FLAGSHIP = "blast_radius"
_MODULES = [hierarchy_queries, graph_queries, source_queries, text_queries]

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
SQL = {name: q for m in _MODULES for name, q in m.SQL.items()}
