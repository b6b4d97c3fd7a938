"""Queries of the training-data operators, one module a kind of problem."""

from netspark.llm import graph_plans, text_plans

_MODULES = [graph_plans, text_plans]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
