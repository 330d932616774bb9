"""Registered queries over the shared tables, each with its check SQL."""

from . import batch_queries, file_queries, repair_queries, search_queries, text_queries

MODULES = (repair_queries, text_queries, search_queries, file_queries, batch_queries)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
