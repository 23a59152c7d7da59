"""Every query of this package, with its SQL."""

from kbspark.llm import answers, conversations, encodings, leakage, packing, pages, quantiles

_MODULES = [answers, conversations, quantiles, pages, packing, leakage, encodings]
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
