"""Registry of the queries and SQL of this subpackage."""

from importlib import import_module

MODULES = ("q_text", "q_languages", "q_pii", "q_answers", "q_mixture", "q_votes")
QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _module = import_module(f"palaver.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
