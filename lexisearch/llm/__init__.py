"""Operators for preparing training text at scale.

Each module holds one operator; :mod:`lexisearch.llm.registry` lists their
queries and SQL. Nothing outside this subpackage imports it.
"""
