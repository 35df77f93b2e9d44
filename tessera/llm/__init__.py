"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; ``llm.queries`` holds the registered
queries and ``llm.oracles`` their SQL.
"""
