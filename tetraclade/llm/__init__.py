"""Operators for preparing language-model training text.

Nothing outside this subpackage imports it; ``tetraclade.llm.queries`` lists the
registered queries and their SQL.
"""
