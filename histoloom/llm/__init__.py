"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it. ``queries()`` and ``oracle_sql()``
of :mod:`histoloom.llm.catalog` list what the entry module registers.
"""
