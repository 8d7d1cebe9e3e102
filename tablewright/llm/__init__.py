"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it. :mod:`tablewright.llm.plans` binds each operator to the
shared tables.
"""
