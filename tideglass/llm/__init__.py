"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrame to DataFrame; ``queries`` binds them to the synthetic tables.
"""
