"""Operators for preparing language-model training data.

Each module holds one operator; ``queries.py`` registers one query per operator.
Nothing outside this subpackage imports it.
"""
