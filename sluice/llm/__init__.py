"""Operators for preparing language-model training data at corpus scale.

Each module holds one operator; ``queries`` registers the thin driver queries.
Nothing else in the library imports this subpackage.
"""
