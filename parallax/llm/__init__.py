"""Operators for preparing language-model training data, each a Spark job over a whole table.

Nothing else in the package imports this subpackage.
"""
