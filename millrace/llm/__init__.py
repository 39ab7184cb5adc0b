"""Operators for preparing language-model training data, with their queries.

Nothing outside this package imports it. Every operator takes DataFrames and gives DataFrames.
"""
