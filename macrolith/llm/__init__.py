"""Training-data operators: one module each, all over plain Spark DataFrames.

Nothing else in the library imports this subpackage.
"""
