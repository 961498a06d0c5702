"""Operators of a training-data pipeline: texts, vectors and web records on Spark.

Nothing else in the library imports this package; ``queries`` holds the registered queries.
"""
