"""Registered queries: the library's operators on the given tables, and the same results in DuckDB SQL."""
