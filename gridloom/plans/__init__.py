"""Queries over the test tables, one or more an operator, with their DuckDB SQL."""
