"""Queries over the driver's tables: for each name a DataFrame function and the equivalent DuckDB SQL."""
