"""Queries of the library and the DuckDB SQL that gives the same rows."""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
