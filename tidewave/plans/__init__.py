"""Registered queries of the signal operators and the DuckDB SQL of each that SQL can express."""

from tidewave.plans import scopes, shapes, studies, training  # noqa: F401  (registers its queries)
from tidewave.plans.catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
