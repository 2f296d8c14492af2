"""All queries and their SQL; importing the modules registers them."""

from __future__ import annotations

from workload import more_oracle, more_queries
from workload.oracle import SQL
from workload.queries import QUERIES

__all__ = ["QUERIES", "SQL", "more_oracle", "more_queries"]
