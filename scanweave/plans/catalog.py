"""All registered queries."""

from scanweave.plans.registry import QUERIES, SQL
from scanweave.plans import time_joins, sequences, clocks, spatial, statistics, scan_queries, evaluation, ingest, columns, modelling  # noqa: F401

__all__ = ["QUERIES", "SQL"]
