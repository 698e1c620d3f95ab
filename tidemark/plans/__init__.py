"""All queries of the engine, by name."""

from tidemark.plans import batches, documents_out, landed, operations, runs, scalars, streams, structured  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
