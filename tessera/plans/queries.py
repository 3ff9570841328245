"""All queries of the library, with their SQL."""

from tessera.plans import places, questions, relational  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
