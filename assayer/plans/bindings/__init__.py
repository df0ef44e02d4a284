"""The operators bound to the given tables, each with the SQL that checks it."""

from assayer.plans.bindings import checks, governance, inventory, profiles, proposals, relationships  # noqa: F401
from assayer.plans.bindings.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
