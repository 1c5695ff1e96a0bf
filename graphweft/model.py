"""Ranks of the model's enumerations. Orders decide precedence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_KINDS = ("Import", "Call", "TypeUse", "Implements", "Documentation", "Asset", "Depends")
NO_CODE_FLOW = ("Documentation", "Asset")
TIERS = ("Proven", "PossibleSet", "Observed", "Unresolved")
ENTRY_KINDS = ("File", "Folder", "Symbol", "Command", "Tool", "Setting", "Route", "Flow", "Branch", "Worktree", "Ticket", "Session")
PATH_KINDS = ("File", "Folder", "Symbol")
MANIFESTS = ("Cargo.toml", "package.json", "pyproject.toml", "go.mod")


def rank(column: str | Column, order: tuple[str, ...]) -> Column:
    """Position of a value in order, from 0; null for others."""
    at = F.array_position(F.array(*map(F.lit, order)), column if isinstance(column, Column) else F.col(column))
    return F.when(at > 0, at - 1).cast("int")


def named(position: str | Column, order: tuple[str, ...]) -> Column:
    return F.try_element_at(F.array(*map(F.lit, order)), (F.col(position) if isinstance(position, str) else position).cast("int") + 1)
