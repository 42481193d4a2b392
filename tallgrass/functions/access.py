"""What roles may read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_scope(role: Column, scope: Column, grants: dict[str, list[str]]) -> Column:
    """Whether the role's grants name the scope. Unknown and null roles have none; a null scope is never granted."""
    allowed = F.lit(False)
    for name, scopes in grants.items():
        allowed = F.when(role == name, scope.isin(list(scopes))).otherwise(allowed)
    return F.coalesce(allowed, F.lit(False))


def may_read(role: str | None, kind: Column, access: dict[str, tuple[str, ...] | None]) -> Column:
    """Whether a role may read sections of a kind. access names the kinds of each role that reads some only; roles of None, and roles that it doesn't name, read all. A null kind is read by those alone."""
    kinds = access.get(role)
    return F.lit(True) if kinds is None else F.coalesce(kind.isin(*kinds), F.lit(False))
