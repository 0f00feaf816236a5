"""Who may see which owner groups, as a ``Column`` predicate."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AccessScope:
    """Unrestricted, a set of owner groups, or (when the set is empty) nothing at all."""

    owner_groups: frozenset[str] = field(default_factory=frozenset)
    unrestricted: bool = False

    @classmethod
    def system(cls) -> AccessScope:
        return cls(unrestricted=True)

    @classmethod
    def groups(cls, *names: str) -> AccessScope:
        return cls(owner_groups=frozenset(n.strip() for n in names if n.strip()))

    @classmethod
    def nothing(cls) -> AccessScope:
        return cls()

    @property
    def is_empty(self) -> bool:
        return not self.unrestricted and not self.owner_groups

    def allows(self, group: str) -> bool:
        return self.unrestricted or group in self.owner_groups

    def narrow(self, groups: Iterable[str] = ()) -> AccessScope:
        """Intersect with ``groups``; an empty request keeps the scope, nothing ever widens it."""
        wanted = frozenset(g.strip() for g in groups if g.strip())
        if not wanted:
            return self
        if self.unrestricted:
            return AccessScope(owner_groups=wanted)
        return AccessScope(owner_groups=self.owner_groups & wanted)


def in_scope(scope: AccessScope, narrow_to: Iterable[str] = (), column: str = "owner_group") -> Column:
    """Rows the scope may see. Deny-all folds to an empty relation at planning time."""
    effective = scope.narrow(narrow_to)
    if effective.unrestricted:
        return F.lit(True)
    if effective.is_empty:
        return F.lit(False)
    return F.col(column).isin(sorted(effective.owner_groups))


def out_of_scope(scope: AccessScope, column: str = "owner_group") -> Column:
    """The complement: under deny-all everything is out of scope."""
    if scope.unrestricted:
        return F.lit(False)
    if scope.is_empty:
        return F.lit(True)
    return ~F.col(column).isin(sorted(scope.owner_groups))


def all_groups_readable(scope: AccessScope, groups: Column, gathered_by_system: Column) -> Column:
    """A stored bundle is readable only when every one of its groups is allowed."""
    if scope.unrestricted:
        return F.lit(True)
    if scope.is_empty:
        return F.lit(False)
    allowed = F.array(*[F.lit(g) for g in sorted(scope.owner_groups)])
    return ~gathered_by_system & (F.size(groups) > 0) & (F.size(F.array_except(groups, allowed)) == 0)
