"""Who asks: tenants, roles and what they may see."""

from __future__ import annotations

from typing import NamedTuple

#: Names that are no tenant.
ANONYMOUS, UNOWNED = "@anonymous@", "@unowned@"
#: Roles, and whether they see sensitive columns.
ROLES = {"analyst": True, "employee": False}


class Principal(NamedTuple):
    """A caller: the tenant, or ANONYMOUS, and the columns denied to the role."""

    tenant: str
    denied: frozenset[str] = frozenset()


def principal(tenant: str | None, role: str, sensitive: frozenset[str] = frozenset()) -> Principal:
    """Blank and reserved tenants are anonymous; an unknown role is an error, never a lesser role."""
    if role not in ROLES:
        raise ValueError(f"unknown role {role!r}")
    name = (tenant or "").strip()
    return Principal(ANONYMOUS if name in ("", ANONYMOUS, UNOWNED) else name, frozenset() if ROLES[role] else sensitive)
