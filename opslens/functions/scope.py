"""Tenant and environment scope (FIL-6..8, SCA-21, SCA-22).

Scope rules are user configuration: a handful of exact names and wildcard
patterns per tenant / environment. They become ``Column`` predicates (an OR
chain of ``==`` / ``like``), which Catalyst pushes into scans where the
column is a raw one. Very long include lists should instead be joined as a
broadcast semi join (:func:`scope_semi_join`).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match_any(col: str | Column, patterns: Sequence[str]) -> Column:
    """Exact match for plain names, case-insensitive LIKE for patterns with
    ``%``/``_``/``*`` wildcards (``*`` is turned into ``%``)."""
    c = F.upper(F.col(col) if isinstance(col, str) else col)
    cond = None
    for p in patterns:
        p = p.upper()
        if any(ch in p for ch in "%*"):
            x = c.like(p.replace("*", "%"))
        else:
            x = c == p
        cond = x if cond is None else (cond | x)
    return cond if cond is not None else F.lit(False)


@dataclass
class Tenant:
    name: str
    warehouse_patterns: list[str] = field(default_factory=list)
    database_patterns: list[str] = field(default_factory=list)
    user_prefix: str | None = None


def tenant_label(tenants: Sequence[Tenant], default: str = "Shared/Unclassified",
                 wh: str = "warehouse_name", db: str = "database_name", user: str = "user_name") -> Column:
    """SCA-21: first tenant whose warehouse, database or user rule matches."""
    out = None
    for t in tenants:
        cond = match_any(wh, t.warehouse_patterns) | match_any(db, t.database_patterns)
        if t.user_prefix:
            cond = cond | F.upper(F.col(user)).startswith(t.user_prefix.upper())
        out = F.when(cond, t.name) if out is None else out.when(cond, t.name)
    return out.otherwise(default) if out is not None else F.lit(default)


@dataclass
class Environments:
    prod: list[str] = field(default_factory=list)
    dev: list[str] = field(default_factory=list)
    other_prefix: str | None = None


def environment_label(envs: Environments, db: str = "database_name") -> Column:
    """SCA-22: PROD / DEV / other-non-prod / no database / shared."""
    c = F.col(db)
    out = F.when(match_any(c, envs.prod), "PROD").when(match_any(c, envs.dev), "DEV")
    if envs.other_prefix:
        out = out.when(F.upper(c).startswith(envs.other_prefix.upper()), "Other Non-Prod")
    return out.when(c.isNull() | (F.trim(c) == ""), "No Database Context").otherwise("Other / Shared")


def tenant_scope(include: Sequence[str], exclude: Sequence[str] = (), col: str = "warehouse_name",
                 keep_null: bool = False) -> Column:
    """FIL-6: include patterns AND NOT exclude patterns; optionally keep NULLs."""
    cond = match_any(col, include) if include else F.lit(True)
    if exclude:
        cond = cond & ~match_any(col, exclude)
    if keep_null:
        cond = cond | F.col(col).isNull()
    return cond


def environment_scope(envs: Environments, environment: str, col: str = "database_name",
                      keep_no_database: bool = False) -> Column:
    """FIL-7: rows of one environment, optionally keeping rows without a database."""
    pats = envs.prod if environment.upper() == "PROD" else envs.dev
    cond = match_any(col, pats)
    if keep_no_database:
        cond = cond | F.col(col).isNull() | (F.trim(F.col(col)) == "")
    return cond


def signal_scope(allowed: dict[str, Sequence[str]]) -> Column:
    """FIL-8: keep a row when at least one scope column has a value and every
    present value is allowed."""
    any_present = None
    all_ok = None
    for c, pats in allowed.items():
        present = F.col(c).isNotNull() & (F.trim(F.col(c)) != "")
        ok = ~present | match_any(c, pats)
        any_present = present if any_present is None else any_present | present
        all_ok = ok if all_ok is None else all_ok & ok
    return any_present & all_ok


def scope_semi_join(df: DataFrame, allowed: DataFrame, col: str) -> DataFrame:
    """FIL-6 for long lists: a broadcast left-semi join against the allowed
    names (the list is a configuration table; its size is the user's)."""
    return df.join(F.broadcast(allowed.select(F.upper(F.col(allowed.columns[0])).alias("_k")).distinct()),
                   F.upper(F.col(col)) == F.col("_k"), "left_semi")
