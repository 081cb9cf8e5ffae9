"""Selecting accounts: by location and kind, without repeats, up to a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestrata.operators.search import contains


def first_occurrence(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key by ``order``, which must be total. Nulls are a key.

    An aggregate with map-side combine, not a window: a key that holds a third of all rows
    is combined before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    if rest == order:  # nothing but the order travels: a hash aggregate of one value
        return df.groupBy(*keys).agg(F.min(rest[0]).alias(rest[0])).select(*df.columns)
    by = F.struct(*(F.col(o) if isinstance(o, str) else o for o in order))
    row = F.min_by(F.struct(*rest), by).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, "__row.*").select(*df.columns)


def valid_logins(df: DataFrame, login: str = "login") -> DataFrame:
    """Without null and empty logins."""
    return df.where(F.coalesce(F.col(login), F.lit("")) != "")


def ordered_limit(df: DataFrame, order: list[Column | str], n: int | None) -> DataFrame:
    """The first ``n`` rows by a total order; 0 is none, null is all."""
    if n is None:
        return df
    return df.orderBy(*order).limit(n) if n > 0 else df.where(F.lit(False))


def accounts_by_location(owners: DataFrame, location: str | None, include_orgs: bool = True, max_users: int | None = None,
                         login: str = "owner_login", kind: str = "owner_type", place: str = "owner_location", order: str = "account_id") -> DataFrame:
    """``username, kind, ord`` of the accounts at a place: users first, then organizations.

    One scan: the two branches differ in their kind only. Logins are distinct inside a kind
    (first by ``order``), not across kinds. ``max_users`` counts users before organizations.
    """
    kinds = ["User", "Organization"] if include_orgs else ["User"]
    at = valid_logins(owners, login).where(F.col(kind).isin(kinds) & contains(place, location))
    rows = at.select(F.col(login).alias("username"), F.col(kind).alias("kind"), F.col(order).alias("ord"))
    distinct = first_occurrence(rows, ["kind", "username"], ["ord"])
    return ordered_limit(distinct, [F.desc(F.col("kind") == "User"), "ord"], max_users)
