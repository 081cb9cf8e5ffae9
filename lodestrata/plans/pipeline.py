"""The engine's jobs: accounts at a place with their repositories, a search, a single repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestrata.functions.scalars import owner_and_name
from lodestrata.operators import search as S
from lodestrata.operators.accounts import accounts_by_location


def repositories_of(accounts: DataFrame, repositories: DataFrame, min_stars: int = 1, include_forks: bool = False, extra: str = "",
                    username: str = "username", owner: str = "owner_login") -> DataFrame:
    """The repositories of listed accounts that meet the filters: an inner join.

    A login listed twice gives its repositories twice; accounts without any vanish. The
    filters are on the scan side, so they reach the files. The join is left to the
    optimizer: it broadcasts a list whose size it knows to be small, otherwise both sides
    are shuffled and a hot owner is split by adaptive execution.
    """
    keep = repositories.where(owned_filter(repositories, min_stars, include_forks, extra))
    names = accounts.select(F.col(username).alias("__login")).where("__login is not null")
    return keep.join(names, F.col(owner) == F.col("__login"), "inner").drop("__login")


def owned_filter(repositories: DataFrame, min_stars: int = 1, include_forks: bool = False, extra: str = ""):
    text = " ".join([*([f"stars:>={min_stars}"] if min_stars > 0 else []), *([] if include_forks else ["fork:false"]), *([extra] if extra.strip() else [])])
    return S.condition(text, repositories)


def repositories_of_distinct(accounts: DataFrame, repositories: DataFrame, username: str = "username", owner: str = "owner_login") -> DataFrame:
    """As ``repositories_of`` for a list without repeats: a semi join, which never widens a row."""
    names = accounts.select(F.col(username).alias("__login"))
    return repositories.join(names, F.col(owner) == F.col("__login"), "left_semi")


def two_step(owners: DataFrame, repositories: DataFrame, location: str, include_orgs: bool = True, min_stars: int = 1, max_users: int | None = None,
             include_forks: bool = False, extra: str = "", accounts: DataFrame | None = None) -> DataFrame:
    """Accounts at a place (or a saved list), then their repositories."""
    listed = accounts if accounts is not None else accounts_by_location(owners, location, include_orgs, max_users)
    return repositories_of(listed, repositories, min_stars, include_forks, extra)


def by_location(repositories: DataFrame, location: str | None, min_stars: int = 1, language: str | None = None, limit: int | None = None) -> DataFrame:
    """Repositories by stars whose owner is at a place; the limit counts after the place filter."""
    s = S.parse(S.build(language, min_stars))
    return S.search(repositories.where(S.contains("owner_location", location)), s, limit)


def by_query(repositories: DataFrame, query: str, min_stars: int = 1, limit: int | None = None, include_forks: bool = True, extra: str = "") -> DataFrame:
    """Repositories that meet a search string, to which a floor of stars is added if it names none."""
    text = " ".join(x for x in (S.build(None, min_stars, query), "" if include_forks else "fork:false", extra) if x)
    return S.search(repositories, text, limit)


def one_repository(repositories: DataFrame, nwo: str) -> DataFrame:
    """The repository ``owner/name``, at most one row (the first by all columns); any other form of the name is an error."""
    if len(nwo.split("/")) != 2:
        raise ValueError(f"expected owner/name, got: {nwo}")
    owner, name = nwo.split("/")
    at = (F.col("owner_login") == owner) & (F.col("name") == name)
    return repositories.where(at).orderBy(*S.total_order(repositories, [])).limit(1)


def lookup_names(repositories: DataFrame, names: DataFrame, nwo: str = "nwo") -> DataFrame:
    """Many names at once: the rows of ``names`` (owner/name) that exist."""
    parts = names.select(owner_and_name(F.col(nwo)).alias("p")).select(F.col("p.owner").alias("__o"), F.col("p.name").alias("__n")).distinct()
    return repositories.join(parts, (F.col("owner_login") == F.col("__o")) & (F.col("name") == F.col("__n")), "left_semi")


def matched_and_scanned(df: DataFrame, condition) -> DataFrame:
    """``scanned, matched``: rows in all, and those that meet the condition."""
    return df.agg(F.count("*").alias("scanned"), F.count_if(condition).alias("matched"))
