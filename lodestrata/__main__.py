"""Command line: ``python -m lodestrata`` over tables of repositories and accounts.

    --location PLACE | --query SEARCH | --repo OWNER/NAME   (the last given in the order repo, query, location wins)
    --repositories PATH  --owners PATH  --output PATH  [--min-stars 1] [--filter SEARCH] [--include-forks]
    [--max-users N] [--max-repos N] [--no-orgs] [--users-file PATH]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from lodestrata.plans import pipeline
from lodestrata.operators.accounts import accounts_by_location
from lodestrata.operators.search import total_order
from lodestrata.sources.files import read_table, users_file
from lodestrata.sources.sinks import users_path, write_table, write_users


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestrata", description="Select repositories by place, search or name.")
    p.add_argument("--location")
    p.add_argument("--query")
    p.add_argument("--repo")
    p.add_argument("--repositories", required=True, help="flat table of repositories")
    p.add_argument("--owners", help="table of accounts, for --location")
    p.add_argument("--output", "-o", required=True)
    p.add_argument("--min-stars", type=int, default=1)
    p.add_argument("--filter", default="", help="further qualifiers, in every mode")
    p.add_argument("--include-forks", action="store_true")
    p.add_argument("--max-users", type=int)
    p.add_argument("--max-repos", type=int)
    p.add_argument("--no-orgs", action="store_true")
    p.add_argument("--users-file", help="saved account list, instead of selecting accounts")
    return p


def select(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame | None]:
    """The result, and the account list if one was made."""
    repositories = read_table(spark, a.repositories)
    if a.repo:
        return pipeline.one_repository(repositories, a.repo), None
    if a.query:
        return pipeline.by_query(repositories, a.query, a.min_stars, a.max_repos, a.include_forks, a.filter), None
    if a.users_file:
        accounts, made = users_file(spark, a.users_file, a.max_users), None
    else:
        accounts = made = accounts_by_location(spark.read.parquet(a.owners), a.location, not a.no_orgs, a.max_users)
    found = pipeline.repositories_of(accounts, repositories, a.min_stars, a.include_forks, a.filter)
    if a.max_repos is not None:
        found = found.orderBy(*total_order(found, ["nwo"])).limit(a.max_repos)
    return found, made


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if not (a.repo or a.query or a.location or a.users_file):
        print("give --location, --query, --repo or --users-file", file=sys.stderr)
        return 1
    if a.location and not (a.repo or a.query or a.users_file or a.owners):
        print("--location needs --owners", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("lodestrata").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        found, accounts = select(spark, a)
        if accounts is not None:
            write_users(accounts, users_path(a.output))
        print(write_table(found, a.output))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
