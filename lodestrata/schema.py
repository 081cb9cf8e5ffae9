"""Schemas: the nested repository node, account pages, response envelopes, and the flat table."""

from __future__ import annotations

#: A repository as the collection service returns it.
REPO_NODE = """
nameWithOwner STRING, name STRING, description STRING, url STRING, homepageUrl STRING,
createdAt STRING, updatedAt STRING, pushedAt STRING, stargazerCount BIGINT, forkCount BIGINT, diskUsage BIGINT,
primaryLanguage STRUCT<name: STRING>, languages STRUCT<nodes: ARRAY<STRUCT<name: STRING>>>,
repositoryTopics STRUCT<nodes: ARRAY<STRUCT<topic: STRUCT<name: STRING>>>>, licenseInfo STRUCT<key: STRING, name: STRING>,
isFork BOOLEAN, isArchived BOOLEAN, isPrivate BOOLEAN, isTemplate BOOLEAN, hasWikiEnabled BOOLEAN, hasIssuesEnabled BOOLEAN,
watchers STRUCT<totalCount: BIGINT>, issues STRUCT<totalCount: BIGINT>,
owner STRUCT<login: STRING, `__typename`: STRING, location: STRING, company: STRING, bio: STRING, email: STRING,
  followers: STRUCT<totalCount: BIGINT>, createdAt: STRING, description: STRING>,
`object` STRUCT<text: STRING>
"""
ACCOUNT = "login STRING, `__typename` STRING"
QUOTA = "remaining INT, resetAt STRING, `limit` INT, cost INT"
_NODE = " ".join(REPO_NODE.split())


def _colons(ddl: str) -> str:
    """Top-level ``name TYPE`` pairs of a DDL string as ``name: TYPE``, for use inside STRUCT<>."""
    out, depth, part = [], 0, ""
    for c in ddl + ",":
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            name, _, kind = part.strip().partition(" ")
            out.append(f"{name}: {kind}")
            part = ""
        else:
            part += c
    return ", ".join(out)


#: One page of repositories or accounts, and the envelope a response comes in.
REPO_PAGE = f"pageInfo STRUCT<hasNextPage: BOOLEAN, endCursor: STRING>, repositoryCount BIGINT, nodes ARRAY<STRUCT<{_colons(_NODE)}>>"
ACCOUNT_PAGE = f"pageInfo STRUCT<hasNextPage: BOOLEAN, endCursor: STRING>, userCount BIGINT, nodes ARRAY<STRUCT<{_colons(ACCOUNT)}>>"
ENVELOPE = "data STRING, errors ARRAY<STRUCT<message: STRING>>"

#: The flat table, in order.
FLAT = """
nwo STRING, name STRING, description STRING, url STRING, homepage_url STRING, created_at STRING, updated_at STRING, pushed_at STRING,
stars BIGINT, forks BIGINT, watchers BIGINT, open_issues BIGINT, disk_usage_kb BIGINT,
primary_language STRING, languages ARRAY<STRING>, topics ARRAY<STRING>,
is_fork BOOLEAN, is_archived BOOLEAN, is_private BOOLEAN, is_template BOOLEAN, has_wiki BOOLEAN, has_issues BOOLEAN,
license_key STRING, license_name STRING, owner_login STRING, owner_type STRING, owner_location STRING, owner_company STRING,
owner_bio STRING, owner_email STRING, owner_followers BIGINT, owner_created_at STRING, readme_content STRING
"""
COLUMNS = [c.split()[0] for c in " ".join(FLAT.split()).split(", ")]
#: List columns: arrays inside the engine, JSON strings at a sink.
LISTS = ["languages", "topics"]
STORED = FLAT.replace("ARRAY<STRING>", "STRING")
