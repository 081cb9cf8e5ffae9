"""Nested repository nodes to the flat 33-column table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestrata.functions.jsonlist import list_to_json
from lodestrata.schema import COLUMNS, LISTS, REPO_NODE


def names(list_: Column, pick) -> Column:
    """Names of a list of structs: null entries and null names' parents dropped, a null list is empty."""
    kept = F.filter(list_, lambda x: x.isNotNull() & pick(x).isNotNull())
    return F.coalesce(F.transform(kept, lambda x: pick(x)["name"]), F.array().cast("array<string>"))


def under(parent: Column, child: str, default) -> Column:
    """A child of a struct: the default only where the parent is null; a null child stays null."""
    return F.when(parent.isNull(), F.lit(default)).otherwise(parent[child])


def repository_columns(n: Column) -> dict[str, Column]:
    """The columns that do not come from the owner."""
    return {
        "nwo": n["nameWithOwner"], "name": n["name"], "description": n["description"], "url": n["url"], "homepage_url": n["homepageUrl"],
        "created_at": n["createdAt"], "updated_at": n["updatedAt"], "pushed_at": n["pushedAt"],
        "stars": n["stargazerCount"], "forks": n["forkCount"],
        "watchers": under(n["watchers"], "totalCount", 0).cast("long"), "open_issues": under(n["issues"], "totalCount", 0).cast("long"),
        "disk_usage_kb": n["diskUsage"], "primary_language": under(n["primaryLanguage"], "name", ""),
        "languages": names(n["languages"]["nodes"], lambda x: x), "topics": names(n["repositoryTopics"]["nodes"], lambda x: x["topic"]),
        "is_fork": n["isFork"], "is_archived": n["isArchived"], "is_private": n["isPrivate"], "is_template": n["isTemplate"],
        "has_wiki": n["hasWikiEnabled"], "has_issues": n["hasIssuesEnabled"],
        "license_key": under(n["licenseInfo"], "key", ""), "license_name": under(n["licenseInfo"], "name", ""),
        "readme_content": under(n["object"], "text", ""),
    }


def owner_columns(o: Column) -> dict[str, Column]:
    """The owner's columns. Fields that a kind of owner does not have get their default."""
    user = o["__typename"] == "User"
    none = o.isNull()
    only = lambda field, default: F.when(~none & user, o[field]).otherwise(F.lit(default))
    return {
        "owner_login": under(o, "login", ""), "owner_type": under(o, "__typename", ""), "owner_location": under(o, "location", ""),
        "owner_company": only("company", ""),
        "owner_bio": F.when(none, "").otherwise(F.when(user, o["bio"]).otherwise(o["description"])),
        "owner_email": under(o, "email", ""),
        "owner_followers": F.when(none | o["followers"].isNull(), F.lit(0)).otherwise(o["followers"]["totalCount"]).cast("long"),
        "owner_created_at": only("createdAt", ""),
    }


def flatten(df: DataFrame, node: str = "node", keep: list[str] | None = None) -> DataFrame:
    """One row of the flat table per node; null nodes are dropped.

    ``node`` holds structs in which every selected field is present, so a field that
    belongs to the other kind of owner is absent and gets its default, while a null stays
    null. ``keep`` names columns of ``df`` that go in front. It is one projection: unused
    columns, the readme above all, are not read.
    """
    n = F.col(node)
    cols = repository_columns(n) | owner_columns(n["owner"])
    return df.where(n.isNotNull()).select(*(keep or []), *(cols[c].alias(c) for c in COLUMNS))


def splice_owner(df: DataFrame, nodes: str, owner: str) -> DataFrame:
    """The flat table of an owner's page: the repositories of the array ``nodes``, each with the columns of the struct ``owner``."""
    each = df.select(F.col(owner).alias("__owner"), F.explode(nodes).alias("__node")).where(F.col("__node").isNotNull())
    cols = repository_columns(F.col("__node")) | owner_columns(F.col("__owner"))
    return each.select(*(cols[c].alias(c) for c in COLUMNS))


#: Defaults of plain fields that may be missing from a JSON object.
_PLAIN = {
    "nwo": ("nameWithOwner", ""), "name": ("name", ""), "description": ("description", ""), "url": ("url", ""), "homepage_url": ("homepageUrl", ""),
    "created_at": ("createdAt", ""), "updated_at": ("updatedAt", ""), "pushed_at": ("pushedAt", ""), "stars": ("stargazerCount", 0), "forks": ("forkCount", 0),
    "disk_usage_kb": ("diskUsage", 0), "is_fork": ("isFork", False), "is_archived": ("isArchived", False), "is_private": ("isPrivate", False),
    "is_template": ("isTemplate", False), "has_wiki": ("hasWikiEnabled", False), "has_issues": ("hasIssuesEnabled", False),
}
_OWNER = {"owner_login": ("login", ""), "owner_type": ("__typename", ""), "owner_location": ("location", ""), "owner_email": ("email", "")}


def flatten_json(df: DataFrame, json: str) -> DataFrame:
    """As ``flatten``, for any JSON text: a *missing* key gets the default, a key that is *null* stays null.

    Parsers give null for both, so the keys themselves are looked at. ``object`` is ``''``
    when null or empty, and null only when it holds a null text.
    """
    j, n = F.col(json), F.from_json(F.col(json), REPO_NODE)
    has = lambda text, key: F.coalesce(F.array_contains(F.json_object_keys(text), key), F.lit(False))
    sub = lambda path: F.get_json_object(j, path)
    base = df.where(j.isNotNull() & (F.trim(j) != "null")).withColumn("__n", n)
    node, cols = F.col("__n"), {}
    cols |= repository_columns(node) | owner_columns(node["owner"])
    for name, (key, default) in _PLAIN.items():
        cols[name] = F.when(has(j, key), node[key]).otherwise(F.lit(default))
    owner = sub("$.owner")
    for name, (key, default) in _OWNER.items():
        cols[name] = F.when(has(owner, key), node["owner"][key]).otherwise(F.lit(default))
    user = node["owner"]["__typename"] == "User"
    cols["owner_company"] = F.when(user & has(owner, "company"), node["owner"]["company"]).otherwise("")
    bio = F.when(has(owner, "bio"), node["owner"]["bio"]).otherwise("")
    about = F.when(has(owner, "description"), node["owner"]["description"]).otherwise("")
    cols["owner_bio"] = F.when(F.coalesce(user, F.lit(False)), bio).otherwise(about)
    cols["owner_created_at"] = F.when(has(owner, "createdAt"), node["owner"]["createdAt"]).otherwise("")
    for name, path, key, default in (("watchers", "$.watchers", "totalCount", 0), ("open_issues", "$.issues", "totalCount", 0), ("primary_language", "$.primaryLanguage", "name", ""), ("license_key", "$.licenseInfo", "key", ""), ("license_name", "$.licenseInfo", "name", ""), ("readme_content", "$.object", "text", "")):
        cols[name] = F.when(has(sub(path), key), cols[name]).otherwise(F.lit(default))
    cols["owner_followers"] = F.when(has(sub("$.owner.followers"), "totalCount"), node["owner"]["followers"]["totalCount"]).otherwise(F.lit(0))
    kinds = {"stars": "long", "forks": "long", "watchers": "long", "open_issues": "long", "disk_usage_kb": "long", "owner_followers": "long"}
    return base.select(*(cols[c].cast(kinds[c]).alias(c) if c in kinds else cols[c].alias(c) for c in COLUMNS))


def stored(df: DataFrame) -> DataFrame:
    """The table as it is written: list columns as JSON text."""
    return df.withColumns({c: list_to_json(c) for c in LISTS if c in df.columns and dict(df.dtypes)[c].startswith("array")})
