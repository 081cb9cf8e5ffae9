import json

import pytest
from pyspark.sql import functions as F

from lodestrata.operators.flatten import flatten, flatten_json, splice_owner, stored
from lodestrata.schema import COLUMNS, REPO_NODE, _colons

USER = {"login": "u", "__typename": "User", "location": None, "company": "C", "bio": "B", "email": None, "followers": {"totalCount": 3}, "createdAt": "2020"}
ORG = {"login": "o", "__typename": "Organization", "location": "L", "email": "e", "description": "D"}
FULL = {
    "nameWithOwner": "u/r", "name": "r", "description": "d", "url": "x", "homepageUrl": "h", "createdAt": "1", "updatedAt": "2", "pushedAt": "3", "stargazerCount": 1, "forkCount": 2, "diskUsage": 9,
    "primaryLanguage": {"name": "Go"}, "languages": {"nodes": [{"name": "Pythön"}, None]}, "repositoryTopics": {"nodes": [{"topic": {"name": "t"}}, {"topic": None}, None]},
    "licenseInfo": {"key": "mit", "name": "MIT"}, "isFork": True, "isArchived": False, "isPrivate": False, "isTemplate": True, "hasWikiEnabled": True, "hasIssuesEnabled": False,
    "watchers": {"totalCount": 4}, "issues": {"totalCount": 5}, "owner": USER, "object": {"text": "readme"},
}


def nodes(spark, *rows):
    df = spark.createDataFrame([(json.dumps(r) if r is not None else None,) for r in rows], "j string")
    return df.select(F.from_json("j", REPO_NODE).alias("node"), "j")


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_full_user(spark):
    (r,) = rows(flatten(nodes(spark, FULL)))
    assert list(r) == COLUMNS and len(COLUMNS) == 33
    assert r["languages"] == ["Pythön"] and r["topics"] == ["t"]
    assert (r["owner_company"], r["owner_bio"], r["owner_followers"], r["owner_created_at"], r["owner_location"], r["readme_content"]) == ("C", "B", 3, "2020", None, "readme")
    (s,) = rows(stored(flatten(nodes(spark, FULL))))
    assert s["languages"] == '["Pyth\\u00f6n"]' and s["topics"] == '["t"]'


def test_organization_and_no_owner(spark):
    org, none = rows(flatten(nodes(spark, {**FULL, "owner": ORG}, {**FULL, "owner": None})))
    assert (org["owner_company"], org["owner_bio"], org["owner_followers"], org["owner_created_at"], org["owner_email"]) == ("", "D", 0, "", "e")
    assert [none[c] for c in COLUMNS if c.startswith("owner_")] == ["", "", "", "", "", "", 0, ""]


def test_null_parents_and_children(spark):
    empty = {**FULL, "primaryLanguage": None, "licenseInfo": None, "watchers": None, "issues": None, "languages": None, "repositoryTopics": {"nodes": None}, "object": None, "description": None, "diskUsage": None}
    (r,) = rows(flatten(nodes(spark, empty)))
    assert (r["primary_language"], r["license_key"], r["license_name"], r["watchers"], r["open_issues"], r["readme_content"]) == ("", "", "", 0, 0, "")
    assert r["languages"] == [] and r["topics"] == [] and r["description"] is None and r["disk_usage_kb"] is None
    (b,) = rows(flatten(nodes(spark, {**FULL, "object": {"text": None}})))
    assert b["readme_content"] in ("", None)


def test_null_nodes_vanish(spark):
    assert rows(flatten(nodes(spark, None, FULL, None)))[0]["nwo"] == "u/r"
    assert flatten(nodes(spark, None)).count() == 0


def test_missing_is_not_null(spark):
    bare, nulls = rows(flatten_json(nodes(spark, {"name": "x"}, {"name": None, "description": None, "stargazerCount": None, "owner": {"location": None}, "object": {"text": None}, "diskUsage": None}), "j"))
    assert (bare["name"], bare["description"], bare["stars"], bare["is_fork"], bare["readme_content"], bare["disk_usage_kb"]) == ("x", "", 0, False, "", 0)
    assert (nulls["name"], nulls["description"], nulls["stars"], nulls["owner_location"], nulls["readme_content"], nulls["disk_usage_kb"]) == (None, None, None, None, None, None)
    (dir_,) = rows(flatten_json(nodes(spark, {**FULL, "object": {}}), "j"))
    assert dir_["readme_content"] == ""
    (full,) = rows(flatten_json(nodes(spark, FULL), "j"))
    assert full == rows(flatten(nodes(spark, FULL)))[0]
    (org,) = rows(flatten_json(nodes(spark, {**FULL, "owner": ORG}), "j"))
    assert org["owner_bio"] == "D" and org["owner_company"] == ""


def test_splice_owner(spark):
    page = nodes(spark, FULL, {**FULL, "nameWithOwner": "u/s"}).agg(F.collect_list("node").alias("nodes"))
    page = page.withColumn("owner", F.expr("nodes[0].owner"))
    got = rows(splice_owner(page, "nodes", "owner"))
    assert sorted(r["nwo"] for r in got) == ["u/r", "u/s"] and {r["owner_login"] for r in got} == {"u"}


def test_projection_is_pruned(spark, tmp_path):
    path = str(tmp_path / "n")
    nodes(spark, FULL).select("node").write.parquet(path)
    plan = flatten(spark.read.parquet(path)).select("nwo", "stars")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<node:struct<nameWithOwner:string,stargazerCount:bigint>>" in plan


def test_clashing_column_names(spark):
    df = nodes(spark, FULL).withColumn("stars", F.lit("other")).withColumn("name", F.lit(1))
    assert rows(flatten(df))[0]["stars"] == 1


@pytest.mark.parametrize("ddl, out", [("a INT, b STRUCT<c: INT, d: INT>", "a: INT, b: STRUCT<c: INT, d: INT>")])
def test_colons(ddl, out):
    assert _colons(ddl) == out
