"""Every core operator as a query over whole tables, with its SQL."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestrata.functions import scalars as X
from lodestrata.functions.jsonlist import json_to_list, list_to_json
from lodestrata.operators import flatten as P, rangesplit as R, search as S
from lodestrata.operators.accounts import accounts_by_location, first_occurrence, ordered_limit, valid_logins
from lodestrata.plans import pipeline as J
from lodestrata.schema import COLUMNS
from lodestrata.session import scratch, table
from lodestrata.sources import files, sinks
from lodestrata.streaming import ingest as I
from lodestrata.streaming.progress import observed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def repos(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "repositories")


def searched(text: str) -> Query:
    """The rows of a search, by their key and name."""
    return lambda spark, d: S.search(repos(spark, d), text).select("fetch_id", "nwo")


#: The UTC day of an ISO time in the two notations of the tables.
_DAY = "CAST(try_cast(substr({0}, 1, 19) AS TIMESTAMP) AS DATE)"
_HITS = "SELECT fetch_id, nwo FROM repositories WHERE "

#: One search per qualifier form: search string, and the condition in SQL.
SEARCHES = {
    "stars_floor": ("stars:>=10", "stars >= 10"),
    "stars_range": ("stars:2..20", "stars BETWEEN 2 AND 20"),
    "fork_exclusion": ("fork:false", "is_fork = false"),
    "language_word": ("language:PYTHON", "lower(coalesce(primary_language, '')) = 'python'"),
    "language_quoted": ('language:"TypeScript"', "lower(coalesce(primary_language, '')) = 'typescript'"),
    "size_floor": ("size:>=1000", "disk_usage_kb >= 1000"),
    "created_range": ("created:2020-01-01..2021-12-31", _DAY.format("created_at") + " BETWEEN DATE '2020-01-01' AND DATE '2021-12-31'"),
    "created_since": ("created:>=2023-06-15", _DAY.format("created_at") + " >= DATE '2023-06-15'"),
    "pushed_since": ("pushed:>=2024-03-01", _DAY.format("pushed_at") + " >= DATE '2024-03-01'"),
    "updated_before": ("updated:<2022-01-01", _DAY.format("updated_at") + " < DATE '2022-01-01'"),
    "license_key_eq": ("license:mit", "lower(coalesce(license_key, '')) = 'mit'"),
    "archived_only": ("archived:true", "is_archived"),
    "topic_member": ("topic:cli", """list_contains(list_transform(from_json(CASE WHEN topics <> '' THEN topics END, '["VARCHAR"]'), lambda x: lower(trim(x))), 'cli')"""),
    "owner_kind": ("type:org", "owner_type = 'Organization'"),
    "location_part": ("location:grad", "contains(lower(coalesce(owner_location, '')), 'grad')"),
    "negated_terms": ("-license:mit -fork:true", "lower(coalesce(license_key, '')) <> 'mit' AND NOT coalesce(is_fork, false)"),
    "qualifier_conjunction": ("language:python stars:>=1 fork:false pushed:>=2022-01-01 size:<100000",
        "lower(coalesce(primary_language, '')) = 'python' AND stars >= 1 AND is_fork = false AND disk_usage_kb < 100000 AND " + _DAY.format("pushed_at") + " >= DATE '2022-01-01'"),
}
for _name, (_text, _where) in SEARCHES.items():
    QUERIES[_name] = searched(_text)
    SQL[_name] = _HITS + _where


# ------------------------------------------------- accounts and joins

_AT = "SELECT owner_login, owner_type, account_id FROM owners WHERE coalesce(owner_login, '') <> '' AND owner_type IN ('User', 'Organization') AND contains(lower(coalesce(owner_location, '')), '{0}')"
_OWN = "SELECT r.fetch_id, r.nwo, r.owner_login, r.stars FROM repositories r JOIN accounts a ON a.owner_login = r.owner_login WHERE r.stars >= {0} AND r.is_fork = false"


@query(f"WITH accounts AS ({_AT.format('grad')}) {_OWN.format(1)}")
def two_step_location(spark: SparkSession, d: str) -> DataFrame:
    found = J.two_step(table(spark, d, "owners"), repos(spark, d), "grad")
    return found.select("fetch_id", "nwo", "owner_login", "stars")


@query(f"WITH accounts AS ({_AT.format('mouth')} ORDER BY owner_type <> 'User', account_id LIMIT 40) {_OWN.format(0)}")
def two_step_limited(spark: SparkSession, d: str) -> DataFrame:
    found = J.two_step(table(spark, d, "owners"), repos(spark, d), "MOUTH", max_users=40, min_stars=0, extra="stars:>=0")
    return found.select("fetch_id", "nwo", "owner_login", "stars")


@query("SELECT r.fetch_id, r.nwo, u.username FROM usernames u JOIN repositories r ON r.owner_login = u.username WHERE r.stars >= 1 AND r.is_fork = false")
def lookup_join_dup_keys(spark: SparkSession, d: str) -> DataFrame:
    found = J.repositories_of(table(spark, d, "usernames"), repos(spark, d))
    return found.select("fetch_id", "nwo", F.col("owner_login").alias("username"))


@query("SELECT fetch_id, nwo FROM repositories r WHERE EXISTS (SELECT 1 FROM usernames u WHERE u.username = r.owner_login)")
def owner_semi_join(spark: SparkSession, d: str) -> DataFrame:
    return J.repositories_of_distinct(table(spark, d, "usernames"), repos(spark, d)).select("fetch_id", "nwo")


@query("SELECT owner_login AS username, owner_type AS kind FROM owners WHERE owner_type IN ('User', 'Organization') AND coalesce(owner_login, '') <> ''")
def type_union_all(spark: SparkSession, d: str) -> DataFrame:
    return accounts_by_location(table(spark, d, "owners"), None).select("username", "kind")


@query("""SELECT username, kind FROM (SELECT owner_login AS username, owner_type AS kind, account_id FROM owners WHERE owner_type IN ('User', 'Organization')
AND coalesce(owner_login, '') <> '' ORDER BY owner_type <> 'User', account_id LIMIT 100)""")
def account_limit(spark: SparkSession, d: str) -> DataFrame:
    return accounts_by_location(table(spark, d, "owners"), None, max_users=100).select("username", "kind")


@query("SELECT username FROM usernames WHERE username IS NOT NULL AND username <> ''")
def account_scan(spark: SparkSession, d: str) -> DataFrame:
    return valid_logins(table(spark, d, "usernames"), "username")


@query("SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return first_occurrence(table(spark, d, "documents").select("doc_id", "text"), ["text"], ["doc_id"])


@query("SELECT DISTINCT username FROM usernames WHERE username IS NOT NULL AND username NOT IN (SELECT owner_login FROM repositories WHERE owner_login IS NOT NULL)")
def resume_unfinished(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "usernames").where("username is not null").distinct()
    return I.unfinished(names, repos(spark, d))


# ------------------------------------------------- filters, sort, lookup, counts


@query(_HITS + "contains(lower(coalesce(owner_location, '')), 'esti')")
def location_contains(spark: SparkSession, d: str) -> DataFrame:
    return repos(spark, d).where(S.contains("owner_location", "ESTI")).select("fetch_id", "nwo")


@query(_HITS + "coalesce(regexp_matches(owner_location, '(?i)polis|grad$'), false)")
def location_pattern(spark: SparkSession, d: str) -> DataFrame:
    return repos(spark, d).where(S.matches("owner_location", "polis|grad$")).select("fetch_id", "nwo")


@query(_HITS + "primary_language = 'Python'")
def language_eq(spark: SparkSession, d: str) -> DataFrame:
    return repos(spark, d).where(F.col("primary_language") == "Python").select("fetch_id", "nwo")


@query("SELECT fetch_id, nwo, stars FROM repositories ORDER BY stars DESC NULLS LAST, nwo, fetch_id LIMIT 100")
def topk_stars(spark: SparkSession, d: str) -> DataFrame:
    return ordered_limit(repos(spark, d).select("fetch_id", "nwo", "stars"), [F.desc_nulls_last("stars"), "nwo", "fetch_id"], 100)


_FIRST = "first_fetch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nwo ORDER BY fetch_id) AS rn FROM repositories) WHERE rn = 1)"


def first_fetch(spark: SparkSession, d: str) -> DataFrame:
    columns = ["fetch_id", "nwo", "name", "owner_login", "owner_location", "primary_language", "stars", "is_fork"]
    return first_occurrence(repos(spark, d).select(*columns), ["nwo"], ["fetch_id"])


@query(f"""WITH {_FIRST} SELECT fetch_id, nwo, stars FROM first_fetch WHERE stars >= 5 AND lower(coalesce(primary_language, '')) = 'python' ORDER BY stars DESC, nwo LIMIT 50""")
def search_sorted(spark: SparkSession, d: str) -> DataFrame:
    return J.by_query(first_fetch(spark, d), "language:python sort:stars", min_stars=5, limit=50).select("fetch_id", "nwo", "stars")


@query(f"""WITH {_FIRST} SELECT fetch_id, nwo, stars FROM first_fetch WHERE stars >= 2 AND contains(lower(coalesce(owner_location, '')), 'vik') ORDER BY stars DESC, nwo LIMIT 60""")
def search_at_location(spark: SparkSession, d: str) -> DataFrame:
    return J.by_location(first_fetch(spark, d), "vik", min_stars=2, limit=60).select("fetch_id", "nwo", "stars")


@query(f"WITH {_FIRST} SELECT fetch_id, nwo, owner_login, name FROM first_fetch WHERE nwo = (SELECT max(nwo) FROM repositories WHERE owner_login <> '')")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = first_fetch(spark, d)
    nwo = rows.where("owner_login <> ''").agg(F.max("nwo")).first()[0]
    return J.one_repository(rows, nwo or "/").select("fetch_id", "nwo", "owner_login", "name")


@query("SELECT fetch_id, nwo FROM repositories r WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT node.nameWithOwner AS n FROM repo_nodes) x WHERE x.n = r.owner_login || '/' || r.name)")
def lookup_many(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "repo_nodes").select(F.col("node.nameWithOwner").alias("nwo")).where("nwo is not null")
    return J.lookup_names(repos(spark, d), names).select("fetch_id", "nwo")


@query("SELECT count(*) AS scanned, count(*) FILTER (WHERE contains(lower(coalesce(owner_location, '')), 'mouth')) AS matched FROM repositories")
def matched_scanned(spark: SparkSession, d: str) -> DataFrame:
    return J.matched_and_scanned(repos(spark, d), S.contains("owner_location", "mouth"))


@query("SELECT count(*) AS cnt FROM owners WHERE owner_type = 'User' AND contains(lower(coalesce(owner_location, '')), 'grad')")
def account_count(spark: SparkSession, d: str) -> DataFrame:
    owners = table(spark, d, "owners")
    return owners.where(S.condition("location:grad type:user", owners, S.ACCOUNT)).agg(F.count("*").alias("cnt"))


# ------------------------------------------------- date ranges

_DAYS = "days AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1)"
_N = "coalesce((SELECT sum(n) FROM days WHERE d BETWEEN {0} AND {1}), 0)"
_MID = "s + CAST((e - s) // 2 AS INTEGER)"
_BISECT = f"""WITH RECURSIVE {_DAYS}, t(s, e, cnt, lvl) AS (
  SELECT DATE '1992-01-01', DATE '2003-12-31', CAST({_N.format("DATE '1992-01-01'", "DATE '2003-12-31'")} AS BIGINT), 0
  UNION ALL
  SELECT c.s, c.e, CAST({_N.format('c.s', 'c.e')} AS BIGINT), c.lvl + 1 FROM (
    SELECT s, CAST({_MID} AS DATE) AS e, lvl FROM t WHERE cnt > 1000 AND e - s > 1
    UNION ALL SELECT CAST({_MID} + 1 AS DATE), e, lvl FROM t WHERE cnt > 1000 AND e - s > 1) c)
"""


def _leaves(spark: SparkSession, d: str) -> DataFrame:
    return R.bisect(table(spark, d, "orders"), F.col("o_orderdate"), date(1992, 1, 1), date(2003, 12, 31), 1000)


@query(_BISECT + "SELECT s, e, cnt, CAST(lvl AS INTEGER) AS lvl, cnt > 1000 AS truncated FROM t WHERE cnt > 0 AND (cnt <= 1000 OR e - s <= 1)")
def range_bisect(spark: SparkSession, d: str) -> DataFrame:
    return _leaves(spark, d)


@query(_BISECT + """SELECT o_orderkey, leaf_start, leaf_pos FROM (SELECT o.o_orderkey, t.s AS leaf_start, row_number() OVER (PARTITION BY t.s ORDER BY o.o_orderkey) AS leaf_pos
FROM orders o JOIN t ON CAST(o.o_orderdate AS DATE) BETWEEN t.s AND t.e WHERE cnt > 0 AND (cnt <= 1000 OR e - s <= 1)) WHERE leaf_pos <= 1000""")
def range_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return R.split_scan(rows, "o_orderdate", _leaves(spark, d), 1000, ["o_orderkey"]).select("o_orderkey", "leaf_start", "leaf_pos")


@query("""SELECT s, e, (SELECT count(*) FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN s AND e) AS cnt FROM (SELECT make_date(y, 1, 1) AS s, make_date(y, 12, 31) AS e FROM range(1990, 2005) r(y))""")
def range_count(spark: SparkSession, d: str) -> DataFrame:
    years = spark.range(1990, 2005).select(F.make_date(F.col("id").cast("int"), F.lit(1), F.lit(1)).alias("s"), F.make_date(F.col("id").cast("int"), F.lit(12), F.lit(31)).alias("e"))
    return R.range_counts(table(spark, d, "orders"), F.col("o_orderdate"), years)


# ------------------------------------------------- flattening

_LIST = "'[' || array_to_string(list_transform({0}, lambda x: '\"' || replace(replace(x, '\\', '\\\\'), '\"', '\\\"') || '\"'), ', ') || ']'"
_LANGS = "coalesce(list_transform(list_filter(node.languages.nodes, lambda x: x IS NOT NULL), lambda x: x.name), [])"
_TOPICS = "coalesce(list_transform(list_filter(node.repositoryTopics.nodes, lambda x: x IS NOT NULL AND x.topic IS NOT NULL), lambda x: x.topic.name), [])"
_FLAT = f"""node.nameWithOwner AS nwo, node.name AS name, node.description AS description, node.url AS url, node.homepageUrl AS homepage_url,
node.createdAt AS created_at, node.updatedAt AS updated_at, node.pushedAt AS pushed_at, node.stargazerCount AS stars, node.forkCount AS forks,
CASE WHEN node.watchers IS NULL THEN 0 ELSE node.watchers.totalCount END AS watchers, CASE WHEN node.issues IS NULL THEN 0 ELSE node.issues.totalCount END AS open_issues,
node.diskUsage AS disk_usage_kb, CASE WHEN node.primaryLanguage IS NULL THEN '' ELSE node.primaryLanguage.name END AS primary_language,
{_LIST.format(_LANGS)} AS languages, {_LIST.format(_TOPICS)} AS topics,
node.isFork AS is_fork, node.isArchived AS is_archived, node.isPrivate AS is_private, node.isTemplate AS is_template, node.hasWikiEnabled AS has_wiki, node.hasIssuesEnabled AS has_issues,
CASE WHEN node.licenseInfo IS NULL THEN '' ELSE node.licenseInfo.key END AS license_key, CASE WHEN node.licenseInfo IS NULL THEN '' ELSE node.licenseInfo.name END AS license_name,
CASE WHEN node.owner IS NULL THEN '' ELSE node.owner.login END AS owner_login, CASE WHEN node.owner IS NULL THEN '' ELSE node.owner.__typename END AS owner_type,
CASE WHEN node.owner IS NULL THEN '' ELSE node.owner.location END AS owner_location,
CASE WHEN node.owner.__typename = 'User' THEN node.owner.company ELSE '' END AS owner_company,
CASE WHEN node.owner IS NULL THEN '' WHEN node.owner.__typename = 'User' THEN node.owner.bio ELSE node.owner.description END AS owner_bio,
CASE WHEN node.owner IS NULL THEN '' ELSE node.owner.email END AS owner_email,
CASE WHEN node.owner IS NULL OR node.owner.followers IS NULL THEN 0 ELSE node.owner.followers.totalCount END AS owner_followers,
CASE WHEN node.owner.__typename = 'User' THEN node.owner.createdAt ELSE '' END AS owner_created_at,
CASE WHEN node.object IS NULL THEN '' ELSE node.object.text END AS readme_content"""


@query(f"SELECT node_id, {_FLAT} FROM repo_nodes WHERE node IS NOT NULL")
def flatten_nodes(spark: SparkSession, d: str) -> DataFrame:
    return P.stored(P.flatten(table(spark, d, "repo_nodes"), keep=["node_id"]))


@query(f"SELECT {_FLAT} FROM repo_nodes WHERE node IS NOT NULL AND node.owner IS NOT NULL")
def flatten_owner_pages(spark: SparkSession, d: str) -> DataFrame:
    """Each owner's page holds its nodes of one page number; owner fields are spliced in."""
    nodes = table(spark, d, "repo_nodes").where("node is not null and node.owner is not null")
    pages = nodes.groupBy("page_no", F.col("node.owner").alias("owner")).agg(F.collect_list("node").alias("nodes"))
    return P.stored(P.splice_owner(pages, "nodes", "owner"))


@query(f"SELECT page_no, node.nameWithOwner AS nwo, {_LIST.format(_TOPICS)} AS topics FROM repo_nodes WHERE node IS NOT NULL")
def page_scan(spark: SparkSession, d: str) -> DataFrame:
    """Pages as the service sends them, parsed from their JSON text."""
    nodes = table(spark, d, "repo_nodes")
    page = F.to_json(F.struct(F.struct(F.collect_list("node").alias("nodes")).alias("search")))
    pages = nodes.groupBy("page_no").agg(page.alias("data"))
    flat = P.flatten(files.repository_nodes(pages), keep=["page_no"])
    return P.stored(flat.select("page_no", "nwo", "topics"))


@query("SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def json_field(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""SELECT r.fetch_id, CASE WHEN o.account_id IS NULL THEN '' ELSE o.owner_email END AS email, CASE WHEN r.owner_type = 'User' THEN r.owner_company ELSE '' END AS company
FROM repositories r LEFT JOIN owners o ON o.owner_login = r.owner_login""")
def null_default(spark: SparkSession, d: str) -> DataFrame:
    owners = table(spark, d, "owners").select("owner_login", F.struct("account_id", "owner_email").alias("o"))
    joined = repos(spark, d).select("fetch_id", "owner_type", "owner_company", "owner_login").join(owners, "owner_login", "left")
    return joined.select("fetch_id", P.under(F.col("o"), "owner_email", "").alias("email"), F.when(F.col("owner_type") == "User", F.col("owner_company")).otherwise("").alias("company"))


_ITEMS = """from_json(CASE WHEN topics <> '' THEN topics END, '["VARCHAR"]')"""


@query(f"SELECT fetch_id, len({_ITEMS}) AS n, {_ITEMS}[1] AS first_topic FROM repositories")
def list_from_json(spark: SparkSession, d: str) -> DataFrame:
    items = json_to_list("topics")
    rows = repos(spark, d).select("fetch_id", F.when(F.col("topics") != "", items).alias("t"))
    return rows.select("fetch_id", F.when(F.col("t").isNotNull(), F.size("t")).cast("long").alias("n"), F.get("t", F.lit(0)).alias("first_topic"))


@query("""SELECT source, '[' || array_to_string(list_transform(list_sort(list(DISTINCT lang)), lambda x: '"' || x || '"'), ', ') || ']' AS langs FROM documents WHERE lang IS NOT NULL GROUP BY source""")
def list_to_json_text(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "documents").where("lang is not null").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("l"))
    return by.select("source", list_to_json("l").alias("langs"))


# ------------------------------------------------- scalars and operations


@query("SELECT fetch_id, nullif(updated_at, '') AS updated, substr(description, 1, 100) AS short, concat_ws(' ', nullif(primary_language, ''), license_key) AS words FROM repositories")
def text_scalars(spark: SparkSession, d: str) -> DataFrame:
    return repos(spark, d).select("fetch_id", X.iso_or_null("updated_at").alias("updated"), X.truncate("description").alias("short"), X.join_words(F.nullif(F.col("primary_language"), F.lit("")), "license_key").alias("words"))


@query("SELECT fetch_id, split_part(nwo, '/', 1) AS owner, split_part(nwo, '/', 2) AS repo FROM repositories WHERE len(string_split(nwo, '/')) = 2")
def split_name(spark: SparkSession, d: str) -> DataFrame:
    rows = repos(spark, d).select("fetch_id", "nwo").where(F.size(F.split("nwo", "/")) == 2)
    return rows.select("fetch_id", X.owner_and_name("nwo").alias("p")).select("fetch_id", F.col("p.owner").alias("owner"), F.col("p.name").alias("repo"))


_A, _B = _DAY.format("created_at"), _DAY.format("updated_at")


@query(f"SELECT fetch_id, CAST({_B} - {_A} AS BIGINT) AS days, CAST({_A} + CAST(floor(({_B} - {_A}) / 2.0) AS INTEGER) AS DATE) AS middle FROM repositories")
def date_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    rows = repos(spark, d).select("fetch_id", X.utc_date("created_at").alias("a"), X.utc_date("updated_at").alias("b"))
    return rows.select("fetch_id", F.datediff("b", "a").cast("long").alias("days"), X.middle_day("a", "b").alias("middle"))


@query("SELECT event_id, greatest(0, epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-05 12:00:00') + 5) AS wait FROM events")
def wait_time(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("reset"))
    now = F.timestamp_seconds(F.lit(1704456000))
    return events.select("event_id", X.wait_seconds("reset", now).alias("wait"))


@query("""SELECT event_id, 'Rate limit: ' || coalesce(CAST(k AS VARCHAR), '?') || '/5000 (resets at ' || CASE WHEN k % 7 = 0 THEN 'soon' WHEN k % 7 = 1 THEN '?' ELSE strftime(ts, '%H:%M:%S') END || ')' AS info
FROM (SELECT event_id, ts, CAST(props->>'k' AS BIGINT) AS k FROM events)""")
def quota_info(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))
    reset = F.when(F.col("k") % 7 == 0, "soon").when(F.col("k") % 7 == 1, "").otherwise(F.col("iso"))
    return e.select("event_id", X.quota_text("k", F.lit(5000), reset).alias("info"))


@query("SELECT event_id, event_type || '; ' || props AS message FROM events")
def error_join(spark: SparkSession, d: str) -> DataFrame:
    errors = F.array(F.struct(F.col("event_type").alias("message")), F.struct(F.col("props").alias("message")))
    return table(spark, d, "events").select("event_id", X.error_text(errors).alias("message"))


@query("SELECT CAST(k AS BIGINT) AS attempt, least(2.0 * power(2, k), 60)::DOUBLE AS delay FROM range(0, 12) r(k)")
def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(12).select(F.col("id").alias("attempt"), X.backoff_delay("id").alias("delay"))


@query("""SELECT fetch_id, CASE WHEN coalesce(primary_language, '') <> '' THEN 'language:' || primary_language || ' ' ELSE '' END || 'stars:>=' || CAST(coalesce(forks, 0) AS VARCHAR) || ' sort:stars' AS built,
CASE WHEN contains(coalesce(description, ''), 'stars:') OR coalesce(description, '') = '' THEN CASE WHEN coalesce(description, '') = '' THEN 'stars:>=3 sort:stars' ELSE description END ELSE description || ' stars:>=3' END AS custom FROM repositories""")
def search_builder(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return repos(spark, d).select("fetch_id", S.build_column(F.col("primary_language"), F.coalesce("forks", F.lit(0)), none).alias("built"), S.build_column(none, F.lit(3), F.col("description")).alias("custom"))


# ------------------------------------------------- sinks and incremental ingest


_ALL = ", ".join(COLUMNS)


@query(f"SELECT {_ALL} FROM repositories")
def parquet_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = sinks.write_table(repos(spark, d).select(*COLUMNS), scratch(spark, "table"))
    return files.read_table(spark, path)


_TEXTS = [c for c in COLUMNS if c not in ("is_fork", "is_archived", "is_private", "is_template", "has_wiki", "has_issues", "stars", "forks", "watchers", "open_issues", "disk_usage_kb", "owner_followers")]


@query("SELECT " + ", ".join(f"nullif({c}, '') AS {c}" if c in _TEXTS else c for c in COLUMNS) + " FROM repositories")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Null and empty are one in CSV."""
    path = sinks.write_table(repos(spark, d).select(*COLUMNS), scratch(spark, "table") + "/t.csv")
    return files.read_table(spark, path).select(*(F.nullif(F.col(c), F.lit("")).alias(c) if c in _TEXTS else F.col(c) for c in COLUMNS))


@query("SELECT username FROM usernames WHERE trim(username) <> ''")
def users_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A saved account list read back as text."""
    path = scratch(spark, "users")
    sinks.write_users(table(spark, d, "usernames").where(F.trim("username") != ""), path, single=False)
    return files.users_file(spark, path).select("username")


@query(f"SELECT {_FLAT} FROM repo_nodes WHERE node IS NOT NULL")
def incremental_ingest(spark: SparkSession, d: str) -> DataFrame:
    """All nodes through a stream of one file a batch, stopped after its first batches and taken up again."""
    source, target, checkpoint = (scratch(spark, x) for x in ("nodes", "ingested", "progress"))
    nodes = table(spark, d, "repo_nodes")
    nodes.repartition(4, "node_id").write.parquet(source)
    run = lambda: I.ingest(I.node_stream(spark, source, nodes.schema, files_per_batch=1), target, checkpoint)
    first = run()
    while first.isActive and first.lastProgress is None:
        time.sleep(0.02)
    first.stop()
    run().awaitTermination()
    return spark.read.parquet(target)


@query("SELECT count(*) AS scanned, count(*) FILTER (WHERE stars >= 10) AS matched FROM repositories")
def observed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts taken in flight while another job runs."""
    df, seen = observed(repos(spark, d).select("stars"), F.col("stars") >= 10, f"counts-{uuid.uuid4().hex}")
    df.write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame([(got["scanned"], got["matched"])], "scanned long, matched long")


# ------------------------------------------------- recorded responses


def _recorded(spark: SparkSession, pages: DataFrame, data) -> DataFrame:
    """``data`` of the pages as responses of the service, written a line each and read again."""
    path = scratch(spark, "responses")
    pages.select(F.to_json(F.struct(F.to_json(data).alias("data"))).alias("value")).write.text(path)
    return files.responses(spark, path)


@query("SELECT owner_login AS login, owner_type AS kind FROM owners WHERE coalesce(owner_login, '') <> ''")
def recorded_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Account pages of a hundred, as the service sends them."""
    node = F.struct(F.col("owner_login").alias("login"), F.col("owner_type").alias("__typename"))
    pages = table(spark, d, "owners").groupBy(F.floor(F.col("account_id") / 100)).agg(F.struct(F.collect_list(node).alias("nodes")).alias("search"))
    return files.account_nodes(_recorded(spark, pages, F.struct("search"))).select("login", "kind")


@query("SELECT CAST(k AS INTEGER) AS remaining, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS resetAt, 5000 AS \"limit\", CAST(NULL AS INTEGER) AS cost FROM (SELECT ts, CAST(props->>'k' AS BIGINT) AS k FROM events)")
def quota_records(spark: SparkSession, d: str) -> DataFrame:
    """What responses report of the quota; a part they leave out is null."""
    quota = F.struct(F.from_json("props", "k bigint")["k"].alias("remaining"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("resetAt"), F.lit(5000).alias("limit"))
    return files.quota_records(_recorded(spark, table(spark, d, "events"), F.struct(quota.alias("rateLimit"))))


#: In JSON that names its nulls, an organisation's creation time is there and null.
_NAMED = _FLAT.replace("CASE WHEN node.owner.__typename = 'User' THEN node.owner.createdAt ELSE '' END", "CASE WHEN node.owner IS NULL THEN '' ELSE node.owner.createdAt END")


@query(f"SELECT {_NAMED} FROM repo_nodes WHERE node IS NOT NULL")
def flatten_json_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Nodes as JSON text that names its nulls: a null stays one."""
    nodes = table(spark, d, "repo_nodes").select(F.to_json("node", {"ignoreNullFields": "false"}).alias("node"))
    return P.stored(P.flatten_json(nodes, "node"))


_MISSING = {"name": "''", "description": "''", "homepage_url": "''", "stars": "0", "disk_usage_kb": "0", "pushed_at": "''", "is_fork": "false"}


@query("SELECT " + ", ".join(f"coalesce({c}, {x}) AS {c}" for c, x in _MISSING.items()) + f" FROM (SELECT {_FLAT} FROM repo_nodes WHERE node IS NOT NULL)")
def flatten_json_missing(spark: SparkSession, d: str) -> DataFrame:
    """Nodes as JSON text that leaves its nulls out: what is missing gets its default."""
    nodes = table(spark, d, "repo_nodes").where("node is not null").select(F.to_json("node").alias("node"))
    return P.flatten_json(nodes, "node").select(*_MISSING)


@query("SELECT owner_login AS username FROM owners WHERE coalesce(owner_login, '') <> '' ORDER BY account_id LIMIT 150")
def users_head(spark: SparkSession, d: str) -> DataFrame:
    """The first accounts of a list saved in several files."""
    path = scratch(spark, "users")
    accounts = valid_logins(table(spark, d, "owners"), "owner_login")
    sinks.write_users(accounts.select(F.col("owner_login").alias("username"), F.col("account_id").alias("ord")), path)
    return files.users_file(spark, path, 150).select("username")


@query(_HITS + "lower(coalesce(owner_login, '')) = (SELECT lower(max(owner_login)) FROM repositories)")
def user_word(spark: SparkSession, d: str) -> DataFrame:
    login = repos(spark, d).agg(F.max("owner_login")).first()[0] or "none"
    return S.search(repos(spark, d), S.Search((S.Term("user", login),))).select("fetch_id", "nwo")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Accounts at a place joined to their repositories."""
    return two_step_location(spark, d)



