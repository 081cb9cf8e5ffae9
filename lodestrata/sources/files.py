"""Reading recorded responses, flat tables and account lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestrata.functions.scalars import error_text
from lodestrata.operators.accounts import valid_logins
from lodestrata.schema import ACCOUNT_PAGE, ENVELOPE, QUOTA, REPO_PAGE, STORED, _colons


def responses(spark: SparkSession, path: str, bad: str = "fail") -> DataFrame:
    """Recorded responses, one JSON envelope ``{data, errors}`` per line: column ``data`` (JSON text).

    Errors are looked at first. ``bad='fail'`` stops at a response with errors or one that
    is no JSON, with its messages; ``'drop'`` leaves it out, ``'keep'`` keeps it with its
    messages in ``error``, for a table of failed requests.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    e = lines.select("value", F.from_json("value", ENVELOPE).alias("e"))
    message = F.when(F.size("e.errors") > 0, error_text("e.errors")).otherwise(F.when(F.col("e.data").isNull() & F.col("e.errors").isNull(), "no JSON response"))
    out = e.select(F.col("e.data").alias("data"), message.alias("error"), "value")
    if bad == "keep":
        return out
    if bad == "drop":
        return out.where("error is null").select("data")
    checked = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("data"))
    return out.select(checked.alias("data"))


def repository_nodes(pages: DataFrame, field: str = "search") -> DataFrame:
    """``page_no, node`` of the repository pages in ``data``; null nodes dropped, numbered in page order of the file only if given as ``page_no``."""
    page = F.from_json(F.col("data"), f"{field} STRUCT<{_colons(REPO_PAGE)}>")[field]
    keep = ["page_no"] if "page_no" in pages.columns else []
    return pages.select(*keep, F.explode(page["nodes"]).alias("node")).where("node is not null")


def account_nodes(pages: DataFrame, field: str = "search") -> DataFrame:
    """``login, kind`` of the account pages in ``data``; null nodes and empty logins dropped."""
    page = F.from_json(F.col("data"), f"{field} STRUCT<{_colons(ACCOUNT_PAGE)}>")[field]
    keep = ["page_no"] if "page_no" in pages.columns else []
    each = pages.select(*keep, F.posexplode(page["nodes"]).alias("pos", "n"))
    return valid_logins(each.select(*keep, "pos", F.col("n.login").alias("login"), F.col("n.__typename").alias("kind")))


def page_counts(pages: DataFrame, count: str, field: str = "search") -> DataFrame:
    """The server's count in each page (``userCount`` or ``repositoryCount``)."""
    return pages.select(F.get_json_object("data", f"$.{field}.{count}").cast("long").alias("cnt"))


def quota_records(pages: DataFrame) -> DataFrame:
    """The quota each response reports: ``remaining, resetAt, limit, cost``; parts it does not report are null."""
    return pages.select(F.from_json(F.get_json_object("data", "$.rateLimit"), QUOTA).alias("q")).where("q is not null").select("q.*")


def users_file(spark: SparkSession, path: str, max_users: int | None = None) -> DataFrame:
    """``username, ord`` of a saved account list: text as it is (``007``, ``NA``), repeats kept, in
    the order of the files' names and of the lines in each, which ``ord`` gives. The rows of one
    split of a file are numbered in turn, whatever order the splits are read in."""
    lines = spark.read.schema("username string").option("header", True).option("escape", "\"").option("emptyValue", "").csv(path)
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    numbered = lines.select("username", at.alias("ord")).where(F.col("username").isNotNull())
    if max_users is None:
        return numbered
    return numbered.orderBy("ord").limit(max_users) if max_users > 0 else numbered.where(F.lit(False))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A flat table written earlier, as CSV if the name says so, else Parquet; list columns are JSON text."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.schema(STORED).option("header", True).option("escape", '"').option("multiLine", True).option("emptyValue", "").csv(path)
    return spark.read.parquet(path)
