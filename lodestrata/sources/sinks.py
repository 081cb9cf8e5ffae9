"""Writing the flat table and account lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestrata.operators.flatten import stored


def kind_of(path: str) -> tuple[str, str]:
    """(format, path): ``.csv`` is CSV, a name without a suffix gets ``.parquet``, anything else is Parquet."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if name.lower().endswith(".csv"):
        return "csv", path
    return "parquet", path if "." in name.strip(".") else path.rstrip("/") + ".parquet"


def _files(df: DataFrame, single: bool) -> DataFrame:
    return df.coalesce(1) if single else df


def write_parquet(df: DataFrame, path: str, single: bool = False, mode: str = "overwrite") -> None:
    """Lists become JSON text. An empty table is written with its schema. ``single`` gives one
    file, for tables of a size that one task can write; by default every task writes its own."""
    _files(stored(df), single).write.mode(mode).parquet(path)


def csv_ready(df: DataFrame) -> DataFrame:
    """Booleans as ``True`` and ``False``."""
    flags = [n for n, t in df.dtypes if t == "boolean"]
    return df.withColumns({c: F.initcap(F.col(c).cast("string")) for c in flags}) if flags else df


def write_csv(df: DataFrame, path: str, single: bool = False, mode: str = "overwrite") -> None:
    """With a header; quotes doubled, null and empty both written as nothing."""
    w = _files(csv_ready(stored(df)), single).write.mode(mode).option("header", True).option("escape", '"')
    w.option("emptyValue", "").option("nullValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_table(df: DataFrame, path: str, single: bool = False, mode: str = "overwrite") -> str:
    """By the name's suffix; the path written. A failed job leaves nothing committed."""
    kind, path = kind_of(path)
    (write_csv if kind == "csv" else write_parquet)(df, path, single, mode)
    return path


def users_path(path: str) -> str:
    """``out/x.parquet`` gives ``out/x_users.csv``."""
    head, _, name = path.rstrip("/").rpartition("/")
    stem = name.rsplit(".", 1)[0] if "." in name.strip(".") else name
    return f"{head}/{stem}_users.csv" if head else f"{stem}_users.csv"


def write_users(accounts: DataFrame, path: str, single: bool = False) -> None:
    """The account list: one column ``username`` with a header, in the order of ``ord`` if there is
    one: files are in order of their names. ``single`` gives one file, written by one task."""
    ordered = accounts.orderBy("ord") if "ord" in accounts.columns else accounts
    _files(ordered.select("username"), single).write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
