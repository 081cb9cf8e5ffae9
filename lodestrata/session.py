"""Session settings and shared storage that every plan of the library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings for a local session; a cluster session keeps its own.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    b = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in LOCAL_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Table ``name`` of a directory that holds one Parquet file or folder per table."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the session names none (tests, local runs) a folder is made and set once
    per application; on a cluster the setting is expected to be there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = os.environ.get("LODESTRATA_LOCAL_SHARED")
    if not made or not os.path.isdir(made):
        made = tempfile.mkdtemp(prefix="lodestrata-")
        os.environ["LODESTRATA_LOCAL_SHARED"] = made
    return f"file://{made}"


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Have the file system delete ``path`` when the application ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The written table survives the loss of any executor and cuts the lineage; the plan
    that reads it starts at a scan with exact sizes, so adaptive execution can use them.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    forget_at_exit(spark, path)
    return path


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_lodestrata_shipped", False):
        return
    root = Path(__file__).resolve().parent
    made = Path(tempfile.mkdtemp(prefix="lodestrata-code-")) / "lodestrata-code.zip"
    with zipfile.ZipFile(made, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(made))
    context._lodestrata_shipped = True


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores where its files have too few splits to keep half of them busy.

    For scans that feed work per row: a small table in one file would be one task. Tables
    of many splits are left as they are, so nothing is shuffled at scale. Results do not
    depend on it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, key) if 2 * df.rdd.getNumPartitions() <= cores else df
