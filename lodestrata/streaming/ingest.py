"""Incremental ingest: raw nodes to the flat table, resumable at any point.

Each micro-batch is written by Spark's own sink with a checkpoint, so a batch is in the
table exactly once however often the job is stopped. What a run has done is in the
checkpoint; the next run takes up the rest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata.operators.flatten import flatten, flatten_json, stored


def node_stream(spark: SparkSession, directory: str, schema: str, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a directory, of which ``glob`` are read."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(directory)


def ingest(nodes: DataFrame, target: str, checkpoint: str, node: str = "node", kind: str = "parquet", available_now: bool = True) -> StreamingQuery:
    """Flatten a stream of nodes (structs, or JSON text) and append it to the table at ``target``."""
    flat = flatten_json(nodes, node) if dict(nodes.dtypes)[node] == "string" else flatten(nodes, node)
    w = stored(flat).writeStream.format(kind).option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    if kind == "csv":
        w = w.option("header", True).option("escape", '"')
    return (w.trigger(availableNow=True) if available_now else w).start()


def distinct_stream(df: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key on a stream; keys older than the watermark are forgotten."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def each_batch(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call ``fn`` for each micro-batch, once per batch number, until all that is there is read."""
    return df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unfinished(accounts: DataFrame, done: DataFrame, username: str = "username", owner: str = "owner_login") -> DataFrame:
    """Accounts that have no row in ``done`` yet: where a stopped run of lookups goes on."""
    d = done.select(F.col(owner).alias("__done")).distinct()
    return accounts.join(d, F.col(username) == F.col("__done"), "left_anti")
