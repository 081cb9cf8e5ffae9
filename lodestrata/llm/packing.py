"""Filling fixed-capacity containers (problem 8): cost-balanced packing.

Only an item above the capacity is split: into full containers and one remainder. All
other items are packed whole. An item of n tokens costs ``n + n * n / capacity`` (the
linear part of a model and attention inside the document). Items go in descending order
to the sequence of the lowest cost that still has room, so that sequences end with like
costs; a sequence is opened only when no open one has room.

Packing runs in shards of a fixed number of items, which a seeded hash fills with a like
mix of lengths. A shard leaves a few containers partly empty, so the loss is a fixed small
share; no task ever sees more than one shard, however items are distributed.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Items packed together by one task call; a bound on its memory.
SHARD_ITEMS = 20_000
#: First guess of the share of capacity that gets filled.
FILL = 0.999


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container (from 0) of each item, none larger than ``capacity``."""
    order = np.argsort(-sizes, kind="stable")
    out = np.zeros(len(sizes), np.int64)
    start = max(1, math.ceil(sizes.sum() / (capacity * FILL)))
    room = [capacity] * start
    cost = [0.0] * start
    ready = [(0.0, i) for i in range(start)]
    aside: list[tuple[int, float, int]] = []  # containers that had too little room, by room
    for k in order:
        n = int(sizes[k])
        while aside and -aside[0][0] >= n:
            r, c, i = heapq.heappop(aside)
            heapq.heappush(ready, (c, i))
        while ready and room[ready[0][1]] < n:
            c, i = heapq.heappop(ready)
            heapq.heappush(aside, (-room[i], c, i))
        if ready:
            c, i = heapq.heappop(ready)
        else:
            c, i = 0.0, len(room)
            room.append(capacity)
            cost.append(0.0)
        room[i] -= n
        cost[i] = c + n + n * n / capacity
        heapq.heappush(ready, (cost[i], i))
        out[k] = i
    return out


def pack_documents(counted: DataFrame, ident: str, containers: DataFrame, shard_items: int = SHARD_ITEMS, seed: int = 11) -> DataFrame:
    """``container_name, container_id, <ident>, part_no, n_tokens, first_token`` of every part.

    ``counted`` has ``ident`` (integer, unique) and ``n_tokens``; ``containers`` has
    ``container_name`` and ``capacity_tokens``. Documents with no tokens (null or empty
    texts) take no space and are not assigned. ``container_id`` is unique in a container
    name and has no meaning beyond that; ``first_token`` is the offset of the part in its
    document, ``part_no`` counts from 0. Null names and capacities below 1 are ignored. The
    number of container sizes must be small (it is a parameter table); an empty table
    gives no rows.
    """
    docs = counted.select(F.col(ident).alias("id"), "n_tokens").where("id is not null and n_tokens > 0")
    sizes = [(r[0], r[1]) for r in containers.where("container_name is not null and capacity_tokens >= 1").select("container_name", "capacity_tokens").distinct().limit(1001).collect()]
    if len(sizes) > 1000:
        raise ValueError("more than 1000 container sizes")
    if not sizes:
        return docs.limit(0).select(F.lit("").alias("container_name"), F.lit("").alias("container_id"), F.col("id").alias(ident), F.lit(0).cast("long").alias("part_no"), "n_tokens", F.lit(0).cast("long").alias("first_token"))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("container_name"), F.lit(c).cast("long").alias("capacity")) for n, c in sizes)))
    items = docs.select("id", "n_tokens", each.alias("c")).select("id", "n_tokens", "c.*")
    # full parts of oversize documents fill a container each and need no packing
    whole = F.floor(F.col("n_tokens") / F.col("capacity")).cast("long")
    full = items.where("n_tokens >= capacity").select("id", "container_name", "capacity", F.posexplode(F.sequence(F.lit(1).cast("long"), whole)).alias("part_no", "x"))
    full = full.select("container_name", F.format_string("full-%d-%d", "id", "part_no").alias("container_id"), "id", F.col("part_no").cast("long").alias("part_no"),
                       F.col("capacity").alias("n_tokens"), (F.col("part_no") * F.col("capacity")).alias("first_token"))
    rest = items.withColumn("left", F.col("n_tokens") % F.col("capacity")).where("left > 0")
    count = docs.count()
    shards = max(1, math.ceil(count / shard_items))
    rest = rest.select("container_name", "capacity", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(shards)).alias("shard"), "id", "left",
                       F.floor(F.col("n_tokens") / F.col("capacity")).cast("long").alias("part_no"))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["left", "id"], ascending=[False, True], kind="stable")
        box = pack(rows["left"].to_numpy(), int(rows["capacity"].iloc[0]))
        return pd.DataFrame({
            "container_name": rows["container_name"], "container_id": [f"{key[1]}-{b}" for b in box], "id": rows["id"],
            "part_no": rows["part_no"], "n_tokens": rows["left"], "first_token": rows["part_no"] * rows["capacity"],
        })

    kind = dict(docs.dtypes)["id"]
    packed = rest.groupBy("container_name", "shard").applyInPandas(one, f"container_name string, container_id string, id {kind}, part_no long, n_tokens long, first_token long")
    return packed.unionByName(full).withColumnRenamed("id", ident)


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per container name: containers used, tokens, share of the space filled, parts split off."""
    by = packed.groupBy("container_name", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("parts"))
    total = by.groupBy("container_name").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.sum("parts").alias("parts"), F.max("tokens").alias("fullest"))
    caps = containers.select("container_name", "capacity_tokens").distinct()
    filled = F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("filled")
    return total.join(caps, "container_name").select("container_name", "capacity_tokens", "containers", "tokens", "parts", "fullest", filled)
