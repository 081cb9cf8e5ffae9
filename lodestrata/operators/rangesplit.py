"""Adaptive date ranges: bisect until each range holds at most ``cap`` rows.

Which ranges the bisection could ever reach depends on the dates alone, so nothing has to
be done step by step: the data is counted once per day, each day's count goes to the ranges
on its path through the tree (about log2 of the days), and one more aggregate gives the counts
of all ranges. Those whose parent is too full and who are not are the leaves. Everything
after the count per day has the size of a calendar.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestrata.functions.scalars import middle_day

#: Days a calendar may span: the bound of everything broadcast here.
MAX_DAYS = 200_000


def per_day(df: DataFrame, day: Column) -> DataFrame:
    return df.select(day.cast("date").alias("d")).where("d is not null").groupBy("d").agg(F.count("*").alias("n"))


def range_counts(df: DataFrame, day: Column, ranges: DataFrame) -> DataFrame:
    """``ranges`` (s, e, both inclusive) with ``cnt``, the rows in each; an empty range counts 0."""
    r = ranges.select("s", "e").where("s <= e").distinct()
    hit = per_day(df, day).join(r.select("s", "e", F.explode(F.sequence("s", "e")).alias("d")), "d")
    counted = hit.groupBy("s", "e").agg(F.sum("n").alias("cnt"))
    return ranges.select("s", "e").distinct().join(counted, ["s", "e"], "left").select("s", "e", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def bisect(df: DataFrame, day: Column, start: date, end: date, cap: int = 1000) -> DataFrame:
    """The leaves ``s, e, cnt, lvl, truncated`` of the bisection of [start, end].

    A range without rows is pruned; with at most ``cap`` rows, or at most two days, it is a
    leaf, truncated if it holds more than ``cap``; otherwise it is halved, the first half
    taking the middle day. Leaves are disjoint and cover every row in [start, end].
    """
    days = (end - start).days
    if days >= MAX_DAYS:
        raise ValueError(f"more than {MAX_DAYS} days")

    def deeper(path: Column, _: Column) -> Column:
        """The path with the half of its last range that holds the day, if that range is halved."""
        last = F.element_at(path, -1)
        middle = middle_day(last["s"], last["e"])
        first = F.col("d") <= middle
        half = F.struct(F.when(first, last["s"]).otherwise(F.date_add(middle, 1)).alias("s"), F.when(first, middle).otherwise(last["e"]).alias("e"), last["s"].alias("ps"), last["e"].alias("pe"))
        return F.when(F.datediff(last["e"], last["s"]) > 1, F.concat(path, F.array(half))).otherwise(path)

    root = F.struct(F.lit(start).alias("s"), F.lit(end).alias("e"), F.lit(None).cast("date").alias("ps"), F.lit(None).cast("date").alias("pe"))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, days.bit_length() + 1))), F.array(root), deeper)
    counted = per_day(df, day).where(F.col("d").between(F.lit(start), F.lit(end)))
    on_path = counted.select("n", F.posexplode(path).alias("lvl", "r"))
    ranges = on_path.groupBy("r.s", "r.e", "r.ps", "r.pe", "lvl").agg(F.sum("n").alias("cnt"))
    # the two halves of a range hold all of its rows, so their sum is the count of the parent
    parent = F.sum("cnt").over(Window.partitionBy("ps", "pe", "lvl"))
    reached = ranges.withColumn("parent", parent).where((F.col("lvl") == 0) | (F.col("parent") > cap))
    leaf = (F.col("cnt") <= cap) | (F.datediff("e", "s") <= 1)
    return reached.where(leaf).select("s", "e", "cnt", "lvl", (F.col("cnt") > cap).alias("truncated"))


def split_scan(df: DataFrame, day: str, leaves: DataFrame, cap: int, order: list[str], limit: int | None = None) -> DataFrame:
    """The rows of the leaves in the order of the leaves, at most ``cap`` of each and ``limit`` in all.

    Adds ``leaf_start`` and ``leaf_pos``. Leaves are spread over their days, which gives an
    equality to join on; there are at most as many as the calendar has days, so they are
    broadcast; more than ``MAX_DAYS`` are an error. A leaf holds at most ``cap`` rows unless it
    is a day or two.
    """
    days = leaves.select(F.col("s").alias("leaf_start"), F.explode(F.sequence("s", "e")).alias("__day"))
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    fits = F.assert_true(n <= MAX_DAYS, f"the leaves have more than {MAX_DAYS} days").isNull()
    days = days.withColumn("__fits", fits).where("__fits").drop("__fits")
    rows = df.withColumn("__day", F.col(day).cast("date")).join(F.broadcast(days), "__day").drop("__day")
    pos = F.row_number().over(Window.partitionBy("leaf_start").orderBy(*order))
    # filtered as it is, so that every task keeps its first rows of a leaf before the shuffle
    kept = rows.withColumn("__pos", pos).where(F.col("__pos") <= cap).withColumn("leaf_pos", F.col("__pos").cast("long")).drop("__pos")
    if limit is None:
        return kept
    return kept.orderBy("leaf_start", "leaf_pos").limit(limit) if limit > 0 else kept.where(F.lit(False))
