"""Capping the records of dominant contributors (problem 1).

Each contributor keeps at most ``cap`` records. The cap is split over the contributor's
strata (topics, periods, ...) by largest-remainder apportionment, slots that a stratum
cannot fill go to the strata that can, and inside a stratum the best records stay.

Hot contributors are never gathered in one task. Ranking is exact but done in chunks: a
bounded sample gives cut points on (quality, id), each row gets the number of cut points
before it as its chunk, and its rank is the count of the earlier chunks plus the position
inside its own. The cut points steer balance only; any of them give the same ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Most cut points of the chunked ranking: beyond MAX_CUTS * chunk_rows rows chunks grow, to no effect but their sorting time.
MAX_CUTS = 4095
#: Rows sampled for each cut point; with MAX_CUTS a bound on what reaches the driver.
SAMPLE_A_CUT = 16


def _cuts(rows: DataFrame, n_rows: int, chunk_rows: int) -> list:
    want = min(MAX_CUTS, n_rows // chunk_rows)
    if want < 1:
        return []
    most = want * SAMPLE_A_CUT
    got = [tuple(r) for r in rows.select("q", "id").sample(fraction=min(1.0, most / max(1, n_rows)), seed=7).limit(2 * most).collect()]
    got.sort(key=lambda r: (-r[0], r[1]))
    return [got[len(got) * (i + 1) // (want + 1)] for i in range(want)] if len(got) > want else []


def _chunk(key: Column, cuts: list) -> Column:
    """How many cut points a row ranks after: a search by halving steps in an array of constants."""
    if not cuts:
        return F.lit(0)
    all_cuts = F.array(*(F.struct(F.lit(-q).alias("a"), F.lit(i).alias("b")) for q, i in cuts))
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]

    def onward(at: Column, step: Column) -> Column:
        after = (at + step <= len(cuts)) & (key > F.get(all_cuts, at + step - 1))
        return F.when(after, at + step).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), onward)


def chunked_rank(df: DataFrame, keys: list[str], n_rows: int, chunk_rows: int = 200_000) -> DataFrame:
    """Adds ``rank``: 1 for the best row of its ``keys`` by ``q`` (high first), then ``id``
    (low first). Neither may be null. No task sees more than a chunk of a group."""
    cuts = _cuts(df, n_rows, chunk_rows)
    rows = df.withColumn("chunk", _chunk(F.struct((-F.col("q")).alias("a"), F.col("id").alias("b")), cuts))
    inside = Window.partitionBy(*keys, "chunk").orderBy(F.desc("q"), F.asc("id"))
    ranked = rows.withColumn("rank", F.row_number().over(inside).cast("long"))
    if not cuts:
        return ranked.drop("chunk")
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*keys, "chunk").agg(F.count("*").alias("n"))
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*keys, "chunk"]]
    both = ranked.alias("r").join(offsets.alias("o"), on, "inner")
    return both.select(*(F.col(f"r.{c}") for c in df.columns), (F.col("r.rank") + F.col("o.before")).alias("rank"))


def apportion(sizes: DataFrame, keys: list[str], cap: Column) -> DataFrame:
    """``sizes`` has ``keys``, ``stratum``, ``n`` and ``weight``; adds ``slots``, the records that stay.

    A contributor within its cap keeps all. Otherwise the cap is split over its strata in
    proportion to their weights (not negative; if all are 0, to their sizes). A stratum with
    fewer records than its quota is filled, and the slots it spares are split among the
    others, again by weight, until none has too few: strata are filled in ascending order of
    records per weight, as long as what is left per weight reaches that. The rest get the
    floors of their quotas, and the remaining slots go to the largest remainders, ties by
    stratum.
    """
    by = Window.partitionBy(*keys)
    t = sizes.withColumns({"__total": F.sum("n").over(by), "__cap": cap.cast("long"), "__w": F.when(F.sum("weight").over(by) > 0, F.col("weight")).otherwise(F.col("n")).cast("decimal(18,0)")})
    # strata of no weight come last: they are filled only if slots are left when all others are full
    order = by.orderBy(F.when(F.col("__w") > 0, F.col("n") / F.col("__w").cast("double")).otherwise(float("inf")), F.asc_nulls_first("stratum"))
    before, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumns({"__left": F.col("__cap") - F.coalesce(F.sum("n").over(before), F.lit(0)), "__weights": F.sum("__w").over(behind)})
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    fills = F.when(F.col("__weights") > 0, wide("__left") * F.col("__w") >= wide("n") * F.col("__weights")).otherwise(F.col("__left") >= F.col("n"))
    # once a stratum is not filled, none behind it is
    t = t.withColumn("__full", F.min(F.when(fills & (F.col("__left") > 0), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    t = t.withColumns({"__room": F.col("__cap") - F.sum(F.when(F.col("__full"), F.col("n")).otherwise(0)).over(by), "__open": F.sum(F.when(F.col("__full"), 0).otherwise(F.col("__w"))).over(by)})
    share = wide("__room") * F.col("__w")
    t = t.withColumns({
        "__floor": F.when(F.col("__full"), F.col("n")).when(F.col("__open") > 0, F.floor(share / F.col("__open"))).otherwise(0).cast("long"),
        "__rest": F.when(~F.col("__full") & (F.col("__open") > 0), share % F.col("__open")).otherwise(0),
    })
    spare = F.col("__cap") - F.sum("__floor").over(by)
    turn = F.row_number().over(by.orderBy(F.col("__full"), F.desc("__rest"), F.asc_nulls_first("stratum")))
    slots = F.when(F.col("__total") <= F.col("__cap"), F.col("n")).otherwise(F.least(F.col("n"), F.col("__floor") + F.when(~F.col("__full") & (turn <= spare), 1).otherwise(0)))
    return t.select(*keys, "stratum", "n", slots.cast("long").alias("slots"))


def cap_contributors(df: DataFrame, contributor: str, quality: str, ident: str, *, max_count: int | None = None,
                     max_share: tuple[int, int] | None = None, stratum: Column | None = None, even: bool = False, chunk_rows: int = 200_000) -> DataFrame:
    """``df`` with a column ``kept``: false where the record exceeds its contributor's cap.

    ``max_share=(a, b)`` caps at ``floor(N * a / b)`` of the ``N`` rows, ``max_count`` at a
    number; with both the smaller holds. ``ident`` must be unique and an integer (rows with a
    null one rank last, in no order); ``quality`` numeric, nulls and NaN rank last, ties go
    to the smaller ``ident``. A null contributor is a contributor of its own, a null
    stratum a stratum of its own. A contributor's cap is split over its strata by their sizes,
    or with ``even`` in equal parts, of which small strata spare some. An empty table stays empty. All other columns pass
    through, whatever their names; an input column ``kept`` is replaced.
    """
    if max_count is None and max_share is None:
        raise ValueError("give max_count or max_share")
    columns = [c for c in df.columns if c != "kept"]
    q = F.col(quality).cast("double")
    rows = df.select(
        F.struct(*columns).alias("row"), F.col(contributor).alias("owner"), (stratum if stratum is not None else F.lit("all")).cast("string").alias("stratum"),
        F.when(q.isNull() | F.isnan(q), F.lit(float("-inf"))).otherwise(q).alias("q"), F.coalesce(F.col(ident).cast("long"), F.lit(2**63 - 1)).alias("id"),
    )
    totals = rows.groupBy("owner").agg(F.count("*").alias("n"))
    n = totals.agg(F.sum("n")).first()[0] or 0
    cap = min(x for x in (max_count, n * max_share[0] // max_share[1] if max_share else None) if x is not None)
    hot = totals.where(F.col("n") > cap).select(F.col("owner").alias("hot"), F.lit(True).alias("is_hot"))
    # a hot contributor holds more than cap of the n rows, so there are at most n / (cap + 1)
    hot = F.broadcast(hot) if n // (cap + 1) <= 10_000 else hot
    marked = rows.join(hot, F.col("owner").eqNullSafe(F.col("hot")), "left").drop("hot")
    calm = marked.where("is_hot is null").select("row", F.lit(True).alias("kept"))
    busy = marked.where("is_hot").drop("is_hot")
    sizes = busy.groupBy("owner", "stratum").agg(F.count("*").alias("n")).withColumn("weight", F.lit(1) if even else F.col("n"))
    slots = apportion(sizes, ["owner"], F.lit(cap)).select(F.col("owner").alias("so"), F.col("stratum").alias("ss"), "slots")
    ranked = chunked_rank(busy, ["owner", "stratum"], n, chunk_rows)
    judged = ranked.join(slots, F.col("owner").eqNullSafe(F.col("so")) & F.col("stratum").eqNullSafe(F.col("ss")), "inner")
    return calm.unionByName(judged.select("row", (F.col("rank") <= F.col("slots")).alias("kept"))).select("row.*", "kept")


def latest(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per ``key``: that of the latest ``fetched_at``, ties to the larger ``fetch_id``."""
    newest = F.max_by(F.struct(*columns), F.struct("fetched_at", "fetch_id")).alias("__row")
    return df.groupBy(key).agg(newest).select(key, "__row.*")
