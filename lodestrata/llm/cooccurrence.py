"""Items that appear together (problem 2): a blocked Gram matrix.

Baskets become a binary sparse matrix X (records by items). Python workers take record
blocks; the items of a block that are frequent there form dense column blocks whose
products X'X run as matrix multiplications, the rest is multiplied sparsely. Only the
non-zero cells of a block's product leave the worker; Spark sums them over all blocks and
divides by what the marginals predict. Item names stay in the JVM: the matrix is indexed by
64-bit codes, so no dictionary has to fit anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Width of a dense item block, and the local frequency from which an item counts as dense.
BLOCK_ITEMS = 256
DENSE_FROM = 48
#: Cells of the sparse product that are expanded at once.
EXPAND = 4_000_000


def gram_block(rows: np.ndarray, codes: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper triangle (by code) of X'X without the diagonal, as (code_a, code_b, count).

    ``rows`` and ``codes`` are the coordinates of the ones of X, without repeats.
    """
    items, local, freq = np.unique(codes, return_inverse=True, return_counts=True)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    head = np.flatnonzero(freq >= DENSE_FROM)
    head = head[np.argsort(-freq[head], kind="stable")]
    is_head = np.zeros(len(items), bool)
    is_head[head] = True
    place = np.full(len(items), -1)
    place[head] = np.arange(len(head))
    dense = is_head[local]
    starts = range(0, len(head), BLOCK_ITEMS)

    def column_block(at: int) -> np.ndarray:
        x = np.zeros((n_rows, min(BLOCK_ITEMS, len(head) - at)), np.float32)
        p = place[local[dense]]
        inside = (p >= at) & (p < at + BLOCK_ITEMS)
        x[rows[dense][inside], p[inside] - at] = 1
        return x

    for i in starts:
        left = column_block(i)
        for j in starts:
            if j < i:
                continue
            product = left.T @ (left if j == i else column_block(j))
            if i == j:
                product = np.triu(product, 1)
            a, b = np.nonzero(product)
            out.append((items[head[a + i]], items[head[b + j]], product[a, b].astype(np.int64)))
    # pairs with at least one sparse item: expand each record's (sparse item, item) cells
    order = np.argsort(rows, kind="stable")
    r, c = rows[order], local[order]
    begin = np.searchsorted(r, np.arange(n_rows + 1))
    tail = np.flatnonzero(~is_head[c])
    width = begin[r[tail] + 1] - begin[r[tail]]
    at = 0
    while at < len(tail):
        upto = at + max(1, int(np.searchsorted(np.cumsum(width[at:]), EXPAND, side="right")))
        t, w = tail[at:upto], width[at:upto]
        a = np.repeat(c[t], w)
        offset = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        b = c[np.repeat(begin[r[t]], w) + offset]
        ok = is_head[b] | (a < b)  # two sparse items meet twice: keep one order
        cell, n = np.unique(a[ok].astype(np.int64) * len(items) + b[ok], return_counts=True)
        out.append((items[cell // len(items)], items[cell % len(items)], n.astype(np.int64)))
        at = upto
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, n = (np.concatenate(x) for x in zip(*out))
    return np.minimum(a, b), np.maximum(a, b), n


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(0)
        sizes = np.diff(lists.offsets.to_numpy())
        codes = lists.flatten().to_numpy(zero_copy_only=False)
        a, b, n = gram_block(np.repeat(np.arange(len(sizes)), sizes), codes, len(sizes))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["code_a", "code_b", "n_ab"])


def cooccurrence(baskets: DataFrame, items: str = "items", group: str = "field", min_count: int = 5,
                 min_lift: tuple[int, int] = (0, 1)) -> DataFrame:
    """Pairs of items of one basket: ``group, item_a, item_b, n_ab, n_a, n_b, n, lift``.

    ``baskets`` has ``group`` (string) and ``items`` (array of string). A null basket, null
    items and repeats inside a basket count for nothing; baskets without items are not in
    ``n``. ``item_a < item_b`` by code point. A pair needs ``n_ab >= min_count`` and
    ``n_ab * n * den >= num * n_a * n_b`` for ``min_lift=(num, den)``; ``lift`` is
    ``n_ab * n / (n_a * n_b)``. Other columns are ignored; an empty table gives no rows.
    """
    b = baskets.select(F.col(group).cast("string").alias("field"), F.array_distinct(F.filter(F.col(items), lambda x: x.isNotNull())).alias("items"))
    b = b.where(F.size("items") > 0)
    code = lambda f, x: F.xxhash64(f, x)
    marginal = (b.select("field", F.explode("items").alias("item")).groupBy("field", "item").agg(F.count("*").alias("n_item"))
                .where(F.col("n_item") >= min_count).withColumn("code", code(F.col("field"), F.col("item"))))
    total = b.groupBy("field").agg(F.count("*").alias("n"))
    coded = b.where(F.size("items") > 1).select(F.transform("items", lambda x: code(F.col("field"), x)).alias("codes"))
    cells = coded.mapInArrow(_gram, "code_a long, code_b long, n_ab long")
    gram = cells.groupBy("code_a", "code_b").agg(F.sum("n_ab").alias("n_ab")).where(F.col("n_ab") >= min_count)
    left = marginal.select(F.col("code").alias("code_a"), "field", F.col("item").alias("x"), F.col("n_item").alias("n_x"))
    right = marginal.select(F.col("code").alias("code_b"), F.col("field").alias("field_b"), F.col("item").alias("y"), F.col("n_item").alias("n_y"))
    named = gram.join(left, "code_a").join(right, "code_b").where(F.col("field") == F.col("field_b")).join(total, "field")
    swap = F.col("x") < F.col("y")
    named = named.select(
        F.col("field").alias(group), F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"), "n_ab",
        F.when(swap, F.col("n_x")).otherwise(F.col("n_y")).alias("n_a"), F.when(swap, F.col("n_y")).otherwise(F.col("n_x")).alias("n_b"), "n",
    )
    wide = lambda *c: [F.col(x).cast("decimal(18,0)") for x in c]
    n_ab, n_a, n_b, n = wide("n_ab", "n_a", "n_b", "n")
    named = named.where(n_ab * n * F.lit(min_lift[1]) >= n_a * n_b * F.lit(min_lift[0]))
    return named.withColumn("lift", F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b")))


def list_baskets(repositories: DataFrame) -> DataFrame:
    """Baskets ``repo_id, field, items`` of the JSON lists ``topics`` and ``languages`` of each
    repository's latest row; items lower-cased and trimmed, blank ones dropped."""
    from lodestrata.llm.capping import latest

    rows = latest(repositories, "repo_id", ["topics", "languages"])
    each = rows.select("repo_id", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("raw")) for c in ("topics", "languages")))).alias("x"))
    parsed = F.from_json("x.raw", "array<string>")
    clean = F.filter(F.transform(parsed, lambda i: F.lower(F.trim(i))), lambda i: i.isNotNull() & (i != ""))
    return each.select("repo_id", "x.field", clean.alias("items"))
