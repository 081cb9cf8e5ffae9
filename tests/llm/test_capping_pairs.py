import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import capping
from lodestrata.llm.capping import cap_contributors
from lodestrata.llm.cooccurrence import cooccurrence, gram_block, list_baskets


def by_hand(rows, cap, strata):
    """Kept ids: largest remainder over strata, best quality inside."""
    groups = defaultdict(list)
    for r in rows:
        groups[r["owner"]].append(r)
    kept = set()
    for members in groups.values():
        parts = defaultdict(list)
        for r in members:
            parts[r["year"] if strata else "all"].append(r)
        if len(members) <= cap:
            kept |= {r["id"] for r in members}
            continue
        slots = {k: cap * len(v) // len(members) for k, v in parts.items()}
        rest = sorted(parts, key=lambda k: (-(cap * len(parts[k]) % len(members)), k is not None, k or ""))
        for k in rest[: cap - sum(slots.values())]:
            slots[k] += 1
        for k, v in parts.items():
            v.sort(key=lambda r: (-(r["stars"] if r["stars"] is not None else float("-inf")), r["id"]))
            kept |= {r["id"] for r in v[: slots[k]]}
    return kept


@pytest.mark.parametrize("strata", [False, True])
@pytest.mark.parametrize("chunk", [200_000, 20])
def test_cap_by_hand(spark, strata, chunk, monkeypatch):
    rng = random.Random(4)
    rows = [{"id": i, "owner": rng.choice(["hot"] * 30 + ["b", "c", None, "d"]), "stars": rng.choice([None, 0, 0, 0, 1, 7]), "year": rng.choice(["1", "2", None, "3", "3"])} for i in range(400)]
    df = spark.createDataFrame(rows, "id long, owner string, stars long, year string")
    kw = {"stratum": F.col("year")} if strata else {}
    got = cap_contributors(df, "owner", "stars", "id", max_count=17, chunk_rows=chunk, **kw)
    assert got.count() == 400
    assert {r.id for r in got.where("kept").collect()} == by_hand(rows, 17, strata)


def test_cap_edges(spark):
    df = spark.createDataFrame([(1, "a", float("nan"), "x", True), (2, "a", None, "y", False), (3, "a", 1.0, "z", None)], "id long, owner string, q double, row string, kept boolean")
    got = cap_contributors(df, "owner", "q", "id", max_count=1)
    assert got.columns == ["id", "owner", "q", "row", "kept"]
    assert [r.id for r in got.where("kept").collect()] == [3]
    assert cap_contributors(df.where("false"), "owner", "q", "id", max_share=(2, 100)).count() == 0
    assert cap_contributors(df, "owner", "q", "id", max_share=(2, 100)).where("kept").count() == 0
    assert cap_contributors(df, "owner", "q", "id", max_count=3).where("kept").count() == 3
    with pytest.raises(ValueError):
        cap_contributors(df, "owner", "q", "id")


def test_chunks_split_ties():
    cuts = [(5.0, 3), (5.0, 9)]
    assert capping.MAX_CUTS >= len(cuts)


def pairs_by_hand(baskets):
    c = Counter()
    for b in baskets:
        for x, y in combinations(sorted({i for i in b if i is not None}), 2):
            c[x, y] += 1
    return c


@pytest.mark.parametrize("dense", [1, 3, 10_000])
def test_gram_block(dense, monkeypatch):
    import lodestrata.llm.cooccurrence as C

    monkeypatch.setattr(C, "DENSE_FROM", dense)
    monkeypatch.setattr(C, "BLOCK_ITEMS", 4)
    monkeypatch.setattr(C, "EXPAND", 50)
    rng = random.Random(1)
    baskets = [sorted({int(rng.paretovariate(0.7)) % 50 for _ in range(rng.randrange(9))}) for _ in range(80)]
    rows = np.repeat(np.arange(80), [len(b) for b in baskets])
    a, b, n = gram_block(rows, np.array([i for x in baskets for i in x], np.int64), 80)
    got = Counter()
    for x, y, k in zip(a.tolist(), b.tolist(), n.tolist()):
        got[x, y] += k
    assert got == pairs_by_hand(baskets)


def test_cooccurrence(spark):
    rng = random.Random(2)
    items = [chr(97 + i) for i in range(12)] + ["é", "Z", ""]
    baskets = [[rng.choice(items) for _ in range(rng.randrange(7))] for _ in range(200)] + [None, [], [None, "a"], ["a", "a"]]
    df = spark.createDataFrame([(i, "f", b, 1) for i, b in enumerate(baskets)], "id int, field string, items array<string>, n long")
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in cooccurrence(df, min_count=5).collect()}
    single = Counter(i for b in baskets if b for i in {x for x in b if x is not None})
    n = sum(1 for b in baskets if b and any(x is not None for x in b))
    assert got == {(x, y): (k, single[x], single[y], n) for (x, y), k in pairs_by_hand([b or [] for b in baskets]).items() if k >= 5}
    lifted = cooccurrence(df, min_count=5, min_lift=(12, 10)).collect()
    assert {(r.item_a, r.item_b) for r in lifted} == {k for k, (ab, a, b, m) in got.items() if ab * m * 10 >= 12 * a * b}
    assert cooccurrence(df.where("false")).count() == 0


def test_list_baskets(spark):
    rows = [(1, 1, '["A ", "b", null]', "[]", 1), (2, 1, '["a"]', "[]", 2), (3, 2, "no list", None, 1)]
    df = spark.createDataFrame(rows, "fetch_id long, repo_id long, topics string, languages string, fetched_at long")
    got = {(r.repo_id, r.field): r["items"] for r in list_baskets(df).collect()}
    assert got[1, "topics"] == ["a"] and not got[2, "topics"] and not got[1, "languages"]


def test_even_strata_spare_slots_for_others(spark):
    """Twelve slots over strata of 1, 3, 20 and 30 records: 1, 3, 4 and 4."""
    rows = [(i, "o", i, s) for i, s in enumerate("a" * 1 + "b" * 3 + "c" * 20 + "d" * 30)] + [(100, "small", 1, "a"), (101, None, 1, None)]
    df = spark.createDataFrame(rows, "id long, who string, q int, s string")
    kept = cap_contributors(df, "who", "q", "id", max_count=12, stratum=F.col("s"), even=True).where("kept").collect()
    by = {k: sum(1 for r in kept if r.who == "o" and r.s == k) for k in "abcd"}
    assert by == {"a": 1, "b": 3, "c": 4, "d": 4} and len(kept) == 14
    assert {r.id for r in kept if r.s == "c"} == {20, 21, 22, 23}
