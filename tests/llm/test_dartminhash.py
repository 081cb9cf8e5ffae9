import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm.dartminhash import SKETCH, UNLIKELY, Darts, Duplicates, alike, groups, least_common, level, linked_ids, near_duplicates, pack, signatures, unpack
from lodestrata.llm.hashing import mix

WORDS = [f"w{i}" for i in range(300)]


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def runs(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def pairs_by_hand(rows, k, num, den, least):
    out = set()
    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            s, t = runs(x, k), runs(y, k)
            if a != b and len(s) >= least and len(t) >= least and len(s & t) * den >= len(s | t) * num:
                out.add((min(a, b), max(a, b)))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows, ident = [], 0
    for _ in range(25):
        base = [rng.choice(WORDS) for _ in range(120)]
        for edits in (0, 0, 2, 5, 9, 14, 25):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            if edits == 9:
                w = w[60:] + w[:60]
            rows.append((ident, " ".join(w).upper() if edits == 2 else "  ".join(w) + "!"))
            ident += 1
    return rows + [(900, None), (901, ""), (902, None), (903, "short text"), (904, "short text"), (905, "x " * 50_000)]


@pytest.mark.parametrize("k, limit, least", [(3, (1, 2), 60), (5, (4, 5), 1)])
def test_pairs(spark, corpus, k, limit, least):
    df = spark.createDataFrame([(i, t, "z") for i, t in corpus], "id long, content string, rep string").unionByName(spark.createDataFrame([(0, corpus[0][1], "z"), (None, "x", "z")], "id long, content string, rep string"))
    found = near_duplicates(df, "id", "content", width=k, threshold=limit, min_elements=least)
    got = {tuple(r) for r in linked_ids(found).collect()}
    want = pairs_by_hand(corpus, k, *limit, least)
    assert got <= want
    assert len(got) >= 0.97 * len(want) and len(want) > 20
    rows = groups(found).collect()
    members = {r.id: r for r in rows}
    assert set(members) == {i for i, _ in corpus} and len(rows) == len(members)
    assert members[0].class_id == members[1].class_id == 0 and members[903].class_id == members[904].class_id == 903
    assert members[903].n_links == 0 and members[900].class_id == members[901].class_id == 900
    for a, b in got:
        assert members[a].group_id == members[b].group_id
    links = {i: 0 for i in members}
    for r in found.links.collect():
        links[r.rep_a] += 1
        links[r.rep_b] += 1
    assert all(members[i].n_links == links[members[i].class_id] for i in members)


def test_empty(spark):
    df = spark.createDataFrame([], "id long, content string")
    found = near_duplicates(df, "id", "content")
    assert linked_ids(found).count() == 0 and groups(found).count() == 0


def test_long_chain_of_links(spark):
    rng = random.Random(9)
    w = [rng.choice(WORDS) for _ in range(200)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join(w)))
        w = w[6:] + [rng.choice(WORDS) for _ in range(6)]
    found = near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", "t", width=3, threshold=(1, 2))
    assert {r.group_id for r in groups(found).collect()} == {0}


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    keys = mix(np.arange(400, dtype=np.uint64))
    weight = rng.uniform(0.05, 1, 400)
    a, b = np.arange(0, 300), np.arange(100, 400)
    s = signatures(np.concatenate([keys[a], keys[b]]), np.concatenate([weight[a], weight[b]]), np.array([0, 300, 600]), 2048)
    want = weight[100:300].sum() / weight.sum()
    assert (s != 0).mean() > 0.99
    assert abs((s[0] == s[1]).mean() - want) < 0.04
    again = signatures(keys[a], weight[a], np.array([0, 300]), 2048)
    assert (again[0] == s[0]).all()


def test_signature_of_nothing():
    s = signatures(np.zeros(0, np.uint64), np.zeros(0), np.array([0, 0]), 8)
    assert s.shape == (1, 8) and not s.any()


def test_pack_round_trip():
    x = np.sort(mix(np.arange(50, dtype=np.uint64)))
    y = unpack(np.frombuffer(pack(x), np.uint8))
    assert (y >> np.uint64(24) == x >> np.uint64(24)).all()


def test_parameters():
    assert Darts().k == 640


def test_hot_copies_collapse(spark):
    base = " ".join(WORDS[:100])
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, base).otherwise(F.concat(F.lit("text number "), F.col("id").cast("string"))).alias("t"))
    found = near_duplicates(df, "id", "t", width=5)
    assert found.sets.count() == 1 and found.links.count() == 0
    assert groups(found).where("class_id = 0").count() == 1000


def test_hot_family_of_different_texts_keeps_its_links(spark):
    """A third of all texts are edits of one text; none is a copy."""
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(150)]
    rows = []
    for i in range(300):
        if i % 3:
            rows.append((i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(150))))
            continue
        w = list(base)
        for _ in range(6):
            w[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    found = near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", "t", width=3, threshold=(1, 2), min_elements=60)
    got, want = {tuple(r) for r in linked_ids(found).collect()}, pairs_by_hand(rows, 3, 1, 2, 60)
    assert len(want) > 4000 and got <= want and len(got) >= 0.97 * len(want)


def test_template_and_template_with_own_text_are_linked(spark):
    """A third of all texts hold a template; half of these add nearly as much text of their own."""
    rng = random.Random(7)
    template = [rng.choice(WORDS) for _ in range(112)]
    rows = []
    for i in range(300):
        own = [f"o{rng.randrange(10**6)}" for _ in range(150)]
        if i % 3:
            rows.append((i, " ".join(own)))
        elif i % 2:
            rows.append((i, " ".join(template + own[:90])))
        else:
            rows.append((i, " ".join(template[:-1] + own[:1])))
    found = near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", "t", width=3, threshold=(1, 2), min_elements=60)
    got, want = {tuple(r) for r in linked_ids(found).collect()}, pairs_by_hand(rows, 3, 1, 2, 60)
    unlike = {(a, b) for a, b in want if a % 2 != b % 2}
    assert len(unlike) == 2500 and got <= want
    assert len(got & unlike) >= 0.97 * len(unlike)


def test_cap_at_the_threshold_itself():
    w = np.array([0.1] * 5 + [1.0] * 5)
    assert (level(w, np.array([0, 10]), (1, 2)) == 0.1).all()
    assert (level(w, np.array([0, 10]), (3, 5)) == w).all()
    assert (level(np.array([0.5]), np.array([0, 0, 1, 1]), (1, 2)) == 0.5).all()


def test_sketches_keep_links_and_drop_unlike_pairs():
    rng = np.random.default_rng(2)
    need = least_common(1, 2)
    below = lambda c: sum(math.comb(SKETCH, i) for i in range(c)) / 2**SKETCH
    assert below(int(need[SKETCH])) <= UNLIKELY < below(int(need[SKETCH]) + 1) and need[1] == 0 and (np.diff(need) >= 0).all()

    def kept(similar, times=2000):
        xs, ys = [], []
        for _ in range(times):
            pool = rng.integers(0, 1 << 40, 300).astype(np.uint64)
            common = int(300 * similar)
            own = (300 - common) // 2
            xs.append(np.sort(pool[: common + own])[:SKETCH])
            ys.append(np.sort(np.concatenate([pool[:common], pool[common + own :]]))[:SKETCH])
        starts = lambda z: np.concatenate([[0], np.cumsum([len(v) for v in z])])
        return alike(np.concatenate(xs), starts(xs), np.concatenate(ys), starts(ys), need).mean()

    assert kept(0.5) == 1 and kept(0.9) == 1 and kept(0.05) < 0.02
    few = np.array([1, 2, 3], np.uint64)
    assert alike(few, np.array([0, 3]), few, np.array([0, 3]), need).all() and alike(few[:0], np.array([0, 0]), few, np.array([0, 3]), need).shape == (1,)


def test_a_chain_of_ten_thousand_links_is_one_group(spark):
    n = 10_000
    ids = spark.range(n + 1)
    links = ids.where(f"id < {n}").select(F.col("id").alias("rep_a"), (F.col("id") + 1).alias("rep_b"), F.lit(1).alias("common"), F.lit(1).alias("either"))
    rows = groups(Duplicates(ids.select("id", F.col("id").alias("rep")), ids.limit(0), links))
    assert rows.count() == n + 1 and rows.where("group_id <> 0").count() == 0
