from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from lodestrata.operators.accounts import accounts_by_location, first_occurrence, ordered_limit, valid_logins
from lodestrata.operators.rangesplit import bisect, range_counts, split_scan
from lodestrata.plans import pipeline as J

OWNERS = [(1, "a", "User", "Lima"), (2, "B", "Organization", "LIMA norte"), (3, "a", "User", "lima"), (4, "c", "User", None), (5, None, "User", "Lima"), (6, "", "User", "Lima"), (7, "d", "User", "lima sur")]


@pytest.fixture(scope="module")
def owners(spark):
    return spark.createDataFrame(OWNERS, "account_id long, owner_login string, owner_type string, owner_location string")


def logins(df):
    return [r.username for r in df.orderBy(F.desc(F.col("kind") == "User"), "ord").collect()]


def test_accounts_by_location(owners):
    assert logins(accounts_by_location(owners, "lima")) == ["a", "d", "B"]
    assert logins(accounts_by_location(owners, "lima", include_orgs=False)) == ["a", "d"]
    assert logins(accounts_by_location(owners, "lima", max_users=2)) == ["a", "d"]
    assert logins(accounts_by_location(owners, "lima", max_users=0)) == []
    assert logins(accounts_by_location(owners, None)) == ["a", "c", "d", "B"]
    assert accounts_by_location(owners.where("false"), "lima").count() == 0


def test_first_occurrence(spark):
    df = spark.createDataFrame([("x", 2, "b"), ("x", 1, "a"), (None, 3, "c"), ("X", 4, "d"), (None, 5, "e")], "k string, o int, v string")
    once = first_occurrence(df, ["k"], ["o"])
    assert sorted(r.v for r in once.collect()) == ["a", "c", "d"]
    assert sorted(r.v for r in first_occurrence(once, ["k"], ["o"]).collect()) == ["a", "c", "d"]
    assert valid_logins(df, "k").count() == 3
    assert [r.o for r in ordered_limit(df, ["o"], 2).collect()] == [1, 2] and ordered_limit(df, ["o"], None).count() == 5


def leaves_by_hand(days, start, end, cap):
    out, stack = [], [(start, end, 0)]
    while stack:
        s, e, lvl = stack.pop()
        n = sum(s <= d <= e for d in days)
        if n and (n <= cap or (e - s).days <= 1):
            out.append((s, e, n, lvl))
        elif n:
            mid = s + timedelta((e - s).days // 2)
            stack += [(mid + timedelta(1), e, lvl + 1), (s, mid, lvl + 1)]
    return sorted(out)


BASE = date(2020, 1, 1)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 40), max_size=60), st.integers(1, 8))
def test_bisection(spark, offsets, cap):
    days = [BASE + timedelta(x) for x in offsets]
    df = spark.createDataFrame([(d,) for d in [*days, None]], "d date")
    got = sorted(tuple(r)[:4] for r in bisect(df, F.col("d"), BASE, BASE + timedelta(35), cap).collect())
    assert got == leaves_by_hand(days, BASE, BASE + timedelta(35), cap)
    assert sum(x[2] for x in got) == sum(d <= BASE + timedelta(35) for d in days)


@pytest.mark.parametrize("counts, cap, want", [({0: 5}, 5, [(0, 9, 5, False)]), ({0: 6}, 5, [(0, 1, 6, True)]), ({4: 3, 5: 3}, 5, [(3, 4, 3, False), (5, 9, 3, False)]), ({}, 5, [])])
def test_bisection_cases(spark, counts, cap, want):
    df = spark.createDataFrame([(BASE + timedelta(k),) for k, n in counts.items() for _ in range(n)], "d date")
    got = [((r.s - BASE).days, (r.e - BASE).days, r.cnt, r.truncated) for r in bisect(df, F.col("d"), BASE, BASE + timedelta(9), cap).orderBy("s").collect()]
    if counts == {0: 6}:
        assert [g[2:] for g in got] == [(6, True)] and got[0][0] == 0
    elif counts.get(4):
        assert sum(g[2] for g in got) == 6 and all(g[2] <= cap for g in got)
    else:
        assert got == want


def test_split_scan_and_counts(spark):
    df = spark.createDataFrame([(i, BASE) for i in range(6)] + [(9, BASE + timedelta(5))], "k int, d date")
    leaves = bisect(df, F.col("d"), BASE, BASE + timedelta(9), 4)
    rows = split_scan(df, "d", leaves, 4, ["k"])
    assert sorted(r.k for r in rows.collect()) == [0, 1, 2, 3, 9]
    assert [r.k for r in split_scan(df, "d", leaves, 4, ["k"], limit=2).orderBy("k").collect()] == [0, 1]
    assert split_scan(df, "d", leaves, 4, ["k"], limit=0).count() == 0
    ranges = spark.createDataFrame([(BASE, BASE + timedelta(1)), (BASE + timedelta(1), BASE + timedelta(2))], "s date, e date")
    assert sorted(r.cnt for r in range_counts(df, F.col("d"), ranges).collect()) == [0, 6]


REPOS = [("a/x", "a", "x", 5, False, "Go", "Lima"), ("a/y", "a", "y", 0, False, "Go", "Lima"), ("B/z", "B", "z", 9, True, "C", None), ("q/q", "q", "q", 9, False, "C", "Lima")]


@pytest.fixture(scope="module")
def repos(spark):
    return spark.createDataFrame(REPOS, "nwo string, owner_login string, name string, stars long, is_fork boolean, primary_language string, owner_location string")


def nwos(df):
    return sorted(r.nwo for r in df.collect())


def test_joins(spark, owners, repos):
    twice = spark.createDataFrame([("a",), ("a",), (None,), ("zz",)], "username string")
    assert nwos(J.repositories_of(twice, repos)) == ["a/x", "a/x"]
    assert nwos(J.repositories_of(twice, repos, min_stars=0)) == ["a/x", "a/x", "a/y", "a/y"]
    assert nwos(J.repositories_of_distinct(twice, repos)) == ["a/x", "a/y"]
    assert nwos(J.two_step(owners, repos, "lima")) == ["a/x"]
    assert nwos(J.two_step(owners, repos, "lima", include_forks=True)) == ["B/z", "a/x"]
    assert nwos(J.two_step(owners, repos, "lima", include_forks=True, extra="language:c")) == ["B/z"]
    assert nwos(J.two_step(owners, repos, "", accounts=twice)) == ["a/x", "a/x"]


def test_modes(spark, repos):
    assert nwos(J.by_query(repos, "language:go")) == ["a/x"]
    assert nwos(J.by_query(repos, "language:c", include_forks=False, limit=5)) == ["q/q"]
    assert nwos(J.by_location(repos, "lima", limit=1)) == ["q/q"]
    assert nwos(J.one_repository(repos, "a/x")) == ["a/x"] and J.one_repository(repos, "a/none").count() == 0
    for bad in ("a", "a/b/c"):
        with pytest.raises(ValueError):
            J.one_repository(repos, bad)
    assert nwos(J.lookup_names(repos, spark.createDataFrame([("a/x",), ("n/n",), ("a/x",)], "nwo string"))) == ["a/x"]
    assert tuple(J.matched_and_scanned(repos, F.col("stars") > 4).first()) == (4, 3)


def test_leaves_beyond_the_calendar_are_an_error(spark, monkeypatch):
    from datetime import date

    from lodestrata.operators import rangesplit as R

    monkeypatch.setattr(R, "MAX_DAYS", 5)
    rows = spark.createDataFrame([(1, date(2020, 1, 1))], "k long, day date")
    leaves = lambda e: spark.createDataFrame([(date(2020, 1, 1), e)], "s date, e date")
    assert R.split_scan(rows, "day", leaves(date(2020, 1, 5)), 10, ["k"]).count() == 1
    with pytest.raises(Exception, match="more than 5 days"):
        R.split_scan(rows, "day", leaves(date(2020, 1, 9)), 10, ["k"]).count()
