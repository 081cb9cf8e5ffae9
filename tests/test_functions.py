import json
from datetime import datetime, timezone

import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import scalars as X
from lodestrata.functions.jsonlist import json_to_list, list_to_json
from lodestrata.functions.retry import Quota, delays, retrying

HARD = ["", "a", 'q"uote', "back\\slash", "tab\t", "line\nend\r", "\x07\x1f\x7f", "Pythön", "名前", "🐦x", "\b\f", "a, b", "null", "é" * 300]


def one(df):
    return df.first()[0]


def test_list_to_json_equals_json_dumps(spark):
    rows = [(HARD,), ([],), ([None, "x"],), (None,)] + [([x],) for x in HARD]
    got = spark.createDataFrame(rows, "l array<string>").select(list_to_json("l")).collect()
    assert [r[0] for r in got] == [json.dumps(l) if l is not None else None for (l,) in rows]


def test_json_lists_round_trip(spark):
    df = spark.createDataFrame([(HARD,)], "l array<string>")
    assert one(df.select(json_to_list(list_to_json("l")))) == HARD
    bad = spark.createDataFrame([("no list",), (None,), ("",)], "t string").select(json_to_list("t").alias("x"))
    assert [r[0] for r in bad.collect()] == [None, None, None]


def test_times(spark):
    df = spark.createDataFrame([("2024-02-29T23:30:00Z",), ("2024-02-29T23:30:00+00:00",), ("2024-03-01T01:30:00+02:00",), ("",), (None,), ("soon",)], "t string")
    assert [str(r[0]) for r in df.select(X.utc_date("t")).collect()] == ["2024-02-29"] * 3 + ["None"] * 3
    assert [r[0] for r in df.select(X.iso_or_null("t")).collect()][3:] == [None, None, "soon"]


def test_owner_and_name(spark):
    df = spark.createDataFrame([("a/b",), (None,)], "n string")
    assert [r[0] for r in df.select(X.owner_and_name("n")).collect()] == [("a", "b"), None]
    for bad in ("a", "a/b/c", ""):
        with pytest.raises(Exception, match="expected owner/name"):
            spark.createDataFrame([(bad,)], "n string").select(X.owner_and_name("n")).collect()


def test_wait_and_quota(spark):
    df = spark.createDataFrame([("2024-01-01T00:10:00Z", 5, 7), ("2023-01-01T00:00:00Z", None, 7), ("soon", 1, None), (None, 1, 1)], "r string, n int, l int")
    now = F.timestamp_seconds(F.lit(1704067200))
    assert [r[0] for r in df.select(X.wait_seconds("r", now)).collect()] == [605.0, 0.0, 0.0, 0.0]
    assert [r[0] for r in df.select(X.quota_text("n", "l", "r")).collect()] == [
        "Rate limit: 5/7 (resets at 00:10:00)", "Rate limit: ?/7 (resets at 00:00:00)", "Rate limit: 1/? (resets at soon)", "Rate limit: 1/1 (resets at ?)"]


def test_quota_pauses_only_when_low():
    q = Quota()
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    assert q.pause(now) == 0
    q.note({"remaining": 99, "resetAt": "2024-01-01T00:01:00Z", "limit": 5000})
    assert q.pause(now) == 65.0
    assert q.text() == "Rate limit: 99/5000 (resets at 00:01:00)"
    q.note({"remaining": 100})
    assert q.pause(now) == 0


def test_retrying():
    assert list(delays(3, 2)) == [2, 4, 8]
    assert list(delays(8, 1))[-2:] == [60.0, 60.0]
    waits, calls = [], []

    @retrying(3, base=2.0, errors=(OSError,), sleep=waits.append)
    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("x")
        return "done"

    assert flaky() == "done" and waits == [2, 4]

    @retrying(2, base=1.0, errors=(OSError,), sleep=waits.append)
    def broken():
        raise OSError("always")

    with pytest.raises(OSError, match="always"):
        broken()

    @retrying(2, errors=(OSError,), sleep=waits.append)
    def wrong():
        raise ValueError("not retried")

    n = len(waits)
    with pytest.raises(ValueError):
        wrong()
    assert len(waits) == n


@given(st.integers(0, 30))
def test_delays_never_exceed_the_most(n):
    d = list(delays(n))
    assert len(d) == n and all(0 < x <= 60 for x in d) and d == sorted(d)


def test_backoff_column(spark):
    got = [r[0] for r in spark.range(7).select(X.backoff_delay("id")).collect()]
    assert got == [2, 4, 8, 16, 32, 60, 60]
