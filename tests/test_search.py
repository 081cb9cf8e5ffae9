import pytest
from pyspark.sql import functions as F
from hypothesis import given, strategies as st

from lodestrata.operators import search as S

ROWS = [
    ("a/x", "Python", 10, "2020-01-01T23:59:59Z", "mit", False, '["cli", "Web"]', "Lima, Peru", "User"),
    ("b/y", "python", 5, "2020-12-31T23:59:59+00:00", "", True, "[]", None, "Organization"),
    ("c/z", None, None, "", None, None, None, "50%_off", "User"),
]
DDL = "nwo string, primary_language string, stars bigint, created_at string, license_key string, is_fork boolean, topics string, owner_location string, owner_type string"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, DDL).cache()


def hits(df, text, **k):
    return [r.nwo[0] for r in S.search(df, text, **k).orderBy("nwo").collect()]


@pytest.mark.parametrize("text, want", [
    ("", "abc"), ("language:PYTHON", "ab"), ("stars:>=5", "ab"), ("stars:>5", "a"), ("stars:<10", "b"), ("stars:10", "a"), ("stars:5..9", "b"), ("stars:*..6", "b"), ("stars:6..*", "a"),
    ("created:2020-01-01..2020-12-31", "ab"), ("created:2020-01-01", "a"), ("created:>=2020-01-02", "b"), ("license:mit", "a"), ("fork:false", "a"), ("-fork:true", "ac"), ("topic:web", "a"),
    ('location:"lima, p"', "a"), ("location:%_", "c"), ("type:org", "b"), ("type:user stars:>=1", "a"), ("-language:python", "c"),
])
def test_qualifiers(df, text, want):
    assert hits(df, text) == list(want)


@pytest.mark.parametrize("text", ["word", "nothing:1", "stars:many", "created:soon", "fork:maybe", "type:robot", "mirror:true", "sort:names", "language:x word"])
def test_what_is_not_understood_is_an_error(df, text):
    with pytest.raises(S.SearchError):
        S.search(df, text)


def test_sort_and_limit(df):
    assert [r.nwo for r in S.search(df, "sort:stars", limit=2).collect()] == ["a/x", "b/y"]
    assert S.search(df, "sort:stars", limit=0).count() == 0


@given(st.lists(st.tuples(st.sampled_from(["language", "topic", "user"]), st.text("abc -9\"é", max_size=6).filter(lambda x: '"' not in x), st.booleans()), max_size=5))
def test_parse_round_trip(parts):
    s = S.Search(tuple(S.Term(*p) for p in parts), "stars")
    assert S.parse(str(s)) == s


@pytest.mark.parametrize("args, want", [
    ((None, 5, None), "stars:>=5 sort:stars"), (("Go", 5, None), "language:Go stars:>=5 sort:stars"), ((None, 5, "topic:x"), "topic:x stars:>=5"), (("Go", 5, "topic:x"), "topic:x stars:>=5"),
    ((None, 0, None), "stars:>=0 sort:stars"), ((None, 5, "a stars:1"), "a stars:1"), ((None, 5, "topic:superstars:x"), "topic:superstars:x"), ((None, 5, ""), "stars:>=5 sort:stars"),
])
def test_build(spark, args, want):
    assert S.build(*args) == want
    from pyspark.sql import functions as F

    language, floor, custom = args
    row = spark.range(1).select(S.build_column(F.lit(language).cast("string"), F.lit(floor), F.lit(custom).cast("string")))
    assert row.first()[0] == want


def test_contains_and_matches(df):
    assert [r.nwo for r in df.where(S.contains("owner_location", "LIMA")).collect()] == ["a/x"]
    assert df.where(S.contains("owner_location", "")).count() == 3
    assert [r.nwo for r in df.where(S.matches("owner_location", "l.ma|OFF$")).orderBy("nwo").collect()] == ["a/x", "c/z"]


def test_filters_reach_the_files(df, tmp_path, spark):
    path = str(tmp_path / "t")
    df.write.parquet(path)
    plan = S.search(spark.read.parquet(path), "stars:>=5 fork:false").select("nwo")._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters")[1].split("ReadSchema")[0]
    assert "GreaterThanOrEqual(stars,5)" in pushed and "is_fork" in pushed
    assert "topics" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("text, column", [
    ("language:kotlin", "primary_language"), ("license:mit", "license_key"), ("user:a", "owner_login"), ("created:2020-01-01..2021-02-02", "created_at"), ("pushed:>=2020-05-05", "pushed_at"),
    ("updated:<2020-05-05", "updated_at"), ("size:>=1", "disk_usage_kb"), ("stars:1..5", "stars"), ("forks:>2", "forks"), ("archived:true", "is_archived"), ("type:org", "owner_type"), ("topic:cli", "topics"),
])
def test_every_qualifier_reaches_the_files(df, tmp_path, spark, text, column):
    path = str(tmp_path / "t")
    df.limit(0).write.parquet(path)
    full = spark.read.parquet(path)
    full = full.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("primary_language", "string"), ("license_key", "string"), ("owner_login", "string"), ("created_at", "string"), ("pushed_at", "string"), ("updated_at", "string"), ("disk_usage_kb", "long"), ("forks", "long"), ("is_archived", "boolean"), ("owner_type", "string"), ("topics", "string")) if c not in full.columns))
    full.write.parquet(path + "2")
    plan = S.search(spark.read.parquet(path + "2"), text).select("nwo")._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters")[1].split("ReadSchema")[0]
    assert f"({column}" in pushed


def test_pushed_ranges_lose_nothing(spark):
    rows = [("PyThOn", "2020-12-31T23:30:00-02:00"), ("python", "2021-01-01T00:30:00+02:00"), ("PYTHON", "2021-01-01T00:00:00Z"), ("pythona", "2021-06-01T00:00:00Z"), ("\u212aotlin", "2020-06-01T00:00:00Z"), (None, None)]
    df = spark.createDataFrame(rows, "primary_language string, created_at string")
    count = lambda text: df.where(S.condition(text, df)).count()
    assert count("language:python") == 3 and count("language:kotlin") == 1 and count("-language:python") == 3
    assert count("created:2021-01-01") == 2 and count("created:2020-12-31") == 1 and count("created:>=2021-01-01") == 3 and count("created:<2021-01-01") == 2
