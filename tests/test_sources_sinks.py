import json
import sys
import types

import pytest
from pyspark.sql import functions as F

from lodestrata.__main__ import main, parser, select
from lodestrata.operators.flatten import flatten
from lodestrata.schema import COLUMNS, FLAT
from lodestrata.sources import files, sinks
from lodestrata.sources.paged import PagedSource, ResponseError, checked, pages
from lodestrata.streaming import ingest as I

HOSTILE = 'quote " comma, new\nline 名 a\r\nb\rc'


def flat_row(**k):
    base = {c: (0 if c in ("stars", "forks", "watchers", "open_issues", "disk_usage_kb", "owner_followers") else False if c.startswith(("is_", "has_")) else [] if c in ("languages", "topics") else "v") for c in COLUMNS}
    return tuple((base | k)[c] for c in COLUMNS)


@pytest.fixture()
def table(spark):
    return spark.createDataFrame([flat_row(nwo="a/b", name="b", owner_login="a", stars=3, description=HOSTILE, languages=["é", 'q"']), flat_row(nwo="c/d", name="d", owner_login="c", description=None, is_fork=True)], FLAT)


def test_parquet(spark, table, tmp_path):
    path = sinks.write_table(table, str(tmp_path / "deep/out"))
    assert path.endswith("out.parquet")
    got = {r.nwo: r for r in files.read_table(spark, path).collect()}
    assert got["a/b"].languages == '["\\u00e9", "q\\""]' and got["a/b"].description == HOSTILE and got["c/d"].description is None
    sinks.write_table(table.where("false"), path)
    assert files.read_table(spark, path).count() == 0 and files.read_table(spark, path).columns == COLUMNS


def test_csv(spark, table, tmp_path):
    path = sinks.write_table(table, str(tmp_path / "t.csv"), single=True)
    got = {r.nwo: r for r in files.read_table(spark, path).collect()}
    assert got["a/b"].description == HOSTILE and got["c/d"].is_fork is True and not got["c/d"].description
    text = "".join(p.read_text() for p in (tmp_path / "t.csv").glob("part*"))
    assert text.startswith(",".join(COLUMNS)) and "True" in text and '""' in text


@pytest.mark.parametrize("name, want", [("x.csv", ("csv", "x.csv")), ("x", ("parquet", "x.parquet")), ("d.e/x", ("parquet", "d.e/x.parquet")), ("x.json", ("parquet", "x.json"))])
def test_kinds(name, want):
    assert sinks.kind_of(name) == want


def test_users_file(spark, tmp_path):
    names = ["null", "NA", "007", "123", "dup", "dup", 'q"x', " pad "]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "username string, ord int")
    sinks.write_users(df, str(tmp_path / "u"))
    got = files.users_file(spark, str(tmp_path / "u")).orderBy("ord")
    assert [r.username for r in got.collect()] == names
    assert files.users_file(spark, str(tmp_path / "u"), 3).count() == 3 and files.users_file(spark, str(tmp_path / "u"), 0).count() == 0
    sinks.write_users(df.where("false"), str(tmp_path / "e"))
    assert files.users_file(spark, str(tmp_path / "e")).count() == 0
    assert sinks.users_path("out/x.parquet") == "out/x_users.csv" and sinks.users_path("x") == "x_users.csv"


def test_users_files_in_order(spark, tmp_path):
    """The head of a list in several files is that of the first, however large the others are."""
    (tmp_path / "u").mkdir()
    (tmp_path / "u/part-0.csv").write_text("username\na1\na2\n")
    (tmp_path / "u/part-1.csv").write_text("username\n" + "".join(f"b{i}\n" for i in range(500)))
    assert [r.username for r in files.users_file(spark, str(tmp_path / "u"), 3).collect()] == ["a1", "a2", "b0"]
    assert [r.username for r in files.users_file(spark, str(tmp_path / "u")).orderBy("ord").collect()][:4] == ["a1", "a2", "b0", "b1"]


def test_responses(spark, tmp_path):
    good = {"data": {"rateLimit": {"remaining": 9, "resetAt": "2024-01-01T00:00:00Z"}, "search": {"pageInfo": {"hasNextPage": False}, "userCount": 7, "nodes": [{"login": "a", "__typename": "User"}, None, {"login": ""}]}}}
    repo = {"data": {"search": {"repositoryCount": 1, "nodes": [{"name": "r", "owner": {"login": "o", "__typename": "User"}}, None]}}}
    bad = {"data": None, "errors": [{"message": "x"}, {"message": "y"}]}
    (tmp_path / "ok.json").write_text(json.dumps(good) + "\n")
    (tmp_path / "repo.json").write_text(json.dumps(repo) + "\n\n")
    (tmp_path / "bad.json").write_text(json.dumps(good) + "\n" + json.dumps(bad) + "\nno json\n")
    ok = files.responses(spark, str(tmp_path / "ok.json"))
    assert [(r.login, r.kind) for r in files.account_nodes(ok).collect()] == [("a", "User")]
    assert files.page_counts(ok, "userCount").first().cnt == 7
    assert [(r.remaining, r.limit) for r in files.quota_records(ok).collect()] == [(9, None)]
    nodes = files.repository_nodes(files.responses(spark, str(tmp_path / "repo.json")))
    assert [r.name for r in flatten(nodes).collect()] == ["r"]
    with pytest.raises(Exception, match="x; y"):
        files.responses(spark, str(tmp_path / "bad.json")).collect()
    assert files.responses(spark, str(tmp_path / "bad.json"), "drop").count() == 1
    assert [r.error for r in files.responses(spark, str(tmp_path / "bad.json"), "keep").collect()] == [None, "x; y", "no JSON response"]


def service(total, size=3, fail=0):
    state = {"fail": fail, "asked": []}

    def fetch(query, cursor, first):
        if state["fail"]:
            state["fail"] -= 1
            raise OSError("gone")
        at = int(cursor or 0)
        state["asked"].append(first)
        n = min(first, size, total - at)
        return {"data": {"search": {"nodes": [{"i": at + k} for k in range(n)], "pageInfo": {"hasNextPage": at + n < total, "endCursor": str(at + n)}}, "rateLimit": {"remaining": 50, "resetAt": "2000-01-01T00:00:00Z"}}}

    return fetch, state


def test_pages():
    fetch, state = service(7, fail=2)
    waits = []
    got = [n["i"] for p in pages(fetch, "q", first=3, sleep=waits.append) for n in p["nodes"]]
    assert got == list(range(7)) and waits == [2.0, 4.0]
    fetch, state = service(7)
    assert sum(len(p["nodes"]) for p in pages(fetch, "q", first=3, limit=4)) == 4 and state["asked"] == [3, 1]
    assert list(pages(service(0)[0], "q")) == []
    with pytest.raises(ResponseError, match="a; b"):
        checked({"data": None, "errors": [{"message": "a"}, {"message": "b"}]})


def test_paged_source(spark, tmp_path, monkeypatch):
    (tmp_path / "lodestrata_test_transport.py").write_text(
        "def fetch(query, cursor, first):\n    at = int(cursor or 0)\n    return {'data': {'search': {'nodes': [{'q': query, 'i': at}, None], 'pageInfo': {'hasNextPage': at < 2, 'endCursor': str(at + 1)}}}}\n"
    )
    spark.sparkContext.addPyFile(str(tmp_path / "lodestrata_test_transport.py"))
    spark.dataSource.register(PagedSource)
    df = spark.read.format("paged").option("transport", "lodestrata_test_transport:fetch").option("queries", json.dumps(["x", "y"])).load()
    assert sorted((r.query, r.page_no) for r in df.collect()) == [(q, i) for q in "xy" for i in range(3)]
    assert df.rdd.getNumPartitions() == 2


def test_ingest_resumes(spark, tmp_path):
    def put(i):
        spark.createDataFrame([(json.dumps({"name": f"r{i}"}),)], "node string").write.parquet(str(tmp_path / f"in/{i}"))

    put(0)
    go = lambda: I.ingest(spark.readStream.schema("node string").parquet(str(tmp_path / "in/*")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    go()
    go()
    put(1)
    go()
    assert sorted(r.name for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["r0", "r1"]


def test_distinct_stream_and_batches(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, s long").select("k", F.timestamp_seconds("s").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = I.distinct_stream(spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in")), ["k"], "ts")
    seen = []
    I.each_batch(stream, lambda b, n: seen.extend(r.k for r in b.collect()), str(tmp_path / "c")).awaitTermination()
    assert sorted(seen) == ["a", "b"]


def test_progress(spark, tmp_path):
    import time

    from lodestrata.streaming.progress import Progress, observed

    df, seen = observed(spark.range(10), F.col("id") > 6)
    assert df.count() == 10 and seen.get == {"scanned": 10, "matched": 3}
    spark.range(5).write.parquet(str(tmp_path / "in"))
    listener = Progress()
    spark.streams.addListener(listener)
    I.each_batch(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), lambda b, n: b.count(), str(tmp_path / "c")).awaitTermination()
    for _ in range(50):
        if listener.ended:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert sum(b[2] for b in listener.batches) == 5 and listener.ended[0][1] is None


def test_unfinished(spark):
    a = spark.createDataFrame([("x",), ("y",), (None,)], "username string")
    done = spark.createDataFrame([("x",), ("x",)], "owner_login string")
    assert [r.username for r in I.unfinished(a, done).where("username is not null").collect()] == ["y"]


def test_command_line(spark, table, tmp_path):
    repos = sinks.write_table(table, str(tmp_path / "repos"))
    owners = str(tmp_path / "owners")
    spark.createDataFrame([(1, "a", "User", "Lima"), (2, "c", "Organization", "Lima")], "account_id long, owner_login string, owner_type string, owner_location string").write.parquet(owners)
    args = lambda *x: parser().parse_args([*x, "--repositories", repos, "--owners", owners, "-o", str(tmp_path / "o")])
    run = lambda *x: sorted(r.nwo for r in select(spark, args(*x))[0].collect())
    assert run("--repo", "a/b", "--query", "stars:>=99") == ["a/b"]
    assert run("--query", "stars:>=1") == ["a/b"]
    assert run("--query", "fork:true stars:>=0", "--include-forks") == ["c/d"]
    assert run("--location", "lima") == ["a/b"]
    assert run("--location", "lima", "--min-stars", "0", "--include-forks") == ["a/b", "c/d"]
    assert run("--location", "lima", "--min-stars", "0", "--include-forks", "--no-orgs") == ["a/b"]
    assert run("--location", "lima", "--max-users", "0") == []
    assert main(["--repositories", repos, "-o", str(tmp_path / "o")]) == 1
    assert isinstance(sys.modules["lodestrata.__main__"], types.ModuleType)
