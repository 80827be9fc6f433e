import datetime as dt

import odd

from check_oracles import compare
from gradewell.llm.url_lists import as_of_blocks

D = dt.date.fromisoformat


def test_registered_query_equals_sql(spark):
    equal, n, difference = compare(spark, "/root/testdata/sf0.01", "op8_url_lists")
    assert equal and n == 250, difference


def test_plan_has_no_python(spark):
    from gradewell.llm.queries import op8_url_lists

    plan = op8_url_lists(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_as_of(spark):
    entries = [
        ("host", "a.example.com", D("2024-01-10"), True), ("host", "a.example.com", D("2024-03-01"), False),
        ("host", "a.example.com", D("2024-05-01"), True), ("domain", "example.com", D("2024-02-01"), True),
        ("domain", "example.com", D("2024-04-01"), False), ("prefix", "b.org/x/", D("2024-01-01"), True),
        ("prefix", "b.org/x/y", D("2024-01-01"), True), ("host", "c.net", D("2024-01-05"), False), ("host", "c.net", D("2024-01-05"), True),
        ("host", None, D("2024-01-01"), True), ("host", "d.net", None, True), (None, "d.net", D("2024-01-01"), True),
    ]
    captures = [
        (1, "https://a.example.com/p", "2024-01-09"), (2, "https://a.example.com/p", "2024-01-10"), (3, "http://A.EXAMPLE.com:8080/p?q#f", "2024-02-29"),
        (4, "https://a.example.com", "2024-03-01"), (5, "https://a.example.com", "2024-04-15"), (6, "https://a.example.com", "2030-01-01"),
        (7, "https://user@b.org/x/y/z", "2024-01-01"), (8, "https://b.org/x/y", "2024-01-01"), (9, "https://b.org/xx/y", "2024-01-01"),
        (10, "https://c.net/", "2024-01-05"), (11, None, "2024-01-05"), (12, "not a url", "2024-01-05"), (13, "https://c.net/", None),
        (14, "https://badexample.com/", "2024-02-02"), (15, "https://d.net/", "2024-02-02"), (None, "https://c.net/", "2024-01-06"),
        (10, "https://c.net/", "2024-01-05"), (16, "https://b.org/x/" + "s/" * 5_000, "2024-01-02"), (17, "https://" + "l." * 3_000 + "example.com/", "2024-02-02"),
    ]
    wanted = {
        1: None, 2: ("host", "a.example.com"), 3: ("host", "a.example.com"), 4: ("domain", "example.com"), 5: None, 6: ("host", "a.example.com"),
        7: ("prefix", "b.org/x/"), 8: ("prefix", "b.org/x/y"), 9: None, 10: ("host", "c.net"), 11: None, 12: None, 13: None, 14: None, 15: None,
        None: ("host", "c.net"), 16: ("prefix", "b.org/x/"), 17: ("domain", "example.com"),
    }
    df = spark.createDataFrame([(i, u, None if d is None else D(d), "x", True) for i, u, d in captures], "id bigint, url string, day date, key string, blocked boolean")
    table = spark.createDataFrame([(*e, "x") for e in entries], "kind string, key string, since date, listed boolean, url string")
    rows = as_of_blocks(df, table, "id", "url", "day").collect()
    assert len(rows) == len(captures)
    for r in rows:
        assert ((r["kind"], r["key"]) if r["blocked"] else None) == wanted[r["id"]], r
    assert as_of_blocks(df, table.limit(0), "id", "url", "day").where("blocked").count() == 0
    assert as_of_blocks(df.limit(0), table, "id", "url", "day").count() == 0
    assert odd.nothing(spark).count() == 0


def test_a_third_of_all_captures_under_one_host(spark, monkeypatch):
    """Keys that many captures share, listed, unlisted and taken off again, with no table small enough to be broadcast."""
    from gradewell import workspace

    monkeypatch.setattr(workspace, "BROADCAST_ROWS", 4)
    hosts = ["hot.example.com"] * 40 + ["cold.example.com"] * 40 + [f"h{i}.org" for i in range(40)]
    captures = [(i, f"https://{h}/p{i}", D("2024-01-01") + dt.timedelta(days=i)) for i, h in enumerate(hosts)]
    entries = [("host", "hot.example.com", D("2024-01-10"), True), ("host", "hot.example.com", D("2024-01-25"), False)]
    entries += [("host", f"h{i}.org", D("2024-01-01"), True) for i in range(0, 40, 2)]
    df = spark.createDataFrame(captures, "id bigint, url string, day date")
    table = spark.createDataFrame(entries, "kind string, key string, since date, listed boolean")
    rows = as_of_blocks(df, table, "id", "url", "day").collect()
    blocked = {r["id"] for r in rows if r["blocked"]}
    assert len(rows) == 120 and blocked == {*range(9, 24), *range(80, 120, 2)}
