import datetime as dt

import pytest
from pyspark.sql import functions as F

from marginflow.llm.urls import domains_of, filter_urls, host_of, plain_url, validity

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


@pytest.fixture
def captures(spark):
    def make(rows):
        return spark.createDataFrame(rows, "page_id long, url string, fetched date, host string")

    return make


@pytest.fixture
def entries(spark):
    def make(rows):
        return spark.createDataFrame(
            rows, "kind string, pattern string, action string, day date, category string"
        )

    return make


def test_parts_of_urls(spark):
    rows = spark.createDataFrame(
        [("HTTPS://User@WWW.Ex.org.:80/A/b/?q=1#f",), ("no url",), (None,), ("ftp://h",)], "u string"
    )
    got = rows.select(host_of(F.col("u")).alias("h"), plain_url(F.col("u")).alias("p")).collect()
    assert [r.h for r in got] == ["www.ex.org", None, None, "h"]
    assert got[0].p == "user@www.ex.org.:80/a/b" and got[2].p is None
    names = rows.select(domains_of(host_of(F.col("u"))).alias("d")).collect()
    assert names[0].d == ["www.ex.org", "ex.org"] and names[3].d == []


def test_intervals(entries):
    rows = [
        ("host", "A.x", "add", day(0), "k"),
        ("host", "a.x", "add", day(0), "k"),
        ("host", "a.x", "remove", day(0), "k"),
        ("host", "a.x", "remove", day(5), None),
        ("host", "a.x", "add", day(9), "l"),
        (None, "a.x", "add", day(9), "l"),
        ("host", None, "add", day(9), "l"),
        ("host", "b", "drop", day(9), "l"),
        ("host", "b", "add", None, "l"),
    ]
    got = validity(entries(rows)).orderBy("since").collect()
    assert [(r.since, r.until, r.category) for r in got] == [
        (day(0), day(5), "k"),
        (day(9), dt.date(9999, 12, 31), "l"),
    ]


def test_as_of_against_brute_force(captures, entries):
    import random

    draw = random.Random(2)
    hosts = ["a.x.org", "b.x.org", "x.org", "deep.b.x.org", "y.net"]
    events = {}
    for _ in range(60):
        kind = draw.choice(["host", "domain", "url"])
        pattern = draw.choice(hosts) + ("/p" if kind == "url" else "")
        events[kind, pattern, day(draw.randrange(40))] = (draw.random() < 0.6, draw.choice("cd"))
    rows = [
        (k, p, "add" if on else "remove", d, c) for (k, p, d), (on, c) in events.items()
    ]
    caps = [(i, f"http://{draw.choice(hosts)}/p", day(draw.randrange(45)), "h") for i in range(300)]
    got = {r.page_id: r for r in filter_urls(captures(caps), entries(rows)).collect()}

    def state(kind, pattern, at):
        past = [(d, v) for (k, p, d), v in events.items() if (k, p) == (kind, pattern) and d <= at]
        return max(past)[1] if past and max(past)[1][0] else None

    for i, url, at, _ in caps:
        host = url[7:-2]
        labels = host.split(".")
        asked = [("url", host + "/p"), ("host", host)]
        asked += [("domain", ".".join(labels[k:])) for k in range(len(labels) - 1)]
        hit = next((a for a in asked if state(*a, at)), None)
        r = got[i]
        assert r.blocked == (hit is not None) and (r.kind, r.pattern) == (hit or (None, None))
        assert r.host == host


def test_odd_rows(captures, entries):
    caps = [(1, None, day(0), "x"), (2, "nonsense", day(0), "x"), (3, "http://a.x/", None, "x")]
    caps += [(4, "http://a.x/" + "p" * 50_000, day(3), "x")] * 2 + [(None, "http://a.x/", day(3), "x")]
    rows = [("host", "a.x", "add", day(0), None)]
    got = filter_urls(captures(caps), entries(rows))
    assert got.columns.count("host") == 1
    assert sorted((r.page_id or 0, r.blocked) for r in got.collect()) == [
        (0, True), (1, False), (2, False), (3, False), (4, True), (4, True)
    ]
    assert filter_urls(captures([]), entries(rows)).collect() == []
    assert not any(r.blocked for r in filter_urls(captures(caps), entries([])).collect())


def test_native_plan(captures, entries):
    plan = filter_urls(captures([]), entries([]))._jdf.queryExecution().toString()
    assert not any(k in plan for k in ("Python", "Pandas", "ArrowEval", "MapInArrow"))
