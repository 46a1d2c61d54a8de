from lexgraph.llm import url_filter as u

CAPTURES = "page_id long, url string, fetched_at long, host string, lists string"
ENTRIES = "list string, pattern string, action string, at long, url string"


def entries(spark, *rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], ENTRIES)


def test_intervals(spark):
    got = u.intervals(entries(spark, ("a", "X.com", "add", 5), ("a", "x.com", "add", 7), ("a", "x.com", "remove", 9), ("a", "x.com", "remove", 9), ("a", "x.com", "add", 20), ("a", "x.com", "add", 30), ("a", "x.com", "remove", 30), ("a", "y.com", "remove", 1), (None, "x.com", "add", 1), ("a", None, "add", 1), ("a", "x.com", "else", 1)))
    assert sorted(map(tuple, got.collect()), key=repr) == [("a", "x.com", 20, 30), ("a", "x.com", 5, 9)]


def test_captures_are_judged_at_their_time(spark):
    log = entries(spark, ("a", "x.com", "add", 5), ("a", "x.com", "remove", 9), ("b", "sub.x.com/p/", "add", 6), ("b", "x.com", "add", 8))
    rows = [
        (1, "http://x.com/", 4), (2, "http://x.com/", 5), (3, "https://user@SUB.x.com.:80/p/q?x=1", 6), (4, "http://sub.x.com/pq", 6), (5, "http://x.com/", 9), (6, None, 6), (7, "nonsense", 6),
        (8, "http://x.com/", None), (None, "http://notx.com/x.com", 6), (2, "http://x.com/", 5), (9, "http://a.b.c.x.com", 8), (10, "http://" + "a." * 50 + "x.com/" + "s/" * 200, 6),
    ]
    got = u.filter_urls(spark.createDataFrame([(*r, "clash", "clash") for r in rows], CAPTURES), log).collect()
    found = sorted(((r.page_id, r.lists, r.n_lists, r.blocked) for r in got), key=repr)
    want = [(1, "", 0, False), (2, "a", 1, True), (2, "a", 1, True), (3, "a,b", 2, True), (4, "a", 1, True), (5, "b", 1, True), (6, "", 0, False), (7, "", 0, False), (8, "", 0, False), (None, "", 0, False), (9, "a,b", 2, True), (10, "a", 1, True)]
    assert found == sorted(want, key=repr)
    assert {r.page_id: r.host for r in got}[3] == "sub.x.com"


def test_pages_prefixes_and_addresses(spark):
    log = entries(spark, ("page", "http://X.com/p/One.html#top", "add", 0), ("pre", "x.com/De", "add", 0), ("dir", "x.com/en/", "add", 0), ("q", "x.com/s?id=1", "add", 0), ("six", "http://[2001:DB8::1]:80/", "add", 0), ("four", "10.0.0.1", "add", 0), ("tld", "org", "add", 0), ("void", "/p/", "add", 0), ("root", "y.com/", "add", 0))
    asked = {
        "http://x.com/p/One.html": "page", "http://a.x.com//p/One.html?x=1": "page", "http://x.com/p/one.html": "", "http://x.com/p/One.html/": "page", "http://x.com/De": "pre", "http://x.com/De/x?y": "pre", "http://x.com/Der": "", "http://x.com/de/": "",
        "http://x.com/en": "", "http://x.com/en/": "dir", "http://x.com/en/a/b": "dir", "http://x.com/s?id=1": "q", "http://x.com/s?id=12": "", "http://[2001:db8::1]/x": "six", "https://10.0.0.1:8080/": "four", "http://0.0.1/": "", "http://a.b.org": "tld", "http://m.y.com?q": "root",
    }
    got = u.filter_urls(spark.createDataFrame([(k, url, 5, "", "") for k, url in enumerate(asked)], CAPTURES), log).collect()
    assert {r.url: r.lists for r in got} == asked


def test_a_long_history_is_cut_by_periods(spark):
    log = [("a", "x.com/p", "add" if k % 2 == 0 else "remove", 10 * k) for k in range(-50, 200)] + [("b", "x.com", "add", 300)]
    rows = [(k, "http://x.com/p", k, "", "") for k in range(0, 1500, 7)]
    got = u.filter_urls(spark.createDataFrame(rows, CAPTURES), entries(spark, *log)).collect()
    assert {r.page_id: r.lists for r in got} == {k: ",".join(["a"] * (k // 10 % 2 == 0) + ["b"] * (k >= 300)) for k, *_ in rows}


def test_empty_tables(spark):
    none = spark.createDataFrame([], CAPTURES)
    assert u.filter_urls(none, entries(spark)).collect() == []
    some = spark.createDataFrame([(1, "http://x.com", 1, "", "")], CAPTURES)
    assert [r.blocked for r in u.filter_urls(some, entries(spark)).collect()] == [False]


def test_dates_against_timestamps(spark):
    captures = spark.sql("SELECT 1 AS page_id, 'http://x.com/a' AS url, TIMESTAMP'2024-03-01 10:00:00' AS fetched_at UNION ALL SELECT 2, 'http://x.com/a', TIMESTAMP'2024-02-29 23:59:59'")
    entries = spark.sql("SELECT 'l' AS list, 'x.com' AS pattern, 'add' AS action, DATE'2024-03-01' AS at")
    assert {r.page_id: r.blocked for r in u.filter_urls(captures, entries).collect()} == {1: True, 2: False}
    by_day = captures.withColumn("fetched_at", captures["fetched_at"].cast("date"))
    assert {r.page_id: r.blocked for r in u.filter_urls(by_day, entries.withColumn("at", entries["at"].cast("timestamp"))).collect()} == {1: True, 2: False}
