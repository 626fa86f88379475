from datetime import datetime, timedelta

from gridloom.llm import urls

EVENTS = [("bad.org", "add", "2024-01-10"), ("bad.org", "remove", "2024-02-10"), ("bad.org", "add", "2024-03-10"), ("x.bad.org", "add", "2024-02-01"), ("same.net", "add", "2024-01-01"), ("same.net", "remove", "2024-01-01"), ("again.io", "add", "2024-01-01"), ("again.io", "add", "2024-01-05"), (None, "add", "2024-01-01"), ("null.at", "add", None)]


def active(events, at):
    """Patterns active at a time, by replaying the history."""
    out = set()
    for p, action, d in sorted((e for e in events if e[0] and e[2]), key=lambda e: (e[2], e[1] == "remove")):
        if datetime.fromisoformat(d) <= at:
            (out.add if action == "add" else out.discard)(p)
    return out


def test_as_by_replaying_the_list(spark):
    hosts = ["bad.org", "BAD.org.", "a.b.x.bad.org", "notbad.org", "same.net", "w.again.io", "a.b.c.d.e.f.g.h.bad.org", "null.at"]
    rows = [(i, f"https://u@{h}:80/p?q#f", datetime(2024, 1, 1) + timedelta(days=7 * k)) for i, h in enumerate(hosts) for k in range(12)]
    rows += [(90, None, datetime(2024, 3, 11)), (91, "no url", datetime(2024, 3, 11)), (92, "http://bad.org", None), (93, "", None), rows[3]]
    events = spark.createDataFrame(EVENTS, "pattern string, action string, at string").withColumn("at", urls.F.to_timestamp("at"))
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, fetched_at timestamp, host string")
    for bound in (urls.BROADCAST, 0):
        urls.BROADCAST, keep = bound, urls.BROADCAST
        got = sorted(((r.page_id, str(r.fetched_at), r.matched, r.blocked) for r in urls.filter_captures(df, events).collect()), key=str)
        urls.BROADCAST = keep
        want = []
        for i, u, at in rows:
            h = hosts[i].lower().rstrip(".") if i < 90 else "bad.org" if i == 92 else None
            m = max((p for p in active(EVENTS, at) if h == p or h.endswith("." + p)), key=len, default=None) if h and at else None
            want.append((i, str(at), m, m is not None))
        assert got == sorted(want, key=str)
    assert urls.filter_captures(df.limit(0), events).collect() == []
    assert not any(r.blocked for r in urls.filter_captures(df, events.limit(0)).collect())


def test_no_python_in_the_plan(spark):
    plan = urls.op10_url_filters(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_entries_of_many_labels_match_deeper_hosts(spark):
    pages = spark.createDataFrame([(1, "http://w.a.b.c.d.e.x.com/", "2024-02-01"), (2, "http://w.b.c.d.e.x.com/", "2024-02-01")], "page_id long, url string, fetched_at string")
    events = spark.createDataFrame([("a.b.c.d.e.x.com", "add", "2024-01-01")], "pattern string, action string, at string")
    got = {r.page_id: r.matched for r in urls.filter_captures(pages, events).collect()}
    assert got == {1: "a.b.c.d.e.x.com", 2: None}
