"""Sessions to reclaim, the last snapshots, the fallback of a name without a page, and the numbers of communities."""

from datetime import datetime, timedelta

from lorekeep.operators import graph, search, sessions


def test_idle_reclaim_keeps_the_most_recent(spark):
    now = datetime(2024, 1, 2)
    rows = [(f"s{k}", now - timedelta(seconds=10 * (k // 2))) for k in range(6)] + [("old", now - timedelta(hours=2))]
    got = sessions.idle_reclaim(spark.createDataFrame(rows, "session string, last_ts timestamp"), now, most=3)
    # s2 and s3 are equally recent: the smaller name is kept
    assert {(r.session, r.reason) for r in got.collect()} == {("old", "idle"), ("s3", "cap"), ("s4", "cap"), ("s5", "cap")}


def test_last_snapshots(spark):
    rows = [("a", 1, "x"), ("a", 3, "y"), ("a", 3, "z"), ("b", 2, "w")]
    got = sessions.last_snapshots(spark.createDataFrame(rows, "id string, saved_at int, file string"))
    assert {tuple(r) for r in got.collect()} == {("a", 3, "z"), ("b", 2, "w")}


def test_page_or_best(spark):
    docs = spark.createDataFrame(
        [("a.md", "Apple", "entity", "red apple pie", []), ("b.md", "Bread", "entity", "warm bread", []), ("c.md", "Pie", "entity", "pie pie crust", [])],
        "page string, title string, type string, body string, aliases array<string>")
    keys = spark.createDataFrame([("a", "a.md"), ("b", "b.md"), ("c", "c.md")], "key string, owner string")
    names = spark.createDataFrame([("B",), ("pie",), ("nothing here",), ("B",)], "name string")
    got = {(r.name, r.rank, r.page) for r in search.page_or_best(names, keys, docs).collect()}
    assert got == {("B", 0, "b.md"), ("pie", 1, "c.md"), ("pie", 2, "a.md")}


def test_community_numbers_follow_least_members(spark):
    cliques = [[f"{c}{k}" for k in range(4)] for c in "pqrst"]
    edges = [(a, b, True) for ids in cliques for a in ids for b in ids if a < b]
    nodes = spark.createDataFrame([(x,) for ids in cliques for x in ids] + [("alone",)], "id string")
    got = {r.id: r.community for r in graph.communities(nodes, spark.createDataFrame(edges, "source string, target string, resolved boolean")).collect()}
    assert got == {"alone": 0} | {x: n + 1 for n, ids in enumerate(cliques) for x in ids}
