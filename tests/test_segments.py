"""Corpus segments, hash trees, image copies and review logs against plain rules."""

import random

from pyspark.sql import functions as F

from lorekeep.operators import index, maintain, search, trees
from lorekeep.sources import wiki
from lorekeep.streaming import corpus


def whole(spark, root):
    files = wiki.page_files(spark, root).where("not is_config")
    docs = wiki.parse_pages(files).select(F.col("path").alias("page"), F.coalesce("title", "stem").alias("title"), "body", "aliases")
    return docs


def test_refreshes_write_what_changed_and_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "FANOUT", 2)
    rng = random.Random(1)
    root = tmp_path / "wiki"
    (root / "concepts").mkdir(parents=True)
    text = lambda: " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "rare"], [8, 4, 2, 1, 0.3], k=rng.randrange(3, 30)))
    for k in range(40):
        (root / "concepts" / f"p{k:02}.md").write_text(text())
    c = corpus.Corpus(spark, str(root))
    assert c.refresh() == {"changed": 40, "gone": 0}
    levels = []
    for turn in range(5):
        (root / "concepts" / f"p{turn:02}.md").write_text(text() + " changed" * (turn + 1))
        if turn == 2:
            (root / "concepts" / "p30.md").unlink()
        if turn == 3:
            (root / "concepts" / "p30.md").write_text("back again")
        before = {id(s) for s in c.segments}
        assert c.refresh() == {"changed": 2 if turn == 3 else 1, "gone": int(turn == 2)}
        levels.append([s.level for s in c.segments])
        if turn == 1:  # one new segment, of one page
            new = [s for s in c.segments if id(s) not in before]
            assert len(new) == 1 and new[0].level == 0 and {r.page for r in new[0].postings.select("page").distinct().collect()} == {"concepts/p01.md"} and new[0].files.count() == 1
    assert levels == [[1], [1, 0], [2], [2, 0], [2, 1]] and c.refresh() == {"changed": 0, "gone": 0}
    docs = whole(spark, str(root))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(c.postings.select("page", "term", "tf")) == key(search.postings(docs)) and key(c.lengths) == key(search.lengths(docs))
    terms = search.query_terms(spark.createDataFrame([(1, "rare changed"), (2, "alpha delta")], "qid int, query string"))
    assert key(search.best_pages(c.postings, c.lengths, terms, 5)) == key(search.top_k(search.scores(search.postings(docs), search.lengths(docs), terms), 5))


def test_tree_difference_equals_that_of_all_files(spark):
    rng = random.Random(2)
    before = {f"{rng.choice('abc')}/{rng.choice('xy')}/{k}.md": str(rng.random()) for k in range(60)} | {"top.md": "1", "a": "<dir>"}
    after = {p: f for p, f in before.items() if rng.random() > 0.1}
    for p in rng.sample(sorted(after), 5):
        after[p] += "!"
    after |= {"b/new/deep/er/n.md": "2", "other.md": "3"}
    tree = lambda rows: trees.hash_tree(spark.createDataFrame(sorted(rows.items()), "path string, fp string"))
    want = {(p, "removed") for p in before.keys() - after.keys()} | {(p, "added") for p in after.keys() - before.keys()} | {(p, "modified") for p in before.keys() & after.keys() if before[p] != after[p]}
    got = [tuple(r) for r in trees.tree_diff(tree(before), tree(after)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert trees.tree_diff(tree(before), tree(before)).count() == 0
    nothing = trees.hash_tree(spark.createDataFrame([], "path string, fp string"))
    assert trees.tree_diff(nothing, tree({"a/b.md": "1"})).collect()[0].path == "a/b.md" and trees.tree_diff(nothing, nothing).count() == 0


def test_images_are_renamed_by_first_appearance(spark):
    pages = [
        ("n/x.md", '![a](one.png) t ![b]( ../two.JPG "title") ![c](one.png)![d](https://e/x.png) ![e](gone.png) ![f](%6Fne.png) ![g](notes.txt)'), ("plain.md", "no images [a](one.png)"),
        ("many.md", "".join(f"![i](m{k}.gif)" for k in range(5))), ("big.md", "![i](big.gif)"), ("sum.md", "![i](m0.gif)![i](half.gif)![i](half2.gif)"), ("up.md", "![i](../../x.png)")]
    files = [("n/one.png", 10), ("two.JPG", 20), ("n/notes.txt", 1), ("big.gif", 101), ("half.gif", 90), ("half2.gif", 90), *[(f"m{k}.gif", 30) for k in range(5)]]
    out = maintain.rewritten_images(spark.createDataFrame(pages, "page string, text string"), spark.createDataFrame(files, "path string, size long"), 100, 200, 4)
    got = {r.page: r for r in out.collect()}
    assert got["n/x.md"].text == '![a](images/x/x-1.png) t ![b]( images/x/x-2.jpg "title") ![c](images/x/x-1.png)![d](https://e/x.png) ![e](gone.png) ![f](images/x/x-1.png) ![g](notes.txt)'
    assert [(i.number, i.source, i["name"], i["size"]) for i in got["n/x.md"].images] == [(1, "n/one.png", "x-1.png", 10), (2, "two.JPG", "x-2.jpg", 20)] and got["n/x.md"].skipped == 3
    assert got["plain.md"].text == "no images [a](one.png)" and got["plain.md"].images == [] and got["up.md"].skipped == 1
    assert {p: (got[p].error, got[p].text) for p in ("many.md", "big.md", "sum.md")} == {"many.md": ("count", None), "big.md": ("size", None), "sum.md": ("total", None)}


def test_review_logs(spark):
    log = "# Log\n\n## [2024-01-01] ingest | a\n- x"
    good = '\n\n## [2024-01-02] audit | r\ntext\n- {"page":"p","slugs":["s","t"],"verdict":"ok"}\n- {"page":"q","slugs":["s"],"verdict":"no"}\n## [2024-01-03] x | y\n- not of the audit\n'
    cases = {
        1: (log, log + good), 2: (log, log.replace("x", "y") + good), 3: (log, log + good.replace('"q"', "1")), 4: (log, log + good + "## audit again\n"), 5: (log, log + "\n\n## other | z\n- {}\n"), 6: (log + good, log + good),
        7: (log, log[:-3] + good), 8: (log, log + "yz" + good), 9: (log, log + good.replace('"verdict":"no"', '"verdict":"no"').replace("- {\"page\":\"q\"", "- {oops"))}
    lines = lambda side: index.lines_of(spark.createDataFrame([(k, v[side]) for k, v in cases.items()], "key long, text string"), "key")
    got = maintain.reviewed_entries(lines(0), lines(1)).collect()
    assert sorted((r.key, r.page, tuple(r.slugs), r.verdict) for r in got) == [(k, *x) for k in (1, 8) for x in (("p", ("s", "t"), "ok"), ("q", ("s",), "no"))]
    assert {r.key: r.ok for r in maintain.log_grew(lines(0), lines(1)).collect()} == {k: k not in (2, 7) for k in cases}
