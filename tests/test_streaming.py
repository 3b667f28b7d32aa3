"""Streams that read all there is give what their batch twins give."""

from datetime import datetime, timedelta

from lorekeep.operators import sessions
from lorekeep.sources import wiki
from lorekeep.streaming import corpus, messages


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams_equal_batches(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [(1, "s", at(0), "a"), (1, "s", at(0.2), "a"), (2, "s", at(0.5), "b"), (3, "s", at(5), "/help"), (4, "s", at(5.1), "c"), (5, "s", at(4000), "d"), (6, "t", at(9000), "e")]
    spark.createDataFrame(rows, "msg_id long, session string, ts timestamp, text string").coalesce(1).write.parquet(f"{tmp_path}/m")
    batch = spark.read.parquet(f"{tmp_path}/m")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/m")
    assert run(messages.dedup_stream(stream), "deduped").count() == 6
    told = run(messages.session_stream(stream), "told").selectExpr("session", "ts", "state").collect()
    assert sorted(map(tuple, told)) == sorted(map(tuple, sessions.session_states(batch).select("session", "ts", "state").collect()))


def test_listing_by_address(spark, tmp_path):
    """A root with a scheme is listed by Spark's source: the same files, contents and pages as the local folder."""
    (tmp_path / "w" / "concepts").mkdir(parents=True)
    for name, text in (("a.md", "alpha"), ("concepts/b c.md", "---\ntitle: B\n---\nbeta [[a]]"), ("x.txt", "no page")):
        (tmp_path / "w" / name).write_text(text)
    local, stored = (wiki.list_tree(spark, r).where("kind = 'file'") for r in (f"{tmp_path}/w", f"file://{tmp_path}/w/"))
    assert sorted(r.path for r in stored.collect()) == ["a.md", "concepts/b c.md", "x.txt"]
    assert {(r.path, r["size"], r.mtime_ns // 10**6) for r in local.collect()} == {(r.path, r["size"], r.mtime_ns // 10**6) for r in stored.collect()}
    pages = lambda r: {(p.path, p.text) for p in wiki.parse_pages(wiki.page_files(spark, r)).collect()}
    assert pages(f"file://{tmp_path}/w") == pages(f"{tmp_path}/w")


def test_corpus_refresh(spark, tmp_path):
    root = tmp_path / "wiki"
    (root / "concepts").mkdir(parents=True)
    (root / "concepts" / "a.md").write_text("alpha beta")
    (root / "concepts" / "b.md").write_text("beta gamma")
    c = corpus.Corpus(spark, str(root))
    assert c.refresh() == {"changed": 2, "gone": 0}
    first = c.signature()
    assert c.refresh() == {"changed": 0, "gone": 0} and c.signature() == first
    (root / "concepts" / "a.md").unlink()
    (root / "concepts" / "b.md").write_text("delta delta!")
    assert c.refresh() == {"changed": 1, "gone": 1} and c.signature() != first
    assert {(r.page, r.term, r.tf) for r in c.postings.collect()} == {("concepts/b.md", "delta", 2), ("concepts/b.md", "b", 3)}
    assert wiki.list_tree(spark, str(tmp_path / "none")).count() == 0
