"""Names, uploads, tables, messages, redaction, write sets, drift, images and message streams against expectations worked out by hand."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import maintain, sessions
from lorekeep.sources import frontmatter as FM
from lorekeep.streaming import messages


def mapped(spark, function, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", function("x").alias("y"))
    return [r.y for r in sorted(rows.collect())]


def test_file_names(spark):
    names = ["“X”.md", "a—b.md", "ｘ．ＰＤＦ", " foo.MD ", "v1.2 notes", ".hidden", "notes.", "a/b/../c.md", "dir\\x.md", "《…》", "zero​width.md", "GPT-4.5 笔记", "/", "x.rtf", "deck.pptx", "`~`", None]
    assert mapped(spark, T.normalize_basename, names) == [
        "X.md", "a-b.md", "x.PDF", "foo.MD", "v1.2 notes", ".hidden", "notes.", "c.md", "dir\\x.md", "《...》", "zero width.md", "GPT-4.5 笔记", "", "x.rtf", "deck.pptx", "-", None]
    told = mapped(spark, T.safe_raw_target, names[:-1])
    assert [r.target for r in told] == [
        "raw/X.md", "raw/a-b.md", None, "raw/foo.md", "raw/v1.2-notes.md", "raw/hidden.md", "raw/notes.md", "raw/c.md", "raw/dir-x.md", None, "raw/zero-width.md", "raw/GPT-4.5-笔记.md", None, None,
        "raw/deck.pptx.md", None]
    assert [r.error for r in told if r.target is None] == ["suffix", "empty", "empty", "suffix", "empty"]


def test_uploads(spark):
    rows = [("a.SVG", b"<svg/>"), ("a.bmp", b"BM"), ("a.png", b"\x00"), ("a.bin", b"a \x00b"), ("a.bin", b"a\x00b"), ("a.txt", b"a\x00b"), ("a.py", b"\xff"), ("README", b"x"), ("a.bin", "é".encode()), ("x.", b"\x00")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, name string, content binary").select("i", T.upload_class("name", "content").alias("c"))
    assert [r.c for r in sorted(df.collect())] == ["text", "text", "image", "binary", "binary", "text", "binary", "text", "text", "text"]


def test_tables(spark):
    given = [
        '<table><colgroup><col span="2"></colgroup><tfoot><tr><td valign="TOP" align="middle" colspan="2a">x</td></tr></tfoot></table>', "<table><script>bad()</script><style>s</style><td>c<br>d &amp; e</td></table>",
        "<p>no table</p>", "<table><td><template><b>x</b></template>y<!-- z --></td>", '<table/><TABLE ROWSPAN="3">']
    assert mapped(spark, T.safe_table, given) == [
        '<table><colgroup><col></colgroup><tfoot><tr><td valign="TOP">x</td></tr></tfoot></table>', "<table><td>cd &amp; e</td></table>", None, "<table><td>y</td>", '<table><table rowspan="3">']


def test_messages_are_split_beside_fences():
    fenced = "before\n```flint\n{\"a\":1}\n```\nafter"
    assert T.message_parts(fenced, 2000, 5) == ([fenced], 0)
    assert T.message_parts("one two three\n```\nshort\n```\nend", 18, 9) == (["one two three", "```\nshort\n```\nend"], 0)
    assert T.message_parts("x" * 25, 10, 9) == (["x" * 10, "x" * 10, "x" * 5], 0)
    assert T.message_parts("\n".join("abcde" * 2 for _ in range(6)), 10, 4) == (["abcdeabcde"] * 3, 32)
    assert T.message_parts("aaaa\nbbbb", 5, 1) == (["aaaa"], 4) and T.message_parts("  \n ", 5, 1) == ([], 0) and T.message_parts(None, 5, 1) == ([], 0)
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a" * rng.randrange(1, 9), " ", "\n", "\n\n", "\n```\n", "~~~"]) for _ in range(rng.randrange(40)))
        parts, dropped = T.message_parts(text, 12, 3)
        assert len(parts) <= 3 and all(0 < len(p) <= 12 for p in parts) and (dropped == 0 or len(parts) == 2)
        everything, none = T.message_parts(text, 12, 10**6)
        assert none == 0 and "".join("".join(everything).split()) == "".join(text.split())
    with pytest.raises(ValueError):
        T.split_message(0, 1)


def test_redaction(spark):
    given = [
        "no /home/averyveryverylongname here", "GET https://Me:pw@Host.Example:8080/s/0123456789abcdef/mcp?token=x#y, failed", "(see ftp://a.b/short.)", "x://", "https://h:99999/p", "at wss://[::1]:0/a", "secret-1 secret-12 abc"]
    redact = lambda c: T.redact(c, ["secret-1", "secret-12", "abc", ""])
    assert mapped(spark, redact, given) == [
        "no /home/averyveryverylongname here", "GET https://host.example:8080/s/***/mcp, failed", "(see ftp://a.b/short.)", "x://", "***", "at wss://[::1]/a", "*** *** abc"]


def test_comments_keep_their_length(spark):
    text = "a\r\n  <!-- [[x]]\r\n y -->  \r\n[[b]] <!-- in line -->\n<!-- open"
    blank = "a\r\n" + " " * 12 + "\r\n" + " " * 8 + "\r\n[[b]] <!-- in line -->\n<!-- open"
    assert mapped(spark, T.strip_comments, [text, "plain", None]) == [blank, "plain", None]


def test_frontmatter_is_requoted_and_stamped(spark):
    pages = [
        '---\ntitle: "say "it\'s" now"\ntype: "fine"\n---\nb', '---\r\ntitle: "a\\b "c""  \r\n---\r\nb', '---\ntitle: "open\n---\nb', '---\ntitle: "a" # x"y\n---\nb', "---\ntitle: [x\n---\nb", "---\ntitle: fine\n---\nb", "none", None]
    assert mapped(spark, FM.repaired_page, pages) == ["---\ntitle: 'say \"it''s\" now'\ntype: \"fine\"\n---\nb", "---\r\ntitle: 'a\\b \"c\"'\r\n---\r\nb", None, None, None, None, None, None]
    given = ["text", "---\ntitle: t\n---\nb", "---\norigin: o\ntitle: t\n---\nb", "---\n- list\n---\nb", "---\na: [\n---\nb", "---\n---\nb", "---\nopen", None]
    stamped = mapped(spark, lambda c: FM.with_origin(c, F.lit("https://x: y #z")), given)
    line = "origin: 'https://x: y #z'\n"
    assert stamped == [f"---\n{line}---\ntext", f"---\ntitle: t\n{line}---\nb", given[2], None, None, f"---\n{line}---\nb", f"---\n{line}---\n---\nopen", None]


def test_commands(spark):
    given = ["/search x y", "@bot @me /NEW", "/unknown thing", "/help\nmore", "/page  a ", "  hi ", "/", "@bot"]
    got = [(r.kind, r.argument) for r in mapped(spark, T.command, given)]
    assert got == [("search", "x y"), ("new", ""), ("prose", "/unknown thing"), ("prose", "/help\nmore"), ("page", "a"), ("prose", "hi"), ("prose", "/"), ("prose", "")]


def test_write_set(spark):
    cols = "path string, fp string, aliases array<string>, rest string"
    before = [("entities/a.md", "1", ["x"], "r"), ("entities/b.md", "1", ["x"], "r"), ("entities/c.md", "1", None, "r"), ("sources/d.md", "1", [], "r"), ("entities/e.md", "1", [], "r"), ("index.md", "1", None, None), ("concepts/g.md", "1", [], "r"), ("entities/h.md", "1", ["x", "y"], "r")]
    after = [("entities/a.md", "2", ["x", "T#1"], "r"), ("entities/b.md", "2", ["x", "t", "u"], "r"), ("entities/c.md", "2", ["t"], "r"), ("sources/d.md", "2", ["t"], "r"), ("entities/e.md", "2", ["t"], "other"), ("index.md", "2", None, None), ("entities/f.md", "1", [], "r"),
             ("misc/f.md", "1", [], "r"), ("entities/h.md", "2", ["y", "x", "t"], "r")]
    sides = [spark.createDataFrame(x, cols) for x in (before, after)]
    targets = spark.createDataFrame([("t",)], "target string")
    said = {r.path: (r.change, r.expected) for r in maintain.heal_write_set(*sides, targets).collect()}
    assert said == {
        "entities/a.md": ("modified", True), "entities/b.md": ("modified", False), "entities/c.md": ("modified", False), "sources/d.md": ("modified", False), "entities/e.md": ("modified", False), "index.md": ("modified", True),
        "entities/f.md": ("added", True), "misc/f.md": ("added", False), "concepts/g.md": ("removed", False), "entities/h.md": ("modified", False)}
    assert not {r.path: r.expected for r in maintain.heal_write_set(*sides, targets, gate_ok=False).collect()}["entities/a.md"]


def test_drift_and_images(spark):
    drifted = spark.createDataFrame([("a", "sources/a.md", "raw/a"), ("b", "sources/b.md", "raw/b")], "slug string, page string, raw_path string")
    cites = spark.createDataFrame([("sources/a.md", ["b", "z"]), ("entities/e.md", ["b"]), ("entities/f.md", ["z"])], "path string, sources array<string>")
    assert {(r.page, r.reason, tuple(r.slugs)) for r in maintain.drift_candidates(drifted, cites).collect()} == {
        ("sources/a.md", "source-drift", ("a", "b")), ("sources/b.md", "source-drift", ("b",)), ("entities/e.md", "cites-drifted-source", ("b",))}
    refs = spark.createDataFrame([("x.md", r) for r in ("images/x/B.PNG", "images/x/a.png", "old/one.gif", "old/two.gif", "http://e/a.png", "gone.png", "images/y/c.png", "images/x/%61.png", "images/x/notes.md")], "page string, ref string")
    files = spark.createDataFrame([(p,) for p in ("images/x/a.png", "images/q/b.png", "images/q/One.gif", "images/q/two.gif", "images/r/TWO.gif", "images/y/c.png", "images/x/notes.md")], "path string")
    assert {r.ref: r.state for r in maintain.image_lint(refs, files).collect()} == {
        "images/x/B.PNG": "misplaced", "images/x/a.png": "ok", "old/one.gif": "misplaced", "old/two.gif": "dangling", "gone.png": "dangling", "images/y/c.png": "misplaced", "images/x/%61.png": "ok", "images/x/notes.md": "dangling"}


def at(s):
    return datetime(2024, 1, 1) + timedelta(seconds=s)


MESSAGES = [
    (1, "s", at(0), "one"), (2, "s", at(0.4), "/unknown thing"), (3, "s", at(0.8), "two"), (4, "s", at(1.2), "  "), (5, "s", at(3), "/help me"), (6, "s", at(3.1), " c "), (7, "s", at(60), "d"), (8, "s", at(200), "  "),
    (9, "t", at(0), "x" * 950), (10, "t", at(2.5), "y"), (11, "t", at(3.6), "z"), (12, "u", at(4000), "late")]
MERGED = [("s", "one\n/unknown thing\ntwo", 4), ("s", "/help me", 1), ("s", "c", 1), ("s", "d", 1), ("t", "x" * 950 + "\ny", 2), ("t", "z", 1), ("u", "late", 1)]


def test_debounce_in_batch_and_stream(spark, tmp_path):
    msgs = spark.createDataFrame(MESSAGES, "msg_id long, session string, ts timestamp, text string")
    assert sorted((r.session, r.text, r.n) for r in sessions.debounce(msgs).collect()) == sorted(MERGED)
    msgs.coalesce(1).write.parquet(f"{tmp_path}/m")
    # the watermark closes what is open: a far message of another session comes in a batch of its own
    spark.createDataFrame([(99, "end", at(10**6), "bye")], msgs.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/m")
    stream = spark.readStream.schema(msgs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/m")
    q = messages.debounce_stream(stream).writeStream.format("memory").queryName("merged").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert sorted((r.session, r.text, r.n) for r in spark.table("merged").collect() if r.session != "end") == sorted(MERGED)


def test_dedup_at_the_edge(spark):
    rows = [("m", at(x), x) for x in (0, 0, 200, 300, 301, 600, 602)] + [("n", at(1), 0), (None, at(1), 0), (None, at(2), 1)]
    msgs = spark.createDataFrame([(a, b, float(c)) for a, b, c in rows], "msg_id string, ts timestamp, v double")
    assert [r.v for r in sessions.dedup_messages(msgs).where("msg_id = 'm'").orderBy("ts").collect()] == [0.0, 301.0, 602.0]
    assert sessions.dedup_messages(msgs).count() == 5


def test_frontmatter_heads_are_those_of_python(spark):
    marks = ["---", " ---\t", "\u00a0---", "\u3000--- ", "----", "-- -", "a: 1", "x--- ", "", " ", "\u200b---"]
    breaks = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1e", "\x85", "\u2028", "\n\n"]
    rng = random.Random(5)
    pages = [None, "", "---", "---\n---", "---\r\n---\r\n\n", "---\n---\n---\n", "\n---\n---\n", "\ufeff---\na: 1\n---\n", "---\na: \U0001f600\n---\n\U0001f600b"]
    pages += ["".join(rng.choice(marks[:4] if rng.random() < 0.5 else marks) + rng.choice(breaks) for _ in range(rng.randrange(1, 7))) + rng.choice(["", "---", "end"]) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, t string")
    got = {r.i: r for r in rows.select("i", FM.head_of("t").alias("head"), FM.parse_page("t").alias("m")).collect()}
    for i, p in enumerate(pages):
        block, body = FM.split_block(p or "")
        assert got[i].head == (p or "")[: len(p or "") - len(body)] and (block is None) == (got[i].head == ""), repr(p)
        want = FM.describe(p)
        assert got[i].m.asDict() == want, repr(p)


def test_bodies_stay_out_of_python(spark):
    page = "---\ntitle: t\n---\n" + "b" * 100_000
    one = spark.createDataFrame([(page,), ("b" * 100_000,)], "t string")
    assert [r[0] for r in one.select(F.length(FM.head_of("t"))).collect()] == [17, 0]
    assert [len(r[0]) for r in one.select(FM.with_origin("t", F.lit("o"))).collect()] == [100_027, 100_018]
    assert [r[0] for r in one.select(FM.with_origin("t", F.lit(None).cast("string"))).collect()] == [page, "b" * 100_000]
    for made in (FM.parse_page("t"), FM.scan_page("t"), FM.repaired_page("t"), FM.with_origin("t", F.lit("o"))):
        plan = one.select(made.alias("m"))._jdf.queryExecution().optimizedPlan().toString()
        evaluated = [x for x in plan.splitlines() if "ArrowEvalPython" in x]
        assert len(evaluated) == 1 and evaluated[0].count("(regexp_extract(") == 1  # the page's head, once
