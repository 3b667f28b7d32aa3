"""Text functions, pages, resolution, graph, retrieval, reports and maintenance on small fixtures."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import checks, graph, maintain, resolve, search, sessions
from lorekeep.plans.components import connected_components
from lorekeep.sources import wiki


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("text, tokens", [
    ("去中心化", ["去中", "中心", "心化"]), ("李", ["李"]), ("DeFi GPT-4", ["defi", "gpt", "4"]), ("L2 扩容", ["l2", "扩容"]), ("café", ["caf"]),
    ("ＡＢ。", []), ("一豈", ["一豈"]), ("", [])])
def test_tokenize(spark, text, tokens):
    assert one(spark, T.tokenize("t"), t=text) == tokens


@pytest.mark.parametrize("raw, stem", [("Foo|x", "foo"), ("Foo#s", "foo"), ("dir/Foo.md", "foo"), ("FOO", "foo"), ("a\\B.MD", "b"), ("|x", ""), ("#a", "")])
def test_link_stem(spark, raw, stem):
    assert one(spark, T.link_stem("t"), t=raw) == stem


def test_fold_digest_slug_paths(spark):
    assert one(spark, T.fold_stem("t"), t="ＡＢＣ_d") == "abc-d"
    assert one(spark, T.raw_slug("t"), t="--中 文 a.b--") == "中-文-a.b"
    d = one(spark, T.parse_digest("t"), t="raw/a@sha256:x@sha256:" + "0" * 64)
    assert d["path"] == "raw/a@sha256:x" and one(spark, T.parse_digest("t"), t="raw/a@sha256:XYZ") is None
    assert one(spark, T.normal_path("t"), t="a/./b/../c") == "a/c"
    assert one(spark, T.inside("t"), t="../x") is False and one(spark, T.inside("t", "raw"), t="raw/x/../y.md") is True
    assert one(spark, T.split_lines("t"), t="a\r\nb\rc\n") == ["a", "b", "c"]


def test_comments_and_index_links(spark):
    body = "<!-- [[a]] -->\nx <!-- [[b]] -->\n<!--\n[[c]]\n-->\n<!-- [[d]]"
    assert one(spark, T.wikilinks(T.strip_comments("t")), t=body) == ["b", "d"]
    text = "[a](./x/a.md#top) [b](https://e.x/b.md) [c](mailto:q) [d](p(1).md)\n<!-- [e](e.md) -->"
    assert one(spark, T.index_links("t"), t=text) == ["x/a.md", "p(1).md"]


def test_snippet_and_substance(spark):
    assert one(spark, T.snippet("t", F.array(F.lit("ai"))), t="He said  no. AI is here") == "AI is here"
    assert one(spark, T.substantive_chars("t"), t="# head\n\nab c\n") == 3


@pytest.fixture
def base(tmp_path):
    root = tmp_path / "kb"
    wiki.init_base(str(root))

    def page(path, front, body):
        p = root / "wiki" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"---\n{front}---\n{body}" if front is not None else body, encoding="utf-8")

    meta = "title: {0}\ntype: {1}\ntags: []\nsources: []\nlast_updated: 2024-01-02\n"
    page("entities/multi-head.md", meta.format("Multi", "entity") + "aliases: [MHA]\n", "See [[foo_bar]] and [[index]] and [[gone]]. " + "x" * 40)
    page("concepts/foo_bar.md", meta.format("Foo", "concept"), "See [[multi_head]], [[mha]], [[gone]] " + "y" * 40)
    page("concepts/_hidden page.md", meta.format("Hidden", "entity"), "[[foo-bar]]")
    page("empty.md", None, "")
    page("sources/s.md", "title: [1]\ntype: source\n", "z" * 50)
    return root


def test_pages_graph_and_reports(spark, base):
    pages = wiki.parse_pages(wiki.page_files(spark, str(base / "wiki"))).cache()
    assert {r.path for r in pages.collect()} == {"index.md", "log.md", "overview.md", "entities/multi-head.md", "concepts/foo_bar.md", "concepts/_hidden page.md", "empty.md", "sources/s.md"}
    edges = {(r.source, r.target, r.resolved) for r in graph.graph_edges(pages).collect()}
    assert edges == {
        ("multi-head", "foo_bar", True), ("multi-head", "gone", False), ("foo_bar", "multi-head", True), ("foo_bar", "gone", False), ("_hidden page", "foo_bar", True)}
    found = {(r.page, r.kind, r.detail) for r in checks.check(pages).collect()}
    assert ("empty.md", "frontmatter.block_missing", "the page has no usable frontmatter") in found
    assert {d for p, k, d in found if p == "sources/s.md" and k == "frontmatter.missing_key"} == {"tags", "sources", "last_updated"}
    assert ("sources/s.md", "frontmatter.bad_type", "title") in found
    assert {(p, d) for p, k, d in found if k == "wikilink.broken"} == {(f"{s}", "gone") for s in ("entities/multi-head.md", "concepts/foo_bar.md")}
    index = pages.where("path = 'index.md'").select("text")
    health = {(r.page, r.kind) for r in checks.health(pages, index).collect()}
    assert {("empty.md", "health.stub_page"), ("empty.md", "health.uncharted_page"), ("concepts/_hidden page.md", "health.type_dir_mismatch")} <= health
    lint = [(r.kind, r.detail) for r in checks.lint(pages, search.documents_of(pages)).collect()]
    assert ("lint.missing_entity", "gone: 2 pages") in lint
    hits = search.search(search.documents_of(pages), "mha").collect()
    assert [h.page for h in hits][0] in ("entities/multi-head.md", "concepts/foo_bar.md")
    assert search.search(search.documents_of(pages), "!!").count() == 0


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, True) for a, b in pairs] or [("x", "x", True)], "source string, target string, resolved boolean")


def nodes_of(spark, ids):
    return spark.createDataFrame([(i, i, "entity", f"entities/{i}.md") for i in ids], "id string, title string, type string, path string")


def test_cliques_thin_links_and_fragile_places(spark):
    a, b = [f"a{i}" for i in range(4)], [f"b{i}" for i in range(4)]
    edges = edges_of(spark, [*itertools.permutations(a, 2), *itertools.permutations(b, 2), ("a0", "b0")])
    nodes = nodes_of(spark, a + b + ["z"])
    com = graph.communities(nodes, edges)
    groups = {r.id: r.community for r in com.collect()}
    assert len({groups[x] for x in a}) == len({groups[x] for x in b}) == 1 and groups["a0"] == 0 and groups["b0"] == 1 and groups["z"] == 2
    assert [(r.u, r.v) for r in graph.thin_links(edges, com).collect()] == [("a0", "b0")]
    found = {(r.kind, r.u, r.v) for r in graph.fragile_places(edges).collect()}
    assert found == {("bridge", "a0", "b0"), ("cut_vertex", "a0", None), ("cut_vertex", "b0", None)}


def test_path_star_cycle(spark):
    frag = lambda pairs: {(r.kind, r.u, r.v) for r in graph.fragile_places(edges_of(spark, pairs)).collect()}
    assert {x for x in frag([("a", "b"), ("b", "c"), ("c", "d")]) if x[0] == "bridge"} == {("bridge", "b", "c")}
    assert frag([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")]) == set()
    leaves = [f"l{i}" for i in range(8)]
    star = edges_of(spark, [("hub", x) for x in leaves])
    assert [(r.id, r.degree) for r in graph.hub_nodes(nodes_of(spark, ["hub", *leaves]), star).collect()] == [("hub", 8)]
    assert frag([("hub", x) for x in leaves]) == set()


def test_components_against_brute_force(spark):
    import random

    random.seed(4)
    pairs = [(random.randrange(200), random.randrange(200)) for _ in range(150)]
    up = {x: x for p in pairs for x in p}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in pairs:
        p, q = sorted((top(x), top(y)))
        up[q] = p
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: top(x) for x in up}


def test_snapshots_gates_and_drift(spark):
    snap = lambda rows: spark.createDataFrame(rows, "path string, fp string")
    diff = {(r.path, r.change) for r in maintain.snapshot_diff(snap([("a", "1"), ("b", "1")]), snap([("b", "2"), ("c", "1")])).collect()}
    assert diff == {("a", "removed"), ("b", "modified"), ("c", "added")}
    meta = lambda rows: spark.createDataFrame(rows, "path string, sources array<string>, body_len long")
    before, after = meta([("p", ["b", "a"], 200), ("q", None, 199)]), meta([("p", [], 99), ("q", [], 1)])
    assert [r.detail for r in maintain.source_regressions(before, after).collect()] == ["a", "b"]
    assert [r.path for r in maintain.body_shrinks(before, after).collect()] == ["p"]
    log = "# Log\n"
    good = log + '## [2024-01-01] audit | x\n- {"page":"p","slugs":["s"],"verdict":"ok"}\n'
    assert [r.page for r in maintain.review_entries(log, good, spark).collect()] == ["p"]
    assert maintain.review_entries(log, good.replace('"p"', "1"), spark) is None and maintain.review_entries(log, "new", spark) is None
    assert maintain.spliced_index("# I\n\n## A\n- [x](x.md)\n\n## B\n- [gone](g.md)\n", [("A", "- [y](y.md)"), ("C", "- [z](z.md)")], {"g.md"}) == "# I\n\n## A\n- [x](x.md)\n- [y](y.md)\n\n## B\n\n## C\n\n- [z](z.md)\n"


def test_messages(spark):
    at = lambda s: (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)).to_pydatetime()
    rows = [(1, "s", at(0), "a"), (2, "s", at(0.5), "b"), (3, "s", at(5), "/help"), (4, "s", at(5.1), "c"), (5, "s", at(4000), "d")]
    msgs = spark.createDataFrame(rows, "msg_id long, session string, ts timestamp, text string")
    assert [r.text for r in sessions.debounce(msgs).orderBy("first_ts").collect()] == ["a\nb", "/help", "c", "d"]
    assert [r.state for r in sessions.session_states(msgs).orderBy("ts").collect()] == ["first", "existing", "existing", "existing", "expired"]
    again = spark.createDataFrame([("m", at(x)) for x in (0, 200, 299, 300, 500, 601)], "msg_id string, ts timestamp")
    assert [r.ts for r in sessions.dedup_messages(again).orderBy("ts").collect()] == [at(0), at(500)]


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout) > 50, out.stderr


def test_entry_query(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10


def test_normal_paths_against_a_plain_walk(spark):
    rng = random.Random(5)

    def walk(path):
        done = []
        for part in path.split("/"):
            if part == ".." and done and done[-1] != "..":
                done.pop()
            elif part not in ("", "."):
                done.append(part)
        return "/".join(done)

    paths = ["/".join(rng.choice(["..", "..", ".", "", "a", "b..", "..c", "...", "d e"]) for _ in range(rng.randrange(12))) for _ in range(600)]
    rows = spark.createDataFrame([(p,) for p in paths] + [(None,)], "p string").select("p", T.normal_path("p").alias("n"), T.inside("p").alias("i")).collect()
    assert {r.p: r.n for r in rows} == {p: walk(p) for p in paths} | {None: None}
    assert all(r.i == (r.n != "" and not r.p.startswith("/") and r.n.split("/")[0] != "..") for r in rows if r.p is not None)


def test_names_that_need_no_python_are_normal(spark):
    import re
    import unicodedata

    plain = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", T.PLAIN))
    fine = [chr(c) for c in range(0x11000) if not 0xD800 <= c < 0xE000 and plain.match(chr(c)) and chr(c) != "\n"]
    assert len(fine) > 20_000 and all(unicodedata.is_normalized("NFKC", a + b) for a in fine[:400] for b in fine) and "\u0301" not in fine
    names = ["a/b\u0301.md", "x/ﬁle", "“ü” — 中", "１", "e\u0301\u0300", "", None]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "x string").select(T.normalize_basename("x").alias("n")).collect()]
    assert got == ["b\u0301.md", "file", "ü - 中", "1", unicodedata.normalize("NFKC", "e\u0301\u0300"), "", None]
    targets = spark.createDataFrame([("a.MD",), ("b.pdf",), ("…",), (None,)], "x string").select(T.safe_raw_target("x").alias("t")).collect()
    assert [r.t and tuple(r.t) for r in targets][:3] == [("raw/a.md", None), (None, "suffix"), (None, "empty")]
