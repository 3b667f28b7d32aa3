"""Indexes as tables of lines against rules applied to whole texts."""

import random
import re

from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import index, maintain
from lorekeep.plans import ranks

COMMENT = re.compile(r"(?<![^\r\n])[ \t]*<!--(?:(?!<!--|-->).)*?-->[ \t]*(?![^\r\n])", re.DOTALL)


def made(seed, n):
    rng = random.Random(seed)
    part = lambda: rng.choice(["<!--", "-->", " <!-- ", " --> ", "[a](x.md)", "[b](y.md)", "[c](https://e.x)", "text", "", "  ", "<!-- [d](z.md) -->"])
    return "\n".join("".join(part() for _ in range(rng.randrange(4))) for _ in range(n))


def test_comments_links_and_pruning(spark):
    texts = [(k, made(k, k % 30)) for k in range(120)] + [(500, "<!--\n[a](x.md)\n-->\n[b](y.md)"), (501, "<!-- open\n[a](x.md)"), (502, "")]
    lines = index.lines_of(spark.createDataFrame(texts, "k long, text string"), "k").repartition(7)
    hidden = {(r.key, r.line) for r in index.comment_lines(lines).collect()}
    found = {(r.key, r.target) for r in index.targets(lines).collect()}
    taken = {(r.key, r.line) for r in index.dangling_lines(lines, spark.createDataFrame([(k, "x.md") for k, _ in texts], "key long, target string")).collect()}
    links = lambda x: {t for t in re.findall(r"\[[^\[\]]*\]\(([^()]*)\)", x) if "://" not in t}
    for k, text in texts:
        rows, inside, gone = text.split("\n"), set(), False
        for m in COMMENT.finditer(text):
            inside |= set(range(text[: m.start()].count("\n"), text[: m.end()].count("\n") + 1))
        assert {n for kk, n in hidden if kk == k} == inside, (k, text)
        assert {t for kk, t in found if kk == k} == {t for n, x in enumerate(rows) if n not in inside for t in links(x)}
        want, open_ = set(), False
        for n, x in enumerate(rows):
            marks = re.findall("<!--|-->", x)
            touched = open_ or bool(marks)
            open_ = marks[-1] == "<!--" if marks else open_
            if n not in inside and not touched and links(x) == {"x.md"}:
                want.add(n)
        assert {n for kk, n in taken if kk == k} == want, (k, text)


def test_long_targets_and_comments(spark):
    text = f"[a]({'x' * 200_000}(y){'-' * 1000}.md)\n<!-- {'-' * 100_000} <{'b' * 100_000} -->\n[b](q(r.md) [c](s.md)"
    assert {r.target[:4] for r in index.targets(index.lines_of(spark.createDataFrame([(text,)], "text string"), F.lit("i"))).collect()} == {"xxxx", "s.md"}
    assert len(spark.createDataFrame([(text,)], "t string").select(T.strip_comments("t").alias("x")).first().x) == len(text)


def test_splicing_equals_that_of_one_text(spark):
    text = "# I\n\n## A\n- [x](x.md)\n\n## B\n- [gone](g.md)\n<!-- [gone](g.md) -->\n\ntail\n## A\n- [late](l.md)\n"
    plan = [("A", "a2", "- [y](y.md)"), ("A", "a1", "- [w](w.md)"), ("C", "c1", "- [z](z.md)"), ("C", "c0", "- [u](u.md)"), ("B", "b", "- [v](v.md)")]
    lines = index.lines_of(spark.createDataFrame([(text,)], "text string"), F.lit("i"))
    left = index.pruned(lines, spark.createDataFrame([("i", "g.md")], "key string, target string"))
    out = index.inserted(left, spark.createDataFrame([("i", *p) for p in plan], "key string, section string, path string, x string"))
    got = "".join(r.x + "\n" for r in out.orderBy("line", "sub").collect())
    assert got == maintain.spliced_index(text, [(s, x) for s, _, x in sorted(plan, key=lambda p: (p[0], p[1]))], {"g.md"})
    assert index.inserted(lines.limit(0), spark.createDataFrame([("i", "N", "n", "- [n](n.md)")], "key string, section string, path string, x string")).count() == 4


def test_carried_across_ranges(spark):
    rng = random.Random(3)
    rows = [(k, n, rng.choice([None, None, None, n])) for k in range(3) for n in range(200)] + [(9, 0, 7)]
    df = spark.createDataFrame(rows, "k long, n long, v long").repartition(5)
    for down in (False, True):
        got = {(r.k, r.n): r.c for r in ranks.carried(df, ["k"], ["n"], "v", "c", descending=down).collect()}
        for k, n, _ in rows:
            near = [v for kk, m, v in rows if kk == k and v is not None and (m > n if down else m < n)]
            assert got[k, n] == ((near[0] if down else near[-1]) if near else None)


def test_pruning_moves_no_text(spark, monkeypatch):
    moved = []
    monkeypatch.setattr(index, "carried", lambda rows, *a, real=index.carried, **k: moved.append(rows.columns) or real(rows, *a, **k))
    x = ["- [a](a.md)", "- [b](b.md)", "<!-- [a](a.md) -->", "- [a](a.md) [b](b.md)", "none", "x <!-- [a](a.md)", "- [a](a.md)"]
    lines = spark.createDataFrame([("k", n, t) for n, t in enumerate(x)], "key string, line int, x string")
    gone = index.dangling_lines(lines, spark.createDataFrame([("k", "a.md")], "key string, target string"))
    assert sorted(r.line for r in gone.collect()) == [0] and not any("x" in columns for columns in moved)
