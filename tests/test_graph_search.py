"""Bridges, cut vertices, ranked retrieval and set joins against brute force."""

import random
import threading
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import biconnect, checks, community, graph, resolve, search
from lorekeep.plans import adapters, ranks
from lorekeep.plans.ranks import ranked


def pieces(nodes, edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out, seen = [], set()
    for x in nodes:
        if x in seen:
            continue
        todo, own = [x], {x}
        while todo:
            for y in near[todo.pop()] - own:
                own.add(y)
                todo.append(y)
        seen |= own
        out.append(own)
    return out


def brute_fragile(edges):
    edges = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
    nodes = {x for e in edges for x in e}
    out = set()
    for own in pieces(nodes, edges):
        inner = {e for e in edges if e[0] in own}
        for e in inner:
            parts = sorted(map(len, pieces(own, inner - {e})))
            if len(parts) > 1 and parts[-2] >= 2:
                out.add(("bridge", *e, parts[-2]))
        for v in own:
            parts = sorted(map(len, pieces(own - {v}, {e for e in inner if v not in e})))
            if len(parts) > 1 and parts[-2] >= 2:
                out.add(("cut_vertex", v, None, parts[-2]))
    return out


def shapes():
    rng = random.Random(7)
    name = lambda k: f"n{k:03}"
    rows = []
    for k in range(5):  # sparse random graphs, side by side in one table
        n = 14
        rows += [(name(100 * k + rng.randrange(n)), name(100 * k + rng.randrange(n))) for _ in range(16)]
    rows += [(f"p{k:02}", f"p{k + 1:02}") for k in range(40)] + [("hub", f"h{k}") for k in range(12)] + [("h3", "h4"), ("h5", "x1"), ("x1", "x2")]
    rows += [(f"c{k}", f"c{(k + 1) % 9}") for k in range(9)] + [("c0", "d0"), ("d0", "d1"), ("d1", "d2"), ("d2", "d0"), ("c4", "e0"), ("e0", "e1")]
    for c in "ABC":  # cliques in a chain
        rows += [(f"{c}{i}", f"{c}{j}") for i in range(4) for j in range(i)]
    return [*rows, ("A0", "B0"), ("B1", "C1"), ("A0", "A0"), ("B0", "A0")]


def test_fragile_places_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(biconnect, "BLOCK", 4)  # several levels of blocks
    rows = shapes()
    edges = spark.createDataFrame(rows, "source string, target string").withColumn("resolved", F.lit(True))
    got = [tuple(r) for r in graph.fragile_places(edges).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_fragile(rows)


def test_biconnected_parts(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3), (4, 3)], "a long, b long")
    tree = biconnect.tree_edges(edges).collect()
    parts = defaultdict(set)
    for r in tree:
        parts[r.part] |= {r.id, r.parent}
    assert sorted(map(sorted, parts.values())) == [[0, 1, 2], [2, 3], [3, 4, 5]] and {r.whole for r in tree} == {6}
    assert {frozenset((r.id, r.parent)) for r in tree if r.bridge} == {frozenset((2, 3))}
    none = biconnect.tree_edges(spark.createDataFrame([(1, 1)], "a long, b long"))
    assert none.count() == 0


def test_stars_are_contracted_at_once(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(biconnect, "materialize", lambda df, label="step", real=biconnect.materialize: rounds.append(label) or real(df, label))
    rows = [(k % 4, 10 + k) for k in range(200)] + [(0, 1), (1, 2), (2, 3), (3, 0)] + [(300 + k, 301 + k) for k in range(100)]
    forest = biconnect.spanning_forest(spark.createDataFrame(rows, "a long, b long")).collect()
    assert rounds.count("hooks") <= 8  # a leaf a round before
    nodes = {x for r in rows for x in r}
    assert len(forest) == len(nodes) - 2 and {(r.a, r.b) for r in forest} <= {tuple(sorted(r)) for r in rows}
    assert sorted(map(len, pieces(nodes, [(r.a, r.b) for r in forest]))) == [101, 204] and len({r.hooked for r in forest}) == len(forest)


def test_list_ranks_and_ranked(spark):
    cells = spark.createDataFrame([(i, i + 1 if i % 100 != 99 else None) for i in range(250)] + [(500, 0)], "id long, next long")
    got = {r.id: (r.last, r.dist) for r in biconnect.list_ranks(cells.where("id <> 249").unionByName(spark.createDataFrame([(249, None)], "id long, next long"))).collect()}
    assert got[0] == (99, 99) and got[500] == (99, 100) and got[99] == (99, 0) and got[200] == (249, 49) and len(got) == 251
    xs = random.Random(1).sample(range(10_000), 500)
    got = ranked(spark.createDataFrame([(x,) for x in xs], "x int").repartition(5), F.desc("x")).collect()
    assert sorted((r["rank"], r.x) for r in got) == list(enumerate(sorted(xs, reverse=True)))


def corpus(spark, n=300):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    docs = [(f"p{i:03}", f"title {rng.choice(words)}", " ".join(rng.choices(words, weights, k=rng.randrange(3, 60))), []) for i in range(n)]
    docs += [(f"q{i}", "same", "w100 w101 w0 w0", []) for i in range(15)]  # ties
    queries = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(40)] + [(90, "w100 w101"), (91, "nowhere"), (92, ""), (93, " ".join(words))]
    return spark.createDataFrame(docs, "page string, title string, body string, aliases array<string>"), spark.createDataFrame(queries, "qid int, query string")


@pytest.mark.parametrize("k, first", [(1, 1), (3, 64), (10, 1), (400, 64)])
def test_best_pages_are_those_of_whole_scores(spark, monkeypatch, k, first):
    monkeypatch.setattr(search, "FIRST_LOOK", first)
    docs, queries = corpus(spark)
    index, terms = search.stored_index(docs), search.query_terms(queries)
    prior = docs.select("page", (F.length("body") % 5).cast("long").alias("n")).where("n <> 1")
    for p in (None, prior):
        want = search.top_k(search.scores(*index, terms, p), k).collect()
        assert sorted(map(tuple, search.best_pages(*index, terms, k, p).collect())) == sorted(map(tuple, want)) and want


def test_search_of_one_query(spark):
    docs, _ = corpus(spark, 30)
    rows = search.search(docs.withColumn("type", F.lit("t")), "w100 w101", 4).collect()
    assert [r["rank"] for r in rows] == [1, 2, 3, 4] and [r.page for r in rows] == ["q0", "q1", "q10", "q11"]
    assert search.search(docs.withColumn("type", F.lit("t")), "?!", 4).count() == 0


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_similar_sets_against_brute_force(spark, least):
    rng = random.Random(11)
    some = lambda: sorted({rng.choice(["part", "the", "of", *map(str, range(25))]) for _ in range(rng.randrange(0, 7))})
    left, right = [(f"l{i}", some()) for i in range(80)], [(f"r{i}", some()) for i in range(120)]
    want = {}
    for l, a in left:
        for r, b in right:
            n = len(set(a) & set(b))
            if n and n / len(set(a) | set(b)) >= least:
                want[l, r] = n / len(set(a) | set(b))
    got = search.similar_sets(spark.createDataFrame(left, "l string, a array<string>"), spark.createDataFrame(right, "r string, a array<string>"), least).collect()
    assert len(got) == len(want) and {(x.l, x.r): x.similarity for x in got} == want


def louvain(edges):
    """The plain ordered form: nodes move, lowest first, to the neighbouring community of greatest gain; communities become nodes; until modularity stays."""
    nodes = sorted({x for e in edges for x in e})
    m = len(edges)
    links = {x: defaultdict(float) for x in nodes}
    for a, b in edges:
        links[a][b] += 1.0
        links[b][a] += 1.0
    loops = dict.fromkeys(nodes, 0.0)
    result, best = {x: x for x in nodes}, -1.0
    while True:
        order = sorted(links)
        of, deg = {x: x for x in order}, {x: sum(links[x].values()) + 2 * loops[x] for x in order}
        tot, moved = dict(deg), True
        while moved:
            moved = False
            for x in order:
                near: dict = defaultdict(float)
                for y, w in links[x].items():
                    near[of[y]] += w
                home = of[x]
                tot[home] -= deg[x]
                score = lambda c: near.get(c, 0.0) - tot[c] * deg[x] / (2 * m)  # noqa: B023, E731
                top = max(sorted(near), key=score, default=home)
                if top != home and score(top) > score(home) + 1e-12:
                    of[x], moved = top, True
                tot[of[x]] += deg[x]
        result = {x: of[c] for x, c in result.items()}
        value = quality(edges, result)
        if value - best < 1e-7:
            return result
        best = value
        merged, inner = defaultdict(lambda: defaultdict(float)), defaultdict(float)
        for x in order:
            inner[of[x]] += loops[x]
            merged[of[x]]  # noqa: B018
            for y, w in links[x].items():
                if of[x] == of[y]:
                    inner[of[x]] += w / 2
                else:
                    merged[of[x]][of[y]] += w
        links, loops = merged, inner


def quality(edges, of):
    m = len(edges)
    inner, tot = defaultdict(int), defaultdict(int)
    for a, b in edges:
        inner[of[a]] += of[a] == of[b]
        tot[of[a]] += 1
        tot[of[b]] += 1
    return sum(inner[c] / m - (tot[c] / (2 * m)) ** 2 for c in tot)


def clique(name, n):
    return [(f"{name}{i}", f"{name}{j}") for i in range(n) for j in range(i)]


SMALL = {
    "two cliques and a bridge": [*clique("a", 4), *clique("b", 4), ("a0", "b0")],
    "three cliques in a chain": [*clique("a", 5), *clique("b", 5), *clique("c", 5), ("a0", "b0"), ("b1", "c0")],
    "a ring of cliques": [e for k in range(6) for e in [*clique(f"{k}x", 4), (f"{k}x0", f"{(k + 1) % 6}x1")]],
    "apart": [*clique("a", 3), *clique("b", 3), *clique("c", 2)],
    "star": [("hub", f"l{i}") for i in range(12)],
    "path": [(f"p{i:02}", f"p{i + 1:02}") for i in range(9)],
    "star of stars": [(f"h{k}", f"h{k}l{i}") for k in range(4) for i in range(6)] + [("h0", "h1"), ("h1", "h2"), ("h2", "h3")],
}


def test_communities_are_as_good_as_ordered_moves(spark):
    """Each small graph alone, as the total number of links counts: a partition, numbered by least member, of no less modularity."""
    for what, rows in SMALL.items():
        edges = spark.createDataFrame(rows, "source string, target string").withColumn("resolved", F.lit(True))
        nodes = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().unionByName(spark.createDataFrame([("zz",)], "id string"))
        com = graph.communities(nodes, edges)
        got = {r.id: r.community for r in com.collect()}
        assert set(got) == {x for e in rows for x in e} | {"zz"}
        firsts: dict = {}
        for x in sorted(got):
            firsts.setdefault(got[x], len(firsts))
        assert all(c == k for c, k in firsts.items())
        own, ordered = quality(rows, got), quality(rows, louvain(rows))
        assert own >= ordered - 1e-9, (what, own, ordered)
        told = graph.community_quality(edges, com).first()
        assert told.links == len(rows) and abs(told.modularity - own) < 1e-9


def test_running_sums_across_ranges(spark):
    rng = random.Random(5)
    rows = [(k, n, rng.randrange(5)) for k in (1, 1, 2, 7) for n in range(150)]
    rows = [(k, 1000 * i + n, v) for i, (k, n, v) in enumerate(rows)]
    got = ranks.running(spark.createDataFrame(rows, "k long, n long, v long").repartition(6), "k", [F.desc("n")], "v", "s").collect()
    assert {(r.k, r.n): r.s for r in got} == {(k, n): sum(v for kk, nn, v in rows if kk == k and nn > n) for k, n, _ in rows}


def test_pages_that_name_missing_entities(spark):
    edges = spark.createDataFrame([("a", "x", False), ("b", "x", False), ("c", "y", False), ("a", "b", True)], "source string, target string, resolved boolean")
    nodes = spark.createDataFrame([("a", "p/a.md"), ("a", "q/a.md"), ("b", "p/b.md"), ("c", "p/c.md")], "id string, path string")
    got = sorted(map(tuple, checks.missing_entity_pages(edges, nodes).collect()))
    assert got == [("x", 2, "p/a.md"), ("x", 2, "p/b.md"), ("x", 2, "q/a.md")]  # one source of two pages counts once, both pages are told


def test_links_without_a_page_do_not_meet_in_one_task(spark):
    """Unknown stems keep places of their own in both probes."""
    links = spark.createDataFrame([(f"gone-{k}",) for k in range(50)] + [("here",), ("He_re",), ("\x00odd",)], "stem string")
    keys = spark.createDataFrame([("here", "here.md"), ("he-re", "here.md"), ("\x00odd", "odd.md")], "key string, owner string")
    out = resolve.resolve(links, keys, fold=T.fold_ascii)
    assert {r.stem: r.owner for r in out.where("owner is not null").collect()} == {"here": "here.md", "He_re": "here.md", "\x00odd": "odd.md"}
    assert out.count() == 53
    texts = [("a.md", "[[b]] [[gone]] [[B]] [[index]]"), ("b.md", ""), ("index.md", "")]
    pages = spark.createDataFrame([(p, t, p == "index.md", []) for p, t in texts], "path string, body string, is_config boolean, aliases array<string>").withColumn("stem", T.link_stem("path"))
    rows = graph.resolved_links(pages, T.fold_ascii).select("pos", "stem", "owner", "to_config", "target").collect()
    assert sorted(map(tuple, rows)) == [(0, "b", "b.md", False, "b"), (1, "gone", None, False, "gone"), (2, "b", "b.md", False, "b"), (3, "index", "index.md", True, "index")]


def test_terms_without_postings_and_places_down_to_a_page(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(40)]
    rows = [(f"p{k}", " ".join(rng.choices(words, range(1, 41), k=rng.randrange(30))), rng.choice(words), [rng.choice(words)]) for k in range(150)]
    rows += [("p3", "w1 w1 extra", "w2", ["w1"]), ("p4", "", "", None)]  # a page of two rows, and one more row without a term
    docs = spark.createDataFrame(rows, "page string, body string, title string, aliases array<string>")
    want = {r.term: r["count"] for r in search.postings(docs).groupBy("term").count().collect()}
    assert {r.term: r.df for r in search.term_counts(docs).collect()} == want
    one = docs.dropDuplicates(["page"])
    terms = search.query_terms(spark.createDataFrame([("q", "w1 w7 w30 gone"), ("r", "w2")], "qid string, query string"))
    plain = sorted(map(tuple, search.scores(*search.stored_index(one), terms).collect()))
    assert sorted(map(tuple, search.scores(*search.index_of_terms(one, terms), terms).collect())) == plain and plain
    asked = one.where("page like 'p%0'")
    golden = asked.select(F.col("page").alias("qid"), F.col("page").alias("primary"), F.array("page").alias("relevant"))
    titles, index = search.query_terms(asked, "page", "title"), search.stored_index(one)
    full = search.top_k(search.scores(*index, titles), 10)
    told = search.best_pages(*index, titles, 10, down_to=golden.select("qid", F.col("primary").alias("page")))
    place = lambda r: {(x.qid, x.rank) for x in r.where("qid = page").collect()}
    assert place(told) == place(full) and search.quality(told, golden).collect() == search.quality(full, golden).collect()


def test_lint_writes_its_links_once_and_runs_its_rounds_side_by_side(spark, monkeypatch):
    seen, threads = {}, {}

    def watched(name):
        real = getattr(graph, name)

        def call(*tables):
            seen[name], threads[name] = tables[-1], threading.get_ident()
            return real(*tables)

        monkeypatch.setattr(graph, name, call)

    watched("communities"), watched("fragile_places")
    body = {"a": "[[b]] [[c]] [[ghost]]", "b": "[[c]] [[ghost]]", "c": "[[d]]", "d": "[[e]]", "e": "[[f]]", "f": "[[d]]"}
    rows = spark.createDataFrame([(f"entities/{k}.md", k.upper(), "entity", [], [], t) for k, t in body.items()], "path string, title string, type string, aliases array<string>, sources array<string>, body string")
    pages = adapters.as_pages(rows)
    found = {(r.page, r.kind, r.detail) for r in checks.lint(pages, search.documents_of(pages)).collect()}
    assert {("entities/c.md", "lint.bridge_edge", "c - d"), ("entities/c.md", "lint.cut_vertex", "c"), ("entities/d.md", "lint.cut_vertex", "d"), ("", "lint.missing_entity", "ghost: 2 pages"), ("entities/a.md", "lint.orphan", "entity")} <= found
    for edges in seen.values():
        assert "Join" not in edges._jdf.queryExecution().optimizedPlan().toString()  # a written table, no resolution once more
    assert len({threading.get_ident(), *threads.values()}) == 3


def test_a_round_of_communities_writes_few_tables(spark, monkeypatch):
    made, real = [], community.materialize
    monkeypatch.setattr(community, "materialize", lambda df, label: made.append(label) or real(df, label))
    links = spark.createDataFrame([(6 * k + i, 6 * k + j) for k in range(8) for i in range(6) for j in range(i)] + [(6 * k, 6 * k + 7) for k in range(7)], "a long, b long")
    got = {r.id: r.community for r in community.communities(links).collect()}
    assert got == {n: n - n % 6 for n in range(48)}
    assert made.count("picks") > 1 and len(made) <= 4 * made.count("picks") + 3


def test_best_pages_leave_their_tiles_alone(spark, monkeypatch):
    monkeypatch.setattr(search, "TILE_POSTINGS", 100)
    monkeypatch.setattr(search, "BLOCK_TERMS", 8)
    docs, queries = corpus(spark, 300)
    docs = docs.unionByName(docs.where("page like 'p%7'").withColumn("body", F.concat("body", F.lit(" w1 w2 more words"))))  # pages of two lengths
    terms = search.query_terms(queries.unionByName(spark.createDataFrame([(None, "w2 w3")], "qid int, query string")))
    rows = {}
    real = search.materialize

    def counted(df, label="step"):
        out = real(df, label)
        rows.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(search, "materialize", counted)
    whole, index = search.stored_index(docs), search.stored_index(docs, terms)
    asked = {r.term for r in terms.select("term").distinct().collect()}
    assert {r.term for r in index[0].select("term").distinct().collect()} <= asked and sorted(map(tuple, index[1].collect())) == sorted(map(tuple, whole[1].collect()))
    assert sorted(map(tuple, index[0].collect())) == sorted(map(tuple, whole[0].where(F.col("term").isin(*asked)).select(*index[0].columns).collect()))
    want = search.top_k(search.scores(*whole, terms), 2).collect()
    rows.clear()
    assert sorted(map(str, search.best_pages(*index, terms, 2).collect())) == sorted(map(str, want)) and want
    pairs, tiles = search.scores(*whole, terms).count(), -(-rows["gains"][0] // 100)
    assert max(rows["found"]) <= terms.select("qid").distinct().count() * max(tiles, spark.sparkContext.defaultParallelism) * 2
    assert not {"held", "part", "could"} & set(rows) and pairs > max(n for label, sizes in rows.items() if label != "gains" for n in sizes)


def test_slug_collisions_list_every_pair(spark, monkeypatch):
    monkeypatch.setattr(resolve, "SLUG_BLOCK", 3)
    paths = [f"raw/{k}/report.md" for k in range(11)] + ["raw/a b.md", "raw/a-b.md", "raw/x/a?b.md", "raw/lone.md"]
    raw = spark.createDataFrame([(p,) for p in [*paths, paths[0]]], "path string")
    groups = [("report", paths[:11]), ("a-b", paths[11:14])]
    want = sorted((s, x, y) for s, g in groups for x in g for y in g if x != y)
    assert sorted(map(tuple, resolve.slug_collisions(raw).select("slug", "path", "other").collect())) == want
    owners = spark.createDataFrame([("report", paths[4]), ("a-b", "raw/lone.md")], "slug string, path string")
    assert sorted(map(tuple, resolve.slug_collisions(raw, owners).collect())) == [x for x in want if x[1] != paths[4]]


def test_lint_numbers_its_links_once(spark, monkeypatch):
    made, real = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label="step": made.append(label) or real(df, label))
    body = {"a": "[[b]] [[c]] [[ghost]]", "b": "[[c]] [[ghost]]", "c": "[[d]]", "d": "[[e]]", "e": "[[f]]", "f": "[[d]]", "g": "[[h]] [[h|twice]]", "h": "<!-- [[a]] -->\n[[g.md]] [[ | ]]"}
    rows = spark.createDataFrame([(f"entities/{k}.md", k.upper(), "entity", [], [], t) for k, t in body.items()], "path string, title string, type string, aliases array<string>, sources array<string>, body string")
    pages = adapters.as_pages(rows)
    found = {(r.page, r.kind, r.detail) for r in checks.lint(pages, search.documents_of(pages)).collect()}
    assert made.count("pairs") == 1 and made.count("numbered") == 1 and made.count("crossing") == 1
    assert {("entities/g.md", "lint.isolated_community", "one of 2"), ("", "lint.missing_entity", "ghost: 2 pages"), ("entities/a.md", "lint.broken_link", "ghost"), ("entities/c.md", "lint.thin_intercommunity_link", "c - d")} <= found
    links = resolve.page_links(pages)
    assert sorted((r.source, r.pos, r.raw, r.stem) for r in links.where("path >= 'entities/g'").collect()) == [("g", 0, "h", "h"), ("g", 1, "h|twice", "h"), ("h", 0, "g.md", "g")]
    assert links._jdf.queryExecution().optimizedPlan().toString().count(r"\.md$") == 2  # of the page and of the link, each computed once
    nodes, edges = graph.graph_nodes(pages), graph.graph_edges(pages)
    plain = sorted(map(tuple, graph.degrees(nodes, edges).collect()))
    graph.numbered(edges)
    assert sorted(map(tuple, graph.degrees(nodes, edges).collect())) == plain and plain
