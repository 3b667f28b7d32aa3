"""Archives, nearest neighbours and the pipeline."""

import gzip
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lorekeep.llm import ann, neardup, tokens, warc
from lorekeep.plans.store import fresh_path


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_archives_round_trip(spark):
    big, tricky = "é" * 60_001, "WARC/1.1\r\n\r\n" * 200
    rows = [(1, "u", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", tricky), (8, "u", tricky), (9, "a b\r\nX: y", tricky + "1"), (9, "z", tricky + "1"), (None, "q", big)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, row int")
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive_round_trip(pages).collect()]
    n, m = 120_002, 2_400
    assert sorted(got, key=str) == sorted([
        (1, "revisit", 2, n), (2, "response", None, n), (3, "response", None, 5), (4, "response", None, 5), (5, "response", None, 0), (6, "response", None, 0),
        (7, "revisit", 8, m), (8, "response", None, m), (9, "response", None, m + 1), (9, "response", None, m + 1), (None, "response", None, n)], key=str)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_framing_and_parsing():
    for size in (0, 1, 5, 100):
        body = bytes(range(256))[:size] * 3
        assert warc.dechunked(warc.chunked(body, 7)) == body
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")
    record = warc._record([("WARC-Type", "response"), ("WARC-Record-ID", "<a>")], b"x\r\n\r\ny") + b"\r\n\r\n"
    for data in (record * 3, gzip.compress(record * 3), gzip.compress(record) * 3):
        assert [b for _, b in warc.parse_records(data)] == [b"x\r\n\r\ny"] * 3
    with pytest.raises(ValueError):
        list(warc.parse_records(record[:-8]))


def test_missing_segment_fails(spark):
    path = fresh_path(spark, "broken")
    first = warc._record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:lorekeep:page:1:0>"), ("WARC-Segment-Number", 1)], b"HTTP/1.1 200 OK\r\n\r\nab")
    spark.createDataFrame([(first.decode(),)], "value string").write.option("lineSep", warc.END).option("compression", "gzip").text(path)
    with pytest.raises(Exception, match="segments"):
        warc.read_warc(spark, path).count()


def test_neighbours_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    x[100:130] = x[100]  # equal vectors
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [None] + [1.0] * 15, 1), (9004, [float("nan")] * 16, 1), (9005, [float("inf")] * 16, 1), (9006, [1.0], 1), (None, x[0].tolist(), 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got: dict = {}
    for r in ann.nearest(table, table.where("vec_id % 20 = 0").select("vec_id"), leaf=256, rounds=6, k=32).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20)) and all(len(v) == 20 for v in got.values())
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        order = sorted((i for i in range(1500) if i != q), key=lambda i: (-round(s[i], 9), i))[:20]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(abs(v - s[i]) < 1e-9 for _, i, v in found)
        assert [i for _, i, _ in found] == sorted((i for _, i, _ in found), key=lambda i: (-round(s[i], 9), i))
        hits += len(set(order) & {i for _, i, _ in found})
    recall = hits / 20 / len(got)
    assert recall >= 0.9
    few = ann.nearest(table.where("vec_id < 5"))
    assert few.count() == 20 and ann.nearest(table.where("vec_id > 9000")).count() == 0 and ann.nearest(table.limit(0)).count() == 0


def test_descent_keeps_distinct_introductions(spark):
    """Nodes that many centres introduce to the same few others still meet all the others."""
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((900, 12)) * rng.pareto(2.0, (900, 1))).astype(np.float32)
    nodes = ann.coded_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cid long, v array<double>"))
    found: dict = {}
    for r in ann.build_graph(nodes, k=12, rounds=2, leaf=64, descents=4, width=12).collect():
        found.setdefault(r.cid, set()).add(r.other)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    hits = [len(found[i] & set(np.argsort(-s[i])[:12].tolist())) / 12 for i in range(900)]
    named = np.bincount(np.argsort(-s, axis=1)[:, :12].ravel(), minlength=900)
    assert np.mean([hits[i] for i in np.argsort(-named)[:50]]) >= 0.99, np.mean(hits)


def test_one_huge_vector_leaves_the_others_their_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((800, 16))
    x[0] *= 1e7
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.nearest(table, table.where("vec_id % 20 = 1").select("vec_id"), leaf=256, rounds=4, k=24).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(got[q] & set([i for i in np.argsort(-(x @ x[q])).tolist() if i != q][:20])) for q in range(1, 800, 20)]
    assert sum(hits) / 20 / len(hits) >= 0.95


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _prose(rng, words):
    """Sentences with the common words of English and no 3-word window twice."""
    common = ["the", "of", "and", "to", "in", "is", "that", "was", "for", "with"]
    noun = lambda: "".join(rng.choice("aeioulnrstdm") for _ in range(rng.randint(4, 8)))
    return " ".join(f"{noun()} {rng.choice(common)} {noun()}{rng.choice(['', '', ',', '.'])}" for _ in range(words // 3))


def _brute_lines(docs):
    """Texts by id without lines that an earlier one equals or is near to; ids of documents left with no word are gone."""
    first, up = {}, {}
    for d in sorted(docs):
        for k, line in enumerate(docs[d].split("\n")):
            if line.strip():
                first.setdefault(line, (d, k))

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    names = sorted(first, key=first.get)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            limit = 2 if min(len(a), len(b)) >= 24 else 1 if min(len(a), len(b)) >= 12 else 0
            if limit and abs(len(a) - len(b)) <= limit and levenshtein(a, b) <= limit:
                p, q = sorted((top(a), top(b)), key=first.get)
                up[q] = p
    out = {}
    for d, t in docs.items():
        kept = [x for k, x in enumerate(t.split("\n")) if not x.strip() or first[top(x)] == (d, k)]
        if len(kept) == len(t.split("\n")) or any(x.strip() for x in kept):
            out[d] = "\n".join(kept)
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    texts = {i: "\n".join(_prose(rng, 60) for _ in range(3)) for i in range(8)}
    texts[10] = texts[0]  # loses all its lines
    words = texts[1].split(" ")
    texts[11] = " ".join(w if k % 40 else f"changed{k}" for k, w in enumerate(words))  # a near copy
    texts[12] = texts[2][: len(texts[2]) // 2] + "\n" + _prose(rng, 90) + "\n" + texts[3].split("\n")[1] + "!"  # one line of it is near to another
    texts[13] = " ".join(f"{'#$%'[k % 3] * 4}{k}" for k in range(120))
    texts[14], texts[15] = "the same few words " * 30, "short"
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(16, None, None, None, None), (17, "", "en", "s", 0)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    one = stages["quality_rules"](spark, docs, "")
    kept = {r.doc_id: r.text for r in one.collect()}
    assert set(kept) == {*range(8), 10, 11, 12} and one.columns == docs.columns
    two = stages["line_dedup"](spark, one, "")
    lines = {r.doc_id: (r.text, r.n_chars) for r in two.collect()}
    want = _brute_lines(kept)
    assert lines == {d: (t, len(t)) for d, t in want.items()} and 10 not in lines and two.columns == docs.columns
    assert any(want[d] != kept[d] for d in want)
    three = stages["near_duplicates"](spark, two, "")
    left = {r.doc_id for r in three.collect()}
    sets = {d: set(zip(t.lower().split(), t.lower().split()[1:])) for d, t in want.items()}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert links and left == set(want) - {b for _, b in links} and three.columns == docs.columns
    marked = {r.doc_id for r in neardup.near_duplicates(two, shingle_words=2, percent=80).where("not kept").collect()}
    assert left == set(want) - marked
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole: dict = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.start)):
        assert r.start == whole.get(r.doc_id, 0)
        whole[r.doc_id] = r.start + r.length
    lib = Tokenizer.from_file(tokens.tokenizer_file("byte_bpe_50k.json"))
    assert whole == {d: len(lib.encode(want[d], add_special_tokens=False).ids) + 1 for d in left}


def test_pipeline_edges(spark, messy, empty):
    """Nulls, repeated rows, a very long text and clashing columns pass through all stages; an empty table stays empty."""
    import corpus_pipeline

    rng = random.Random(2)
    long_text = _prose(rng, 30_000)
    names = ["_key", "_gone", "_w", "row", "kept", "hash", "key", "component_id"]
    rows = [(1, None), (2, ""), (3, long_text), (3, long_text), (None, _prose(rng, 200)), (4, _prose(rng, 200)), (5, "é" * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.char_length("text").cast("long")).withColumns({c: F.lit(c) for c in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "n_chars", *names] and all(r[c] == c for r in docs.collect() for c in names)
    assert sorted(r.doc_id for r in docs.where("doc_id is not null").collect()) == [3, 4] and docs.where("doc_id is null").count() == 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty.withColumn("n_chars", F.lit(0)), "").count() == 0
    kept = {name: stage(spark, messy.withColumn("n_chars", F.lit(0)), "") for name, stage in corpus_pipeline.STAGES}
    assert kept["quality_rules"].count() == 0  # too short, or one window of words over and over
    assert {r.doc_id for r in kept["line_dedup"].collect()} >= {0, 1, 2, 3, 5, 7, None}
    assert sorted((r.doc_id is None, r.doc_id) for r in kept["near_duplicates"].collect()) == sorted((d is None, d) for d in (0, 1, 2, 3, 4, 4, 5, None, 7))
    assert kept["packing"].select("doc_id").distinct().count() == 9


def test_near_duplicate_stage_keeps_texts_of_shared_ids(spark):
    """An id is no key: of five rows, the two different texts stay once each, whichever ids their copies have."""
    import corpus_pipeline

    rng = random.Random(4)
    a, b = _prose(rng, 80), _prose(rng, 80)
    rows = [(2, a, 1), (4, a, 2), (4, b, 3), (None, a, 4), (None, a, 5)]
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, spark.createDataFrame(rows, "doc_id long, text string, n int"), "")
    assert sorted(tuple(r) for r in got.collect()) == [(2, a, 1), (4, b, 3)]
    c = _prose(rng, 80)
    only = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, spark.createDataFrame([(None, c), (None, c), (None, ""), (None, "")], "doc_id long, text string"), "")
    assert sorted(r.text for r in only.collect()) == ["", "", c]


def test_exact_search_and_recall_over_several_leaves(spark, monkeypatch):
    """The exact mode equals brute force, repeated ids and vectors included; the graph at shipped parameters finds nine in ten of it or more."""
    monkeypatch.setattr(ann, "EXACT_QUERIES", 40)  # several blocks, and tiles of few vectors
    monkeypatch.setattr(ann, "EXACT_TILE", 300)
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(2600, 12)) * rng.lognormal(0, 0.5, size=(2600, 1)), 6)
    x[100:130] = x[99]  # more copies than are asked for
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist()), (7, x[8].tolist()), (None, x[1].tolist()), (9000, None), (9001, [0.0] * 12)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(i,) for i in range(0, 2600, 20)], "vec_id long")
    exact = defaultdict(list)
    for r in ann.nearest(vectors, asked, exact=True).collect():
        exact[r.query_id].append((r["rank"], r.vec_id))
    ids = np.array([i for i, v in rows if i is not None and v and any(v)])
    mat = np.array([v for i, v in rows if i is not None and v and any(v)])
    for q in range(0, 2600, 20):
        score = np.array([sum(a * b for a, b in zip(x[q].tolist(), v, strict=True)) for v in mat.tolist()])
        order = [k for k in np.lexsort((ids, -score)) if ids[k] != q][:20]
        assert [v for _, v in sorted(exact[q])] == ids[order].tolist()
    found = defaultdict(set)
    for r in ann.nearest(vectors, asked).collect():
        found[r.query_id].add(r.vec_id)
    hits = [len(found[q] & {v for _, v in exact[q]}) / 20 for q in exact]
    assert len(rows) > 2 * ann.LEAF and np.mean(hits) >= 0.9
    assert ann.nearest(vectors.limit(0), exact=True).count() == 0
