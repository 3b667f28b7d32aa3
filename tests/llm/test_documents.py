"""Operators on documents against brute force, library results and exact round trips; edge cases of each."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import licenses, linededup, lmscore, neardup, packing, pieces, quality, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def variants(seed, n, words=60, changes=3):
    rng = random.Random(seed)
    base = [rng.choice("abcdefgh") * rng.randint(1, 4) + rng.choice("xyz") for _ in range(words)]
    out = []
    for _ in range(n):
        w = base[:]
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(words)] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("words, percent", [(2, 80), (5, 80)])
def test_near_duplicates_against_brute_force(spark, words, percent, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_WEIGHT", 700)  # several blocks a group
    texts = [t for k in range(12) for t in variants(k, 12)] + ["", "x", "x", "a b", "A b"]
    sets = []
    for t in texts:
        w = WORD.findall(t.lower())
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            p, q = sorted((top(i), top(j)))
            up[q] = p
    got = neardup.near_duplicates(docs_of(spark, texts), shingle_words=words, percent=percent).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: top(i) for i in range(len(texts))}
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in enumerate(sets)}


def test_likelihood_estimates_similarity():
    rng = np.random.default_rng(1)
    for j in (0.2, 0.5, 0.8, 0.95):
        both, one = int(2000 * j), int(1000 * (1 - j))
        x = rng.integers(0, 2**63, both + 2 * one, dtype=np.uint64)
        a, b = neardup.registers(x[: both + one]), neardup.registers(np.concatenate([x[:both], x[both + one :]]))
        more, same = int((a > b).sum()), int((a == b).sum())
        true = both / (both + 2 * one)
        assert abs(float(neardup.likelihood_jaccard(np.array([more]), np.array([len(a) - more - same]), np.array([same]), both + one, both + one)[0]) - true) < 0.12
        assert (neardup.registers(x) == np.maximum(neardup.registers(x[:100]), neardup.registers(x[100:]))).all()


def test_near_duplicate_edges(messy, empty):
    got = neardup.near_duplicates(messy).collect()
    assert len(got) == 11 and {r.n_shingles for r in got if r.doc_id in (0, 1, 2)} == {0}
    assert {r.component_id for r in got if r.doc_id in (5, 6)} == {5} and [r.component_id for r in got if r.doc_id is None] == [None]
    assert neardup.near_duplicates(empty).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, line, n):
    out = list(line)
    for _ in range(n):
        at, kind = rng.randrange(len(out)), rng.random()
        out[at : at + (kind > 0.3)] = [rng.choice("abé")] if kind < 0.7 else []
    return "".join(out)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_banded_distance(spark, most):
    rng = random.Random(most)
    pairs = [(a := "".join(rng.choice("abé") for _ in range(rng.randint(20, 50))), edited(rng, a, rng.randint(0, 5))) for _ in range(400)]
    df = spark.createDataFrame([(a, b, levenshtein(a, b)) for a, b in pairs if abs(len(a) - len(b)) <= most], "a string, b string, d int")
    rows = df.select("d", linededup.banded_distance(F.col("a"), F.col("b"), most).alias("got")).collect()
    assert all(r.got == r.d if r.d <= most else r.got > most for r in rows)


def test_line_dedup_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SLICE", 3)
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([rng.randint(9, 26), rng.randint(20, 70)]))) for _ in range(40)]
    texts = ["\n".join(edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) if rng.random() < 0.9 else rng.choice(["", " ", "x"]) for _ in range(rng.randint(0, 6))) for _ in range(130)]
    first: dict = {}
    for d, t in enumerate(texts):
        for p, line in enumerate(t.split("\n")):
            if line.strip():
                first.setdefault(line, (d, p))
    up = {x: x for x in first}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(first, 2):
        limit = 2 if min(len(a), len(b)) >= 24 else 1
        if min(len(a), len(b)) >= 12 and abs(len(a) - len(b)) <= limit and levenshtein(a, b) <= limit:
            p, q = sorted((top(a), top(b)), key=first.get)
            up[q] = p
    want = ["\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip() or first[top(x)] == (d, p)) for d, t in enumerate(texts)]
    got = {r.doc_id: r for r in linededup.line_dedup(docs_of(spark, texts)).collect()}
    assert [got[d].kept_text for d in range(len(texts))] == want and sum(r.n_near for r in got.values()) > 10


def test_line_dedup_collapses_frequent_lines(spark, monkeypatch):
    """A line of every document is compared once; its near line is still found; a long text of copies loses all but one."""
    monkeypatch.setattr(linededup, "LEAST_COPIES", 3)
    common, near = "This notice stands at the foot of every single page", "This notice stands at the foot of every single page!"
    texts = [f"Own words of page {k * 7919} {chr(97 + k % 26) * 9}\n{common}" for k in range(40)] + [near, "\n".join(["the same line over and over"] * 5000)]
    occurrences = linededup.line_occurrences(docs_of(spark, texts), "doc_id", "text")
    repeated = occurrences.groupBy("h1", "h2").agg(F.min(F.struct("doc", "th", "pos")).alias("first"), F.count("*").alias("n"))
    assert linededup.without_frequent_copies(occurrences, repeated).where(F.col("line") == common).count() == 1
    got = {r.doc_id: r for r in linededup.line_dedup(docs_of(spark, texts)).collect()}
    assert got[0].n_kept == 2 and all((got[d].n_exact, got[d].kept_text) == (1, texts[d].split("\n")[0]) for d in range(1, 40))
    assert (got[40].n_near, got[40].kept_text) == (1, "") and (got[41].n_exact, got[41].kept_text) == (4999, "the same line over and over")


def test_line_dedup_keeps_other_columns(spark):
    names = ["_key", "_gone", "_hash", "_doc", "key", "hash", "doc", "th", "gone", "row", "n", "first", "pos", "line", "h1"]
    docs = docs_of(spark, ["a line of text\nother", "a line of text"]).withColumns({c: F.lit(c) for c in names}).withColumn("n_kept", F.lit("old"))
    rows = sorted(linededup.line_dedup(docs).collect())
    assert [r.kept_text for r in rows] == ["a line of text\nother", ""] and all(r[c] == c for c in names for r in rows) and rows[1].n_kept == 0


def test_line_dedup_edges(messy, empty):
    got = linededup.line_dedup(messy).collect()
    assert len(got) == 11 and all(r.kept_text is None for r in got if r.doc_id == 0) and {r.n_kept for r in got if r.doc_id == 6} == {0}
    assert [r.n_exact for r in got if r.doc_id == 4] == [0, 0, 0] and got[0].w == "w"
    assert linededup.line_dedup(empty).count() == 0


def test_quality(spark, messy, empty):
    rng = random.Random(1)
    noun = lambda: "".join(rng.choice("aeioulnrst") for _ in range(6))
    clean = " ".join(f"The {noun()} of {noun()} and {noun()} {noun()} in {noun()} {noun()} is {noun()}, {noun()}." for _ in range(14))
    junk = " ".join(f"{chr(97 + i % 26) * 3}{i}%%%$$$ ###" for i in range(120))
    rows = {r.doc_id: r for r in quality.quality_rules(docs_of(spark, [clean, junk, "a b c " * 40, "short"])).collect()}
    assert rows[0].kept and not rows[1].kept and not rows[1].base_failed and rows[2].base_failed and rows[3].base_failed
    for d, t in enumerate([clean, junk, "a b c " * 40]):
        w = WORD.findall(t)
        c = Counter(zip(w, w[1:], w[2:]))
        assert rows[d].n_repeat_words == len({i + o for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for o in range(3)})
    got = quality.quality_rules(messy).collect()
    assert len(got) == 11 and all(r.n_words == 0 and not r.kept for r in got if r.doc_id in (0, 1, 2)) and quality.quality_rules(empty).count() == 0
    p, q = np.array([0.5, 0.5, 0]), np.array([0.25, 0.25, 0.5])
    m = (p + q) / 2
    want = math.sqrt(sum(x * math.log2(x / z) if x else 0 for a in (p, q) for x, z in zip(a, m)) / 2)
    got = spark.range(1).select(quality.js_distance(F.array(F.lit(2.0), F.lit(2.0), F.lit(0.0)), (0.25, 0.25, 0.5)).alias("d")).first().d
    assert abs(got - want) < 1e-12


def test_quality_needs_common_words(spark):
    """Word salad with the characters of prose goes; prose of each language, and salad under the guard, stays."""
    rng = random.Random(6)
    noun = lambda: "".join(rng.choice("aeioulnrst") for _ in range(6))
    salad = lambda n: " ".join(f"{noun().capitalize()} {noun()} {noun()}, {noun()} {noun()} {noun()}." for _ in range(n))
    prose = [" ".join(rng.choices(list(k), list(k.values()))[0] if rng.random() < sum(k.values()) / 100 else noun() + rng.choice(["", "", "", ",", "."]) for _ in range(n))
             for k in quality.WORD_REFERENCE.values() for n in (110, 400, 2000)]
    texts = [salad(30), salad(300), salad(15), *prose]
    kept = {r.doc_id: r.kept for r in quality.quality_rules(docs_of(spark, texts)).collect()}
    assert [kept[k] for k in range(3)] == [False, False, True] and all(kept[k] for k in range(3, len(texts)))


def test_quality_leaves_other_scripts_to_the_base_rules(spark):
    rng = random.Random(8)
    russian = " ".join("".join(rng.choice("аеиоунтрслквдмп") for _ in range(rng.randint(2, 9))) for _ in range(300))
    chinese = " ".join("".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(rng.randint(5, 20))) + "。" for _ in range(80))
    symbols = " ".join("#$%"[rng.randrange(3)] * rng.randint(2, 9) + str(rng.randrange(10**6)) for _ in range(300))
    kept = {r.doc_id: (r.kept, r.base_failed) for r in quality.quality_rules(docs_of(spark, [russian, chinese, symbols, "да нет " * 60])).collect()}
    assert kept == {0: (True, False), 1: (True, False), 2: (False, False), 3: (False, True)}


def test_quality_keeps_other_columns(spark):
    names = ["_w", "_l", "_lw", "_known", "_common", "_times", "_classes", "row", "found", "t", "w", "c"]
    rows = quality.quality_rules(docs_of(spark, ["a", None]).withColumns({c: F.lit(c) for c in names}).withColumn("kept", F.lit("old")))
    assert all(r[c] == c for r in rows.collect() for c in names) and rows.where("kept").count() == 0 and rows.columns.count("kept") == 1


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_file("byte_bpe_50k.json"))


ATOMS = ["a", "the", " ", "  ", "\n", "'", "re", "'re", "'ve", "'ll", "'s", "é", "中", "😀", "1", "23", "!", "?!", " the", "ing", "<|endoftext|>", "<|endof", "\t", " "]


def test_prefix_counts_equal_the_library():
    lib, c, rng = library(), tokens.PrefixTokens("byte_bpe_50k.json"), random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(ATOMS) for _ in range(rng.randint(0, 12)))
        want = [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert c.counts(text).tolist() == want and c.total(text) == want[-1]


def test_token_count_edges(messy, empty):
    lib = library()
    for r in tokens.token_counts(messy, prefixes=True).join(messy.select("doc_id", "text").distinct(), "doc_id").where("doc_id <> 4").collect():
        assert r.n_tokens == len(lib.encode(r.text or "", add_special_tokens=False).ids) and r.n_bytes == len((r.text or "").encode())
        if r.text:
            assert np.frombuffer(r.steps, np.int16).sum() == r.n_tokens and len(lib.encode(r.text[: r.budget_chars], add_special_tokens=False).ids) <= 1024
    assert tokens.token_counts(messy).count() == 11 and tokens.token_counts(empty).count() == 0


def test_packing(messy, empty):
    lib = library()
    rows = packing.pack(messy, group_tokens=5000, with_ids=True).collect()
    by_sequence, whole = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        whole[r.doc_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        total = sum(r.length for r in parts)
        assert [r.offset for r in parts] == [sum(x.length for x in parts[:k]) for k in range(len(parts))] and total <= 1024 and (total == 1024 or total & (total - 1) == 0)
    texts = {r.doc_id: r.text for r in messy.collect()}
    for d in (0, 1, 3, 5, 6, 7, None):
        ids = np.frombuffer(b"".join(r.ids for r in sorted(whole[d], key=lambda r: r.start)), "<u4").tolist()
        assert ids == [*lib.encode(texts[d] or "", add_special_tokens=False).ids, 0]
    assert packing.pack(empty).count() == 0


def test_tournament_is_first_fit():
    """The tree finds what a search through all bins from the first finds."""
    rng = random.Random(7)
    for sizes in ([rng.randrange(1, 1025) for _ in range(n)] for n in (1, 2, 3, 7, 64, 300)):
        sizes.sort(reverse=True)
        tree, free = packing.Tournament(len(sizes), 1024), [1024] * len(sizes)
        for size in sizes:
            want = next(k for k, room in enumerate(free) if room >= size)
            free[want] -= size
            assert tree.place(size) == want
        lengths = [rng.randrange(1, 5000) for _ in sizes]
        pieces = packing.pack_group(lengths)
        held = defaultdict(list)
        for sequence in pieces:
            total = sum(n for _, _, n in sequence)
            assert total <= 1024 and total & (total - 1) == 0
            for k, start, n in sequence:
                held[k].append((start, n))
        assert sum(sum(n for _, _, n in x) < 1024 for x in pieces) <= 10  # one bin a group is cut at powers of two
        for k, n in enumerate(lengths):
            spans = sorted(held[k])
            assert [a for a, _ in spans] == [sum(m for _, m in spans[:i]) for i in range(len(spans))] and sum(m for _, m in spans) == n


def test_packing_ids_are_the_librarys():
    """Random texts of odd pieces: special strings, ligatures, marks, digits, white space of all kinds, other scripts."""
    lib, encode = library(), packing.encoder("byte_bpe_50k.tiktoken")
    rng = random.Random(12)
    atoms = ["<|endoftext|>", "<|end", "'ll", "'S", "don't", " ", "  ", "\n", "\r\n", "\t", "\u00a0", "\u2003", "\u200d", "é", "e\u0301", "ﬁ", "日本", "ß", "😀", "👩\u200d👩", "12", "٣", "½", "_", "--", "…", "x" * 40, "The", "ing", "\x00", "{", "//"]
    for _ in range(400):
        text = "".join(rng.choice(atoms) for _ in range(rng.randrange(0, 40)))
        assert encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_quality_judges_no_other_languages(spark):
    """Clean texts in languages without a reference stay, with or without a word about their language; junk goes unless it is said to be in one."""
    polish = "Wczoraj wieczorem w stolicy odbyło się spotkanie mieszkańców z władzami miasta, podczas którego omówiono budowę nowej linii tramwajowej oraz remont mostu. " \
        "Według zapowiedzi prace ruszą jesienią, a ich koszt ma wynieść kilkaset milionów złotych. Część uczestników pytała o zieleń i hałas, inni chwalili krótszy dojazd do szkół. " * 3
    finnish = "Kaupungin uusi kirjasto avattiin eilen ja ihmiset tulivat katsomaan sen suuria saleja sekä hiljaisia lukupaikkoja joita on nyt enemmän kuin koskaan ennen " \
        "vaikka rakennus valmistui vasta kesällä kun viimeiset työt saatiin tehtyä hyvin " * 6
    rng = random.Random(1)
    junk = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(3, 9))) for _ in range(200))
    russian = "Вчера вечером в городе прошла встреча жителей с властями и на ней обсудили ремонт моста и новую линию трамвая которую построят к осени " * 4
    rows = [(0, polish, None), (1, polish, "pl"), (2, finnish, "fi"), (3, junk, "en"), (4, junk, None), (5, russian, None), (6, russian, "ru"), (7, polish, "en")]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), lang="lang", max_repeat_percent=100)
    assert {r.doc_id: r.kept for r in got.collect()} == {0: True, 1: True, 2: True, 3: False, 4: False, 5: True, 6: True, 7: False}
    assert got.columns[:3] == ["doc_id", "text", "lang"]


def test_license_scan(spark, messy, empty):
    mit = dict((a, b) for a, b in licenses.NOTICES)["mit"]
    words = mit.split()
    texts = ["Under the MIT License. mit license", " ".join(["intro words here"] + words[:30] + ["inserted"] + words[30:]), " ".join(words[: len(words) // 2]), "apache license cc by gnu general public license", ""]
    rows = {r.doc_id: r for r in licenses.license_scan(docs_of(spark, texts)).collect()}
    assert (rows[0].n_base, rows[0].first_word, rows[0].last_word, rows[0].labels, rows[0].score) == (2, 2, 4, "mit", 1.0)
    assert rows[1].base_labels == "" and rows[1].labels == "mit" and 0.95 < rows[1].score <= 1 and rows[1].spans[0].start in (2, 3)
    assert rows[2].labels == "" and rows[2].score == 0 and rows[3].base_labels == "apache,cc-by,gpl" and rows[4].n_words == 0
    assert licenses.license_scan(messy).count() == 11 and licenses.license_scan(empty).count() == 0


def test_license_scan_tells_related_notices_apart(spark):
    by = dict(licenses.NOTICES)
    gpl, lgpl = by["gpl"].split(), "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.".split()
    texts = [
        " ".join(gpl), " ".join(lgpl), by["cc-by-nc"], by["cc-by-sa"], " ".join(gpl[:20] + ["page", "3", "header"] + gpl[20:]), " ".join(random.Random(1).sample(gpl, len(gpl))),
        " ".join(["permission"] * 3000 + ["or substantial portions of"] * 2000), " ".join(["x"] * 7 + by["mit"].split()[:45] + ["inserted"] * 8 + by["mit"].split()[45:]),
        f"{by['cc-by-nc']} and elsewhere, a long way further down in this text: {by['cc-by-sa']}"]
    got = {r.doc_id: r for r in licenses.license_scan(docs_of(spark, texts), phrases={}).collect()}
    assert [got[k].labels for k in range(9)] == ["gpl", "lgpl", "cc-by-nc", "cc-by-sa", "gpl", "", "", "mit", "cc-by-nc,cc-by-sa"]


def test_license_scan_takes_no_words_of_neighbours(spark):
    """Words of one notice serve no other; a notice beside a better covered one keeps its label, a reading that two share has none."""
    by = dict(licenses.NOTICES)
    changed = by["mit"].split()
    changed[20] = changed[20][:-1] + "x"
    texts = ["Licensed under CC BY-NC 4.0. Licensed under CC BY-SA 3.0.", "Licensed under CC BY-SA 3.0.", f"{by['cc-by-nc']}. {' '.join(changed)}", f"{by['cc-by-nc']}. {by['cc-by-sa']}.",
             "Licensed under CC BY 4.0", " ".join([*by["isc"].split(), *by["mit"].split()]), " ".join(by["mit"].split()[::-1]), " ".join([by["gpl"]] * 3)]
    got = {r.doc_id: r for r in licenses.license_scan(docs_of(spark, texts), phrases={}).collect()}
    assert [got[k].labels for k in range(8)] == ["cc-by-nc", "", "cc-by-nc,mit", "cc-by-nc,cc-by-sa", "", "isc,mit", "", "gpl"]
    spans = {(x.label, x.start, x.end) for x in got[2].spans}
    assert ("cc-by-nc", 0, 7) in spans and any(x[0] == "mit" and x[1] == 7 for x in spans)
    size = len(re.findall(r"[A-Za-z0-9]+", by["gpl"]))
    assert {(x.start, x.end) for x in got[7].spans} == {(0, size), (size, 2 * size), (2 * size, 3 * size)}


def test_lm_prefers_learnt_order(spark, messy, empty):
    rng = random.Random(3)
    sentence = lambda: " ".join(f"{a} {b}" for a, b in (rng.choice([("red", "apple"), ("blue", "sky"), ("green", "tree"), ("old", "stone")]) for _ in range(30)))
    model = lmscore.fit(docs_of(spark, [sentence() for _ in range(200)]), epochs=100)
    held = [sentence() for _ in range(20)]
    mixed = [" ".join(random.Random(9).sample(t.split(), len(t.split()))) for t in held]
    score = lambda texts: np.mean([r.mean_logp for r in lmscore.pseudo_likelihood(docs_of(spark, texts), model=model).collect()])
    assert score(held) > -0.9 and score(held) > score(mixed) + 1
    got = lmscore.pseudo_likelihood(messy, epochs=5).collect()
    assert len(got) == 11 and all(r.mean_logp is None and r.sum_logp == 0 for r in got if r.doc_id in (0, 1, 2))
    assert lmscore.pseudo_likelihood(empty, epochs=5).count() == 0


def test_lm_counts_rare_words(spark):
    """Words outside the frequent ones count with P(word | class): garbled ones of equal ending score below real ones."""
    rng = random.Random(4)
    common = [f"w{chr(97 + k // 10)}{k % 10}" for k in range(lmscore.FREQUENT)]
    real = [f"{a}{b}éling" for a in "bdfg" for b in "aeiou"] + ["z"]
    texts = [" ".join(rng.choice(common) if rng.random() < 0.95 else rng.choice(real) for _ in range(200)) for _ in range(150)]
    garbled = [re.sub("éling", "xqéling", t) for t in texts[:10]]
    docs = docs_of(spark, texts)
    model = lmscore.fit(docs, epochs=20)
    assert set(model.frequent) == set(common)
    counts = Counter(w for t in texts for w in t.split() if w not in common)
    size = Counter()
    for w, n in counts.items():
        size[lmscore.ending(w)] += n + 1
    rows = lmscore.pseudo_likelihood(docs_of(spark, [*texts[:10], *garbled, texts[0], None]), model=model).collect()
    got = {r.doc_id: r for r in rows}
    known, table = lmscore._Classes(model.frequent), lmscore.log_probabilities(model.weights)
    for d, t in enumerate([*texts[:10], *garbled]):
        c = lmscore.word_classes(t.split(), known)
        want = float(table[c[:-2], c[2:], c[1:-1]].sum(dtype=np.float64))
        want += sum(math.log((counts[w] + 1) / (size[lmscore.ending(w)] + 1)) for w in t.split() if w not in common)
        assert abs(got[d].sum_logp - want) < 1e-5 and got[d].n_words == 200
    assert all(got[10 + d].mean_logp < got[d].mean_logp for d in range(10)) and got[20].sum_logp == got[0].sum_logp and got[21].n_words == 0


def test_sampled_segmentations(messy, empty):
    v = pieces.vocabulary("piece_bpe_32k.model", 1.0)

    def paths(s):
        if not s:
            yield []
        for j in range(1, len(s) + 1):
            if s[:j] in v.ids:
                yield from ([v.ids[s[:j]], *r] for r in paths(s[j:]))

    weight = {tuple(x for part in c for x in part): 0.0 for c in itertools.product(*[list(paths(x)) for x in pieces.CHUNK.findall(pieces.normalized("the ab"))])}
    weight = {p: math.exp(sum(v.weight[i] for i in p)) for p in weight}
    share = {p: w / sum(weight.values()) for p, w in weight.items()}
    n = 4000
    drawn = pieces.sample_texts(["the ab"] * n, list(range(n)), 4, v)
    first, second, third = (Counter(tuple(r[k]["pieces"].tolist()) for r in drawn) for k in (0, 1, 2))
    for b in sorted(share, key=share.get)[-3:]:
        want = sum(share[a] * share[b] / (1 - share[a]) for a in share if a != b)
        last = sum(share[a] / 1 * share[c] / (1 - share[a]) * share[b] / (1 - share[a] - share[c]) for a in share for c in share if len({a, b, c}) == 3)
        assert abs(first[b] / n - share[b]) < 0.04 and abs(second[b] / n - want) < 0.04 and abs(third[b] / n - last) < 0.04
    for r in drawn:
        assert len({tuple(x["pieces"]) for x in r}) == len(r) == min(4, len(share)) and [x["gumbel"] for x in r] == sorted((x["gumbel"] for x in r), reverse=True)
    # without-replacement estimate of the mean number of pieces: each draw but the last, weighted by its inclusion
    mean = sum(len(p) * s for p, s in share.items())
    estimate = [sum(math.exp(x["logp"]) * len(x["pieces"]) / x["inclusion"] for x in r) for r in drawn]
    assert abs(np.mean(estimate) - mean) < 0.05
    drawn = [r[:2] for r in drawn]
    assert all(tuple(a["pieces"]) != tuple(b["pieces"]) and a["gumbel"] >= b["gumbel"] and 0 <= a["inclusion"] <= 1 for a, b in drawn)
    rows = pieces.sample_segmentations(messy).collect()
    assert all(r.round_trip for r in rows) and {r.n_pieces for r in rows if r.doc_id in (0, 1)} == {0} and pieces.sample_segmentations(empty).count() == 0
    again = pieces.sample_segmentations(messy.repartition(7)).collect()
    assert sorted((str(r.doc_id), r.sample, r.ids_crc32) for r in rows) == sorted((str(r.doc_id), r.sample, r.ids_crc32) for r in again)
    for text in ("a b\nc", "  two  marks ", "x▁y", "日本😀\n\x00", "word" * 70_000):  # lattices of any shape are walked to the end
        for r in pieces.sample_texts([text], [5], 3, v)[0]:
            assert pieces.decode(r["pieces"], v) == text.replace("▁", " ")
    back = pieces.decode_ids(pieces.encode_texts(messy)).where("text is not null").collect()
    assert all(r.decoded == r.text for r in back)


def test_segmentations_are_drawn_by_slices_not_by_texts(monkeypatch):
    v = pieces.vocabulary("piece_bpe_32k.model", 1.0)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["Straße", "lowercase", "x", "日本", "internationalization", "a\nb", "\x00"]) for _ in range(rng.randrange(300))) for _ in range(120)]
    texts += ["", " ", "  two  marks ", " lead", "trail ", "x▁y", "▁", "\n"]
    rng.shuffle(texts)
    # Arrow numbers the chunks of plain texts; they are those of chunks_of, in the order of the texts
    distinct, chunk, sizes = pieces.numbered_chunks(texts)
    assert [distinct[n] for n in chunk] == [c for t in texts for c in pieces.chunks_of(t)] and sizes.tolist() == [len(pieces.chunks_of(t)) for t in texts]
    assert len(set(distinct)) == len(distinct)
    for few in ([""], ["  a"], ["a"], ["", "b c"]):
        distinct, chunk, sizes = pieces.numbered_chunks(few)
        assert [distinct[n] for n in chunk] == [c for t in few for c in pieces.chunks_of(t)] and len(sizes) == len(few)
    big = 2**64 - 1
    assert all(pieces.uniform_one(key, salt, i) == pieces.uniform(key, salt, np.array([i]))[0] for key in (0, 7, big) for salt in (1, 208) for i in (0, 5, 10**6))
    alone = [pieces.sample_texts([t], [n], 3, v)[0] for n, t in enumerate(texts)]
    calls, real = [], pieces.uniform
    monkeypatch.setattr(pieces, "uniform", lambda key, *a: calls.append(1) or real(key, *a))
    together = pieces.sample_texts(texts, list(range(len(texts))), 3, v)
    assert len(calls) < 3 * len(texts)  # one for each step of the longest word and each draw, none for each text
    for t, a, b in zip(texts, alone, together, strict=True):
        assert [x["pieces"].tolist() for x in a] == [x["pieces"].tolist() for x in b]
        assert not t or np.allclose([(x["gumbel"], x["logp"], x["inclusion"]) for x in a], [(x["gumbel"], x["logp"], x["inclusion"]) for x in b])
