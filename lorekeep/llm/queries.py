"""One query per operator of this package, over whole tables; SQL where it can express the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import ann, audit, lexical, licenses, linededup, lmscore, neardup, packing, pieces, quality, secrets, tokens, warc
from lorekeep.plans.store import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt over the cores where they come in fewer files: without a shuffle each file would be one task."""
    return spread(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(documents(spark, sf_dir).select("doc_id", "text", "lang"), lang="lang")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _js_sql(counts: list[str], reference: tuple[float, ...], size: str) -> str:
    total = sum(reference)
    terms = []
    for c, r in zip(counts, reference, strict=True):
        p, q = f"({c})::DOUBLE/({size})", repr(r / total)
        m = f"(({p} + {q})/2)"
        terms.append(f"(CASE WHEN ({c}) > 0 THEN ({p})*log2(({p})/{m}) ELSE 0 END) + {q}*log2({q}/{m})")
    return f"sqrt(greatest(0, ({' + '.join(terms)})/2))"


def _op6_sql() -> str:
    classes = ["lo", "up", "di", "sp", "pu", "n_chars - lo - up - di - sp - pu"]
    fits = []
    for lang, chars in quality.CHAR_REFERENCE.items():
        known = quality.WORD_REFERENCE[lang]
        own = [f"len(list_filter(lw, lambda x: x = '{w}'))" for w in known]
        counts = [*own, f"len(lw) - ({' + '.join(own)})"]
        shares = (*known.values(), 100.0 - sum(known.values()))
        fits.append(
            f"((n_chars < {quality.MIN_CHARS} OR {_js_sql(classes, chars, 'n_chars')} <= {quality.MAX_CHAR_DISTANCE}) AND "
            f"(len(lw) < {quality.MIN_WORDS} OR ({_js_sql(counts, shares, 'len(lw)')} <= {quality.MAX_WORD_DISTANCE} AND "
            f"({' + '.join(own)})::DOUBLE / len(lw) / {sum(known.values()) / 100.0!r} >= {quality.MIN_COMMON})))")
    chars_only = " OR ".join(f"{_js_sql(classes, r, 'n_chars')} <= {quality.MAX_CHAR_DISTANCE}" for r in quality.CHAR_REFERENCE.values())
    space = r"[ \t\n\x0B\f\r]"
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, lang, t, list_filter(string_split_regex(t, '{space}+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '{space}+', '', 'g')) > 0) AS ls,
    list_filter(string_split_regex(lower(t), '[^\p{{L}}]+'), lambda x: x <> '') AS lw, length(t) AS n_chars,
    length(regexp_replace(t, '[^\p{{Ll}}]+', '', 'g')) AS lo, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS up,
    length(regexp_replace(t, '[^0-9]+', '', 'g')) AS di, length(regexp_replace(t, '[^ \t\n\x0B\f\r]+', '', 'g')) AS sp,
    length(regexp_replace(t, '[^.,;:!?''\x22()\-]+', '', 'g')) AS pu
  FROM d),
g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c
  FROM (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM g, (SELECT unnest([0, 1, 2]) AS o) WHERE c > 1 GROUP BY doc_id),
s AS (
  SELECT w.*, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{space}+', '', 'g'))::BIGINT AS word_chars,
    (n_chars - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND CASE WHEN len(lw) = 0 THEN n_chars < {quality.MIN_CHARS} OR {chars_only} ELSE {' OR '.join(fits)} END
    OR NOT base_failed AND (2 * length(regexp_replace(t, '[^\p{{Latin}}]+', '', 'g')) < length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) OR lang NOT IN ({', '.join(f"'{x}'" for x in quality.CHAR_REFERENCE)})
      OR (lang IS NULL AND 100 * length(regexp_replace(t, '[^\p{{L}}]+|[{quality.KNOWN_LETTERS}]+', '', 'g')) > {quality.MAX_OTHER_LETTERS} * length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')))) AS kept
FROM b"""


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.sample_segmentations(documents(spark, sf_dir), with_pieces=True)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.license_scan(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _op9_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    notices = ", ".join(f"({k}, {quoted(a)}, {quoted(b)})" for k, (a, b) in enumerate(licenses.NOTICES))
    words = lambda c: (
        f"list_filter(string_split_regex(translate(coalesce({c}, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.NOT_WORD}'), lambda x: x <> '')")
    phrases = ", ".join(f"({quoted(p)}, {quoted(x)}, {len(p.split())})" for p, x in licenses.PHRASES.items())
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, {words('text')} AS w FROM documents),
n AS (SELECT t, label, {words('wording')} AS tw FROM (VALUES {notices}) v(t, label, wording)),
ng AS (SELECT t, len(tw) AS size, unnest(range(0, len(tw) - 3)) AS p, tw FROM n),
tg AS (SELECT t, size, p, array_to_string(tw[p + 1:p + 4], ' ') AS g FROM ng),
dg AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 3)) AS i FROM d WHERE len(w) >= 4)),
votes AS (SELECT doc_id, t, size, i - p AS diagonal, count(DISTINCT i) AS votes FROM dg JOIN tg USING (g) GROUP BY ALL),
celled AS (
  SELECT doc_id, t, size, diagonal, votes, grid, floor((diagonal + grid * near) / (2.0 * near)) AS cell
  FROM (SELECT *, greatest({licenses.MERGE_WITHIN}, size // 10) AS near, unnest([0, 1]) AS grid FROM votes)),
islands AS (
  SELECT DISTINCT doc_id, t, low, high FROM (
    SELECT doc_id, t, min(diagonal) AS low, max(diagonal) AS high FROM celled GROUP BY doc_id, t, grid, cell, size HAVING sum(votes) >= greatest(1, size // 10))),
held AS (
  SELECT row_number() OVER () AS id, doc_id, label, low, len(tw) AS size, list_transform(range(0, len(tw)), lambda p: list_transform(range(low, high + 1), lambda d: coalesce(p + d >= 0 AND w[p + d + 1] = tw[p + 1]
      AND ((p >= 1 AND p + d >= 1 AND w[p + d] = tw[p]) OR coalesce(w[p + d + 2] = tw[p + 2], false)), false))) AS same
  FROM islands JOIN d USING (doc_id) JOIN n USING (t)),
walk(id, p, st) AS (
  SELECT id, 0::BIGINT, list_transform(same[1], lambda x: {{'n': 0::BIGINT, 's': 0::BIGINT, 'e': 0::BIGINT}}) FROM held
  UNION ALL
  SELECT id, p + 1, list_transform(range(1, len(c) + 1), lambda k: list_max(c[1:k])) FROM (
    SELECT id, p, list_transform(range(1, len(st) + 1), lambda k: list_max(list_filter([st[k], st[k + 1],
      CASE WHEN same[p + 1][k] THEN {{'n': st[k].n + 1, 's': CASE WHEN st[k].n = 0 THEN p + low + k - 1 ELSE st[k].s END, 'e': -(p + low + k - 1)}} END], lambda x: x IS NOT NULL))) AS c
    FROM walk JOIN held USING (id) WHERE p < size)),
spanned AS (
  SELECT DISTINCT doc_id, label, st[len(st)].n / size AS coverage, st[len(st)].s AS start, 1 - st[len(st)].e AS stop
  FROM walk JOIN held USING (id) WHERE p = size AND st[len(st)].n / size >= {licenses.MIN_COVERAGE}),
met AS (
  SELECT * FROM spanned s WHERE NOT EXISTS (SELECT 1 FROM spanned r WHERE r.doc_id = s.doc_id AND r.label <> s.label AND r.coverage >= s.coverage
    AND 2 * (least(s.stop, r.stop) - greatest(s.start, r.start)) >= least(s.stop - s.start, r.stop - r.start))),
found AS (SELECT doc_id, list(DISTINCT label) AS more, max(coverage) AS best FROM met GROUP BY doc_id),
ph AS (SELECT * FROM (VALUES {phrases}) v(phrase, label, size)),
pl AS (
  SELECT doc_id, label, i FROM (SELECT doc_id, w, label, phrase, size, unnest(range(0, len(w) - size + 1)) AS i FROM d, ph WHERE len(w) >= size)
  WHERE array_to_string(w[i + 1:i + size], ' ') = phrase),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS marks FROM pl GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(marks), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(marks, []), coalesce(more, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)"""


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), shingle_words=2, percent=80)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OP10_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
top AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(top.other, w.doc_id)) AS component_id,
  w.doc_id = least(w.doc_id, coalesce(top.other, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN top USING (doc_id)"""


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_exact", "n_near", "n_kept", "kept_text")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0").select("vec_id"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_OP3_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN top END AS refers_to
FROM t"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir), prefixes=True)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(documents(spark, sf_dir).select("doc_id", "text", "source"))


def _op11_sql() -> str:
    kinds, last = [], len(secrets.BASE_KINDS) - 1
    for k, (_, pattern, group, least) in enumerate(secrets.KINDS):
        p = "'" + pattern.replace("'", "''") + "'"
        kinds.append(
            f"SELECT r, {k} AS kind, v[i] AS value, list_sum(list_transform(o[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start, length(m[i]) AS size "
            f"FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {group}) AS v, string_split_regex(t, {p}) AS o FROM d)) WHERE length(v[i]) >= {least}")
    names = ", ".join(f"'{n}'" for n in secrets.NAMES)
    listed = lambda cond: f"coalesce(string_agg(([{names}])[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER ({cond}), '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS repo, split_part(coalesce(source, ''), '/', 1) AS owner, coalesce(text, '') AS t FROM documents),
c AS (SELECT r, kind, value, start::BIGINT AS start, (start + size)::BIGINT AS stop FROM ({' UNION ALL '.join(kinds)})),
f AS (SELECT value, count(DISTINCT (owner, repo)) <= {secrets.MOST_REPOSITORIES} AND count(DISTINCT owner) <= {secrets.MOST_OWNERS} AS live, bool_or(kind NOT IN (2, 7)) AS named FROM c JOIN d USING (r) GROUP BY value),
j AS (
  SELECT c.*, live, named, kind <= {last} AS base, regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')
    AND len(list_distinct(string_split(value, ''))) >= {secrets.MIN_DISTINCT} AS random FROM c JOIN f USING (value)),
k AS (
  SELECT * FROM j WHERE base OR (live AND (kind <> 7 OR random OR named) AND NOT EXISTS (
    SELECT 1 FROM j b WHERE b.r = j.r AND b.start < j.stop AND j.start < b.stop AND (b.base OR (j.kind = 7 AND b.live AND b.kind <> 7))))),
s AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, {listed('base')} AS base_spans, {listed('true')} AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (base AND NOT live) AS n_example, {listed('live')} AS live_spans FROM k GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(live_spans, '') AS live_spans
FROM d LEFT JOIN s USING (r)"""


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_OP12_TERMS = rf"list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_OP12_TERMS} AS ws FROM documents),
s AS (SELECT count(*) FILTER (len(ws) > 0) AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, n_docs),
i AS (SELECT item_id, text, unnest({_OP12_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item_id, text, term, count(*) AS times FROM i GROUP BY ALL),
g AS (
  SELECT item_id, text, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN df USING (term) JOIN tf USING (term), s GROUP BY item_id, text, r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM g WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(documents(spark, sf_dir).select("doc_id", "text", "source"), table(spark, sf_dir, "labels"))


_OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, min(doc_id) OVER (PARTITION BY t) AS first, list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n,
    CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l USING (doc_id) GROUP BY ALL),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c3.x || d4.x || e.x AS filter_order FROM c a, c b, c c3, c d4, c e
  WHERE a.x <> b.x AND c3.x NOT IN (a.x, b.x) AND d4.x NOT IN (a.x, b.x, c3.x) AND e.x NOT IN (a.x, b.x, c3.x, d4.x)),
s AS (SELECT filter_order, step::INTEGER AS step, substr(filter_order, step, 1) AS filter FROM o, (SELECT unnest(range(1, 6)) AS step)),
met AS (
  SELECT s.*, m.*, CASE WHEN fails = '' THEN 9 ELSE 1 + length(regexp_extract(filter_order, '^[^' || fails || ']*')) END AS gone FROM s, m),
t AS (
  SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (gone > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (gone = step), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone < step AND contains(fails, filter)), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = filter), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (gone = step AND good = 1), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (gone = step AND toxic = 1), 0)::BIGINT AS toxic_lost
  FROM met GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM t"""


QUERIES = {
    "op1_line_dedup": op1_line_dedup, "op2_ann": op2_ann, "op3_warc": op3_warc, "op4_token_counts": op4_token_counts, "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules, "op7_lm_scoring": op7_lm_scoring, "op8_sentencepiece": op8_sentencepiece, "op9_license_scan": op9_license_scan, "op10_minhash_neardup": op10_minhash_neardup,
    "op11_secret_scan": op11_secret_scan, "op12_lexical_search": op12_lexical_search, "op13_filter_audit": op13_filter_audit,
}
ORACLES = {"op3_warc": _OP3_SQL, "op9_license_scan": _op9_sql(), "op6_quality_rules": _op6_sql(), "op10_minhash_neardup": _OP10_SQL.replace("\\\\", "\\"),
    "op11_secret_scan": _op11_sql(), "op12_lexical_search": _OP12_SQL, "op13_filter_audit": _OP13_SQL,
}
