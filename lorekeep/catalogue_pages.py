"""Queries of page sources, text predicates and graph topology; registered beside those of the catalogue.

Page texts, names, addresses and references are made of columns of the tables in Spark and in SQL alike; what they must yield
is computed by the SQL from the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.catalogue import INDEX, ORACLES, S, _index, query, star, table
from lorekeep.functions import text as T
from lorekeep.operators import checks, graph
from lorekeep.plans import adapters
from lorekeep.sources import frontmatter as FM
from lorekeep.sources import wiki


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])


# --- frontmatter: pages whose block depends on source, language and length of a document ------------------------------------------
MADE = """
d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t, coalesce(n_chars, 0) AS n FROM documents),
m AS (SELECT *, CASE WHEN n % 3 <> 0 THEN 'entity' WHEN n % 2 = 0 THEN lang END AS kind, CASE n % 11 WHEN 0 THEN 'none' WHEN 1 THEN 'open' WHEN 2 THEN 'broken' ELSE 'whole' END AS shape, n % 5 = 0 AS blank,
  'entities/p-' || doc_id || '.md' AS page FROM d),
f AS (SELECT *, 'title: "' || source || ': ' || lang || '"' || chr(10) || CASE WHEN kind IS NULL THEN '' ELSE 'type: ' || kind || chr(10) END || 'tags: [' || lang || ', ' || source || ']' || chr(10)
  || 'sources:' || chr(10) || '  - ' || source || chr(10) || '  - doc-' || doc_id || chr(10) || 'last_updated: 2024-03-01' || chr(10) || CASE WHEN blank THEN 'aliases: ['''']' ELSE 'aliases: [' || source || ' ' || lang || ']  # known as' END || chr(10) AS block FROM m)"""


def _made(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("t"), F.coalesce("n_chars", F.lit(0)).alias("n"))
    kind = F.when(F.col("n") % 3 != 0, "entity").when(F.col("n") % 2 == 0, F.col("lang"))
    block = _text(
        'title: "', F.col("source"), ": ", F.col("lang"), '"\n', F.coalesce(_text("type: ", kind, "\n"), F.lit("")), "tags: [", F.col("lang"), ", ", F.col("source"), "]\nsources:\n  - ",
        F.col("source"), "\n  - doc-", F.col("doc_id"), "\nlast_updated: 2024-03-01\n", F.when(F.col("n") % 5 == 0, "aliases: ['']").otherwise(_text("aliases: [", F.col("source"), " ", F.col("lang"), "]  # known as")), "\n")
    shape = F.col("n") % 11
    page = F.when(shape == 0, F.col("t")).when(shape == 1, _text("---\n", block, F.col("t"))).when(shape == 2, _text("---\ntitle: [open\n---\n", F.col("t"))).otherwise(_text("---\n", block, "---\n", F.col("t")))
    return d.select("doc_id", _text("entities/p-", F.col("doc_id"), ".md").alias("path"), page.alias("text"))


@query(f"""WITH {MADE} SELECT doc_id, shape = 'whole' AS ok, CASE shape WHEN 'none' THEN 'block_missing' WHEN 'open' THEN 'block_missing' WHEN 'broken' THEN 'unparsable' END AS error,
  CASE WHEN shape = 'whole' THEN source || ': ' || lang END AS title, CASE WHEN shape = 'whole' THEN kind END AS type, CASE WHEN shape = 'whole' THEN lang || '|' || source END AS tags,
  CASE WHEN shape = 'whole' THEN source || '|doc-' || doc_id END AS sources, CASE WHEN shape = 'whole' THEN 'date' ELSE 'missing' END AS last_updated_kind,
  (length(t) + CASE WHEN shape = 'open' THEN length(block) + 4 ELSE 0 END)::INTEGER AS body_len FROM f""")
def frontmatter_parse(spark, sf_dir):
    m = _made(spark, sf_dir).select("doc_id", FM.parse_page("text").alias("m"))
    return m.select("doc_id", *[F.col("m")[c].alias(c) for c in ("ok", "error", "title", "type")], F.array_join("m.tags", "|").alias("tags"), F.array_join("m.sources", "|").alias("sources"), "m.last_updated_kind", F.char_length("m.body").alias("body_len"))


def _parsed_pages(spark, sf_dir):
    return wiki.parse_pages(_made(spark, sf_dir).select("path", F.lit(False).alias("is_config"), "text", F.lit(True).alias("utf8")))


@query(f"""WITH {MADE} SELECT page, CASE shape WHEN 'broken' THEN 'frontmatter.unparsable' ELSE 'frontmatter.block_missing' END AS kind, 'the page has no usable frontmatter' AS detail FROM m WHERE shape <> 'whole'
UNION ALL SELECT page, 'frontmatter.missing_key', 'type' FROM m WHERE shape = 'whole' AND kind IS NULL
UNION ALL SELECT page, 'frontmatter.bad_type', 'type' FROM m WHERE shape = 'whole' AND kind <> 'entity'
UNION ALL SELECT page, 'frontmatter.bad_type', 'aliases' FROM m WHERE shape = 'whole' AND blank""")
def check_frontmatter(spark, sf_dir):
    pages = _parsed_pages(spark, sf_dir)
    return checks.unreadable(pages).unionByName(checks.missing_keys(pages)).unionByName(checks.bad_types(pages)).select("page", "kind", "detail")


@query(f"WITH {MADE} SELECT page AS path, CASE WHEN shape = 'whole' THEN source || ': ' || lang ELSE 'p-' || doc_id END AS title, CASE WHEN shape = 'whole' THEN coalesce(kind, 'unknown') ELSE 'unknown' END AS type FROM m")
def page_scan(spark, sf_dir):
    return wiki.page_list(_parsed_pages(spark, sf_dir))


@query(f"""WITH {MADE} SELECT doc_id, CASE shape WHEN 'whole' THEN source || ': ' || lang WHEN 'broken' THEN '[open' END AS title, CASE WHEN shape = 'whole' THEN kind END AS type,
  CASE WHEN shape = 'whole' AND NOT blank THEN source || ' ' || lang ELSE '' END AS aliases FROM m""")
def line_scan(spark, sf_dir):
    m = _made(spark, sf_dir).select("doc_id", FM.scan_page("text").alias("m"))
    return m.select("doc_id", "m.title", "m.type", F.array_join("m.aliases", "|").alias("aliases"))


@query("""SELECT doc_id, '---' || chr(10) || CASE WHEN n_chars % 2 = 0 THEN 'origin: kept' || chr(10) || '---' || chr(10) WHEN n_chars % 3 = 0 THEN 'title: t' || chr(10) || 'origin: from-' || source || chr(10) || '---' || chr(10)
  ELSE 'origin: from-' || source || chr(10) || '---' || chr(10) END || text AS text FROM documents WHERE text IS NOT NULL""")
def origin_stamp(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    page = F.when(F.col("n_chars") % 2 == 0, _text("---\norigin: kept\n---\n", F.col("text"))).when(F.col("n_chars") % 3 == 0, _text("---\ntitle: t\n---\n", F.col("text"))).otherwise(F.col("text"))
    return d.select("doc_id", FM.with_origin(page, _text("from-", F.col("source"))).alias("text"))


@query("""SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN '---' || chr(10) || 'title: ''say "' || source || '" it''''s''' || chr(10) || 'type: entity' || chr(10) || '---' || chr(10) || text END AS mended FROM documents WHERE text IS NOT NULL""")
def frontmatter_repair(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    title = F.when(F.col("n_chars") % 2 == 0, _text('"say "', F.col("source"), '" it\'s"')).otherwise(F.col("source"))
    return d.select("doc_id", FM.repaired_page(_text("---\ntitle: ", title, "\ntype: entity\n---\n", F.col("text"))).alias("mended"))


# --- names, paths, predicates ----------------------------------------------------------------------------------------------
@query(r"""SELECT DISTINCT w, replace(replace(lower(w), 'ß', 'ss'), '_', '-') AS fold
FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}_]+')) AS w FROM documents)""")
def fold_words(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}_]+"), F.lit(0))).alias("w")).distinct()
    return words.select("w", T.fold_stem("w").alias("fold"))


#: Every line of every text, by document and number; lines serve as titles, names and paths.
LINES = "x AS (SELECT doc_id, generate_subscripts(l, 1) AS n, unnest(l) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"
#: A title as a file name: quoted, with a dash, under a folder, with an ending that follows from its length.
NAMED = LINES + """, nm AS (SELECT *, 'up/' || CASE length(x) % 3 WHEN 0 THEN '“' || x || '”' WHEN 1 THEN '`' || x || '` — ~' ELSE chr(8203) || x END
  || CASE length(x) % 7 WHEN 0 THEN '.txt' WHEN 1 THEN '.MD' WHEN 2 THEN '.v1' WHEN 3 THEN '.Pdf' WHEN 4 THEN '.htm ' ELSE '' END AS name FROM x)"""
_PARTS = "list_filter(string_split(name, '/'), lambda p: p NOT IN ('', '.'))"
BASE = NAMED + f""", bn AS (SELECT doc_id, n, trim(translate(coalesce({_PARTS}[len({_PARTS})], ''), '—–―‒~' || chr(8203) || chr(65279) || '"''“”‟„«»‘’‚‛‹›「」『』`…', '-----  '), chr(9) || chr(160) || ' ') AS base FROM nm)"""


def _lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "x")).withColumn("n", F.col("n") + 1)


def _names(spark, sf_dir) -> DataFrame:
    x, k = F.col("x"), F.char_length("x")
    body = F.when(k % 3 == 0, _text("“", x, "”")).when(k % 3 == 1, _text("`", x, "` — ~")).otherwise(_text("\u200b", x))
    ending = F.when(k % 7 == 0, ".txt").when(k % 7 == 1, ".MD").when(k % 7 == 2, ".v1").when(k % 7 == 3, ".Pdf").when(k % 7 == 4, ".htm ").otherwise("")
    return _lines(spark, sf_dir).select("doc_id", "n", _text("up/", body, ending).alias("name"))


@query(f"WITH {BASE} SELECT doc_id, n::INTEGER AS n, base FROM bn")
def normalize_basename(spark, sf_dir):
    return _names(spark, sf_dir).select("doc_id", "n", T.normalize_basename("name").alias("base"))


@query(rf"""WITH {BASE}, e AS (SELECT *, lower(regexp_extract(base, '(?s)^.+(\.[^.]+)$', 1)) AS ending FROM bn),
g AS (SELECT *, trim(regexp_replace(regexp_replace(CASE WHEN ending = '.md' THEN left(base, length(base) - 3) ELSE base END, '[^\p{{L}}\p{{N}}_.\-]+', '-', 'g'), '-+', '-', 'g'), '-.') AS slug FROM e)
SELECT doc_id, n::INTEGER AS n, CASE WHEN ending IN ('.txt', '.pdf', '.docx', '.doc', '.html', '.htm', '.rtf', '.epub') OR slug = '' THEN NULL ELSE 'raw/' || slug || '.md' END AS target,
  CASE WHEN ending IN ('.txt', '.pdf', '.docx', '.doc', '.html', '.htm', '.rtf', '.epub') THEN 'suffix' WHEN slug = '' THEN 'empty' END AS error FROM g""")
def safe_raw_target(spark, sf_dir):
    return _names(spark, sf_dir).select("doc_id", "n", F.inline(F.array(T.safe_raw_target("name"))))


@query(rf"""WITH {LINES}, w AS (SELECT doc_id, n, replace(replace(replace(x, ', ', '/../'), '. ', '/./'), ' ', '/') AS path FROM x),
r AS (SELECT *, list_reduce(list_prepend('', list_filter(string_split(path, '/'), lambda p: p NOT IN ('', '.'))), lambda done, p: CASE
  WHEN p = '..' AND done <> '' AND NOT regexp_matches(done, '(^|/)\.\.$') THEN regexp_replace(done, '(^|/)[^/]*$', '') WHEN done = '' THEN p ELSE done || '/' || p END) AS normal FROM w)
SELECT doc_id, n::INTEGER AS n, normal, path NOT LIKE '/%' AND NOT contains(path, chr(92)) AND normal <> '' AND NOT regexp_matches(normal, '^\.\.(/|$)') AS inside FROM r""")
def path_containment(spark, sf_dir):
    path = F.replace(F.replace(F.replace("x", F.lit(", "), F.lit("/../")), F.lit(". "), F.lit("/./")), F.lit(" "), F.lit("/"))
    lines = _lines(spark, sf_dir).select("doc_id", "n", path.alias("path"))
    both = T.once(F.struct("path", T.normal_path("path").alias("normal")), lambda x: F.struct(x["normal"].alias("normal"), T.inside_as(x["path"], x["normal"]).alias("inside")))
    return lines.select("doc_id", "n", F.inline(F.array(both)))


@query("""WITH t AS (SELECT doc_id, replace(replace(text, '. ', '.' || chr(13) || chr(10)), ', ', ',' || chr(13)) AS t FROM documents WHERE text IS NOT NULL),
l AS (SELECT *, string_split_regex(t, '\r\n|\r|\n') AS l FROM t)
SELECT doc_id, coalesce(nullif(regexp_extract(t, '\r\n|\r|\n'), ''), chr(10)) AS first_break, (len(l) - CASE WHEN l[len(l)] = '' THEN 1 ELSE 0 END)::INTEGER AS n_lines FROM l""")
def line_breaks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    t = F.replace(F.replace("text", F.lit(". "), F.lit(".\r\n")), F.lit(", "), F.lit(",\r"))
    return d.select("doc_id", T.first_line_break(t).alias("first_break"), F.size(T.split_lines(t)).alias("n_lines"))


@query(star("SELECT DISTINCT raw, trim(CASE WHEN contains(raw, '|') THEN substr(raw, strpos(raw, '|') + 1) ELSE split_part(raw, '#', 1) END) AS display FROM l"))
def link_display(spark, sf_dir):
    from lorekeep.operators import resolve

    return resolve.page_links(adapters.star_kb(spark, sf_dir)).select("raw", T.link_display("raw").alias("display")).distinct()


#: Addresses of pages: their own, those that their HTML names, and the latter behind other schemes.
ADDRESSES = r"""h AS (SELECT page_id, url, list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS l FROM pages),
ad AS (SELECT page_id, url AS address FROM h UNION ALL SELECT page_id, unnest(list_concat(l, list_transform(l, lambda x: 'JaVa&#115;cript:' || x), list_transform(l, lambda x: 'mailto:' || x), list_transform(l, lambda x: 'da' || chr(9) || 'ta:' || x))) FROM h)"""


@query(rf"""WITH {ADDRESSES}, p AS (SELECT *, regexp_replace(replace(replace(address, '&#115;', 's'), '&amp;', '&'), '[\x00-\x20]', '', 'g') AS plain FROM ad)
SELECT page_id, address, NOT regexp_matches(plain, '^[a-zA-Z][a-zA-Z0-9+.\-]*:') OR regexp_matches(lower(plain), '^(https?|mailto):') AS safe FROM p""")
def url_safety(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("l"))
    behind = lambda scheme: F.transform("l", lambda x: F.concat(F.lit(scheme), x))
    all_of = F.concat(F.array("url"), "l", behind("JaVa&#115;cript:"), behind("mailto:"), behind("da\tta:"))
    return p.select("page_id", F.explode(all_of).alias("address")).withColumn("safe", T.url_is_safe("address"))


_ESCAPED = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\x22', '&quot;'), '''', '&#x27;')"


@query(f"""SELECT doc_id, '<table><thead><tr><th scope="COL">' || lang || '</th></tr></thead><tbody><tr><td colspan="' || n_chars || '" align="left">' || {_ESCAPED} || '</td><td></td></tr></tbody></table>' AS html
FROM documents WHERE text IS NOT NULL""")
def table_sanitise(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    escaped = F.col("text")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        escaped = F.replace(escaped, F.lit(sign), F.lit(name))
    html = _text(
        '<table onclick="x"><thead><tr><th scope="COL" style="y">', F.col("lang"), '</th></tr></thead><tbody><tr><td colspan=" ', F.col("n_chars"), '" rowspan="x" align=left valign="up">',
        "<b>", escaped, "</b></td><td><script>", escaped, "</script><!-- ", F.col("source"), " --></td></tr></tbody></table>")
    return d.select("doc_id", T.safe_table(html).alias("html"))


@query()  # tests hold it against texts with fences, long lines and too many parts
def message_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.split_message(2000, 5)("text").alias("c")).select("doc_id", F.array_join("c.parts", "\n-\n").alias("parts"), "c.dropped")


@query(f"WITH {LINES} SELECT doc_id, n::INTEGER AS n, length(trim(x)) BETWEEN 1 AND 200 AND NOT regexp_matches(trim(x), '[\x00-\x1F\x7F]') AS ok FROM x")
def page_argument(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "n", T.page_argument_ok("x").alias("ok"))


@query("SELECT conv_id, turn, trim(text || chr(10) || role, ' ' || chr(10)) AS message FROM conversations WHERE text IS NOT NULL")
def message_blocks(spark, sf_dir):
    block = lambda kind, x: F.struct(F.lit(kind).alias("type"), x.alias("text"))
    c = table(spark, sf_dir, "conversations").where("text is not null")
    hidden = F.concat("role", F.lit("<system-reminder>\nnot for\nreaders</system-reminder>"))
    return c.select("conv_id", "turn", T.message_text(F.array(block("text", F.col("text")), block("tool_use", F.lit("call")), block("text", hidden))).alias("message"))


@query(r"""WITH h AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS href FROM pages),
r AS (SELECT page_id, CASE length(href) % 4 WHEN 0 THEN href WHEN 1 THEN replace(href, '/', 'img%2F') WHEN 2 THEN replace(href, '/', '%2e%2e/') ELSE replace(href, '/', './a/../') END || CASE length(href) % 3 WHEN 0 THEN '.TIFF' WHEN 1 THEN '.png' ELSE '.txt' END AS ref, href FROM h)
SELECT page_id, ref, length(href) % 4 IN (1, 3) AND length(href) % 3 <> 2 AND NOT regexp_matches(ref, '^([A-Za-z][A-Za-z0-9+.\-]*:|/|~)') AS ok FROM r""")
def image_reference(spark, sf_dir):
    h = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("href"))
    k, at = F.char_length("href"), lambda to: F.replace("href", F.lit("/"), F.lit(to))
    ref = F.when(k % 4 == 0, F.col("href")).when(k % 4 == 1, at("img%2F")).when(k % 4 == 2, at("%2e%2e/")).otherwise(at("./a/../"))
    ref = F.concat(ref, F.when(k % 3 == 0, ".TIFF").when(k % 3 == 1, ".png").otherwise(".txt"))
    return h.select("page_id", ref.alias("ref")).withColumn("ok", T.image_ref_admitted("ref"))


#: Files made of pages: the ending follows from the length of the address, some contents get a NUL behind a blank or a byte that is no UTF-8.
@query("""SELECT page_id, CASE length(url) % 8 WHEN 0 THEN 'image' WHEN 1 THEN 'text' WHEN 2 THEN 'text' WHEN 3 THEN 'binary' WHEN 4 THEN 'binary' WHEN 5 THEN 'text' WHEN 6 THEN 'text' ELSE 'binary' END AS class FROM pages WHERE html IS NOT NULL""")
def upload_class(spark, sf_dir):
    k = F.char_length("url") % 8
    ending = F.element_at(F.array(*[F.lit(x) for x in (".JPeg", ".svg", ".Rst", ".bin", ".dat", ".bin", "", ".pdf")]), (k + 1).cast("int"))
    start = F.when((k == 3) | (k == 2), F.unhex(F.lit("2000"))).when((k == 4) | (k == 7), F.unhex(F.lit("FF20"))).otherwise(F.unhex(F.lit("")))
    pages = table(spark, sf_dir, "pages").where("html is not null")
    return pages.select("page_id", T.upload_class(_text("page-", F.col("page_id"), ending), F.concat(start, F.encode("html", "UTF-8"))).alias("class"))


_CLOSING = "[" + "".join("\\" + c for c in ".,;:!?)]}") + "。，）”]+$"
_URL = "[a-zA-Z][a-zA-Z0-9+.\\-]*://[^\\s''\x22<>]+"


@query(rf"""WITH t AS (SELECT page_id, html || ' Cannot reach ' || replace(url, '://', '://me:pass@') || ', nor (' || replace(url, '/', '/0123456789abcdef') || '). Key key-' || replace(url, '/', '') || ' was used' AS t, 'key-' || replace(url, '/', '') AS key FROM pages WHERE html IS NOT NULL),
u AS (SELECT page_id, string_split_regex(t, '{_URL}') AS o, list_transform(regexp_extract_all(t, '{_URL}'), lambda u: struct_pack(bare := regexp_replace(u, '{_CLOSING}', ''), whole := u)) AS l FROM t),
v AS (SELECT page_id, o, list_transform(l, lambda x: struct_pack(tail := substr(x.whole, length(x.bare) + 1), a := regexp_extract(regexp_replace(x.bare, '[?#].*$', ''), '^([^:]+)://(?:[^/]*@)?([^/]+)(.*)$', ['s', 'h', 'p']))) AS l FROM u),
w AS (SELECT page_id, o, list_transform(l, lambda x: lower(x.a.s) || '://' || lower(x.a.h) || array_to_string(list_transform(string_split(x.a.p, '/'), lambda p: CASE WHEN length(p) >= 16 THEN '***' ELSE p END), '/') || x.tail) AS l FROM v)
SELECT page_id, array_to_string(list_transform(range(1, len(o) + 1), lambda i: o[i] || coalesce(l[i], '')), '') AS redacted FROM w""")
def redaction(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where("html is not null")
    t = _text(F.col("html"), " Cannot reach ", F.replace("url", F.lit("://"), F.lit("://me:pass@")), ", nor (", F.replace("url", F.lit("/"), F.lit("/0123456789abcdef")), "). Key key-", F.replace("url", F.lit("/"), F.lit("")), " was used")
    return p.select("page_id", T.redact(t, ["pass"]).alias("redacted"))


# --- listings ------------------------------------------------------------------------------------------------------------
@query("SELECT 'doc.' || doc_id || '.md' AS name, length(text) AS size, doc_id % 2 = 0 AS ingested, CASE WHEN doc_id % 2 = 0 THEN 'sources/doc-' || doc_id || '.md' END AS page FROM documents")
def raw_listing(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = lambda dot: F.concat(F.lit(f"doc{dot}"), F.col("doc_id").cast("string"))
    raw = d.select(F.concat(name("."), F.lit(".md")).alias("path"), F.char_length("text").cast("long").alias("size")).unionByName(
        d.select(F.concat(F.lit("deep/"), name("."), F.lit(".md")).alias("path"), F.lit(1).cast("long").alias("size")))
    sources = d.where("doc_id % 2 = 0").select(name("-").alias("stem"), F.concat(F.lit("sources/"), name("-"), F.lit(".md")).alias("path"))
    return wiki.raw_listing(raw, sources)


@query("""WITH f AS (SELECT source || '/' || CASE WHEN doc_id % 3 = 0 THEN 'Doc' ELSE 'doc' END || (doc_id // 2) || '.md' AS path FROM documents), b AS (SELECT path, regexp_extract(path, '([^/]+)$', 1) AS name FROM f),
e AS (SELECT name AS key, min(path) AS path, true AS exact FROM b GROUP BY name),
l AS (SELECT lower(name) AS key, min(path) AS path, false AS exact FROM b GROUP BY 1 HAVING min(path) = max(path))
SELECT * FROM e UNION ALL SELECT * FROM l WHERE key NOT IN (SELECT key FROM e)""")
def unique_names(spark, sf_dir):
    word = F.when(F.col("doc_id") % 3 == 0, "Doc").otherwise("doc")
    return wiki.unique_names(table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), word, F.floor(F.col("doc_id") / 2).cast("string"), F.lit(".md")).alias("path")))


@query(star("SELECT path, title, body FROM p WHERE path = 'entities/nation-3.md'"))
def read_page(spark, sf_dir):
    return wiki.read_page(adapters.star_kb(spark, sf_dir), "entities/nation-3.md")


# --- topology: a forest of regions, nations and suppliers, with some cycles and an island -------------------------------------
FOREST = """
fe AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 's' || s_suppkey, 's' || (s_suppkey + 1) FROM supplier WHERE s_suppkey % 3 = 1 AND s_suppkey + 1 IN (SELECT s_suppkey FROM supplier)
  UNION ALL SELECT * FROM (VALUES ('island-1', 'island-2'), ('island-2', 'island-3'), ('island-3', 'island-4'))),
u AS (SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM fe), both_ AS (SELECT u AS a, v AS b FROM u UNION ALL SELECT v, u FROM u), ids AS (SELECT DISTINCT a AS id FROM both_)"""


def _forest(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    name = lambda p, c: F.concat(F.lit(p), (F.col(c) if isinstance(c, str) else c).cast("string"))
    known = s.select((F.col("s_suppkey") - 1).alias("k"))
    pairs = n.select(name("n", "n_nationkey").alias("source"), name("r", "n_regionkey").alias("target"))
    pairs = pairs.unionByName(s.select(name("s", "s_suppkey").alias("source"), name("n", "s_nationkey").alias("target")))
    pairs = pairs.unionByName(
        s.where("s_suppkey % 3 = 1").join(known, F.col("s_suppkey") == F.col("k"), "left_semi").select(name("s", "s_suppkey").alias("source"), name("s", F.col("s_suppkey") + 1).alias("target")))
    island = spark.createDataFrame([(f"island-{k}", f"island-{k + 1}") for k in (1, 2, 3)], "source string, target string")
    edges = pairs.unionByName(island).withColumn("resolved", F.lit(True))
    ids = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return ids.select("id", F.col("id").alias("title"), F.lit("entity").alias("type"), F.concat("id", F.lit(".md")).alias("path")), edges


@query(f"""WITH RECURSIVE {FOREST}, reach(id, other) AS (SELECT id, id FROM ids UNION SELECT id, b FROM reach JOIN both_ ON a = other)
SELECT id, min(other) AS component FROM reach GROUP BY id""")
def forest_components(spark, sf_dir):
    return graph.components(*_forest(spark, sf_dir))


SIZES = "whole(id, other) AS (SELECT id, id FROM ids UNION SELECT id, b FROM whole JOIN both_ ON a = other), n AS (SELECT id, count(*) AS n FROM whole GROUP BY id)"


@query(f"""WITH RECURSIVE {FOREST}, {SIZES},
cut(u, v, other) AS (SELECT u, v, u FROM u UNION SELECT c.u, c.v, b FROM cut c JOIN both_ ON a = other WHERE NOT (least(a, b) = c.u AND greatest(a, b) = c.v)),
s AS (SELECT u, v, count(*) AS side, max(CASE WHEN other = v THEN 1 ELSE 0 END) AS back FROM cut GROUP BY u, v)
SELECT 'bridge' AS kind, u, v, least(side, n - side)::INT AS side FROM s JOIN n ON n.id = u WHERE back = 0 AND least(side, n - side) >= 2""")
def bridges(spark, sf_dir):
    return graph.fragile_places(_forest(spark, sf_dir)[1]).where("kind = 'bridge'")


@query(f"""WITH RECURSIVE {FOREST},
cut(v, start, other) AS (SELECT a, b, b FROM both_ UNION SELECT v, start, b FROM cut JOIN both_ ON a = other WHERE b <> v),
piece AS (SELECT v, min_other, any_value(n) AS n FROM (SELECT v, start, min(other) AS min_other, count(*) AS n FROM cut GROUP BY v, start) GROUP BY v, min_other),
ranked AS (SELECT v, n, row_number() OVER (PARTITION BY v ORDER BY n DESC) AS k FROM piece)
SELECT 'cut_vertex' AS kind, v AS u, NULL::VARCHAR AS v, n::INT AS side FROM ranked WHERE k = 2 AND n >= 2""")
def cut_vertices(spark, sf_dir):
    return graph.fragile_places(_forest(spark, sf_dir)[1]).where("kind = 'cut_vertex'")


@query(star("""SELECT 0 AS part, '{"id":"' || id || '","title":"' || title || '","type":"' || type || '","path":"' || path || '"}' AS line FROM nodes
UNION ALL SELECT 1, '{"source":"' || source || '","target":"' || target || '","resolved":' || resolved::VARCHAR || '}' FROM edges"""))
def graph_json(spark, sf_dir):
    pages = adapters.star_kb(spark, sf_dir)
    return graph.graph_json(graph.graph_nodes(pages), graph.graph_edges(pages, fold=T.fold_ascii))


# --- whole reports ---------------------------------------------------------------------------------------------------------
_OF = lambda name: ORACLES[name].split(S, 1)[1].strip()  # noqa: E731  the part after the common tables
_FOLDER = "CASE parts[1] WHEN 'sources' THEN 'source' WHEN 'entities' THEN 'entity' WHEN 'concepts' THEN 'concept' WHEN 'syntheses' THEN 'synthesis' END"


@query(star(f"""SELECT page, 'health.stub_page' AS kind, detail, NULL::VARCHAR AS suggestion FROM ({_OF('stub_pages')})
UNION ALL SELECT page, 'health.uncharted_page', detail, NULL FROM ({_OF('uncharted_pages')})
UNION ALL SELECT path, 'health.type_dir_mismatch', type || ' in a folder of ' || {_FOLDER}, NULL FROM p WHERE NOT is_config AND type <> {_FOLDER}
UNION ALL SELECT path, 'health.index_missing_page', 'not linked from the index', NULL FROM p WHERE NOT is_config AND path NOT IN (SELECT target FROM tl)
UNION ALL SELECT 'index.md', 'health.index_dangling', target, NULL FROM tl WHERE target NOT IN (SELECT path FROM p)""", INDEX).replace("WITH RECURSIVE", "WITH"))
def health_report(spark, sf_dir):
    pages = adapters.star_kb(spark, sf_dir)
    return checks.health(pages, _index(pages))


@query(star(f"""SELECT page, 'aliases.collides_stem' AS kind, detail FROM ({_OF('check_alias_stem')})
UNION ALL SELECT path, 'wikilink.broken', raw FROM r WHERE owner IS NULL
UNION ALL SELECT page, 'sources.unresolved', detail FROM ({_OF('check_sources')})
UNION ALL SELECT page, 'aliases.duplicate', detail FROM ({_OF('check_alias_duplicates')})"""))
def check_report(spark, sf_dir):
    return checks.check(adapters.star_kb(spark, sf_dir), T.fold_ascii)

