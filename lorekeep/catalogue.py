"""The library's own queries over the driver's tables, by name, with DuckDB SQL for the same rows where there is a form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import checks, graph, index, maintain, resolve, search, sessions
from lorekeep.plans import adapters
from lorekeep.plans.ranks import ranked
from lorekeep.plans.store import materialize
from lorekeep.sources import wiki

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
QUERY_TEXT = "the and with that"


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- text and retrieval over documents -----------------------------------------------------------------------------------
D = adapters.DOCS_SQL
IDF = """
n AS (SELECT count(*) AS n, avg(dl) AS mean FROM dl),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
idf AS (SELECT term, df, ln(1.0 + (n - df + 0.5) / (df + 0.5)) AS idf, mean FROM df, n)"""
SCORED = """
g AS (SELECT qid, page, term, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean)) AS gain FROM q JOIN post USING (term) JOIN idf USING (term) JOIN dl USING (page)),
s AS (SELECT qid, page, round(list_reduce(list(gain ORDER BY term), lambda a, b: a + b), 6) AS score FROM g GROUP BY qid, page)"""
Q1 = f"q AS (SELECT 'q' AS qid, unnest(list_distinct(regexp_extract_all('{QUERY_TEXT}', '[a-z0-9]+'))) AS term)"
TOP = "SELECT qid, rank, page, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, page)::INT AS rank FROM {0} WHERE score > 0) WHERE rank <= {1}"


@query(f"WITH {D} SELECT page, unnest(b) AS term, generate_subscripts(b, 1) - 1 AS pos FROM toks")
def tokenize_terms(spark, sf_dir):
    return adapters.docs_kb(spark, sf_dir).select("page", F.posexplode(T.tokenize("body")).alias("pos", "term"))


@query(f"WITH {D} SELECT term, count(*) AS df FROM post GROUP BY term")
def token_df(spark, sf_dir):
    return search.term_counts(adapters.docs_kb(spark, sf_dir))


@query(f"WITH {D} SELECT * FROM dl")
def doc_length(spark, sf_dir):
    return search.lengths(adapters.docs_kb(spark, sf_dir))


@query(f"WITH {D} SELECT * FROM post")
def field_weighted_tf(spark, sf_dir):
    return search.postings(adapters.docs_kb(spark, sf_dir))


@query(f"WITH {D}, {IDF} SELECT term, df, round(idf, 9) AS idf FROM idf")
def idf_table(spark, sf_dir):
    docs = adapters.docs_kb(spark, sf_dir)
    df = search.term_counts(docs)
    n = docs.agg(F.count("*").alias("n"))
    return df.join(F.broadcast(n)).select("term", "df", F.round(F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 9).alias("idf"))


def _one_query(spark):
    return search.query_terms(spark.createDataFrame([("q", QUERY_TEXT)], "qid string, query string"))


@query(f"WITH {D}, {IDF}, {Q1}, {SCORED} {TOP.format('s', 10)}")
def bm25_topk(spark, sf_dir):
    docs, terms = adapters.docs_kb(spark, sf_dir), _one_query(spark)
    return search.top_k(search.scores(*search.index_of_terms(docs, terms), terms), 10)


@query(f"""WITH {D}, {IDF}, {Q1}, {SCORED}, prior AS (SELECT page, doc_id % 7 AS n FROM docs),
boosted AS (SELECT qid, page, round(score * CASE WHEN n > 0 THEN 1 + 0.5 * ln(1.0 + n) ELSE 1.0 END, 6) AS score FROM s JOIN prior USING (page) WHERE score > 0)
{TOP.format('boosted', 10)}""")
def bm25_boosted_topk(spark, sf_dir):
    docs, terms = adapters.docs_kb(spark, sf_dir), _one_query(spark)
    prior = docs.select("page", (F.col("doc_id") % 7).alias("n"))
    return search.top_k(search.scores(*search.index_of_terms(docs, terms), terms, prior), 10)


@query(f"""WITH {D}, {IDF}, q AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark), {SCORED} {TOP.format('s', 5)}""")
def bm25_batch(spark, sf_dir):
    docs = adapters.docs_kb(spark, sf_dir)
    terms = search.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return search.best_pages(*search.stored_index(docs, terms), terms, 5)


@query(f"""WITH {D}, place AS (SELECT page, body, strpos(regexp_replace(lower(body), '[^a-z0-9]', ' ', 'g'), ' with ') AS p, lower(body) AS low FROM docs)
SELECT page, trim(regexp_replace(substr(body, CASE WHEN regexp_matches(low, '^with([^a-z0-9]|$)') THEN 1 WHEN p > 0 THEN p + 1 WHEN regexp_matches(low, '[^a-z0-9]with$') THEN length(body) - 3 ELSE 1 END, 140), '\\s+', ' ', 'g'), ' ') AS snippet
FROM place""".replace("\\\\", "\\"))
def snippet(spark, sf_dir):
    return adapters.docs_kb(spark, sf_dir).select("page", T.snippet("body", F.array(F.lit("with"))).alias("snippet"))


@query(f"""WITH {D}, {IDF}, q AS (SELECT DISTINCT doc_id AS qid, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) AS term FROM docs WHERE doc_id % 50 = 0), {SCORED},
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, page) AS rank FROM s WHERE score > 0),
h AS (SELECT d.doc_id, min(CASE WHEN r.page = d.page THEN rank END) AS place FROM docs d LEFT JOIN r ON r.qid = d.doc_id WHERE d.doc_id % 50 = 0 GROUP BY d.doc_id)
SELECT round(avg(CASE WHEN place = 1 THEN 1.0 ELSE 0.0 END), 9) AS p_at_1, round(avg(CASE WHEN place <= 2 THEN 1.0 ELSE 0.0 END), 9) AS recall_at_k, round(avg(CASE WHEN place <= 10 THEN 1.0 / place ELSE 0.0 END), 9) AS mrr FROM h""")
def retrieval_metrics(spark, sf_dir):
    docs = adapters.docs_kb(spark, sf_dir)
    asked = docs.where("doc_id % 50 = 0")  # the queries; all documents are candidates
    golden = asked.select(F.col("doc_id").alias("qid"), F.col("page").alias("primary"), F.array("page").alias("relevant"))
    terms = materialize(search.query_terms(asked, "doc_id", "title"), "asked")
    ranked = search.best_pages(*search.stored_index(docs, terms), terms, 10, down_to=golden.select("qid", F.col("primary").alias("page")))
    out = search.quality(ranked, golden)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


# --- links, resolution and the graph over the star of pages -----------------------------------------------------------------
STEM = r"lower(regexp_replace(list_extract(string_split(replace(trim(split_part(split_part({0}, '|', 1), '#', 1)), '\', '/'), '/'), -1), '(?i)\.md$', ''))"
S = rf"""
p0 AS ({adapters.star_pages_sql('duckdb')}),
p AS (SELECT *, {STEM.format('path')} AS stem, path IN ('index.md', 'log.md', 'overview.md') AS is_config, string_split(path, '/') AS parts FROM p0),
l0 AS (SELECT path, regexp_extract_all(regexp_replace(body, '(?m)^[ \t]*<!--[^>]*-->[ \t]*$', '', 'g'), '\[\[([^\[\]\r\n]+?)\]\]', 1) AS r FROM p WHERE NOT is_config),
l AS (SELECT path, pos, raw, {STEM.format('raw')} AS stem FROM (SELECT path, unnest(r) AS raw, generate_subscripts(r, 1) - 1 AS pos FROM l0)),
stems AS (SELECT stem AS key, arg_min(path, parts) AS owner FROM p GROUP BY stem),
al AS (
  SELECT key, arg_min(stem, (parts, i)) AS stem FROM (SELECT {STEM.format('a')} AS key, stem, parts, i FROM (
    SELECT unnest(aliases) AS a, generate_subscripts(aliases, 1) AS i, stem, parts FROM p WHERE NOT is_config)) WHERE key <> '' GROUP BY key),
base AS (SELECT key, owner, 0 AS tier FROM stems UNION ALL SELECT al.key, s.owner, 1 FROM al JOIN stems s ON s.key = al.stem WHERE al.key NOT IN (SELECT key FROM stems)),
keys AS (
  SELECT * FROM base UNION ALL
  SELECT f, min(owner), 2 FROM (SELECT replace(lower(key), '_', '-') AS f, owner FROM base) WHERE f NOT IN (SELECT key FROM base) GROUP BY f HAVING min(owner) = max(owner)),
r AS (
  SELECT l.*, coalesce(a.owner, b.owner) AS owner FROM l LEFT JOIN keys a ON a.key = l.stem LEFT JOIN keys b ON a.key IS NULL AND b.key = replace(lower(l.stem), '_', '-')),
nodes AS (SELECT stem AS id, title, type, path FROM p WHERE NOT is_config),
edges AS (
  SELECT DISTINCT {STEM.format('path')} AS source, CASE WHEN owner IS NULL THEN stem ELSE {STEM.format('owner')} END AS target, owner IS NOT NULL AS resolved
  FROM r WHERE owner IS NULL OR owner NOT IN ('index.md', 'log.md', 'overview.md')),
und AS (SELECT DISTINCT least(source, target) AS u, greatest(source, target) AS v FROM edges WHERE resolved AND source <> target),
inl AS (SELECT n.id, count(e.source) AS n FROM (SELECT DISTINCT id FROM nodes) n LEFT JOIN edges e ON e.target = n.id AND e.resolved AND e.source <> e.target GROUP BY n.id),
deg AS (SELECT n.id, count(x.id) AS degree FROM (SELECT DISTINCT id FROM nodes) n LEFT JOIN (SELECT u AS id FROM und UNION ALL SELECT v FROM und) x ON x.id = n.id GROUP BY n.id)"""


def star(sql: str, recursive: str = "") -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{S}{', ' + recursive if recursive else ''} {sql}"


def _edges(spark, sf_dir):
    pages = adapters.star_kb(spark, sf_dir)
    return graph.graph_nodes(pages), graph.graph_edges(pages, fold=T.fold_ascii)


@query(star("SELECT path, pos, raw FROM l"))
def wikilinks(spark, sf_dir):
    return resolve.page_links(adapters.star_kb(spark, sf_dir)).select("path", "pos", "raw")


@query(star("SELECT DISTINCT raw, stem FROM l"))
def link_stems(spark, sf_dir):
    return resolve.page_links(adapters.star_kb(spark, sf_dir)).select("raw", "stem").distinct()


@query(star("SELECT key, stem FROM al"))
def alias_index(spark, sf_dir):
    return resolve.alias_index(adapters.star_kb(spark, sf_dir))


@query(star("SELECT key AS stem, owner AS path FROM stems"))
def stem_index(spark, sf_dir):
    return wiki.stem_index(adapters.star_kb(spark, sf_dir))


@query(star("SELECT key, owner, tier FROM keys"))
def resolution_table(spark, sf_dir):
    return resolve.resolution_table(adapters.star_kb(spark, sf_dir), T.fold_ascii)


@query(star("SELECT key, owner FROM keys WHERE tier = 2"))
def fold_variants(spark, sf_dir):
    return resolve.resolution_table(adapters.star_kb(spark, sf_dir), T.fold_ascii).where("tier = 2").select("key", "owner")


@query(star("SELECT path, pos, stem, owner FROM r"))
def resolve_links(spark, sf_dir):
    return graph.resolved_links(adapters.star_kb(spark, sf_dir), T.fold_ascii).select("path", "pos", "stem", "owner")


@query(star("SELECT * FROM nodes"))
def graph_nodes(spark, sf_dir):
    return graph.graph_nodes(adapters.star_kb(spark, sf_dir))


@query(star("SELECT * FROM edges"))
def link_edges(spark, sf_dir):
    return _edges(spark, sf_dir)[1]


@query(star("SELECT source, target FROM edges WHERE NOT resolved"))
def broken_edges(spark, sf_dir):
    return _edges(spark, sf_dir)[1].where("not resolved").select("source", "target")


@query(star("SELECT * FROM inl"))
def inlink_counts(spark, sf_dir):
    return graph.inlink_counts(*_edges(spark, sf_dir))


@query(star("SELECT path, n FROM nodes JOIN inl USING (id)"))
def backlinks(spark, sf_dir):
    return graph.backlinks(*_edges(spark, sf_dir))


@query(star("SELECT nodes.* FROM nodes JOIN inl USING (id) WHERE n = 0"))
def orphans(spark, sf_dir):
    return graph.orphans(*_edges(spark, sf_dir))


@query(star("SELECT * FROM deg"))
def undirected_degree(spark, sf_dir):
    return graph.degrees(*_edges(spark, sf_dir))


@query(star("SELECT id, degree FROM deg, (SELECT avg(degree) + 2.0 * stddev_pop(degree) AS bar FROM deg) WHERE degree >= bar AND degree >= 5"))
def hub_nodes(spark, sf_dir):
    return graph.hub_nodes(*_edges(spark, sf_dir))


@query(star(
    "SELECT n.id, coalesce(min(c.other), n.id) AS component FROM (SELECT DISTINCT id FROM nodes) n LEFT JOIN cc c ON c.id = n.id GROUP BY n.id",
    "both_ AS (SELECT u AS a, v AS b FROM und UNION ALL SELECT v, u FROM und), cc(id, other) AS (SELECT a, a FROM both_ WHERE a = (SELECT min(u) FROM und) UNION SELECT b, other FROM cc JOIN both_ ON a = id)"))
def components(spark, sf_dir):
    # every linked page of the star hangs together over regions and nations, so SQL walks from the least one alone
    return graph.components(*_edges(spark, sf_dir))


#: A star of customers around each nation; some nations are linked to the next one.  A star is one community as long as it has more than a
#: dozen or so customers, from sf0.01 on: by one link, two of them gain nothing from merging.
STARS = """
n AS (SELECT n_nationkey AS k, 'n' || lpad(n_nationkey::VARCHAR, 2, '0') AS id FROM nation),
c AS (SELECT 'c' || c_custkey AS id, c_nationkey AS k FROM customer),
ch AS (SELECT a.id AS u, b.id AS v, a.k FROM n a JOIN n b ON b.k = a.k + 1 WHERE a.k % 5 < 2),
mem AS (SELECT k, id FROM n UNION ALL SELECT k, id FROM c),
num AS (SELECT k, row_number() OVER (ORDER BY least) - 1 AS community FROM (SELECT k, min(id) AS least FROM mem GROUP BY k))"""


def _stars(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    name = lambda c: F.concat(F.lit("n"), F.lpad(F.col(c).cast("string"), 2, "0"))
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    links = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("source"), name("c_nationkey").alias("target"))
    following = n.select((F.col("n_nationkey") - 1).alias("k"), name("n_nationkey").alias("target"))
    chain = n.where("n_nationkey % 5 < 2").join(following, F.col("n_nationkey") == F.col("k")).select(name("n_nationkey").alias("source"), "target")
    edges = materialize(links.unionByName(chain).withColumn("resolved", F.lit(True)), "edges")
    ids = n.select(name("n_nationkey").alias("id")).unionByName(edges.select(F.col("source").alias("id"))).distinct()
    return ids.select("id", F.col("id").alias("title"), F.lit("entity").alias("type"), F.concat("id", F.lit(".md")).alias("path")), edges


@query(f"WITH {STARS} SELECT id, community FROM mem JOIN num USING (k)")
def communities(spark, sf_dir):
    return graph.communities(*_stars(spark, sf_dir))


@query(f"WITH {STARS} SELECT least(a.community, b.community) AS a, greatest(a.community, b.community) AS b, u, v FROM ch JOIN num a ON a.k = ch.k JOIN num b ON b.k = ch.k + 1")
def thin_links(spark, sf_dir):
    nodes, edges = _stars(spark, sf_dir)
    return graph.thin_links(edges, materialize(graph.communities(nodes, edges), "communities"))


@query(f"WITH {STARS} SELECT community, count(*) OVER (PARTITION BY community) AS size, id FROM mem JOIN num USING (k) WHERE k % 5 > 2")
def isolated_groups(spark, sf_dir):
    nodes, edges = _stars(spark, sf_dir)
    return graph.isolated_communities(edges, materialize(graph.communities(nodes, edges), "communities"))


@query(f"""WITH {STARS} SELECT (SELECT count(*) FROM mem) AS nodes, (SELECT count(*) FROM c) + (SELECT count(*) FROM ch) AS edges, 0::BIGINT AS broken, (SELECT count(*) FROM c) AS orphans,
(SELECT count(*) FROM num) AS communities, (SELECT count(*) FROM ch) AS bridges, (SELECT count(*) FROM n WHERE k % 5 = 1) AS cut_vertices""")
def graph_stats(spark, sf_dir):
    nodes, edges = _stars(spark, sf_dir)
    return graph.graph_stats(nodes, edges, materialize(graph.communities(nodes, edges), "communities"), materialize(graph.fragile_places(edges), "fragile"))


@query()  # tests hold communities against ordered moves
def kb_communities(spark, sf_dir):
    return graph.communities(*_edges(spark, sf_dir))


@query()
def kb_community_quality(spark, sf_dir):
    nodes, edges = _edges(spark, sf_dir)
    return graph.community_quality(edges, materialize(graph.communities(nodes, edges), "communities"))


# --- reports ---------------------------------------------------------------------------------------------------------------
INDEX = """
il AS (SELECT '- [' || title || '](' || path || ')' AS x, length(path) % 7 = 0 AS hidden FROM p WHERE NOT is_config AND length(path) % 9 <> 0
  UNION ALL SELECT * FROM (VALUES ('- [gone](entities/gone.md)', false), ('- [out](../out.md) [web](https://x.example/a.md)', false))),
tg AS (SELECT DISTINCT unnest(regexp_extract_all(x, '\\[[^\\[\\]\\r\\n]*\\]\\(([^()\\r\\n]*)\\)', 1)) AS target FROM il WHERE NOT hidden),
tl AS (SELECT target FROM tg WHERE target NOT LIKE '%://%')""".replace("\\\\", "\\")


def _index(pages: DataFrame) -> DataFrame:
    """Lines of an index of most pages, in the order of their paths; some are comments, the last two link elsewhere."""
    line = F.concat(F.lit("- ["), "title", F.lit("]("), "path", F.lit(")"))
    line = F.when(F.length("path") % 7 == 0, F.concat(F.lit("  <!-- "), line, F.lit(" -->"))).otherwise(line)
    listed = pages.where("not is_config and length(path) % 9 <> 0").select("path", line.alias("x"))
    ends = pages.sparkSession.createDataFrame([("~1", "- [gone](entities/gone.md)"), ("~2", "- [out](../out.md) [web](https://x.example/a.md)")], "path string, x string")
    return materialize(ranked(listed.unionByName(ends), "path", name="line").select(F.lit("index.md").alias("key"), "line", "x"), "index")


@query(star("SELECT target FROM tl", INDEX).replace("WITH RECURSIVE", "WITH"))
def index_link_scan(spark, sf_dir):
    return checks.index_targets(_index(adapters.star_kb(spark, sf_dir)))


@query(star("SELECT path AS page FROM p WHERE NOT is_config AND path NOT IN (SELECT target FROM tl)", INDEX).replace("WITH RECURSIVE", "WITH"))
def index_missing(spark, sf_dir):
    pages = adapters.star_kb(spark, sf_dir)
    return checks.index_missing(pages, checks.index_targets(_index(pages))).select("page")


@query(star("SELECT target AS detail FROM tl WHERE target NOT IN (SELECT path FROM p)", INDEX).replace("WITH RECURSIVE", "WITH"))
def index_dangling(spark, sf_dir):
    pages = adapters.star_kb(spark, sf_dir)
    return checks.index_dangling(pages, checks.index_targets(_index(pages))).select("detail")


#: Every document as an index: each line links what its letters spell; some open or close a comment, one way or another.
INDEXES = r"""x AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS n, unnest(l) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL AND text <> '')),
b AS (SELECT doc_id, n, length(x) % 7 AS k, regexp_replace(x, '[^A-Za-z]+', '', 'g') || '.md' AS target FROM x),
marks AS (SELECT doc_id, n, k, lead(k) OVER w AS nk, lead(n) OVER w AS nn FROM b WHERE k <= 2 WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
com AS (SELECT doc_id, unnest(range(n, nn + 1)) AS n FROM marks WHERE k = 0 AND nk = 1),
st AS (SELECT *, last_value(CASE WHEN k <= 2 THEN k END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b)"""


def _document_indexes(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "documents").where("text <> ''").select(F.col("doc_id").alias("key"), F.posexplode(F.split("text", "\n")).alias("line", "x"))
    target = F.concat(F.regexp_replace("x", "[^A-Za-z]+", ""), F.lit(".md"))
    link = F.concat(F.lit("- [n](./"), target, F.lit("#top) [w](https://e.x/"), target, F.lit(")"))
    k = F.length("x") % 7
    marked = F.when(k == 0, F.concat(F.lit("<!-- "), link)).when(k == 1, F.concat(link, F.lit(" --> "))).when(k == 2, F.concat(F.lit("see <!-- "), link)).otherwise(link)
    return materialize(lines.select("key", "line", marked.alias("x")), "indexes")


@query(f"WITH {INDEXES} SELECT DISTINCT doc_id AS key, target FROM b ANTI JOIN com USING (doc_id, n)")
def index_targets_by_document(spark, sf_dir):
    return index.targets(_document_indexes(spark, sf_dir))


@query(f"WITH {INDEXES} SELECT doc_id AS key, n::INTEGER AS line FROM st ANTI JOIN com USING (doc_id, n) WHERE k > 2 AND coalesce(before, 1) = 1 AND length(target) % 2 = 0")
def index_prune(spark, sf_dir):
    lines = _document_indexes(spark, sf_dir)
    return index.dangling_lines(lines, index.targets(lines).where("length(target) % 2 = 0"))


@query(star("SELECT path AS page, raw AS detail, pos FROM r WHERE owner IS NULL"))
def check_broken(spark, sf_dir):
    return checks.broken_occurrences(graph.resolved_links(adapters.star_kb(spark, sf_dir), T.fold_ascii)).select("page", "detail", "pos")


@query(star("SELECT path AS page, slug AS detail FROM (SELECT path, unnest(sources) AS slug FROM p WHERE NOT is_config) WHERE 'sources/' || slug || '.md' NOT IN (SELECT path FROM p)"))
def check_sources(spark, sf_dir):
    return checks.unresolved_sources(adapters.star_kb(spark, sf_dir)).select("page", "detail")


@query(star(f"SELECT path AS page, a AS detail FROM (SELECT path, unnest(aliases) AS a FROM p WHERE NOT is_config) WHERE {STEM.format('a')} IN (SELECT stem FROM p)"))
def check_alias_stem(spark, sf_dir):
    return checks.aliases_as_stems(adapters.star_kb(spark, sf_dir)).select("page", "detail")


@query(star(f"""SELECT DISTINCT path AS page, key || ' x' || n AS detail FROM (SELECT path, {STEM.format('a')} AS key FROM (SELECT path, unnest(aliases) AS a FROM p WHERE NOT is_config))
JOIN (SELECT {STEM.format('a')} AS key, count(*) AS n FROM (SELECT unnest(aliases) AS a FROM p WHERE NOT is_config) GROUP BY 1 HAVING count(*) > 1) USING (key)"""))
def check_alias_duplicates(spark, sf_dir):
    return checks.repeated_aliases(adapters.star_kb(spark, sf_dir)).select("page", "detail")


@query(star("""SELECT path AS page, n::VARCHAR AS detail FROM (
  SELECT path, list_sum(list_transform(list_filter(string_split(body, chr(10)), lambda x: NOT regexp_matches(trim(x), '^#{1,6}(\\s|$)')), lambda x: length(regexp_replace(x, '\\s', '', 'g')))) AS n
  FROM p WHERE NOT is_config) WHERE coalesce(n, 0) < 30""".replace("\\\\", "\\")))
def stub_pages(spark, sf_dir):
    return checks.stub_pages(adapters.star_kb(spark, sf_dir)).select("page", "detail")


@query(star("SELECT path AS page, parts[1] AS detail FROM p WHERE NOT is_config AND parts[1] NOT IN ('sources', 'entities', 'concepts', 'syntheses')"))
def uncharted_pages(spark, sf_dir):
    return checks.uncharted_pages(adapters.star_kb(spark, sf_dir)).select("page", "detail")


@query(star("""SELECT path AS page FROM p WHERE NOT is_config
  AND type <> CASE parts[1] WHEN 'sources' THEN 'source' WHEN 'entities' THEN 'entity' WHEN 'concepts' THEN 'concept' WHEN 'syntheses' THEN 'synthesis' ELSE type END"""))
def type_folder_mismatch(spark, sf_dir):
    return checks.type_folder_mismatches(adapters.star_kb(spark, sf_dir)).select("page")


MISSING = "me AS (SELECT target, count(DISTINCT source) AS ref_count, list_sort(list_distinct(list(path))) AS ref_pages FROM edges JOIN nodes ON id = source WHERE NOT resolved GROUP BY target HAVING count(DISTINCT source) >= 2)"


@query(star("SELECT target, ref_count, unnest(ref_pages) AS page FROM me", MISSING).replace("WITH RECURSIVE", "WITH"))
def missing_entities(spark, sf_dir):
    nodes, edges = _edges(spark, sf_dir)
    return checks.missing_entity_pages(edges, nodes)


@query(star("SELECT DISTINCT target, path AS page FROM edges JOIN nodes ON id = source WHERE NOT resolved"))
def missing_references(spark, sf_dir):
    nodes, edges = _edges(spark, sf_dir)
    return checks.missing_references(edges, nodes)


@query(star("SELECT target, rank, rank > 20 AS postponed FROM (SELECT target, row_number() OVER (ORDER BY ref_count DESC, target)::INT AS rank FROM me)", MISSING).replace("WITH RECURSIVE", "WITH"))
def heal_worklist(spark, sf_dir):
    nodes, edges = _edges(spark, sf_dir)
    return maintain.heal_worklist(checks.missing_entities(edges, nodes)).select("target", "rank", "postponed")


@query(star("""SELECT target, page, round(similarity, 9) AS similarity FROM (
  SELECT target, page, similarity, row_number() OVER (PARTITION BY target ORDER BY similarity DESC, page) AS n FROM (
    SELECT target, page, max(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))) AS similarity FROM tt, ff WHERE list_has_any(a, b)
      AND NOT EXISTS (SELECT 1 FROM edges e JOIN nodes n ON n.id = e.source WHERE NOT e.resolved AND e.target = tt.target AND n.path = ff.page) GROUP BY target, page)
  WHERE similarity >= 0.5) WHERE n = 1""", """
  tt AS (SELECT target, list_distinct(regexp_extract_all(lower(target), '[a-z0-9]+')) AS a FROM (SELECT DISTINCT target FROM edges WHERE NOT resolved)),
  ff AS (SELECT path AS page, list_distinct(regexp_extract_all(lower(x), '[a-z0-9]+')) AS b FROM (SELECT path, unnest([stem, title]) AS x FROM p WHERE NOT is_config))""").replace("WITH RECURSIVE", "WITH"))
def nearest_page(spark, sf_dir):
    pages = adapters.star_kb(spark, sf_dir)
    nodes, edges = graph.graph_nodes(pages), graph.graph_edges(pages, fold=T.fold_ascii)
    broken = edges.where("not resolved")
    named = broken.join(nodes.select(F.col("id").alias("source"), F.col("path").alias("page")), "source").select("target", "page").distinct()
    out = search.nearest_pages(broken.select("target").distinct(), search.documents_of(pages), named)
    return out.withColumn("similarity", F.round("similarity", 9))


@query(star("""SELECT target, page, round(similarity, 9) AS similarity FROM (
  SELECT target, page, similarity, row_number() OVER (PARTITION BY target ORDER BY similarity DESC, page) AS n FROM (
    SELECT target, page, max(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))) AS similarity FROM tt, ff WHERE list_has_any(a, b) GROUP BY target, page)
  WHERE similarity >= 0.5) WHERE n = 1""", """
  tt AS (SELECT target, list_distinct(regexp_extract_all(lower(target), '[a-z0-9]+')) AS a FROM (
    SELECT 'old ' || s_name || ' inc' AS target FROM supplier UNION SELECT c_name || ' ltd' FROM customer UNION SELECT 'the ' || p_name || ' new' FROM part UNION SELECT n_name || ' of ' || n_name || ' and more' FROM nation)),
  ff AS (SELECT path AS page, list_distinct(regexp_extract_all(lower(x), '[a-z0-9]+')) AS b FROM (SELECT path, unnest([stem, title]) AS x FROM p WHERE NOT is_config))""").replace("WITH RECURSIVE", "WITH"))
def nearest_title(spark, sf_dir):
    pages = adapters.star_kb(spark, sf_dir)
    name = lambda t, *parts: table(spark, sf_dir, t).select(F.concat(*[F.col(x) if x.endswith("_name") else F.lit(x) for x in parts]).alias("target"))
    asked = name("supplier", "old ", "s_name", " inc").unionByName(name("customer", "c_name", " ltd")).unionByName(name("part", "the ", "p_name", " new")).unionByName(name("nation", "n_name", " of ", "n_name", " and more"))
    return search.nearest_pages(asked.distinct(), search.documents_of(pages)).withColumn("similarity", F.round("similarity", 9))


@query()  # its parts have queries with SQL, its order a test
def lint_report(spark, sf_dir):
    pages = adapters.star_kb(spark, sf_dir)
    return checks.lint(pages, search.documents_of(pages), T.fold_ascii)


@query(star("""SELECT CASE WHEN parts[1] = 'misc' THEN 'Misc' WHEN parts[1] = 'sources' THEN 'Sources' WHEN parts[1] = 'entities' THEN 'Entities' ELSE 'Concepts' END AS section, path,
  '- [' || title || '](' || path || ')' || CASE WHEN len(aliases) > 0 THEN ' — ' || array_to_string(aliases, ', ') ELSE '' END AS line
  FROM p WHERE NOT is_config AND path NOT IN (SELECT target FROM tl)""", INDEX).replace("WITH RECURSIVE", "WITH"))
def reindex_plan(spark, sf_dir):
    pages = adapters.star_kb(spark, sf_dir)
    missing = checks.index_missing(pages, checks.index_targets(_index(pages))).select(F.col("page").alias("path"))
    return maintain.index_plan(pages.join(missing, "path", "left_semi"))


@query(star("""SELECT path, CASE WHEN path = 'sources/part_20.md' THEN 'delete' WHEN list_distinct(sources) = ['part_20'] THEN 'orphan' ELSE 'drop_slug' END AS action
  FROM p WHERE NOT is_config AND (path = 'sources/part_20.md' OR list_contains(sources, 'part_20'))"""))
def remove_plan(spark, sf_dir):
    return maintain.remove_plan(adapters.star_kb(spark, sf_dir), "part_20")


@query(star("SELECT path, title, type FROM p WHERE NOT is_config"))
def page_list(spark, sf_dir):
    return wiki.page_list(adapters.star_kb(spark, sf_dir))


@query(star("SELECT path, list_sort(list_distinct(sources))::VARCHAR AS sources, length(body) AS body_len FROM p WHERE NOT is_config"))
def page_meta(spark, sf_dir):
    out = wiki.page_meta_snapshot(adapters.star_kb(spark, sf_dir))
    return out.select("path", F.concat(F.lit("["), F.array_join("sources", ", "), F.lit("]")).alias("sources"), "body_len")


# --- snapshots and drift over documents ---------------------------------------------------------------------------------------
SNAP = """
b AS (SELECT 'sources/doc-' || doc_id || '.md' AS path, text, [source] AS sources, doc_id FROM documents),
a AS (
  SELECT path, CASE WHEN doc_id % 7 = 0 THEN left(text, length(text) // 3) ELSE text END AS text, CASE WHEN doc_id % 11 = 0 THEN [] ELSE sources END AS sources, doc_id FROM b WHERE doc_id % 10 <> 0
  UNION ALL SELECT 'sources/new-' || doc_id || '.md', text, sources, doc_id FROM b WHERE doc_id % 13 = 0),
fb AS (SELECT path, sha256(text) AS fp, sources, length(text) AS body_len, doc_id FROM b), fa AS (SELECT path, sha256(text) AS fp, sources, length(text) AS body_len FROM a)"""


def _snapshots(spark, sf_dir):
    """Before: the documents; after: some gone, some cut, some without sources, some new."""
    d = table(spark, sf_dir, "documents")
    path = lambda p: F.concat(F.lit(f"sources/{p}-"), F.col("doc_id").cast("string"), F.lit(".md"))
    b = d.select(path("doc").alias("path"), "text", F.array("source").alias("sources"), "doc_id")
    cut = F.when(F.col("doc_id") % 7 == 0, F.left("text", F.floor(F.char_length("text") / 3))).otherwise(F.col("text"))
    kept = b.where("doc_id % 10 <> 0").select("path", cut.alias("text"), F.when(F.col("doc_id") % 11 == 0, F.array().cast("array<string>")).otherwise(F.col("sources")).alias("sources"), "doc_id")
    a = kept.unionByName(b.where("doc_id % 13 = 0").select(path("new").alias("path"), "text", "sources", "doc_id"))
    mark = lambda x: x.select("path", F.sha2(F.encode("text", "UTF-8"), 256).alias("fp"), "sources", F.char_length("text").cast("long").alias("body_len"), "doc_id")
    return mark(b), mark(a)


@query(f"""WITH {SNAP} SELECT coalesce(fb.path, fa.path) AS path, CASE WHEN fa.path IS NULL THEN 'removed' WHEN fb.path IS NULL THEN 'added' ELSE 'modified' END AS change
FROM fb FULL JOIN fa ON fa.path = fb.path WHERE fa.path IS NULL OR fb.path IS NULL OR fa.fp <> fb.fp""")
def snapshot_diff(spark, sf_dir):
    return maintain.snapshot_diff(*_snapshots(spark, sf_dir))


@query(f"WITH {SNAP} SELECT fb.path AS page, 'sources.dropped' AS kind, unnest(fb.sources) AS detail FROM fb JOIN fa USING (path) WHERE len(fa.sources) = 0")
def source_regression(spark, sf_dir):
    return maintain.source_regressions(*_snapshots(spark, sf_dir))


@query(f"WITH {SNAP} SELECT path, fb.body_len AS b0, fa.body_len AS b1 FROM fb JOIN fa USING (path) WHERE fb.body_len >= 200 AND fa.body_len < 0.5 * fb.body_len")
def body_shrink(spark, sf_dir):
    return maintain.body_shrinks(*_snapshots(spark, sf_dir))


@query(f"""WITH {SNAP}, v0 AS (SELECT DISTINCT path AS page, 'short' AS kind, 'x' AS detail FROM fb WHERE body_len < 500), v1 AS (SELECT DISTINCT path AS page, 'short' AS kind, 'x' AS detail FROM fa WHERE body_len < 500)
SELECT *, 'blocking' AS severity FROM (SELECT * FROM v1 EXCEPT SELECT * FROM v0)""")
def new_violations(spark, sf_dir):
    rows = lambda x: x.where("body_len < 500").select(F.col("path").alias("page"), F.lit("short").alias("kind"), F.lit("x").alias("detail"))
    return maintain.new_violations(*map(rows, _snapshots(spark, sf_dir)))


DRIFT = f"""{SNAP},
dr AS (SELECT 'doc-' || fb.doc_id AS slug, fb.path AS page, 'raw/' || fb.path AS raw_path FROM fb JOIN fa USING (path) WHERE fa.fp <> fb.fp),
cites AS (SELECT 'entities/e-' || (doc_id % 97) || '.md' AS page, 'doc-' || doc_id AS slug FROM fb UNION ALL SELECT path, 'doc-' || (doc_id * 3) FROM fb),
cd AS (SELECT page, CASE WHEN page IN (SELECT page FROM dr) THEN 'source-drift' ELSE 'cites-drifted-source' END AS reason, slug
  FROM (SELECT page, slug FROM dr UNION SELECT page, slug FROM cites WHERE slug IN (SELECT slug FROM dr)))"""


def _drift(spark, sf_dir):
    before, after = _snapshots(spark, sf_dir)
    raw = F.concat(F.lit("raw/"), "path")
    pages = before.select("path", T.format_digest(raw, "fp").alias("raw_digest"))
    drifted = maintain.drifted_sources(pages, after.select(raw.alias("path"), "fp"))
    cites = before.groupBy(F.concat(F.lit("entities/e-"), (F.col("doc_id") % 97).cast("string"), F.lit(".md")).alias("path")).agg(F.collect_list(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("sources"))
    own = before.select("path", F.array(F.concat(F.lit("doc-"), (F.col("doc_id") * 3).cast("string"))).alias("sources"))  # source pages cite as well
    return drifted, maintain.drift_candidates(drifted, cites.unionByName(own))


@query(f"WITH {DRIFT} SELECT * FROM dr")
def drifted_sources(spark, sf_dir):
    return _drift(spark, sf_dir)[0]


@query(f"WITH {DRIFT} SELECT page, reason, array_to_string(list_sort(list(slug)), ',') AS slugs FROM cd GROUP BY page, reason")
def drift_propagation(spark, sf_dir):
    return _drift(spark, sf_dir)[1].select("page", "reason", F.array_join("slugs", ",").alias("slugs"))


@query(f"WITH {DRIFT} SELECT dr.slug, dr.page AS source_page, raw_path, array_to_string(list_sort(list_distinct(list(cd.page))), ',') AS members FROM dr JOIN cd ON cd.slug = dr.slug GROUP BY ALL")
def audit_groups(spark, sf_dir):
    drifted, candidates = _drift(spark, sf_dir)
    return maintain.audit_groups(candidates, drifted).withColumn("members", F.array_join("members", ","))


@query(f"WITH {DRIFT} SELECT page, array_to_string(list_sort(list_distinct(list(cd.slug))), ',') AS slugs, array_to_string(list_sort(list_distinct(list(raw_path))), ',') AS raw_paths FROM cd JOIN (SELECT slug, raw_path FROM dr) x ON x.slug = cd.slug GROUP BY page")
def audit_targets(spark, sf_dir):
    drifted, candidates = _drift(spark, sf_dir)
    return maintain.audit_targets(maintain.audit_groups(candidates, drifted)).select("page", F.array_join("slugs", ",").alias("slugs"), F.array_join("raw_paths", ",").alias("raw_paths"))


@query("SELECT doc_id, lang || '/' || source AS path, sha256(coalesce(text, '')) AS sha256 FROM documents")
def digest_parse(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.parse_digest(T.format_digest(F.concat_ws("/", "lang", "source"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256))).alias("d"))
    return d.select("doc_id", "d.path", "d.sha256")


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9_.\-]+', '-', 'g'), '-+', '-', 'g'), '-.') AS slug FROM pages")
def raw_slug(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.raw_slug("url").alias("slug"))


@query(r"""WITH x AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(split_part(url, '?', 1), '^.*/', ''), '[^a-zA-Z0-9_.\-]+', '-', 'g'), '-+', '-', 'g'), '-.') AS slug FROM pages)
SELECT DISTINCT a.slug, a.page_id::VARCHAR AS path, b.page_id::VARCHAR AS other FROM x a JOIN x b ON a.slug = b.slug AND a.page_id <> b.page_id""")
def slug_collision(spark, sf_dir):
    name = F.regexp_extract(F.split_part("url", F.lit("?"), F.lit(1)), r"([^/]*)$", 1)
    return resolve.slug_collisions(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), T.raw_slug(name).alias("slug")))


@query(r"SELECT doc_id, length(trim(text)) > 0 AND strlen(text) <= 5242880 AND NOT regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]') AS admitted FROM documents")
def text_admission(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.text_admitted("text").alias("admitted"))


# --- images, messages and sessions -----------------------------------------------------------------------------------------------
REFS = r"rf AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '(?:href|src)=\x22/?([A-Za-z0-9_./\-]+)\x22', 1))) AS ref FROM pages), fl AS (SELECT DISTINCT ref AS path FROM rf WHERE length(ref) % 2 = 0 UNION SELECT 'unused/' || page_id || '.png' FROM pages)"


def _refs(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    refs = pages.select(F.col("page_id").alias("page"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'(?:href|src)="/?([A-Za-z0-9_./\-]+)"'), F.lit(1)))).alias("ref"))
    files = refs.where("length(ref) % 2 = 0").select(F.col("ref").alias("path")).distinct().unionByName(pages.select(F.concat(F.lit("unused/"), F.col("page_id").cast("string"), F.lit(".png")).alias("path")))
    return refs, files


@query(f"WITH {REFS} SELECT path FROM fl WHERE path NOT IN (SELECT ref FROM rf)")
def image_gc(spark, sf_dir):
    refs, files = _refs(spark, sf_dir)
    return maintain.image_garbage(files, refs)


LINT = r"""rr AS (SELECT 'parsed/page-' || page_id || '.md' AS page, page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\x22/?([^\x22]*)\x22', 1))) AS href FROM pages),
rf AS (SELECT page, page_id, href, '../images/x/' || href || '.png' AS ref FROM rr UNION ALL SELECT page, page_id, href, 'images/page-' || page_id || '/' || href || '.PNG' FROM rr UNION ALL SELECT page, page_id, href, 'https://e.x/' || href FROM rr),
fl AS (SELECT DISTINCT 'images/x/' || lower(href) || '.png' AS path FROM rr WHERE length(href) % 3 = 0 UNION SELECT DISTINCT 'images/y/' || href || '.png' FROM rr WHERE length(href) % 5 = 0
  UNION SELECT 'parsed/images/page-' || page_id || '/' || href || '.PNG' FROM rr WHERE length(href) % 2 = 0)"""


@query(rf"""WITH {LINT}, nm AS (SELECT lower(regexp_extract(path, '([^/]+)$', 1)) AS name, count(*) AS n FROM fl WHERE path LIKE 'images/%' GROUP BY 1),
p AS (SELECT page, ref, CASE WHEN ref LIKE '../%' THEN substr(ref, 4) ELSE 'parsed/' || ref END AS path, lower(regexp_extract(ref, '([^/]*)$', 1)) AS name, 'parsed/images/page-' || page_id || '/' AS own FROM rf WHERE ref NOT LIKE 'https:%')
SELECT page, ref, CASE WHEN path IN (SELECT path FROM fl) THEN CASE WHEN starts_with(path, own) THEN 'ok' ELSE 'misplaced' END WHEN n = 1 THEN 'misplaced' ELSE 'dangling' END AS state FROM p LEFT JOIN nm USING (name)""")
def image_lint(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("parsed/page-"), F.col("page_id").cast("string"), F.lit(".md")).alias("page"), "page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/?([^"]*)"'), F.lit(1)))).alias("href"))
    own = F.concat(F.lit("images/page-"), F.col("page_id").cast("string"), F.lit("/"), "href", F.lit(".PNG"))
    refs = rows.select("page", F.explode(F.array(F.concat(F.lit("../images/x/"), "href", F.lit(".png")), own, F.concat(F.lit("https://e.x/"), "href"))).alias("ref"))
    size = F.char_length("href")
    files = rows.where(size % 3 == 0).select(F.concat(F.lit("images/x/"), F.lower("href"), F.lit(".png")).alias("path")).unionByName(
        rows.where(size % 5 == 0).select(F.concat(F.lit("images/y/"), "href", F.lit(".png")).alias("path"))).unionByName(rows.where(size % 2 == 0).select(F.concat(F.lit("parsed/"), own).alias("path")))
    return maintain.image_lint(refs, files)


MSGS = "m AS (SELECT event_id AS msg_id, user_id AS session, ts, CASE event_type WHEN 'purchase' THEN '/search ' WHEN 'error' THEN '/unknown ' ELSE '' END || event_type AS text FROM events)"


def _msgs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.concat(F.when(F.col("event_type") == "purchase", "/search ").when(F.col("event_type") == "error", "/unknown ").otherwise(""), "event_type")
    return e.select(F.col("event_id").alias("msg_id"), F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"), text.alias("text"))


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'search' ELSE 'prose' END AS kind, CASE event_type WHEN 'error' THEN '/unknown error' ELSE event_type END AS argument FROM events")
def command_classify(spark, sf_dir):
    return _msgs(spark, sf_dir).select(F.col("msg_id").alias("event_id"), F.inline(F.array(T.command("text"))))


@query(f"""WITH {MSGS}, g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session ORDER BY ts, msg_id) AS idle FROM m)
SELECT msg_id, session, CASE WHEN idle IS NULL THEN 'first' WHEN idle > 1800000000 THEN 'expired' ELSE 'existing' END AS state FROM g""")
def session_state(spark, sf_dir):
    return sessions.session_states(_msgs(spark, sf_dir)).select("msg_id", "session", "state")


@query(f"""WITH {MSGS}, w AS (SELECT *, text LIKE '/search %' AS cmd, lag(epoch_us(ts) + 3600000000) OVER o AS due, lag(text LIKE '/search %') OVER o AS before FROM m WINDOW o AS (PARTITION BY session ORDER BY ts, msg_id)),
p AS (SELECT *, sum(CASE WHEN due IS NULL OR epoch_us(ts) >= due OR cmd OR before THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts, msg_id) AS part FROM w)
SELECT session, count(*) AS n, string_agg(text, chr(10) ORDER BY ts, msg_id) AS text, min(msg_id) AS first_id FROM p GROUP BY session, part""")
def debounce_merge(spark, sf_dir):
    msgs = _msgs(spark, sf_dir)
    out = sessions.debounce(msgs, 3600.0, 3600.0)
    ids = msgs.groupBy("session", F.col("ts").alias("first_ts")).agg(F.min("msg_id").alias("first_id"))
    return out.join(ids, ["session", "first_ts"]).select("session", "n", "text", "first_id")


#: Accepted times of each id: its first, and again and again the first past the span.
SEEN = """m AS (SELECT event_id, epoch_us(ts) AS us, user_id || event_type AS msg_id FROM events),
seen(msg_id, us) AS (SELECT msg_id, min(us) FROM m GROUP BY msg_id
  UNION ALL SELECT s.msg_id, min(m.us) FROM seen s JOIN m ON m.msg_id = s.msg_id AND m.us > s.us + {0} GROUP BY s.msg_id)"""


def _sent(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.col("user_id").cast("string"), "event_type").alias("msg_id"))


@query(f"WITH RECURSIVE {SEEN.format(10**15)} SELECT count(*) AS kept FROM seen")
def msg_first_seen(spark, sf_dir):
    return sessions.dedup_messages(_sent(spark, sf_dir), seconds=10**9).agg(F.count("*").alias("kept"))


@query(f"WITH RECURSIVE {SEEN.format(86_400_000_000)} SELECT min(event_id) AS event_id, msg_id FROM seen JOIN m USING (msg_id, us) GROUP BY msg_id, us")
def msg_dedup(spark, sf_dir):
    return sessions.dedup_messages(_sent(spark, sf_dir), seconds=86_400).select("event_id", "msg_id")


@query("SELECT event_id, user_id % 3 <> 0 AND (user_id % 2 = 0 OR (event_type IN ('click', 'view') AND value > 50)) AS permitted FROM events")
def access_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ok = T.access_permitted(F.when(F.col("user_id") % 3 != 0, "u").otherwise("x"), F.col("event_type"), F.col("user_id") % 2 != 0, F.col("value") > 50, ["u"], ["click", "view"])
    return e.select("event_id", ok.alias("permitted"))


@query(rf"""WITH m0 AS (SELECT conv_id * 1000 + turn AS id, '[[' || replace(substr(text, 1, 12), chr(10), ' ') || '|x]] and [[' || role || ']] and [[' || role || '#a|b]]' AS text FROM conversations),
m1 AS (SELECT id, unnest(r) AS raw, generate_subscripts(r, 1) - 1 AS pos FROM (SELECT id, regexp_extract_all(text, '\[\[([^\[\]\r\n]+?)\]\]', 1) AS r FROM m0)),
m2 AS (SELECT id, pos, {STEM.format('raw')} AS stem FROM m1)
SELECT id, pos, stem FROM m2 WHERE stem <> '' QUALIFY row_number() OVER (PARTITION BY id, stem ORDER BY pos) = 1""")
def ordered_mentions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    text = F.concat(F.lit("[["), F.replace(F.substring("text", 1, 12), F.lit("\n"), F.lit(" ")), F.lit("|x]] and [["), "role", F.lit("]] and [["), "role", F.lit("#a|b]]"))
    return resolve.ordered_mentions(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), text.alias("text"))).select("id", "pos", "stem")


@query("SELECT event_id, ts::DATE AS date, event_type AS op, user_id::VARCHAR AS title FROM events")
def log_timeline(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.concat(F.lit("## ["), F.date_format("ts", "yyyy-MM-dd"), F.lit("] "), "event_type", F.lit(" | "), F.col("user_id").cast("string"))
    return e.select("event_id", T.log_entry(line).alias("l")).select("event_id", "l.date", "l.op", "l.title")


@query()
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_text("html").alias("text"))
