"""Knowledge bases made of the driver's tables, in SQL that Spark and DuckDB share but for a few function names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.plans.store import materialize, spread

NAMES = {
    "spark": {"joined": "array_join(array_sort(collect_set({0})), ' ')", "set": "array_sort(collect_set({0}))", "nl": "'\\n'", "none": "cast(array() as array<string>)", "list": "array({0})"},
    "duckdb": {"joined": "array_to_string(list_sort(list_distinct(list({0}))), ' ')", "set": "list_sort(list_distinct(list({0})))", "nl": "chr(10)", "none": "[]::VARCHAR[]", "list": "[{0}]"},
}


def star_pages_sql(dialect: str) -> str:
    """One page per region, nation, supplier, customer and part, linked as their keys are; large parts have no page."""
    n = NAMES[dialect]
    nl, none = n["nl"], n["none"]
    one = lambda x: n["list"].format(x)
    sold = "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem"
    link = n["joined"].format("concat('[[Part-', cast(l_partkey as string), '|part ', cast(l_partkey as string), ']]')")
    cited = n["set"].format("CASE WHEN l_partkey % 20 = 0 THEN concat('part_', cast(l_partkey as string)) END")
    sql = f"""
SELECT concat('concepts/region-', cast(r_regionkey as string), '.md') AS path, r_name AS title, 'concept' AS type, {none} AS aliases, {none} AS sources,
  concat('# ', r_name, {nl}, 'See [[index]] and [[overview|the start]].') AS body FROM region
UNION ALL SELECT concat('entities/nation-', cast(n_nationkey as string), '.md'), n_name, 'entity', {one('n_name')}, {none},
  concat('Lies in [[region-', cast(n_regionkey as string), '|home]].') FROM nation
UNION ALL SELECT concat('entities/supplier-', cast(s_suppkey as string), '.md'), s_name, 'entity', {none}, coalesce(cited, {none}),
  concat('Based in [[nation_', cast(s_nationkey as string), ']].', {nl}, '<!-- [[ghost-', cast(s_suppkey as string), ']] -->', {nl}, 'Sells ', coalesce(sold, 'nothing'), '.')
  FROM supplier LEFT JOIN (SELECT l_suppkey, {link} AS sold, {cited} AS cited FROM ({sold}) x GROUP BY l_suppkey) y ON l_suppkey = s_suppkey
UNION ALL SELECT concat('entities/customer-', cast(c_custkey as string), '.md'), c_name, 'entity', {none}, {none},
  concat('Lives in [[entities/nation-', cast(c_nationkey as string), '.md#home]]. Buys for [[', c_mktsegment, ']].') FROM customer
UNION ALL SELECT concat(CASE WHEN p_size = 7 THEN 'misc' ELSE 'sources' END, '/part_', cast(p_partkey as string), '.md'), p_name, CASE WHEN p_size % 10 = 0 THEN 'concept' ELSE 'source' END,
  {one("concat('sku ', cast(p_partkey % 500 as string))")}, {none}, concat('## ', p_name, {nl}, p_type, ' ', CASE WHEN p_size > 12 THEN p_brand ELSE '' END) FROM part WHERE p_size <= 25
UNION ALL SELECT 'index.md', 'Index', 'synthesis', {none}, {none}, ''
UNION ALL SELECT 'log.md', 'Log', 'synthesis', {none}, {none}, ''
UNION ALL SELECT 'overview.md', 'Overview', 'synthesis', {none}, {none}, ''"""
    return sql.replace("as string)", "as VARCHAR)") if dialect == "duckdb" else sql


def with_views(spark: SparkSession, sf_dir: str, sql: str, tables: tuple[str, ...]) -> DataFrame:
    """``sql`` over tables of a folder, each named in the text by its bare name."""
    for t in tables:
        sql = _named(sql, t, f"parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(sql)


def _named(sql: str, table: str, to: str) -> str:
    import re

    return re.sub(rf"(?i)\b(FROM|JOIN) {table}\b", lambda m: f"{m[1]} {to}", sql)


def as_pages(rows: DataFrame) -> DataFrame:
    """Page rows with the metadata columns that the operators know, as well-formed pages have them."""
    kind = lambda k: F.lit(k)
    return rows.withColumns({
        "stem": T.link_stem("path"), "is_config": F.col("path").isin("index.md", "log.md", "overview.md"), "ok": F.lit(True), "strict_error": F.lit(None).cast("string"),
        "tags": F.array().cast("array<string>"), "title_kind": kind("str"), "type_kind": kind("str"), "tags_kind": kind("list_str"), "aliases_kind": kind("list_str"),
        "sources_kind": kind("list_str"), "last_updated": kind("2024-01-01"), "last_updated_kind": kind("str"),
        "keys": F.array(*[F.lit(k) for k in ("title", "type", "tags", "sources", "last_updated", "aliases")])})


def star_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star's pages, written once: resolution, links and nodes each read the columns they need."""
    return materialize(as_pages(with_views(spark, sf_dir, star_pages_sql("spark"), ("region", "nation", "supplier", "customer", "part", "lineitem"))).repartition("path"), "pages")


def docs_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page, title, type, body, aliases)``: documents as source pages, their first six words as title."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    words = F.slice(F.split(F.coalesce("text", F.lit("")), r"[\s]+"), 1, 6)
    return docs.select(
        F.concat(F.lit("sources/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("page"), F.array_join(words, " ").alias("title"), F.lit("source").alias("type"),
        F.coalesce("text", F.lit("")).alias("body"), F.array().cast("array<string>").alias("aliases"), F.array("source").alias("sources"), "doc_id")


DOCS_SQL = r"""
docs AS (
  SELECT 'sources/doc-' || doc_id || '.md' AS page, array_to_string(list_slice(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), 1, 6), ' ') AS title,
    coalesce(text, '') AS body, source, doc_id FROM documents),
toks AS (
  SELECT page, regexp_extract_all(lower(body), '[a-z0-9]+') AS b, regexp_extract_all(lower(title), '[a-z0-9]+') AS t FROM docs),
post AS (
  SELECT page, term, sum(w)::BIGINT AS tf FROM (
    SELECT page, unnest(b) AS term, 1 AS w FROM toks UNION ALL SELECT page, unnest(t), 3 FROM toks) GROUP BY page, term),
dl AS (SELECT page, len(b)::BIGINT AS dl FROM toks)"""
