"""Validators, health and lint reports: each finding is a row, each rule a plan.

Blocking rows are (page, kind, detail); advisory ones carry a suggestion too.  Details are our own wording.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import graph as G
from lorekeep.operators import index
from lorekeep.operators.search import nearest_pages
from lorekeep.plans.store import materialize
from lorekeep.sources.wiki import page_order

REQUIRED = ("title", "type", "tags", "sources", "last_updated")
TYPES = ("source", "entity", "concept", "synthesis")
#: The folder of each page type, and the order in which kinds are told.
FOLDERS = {"sources": "source", "entities": "entity", "concepts": "concept", "syntheses": "synthesis"}
ORDER = (
    "health.index_dangling", "health.index_missing_page", "health.type_dir_mismatch", "health.uncharted_page", "health.stub_page", "lint.broken_link", "lint.missing_entity",
    "lint.orphan", "lint.isolated_community", "lint.bridge_edge", "lint.cut_vertex", "lint.thin_intercommunity_link", "lint.hub_node")
STUB_CHARS, MISSING_REFS = 30, 2


def _rows(df: DataFrame, page, kind, detail, step: int, pos=None) -> DataFrame:
    text = lambda x: x if not isinstance(x, str) else F.lit(x)
    return df.select(page.alias("page"), text(kind).alias("kind"), detail.cast("string").alias("detail"), F.lit(step).alias("step"), (F.lit(0) if pos is None else pos).cast("int").alias("pos"))


def unreadable(pages: DataFrame) -> DataFrame:
    bad = pages.where("not is_config and strict_error is not null")
    return _rows(bad, F.col("path"), F.concat(F.lit("frontmatter."), "strict_error"), F.lit("the page has no usable frontmatter"), 1)


def missing_keys(pages: DataFrame) -> DataFrame:
    rows = pages.where("not is_config and ok").select("path", F.posexplode(F.array_except(F.array(*map(F.lit, REQUIRED)), "keys")).alias("pos", "key"))
    return _rows(rows, F.col("path"), "frontmatter.missing_key", F.col("key"), 1, F.col("pos"))


def bad_types(pages: DataFrame) -> DataFrame:
    """Fields of a wrong type or value, for keys that are there."""
    there = lambda k: F.col(f"{k}_kind") != "missing"
    blank = F.exists("aliases", lambda a: F.length(T.strip(a)) == 0)
    dated = (F.col("last_updated_kind") == "date") | ((F.col("last_updated_kind") == "str") & F.col("last_updated").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    wrong = [
        ("title", there("title") & ~((F.col("title_kind") == "str") & (F.length(T.strip("title")) > 0))),
        ("type", there("type") & ~((F.col("type_kind") == "str") & F.col("type").isin(*TYPES))),
        ("tags", there("tags") & ~F.col("tags_kind").isin("list_str", "list_mixed")),
        ("sources", there("sources") & (F.col("sources_kind") != "list_str")),
        ("last_updated", there("last_updated") & ~dated),
        ("aliases", there("aliases") & ((F.col("aliases_kind") != "list_str") | F.coalesce(blank, F.lit(False))))]
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in wrong]))
    rows = pages.where("not is_config and ok").select("path", F.posexplode(found).alias("pos", "key"))
    return _rows(rows, F.col("path"), "frontmatter.bad_type", F.col("key"), 1, F.col("pos") + 100)


def broken_occurrences(links: DataFrame) -> DataFrame:
    return _rows(links.where("owner is null"), F.col("path"), "wikilink.broken", F.col("raw"), 3, F.col("pos"))


def unresolved_sources(pages: DataFrame) -> DataFrame:
    rows = pages.where("not is_config and ok and sources_kind = 'list_str'").select("path", F.posexplode("sources").alias("pos", "slug"))
    known = pages.where("path rlike '^sources/[^/]+[.]md$'").select(F.regexp_extract("path", r"^sources/(.+)\.md$", 1).alias("slug")).distinct()
    bad = rows.join(known, "slug", "left_anti")
    return _rows(bad, F.col("path"), "sources.unresolved", F.col("slug"), 4, F.col("pos"))


def aliases_as_stems(pages: DataFrame) -> DataFrame:
    rows = pages.where("not is_config").select("path", F.posexplode("aliases").alias("pos", "alias")).withColumn("stem", T.link_stem("alias"))
    hit = rows.join(pages.select("stem").distinct(), "stem", "left_semi")
    return _rows(hit, F.col("path"), "aliases.collides_stem", F.col("alias"), 2, F.col("pos"))


def repeated_aliases(pages: DataFrame) -> DataFrame:
    """One row for each owner of an alias that is declared more than once."""
    rows = pages.where("not is_config").select("path", F.explode("aliases").alias("alias")).select("path", T.link_stem("alias").alias("key")).where("key <> ''")
    many = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    found = rows.distinct().join(many, "key")
    return _rows(found, F.col("path"), "aliases.duplicate", F.concat_ws(" x", "key", F.col("n").cast("string")), 9)


def check(pages: DataFrame, fold=T.fold_stem) -> DataFrame:
    """All blocking rows in report order: by page and step, then what concerns several pages, by alias."""
    parts = [unreadable(pages), missing_keys(pages), bad_types(pages), aliases_as_stems(pages), broken_occurrences(G.resolved_links(pages, fold)), unresolved_sources(pages), repeated_aliases(pages)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    last = F.col("step") == 9
    return out.orderBy(last, F.when(last, F.col("detail")), page_order("page"), "step", "pos", "kind").select("page", "kind", "detail")


def stub_pages(pages: DataFrame) -> DataFrame:
    n = T.substantive_chars("body")
    return _rows(pages.where("not is_config").where(n < STUB_CHARS), F.col("path"), "health.stub_page", n, 0)


def uncharted_pages(pages: DataFrame) -> DataFrame:
    top = F.when(F.contains("path", F.lit("/")), F.split_part("path", F.lit("/"), F.lit(1))).otherwise("")
    return _rows(pages.where("not is_config").where(~top.isin(*FOLDERS)), F.col("path"), "health.uncharted_page", top, 0)


def type_folder_mismatches(pages: DataFrame) -> DataFrame:
    folder = F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv])[F.split_part("path", F.lit("/"), F.lit(1))]
    rows = pages.where("not is_config and ok").where(F.contains("path", F.lit("/")) & folder.isNotNull() & F.col("type").isin(*TYPES) & (F.col("type") != folder))
    return _rows(rows, F.col("path"), "health.type_dir_mismatch", F.concat_ws(" in a folder of ", "type", folder), 0)


def index_targets(lines: DataFrame) -> DataFrame:
    """``(target)`` of an index that is a table of lines, or of its text where that is one row."""
    rows = lines if "line" in lines.columns else index.lines_of(lines, F.lit("index.md"))
    return index.targets(rows).select("target").distinct()


def index_missing(pages: DataFrame, targets: DataFrame) -> DataFrame:
    rows = pages.where("not is_config").join(targets.select(T.normal_path("target").alias("path")).distinct(), "path", "left_anti")
    return _rows(rows, F.col("path"), "health.index_missing_page", F.lit("not linked from the index"), 0)


def index_dangling(pages: DataFrame, targets: DataFrame) -> DataFrame:
    rows = targets.withColumn("path", F.when(T.inside("target"), T.normal_path("target")))
    bad = rows.join(pages.select("path"), "path", "left_anti")
    return _rows(bad, F.lit("index.md"), "health.index_dangling", F.col("target"), 0)


def missing_references(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(target, page)``: the pages that name an unknown target, a row each."""
    pages = nodes.select(F.col("id").alias("source"), F.col("path").alias("page"))
    return edges.where("not resolved").join(pages, "source").select("target", "page").distinct()


def missing_entities(edges: DataFrame, nodes: DataFrame, least: int = MISSING_REFS) -> DataFrame:
    """``(target, ref_count)`` of unknown targets that ``least`` or more pages name; :func:`missing_references` has the pages."""
    by = edges.where("not resolved").join(nodes.select(F.col("id").alias("source")).distinct(), "source", "left_semi").select("target", "source").distinct()
    return by.groupBy("target").agg(F.count("*").alias("ref_count")).where(F.col("ref_count") >= least)


def missing_entity_pages(edges: DataFrame, nodes: DataFrame, least: int = MISSING_REFS) -> DataFrame:
    """``(target, ref_count, page)``: :func:`missing_entities` with every page that names them, a row each."""
    pages = nodes.select(F.col("id").alias("source"), F.col("path").alias("page"))
    named = materialize(edges.where("not resolved").select("target", "source").join(pages, "source").distinct(), "named")
    counts = named.select("target", "source").distinct().groupBy("target").agg(F.count("*").alias("ref_count")).where(F.col("ref_count") >= least)
    return named.select("target", "page").distinct().join(counts, "target").select("target", "ref_count", "page")


def _findings(rows: DataFrame, suggestion=None) -> DataFrame:
    return rows.select("page", "kind", "detail", (F.lit(None) if suggestion is None else suggestion).cast("string").alias("suggestion"))


def health(pages: DataFrame, index_lines: DataFrame) -> DataFrame:
    targets = materialize(index_targets(index_lines), "targets")
    parts = [stub_pages(pages), uncharted_pages(pages), type_folder_mismatches(pages), index_missing(pages, targets), index_dangling(pages, targets)]
    out = _findings(parts[0])
    for p in parts[1:]:
        out = out.unionByName(_findings(p))
    return ordered(out)


def lint(pages: DataFrame, docs: DataFrame, fold=T.fold_stem) -> DataFrame:
    nodes, edges = materialize(G.graph_nodes(pages), "nodes"), materialize(G.graph_edges(pages, fold=fold), "edges")  # every rule reads them
    path = nodes.groupBy("id").agg(F.max("path").alias("path"))
    at = lambda df, c: df.join(path.select(F.col("id").alias(c), F.col("path").alias("page")), c)
    named = materialize(at(edges.where("not resolved"), "source").select("target", "source", "page"), "named")
    G.numbered(edges)  # before the threads, which read it
    # communities and fragile places take many rounds of small jobs and don't need one another: their jobs run side by side, and beside those of the nearest pages
    with ThreadPoolExecutor(2) as pool:
        start = lambda made, name: pool.submit(inheritable_thread_target(nodes.sparkSession)(lambda: materialize(made(), name)))
        com, fragile = start(lambda: G.communities(nodes, edges), "communities"), start(lambda: G.fragile_places(edges), "fragile")
        near = materialize(nearest_pages(edges.where("not resolved").select("target").distinct(), docs, named.select("target", "page")), "near")
        hubs = G.hub_nodes(nodes, edges)
        com, fragile = com.result(), fragile.result()
    crossed = G.crossing(edges, com)
    thin, lonely = G.thin_links(edges, com, crossed), G.isolated_communities(edges, com, crossed=crossed)
    entities = named.groupBy("target").agg(F.count("*").alias("ref_count")).where(F.col("ref_count") >= MISSING_REFS)  # links are distinct, as in missing_entities
    parts = [
        at(G.orphans(nodes, edges).select("id", "type"), "id").select("page", F.lit("lint.orphan").alias("kind"), F.col("type").alias("detail"), F.lit(None).cast("string").alias("suggestion")),
        named.join(near.select("target", F.col("page").alias("s")), "target", "left").select("page", F.lit("lint.broken_link").alias("kind"), F.col("target").alias("detail"), F.col("s").alias("suggestion")),
        entities.select(F.lit("").alias("page"), F.lit("lint.missing_entity").alias("kind"), F.concat_ws(": ", "target", F.concat("ref_count", F.lit(" pages"))).alias("detail"), F.lit(None).cast("string").alias("suggestion")),
        at(hubs, "id").select("page", F.lit("lint.hub_node").alias("kind"), F.col("degree").cast("string").alias("detail"), F.lit(None).cast("string").alias("suggestion"))]
    parts += [
        at(thin, "u").select("page", F.lit("lint.thin_intercommunity_link").alias("kind"), F.concat_ws(" - ", "u", "v").alias("detail"), F.lit(None).cast("string").alias("suggestion")),
        at(lonely, "id").select("page", F.lit("lint.isolated_community").alias("kind"), F.concat_ws(" of ", F.lit("one"), "size").alias("detail"), F.lit(None).cast("string").alias("suggestion")),
        at(fragile, "u").select("page", F.concat(F.lit("lint."), F.when(F.col("kind") == "bridge", "bridge_edge").otherwise("cut_vertex")).alias("kind"), F.concat_ws(" - ", "u", "v").alias("detail"), F.lit(None).cast("string").alias("suggestion"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return ordered(materialize(out, "findings"))  # Spark reads the rows twice to sort them


def ordered(findings: DataFrame) -> DataFrame:
    """Findings in causal order of their kinds, unknown kinds last; inside a kind by page and detail."""
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind"))
    return findings.orderBy(F.when(rank > 0, rank).otherwise(len(ORDER) + 1), "page", "detail")


def report_json(rows: DataFrame, pages_checked: int, name: str = "violations") -> str:
    """The envelope of a report; optional fields that are null are left out."""
    items = [r[0] for r in rows.select(F.to_json(F.struct(*rows.columns))).collect()]
    return f'{{"ok":{str(not items).lower()},"pages_checked":{pages_checked},"{name}":[{",".join(items)}]}}'
