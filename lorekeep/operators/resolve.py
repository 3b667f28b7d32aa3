"""Resolution of links: a table of keys to pages, probed exactly first and folded second, as two equi-joins.

Every table here is one row per key; the probing side keeps its rows and its partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.plans.store import materialize
from lorekeep.sources.wiki import page_order, stem_index


def alias_index(pages: DataFrame) -> DataFrame:
    """``(key, stem)`` of the string aliases of content pages; of equal keys the first in page order, then in the list."""
    rows = pages.where("not is_config").select("path", "stem", F.posexplode("aliases").alias("pos", "alias"))
    rows = rows.withColumn("key", T.link_stem("alias")).where("key <> ''")
    first = F.row_number().over(Window.partitionBy("key").orderBy(page_order(), "pos"))
    return rows.withColumn("n", first).where("n = 1").select("key", "stem")


def resolution_table(pages: DataFrame, fold=T.fold_stem) -> DataFrame:
    """``(key, owner, tier)``: stems (0), aliases that are no stem (1), and folded keys with a single owner that are no key yet (2)."""
    stems = stem_index(pages)
    aliases = alias_index(pages).join(stems, "stem").select("key", F.col("path").alias("owner"), F.lit(1).alias("tier"))
    known = stems.select(F.col("stem").alias("key"), F.col("path").alias("owner"), F.lit(0).alias("tier")).unionByName(aliases)
    base = known.groupBy("key").agg(F.min(F.struct("tier", "owner")).alias("b")).select("key", "b.owner", "b.tier").withColumn("folded", fold(F.col("key")))
    own = F.struct("key", "owner", "tier")
    loose = F.struct(F.col("folded").alias("key"), "owner", F.lit(2).alias("tier"))
    rows = base.select(F.inline(F.array(own, loose))).groupBy("key").agg(F.min(F.struct("tier", "owner")).alias("b"), F.max("owner").alias("last"), F.min("owner").alias("first"))
    return rows.where("b.tier < 2 or first = last").select("key", "b.owner", "b.tier")


def resolve(links: DataFrame, keys: DataFrame, stem: str = "stem", fold=T.fold_stem) -> DataFrame:
    """``links`` and the column owner: the page of the exact key, else of the folded one, else null."""
    table = keys.select("key", "owner")
    distinct = links.select(stem).distinct()  # folding may pass through Python: once for each stem
    exact = distinct.join(table.withColumnsRenamed({"key": stem, "owner": "exact"}), stem, "left")
    # a stem that is met has no need of its folded key; a place of its own keeps all of them from meeting in one task, as they would with null
    probed = exact.withColumn("folded", F.when(F.col("exact").isNull(), fold(F.col(stem))).otherwise(F.concat(F.lit("\x00"), stem)))
    probed = probed.join(table.withColumnsRenamed({"key": "folded", "owner": "loose"}), "folded", "left")
    return links.join(probed.select(stem, F.coalesce("exact", "loose").alias("owner")), stem, "left")


def page_links(pages: DataFrame, body: str = "body") -> DataFrame:
    """``(path, source, pos, raw, stem)`` of the links outside whole-line comments of content pages, source being the page's own key; empty stems are left out."""
    # all of it inside posexplode: a column of its own would be made once more by the filter on its size, and a stem by the one below
    each = F.transform(T.wikilinks(T.strip_comments(body)), lambda raw: F.struct(raw.alias("raw"), T.link_stem(raw).alias("stem")))
    rows = pages.where("not is_config").select("path", T.link_stem("path").alias("source"), F.posexplode(each).alias("pos", "x"))
    return rows.where("x.stem <> ''").select("path", "source", "pos", "x.raw", "x.stem")


def first_by(rows: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def ordered_mentions(texts: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """``(id, pos, stem, name)``: links of a text in order of first appearance, one per stem, with their display name."""
    rows = texts.select(F.col(id_col).alias("id"), F.posexplode(T.wikilinks(text)).alias("pos", "raw"))
    rows = rows.withColumns({"stem": T.link_stem("raw"), "name": T.link_display("raw")}).where("stem <> ''")
    return first_by(rows, ["id", "stem"], ["pos"]).select("id", "pos", "stem", "name")


def resolvable_mentions(mentions: DataFrame, keys: DataFrame, most: int | None = None, fold=T.fold_stem) -> DataFrame:
    """Mentions with a page and an admissible name, the first of each page; with ``most``: that many, and how many more there are."""
    known = resolve(mentions.where(T.page_argument_ok("name")), keys, fold=fold).where("owner is not null")
    rows = first_by(known, ["id", "owner"], ["pos"])
    if most is None:
        return rows.select("id", "pos", "name", "owner")
    w = Window.partitionBy("id")
    rows = rows.withColumns({"rank": F.row_number().over(w.orderBy("pos")), "total": F.count("*").over(w)})
    return rows.where(F.col("rank") <= most).select("id", "rank", "name", "owner", F.greatest(F.lit(0), F.col("total") - most).alias("more"))


def source_page_of(slugs: DataFrame, source_pages: DataFrame, slug: str = "slug") -> DataFrame:
    """``slugs`` and the column page: the source page of the slug, else of the slug with dots as dashes."""
    by = source_pages.select(F.col("stem").alias("_s"), F.col("path").alias("_p"))
    out = slugs.join(by.withColumnRenamed("_p", "_exact"), F.lower(F.col(slug)) == F.col("_s"), "left").drop("_s")
    out = out.join(by, F.replace(F.lower(F.col(slug)), F.lit("."), F.lit("-")) == F.col("_s"), "left")
    return out.withColumn("page", F.coalesce("_exact", "_p")).drop("_s", "_p", "_exact")


#: Files of a slug that meet as many others of it on one key, and pairs of a task, about.
SLUG_BLOCK, TASK_PAIRS = 1024, 1 << 22


def slug_collisions(raw: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """``(slug, path, other)``: every ordered pair of raw files that share a slug.

    raw: ``(path)``, or ``(path, slug)`` where slugs are known.  owners: ``(slug, path)`` of pages that belong to a file already; pairs of such a path are
    left out.  Pairs grow with the square of a slug's files: these are numbered and cut into blocks, and each two blocks meet on a key of their own.
    """
    slug = F.col("slug") if "slug" in raw.columns else T.raw_slug(F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.md$", ""))
    rows = materialize(raw.select("path", slug.alias("slug")).where("slug is not null and path is not null").distinct(), "slugs")
    shared = materialize(rows.groupBy("slug").agg(F.count("*").alias("files")).where("files > 1"), "sizes")
    pairs = shared.agg(F.sum(F.col("files").cast("double") * F.col("files")).alias("n")).first()["n"] or 0
    parts = max(raw.sparkSession.sparkContext.defaultParallelism, int(pairs // TASK_PAIRS) + 1)
    blocks = F.ceil(F.col("files") / SLUG_BLOCK).cast("int")
    same = rows.join(shared, "slug").select("slug", "path", blocks.alias("blocks"), F.pmod(F.xxhash64("path"), blocks).cast("int").alias("block"))
    same = materialize(same, "shared")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = same.select("slug", "path", F.col("block").alias("a"), every.alias("b"))
    right = same.select("slug", F.col("path").alias("other"), every.alias("a"), F.col("block").alias("b"))
    if owners is not None:
        left = left.join(owners, ["slug", "path"], "left_anti")
    met = left.repartition(parts, "slug", "a", "b").join(right.repartition(parts, "slug", "a", "b").hint("merge"), ["slug", "a", "b"])  # by number: few bytes make many pairs
    return met.where("path <> other").select("slug", "path", "other")


def code_reference(code: Column, paths: DataFrame) -> DataFrame:
    """Rows of ``paths`` that an inline code names: the path, the path without ``wiki/``, or the file name, with or without ``.md``."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    forms = [F.col("path"), F.concat(F.lit("wiki/"), "path"), name]
    return paths.where(F.greatest(*[(f == code) | (f == F.concat(code, F.lit(".md"))) for f in forms]))


def raw_references(texts: DataFrame, names: DataFrame, id_col: str = "path", text: str = "body") -> DataFrame:
    """``(id, ref, target)``: ``raw/...`` references in links, wikilinks, code and plain text; target null where no such file is."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"(?:\[\[|\(|`|(?<![\w/]))raw/([^\]\)`|#\s]+)"), F.lit(1))
    rows = texts.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(found)).alias("ref")).withColumn("key", F.regexp_extract("ref", r"([^/]+)$", 1))
    exact = rows.join(names.where("exact").select("key", F.col("path").alias("p1")), "key", "left").withColumn("low", F.lower("key"))
    loose = exact.join(names.select(F.col("key").alias("low"), F.col("path").alias("p2")), "low", "left")
    return loose.select("id", "ref", F.coalesce("p1", "p2").alias("target"))
