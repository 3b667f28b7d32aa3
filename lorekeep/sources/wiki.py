"""A knowledge base as DataFrames: pages, raw files and their fingerprints.

Spark's file sources do not list empty files, names that begin with ``_`` or ``.``, folders or links, all of which count
in a local folder.  So its names are listed on the driver (one row of names per file, no contents), contents are read by
``binaryFile`` on the executors, and a left join brings them together.  A root with a scheme (``hdfs://``, ``s3a://``,
``file://``) is listed and read by ``binaryFile`` alone, in tasks where there are many folders, with that source's limits.  Paths are relative with ``/``;
page order compares path parts.
"""

from __future__ import annotations

import os
import stat

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.sources import frontmatter as FM

CONFIG_PAGES = ("index.md", "log.md", "overview.md")
LISTING = "path string, kind string, target string, mtime_ns bigint, size bigint"


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """``(path, kind, target, mtime_ns, size)`` of all below ``root``: files, folders, links, special files; the root is ``.``.

    A root with a scheme gives its files alone.
    """
    if "://" in root:
        found = _stored(spark, root)
        return found.select("path", F.lit("file").alias("kind"), F.lit(None).cast("string").alias("target"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size"))
    rows, seen = [], set()

    def walk(folder: str, at: str) -> None:
        real = os.path.realpath(folder)
        if real in seen:
            return
        seen.add(real)
        for name in sorted(os.listdir(folder)):
            full, path = os.path.join(folder, name), f"{at}/{name}" if at else name
            info = os.lstat(full)
            link = os.readlink(full) if stat.S_ISLNK(info.st_mode) else None
            now = os.stat(full) if link is not None and os.path.exists(full) else info
            kind = "dir" if stat.S_ISDIR(now.st_mode) else "file" if stat.S_ISREG(now.st_mode) else "special"
            rows.append((path, "link" if link is not None and kind != "file" else kind, link, now.st_mtime_ns, now.st_size))
            if kind == "dir":
                walk(full, path)

    if os.path.isdir(root):
        info = os.lstat(root)
        rows.append((".", "dir", None, info.st_mtime_ns, 0))
        walk(root, "")
    return spark.createDataFrame(rows, LISTING)


def _stored(spark: SparkSession, root: str) -> DataFrame:
    """``(path, modificationTime, length, content)`` of the files below a root with a scheme, paths relative to it; what isn't selected isn't read."""
    base = root.rstrip("/") + "/"
    scheme, rest = base.split("://", 1)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    full = F.regexp_replace("path", "^[a-zA-Z0-9+.-]+:/+", "/")
    below = "/" + rest.lstrip("/")  # of file:///a/b the path, of others host and path
    return read.withColumn("path", F.when(F.startswith(full, F.lit(below)), F.substring(full, len(below) + 1, 1 << 30)))


def with_content(listed: DataFrame, root: str) -> DataFrame:
    """``listed`` files and the column content; empty for files of no bytes."""
    spark = listed.sparkSession
    if "://" in root:
        return listed.where("kind = 'file'").join(_stored(spark, root).select("path", "content"), "path", "left")
    files = listed.where("kind = 'file'")
    if not os.path.isdir(root) or files.isEmpty():
        return files.withColumn("content", F.lit(None).cast("binary"))
    base = os.path.abspath(root)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{base}")
    plain = read.select(F.regexp_replace("path", "^file:/+", "/").substr(F.lit(len(base) + 2), F.lit(1 << 30)).alias("path"), F.col("content").alias("seen"))
    hidden = [r["path"] for r in files.where("size > 0 and path rlike '(^|/)[_.]'").select("path").collect()]  # names that Spark's sources skip
    extra = spark.createDataFrame([(p, open(os.path.join(base, p), "rb").read()) for p in hidden], "path string, hidden binary")
    return files.join(plain, "path", "left").join(extra, "path", "left").withColumn("content", F.coalesce("seen", "hidden", F.lit(b""))).drop("seen", "hidden")


def page_files(spark: SparkSession, wiki: str) -> DataFrame:
    """All ``*.md`` files: path, mtime_ns, size, content, text (bytes that are not UTF-8 replaced), utf8, is_config."""
    listed = list_tree(spark, wiki).where("kind = 'file' and path like '%.md'")
    rows = with_content(listed, wiki).select("path", "mtime_ns", "size", "content")
    return rows.withColumns({
        "utf8": F.is_valid_utf8(F.col("content").cast("string")), "text": F.make_valid_utf8(F.col("content").cast("string")), "is_config": F.col("path").isin(*CONFIG_PAGES)})


def parse_pages(files: DataFrame) -> DataFrame:
    """Pages with tolerant metadata, and the strict regime's error beside it.

    Columns: path, stem, is_config, text, body, meta fields and kinds, strict_error (null, block_missing, unparsable, not_utf8).
    """
    keep = [c for c in ("path", "is_config", "text", "utf8", "mtime_ns", "size") if c in files.columns]
    rows = files.select(*keep, FM.parse_page("text").alias("m"))
    error = F.col("error") if "utf8" not in keep else F.when(~F.col("utf8"), "not_utf8").otherwise(F.col("error"))
    return rows.select(*keep, "m.*").withColumns({"stem": T.link_stem("path"), "strict_error": error}).drop("error")


def page_order(path="path"):
    """Sort key of page order: by path parts, not by characters."""
    return F.split(path, "/")


def stem_index(pages: DataFrame) -> DataFrame:
    """``(stem, path)`` of all pages, settings pages included; of equal stems the first in page order."""
    first = F.row_number().over(Window.partitionBy("stem").orderBy(page_order()))
    return pages.select("path", "stem").withColumn("n", first).where("n = 1").select("stem", "path")


def page_list(pages: DataFrame) -> DataFrame:
    """``(path, title, type)`` of content pages."""
    return pages.where("not is_config").select("path", T.page_title("title", "stem").alias("title"), T.page_type("type").alias("type"))


def read_page(pages: DataFrame, path: str) -> DataFrame:
    """The one page at ``path``, which must lie inside the wiki; else no row."""
    return pages.where((F.col("path") == path) & T.inside(F.lit(path))).select("path", T.page_title("title", "stem").alias("title"), "body")


def page_meta_snapshot(pages: DataFrame) -> DataFrame:
    """``(path, sources, body_len)`` of content pages; sources null where they can't be trusted, else distinct and sorted."""
    trusted = F.when(F.col("ok") & (F.col("sources_kind") == "list_str"), F.array_sort(F.array_distinct("sources")))
    return pages.where("not is_config").select("path", trusted.alias("sources"), F.char_length("body").cast("long").alias("body_len"))


def tree_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """``(path, fp)`` of a tree: sha256 of files, marks for folders, links and special files, and the root as ``.``."""
    listed = list_tree(spark, root)
    files = with_content(listed, root).select("path", F.sha2("content", 256).alias("fp"))
    mark = F.when(F.col("kind") == "link", F.concat(F.lit("<symlink:"), "target", F.lit(">"))).when(F.col("kind") == "dir", "<dir>").otherwise("<special>")
    return files.unionByName(listed.where("kind <> 'file'").select("path", mark.alias("fp")))


def wiki_snapshot(pages: DataFrame, tree: DataFrame) -> DataFrame:
    """The tree's fingerprints, with the metadata of entity and concept pages beside them."""
    meta = pages.where("path like 'entities/%' or path like 'concepts/%'").select(
        "path", F.struct("ok", "title", "type", "tags", "aliases", "sources", "keys").alias("meta"), F.sha2("body", 256).alias("body_fp"))
    return tree.join(meta, "path", "left")


def raw_listing(raw: DataFrame, source_pages: DataFrame) -> DataFrame:
    """``(name, size, ingested, page)`` of top-level ``*.md`` raw files; a source page is found by slug, then by slug with dots as dashes."""
    rows = raw.where("path like '%.md' and path not like '%/%'").withColumn("slug", F.regexp_replace("path", r"\.md$", ""))
    by = source_pages.select(F.col("stem").alias("s"), F.col("path").alias("page"))
    found = rows.join(by.withColumnsRenamed({"s": "slug", "page": "p1"}), "slug", "left").withColumn("s", F.replace("slug", F.lit("."), F.lit("-"))).join(by.withColumnRenamed("page", "p2"), "s", "left")
    return found.select(F.col("path").alias("name"), "size", F.coalesce("p1", "p2").isNotNull().alias("ingested"), F.coalesce("p1", "p2").alias("page"))


def workspace_listing(listed: DataFrame, folder: str = "") -> DataFrame:
    """One level of a tree: folders by name first, then files, newest first, with a kind by ending."""
    rows = listed.where("path <> '.'").withColumn("parent", F.regexp_replace("path", r"/?[^/]*$", "")).where(F.col("parent") == folder)
    suffix = T.suffix(T.basename("path"))
    view = F.when(F.col("kind") == "dir", "dir").when(suffix.isin(*T.IMAGE_SUFFIXES), "image").when(suffix.isin(*T.TEXT_SUFFIXES), "text").otherwise("binary")
    rows = rows.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "path", view.alias("view"), "mtime_ns", "size")
    return rows.orderBy(F.col("view") != "dir", F.when(F.col("view") == "dir", F.col("name")), F.desc("mtime_ns"), "name")


def modified_since(listed: DataFrame, since_ns: int) -> DataFrame:
    return listed.where("kind = 'file'").agg(F.count_if(F.col("mtime_ns") >= since_ns).alias("n"))


def unique_names(names: DataFrame, path: str = "path") -> DataFrame:
    """``(key, path, exact)``: exact file names, and lower-case names that only one file has and that are no exact name."""
    base = names.select(F.col(path).alias("path"), F.regexp_extract(path, r"([^/]+)$", 1).alias("name"))
    exact = base.groupBy(F.col("name").alias("key")).agg(F.min("path").alias("path")).withColumn("exact", F.lit(True))
    lower = base.groupBy(F.lower("name").alias("key")).agg(F.min("path").alias("path"), F.max("path").alias("last")).where("path = last").drop("last")
    return exact.unionByName(lower.join(exact.select("key"), "key", "left_anti").withColumn("exact", F.lit(False)))


TEMPLATES = {"SCHEMA.md": "# Schema\n", "AGENTS.md": "# Agent notes\n", "wiki/index.md": "# Index\n", "wiki/log.md": "# Log\n", "wiki/overview.md": "# Overview\n"}


def init_base(root: str, templates: dict[str, str] | None = None) -> list[str]:
    """Create what is missing of a knowledge base, never overwriting; the paths created."""
    made = []
    os.makedirs(os.path.join(root, "raw"), exist_ok=True)
    for path, content in (templates or TEMPLATES).items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        try:
            with open(full, "x", encoding="utf-8") as f:
                f.write(content)
            made.append(path)
        except FileExistsError:
            pass
    return made


def write_atomically(path: str, data: str | bytes) -> None:
    """Replace a file's content in one step, keeping its mode."""
    raw = data.encode() if isinstance(data, str) else data
    part = f"{path}.part-{os.getpid()}"
    with open(part, "wb") as f:
        f.write(raw)
        f.flush()
        os.fsync(f.fileno())
    if os.path.exists(path):
        os.chmod(part, stat.S_IMODE(os.stat(path).st_mode))
    os.replace(part, path)
