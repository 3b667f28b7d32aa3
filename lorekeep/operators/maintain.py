"""Worklists, provenance, snapshots and gates: what changed, what drifted, what may be written.

All of it is set algebra between two tables; only the splicing of one small text (an index, a page) runs on the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.plans.ranks import carried, ranked
from lorekeep.plans.store import materialize
from lorekeep.sources.wiki import page_order

SHRINK_FLOOR, SHRINK_RATIO, HEAL_LIMIT = 200, 0.5, 20


def heal_worklist(missing: DataFrame, min_refs: int = 2, limit: int = HEAL_LIMIT) -> DataFrame:
    """Missing entities by falling number of references; those past ``limit`` are postponed."""
    placed = ranked(missing.where(F.col("ref_count") >= min_refs), F.desc("ref_count"), "target")
    return placed.withColumn("rank", (F.col("rank") + 1).cast("int")).withColumn("postponed", F.col("rank") > limit)


def selected_targets(worklist: DataFrame, chosen: DataFrame) -> DataFrame:
    return worklist.where("not postponed").join(chosen.select("target").distinct(), "target", "left_semi")


def heal_receipts(targets: DataFrame, keys_after: DataFrame, gate_ok: bool, fold=T.fold_stem) -> DataFrame:
    """``(target, outcome, page)``: healed with its page, or still_broken; all still_broken if the gate failed."""
    from lorekeep.operators.resolve import resolve

    found = resolve(targets.select("target").withColumn("stem", F.col("target")), keys_after, fold=fold)
    healed = F.col("owner").isNotNull() & F.lit(gate_ok)
    return found.select("target", F.when(healed, "healed").otherwise("still_broken").alias("outcome"), F.when(healed, F.col("owner")).alias("page"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(path, change)``: removed, added or modified."""
    both = before.select("path", F.col("fp").alias("f0")).join(after.select("path", F.col("fp").alias("f1")), "path", "full")
    change = F.when(F.col("f1").isNull(), "removed").when(F.col("f0").isNull(), "added").when(F.col("f0") != F.col("f1"), "modified")
    return both.withColumn("change", change).where("change is not null").select("path", "change")


def heal_write_set(before: DataFrame, after: DataFrame, targets: DataFrame, gate_ok: bool = True, free: tuple = ("log.md", "index.md"), folders: tuple = ("entities", "concepts")) -> DataFrame:
    """``(path, change, expected)`` of every page whose bytes changed; sides: ``(path, fp, aliases, rest)``, targets: ``(target)``.

    rest is a digest of all but the aliases and the date; aliases that are no list of strings, or a page that can't be read, are null.
    Expected are edits of the log and the index, new pages in ``folders``, and pages there to whose aliases only the batch's
    targets were appended, nothing else changed, if the gate passed.  Everything else isn't, deletions least of all.
    """
    keep = ["path", "fp", "aliases", "rest"]
    both = before.select(*keep).withColumnsRenamed({"fp": "f0", "aliases": "a0", "rest": "r0"}).join(after.select(*keep).withColumnsRenamed({"fp": "f1", "aliases": "a1", "rest": "r1"}), "path", "full")
    change = F.when(F.col("f1").isNull(), "removed").when(F.col("f0").isNull(), "added").when(F.col("f0") != F.col("f1"), "modified")
    content = F.split_part("path", F.lit("/"), F.lit(1)).isin(*folders) & F.contains("path", F.lit("/"))
    changed = both.withColumn("change", change).where("change is not null")
    n = F.size("a0")
    kept = F.when(n == 0, True).otherwise(F.slice("a1", F.lit(1), F.greatest(n, F.lit(1))) == F.col("a0"))
    grown = content & (F.col("r0") == F.col("r1")) & (F.size("a1") > n) & kept
    new = changed.where(F.col("change") == "modified").where(F.coalesce(grown, F.lit(False))).select("path", F.explode(F.slice("a1", n + 1, F.size("a1") - n)).alias("alias"))
    asked = targets.select(F.col("target").alias("key"), F.lit(True).alias("asked")).distinct()
    collected = new.withColumn("key", T.link_stem("alias")).join(asked, "key", "left").groupBy("path").agg(F.bool_and((F.col("key") != "") & F.coalesce("asked", F.lit(False))).alias("collected"))
    fine = F.when(F.col("change") == "added", content).when(F.col("change") == "modified", F.col("path").isin(*free) | (F.coalesce("collected", F.lit(False)) & F.lit(gate_ok))).otherwise(F.lit(False))
    return changed.join(collected, "path", "left").select("path", "change", fine.alias("expected"))


def log_only_grew(before: str, after: str) -> bool:
    return after.startswith(before)


def new_violations(before: DataFrame, after: DataFrame, warnings: tuple = ("wikilink.broken",)) -> DataFrame:
    """Rows of ``after`` that ``before`` lacks by (page, kind, detail), as sets, with their severity."""
    key = ["page", "kind", "detail"]
    return after.select(*key).join(before.select(*key), key, "left_anti").distinct().withColumn("severity", F.when(F.col("kind").isin(*warnings), "warning").otherwise("blocking"))


def turn_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(new, resolved, total, ok)`` of one turn."""
    key = ["page", "kind", "detail"]
    count = lambda df, name: df.agg(F.count("*").alias(name))
    out = count(after.join(before, key, "left_anti"), "new").join(count(before.select(*key).distinct().join(after, key, "left_anti"), "resolved")).join(count(after, "total"))
    return out.withColumn("ok", F.col("new") == 0)


def source_regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    """A ``sources.dropped`` row for each slug that a page on both sides lost, where both lists are trusted (not null)."""
    both = before.select("path", F.col("sources").alias("s0")).join(after.select("path", F.col("sources").alias("s1")), "path").where("s0 is not null and s1 is not null")
    return both.select(F.col("path").alias("page"), F.lit("sources.dropped").alias("kind"), F.explode(F.array_sort(F.array_except("s0", "s1"))).alias("detail"))


def body_shrinks(before: DataFrame, after: DataFrame, floor: int = SHRINK_FLOOR, ratio: float = SHRINK_RATIO) -> DataFrame:
    both = before.select("path", F.col("body_len").alias("b0")).join(after.select("path", F.col("body_len").alias("b1")), "path")
    return both.where((F.col("b0") >= floor) & (F.col("b1") < ratio * F.col("b0"))).select("path", "b0", "b1")


def drifted_sources(source_pages: DataFrame, raw: DataFrame) -> DataFrame:
    """``(slug, page, raw_path)`` of source pages whose recorded digest isn't their raw file's; what can't be read is skipped."""
    known = source_pages.where("path rlike '^sources/[^/]+[.]md$'").select(
        F.regexp_extract("path", r"^sources/(.+)\.md$", 1).alias("slug"), F.col("path").alias("page"), T.parse_digest("raw_digest").alias("d")).where("d is not null")
    known = known.where(T.inside("d.path", "raw")).select("slug", "page", T.normal_path("d.path").alias("raw_path"), F.col("d.sha256").alias("recorded"))
    return known.join(raw.select(F.col("path").alias("raw_path"), F.col("fp").alias("now")), "raw_path").where("recorded <> now").select("slug", "page", "raw_path")


def drift_candidates(drifted: DataFrame, page_sources: DataFrame) -> DataFrame:
    """``(page, reason, slugs)``: drifted source pages, with the drifted sources that they cite as well, and other pages that cite one."""
    cites = page_sources.select(F.col("path").alias("page"), F.explode("sources").alias("slug")).join(drifted.select("slug"), "slug", "left_semi").withColumn("own", F.lit(False))
    own = drifted.select("page", "slug", F.lit(True).alias("own"))
    by = own.unionByName(cites).groupBy("page").agg(F.sort_array(F.collect_set("slug")).alias("slugs"), F.bool_or("own").alias("own"))
    return by.select("page", F.when(F.col("own"), "source-drift").otherwise("cites-drifted-source").alias("reason"), "slugs")


def audit_groups(candidates: DataFrame, drifted: DataFrame, limit: int | None = None) -> DataFrame:
    """``(slug, source_page, raw_path, members)``, the first ``limit`` slugs."""
    members = candidates.select("page", F.explode("slugs").alias("slug")).groupBy("slug").agg(F.sort_array(F.collect_set("page")).alias("members"))
    out = drifted.withColumnRenamed("page", "source_page").join(members, "slug").select("slug", "source_page", "raw_path", "members").orderBy("slug")
    return out if limit is None else out.limit(limit)


def audit_targets(groups: DataFrame) -> DataFrame:
    rows = groups.select("slug", "raw_path", F.explode("members").alias("page"))
    return rows.groupBy("page").agg(F.sort_array(F.collect_set("slug")).alias("slugs"), F.sort_array(F.collect_set("raw_path")).alias("raw_paths"))


REVIEW = "page string, slugs array<string>, verdict string"


def review_entries(before: str, after: str, spark) -> DataFrame | None:
    """``(page, slugs, verdict)`` of the one new audit section of a log that only grew; None at any fault of form."""
    if not after.startswith(before):
        return None
    added = after[len(before) :]
    heads = [m.start() for m in re.finditer(r"(?m)^## ", added)]
    audits = [i for i, h in enumerate(heads) if re.match(r"## .*\baudit\b", added[h:].split("\n")[0])]
    if len(audits) != 1:
        return None
    end = heads[audits[0] + 1] if audits[0] + 1 < len(heads) else len(added)
    bullets = [(x[2:],) for x in added[heads[audits[0]] : end].split("\n") if x.startswith("- ")]
    rows = spark.createDataFrame(bullets, "line string").withColumn("v", F.try_parse_json("line"))
    kind = lambda p: F.schema_of_variant(F.try_variant_get("v", p, "variant"))
    good = F.coalesce((kind("$.page") == "STRING") & (kind("$.slugs") == "ARRAY<STRING>") & (kind("$.verdict") == "STRING"), F.lit(False))
    if rows.where(~good).limit(1).count():
        return None
    return rows.select(F.try_variant_get("v", "$.page", "string").alias("page"), F.try_variant_get("v", "$.slugs", "array<string>").alias("slugs"), F.try_variant_get("v", "$.verdict", "string").alias("verdict"))


def log_grew(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(key, ok, known)`` of logs as tables of lines ``(key, line, x)``: whether all earlier lines are still there, the last one possibly longer; known: how many those are."""
    size = before.groupBy("key").agg((F.max("line") + 1).alias("known"))
    same = F.when(F.col("line") == F.col("known") - 1, F.startswith("y", F.col("x"))).otherwise(F.col("x") == F.col("y"))
    both = before.join(size, "key").join(after.select("key", "line", F.col("x").alias("y")), ["key", "line"], "left")
    return both.groupBy("key", "known").agg(F.bool_and(F.coalesce(same, F.lit(False))).alias("ok")).select("key", "ok", "known")


def reviewed_entries(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(key, page, slugs, verdict)`` of the one new audit section of each log that only grew; nothing of a log with any fault of form.

    Sections are runs of lines behind a heading of two signs, bullets of the audit's JSON objects with a page, a list of slugs and a verdict.
    """
    marked = carried(after.withColumn("start", F.when(F.col("x").rlike("^## "), F.col("line"))), ["key"], ["line"], "start", "since")
    new = marked.withColumn("section", F.coalesce("start", "since")).join(log_grew(before, after).where("ok"), "key").where("line >= known and section >= known")
    heads = new.where("start is not null").groupBy("key").agg(F.count_if(F.col("x").rlike(r"\baudit\b")).alias("n"), F.min(F.when(F.col("x").rlike(r"\baudit\b"), F.col("line"))).alias("section")).where("n = 1")
    bullets = new.join(heads.select("key", "section"), ["key", "section"]).where(F.col("x").startswith("- ")).select("key", "line", F.try_parse_json(F.substring("x", 3, 1 << 30)).alias("v"))
    kind = lambda p: F.schema_of_variant(F.try_variant_get("v", p, "variant"))
    good = F.coalesce((kind("$.page") == "STRING") & (kind("$.slugs") == "ARRAY<STRING>") & (kind("$.verdict") == "STRING"), F.lit(False))
    rows = materialize(bullets.select("key", "line", good.alias("good"), F.try_variant_get("v", "$.page", "string").alias("page"), F.try_variant_get("v", "$.slugs", "array<string>").alias("slugs"), F.try_variant_get("v", "$.verdict", "string").alias("verdict")), "bullets")
    return rows.join(rows.where("not good").select("key").distinct(), "key", "left_anti").select("key", "page", "slugs", "verdict")


def complete_groups(groups: DataFrame, targets: DataFrame, reviewed: DataFrame | None, gate_ok: bool) -> DataFrame:
    """``(slug, complete)``: every member reviewed with exactly its slugs, and the gate passed."""
    if reviewed is None:
        return groups.select("slug", F.lit(False).alias("complete"))
    done = targets.join(reviewed.select("page", F.array_sort(F.array_distinct("slugs")).alias("said")), "page", "left").select("page", (F.array_sort("slugs") == F.col("said")).alias("ok"))
    rows = groups.select("slug", F.explode("members").alias("page")).join(done, "page", "left")
    return rows.groupBy("slug").agg((F.bool_and(F.coalesce("ok", F.lit(False))) & F.lit(gate_ok)).alias("complete"))


def index_plan(missing: DataFrame) -> DataFrame:
    """``(section, path, line)`` of index lines to add, in page order."""
    section = F.when(F.contains("path", F.lit("/")), F.initcap(F.split_part("path", F.lit("/"), F.lit(1)))).otherwise("Other")
    more = F.when(F.size("aliases") > 0, F.concat(F.lit(" — "), F.array_join("aliases", ", "))).otherwise("")
    line = F.concat(F.lit("- ["), F.replace("title", F.lit("]"), F.lit("］")), F.lit("]("), "path", F.lit(")"), more)
    return missing.select(section.alias("section"), "path", line.alias("line")).orderBy("section", page_order())


def spliced_index(text: str, plan: list[tuple[str, str]], dangling: set[str] = frozenset()) -> str:
    """The index with (section, line) pairs after the last filled line of their sections, and without lines that only link dangling targets."""
    lines, touched, inside = text.split("\n"), set(), False
    for k, line in enumerate(lines):
        was = inside
        for mark in re.findall(r"<!--|-->", line):
            inside = mark == "<!--"
        if was or "<!--" in line or "-->" in line:
            touched.add(k)
    targets = lambda x: {re.sub(r"^(\./)+", "", t.split("#")[0].strip()) for t in re.findall(r"\[[^\[\]\r\n]*\]\(((?:[^()\r\n]|\([^()\r\n]*\))*)\)", x) if "://" not in t}
    lines = [x for k, x in enumerate(lines) if k in touched or not (found := targets(x)) or not found <= dangling]
    for section in dict.fromkeys(s for s, _ in plan):
        new = [x for s, x in plan if s == section]
        head = next((k for k, x in enumerate(lines) if re.match(rf"##\s+{re.escape(section)}\s*$", x)), None)
        if head is None:
            lines = [*(lines[:-1] if lines and not lines[-1] else lines), "", f"## {section}", "", *new, ""]
            continue
        end = next((k for k in range(head + 1, len(lines)) if lines[k].startswith("#")), len(lines))
        last = max((k for k in range(head, end) if lines[k].strip()), default=head)
        lines[last + 1 : last + 1] = new
    return "\n".join(lines)


def remove_plan(pages: DataFrame, slug: str) -> DataFrame:
    """``(path, action)`` if the source ``slug`` goes: its own page, orphans (sole source), and pages that drop the slug."""
    own = F.col("path") == f"sources/{slug}.md"
    cites = F.array_contains("sources", slug)
    sole = F.array_distinct("sources") == F.array(F.lit(slug))
    action = F.when(own, "delete").when(cites & sole, "orphan").when(cites, "drop_slug")
    return pages.where("not is_config").select("path", action.alias("action")).where("action is not null")


def image_plan(refs: DataFrame, files: DataFrame) -> DataFrame:
    """``(page, ref, number)``: admitted images numbered by first appearance of their file; refs: (page, pos, ref)."""
    known = refs.where(T.image_ref_admitted("ref")).withColumn("path", T.normal_path("ref")).join(files.select("path", "size"), "path")
    first = known.groupBy("page", "path").agg(F.min("pos").alias("first"))
    number = first.withColumn("number", F.row_number().over(Window.partitionBy("page").orderBy("first", "path")))
    return known.join(number, ["page", "path"]).select("page", "pos", "ref", "path", "number")


#: Bounds of the images that one page brings along, in bytes and in number.
IMAGE_BYTES, IMAGES_BYTES, IMAGES_COUNT = 20 << 20, 200 << 20, 500
_IMAGE = r"(!\[[^\]]*\]\()(\s*)([^)\s]+)([^)]*)\)"


def rewritten_images(pages: DataFrame, files: DataFrame, one: int = IMAGE_BYTES, all_of: int = IMAGES_BYTES, count: int = IMAGES_COUNT) -> DataFrame:
    """``(page, text, images, skipped, error)`` of ``pages(page, text)``: references to images of ``files(path, size)`` point to copies of the page's own.

    A copy is ``images/<stem>/<stem>-<number><ending>``, numbered by first appearance of its file; images lists ``(number, source,
    name, size)``, skipped counts references that stay as they are.  error: count, size or total, whichever bound the first image
    past one breaks, in this order; such a page gets no text.  Paths are relative to one root, references to their page's folder.
    """
    part = lambda k: F.regexp_extract_all("text", F.lit(_IMAGE), F.lit(k))
    cut = pages.select("page", "text", F.split("text", _IMAGE).alias("outside"), part(1).alias("head"), part(2).alias("gap"), part(3).alias("ref"), part(4).alias("rest"))
    refs = _placed_refs(cut.select("page", F.posexplode("ref").alias("pos", "ref"))).where(T.image_ref_admitted(T.normal_path("path")))
    known = refs.join(files.select("path", "size").distinct(), "path").select("page", "pos", "path", "size")
    stem = F.regexp_replace(T.basename("page"), r"(?s)(?<=.)\.[^.]+$", "")
    first = known.groupBy("page", "path").agg(F.min("pos").alias("first"), F.max("size").alias("size"))
    w = Window.partitionBy("page").orderBy("first")  # the images of a page
    first = first.withColumns({"number": F.row_number().over(w), "total": F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    broken = F.when(F.col("number") > count, "count").when(F.col("size") > one, "size").when(F.col("total") > all_of, "total")
    first = first.withColumns({"name": F.concat(stem, F.lit("-"), F.col("number").cast("string"), T.suffix(T.basename("path"))), "broken": broken})
    first = materialize(first.select("page", "path", "number", "size", "name", "broken"), "images")
    listed = first.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("number", F.col("path").alias("source"), "name", "size"))).alias("images"), F.min_by("broken", F.when(F.col("broken").isNotNull(), F.col("number"))).alias("error"))
    new = known.select("page", "pos", "path").join(first.select("page", "path", "name"), ["page", "path"]).groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("pos", "name"))).alias("names"))
    rows = cut.join(listed, "page", "left").join(new, "page", "left")
    url = lambda i: F.coalesce(F.concat(F.lit("images/"), stem, F.lit("/"), F.try_element_at("names", i)), F.get("ref", i))
    woven = F.transform("outside", lambda x, i: F.concat(x, F.when(i < F.size("ref"), F.concat(F.get("head", i), F.get("gap", i), url(i), F.get("rest", i), F.lit(")"))).otherwise("")))
    empty = F.array().cast("array<struct<number:int,source:string,name:string,size:bigint>>")
    images = F.coalesce(F.transform("images", lambda x: F.struct(x["number"].cast("int").alias("number"), x["source"].alias("source"), x["name"].alias("name"), x["size"].cast("long").alias("size"))), empty)
    return rows.select("page", F.when(F.col("error").isNull(), F.array_join(woven, "")).alias("text"), images.alias("images"), (F.size("ref") - F.coalesce(F.size("names"), F.lit(0))).alias("skipped"), "error")


def _placed_refs(refs: DataFrame) -> DataFrame:
    """``refs(page, ref)`` that aren't external, and what they mean from the page's folder; paths are relative to one root."""
    folder = F.regexp_extract("page", r"(?s)^(.*/)?[^/]*$", 1)
    return refs.where(~T.external_ref("ref")).withColumn("path", T.normal_path(F.concat(folder, T.decoded_ref("ref")))).withColumn("folder", folder)


def image_lint(refs: DataFrame, files: DataFrame) -> DataFrame:
    """``(page, ref, state)`` of the references that aren't external: ok, misplaced or dangling.

    ok: an image under ``images/<stem of the page>/`` beside it.  misplaced: an image elsewhere, or none there but just one file of
    that name, in any case, somewhere under ``images/``; either can be mended.  dangling: neither, or several of that name.
    """
    rows = _placed_refs(refs).withColumn("name", F.lower(F.regexp_extract(T.decoded_ref("ref"), r"([^/]*)$", 1)))
    own = F.concat("folder", F.lit("images/"), F.regexp_replace(T.basename("page"), r"(?s)(?<=.)\.[^.]+$", ""), F.lit("/"))
    images = files.select("path").distinct().where(T.suffix(T.basename("path")).isin(*T.IMAGE_SUFFIXES))
    names = images.where(F.startswith("path", F.lit("images/"))).groupBy(F.lower(T.basename("path")).alias("name")).agg(F.count("*").alias("n"))
    rows = rows.join(images.withColumn("there", F.lit(True)), "path", "left").join(names, "name", "left")
    here = F.col("there").isNotNull()
    state = F.when(here & F.startswith("path", own), "ok").when(here | (F.col("n") == 1), "misplaced").otherwise("dangling")
    return rows.select("page", "ref", state.alias("state"))


def image_garbage(files: DataFrame, refs: DataFrame) -> DataFrame:
    return files.join(refs.select(T.normal_path("ref").alias("path")).distinct(), "path", "left_anti").select("path")


def same_fingerprint(planned: DataFrame, now: DataFrame) -> DataFrame:
    """``(ok)``: nothing that a plan read has changed or gone since."""
    both = planned.join(now.select("path", F.col("fp").alias("now")), "path", "left")
    return both.agg(F.coalesce(F.bool_and(F.coalesce(F.col("fp") == F.col("now"), F.lit(False))), F.lit(True)).alias("ok"))


def undo_plan(journal: DataFrame, now: DataFrame) -> DataFrame:
    """``(path, restore)``: a file is restored only if it still is as the turn left it; journal: (path, before, after)."""
    return journal.join(now, "path", "left").select("path", F.col("after").eqNullSafe(F.col("fp")).alias("restore"))
