"""Command line over a knowledge base: check, health, lint, graph, search, reindex, remove, list, init.

Exit codes: 0 fine, 1 a wrong call, 3 no knowledge base, 4 blocking findings, 6 advisory findings with ``--strict``.
"""

from __future__ import annotations

import argparse
import html
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import checks, graph, maintain, search
from lorekeep.operators import index as index_lines
from lorekeep.sources import wiki


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("lorekeep").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", os.environ.get("LOREKEEP_PARTITIONS", "8")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def graph_html(nodes: DataFrame, edges: DataFrame) -> str:
    """A static page: each node with what it links to."""
    by: dict[str, list[str]] = {}
    for r in edges.where("resolved").orderBy("source", "target").collect():
        by.setdefault(r["source"], []).append(r["target"])
    rows = "".join(f"<li><b>{html.escape(n['title'])}</b> {html.escape(', '.join(by.get(n['id'], [])))}</li>" for n in nodes.orderBy("id").collect())
    return f"<!DOCTYPE html><meta charset='utf-8'><title>Graph</title><ul>{rows}</ul>"


def _print(rows: DataFrame, as_json: bool, pages: DataFrame, name: str) -> int:
    rows = rows.cache()
    if as_json:
        print(checks.report_json(rows, pages.where("not is_config").count(), name))
    else:
        for r in rows.collect():
            print(" | ".join(str(x) for x in r if x is not None))
    return rows.count()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lorekeep")
    p.add_argument("--root", default=".")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb in ("check", "health", "lint", "graph", "list", "init", "reindex"):
        v = verbs.add_parser(verb)
        v.add_argument("--json", action="store_true")
        v.add_argument("--strict", action="store_true")
    s = verbs.add_parser("search")
    s.add_argument("query")
    s.add_argument("--limit", type=int, default=10)
    s.add_argument("--json", action="store_true")
    verbs.add_parser("remove").add_argument("slug")
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    if a.verb == "init":
        print("\n".join(wiki.init_base(a.root)))
        return 0
    folder = os.path.join(a.root, "wiki")
    if not os.path.isdir(folder):
        print(f"no wiki in {a.root}", file=sys.stderr)
        return 3
    spark = _session()
    pages = wiki.parse_pages(wiki.page_files(spark, folder)).cache()
    index = pages.where("path = 'index.md'").select("text")
    if a.verb == "check":
        return 4 if _print(checks.check(pages), a.json, pages, "violations") else 0
    if a.verb in ("health", "lint"):
        found = checks.health(pages, index) if a.verb == "health" else checks.lint(pages, search.documents_of(pages))
        return 6 if _print(found, a.json, pages, "findings") and a.strict else 0
    nodes, edges = graph.graph_nodes(pages), graph.graph_edges(pages).cache()
    if a.verb == "graph":
        wiki.write_atomically(os.path.join(a.root, "graph.json"), "\n".join(r["line"] for r in graph.graph_json(nodes, edges).collect()) + "\n")
        wiki.write_atomically(os.path.join(a.root, "graph.html"), graph_html(nodes, edges))
    elif a.verb == "list":
        for r in wiki.page_list(pages).orderBy("path").collect():
            print(r["path"], r["title"], r["type"], sep=" | ")
    elif a.verb == "search":
        docs = search.documents_of(pages)
        if a.limit < 1 or not any(c.isalnum() for c in a.query):
            print("a query needs a word, and a limit of 1 or more", file=sys.stderr)
            return 1
        hits = [r.asDict() for r in search.search(docs, a.query, a.limit, graph.backlinks(nodes, edges).withColumnRenamed("path", "page")).collect()]
        print(json.dumps({"ok": True, "query": a.query, "pages_searched": docs.count(), "results": hits}, ensure_ascii=False) if a.json else "\n".join(f"{h['rank']}. {h['page']} {h['score']} {h['snippet']}" for h in hits))
    elif a.verb == "reindex":
        lines = index_lines.lines_of(index, F.lit("index.md"))
        targets = checks.index_targets(lines)
        missing = pages.join(checks.index_missing(pages, targets).select("page").withColumnRenamed("page", "path"), "path", "left_semi")
        plan = maintain.index_plan(missing).select(F.lit("index.md").alias("key"), "section", "path", F.col("line").alias("x"))
        gone = checks.index_dangling(pages, targets).select(F.lit("index.md").alias("key"), F.col("detail").alias("target"))
        rows = index_lines.inserted(index_lines.pruned(lines, gone), plan).orderBy("line", "sub").select("x").toLocalIterator()
        wiki.write_atomically(os.path.join(folder, "index.md"), "".join(r["x"] + "\n" for r in rows))
    elif a.verb == "remove":
        for r in maintain.remove_plan(pages, a.slug).orderBy("path").collect():
            print(r["action"], r["path"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
