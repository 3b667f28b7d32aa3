"""The link graph: nodes, edges, in-links, hubs, communities and fragile places.

``nodes(id, title, type, path)`` and ``edges(source, target, resolved)`` are long tables; no adjacency is built outside
the two traversals that need an order (communities, low-links), which run per connected component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import biconnect, community
from lorekeep.operators.resolve import page_links, resolution_table, resolve
from lorekeep.plans.components import connected_components
from lorekeep.plans.ranks import ranked
from lorekeep.plans.store import discard, materialize

HUB_SIGMA, HUB_MIN_DEGREE, MIN_COMMUNITY, MIN_SIDE, MIN_PIECE, MIN_GAIN = 2.0, 5, 2, 2, 2, 1e-7


def graph_nodes(pages: DataFrame) -> DataFrame:
    return pages.where("not is_config").select(
        F.col("stem").alias("id"), T.page_title("title", "stem").alias("title"), T.page_type("type").alias("type"), "path")


def _met(links: DataFrame, pages: DataFrame, fold) -> DataFrame:
    """``links`` and ``(owner, to_config, target)``; links: a written table, read for its distinct stems and for its rows."""
    # stems meet their pages first: links without a page, often half of all, would meet in one task on a join by owner
    stems = resolve(links.select("stem").distinct(), materialize(resolution_table(pages, fold), "keys"), fold=fold)  # probed twice
    owners = pages.select(F.col("path").alias("owner"), F.col("is_config").alias("to_config"), T.link_stem("path").alias("owner_stem")).distinct()
    found = links.join(stems.where("owner is not null").join(owners, "owner"), "stem", "left")
    return found.select(*links.columns, "owner", F.coalesce("to_config", F.lit(False)).alias("to_config"), F.coalesce("owner_stem", "stem").alias("target"))


def resolved_links(pages: DataFrame, fold=T.fold_stem) -> DataFrame:
    """``(path, source, pos, raw, stem, owner, to_config, target)`` of every link; source and target are keys, of an unknown target that of the link."""
    return _met(materialize(page_links(pages), "links"), pages, fold)


def graph_edges(pages: DataFrame, links: DataFrame | None = None, fold=T.fold_stem) -> DataFrame:
    """Distinct ``(source, target, resolved)``: links to settings pages are dropped, self loops stay, unknown targets are their key."""
    links = _met(materialize(page_links(pages).select("source", "stem"), "links"), pages, fold) if links is None else links
    return links.where("not to_config").select("source", "target", F.col("owner").isNotNull().alias("resolved")).distinct()


def inlink_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, n)``: resolved links from other pages, 0 included."""
    counts = edges.where("resolved and source <> target").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n"))
    return nodes.select("id").distinct().join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def backlinks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("id", "path").join(inlink_counts(nodes, edges), "id").select("path", "n")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    linked = edges.where("resolved and source <> target").select(F.col("target").alias("id")).distinct()
    return nodes.join(linked, "id", "left_anti")


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct pairs ``(u, v)``, u < v, of resolved links between different pages."""
    return edges.where("resolved and source <> target").select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).distinct()


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(id, n)`` of the ends of :func:`undirected` links, numbered in the order of ids, and the links ``(a, b)`` by number, a < b, each once.

    Two written tables, made once for each ``edges`` and kept beside it: communities, fragile places and what is told of them read the same.
    """
    made = getattr(edges, "_lorekeep_numbered", None)
    if made is None:
        pairs = materialize(undirected(edges), "pairs")
        ids = materialize(ranked(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "id", name="n"), "ids")
        number = lambda c, n: ids.select(F.col("id").alias(c), F.col("n").alias(n))
        links = materialize(pairs.join(number("u", "a"), "u").join(number("v", "b"), "v").select("a", "b"), "numbered")
        discard(pairs)
        made = edges._lorekeep_numbered = (ids, links)
    return made


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    if hasattr(edges, "_lorekeep_numbered"):
        ids, links = numbered(edges)
        ends = links.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count("*").alias("degree")).join(ids, "n")
    else:
        ends = undirected(edges).select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").distinct().join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def hub_nodes(nodes: DataFrame, edges: DataFrame, sigma: float = HUB_SIGMA, least: int = HUB_MIN_DEGREE) -> DataFrame:
    """``(id, degree)`` of nodes at or above mean + sigma deviations (of all nodes) and ``least``; highest first."""
    d = materialize(degrees(nodes, edges), "degrees")  # for the bar and for the nodes above it
    bar = d.agg((F.avg("degree") + sigma * F.stddev_pop("degree")).alias("bar"))
    return d.join(F.broadcast(bar)).where((F.col("degree") >= F.col("bar")) & (F.col("degree") >= least)).select("id", "degree").orderBy(F.desc("degree"), "id")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)``: the least id of the component; lonely nodes are their own."""
    found = connected_components(undirected(edges), "u", "v")
    return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, community)``: communities of :mod:`lorekeep.operators.community`, numbered from 0 by least member; lonely nodes are their own."""
    ids, links = numbered(edges)  # in the order of ids, so least members stay least
    number = lambda c, n: ids.select(F.col("id").alias(c), F.col("n").alias(n))
    found = community.communities(links, single=True)
    named = found.select(F.col("id").alias("n"), F.col("community").alias("c")).join(ids, "n").join(number("least", "c"), "c").select("id", "least")
    out = materialize(nodes.select("id").distinct().join(named, "id", "left").withColumn("least", F.coalesce("least", "id")), "labelled")
    return out.join(ranked(out.select("least").distinct(), "least", name="community"), "least").select("id", "community")


def community_quality(edges: DataFrame, com: DataFrame) -> DataFrame:
    """``(links, communities, modularity)`` of a partition, over the linked nodes."""
    return community.modularity(undirected(edges).select(F.col("u").alias("a"), F.col("v").alias("b")), com)


def crossing(edges: DataFrame, com: DataFrame) -> DataFrame:
    """``(a, b, ca, cb)``: undirected links between communities, ends by the numbers of :func:`numbered`; a written table."""
    ids, links = numbered(edges)
    sides = materialize(ids.join(com, "id").select("n", "community"), "sides")
    side = lambda c: sides.select(F.col("n").alias(c), F.col("community").alias(f"c{c}"))
    return materialize(links.join(side("a"), "a").join(side("b"), "b").where("ca <> cb").select("a", "b", "ca", "cb"), "crossing")


def thin_links(edges: DataFrame, com: DataFrame, crossed: DataFrame | None = None) -> DataFrame:
    """``(a, b, u, v)``: pairs of communities that a single undirected link joins; crossed: :func:`crossing`, if it is made."""
    crossed = crossing(edges, com) if crossed is None else crossed
    pair = [F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")]
    single = crossed.groupBy(*pair).agg(F.count("*").alias("n"), F.min(F.struct(F.col("a").alias("x"), F.col("b").alias("y"))).alias("e")).where("n = 1").select("a", "b", "e.x", "e.y")
    name = lambda n, c: numbered(edges)[0].select(F.col("n").alias(n), F.col("id").alias(c))
    return single.join(name("x", "u"), "x").join(name("y", "v"), "y").select("a", "b", "u", "v").orderBy("a", "b")


def isolated_communities(edges: DataFrame, com: DataFrame, least: int = MIN_COMMUNITY, crossed: DataFrame | None = None) -> DataFrame:
    """``(community, size, id)``: a row a member of communities of ``least`` or more without an outer link, if there are several communities."""
    crossed = crossing(edges, com) if crossed is None else crossed
    sizes = com.groupBy("community").agg(F.count("*").alias("size"))
    linked = crossed.select(F.explode(F.array("ca", "cb")).alias("community")).distinct()
    several = sizes.agg(F.count("*").alias("n"))
    lonely = sizes.where(F.col("size") >= least).join(linked, "community", "left_anti").join(F.broadcast(several)).where("n > 1").drop("n")
    return com.join(materialize(lonely, "lonely"), "community").select("community", "size", "id").orderBy("community", "id")


def fragile_places(edges: DataFrame) -> DataFrame:
    """``(kind, u, v, side)``: bridges (u, v) and cut vertices (u), with the size of the smaller side or second-largest piece."""
    ids, links = numbered(edges)  # in the order of ids, so ends stay in order
    number = lambda c, n: ids.select(F.col("id").alias(c), F.col("n").alias(n))
    tree = biconnect.tree_edges(links, single=True)
    over = biconnect.bridges(tree).where(F.col("side") >= MIN_SIDE).join(number("u", "a"), "a").join(number("v", "b"), "b")
    cut = biconnect.cut_vertices(tree).where(F.col("side") >= MIN_PIECE).join(number("u", "a"), "a")
    return over.select(F.lit("bridge").alias("kind"), "u", "v", F.col("side").cast("int").alias("side")).unionByName(
        cut.select(F.lit("cut_vertex").alias("kind"), "u", F.lit(None).cast("string").alias("v"), F.col("side").cast("int").alias("side")))


def graph_stats(nodes: DataFrame, edges: DataFrame, com: DataFrame, fragile: DataFrame) -> DataFrame:
    parts = [
        nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count_if("resolved").alias("edges"), F.count_if(~F.col("resolved")).alias("broken")),
        orphans(nodes, edges).agg(F.count("*").alias("orphans")), com.agg(F.countDistinct("community").alias("communities")),
        fragile.agg(F.count_if(F.col("kind") == "bridge").alias("bridges"), F.count_if(F.col("kind") == "cut_vertex").alias("cut_vertices"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return out


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per line of a stable JSON form: nodes by id, then edges by (source, target)."""
    n = nodes.select(F.lit(0).alias("part"), F.col("id").alias("k1"), F.lit("").alias("k2"), F.to_json(F.struct("id", "title", "type", "path")).alias("line"))
    e = edges.select(F.lit(1).alias("part"), F.col("source").alias("k1"), F.col("target").alias("k2"), F.to_json(F.struct("source", "target", "resolved")).alias("line"))
    return materialize(n.unionByName(e), "lines").orderBy("part", "k1", "k2").select("part", "line")  # Spark reads the rows twice to sort them
