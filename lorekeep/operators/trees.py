"""Trees of files as hash trees: the difference of two snapshots enters only folders whose hashes differ.

A folder's hash sums, lane by lane, the digests of its children's names and hashes, so it doesn't depend on their order, is summed
before any shuffle, and no task holds a folder's children.  Levels are built from the deepest up: as many rounds as the tree is deep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.plans.store import materialize


def _parent(path: str = "path") -> Column:
    """The folder of a path; of a top-level name the empty path, of that nothing."""
    return F.when(F.col(path) != "", F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(""))


def _lanes(x: Column) -> list[Column]:
    """Four 64-bit parts of a digest, as numbers that can be summed without loss."""
    digest = F.sha2(x, 256)
    return [F.sum(F.conv(F.substring(digest, 1 + 16 * k, 16), 16, 10).cast("decimal(38,0)")).alias(f"lane{k}") for k in range(4)]


def hash_tree(snapshot: DataFrame) -> DataFrame:
    """``(path, parent, depth, fp, folder)`` of ``snapshot(path, fp)``: its rows and all folders above them, the root with the empty path; a written table."""
    files = snapshot.select("path", "fp").where("path not in ('', '.')")
    level = F.size(F.split("path", "/"))
    rows = materialize(files.select("path", _parent().alias("parent"), level.alias("depth"), "fp", F.lit(False).alias("folder")), "files")
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    done, below = rows, None
    for depth in range(deepest, 0, -1):
        here = rows.where(F.col("depth") == depth)
        children = here if below is None else here.unionByName(below)
        # a folder that is a row of its own, as snapshots mark them, gives way to its hash but keeps its mark in it
        name = F.concat_ws("\x00", "path", F.when(F.col("folder"), "dir").otherwise("file"), "fp")
        sums = children.groupBy("parent").agg(*_lanes(name), F.count("*").alias("n"))
        fp = F.sha2(F.concat_ws(":", *[F.col(f"lane{k}").cast("string") for k in range(4)], F.col("n").cast("string")), 256)
        folders = sums.select(F.col("parent").alias("path"), _parent("parent").alias("parent"), F.lit(depth - 1).alias("depth"), fp.alias("fp"), F.lit(True).alias("folder"))
        below = materialize(folders, "folders")
        done = done.unionByName(below)
    return materialize(done, "tree")


def tree_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(path, change)`` of files: removed, added or modified between two :func:`hash_tree` tables."""
    differing = None
    frontier = before.where("path = '' and folder").select("path", F.col("fp").alias("f0")).join(after.where("path = '' and folder").select("path", F.col("fp").alias("f1")), "path", "full")
    frontier = materialize(frontier.where(~F.col("f0").eqNullSafe(F.col("f1"))).select("path"), "frontier")
    while not frontier.isEmpty():
        parents = frontier.select(F.col("path").alias("parent"))
        side = lambda tree, c: tree.join(parents, "parent", "left_semi").select("path", "folder", F.col("fp").alias(c))  # noqa: B023, E731
        both = materialize(side(before, "f0").join(side(after, "f1"), ["path", "folder"], "full").where(~F.col("f0").eqNullSafe(F.col("f1"))), "differing")
        change = F.when(F.col("f1").isNull(), "removed").when(F.col("f0").isNull(), "added").otherwise("modified")
        found = both.where("not folder").select("path", change.alias("change"))
        differing = found if differing is None else differing.unionByName(found)
        frontier = both.where("folder").select("path")
    return before.select("path", F.lit("").alias("change")).limit(0) if differing is None else differing
