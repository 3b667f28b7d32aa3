"""Connected components by repeated contraction.

Each round every vertex adopts the neighbour (or itself) with the smallest random priority, and the edges
are rewritten between adopters.  Priorities are fresh hashes in each round, so a path as well as a star
shrinks by a constant factor in expectation and the number of rounds is logarithmic.  All work is grouped
aggregation with a fixed-size state (``min``) and equi-joins whose one side is unique on the key: a hub
costs partial aggregates and a split join side, never a task that holds all its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.plans.store import discard, materialize


#: Pointers that a round of joins follows towards a root.
JUMPS = 4


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for each vertex of the undirected ``edges``; component: the least id in it.

    Null ends and self loops carry no link; a vertex with self loops only is returned alone.  Ids may be of
    any orderable type (numbers, strings, structs).  No edges: an empty table.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    todo = materialize(pairs.distinct(), "edges")
    member = todo.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("at"))
    member = materialize(member, "members")
    todo_live = todo.where("a <> b")
    turn = 0
    while not todo_live.isEmpty():
        both = todo_live.select("a", "b").unionByName(todo_live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        adopt = (
            both.groupBy("a").agg(F.min(rank("b")).alias("best"))
            .select(F.col("a").alias("from"), F.least(rank("a"), F.col("best"))["v"].alias("to"))
        )
        adopt = materialize(adopt, "adopt")
        left = todo_live.join(adopt, todo_live["a"] == adopt["from"]).select(F.col("to").alias("a"), "b")
        moved = left.join(adopt, left["b"] == adopt["from"]).select("a", F.col("to").alias("b"))
        moved = moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        next_todo = materialize(moved, "edges")
        next_member = materialize(
            member.join(adopt, member["at"] == adopt["from"], "left").select("id", F.coalesce("to", "at").alias("at")), "members"
        )
        discard(todo, member, adopt)
        todo, todo_live, member = next_todo, next_todo, next_member
        turn += 1
    least = member.groupBy("at").agg(F.min("id").alias("component"))
    return member.join(least, "at").select("id", "component")


def roots(pointers: DataFrame) -> DataFrame:
    """``(a, to)`` with each ``to`` moved along the ``pointers(a, to)`` to its root, which points to itself; a written table.

    A round goes four pointers on, so a way of n pointers takes log n rounds to the base of five.
    """
    while True:
        at = pointers
        for _ in range(JUMPS):
            at = at.select("a", F.col("to").alias("via")).join(pointers.select(F.col("a").alias("via"), "to"), "via")
        moved = materialize(at.select("a", "to", (F.col("via") != F.col("to")).alias("open")), "roots")
        if moved.where("open").isEmpty():
            return moved
        pointers = moved.select("a", "to")
