"""Filter interaction audit: what each filter of a cascade removes, in every order of the filters.

A document is only its failure mask, the set of filters it fails, so all documents of a part with one mask are one
weight.  Orders are ranked by their Lehmer code, that is lexicographically, so all orders with the same first filters are
one interval of ranks.  Where a prefix holds no failed filter and the next one is failed, the document is removed at that
step in the whole interval; behind it, a failed filter is redundant in the interval of the longer prefix.  Each mask thus
gives a few interval ends: its count is added at the first rank and taken off behind the last, and a prefix sum over the
ranks gives the totals of every order and step.

The interval ends are a table of the filters alone (five: some 8,000 rows), so it is broadcast.  Documents are shuffled as rows
of an id, a digest and a mask.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.quality import words_of
from lorekeep.plans.store import materialize

LETTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, MARKS = 200, 50, 2, r"[#$%&*|]"
TOTALS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def interval_ends(n: int) -> list[tuple[int, int, int, int, int, int]]:
    """``(mask, step, rank, kept, removed, redundant)``: changes, 1 or -1, of what a document of this mask counts as from this rank on.

    A mask has bit f set if filter f is failed; ranks run from 0 to n! (behind the last).  Ends that cancel are left out.
    """
    ends: dict[tuple[int, int, int], list[int]] = {}

    def mark(mask: int, step: int, first: int, size: int, what: int) -> None:
        for rank, sign in ((first, 1), (first + size, -1)):
            ends.setdefault((mask, step, rank), [0, 0, 0])[what] += sign

    def walk(prefix: tuple[int, ...], first: int) -> None:
        """``first``: the rank of the first order that begins with ``prefix``."""
        step = len(prefix) + 1
        size = factorial(n - step)
        seen = sum(1 << f for f in prefix)
        for digit, f in enumerate(x for x in range(n) if x not in prefix):
            start = first + digit * size
            for mask in range(1 << n):
                if mask & seen:
                    if mask >> f & 1:
                        mark(mask, step, start, size, 2)
                else:
                    mark(mask, step, start, size, mask >> f & 1)
            if step < n:
                walk((*prefix, f), start)

    walk((), 0)
    return [(*key, *x) for key, x in sorted(ends.items()) if any(x)]


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """``(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)`` for every part, order and step.

    counts: ``(part, mask, docs, good, toxic)``, any number of rows a mask; a mask's bit f stands for ``letters[f]``.
    shapley: what the filter removes, summed over all orders.  An empty table gives an empty one.
    """
    spark, n = counts.sparkSession, len(letters)
    ends = spark.createDataFrame(interval_ends(n), "mask int, step int, rank int, k int, r int, d int")
    orders = spark.createDataFrame([(i, "".join(p)) for i, p in enumerate(permutations(letters))], "rank int, filter_order string")
    per_mask = counts.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("docs", "good", "toxic")])
    single = F.when(F.bit_count("mask") == 1, F.col("docs")).otherwise(0)
    changes = per_mask.join(F.broadcast(ends), "mask").select(
        "part", "step", "rank", (F.col("k") * F.col("docs")).alias("kept"), (F.col("r") * F.col("docs")).alias("removed"),
        (F.col("d") * F.col("docs")).alias("redundant"), (F.col("r") * single).alias("unique_fails"),
        (F.col("r") * F.col("good")).alias("good_lost"), (F.col("r") * F.col("toxic")).alias("toxic_lost"))
    grid = per_mask.select("part").distinct().select("part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    grid = grid.select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(factorial(n) - 1))).alias("rank"), *[F.lit(0).cast("long").alias(c) for c in TOTALS])
    summed = changes.unionByName(grid).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in TOTALS])
    w = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    totals = summed.select("part", "step", "rank", *[F.sum(c).over(w).alias(c) for c in TOTALS])
    named = totals.join(F.broadcast(orders), "rank").withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley")
    return named.select("part", "filter_order", "step", "filter", *[F.col(c).cast("long").alias(c) for c in TOTALS], shapley)


def text_failures(text: Column) -> Column:
    """Bits of the four filters that a text alone decides: few words, few different words, many capitals, marks."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    counted = F.element_at(F.transform(F.array(words_of(t)), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("k"))), 1)
    return F.element_at(F.transform(F.array(counted), lambda c: (
        F.when(c["n"] < MIN_WORDS, 1).otherwise(0) + F.when(100 * c["k"] < MIN_DISTINCT_PERCENT * c["n"], 2).otherwise(0)
        + F.when(100 * F.char_length(F.regexp_replace(t, "[^A-Z]+", "")) > MAX_UPPER_PERCENT * F.char_length(t), 4).otherwise(0)
        + F.when(t.rlike(MARKS), 8).otherwise(0))), 1)


def failure_counts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``(part, mask, docs, good, toxic)``: documents by the filters they fail; good and toxic: those labelled so.

    The fifth filter fails a document whose text a smaller id has anywhere in the table.  Texts are equal if their SHA-256
    is.  Rows of one id and text are one another's equals, so all of the least id pass; a null id is neither smaller nor
    larger than another, so it never fails the fifth and makes none fail.  A null text is empty, a null part the empty
    string; of several labels of an id, any 1 counts.  Every row counts, repeated ones too.  A very long text is held
    with the list of its words by one task.  Other columns, whatever they are called, aren't read.

    Copies are summed before they meet: by id, text and part first, then by text, part and label, with the least id and how
    many rows it has.  A text's rows after that are as many as the parts that hold it.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest"), text_failures(F.col(text)).alias("mask"))
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    # written, so that both sides of the join are plain exchanges, of which Spark can split a hot id
    rows = rows.join(materialize(known, "labels"), "id", "left").fillna(0, ["good", "toxic"])
    groups = rows.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.min("id").alias("first"), F.min_by("n", "id").alias("n_first"))
    least = F.min("first").over(Window.partitionBy("digest"))
    passing = F.col("n_null") + F.when(F.col("first") == least, F.col("n_first")).otherwise(0)
    told = groups.withColumn("passing", passing).select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))).alias("x"))
    told = told.select("part", "good", "toxic", "x.mask", "x.n").where("n > 0")
    return told.groupBy("part", "mask").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def filter_audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """:func:`audit` of the five filters over whole texts, with the nulls and ties of :func:`failure_counts`."""
    return audit(materialize(failure_counts(docs, labels, doc_id, text, part), "masks"))
