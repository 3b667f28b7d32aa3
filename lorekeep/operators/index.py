"""Indexes as tables of lines ``(key, line, x)``: comments, links, lines to take out and lines to put in.

Whether a line lies in a comment depends on all lines before it, but only through the last comment mark: a value that is carried
along the ordered lines from range partition to range partition.  No index is one row, and none passes the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.plans.ranks import carried

_MARK = r"<!--|-->"
SECTION = r"^##[ \t]+(.*?)[ \t]*$"


def lines_of(texts: DataFrame, key: Column | str, text: str = "text") -> DataFrame:
    """``(key, line, x)`` of texts that are rows; lines from 0, line breaks left out."""
    return texts.select(T.col(key).alias("key"), F.posexplode(T.split_lines(text)).alias("line", "x"))


def _marks(lines: DataFrame) -> DataFrame:
    """``(key, line, k, open, own, nearest)``: every comment mark; own: nothing but blanks between it and its end of the line; nearest: (open, own, line) of the next mark."""
    found = F.regexp_extract_all("x", F.lit(f"({_MARK})"), F.lit(1))
    starts, ends = F.col("x").rlike(r"^[ \t]*<!--"), F.col("x").rlike(r"-->[ \t]*$")
    each = lines.where(F.col("x").rlike(_MARK)).select("key", "line", F.posexplode(found).alias("k", "mark"), F.size(found).alias("n"), starts.alias("starts"), ends.alias("ends"))
    is_open = F.col("mark") == "<!--"
    own = F.when(is_open, (F.col("k") == 0) & F.col("starts")).otherwise((F.col("k") == F.col("n") - 1) & F.col("ends"))
    marks = each.select("key", "line", "k", F.struct(is_open.alias("open"), own.alias("own"), "line").alias("mark"))
    return carried(marks, ["key"], ["line", "k"], "mark", "nearest", descending=True)


def comment_lines(lines: DataFrame) -> DataFrame:
    """``(key, line)`` of lines that are comment and nothing else: from a mark that opens its line to the next mark, if that closes its own."""
    whole = _marks(lines).where("mark.open and mark.own and nearest is not null and not nearest.open and nearest.own")
    inside = whole.select("key", F.explode(F.sequence("line", "nearest.line")).alias("line")).distinct()
    return inside


def touched_lines(lines: DataFrame) -> DataFrame:
    """``(key, line)`` of lines that hold a comment mark or stand behind an opening one, closed or not: such lines are never taken out."""
    last = F.when(F.col("x").rlike(_MARK), F.element_at(F.regexp_extract_all("x", F.lit(f"({_MARK})"), F.lit(1)), -1))
    state = carried(lines.select("key", "line", last.alias("last")), ["key"], ["line"], "last", "before")  # the text itself doesn't move
    return state.where((F.col("before") == "<!--") | F.col("last").isNotNull()).select("key", "line")


def line_links(lines: DataFrame) -> DataFrame:
    """``(key, line, targets)``: distinct local link targets of each line that has some and isn't comment."""
    each = lines.select("key", "line", T.line_targets("x").alias("targets")).where(F.size("targets") > 0)
    return each.join(comment_lines(lines), ["key", "line"], "left_anti")


def targets(lines: DataFrame) -> DataFrame:
    """``(key, target)``, distinct."""
    return line_links(lines).select("key", F.explode("targets").alias("target")).distinct()


def dangling_lines(lines: DataFrame, dangling: DataFrame) -> DataFrame:
    """``(key, line)`` of lines to take out: all their links dangle, and no comment touches them; dangling: ``(key, target)``."""
    each = line_links(lines).select("key", "line", F.explode("targets").alias("target"))
    gone = dangling.select("key", "target", F.lit(True).alias("gone")).distinct()
    lost = each.join(gone, ["key", "target"], "left").groupBy("key", "line").agg(F.bool_and(F.coalesce("gone", F.lit(False))).alias("gone")).where("gone")
    return lost.select("key", "line").join(touched_lines(lines), ["key", "line"], "left_anti")


def pruned(lines: DataFrame, dangling: DataFrame) -> DataFrame:
    """The lines that stay, with their numbers."""
    return lines.join(dangling_lines(lines, dangling), ["key", "line"], "left_anti").select(*lines.columns)


def inserted(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """``(key, line, sub, x)`` in the order of line and sub: the lines and those of ``plan(key, section, path, x)``.

    New lines go behind the last filled line of their section, in the order of their paths; sections that the index lacks come at its
    end, each with a heading of its own.  Lines keep their numbers, those put in have a sub above 0.
    """
    rows = carried(lines.withColumn("head", F.when(F.col("x").rlike("^#"), F.regexp_extract("x", SECTION, 1))), ["key"], ["line"], "head", "above")
    rows = rows.withColumn("section", F.coalesce("head", "above"))
    # of several sections of one name the first takes the lines: it ends where another heading comes
    heads = rows.where("head <> ''").groupBy("key", F.col("head").alias("section")).agg(F.min("line").alias("at"))
    runs = carried(lines.withColumn("start", F.when(F.col("x").rlike("^#"), F.col("line"))), ["key"], ["line"], "start", "since")
    filled = runs.where(T.strip("x") != "").withColumn("at", F.coalesce("start", "since")).groupBy("key", "at").agg(F.max("line").alias("last"))
    spots = heads.join(filled, ["key", "at"]).select("key", "section", "last")
    end = lines.groupBy("key").agg(F.max("line").alias("end"))
    new = plan.join(spots, ["key", "section"], "left").join(end, "key", "left")
    here = new.where("last is not null").select("key", F.col("last").alias("line"), F.struct(F.lit(1).alias("a"), F.lit("").alias("b"), F.col("path").alias("c")).alias("sub"), "x")
    late = new.where("last is null").withColumn("line", F.coalesce(F.col("end") + 1, F.lit(0)))
    below = late.select("key", "line", F.struct(F.lit(1).alias("a"), F.col("section").alias("b"), F.concat(F.lit("2"), "path").alias("c")).alias("sub"), "x")
    heading = late.select("key", "line", "section").distinct()
    above = heading.select("key", "line", "section", F.posexplode(F.array(F.lit(""), F.concat(F.lit("## "), "section"), F.lit(""))).alias("n", "x"))
    above = above.select("key", "line", F.struct(F.lit(1).alias("a"), F.col("section").alias("b"), F.concat(F.lit("1"), F.col("n").cast("string")).alias("c")).alias("sub"), "x")
    old = lines.select("key", "line", F.struct(F.lit(0).alias("a"), F.lit("").alias("b"), F.lit("").alias("c")).alias("sub"), "x")
    return old.unionByName(here).unionByName(above).unionByName(below)
