"""Messages and sessions in batch form: the exact twins of the streaming operators, and session catalogues."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as T

DEDUP_SECONDS, SESSION_SECONDS = 300, 1800


def dedup_messages(msgs: DataFrame, seconds: int = DEDUP_SECONDS) -> DataFrame:
    """Messages whose id wasn't accepted ``seconds`` or less before; a repeat does not renew the time of the first.

    Each id's messages are read in order of time with one number at hand; of equal times the first by the other columns counts.
    """
    own = msgs.columns
    order = ["msg_id", "ts", *[F.col(c).cast("string") for c in own if c not in ("msg_id", "ts")]]
    rows = msgs.select(F.struct(*own).alias("row"), F.col("msg_id").cast("string").alias("id"), F.unix_micros("ts").alias("at"), *[(F.col(x) if isinstance(x, str) else x).alias(f"o{k}") for k, x in enumerate(order)])
    rows = rows.repartition("id").sortWithinPartitions("id", "at", *[f"o{k}" for k in range(len(order))]).select("id", "at", "row")

    def first(batches):
        known, last = None, None
        for batch in batches:
            keep = []
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fresh = name != known or last is None or at - last > seconds * 1_000_000
                known, last = name, at if fresh else last
                keep.append(fresh)
            yield batch.filter(pa.array(keep)).select(["row"])

    return rows.mapInArrow(first, rows.select("row").schema).select("row.*")


def debounce(msgs: DataFrame, quiet: float = 1.0, long_quiet: float = 3.0, most: int = 1000, key: str = "session") -> DataFrame:
    """``(session, first_ts, last_ts, n, text)``: parts of a session merged until it is quiet; one of the four commands ends the merge before it and stands alone.

    A part's own deadline replaces the one before: ``long_quiet`` seconds after a part of 0.9 of the most characters.  Parts are trimmed and
    empty ones left out of the text, though they count and prolong; a merge without any text is no message.
    """
    w = Window.partitionBy(key).orderBy("ts", "msg_id")
    rows = msgs.withColumn("x", T.command("text")).withColumns({"cmd": F.col("x.kind") != "prose", "text": F.when(F.col("x.kind") == "prose", F.col("x.argument")).otherwise(F.col("text"))})
    gap = F.when(F.char_length("text") >= 0.9 * most, long_quiet).otherwise(quiet)
    rows = rows.withColumn("due", F.unix_micros("ts") + (gap * 1_000_000).cast("long"))
    new = F.lag("due").over(w).isNull() | (F.unix_micros("ts") >= F.lag("due").over(w)) | F.col("cmd") | F.lag("cmd").over(w)
    rows = rows.withColumn("part", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy(key, "part").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("ts", "msg_id", "text"))).alias("p"))
    texts = F.filter(F.transform("p", lambda x: x["text"]), lambda x: x != "")
    return merged.select(key, "first_ts", "last_ts", "n", F.array_join(texts, "\n").alias("text")).where("text <> ''")


def session_states(msgs: DataFrame, seconds: int = SESSION_SECONDS, key: str = "session") -> DataFrame:
    """``msgs`` and the column state: first, existing, or expired after ``seconds`` of silence."""
    before = F.lag("ts").over(Window.partitionBy(key).orderBy("ts", "msg_id"))
    idle = F.unix_micros("ts") - F.unix_micros(before)
    return msgs.withColumn("state", F.when(before.isNull(), "first").when(idle > seconds * 1_000_000, "expired").otherwise("existing"))


def idle_reclaim(sessions: DataFrame, now, seconds: int = SESSION_SECONDS, most: int = 100) -> DataFrame:
    """``(session, reason)`` of sessions to close: idle too long, or the least recent beyond ``most``."""
    rows = sessions.withColumns({"idle": F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("last_ts") > seconds * 1_000_000})
    live = rows.where("not idle").select("session", "last_ts")
    kept = live.orderBy(F.desc("last_ts"), "session").limit(most).select("session")  # a top-k of bounded size, no task that sees all sessions
    over = live.join(F.broadcast(kept), "session", "left_anti").select("session", F.lit("cap").alias("reason"))
    return rows.where("idle").select("session", F.lit("idle").alias("reason")).unionByName(over)


def busy_rejections(turns: DataFrame, key: str = "session") -> DataFrame:
    """``turns`` and the column rejected: the turn begins while an earlier one of its session runs; turns: (session, start, end)."""
    running = F.max("end").over(Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    return turns.withColumn("rejected", F.coalesce(F.col("start") < running, F.lit(False)))


def goal_budget(turns: DataFrame, most_turns: int = 25, most_minutes: float = 120.0, key: str = "session") -> DataFrame:
    """``(session, stopped_at, reason)``: the first turn that spends the budget of turns or minutes."""
    w = Window.partitionBy(key).orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.withColumns({"n": F.count("*").over(w), "spent": F.sum("minutes").over(w)})
    over = rows.where((F.col("n") >= most_turns) | (F.col("spent") >= most_minutes))
    return over.groupBy(key).agg(F.min_by(F.struct("turn", F.when(F.col("n") >= most_turns, "turns").otherwise("time").alias("reason")), "turn").alias("s")).select(key, F.col("s.turn").alias("stopped_at"), F.col("s.reason").alias("reason"))


def merged_catalogue(live: DataFrame, stored: DataFrame, tag: str | None = None) -> DataFrame:
    """Sessions in memory and on disk, one row an id: memory wins, then the newest; live rows first, then cold ones, newest first."""
    cold = stored if tag is None else stored.where(F.col("skill") == tag)
    both = live.select("id", "title", "updated_at", F.lit(0).alias("prio")).unionByName(cold.select("id", "title", "updated_at", F.lit(1).alias("prio")))
    n = F.row_number().over(Window.partitionBy("id").orderBy("prio", F.desc("updated_at"), "title"))
    return both.withColumn("n", n).where("n = 1").select("id", "title", "updated_at", (F.col("prio") == 0).alias("live")).orderBy(F.desc("live"), F.desc("updated_at"), "id")


def stale_snapshots(stored: DataFrame, session_id: str) -> DataFrame:
    return stored.where(F.col("id") == session_id).select("file")


def last_snapshots(stored: DataFrame) -> DataFrame:
    """``(id, saved_at, file)``: the last stored snapshot of each session; of equal times the last file name."""
    return stored.groupBy("id").agg(F.max(F.struct("saved_at", "file")).alias("s")).select("id", "s.saved_at", "s.file")


def filtered_pages(pages: DataFrame, needle: str) -> DataFrame:
    """Pages whose title or path holds ``needle`` in any case, by type."""
    hit = F.contains(F.lower("title"), F.lit(needle.lower())) | F.contains(F.lower("path"), F.lit(needle.lower()))
    return pages.where(hit).orderBy("type", "path")


def chart_problems(rows: DataFrame, fields: DataFrame, most: int = 1000) -> DataFrame:
    """``(chart, problem)``: too many inline rows, or an encoded field that no row has; rows: (chart, values map), fields: (chart, field)."""
    many = rows.groupBy("chart").agg(F.count("*").alias("n")).where(F.col("n") > most).select("chart", F.lit("rows").alias("problem"))
    known = rows.select("chart", F.explode(F.map_keys("values")).alias("field")).distinct()
    return many.unionByName(fields.join(known, ["chart", "field"], "left_anti").select("chart", F.concat(F.lit("field "), "field").alias("problem")))
