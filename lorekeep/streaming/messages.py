"""Message streams: dedup, debounce and session states with event time; batch twins are in operators.sessions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text as T


def dedup_stream(msgs: DataFrame, seconds: int = 300) -> DataFrame:
    """First message of each id within a watermark of ``seconds``; state is dropped as the watermark passes."""
    return msgs.withWatermark("ts", f"{seconds} seconds").dropDuplicatesWithinWatermark(["msg_id"])


def debounce_stream(msgs: DataFrame, quiet: float = 1.0, long_quiet: float = 3.0, most: int = 1000, late: str = "0 seconds") -> DataFrame:
    """``(session, first_ts, last_ts, n, text)``: parts merged as :func:`lorekeep.operators.sessions.debounce` does.  Each part replaces the deadline; a command flushes."""
    schema = "session string, first_ts timestamp, last_ts timestamp, n bigint, text string"

    def merge(key, batches, state):
        held = list(state.get[0]) if state.exists else []  # (micros, msg_id, text)
        out = []

        def flush(parts):
            if text := "\n".join(p[2] for p in parts if p[2]):
                out.append((key[0], pd.Timestamp(parts[0][0], unit="us"), pd.Timestamp(parts[-1][0], unit="us"), len(parts), text))

        def due(part):
            return part[0] + int((long_quiet if len(part[2]) >= 0.9 * most else quiet) * 1e6)

        new = sorted((r.ts.value // 1000, r.msg_id, r.text, r.cmd) for b in batches for r in b.itertuples()) if not state.hasTimedOut else []
        for *part, cmd in new:
            if held and part[0] >= due(held[-1]):
                flush(held)
                held = []
            if cmd:
                flush(held)
                flush([part])
                held = []
            else:
                held = [*held, part]
        if state.hasTimedOut or (held and due(held[-1]) <= state.getCurrentWatermarkMs() * 1000):
            flush(held)
            held = []
        if held:
            state.update(([list(p) for p in held],))
            state.setTimeoutTimestamp(max(due(held[-1]) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["session", "first_ts", "last_ts", "n", "text"])

    held_type = "held array<struct<at: bigint, msg_id: string, text: string>>"
    x = T.command("text")
    prose = x["kind"] == "prose"
    source = msgs.withWatermark("ts", late).select("session", "ts", F.col("msg_id").cast("string").alias("msg_id"), F.when(prose, x["argument"]).otherwise(F.col("text")).alias("text"), (~prose).alias("cmd"))
    return source.groupBy("session").applyInPandasWithState(merge, schema, held_type, "append", "EventTimeTimeout")


def session_stream(msgs: DataFrame, seconds: int = 1800, late: str = "0 seconds") -> DataFrame:
    """``(session, msg_id, ts, state)``: first, existing or expired; a silent session's state is kept as one number."""

    def tell(key, batches, state):
        last = state.get[0] if state.exists else None
        rows = []
        for at, msg in sorted((r.ts.value // 1000, r.msg_id) for b in batches for r in b.itertuples()):
            rows.append((key[0], msg, pd.Timestamp(at, unit="us"), "first" if last is None else "expired" if at - last > seconds * 1_000_000 else "existing"))
            last = at
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(rows, columns=["session", "msg_id", "ts", "state"])

    source = msgs.withWatermark("ts", late).select("session", "ts", F.col("msg_id").cast("string").alias("msg_id"))
    return source.groupBy("session").applyInPandasWithState(tell, "session string, msg_id string, ts timestamp, state string", "last bigint", "append", "NoTimeout")
