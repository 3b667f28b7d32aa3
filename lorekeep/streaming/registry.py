"""Ids that were seen and sessions that live, as keyed state with bounds; the same rules in a stream and over a sorted table.

State is kept by scope (a bot, a tenant): within one, ids and sessions are bounded in number, and what is given up is the oldest
of the scope.  The rules work on a small table of names; in a stream that is map state, over sorted rows a dictionary.
"""

from __future__ import annotations

import heapq
from collections import namedtuple
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lorekeep.plans.store import materialize

#: How long an id counts as seen, how many are held, to how many they are cut, how long a silent session lives.
SEEN_SECONDS, SEEN_MOST, SEEN_KEPT, IDLE_SECONDS, TOMBSTONES = 300, 4096, 3072, 1800, 1024
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Names(dict):
    """Name to (time, live) over rows in memory.  Heaps of living and silent names by time hold stale entries too, which are passed over."""

    def __init__(self):
        super().__init__()
        self.heaps: tuple[list, list] = ([], [])  # silent, living
        self.silent = 0

    def put(self, name: str, at: int, live: bool = True) -> None:
        self.drop(name)
        self[name] = (at, live)
        self.silent += not live
        heapq.heappush(self.heaps[live], (at, name))
        if len(self.heaps[live]) > 2 * len(self) + 64:  # stale ones outnumber the others
            self.heaps[live][:] = sorted((seen, n) for n, (seen, alive) in self.items() if alive == live)

    def drop(self, name: str) -> None:
        known = self.pop(name, None)
        self.silent -= known is not None and not known[1]

    def clear(self) -> None:
        super().clear()
        self.__init__()

    def retire(self, before: int, but: str) -> None:
        """Living names last seen before a time become silent ones, except one."""
        living = self.heaps[True]
        while living and living[0][0] < before:
            seen, name = heapq.heappop(living)
            if name != but and self.get(name) == (seen, True):
                self.put(name, seen, False)

    def forget(self, most: int, but: str) -> None:
        """Of more than ``most`` silent names those silent longest go, except one."""
        silent, kept = self.heaps[False], None
        while self.silent > most and silent:
            seen, name = heapq.heappop(silent)
            if self.get(name) == (seen, False):
                if name == but:
                    kept = (seen, name)
                else:
                    self.drop(name)
        if kept is not None:
            heapq.heappush(silent, kept)


class StateNames:
    """The same over map state; how many names there are is kept beside it."""

    def __init__(self, handle):
        self.map = handle.getMapState("names", "name string", "at long, live boolean")
        self.count = handle.getValueState("count", "n long")

    def __len__(self) -> int:
        return self.count.get()[0] if self.count.exists() else 0

    def get(self, name: str):
        return tuple(self.map.getValue((name,))) if self.map.containsKey((name,)) else None

    def put(self, name: str, at: int, live: bool = True) -> None:
        if not self.map.containsKey((name,)):
            self.count.update((len(self) + 1,))
        self.map.updateValue((name,), (at, live))

    def drop(self, name: str) -> None:
        if self.map.containsKey((name,)):
            self.map.removeKey((name,))
            self.count.update((len(self) - 1,))

    def items(self) -> list:
        return [(k[0], tuple(v)) for k, v in self.map.iterator()]

    def clear(self) -> None:
        self.map.clear()
        self.count.clear()

    def retire(self, before: int, but: str) -> None:
        for name, (seen, live) in self.items():
            if live and name != but and seen < before:
                self.put(name, seen, False)

    def forget(self, most: int, but: str) -> None:
        silent = sorted((seen, name) for name, (seen, live) in self.items() if not live)
        over = len(silent) - most
        for _, name in silent:
            if over > 0 and name != but:
                self.drop(name)
                over -= 1


def fresh(names, name: str, at: int, span: int, most: int | None, kept: int) -> bool:
    """Whether a message's id wasn't accepted within ``span`` before; accepted ids are held, beyond ``most`` (None: any number) the expired and then the oldest go."""
    before = names.get(name)
    if before is not None and at - before[0] <= span:
        return False
    names.put(name, at)
    if most is not None and len(names) > most:
        for other, (seen, _) in list(names.items()):
            if at - seen > span:
                names.drop(other)
        held = sorted((seen, other) for other, (seen, _) in names.items())
        for _, other in held[: max(0, len(held) - kept)]:
            names.drop(other)
    return True


def acquired(names, session: str, at: int, span: int, tombstones: int, present: bool) -> str:
    """What a message finds: first, existing, expired, or lost if the session should live but its object is gone (``present`` is false).

    Only where a session is made anew, those silent for longer than ``span`` become tombstones, which remember that they expired; beyond the
    bound the tombstones silent longest are forgotten.  A living session never is, nor the one being made.
    """
    known = names.get(session)
    state = "first" if known is None else "expired" if not known[1] or at - known[0] > span else "existing" if present else "lost"
    if state != "existing":
        if state == "expired":
            names.put(session, at, False)
        names.retire(at - span, session)
        names.forget(tombstones, session)
    names.put(session, at)
    return state


class _Stateful(StatefulProcessor):
    def init(self, handle) -> None:
        self.handle, self.names = handle, StateNames(handle)

    def close(self) -> None:
        pass


class _Seen(_Stateful):
    def __init__(self, seconds: int, most: int, kept: int):
        self.span, self.most, self.kept = seconds * 1_000_000, most, kept

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        last = 0
        for r in sorted(rows, key=lambda r: (r.at, r.msg_id)):
            last = r.at
            if fresh(self.names, r.msg_id, r.at, self.span, self.most, self.kept):
                yield Row(scope=key[0], msg_id=r.msg_id, at=r.at)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        # once time has passed all of them nothing is held: the state of a silent scope goes
        self.handle.registerTimer(max((last + self.span) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.names.clear()
        return iter(())


class _Sessions(_Stateful):
    def __init__(self, seconds: int, tombstones: int):
        self.span, self.tombstones = seconds * 1_000_000, tombstones

    def init(self, handle) -> None:
        super().init(handle)
        self.gone = handle.getMapState("gone", "session string", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for r in sorted(rows, key=lambda r: (r.at, r.msg_id)):
            if r.kind == "drop":
                self.names.drop(r.session)
                self.gone.removeKey((r.session,))
            elif r.kind == "vanish":
                self.gone.updateValue((r.session,), (r.at,))
            else:
                state = acquired(self.names, r.session, r.at, self.span, self.tombstones, not self.gone.containsKey((r.session,)))
                self.gone.removeKey((r.session,))
                yield Row(scope=key[0], session=r.session, msg_id=r.msg_id, at=r.at, state=state)


def _source(events: DataFrame, *columns: str) -> DataFrame:
    at = F.unix_micros("ts").alias("at")
    return events.select(F.col("scope").cast("string").alias("scope"), at, F.col("msg_id").cast("string").alias("msg_id"), *columns)


def dedup_stream(msgs: DataFrame, seconds: int = SEEN_SECONDS, most: int = SEEN_MOST, kept: int = SEEN_KEPT, late: str = "0 seconds") -> DataFrame:
    """``(scope, msg_id, ts)`` of the accepted of ``(scope, msg_id, ts)``; see :func:`fresh`.  The session's state store must be :data:`STATE_STORE`."""
    source = _source(msgs.withWatermark("ts", late), "ts")
    out = source.groupBy("scope").transformWithState(_Seen(seconds, most, kept), "scope string, msg_id string, at long", "Append", "EventTime")
    return out.select("scope", "msg_id", F.timestamp_micros("at").alias("ts"))


def session_stream(events: DataFrame, seconds: int = IDLE_SECONDS, tombstones: int = TOMBSTONES) -> DataFrame:
    """``(scope, session, msg_id, ts, state)`` of the messages among ``(scope, session, msg_id, ts, kind)``; kind: message, drop (begun anew by the user) or vanish (its object was lost)."""
    source = _source(events, F.col("session").cast("string").alias("session"), "kind")
    out = source.groupBy("scope").transformWithState(_Sessions(seconds, tombstones), "scope string, session string, msg_id string, at long, state string", "Append", "None")
    return out.select("scope", "session", "msg_id", F.timestamp_micros("at").alias("ts"), "state")


def _told(source: DataFrame, name: str, bound: int | None, schema: str, told) -> DataFrame:
    """Rows sorted by time, each told with the state of its scope: one bounded table of names at a time.

    A scope of no more names than ``bound`` never gives one up, so its names know nothing of each other: they are dealt and told one by one.
    """
    part = F.col(name)
    if bound is not None:
        full = materialize(source.groupBy("scope").agg(F.countDistinct(name).alias("n")).where(F.col("n") > bound).select(F.col("scope").alias("full")), "full")
        if not full.isEmpty():
            source = source.join(full.withColumn("whole", F.lit(True)), F.col("scope").eqNullSafe(F.col("full")), "left")
            part = F.when(F.col("whole").isNull(), part)
    source = source.withColumn("part", part).drop("full", "whole")
    row = namedtuple("row", names := source.columns)
    fields = pa.schema([(n, {"string": pa.string(), "long": pa.int64()}[k]) for n, k in (x.split() for x in schema.split(", "))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for r in map(row._make, zip(*[batch.column(c).to_pylist() for c in names], strict=True)):
                if state is None or (r.scope, r.part) != key:
                    key, state = (r.scope, r.part), (Names(), set())
                if (found := told(r, *state)) is not None:
                    out.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(fields), fields.types, strict=True)], schema=fields)

    return source.repartition("scope", "part").sortWithinPartitions("scope", "part", "at", "msg_id").mapInArrow(scan, schema)


def dedup_batch(msgs: DataFrame, seconds: int = SEEN_SECONDS, most: int | None = SEEN_MOST, kept: int = SEEN_KEPT) -> DataFrame:
    """:func:`dedup_stream` over a table; ``most`` None: ids without a bound on their number."""

    def told(r, names, _):
        return (r.scope, r.msg_id, r.at) if fresh(names, r.msg_id, r.at, seconds * 1_000_000, most, kept) else None

    return _told(_source(msgs), "msg_id", most, "scope string, msg_id string, at long", told).select("scope", "msg_id", F.timestamp_micros("at").alias("ts"))


def session_batch(events: DataFrame, seconds: int = IDLE_SECONDS, tombstones: int = TOMBSTONES) -> DataFrame:
    """:func:`session_stream` over a table."""

    def told(r, names, gone):
        if r.kind == "drop":
            names.drop(r.session)
        if r.kind == "vanish":
            gone.add(r.session)
            return None
        present = r.session not in gone
        gone.discard(r.session)
        if r.kind == "drop":
            return None
        return (r.scope, r.session, r.msg_id, r.at, acquired(names, r.session, r.at, seconds * 1_000_000, tombstones, present))

    source = _source(events, F.col("session").cast("string").alias("session"), "kind")
    return _told(source, "session", tombstones, "scope string, session string, msg_id string, at long, state string", told).select("scope", "session", "msg_id", F.timestamp_micros("at").alias("ts"), "state")
