"""Bounded ids and sessions: rules by hand, batch against a plain run over all rows, stream against batch."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lorekeep.streaming import registry

SECOND = 1_000_000


def at(s):
    return datetime(2024, 1, 1) + timedelta(seconds=s)


def test_ids_are_seen_for_a_while_and_bounded():
    names = registry.Names()
    seen = lambda name, s, most=10, kept=7: registry.fresh(names, name, s * SECOND, 300 * SECOND, most, kept)
    assert [seen("m", s) for s in (0, 299, 300, 301, 601, 602)] == [True, False, False, True, False, True]
    names.clear()
    assert all(seen(f"i{k}", k) for k in range(10)) and len(names) == 10
    assert seen("i10", 10) and sorted(names) == sorted(f"i{k}" for k in range(4, 11))  # cut to seven, the oldest gone
    assert seen("i3", 11) and not seen("i4", 12)
    for k in range(20, 22):
        seen(f"i{k}", k)
    assert seen("late", 1000) and set(names) == {"late"}  # past the bound the expired go first


def test_sessions_leave_bounded_tombstones():
    names = registry.Names()
    get = lambda name, s, present=True: registry.acquired(names, name, s * SECOND, 100 * SECOND, 2, present)
    assert [get("a", 0), get("a", 100), get("a", 201), get("a", 210, False), get("a", 220)] == ["first", "existing", "expired", "lost", "existing"]
    assert [get(x, 300) for x in "bcd"] == ["first"] * 3
    assert get("e", 500) == "first" and sorted(n for n, (_, live) in names.items() if not live) == ["c", "d"]  # a and b were silent longest and are forgotten; equal times by name
    assert [get("a", 501), get("d", 502), get("e", 503)] == ["first", "expired", "existing"]
    assert {"a", "d", "e"} <= {n for n, (_, live) in names.items() if live}


def messages(n=400):
    rng = random.Random(6)
    rows, now = [], 0.0
    for k in range(n):
        now += rng.choice([0, 1, 20, 90])
        rows.append((rng.choice("xy"), f"s{rng.randrange(12)}", f"{k:05}", at(now), rng.choice(["message"] * 6 + ["drop", "vanish"]), f"id{rng.randrange(30)}"))
    return rows


SCHEMA = "scope string, session string, msg_id string, ts timestamp, kind string, id string"


def plain_sessions(rows, span, tombstones):
    out, state = [], {}
    for scope, session, msg, ts, kind, _ in sorted(rows, key=lambda r: (r[3], r[2])):
        names, gone = state.setdefault(scope, (registry.Names(), set()))
        if kind == "drop":
            names.drop(session)
            gone.discard(session)
        elif kind == "vanish":
            gone.add(session)
        else:
            out.append((msg, registry.acquired(names, session, int((ts - at(0)).total_seconds()) * SECOND, span * SECOND, tombstones, session not in gone)))
            gone.discard(session)
    return sorted(out)


def run(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return stream.sparkSession.table(name)


def test_streams_equal_batches(spark, tmp_path):
    rows = messages()
    table = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.msg_id, r.state) for r in registry.session_batch(table, 200, 3).collect())
    assert got == plain_sessions(rows, 200, 3) and {s for _, s in got} == {"first", "existing", "expired", "lost"}
    for k in range(4):  # several batches in order of time
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/m")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", registry.STATE_STORE)
    try:
        stream = lambda: spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/m")
        told = run(registry.session_stream(stream(), 200, 3), "sessions_told")
        assert sorted((r.msg_id, r.state) for r in told.collect()) == got
        ids = lambda df: df.select("scope", F.col("id").alias("msg_id"), "ts")
        kept = run(registry.dedup_stream(ids(stream()), 100, 12, 9), "ids_kept")
        want = registry.dedup_batch(ids(table), 100, 12, 9)
        assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, want.collect())) and kept.count() < 400
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_ids_without_a_bound_are_all_remembered(spark):
    """More ids than a scope holds by default: none is forgotten within the span."""
    n = registry.SEEN_MOST + 500
    rows = spark.range(2 * n).selectExpr("'x' AS scope", f"cast(id % {n} AS string) AS msg_id", "timestamp_micros(id * 1000) AS ts")
    assert registry.dedup_batch(rows, 300, most=None).count() == n < registry.dedup_batch(rows, 300).count()


def acquired_by_scans(names, session, at, span, tombstones, present):
    """The rule with plain scans of a dictionary."""
    known = names.get(session)
    state = "first" if known is None else "expired" if not known[1] or at - known[0] > span else "existing" if present else "lost"
    if state != "existing":
        if state == "expired":
            names[session] = (at, False)
        for other, (seen, live) in list(names.items()):
            if live and other != session and at - seen > span:
                names[other] = (seen, False)
        silent = sorted((seen, other) for other, (seen, live) in names.items() if not live)
        over = len(silent) - tombstones
        for _, other in silent:
            if over > 0 and other != session:
                del names[other]
                over -= 1
    names[session] = (at, True)
    return state


def test_heaps_of_names_equal_scans():
    rng = random.Random(3)
    for bound in (0, 1, 3, 20):
        fast, plain, now = registry.Names(), {}, 0
        for _ in range(1500):
            now += rng.choice([0, 1, 5, 30])
            name, present = f"s{rng.randrange(25)}", rng.random() < 0.8
            if rng.random() < 0.1:
                fast.drop(name)
                plain.pop(name, None)
            assert registry.acquired(fast, name, now, 50, bound, present) == acquired_by_scans(plain, name, now, 50, bound, present)
            assert dict(fast) == plain


def test_many_sessions_take_a_step_each():
    """A new session doesn't look at all others: a hundred thousand in one scope end at once."""
    import time

    names, began = registry.Names(), time.process_time()
    assert {registry.acquired(names, f"s{k}", k * SECOND, 60 * SECOND, 10**6, True) for k in range(100_000)} == {"first"}
    assert time.process_time() - began < 20 and len(names) == 100_000
