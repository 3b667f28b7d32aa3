"""Near-duplicate documents: SetSketch registers, banded, estimated by likelihood and verified on full sets.

1. One pass over the texts gives each document's shingle-set fingerprint and registers (Ertl's SetSketch: minima of
   exponential hashes, truncated to steps of a power of ``BASE``).  Equal sets form a class; only classes go on.
2. Classes that share the registers of a band meet.  Each band bucket names its least class as centre, so a bucket
   costs as many (centre, member) rows as it has members, never all pairs.
3. The members of a centre are dealt into blocks of bounded weight.  Within a block the joint likelihood of the
   registers picks the pairs worth a look, and the full sets decide.  Pairs already connected are skipped, and a
   block emits a spanning forest, so a tight group costs a linear number of comparisons and rows.
4. Where a group has several blocks and isn't one component after that, the members outside its main component
   meet all other blocks.  Every pair that shares a bucket is thus either connected or compared: no caps.

A pair at a similarity of 0.8 misses all bands with probability 5e-6, while unrelated texts seldom share one; the likelihood filter keeps five
standard errors below the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.plans.components import connected_components
from lorekeep.plans.store import discard, materialize

BASE, RATE, LIMIT = 1.2, 20.0, 255
BANDS, BAND_ROWS = 56, 8
REGISTERS = BANDS * BAND_ROWS
#: Shingles that a block of documents holds at most, about; a document counts as LIGHTEST at least.
BLOCK_WEIGHT, LIGHTEST = 200_000, 64
#: The ids of documents with candidates are broadcast up to this size, which their count is checked against.
BROADCAST_BYTES = 64 << 20
_RNG = np.random.default_rng(20210)
_MULTIPLY = (_RNG.integers(0, 2**32, REGISTERS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 2**32, REGISTERS, dtype=np.uint64).astype(np.uint32)
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _WordHashes(dict):
    """64-bit hashes of words as seen; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, known: _WordHashes, size: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; of the whole sequence if it is shorter; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(size, len(h))
    out = np.full(len(h) - width + 1, np.uint64(width))
    for k in range(width):
        out = _mix(out * _C1 + h[k : len(h) - width + 1 + k] * _C2)
    return np.unique(out)


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a non-empty set; mergeable by maximum."""
    short, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(REGISTERS, 2**32 - 1, np.uint32)
    room = np.empty((min(64, len(short)), REGISTERS), np.uint32)
    for at in range(0, len(short), 64):
        part = short[at : at + 64]
        np.multiply(part[:, None], _MULTIPLY, out=room[: len(part)])
        room += _ADD
        np.minimum(least, room[: len(part)].min(axis=0), out=least)
    exponential = -np.log1p(-(least + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LIMIT).astype(np.uint8)


def likelihood_jaccard(more: np.ndarray, less: np.ndarray, same: np.ndarray, n_a, n_b) -> np.ndarray:
    """Jaccard similarity that makes the counts of greater, smaller and equal registers likeliest, given both set sizes."""
    u = np.asarray(n_a / (n_a + n_b), float)
    v = 1 - u
    probability = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def fit(j):
        p, q = probability(u - v * j), probability(v - u * j)
        return more * np.log(np.maximum(p, 1e-12)) + less * np.log(np.maximum(q, 1e-12)) + same * np.log(np.maximum(1 - p - q, 1e-12))

    low, high = np.zeros(np.broadcast(u, same).shape), np.broadcast_to(np.minimum(u / v, v / u), np.broadcast(u, same).shape).copy()
    for _ in range(24):
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        left = fit(a) > fit(b)
        high, low = np.where(left, b, high), np.where(left, low, a)
    return (low + high) / 2


def _features(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    known = _WordHashes()
    for batch in batches:
        ids, n, fp1, fp2, reg = batch.column(0), [], [], [], []
        for text in batch.column(1):
            s = shingle_set(text.as_py(), known, size)
            n.append(len(s))
            fp1.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
            fp2.append(int(np.bitwise_xor.reduce(_mix(s * _C3)).view(np.int64)) if len(s) else 0)
            reg.append(registers(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64()), pa.array(reg, pa.binary())],
            names=["doc", "n", "fp1", "fp2", "registers"])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    known = _WordHashes()
    for batch in batches:
        sets = [shingle_set(t.as_py(), known, size) for t in batch.column(1)]
        fp1 = [int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(fp1, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc", "fp1", "shingles"])


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while not np.array_equal(self.up, up := self.up[self.up]):
            self.up = up
        return self.up


def linked_forest(sets: list[np.ndarray], reg: np.ndarray, probes: np.ndarray, labels: list, percent: int) -> list[tuple[int, int]]:
    """Verified links that connect what the probes' links connect; rows of equal labels count as connected from the start."""
    m = len(sets)
    n = np.array([len(s) for s in sets])
    first: dict = {}
    forest = _Forest(m)
    for i, label in enumerate(labels):
        forest.up[i] = first.setdefault(label, i)
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(ids.max() + 1, bool)
    share = percent / 100
    floor_est = share - 5 * np.sqrt(share * (1 - share) / REGISTERS)
    links = []
    for i in np.flatnonzero(probes):
        root = forest.roots()
        others = np.flatnonzero((root != root[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
        if not len(others):
            continue
        same = (reg[others] == reg[i]).sum(axis=1)
        keep = same >= REGISTERS * (floor_est - 0.1)
        others, same = others[keep], same[keep]
        if not len(others):
            continue
        more = (reg[others] < reg[i]).sum(axis=1)
        others = others[likelihood_jaccard(more, REGISTERS - same - more, same, n[i], n[others]) >= floor_est]
        if not len(others):
            continue
        own = ids[starts[i] : starts[i] + n[i]]
        mark[own] = True
        shared = np.array([np.count_nonzero(mark[ids[starts[j] : starts[j] + n[j]]]) for j in others])
        mark[own] = False
        for j in others[100 * shared >= percent * (n[i] + n[others] - shared)]:
            root = forest.roots()
            if root[i] != root[j]:
                forest.up[root[j]] = root[i]
                links.append((int(i), int(j)))
    return links


_LINKS = "a struct<doc: bigint, fp1: bigint>, b struct<doc: bigint, fp1: bigint>"


def _block_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (centre, block_a, block_b); the links of each such group go out."""
    schema = pa.schema([(k, pa.struct([("doc", pa.int64()), ("fp1", pa.int64())])) for k in "ab"])
    rows: dict = {}
    group = None

    def solved():
        if len(rows) < 2:
            return None
        ids = list(rows)
        sets = [np.frombuffer(rows[k][0], np.uint64) for k in ids]
        reg = np.stack([np.frombuffer(rows[k][1], np.uint8) for k in ids])
        found = linked_forest(sets, reg, np.array([rows[k][2] for k in ids]), [rows[k][3] for k in ids], percent)
        as_row = lambda k: {"doc": ids[k][0], "fp1": ids[k][1]}
        return pa.RecordBatch.from_pylist([{"a": as_row(i), "b": as_row(j)} for i, j in found], schema) if found else None

    for batch in batches:
        for r in batch.to_pylist():
            key = (r["c_doc"], r["c_fp1"], r["block_a"], r["block_b"])
            if key != group:
                if (out := solved()) is not None:
                    yield out
                rows, group = {}, key
            old = rows.get(at := (r["doc"], r["fp1"]))
            rows[at] = (r["shingles"], r["registers"], r["probe"] or bool(old and old[2]), (r["l_doc"], r["l_fp1"]))
    if (out := solved()) is not None:
        yield out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs``.

    Two documents link if their sets of distinct ``shingle_words``-word shingles (A-Z lower-cased, words split at ASCII
    white space) have a Jaccard similarity of ``percent`` % or more.  component_id: least id reachable over links.
    Fewer words than a shingle: the whole sequence is the only shingle.  Null, empty or blank text: an empty set,
    linked with nothing.  Repeated rows and equal texts link; rows that share an id but not a text stay apart unless
    linked.  A null id gets a null component.  Other columns of ``docs`` are ignored.  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    features = materialize(
        source.mapInArrow(lambda b: _features(b, shingle_words), "doc bigint, n bigint, fp1 bigint, fp2 bigint, registers binary"), "features")
    classes = materialize(
        features.where("n > 0 and doc is not null").groupBy("fp1", "fp2", "n").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"), F.first("registers").alias("registers")), "classes")
    cid = F.struct("doc", "fp1")
    band = lambda k: F.xxhash64(k, F.substring("registers", k * BAND_ROWS + 1, F.lit(BAND_ROWS)))
    bands = classes.select(cid.alias("id"), "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("key"))
    buckets = bands.groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("members")).where("members > 1").drop("members")
    pairs = materialize(
        bands.join(buckets, "key").where("id <> centre").select("centre", "id", F.greatest("n", F.lit(LIGHTEST)).alias("w")).distinct(), "pairs")
    weights = pairs.groupBy("centre").agg(F.sum("w").alias("w")).select("centre", F.ceil(F.col("w") / BLOCK_WEIGHT).cast("int").alias("blocks"))
    weights = materialize(weights, "weights")
    needed = materialize(pairs.select(F.explode(F.array("centre", "id")).alias("id")).distinct().select("id.*"), "needed")
    wanted = needed.select("doc").distinct()
    if needed.count() * 64 <= BROADCAST_BYTES:  # a long in a hash table; beyond that the texts are shuffled
        wanted = F.broadcast(wanted)
    sets = materialize(
        source.join(wanted, "doc", "left_semi").select("doc", "text")
        .mapInArrow(lambda b: _sets(b, shingle_words), "doc bigint, fp1 bigint, shingles binary")
        .join(needed, ["doc", "fp1"], "left_semi").dropDuplicates(["doc", "fp1"])
        .join(classes.select("doc", "fp1", "registers"), ["doc", "fp1"]), "sets")

    def links(rows: DataFrame) -> DataFrame:
        """rows: centre, block_a, block_b, id, probe, label."""
        flat = rows.select(
            F.col("centre.doc").alias("c_doc"), F.col("centre.fp1").alias("c_fp1"), "block_a", "block_b", F.col("id.doc").alias("doc"),
            F.col("id.fp1").alias("fp1"), "probe", F.col("label.doc").alias("l_doc"), F.col("label.fp1").alias("l_fp1"))
        key = ["c_doc", "c_fp1", "block_a", "block_b"]
        full = flat.join(sets, ["doc", "fp1"]).repartition(*key).sortWithinPartitions(*key)
        return materialize(full.mapInArrow(lambda b: _block_links(b, percent), _LINKS), "links")

    dealt = pairs.join(weights, "centre").select("centre", "id", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block_a"))
    centres = weights.select("centre", F.col("centre").alias("id"), "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block_a"))
    inside = links(dealt.unionByName(centres).select("centre", "block_a", F.lit(0).alias("block_b"), "id", F.lit(True).alias("probe"), F.col("id").alias("label")))
    member = materialize(connected_components(inside), "components")

    wide = weights.where("blocks > 1")
    if not wide.isEmpty():
        label = lambda name: member.select(F.col("id").alias(name), F.col("component").alias(f"{name}_label"))
        rows = dealt.where("blocks > 1").join(label("id"), "id", "left").join(label("centre"), "centre", "left")
        rows = rows.select("centre", "id", "blocks", "block_a", F.coalesce("id_label", "id").alias("label"), F.coalesce("centre_label", "centre").alias("main"))
        rows = materialize(rows, "labelled")
        outside = rows.where("label <> main")
        load = outside.join(classes.select(cid.alias("id"), "n"), "id").groupBy("centre").agg(
            F.ceil(F.sum(F.greatest("n", F.lit(LIGHTEST))) / BLOCK_WEIGHT).cast("int").alias("probe_blocks"))
        load = materialize(load, "load")
        probing = outside.join(load, "centre").select(
            "centre", F.pmod(F.xxhash64("id", F.lit(1)), F.col("probe_blocks")).cast("int").alias("block_a"),
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block_b"), "id", F.lit(True).alias("probe"), "label")
        probed = rows.join(load, "centre").select(
            "centre", F.explode(F.sequence(F.lit(0), F.col("probe_blocks") - 1)).alias("block_a"), F.col("block_a").alias("block_b"), "id", F.lit(False).alias("probe"), "label")
        across = links(probing.unionByName(probed))
        linked = inside.unionByName(across)
        # what is connected already stays so: the first round's links go in as well
        member = materialize(connected_components(linked), "components")
        discard(rows, load, across)

    final = classes.join(member.select(F.col("id.doc").alias("doc"), F.col("id.fp1").alias("fp1"), F.col("component.doc").alias("top")), ["doc", "fp1"], "left")
    final = final.where("copies > 1 or top is not null").select("fp1", "fp2", "n", F.coalesce("top", "doc").alias("component_id"))
    out = features.select("doc", "n", "fp1", "fp2").join(final, ["fp1", "fp2", "n"], "left")
    out = out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))
    discard(pairs, needed, sets, inside)
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))
