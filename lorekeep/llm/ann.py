"""Approximate nearest neighbours: NN-descent builds a graph with Spark joins, greedy graph search answers queries.

Equal vectors form one node.  The graph is one of largest inner products, not of distances: with vectors of different
length, a graph of distances (of vectors made equally long) finds too little.  Nodes are kept as 32-bit numbers, each
scaled by its own largest component; only the final ranking reads the original vectors.

Start: in each of several rounds random hyperplanes deal the nodes into leaves of bounded size, inside which all pairs are
scored; this gives the first lists.  Descent: a node's neighbours and those it is a neighbour of are joined with their vectors and
introduced to each other; pairs that beat the worst neighbour of an end are kept.  Search: from the query's own node and the
longest vectors, the best nodes not yet visited are joined with the graph, the new ones among their neighbours with the
vectors, until a query's beam holds none; a query's state is its beam alone.

Every step groups by node or query and holds one group of bounded size at a time.  The hyperplanes' medians and leaf
frequencies come from a sample of at most ``SAMPLE`` nodes; all nodes are indexed.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.plans.store import discard, materialize

NEIGHBOURS, WIDTH, ROUNDS, LEAF, DESCENTS = 48, 20, 12, 1_024, 2
SAMPLE = 20_000
BEAM, EXPAND, RERANK, ENTRIES = 128, 64, 40, 8


def _matrix(column: pa.Array, kind) -> np.ndarray:
    """Rows of a binary column whose values are all of one length."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def _vectors(column: pa.Array) -> np.ndarray:
    """Vectors of :func:`_encode`: 32-bit components, and a 64-bit factor at the end."""
    raw = _matrix(column, np.uint8)
    return np.ascontiguousarray(raw[:, :-8]).view(np.float32) * np.ascontiguousarray(raw[:, -8:]).view(np.float64)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Each run of equal keys as one batch; the input is sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        same = held and all(held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() == c[0] for k, c in zip(keys, columns, strict=True))
        if held and not same:
            yield _joined(held)
            held = []
        cuts = [0, *change.tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            held.append(batch.slice(a, b - a))
            if b < len(batch):
                yield _joined(held)
                held = []
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _flat(rows: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in rows.values()], names=list(rows))


def _emit(results: Iterator[dict[str, np.ndarray]], size: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Small column sets gathered into batches."""
    rows: dict[str, list] = {}
    n = 0
    for r in results:
        for k, v in r.items():
            rows.setdefault(k, []).append(v)
        n += len(next(iter(r.values())))
        if n >= size:
            yield _flat(rows)
            rows, n = {}, 0
    if n:
        yield _flat(rows)


def _grouped(df: DataFrame, keys: list[str], solve: Callable, schema: str, order: tuple = ()) -> DataFrame:
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(lambda b: _emit(r for g in _groups(b, keys) if (r := solve(g)) is not None), schema)


def _best(ids: np.ndarray, scores: np.ndarray, fresh: np.ndarray, k: int):
    """Distinct ids with the highest scores; an id is fresh only if all its rows are."""
    order = np.lexsort((fresh, ids))
    ids, scores, fresh = ids[order], scores[order], fresh[order]
    first = np.concatenate([[True], ids[1:] != ids[:-1]])
    ids, scores, fresh = ids[first], scores[first], fresh[first]
    top = np.lexsort((ids, -scores))[:k]
    return ids[top], scores[top], fresh[top]


def valid_vectors(vectors: DataFrame, id_col: str, vector: str, dim: int | None) -> DataFrame:
    """``(vec_id, v)`` of rows with an id and a finite, non-zero vector of ``dim`` components (or of the commonest number)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0.0))
    if dim is None:
        top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
        dim = top[0]["d"] if top else 0
    return rows.where(F.size("v") == dim)


def _planes(nodes: DataFrame, rounds: int, leaf: int, seed: int):
    """Hyperplanes by round, their medians, and how many parts each dense code is dealt into."""
    total = nodes.count()
    bits = max(0, int(np.ceil(np.log2(max(1, total / leaf)))))
    sample = _vectors(nodes.orderBy(F.xxhash64("cid", F.lit(seed))).limit(SAMPLE).select("q").toArrow().column("q").combine_chunks())
    rng = np.random.default_rng(seed)
    normals = rng.standard_normal((rounds, bits, sample.shape[1])).astype(np.float32)
    cuts = np.median(np.einsum("nd,rbd->nrb", sample, normals), axis=0) if bits else np.zeros((rounds, 0))
    power = 1 << np.arange(bits, dtype=np.int64)
    codes = (np.einsum("nd,rbd->nrb", sample, normals) > cuts) @ power if bits else np.zeros((len(sample), rounds), np.int64)
    parts = [{c: p for c, n in Counter(codes[:, r].tolist()).items() if (p := int(np.ceil(n / len(sample) * total / leaf / 1.5))) > 1} for r in range(rounds)]
    return normals, cuts, power, parts


def _deal(batches: Iterator[pa.RecordBatch], normals, cuts, power, parts) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, q = batch.column(0), _vectors(batch.column(1))
        mixed = ids.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
        for r in range(len(normals)):
            code = ((q @ normals[r].T) > cuts[r]) @ power if len(power) else np.zeros(len(q), np.int64)
            share = np.array([parts[r].get(c, 1) for c in code.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(q), r, np.int64)), pa.array(code), pa.array((mixed.astype(np.int64) + r) % share), ids, batch.column(1)],
                names=["round", "code", "part", "cid", "q"])


def _leaf(group: pa.RecordBatch, k: int, leaf: int) -> dict[str, np.ndarray] | None:
    ids, q = group.column("cid").to_numpy(), _vectors(group.column("q"))
    out = {"cid": [], "other": [], "score": []}
    pieces = int(np.ceil(len(ids) / (4 * leaf)))  # a leaf denser than the sample told
    for part in np.array_split(np.arange(len(ids)), pieces):
        for at in range(0, len(part), 512):
            rows = part[at : at + 512]
            s = q[rows] @ q[part].T
            s[np.arange(len(rows)), at + np.arange(len(rows))] = -np.inf
            n = min(k, len(part) - 1)
            if n < 1:
                continue
            top = np.argpartition(-s, n - 1, axis=1)[:, :n]
            out["cid"].append(np.repeat(ids[rows], n))
            out["other"].append(ids[part[top]].ravel())
            out["score"].append(np.take_along_axis(s, top, 1).ravel())
    return {c: np.concatenate(v) for c, v in out.items()} if out["cid"] else None


def _merge(group: pa.RecordBatch, k: int) -> dict[str, np.ndarray]:
    ids, scores, fresh = _best(group.column("other").to_numpy(), group.column("score").to_numpy(), group.column("fresh").to_numpy(), k)
    return {"cid": np.full(len(ids), group.column("cid")[0].as_py()), "other": ids, "score": scores, "fresh": fresh}


def _circle(group: pa.RecordBatch, width: int) -> dict[str, np.ndarray] | None:
    """A node's circle: its best neighbours, and as many of those that name it, fresh ones first, else by chance."""
    centre = group.column("centre")[0].as_py()
    other, fresh, rank = group.column("other").to_numpy(), group.column("fresh").to_numpy(), group.column("rank").to_numpy()
    mine = rank >= 0
    chance = (other[~mine].astype(np.uint64) ^ np.uint64(centre & (2**63 - 1))) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(40)
    named = np.lexsort((chance, -fresh[~mine]))[:width]
    ids, _, f = _best(np.concatenate([other[mine], other[~mine][named]]), np.zeros(mine.sum() + len(named)), np.concatenate([fresh[mine], fresh[~mine][named]]), 1 << 30)
    return {"centre": np.full(len(ids), centre), "cid": ids, "fresh": f} if f.any() else None


def _introduce(group: pa.RecordBatch) -> dict[str, np.ndarray] | None:
    ids, q = group.column("cid").to_numpy(), _vectors(group.column("q"))
    fresh, worst = group.column("fresh").to_numpy() > 0, group.column("worst").to_numpy()
    s = q @ q.T
    s[~(fresh[:, None] | fresh)] = -np.inf
    np.fill_diagonal(s, -np.inf)
    a, b = np.nonzero(s > worst[:, None])
    return {"cid": ids[a], "other": ids[b], "score": s[a, b], "fresh": np.ones(len(a), np.int32)} if len(a) else None


def build_graph(nodes: DataFrame, k: int = NEIGHBOURS, rounds: int = ROUNDS, leaf: int = LEAF, descents: int = DESCENTS, width: int = WIDTH, seed: int = 3) -> DataFrame:
    """``(cid, other, score, fresh, rank)``: the ``k`` best neighbours found for each of ``nodes`` (cid, q)."""
    normals, cuts, power, parts = _planes(nodes, rounds, leaf, seed)
    dealt = nodes.select("cid", "q").mapInArrow(lambda b: _deal(b, normals, cuts, power, parts), "round bigint, code bigint, part bigint, cid bigint, q binary")
    pairs = _grouped(dealt, ["round", "code", "part"], lambda g: _leaf(g, k, leaf), "cid bigint, other bigint, score double")
    edge = "cid bigint, other bigint, score double, fresh int"
    graph = materialize(_grouped(pairs.withColumn("fresh", F.lit(1)), ["cid"], lambda g: _merge(g, k), edge), "graph")
    for _ in range(descents):
        ranked = graph.withColumn("rank", F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("score"), "other")))
        mine = ranked.where(F.col("rank") <= width).select(F.col("cid").alias("centre"), "other", "fresh", "rank")
        named = graph.select(F.col("other").alias("centre"), F.col("cid").alias("other"), "fresh", F.lit(-1).alias("rank"))
        # a hub is named by any number of nodes; the limit is applied before the shuffle as well as after
        chance = Window.partitionBy("centre").orderBy(F.desc("fresh"), F.xxhash64("centre", "other"))
        named = named.withColumn("n", F.row_number().over(chance)).where(F.col("n") <= width).drop("n")
        circles = _grouped(mine.unionByName(named), ["centre"], lambda g: _circle(g, width), "centre bigint, cid bigint, fresh int")
        worst = graph.groupBy("cid").agg(F.min("score").alias("low"), F.count("*").alias("n")).select("cid", F.when(F.col("n") < k, F.lit(-1e30)).otherwise(F.col("low")).cast("double").alias("worst"))
        info = nodes.select("cid", "q").join(worst, "cid", "left").fillna(-1e30, ["worst"])
        found = _grouped(circles.join(info, "cid"), ["centre"], _introduce, edge)
        # every centre that has both ends introduces a pair again; the limit is one of distinct pairs not yet in the graph.
        # A pair's score varies in its last bits with the centre, so pairs are told apart by their ends alone
        found = found.groupBy("cid", "other").agg(F.max("score").alias("score"), F.max("fresh").alias("fresh"))
        found = found.join(graph.select("cid", "other"), ["cid", "other"], "left_anti")
        first = Window.partitionBy("cid").orderBy(F.desc("score"), "other")
        found = found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= 8 * k).drop("n")  # as many introduce a hub
        merged = materialize(_grouped(graph.withColumn("fresh", F.lit(0)).unionByName(found), ["cid"], lambda g: _merge(g, k), edge), "graph")
        discard(graph)
        graph = merged
    return graph


_STATE = "cid bigint, node bigint, score double, visited int, todo int"


def _advance(group: pa.RecordBatch, beam: int, expand: int) -> dict[str, np.ndarray] | None:
    """A query's next beam: its last one and the nodes newly reached, which are scored; todo: the nodes to visit next.

    The query's own vector stands in the row of node -1.
    """
    cid, node = group.column("cid")[0].as_py(), group.column("node").to_numpy()
    score = group.column("score").to_numpy(zero_copy_only=False).copy()
    visited = group.column("visited").to_numpy()
    v = group.column("v")
    fresh = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False) & (node >= 0))
    if len(fresh):
        score[fresh] = _vectors(v.take(pa.array(fresh))) @ _vectors(v.take(pa.array(np.flatnonzero(node == -1)[:1])))[0]
    rows = np.flatnonzero(node >= 0)
    rows = rows[np.lexsort((node[rows], -score[rows]))][:beam]
    todo = np.zeros(len(rows), np.int32)
    todo[np.flatnonzero(visited[rows] == 0)[:expand]] = 1
    return {"cid": np.full(len(rows), cid), "node": node[rows], "score": score[rows], "visited": np.maximum(visited[rows], todo), "todo": todo}


def search_graph(nodes: DataFrame, graph: DataFrame, queries: DataFrame, entries: list[int] = (), beam: int = BEAM, expand: int = EXPAND, hops: int | None = None) -> DataFrame:
    """``(cid, node, score)``: the last beam of a greedy search for each query node of ``queries`` (cid).  hops: the most rounds, None: until no beam holds an unvisited node."""
    of_node = nodes.select(F.col("cid").alias("node"), F.col("q").alias("v"))
    near = graph.select(F.col("cid").alias("node"), "other")
    asked = queries.join(nodes.select("cid", F.col("q").alias("v")), "cid").select("cid", F.lit(-1).cast("long").alias("node"), "v")
    start = F.array_distinct(F.array("cid", *[F.lit(e).cast("long") for e in entries]))
    state = queries.select("cid", F.explode(start).alias("node"))
    first = state.join(near, "node").select("cid", F.col("other").alias("node")).distinct().join(state, ["cid", "node"], "left_anti")
    reached = state.withColumn("visited", F.lit(1)).unionByName(first.withColumn("visited", F.lit(0)))
    old = None
    for _ in itertools.count() if hops is None else range(hops):
        rows = reached.join(of_node, "node").unionByName(asked.withColumn("visited", F.lit(0))).withColumn("score", F.lit(0.0))
        if old is not None:
            rows = rows.unionByName(old.select("cid", "node", "visited", "score", F.lit(None).cast("binary").alias("v")))
        new = materialize(_grouped(rows.select("cid", "node", "score", "visited", "v"), ["cid"], lambda g: _advance(g, beam, expand), _STATE), "beam")
        discard(old)
        old = new
        todo = new.where("todo = 1").select("cid", "node")
        if todo.isEmpty():
            break
        met = todo.join(near, "node").select("cid", F.col("other").alias("node")).distinct()
        reached = met.join(new.select("cid", "node"), ["cid", "node"], "left_anti").withColumn("visited", F.lit(0))
    return old.select("cid", "node", "score")


def _encode(batches: Iterator[pa.RecordBatch], largest: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = np.array(b.column("v").to_pylist(), float).reshape(len(b), -1)
        own = np.abs(x).max(axis=1, initial=0.0)
        q, factor = (x / own[:, None]).astype(np.float32), own / largest
        yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array([r.tobytes() + f.tobytes() for r, f in zip(q, factor, strict=True)], pa.binary())], names=["cid", "q"])


def coded_vectors(nodes: DataFrame) -> DataFrame:
    """``(cid, q)`` of ``nodes`` (cid, v), as the graph keeps them."""
    largest = nodes.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 1.0
    return materialize(nodes.select("cid", "v").mapInArrow(lambda b: _encode(b, largest), "cid bigint, q binary"), "coded")


#: Queries of a block of the exact search, and vectors of a tile.
EXACT_QUERIES, EXACT_TILE = 2048, 4096


def search_all(nodes: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """``(cid, node, score)``: the ``top`` nodes of largest inner product of all ``nodes`` (cid, v) for each query node (cid).

    Queries are answered in blocks, whose vectors are broadcast; a task multiplies tiles and keeps each query's best so far.
    """
    spark = nodes.sparkSession
    wanted = materialize(nodes.join(queries.select("cid").distinct(), "cid", "left_semi").select("cid", "v"), "asked")
    out, last = None, -1
    while block := wanted.where(F.col("cid") > last).orderBy("cid").limit(EXACT_QUERIES).collect():
        last = block[-1].cid
        shared = spark.sparkContext.broadcast((np.array([r.cid for r in block]), np.array([r.v for r in block])))

        def multiply(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best_score, best_node = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
            for batch in batches:
                for start in range(0, batch.num_rows, EXACT_TILE):
                    part = batch.slice(start, EXACT_TILE)
                    node = part.column(0).to_numpy()
                    score = q @ np.array(part.column(1).to_pylist()).T
                    score, node = np.hstack([best_score, score]), np.hstack([best_node, np.broadcast_to(node, (len(ids), len(node)))])
                    order = np.lexsort((node, -score))[:, :top]
                    best_score, best_node = np.take_along_axis(score, order, 1), np.take_along_axis(node, order, 1)
            n = best_node.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(best_node.ravel()), pa.array(best_score.ravel())], names=["cid", "node", "score"])

        found = nodes.select("cid", "v").mapInArrow(multiply, "cid bigint, node bigint, score double")
        place = F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("score"), "node"))
        found = materialize(found.withColumn("n", place).where(F.col("n") <= top).drop("n"), "exact")
        out = found if out is None else out.unionByName(found)
    return nodes.select("cid", F.col("cid").alias("node"), F.lit(0.0).alias("score")).limit(0) if out is None else out


def nearest(vectors: DataFrame, queries: DataFrame | None = None, top: int = 20, id_col: str = "vec_id", vector: str = "embedding", dim: int | None = None, exact: bool = False, **tuning) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``top`` rows with the largest inner product found for each query.

    ``queries``: ids (one column) of rows of ``vectors``; None: all.  A row isn't its own neighbour, rows equal to it are.
    Ties go to the smaller id.  Null ids, and vectors that are null, zero, of another length, or hold a null, NaN or
    infinity take no part.  Fewer candidates than ``top``: all of them.  Other columns are ignored.
    exact: compare every query with every vector instead, in tiles; the graph's bounds on neighbours, introductions and beams don't apply then.
    tuning: rounds, leaf, descents, width, k (of the graph), beam, expand, hops (of the search).
    """
    rows = materialize(valid_vectors(vectors, id_col, vector, dim), "vectors")
    nodes = materialize(rows.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("cid", F.monotonically_increasing_id()), "nodes")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    few = max(RERANK, 2 * top) + 1 + ENTRIES
    coded = nodes.limit(0).select("cid", F.lit(None).cast("binary").alias("q")) if exact else coded_vectors(nodes)
    entries = [r["cid"] for r in nodes.orderBy(F.desc(square), "cid").limit(ENTRIES).select("cid").collect()]  # the longest vectors
    graph_options = {k: v for k, v in tuning.items() if k in ("k", "rounds", "leaf", "descents", "width", "seed")}
    search_options = {k: v for k, v in tuning.items() if k in ("beam", "expand", "hops")}
    graph = build_graph(coded, **graph_options) if not coded.isEmpty() else coded.select("cid", F.col("cid").alias("other"), F.lit(0).cast("double").alias("score")).limit(0)
    asked = rows if queries is None else rows.join(queries.select(F.col(queries.columns[0]).cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    placed = asked.join(nodes.select("v", "cid"), "v").select(F.col("vec_id").alias("query_id"), "cid", F.col("v").alias("qv"))
    cids = placed.select("cid").distinct()
    met = search_all(nodes, cids, few) if exact else search_graph(coded, graph, cids, entries, **search_options)
    order = Window.partitionBy("cid").orderBy(F.desc("score"), "node")
    best = met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= few).select("cid", "node")
    # of equal vectors the least ids suffice: as many as are asked for, and one more for the query's own
    single = nodes.where("copies = 1").select(F.col("cid").alias("node"), F.col("least").alias("vec_id"), "v")
    several = rows.join(nodes.where("copies > 1").select("v", "cid"), "v").select(F.col("cid").alias("node"), "vec_id", "v")
    several = several.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("n") <= top + 1).drop("n")
    scored = placed.join(best, "cid").join(single.unionByName(several), "node").where("vec_id <> query_id")
    scored = scored.withColumn("score", F.aggregate(F.zip_with("qv", "v", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
