"""Ranked lexical search by dense blocked matrix multiplication.

A set of items is answered against all documents in blocks of items.  For a block, one pass over the texts keeps of every
document its number of terms and the occurrences of the block's terms; corpus size and document frequencies are sums over
that table.  Then every task multiplies tiles: rows of item weights times documents' impacts, over the columns of one
vocabulary tile that the document tile holds at all.  Weights and impacts are whole numbers, and a tile's columns are
taken in spans whose sums can't reach 2^53, so products in double precision are exact in any order; spans are added as
64-bit integers.  Of each tile only documents that beat an item's tenth best so far, in score and then in id, are looked at.

What is broadcast is a block: at most ``BLOCK_ITEMS`` items of ``BLOCK_BYTES`` of text (one item, if it is longer).  A task holds
tiles of fixed size and the best documents of each item of a block.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.plans.store import discard, materialize

BLOCK_ITEMS, BLOCK_BYTES = 1024, 8 << 20
TILE_DOCS, TILE_TERMS = 512, 4096
#: Impacts are below this.
MAX_IMPACT = 1_000_000
EXACT = 1 << 53
#: Bytes of terms: ASCII letters (upper-case ones as lower-case) and digits, and all bytes of other characters; the rest part them.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_MET = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cols", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
_BEST = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order; none for null."""
    return text.translate(_TERM_BYTES).split() if text else []


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, bytes]]]:
    """Items, each (id, text) once, in blocks of bounded size, in the order of a digest: only one block is on the driver."""
    both = F.concat_ws("\n", F.coalesce(F.col("item_id").cast("string"), F.lit("-")), F.base64(F.col("text")))
    keyed = materialize(items.where(F.col("text").isNotNull()).distinct().select("item_id", "text", F.sha2(both, 256).alias("k")), "items")
    last = ""
    while True:
        sizes = keyed.where(F.col("k") > last).select("k", F.octet_length("text").alias("b")).orderBy("k").limit(BLOCK_ITEMS).collect()
        if not sizes:
            break
        took, total = 0, 0
        while took < len(sizes) and (not took or total + sizes[took].b <= BLOCK_BYTES):
            total += sizes[took].b
            took += 1
        end = sizes[took - 1].k
        yield [(r.item_id, bytes(r.text)) for r in keyed.where((F.col("k") > last) & (F.col("k") <= end)).select("item_id", "text").collect()]
        last = end
    discard(keyed)


def _term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``(doc_id, n, cols, tfs)`` of every document: its number of terms, and columns and occurrences of those in the vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = known.value
        for batch in batches:
            sizes, cols, tfs = [], [], []
            for text in batch.column(1):
                words = terms_of(text.as_py())
                sizes.append(len(words))
                met = [(columns[w], k) for w, k in Counter(words).items() if w in columns]
                cols.append([c for c, _ in met])
                tfs.append([k for _, k in met])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(x, f.type) for x, f in zip((sizes, cols, tfs), list(_MET)[1:], strict=True)]], schema=_MET)

    return docs.mapInArrow(count, "doc_id long, n long, cols array<int>, tfs array<int>")


class Weights:
    """A block's weights, occurrences times term weight, by item and column: (row, column, weight) triples sorted by column, and the number of rows."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, weights: np.ndarray, size: int):
        order = np.argsort(cols, kind="stable")
        self.rows, self.cols, self.weights, self.size = rows[order], cols[order], weights[order], size

    def tile(self, columns: np.ndarray) -> np.ndarray:
        """The dense rows of these columns, which are sorted."""
        out = np.zeros((self.size, len(columns)))
        lo, hi = np.searchsorted(self.cols, columns[0]), np.searchsorted(self.cols, columns[-1], "right")
        at = np.minimum(np.searchsorted(columns, self.cols[lo:hi]), len(columns) - 1)
        held = columns[at] == self.cols[lo:hi]
        out[self.rows[lo:hi][held], at[held]] = self.weights[lo:hi][held]
        return out

    def spans(self, columns: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
        """Runs of columns whose sums stay below 2^53 whatever the impacts, and whether they do: a run of one column may not."""
        if not len(columns):
            return
        at = np.searchsorted(columns, self.cols)
        held = columns[np.minimum(at, len(columns) - 1)] == self.cols
        most = np.zeros(len(columns), np.int64)  # the largest weight of a column bounds what it adds to any item
        np.maximum.at(most, at[held], self.weights[held])
        start, total = 0, 0
        for k, w in enumerate(most.tolist()):
            if k > start and (k - start == TILE_TERMS or (total + w) * MAX_IMPACT >= EXACT):
                yield columns[start:k], total * MAX_IMPACT < EXACT
                start, total = k, 0
            total += w
        yield columns[start:], total * MAX_IMPACT < EXACT


def impacts(tfs: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(1000000000 * tf) div (1000 * tf + 8 * m) with m = 25 + (75 * n * N) div L."""
    if len(n) and 75 * int(n.max()) * n_docs >= 1 << 63:  # past 64 bits: as whole numbers of any size
        m = np.array([25 + 75 * int(x) * n_docs // n_terms for x in n], np.int64)
    else:
        m = 25 + 75 * n * n_docs // n_terms
    return 1_000_000_000 * tfs // (1000 * tfs + 8 * m)


def tile_scores(weights: Weights, docs: np.ndarray, cols: np.ndarray, values: np.ndarray, n_docs: int) -> np.ndarray:
    """Scores, items by documents, of a tile of documents given as (document, column, impact) triples."""
    out = np.zeros((weights.size, n_docs), np.int64)
    order = np.argsort(cols, kind="stable")
    docs, cols, values = docs[order], cols[order], values[order]
    for span, exact in weights.spans(np.unique(cols)):
        lo, hi = np.searchsorted(cols, span[0]), np.searchsorted(cols, span[-1], "right")
        dense = np.zeros((len(span), n_docs))
        dense[np.searchsorted(span, cols[lo:hi]), docs[lo:hi]] = values[lo:hi]
        if exact:
            out += (weights.tile(span) @ dense).astype(np.int64)
        else:  # one column of very large weights
            out += weights.tile(span).astype(np.int64) * dense.astype(np.int64)
    return out


class Best:
    """The ``k`` best documents of each item so far: by score, then by id, null ids last."""

    def __init__(self, size: int, k: int):
        self.k = k
        self.items, self.ids, self.nulls, self.scores = (np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))
        self.least = np.ones(size, np.int64)  # a score that an item still takes

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        items, docs = np.nonzero(scores >= self.least[:, None])
        if not len(items):
            return
        merged = [np.concatenate(x) for x in ((self.items, items), (self.ids, ids[docs]), (self.nulls, nulls[docs]), (self.scores, scores[items, docs]))]
        order = np.lexsort((merged[1], merged[2], -merged[3], merged[0]))
        items, ids, nulls, scores = (x[order] for x in merged)
        first = np.searchsorted(items, items)  # where the item's rows begin
        place = np.arange(len(items)) - first
        full = place == self.k - 1
        self.least[items[full]] = scores[full]
        kept = place < self.k
        self.items, self.ids, self.nulls, self.scores = items[kept], ids[kept], nulls[kept], scores[kept]


def _block_best(met: DataFrame, weights: Weights, n_docs: int, n_terms: int, k: int) -> DataFrame:
    shared = met.sparkSession.sparkContext.broadcast(weights)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        best = Best(held.size, k)
        for batch in batches:
            for start in range(0, batch.num_rows, TILE_DOCS):
                part = batch.slice(start, TILE_DOCS)
                ids = part.column(0)
                n = part.column(1).to_numpy()
                cols = part.column(2)
                sizes = np.diff(cols.offsets.to_numpy())
                docs = np.repeat(np.arange(part.num_rows), sizes)
                tfs = part.column(3).flatten().to_numpy().astype(np.int64)
                values = impacts(tfs, n[docs], n_docs, n_terms)
                best.add(tile_scores(held, docs, cols.flatten().to_numpy(), values, part.num_rows), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        ids = pa.array(best.ids, pa.int64(), mask=best.nulls)
        yield pa.RecordBatch.from_arrays([pa.array(best.items.astype(np.int32)), ids, pa.array(best.scores)], schema=_BEST)

    return met.where(F.size("cols") > 0).mapInArrow(multiply, "item int, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` highest-scoring documents with a score above 0 of each item.

    Terms are runs of ASCII letters and digits and all characters beyond ASCII; only A-Z are lower-cased.  A term's weight is
    floor(1000 ln((2 N + 2) / (2 df + 1))); a document's m is 25 + (75 n N) div L; its score sums w * ((10^9 tf) div (1000 tf + 8 m))
    over the item's terms, repeats included.  N counts documents with a term, L all terms, n the document's, df the documents
    with the term, tf its occurrences in the document.

    Null texts have no terms, empty ones neither; items without terms or matches give no rows.  Every row of the documents
    counts, repeated ones too; equal scores go by ascending id, null ids last.  Repeated items (id and text) are answered
    once, texts that share an id each with ranks of their own.  Very long texts are one row's work, a list of their terms.
    An empty table on either side gives an empty one.  Other columns, whatever they are called, aren't read.
    """
    raw = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("binary").alias("text"))
    out = None
    for block in _blocks(asked):
        counted = [Counter(terms_of(t)) for _, t in block]
        vocabulary = {w: c for c, w in enumerate(sorted({w for x in counted for w in x}))}
        if not vocabulary:
            continue
        met = materialize(_term_counts(raw, vocabulary), "terms")
        n_docs, n_terms = met.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(met.select(F.explode("cols").alias("c")).groupBy("c").count().collect())  # a row per term of the block at most
        weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(c, 0) + 1))) for c in range(len(vocabulary))]
        triples = [(r, vocabulary[w], times * weight[vocabulary[w]]) for r, x in enumerate(counted) for w, times in x.items() if df.get(vocabulary[w]) and weight[vocabulary[w]]]
        if not triples:
            continue
        rows, cols, values = (np.array(x, np.int64) for x in zip(*triples, strict=True))
        found = _block_best(met, Weights(rows, cols, values, len(block)), n_docs, n_terms, k)
        names = docs.sparkSession.createDataFrame([(i, b) for i, (b, _) in enumerate(block)], "item int, item_id long")
        best = _top(found, k).join(F.broadcast(names), "item")
        best = materialize(best.select("item_id", "rank", "doc_id", "score"), "ranked")
        discard(met)
        out = best if out is None else out.unionByName(best)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def _top(found: DataFrame, k: int, buckets: int = 16) -> DataFrame:
    """The ``k`` best rows of each item: of buckets of tasks first, so that no task gets what all tasks found for an item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    some = found.withColumn("bucket", F.spark_partition_id() % buckets).withColumn("rank", rank("item", "bucket")).where(F.col("rank") <= k)
    return some.withColumn("rank", rank("item")).where(F.col("rank") <= k).drop("bucket")
