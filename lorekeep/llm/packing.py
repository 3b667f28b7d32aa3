"""Packing of tokenized documents into sequences: first-fit decreasing inside randomised groups.

Documents are dealt by a hash of their id, so each task gets a random share; a task closes a group when it holds
``group_tokens`` tokens, and packs it alone.  Nothing but one group is in memory, and groups need no coordination.
In a group, whole sequences are cut off first; the rests go first-fit decreasing into bins that a tournament tree of
free capacities finds in logarithmic time.  Then the emptiest bins are cut up to fill the others, and the one bin
that is left is cut at powers of two, lengths that need no padding.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.tokens import WORD_PATTERN, tokenizer_file

GROUP_TOKENS = 1_000_000
#: The library's file of the vocabulary that is also read as ranks; it names the special tokens.
SPECIAL_FROM = "byte_bpe_50k.json"


@functools.lru_cache(4)
def encoder(file: str):
    """The encoder of a .json file (``tokenizers``), or of the same vocabulary as ranks (``tiktoken``), which is faster."""
    path = tokenizer_file(file)
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        return lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, np.uint32)
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(tokenizer_file(SPECIAL_FROM), encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    enc = tiktoken.Encoding("ranks", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: np.array(enc.encode(text, allowed_special="all"), np.uint32)


class Tournament:
    """Free capacities of bins in a tree of maxima; finds the first bin with room."""

    def __init__(self, bins: int, capacity: int):
        self.width = 1 << max(0, bins - 1).bit_length()
        self.tree = [capacity] * (2 * self.width)

    def place(self, size: int) -> int:
        """The first bin with room for ``size``, which is taken from it."""
        tree, at = self.tree, 1
        while at < self.width:
            at *= 2
            if tree[at] < size:
                at += 1
        leaf, tree[at] = at - self.width, tree[at] - size
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
        return leaf


def pack_group(lengths: list[int], capacity: int = 1024) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document's place, start, length) that hold every token once; all full but powers of two."""
    full, rests = [], []
    for k, n in enumerate(lengths):
        cut = n - n % capacity
        full += [[(k, s, capacity)] for s in range(0, cut, capacity)]
        if n > cut:
            rests.append((k, cut, n - cut))
    rests.sort(key=lambda p: (-p[2], p[0]))
    tree, bins = Tournament(max(1, len(rests)), capacity), {}
    for piece in rests:
        bins.setdefault(tree.place(piece[2]), []).append(piece)
    used = lambda pieces: sum(p[2] for p in pieces)
    open_bins = sorted((b for b in bins.values() if used(b) < capacity), key=used, reverse=True)
    full += [b for b in bins.values() if used(b) == capacity]
    at, last = 0, len(open_bins) - 1
    free = capacity - used(open_bins[0]) if open_bins else 0
    while at < last:
        if not open_bins[last]:
            last -= 1
            continue
        if free == 0:
            full.append(open_bins[at])
            at += 1
            free = capacity - used(open_bins[at])
            continue
        k, start, n = open_bins[last].pop()
        take = min(n, free)
        open_bins[at].append((k, start, take))
        free -= take
        if n > take:
            open_bins[last].append((k, start + take, n - take))
    rest = open_bins[at] if open_bins else []
    left = used(rest)
    while left:  # powers of two, the largest first
        want, part = 1 << (left.bit_length() - 1), []
        left -= want
        while want:
            k, start, n = rest[0]
            take = min(n, want)
            part.append((k, start, take))
            rest[0:1] = [(k, start + take, n - take)] if n > take else []
            want -= take
        full.append(part)
    return full


def _pack(batches: Iterator[pa.RecordBatch], file: str, capacity: int, group_tokens: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = encoder(file)
    sequence = TaskContext.get().partitionId() << 40
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    types = [pa.int64()] * 7 + [pa.binary()] * with_ids
    group: list[tuple[int, np.ndarray]] = []
    held = 0

    def packed():
        nonlocal sequence
        rows = []
        for pieces in pack_group([len(ids) for _, ids in group], capacity):
            offset = 0
            for k, start, n in pieces:
                doc, ids = group[k]
                raw = ids[start : start + n].astype("<u4").tobytes()
                rows.append((doc, start, n, zlib.crc32(raw), len(ids), sequence, offset) + ((raw,) if with_ids else ()))
                offset += n
            sequence += 1
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.append(encode(text.as_py() or ""), np.uint32(end_id))
            group.append((doc, ids))
            held += len(ids)
            if held >= group_tokens:
                yield packed()
                group, held = [], 0
    if group:
        yield packed()


def pack(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", file: str = "byte_bpe_50k.tiktoken", capacity: int = 1024,
    group_tokens: int = GROUP_TOKENS, end_id: int = 0, seed: int = 5, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with ``with_ids`` its ids too.

    A document's tokens are its ids and ``end_id``.  A null text counts as empty, so its only token is ``end_id``; a null
    id stays null; repeated rows are packed each; other columns are ignored; an empty table gives no rows.  Inside a task
    rows are ordered by (hash of the id, id, text), so a lost task packs the same again.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    dealt = source.withColumn("deal", F.xxhash64("doc_id", F.lit(seed))).repartition("deal").sortWithinPartitions("deal", "doc_id", "text")
    fields = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * with_ids
    return dealt.select("doc_id", "text").mapInArrow(
        lambda b: _pack(b, file, capacity, group_tokens, end_id, with_ids), fields).withColumnRenamed("doc_id", id_col)
