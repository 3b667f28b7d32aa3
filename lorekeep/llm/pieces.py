"""SentencePiece encoding and decoding, and sampled segmentations by Gumbel top-k without replacement.

A text's segmentations are the paths of a lattice of vocabulary pieces; a path's probability is proportional to the
product of its pieces' weights, which fall with a piece's rank as in Zipf's law.  Gumbel top-k: give each path its log-
probability plus Gumbel noise; the k highest are a sample without replacement.  The noise is drawn top-down (A-star over
sets of paths): a set's highest value has a Gumbel distribution whose place is the set's log-probability, a set splits
into the branch that attains it and the rest, and the rest's highest value is drawn below it.  So the first path is an
ordinary draw, and each next one leaves the best rest not yet entered.  No other path is built.

Draws come from a hash of (row key, sample, step), so a row gets the same segmentations wherever it is computed.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.tokens import tokenizer_file

SPACE = "▁"
CHUNK = regex.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Characters of text that are sampled at once; a longer text is sampled alone, in about 100 bytes a character.
SLICE_CHARS = 2_000_000
#: Noise of 53-bit draws stays below this.
NOISE = 37.0
_A, _B, _WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), 2**64 - 1


def uniform(key: np.ndarray | int, salt: int, index: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from a hash of key, salt and index."""
    with np.errstate(over="ignore"):
        x = np.asarray(key, np.uint64) + np.uint64(salt) * _B + (np.asarray(index).astype(np.uint64) + np.uint64(1)) * _A
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def uniform_one(key: int, salt: int, index: int) -> float:
    """One number of :func:`uniform`, without arrays."""
    x = (key + salt * int(_B) + (index + 1) * int(_A)) & _WORD
    x = ((x ^ (x >> 30)) * int(_B)) & _WORD
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _WORD
    return (((x ^ (x >> 31)) >> 11) + 0.5) / 2.0**53


def normalized(text: str) -> str:
    """The model's view of a text: spaces as marks, and one more in front; empty stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def chunks_of(text: str) -> list[str]:
    """The normalized text cut before each run of marks."""
    if not text or "  " in text or text[0] == " " or SPACE in text:
        return CHUNK.findall(normalized(text))
    return (SPACE + text.replace(" ", f" {SPACE}")).split(" ")


def numbered_chunks(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct chunks of all texts, the number of each chunk in the order of the texts, and how many each text has.

    Arrow cuts and numbers the words of texts that single spaces part; other texts are cut by :func:`chunks_of`.
    """
    plain = np.array([bool(t) and "  " not in t and t[0] != " " and SPACE not in t for t in texts], bool)
    words = pc.split_pattern(pa.array(itertools.compress(texts, plain), pa.large_string()), " ")
    coded = words.flatten().dictionary_encode()
    number = {SPACE + w: n for n, w in enumerate(coded.dictionary.to_pylist())}
    others = [chunks_of(t) for t in itertools.compress(texts, ~plain)]
    sizes = np.empty(len(texts), np.int64)
    sizes[plain], sizes[~plain] = pc.list_value_length(words).to_numpy(), [len(p) for p in others]
    chunk, is_plain = np.empty(sizes.sum(), np.int64), np.repeat(plain, sizes)
    chunk[is_plain] = coded.indices.to_numpy()
    chunk[~is_plain] = [number.setdefault(c, len(number)) for c in itertools.chain.from_iterable(others)]
    return list(number), chunk, sizes


class Trie:
    """All starts of pieces; one hash table (node, character) -> node, which arrays of both are looked up in at once."""

    def __init__(self, ids: dict[str, int]):
        node_of, step = {"": 0}, {}
        for piece in ids:
            for n in range(1, len(piece) + 1):
                if piece[:n] not in node_of:
                    node_of[piece[:n]] = len(node_of)
                    step[node_of[piece[: n - 1]] << 21 | ord(piece[n - 1])] = node_of[piece[:n]]
        self.piece = np.full(len(node_of), -1, np.int64)
        for piece, i in ids.items():
            self.piece[node_of[piece]] = i
        keys = np.fromiter(step, np.int64, len(step))
        self.goes_on = np.zeros(len(node_of), bool)
        self.goes_on[keys >> 21] = True
        bits = int(4 * len(keys)).bit_length()
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.next = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        for slot, key, node in zip(self._slots(keys).tolist(), keys.tolist(), step.values(), strict=True):
            while self.keys[slot] != -1:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.next[slot] = key, node

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _A >> self.shift).view(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The node after each character; -1: none."""
        keys = node << 21 | char
        slot = self._slots(keys)
        found = self.keys[slot]
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            found[todo] = self.keys[slot[todo]]
            todo = todo[(found[todo] != keys[todo]) & (found[todo] != -1)]
        return np.where(found == keys, self.next[slot], -1)


class Vocabulary:
    def __init__(self, file: str, sharpness: float):
        sp = self.sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(file))
        if sp.normalize("a  b") != normalized("a  b"):
            raise ValueError("only models that keep texts as they are can be sampled")
        text = self.text = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(len(text))]
        self.ids = {t: i for i, t in enumerate(text) if not special[i]}
        self.byte = {int(t[3:5], 16): i for i, t in enumerate(text) if sp.is_byte(i)}
        self.weight = np.array([-sharpness * np.log(2 + max(0.0, -sp.get_score(i))) for i in range(len(text))])
        if any(SPACE in t.lstrip(SPACE) for t in self.ids):
            raise ValueError("pieces across words can't be sampled word by word")
        self.trie = Trie(self.ids)
        value = {i: bytes([b]) for b, i in self.byte.items()}
        spelled = [value.get(i, t.replace(SPACE, " ").encode("utf-8", "surrogatepass")) for i, t in enumerate(text)]
        self.size = np.array([len(x) for x in spelled])
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)

    def spell(self, piece: int) -> list[int]:
        """The byte pieces of a character that has no piece; ``piece``: below zero, its code point."""
        return [self.byte[b] for b in chr(-piece - 1).encode("utf-8", "surrogatepass")]

    def spelled(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``pieces`` with byte pieces for characters that have none, and how many each gave."""
        count, at = np.ones(len(pieces), np.int64), np.flatnonzero(pieces < 0)
        if not len(at):
            return pieces, count
        chars, which = np.unique(pieces[at], return_inverse=True)
        table = [self.spell(int(c)) for c in chars]
        count[at] = np.array([len(x) for x in table])[which]
        place = np.cumsum(count) - count
        out = np.empty(count.sum(), np.int64)
        out[place[pieces >= 0]] = pieces[pieces >= 0]
        for n in range(max(map(len, table))):
            has = count[at] > n
            out[place[at[has]] + n] = np.array([x[n] if n < len(x) else -1 for x in table])[which[has]]
        return out, count

    def raw(self, pieces: np.ndarray) -> np.ndarray:
        """The bytes of piece ids, marks as spaces."""
        size = self.size[pieces]
        return self.bytes[np.arange(size.sum()) + np.repeat(self.begin[pieces] - (np.cumsum(size) - size), size)]


@functools.lru_cache(4)
def vocabulary(file: str, sharpness: float) -> Vocabulary:
    return Vocabulary(file, sharpness)


class Lattice:
    """Lattices of distinct chunks, side by side: node n of a chunk is the place before its n-th character.

    Edges are ordered by their node, the longest first.  cond: an edge's log-probability at its node; beta: log of summed
    path weights from a node to its chunk's end.  An edge's piece is an id, or, below zero, a character that is spelled in bytes.
    """

    def __init__(self, chunks: list[str], v: Vocabulary):
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        self.root = np.cumsum(lengths + 1) - lengths - 1
        n = int(lengths.sum()) + len(chunks)
        chars = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        node_of = np.arange(len(chars)) + np.repeat(np.arange(len(chunks)), lengths)  # of a character
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(chars))
        self.final = np.ones(n, bool)
        self.final[node_of] = False

        # all places walk down the trie together, one character a turn, until no piece goes on
        found, at, node = [], np.arange(len(chars)), np.zeros(len(chars), np.int64)
        size = 0
        while len(at):
            node = v.trie.step(node, chars[at + size])
            size += 1
            piece = np.where(node >= 0, v.trie.piece[node], -1)
            if size == 1:
                found.append((at, np.where(piece >= 0, piece, -chars - 1)))
            else:
                found.append((at[piece >= 0], piece[piece >= 0]))
            on = (node >= 0) & v.trie.goes_on[node] & (left[at] > size)
            at, node = at[on], node[on]
        count = np.zeros(n + 1, np.int64)
        for places, _ in found:
            count[node_of[places]] += 1
        self.first = np.cumsum(count) - count
        free = self.first.copy()
        self.start, self.end, self.piece = (np.empty(self.first[-1], np.int64) for _ in range(3))
        for size, (places, piece) in reversed(list(enumerate(found, 1))):
            start = node_of[places]
            slot = free[start]
            free[start] += 1
            self.start[slot], self.end[slot], self.piece[slot] = start, start + size, piece

        self.weight = np.where(self.piece >= 0, v.weight[np.maximum(self.piece, 0)], 0.0)
        bare = np.flatnonzero(self.piece < 0)
        if len(bare):
            kinds, which = np.unique(self.piece[bare], return_inverse=True)
            self.weight[bare] = np.array([sum(v.weight[i] for i in v.spell(int(k))) for k in kinds])[which]
        self._inside(n, left, node_of)

    def _inside(self, n: int, left: np.ndarray, node_of: np.ndarray) -> None:
        """beta of all nodes at one distance from their end at a time, then the edges' probabilities."""
        beta, of_node = np.zeros(n), np.zeros(n, np.int64)
        of_node[node_of] = left
        edge_left = of_node[self.start]
        longest = int(left.max(initial=0))
        by_left = np.argsort(edge_left.astype(np.uint16) if longest < 65_536 else edge_left, kind="stable")
        cuts = np.searchsorted(edge_left[by_left], np.arange(1, longest + 2))
        for a, b in zip(cuts, cuts[1:]):
            e = by_left[a:b]
            if len(e):
                value, start = self.weight[e] + beta[self.end[e]], self.start[e]
                heads = np.flatnonzero(np.concatenate([[True], start[1:] != start[:-1]]))
                top = np.maximum.reduceat(value, heads)
                share = np.exp(value - np.repeat(top, np.diff(heads, append=len(e))))
                beta[start[heads]] = top + np.log(np.add.reduceat(share, heads))
        self.beta = beta
        self.cond = np.minimum(0.0, self.weight + beta[self.end] - beta[self.start])
        run = np.cumsum(np.exp(self.cond))
        self.upto = run - np.concatenate([[0.0], run])[self.first[self.start]]
        self.upto[self.first[1:][~self.final] - 1] = 2.0  # a node's last edge takes what is left

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node by its probability."""
        edge = self.first[node]
        todo = np.flatnonzero(u >= self.upto[edge])
        while len(todo):
            edge[todo] += 1
            todo = todo[u[todo] >= self.upto[edge[todo]]]
        return edge


def _walk(lat: Lattice, chunk: np.ndarray, key: np.ndarray, place: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """A random path through each chunk: its edges in order, and how many each has.  place: the chunk's first character in its text."""
    node, alive, steps = lat.root[chunk], np.arange(len(chunk)), []
    count = np.zeros(len(chunk), np.int64)
    to_text = place - node
    while len(alive):
        edge = lat.draw(node, uniform(key[alive], salt, node + to_text[alive]))
        steps.append((alive, edge))
        count[alive] += 1
        node = lat.end[edge]
        going = ~lat.final[node]
        node, alive = node[going], alive[going]
    offset = np.cumsum(count) - count
    out = np.empty(count.sum(), np.int64)
    for step, (who, edge) in enumerate(steps):
        out[offset[who] + step] = edge
    return out, count


def _below(place: np.ndarray, bound: np.ndarray | float, u: np.ndarray) -> np.ndarray:
    """The highest value of sets at ``place`` (log-probabilities), given that it is below ``bound``."""
    return place - np.logaddexp(place - bound, np.log(-np.log(u)))


def sample_texts(texts: list[str], keys: list[int], k: int, v: Vocabulary) -> list[list[dict]]:
    """For each text up to ``k`` distinct segmentations, the likeliest draws first: pieces, logp, gumbel, inclusion."""
    distinct, chunk, sizes = numbered_chunks(texts)
    if not len(chunk):
        return [[{"pieces": np.empty(0, np.int64), "logp": 0.0, "gumbel": 0.0, "inclusion": 1.0}] for _ in texts]
    lat = Lattice(distinct, v)
    begin = np.cumsum(sizes) - sizes
    length = np.fromiter(map(len, distinct), np.int64, len(distinct))[chunk]
    place = np.cumsum(length) - length
    place -= np.repeat(place[np.minimum(begin, len(place) - 1)], sizes)
    key = np.repeat(np.array(keys, np.uint64), sizes)
    results: list[list[dict]] = [[] for _ in texts]
    paths: list[list] = [[] for _ in texts]  # edges
    rests: list[list] = [[] for _ in texts]  # (value, path, step, banned edges)
    top = (-np.log(-np.log(uniform(np.array(keys, np.uint64), 1, np.zeros(1))))).tolist()

    edges, count = _walk(lat, chunk, key, place, 2)
    cond = lat.cond[edges]
    ends = np.concatenate([[0], np.cumsum(count)])
    first = [(t, edges[a:b], cond[a:b], top[t], 0, None) for t, (a, b) in enumerate(zip(ends[begin].tolist(), ends[begin + sizes].tolist(), strict=True))]
    _enter(lat, results, paths, rests, first, keys, 1, k + 1)
    for sample in range(2, k + 1):
        entered, tails = [], []
        for t in range(len(texts)):
            if not rests[t]:
                continue
            best = max(range(len(rests[t])), key=lambda i: rests[t][i][0])
            value, path, step, banned = rests[t].pop(best)
            head = paths[t][path]
            node = lat.start[head[step]]
            options = np.array([e for e in range(lat.first[node], lat.first[node + 1]) if e not in banned])
            share = np.cumsum(np.exp(lat.cond[options]))
            salt = 100 * sample
            edge = int(options[min(len(options) - 1, int(np.searchsorted(share, share[-1] * uniform_one(keys[t], salt, step))))])
            kept, node, at = [*head[:step].tolist(), edge], int(lat.end[edge]), step + 1
            while not lat.final[node]:
                edge, u = int(lat.first[node]), uniform_one(keys[t], salt + 1, at)
                while u >= lat.upto[edge]:
                    edge += 1
                kept.append(edge)
                node, at = int(lat.end[edge]), at + 1
            done = int(lat.final[lat.end[np.array(kept)]].sum())  # whole chunks so far
            others = [e for e in options.tolist() if e != kept[step]]
            entered.append((t, value, step, np.array(kept), banned | {kept[step]}, bool(others)))
            tails.append(np.arange(begin[t] + done, begin[t] + sizes[t]))
        if not entered:
            break
        tail = np.concatenate(tails)
        edges, count = _walk(lat, chunk[tail], key[tail], place[tail], 100 * sample + 2)
        cond = lat.cond[edges]
        ends = np.concatenate([[0], np.cumsum(count)])
        at, found = 0, []
        for (t, value, step, kept, banned, more), own in zip(entered, tails, strict=True):
            a, b = ends[at], ends[at + len(own)]
            at += len(own)
            path, along = np.concatenate([kept, edges[a:b]]), np.concatenate([lat.cond[kept], cond[a:b]])
            found.append((t, path, along, value, step + 1, banned if more else None))
        _enter(lat, results, paths, rests, found, keys, sample, k + 1)
    for t in range(len(texts)):
        threshold = max((r[0] for r in rests[t]), default=-np.inf)
        for r in results[t]:
            r["inclusion"] = float(-np.expm1(-np.exp(min(700.0, r["logp"] - threshold)))) if threshold > -np.inf else 1.0
    rows = [r for found in results for r in found]
    steps = np.array([len(r["edges"]) for r in rows])
    ids, count = v.spelled(lat.piece[np.concatenate([r.pop("edges") for r in rows])])
    ends = np.concatenate([[0], np.cumsum(count)])[np.cumsum(steps)].tolist()
    for r, a, b in zip(rows, [0, *ends], ends):
        r["pieces"] = ids[a:b]
    return results


def _enter(lat: Lattice, results: list, paths: list, rests: list, found: list[tuple], keys: list[int], sample: int, most: int) -> None:
    """Note new paths, one of a text, and the rests that they leave.

    found: (text, path's edges, their log-probabilities, highest value of the path's set, first step that leaves rests, edges of
    the step before that are taken, where more are left).
    """
    heads, lasts = [], []
    for t, path, cond, value, fresh, banned in found:
        results[t].append({"edges": path, "logp": float(cond.sum()), "gumbel": value})
        if banned:
            node = lat.start[path[fresh - 1]]
            left = [lat.cond[e] for e in range(lat.first[node], lat.first[node + 1]) if e not in banned]
            where = cond[: fresh - 1].sum() + np.logaddexp.reduce(left)
            u = uniform_one(keys[t], 50 * sample + 7, fresh - 1)
            rests[t].append((float(_below(where, value, u)), len(paths[t]), fresh - 1, banned))
        prefix = np.cumsum(cond) - cond
        heads.append(prefix)
        # rests as far down as this hardly ever count
        lasts.append(max(fresh, int(np.searchsorted(-prefix, 2 * NOISE - min(value, 0.0)))))
    # once ``most`` rests stand above all that noise can lift sets further down to, the head suffices; else the whole path is drawn
    todo = list(range(len(found)))
    while todo:
        again, spans = [], [(found[i][4], min(lasts[i] + 1, len(heads[i]))) for i in todo]
        sizes = np.array([max(0, b - a) for a, b in spans])
        cut = lambda arrays: np.concatenate([x[a:b] for x, (a, b) in zip(arrays, spans, strict=True)])  # noqa: B023, E731
        cond, prefix = cut([found[i][2] for i in todo]), cut([heads[i] for i in todo])
        ends = np.cumsum(sizes)
        steps = np.arange(len(cond)) - np.repeat(ends - sizes - np.array([a for a, _ in spans]), sizes)
        who = np.repeat(np.arange(len(todo)), sizes)
        open_ = np.flatnonzero(cond < 0.0)  # a node's only edge leaves no rest
        cond, prefix, steps, who = cond[open_], prefix[open_], steps[open_], who[open_]
        place = prefix + np.log(-np.expm1(np.minimum(cond, -1e-300)))
        u = uniform(np.array([keys[found[i][0]] for i in todo], np.uint64)[who], 50 * sample + 8, steps)
        drawn = _below(place, np.array([found[i][3] for i in todo])[who], u)
        cuts = np.searchsorted(who, np.arange(len(todo) + 1)).tolist()
        for n, i in enumerate(todo):
            t, path, last = found[i][0], found[i][1], spans[n][1]
            own = drawn[cuts[n] : cuts[n + 1]]
            keep = np.argsort(-own)[:most]  # no path gives more than that
            if last < len(path) and not (len(keep) == most and heads[i][last - 1] + NOISE < own[keep[-1]]):
                lasts[i] = len(path)
                again.append(i)
                continue
            at = steps[cuts[n] : cuts[n + 1]]
            rests[t].extend((float(own[x]), len(paths[t]), int(at[x]), {int(path[at[x]])}) for x in keep)
            paths[t].append(path)
        todo = again


def decode(pieces, v: Vocabulary) -> str:
    """The text of piece ids: bytes in a row are joined, the mark in front is dropped, other marks become spaces."""
    pieces = np.asarray(pieces, np.int64)
    text = v.raw(pieces).tobytes().decode("utf-8", "replace")
    return text[1:] if len(pieces) and v.text[pieces[0]].startswith(SPACE) else text


_FIELDS = {"doc_id": pa.int64(), "sample": pa.int32(), "n_pieces": pa.int64(), "logp": pa.float64(), "gumbel": pa.float64(), "inclusion": pa.float64(), "ids_crc32": pa.int64(), "round_trip": pa.bool_()}


def _sample(batches: Iterator[pa.RecordBatch], file: str, k: int, sharpness: float, seed: int, with_pieces: bool) -> Iterator[pa.RecordBatch]:
    v = vocabulary(file, sharpness)
    schema = pa.schema(list(_FIELDS.items()) + [("pieces", pa.list_(pa.int32()))] * with_pieces)

    def solved(ids, texts):
        keys = [xxhash.xxh64_intdigest(repr(i).encode(), seed) for i in ids]
        rows, found = [], sample_texts(texts, keys, k, v)
        for i, text, drawn in zip(ids, texts, found, strict=True):
            want = text.replace(SPACE, " ").encode("utf-8", "surrogatepass")
            for n, r in enumerate(drawn, 1):
                crc = zlib.crc32(r["pieces"].astype("<u4").tobytes())
                rows.append((i, n, len(r["pieces"]), r["logp"], r["gumbel"], r["inclusion"], crc, v.raw(r["pieces"]).tobytes()[1:] == want))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FIELDS.values(), strict=True)]
        if with_pieces:
            flat = [r["pieces"] for drawn in found for r in drawn]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(ends, np.concatenate(flat).astype(np.int32)))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for batch in batches:
        ids, texts, size = [], [], 0
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(i)
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= SLICE_CHARS:
                yield solved(ids, texts)
                ids, texts, size = [], [], 0
        if ids:
            yield solved(ids, texts)


def sample_segmentations(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", file: str = "piece_bpe_32k.model", k: int = 2, sharpness: float = 1.0, seed: int = 8,
    with_pieces: bool = False,
) -> DataFrame:
    """Up to ``k`` rows per row of ``docs``: id, sample (1 is the highest draw), n_pieces, logp, gumbel, inclusion, ids_crc32, round_trip (and pieces).

    The segmentations of a row are distinct; a text with fewer has fewer rows, an empty or null one a single empty row.
    logp: the segmentation's log-probability; gumbel: its perturbed value; inclusion: the probability that it exceeds the
    first value left out, the weight of without-replacement estimates.  round_trip: whether the pieces decode to the text
    (a mark U+2581 in a text decodes to a space).  Rows with one id draw the same numbers; a null id is a key as well.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    fields = "doc_id bigint, sample int, n_pieces bigint, logp double, gumbel double, inclusion double, ids_crc32 bigint, round_trip boolean" + ", pieces array<int>" * with_pieces
    return source.mapInArrow(lambda b: _sample(b, file, k, sharpness, seed, with_pieces), fields).withColumnRenamed("doc_id", id_col)


def encode_texts(docs: DataFrame, text: str = "text", file: str = "piece_bpe_32k.model") -> DataFrame:
    """``docs`` and the column piece_ids: the library's own encoding; null for null."""

    @F.pandas_udf("array<int>")
    def encoded(column):
        sp = vocabulary(file, 1.0).sp
        return column.map(lambda t: sp.encode(t), na_action="ignore")

    return docs.withColumn("piece_ids", encoded(F.col(text)))


def decode_ids(docs: DataFrame, ids: str = "piece_ids", file: str = "piece_bpe_32k.model") -> DataFrame:
    """``docs`` and the column decoded: the text of piece ids; null for null."""

    @F.pandas_udf("string")
    def decoded(column):
        v = vocabulary(file, 1.0)
        return column.map(lambda x: decode([int(i) for i in x], v), na_action="ignore")

    return docs.withColumn("decoded", decoded(F.col(ids)))
