"""Masked pseudo-likelihood of texts under a bidirectional window network and the corpus's word counts.

Words become classes: the most frequent words of the corpus, hash classes of word endings for all others, and a border.
Counts of (left, word, right) over all documents train a small network in numpy that predicts a class from both its
neighbours; as there are ``classes ** 3`` windows at most, the counts that reach the driver have a fixed bound however
large the corpus.  P(word | class) comes from a table of all words of the corpus, which grows with it, stays in shared
storage and meets the texts' words in a join.  A text's score sums log P(class | both sides) + log P(word | class) over
its words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.plans.store import materialize

WORD = re.compile(r"[^\W_]+")
FREQUENT, ENDINGS = 88, 39
BORDER = FREQUENT + ENDINGS
CLASSES = BORDER + 1
HIDDEN, EPOCHS = 32, 150
#: Log-probabilities of words are summed as whole multiples of 1 / UNIT, so that the order of a sum doesn't matter.
UNIT = 1 << 30


class Model(NamedTuple):
    """words: (word, ending, logp) of all words but the frequent ones; unknown: log-probability by ending of a word not among them."""

    frequent: list[str]
    weights: dict[str, np.ndarray]
    words: DataFrame
    unknown: list[float]


def ending(word: str) -> int:
    return zlib.crc32(word[-2:].encode("utf-8", "surrogatepass")) % ENDINGS


def _ending_of(word: str) -> Column:
    """:func:`ending` of a column."""
    return (F.crc32(F.encode(F.right(word, F.lit(2)), "utf-8")) % ENDINGS).cast("int")


class _Classes(dict):
    def __init__(self, frequent: list[str]):
        super().__init__({w: k for k, w in enumerate(frequent)})
        self.frequent = dict(self)

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
            self.update(self.frequent)
        value = self[word] = FREQUENT + ending(word)
        return value


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def word_classes(words: list[str], known: _Classes) -> np.ndarray:
    """Classes of lower-cased words, with a border at both ends; empty without words."""
    if not words:
        return np.empty(0, np.int64)
    out = np.full(len(words) + 2, BORDER, np.int64)
    out[1:-1] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    return out


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0):
            counts.update(words_of(text.as_py()))
            if len(counts) > 200_000:
                yield out()
                counts.clear()
    if counts:
        yield out()


def _windows(batches: Iterator[pa.RecordBatch], frequent: list[str]) -> Iterator[pa.RecordBatch]:
    known, total = _Classes(frequent), np.zeros(CLASSES**3, np.int64)
    pending, size = [], 0

    def add():
        total[:] += np.bincount(np.concatenate(pending), minlength=len(total))

    for batch in batches:
        for text in batch.column(0):
            c = word_classes(words_of(text.as_py()), known)
            if len(c):
                pending.append((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:])
                size += len(c)
            if size > 2_000_000:
                add()
                pending, size = [], 0
    if pending:
        add()
    at = np.flatnonzero(total)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])


def train(codes: np.ndarray, counts: np.ndarray, epochs: int = EPOCHS, hidden: int = HIDDEN, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights fitted to window counts by full-batch Adam on the cross-entropy of the middle class."""
    rng = np.random.default_rng(seed)
    context = codes // CLASSES**2 * CLASSES + codes % CLASSES
    middle = codes // CLASSES % CLASSES
    seen, row = np.unique(context, return_inverse=True)
    target = np.zeros((len(seen), CLASSES), np.float32)
    np.add.at(target, (row, middle), counts.astype(np.float64))
    target /= target.sum()
    weight = target.sum(axis=1, keepdims=True)
    left, right = seen // CLASSES, seen % CLASSES
    marginal = target.sum(axis=0) + 1e-6
    p = {
        "left": rng.normal(0, 0.3, (CLASSES, hidden)), "right": rng.normal(0, 0.3, (CLASSES, hidden)), "in": np.zeros(hidden),
        "out": rng.normal(0, 0.1, (hidden, CLASSES)), "bias": np.log(marginal / marginal.sum())}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, epochs + 1):
        h = np.tanh(p["left"][left] + p["right"][right] + p["in"])
        z = h @ p["out"] + p["bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        dz = z / z.sum(axis=1, keepdims=True) * weight - target
        dh = dz @ p["out"].T * (1 - h * h)
        g = {"out": h.T @ dz, "bias": dz.sum(axis=0), "in": dh.sum(axis=0), "left": np.zeros_like(p["left"]), "right": np.zeros_like(p["right"])}
        np.add.at(g["left"], left, dh)
        np.add.at(g["right"], right, dh)
        rate = 0.05 * (1 - step / (epochs + 1))
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
    return p


def log_probabilities(weights: dict[str, np.ndarray]) -> np.ndarray:
    """Table [left, right, word] of log-probabilities."""
    h = np.tanh(weights["left"][:, None, :] + weights["right"][None, :, :] + weights["in"])
    z = h @ weights["out"] + weights["bias"]
    z -= z.max(axis=2, keepdims=True)
    return (z - np.log(np.exp(z).sum(axis=2, keepdims=True))).astype(np.float32)


def _score(batches: Iterator[pa.RecordBatch], frequent: list[str], weights: dict[str, np.ndarray], rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """A row for each distinct word of a text that isn't frequent; the text's first row has its id, length and sum over classes.

    A text without such words has one row with a word that no text holds.
    """
    known, table = _Classes(frequent), log_probabilities(weights)
    head = pa.struct([("doc_id", pa.int64()), ("n_words", pa.int64()), ("base", pa.float64())])
    keys, sizes, words, times, heads = [], [], [], [], []

    def out():
        size = np.array(sizes)
        first = np.zeros(len(words), bool)
        first[np.cumsum(size) - size] = True
        at = pa.array(np.where(first, np.cumsum(first) - 1, 0), mask=~first)
        batch = pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array(keys), size)), pa.array(words, pa.string()), pa.array(times, pa.int64()), pa.array(heads, head).take(at)],
            names=["key", "word", "n", "head"])
        for held in (keys, sizes, words, times, heads):
            held.clear()
        return batch

    for batch in batches:
        for key, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            found = words_of(text.as_py())
            c = word_classes(found, known)
            rare = Counter(w for w in found if w not in known.frequent) or {f" {key % 100_003}": 0}
            keys.append(key)
            sizes.append(len(rare))
            words.extend(rare)
            times.extend(rare.values())
            heads.append({"doc_id": doc, "n_words": len(found), "base": float(table[c[:-2], c[2:], c[1:-1]].sum(dtype=np.float64)) if len(c) else 0.0})
            if len(words) >= rows:
                yield out()
    if keys:
        yield out()


def word_table(counted: DataFrame, frequent: list[str]) -> tuple[DataFrame, list[float]]:
    """``(word, ending, logp)`` of the words of ``counted`` (word, n) that aren't frequent, and the same for an unknown word by ending.

    P(word | ending) is (n + 1) / (N + V + 1) where N words, V of them distinct, have the ending: the last place is for
    all words not met.
    """
    rest = counted.where(~F.col("word").isin(frequent)) if frequent else counted
    rest = rest.select("word", "n", _ending_of("word").alias("ending"))
    size = {r["ending"]: r["size"] for r in rest.groupBy("ending").agg((F.sum("n") + F.count("*") + 1).alias("size")).collect()}
    unknown = [-float(np.log(size.get(e, 1))) for e in range(ENDINGS)]
    logp = F.log(F.col("n") + 1.0) + F.get(F.array(*[F.lit(x) for x in unknown]), F.col("ending"))
    return rest.select("word", "ending", logp.alias("logp")), unknown


def fit(docs: DataFrame, text: str = "text", epochs: int = EPOCHS) -> Model:
    """The frequent words of ``docs``, the network's weights and the table of all other words.  Without any word: no words, and weights as drawn."""
    texts = docs.select(F.col(text).cast("string").alias("text"))
    counted = materialize(texts.mapInArrow(_word_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    frequent = [r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]
    windows = texts.mapInArrow(lambda b: _windows(b, frequent), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    found = windows.toArrow()  # at most CLASSES ** 3 rows of 16 bytes
    codes, counts = found.column("code").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(codes)
    if not len(codes):
        codes, counts, order = np.array([0]), np.array([1]), np.array([0])
    return Model(frequent, train(codes[order], counts[order], epochs), *word_table(counted, frequent))


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model: Model | None = None, epochs: int = EPOCHS) -> DataFrame:
    """``(id, n_words, sum_logp, mean_logp)`` per row of ``docs``, under ``model`` or one fitted to all of ``docs``.

    A text without words (null, empty) has a sum of 0 and a null mean; a null id stays null; repeated rows get equal
    scores; other columns are ignored.
    """
    frequent, weights, words, unknown = model or fit(docs, text, epochs)
    source = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "key bigint, word string, n bigint, head struct<doc_id: bigint, n_words: bigint, base: double>"
    bags = source.mapInArrow(lambda b: _score(b, frequent, weights), schema)
    logp = F.coalesce("logp", F.get(F.array(*[F.lit(x) for x in unknown]), _ending_of("word")))
    part = F.col("n") * F.round(logp * UNIT).cast("long")
    met = bags.join(words.select("word", "logp").hint("shuffle_hash"), "word", "left").select("key", "head.*", part.alias("part"))
    out = met.groupBy("key").agg(F.max("doc_id").alias(id_col), F.max("n_words").alias("n_words"), (F.max("base") + F.sum("part") / UNIT).alias("sum_logp"))
    return out.drop("key").withColumn("mean_logp", F.when(F.col("n_words") > 0, F.col("sum_logp") / F.col("n_words")))
