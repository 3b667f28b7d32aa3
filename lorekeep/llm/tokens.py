"""Token counts at every prefix, by dynamic programming over byte-pair encodings.

Any run of tokens out of an encoding is the encoding of its own bytes, and a sequence is an encoding if each
neighbouring pair is one.  So for each prefix of a word exactly one last token fits: it stands after a shorter prefix
whose own last token it pairs with.  One pass over a word gives the counts of all its prefixes, and a text's counts are
the sums over its words.  Word results and pair verdicts are remembered per worker, in tables of bounded size.
"""

from __future__ import annotations

import functools
import json
import operator
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how this kind of tokenizer cuts a text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MEMORY = 400_000
#: Two white-space characters in a row: there a prefix may end inside a run that the whole text cuts elsewhere.
_RUN = re.compile(r"\s\s")


def tokenizer_file(name_or_path: str) -> str:
    """A path as it is; the name of a public tokenizer file as its place on this machine."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def _byte_of_symbol() -> dict[str, int]:
    """Printable stand-ins of bytes: printable Latin-1 characters stand for themselves, other bytes for U+0100 and up, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Counts(dict):
    def __init__(self, solve):
        super().__init__()
        self.solve = solve

    def __missing__(self, word: str) -> int:
        if len(self) > _MEMORY:
            self.clear()
        value = self[word] = self.solve(word)
        return value


class PrefixTokens:
    """Counts for a byte-level BPE file of the ``tokenizers`` library, special tokens inside texts recognised as it does."""

    def __init__(self, file: str):
        with open(tokenizer_file(file), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"]:
            raise ValueError("only byte-level BPE without a normalizer is supported")
        as_byte = _byte_of_symbol()
        raw = lambda symbols: bytes(as_byte[c] for c in symbols)
        self.ids = {raw(k): v for k, v in model["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.parts: dict[bytes, tuple[bytes, bytes]] = {}
        for a, b in self.rank:
            self.parts.setdefault(a + b, (a, b))
        self.born = {t: self.rank[ab] for t, ab in self.parts.items()}
        self.longest = max(map(len, self.ids))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = regex.compile(WORD_PATTERN)
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.total_of = _Counts(lambda w: self.word_counts(w)[-1])
        self.steps_of = _Counts(self._steps_of_word)

    def merged(self, data: bytes) -> list[bytes]:
        """The encoding by its definition: merge the pair of least rank until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def fit(self, a: bytes, b: bytes) -> bool:
        """Whether the encoding of ``a + b`` is [a, b] (of ``b`` alone: [b])."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > _MEMORY:
                self.fits.clear()
            known = self.fits[a, b] = self._stay_apart(a, b) if a else self.merged(b) == [b]
        return known

    def _stay_apart(self, a: bytes, b: bytes) -> bool:
        """Undo the merges that made ``a`` and ``b``, latest first: did any pair across the border come up in time to merge?

        Of merges of one rank the leftmost comes first, so a pair across the border precedes the making of ``b`` at a tie.
        """
        rank, born, parts = self.rank.get, self.born.get, self.parts
        before = 1 << 60
        while True:
            if rank((a, b), before) < before:
                return False
            made_a, made_b = born(a, -1), born(b, -1)
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                before, a = made_a, parts[a][1]
            else:
                before, b = made_b + 1, parts[b][0]

    def word_counts(self, word: str) -> list[int]:
        """Token counts of all prefixes of a word, by character, from the empty one to the whole."""
        data = word.encode()
        counts, last = [0] * (len(data) + 1), [b""] * (len(data) + 1)
        ids, known = self.ids, self.fits.get
        for j in range(1, len(data) + 1):
            for i in range(max(0, j - self.longest), j):
                token = data[i:j]
                if token in ids:
                    verdict = known((last[i], token))
                    if verdict or verdict is None and self.fit(last[i], token):
                        counts[j], last[j] = counts[i] + 1, token
                        break
        if len(data) == len(word):
            return counts
        return [counts[i] for i in range(len(data) + 1) if i == len(data) or data[i] & 0xC0 != 0x80]

    def _steps_of_word(self, word: str) -> bytes:
        """Differences of the token counts of a word's prefixes, as 16-bit numbers."""
        counts = self.word_counts(word)
        if word in ("'re", "'ve", "'ll"):  # one character less is no word of its own
            counts[2] = 2
        return array("h", map(operator.sub, counts[1:], counts)).tobytes()

    def _parts(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special tokens: (part, special)."""
        if self.special_pattern is None or not any(s in text for s in self.special):
            return [(text, False)]
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += [(text[at : m.start()], False), (m[0], True)]
            at = m.end()
        return [x for x in [*out, (text[at:], False)] if x[0]]

    def total(self, text: str) -> int:
        """Tokens of a whole text: its last prefix count."""
        count = self.total_of.__getitem__
        return sum(1 if special else sum(map(count, self.words.findall(part))) for part, special in self._parts(text))

    def counts(self, text: str) -> np.ndarray:
        """Token counts of all prefixes of a text, by character: entry p counts the tokens of ``text[:p]``."""
        out, base, before = [np.zeros(1, np.int64)], 0, ""
        for part, special in self._parts(text):
            if special:  # until it is whole, a special token is ordinary text behind what stands before it
                start = base - (self.total(before) if before else 0)
                out.append(np.array([start + self.total(before + part[:k]) for k in range(1, len(part))] + [base + 1], np.int64))
                base, before = base + 1, ""
                continue
            run_start, run_base = 0, base  # of the white-space run that ends here
            for m in self.words.finditer(part):
                word = m[0]
                own = np.cumsum(np.frombuffer(self.steps_of[word], np.int16), dtype=np.int64)
                whole = int(own[-1])
                own += base
                lead = 1 if word[0].isspace() and not word.isspace() else len(word) if word.isspace() else 0
                if lead:  # inside a run of white space, a prefix ends with all of the run so far as one word
                    if not (m.start() and part[m.start() - 1].isspace()):
                        run_start, run_base = m.start(), base
                    if run_start < m.start():
                        run = np.array(self.word_counts(part[run_start : m.start() + lead])[1:], np.int64)
                        own[:lead] = run_base + run[m.start() - run_start :]
                out.append(own)
                base += whole
            before = part
        return np.concatenate(out)

    def steps(self, text: str) -> np.ndarray:
        """Differences of :meth:`counts`; where no two white-space characters meet, those of its words in a row."""
        if _RUN.search(text) or len(self._parts(text)) > 1:
            return np.diff(self.counts(text)).astype(np.int16)
        if text in self.special:
            return np.diff(self.counts(text)).astype(np.int16)
        return np.frombuffer(b"".join(map(self.steps_of.__getitem__, self.words.findall(text))), np.int16)


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """Most characters whose tokens fit a budget, from prefix counts (which need not rise steadily)."""
    if counts.max() <= budget:
        return len(counts) - 1
    return int(np.flatnonzero(counts <= budget)[-1])


@functools.lru_cache(4)
def counter(file: str) -> PrefixTokens:
    return PrefixTokens(file)


def _count(batches: Iterator[pa.RecordBatch], file: str, prefixes: bool, budget: int) -> Iterator[pa.RecordBatch]:
    c = counter(file)
    for batch in batches:
        n_bytes, n_tokens, kept, deltas = [], [], [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
            if prefixes:
                steps = c.steps(text)
                total = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
                n_tokens.append(int(total[-1]))
                kept.append(longest_prefix(total, budget))
                deltas.append(steps.tobytes())
            else:
                n_tokens.append(c.total(text))
        columns = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())]
        if prefixes:
            columns += [pa.array(kept, pa.int64()), pa.array(deltas, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "budget_chars", "steps"][: len(columns)])


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", file: str = "byte_bpe_50k.json", limit: int = 1024, prefixes: bool = False
) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` for each row; with ``prefixes`` also budget_chars and steps.

    n_tokens: as the library encodes the whole text without added special tokens; over_limit: more than ``limit``.
    steps: 16-bit differences (in the machine's order of bytes) of the token counts of successive prefixes, by character; their running sum
    answers any truncation or budget question without encoding again.  budget_chars: most characters within ``limit``.
    A null text counts as empty; a null id stays null; repeated rows stay; other columns are ignored.  No shuffle.
    """
    fields = "doc_id bigint, n_bytes bigint, n_tokens bigint" + (", budget_chars bigint, steps binary" if prefixes else "")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = source.mapInArrow(lambda b: _count(b, file, prefixes, limit), fields).withColumnRenamed("doc_id", id_col)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
