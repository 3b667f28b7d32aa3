"""Quality rules: base counts plus distribution divergence, in built-in expressions only.

A document's character-class histogram and its common-word histogram are compared with references of several
languages by Jensen-Shannon distance (base 2, so 0 to 1).  A document passes if some language fits both and its common
words make up a least part of the share they have in the reference: without any of them the distance stays below its limit.
Histograms of few characters or words say little, so each has a minimum length under which it isn't judged.  The references
say nothing of languages that they don't hold: a text that is said to be in another one, one without such a word whose letters
theirs lack, and one in another script are judged by the base rules alone.

The references are parameters of fixed size, not corpus statistics: one pass, no shuffle, no state that grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shares of lower-case letters, upper-case letters, digits, white space, punctuation, all else in edited prose.
CHAR_CLASSES = ("lower", "upper", "digit", "space", "punct", "other")
CHAR_REFERENCE = {
    "en": (0.775, 0.030, 0.010, 0.160, 0.024, 0.001),
    "de": (0.770, 0.055, 0.010, 0.140, 0.024, 0.001),
    "fr": (0.770, 0.030, 0.010, 0.160, 0.029, 0.001),
    "es": (0.775, 0.028, 0.010, 0.162, 0.024, 0.001),
}
CHAR_PATTERN = (r"[^\p{Ll}]+", r"[^\p{Lu}]+", r"[^0-9]+", r"[^\x09-\x0D\x20]+", r"[^.,;:!?'\x22()\-]+")
#: Shares, in percent of all words, of very common words.
WORD_REFERENCE = {
    "en": {"the": 6.2, "of": 3.1, "and": 2.8, "to": 2.6, "a": 2.2, "in": 2.0, "is": 1.1, "that": 1.1, "it": 0.9, "was": 0.9, "for": 0.9, "with": 0.7},
    "de": {"der": 3.4, "die": 3.3, "und": 2.7, "in": 1.8, "den": 1.2, "von": 1.1, "zu": 1.1, "das": 1.1, "mit": 0.9, "des": 0.8, "ist": 0.8, "nicht": 0.7},
    "fr": {"de": 4.7, "la": 2.8, "le": 2.2, "et": 2.1, "les": 1.9, "des": 1.7, "en": 1.3, "un": 1.1, "du": 1.1, "une": 0.9, "que": 0.9, "pour": 0.8},
    "es": {"de": 5.5, "la": 3.6, "que": 2.8, "el": 2.7, "en": 2.5, "y": 2.4, "los": 1.6, "del": 1.1, "se": 1.1, "las": 1.0, "por": 0.9, "un": 0.9},
}
#: Fixed value: the Latin letters that the references' languages write.
KNOWN_LETTERS = "a-zA-ZÄÖÜäöüßÀÂÆÇÈÉÊËÎÏÔŒÙÛŸàâæçèéêëîïôœùûÿÁÍÑÓÚáíñóú"
#: A text without a language is in another one if more than this percentage of its letters are others.
MAX_OTHER_LETTERS = 1
MIN_CHARS, MIN_WORDS = 200, 100
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.20, 0.45
#: Least share of a language's common words, as a part of their share in its reference.
MIN_COMMON = 0.3


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words stand in 3-word windows that the array holds twice or more.

    Windows are ordered by (64-bit hash, place), so equal ones become neighbours; each repeated window then
    adds the words up to the next repeated window, three at most.
    """
    n = F.size(words)
    none = F.lit(0).cast("long")

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = lambda o: F.sort_array(F.transform(F.filter(o, lambda x, k: (
            (x["h"] == F.get(o, k - 1)["h"]) | (x["h"] == F.get(o, k + 1)["h"]))), lambda x: x["i"]))
        total = F.aggregate(
            _once(ordered, starts), F.struct(none.alias("sum"), F.lit(-3).alias("last")),
            lambda acc, i: F.struct((acc["sum"] + F.least(F.lit(3), i - acc["last"])).cast("long").alias("sum"), i.alias("last")))["sum"]
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).otherwise(total)

    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    return F.when(n < 4, none).otherwise(_once(hashes, covered))


def js_distance(counts: Column, reference: tuple[float, ...]) -> Column:
    """Jensen-Shannon distance (square root of the base-2 divergence) of a histogram from shares."""
    total = float(sum(reference))
    ref = F.array(*[F.lit(x / total) for x in reference])
    size = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(F.transform(counts, lambda c: c / size), ref, lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def _once(value: Column, use) -> Column:
    """``use(value)``, with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _signals(text: Column, char_reference: dict, word_reference: dict) -> Column:
    """All signals of a text as one struct, each part of which is computed once wherever its fields are used or filtered."""
    vocabulary = sorted({w for words in word_reference.values() for w in words})
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

    def parts(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        letter_words = F.filter(F.split(F.lower(t), r"[^\p{L}]+"), lambda w: w != "")
        classes = F.array(*[F.char_length(F.regexp_replace(t, p, "")).cast("double") for p in CHAR_PATTERN])
        return F.struct(t.alias("t"), words_of(t).alias("w"), lines.alias("l"), letter_words.alias("lw"), classes.alias("known"))

    def counts(x: Column) -> Column:
        common = F.concat(F.lit(" "), F.array_join(F.filter(x["lw"], lambda w: w.isin(vocabulary)), "  "), F.lit(" "))
        times = lambda j: F.array(*[(F.octet_length(j) - F.octet_length(F.replace(j, F.lit(f" {w} "), F.lit("")))) / float(len(f" {w} ".encode())) for w in vocabulary])
        n = F.char_length(x["t"])
        return F.struct(
            x["t"].alias("t"), F.size(x["w"]).cast("long").alias("n_words"), (n - x["known"][CHAR_CLASSES.index("space")]).cast("long").alias("word_chars"),
            F.char_length(F.regexp_replace(x["t"], r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size(x["l"]) - F.size(F.array_distinct(x["l"]))).cast("long").alias("n_dup_lines"), repeated_words(x["w"]).alias("n_repeat_words"),
            n.cast("long").alias("n_chars"), F.size(x["lw"]).cast("long").alias("n_letter_words"),
            F.concat(x["known"], F.array(n - total(x["known"]))).alias("classes"), _once(common, times).alias("times"))

    def distances(x: Column) -> Column:
        own = lambda known: F.array(*[x["times"][vocabulary.index(w)] for w in known])
        words = lambda known: F.concat(own(known), F.array(x["n_letter_words"] - total(own(known))))
        shares = lambda known: (*known.values(), 100.0 - sum(known.values()))
        common = lambda known: total(own(known)) / x["n_letter_words"] / (sum(known.values()) / 100.0)
        return F.struct(
            *[x[c].alias(c) for c in ("t", *COUNTS)],
            F.when(x["n_chars"] > 0, F.array(*[js_distance(x["classes"], r) for r in char_reference.values()])).alias("js_chars"),
            F.when(x["n_letter_words"] > 0, F.array(*[js_distance(words(k), shares(k)) for k in word_reference.values()])).alias("js_words"),
            F.when(x["n_letter_words"] > 0, F.array(*[common(k) for k in word_reference.values()])).alias("common"))

    return _once(_once(_once(F.coalesce(text, F.lit("")), parts), counts), distances)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_letter_words")
SIGNALS = (*COUNTS, "js_chars", "js_words", "common")


def _with(docs: DataFrame, found: Column, names: tuple[str, ...]) -> DataFrame:
    """``docs`` and fields of a struct; its own columns travel in another, so that no name can clash."""
    own = [c for c in docs.columns if c not in names]
    return docs.select(F.struct(*own).alias("row"), found.alias("found")).select(*[F.col("row")[c].alias(c) for c in own], *[F.col("found")[c].alias(c) for c in names])


def quality_signals(docs: DataFrame, text: str = "text", char_reference=None, word_reference=None) -> DataFrame:
    """``docs`` and the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_chars, n_letter_words,
    js_chars, js_words and common (arrays by language, in order of the references; common: the share of the language's
    common words as a part of their share in its reference).

    A null text counts as no text: all counts 0 and distances null.  Columns of ``docs`` with these names are replaced,
    all others stay whatever they are called.
    """
    return _with(docs, _signals(F.col(text).cast("string"), char_reference or CHAR_REFERENCE, word_reference or WORD_REFERENCE), SIGNALS)


def quality_rules(
    docs: DataFrame, text: str = "text", min_words: int = 50, max_repeat_percent: int = 50, min_chars: int = MIN_CHARS, min_letter_words: int = MIN_WORDS,
    max_char_distance: float = MAX_CHAR_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE, char_reference=None, word_reference=None,
    min_common: float = MIN_COMMON, script: str = "Latin", lang: str | None = None,
) -> DataFrame:
    """:func:`quality_signals` and the columns base_failed and kept.

    base_failed: under ``min_words`` words, or over ``max_repeat_percent`` % of them in repeated 3-word windows.
    kept: not base_failed, and some language's distances are both small enough and its common words no fewer than
    ``min_common`` of their share in the reference; a histogram of under ``min_chars``
    characters or ``min_letter_words`` words is not judged, nor is a text in a language without a reference: one of which the column
    ``lang`` says so; one without a language there more than ``MAX_OTHER_LETTERS`` % of whose letters the references' languages don't
    write; one most of whose letters are of another script than ``script``.  Both references must name the same languages in order.

    Null, empty and blank texts have no words and fail the base rules; repeated rows get equal results, an empty table an
    empty one.  A very long text is one row's work: lists of its words are held, of windows a hash each.
    """
    char_reference, word_reference = char_reference or CHAR_REFERENCE, word_reference or WORD_REFERENCE
    if list(char_reference) != list(word_reference):
        raise ValueError("the references name different languages")

    def judged(x: Column) -> Column:
        failed = (x["n_words"] < min_words) | (100 * x["n_repeat_words"] > max_repeat_percent * x["n_words"])
        fits = F.exists(
            F.arrays_zip(x["js_chars"].alias("c"), x["js_words"].alias("w"), x["common"].alias("o")),
            lambda y: ((x["n_chars"] < min_chars) | (y["c"] <= max_char_distance))
            & ((x["n_letter_words"] < min_letter_words) | ((y["w"] <= max_word_distance) & (y["o"] >= min_common))))
        no_words = (x["n_chars"] < min_chars) | (F.array_min(x["js_chars"]) <= max_char_distance)
        verdict = F.when(x["n_letter_words"] == 0, no_words).otherwise(fits)
        letters = lambda p: F.char_length(F.regexp_replace(x["t"], p, ""))
        named = F.lit(None).cast("string") if lang is None else F.col(lang).cast("string")
        odd = 100 * letters(rf"[^\p{{L}}]+|[{KNOWN_LETTERS}]+") > MAX_OTHER_LETTERS * letters(r"[^\p{L}]+")
        foreign = F.coalesce(~named.isin(*char_reference), odd) | (2 * letters(rf"[^\p{{Is{script}}}]+") < letters(r"[^\p{L}]+"))  # asked of rejected texts alone
        kept = F.when(failed, False).when(F.coalesce(verdict, F.lit(True)), True).otherwise(foreign)
        return F.struct(*[x[c].alias(c) for c in SIGNALS], failed.alias("base_failed"), kept.alias("kept"))

    found = _once(_signals(F.col(text).cast("string"), char_reference, word_reference), judged)
    return _with(docs, found, (*SIGNALS, "base_failed", "kept"))
