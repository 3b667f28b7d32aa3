"""Line dedup within an edit distance: segment-partition join, in built-in expressions only.

A line of at least ``min_chars`` characters is cut into ``max_edits + 1`` segments, a shorter one into as many as its
smaller limit asks for.  Two lines within that distance
share a segment exactly, so each line is indexed by (segment number, own length, segment) and probes, for each length
it may match, the substrings at the few offsets that can hold that segment.  Lines that share a key and whose letter
counts allow the distance are verified by a banded bit-parallel edit distance.

Keys are hashes; a hash that meets by chance is refuted by the verification.  Lines are known by 128 bits of hash (in
keys by 64, which pick texts of either), so texts move only for lines that share a key.  Keys that many lines share are
split into slices of bounded size, of which each is matched alone; no pair is dropped.  Copies of the lines that occur most
often are collapsed before keys are made, all others after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.plans.components import connected_components
from lorekeep.plans.store import discard, materialize

SLICE = 512
#: Of the lines that occur most often, at most as many, only the first occurrence is compared; none with fewer copies counts as frequent.
FREQUENT_LINES, LEAST_COPIES = 500_000, 64
#: The hashes of lines with candidates are broadcast up to this size, which their count is checked against.
BROADCAST_BYTES = 64 << 20
#: Letters whose counts the filter compares; any 32 will do.
LETTERS = "abcdefghijklmnopqrstuvwxyz .éèäö"
_HAS_WORD = r"[^\x20\x09-\x0D]"


def letter_signature(line: Column) -> Column:
    """Two bits for each letter: the Gray code of its count modulo 4, so that one more or less flips one bit."""
    total = F.lit(0).cast("long")
    for k, letter in enumerate(LETTERS):
        n = ((F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))) / len(letter.encode())).cast("long")
        total = total.bitwiseOR(F.shiftleft(n.bitwiseXOR(F.shiftright(n, 1)).bitwiseAND(F.lit(3).cast("long")), 2 * k))
    return total


def banded_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance of two strings whose lengths differ by ``most`` or less; exact up to ``most``, above it some larger number.

    Bit k of a vector stands for row j - most + k of column j: the band is one machine word that slides down the diagonal.
    """
    if not 1 <= most <= 30:
        raise ValueError("the band must fit a word")
    one = F.lit(1).cast("long")
    width = 2 * most + 1
    full = F.lit((1 << width) - 1).cast("long")
    flip = lambda x: x.bitwiseXOR(full)

    def solve(x: Column) -> Column:
        chars_a, chars_b, m = x["a"], x["b"], F.size(x["a"])

        def match(c: Column, at: Column) -> Column:  # at: 0-based column
            bits = F.lit(0).cast("long")
            for k in range(width):
                bits = bits.bitwiseOR(F.when(F.get(chars_a, at - most + k) == c, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
            return F.struct(bits.alias("pm"), (at + 1).alias("j"))

        def step(s: Column, col: Column) -> Column:
            pm, vp, vn = col["pm"], s["vp"], s["vn"]
            d0 = (pm.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(full)
            return F.struct(d0.alias("d0"), vp.alias("vp"), vn.alias("vn"), s["d"].alias("d"), col["j"].alias("j"))

        def finish(t: Column) -> Column:
            d0, vp, vn, j = t["d0"], t["vp"], t["vn"], t["j"]
            hp, hn = vn.bitwiseOR(flip(d0.bitwiseOR(vp))), d0.bitwiseAND(vp)
            at_end = m - j + most
            bit = lambda v: F.call_function("shiftright", v, at_end).bitwiseAND(one)
            grown = F.when(j <= m - most, one - F.shiftright(d0, 2 * most).bitwiseAND(one)).otherwise(bit(hp) - bit(hn))
            down = F.shiftright(d0, 1)
            return F.struct(
                hn.bitwiseOR(flip(down.bitwiseOR(hp))).bitwiseAND(full).alias("vp"), down.bitwiseAND(hp).alias("vn"), (t["d"] + grown).alias("d"))

        start = F.struct(
            F.lit(((1 << (most + 1)) - 1) << most).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(most).cast("long").alias("d"))
        columns = F.transform(chars_b, match)
        return F.aggregate(columns, start, lambda s, c: F.element_at(F.transform(F.array(step(s, c)), finish), 1))["d"]

    pair = F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"))
    return F.element_at(F.transform(F.array(pair), solve), 1)


def _segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """0-based start and length of segment ``i`` of a line: all equal, the last ones longer by one where it doesn't divide."""
    base = F.floor(length / parts).cast("int")
    short = parts - (length - base * parts)
    return base * i + F.greatest(F.lit(0), F.lit(i) - short), base + F.when(F.lit(i) >= short, 1).otherwise(0)


_KEYS = "array<struct<key: bigint, probe: boolean>>"


def segment_keys(line: Column, length: Column, most: int, family: int = 0) -> Column:
    """Array of (key, probe): own segments (probe false), and the substrings where a line up to ``most`` shorter may have its own.

    family: tells apart the segments of different limits.
    """
    parts, keys = most + 1, []
    for less in range(most + 1):
        for i in range(parts):
            start, size = _segment(length - less, i, parts)
            for shift in range(max(-i, less - (most - i)), min(i, less + most - i) + 1):
                key = F.xxhash64(F.lit(i + family), length - less, F.substring(line, start + shift + 1, size))
                keys.append(F.struct(key.alias("key"), F.lit(bool(less or shift)).alias("probe")))
    return F.array(*keys)


def line_occurrences(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(doc, th, pos, line, h1, h2)`` of each line with a word; th tells apart texts under one id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return rows.where(F.col("line").rlike(_HAS_WORD)).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(11), "line")})


def _place() -> Column:
    return F.struct("doc", "th", "pos")


def without_frequent_copies(occurrences: DataFrame, repeated: DataFrame) -> DataFrame:
    """``occurrences`` with the first occurrence only of the lines that occur most often.

    repeated: (h1, h2, first, n).  As the counts add up to the number of occurrences, fewer than ``FREQUENT_LINES`` lines can
    occur more often than that number's share of each: the broadcast is bounded whatever the table, and no line
    left comes with more copies than that share.
    """
    total = repeated.agg(F.sum("n")).first()[0] or 0
    frequent = repeated.where(F.col("n") > max(LEAST_COPIES, total // FREQUENT_LINES)).select("h1", "h2", "first")
    marked = occurrences.join(F.broadcast(frequent), ["h1", "h2"], "left")
    return marked.where(F.col("first").isNull() | (F.col("first") == _place())).drop("first")


def _keys_of(line: Column, length: Column, max_edits: int, min_chars: int, short_edits: int, short_chars: int) -> Column:
    """Keys of a line under the limits that hold for its length; a line of ``min_chars`` may also be near to shorter ones."""
    keys = F.when(length >= min_chars, segment_keys(line, length, max_edits)).otherwise(F.array().cast(_KEYS))
    if not short_edits:
        return keys
    return F.when((length >= short_chars) & (length < min_chars + short_edits), F.concat(segment_keys(line, length, short_edits, 1000), keys)).otherwise(keys)


def near_line_links(occurrences: DataFrame, max_edits: int = 2, min_chars: int = 24, short_edits: int = 1, short_chars: int = 12) -> DataFrame:
    """``(h1, h2, first, other)``: each line with a near line; first: its first occurrence; other: that of the near line."""
    line_id = F.struct("h1", "h2").alias("id")
    min_chars, short_chars = max(min_chars, 2 * (max_edits + 1)), max(short_chars, 2 * (short_edits + 1))
    lines = occurrences.withColumn("len", F.char_length("line")).where(F.col("len") >= (min(min_chars, short_chars) if short_edits else min_chars))
    keys = lines.select("h1", F.inline(_keys_of(F.col("line"), F.col("len"), max_edits, min_chars, short_edits, short_chars)))
    keys = keys.repartition("key")  # once, for the counts and for the rows that they pick
    shared = keys.groupBy("key").agg(
        F.min("h1").alias("low"), F.max("h1").alias("high"), F.bool_and("probe").alias("p"), F.count("*").alias("n")
    ).where("low <> high and not p").select("key", "n")
    met = materialize(keys.join(shared.hint("shuffle_hash"), "key").select("key", "n", "h1", "probe").distinct(), "met")
    wanted = materialize(met.select("h1").distinct(), "wanted")
    fits = wanted.count() * 64 <= BROADCAST_BYTES  # a long in a hash table; beyond that the lines are shuffled
    texts = materialize(
        lines.join(F.broadcast(wanted) if fits else wanted, "h1", "left_semi").groupBy("h1", "h2")
        .agg(F.min(_place()).alias("first"), F.first("line").alias("line"), F.first("len").alias("len"))
        .withColumn("sig", letter_signature(F.col("line"))), "texts")
    sides = met.join(texts.select("h1", "h2", "len", "sig"), "h1").withColumn("slices", F.ceil(F.col("n") / SLICE).cast("int"))
    own = sides.where("not probe").select(
        "key", line_id.alias("a"), F.col("len").alias("len_a"), F.col("sig").alias("sig_a"),
        F.pmod(F.xxhash64("h1"), F.col("slices")).cast("int").alias("slice"))
    probes = sides.select(
        "key", line_id.alias("b"), F.col("len").alias("len_b"), F.col("sig").alias("sig_b"), "probe",
        F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    limit = lambda a, b: F.when(F.least(a, b) >= min_chars, max_edits).otherwise(short_edits)
    allowed = limit("len_a", "len_b")
    pairs = own.join(
        probes, (own["key"] == probes["key"]) & (own["slice"] == probes["slice"]) & (F.col("a") != F.col("b")) & (F.col("probe") | (F.col("a") < F.col("b")))
        & (F.abs(F.col("len_a") - F.col("len_b")) <= allowed) & (F.bit_count(F.col("sig_a").bitwiseXOR(F.col("sig_b"))) <= 2 * allowed))
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")

    def side(c: str) -> DataFrame:
        return texts.select(F.struct("h1", "h2").alias(c), F.col("line").alias(f"{c}_line"), F.col("first").alias(f"{c}_first"), F.col("len").alias(f"len_{c}"))

    close = pairs.join(side("a"), "a").join(side("b"), "b")
    close = close.where(banded_distance(F.col("a_line"), F.col("b_line"), max(max_edits, short_edits)) <= allowed)
    close = materialize(close.select("a", "b", "a_first", "b_first"), "close")
    discard(met, wanted, texts, pairs)
    return close.select("a.h1", "a.h2", F.col("a_first").alias("first"), F.col("b_first").alias("other")).unionByName(
        close.select("b.h1", "b.h2", F.col("b_first").alias("first"), F.col("a_first").alias("other")))


RESULTS = ("n_lines", "n_exact", "n_near", "n_kept", "kept_text")


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_edits: int = 2, min_chars: int = 24, short_edits: int = 1, short_chars: int = 12,
) -> DataFrame:
    """``docs`` with the columns n_lines, n_exact, n_near, n_kept and kept_text.

    Lines are cut at ``\\n``.  Lines with a word form classes: equal lines, lines of ``min_chars`` characters or more within
    ``max_edits`` edits of each other, and lines of ``short_chars`` or more of which one is shorter than ``min_chars`` within
    ``short_edits`` (0: only equal ones), directly or over others.  Of each class the first line (least id, then place)
    stays, all others go: n_exact of them equal an earlier line, n_near don't.  Lines without a word always stay, lines
    under ``short_chars`` go only as copies.  kept_text: the lines that stay, joined by ``\\n``; null for a null text.

    Rows with the same id and text count as one document, and get the same result each; a null id sorts first.  An empty
    table gives an empty one.  Columns with the five names are replaced, all others stay whatever they are called.  Very long
    texts: work and memory grow in proportion to a text's lines, each of which is handled alone.
    """
    occurrences = line_occurrences(docs, id_col, text)
    place = _place()
    repeated = materialize(
        occurrences.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
        .where("n > 1").select("h1", "h2", "first", "last", "n"), "repeated")
    links = near_line_links(without_frequent_copies(occurrences, repeated), max_edits, min_chars, short_edits, short_chars)
    root = connected_components(links.select(F.col("first").alias("a"), F.col("other").alias("b")))
    linked = links.select("h1", "h2", "first").distinct().join(root.withColumnsRenamed({"id": "first", "component": "root"}), "first")
    ruled = materialize(
        repeated.where("first <> last").select("h1", "h2", "first")
        .join(linked.select("h1", "h2", "root", F.col("first").alias("near_first")), ["h1", "h2"], "full")
        .select("h1", "h2", F.coalesce("first", "near_first").alias("first"), F.coalesce("root", "first", "near_first").alias("root")), "ruled")
    gone = occurrences.select("h1", "h2", place.alias("at")).distinct().join(ruled, ["h1", "h2"]).where("at <> root")
    by_doc = gone.groupBy("at.doc", "at.th").agg(
        F.count_if(F.col("at") != F.col("first")).alias("n_exact"), F.count_if(F.col("at") == F.col("first")).alias("n_near"), F.collect_list("at.pos").alias("gone"))
    own = [c for c in docs.columns if c not in RESULTS]
    base = docs.select(  # the caller's columns travel in one struct past those of this operator
        F.struct(*own).alias("row"), F.col(id_col).cast("long").alias("key"), F.xxhash64(text).alias("hash"), F.col(text).cast("string").alias("text"))
    out = base.join(by_doc, F.col("key").eqNullSafe(F.col("doc")) & (F.col("hash") == F.col("th")), "left")
    size = F.size(F.split("text", "\n"))
    n_lines = F.when(size >= 0, size).otherwise(0).cast("long")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    cut = F.struct(F.split("text", "\n").alias("lines"), F.array_except(F.sequence(F.lit(0), F.greatest(size, F.lit(1)) - 1), "gone").alias("stay"))
    kept = F.element_at(F.transform(F.array(cut), lambda x: F.array_join(F.transform(x["stay"], lambda i: F.get(x["lines"], i)), "\n")), 1)
    out = out.select("row", n_lines.alias("n_lines"), count("n_exact").alias("n_exact"), count("n_near").alias("n_near"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept_text"))
    return out.select(*[F.col("row")[c].alias(c) for c in own], "n_lines", "n_exact", "n_near", (F.col("n_lines") - F.col("n_exact") - F.col("n_near")).alias("n_kept"), "kept_text")
