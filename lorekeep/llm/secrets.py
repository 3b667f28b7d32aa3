"""Secret scans with corpus-wide ownership frequency, in built-in expressions only.

Patterns give candidate spans: three base kinds, which are always reported, and further kinds that are only candidates:
key blocks, signed tokens, tokens with a vendor's prefix, passwords in addresses, and opaque words.  Each candidate's value
is hashed, and the hashes are aggregated over the corpus by distinct repositories and owners.  A value that many owners or
repositories hold was copied from documentation or test data; a value of few looks live.  Of the further kinds, live-looking
spans are added: opaque words only if they mix their characters as random keys do, or if the same value stands elsewhere as
a password, key or token, which the corpus shows and the text alone doesn't.

Places are found by marking matches in a copy of the text and summing the lengths of its pieces.  Texts are read once and stay
where they are; what moves is a row of numbers and a digest for each candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.plans.store import materialize

#: (kind, pattern, group of the value, least characters of the value).  The base kinds come first, in the order in which equal starts are listed.
BASE_KINDS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
MORE_KINDS = (
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\r\n]+", 0, 60),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("vendor", r"(gh[opusr]_|glpat-|npm_|xox[abprs]-|[rs]k_live_|AIza)[A-Za-z0-9_-]{16,}", 0, 20),
    ("url", r"://[A-Za-z0-9._~%+-]+:([A-Za-z0-9._~%!$*+=-]+)@", 1, 6),
    ("opaque", r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
)
KINDS = (*BASE_KINDS, *MORE_KINDS)
NAMES = tuple(k[0] for k in KINDS)
#: A text without any of these can't hold a match of the kind; those that can are searched.
NEEDED = {
    "assign": ("passw", "secret", "token", "api"), "access": ("AKIA",), "pem": ("-----BEGIN",), "jwt": ("eyJ",),
    "vendor": ("gh", "glpat-", "npm_", "xox", "k_live_", "AIza"), "url": ("://",),
}
#: A run that an opaque word or a hexadecimal one of their least length stands in.
LONG_RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: A value that more owners, or more repositories, hold is a copied example.
MOST_OWNERS, MOST_REPOSITORIES = 2, 4
#: Least different characters of an opaque word that counts by itself; it must hold both cases and a digit, too.
MIN_DISTINCT = 12
_MARK, _STAND_IN = "\x01", "\x02"
_SPAN = "array<struct<start:bigint,kind:int,stop:bigint,value:string>>"


def _once(value: Column, use) -> Column:
    """``use(value)``, with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running_sums(xs: Column) -> Column:
    """Sums of an array's first 1, 2, ... entries.

    By blocks of the square root of its size, as an array that grows by one entry is copied each time.
    """
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long"))
    none = F.array().cast("array<bigint>")
    sums = lambda ys: F.aggregate(ys, none, lambda acc, x: F.concat(acc, F.array(last(acc) + x)).cast("array<bigint>"))

    def joined(ys: Column, width: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(ys) - 1) / width).cast("int")), lambda b: sums(F.slice(ys, b * width + 1, width)))
        return _once(blocks, lambda bs: _once(sums(F.transform(bs, lambda b: F.element_at(b, -1))), lambda tops: F.flatten(
            F.transform(bs, lambda b, i: F.transform(b, lambda x: x + F.when(i > 0, F.get(tops, i - 1)).otherwise(F.lit(0).cast("long")))))))

    filled = lambda ys: joined(ys, F.ceil(F.sqrt(F.size(ys))).cast("int"))
    return F.when(F.size(xs) == 0, none).otherwise(_once(xs.cast("array<bigint>"), filled))


def matches(text: Column, kind: str) -> Column:
    """Array of struct(start, kind, stop, value) of a kind's leftmost, non-overlapping matches whose value is long enough, in order.

    Places count code points, stop exclusive; kind is the number in ``KINDS``.  The text must not hold the mark.
    """
    _, pattern, group, least = KINDS[NAMES.index(kind)]
    marked = F.regexp_replace(text, f"({pattern})", f"{_MARK}$1{_MARK}${group + 1}{_MARK}")

    def spans(parts: Column) -> Column:  # outside, match, value, outside, match, value, ..., outside
        n = F.floor((F.size(parts) - 1) / 3).cast("int")
        at = F.sequence(F.lit(0), n - 1)
        steps = F.transform(at, lambda i: (F.char_length(F.get(parts, 3 * i)) + F.char_length(F.get(parts, 3 * i + 1))).cast("long"))
        found = _once(running_sums(steps), lambda stops: F.transform(at, lambda i: F.struct(
            (F.get(stops, i) - F.char_length(F.get(parts, 3 * i + 1))).alias("start"), F.lit(NAMES.index(kind)).alias("kind"),
            F.get(stops, i).alias("stop"), F.get(parts, 3 * i + 2).alias("value"))))
        return F.when(n == 0, F.array().cast(_SPAN)).otherwise(F.filter(found, lambda x: F.char_length(x["value"]) >= least))

    return _once(F.split(marked, _MARK), spans)


def all_matches(text: Column) -> Column:
    """:func:`matches` of all kinds, ordered by start and kind; an empty array for most texts after a few searches for fixed words."""
    none = F.array().cast(_SPAN)

    def of(t: Column, low: Column, kind: str, run: Column) -> Column:
        gate = run if kind in ("hex", "opaque") else None
        for word in NEEDED.get(kind, ()):
            here = F.contains(low if kind == "assign" else t, F.lit(word))
            gate = here if gate is None else gate | here
        return F.when(gate, matches(t, kind)).otherwise(none)

    def gated(x: Column) -> Column:
        return F.concat(*[of(x["t"], x["low"], kind, x["run"]) for kind in NAMES])

    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), _MARK, _STAND_IN)
    told = _once(plain, lambda t: F.struct(t.alias("t"), F.lower(t).alias("low"), t.rlike(LONG_RUN).alias("run")))
    return F.array_sort(_once(told, gated))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(n) for n in NAMES])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def _random_looking(value: Column) -> Column:
    different = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]") & (different >= MIN_DISTINCT)


def value_frequencies(candidates: DataFrame) -> DataFrame:
    """``(value, n_repositories, n_owners, named)`` from ``(value, owner, repository, named)``: how many different ones hold a value, and whether it is named a secret anywhere.

    Three aggregations, each of which sums before it shuffles: a value that all documents hold is one row of each task.  A repository is one
    of its owner's, so equal names of two owners are two.
    """
    repositories = candidates.groupBy("value", "owner", "repository").agg(F.max("named").alias("named"))
    owners = repositories.groupBy("value", "owner").agg(F.count("*").alias("n"), F.max("named").alias("named"))
    return owners.groupBy("value").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"), F.max("named").alias("named"))


def secret_scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repository: str = "source", owner: str | None = None,
    most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES,
) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, live_spans)`` of every row of ``docs``.

    spans: all base spans and the added ones, ``kind:start:end`` by start and kind.  live_spans: those of them, base or added, whose value
    at most ``most_owners`` owners and ``most_repositories`` repositories hold, n_live of them; n_example: the base spans of copied values.
    ``owner`` names the column of owners; without it, an owner is what stands before the first ``/`` of the repository.

    A null text is empty: no spans, and the digest of no bytes.  A null repository or owner is the empty name.  Repeated rows and ids
    give a row each, equal ones equal; an empty table an empty one.  Other columns, whatever they are called, aren't read.  A very long
    text is one row's work, its list of candidates included; added spans never overlap base ones,
    opaque words no added ones either.
    """
    repo = F.coalesce(F.col(repository).cast("string"), F.lit(""))
    who = F.substring_index(repo, "/", 1) if owner is None else F.coalesce(F.col(owner).cast("string"), F.lit(""))
    base = lambda xs: F.filter(xs, lambda x: x["kind"] < len(BASE_KINDS))
    narrow = lambda xs: F.transform(xs, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"), F.unhex(F.sha2(x["value"].cast("binary"), 256)).alias("value"), _random_looking(x["value"]).alias("random")))
    found = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), repo.alias("repository"), who.alias("owner"), _once(all_matches(F.col(text)), narrow).alias("spans"))
    found = materialize(found, "candidates")  # rows keep their numbers, and texts are searched once
    held = found.where(F.size("spans") > 0).select("row", "repository", "owner", F.explode("spans").alias("x")).select("row", "repository", "owner", "x.*")
    named = ~F.col("kind").isin(NAMES.index("hex"), NAMES.index("opaque"))
    frequencies = materialize(value_frequencies(held.select("value", "owner", "repository", named.alias("named"))), "frequencies")
    judged = held.select("row", "start", "kind", "stop", "value", "random").join(frequencies, "value")
    live = (F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories)
    is_base, opaque = F.col("kind") < len(BASE_KINDS), F.col("kind") == NAMES.index("opaque")
    upto = lambda order: Window.partitionBy("row").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    apart = lambda those: (  # noqa: E731  two running bounds instead of a comparison of all pairs
        F.coalesce(F.max(F.when(those, F.col("stop"))).over(upto(F.asc("start"))), F.lit(-1)) <= F.col("start")) & (
        F.coalesce(F.min(F.when(those, F.col("start"))).over(upto(F.desc("start"))), F.lit(1 << 62)) >= F.col("stop"))
    more = live & apart(is_base) & (~opaque | ((F.col("random") | F.col("named")) & apart(is_base | (live & ~opaque))))
    told = judged.select("row", "start", "kind", "stop", live.alias("live"), is_base.alias("base"), (is_base | more).alias("kept"))
    spans = told.where("kept").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "live", "base"))).alias("all"))
    empty, sha = F.lit(""), lambda x: F.sha2(x.cast("binary"), 256)
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == NAMES.index(kind))).cast("long").alias(f"n_{kind}")
    base_columns = ["doc_id", *[count(k[0]) for k in BASE_KINDS], sha(_listed(base(F.col("spans")))).alias("base_sha256")]
    none = found.where(F.size("spans") == 0).select(*base_columns, empty.alias("spans"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_example"), empty.alias("live_spans"))
    lives = F.filter("all", lambda x: x["live"])
    some = found.where(F.size("spans") > 0).join(spans, "row", "left").select(
        *base_columns, F.coalesce(_listed(F.col("all")), empty).alias("spans"), F.coalesce(F.size(lives), F.lit(0)).cast("long").alias("n_live"),
        F.coalesce(F.size(F.filter("all", lambda x: x["base"] & ~x["live"])), F.lit(0)).cast("long").alias("n_example"), F.coalesce(_listed(lives), empty).alias("live_spans"))
    return none.unionByName(some)
