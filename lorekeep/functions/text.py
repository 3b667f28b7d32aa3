"""Scalar functions on page texts, as column expressions; each takes and gives columns.

Lengths count code points.  White space in trimming is Unicode's.
"""

from __future__ import annotations

import html
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as X

#: The CJK ranges that are cut into bigrams, and the link syntaxes.
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}"
WIKILINK = r"\[\[([^\[\]\r\n]+?)\]\]"
COMMENT = r"(?<![^\r\n])[ \t]*<!--(?:(?!<!--|-->)[\s\S])*-->[ \t]*(?![^\r\n])"
LINE_BREAKS = r"\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}"
INDEX_LINK = r"\[[^\[\]\r\n]*\]\(([^()\r\n]*+(?:\([^()\r\n]*+\)[^()\r\n]*+)*+)\)"  # possessive: a target of any length takes no stack
DIGEST = r"(?s)^(.+)@sha256:([0-9a-f]{64})$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Every character that Unicode calls white space, and the four separators that Python strips as well.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column | str) -> Column:
    return F.trim(col(c), F.lit(SPACES))


def tokenize(text: Column | str) -> Column:
    """Tokens in order, repeats kept: words of [a-z0-9] after lower-casing, CJK runs as overlapping bigrams (alone: one character)."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    runs = F.regexp_extract_all(low, F.lit(f"[{CJK}]+|[a-z0-9]+"), F.lit(0))
    bigrams = lambda s: F.transform(F.sequence(F.lit(1), F.char_length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))
    cut = lambda s: F.when(s.rlike(f"^[{CJK}]") & (F.char_length(s) > 1), bigrams(s)).otherwise(F.array(s))
    words = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))  # most texts hold no CJK: no test of each word
    return F.when(low.rlike(f"[{CJK}]"), F.flatten(F.transform(runs, cut))).otherwise(words)


def wikilinks(text: Column | str) -> Column:
    """Inner texts of ``[[...]]`` in order."""
    return F.regexp_extract_all(col(text), F.lit(WIKILINK), F.lit(1))


def link_stem(raw: Column | str) -> Column:
    """Key of a link: before the first ``|`` and ``#``, last path part, without ``.md``, lower-case."""
    target = strip(F.substring_index(F.substring_index(col(raw), "|", 1), "#", 1))
    name = F.lower(F.substring_index(F.replace(target, F.lit("\\"), F.lit("/")), "/", -1))
    return F.regexp_replace(name, r"\.md$", "")  # one occurrence of the name: plans copy what a filter tests


@F.pandas_udf(X.StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold().replace("_", "-"), na_action="ignore")


def fold_stem(stem: Column | str) -> Column:
    """NFKC, case folding and ``_`` to ``-``.  Call it on distinct stems: non-ASCII ones pass through Python."""
    s = col(stem)
    return F.when(s.rlike(r"^[\x00-\x7F]*$"), F.replace(F.lower(s), F.lit("_"), F.lit("-"))).otherwise(_fold(s))


def fold_ascii(stem: Column | str) -> Column:
    """:func:`fold_stem` where stems are known to be ASCII: no Python in the plan."""
    return F.replace(F.lower(col(stem)), F.lit("_"), F.lit("-"))


def strip_comments(text: Column | str) -> Column:
    """HTML comments that own their lines as blanks of the same length, line breaks kept, so places behind them hold; inline and unclosed ones stay."""
    t = col(text)
    blank = F.transform(F.regexp_extract_all(t, F.lit(f"({COMMENT})"), F.lit(1)), lambda c: F.regexp_replace(c, f"[^{LINE_BREAKS}]", " "))
    woven = F.zip_with(F.split(t, COMMENT), blank, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(F.contains(t, F.lit("<!--")), F.array_join(woven, "")).otherwise(t)


def link_display(raw: Column | str) -> Column:
    r = col(raw)
    return strip(F.when(F.contains(r, F.lit("|")), F.regexp_replace(r, r"(?s)^[^|]*\|", "")).otherwise(F.split_part(r, F.lit("#"), F.lit(1))))


def page_title(title: Column | str, stem: Column | str) -> Column:
    return F.when(F.length(strip(title)) > 0, strip(title)).otherwise(col(stem))


def page_type(kind: Column | str) -> Column:
    return F.when(F.length(col(kind)) > 0, col(kind)).otherwise("unknown")


def substantive_chars(body: Column | str) -> Column:
    """Non-space characters on lines that are neither blank nor headings."""
    lines = F.filter(F.split(col(body), r"\R"), lambda x: ~strip(x).rlike(r"^#{1,6}(\s|$)"))
    return F.aggregate(lines, F.lit(0), lambda n, x: n + F.char_length(F.regexp_replace(x, r"(?U)\s", "")))


def snippet(body: Column | str, tokens: Column | str, width: int = 140) -> Column:
    """``width`` characters from the first place of any token, white space collapsed; from the start if none is found."""
    b, low = col(body), F.lower(col(body))
    at = lambda t: F.when(t.rlike("^[a-z0-9]+$"), F.regexp_instr(low, F.concat(F.lit("(?<![a-z0-9])"), t, F.lit("(?![a-z0-9])")))).otherwise(F.instr(low, t))
    first = F.coalesce(F.array_min(F.filter(F.transform(col(tokens), at), lambda p: p > 0)), F.lit(1))
    return F.trim(F.regexp_replace(F.substring(b, first, F.lit(width)), r"(?U)\s+", " "))


def raw_slug(name: Column | str) -> Column:
    s = F.regexp_replace(F.regexp_replace(col(name), r"[^\p{L}\p{N}_.\-]+", "-"), r"-+", "-")
    return F.regexp_replace(s, r"^[-.]+|[-.]+$", "")


#: In file names, dashes become "-", zero-width characters a space, quotes and the ellipsis go.
NAME_DASHES = "—–―‒~"
NAME_ZERO_WIDTH = "\u200B\uFEFF"
NAME_DROPPED = "\"'“”‟„«»‘’‚‛‹›「」『』`…"


def once(c: Column, body) -> Column:
    """``body(c)`` with ``c`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(c), body), 1)


def _plain(ranges) -> str:
    """A regular expression of texts of characters that NFKC leaves alone, whatever stands beside them: no marks, nothing that composes."""
    fine = [c for a, b in ranges for c in range(a, b) if not unicodedata.combining(chr(c)) and unicodedata.is_normalized("NFKC", chr(c))]
    return "^[" + "".join(rf"\x{{{c:X}}}" if a == 1 else rf"\x{{{c:X}}}-\x{{{c + a - 1:X}}}" for c, a in _runs(fine)) + "]*$"


def _runs(numbers: list[int]) -> list[tuple[int, int]]:
    """(start, length) of runs of rising numbers."""
    out: list[tuple[int, int]] = []
    for n in numbers:
        out[-1:] = [(out[-1][0], out[-1][1] + 1)] if out and sum(out[-1]) == n else [*out[-1:], (n, 1)]
    return out


#: Latin, Greek, Cyrillic, punctuation and the common ideographs: most names are of these alone and need no Python.
PLAIN = _plain(((0, 0x2B0), (0x370, 0x530), (0x2000, 0x2070), (0x4E00, 0xA000)))


@F.pandas_udf(X.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def basename(path: Column | str) -> Column:
    """The last part of a path that names something; a backslash is a character like others."""
    parts = F.filter(F.split(col(path), "/"), lambda p: ~p.isin("", "."))
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.when(col(path).isNotNull(), F.lit("")))


def normalize_basename(name: Column | str) -> Column:
    """A file name without folders, NFKC, look-alikes folded, trimmed."""
    base = basename(name)
    folded = F.coalesce(nfkc(F.when(~base.rlike(PLAIN), base)), base)  # the others pass Python as nulls
    dashes, spaces = "-" * len(NAME_DASHES), " " * len(NAME_ZERO_WIDTH)
    return strip(F.translate(folded, NAME_DASHES + NAME_ZERO_WIDTH + NAME_DROPPED, dashes + spaces))


def suffix(name: Column | str) -> Column:
    """Lower-case ending with its dot; empty for names that only begin or end with a dot."""
    return F.lower(F.regexp_extract(col(name), r"(?s)^.+(\.[^.]+)$", 1))


#: Fixed value: endings that are converted, never taken as text.
REJECTED_SUFFIXES = (".txt", ".pdf", ".docx", ".doc", ".html", ".htm", ".rtf", ".epub")


def safe_raw_target(name: Column | str) -> Column:
    """struct(target, error): where a text of this name or title goes under ``raw/``; error: suffix, or empty if nothing of the name is left."""
    bare = lambda x: F.when(x["ending"] == ".md", F.regexp_replace(x["base"], r"(?s)\.[^.]+$", "")).otherwise(x["base"])
    error = lambda x: F.when(x["ending"].isin(*REJECTED_SUFFIXES), "suffix").when(F.length(x["slug"]) == 0, "empty")
    split = once(normalize_basename(name), lambda base: F.struct(base.alias("base"), suffix(base).alias("ending")))
    slugged = once(split, lambda x: F.struct(x["ending"].alias("ending"), raw_slug(bare(x)).alias("slug")))
    judged = once(slugged, lambda x: F.struct(x["slug"].alias("slug"), error(x).alias("error")))
    return once(judged, lambda x: F.struct(F.when(x["error"].isNull(), F.concat(F.lit("raw/"), x["slug"], F.lit(".md"))).alias("target"), x["error"].alias("error")))


def text_admitted(text: Column | str, most_bytes: int = 5 << 20) -> Column:
    t = col(text)
    return F.coalesce((F.length(strip(t)) > 0) & (F.octet_length(t) <= most_bytes) & ~t.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), F.lit(False))


def parse_digest(value: Column | str) -> Column:
    """struct(path, sha256) of ``path@sha256:hex``, the last mark counting; null if malformed."""
    v = col(value)
    return F.when(v.rlike(DIGEST), F.struct(F.regexp_extract(v, DIGEST, 1).alias("path"), F.regexp_extract(v, DIGEST, 2).alias("sha256")))


def format_digest(path: Column | str, sha256: Column | str) -> Column:
    return F.concat(col(path), F.lit("@sha256:"), F.lower(col(sha256)))


def normal_path(path: Column | str) -> Column:
    """Path with ``.`` and ``..`` resolved lexically; what would leave the top keeps its ``..`` in front."""
    parts = F.filter(F.split(col(path), "/"), lambda p: ~p.isin("", "."))
    # runs of names between the steps up, each name with its slash: a turn for a step up, not for a name
    runs = lambda names: F.split(F.concat(F.array_join(names, "/"), F.lit("/")), r"(?:^|(?<=/))\.\./")
    stuck = lambda done: done.isin("", "../") | done.endswith("/../")
    up = lambda done: F.when(stuck(done), F.concat(done, F.lit("../"))).otherwise(F.regexp_replace(done, "[^/]+/$", ""))
    step = lambda done, run: F.when(done.isNull(), run).otherwise(F.concat(up(done), run))
    walked = lambda names: F.aggregate(runs(names), F.lit(None).cast("string"), step, lambda done: F.regexp_replace(done, "/$", ""))
    return once(parts, lambda names: F.when(F.size(names) == 0, "").otherwise(walked(names)))


def inside(path: Column | str, top: str = "") -> Column:
    """Whether a relative path stays below ``top`` (lexically)."""
    return once(normal_path(path), lambda normal: inside_as(path, normal, top))


def inside_as(path: Column | str, normal: Column | str, top: str = "") -> Column:
    """:func:`inside` of a path whose normal form is known."""
    p, normal = col(path), col(normal)
    relative = ~p.startswith("/") & ~F.contains(p, F.lit("\\"))
    return relative & ~normal.rlike(r"^\.\.(/|$)") & (normal.startswith(f"{top}/") if top else F.length(normal) > 0)


def first_line_break(text: Column | str) -> Column:
    found = F.regexp_extract(col(text), r"(\r\n|\r|\n)", 1)
    return F.when(found == "", F.lit("\n")).otherwise(found)


def split_lines(text: Column | str) -> Column:
    parts = F.split(col(text), r"\r\n|\r|\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_targets(text: Column | str) -> Column:
    """Distinct local targets of markdown links: anchors, ``./`` and external addresses removed; comments aren't looked at."""
    raw = F.regexp_extract_all(col(text), F.lit(INDEX_LINK), F.lit(1))
    clean = lambda t: F.regexp_replace(F.replace(strip(F.split_part(t, F.lit("#"), F.lit(1))), F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    local = F.filter(raw, lambda t: ~F.contains(t, F.lit("://")) & ~F.lower(strip(t)).startswith("mailto:"))
    return F.array_distinct(F.filter(F.transform(local, clean), lambda t: t != ""))


def index_links(text: Column | str) -> Column:
    """:func:`line_targets` of a small text, comments left out; indexes of any size go through ``operators.index``."""
    return line_targets(strip_comments(text))


def page_argument_ok(arg: Column | str) -> Column:
    a = strip(arg)
    return (F.length(a) > 0) & (F.char_length(a) <= 200) & ~a.rlike(r"[\x00-\x1F\x7F]")


#: Fixed value: what a message can ask for without a question.
COMMANDS = ("search", "new", "help", "page")


def strip_mention(text: Column | str) -> Column:
    """A group message without the mentions that begin it."""
    return F.regexp_replace(F.regexp_replace(col(text), r"(?U)^(@\S+\s*)+", ""), r"(?U)^\s+", "")


def command(text: Column | str, attachments: Column | None = None) -> Column:
    """struct(kind, argument): search, new, help or page for a slash command, whose name ends at a blank; attachment; else prose, unknown commands included."""
    t = strip(strip_mention(text))
    word = F.lower(strip(F.split_part(F.substring(t, 2, 1 << 30), F.lit(" "), F.lit(1))))
    known = F.startswith(t, F.lit("/")) & word.isin(*COMMANDS)
    with_files = F.lit(False) if attachments is None else attachments
    kind = F.when(with_files, "attachment").when(known, word).otherwise("prose")
    rest = F.when(F.contains(t, F.lit(" ")), strip(F.substring(t, F.instr(t, " ") + 1, F.lit(1 << 30)))).otherwise("")
    return F.struct(kind.alias("kind"), F.when(with_files, "").when(known, rest).otherwise(t).alias("argument"))


def access_permitted(user: Column, chat: Column, group: Column, mentioned: Column, users: list[str] | None, chats: list[str]) -> Column:
    """A user on the list (None: anyone); in a group also a chat on the list and a mention."""
    who = F.lit(True) if users is None else user.isin(users)
    return who & (~group | (chat.isin(chats) & mentioned))


#: Endings of files that are shown as images, of texts, and of images that pages may refer to.
UPLOAD_IMAGES = (".png", ".jpg", ".jpeg", ".gif", ".webp")
TEXT_SUFFIXES = (
    "", ".md", ".markdown", ".txt", ".text", ".rst", ".org", ".log", ".csv", ".tsv", ".json", ".jsonl", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf",
    ".py", ".js", ".mjs", ".ts", ".tsx", ".jsx", ".html", ".htm", ".css", ".scss", ".sh", ".bash", ".zsh", ".c", ".h", ".cpp", ".hpp", ".cc", ".java", ".go", ".rs",
    ".rb", ".php", ".pl", ".lua", ".sql", ".xml", ".svg", ".tex", ".bib", ".r", ".jl")
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".tif", ".tiff", ".svg")


def upload_class(name: Column | str, content: Column | str) -> Column:
    """image by ending; text if the first 64 KiB are UTF-8 and, unless the ending is one of texts, hold no NUL; else binary."""
    ending, head = suffix(name), F.substring(col(content), 1, 65_536)
    readable = F.is_valid_utf8(head.cast("string"))
    no_nul = F.instr(F.decode(head, "ISO-8859-1"), "\x00") == 0  # one character a byte
    return F.when(ending.isin(*UPLOAD_IMAGES), "image").when(readable & (ending.isin(*TEXT_SUFFIXES) | no_nul), "text").otherwise("binary")


def message_text(blocks: Column | str) -> Column:
    """Text blocks of array<struct<type, text>> joined by line breaks, reminders removed."""
    texts = F.transform(F.filter(col(blocks), lambda b: b["type"] == "text"), lambda b: b["text"])
    return strip(F.regexp_replace(F.array_join(texts, "\n"), r"(?s)<system-reminder>.*?</system-reminder>", ""))


@F.pandas_udf(X.BooleanType())
def url_is_safe(s: pd.Series) -> pd.Series:
    """Whether a link address, entities resolved and controls dropped, is relative or http, https or mailto."""

    def ok(x):
        if x is None:
            return None
        plain = re.sub(r"[\x00-\x20]", "", html.unescape(x))
        scheme = re.match(r"([a-zA-Z][a-zA-Z0-9+.\-]*):", plain)
        return not scheme or scheme[1].lower() in ("http", "https", "mailto")

    return s.map(ok)


#: What of an HTML table may stay.
TABLE_TAGS = ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup", "col")
TABLE_HIDDEN = ("script", "style", "template")
TABLE_NUMBERS = ("colspan", "rowspan")
TABLE_CHOICES = {
    "align": ("left", "right", "center", "justify", "char"), "valign": ("top", "middle", "bottom", "baseline"), "scope": ("row", "col", "rowgroup", "colgroup")}


class _Table(HTMLParser):
    """Rebuilds a table: allowed tags with checked attributes, all text escaped, hidden elements and comments left out with what they hold."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden, self.tables = 0, 0

    @staticmethod
    def attribute(key: str, value: str | None) -> str:
        v = (value or "").strip()
        fine = v.isdigit() if key in TABLE_NUMBERS else v.lower() in TABLE_CHOICES.get(key, ())
        return f' {key}="{html.escape(v)}"' if fine else ""

    def handle_starttag(self, tag, attrs):
        if tag in TABLE_HIDDEN:
            self.hidden += 1
        elif not self.hidden and tag in TABLE_TAGS:
            self.tables += tag == "table"
            self.out.append(f"<{tag}{''.join(self.attribute(*a) for a in attrs)}>")

    def handle_startendtag(self, tag, attrs):
        if tag not in TABLE_HIDDEN:
            was = self.tables
            self.handle_starttag(tag, attrs)
            self.tables = was

    def handle_endtag(self, tag):
        if self.hidden:
            self.hidden -= tag in TABLE_HIDDEN
        elif tag in TABLE_TAGS and tag != "col":
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(html.escape(data))


@F.pandas_udf(X.StringType())
def safe_table(s: pd.Series) -> pd.Series:
    """A piece of HTML with a table, rebuilt; null if no table is opened in it (it is then shown as text)."""

    def clean(x):
        p = _Table()
        p.feed(x)
        p.close()
        return "".join(p.out) if p.tables else None

    return s.map(clean, na_action="ignore")


#: A line that opens or closes a fenced block.
FENCE = re.compile(r"\s{0,3}(?:```|~~~)")


def _message_blocks(lines: list[str], limit: int) -> list[str]:
    """Runs of lines: a fenced block is one, whatever its length; others are as long as the limit lets them."""
    out: list[list[str]] = [[]]
    fenced = False
    for line in lines:
        mark = FENCE.match(line) is not None
        if not fenced and (mark or sum(map(len, out[-1])) + len(out[-1]) + len(line) + 1 > limit):
            out.append([])
        out[-1].append(line)
        fenced ^= mark
        if mark and not fenced:
            out.append([])
    return ["\n".join(x).strip("\n") for x in out]


def _message_pieces(block: str, limit: int) -> list[str]:
    """A block cut at its last line break within the limit, or at the limit; no piece is blank."""
    out = []
    while len(block) > limit:
        at = block.rfind("\n", 0, limit)
        at = at if at > 0 else limit
        out.append(block[:at].rstrip())
        block = block[at:].lstrip("\n")
    return [x for x in [*out, block] if x]


def message_parts(text: str | None, limit: int, most: int) -> tuple[list[str], int]:
    """Parts of at most ``limit`` characters, and how many characters are dropped.

    Fenced blocks stay whole where they fit.  If there are more than ``most`` parts, one is left free for the notice that says so, and
    what comes after is dropped; one part of text always stays.
    """
    text = (text or "").strip()
    if len(text) <= limit:
        return ([text] if text else []), 0
    parts: list[str] = []
    for block in _message_blocks(text.split("\n"), limit):
        for piece in _message_pieces(block, limit):
            if parts and len(parts[-1]) + 1 + len(piece) <= limit:
                parts[-1] += "\n" + piece
            else:
                parts.append(piece)
    if len(parts) <= most:
        return parts, 0
    kept = max(1, most - 1)
    return parts[:kept], len("\n".join(parts[kept:]))


def split_message(limit: int, most: int):
    """A function of a text column to struct(parts, dropped): see :func:`message_parts`."""
    if limit < 1 or most < 1:
        raise ValueError("limit and most must be 1 or more")

    @F.pandas_udf(X.StructType([X.StructField("parts", X.ArrayType(X.StringType())), X.StructField("dropped", X.IntegerType())]))
    def cut(s: pd.Series) -> pd.DataFrame:
        found = [message_parts(x, limit, most) for x in s]
        return pd.DataFrame({"parts": [p for p, _ in found], "dropped": pd.Series([d for _, d in found], dtype="int32")})

    return cut


@F.pandas_udf(X.StringType())
def html_text(s: pd.Series) -> pd.Series:
    """Visible text of an HTML page, blocks on lines of their own."""

    class Text(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "title")
            if tag in ("p", "div", "li", "br", "tr", "h1", "h2", "h3", "ul", "nav"):
                self.out.append("\n")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "title") and self.hidden > 0

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(data)

    def text(x):
        p = Text()
        p.feed(x)
        p.close()
        return re.sub(r"\s*\n\s*", "\n", re.sub(r"[ \t]+", " ", "".join(p.out))).strip()

    return s.map(text, na_action="ignore")


IMAGE_REF = r"!\[[^\]\r\n]*\]\(([^()\s]+)\)"


def image_refs(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(IMAGE_REF), F.lit(1))


def image_ref_admitted(ref: Column | str) -> Column:
    """Relative, contained after percent-decoding, and of an image ending (that the file exists is a join)."""
    r = decoded_ref(ref)
    return ~external_ref(ref) & inside(r) & suffix(basename(r)).isin(*IMAGE_SUFFIXES)


def external_ref(ref: Column | str) -> Column:
    """Whether a reference has a scheme or is absolute; it is left as it is."""
    return col(ref).rlike(r"^([A-Za-z][A-Za-z0-9+.\-]*:|/|~)")


def decoded_ref(ref: Column | str) -> Column:
    """A reference with its percent escapes decoded; as it is, if some are malformed."""
    return F.coalesce(F.try_url_decode(F.replace(col(ref), F.lit("+"), F.lit("%2B"))), col(ref))


#: Shortest secret, shortest part of an address's path that counts as one, and signs that end a sentence, not an address.
MIN_SECRET, MIN_SECRET_SEGMENT, CLOSING = 8, 16, ".,;:!?)]}。，）”"
_ADDRESS = r"[a-zA-Z][a-zA-Z0-9+.\-]*://[^\s'\"<>]+"


def masked_address(address: Column | str) -> Column:
    """An address without user, query and fragment, its long path parts masked; ``***`` for what is no address with a host."""
    a = F.regexp_replace(col(address), r"(?s)[?#].*$", "")
    whole = r"(?s)^([a-zA-Z][a-zA-Z0-9+.\-]*)://(?:[^/]*@)?(\[[^\]/]*\]|[^:/@]+)(?::([0-9]{0,5}))?(/.*)?$"
    part = lambda k: F.regexp_extract(a, whole, k)
    port = F.when(part(3) != "", F.concat(F.lit(":"), part(3).cast("int").cast("string"))).otherwise("")
    path = F.array_join(F.transform(F.split(part(4), "/"), lambda p: F.when(F.char_length(p) >= MIN_SECRET_SEGMENT, "***").otherwise(p)), "/")
    fine = a.rlike(whole) & (F.coalesce(part(3).try_cast("int"), F.lit(0)) <= 65535)
    return F.when(fine, F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.when(port == ":0", "").otherwise(port), path)).otherwise("***")


def redact(text: Column | str, secrets: list[str]) -> Column:
    """Known secrets of ``MIN_SECRET`` characters or more replaced, longest first; then every address masked, signs behind it kept."""
    out = col(text)
    for s in sorted({s for s in secrets if len(s) >= MIN_SECRET}, key=lambda s: (-len(s), s)):
        out = F.replace(out, F.lit(s), F.lit("***"))
    closing = "[" + re.escape(CLOSING) + "]"
    bare = lambda u: F.regexp_replace(u, f"{closing}+$", "")
    masked = F.transform(F.regexp_extract_all(out, F.lit(f"({_ADDRESS})"), F.lit(1)), lambda u: F.concat(masked_address(bare(u)), F.substring(u, F.char_length(bare(u)) + 1, F.char_length(u))))
    woven = F.zip_with(F.split(out, _ADDRESS), masked, lambda x, y: F.concat(x, F.coalesce(y, F.lit(""))))
    return F.when(F.contains(out, F.lit("://")), F.array_join(woven, "")).otherwise(out)


def log_entry(line: Column | str) -> Column:
    """struct(date, op, title) of ``## [YYYY-MM-DD] op | title``; null otherwise."""
    pattern = r"^## \[(\d{4}-\d{2}-\d{2})\] ([^|]+?) \| (.*)$"
    x = col(line)
    part = lambda k: F.regexp_extract(x, pattern, k)
    return F.when(x.rlike(pattern), F.struct(F.try_to_date(part(1)).alias("date"), part(2).alias("op"), part(3).alias("title")))
