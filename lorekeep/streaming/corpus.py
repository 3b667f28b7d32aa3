"""An incrementally kept search corpus: each refresh reads and writes only what belongs to files whose (mtime, size) changed.

A file stream doesn't see deletions, so each refresh compares the full listing with what is held.  What changed goes into a segment of
its own: postings, lengths, and a row a page that is the page's newest word, or says that it went.  Older rows of the page stay where
they are and count no more: only rows of a page's newest generation are live.  Where ``FANOUT`` segments of a level have come
together, their live rows are merged into one of the next level, so a row is rewritten once a level, and there are few levels.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators.search import lengths, postings
from lorekeep.plans.store import discard, materialize
from lorekeep.sources import wiki

#: Segments of a level that are merged.
FANOUT = 4
_KEY = ["path", "mtime_ns", "size"]


@dataclass
class Segment:
    """Rows of the generations up to ``last``: files ``(path, mtime_ns, size, gone, generation)``, and postings and lengths with their page's generation."""

    level: int
    last: int
    files: DataFrame
    postings: DataFrame
    lengths: DataFrame


class Corpus:
    """Postings and lengths of a wiki, brought up to date by :meth:`refresh`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.segments: list[Segment] = []
        self.generation = 0

    def _union(self, name: str, segments: list[Segment] | None = None) -> DataFrame:
        return reduce(DataFrame.unionByName, [getattr(s, name) for s in (self.segments if segments is None else segments)])

    def _newest(self, segments: list[Segment] | None = None) -> DataFrame:
        """``(path, mtime_ns, size, gone, generation)``: each page's last word."""
        rows = self._union("files", segments)
        return rows.groupBy("path").agg(F.max_by(F.struct("mtime_ns", "size", "gone", "generation"), "generation").alias("x")).select("path", "x.*")

    def _live(self, name: str, newest: DataFrame, segments: list[Segment] | None = None) -> DataFrame:
        pages = newest.where("not gone").select(F.col("path").alias("page"), "generation")
        return self._union(name, segments).join(pages, ["page", "generation"], "left_semi")

    @property
    def files(self) -> DataFrame:
        return self._newest().where("not gone").select(*_KEY)

    @property
    def postings(self) -> DataFrame:
        return self._live("postings", self._newest()).drop("generation")

    @property
    def lengths(self) -> DataFrame:
        return self._live("lengths", self._newest()).drop("generation")

    def refresh(self) -> dict[str, int]:
        """Read changed pages, forget deleted ones; how many of either."""
        listed = wiki.list_tree(self.spark, self.root).where("kind = 'file' and path like '%.md'").where(~F.col("path").isin(*wiki.CONFIG_PAGES))
        held = materialize(self.files, "held") if self.segments else listed.select(*_KEY).limit(0)
        changed = materialize(listed.join(held, _KEY, "left_anti"), "changed")
        gone = held.select("path").join(listed, "path", "left_anti")
        gone = materialize(gone, "gone")
        counts = {"changed": changed.count(), "gone": gone.count()}
        if self.segments and not any(counts.values()):
            discard(held, changed, gone)
            return counts
        self.generation += 1
        at = F.lit(self.generation).cast("long").alias("generation")
        content = wiki.with_content(changed, self.root).withColumns({"text": F.make_valid_utf8(F.col("content").cast("string")), "is_config": F.lit(False)})
        docs = wiki.parse_pages(content).select(F.col("path").alias("page"), F.coalesce("title", "stem").alias("title"), "body", "aliases")
        files = changed.select(*_KEY, F.lit(False).alias("gone"), at).unionByName(gone.select("path", F.lit(None).cast("long").alias("mtime_ns"), F.lit(None).cast("long").alias("size"), F.lit(True).alias("gone"), at))
        self.segments.append(Segment(0, self.generation, materialize(files, "files"), materialize(postings(docs).select("*", at), "postings"), materialize(lengths(docs).select("*", at), "lengths")))
        discard(held, changed, gone)
        self._merge()
        return counts

    def _merge(self) -> None:
        """Merge the last segments while ``FANOUT`` of one level end the list; pages that went are forgotten once nothing older is left."""
        while len(self.segments) >= FANOUT and len({s.level for s in self.segments[-FANOUT:]}) == 1:
            rest, old = self.segments[:-FANOUT], self.segments[-FANOUT:]
            newest = materialize(self._newest(old), "newest")
            files = newest if rest else newest.where("not gone")
            merged = Segment(old[0].level + 1, old[-1].last, materialize(files.select(*_KEY, "gone", "generation"), "files"),
                             materialize(self._live("postings", newest, old), "postings"), materialize(self._live("lengths", newest, old), "lengths"))
            self.segments = [*rest, merged]
            discard(newest, *[df for s in old for df in (s.files, s.postings, s.lengths)])

    def signature(self) -> str:
        """A hash of all (path, mtime, size): equal signatures mean that what hangs on the corpus (in-link counts) still holds."""
        row = self.files.select(F.xxhash64("path", "mtime_ns", "size").alias("h")).agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x"), F.count("*").alias("n")).first()
        return f"{row['s']}:{row['x']}:{row['n']}"
