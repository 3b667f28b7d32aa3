"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and reread as the next
stage's docs.  All stages but the last return the columns of their docs; whatever these are called, they travel in
one struct past the operators' own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import linededup, neardup, packing, quality
from lorekeep.plans.store import materialize


def _carried(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(F.struct(*docs.columns).alias("row"), *columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    lang = "lang" if "lang" in docs.columns else None
    return quality.quality_rules(_carried(docs, "text", *([lang] if lang else [])), lang=lang).where("kept").select("row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; those go that lose lines and have no word left."""
    out = linededup.line_dedup(_carried(docs, "doc_id", "text"))
    out = out.where((F.col("n_exact") + F.col("n_near") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that with the least id, null ids last; of rows that share it, the first.

    Rows are told apart by a number of their own, so rows that share an id but no text are judged apart, and rows without an
    id like all others.  Documents without a word have no duplicates and stay.  Sets are of two-word shingles, as in
    the operator's query: sets of five words lose copies with a few scattered edits.
    """
    numbered = materialize(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("n")), "numbered")
    found = neardup.near_duplicates(numbered.select(F.col("n").alias("doc_id"), F.col("row.text").alias("text")), shingle_words=2, percent=80)
    member = found.where("n_shingles > 0").select(F.col("doc_id").alias("n"), "component_id").join(numbered.select("n", F.col("row.doc_id").alias("doc_id")), "n")
    member = materialize(member, "member")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "n")
    first = member.groupBy("component_id").agg(F.min(rank).alias("kept"), F.count("*").alias("rows")).where("rows > 1")
    gone = member.join(materialize(first.select("component_id", F.col("kept.n").alias("kept")), "kept"), "component_id").where("n <> kept").select("n")
    return numbered.join(gone, "n", "left_anti").select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]
#: The packing of byte-pair tokens has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table over ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
