"""The corpus pipeline: quality rules, near-dedup, decontamination, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to
the shared scratch folder, deletes the stage's own scratch tables and reads it back as the next stage's docs.  All stages but the last return
the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import materialize, temporary
from quadrille.llm.decontaminate import find_leaks
from quadrille.llm.neardup import near_duplicates
from quadrille.llm.packing import pack
from quadrille.llm.quality import quality_rules
from quadrille.llm.secrets import scan_secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL cannot express trained trees, min-max hashing, an SVD or a tokenizer; tests compare with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rules or the trees reject; the trees learn from the documents that came in.

    Cases: a null or empty text is rejected; null ids and repeated rows are judged like others; texts of
    any length are judged whole; a score that ties with the cut is kept; an empty table gives no rows;
    columns besides those of `documents` are dropped, and may have any names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality_rules(docs, labels, carry=list(COLUMNS))
    return judged.where("kept").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(COLUMNS)])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group (5-word shingles, similarity 0.8 or more).

    A row that repeats a kept id and text is a copy too and goes; rows with a null id are kept.  Null and
    empty texts are like nothing and stay; texts of any length are compared whole; of equal rows any one
    stays; an empty table gives no rows; other columns are dropped.
    """
    dropped = near_duplicates(docs, k=5, percent=80).where("not kept").select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(materialize(dropped, "dropped"), "doc_id", "left_anti")
    repeated = materialize(kept.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated")
    once = kept.join(repeated, "doc_id", "left_anti")
    again = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.union(again).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which an item of the benchmark leaks.

    A row is known by its id and its text, so that one with a null id goes too if it leaks, and one that
    merely shares the id of a leaking row stays.  Null and empty texts leak nothing; texts of any length
    are searched whole; of equal rows all go or all stay; an empty table gives no rows; other columns are
    dropped.
    """
    rows = docs.select(*COLUMNS).withColumn("_text_hash", F.xxhash64("text"))
    leaks = find_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=("_text_hash",)).select(F.col("doc_id").alias("_id"), F.col("_text_hash").alias("_hash")).distinct()
    leaks = materialize(leaks, "leaks")
    return rows.join(leaks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left_anti").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret, such as [ASSIGN]; no document goes, and clean texts stay as they are.

    Cases: a null text becomes an empty one; null ids and repeated rows stay; texts of any length are
    scanned whole; where secrets overlap, the mark names the first; an empty table gives no rows; other
    columns are dropped.
    """
    found = scan_secrets(docs, with_redacted=True, carry=("text", "lang", "source", "n_chars"))
    hit = F.col("redacted").isNotNull()
    text = F.coalesce("redacted", "_c0")
    return found.select("doc_id", text.alias("text"), F.col("_c1").alias("lang"), F.col("_c2").alias("source"), F.when(hit, F.char_length(text)).otherwise(F.col("_c3")).cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths, with their ids.

    Cases: a null or empty text is the closing id alone; null ids and repeated rows give sequences of their
    own; texts of any length are cut whole; pieces that tie in id and start are numbered in any order; an
    empty table gives no rows; other columns are ignored.
    """
    return pack(docs, 1024).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secret scan", secrets),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with temporary(spark):
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
