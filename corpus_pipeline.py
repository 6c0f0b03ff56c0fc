"""A training-corpus pipeline of five stages, each over all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a frame; `run` writes each result as Parquet in the shared folder and
reads it again for the next stage. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm import bpe, decontam, linededup, neardup, quality
from trawl.llm._spark import new_table_path
from trawl.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all quality rules. The rules read the row's own text, so no join is needed.

    Null and empty texts fail. Each row is judged alone, so null and repeated ids and ties make no difference.
    """
    return quality.keep(docs).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that come earlier elsewhere; a document of which no word is left goes.

    Null texts and rows of a null id stay as they are. Rows that repeat an id are told apart by their text; those that
    repeat both have one verdict. Of equal and similar lines the one of the least id, then place, stays.
    """
    out = linededup.drop_duplicate_lines(docs, keep_columns=True)
    left = out.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8), the document of the least id.

    Rows of a null id and of a null or wordless text stay. Rows that repeat an id are one document and stay or go together.
    """
    verdicts = neardup.near_duplicates(docs, shingle=5, percent=80)
    return docs.join(verdicts.filter("NOT kept").select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage (ten words) of a benchmark item.

    Rows are named by a hash of their id and text, so that rows of null and repeated ids are judged by their own text.
    Null texts have no passage and stay, as do all rows if no item has a word.
    """
    named = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    verdicts = decontam.contamination(decontam.build_postings(named, "_row"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return named.join(verdicts.filter("contaminated").select(F.col("doc_id").alias("_row")), "_row", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the token ids of each row; a null or empty text has none. Null and repeated ids stay as they are."""
    return bpe.encode(docs, tokenizer_path()).select("doc_id", "n_tokens", "ids")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("encode", encode)]

#: Near-duplicate groups, fuzzy lines and BPE are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_table_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
