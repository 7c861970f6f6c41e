"""From raw documents to packed training sequences: STAGES in order, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs; all but the last return the
columns of documents, and further columns are kept. An empty table passes through
every stage; rows that are equal in all columns are treated alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrec.llm.common import free_name, staged
from lumenrec.llm.decontaminate import drop_contaminated
from lumenrec.llm.line_dedup import line_dedup
from lumenrec.llm.near_dedup import drop_near_duplicates
from lumenrec.llm.packing import packed
from lumenrec.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar rejects go.

    Null and empty texts hold no clause and stay; a score at the threshold rejects; rows of one doc_id are judged
    each by its text; without labels the grammar's own words and weights decide.
    """
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; a document of which nothing is left, such as a copy, goes with them; n_chars follows the text.

    Null, empty and blank texts stay as they are (n_chars of a null text is null); of several copies the one with
    the least doc_id keeps the passage, a null doc_id comes last; rows of one doc_id and text all keep it.
    """
    had = free_name(docs, "had")
    left = line_dedup(docs.withColumn(had, F.col("text").rlike(r"\S")))
    gone = F.coalesce(F.col(had) & ~F.col("text").rlike(r"\S"), F.lit(False))
    return left.filter(~gone).drop(had).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the least doc_id stays.

    Texts that are null or without words are like nothing and stay, as do rows without doc_id and all rows of the
    doc_id that stays.
    """
    return drop_near_duplicates(docs, k=5, threshold=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to a fifth of its words edited, go.

    Null and empty texts hold none and stay; items that are null or without words are passed over.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is cut and packed into sequences of 1024 tokens; a null text is packed as an empty one, each row by itself."""
    return packed(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", dedup_lines), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", pack)]

#: A learned classifier, sketches and a tokenizer cannot be written as SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
