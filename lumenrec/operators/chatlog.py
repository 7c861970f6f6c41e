"""The log of a chat front end: first-seen registration, typed split, appends.

Odd input: of events with the same order one is taken; a null key is a key like any
other, but is inserted anew each time, as it equals nothing; kinds without a target,
null included, are left out; an empty batch adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first event of each key; aggregated before the shuffle, so a key with many events is no burden."""
    rest = [c for c in events.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("__first")
    return events.groupBy(key).agg(first).select(key, *(F.col(f"__first.{c}").alias(c) for c in rest))


def latest_per_key(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The same for the last event, as a window."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return events.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def unseen(events: DataFrame, existing: DataFrame, key: str, order: list[str]) -> DataFrame:
    """What is to be inserted: the first event of each key that the table does not have."""
    return first_per_key(events, key, order).join(existing.select(key), key, "left_anti")


def insert_unseen(events: DataFrame, path: str, key: str, order: list[str]) -> None:
    """Append the first event of each key that the Parquet table at path does not have; the first write wins."""
    spark = events.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    new = unseen(events, spark.read.parquet(path), key, order) if there else first_per_key(events, key, order)
    new.write.mode("append").parquet(path)


def split_by_type(messages: DataFrame, kind: str, targets: dict[str, str]) -> dict[str, DataFrame]:
    """A frame for each target table; other kinds are left out."""
    return {table: messages.filter(F.col(kind) == value) for value, table in targets.items()}


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def legacy_null_text(df: DataFrame, spelling: str) -> DataFrame:
    """Missing texts as a literal spelling, for readers of the older logs."""
    return df.fillna(spelling)
