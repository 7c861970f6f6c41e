"""Indicator features and word-vector sums.

Odd input: a null or empty list has no element, a null or empty text no token; an
element that stands twice in a list counts once; rows are taken each for itself;
an empty table gives an empty result; other columns stay or are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import tokens


def vocabulary(df: DataFrame, values: Column) -> DataFrame:
    """genre: the distinct elements of a list column."""
    return df.select(F.explode(values).alias("genre")).distinct()


def genre_counts(df: DataFrame, values: Column) -> DataFrame:
    """genre, cnt: rows that have it. Aggregated before the shuffle."""
    return df.select(F.explode(F.array_distinct(values)).alias("genre")).groupBy("genre").agg(F.count(F.lit(1)).alias("cnt"))


def top_genres(counts: DataFrame, n: int = 5) -> DataFrame:
    """The n most frequent; ties go to the later one of the vocabulary."""
    return counts.orderBy(F.desc("cnt"), F.desc("genre")).limit(n)


def onehot(df: DataFrame, values: Column, names: list[str]) -> DataFrame:
    """One 0/1 column for each name, all in one projection; a missing list counts as empty."""
    return df.withColumns({n: F.coalesce(F.array_contains(values, n).cast("int"), F.lit(0)) for n in names})


#: Numbers of a vocabulary that every worker may hold, 64 MB.
HELD = 8_000_000
#: Numbers that are summed at once.
AT_ONCE = 1_000_000


def embed_sum(docs: DataFrame, key: str, text: str, vectors: DataFrame, dimensions: int, held: int = HELD) -> DataFrame:
    """key, hits, vec: the sum of the word vectors of each document's tokens, repeats included; no hit gives zeros. Keys are unique.

    A vocabulary of at most `held` numbers goes to every worker, and documents are not
    shuffled; a larger one is joined by token.
    """
    most = held // max(dimensions, 1)
    found = vectors.select("token", "vec").limit(most + 1).collect()
    if len(found) <= most:
        return _summed_by_workers(docs, key, text, {r.token: i for i, r in enumerate(found)}, np.array([r.vec for r in found], float).reshape(len(found), dimensions))
    return _summed_by_join(docs, key, text, vectors, dimensions)


def _summed_by_workers(docs: DataFrame, key: str, text: str, number: dict[str, int], matrix: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((number, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, matrix = shared.value
        step = max(1, AT_ONCE // max(matrix.shape[1], 1))
        for batch in batches:
            hits, sums = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, matrix.shape[1]))
            for i, words in enumerate(batch.column(1).to_pylist()):
                at = [k for k in map(number.get, words or ()) if k is not None]
                hits[i] = len(at)
                for j in range(0, len(at), step):
                    sums[i] += matrix[at[j : j + step]].sum(axis=0)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * matrix.shape[1]), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits), vec], names=[key, "hits", "vec"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, tokens(F.col(text)).alias("words")).mapInArrow(run, f"`{key}` {kind}, hits long, vec array<double>")


def _summed_by_join(docs: DataFrame, key: str, text: str, vectors: DataFrame, dimensions: int) -> DataFrame:
    """Tokens are counted for each document first, which shrinks what meets the vectors."""
    counted = docs.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    hit = counted.join(vectors, "token")
    sums = hit.groupBy(key).agg(F.sum("n").alias("hits"), *(F.sum(F.get("vec", F.lit(i)) * F.col("n")).alias(f"v{i}") for i in range(dimensions)))
    sums = sums.select(key, "hits", F.array(*(F.col(f"v{i}") for i in range(dimensions))).alias("vec"))
    zeros = F.array_repeat(F.lit(0.0), dimensions)
    return docs.select(key).join(sums, key, "left").select(key, F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("vec", zeros).alias("vec"))
